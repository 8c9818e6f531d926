"""Dialogues over views that are released round by round; an answer may use released views alone.

A dialogue is a row (episode, round, released array, task_type, question
fields, evidence array). Rounds are built for all episodes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.families import PLANAR
from orrery.operators.visibility import views
from orrery.plans.durable import shuffle_partitions


def releases(seen: DataFrame, per_round: int = 2) -> DataFrame:
    """Views dealt to rounds in order: (episode, round, released, known), known being all views until then."""
    v = views(seen).select("episode", "step", F.floor(F.col("step") / per_round).cast("int").alias("round"))
    r = v.groupBy("episode", "round").agg(F.array_sort(F.collect_list("step")).alias("released"))
    before = F.flatten(F.collect_list("released").over(W.partitionBy("episode").orderBy("round").rowsBetween(W.unboundedPreceding, 0)))
    return r.withColumn("known", before)


def memory_rounds(seen: DataFrame, per_round: int = 2) -> DataFrame:
    """For each round but the first: an entity that earlier rounds showed and this one does not, first by name, and the view that last showed it."""
    at = seen.select("episode", "entity", "step", F.floor(F.col("step") / per_round).cast("int").alias("round"))
    rounds = at.select("episode", "round").distinct()
    # last sighting before a round, for entities that the round lacks
    before = rounds.join(at.select("episode", "entity", F.col("step").alias("s"), F.col("round").alias("r")), "episode").where("r < round")
    last = before.groupBy("episode", "round", "entity").agg(F.max("s").alias("evidence"))
    gone = last.join(at.select("episode", "round", "entity").distinct(), ["episode", "round", "entity"], "left_anti")
    pick = gone.groupBy("episode", "round").agg(F.min(F.struct("entity", "evidence")).alias("p"))
    return pick.select("episode", "round", F.lit("last_seen_memory").alias("task_type"), "p.entity", "p.evidence")


def entry_rounds(seen: DataFrame, per_round: int = 2) -> DataFrame:
    """For each round: the entities that no earlier view had, and how many were known before."""
    first = seen.groupBy("episode", "entity").agg(F.min("step").alias("first"))
    r = first.withColumn("round", F.floor(F.col("first") / per_round).cast("int")).groupBy("episode", "round").agg(F.array_sort(F.collect_set("entity")).alias("entered"))
    known = F.coalesce(F.sum(F.size("entered")).over(W.partitionBy("episode").orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("n_known_before", known.cast("int"))


def evidence_faults(rounds: DataFrame, released: DataFrame) -> DataFrame:
    """Rounds whose evidence view is not released yet: (episode, round, evidence)."""
    known = released.select("episode", "round", F.explode("known").alias("evidence"))
    return rounds.select("episode", "round", "evidence").join(known, ["episode", "round", "evidence"], "left_anti")


def messages(rounds: DataFrame, question: str, answer: str) -> DataFrame:
    """Rounds as chat rows (episode, turn, role, text), two turns a round in order."""
    nth = F.row_number().over(W.partitionBy("episode").orderBy("round")) - 1
    pair = F.array(
        F.struct((2 * F.col("n")).alias("turn"), F.lit("user").alias("role"), F.col(question).alias("text")),
        F.struct((2 * F.col("n") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col(answer).alias("text")),
    )
    return rounds.withColumn("n", nth).select("episode", F.explode(pair).alias("m")).select("episode", "m.*")


#: Views that each of the seven rounds releases, by step; how many a trajectory has; least pixels, margin and angle (fixed values).
SLOTS = ((0,), (1, 2), (3, 4), (5, 6, 7), (8, 9), (10,), ())
N_VIEWS = 11
LEAST_PIXELS = 256
LEAST_MARGIN_M = 0.4
LEAST_ANGLE_DEG = 20.0
MOST_NAMES = 8
KINDS = ("inventory", "covis_relation", "temporal", "crossview", "perspective", "epistemic_loop", "layout")


#: Pairs times targets that are looked at together.
TRIPS = 1 << 20


def _first(flags: np.ndarray) -> int | None:
    return int(flags.argmax()) if flags.any() else None


def _view_round(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, shown: np.ndarray, clear: np.ndarray) -> tuple | None:
    """The clearest quadrant: (origin, facing, target, its name); shown and clear are (views, objects)."""
    n, best, seen = len(x), None, shown.astype(np.float32)
    c = clear.astype(np.float32)
    o, f = np.nonzero((c.T @ c > 0) & ~np.eye(n, dtype=bool))
    well = clear.any(axis=0)
    for at in range(0, len(o), max(1, TRIPS // n)):
        i, j = o[at : at + max(1, TRIPS // n)], f[at : at + max(1, TRIPS // n)]
        dx, dy = x[j] - x[i], y[j] - y[i]
        long = np.sqrt(dx * dx + dy * dy)
        far = long >= 1e-6
        i, j = i[far], j[far]
        ux, uy = (dx[far] / long[far])[:, None], (dy[far] / long[far])[:, None]
        vx, vy = x[None] - x[i][:, None], y[None] - y[i][:, None]
        qx, qy = vx * uy - vy * ux, vx * ux + vy * uy
        ok = well[None] & (np.abs(qx) > np.abs(uy) * hx + np.abs(ux) * hy) & (np.abs(qy) > np.abs(ux) * hx + np.abs(uy) * hy)
        ok[np.arange(len(i)), i] = ok[np.arange(len(i)), j] = False
        p, t = np.nonzero(ok)
        ax, ay = np.abs(qx[p, t]), np.abs(qy[p, t])
        angle = np.degrees(np.minimum(np.arctan2(ax, ay), np.arctan2(ay, ax)))
        steep = angle >= LEAST_ANGLE_DEG
        p, t, angle = p[steep], t[steep], np.floor(angle[steep] * 100 + 0.5) / 100
        if not len(p):
            continue
        mixed = ((c[:, i] * c[:, j]).T @ seen > 0)[p, t]
        k = int(np.lexsort((t, j[p], i[p], -angle, mixed))[0])
        key = (bool(mixed[k]), -float(angle[k]), int(i[p[k]]), int(j[p[k]]), int(t[k]))
        if best is None or key < best[0]:
            best = key, ("front" if qy[p[k], t[k]] >= 0 else "back") + ("-right" if qx[p[k], t[k]] >= 0 else "-left")
    return best and (*best[0][2:], best[1])


def _layout(relation: np.ndarray, margin: np.ndarray, least: float = 0.5, most: int = 3, per_relation: int = 2) -> list[tuple[int, int]]:
    """What layout_facts() takes of all pairs of one scene."""
    n, out = len(margin), []
    free = np.triu(margin >= least, 1)
    while len(out) < most and free.any():
        a, b = divmod(int(np.where(free, margin, -1.0).argmax()), n)
        out.append((a, b))
        free[[s for s, _ in out]] = False
        named = sorted({k for fact in out for k in fact})
        free[np.ix_(named, named)] = False
        if sum(relation[p] == relation[a, b] for p in out) >= per_relation:
            free &= relation != relation[a, b]
    return out if len(out) >= 2 else []


def _rounds(label: list[str], x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, step: np.ndarray, who: np.ndarray, ok: np.ndarray, unseen: str | None, slots: tuple[tuple[int, ...], ...]) -> list[tuple]:
    """The certified rounds of one scene, before views are dealt to them: (slot, evidence, objects, answer).

    Objects are in the order of their labels; step, who and ok say what is
    shown, who by object; unseen is null where no loop is closed.
    """
    n = len(label)
    at, row = np.unique(step, return_inverse=True)
    slot = np.full(len(at), len(slots))
    for i in reversed(range(len(slots))):
        if slots[i]:
            slot[at <= max(slots[i])] = i
    shown, clear = np.zeros((len(at), n), bool), np.zeros((len(at), n), bool)
    shown[row, who], clear[row[ok], who[ok]] = True, True
    dx, dy = x[:, None] - x[None], y[:, None] - y[None]
    relation = np.where(np.abs(dx) >= np.abs(dy), dx > 0, 2 + (dy > 0))
    margin = np.floor(np.abs(np.abs(dx) - np.abs(dy)) * 1000 + 0.5) / 1000
    big = margin >= LEAST_MARGIN_M

    def clearest(pairs: np.ndarray) -> tuple[int, int]:
        return divmod(int(np.where(pairs, margin, -1.0).argmax()), n)

    def together(flags: np.ndarray) -> np.ndarray:
        f = flags.astype(np.float32)
        return f.T @ f > 0

    out, used = [], None
    names = np.flatnonzero(clear[at == 0].any(axis=0))[:MOST_NAMES]
    if len(names) >= 2:
        words = [label[k] for k in names]
        out.append((0, [0], words, ", ".join(words)))
    early = clear[slot <= 1]
    pairs = np.triu(together(early), 1) & big
    if pairs.any():
        a, b = clearest(pairs)
        used = relation[a, b]
        out.append((1, [int(at[slot <= 1][_first(early[:, a] & early[:, b])])], [label[a], label[b]], PLANAR[used]))
    low = 2 if used is not None else 1 if out else 0
    some = shown[slot <= 2]
    if low and len(some):
        last = len(some) - 1 - some[::-1].argmax(axis=0)
        k = _first(some.any(axis=0) & clear[slot <= 2][last, np.arange(n)] & (slot[last] < low))
        if k is not None:
            out.append((2, [int(at[last[k]])], [label[k]], str(at[last[k]] + 1)))
    well = clear[slot <= 3].any(axis=0)
    pairs = well[:, None] & well[None] & ~together(shown) & big
    if pairs.any():
        other = pairs & (relation != used) if used is not None else pairs
        a, b = clearest(other if other.any() else pairs)
        steps = [s for k in (a, b) for s in at[(slot <= 3) & shown[:, k]][:2].tolist()]
        out.append((3, sorted(set(steps)), [label[a], label[b]], PLANAR[relation[a, b]]))
    view = _view_round(x, y, hx, hy, shown[slot <= 4], clear[slot <= 4])
    if view:
        o, f, t, quadrant = view
        steps = [int(at[_first(clear[:, o] & clear[:, f])]), int(at[_first(shown[:, t])])]
        out.append((4, sorted(set(steps)), [label[k] for k in (o, f, t)], quadrant))
    end = sum(map(len, slots)) - 1
    anchor = _first(shown[at == 0].any(axis=0) & clear[at == end].any(axis=0))
    if unseen is not None and anchor is not None:
        out.append((5, [0, end], [unseen, label[anchor]], "unknown"))
    facts = _layout(relation, margin)
    if facts:
        out.append((6, [], [], "; ".join(f"{label[a]} {PLANAR[relation[a, b]]} {label[b]}" for a, b in facts)))
    return out


def _told(slots: tuple[tuple[int, ...], ...]):
    """The rounds of each row (episode, unseen, things, seen), of those that have a dialogue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = (pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("things", "seen"))
            label, *spots = batch.column("things").flatten().flatten()
            step, name, ok = batch.column("seen").flatten().flatten()
            spots = [c.to_numpy(zero_copy_only=False) for c in spots]
            # a label and its scene as one number
            codes = pa.concat_arrays([label, name]).dictionary_encode()
            kinds, codes = len(codes.dictionary), codes.indices.to_numpy()
            scene = lambda n: np.repeat(np.arange(len(batch)), n)
            key, wanted = scene(sizes) * kinds + codes[: len(label)], scene(counts) * kinds + codes[len(label) :]
            order = np.argsort(key)
            place = order[np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)]
            known = key[place] == wanted
            step, ok = step.to_numpy(), ok.to_numpy(zero_copy_only=False)
            ends, stops = np.cumsum(sizes), np.cumsum(counts)
            label, kept, rounds = label.to_pylist(), [], []
            for i, unseen in enumerate(batch.column("unseen").to_pylist()):
                lo, hi = ends[i] - sizes[i], ends[i]
                rows = np.arange(stops[i] - counts[i], stops[i])[known[stops[i] - counts[i] : stops[i]]]
                made = _rounds(label[lo:hi], *[c[lo:hi] for c in spots], step[rows], place[rows] - lo, ok[rows], unseen, slots)
                if len(made) >= 4 and any(r[0] in (3, 4) for r in made):
                    kept.append(i)
                    rounds.append([dict(zip(("slot", "evidence", "objects", "answer"), r, strict=True)) for r in made])
            kind = pa.list_(pa.struct([("slot", pa.int32()), ("evidence", pa.list_(pa.int32())), ("objects", pa.list_(pa.string())), ("answer", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("episode").take(pa.array(kept, pa.int64())), pa.array(rounds, kind)], names=["episode", "rounds"])

    return run


def scene_dialogues(entities: DataFrame, shown: DataFrame, trajectories: DataFrame, slots: tuple[tuple[int, ...], ...] = SLOTS) -> DataFrame:
    """The certified rounds of each episode's dialogue: (episode, round, kind, released, evidence, objects, answer), round from 1.

    entities: (episode, label, x, y, hx, hy), the named objects that some view
    shows and that are the only one of their label, in the first view's
    frame, a bounded vocabulary a scene; shown: (episode, step, label,
    pixels); trajectories: (episode, n_views, closed, unseen), unseen being a
    name that no view shows, or null.

    A round may use the views released until then: those of its slot and all
    before. Inventory names what the first view shows; covis_relation relates
    the clearest pair of one view; temporal asks for what the newest views no
    longer show; crossview relates two objects that no view shows together,
    in another relation than covis_relation if there is one; perspective asks for the clearest
    quadrant, of an object apart from the others' views if possible;
    epistemic_loop asks at the closed loop for what was never shown and for what is still there;
    layout sums up. A round that cannot be certified is skipped and its views
    go to the next, which alone matters to temporal, whose newest views these
    are. An episode with another number of views, fewer than four
    rounds, or neither crossview nor perspective has no dialogue.

    A scene is one row, so its pairs and triples stay in its task and are never
    shuffled; triples are made TRIPS at a time.
    """
    right = trajectories.where(F.col("n_views") == sum(map(len, slots))).select("episode", F.when(F.col("closed"), F.col("unseen")).alias("unseen"))
    thing = F.struct("label", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "hx", "hy")])
    things = entities.where("label is not null").join(right.select("episode"), "episode", "left_semi").groupBy("episode").agg(F.sort_array(F.collect_list(thing)).alias("things"))
    look = F.struct(F.col("step").cast("int").alias("step"), "label", F.coalesce(F.col("pixels") >= LEAST_PIXELS, F.lit(False)).alias("ok"))
    seen = shown.where("label is not null and step is not null").join(right.select("episode"), "episode", "left_semi").groupBy("episode").agg(F.collect_list(look).alias("seen"))
    # the work of a scene is in its pairs, not in its bytes: tasks by number
    rows = right.join(things, "episode").join(seen, "episode").select("episode", "unseen", "things", "seen").repartition(shuffle_partitions(right.sparkSession), "episode")
    made = "array<struct<slot: int, evidence: array<int>, objects: array<string>, answer: string>>"
    rows = rows.mapInArrow(_told(slots), f"episode {rows.schema['episode'].dataType.simpleString()}, rounds {made}")
    ids = lambda s, low, i: F.array(*[F.lit(x) for k in range(low, i + 1) for x in s[k]]).cast("array<int>")
    out = rows.select("episode", "rounds", F.posexplode("rounds").alias("at", "r"))
    before = F.when(F.col("at") == 0, -1).otherwise(F.get("rounds", F.col("at") - 1)["slot"])
    dealt = F.array(*[ids(slots, i, i) for i in range(len(slots))])
    released = F.flatten(F.slice(dealt, before + 2, F.col("r.slot") - before))
    names = F.array(*map(F.lit, KINDS))
    return out.select("episode", (F.col("at") + 1).alias("round"), names[F.col("r.slot")].alias("kind"), released.alias("released"), "r.evidence", "r.objects", "r.answer")
