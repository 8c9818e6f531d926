"""Choices among pairs of objects and pairs of views: frame families, anchored target views, queries with quotas.

Views of a trajectory are few; objects of a scene may be many. So pairs of
views are made for each object, and pairs of objects only of those whose bound
can still win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.plans.durable import cut

LEAST_TURN_DEG = 30.0
LEAST_RATIO = 1.25


def bindings(views: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks that bind their object: clear, in a good frame, and alone of their confusable group among the clear ones of the view.

    views: (episode, view, step, yaw, passed); masks: (episode, view, entity,
    label, group, pixels, box_w, box_h, clear). Rows (episode, view, step,
    yaw, entity, label, pixels, side).
    """
    seen = masks.where("clear")
    alone = seen.groupBy("episode", "view", "group").agg(F.count("*").alias("n"), F.first(F.struct("entity", "label", "pixels", F.least("box_w", "box_h").alias("side"))).alias("m")).where("n = 1")
    return alone.join(views.where("passed").select("episode", "view", "step", "yaw"), ["episode", "view"]).select("episode", "view", "step", "yaw", "m.*")


def _turned(bound: DataFrame, entities: DataFrame, least: float) -> DataFrame:
    """Each object with each two views that bind it and are turned apart: the least side and pixels of its two masks."""
    a = bound.select("episode", "entity", "label", F.struct("view", "step", "yaw").alias("va"), F.col("pixels").alias("pa"), F.col("side").alias("sa"))
    b = bound.select("episode", "entity", F.struct("view", "step", "yaw").alias("vb"), F.col("pixels").alias("pb"), F.col("side").alias("sb"))
    both = a.join(b, ["episode", "entity"]).where("va.step < vb.step")
    turn = F.abs(F.degrees(F.col("va.yaw") - F.col("vb.yaw"))) % 360
    both = both.withColumn("turn_deg", F.least(turn, 360 - turn)).where(F.col("turn_deg") >= least)
    at = entities.select("episode", "entity", "x", "y")
    return both.join(at, ["episode", "entity"]).select("episode", "va", "vb", "turn_deg", "entity", "label", "x", "y", F.least("sa", "sb").alias("side"), F.least("pa", "pb").alias("pixels"))


def _families(some: DataFrame) -> DataFrame:
    """Families of the objects that share two views, with their score."""
    keys = ["episode", "va", "vb", "turn_deg"]
    side = lambda p: some.select(*keys, F.col("entity").alias(f"{p}_id"), F.col("label").alias(f"{p}_label"), *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "side", "pixels")])
    pairs = side("s").join(side("r"), keys).where("s_id < r_id and s_label <> r_label")
    seen = lambda v: G.camera_components(F.col("s_x"), F.col("s_y"), F.col("r_x"), F.col("r_y"), F.col(f"{v}.yaw"))
    ratio = lambda r, f: F.greatest(F.abs(r), F.abs(f)) / F.greatest(F.least(F.abs(r), F.abs(f)), F.lit(1e-12))
    (ra, fa), (rb, fb) = seen("va"), seen("vb")
    pairs = pairs.where(G.is_dominant(ra, fa, LEAST_RATIO) & G.is_dominant(rb, fb, LEAST_RATIO))
    of = lambda r, f: G.dominant_relation(r, f)["relation"]
    pairs = pairs.select(
        "episode", F.col("s_id").alias("subject"), F.col("r_id").alias("reference"), F.col("va.view").alias("view_a"), F.col("vb.view").alias("view_b"), F.col("va.step").alias("step_a"), F.col("vb.step").alias("step_b"),
        of(ra, fa).alias("relation_a"), of(rb, fb).alias("relation_b"), F.least("s_side", "r_side").alias("side"), F.least("s_pixels", "r_pixels").alias("pixels"),
        F.round(F.least(ratio(ra, fa), ratio(rb, fb)), 9).alias("ratio"), F.round("turn_deg", 9).alias("turn_deg"),
    )
    return pairs.where("relation_a <> relation_b")


def best_families(bound: DataFrame, entities: DataFrame, least: float = LEAST_TURN_DEG, seeds: int = 3) -> DataFrame:
    """Of each episode the best frame family: two objects of different labels in two views that give different relations.

    bound: see bindings(); entities: (episode, entity, x, y). Best is by the
    least side and the least pixels of the four masks, the lesser dominance
    ratio and the turn (larger is better), then the earlier views, then the
    larger ids. Rows (episode, subject, reference, view_a, view_b, relation_a,
    relation_b, side, pixels, ratio, turn_deg); episodes without a family have
    none.

    The side of a family is at most that of either object in the two views.
    The largest `seeds` objects of each two views give a first best, and then
    only objects at least as large take part. That is exact: what is left out
    loses to the first best. An episode without a first best keeps all.
    """
    turned = cut(_turned(bound, entities, least))
    rank = F.row_number().over(W.partitionBy("episode", "va", "vb").orderBy(F.col("side").desc(), F.col("pixels").desc(), "entity"))
    first = _families(turned.withColumn("nth", rank).where(F.col("nth") <= seeds).drop("nth")).groupBy("episode").agg(F.max("side").alias("bound"))
    kept = turned.join(first, "episode", "left").where(F.col("bound").isNull() | (F.col("side") >= F.col("bound"))).drop("bound")
    score = F.struct("side", "pixels", "ratio", "turn_deg", (-F.col("step_a")).alias("ma"), (-F.col("step_b")).alias("mb"), "subject", "reference", "view_a", "view_b", "relation_a", "relation_b")
    best = _families(kept).groupBy("episode").agg(F.max(score).alias("b"))
    return best.select("episode", *[F.col(f"b.{c}") for c in ("subject", "reference", "view_a", "view_b", "relation_a", "relation_b", "side", "pixels", "ratio", "turn_deg")])


def anchor_views(masks: DataFrame, quality: Column | str = "salient") -> DataFrame:
    """Of each episode and object the best view that can name it: good enough, and the only one of its label there.

    masks: (episode, view, step, entity, label, pixels, side, outer_share,
    sides, and quality). Rows (episode, entity, label, view, step). Better is
    off the border, with less in the outer ring, larger, more pixels, earlier.
    """
    good = F.col(quality) if isinstance(quality, str) else quality
    lone = masks.groupBy("episode", "view", "label").agg(F.count_distinct("entity").alias("n")).where("n = 1").drop("n")
    named = masks.where(good).join(lone, ["episode", "view", "label"])
    score = F.struct((F.size("sides") == 0).alias("free"), (-F.col("outer_share")).alias("ring"), "side", "pixels", (-F.col("step")).alias("early"), "view")
    return named.groupBy("episode", "entity", "label").agg(F.max(score).alias("b")).select("episode", "entity", "label", "b.view", (-F.col("b.early")).alias("step"))


def target_views(sources: DataFrame, anchors: DataFrame, views: DataFrame, masks: DataFrame) -> DataFrame:
    """Questions whether an object would be seen from a held-out view, with the object's place named in the source.

    sources: (target, source), the source episode of each target episode;
    anchors: (target, view, origin, facing), where the held-out view stands
    and looks; views: (episode, view, step, x, y, yaw, passed) and masks (see
    anchor_views, with clear and salient) of both kinds of episodes.

    Rows (target, source, view, form, origin, facing, origin_view,
    facing_view, entity, entity_view, visible, from_view, right_m, front_m,
    yaw_deg). Two a held-out view at most: the first object (by label, then
    id) that is to be seen, clearly, and the first that is not; both known from
    the source, with an anchor view there. form is anchored where origin and
    facing have anchor views too. A target without any such question has its
    views told by pose from the nearest source view (then the earliest). A
    source with one bad frame gives none.
    """
    bad = views.where(~F.coalesce("passed", F.lit(False))).select(F.col("episode").alias("source")).distinct()
    pairs = sources.join(bad, "source", "left_anti")
    held = anchors.join(pairs, "target").join(views.select(F.col("episode").alias("target"), "view"), ["target", "view"], "left_semi")
    named = anchor_views(masks).withColumnRenamed("view", "entity_view").drop("step")
    place = lambda p: named.select(F.col("episode").alias("source"), F.col("entity").alias(p), F.col("entity_view").alias(f"{p}_view"))
    stand = held.join(place("origin"), ["source", "origin"]).join(place("facing"), ["source", "facing"])
    shown = masks.select(F.col("episode").alias("target"), "view", "entity", F.col("clear").alias("clearly"))

    def asked(rows: DataFrame) -> DataFrame:
        """The first object that is seen and the first that is not, of each held-out view."""
        known = rows.join(named.withColumnRenamed("episode", "source"), "source").where(~F.coalesce((F.col("entity") == F.col("origin")) | (F.col("entity") == F.col("facing")), F.lit(False)))
        seen = known.join(shown, ["target", "view", "entity"], "left").withColumn("visible", F.col("clearly").isNotNull()).where("not visible or clearly")
        keys = ["target", "source", "view", "origin", "facing", "origin_view", "facing_view", "visible"]
        return seen.groupBy(*keys).agg(F.min(F.struct("label", "entity", "entity_view")).alias("m")).select(*keys, "m.entity", "m.entity_view")

    none = lambda kind: F.lit(None).cast(kind)
    full = asked(stand).select("*", F.lit("anchored").alias("form"), none(views.schema["view"].dataType).alias("from_view"), *[none("double").alias(c) for c in ("right_m", "front_m", "yaw_deg")])
    rest = held.join(full.select("target").distinct(), "target", "left_anti").select("target", "source", "view").distinct()
    kinds = {c: masks.schema["entity"].dataType for c in ("origin", "facing")} | {f"{c}_view": views.schema["view"].dataType for c in ("origin", "facing")}
    plain = asked(rest.select("*", *[none(k).alias(c) for c, k in kinds.items()]))
    at = views.select(F.col("episode").alias("target"), "view", *[F.col(c).alias(f"t_{c}") for c in ("x", "y", "yaw")])
    of = views.select(F.col("episode").alias("source"), F.col("view").alias("from_view"), "step", *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "yaw")])
    apart = F.round(F.hypot(F.col("t_x") - F.col("s_x"), F.col("t_y") - F.col("s_y")), 9)
    near = rest.join(at, ["target", "view"]).join(of, "source").groupBy("target", "source", "view").agg(F.min(F.struct(apart.alias("apart"), "step", "from_view", "t_x", "t_y", "t_yaw", "s_x", "s_y", "s_yaw")).alias("n"))
    right, front = G.camera_components(F.col("n.t_x"), F.col("n.t_y"), F.col("n.s_x"), F.col("n.s_y"), F.col("n.s_yaw"))
    moved = near.select("target", "source", "view", F.col("n.from_view").alias("from_view"), right.alias("right_m"), front.alias("front_m"), G.wrap_degrees(F.degrees(F.col("n.t_yaw") - F.col("n.s_yaw"))).alias("yaw_deg"))
    told = plain.join(moved, ["target", "source", "view"]).withColumn("form", F.lit("pose"))
    return full.unionByName(told)


def pose_instruction(right: Column, front: Column, yaw_deg: Column) -> Column:
    """How to get from one pose to another, in words: to a tenth of a metre and a whole degree."""
    metres = lambda v: F.format_string("%.1f", F.abs(v))
    aside = F.when(F.abs(right) < 0.05, "stay in line").otherwise(F.concat(F.lit("move "), metres(right), F.when(right >= 0, " m right").otherwise(" m left")))
    ahead = F.when(F.abs(front) < 0.05, "stay in depth").otherwise(F.concat(F.lit("move "), metres(front), F.when(front >= 0, " m forward").otherwise(" m back")))
    turn = F.when(F.abs(yaw_deg) < 0.5, "keep facing the same way").otherwise(F.concat(F.lit("turn "), F.format_string("%.0f", F.abs(yaw_deg)), F.when(yaw_deg > 0, " degrees left").otherwise(" degrees right")))
    return F.concat_ws(", ", aside, ahead, turn)


def quota_queries(candidates: DataFrame, seen: DataFrame, per_relation: int = 2, relations: int = 6) -> DataFrame:
    """Relations of a scene's oracle that each episode can ask: both objects seen, each pair once, at most per_relation of a relation, in the oracle's order.

    candidates: (episode, place, subject, reference, relation, margin), place
    ascending within the episode; seen: (episode, step, entity). Rows
    (episode, place, subject, reference, relation, margin, evidence): evidence
    is the first step that shows both, or else the first step of each.

    A choice depends on those before it, but on few: of a pair and relation
    only the first counts, and at most per_relation * relations pairs can be
    taken, so a relation needs no more than so many, and its quota, of its
    first rows. That bound holds for any number of candidates; the fold over
    what is left keeps the pairs taken.
    """
    first = seen.groupBy("episode", "entity").agg(F.min("step").alias("first"))
    side = lambda p: first.select("episode", F.col("entity").alias(p), F.col("first").alias(f"{p}_step"))
    both = candidates.join(side("subject"), ["episode", "subject"]).join(side("reference"), ["episode", "reference"])
    pair = F.struct(F.least("subject", "reference").alias("a"), F.greatest("subject", "reference").alias("b"))
    row = F.struct("place", pair.alias("pair"), "relation", "subject", "reference", "margin", "subject_step", "reference_step")
    once = both.groupBy("episode", pair.alias("pair"), "relation").agg(F.min(row).alias("c"))
    most = per_relation * relations + per_relation
    rank = F.row_number().over(W.partitionBy("episode", "relation").orderBy("c.place"))
    few = once.withColumn("nth", rank).where(F.col("nth") <= most).groupBy("episode").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    kind = few.schema["cs"].dataType.simpleString()

    def take(taken: Column, c: Column) -> Column:
        known = F.exists(taken, lambda t: t["pair"] == c["pair"])
        full = F.size(F.filter(taken, lambda t: t["relation"] == c["relation"])) >= per_relation
        return F.when(known | full, taken).otherwise(F.array_append(taken, c))

    chosen = few.select("episode", F.explode(F.aggregate("cs", F.array().cast(kind), take)).alias("c")).select("episode", "c.*")
    shared = chosen.join(seen.select("episode", F.col("entity").alias("subject"), "step"), ["episode", "subject"]).join(seen.select("episode", F.col("entity").alias("reference"), "step"), ["episode", "reference", "step"])
    common = shared.groupBy("episode", "place").agg(F.min("step").alias("common"))
    evidence = F.when(F.col("common").isNotNull(), F.array("common")).otherwise(F.array("subject_step", "reference_step"))
    return chosen.join(common, ["episode", "place"], "left").select("episode", "place", "subject", "reference", "relation", "margin", evidence.alias("evidence"))


#: Planar relations of two objects, by number.
PLANAR = ("left_of", "right_of", "behind", "in_front_of")
#: Ordered pairs that a task holds at once (one scene at least).
PAIRS = 1 << 19


def first_places(sizes: np.ndarray, rank: np.ndarray, x: np.ndarray, y: np.ndarray, shown: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Ordered pairs of each scene's objects, the first `most` of each relation with both objects shown: scene, place, subject, reference, relation, margin.

    sizes: objects of each scene; the others are a row an object, rank the
    order of its id. A pair's place is its rank from 1 among all of the scene,
    by falling margin, then subject and reference; objects are row numbers.
    """
    square = sizes * sizes
    scene = np.repeat(np.arange(len(sizes)), square)
    within = np.arange(len(scene)) - np.repeat(np.cumsum(square) - square, square)
    start = (np.cumsum(sizes) - sizes)[scene]
    subject, reference = start + within // sizes[scene], start + within % sizes[scene]
    apart = subject != reference
    scene, subject, reference = scene[apart], subject[apart], reference[apart]
    dx, dy = x[subject] - x[reference], y[subject] - y[reference]
    margin = np.floor(np.abs(np.abs(dx) - np.abs(dy)) * 1e9 + 0.5) / 1e9
    relation = np.where(np.abs(dx) >= np.abs(dy), dx > 0, 2 + (dy > 0))
    order = np.lexsort((rank[reference], rank[subject], -margin, scene))
    scene, subject, reference, relation, margin = (c[order] for c in (scene, subject, reference, relation, margin))
    pairs = sizes * (sizes - 1)
    place = 1 + np.arange(len(scene)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    kept = np.flatnonzero(shown[subject] & shown[reference])
    key = scene[kept] * len(PLANAR) + relation[kept]
    by_key = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[by_key], prepend=-1))
    nth = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
    kept = np.sort(kept[by_key[nth < most]])
    return tuple(c[kept] for c in (scene, place, subject, reference, relation, margin))


def taken_rows(scene: np.ndarray, pair: np.ndarray, relation: np.ndarray, per_relation: int) -> np.ndarray:
    """Which rows, in order within each scene (ascending), a quota takes: each pair once, at most per_relation of a relation. All scenes go on by a row at a time."""
    begins = np.flatnonzero(np.diff(scene, prepend=-1))
    ends = np.append(begins[1:], len(scene))
    used = np.zeros((len(begins), len(PLANAR)), np.int64)
    pairs = np.full((len(begins), per_relation * len(PLANAR)), -1, np.int64)
    taken = np.zeros(len(scene), bool)
    open_, row = np.arange(len(begins)), begins.copy()
    while len(open_):
        at = row[open_]
        free = (used[open_, relation[at]] < per_relation) & ~(pairs[open_] == pair[at, None]).any(axis=1)
        of, at = open_[free], at[free]
        pairs[of, used[of].sum(axis=1)] = pair[at]
        used[of, relation[at]] += 1
        taken[at] = True
        row[open_] += 1
        open_ = open_[row[open_] < ends[open_]]
    return taken


def scene_queries(scenes: DataFrame, per_relation: int = 2) -> DataFrame:
    """What quota_queries takes of all ordered pairs of each scene's objects, by the planar relation, clearest first.

    scenes: (episode, things), things an array of (entity, x, y, steps), the
    steps that show the object; ids and coordinates are not null. Objects of a
    scene are a bounded vocabulary: all pairs of one scene are held by a task,
    and none is shuffled. Rows as those of quota_queries.

    Up to the last row that is taken of a relation, each row of it is of a
    pair that is taken. These are at most per_relation of four relations, with
    two rows each; so the first 8 * per_relation rows of a relation are enough.
    """
    most = 2 * len(PLANAR) * per_relation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("things")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.cumsum(sizes * sizes) // PAIRS
            for number in np.unique(chunk).tolist():
                at, end = np.searchsorted(chunk, [number, number + 1]).tolist()
                some = batch.slice(at, end - at)
                flat = some.column("things").flatten()
                entity, x, y, steps = flat.flatten()
                rank = np.empty(len(flat), np.int64)
                rank[pc.sort_indices(entity).to_numpy()] = np.arange(len(flat))
                shown = pc.fill_null(pc.list_value_length(steps), 0).to_numpy(zero_copy_only=False) > 0
                rows = first_places(sizes[at:end], rank, x.to_numpy(), y.to_numpy(), shown, most)
                pair = np.minimum(rows[2], rows[3]) * len(flat) + np.maximum(rows[2], rows[3])
                taken = taken_rows(rows[0], pair, rows[4], per_relation)
                scene, place, subject, reference, relation, margin = (c[taken] for c in rows)
                data = [some.column("episode").take(pa.array(scene)), place, flat.take(pa.array(subject)), flat.take(pa.array(reference)), pa.array(PLANAR).take(pa.array(relation)), margin]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in data], names=["episode", "place", "s", "r", "relation", "margin"])

    thing = scenes.schema["things"].dataType.elementType
    one = "struct<" + ", ".join(f"{c}: {thing[c].dataType.simpleString()}" for c in ("entity", "x", "y", "steps")) + ">"
    rows = scenes.select("episode", F.transform("things", lambda t: F.struct(*[t[c].alias(c) for c in ("entity", "x", "y", "steps")])).alias("things"))
    chosen = rows.mapInArrow(run, f"episode {rows.schema['episode'].dataType.simpleString()}, place long, s {one}, r {one}, relation string, margin double")
    common = F.array_min(F.array_intersect("s.steps", "r.steps"))
    evidence = F.when(common.isNotNull(), F.array(common)).otherwise(F.array(F.array_min("s.steps"), F.array_min("r.steps")))
    return chosen.select("episode", "place", F.col("s.entity").alias("subject"), F.col("r.entity").alias("reference"), "relation", "margin", evidence.alias("evidence"))
