"""Splits, quotas and balanced choices with orders that hashes fix; no random numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.ids import hash_rank_key
from orrery.operators.relations import eligible, start_reach, top_per
from orrery.plans.durable import cut


def hash_split(units: DataFrame, unit: str, salt: str, counts: tuple[tuple[str, int], ...], rest: str = "train") -> DataFrame:
    """Exact numbers of units to each named split in hash order; the others to `rest`.

    The few that the counts take are found by a top-k, not by a sort of all.
    """
    key = hash_rank_key(salt, F.col(unit))
    total = sum(n for _, n in counts)
    names = units.select(unit).distinct()
    first = names.orderBy(key, unit).limit(total).withColumn("r", F.row_number().over(W.orderBy(key, unit)))
    name, until = F.lit(rest), 0
    marks = []
    for split, n in counts:
        marks.append((until, until + n, split))
        until += n
    for low, high, split in reversed(marks):
        name = F.when((F.col("r") > low) & (F.col("r") <= high), split).otherwise(name)
    return names.join(first.select(unit, "r"), unit, "left").select(unit, name.alias("split"))


def largest_remainder(groups: DataFrame, key: str, count: str, target: int) -> DataFrame:
    """Integer quotas in proportion to counts that add up to the target (at most all), none above its count.

    Whole parts first; the rest by larger fraction, then count, then key, over
    groups that have room. Rows (key, count, quota).
    """
    every = W.partitionBy()
    exact = F.lit(target) * F.col(count) / F.sum(count).over(every)
    g = groups.select(key, count).withColumn("exact", F.least(exact, F.col(count).cast("double"))).withColumn("base", F.floor("exact"))
    g = g.withColumn("left", F.least(F.lit(target), F.sum(count).over(every)) - F.sum("base").over(every))
    order = W.orderBy((F.col("base") < F.col(count)).desc(), F.round(F.col("exact") - F.col("base"), 9).desc(), F.col(count).desc(), F.col(key).desc())
    return g.withColumn("r", F.row_number().over(order)).select(key, count, (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_split(units: DataFrame, unit: str, stratum: str, salt: str, parts: tuple[tuple[str, int], ...], rest: str = "train") -> DataFrame:
    """Quotas by largest remainder over strata, one part after another, units by hash within a stratum."""
    key = hash_rank_key(salt, F.col(unit))
    sizes = units.groupBy(stratum).agg(F.count("*").alias("n"))
    ranked = units.select(unit, stratum).withColumn("r", F.row_number().over(W.partitionBy(stratum).orderBy(key, unit)))
    name, low = F.lit(rest), F.lit(0)
    for i, (split, n) in enumerate(parts):
        quotas = largest_remainder(sizes, stratum, "n", n).select(stratum, F.col("quota").alias(f"q{i}"))
        ranked = ranked.join(quotas, stratum)
    whens = []
    for i, (split, _) in enumerate(parts):
        high = low + F.col(f"q{i}")
        whens.append(((F.col("r") > low) & (F.col("r") <= high), split))
        low = high
    for cond, split in reversed(whens):
        name = F.when(cond, split).otherwise(name)
    return ranked.select(unit, stratum, name.alias("split"))


def round_robin(rows: DataFrame, bucket: str, order: list[Column], limit: int) -> DataFrame:
    """Rows taken in turn from sorted buckets until `limit` are: (.., turn).

    No bucket gives more than `limit`, so ranks are limited before the shuffle.
    """
    nth = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("turn", nth).where(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def balanced_floor(rows: DataFrame, split: str, label: str, fact: str, surface: str, salt: str) -> DataFrame:
    """As many facts of each label as the rarest label of the split has, by hash, one surface (the first) of each."""
    facts = rows.groupBy(split, label, fact).agg(F.min(surface).alias(surface))
    n = facts.groupBy(split, label).agg(F.count("*").alias("n")).groupBy(split).agg(F.min("n").alias("floor"))
    nth = F.row_number().over(W.partitionBy(split, label).orderBy(hash_rank_key(salt, F.col(fact)), fact))
    return facts.join(n, split).withColumn("r", nth).where("r <= floor").select(split, label, fact, surface)


def unique_pairs(rows: DataFrame, keys: list[str], a: str, b: str, order: list[Column]) -> DataFrame:
    """Of each unordered pair under the keys, the first row."""
    pair = F.array_sort(F.array(F.col(a), F.col(b)))
    nth = F.row_number().over(W.partitionBy(*keys, pair).orderBy(*order))
    return rows.withColumn("_r", nth).where("_r = 1").drop("_r")


def best_per(rows: DataFrame, keys: list[str], score: Column, *columns: str) -> DataFrame:
    """The columns of the row of the highest score (a struct without ties) under each key; combined before the shuffle."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(score.alias("_s"), *columns)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def capped_running(rows: DataFrame, key: str, order: list[Column], flag: Column, cap: int, limit: int) -> DataFrame:
    """Rows in order, flagged ones up to a cap, `limit` in all, under each key."""
    by = W.partitionBy(key).orderBy(*order)
    flagged = F.sum(flag.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("_f", flagged).where(~flag | (F.col("_f") <= cap)).drop("_f")
    return kept.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def packed(groups: DataFrame, order: list[Column], size: str, target: int) -> DataFrame:
    """Groups in order until their sizes reach the target: those whose sum before is below it."""
    before = F.coalesce(F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("before", before).where(F.col("before") < target)


def risk_quota(population: Column, risky: Column, sample: Column, multiplier: float) -> Column:
    share = F.least(F.lit(0.6), F.try_divide(risky.cast("double"), population) * multiplier)
    return F.least(risky, F.ceil(sample * F.coalesce(share, F.lit(0.0)))).cast("long")


def risk_round_robin(rows: DataFrame, stratum: str, risk: str, unit: str, salt: str, quota: int) -> DataFrame:
    """Risky units in turn over strata in hash order, the riskiest of each first."""
    nth = F.row_number().over(W.partitionBy(stratum).orderBy(F.col(risk).desc(), hash_rank_key(salt, F.col(unit)), unit))
    picked = rows.withColumn("turn", nth).where(F.col("turn") <= quota)
    return picked.orderBy("turn", hash_rank_key(salt, F.col(stratum)), stratum).limit(quota)


def greedy_pairs(candidates: DataFrame, scene: str, subject: str, reference: str, relation: str, order: str, per_relation: int = 2) -> DataFrame:
    """In order within a scene: a pair is used once, in either direction, and a relation at most per_relation times.

    State runs through a scene, so a scene is one group. Of each relation its
    first per_relation times the number of relations give the same choice, so
    callers leave the others out before.
    """
    schema = candidates.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        used, times, kept = set(), {}, []
        for i, r in enumerate(rows.sort_values([order, subject, reference]).itertuples(index=False)):
            pair = frozenset((getattr(r, subject), getattr(r, reference)))
            name = getattr(r, relation)
            if pair in used or times.get(name, 0) >= per_relation:
                continue
            used.add(pair)
            times[name] = times.get(name, 0) + 1
            kept.append(r)
        return pd.DataFrame(kept, columns=rows.columns)

    return candidates.groupBy(scene).applyInPandas(run, schema)


def balanced_choices(candidates: DataFrame, scene: str, relation: str, margin: str) -> DataFrame:
    """One candidate a scene, scenes in order: of the relation used least so far, the largest margin.

    The count crosses scenes, so this is one sequence; only the best candidate
    of each scene and relation takes part, at most six a scene.
    """
    # a maximum of numbers is hashed, one of structs would sort every candidate
    few = candidates.groupBy(scene, relation).agg(F.max(margin).alias(margin))
    schema = few.select(scene, relation, margin).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        out, held, at = [], [], None

        def choose() -> None:
            if held:
                best = min(held, key=lambda r: (used.get(r[1], 0), -r[2], r[1]))
                used[best[1]] = used.get(best[1], 0) + 1
                out.append(best)

        for rows in batches:
            for r in rows.itertuples(index=False):
                if r[0] != at:
                    choose()
                    held, at = [], r[0]
                held.append(tuple(r))
            yield pd.DataFrame(out, columns=schema.names)
            out.clear()
        choose()
        yield pd.DataFrame(out, columns=schema.names)

    return few.select(scene, relation, margin).orderBy(scene, relation).coalesce(1).mapInPandas(run, schema)


def balanced_remainder(candidates: DataFrame, unit: str, dims: list[str], size: int, salt: str) -> DataFrame:
    """Units chosen one by one for the largest marginal gain, a sum over dimensions of 1 / (1 + times chosen).

    The candidates are a review pool of bounded size, held as one group.
    """
    pool = candidates.select(unit, *dims, hash_rank_key(salt, F.col(unit)).alias("_h"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = sorted(rows.itertuples(index=False), key=lambda r: (r[-1], r[0]))
        seen: dict[tuple, int] = {}
        out = []
        while left and len(out) < size:
            gain = [sum(1 / (1 + seen.get((d, r[1 + d]), 0)) for d in range(len(dims))) for r in left]
            best = max(range(len(left)), key=lambda i: (gain[i], -i))
            r = left.pop(best)
            for d in range(len(dims)):
                seen[d, r[1 + d]] = seen.get((d, r[1 + d]), 0) + 1
            out.append((r[0], len(out)))
        return pd.DataFrame(out, columns=["unit", "place"])

    return pool.groupBy().applyInPandas(run, "unit string, place long")


def covered_subset(rows: DataFrame, unit: str, program: str, facts: str, budget: int, salt: str) -> DataFrame:
    """One unit of each program first, then units in hash order while their facts fit a budget: (unit, chosen)."""
    key = hash_rank_key(salt, F.col(unit))
    lead = F.row_number().over(W.partitionBy(program).orderBy(key, unit)) == 1
    ranked = rows.withColumn("lead", lead)
    so_far = F.sum(facts).over(W.orderBy(F.col("lead").desc(), key, F.col(unit)).rowsBetween(W.unboundedPreceding, 0))
    return ranked.select(unit, "lead", so_far.alias("facts_so_far")).where(F.col("lead") | (F.col("facts_so_far") <= budget))


def layout_facts(candidates: DataFrame, scene: str, least: float = 0.5, most: int = 3, per_relation: int = 2) -> DataFrame:
    """Up to `most` facts a scene by falling margin, ties by ids: no subject twice, no relation over `per_relation`, each with an object not yet named.

    candidates: (scene, subject, reference, relation, margin). What cannot be
    chosen once never can be later, so choosing in order is taking the best of
    what is left `most` times: each time one minimum a scene, combined before
    the shuffle. Scenes with a single fact have none.
    """
    rows = candidates.where(F.col("margin") >= least).select(scene, "subject", "reference", "relation", "margin")
    fact = F.struct((-F.col("margin")).alias("lead"), "subject", "reference", "relation")
    chosen = rows.groupBy(scene).agg(F.array(F.min(fact)).alias("facts"))
    for _ in range(most - 1):
        had = rows.join(chosen.withColumnRenamed(scene, "_scene"), F.equal_null(scene, "_scene")).drop("_scene")
        subjects, named = F.col("facts.subject"), F.concat("facts.subject", "facts.reference")
        free = ~F.array_contains(subjects, F.col("subject")) & ~(F.array_contains(named, F.col("subject")) & F.array_contains(named, F.col("reference")))
        free = free & (F.size(F.filter("facts", lambda f: f["relation"] == F.col("relation"))) < per_relation)
        more = had.where(free).groupBy(scene).agg(F.array(F.min(fact)).alias("facts"))
        chosen = chosen.unionByName(more).groupBy(scene).agg(F.sort_array(F.flatten(F.collect_list("facts"))).alias("facts"))
    out = chosen.where(F.size("facts") >= 2).select(scene, F.posexplode("facts").alias("place", "f"))
    return out.select(scene, (F.col("place") + 1).alias("place"), "f.subject", "f.reference", "f.relation", (-F.col("f.lead")).alias("margin"))


def relation_layouts(
    entities: DataFrame, least: float = 0.5, most: int = 3, per_relation: int = 2, reach: tuple[float, float] = (0.3, 4.5), margin: float = 0.4, most_half: float = 2.5, vertical_reach: float = 1.5
) -> DataFrame:
    """layout_facts() of each region over its relation_candidates() whose subject has the smaller id, without making them all.

    A margin near the reach leaves a pair little room: on one axis it is as far
    apart as its margin at least, across it no farther than what is left. So
    the facts of margins above a floor come from narrow cells. What is chosen
    from them is final for a region that has its `most` facts, and the others
    go on with twice the room, down to `least`. Places are compared, not
    objects: a pair of places gives the first facts that the chosen ones
    cannot rule out, whatever the number of objects there.
    """
    at = ["region", "x", "y", "z"]
    n_subjects, n_references = 3 * (most - 1) + 1, 2 * (most - 1) + 1
    real = F.lit(True)
    for c in at[1:]:
        real = real & (F.abs(c) < float("inf"))
    known = eligible(entities, most_half=most_half).where(real).select("entity_id", *at)
    few = top_per(known, at, [F.col("entity_id")], n_subjects).groupBy(*at).agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    places = cut(few.select(F.col("ids")[0].alias("place"), "ids", *at))
    here = F.equal_null("region", "_region") & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))
    objects = known.join(places.select("place", *[F.col(c).alias(f"_{c}") for c in at]), here).select(F.col("place").alias("r_place"), F.col("entity_id").alias("reference"))

    def facts(pending: DataFrame, room: float, floor: float) -> DataFrame:
        slack = 1e-6
        far, wide, upright = ((floor - slack, reach[1] + slack), (-room - slack, room + slack), min(room, vertical_reach) + slack)
        boxes = (("x", far, wide), ("y", wide, far), ("z", (-upright, upright), (-upright, upright)))
        looks = F.array(*[F.struct(F.lit(k).alias("kind"), *[(F.col(c) + v).alias(f"{c}{i}") for c, ends in (("x", xs), ("y", ys)) for i, v in enumerate(ends)]) for k, xs, ys in boxes])
        cell = lambda c: F.floor(F.col(c) / room).cast("long")
        a = pending.select("region", *[F.col(c).alias(f"a_{c}") for c in ("place", "x", "y", "z")], F.explode(looks).alias("k")).select("*", "k.*").drop("k")
        a = a.withColumn("nx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("ny", F.explode(F.sequence(cell("y0"), cell("y1"))))
        b = pending.select(F.col("region").alias("b_region"), *[F.col(c).alias(f"b_{c}") for c in ("place", "x", "y", "z")], cell("x").alias("bx"), cell("y").alias("by"))
        d = {k: F.col(f"b_{k}") - F.col(f"a_{k}") for k in "xyz"}
        planar, apart = F.hypot(d["x"], d["y"]), F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2)
        by_kind = lambda x, y, z: F.when(F.col("kind") == "x", x).when(F.col("kind") == "y", y).otherwise(z)
        clear = by_kind(F.abs(d["x"]) - F.abs(d["y"]), F.abs(d["y"]) - F.abs(d["x"]), F.abs(d["z"]) - planar)
        ahead = by_kind(d["x"], d["y"], d["z"]) > 0
        kept = ahead & (clear >= margin) & (F.round(clear, 9) >= floor) & (planar <= F.when(F.col("kind") == "z", vertical_reach).otherwise(reach[1])) & (planar <= reach[1]) & apart.between(*reach)
        pairs = a.join(b, F.equal_null("region", "b_region") & (F.col("nx") == F.col("bx")) & (F.col("ny") == F.col("by")) & kept)
        ways = F.array(*[F.struct(F.col(f"{s}_place").alias("place"), F.col(f"{r}_place").alias("r_place"), by_kind(*map(F.lit, names)).alias("relation")) for s, r, names in (("a", "b", ("left_of", "behind", "below")), ("b", "a", ("right_of", "in_front_of", "above")))])
        both = pairs.select(F.round(clear, 9).alias("margin"), F.explode(ways).alias("w")).select("w.*", "margin")
        each = both.join(places.select("place", "region", "ids"), "place").select("region", "place", "r_place", "relation", "margin", F.explode("ids").alias("subject"))
        told = each.join(objects, "r_place").where("subject < reference")
        return top_per(told, ["place", "r_place", "relation", "subject"], [F.col("reference")], n_references).select("region", "subject", "reference", "relation", "margin")

    out, pending, room = None, places, start_reach(places, ["region"], ("x", "y"), reach[1])
    while True:
        floor = max(least, reach[1] - room)
        chosen = cut(layout_facts(cut(facts(pending, room, floor)), "region", least, most, per_relation))
        if floor <= least:
            return chosen if out is None else out.unionByName(chosen)
        whole = chosen.where(F.col("place") == most).select(F.col("region").alias("_region"))
        ready = chosen.join(whole, F.equal_null("region", "_region"), "left_semi")
        out = ready if out is None else out.unionByName(ready)
        pending = cut(pending.join(whole, F.equal_null("region", "_region"), "left_anti"))
        if pending.isEmpty():
            return out
        room *= 2
