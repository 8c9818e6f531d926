"""Independent replay: targets are computed anew and compared, never trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import relations as R
from orrery.plans.durable import small


def replay_relations(stored: DataFrame, entities: DataFrame, tolerance: float = 0.11) -> DataFrame:
    """Stored relations against those computed from the objects: ok, wrong_relation, wrong_distance or no_such_pair.

    Each stored row looks up its two objects, so the cost follows the rows,
    which stay where they are if the objects are few enough to be sent to them.
    """
    side = lambda s, k: small(entities.select(F.col("entity_id").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in "xyz"]))
    rows = stored.join(side("a", "subject"), "subject", "left").join(side("b", "reference"), "reference", "left")
    d = {k: F.col(f"a_{k}") - F.col(f"b_{k}") for k in "xyz"}
    holds = (
        F.when(F.col("relation") == "right_of", d["x"] > 0).when(F.col("relation") == "left_of", d["x"] < 0).when(F.col("relation") == "in_front_of", d["y"] > 0)
        .when(F.col("relation") == "behind", d["y"] < 0).when(F.col("relation") == "above", d["z"] > 0).when(F.col("relation") == "below", d["z"] < 0)
    )
    apart = F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2)
    status = (
        F.when(F.col("a_x").isNull() | F.col("b_x").isNull(), "no_such_pair").when(~F.coalesce(holds, F.lit(False)), "wrong_relation")
        .when(F.abs(apart - F.col("distance")) > tolerance, "wrong_distance").otherwise("ok")
    )
    return rows.select("subject", "reference", "relation", status.alias("status"))


def inverses_hold(candidates: DataFrame) -> DataFrame:
    """Relations whose inverse is missing: none, if both directions were made."""
    back = candidates.select(F.col("reference").alias("subject"), F.col("subject").alias("reference"), R.inverse(F.col("relation")).alias("relation"))
    return candidates.select("subject", "reference", "relation").join(back, ["subject", "reference", "relation"], "left_anti")


def reviews(packet: DataFrame, decisions: DataFrame, key: str = "item") -> DataFrame:
    """Each packet item's reviews: missing, unexpected, repeated, accept, reject or disagree."""
    d = decisions.groupBy(key, "reviewer").agg(F.count("*").alias("n"), F.min("decision").alias("decision"))
    g = d.groupBy(key).agg(F.max("n").alias("n"), F.count_distinct("decision").alias("k"), F.min("decision").alias("decision"))
    both = packet.select(key).withColumn("_p", F.lit(True)).join(g, key, "full")
    status = F.when(F.col("_p").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("k") > 1, "disagree").otherwise(F.col("decision"))
    return both.select(key, status.alias("status"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right, same): whether two tables hold the same rows the same number of times."""
    keys = left.columns
    a = left.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_s", F.lit(1))
    b = right.select(*keys).groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_s", F.lit(-1))
    d = a.unionByName(b).groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_s")).alias("d"))
    out = d.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_right"))
    return out.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def shards(rows: DataFrame, n: int, ordinal: str, shard: str) -> DataFrame:
    """Rows that stand in another shard than their ordinal says."""
    return rows.where(F.pmod(F.col(ordinal), F.lit(n)) != F.col(shard))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys for which shards give different values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def schedule_faults(schedule: DataFrame, records: DataFrame) -> DataFrame:
    """Draws whose source row is missing or says something else: (draw, faults).

    schedule: (draw, source_jsonl, source_line, source_sha256, record_id, fact_ids, sample_weight);
    records: (source_jsonl, source_line, source_sha256, record_id, fact_ids), lines from 1.
    """
    claimed = ("source_sha256", "record_id", "fact_ids")
    found = records.select("source_jsonl", "source_line", F.lit(True).alias("found"), *[F.col(c).alias(f"own_{c}") for c in claimed])
    joined = schedule.join(found, ["source_jsonl", "source_line"], "left")
    missing = F.col("found").isNull()
    faults = F.array_compact(F.array(
        F.when(missing, "source_line"),
        *[F.when(~missing & ~F.col(c).eqNullSafe(F.col(f"own_{c}")), c) for c in claimed],
        F.when(~F.coalesce(F.col("sample_weight") > 0, F.lit(False)), "sample_weight"),
    ))
    return joined.select("draw", faults.alias("faults")).where(F.size("faults") > 0)


def with_split(units: DataFrame, splits: DataFrame, key: str = "scene") -> DataFrame:
    """Units with the split of their scene; a scene that has none, when its row is read, is an error."""
    told = F.coalesce("split", F.raise_error(F.concat(F.lit("no split for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return units.join(splits.select(key, "split"), key, "left").withColumn("split", told)


def unequal_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with side and copies, by which two tables of the same columns differ as multisets; none if they are equal."""
    names = left.columns
    both = left.withColumn("n", F.lit(1)).unionByName(right.withColumn("n", F.lit(-1)))
    counts = both.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")
    return counts.select(*names, F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.abs("n").alias("copies"))


def summed_counters(rows: DataFrame, key: str, counter: str) -> DataFrame:
    """Rows (key, name, n): the sum of maps from names to counts."""
    return rows.select(key, F.explode(counter).alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("n"))


def arm_faults(episodes: DataFrame, isolated: DataFrame) -> DataFrame:
    """Faults of two training arms that must hold the same facts: (comparison, fault), one row a fault.

    episodes: (comparison, facts array, images array), one row a comparison;
    isolated: the same columns, one row a fact. Faults: no comparison,
    repeated comparison, missing in isolated, missing in episodes, more than one fact, other images, other
    facts (counted as often as they come).
    """
    none = F.col("comparison").isNull()
    e = episodes.where(~none).groupBy("comparison").agg(F.count("*").alias("n"), F.first("facts").alias("facts"), F.first("images").alias("images"))
    shape = isolated.where(~none).groupBy("comparison").agg(F.count("*").alias("k"), F.bool_or(F.coalesce(F.size("facts"), F.lit(0)) != 1).alias("many"))
    given = e.select("comparison", F.col("images").alias("wanted"))
    images = isolated.join(given, "comparison").groupBy("comparison").agg(F.bool_or(~F.col("images").eqNullSafe(F.col("wanted"))).alias("other_images"))
    count = lambda rows, name: rows.select("comparison", F.explode("facts").alias("fact")).groupBy("comparison", "fact").agg(F.count("*").alias(name))
    facts = count(e, "a").join(count(isolated, "b"), ["comparison", "fact"], "full").groupBy("comparison").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("other_facts"))
    rows = e.drop("facts", "images").join(shape, "comparison", "full").join(images, "comparison", "left").join(facts, "comparison", "left")
    both = F.col("n").isNotNull() & F.col("k").isNotNull()
    told = F.array_compact(F.array(
        F.when(F.col("n") > 1, "repeated comparison"), F.when(F.col("k").isNull(), "missing in isolated"), F.when(F.col("n").isNull(), "missing in episodes"),
        F.when(F.col("many"), "more than one fact"), F.when(both & F.col("other_images"), "other images"), F.when(both & F.col("other_facts"), "other facts"),
    ))
    nameless = episodes.where(none).unionByName(isolated.where(none)).select("comparison", F.lit("no comparison").alias("fault"))
    return rows.select("comparison", F.explode(told).alias("fault")).unionByName(nameless)
