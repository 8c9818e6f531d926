"""Audits of a corpus: distributions, leakage, dependencies, named gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The relations that an answer may state.
RELATIONS = ("left_of", "right_of", "in_front_of", "behind", "front_left", "front_right", "back_left", "back_right")


def distribution(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Targets by keys with count and share."""
    n = rows.groupBy(*keys, target).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def cluster_stats(rows: DataFrame, key: str) -> DataFrame:
    """Sizes of the groups of a key: groups, least, median, most, mean."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def cluster_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """cluster_stats() of several keys, in one pass over the rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select("k.*")
    sizes = long.groupBy("key", "value").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def split_leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits"), F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def missing_fields(rows: DataFrame, fields: list[str], order: str, examples: int = 5) -> DataFrame:
    """For each field: rows where it is null, and the first of them by `order`.

    The first few are kept by a rank limit, so no list grows with the rows.
    """
    marks = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    gone = rows.select(F.col(order).alias("i"), F.explode(F.array_compact(marks)).alias("field"))
    counts = gone.groupBy("field").agg(F.count("*").alias("n_missing"))
    nth = F.row_number().over(W.partitionBy("field").orderBy("i"))
    first = gone.withColumn("r", nth).where(F.col("r") <= examples).groupBy("field").agg(F.array_sort(F.collect_list("i")).alias("first"))
    names = rows.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(counts, "field", "left").join(first, "field", "left").select("field", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("first", F.array().cast("array<bigint>")).alias("first"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_distinct, unique), by a count of each key that is combined before the shuffle."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.count(key).alias("n_distinct")).withColumn("unique", F.col("n_rows") == F.col("n_distinct"))


def broken_dependencies(rows: DataFrame, inputs: list[str], target: str) -> DataFrame:
    """Inputs with more than one target."""
    return rows.groupBy(*inputs).agg(F.count_distinct(target).alias("n_targets"), F.count("*").alias("n_rows")).where("n_targets > 1")


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that the two hold a different number of times."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    joined = a.join(b, keys, "full").fillna(0, ["n_left", "n_right"])
    return joined.where("n_left <> n_right")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of one side alone: (id, side)."""
    only_left = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")
    only_right = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti")
    return only_left.select(F.col(key).alias("id"), F.lit("left").alias("side")).unionByName(only_right.select(F.col(key).alias("id"), F.lit("right").alias("side")))


def union_by_id(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; of an id in both, the first's."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def dangling(rows: DataFrame, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """References that point at nothing."""
    refs = rows.where(F.col(reference).isNotNull()).groupBy(reference).agg(F.count("*").alias("n_rows"))
    return refs.join(targets.select(F.col(key).alias(reference)), reference, "left_anti")


def disjoint(*sets: Column) -> Column:
    """Whether arrays have no element in common, pairwise."""
    out = F.lit(True)
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            out = out & (F.size(F.array_intersect(a, b)) == 0)
    return out


def single_replacement(a: Column, b: Column, c: Column) -> Column:
    """Whether three view lists of equal length share all but one view, and the odd views differ."""
    common = F.array_intersect(F.array_intersect(a, b), c)
    odd = F.array_distinct(F.concat(F.array_except(a, common), F.array_except(b, common), F.array_except(c, common)))
    same = (F.size(a) == F.size(b)) & (F.size(b) == F.size(c))
    return same & (F.size(common) == F.size(a) - 1) & (F.size(odd) == 3)


def gate(name: str, measured: Column, passed: Column, required: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), measured.cast("double").alias("measured"), required.cast("double").alias("required"), passed.alias("passed"))


def at_least(name: str, measured: Column, required: float) -> Column:
    return gate(name, measured, measured >= required, F.lit(required))


def at_most(name: str, measured: Column, required: float) -> Column:
    return gate(name, measured, measured <= required, F.lit(required))


def gates(one_row: DataFrame, *checks: Column) -> DataFrame:
    """Named checks of a row of measures, as rows (gate, measured, required, passed)."""
    return one_row.select(F.explode(F.array(*checks)).alias("g")).select("g.*")


def verdict(checks: DataFrame) -> DataFrame:
    """pass, warn (some fail) or fail (most fail) over gate rows."""
    n = checks.agg(F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "pass").when(2 * F.col("failed") < F.col("total"), "warn").otherwise("fail"))


def family_atomic(rows: DataFrame, group: str, bad: Column) -> DataFrame:
    """Rows that are good and whose whole group is; a null group stands alone."""
    marked = rows.withColumn("_bad", bad)
    broken = marked.where(F.col("_bad") & F.col(group).isNotNull()).select(group).distinct()
    return marked.where(~F.col("_bad")).drop("_bad").join(broken, group, "left_anti")


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (label, n) of the values of the keys with / between; a null is written None."""
    label = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def field_marginals(rows: DataFrame, keys: list[str], status: str, value: str) -> DataFrame:
    """Rows (keys.., path, value, n): how often each field of the JSON targets has each value, as JSON, status among them."""
    from orrery.functions.structs import fields

    said = F.regexp_extract(F.to_json(F.array(F.col(status).cast("string"))), r"(?s)^\[(.*)\]$", 1)
    own = F.array(F.struct(F.lit("status").alias("path"), said.alias("value")))
    each = rows.select(*keys, F.explode(F.concat(own, fields(F.col(value)))).alias("f"))
    return each.groupBy(*keys, F.col("f.path").alias("path"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def partition_targets(rows: DataFrame, partition: str, split: str, task: str, target: str) -> DataFrame:
    """For each partition: records, those with split, task and target, what lacks, and the accuracy of each task's majority within its split."""
    whole = F.col(split).isNotNull() & F.col(task).isNotNull() & F.col(target).isNotNull()
    told = rows.groupBy(partition).agg(
        F.count("*").alias("n_records"), F.count_if(whole).alias("n_valid"), *[F.count_if(F.col(c).isNull()).alias(f"no_{k}") for k, c in (("split", split), ("task", task), ("target", target))]
    )
    n = rows.where(whole).groupBy(partition, split, task, target).agg(F.count("*").alias("n"))
    best = n.groupBy(partition, split, task).agg(F.max("n").alias("n")).groupBy(F.col(partition).alias("_p")).agg(F.sum("n").alias("n_majority"), F.count("*").alias("n_groups"))
    out = told.join(best, F.equal_null(partition, "_p"), "left").drop("_p").fillna(0, ["n_majority", "n_groups"])
    return out.withColumn("majority_accuracy", F.try_divide("n_majority", "n_valid"))


def image_audit(references: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (measure, value, n) of the images that artifacts name, each path once but for the references.

    references: (artifact, path); files: (path, width, height, mode, format), a null width where a file could not be read.
    """
    paths = references.groupBy("path").agg(F.count("*").alias("n_references"))
    seen = paths.join(files.withColumn("found", F.lit(True)), "path", "left")
    read = F.col("found") & F.col("width").isNotNull()
    measure = lambda name, value, n=F.lit(1): F.struct(F.lit(name).alias("measure"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    each = F.array_compact(F.array(
        measure("references", F.lit(None), F.col("n_references")), measure("paths", F.when(F.startswith("path", F.lit("/")), "absolute").otherwise("relative")),
        F.when(F.col("found").isNull(), measure("missing", F.lit(None))), F.when(F.col("found") & F.col("width").isNull(), measure("unreadable", F.lit(None))),
        F.when(read, measure("dimensions", F.concat_ws("x", "width", "height"))), F.when(read, measure("modes", F.col("mode"))), F.when(read, measure("formats", F.coalesce("format", F.lit("unknown")))),
    ))
    return seen.select(F.explode(each).alias("m")).select("m.*").groupBy("measure", "value").agg(F.sum("n").alias("n"))


def frame_pair_faults(rows: DataFrame) -> DataFrame:
    """Families of two frames (variants frame_a and frame_b) and in what they differ beyond the frame: (family, faults).

    rows: (family, variant, view_ids, question, status, answer, task, program). Questions name their image by its place,
    the first of frame_a and the second of frame_b. A family without exactly these two is not_evaluable.
    """
    a, b = (F.max(F.when(F.col("variant") == v, F.struct("view_ids", "question", "status", "answer", "task", "program"))).alias(s) for v, s in (("frame_a", "a"), ("frame_b", "b")))
    pairs = rows.groupBy("family").agg(a, b, F.count("*").alias("n"), F.count_if(F.col("variant").isin("frame_a", "frame_b")).alias("known"))
    whole = (F.col("n") == 2) & (F.col("known") == 2) & F.col("a").isNotNull() & F.col("b").isNotNull()
    frame = lambda s, i: F.replace(F.col(f"{s}.question"), F.lit(f"第{i}张图"), F.lit("第<FRAME>张图"))
    views = F.col("a.view_ids")
    good = {
        "images": (F.size(views) >= 2) & (views == F.col("b.view_ids")) & (F.size(F.array_distinct(views)) == F.size(views)),
        "frames": F.contains("a.question", F.lit("第1张图")) & F.contains("b.question", F.lit("第2张图")),
        "question": frame("a", 1) == frame("b", 2), "status": (F.col("a.status") == "accepted") & (F.col("b.status") == "accepted"),
        "relation": F.col("a.answer").isin(*RELATIONS) & F.col("b.answer").isin(*RELATIONS), "answer": ~F.equal_null("a.answer", "b.answer"),
        "task": F.equal_null("a.task", "b.task"), "program": F.equal_null("a.program", "b.program"),
    }
    faults = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in good.items()]))
    return pairs.select("family", F.when(whole, faults).otherwise(F.array(F.lit("not_evaluable"))).alias("faults")).where(F.size("faults") > 0)
