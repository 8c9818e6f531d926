"""Accuracy of predictions against a benchmark, by record and by family.

Metrics are sums of 0 and 1 combined before the shuffle. A metric without
cases is null with the status NA_ZERO_DENOMINATOR.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.durable import shuffle_partitions

OK, NONE = "OK", "NA_ZERO_DENOMINATOR"


def metric(correct: Column, total: Column) -> list[Column]:
    """correct, total, accuracy and status columns of a metric."""
    c, t = F.coalesce(correct, F.lit(0)).cast("long"), F.coalesce(total, F.lit(0)).cast("long")
    return [c.alias("correct"), t.alias("total"), F.try_divide(c.cast("double"), t).alias("accuracy"), F.when(t == 0, NONE).otherwise(OK).alias("status")]


def accuracy(rows: DataFrame, correct: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*metric(F.count_if(correct), F.count("*")))


def accuracy_sets(rows: DataFrame, correct: Column, keys: list[str]) -> DataFrame:
    """Accuracy by each key alone and in all, in one pass: (grouping, key, correct, total, accuracy, status)."""
    sets = [F.col(k) for k in keys]
    spark_rows = rows.withColumn("_c", correct.cast("int"))
    out = spark_rows.groupingSets([[s] for s in sets] + [[]], *sets).agg(F.sum("_c").alias("c"), F.count("*").alias("t"), *[F.grouping(k).alias(f"g_{k}") for k in keys])
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k in keys:
        name = F.when(F.col(f"g_{k}") == 0, k).otherwise(name)
        value = F.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return out.select(name.alias("grouping"), value.alias("key"), *metric(F.col("c"), F.col("t")))


def coverage(benchmark: DataFrame, predictions: DataFrame, key: str = "record_id") -> DataFrame:
    """One row an id: matched, missing, extra or duplicate_prediction, and how many predictions there are.

    Predictions without an id are counted in a row of null id and reason missing_record_id.
    """
    b = benchmark.select(key).distinct().withColumn("_b", F.lit(True))
    p = predictions.groupBy(key).agg(F.count("*").alias("n_predictions"))
    both = b.join(p.where(F.col(key).isNotNull()), key, "full").unionByName(p.where(F.col(key).isNull()).withColumn("_b", F.lit(None).cast("boolean")))
    n = F.coalesce("n_predictions", F.lit(0))
    reason = F.when(F.col(key).isNull(), "missing_record_id").when(F.col("_b").isNull(), "extra").when(n == 0, "missing").when(n > 1, "duplicate_prediction").otherwise("matched")
    return both.select(key, n.alias("n_predictions"), reason.alias("reason"))


def families(rows: DataFrame, group: str, variant: str, correct: Column, expected: tuple[str, ...]) -> DataFrame:
    """Groups with exactly the expected variants, each once: whether all are right, and each variant's answer."""
    agg = [F.count("*").alias("n"), F.array_sort(F.collect_set(variant)).alias("variants"), F.bool_and(correct).alias("all_correct")]
    agg += [F.max(F.when(F.col(variant) == v, correct.cast("int"))).alias(f"c_{v}") for v in expected]
    whole = (F.col("n") == len(expected)) & (F.col("variants") == F.array(*map(F.lit, sorted(expected))))
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(*agg).where(whole).drop("n", "variants")


def family_exact_match(rows: DataFrame, group: str, variant: str, correct: Column, expected: tuple[str, ...]) -> DataFrame:
    return families(rows, group, variant, correct, expected).agg(*metric(F.count_if("all_correct"), F.count("*")))


def conditional_success(rows: DataFrame, group: str, variant: str, correct: Column, expected: tuple[str, ...], given: str) -> DataFrame:
    """Of families whose `given` variant is right, the share with all right."""
    f = families(rows, group, variant, correct, expected)
    return f.agg(*metric(F.count_if("all_correct"), F.count_if(F.col(f"c_{given}") == 1)))


def pair_metrics(rows: DataFrame, group: str, variant: str, answer: str, truth: str, expected: tuple[str, str]) -> DataFrame:
    """Of pairs: both right; truths differ; answers differ where truths do; answers right where truths are equal."""
    a, b = expected
    at = lambda c, v: F.max(F.when(F.col(variant) == v, F.col(c)))
    pairs = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(variant).alias("k"), at(answer, a).alias("pa"), at(answer, b).alias("pb"), at(truth, a).alias("ta"), at(truth, b).alias("tb"))
    pairs = pairs.where("n = 2 and k = 2 and ta is not null and tb is not null")
    exact, change, changed = (F.col("pa") == F.col("ta")) & (F.col("pb") == F.col("tb")), F.col("ta") != F.col("tb"), F.col("pa") != F.col("pb")
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if(exact).alias("exact"), F.count_if(change).alias("change_required"),
        F.count_if(change & changed).alias("changed"), F.count_if(~change).alias("same_required"), F.count_if(~change & ~changed).alias("kept"),
    )


def reconstructs(rows: DataFrame, correct: Column, stratum: str) -> DataFrame:
    """Whether the strata add up to the whole: (strata_correct, strata_total, correct, total, holds)."""
    each = rows.groupBy(stratum).agg(F.count_if(correct).alias("c"), F.count("*").alias("t")).agg(F.sum("c").alias("strata_correct"), F.sum("t").alias("strata_total"))
    whole = rows.agg(F.count_if(correct).alias("correct"), F.count("*").alias("total"))
    # one row on either side
    return each.join(whole, F.lit(True)).withColumn("holds", (F.col("strata_correct") == F.col("correct")) & (F.col("strata_total") == F.col("total")))


def metric_deltas(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """right less left by key; null where either is undefined or missing."""
    l, r = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return l.join(r, key, "full").withColumn("delta", F.col("right") - F.col("left"))


def seed_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least, most and number of defined values over seeds."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n_defined"))


def majority(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """By keys: the most frequent target (ties joined in order), its share, and how many tie."""
    from pyspark.sql import Window as W

    n = rows.groupBy(*keys, target).agg(F.count("*").alias("n"))
    top = F.max("n").over(W.partitionBy(*keys))
    total = F.sum("n").over(W.partitionBy(*keys))
    best = n.withColumn("top", top).withColumn("total", total).where("n = top").groupBy(*keys)
    return best.agg(F.array_join(F.array_sort(F.collect_set(F.col(target).cast("string"))), ",").alias("majority"), F.count("*").alias("n_ties"), F.max("n").alias("n"), F.max("total").alias("total")).withColumn(
        "accuracy", F.col("n") / F.col("total")
    )


def fitted_majority(train: DataFrame, test: DataFrame, key: str, target: str) -> DataFrame:
    """The majority of train (ties: the first) applied to test: covered, correct, total."""
    n = train.groupBy(key, target).agg(F.count("*").alias("n"))
    fit = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(target).alias("t"))).alias("b")).select(key, F.col("b.t").alias("guess"))
    joined = test.join(fit, key, "left")
    return joined.agg(F.count("guess").alias("covered"), F.count_if(F.col("guess") == F.col(target)).alias("correct"), F.count("*").alias("total"))


#: Steps of a hash of (cluster, resample) on the prime 2**31 - 1, and the Poisson(1) distribution up to 7.
_PRIME, _STEPS = (1 << 31) - 1, ((15, 48271), (13, 40692), (16, 16807))
_POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080)
LEAST_RESAMPLES = 10_000


def bootstrap(rows: DataFrame, cluster: str, left: Column, right: Column, resamples: int = LEAST_RESAMPLES, salt: str = "17") -> DataFrame:
    """Paired cluster bootstrap of right less left accuracy: mean, 2.5 and 97.5 percentiles.

    A cluster stands in a resample as often as a Poisson draw of mean 1 says,
    which is a hash of (salt, cluster, resample): so any engine draws the same,
    and a cluster never meets another. Draws are made where clusters are and
    summed before the shuffle, so that one row a resample moves from each task.
    """
    return bootstrap_endpoints(rows, cluster, left, right, {"": F.lit(True)}, resamples, salt).drop("endpoint")


def bootstrap_endpoints(rows: DataFrame, cluster: str, left: Column, right: Column, endpoints: dict[str, Column], resamples: int = LEAST_RESAMPLES, salt: str = "17") -> DataFrame:
    """bootstrap() over the rows of each endpoint, with its name; an endpoint without rows has nulls.

    A cluster's draws are the same for all endpoints, so they are made once.
    """
    if resamples < LEAST_RESAMPLES:
        raise ValueError(f"at least {LEAST_RESAMPLES} resamples")
    names = list(endpoints)
    delta = right.cast("int") - left.cast("int")
    flags = rows.select(F.col(cluster).alias("cluster"), delta.alias("delta"), *[F.coalesce(m, F.lit(False)).alias(f"in{i}") for i, m in enumerate(endpoints.values())])
    sums = [f for i in range(len(names)) for f in (F.coalesce(F.sum(F.when(F.col(f"in{i}"), F.col("delta"))), F.lit(0)), F.count_if(f"in{i}"))]
    per = flags.groupBy("cluster").agg(F.array(*sums).alias("v"))
    seed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col("cluster").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long") % _PRIME
    width, least = 2 * len(names), [np.uint32(x) for x in _thresholds()]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.arange(resamples, dtype=np.int64)
        base = ((r * 69_621 + 1) % _PRIME).astype(np.uint32)
        total, part = np.zeros((width, resamples), np.int64), np.empty(resamples, np.int64)
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(-1, width)
            for h, some in zip(batch.column("h").to_pylist(), values.tolist(), strict=True):
                times = _times(h, base, least).astype(np.int64)
                for row, value in zip(total, some, strict=True):
                    row += np.multiply(times, value, out=part)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total.T.ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(r), sums], names=["r", "v"])

    # a cluster is a short row and much work: dealt evenly, whatever the bytes
    dealt = per.select("v", seed.alias("h")).repartition(shuffle_partitions(rows.sparkSession))
    sums = dealt.mapInArrow(drawn, "r long, v array<long>")
    of = [F.try_divide(F.sum(F.col("v")[2 * i]), F.sum(F.col("v")[2 * i + 1])).alias(f"e{i}") for i in range(len(names))]
    each = sums.groupBy("r").agg(*of)
    ends = [F.struct(F.lit(n).alias("endpoint"), F.avg(f"e{i}").alias("mean"), F.percentile(f"e{i}", 0.025).alias("low"), F.percentile(f"e{i}", 0.975).alias("high")) for i, n in enumerate(names)]
    return each.agg(F.array(*ends).alias("e")).select(F.inline("e"))


def _thresholds() -> list[int]:
    """The least hash at which each count of the Poisson distribution is passed, as a quotient of doubles tells."""
    out = []
    for p in _POISSON:
        x = int(p * _PRIME) - 2
        while x / _PRIME < p:
            x += 1
        out.append(x)
    return out


def _times(h: int, base: np.ndarray, least: list[np.uint32]) -> np.ndarray:
    """How often a cluster of hash h stands in each resample; remainders by 2**31 - 1 are taken with shifts."""
    prime = np.uint32(_PRIME)
    x = base + np.uint32(h)
    # below twice the prime: of x and x - prime, the one that does not wrap round is less
    x = np.minimum(x, x - prime)
    for shift, factor in _STEPS:
        wide = (x ^ (x >> np.uint32(shift))).astype(np.uint64)
        wide *= np.uint64(factor)
        high = wide >> np.uint64(31)
        wide &= np.uint64(_PRIME)
        wide += high
        x = wide.astype(np.uint32)
        x = np.minimum(x, x - prime)
    times = np.zeros(len(base), np.uint8)
    for limit in least:
        times += (x >= limit).view(np.uint8)
    return times


def scalar_metrics(rows: DataFrame, run: str, split: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows (run, metric, value): each metric of a run over all its rows, and over each split as split_metric.

    A metric is (correct, counted): the share of the counted rows that are
    correct, null without any. One pass over the rows.
    """
    flags = rows.select(run, split, *[c.alias(f"c_{m}") for m, (c, _) in metrics.items()], *[c.alias(f"t_{m}") for m, (_, c) in metrics.items()])
    aggs = [F.try_divide(F.count_if(F.col(f"c_{m}") & F.col(f"t_{m}")), F.count_if(F.col(f"t_{m}"))).alias(m) for m in metrics]
    sets = flags.groupingSets([[F.col(run)], [F.col(run), F.col(split)]], F.col(run), F.col(split)).agg(F.grouping(split).alias("all"), *aggs)
    prefix = F.when(F.col("all") == 1, "").otherwise(F.concat(F.coalesce(F.col(split).cast("string"), F.lit("none")), F.lit("_")))
    named = F.explode(F.array(*[F.struct(F.concat(prefix, F.lit(m)).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return sets.select(run, named.alias("m")).select(run, "m.*")


def zero_shot_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, accuracy of the meaning and rate of whole traces by each key alone and in all; score is a response_score()."""
    flags = scores.select(*keys, F.col("score.correct").alias("c"), F.col("score.semantic_correct").alias("s"), (F.col("score.trace.cue") & F.col("score.trace.reasoning") & F.col("score.trace.answer")).alias("t"))
    sets = [F.col(k) for k in keys]
    out = flags.groupingSets([[s] for s in sets] + [[]], *sets).agg(F.count("*").alias("n"), *[F.avg(F.col(x).cast("int")).alias(x) for x in "cst"], *[F.grouping(k).alias(f"g_{k}") for k in keys])
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k in keys:
        name, value = F.when(F.col(f"g_{k}") == 0, k).otherwise(name), F.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return out.select(name.alias("grouping"), value.alias("key"), "n", F.col("c").alias("accuracy"), F.col("s").alias("semantic_accuracy"), F.col("t").alias("trace_rate"))


#: Clusters whose differences every task holds (16 bytes each); more are an error.
CLUSTERS_AT_ONCE = 1 << 20


def bootstrap_draws(rows: DataFrame, cluster: str, left: Column, right: Column, resamples: int = LEAST_RESAMPLES, salt: int = 17) -> DataFrame:
    """Paired cluster bootstrap of right less left accuracy, each resample drawing as many clusters as there are, with replacement.

    One row: observed, mean, low and high (2.5 and 97.5 percentiles), records,
    clusters. Draw j of resample r takes the cluster whose place by name a hash
    of (salt, r, j) gives, so any engine draws the same and every resample has
    exactly as many draws. Tasks take ranges of resamples and hold one
    difference and one size a cluster: clusters are a benchmark's scenes, at
    most CLUSTERS_AT_ONCE, which is checked; bootstrap() has no such bound.
    """
    if resamples < LEAST_RESAMPLES:
        raise ValueError(f"at least {LEAST_RESAMPLES} resamples")
    per = rows.groupBy(cluster).agg(F.sum(right.cast("int") - left.cast("int")).alias("d"), F.count("*").alias("n"))
    held = per.orderBy(F.col(cluster).cast("string").asc_nulls_first()).limit(CLUSTERS_AT_ONCE + 1).select(F.coalesce("d", F.lit(0)).alias("d"), "n").toPandas()
    count = len(held)
    if count < 2 or count > CLUSTERS_AT_ONCE:
        raise ValueError(f"{count} clusters: at least 2 and at most {CLUSTERS_AT_ONCE}")
    difference, size = held["d"].to_numpy(np.int64), held["n"].to_numpy(np.int64)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.column("id").to_pylist():
                d = n = 0
                for start in range(0, count, 1 << 16):
                    x = (np.arange(start, min(start + (1 << 16), count), dtype=np.int64) * 69_621 + r * 16_807 + salt) % _PRIME
                    for shift, factor in _STEPS:
                        x = ((x ^ x >> shift) * factor) % _PRIME
                    d += int(difference[x % count].sum())
                    n += int(size[x % count].sum())
                out.append(d / n)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["delta"])

    spark = rows.sparkSession
    deltas = spark.range(0, resamples, 1, 4 * spark.sparkContext.defaultParallelism).mapInArrow(drawn, "delta double")
    ends = (F.avg("delta").alias("mean"), F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"))
    total = F.lit(int(size.sum())).cast("long")
    return deltas.agg(*ends).select((F.lit(int(difference.sum())) / total).alias("observed"), "mean", "low", "high", total.alias("records"), F.lit(count).cast("long").alias("clusters"))
