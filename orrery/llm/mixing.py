"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions alone.

Documents are numbered by 30 bits of the MD5 of their id. For each source,
sizes are summed by the first 10 bits; the bucket where the budget is passed
is refined by the next 10 bits, and so once more. All documents below the
threshold that this gives are taken: no sort, and every run agrees. Only sums
by source and bucket are shuffled, combined before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.columns import KEYS_AT_ONCE, numbered, others, place
from orrery.plans.durable import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
LEVELS, BITS = 3, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size) with weight and target.

    Sources by code point, null last, get the weights in turn. They share
    `share` times the total by weight; no target is above `most` times its
    source's size, and what is cut off is shared by weight among the others
    until none is above. Sources in order of cap by weight fill up first, so
    the level is where the first source does not fill up.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    filled = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - F.coalesce(filled, F.lit(0.0))) / rest
    rows = rows.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    rows = rows.withColumn("at", first.over(every)["level"])
    return rows.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def _numbers(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """A numbered row's source, size and number."""
    digest = F.md5(F.col(place(docs, id_col)).cast("string").cast("binary"))
    number = F.coalesce(F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - LEVELS * BITS), F.lit(0).cast("long"))
    return F.col(place(docs, source_col)).alias("source"), word_count(F.col(place(docs, text_col))).alias("size"), number.alias("number")


def thresholds(sized: DataFrame, **shares) -> DataFrame:
    """Rows (s, source_size, target, passes, threshold), one a source, from a written table of (source, size, number)."""
    plan = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    ratio = F.col("target") / F.col("source_size")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(2))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("want", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    plan = cut(plan.select("source", "source_size", "target", "passes", "want", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("had"), F.lit(0).cast("long").alias("held")))
    for level in range(1, LEVELS + 1):
        plan = cut(_refined(sized, plan, level))
    nearer = F.col("had") + F.col("held") - F.col("want") < F.col("want") - F.col("had")
    threshold = F.col("below") + F.when((F.col("want") > 0) & nearer, 1).otherwise(0)
    return plan.select(F.col("source").alias("s"), "source_size", "target", "passes", threshold.alias("threshold"))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with what their source's plan says; a plan of few sources, when counted, is broadcast, so that no source meets in one task."""
    return rows.join(F.broadcast(plan) if plan.count() <= KEYS_AT_ONCE else plan, F.col("source").eqNullSafe(F.col("s")))


def _copies() -> Column:
    return F.col("passes") + F.when((F.col("number") < F.col("threshold")) & (F.col("passes") < 2), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **shares) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, copies, taken.

    size: words of the text (null: 0). copies: 0, 1 or 2 of the document are
    taken, taken = copies * size. Each source takes whole passes of its
    documents and one more of those below a hash threshold. Rows of equal id
    are decided alike; a null id has number 0. Sources of no
    words have target 0. Further columns, of whatever names, are not looked
    at; texts of any length count whole; an empty table gives an empty result.
    """
    source, size, number = _numbers(docs, id_col, source_col, text_col)
    sized = cut(numbered(docs).select(F.col(place(docs, id_col)).cast("long").alias("doc_id"), source, size, number))
    out = _joined(sized, thresholds(sized, **shares))
    return out.select("doc_id", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def _refined(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The plan with the boundary bucket of this level: its first number, the size before it and the size it holds."""
    above = (LEVELS - level + 1) * BITS
    here = (LEVELS - level) * BITS
    at = plan.select(F.col("source").alias("s"), F.shiftright("below", above).alias("prefix"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("number", above) == F.col("prefix"))
    sums = sized.join(at, same).groupBy("source", F.shiftright("number", here).alias("bucket")).agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).withColumnRenamed("source", "s")
    found = sums.join(plan, F.col("source").eqNullSafe(F.col("s")))
    passed = F.col("had") + F.col("before") + F.col("n") > F.col("want")
    found = found.where(passed).groupBy("source").agg(F.min(F.struct("bucket", "before", "n")).alias("b")).withColumnRenamed("source", "s")
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select(
        "source", "source_size", "target", "passes", "want",
        F.coalesce(F.shiftleft("b.bucket", here), F.col("below")).alias("below"),
        (F.col("had") + F.coalesce("b.before", F.lit(0))).alias("had"),
        F.coalesce("b.n", F.lit(0)).alias("held"),
    )


def mixing_stage(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows that the mix takes, each once, with copies, size, source_size, target and taken after their columns.

    Rows are decided as mix() says: those of equal id alike, null texts and
    sources among them. Columns of the added names, in whatever case, are
    replaced, and any other name may be used. Texts stay where they are: only
    sums and one threshold a source are joined. An empty table stays empty.
    """
    added = ["copies", "size", "source_size", "target", "taken"]
    own = others(docs, added)
    source, size, number = _numbers(docs, id_col, source_col, text_col)
    rows = numbered(docs)
    plan = thresholds(cut(rows.select(source, size, number)))
    out = _joined(rows.select(*own, source, size, number), plan).withColumn("copies", _copies())
    return out.where("copies > 0").withColumn("taken", F.col("copies") * F.col("size")).select(*own, *added).toDF(*own.values(), *added)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) // 4, 0) AS num FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT source, source_size, ([3, 1, 2])[nth % 3 + 1] AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, cap / weight AS rate,
    (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY rate, level LIMIT 1) * weight, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS passes FROM t),
q AS (SELECT *, greatest(target - passes * source_size, 0) AS want FROM p),
c AS (SELECT source, num, n, sum(n) OVER (PARTITION BY source ORDER BY num) AS until FROM (SELECT source, num, sum(size) AS n FROM d GROUP BY ALL)),
b AS (
  SELECT q.source, num + CASE WHEN want > 0 AND until - want < want - (until - n) THEN 1 ELSE 0 END AS threshold
  FROM q JOIN c ON c.source IS NOT DISTINCT FROM q.source WHERE until > want
  QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY num) = 1)
SELECT doc_id, size, source_size, target, size * (passes + CASE WHEN passes < 2 AND num < coalesce(threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
"""
