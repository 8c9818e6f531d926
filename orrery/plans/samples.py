"""Queries of splits, samples and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import relations as R
from orrery.operators import sampling as S
from orrery.operators import schedule as X
from orrery.plans.registry import ENTITIES_SQL, entities, query, table
from orrery.plans.spatial import CANDIDATES_SQL


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('v1:' || c_custkey), c_custkey) AS r FROM customer)
SELECT c_custkey, CASE WHEN r <= 60 THEN 'test' WHEN r <= 100 THEN 'val' ELSE 'train' END AS split FROM r""")
def hash_split(spark, d):
    return S.hash_split(table(spark, d, "customer"), "c_custkey", "v1", (("test", 60), ("val", 40)))


_QUOTA = """q AS (
  SELECT k, n, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY (floor(x) < n) DESC, round(x - floor(x), 9) DESC, n DESC, k DESC) <= 100 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
  FROM (SELECT c_mktsegment AS k, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM customer) AS x FROM customer GROUP BY 1))"""


@query(f"WITH {_QUOTA} SELECT k AS c_mktsegment, n, quota FROM q")
def largest_remainder(spark, d):
    sizes = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return S.largest_remainder(sizes, "c_mktsegment", "n", 100)


@query(f"""WITH {_QUOTA}, r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('v2:' || c_custkey), c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN r <= quota THEN 'test' WHEN r <= 2 * quota THEN 'val' ELSE 'train' END AS split FROM r JOIN q ON k = c_mktsegment""")
def stratified_split(spark, d):
    return S.stratified_split(table(spark, d, "customer"), "c_custkey", "c_mktsegment", "v2", (("test", 100), ("val", 100)))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders)
SELECT o_orderkey, o_orderpriority, turn FROM r ORDER BY turn, o_orderpriority LIMIT 57""")
def round_robin_sample(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return S.round_robin(rows, "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 57).select("o_orderkey", "o_orderpriority", F.col("turn").cast("long").alias("turn"))


@query("""WITH f AS (SELECT o_orderstatus AS split, o_orderpriority AS label, o_custkey AS fact, min(o_orderkey) AS surface FROM orders GROUP BY ALL),
n AS (SELECT split, min(c) AS fl FROM (SELECT split, label, count(*) AS c FROM f GROUP BY ALL) GROUP BY split)
SELECT split, label, fact, surface FROM f JOIN n USING (split) QUALIFY row_number() OVER (PARTITION BY split, label ORDER BY sha256('v3:' || fact), fact) <= fl""")
def label_balanced_floor(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderstatus as split", "o_orderpriority as label", "o_custkey as fact", "o_orderkey as surface")
    return S.balanced_floor(rows, "split", "label", "fact", "surface", "v3")


@query("""SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber) = 1""")
def unique_pairs(spark, d):
    return S.unique_pairs(table(spark, d, "lineitem"), [], "l_partkey", "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_suppkey", "l_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_witness(spark, d):
    return S.best_per(table(spark, d, "orders"), ["o_custkey"], F.struct("o_totalprice", -F.col("o_orderkey")), "o_orderkey", "o_totalprice")


@query("""WITH f AS (SELECT *, sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM f WHERE o_orderstatus <> 'F' OR k <= 2)
SELECT * FROM p WHERE place <= 5""")
def capped_selection(spark, d):
    out = S.capped_running(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "F", 2, 5)
    return out.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH g AS (SELECT c_mktsegment || '/' || c_nationkey AS g, count(*) AS n FROM customer GROUP BY ALL)
SELECT * FROM (SELECT g, n, CAST(coalesce(sum(n) OVER (ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g) WHERE before < 400""")
def episode_packing(spark, d):
    groups = table(spark, d, "customer").groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("g")).agg(F.count("*").alias("n"))
    return S.packed(groups, [F.col("n").desc(), F.col("g")], "n", 400)


@query("""WITH m AS (SELECT c_mktsegment, count(*) AS n, sum((c_acctbal < 0)::INT) AS risky FROM customer GROUP BY 1)
SELECT c_mktsegment, n, CAST(risky AS BIGINT) AS risky, CAST(least(risky, ceil(50 * least(0.6, risky / n * 2.0))) AS BIGINT) AS quota FROM m""")
def risk_quota(spark, d):
    m = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("risky"))
    return m.withColumn("quota", S.risk_quota(F.col("n"), F.col("risky"), F.lit(50), 2.0))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, sha256('v4:' || c_custkey), c_custkey) AS turn FROM customer)
SELECT c_custkey, c_mktsegment, turn FROM r ORDER BY turn, sha256('v4:' || c_mktsegment), c_mktsegment LIMIT 33""")
def risk_round_robin(spark, d):
    out = S.risk_round_robin(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", "v4", 33)
    return out.select("c_custkey", "c_mktsegment", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH RECURSIVE {ENTITIES_SQL}, {CANDIDATES_SQL},
o AS (SELECT coalesce(region, -1) AS g, region, subject, reference, relation, m, CAST(row_number() OVER (PARTITION BY region ORDER BY -round(m, 9), subject, reference) AS BIGINT) AS i,
  CASE WHEN subject < reference THEN subject || '/' || reference ELSE reference || '/' || subject END AS pair FROM w),
t(g, i, pairs, rels, kept) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false FROM o
  UNION ALL
  SELECT t.g, o.i, CASE WHEN ok THEN list_append(pairs, pair) ELSE pairs END, CASE WHEN ok THEN list_append(rels, relation) ELSE rels END, ok
  FROM (SELECT t.g, o.i, t.pairs, t.rels, o.pair, o.relation, NOT list_contains(t.pairs, o.pair) AND len(list_filter(t.rels, lambda x: x = o.relation)) < 2 AS ok FROM t JOIN o ON o.g = t.g AND o.i = t.i + 1) AS o JOIN (SELECT DISTINCT g FROM o) AS t ON t.g = o.g)
SELECT o.region, subject, reference, relation, m AS margin FROM t JOIN o USING (g, i) WHERE kept""")
def greedy_unique_pairs(spark, d):
    e = entities(spark, d)
    ranked = lambda c: c.withColumn("rank", -F.round("margin", 9)).select("region", "subject", "reference", "relation", "margin", "rank")
    c, few = (ranked(R.relation_candidates(e, per_relation=None, keep=("region",), some=some)) for some in (None, R.probe(e)))
    # two of each of six relations: ten pairs at most are taken by the others, so the first twelve of a relation hold its two
    c = R.up_to(c, few, ["region", "relation"], "rank", 2 * len(R.INVERSE))
    c = R.top_per(c, ["region", "relation"], [F.col("rank"), F.col("subject"), F.col("reference")], 2 * len(R.INVERSE))
    return S.greedy_pairs(c, "region", "subject", "reference", "relation", "rank").drop("rank")


@query(f"""WITH RECURSIVE {ENTITIES_SQL}, {CANDIDATES_SQL},
b AS (SELECT region, relation, max(m) AS m, CAST(dense_rank() OVER (ORDER BY region NULLS FIRST) AS BIGINT) AS i FROM w GROUP BY region, relation),
t(i, rels, best) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS STRUCT(r VARCHAR, m DOUBLE))
  UNION ALL
  SELECT any_value(b.i), list_append(any_value(t.rels), arg_min(b.relation, row(len(list_filter(t.rels, lambda x: x = b.relation)), -b.m, b.relation))),
    arg_min({{'r': b.relation, 'm': b.m}}, row(len(list_filter(t.rels, lambda x: x = b.relation)), -b.m, b.relation))
  FROM t JOIN b ON b.i = t.i + 1 GROUP BY t.i)
SELECT (SELECT any_value(region) FROM b WHERE b.i = t.i) AS region, best.r AS relation, best.m AS margin FROM t WHERE i > 0""")
def balanced_relations(spark, d):
    c = R.relation_candidates(entities(spark, d), per_relation=None, keep=("region",))
    return S.balanced_choices(c, "region", "relation", "margin")


@query("""WITH RECURSIVE pool AS (SELECT CAST(s_suppkey AS VARCHAR) AS u, CAST(s_nationkey AS VARCHAR) AS n, CAST(s_acctbal < 0 AS VARCHAR) AS neg, sha256('v5:' || s_suppkey) AS h FROM supplier),
t(k, us, ns, gs) AS (
  SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT k + 1, list_append(us, best.u), list_append(ns, best.n), list_append(gs, best.g) FROM (
    SELECT t.k, any_value(t.us) AS us, any_value(t.ns) AS ns, any_value(t.gs) AS gs,
      arg_min({'u': p.u, 'n': p.n, 'g': p.neg}, row(-(CAST(1 AS DOUBLE) / (1 + len(list_filter(t.ns, lambda x: x = p.n))) + CAST(1 AS DOUBLE) / (1 + len(list_filter(t.gs, lambda x: x = p.neg)))), p.h, p.u)) AS best
    FROM t JOIN pool p ON NOT list_contains(t.us, p.u) WHERE t.k < 20 GROUP BY t.k))
SELECT unnest(us) AS unit, CAST(unnest(range(len(us))) AS BIGINT) AS place FROM (SELECT us FROM t ORDER BY k DESC LIMIT 1)""")
def balanced_remainder(spark, d):
    pool = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("u"), F.col("s_nationkey").cast("string").alias("n"), (F.col("s_acctbal") < 0).cast("string").alias("neg"))
    return S.balanced_remainder(pool, "u", ["n", "neg"], 20, "v5")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('v6:' || p_partkey), p_partkey) = 1 AS lead FROM part),
s AS (SELECT p_partkey, lead, CAST(sum(p_size) OVER (ORDER BY lead DESC, sha256('v6:' || p_partkey), p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS facts_so_far FROM p)
SELECT p_partkey, lead, facts_so_far FROM s WHERE lead OR facts_so_far <= 2000""")
def covered_subset(spark, d):
    return S.covered_subset(table(spark, d, "part"), "p_partkey", "p_brand", "p_size", 2000, "v6")


@query("""WITH a AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_tax < 0.08 GROUP BY ALL)
SELECT l_orderkey, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS n_left, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS n_right, bool_and(coalesce(a.n, 0) = coalesce(b.n, 0)) AS same_facts
FROM a FULL JOIN b USING (l_orderkey, l_suppkey) GROUP BY l_orderkey""")
def paired_arms(spark, d):
    rows = table(spark, d, "lineitem")
    return X.arm_pairs(rows, rows.where("l_tax < 0.08"), "l_orderkey", "l_suppkey")


@query("""WITH d AS (SELECT o_orderkey AS record_id, o_custkey, unnest(range(1 + o_orderkey % 3)) AS repeat_index, 1 + o_orderkey % 3 AS k FROM orders)
SELECT record_id, CAST(repeat_index AS INT) AS repeat_index, CAST(1 AS BIGINT) AS weight_num, k AS weight_den, sha256('23:fact_matched:' || record_id || ':' || repeat_index) AS schedule_rank,
  row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('23:fact_matched:' || record_id || ':' || repeat_index)) - 1 AS schedule_index FROM d""")
def schedule_expand(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as record_id", "o_custkey", "cast(1 + o_orderkey % 3 as int) as repeats")
    out = X.draw_order(X.expanded(rows, "repeats", "fact_matched", "23"), "o_custkey")
    return out.select("record_id", "repeat_index", "weight_num", "weight_den", "schedule_rank", F.col("schedule_index").cast("long").alias("schedule_index"))


@query("SELECT o_custkey, CAST(6 * count(*) AS BIGINT) AS weight, CAST(6 AS BIGINT) AS unit, true AS exact FROM orders GROUP BY 1")
def exact_weights(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey as record_id", "o_custkey", "cast(1 + o_orderkey % 3 as int) as repeats")
    return X.fact_weights(X.expanded(rows, "repeats", "fact_matched", "23"), "o_custkey", 6)


@query("""SELECT conv_id, count(*) AS n_turns, CAST(sum((role = 'assistant')::INT) AS BIGINT) AS n_replies, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  CAST(sum(len(regexp_extract_all(text, '[A-Za-z]+|\\d+|[\\x{4e00}-\\x{9fff}]|[^\\sA-Za-z\\d\\x{4e00}-\\x{9fff}]'))) AS BIGINT) AS n_lexemes FROM conversations GROUP BY 1""")
def message_accounting(spark, d):
    return X.message_accounting(table(spark, d, "conversations"), "conv_id", "role", "text")


@query("""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, unnest(range(len(ls))) AS line, unnest(ls) AS content FROM l),
s AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY conv_id, turn ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u)
SELECT conv_id, turn, CAST(line AS INT) AS line, CAST(st AS INT) AS start, CAST(st + length(content) AS INT) AS "end" FROM s""")
def answer_segments(spark, d):
    return X.answer_segments(table(spark, d, "conversations").where("role = 'assistant'"), "text", "conv_id", "turn")


@query("""WITH o AS (SELECT l_suppkey, l_partkey FROM lineitem), s AS (SELECT p_partkey AS l_partkey, p_size AS width, p_size + 1 AS height FROM part WHERE p_size > 1)
SELECT l_suppkey, count(*) AS n_images, CASE WHEN count(*) = count(width) THEN CAST(sum(width * height) AS BIGINT) END AS pixels FROM o LEFT JOIN s USING (l_partkey) GROUP BY 1""")
def pixel_exposure(spark, d):
    sizes = table(spark, d, "part").where("p_size > 1").selectExpr("p_partkey as l_partkey", "p_size as width", "p_size + 1 as height")
    return X.pixel_exposure(table(spark, d, "lineitem"), sizes, "l_suppkey", "l_partkey")
