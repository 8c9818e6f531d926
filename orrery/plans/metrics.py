"""Queries of evaluation and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import audit as A
from orrery.operators import evaluation as E
from orrery.plans.registry import query, table

_RIGHT = "l_discount >= 0.05"


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query(f"""
WITH m AS (
  SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS "grouping",
    coalesce(l_returnflag, l_linestatus) AS key, CAST(sum(({_RIGHT})::INT) AS BIGINT) AS correct, count(*) AS total
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ()))
SELECT *, correct / total AS accuracy, CASE WHEN total = 0 THEN 'NA_ZERO_DENOMINATOR' ELSE 'OK' END AS status FROM m""")
def metric_by_group(spark, d):
    return E.accuracy_sets(_lines(spark, d), F.expr(_RIGHT), ["l_returnflag", "l_linestatus"])


@query(f"""SELECT l_linenumber, CAST(sum(({_RIGHT})::INT) AS BIGINT) AS correct, count(*) AS total, sum(({_RIGHT})::INT) / count(*) AS accuracy, 'OK' AS status FROM lineitem GROUP BY 1""")
def accuracy_by_key(spark, d):
    return E.accuracy(_lines(spark, d), F.expr(_RIGHT), "l_linenumber")


_FAMILY = f"""f AS (
  SELECT l_orderkey, bool_and({_RIGHT}) AS ok, max(CASE WHEN l_returnflag = 'A' THEN ({_RIGHT})::INT END) AS a FROM lineitem GROUP BY l_orderkey
  HAVING count(*) = 3 AND count(DISTINCT l_returnflag) = 3)"""


@query(f"WITH {_FAMILY} SELECT CAST(sum(ok::INT) AS BIGINT) AS correct, count(*) AS total, sum(ok::INT) / count(*) AS accuracy, 'OK' AS status FROM f")
def family_exact_match(spark, d):
    return E.family_exact_match(_lines(spark, d), "l_orderkey", "l_returnflag", F.expr(_RIGHT), ("A", "N", "R"))


@query(f"WITH {_FAMILY} SELECT CAST(sum(ok::INT) AS BIGINT) AS correct, CAST(sum(a) AS BIGINT) AS total, sum(ok::INT) / sum(a) AS accuracy, 'OK' AS status FROM f")
def aces(spark, d):
    return E.conditional_success(_lines(spark, d), "l_orderkey", "l_returnflag", F.expr(_RIGHT), ("A", "N", "R"), "A")


@query("""
WITH p AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) AS k, max(CASE WHEN l_linestatus = 'O' THEN l_quantity > 25 END) AS pa, max(CASE WHEN l_linestatus = 'F' THEN l_quantity > 25 END) AS pb,
    max(CASE WHEN l_linestatus = 'O' THEN l_tax > 0.04 END) AS ta, max(CASE WHEN l_linestatus = 'F' THEN l_tax > 0.04 END) AS tb FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS pairs, CAST(sum((pa = ta AND pb = tb)::INT) AS BIGINT) AS exact, CAST(sum((ta <> tb)::INT) AS BIGINT) AS change_required, CAST(sum((ta <> tb AND pa <> pb)::INT) AS BIGINT) AS changed,
  CAST(sum((ta = tb)::INT) AS BIGINT) AS same_required, CAST(sum((ta = tb AND pa = pb)::INT) AS BIGINT) AS kept FROM p WHERE n = 2 AND k = 2""")
def pair_exact_match(spark, d):
    rows = _lines(spark, d).select("l_orderkey", "l_linestatus", F.expr("l_quantity > 25").alias("answer"), F.expr("l_tax > 0.04").alias("truth"))
    return E.pair_metrics(rows, "l_orderkey", "l_linestatus", "answer", "truth", ("O", "F"))


@query("""
WITH p AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id FROM documents WHERE n_chars > 8000 UNION ALL SELECT doc_id + 1000000 FROM documents WHERE n_chars > 9000) GROUP BY 1)
SELECT coalesce(l.doc_id, p.doc_id) AS record_id, coalesce(n, 0) AS n_predictions,
  CASE WHEN l.doc_id IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate_prediction' ELSE 'matched' END AS reason
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN p USING (doc_id)""")
def prediction_coverage(spark, d):
    docs = table(spark, d, "documents")
    predictions = docs.where("n_chars > 1000").select("doc_id").unionAll(docs.where("n_chars > 8000").select("doc_id")).unionAll(docs.where("n_chars > 9000").selectExpr("doc_id + 1000000"))
    return E.coverage(table(spark, d, "labels").selectExpr("doc_id as record_id"), predictions.withColumnRenamed("doc_id", "record_id"))


@query(f"""WITH t AS (SELECT sum(c) AS sc, sum(t) AS st FROM (SELECT sum(({_RIGHT})::INT) AS c, count(*) AS t FROM lineitem GROUP BY l_shipdate))
SELECT CAST(sc AS BIGINT) AS strata_correct, CAST(st AS BIGINT) AS strata_total, CAST((SELECT sum(({_RIGHT})::INT) FROM lineitem) AS BIGINT) AS correct, (SELECT count(*) FROM lineitem) AS total, true AS holds FROM t""")
def split_reconstruction(spark, d):
    return E.reconstructs(_lines(spark, d), F.expr(_RIGHT), "l_shipdate")


@query(f"""WITH a AS (SELECT l_linenumber, l_returnflag, avg(({_RIGHT})::INT) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), b AS (SELECT l_linenumber, l_returnflag, avg(({_RIGHT})::INT) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l_linenumber || l_returnflag AS k, a.v AS "left", b.v AS "right", round(b.v - a.v, 9) AS delta FROM a FULL JOIN b USING (l_linenumber, l_returnflag)""")
def metric_deltas(spark, d):
    rows = _lines(spark, d).withColumn("k", F.concat(F.col("l_linenumber").cast("string"), "l_returnflag"))
    of = lambda s: E.accuracy(rows.where(F.col("l_linestatus") == s), F.expr(_RIGHT), "k")
    return E.metric_deltas(of("O"), of("F"), "k", "accuracy").withColumn("delta", F.round("delta", 9))


@query(f"""WITH r AS (SELECT l_returnflag, l_linenumber AS seed, CASE WHEN count(*) > 10 THEN avg(({_RIGHT})::INT) END AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(v), 9) AS mean, min(v) AS least, max(v) AS most, count(v) AS n_defined FROM r GROUP BY 1""")
def seed_summary(spark, d):
    runs = E.accuracy(_lines(spark, d), F.expr(_RIGHT), "l_returnflag", "l_linenumber").withColumn("v", F.when(F.col("total") > 10, F.col("accuracy")))
    return E.seed_summary(runs, ["l_returnflag"], "v").withColumn("mean", F.round("mean", 9))


@query("""WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT *, max(n) OVER (PARTITION BY o_orderpriority) AS top, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM n)
SELECT o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS majority, count(*) AS n_ties, max(n) AS n, CAST(max(total) AS BIGINT) AS total, max(n) / max(total) AS accuracy FROM t WHERE n = top GROUP BY 1""")
def majority_prior(spark, d):
    return E.majority(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("""WITH n AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
f AS (SELECT l_linenumber, l_returnflag AS guess FROM n QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY n DESC, l_returnflag) = 1)
SELECT count(guess) AS covered, CAST(sum((guess = l_returnflag)::INT) AS BIGINT) AS correct, count(*) AS total FROM lineitem LEFT JOIN f USING (l_linenumber) WHERE l_linestatus = 'O'""")
def train_fitted_prior(spark, d):
    rows = _lines(spark, d)
    return E.fitted_majority(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), "l_linenumber", "l_returnflag")


@query("SELECT *, n / sum(n) OVER (PARTITION BY o_orderstatus) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def target_distribution(spark, d):
    return A.distribution(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority")


@query("SELECT count(*) AS groups, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most, avg(n) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def cluster_stats(spark, d):
    return A.cluster_stats(table(spark, d, "orders"), "o_custkey")


@query("""SELECT 'o_custkey' AS key, count(*) AS groups, min(n) AS least, max(n) AS most, avg(n) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'o_orderpriority', count(*), min(n), max(n), avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)
UNION ALL SELECT 'o_orderstatus', count(*), min(n), max(n), avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)""")
def cluster_audit(spark, d):
    return A.cluster_audit(table(spark, d, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"])


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS splits, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_leakage(spark, d):
    return A.split_leaks(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""WITH r AS (SELECT d.doc_id, CASE WHEN n_chars > 500 THEN lang END AS lang, quality FROM documents d LEFT JOIN labels USING (doc_id)),
m AS (SELECT 'lang' AS field, doc_id FROM r WHERE lang IS NULL UNION ALL SELECT 'quality', doc_id FROM r WHERE quality IS NULL UNION ALL SELECT 'doc_id', doc_id FROM r WHERE doc_id IS NULL)
SELECT field, count(doc_id) AS n_missing, coalesce(array_to_string(list_sort(array_agg(doc_id) FILTER (k <= 5)), ','), '') AS first
FROM (SELECT unnest(['lang', 'quality', 'doc_id']) AS field) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc_id) AS k FROM m) USING (field) GROUP BY field""")
def schema_missing_fields(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("lang", F.when(F.col("n_chars") > 500, F.col("lang")))
    out = A.missing_fields(rows, ["lang", "quality", "doc_id"], "doc_id")
    return out.withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_distinct, count(*) = count(DISTINCT l_orderkey) AS \"unique\" FROM lineitem")
def uniqueness_gates(spark, d):
    return A.unique(_lines(spark, d), "l_orderkey")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n_targets, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def functional_dependency(spark, d):
    return A.broken_dependencies(_lines(spark, d), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("""WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_partkey, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b USING (l_partkey) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_parity(spark, d):
    rows = _lines(spark, d)
    return A.multiset_difference(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), ["l_partkey"])


@query("""SELECT DISTINCT c_custkey AS id, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def set_differences(spark, d):
    return A.set_differences(table(spark, d, "customer").selectExpr("c_custkey as k"), table(spark, d, "orders").selectExpr("o_custkey as k"), "k")


@query("SELECT doc_id, 'first' AS part FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, 'second' FROM documents WHERE lang = 'en' AND NOT n_chars > 2000")
def union_by_id(spark, d):
    docs = table(spark, d, "documents")
    return A.union_by_id(docs.where("n_chars > 2000").selectExpr("doc_id", "'first' as part"), docs.where("lang = 'en'").selectExpr("doc_id", "'second' as part"), "doc_id")


@query("SELECT user_id, count(*) AS n_rows FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1")
def dangling_references(spark, d):
    return A.dangling(table(spark, d, "events"), "user_id", table(spark, d, "customer").where("c_acctbal >= 0"), "c_custkey")


_GATES = """m AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS k, avg(c_acctbal) AS bal, sum((c_acctbal < 0)::INT) / count(*) AS neg FROM customer),
g AS (
  SELECT 'rows' AS gate, CAST(n AS DOUBLE) AS measured, 100.0 AS required, n >= 100 AS passed FROM m
  UNION ALL SELECT 'segments', k, 5, k >= 5 FROM m UNION ALL SELECT 'negative_share', neg, 0.05, neg <= 0.05 FROM m)"""


def _gates(spark, d):
    one = table(spark, d, "customer").agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("k"), (F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("neg"))
    return A.gates(one, A.at_least("rows", F.col("n"), 100.0), A.at_least("segments", F.col("k"), 5.0), A.at_most("negative_share", F.col("neg"), 0.05))


@query(f"WITH {_GATES} SELECT gate, round(measured, 9) AS measured, CAST(required AS DOUBLE) AS required, passed FROM g")
def coverage_gates(spark, d):
    return _gates(spark, d).withColumn("measured", F.round("measured", 9))


@query(f"WITH {_GATES} SELECT CAST(sum((NOT passed)::INT) AS BIGINT) AS failed, count(*) AS total, CASE WHEN sum((NOT passed)::INT) = 0 THEN 'pass' WHEN 2 * sum((NOT passed)::INT) < count(*) THEN 'warn' ELSE 'fail' END AS status FROM g")
def overall_verdict(spark, d):
    return A.verdict(_gates(spark, d))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_quantity > 45)")
def family_atomic_filter(spark, d):
    return A.family_atomic(_lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber")


#: From clusters c (k, c, a, b) the resamples' differences e (k, r, delta) of each endpoint k.
BOOTSTRAP_SQL = """p AS (SELECT k, c, sum(b::INT - a::INT) AS d, count(*) AS n FROM c GROUP BY k, c),
s AS (SELECT k, d, n, CAST('0x' || substr(md5('17:' || c), 1, 12) AS BIGINT) % 2147483647 AS h FROM p),
r0 AS (SELECT k, d, n, r, (h + r * 69621 + 1) % 2147483647 AS h FROM s, (SELECT unnest(range(10000)) AS r)),
r1 AS (SELECT k, d, n, r, (xor(h, h >> 15) * 48271) % 2147483647 AS h FROM r0),
r2 AS (SELECT k, d, n, r, (xor(h, h >> 13) * 40692) % 2147483647 AS h FROM r1),
r3 AS (SELECT k, d, n, r, CAST((xor(h, h >> 16) * 16807) % 2147483647 AS DOUBLE) / 2147483647 AS u FROM r2),
w AS (SELECT k, d, n, r, CASE WHEN u < 0.36787944117 THEN 0 WHEN u < 0.73575888234 THEN 1 WHEN u < 0.91969860293 THEN 2 WHEN u < 0.98101184312 THEN 3 WHEN u < 0.99634015317 THEN 4
  WHEN u < 0.99940581518 THEN 5 WHEN u < 0.99991675885 THEN 6 WHEN u < 0.99998975080 THEN 7 ELSE 8 END AS w FROM r3),
e AS (SELECT k, r, sum(w * d) / nullif(sum(w * n), 0) AS delta FROM w GROUP BY k, r)"""
ENDS_SQL = "round(avg(delta), 9) AS mean, round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high"


@query(f"""WITH c AS (SELECT 'all' AS k, o_custkey AS c, l_discount >= 0.05 AS a, l_tax >= 0.04 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {BOOTSTRAP_SQL}
SELECT {ENDS_SQL} FROM e""")
def cluster_bootstrap(spark, d):
    rows = _lines(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = E.bootstrap(rows, "o_custkey", F.expr("l_discount >= 0.05"), F.expr("l_tax >= 0.04"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])
