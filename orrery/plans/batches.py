"""Batches of questions, paired arms, inventories and rationales."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import inventory, verify
from orrery.operators import questions as Q
from orrery.plans.registry import query, table

_TASKS = (*Q.LIFTED_TASKS, "unknown_abstention", "grounding_presence")
_LIST = "[" + ", ".join(f"'{t}'" for t in _TASKS) + "]"


@query(f"""WITH RECURSIVE raw AS (SELECT o_custkey AS ep, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS fact, l_suppkey % {len(_TASKS)} AS score, ({_LIST})[l_suppkey % {len(_TASKS)} + 1] AS task,
    CASE WHEN l_tax = 0 THEN '' ELSE 'g' || (l_partkey % 15) END AS grp, l_returnflag AS flag, l_linestatus AS status, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
kept AS (SELECT * FROM raw WHERE (task <> 'grounding_presence' AND task <> 'unknown_abstention' OR task = 'unknown_abstention' AND status = 'O') AND flag <> 'N' AND NOT (task = 'orbit_identity' AND flag = 'A')
  AND fact NOT IN (SELECT fact FROM raw WHERE l_discount >= 0.09)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score, fact, task, grp) AS i FROM kept),
t(ep, i, tasks, groups, took) AS (SELECT DISTINCT ep, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false FROM o
  UNION ALL SELECT ep, i, CASE WHEN good THEN list_append(tasks, task) ELSE tasks END, CASE WHEN good AND grp <> '' THEN list_append(groups, grp) ELSE groups END, good
  FROM (SELECT o.*, t.tasks, t.groups, NOT list_contains(t.tasks, o.task) AND NOT list_contains(t.groups, o.grp) AS good FROM t JOIN o ON o.ep = t.ep AND o.i = t.i + 1))
SELECT t.ep AS episode, fact AS fact_id, row_number() OVER (PARTITION BY t.ep ORDER BY i) - 1 AS place FROM t JOIN o USING (ep, i) WHERE took""")
def context_lift(spark, d):
    """Lines of a customer as its episode's questions: which of them one batch may ask of all views."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_suppkey") % len(_TASKS)
    task = F.array(*map(F.lit, _TASKS))[n.cast("int")]
    rows = rows.select(
        F.col("o_custkey").alias("episode"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"), task.alias("task_type"), F.concat(task, F.col("l_returnflag")).alias("program_id"),
        F.when(F.col("l_returnflag") == "N", "frame_b").otherwise("canonical").alias("variant"), F.when(F.col("l_tax") != 0, F.concat(F.lit("g"), (F.col("l_partkey") % 15).cast("string"))).alias("group"),
        F.array("l_linestatus").alias("models"), F.array(F.lit("O")).alias("all_views"), n.alias("score"), "l_discount",
    )
    return Q.context_lift(rows, rows.where("l_discount >= 0.09"), ("orbit_identityA",)).withColumn("place", F.col("place").cast("long"))


@query("""WITH e AS (SELECT l_orderkey AS c, o_orderpriority AS image FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT l_orderkey AS c, l_suppkey AS f, CASE WHEN l_tax < 0.08 THEN o_orderpriority ELSE 'x' END AS image FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 100 DAY
  UNION ALL SELECT -n_nationkey - 1, n_nationkey, n_name FROM nation),
n AS (SELECT l_orderkey AS c, l_suppkey AS f, count(*) AS a FROM lineitem GROUP BY ALL), m AS (SELECT c, f, count(*) AS b FROM s GROUP BY ALL)
SELECT c AS comparison, 'missing in isolated' AS fault FROM e WHERE c NOT IN (SELECT c FROM s) UNION ALL SELECT DISTINCT c, 'missing in episodes' FROM s WHERE c NOT IN (SELECT c FROM e)
UNION ALL SELECT DISTINCT s.c, 'other images' FROM s JOIN e ON e.c = s.c WHERE s.image <> e.image
UNION ALL SELECT DISTINCT coalesce(n.c, m.c), 'other facts' FROM n FULL JOIN m ON n.c = m.c AND n.f = m.f WHERE a IS DISTINCT FROM b AND coalesce(n.c, m.c) IN (SELECT c FROM e) AND coalesce(n.c, m.c) IN (SELECT c FROM s)""")
def arm_faults(spark, d):
    """Orders with all their suppliers against lines one by one, of which late ones are missing."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    whole = rows.groupBy(F.col("l_orderkey").alias("comparison"), "o_orderpriority").agg(F.collect_list("l_suppkey").alias("facts")).select("comparison", "facts", F.array("o_orderpriority").alias("images"))
    image = F.when(F.col("l_tax") < 0.08, F.col("o_orderpriority")).otherwise("x")
    single = rows.where("l_shipdate <= o_orderdate + interval 100 days").select(F.col("l_orderkey").alias("comparison"), F.array("l_suppkey").alias("facts"), F.array(image).alias("images"))
    strange = table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("comparison"), F.array(F.col("n_nationkey").cast("long")).alias("facts"), F.array("n_name").alias("images"))
    return verify.arm_faults(whole, single.unionByName(strange))


@query("""WITH i AS (SELECT l_suppkey AS s, l_linenumber AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
SELECT l_orderkey || ':' || l_partkey AS question, '/r/' || l_suppkey AS bundle_root, l_linenumber AS view_id, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'repeated' ELSE 'found' END AS status
FROM lineitem LEFT JOIN i ON s = l_suppkey AND v = l_linenumber""")
def inventory_lookup(spark, d):
    """Every line's supplier and number looked up among those of one flag, paths written in two ways."""
    rows = table(spark, d, "lineitem")
    root = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    supp = F.col("l_suppkey").cast("string")
    asked = rows.select(F.concat_ws(":", "l_orderkey", "l_partkey").alias("question"), root("/r//./", supp, "/").alias("bundle_root"), F.col("l_linenumber").alias("view_id"))
    return inventory.inventory_views(asked, rows.where("l_returnflag = 'N'").select(root("/r/", supp).alias("bundle_root"), F.col("l_linenumber").alias("view_id")))


@query(f"""WITH q AS (SELECT o_orderkey, ({_LIST})[o_orderkey % {len(_TASKS)} + 1] AS task, o_custkey % 6 AS k, lower(o_orderpriority) AS label FROM orders),
v AS (SELECT *, CASE WHEN k > 2 THEN 'view 1 to view ' || (k + 1) ELSE array_to_string(['view ' || (i + 1) FOR i IN range(k + 1)], ', ') END AS seen, CASE label WHEN '1-urgent' THEN 'an urgent one' ELSE trim(replace(label, '_', ' ')) END AS name FROM q)
SELECT o_orderkey, CASE task WHEN 'cross_view_relation' THEN 'The two objects are shown by ' || seen || ', and no view shows both; both are placed on one plane and compared; ' WHEN 'counterfactual_verification' THEN 'The relation is rebuilt from ' || seen || ' and compared with the claim; '
  WHEN 'object_centric_perspective' THEN 'Standpoint, facing and target are bound by ' || seen || ' and seen from there; ' WHEN 'last_seen_memory' THEN 'The object is followed through the views in order, and those after its last are checked; '
  WHEN 'metric_distance' THEN 'Both objects are bound in ' || seen || ' and their centres compared; ' WHEN 'unknown_abstention' THEN 'Only the views given are checked; what they do not show may still be there; ' ELSE '' END || name AS rationale FROM v""")
def rationales(spark, d):
    """A rationale for each order, which names a label with a fallback."""
    task = F.array(*map(F.lit, _TASKS))[(F.col("o_orderkey") % len(_TASKS)).cast("int")]
    name = T.entity_name(F.lower("o_orderpriority"), F.create_map(F.lit("1-urgent"), F.lit("an urgent one")))
    steps = F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 6)
    return table(spark, d, "orders").select("o_orderkey", Q.rationale(task, steps, name).alias("rationale"))
