"""Queries on reviews of views, pairs and schedules, over the driver's tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import structs
from orrery.operators import gates as Q
from orrery.operators import verify as V
from orrery.operators import visibility as S
from orrery.plans.registry import SIGHTINGS_SQL, query, sightings, table


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 2 AS sd, l_quantity * 5 AS hi, 260 - l_quantity * 6 AS lo, l_discount * 50 AS sharp FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN sd < 5 THEN 'near_uniform_rgb' END, CASE WHEN hi < 20 THEN 'severe_underexposure' END, CASE WHEN lo > 235 THEN 'severe_overexposure' END,
  CASE WHEN sharp < 1.5 AND l_linenumber <= 2 THEN 'low_information_or_camera_collision' END) AS reasons FROM v)
SELECT * FROM r WHERE reasons <> ''""")
def visual_blockers(spark, d):
    q = F.col("l_quantity")
    views = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q / 2).alias("rgb_std"), (q * 5).alias("rgb_p99"), (260 - q * 6).alias("rgb_p01"), (F.col("l_discount") * 50).alias("sharpness"), F.col("l_linenumber").alias("instances"))
    return Q.visual_blockers(views).select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH j AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'certified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'failed' WHEN 3 THEN 'certified' END AS job,
  CASE WHEN o_orderkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS bi, CASE WHEN o_orderkey % 7 = 0 THEN 'warn' ELSE 'pass' END AS bv, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'pass' END AS vi, 'pass' AS vv FROM orders)
SELECT o_orderkey, CASE WHEN job IS NULL OR job NOT IN ('certified', 'needs_review') THEN 'excluded' WHEN bi <> 'pass' OR vi IS NULL OR vi <> 'pass' THEN 'audit_only' ELSE 'candidate' END AS tier,
  CASE WHEN job IS NULL OR job NOT IN ('certified', 'needs_review') THEN 'intervention job status is ' || coalesce(job, 'unknown')
    WHEN bi <> 'pass' OR vi IS NULL OR vi <> 'pass' THEN concat_ws(';', CASE WHEN bi <> 'pass' THEN 'base sensor integrity is not a full pass' END, CASE WHEN vi IS NULL OR vi <> 'pass' THEN 'variant sensor integrity is not a full pass' END)
    WHEN bv <> 'pass' OR vv <> 'pass' THEN 'base or variant visual warning requires human review' ELSE 'awaiting explicit pair-level human acceptance' END AS reasons FROM j""")
def pair_tiers(spark, d):
    k = F.col("o_orderkey")
    job = F.when(k % 5 == 0, "certified").when(k % 5 == 1, "needs_review").when(k % 5 == 2, "failed").when(k % 5 == 3, "certified")
    tier = Q.pair_tier(job, F.when(k % 3 == 0, "fail").otherwise("pass"), F.when(k % 7 == 0, "warn").otherwise("pass"), F.when(k % 11 != 0, "pass"), F.lit("pass"))
    return table(spark, d, "orders").select("o_orderkey", tier.alias("t")).select("o_orderkey", F.col("t.tier").alias("tier"), F.array_join("t.reasons", ";").alias("reasons"))


@query(f"""WITH {SIGHTINGS_SQL}, v AS (SELECT episode, step, bool_and(pixels >= 20) AS ok FROM sightings GROUP BY ALL)
SELECT episode AS question, coalesce(string_agg(step, ',' ORDER BY step DESC) FILTER (NOT ok), '') AS bad FROM v GROUP BY episode""")
def degenerate_views(spark, d):
    v = sightings(spark, d).groupBy("episode", "step").agg(F.min("pixels").alias("least"))
    name = F.struct("episode", "step")
    asked = v.groupBy(F.col("episode").alias("question")).agg(F.reverse(F.array_sort(F.collect_list(name))).alias("views"))
    bad = Q.degenerate_views(asked, v.select(name.alias("view"), (F.col("least") >= 20).alias("passed")))
    return bad.select("question", F.array_join(F.transform("bad_views", lambda x: x["step"].cast("string")), ",").alias("bad"))


@query("""SELECT coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END, 'unavailable_no_quality_report') AS decision, count(*) AS jobs, count(DISTINCT o_custkey) AS scenes FROM orders GROUP BY 1""")
def adjudication_counts(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("scene"), F.col("o_orderstatus").alias("decision"))
    return Q.adjudication_counts(jobs.drop("decision"), jobs.where("job % 4 <> 0").select("job", "decision"))


@query(f"""WITH {SIGHTINGS_SQL} SELECT episode, step, entity, pixels, row_number() OVER (PARTITION BY episode, step ORDER BY pixels DESC, entity) AS place FROM sightings WHERE pixels >= 30""")
def named_visible(spark, d):
    return S.named_visible(sightings(spark, d), 30)


@query(f"""WITH {SIGHTINGS_SQL}, p AS (SELECT DISTINCT episode, step, CAST((step * step * 59) % 360 AS DOUBLE) AS yaw FROM sightings),
c AS (SELECT episode, step, yaw - lag(yaw) OVER (PARTITION BY episode ORDER BY step) AS raw FROM p), w AS (SELECT episode, step, CASE WHEN raw < -180 THEN raw + 360 WHEN raw >= 180 THEN raw - 360 ELSE raw END AS turn FROM c WHERE raw IS NOT NULL)
SELECT episode, step, turn AS yaw_change_deg, CASE WHEN abs(turn) >= 175 THEN 'turnaround' ELSE 'heading_change' END AS event, abs(turn) >= 175 AS verified FROM w""")
def turn_events(spark, d):
    return S.turn_events(sightings(spark, d).select("episode", "step", ((F.col("step") * F.col("step") * 59) % 360).cast("double").alias("yaw_deg")).distinct())


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 9 = 0 AS lost, o_orderkey % 7 = 0 AS other, o_orderkey % 5 = 0 AS moved, o_orderkey % 11 AS weight FROM orders),
f AS (SELECT k AS draw, concat_ws(',', CASE WHEN lost THEN 'source_line' END, CASE WHEN NOT lost AND other THEN 'source_sha256' END, CASE WHEN NOT lost AND moved THEN 'record_id' END, CASE WHEN weight = 0 THEN 'sample_weight' END) AS faults FROM s)
SELECT * FROM f WHERE faults <> ''""")
def schedule_faults(spark, d):
    rows = table(spark, d, "orders")
    k, facts = F.col("o_orderkey"), F.array("o_custkey", "o_orderkey")
    records = rows.select((k % 8).alias("source_jsonl"), k.alias("source_line"), F.lit("d").alias("source_sha256"), F.col("o_custkey").alias("record_id"), facts.alias("fact_ids"))
    draws = rows.select(
        k.alias("draw"), (k % 8).alias("source_jsonl"), F.when(k % 9 == 0, -k - 1).otherwise(k).alias("source_line"), F.when(k % 7 == 0, "x").otherwise("d").alias("source_sha256"),
        F.when(k % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("record_id"), facts.alias("fact_ids"), (k % 11).alias("sample_weight"),
    )
    return V.schedule_faults(draws, records).select("draw", F.array_join("faults", ",").alias("faults"))


@query("SELECT c_custkey, n_name AS split FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scene_splits(spark, d):
    units = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scene"))
    return V.with_split(units, table(spark, d, "nation").select(F.col("n_nationkey").alias("scene"), F.col("n_name").alias("split"))).select("c_custkey", "split")


@query("""WITH a AS (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY ALL),
x AS (SELECT o_custkey AS c, 'Z' AS s, count(*) AS n FROM orders WHERE o_orderkey % 97 = 0 GROUP BY ALL)
SELECT a.c, a.s, 'left' AS side, a.n - coalesce(b.n, 0) AS copies FROM a LEFT JOIN b USING (c, s) WHERE a.n <> coalesce(b.n, 0) UNION ALL SELECT c, s, 'right', n FROM x""")
def unequal_rows(spark, d):
    o = table(spark, d, "orders")
    left = o.select(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    right = o.where("o_orderkey % 10 <> 0").select(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).unionAll(o.where("o_orderkey % 97 = 0").select("o_custkey", F.lit("Z")))
    return V.unequal_rows(left, right)


@query("SELECT l_suppkey, name, sum(n) AS n FROM (SELECT l_suppkey, 'a' AS name, l_linenumber AS n FROM lineitem UNION ALL SELECT l_suppkey, l_returnflag, 2 FROM lineitem) GROUP BY ALL")
def summed_counters(spark, d):
    counter = F.create_map(F.lit("a"), F.col("l_linenumber").cast("long"), F.col("l_returnflag"), F.lit(2).cast("long"))
    return V.summed_counters(table(spark, d, "lineitem").select("l_suppkey", counter.alias("m")), "l_suppkey", "m")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey + 0.5 WHEN 1 THEN s_suppkey WHEN 2 THEN NULL ELSE 3 END AS right_m, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN -1.25 WHEN 2 THEN NULL ELSE 4 END AS front_m FROM supplier""")
def relation_components(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    made = (
        F.when(k % 4 == 0, F.concat(F.lit('{"oracle": {"query_right_m": 9, "query_front_m": 9, "ego_right_delta_m": '), n, F.lit('.5, "ego_front_delta_m": 2}}')))
        .when(k % 4 == 1, F.concat(F.lit('{"oracle": {"ego_right_delta_m": true, "ego_front_delta_m": 2, "query_right_m": '), n, F.lit(', "query_front_m": -1.25}}')))
        .when(k % 4 == 2, '{"oracle": {"query_right_m": "1", "query_front_m": 2}, "query_right_m": 1}')
        .otherwise('{"oracle": {"canonical_right_delta_m": 1, "target_ego_right_m": 3, "target_ego_front_m": 4}}')
    )
    found = structs.relation_components(made)
    return table(spark, d, "supplier").select("s_suppkey", found["right"].alias("right_m"), found["front"].alias("front_m"))


@query("""SELECT p_partkey, p_size * 100 >= 2000 AND p_partkey % 90 >= 40 AND (p_partkey % 10) / 10 < 0.8 AS passed FROM part""")
def salient_anchors(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("pixels"), (F.col("p_partkey") % 90).alias("min_side"), ((F.col("p_partkey") % 10) / 10).alias("outer_share"))
    return Q.gated(rows, *Q.anchor_checks()).select("p_partkey", "passed")
