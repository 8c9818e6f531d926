"""Queries of question building and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import questions as Q
from orrery.operators import relations as R
from orrery.operators import verify as V
from orrery.plans.registry import ENTITIES_SQL, SIGHTINGS_SQL, entities, query, sightings, table

_S = f"WITH {SIGHTINGS_SQL}"


@query(f"""{_S}, p AS (SELECT episode, 0 AS step, min(entity) AS present FROM sightings WHERE step = 0 GROUP BY episode),
n AS (SELECT episode, min(entity) AS absent FROM sightings s WHERE NOT EXISTS (SELECT 1 FROM sightings f WHERE f.episode = s.episode AND f.step = 0 AND f.entity = s.entity) GROUP BY episode)
SELECT episode, 'grounding_presence' AS task_type, CAST(step AS BIGINT) AS step, present AS entity, true AS answer FROM p
UNION ALL SELECT episode, 'grounding_presence', CAST(step AS BIGINT), absent, false FROM p JOIN n USING (episode)""")
def grounding_questions(spark, d):
    return Q.grounding_pairs(sightings(spark, d))


@query(f"""{_S}, e AS (SELECT episode, max(step) AS en FROM sightings GROUP BY 1), f AS (SELECT episode, entity, min(step) AS shown FROM sightings GROUP BY ALL HAVING min(step) >= 2),
l AS (SELECT f.episode, entity, shown, unnest(range(shown, en + 1)) AS step FROM f JOIN e USING (episode)),
w AS (SELECT episode, entity, shown, min(step) AS other FROM l WHERE NOT EXISTS (SELECT 1 FROM sightings s WHERE s.episode = l.episode AND s.entity = l.entity AND s.step = l.step) GROUP BY ALL)
SELECT episode, entity, 'prefix_unknown' AS variant, '0,1' AS steps, 'unknown' AS answer FROM w UNION ALL SELECT episode, entity, 'revealed', '0,' || shown, 'present' FROM w
UNION ALL SELECT episode, entity, 'decisive_deleted', '0,' || other, 'unknown' FROM w""")
def presence_families(spark, d):
    return Q.presence_families(sightings(spark, d)).withColumn("steps", F.array_join(F.col("steps").cast("array<string>"), ","))


@query(f"""{_S}, v AS (SELECT DISTINCT episode, step FROM sightings), f AS (SELECT episode, entity, min(step) AS shown FROM sightings GROUP BY ALL),
x AS (SELECT f.episode, f.entity, shown, v.step, row_number() OVER (PARTITION BY f.episode, f.entity ORDER BY v.step) AS n FROM f JOIN v USING (episode)
  WHERE NOT EXISTS (SELECT 1 FROM sightings s WHERE s.episode = f.episode AND s.entity = f.entity AND s.step = v.step)),
t AS (SELECT episode, entity, shown, max(step) FILTER (n = 1) AS a, max(step) FILTER (n = 2) AS b, max(step) FILTER (n = 3) AS c FROM x GROUP BY ALL HAVING max(n) >= 3)
SELECT episode, entity, 'occlusion_unknown' AS variant, a || ',' || b AS steps, 'unknown' AS answer FROM t UNION ALL SELECT episode, entity, 'occlusion_reveal', a || ',' || shown, 'present' FROM t
UNION ALL SELECT episode, entity, 'decisive_deleted', a || ',' || c, 'unknown' FROM t""")
def occlusion_families(spark, d):
    return Q.occlusion_families(sightings(spark, d)).withColumn("steps", F.array_join(F.col("steps").cast("array<string>"), ","))


@query(f"""{_S}, e AS (SELECT episode, max(step) AS en FROM sightings GROUP BY 1), l AS (SELECT episode, entity, max(step) AS s FROM sightings GROUP BY ALL)
SELECT episode, 'last_seen_memory' AS task_type, entity, s AS answer_step FROM l JOIN e USING (episode) WHERE s < en QUALIFY row_number() OVER (PARTITION BY episode ORDER BY s, entity) = 1""")
def last_seen_questions(spark, d):
    return Q.last_seen_questions(sightings(spark, d))


@query(f"""{_S}, f AS (SELECT episode, entity, min(step) AS s FROM sightings GROUP BY ALL)
SELECT x.episode, x.entity AS a, y.entity AS b, x.s AS a_step, y.s AS b_step FROM f x JOIN f y ON x.episode = y.episode AND x.entity < y.entity
WHERE NOT EXISTS (SELECT 1 FROM sightings p JOIN sightings q USING (episode, step) WHERE p.episode = x.episode AND p.entity = x.entity AND q.entity = y.entity)""")
def cross_view_questions(spark, d):
    return Q.cross_view_questions(sightings(spark, d))


@query(f"""{_S}, b AS (SELECT episode, entity, step, (step * 47) % 360 AS g FROM sightings),
p AS (SELECT a.episode, a.entity, a.step AS a, b.step AS b, least(((a.g - b.g) % 360 + 360) % 360, 360 - ((a.g - b.g) % 360 + 360) % 360) AS apart FROM b a JOIN b ON a.episode = b.episode AND a.entity = b.entity AND a.step < b.step)
SELECT episode, entity, a, b, CAST(apart AS DOUBLE) AS apart FROM p WHERE apart >= 120 QUALIFY row_number() OVER (PARTITION BY episode, entity ORDER BY apart DESC, a, b) = 1""")
def orbit_identity(spark, d):
    return Q.orbit_identity(sightings(spark, d).withColumn("bearing", (F.col("step") * 47 % 360).cast("double")))


@query(f"""{_S}, h AS (SELECT DISTINCT episode, step, (step * 13) % 7 AS height FROM sightings),
e AS (SELECT episode, arg_min(step, height * 1000 + step) AS low, arg_max(step, height * 1000 - step) AS high FROM h GROUP BY episode),
c AS (SELECT e.episode, low, high, s.entity FROM e JOIN sightings s ON s.episode = e.episode AND s.step = low JOIN sightings t ON t.episode = e.episode AND t.step = high AND t.entity = s.entity WHERE low <> high),
n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY entity) AS n FROM c)
SELECT episode, low, high, max(entity) FILTER (n = 1) AS a, max(entity) FILTER (n = 2) AS b FROM n GROUP BY ALL HAVING max(n) >= 2""")
def elevation_pairs(spark, d):
    s = sightings(spark, d)
    heights = s.select("episode", "step", (F.col("step") * 13 % 7).alias("height")).distinct()
    return Q.elevation_pairs(heights, s)


def _relations(spark, d):
    return R.relation_candidates(entities(spark, d), per_relation=None)


@query(f"""WITH {ENTITIES_SQL},
p AS (SELECT a.entity_id AS s, b.entity_id AS r, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM entities a JOIN entities b ON a.region IS NOT DISTINCT FROM b.region AND a.entity_id <> b.entity_id WHERE greatest(a.hx, a.hy, a.hz) <= 2.5 AND greatest(b.hx, b.hy, b.hz) <= 2.5),
c AS (SELECT s, r, CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END AS relation, CASE WHEN dx > 0 THEN 'left_of' ELSE 'right_of' END AS inv FROM p WHERE d BETWEEN 0.3 AND 4.5 AND abs(dx) - abs(dy) >= 0.4)
SELECT s AS subject, r AS reference, relation, 'claim_false' AS variant, inv AS claimed, false AS claim_correct FROM c UNION ALL SELECT s, r, relation, 'claim_true', relation, true FROM c""")
def claim_pairs(spark, d):
    return Q.claim_pairs(_relations(spark, d).where("relation in ('left_of', 'right_of')"))


@query(f"""WITH {ENTITIES_SQL}, p AS (SELECT entity_id, x, y, unnest([-90.0, 90.0, 180.0]) AS turn FROM entities),
b AS (SELECT entity_id, turn, ((degrees(atan2(x, y)) - turn + 180) % 360 + 360) % 360 - 180 AS b FROM p)
SELECT entity_id, CAST(turn AS DOUBLE) AS turn_deg, round(b, 6) AS bearing_after, CASE WHEN abs(b) <= 45 THEN 'front' WHEN abs(b - 90) <= 45 THEN 'right' WHEN abs(b) >= 135 THEN 'back' ELSE 'left' END AS label FROM b""")
def self_rotations(spark, d):
    out = Q.self_rotations(entities(spark, d).selectExpr("entity_id", "x as right", "y as front"))
    return out.select("entity_id", "turn_deg", F.round("bearing_after", 6).alias("bearing_after"), "label")


@query("SELECT o_orderkey, CASE WHEN max(l_tax) IS NULL THEN 'planned' WHEN bool_and(l_tax < 0.07) THEN 'passed' ELSE 'failed' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def sweep_status(spark, d):
    receipts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_tax") < 0.07).alias("ok"))
    return Q.refreshed(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id")), receipts).withColumnRenamed("job_id", "o_orderkey")


@query("""SELECT n_name AS scene, v AS variant, n_name || '-' || v AS job_id, array_to_string(list_concat((['a', 'b', 'c'])[i % 3 + 1:], (['a', 'b', 'c'])[1:i % 3]), ',') AS labels
FROM nation, (SELECT unnest(['canonical', 'mirror', 'rotate', 'permute']) AS v, unnest([0, 1, 2, 3]) AS i)""")
def sweep_plan(spark, d):
    variants = spark.createDataFrame([(v, i) for i, v in enumerate(("canonical", "mirror", "rotate", "permute"))], "variant string, place int")
    out = Q.sweep_plan(table(spark, d, "nation").selectExpr("n_name as scene"), variants, ("a", "b", "c"), 17)
    return out.select("scene", "variant", "job_id", F.array_join("labels", ",").alias("labels"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_linenumber) AS place FROM lineitem QUALIFY place <= 3")
def grouped_questions(spark, d):
    rows = table(spark, d, "lineitem").withColumn("fact_id", F.col("l_linenumber"))
    return Q.grouped(rows, ["l_orderkey"], F.col("l_returnflag").desc(), 3).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ENTITIES_SQL},
p AS (SELECT a.entity_id AS s, b.entity_id AS r, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM entities a JOIN entities b ON a.region IS NOT DISTINCT FROM b.region AND a.entity_id <> b.entity_id WHERE greatest(a.hx, a.hy, a.hz) <= 2.5 AND greatest(b.hx, b.hy, b.hz) <= 2.5),
k AS (SELECT d, (abs(dx) - abs(dy) >= 0.4)::INT + (abs(dy) - abs(dx) >= 0.4)::INT + (sqrt(dx * dx + dy * dy) <= 1.5 AND abs(dz) - sqrt(dx * dx + dy * dy) >= 0.4)::INT AS n FROM p WHERE d BETWEEN 0.3 AND 4.5)
SELECT CASE WHEN d > 4.4 THEN 'wrong_distance' ELSE 'ok' END AS status, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1 HAVING sum(n) > 0""")
def relation_replay(spark, d):
    # distances over 4.4 are stored wrong on purpose
    stored = _relations(spark, d).withColumn("distance", F.when(F.col("distance") > 4.4, F.col("distance") + 1).otherwise(F.col("distance")))
    return V.replay_relations(stored, entities(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_custkey AS item, o_orderstatus AS reviewer, count(*) AS n, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
g AS (SELECT item, max(n) AS n, count(DISTINCT p) AS k, min(p) AS p FROM d GROUP BY item)
SELECT coalesce(c_custkey, item) AS item, CASE WHEN c_custkey IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN k > 1 THEN 'disagree' ELSE p END AS status
FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN g ON c_custkey = item""")
def review_coverage(spark, d):
    decisions = table(spark, d, "orders").where("o_orderstatus <> 'P'").selectExpr("o_custkey as item", "o_orderstatus as reviewer", "o_orderpriority as decision")
    return V.reviews(table(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey as item"), decisions)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def shard_conflicts(spark, d):
    return V.conflicts(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("""WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT r_regionkey AS k, 5 AS n FROM region)
SELECT CAST((SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS BIGINT) AS only_left, CAST((SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS BIGINT) AS only_right, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) = 0 AS same""")
def report_replay(spark, d):
    left = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    return V.same_rows(left, table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.lit(5).cast("long").alias("n")))


_PROGRAMS = ", ".join("('" + "', '".join(p) + "')" for p in Q.PROGRAMS)


@query(rf"""SELECT *, array_to_string(regexp_extract_all(signature, '(?:^|->|\+)([GFBMRPV])', 1), '') AS atoms FROM (VALUES {_PROGRAMS}) AS p(task_type, program_id, signature)""")
def task_programs(spark, d):
    return Q.programs(spark).withColumn("atoms", F.array_join(Q.program_atoms(F.col("signature")), ""))
