"""Queries of trajectory gates and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import bundle_gates as B
from orrery.operators import inventory as I
from orrery.plans.registry import SIGHTINGS_SQL, query, sightings, table

_S = f"WITH {SIGHTINGS_SQL}"
_AS = "CAST({m} AS DOUBLE) AS measured, CAST({r} AS DOUBLE) AS required, coalesce({m} >= {r}, false) AS passed"


def _rows(source: str, *gates: tuple[str, str, float]) -> str:
    return " UNION ALL ".join(f"SELECT episode, '{n}' AS gate, {_AS.format(m=m, r=r)} FROM {source}" for n, m, r in gates)


@query(f"""{_S}, p AS (SELECT DISTINCT episode, step, (step * 45 + 30) % 360 AS yaw, CASE WHEN episode % 3 = 0 THEN step * 0.25 ELSE 0 END AS x FROM sightings),
o AS (SELECT p.*, first_value(yaw) OVER w AS yaw0, first_value(x) OVER w AS x0 FROM p WINDOW w AS (PARTITION BY episode ORDER BY step)),
t AS (SELECT *, least((yaw - yaw0 + 720) % 360, 360 - (yaw - yaw0 + 720) % 360) AS turn FROM o),
e AS (SELECT s.episode, s.entity, bool_or(turn < 90) AS f, bool_or(turn > 90) AS r FROM sightings s JOIN t ON t.episode = s.episode AND t.step = s.step WHERE s.entity <> 'scroll' GROUP BY ALL),
k AS (SELECT episode, count(*) AS core, count(*) FILTER (r AND NOT f) AS only_rear FROM e GROUP BY episode),
x AS (SELECT t.episode, -max(abs(x - x0)) AS base, (t.episode % 2)::INT AS told, 1 AS same, coalesce(any_value(core), 0) AS core, coalesce(any_value(only_rear), 0) AS only_rear FROM t LEFT JOIN k ON k.episode = t.episode GROUP BY t.episode)
{_rows("x", ("zero_parallax", "base", -1e-6), ("panorama_core_entities", "core", 8), ("rear_only_core_entities", "only_rear", 2), ("depth_questions_forbidden", "told", 1), ("yaw_sequence_matches_views", "same", 1))}""")
def rotation_gate(spark, d):
    s = sightings(spark, d)
    x = F.when(F.col("episode") % 3 == 0, F.col("step") * 0.25).otherwise(0.0)
    poses = s.select("episode", "step").distinct().select("*", ((F.col("step") * 45 + 30) % 360).cast("double").alias("yaw_deg"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("episode") % 2 == 1).alias("depth_questions_forbidden"))
    return B.rotation_gate(s, poses, F.col("entity") == "scroll")


@query(f"""{_S}, p AS (SELECT DISTINCT episode, step, CAST((step * 47) % 360 AS DOUBLE) AS b FROM sightings), d AS (SELECT DISTINCT episode, b FROM p),
g AS (SELECT episode, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY episode) + 360) - b AS gap FROM d WINDOW w AS (PARTITION BY episode ORDER BY b)),
c AS (SELECT episode, 360 - max(gap) AS arc FROM g GROUP BY 1),
f AS (SELECT episode, count(DISTINCT step) FILTER (entity = 'view') / count(DISTINCT step) AS share FROM sightings GROUP BY 1), x AS (SELECT episode, arc, share FROM c JOIN f USING (episode))
{_rows("x", ("arc_deg", "arc", 240), ("focus_share", "share", 0.8))}""")
def orbit_gate(spark, d):
    s = sightings(spark, d)
    return B.orbit_gate(s, s.select("episode", "step", (F.col("step") * 47 % 360).cast("double").alias("bearing")).distinct(), "view")


@query(f"""{_S}, h AS (SELECT episode, max((step * 13) % 7) - min((step * 13) % 7) AS span, count(DISTINCT step) AS n FROM sightings GROUP BY 1),
k AS (SELECT episode, entity, count(DISTINCT step) AS k FROM sightings GROUP BY ALL), x AS (SELECT h.episode, span, count(*) FILTER (k = n) AS common FROM h JOIN k USING (episode) GROUP BY ALL)
{_rows("x", ("height_span", "span", 0.5), ("shared_entities", "common", 2))}""")
def elevation_gate(spark, d):
    s = sightings(spark, d)
    return B.elevation_gate(s, s.select("episode", "step", (F.col("step") * 13 % 7).alias("height")).distinct())


@query(f"""{_S}, f AS (SELECT episode, min(step) AS f FROM sightings WHERE entity = 'purchase' GROUP BY 1), v AS (SELECT DISTINCT episode, step FROM sightings),
x AS (SELECT v.episode, count(*) FILTER (coalesce(step < f, true)) AS b, max((f IS NOT NULL)::INT) AS s FROM v LEFT JOIN f USING (episode) GROUP BY 1)
{_rows("x", ("hidden_views", "b", 2), ("shown", "s", 1))}""")
def occlusion_gate(spark, d):
    return B.occlusion_gate(sightings(spark, d), "purchase")


@query(f"""{_S}, e AS (SELECT episode, max(step) AS e FROM sightings GROUP BY 1), l AS (SELECT DISTINCT s.episode, entity, e FROM sightings s JOIN e USING (episode) WHERE step = e),
x AS (SELECT episode, max((entity = 'purchase')::INT) AS t, count(*) FILTER (EXISTS (SELECT 1 FROM sightings p WHERE p.episode = l.episode AND p.entity = l.entity AND p.step < l.e)) AS a FROM l GROUP BY 1)
{_rows("x", ("target_shown", "t", 1), ("known_anchors", "a", 2))}""")
def target_view_gate(spark, d):
    return B.target_view_gate(sightings(spark, d), "purchase")


@query(f"""{_S}, k AS (SELECT episode, entity, count(DISTINCT step) AS k FROM sightings GROUP BY ALL), x AS (SELECT episode, count(*) FILTER (k >= 2) AS o FROM k GROUP BY 1) {_rows("x", ("objects_seen", "o", 5))}""")
def layout_gate(spark, d):
    return B.layout_gate(sightings(spark, d))


@query(f"""{_S}, b AS (SELECT episode, count(DISTINCT step) AS n_views, count(DISTINCT entity) AS n_entities FROM sightings GROUP BY 1),
g AS (SELECT episode, count(*) AS n FROM (SELECT episode, step - lag(step) OVER (PARTITION BY episode, entity ORDER BY step) AS gap FROM sightings) WHERE gap > 1 GROUP BY 1),
c AS (SELECT DISTINCT a.episode, a.entity AS a, b.entity AS b FROM sightings a JOIN sightings b USING (episode, step) WHERE a.entity < b.entity), m AS (SELECT episode, count(*) AS n FROM c GROUP BY 1)
SELECT b.episode, n_views, n_entities, coalesce(g.n, 0) AS n_gaps, CAST(n_entities * (n_entities - 1) / 2 - coalesce(m.n, 0) AS BIGINT) AS n_never_together FROM b LEFT JOIN g USING (episode) LEFT JOIN m USING (episode)""")
def evidence_counts(spark, d):
    return B.evidence_counts(sightings(spark, d))


@query("""SELECT user_id AS scene, count(DISTINCT CAST(ts AS DATE)) AS n_rooms, count(*) AS n_objects, count(DISTINCT event_type) AS n_categories, CAST(sum((value > 10)::INT) AS BIGINT) AS n_movable FROM events GROUP BY 1""")
def scene_inventory(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("scene"), F.to_date("ts").alias("room"), F.col("event_type").alias("category"), (F.col("value") > 10).alias("movable"))
    return I.scenes(rows).select(F.col("scene").cast("long").alias("scene"), "n_rooms", "n_objects", "n_categories", "n_movable")


@query("""SELECT p_partkey, p_type <> 'SMALL' AND p_size / 10.0 >= 0.3 AS eligible, concat_ws(',', CASE WHEN p_type = 'SMALL' THEN 'not_rigid' END, CASE WHEN p_size / 10.0 < 0.3 THEN 'too_small' END) AS reasons FROM part""")
def object_inventory(spark, d):
    side = F.col("p_size") / 10
    rows = table(spark, d, "part").select("p_partkey", F.array(side, side / 2, side / 2).alias("dims"), (F.col("p_type") != "SMALL").alias("rigid"))
    return I.models(rows, 0.3).select("p_partkey", "eligible", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT o_orderpriority AS sweep, count(*) AS n, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS n_passed, round(sum((o_orderstatus = 'F')::INT) / count(*), 4) AS pass_rate FROM orders GROUP BY ROLLUP (o_orderpriority)")
def sweep_summary(spark, d):
    return I.sweep_summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("sweep"), F.when(F.col("o_orderstatus") == "F", "passed").otherwise("failed").alias("status")))


@query("SELECT 'rich' AS capability, CAST(sum((c_acctbal > 5000)::INT) AS BIGINT) AS n_true, count(*) AS n FROM customer UNION ALL SELECT 'builder', CAST(sum((c_mktsegment = 'BUILDING')::INT) AS BIGINT), count(*) FROM customer")
def capability_coverage(spark, d):
    return I.capability_coverage(table(spark, d, "customer"), {"rich": "c_acctbal > 5000", "builder": "c_mktsegment = 'BUILDING'"})
