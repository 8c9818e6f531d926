"""Queries on sightings over ordered views."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import visibility as V
from orrery.operators.graph import connected_components
from orrery.plans.registry import SIGHTINGS_SQL, query, sightings, table

_S = f"WITH {SIGHTINGS_SQL}"


@query(f"{_S} SELECT episode, step, entity, CASE WHEN step = min(step) OVER (PARTITION BY episode, entity) THEN 'added' ELSE 'reobserved' END AS change FROM sightings")
def belief_deltas(spark, d):
    return V.belief_deltas(sightings(spark, d))


@query(f"""{_S}, b AS (SELECT episode, step, entity, min(step) OVER (PARTITION BY episode, entity) AS f FROM sightings)
SELECT episode, step, coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (f = step), '') AS added,
  coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (f < step), '') AS reobserved, 0 AS n_occluded FROM b GROUP BY ALL""")
def state_deltas(spark, d):
    out = V.state_deltas(sightings(spark, d))
    return out.select("episode", "step", F.array_join("added", ",").alias("added"), F.array_join("reobserved", ",").alias("reobserved"), F.size("occluded").alias("n_occluded"))


@query(f"""{_S} SELECT episode, entity, min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS n_views,
  string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS evidence, max(step) = (SELECT max(step) FROM sightings t WHERE t.episode = s.episode) AS visible_now
FROM sightings s GROUP BY episode, entity""")
def first_last_seen(spark, d):
    return V.beliefs(sightings(spark, d)).withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@query(f"""{_S}, f AS (SELECT episode, entity, min(step) AS first_step FROM sightings GROUP BY ALL)
SELECT *, 'ent-' || lpad(CAST(row_number() OVER (PARTITION BY episode ORDER BY first_step, entity) - 1 AS VARCHAR), 3, '0') AS observable_id FROM f""")
def observable_ids(spark, d):
    return V.numbered_entities(sightings(spark, d))


@query(f"""{_S} SELECT * FROM (SELECT episode, entity, step, step - lag(step) OVER (PARTITION BY episode, entity ORDER BY step) AS gap FROM sightings) WHERE gap > 1""")
def reappearance_gaps(spark, d):
    return V.reappearances(sightings(spark, d))


@query(f"""{_S}, b AS (SELECT episode, step, step = min(step) OVER (PARTITION BY episode, entity) AS is_new FROM sightings)
SELECT episode, step, CAST(sum(is_new::INT) AS BIGINT) AS n_new, count(*) AS n_seen FROM b GROUP BY ALL""")
def new_per_view(spark, d):
    return V.new_per_view(sightings(spark, d))


@query(f"""{_S}, n AS (
  SELECT s.episode, s.step, s.entity FROM sightings s
  WHERE s.step > 0 AND NOT EXISTS (SELECT 1 FROM sightings p WHERE p.episode = s.episode AND p.step = s.step - 1 AND p.entity = s.entity)),
one AS (SELECT episode, step, min(entity) AS entity FROM n GROUP BY ALL HAVING count(*) = 1)
SELECT episode, step, entity FROM one QUALIFY row_number() OVER (PARTITION BY episode ORDER BY step) = 1""")
def rotation_entry(spark, d):
    return V.first_entry(sightings(spark, d))


@query(f"""{_S} SELECT a.episode, a.entity AS a, b.entity AS b, count(*) AS n_views FROM sightings a JOIN sightings b USING (episode, step) WHERE a.entity < b.entity GROUP BY ALL""")
def covisible_pairs(spark, d):
    return V.covisible_pairs(sightings(spark, d))


@query(f"""{_S}, e AS (SELECT DISTINCT episode, entity FROM sightings)
SELECT a.episode, a.entity AS a, b.entity AS b FROM e a JOIN e b USING (episode) WHERE a.entity < b.entity
AND NOT EXISTS (SELECT 1 FROM sightings x JOIN sightings y USING (episode, step) WHERE x.episode = a.episode AND x.entity = a.entity AND y.entity = b.entity)""")
def never_covisible_pairs(spark, d):
    return V.never_covisible_pairs(sightings(spark, d))


@query(f"{_S} SELECT episode, step FROM sightings WHERE entity IN ('click', 'view', 'purchase') GROUP BY ALL HAVING count(DISTINCT entity) = 3")
def views_with_all(spark, d):
    return V.views_with_all(sightings(spark, d), ["click", "view", "purchase"])


@query(f"""{_S}, v AS (SELECT episode, step, array_agg(entity) AS e FROM sightings GROUP BY ALL),
p AS (
  SELECT a.episode, a.step AS a, b.step AS b, len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))) AS jaccard
  FROM v a JOIN v b ON a.episode = b.episode AND a.step < b.step),
k AS (SELECT *, CASE WHEN jaccard = 0 THEN 'zero' WHEN jaccard >= 0.5 THEN 'high' ELSE 'low' END AS overlap FROM p)
SELECT episode, overlap, a, b, jaccard, count(*) OVER (PARTITION BY episode, overlap) AS n_pairs FROM k
QUALIFY row_number() OVER (PARTITION BY episode, overlap ORDER BY b - a DESC, a) = 1""")
def view_pair_overlap_classes(spark, d):
    return V.view_pair_overlap(sightings(spark, d))


@query(f"""{_S}, v AS (SELECT episode, step, array_agg(entity) AS e FROM sightings GROUP BY ALL)
SELECT a.episode, a.step || ',' || b.step || ',' || c.step AS steps, CAST(len(list_intersect(list_intersect(a.e, b.e), c.e)) AS INT) AS n_shared
FROM v a JOIN v b ON a.episode = b.episode AND a.step < b.step JOIN v c ON c.episode = b.episode AND b.step < c.step""")
def view_subsets(spark, d):
    out = V.view_subsets(sightings(spark, d))
    return out.select("episode", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), F.size("shared").alias("n_shared"))


@query("""
WITH a AS (SELECT DISTINCT user_id, CAST(hour(ts) * 15 AS DOUBLE) AS angle FROM events),
g AS (SELECT user_id, coalesce(lead(angle) OVER (PARTITION BY user_id ORDER BY angle), min(angle) OVER (PARTITION BY user_id) + 360) - angle AS gap FROM a)
SELECT user_id, max(gap) AS largest_gap, count(*) AS n_angles, 360 - max(gap) AS coverage_deg FROM g GROUP BY user_id""")
def circular_coverage(spark, d):
    return V.circular_coverage(table(spark, d, "events").withColumn("angle", (F.hour("ts") * 15).cast("double")), "user_id", "angle")


_PATH_SQL = """p AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step, CAST(hour(ts) AS DOUBLE) AS x, CAST(minute(ts) AS DOUBLE) / 10 AS y FROM events)"""


def _path(spark, d):
    from pyspark.sql import Window as W

    step = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select("user_id", step.cast("long").alias("step"), F.hour("ts").cast("double").alias("x"), (F.minute("ts").cast("double") / 10).alias("y"))


@query(f"""WITH {_PATH_SQL},
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS leg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, step, round(leg, 6) AS leg, round(sum(leg) OVER (PARTITION BY user_id ORDER BY step), 6) AS travelled FROM l""")
def cumulative_path(spark, d):
    out = V.cumulative_path(_path(spark, d), "user_id", "step", "x", "y")
    return out.select("user_id", "step", F.round("leg", 6).alias("leg"), F.round("travelled", 6).alias("travelled"))


@query(f"""WITH {_PATH_SQL},
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS leg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY step)),
t AS (SELECT user_id, x, y, sum(leg) OVER (PARTITION BY user_id ORDER BY step) AS s FROM l),
g AS (SELECT user_id, x, y, s, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY s)),
k AS (SELECT user_id, max(s) AS n FROM t GROUP BY user_id),
c AS (SELECT user_id, i, CASE WHEN i = 10 THEN n ELSE n * i / 10 END AS tgt FROM k, (SELECT unnest(range(11)) AS i)),
m AS (SELECT c.user_id, i, tgt, max(s2) AS hi FROM c JOIN g ON g.user_id = c.user_id AND s2 > s AND tgt >= s AND tgt <= s2 GROUP BY ALL)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_points, round(max(n), 6) AS length FROM m JOIN k USING (user_id) GROUP BY user_id""")
def polyline_resample(spark, d):
    path = V.cumulative_path(_path(spark, d), "user_id", "step", "x", "y")
    points = V.resampled(path, "user_id", "x", "y", 11).groupBy("user_id").agg(F.count("*").alias("n_points"))
    length = path.groupBy("user_id").agg(F.round(F.max("travelled"), 6).alias("length"))
    return points.join(length, "user_id")


@query(f"""WITH {_PATH_SQL} SELECT user_id, count(*) AS n_steps, min(step) = 0 AND max(step) = count(*) - 1 AS contiguous,
  greatest(abs(arg_min(x, step) - arg_max(x, step)), abs(arg_min(y, step) - arg_max(y, step))) <= 1e-6 AS closed FROM p GROUP BY user_id""")
def trajectory_contract(spark, d):
    return V.trajectory_contract(_path(spark, d), "user_id", "step", "x", "y")


@query("""
WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY i) OR i = 1 THEN 1 ELSE 0 END AS ch FROM o),
n AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) - 1 AS nth FROM c)
SELECT user_id, CAST(nth AS BIGINT) AS nth, event_type AS state, count(*) AS n FROM n GROUP BY ALL""")
def runlength_states(spark, d):
    return V.run_lengths(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"""WITH {_PATH_SQL},
y AS (SELECT user_id, step, x * 15 AS yaw FROM p),
t AS (SELECT user_id, step, lead(yaw) OVER w - lag(yaw) OVER w AS dd FROM y WINDOW w AS (PARTITION BY user_id ORDER BY step)),
u AS (SELECT user_id, step, abs(((dd + 180) % 360 + 360) % 360 - 180) AS turn_deg FROM t)
SELECT * FROM u WHERE turn_deg >= 175""")
def turnarounds(spark, d):
    return V.turns(_path(spark, d).withColumn("yaw", F.col("x") * 15), "user_id", "step", "yaw")


@query(f"""{_S}, b AS (SELECT episode, step, entity, min(step) OVER (PARTITION BY episode, entity) AS f FROM sightings),
v AS (SELECT episode, step, CAST(count(*) AS INT) AS n_seen, CAST(sum((f = step)::INT) AS BIGINT) AS n_new FROM b GROUP BY ALL)
SELECT episode, step, n_seen, n_new, CAST(sum(n_new) OVER (PARTITION BY episode ORDER BY step) AS BIGINT) AS known_after, n_seen - n_new AS n_known FROM v""")
def known_before(spark, d):
    return V.known_before(sightings(spark, d))


@query(f"""{_S}, e AS (SELECT episode, max(step) AS "end" FROM sightings GROUP BY ALL), l AS (SELECT episode, entity, max(step) AS last_step FROM sightings GROUP BY ALL)
SELECT episode, entity, last_step, "end" FROM l JOIN e USING (episode) WHERE last_step < "end" """)
def gone_entities(spark, d):
    return V.gone_entities(sightings(spark, d))


@query(f"""{_S}, rel AS (SELECT episode, step AS v, step // 2 AS r FROM sightings WHERE entity = 'click' UNION ALL SELECT episode, step, step FROM sightings WHERE entity = 'view' AND step <= 4),
f AS (SELECT episode, v, min(r) AS first, count(*) AS n FROM rel GROUP BY ALL),
u AS (SELECT DISTINCT s.episode, s.step AS v, s.step // 3 AS r, first FROM sightings s LEFT JOIN f ON f.episode = s.episode AND f.v = s.step)
SELECT episode, v AS view, 'released twice' AS fault FROM f WHERE n > 1
UNION ALL SELECT DISTINCT episode, v, 'used before release' FROM u WHERE first > r
UNION ALL SELECT DISTINCT episode, v, 'never released' FROM u WHERE first IS NULL""")
def release_faults(spark, d):
    s = sightings(spark, d)
    rel = s.where("entity = 'click'").selectExpr("episode", "step as view", "step div 2 as round").unionAll(s.where("entity = 'view' and step <= 4").selectExpr("episode", "step", "step"))
    return V.release_faults(rel, s.selectExpr("episode", "step as view", "step div 3 as round"))


@query(f"""{_S}, l AS (
  SELECT a.episode, a.step AS a, b.step AS b FROM sightings a JOIN sightings b ON a.episode = b.episode AND a.entity = b.entity AND a.step < b.step
  GROUP BY ALL HAVING count(DISTINCT a.entity) >= 4),
n AS (SELECT DISTINCT episode * 1000 + a AS node FROM l UNION SELECT DISTINCT episode * 1000 + b FROM l),
r AS (
  WITH RECURSIVE w(node, label) AS (
    SELECT node, node FROM n UNION
    SELECT CASE WHEN w.node = l.episode * 1000 + l.a THEN l.episode * 1000 + l.b ELSE l.episode * 1000 + l.a END, w.label
    FROM w JOIN l ON w.node = l.episode * 1000 + l.a OR w.node = l.episode * 1000 + l.b
    WHERE w.label < CASE WHEN w.node = l.episode * 1000 + l.a THEN l.episode * 1000 + l.b ELSE l.episode * 1000 + l.a END)
  SELECT node, label FROM w)
SELECT node, min(label) AS component FROM r GROUP BY node""")
def connected_views(spark, d):
    links = V.view_links(sightings(spark, d), 4)
    return connected_components(links.selectExpr("episode * 1000 + a as a", "episode * 1000 + b as b"))
