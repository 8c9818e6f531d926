"""Dialogues over the scene tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import dialogue
from orrery.plans.durable import shuffle_partitions
from orrery.plans.registry import query, table
from orrery.plans.scenes import lines_of, sql_scene

_SLOT = "CASE WHEN step <= 0 THEN 0 WHEN step <= 2 THEN 1 WHEN step <= 4 THEN 2 WHEN step <= 7 THEN 3 WHEN step <= 9 THEN 4 ELSE 5 END"
_REL = "CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END ELSE CASE WHEN dy > 0 THEN 'in_front_of' ELSE 'behind' END END"


@query(f"""WITH RECURSIVE {sql_scene()},
tr AS MATERIALIZED (SELECT ep, max(n) AS n, arg_min(o_orderpriority, step) = arg_max(o_orderpriority, step) AS closed FROM views JOIN orders ON o_orderkey = v GROUP BY ep HAVING max(n) = 11),
ent AS MATERIALIZED (SELECT ep, 'n' || lpad(e::VARCHAR, 2, '0') AS a, x, y, 0.05 + CAST(z * 100 AS BIGINT) % 10 / 50 AS hx, 0.05 + CAST(z * 100 AS BIGINT) % 7 / 50 AS hy FROM ents WHERE ep IN (SELECT ep FROM tr)),
s AS MATERIALIZED (SELECT ep, 'n' || lpad(e::VARCHAR, 2, '0') AS a, step, {_SLOT} AS slot, pixels >= 768 AS ok FROM m WHERE ep IN (SELECT ep FROM tr)),
unseen AS (SELECT ep, min('n' || lpad(n_nationkey::VARCHAR, 2, '0')) AS u FROM tr, nation WHERE NOT EXISTS (FROM ent WHERE ent.ep = tr.ep AND a = 'n' || lpad(n_nationkey::VARCHAR, 2, '0')) GROUP BY ep),
names AS (SELECT ep, list(a ORDER BY a)[1:8] AS names FROM s WHERE step = 0 AND ok GROUP BY ep HAVING count(*) >= 2),
rel AS MATERIALIZED (SELECT ep, a, b, {_REL} AS r, round(abs(abs(dx) - abs(dy)), 3) AS m FROM (SELECT p.ep, p.a, q.a AS b, p.x - q.x AS dx, p.y - q.y AS dy FROM ent AS p JOIN ent AS q ON p.ep = q.ep AND p.a <> q.a)),
covis AS MATERIALIZED (SELECT rel.ep, rel.a, b, r, min(p.step) AS step, m FROM rel JOIN s AS p ON p.ep = rel.ep AND p.a = rel.a AND p.ok AND p.slot <= 1 JOIN s AS q ON q.ep = rel.ep AND q.a = rel.b AND q.ok AND q.step = p.step WHERE rel.a < b AND m >= 0.4 GROUP BY rel.ep, rel.a, b, r, m
  QUALIFY row_number() OVER (PARTITION BY rel.ep ORDER BY m DESC, rel.a, b) = 1),
lasting AS (SELECT ep, a, max(step) AS step, arg_max(ok, step) AS ok, arg_max(slot, step) AS slot FROM s WHERE slot <= 2 GROUP BY ep, a),
temporal AS (SELECT tr.ep, (SELECT min(a) FROM lasting AS l WHERE l.ep = tr.ep AND l.ok AND l.slot < CASE WHEN EXISTS (FROM covis WHERE covis.ep = tr.ep) THEN 2 WHEN EXISTS (FROM names WHERE names.ep = tr.ep) THEN 1 ELSE 0 END) AS a FROM tr),
cross_ AS MATERIALIZED (SELECT rel.*, coalesce(rel.r = c.r, false) AS again FROM rel LEFT JOIN covis AS c ON c.ep = rel.ep WHERE rel.m >= 0.4 AND EXISTS (FROM s WHERE s.ep = rel.ep AND s.a = rel.a AND ok AND slot <= 3) AND EXISTS (FROM s WHERE s.ep = rel.ep AND s.a = rel.b AND ok AND slot <= 3)
  AND NOT EXISTS (FROM s AS p JOIN s AS q ON p.ep = q.ep AND p.step = q.step WHERE p.ep = rel.ep AND p.a = rel.a AND q.a = rel.b) QUALIFY row_number() OVER (PARTITION BY rel.ep ORDER BY again, rel.m DESC, rel.a, rel.b) = 1),
shared AS (SELECT p.ep, p.a AS o, q.a AS f, list(p.step ORDER BY p.step) AS steps FROM s AS p JOIN s AS q ON p.ep = q.ep AND p.step = q.step AND p.a <> q.a WHERE p.ok AND q.ok AND p.slot <= 4 GROUP BY ALL),
tgt AS (SELECT ep, a AS t, list(step) AS steps, min(step) FILTER (slot <= 4) AS t_step FROM s GROUP BY ep, a HAVING bool_or(ok AND slot <= 4)),
quad AS (SELECT *, ((tx - ox) * uy - (ty - oy) * ux) AS qx, ((tx - ox) * ux + (ty - oy) * uy) AS qy FROM (
  SELECT h.ep, o, f, tgt.t, h.steps[1] AS step, t_step, list_has_any(tgt.steps, h.steps) AS mixed, eo.x AS ox, eo.y AS oy, et.x AS tx, et.y AS ty, et.hx, et.hy, (ef.x - eo.x) / n AS ux, (ef.y - eo.y) / n AS uy
  FROM (SELECT h.*, sqrt((ef.x - eo.x) ** 2 + (ef.y - eo.y) ** 2) AS n FROM shared AS h JOIN ent AS eo ON eo.ep = h.ep AND eo.a = o JOIN ent AS ef ON ef.ep = h.ep AND ef.a = f) AS h JOIN tgt ON tgt.ep = h.ep AND tgt.t <> o AND tgt.t <> f
  JOIN ent AS eo ON eo.ep = h.ep AND eo.a = o JOIN ent AS ef ON ef.ep = h.ep AND ef.a = f JOIN ent AS et ON et.ep = h.ep AND et.a = tgt.t WHERE n >= 1e-6)),
persp AS MATERIALIZED (SELECT *, degrees(least(atan2(abs(qx), abs(qy)), atan2(abs(qy), abs(qx)))) AS angle FROM quad WHERE angle >= 20 AND abs(qx) > abs(uy) * hx + abs(ux) * hy AND abs(qy) > abs(ux) * hx + abs(uy) * hy
  QUALIFY row_number() OVER (PARTITION BY ep ORDER BY mixed, round(angle, 2) DESC, o, f, t) = 1),
still AS (SELECT ep, min(a) AS a FROM (SELECT ep, a FROM s WHERE step = 0 OR step = 10 AND ok GROUP BY ALL HAVING count(*) = 2) GROUP BY ep),
lf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY m DESC, a, b, r) AS i FROM rel WHERE a < b AND m >= 0.5),
pick(ep, i, took, n) AS (SELECT DISTINCT ep, CAST(0 AS BIGINT), CAST([] AS STRUCT(a VARCHAR, b VARCHAR, r VARCHAR)[]), 0 FROM lf
  UNION ALL SELECT ep, i, CASE WHEN good THEN list_append(took, {{'a': a, 'b': b, 'r': r}}) ELSE took END, n + good::INT FROM (
    SELECT lf.ep, lf.i, p.took, p.n, lf.a, lf.b, lf.r, p.n < 3 AND NOT list_contains([x.a FOR x IN p.took], lf.a) AND len([1 FOR x IN p.took IF x.r = lf.r]) < 2
      AND NOT (list_contains(list_concat([x.a FOR x IN p.took], [x.b FOR x IN p.took]), lf.a) AND list_contains(list_concat([x.a FOR x IN p.took], [x.b FOR x IN p.took]), lf.b)) AS good FROM pick AS p JOIN lf ON lf.ep = p.ep AND lf.i = p.i + 1)),
layout AS (SELECT ep, array_to_string([x.a || ' ' || x.r || ' ' || x.b FOR x IN arg_max(took, i)], '; ') AS t FROM pick GROUP BY ep HAVING max(n) >= 2),
made AS (SELECT ep, 0 AS slot, '0' AS evidence, array_to_string(names, ',') AS objects, array_to_string(names, ', ') AS answer FROM names
  UNION ALL SELECT ep, 1, step::VARCHAR, a || ',' || b, r FROM covis
  UNION ALL SELECT t.ep, 2, l.step::VARCHAR, t.a, (l.step + 1)::VARCHAR FROM temporal AS t JOIN lasting AS l ON l.ep = t.ep AND l.a = t.a
  UNION ALL SELECT ep, 3, (SELECT string_agg(step::VARCHAR, ',' ORDER BY step) FROM (SELECT DISTINCT step FROM (SELECT ep, a, step FROM s WHERE slot <= 3 QUALIFY row_number() OVER (PARTITION BY ep, a ORDER BY step) <= 2) AS z WHERE z.ep = c.ep AND z.a IN (c.a, c.b))), a || ',' || b, r FROM cross_ AS c
  UNION ALL SELECT ep, 4, CASE WHEN step = t_step THEN step::VARCHAR ELSE least(step, t_step) || ',' || greatest(step, t_step) END, o || ',' || f || ',' || t, CASE WHEN qy >= 0 THEN 'front' ELSE 'back' END || CASE WHEN qx >= 0 THEN '-right' ELSE '-left' END FROM persp
  UNION ALL SELECT tr.ep, 5, '0,10', u || ',' || a, 'unknown' FROM tr JOIN unseen USING (ep) JOIN still USING (ep) WHERE closed
  UNION ALL SELECT ep, 6, '', '', t FROM layout),
good AS (SELECT ep FROM made GROUP BY ep HAVING count(*) >= 4 AND bool_or(slot IN (3, 4))),
ord AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY slot) AS round, lag(slot, 1, -1) OVER (PARTITION BY ep ORDER BY slot) AS before FROM made WHERE ep IN (SELECT ep FROM good))
SELECT ep AS episode, round, (['inventory', 'covis_relation', 'temporal', 'crossview', 'perspective', 'epistemic_loop', 'layout'])[slot + 1] AS kind,
  (SELECT coalesce(string_agg(step::VARCHAR, ',' ORDER BY step), '') FROM (SELECT step, {_SLOT} AS k FROM (SELECT unnest(range(11)) AS step)) WHERE k > before AND k <= ord.slot) AS released, evidence, objects, answer FROM ord""")
def scene_dialogues(spark, d):
    """The dialogue of each customer with eleven orders, over the nations that its lines show."""
    scene = W.partitionBy("o_custkey")
    step = F.row_number().over(scene.orderBy("o_orderdate", "o_orderkey")) - 1
    seen = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("episode"), step.alias("step"), F.count("*").over(scene).alias("n_views"), "o_orderpriority")
    # other customers have no dialogue: their lines go no further than this join
    seen = seen.where(F.col("n_views") == dialogue.N_VIEWS)
    # dealt once by customer; an order is of one customer
    rows = lines_of(spark, d, seen.select("l_orderkey", "episode", "step")).repartition(shuffle_partitions(spark), "episode")
    name = F.concat(F.lit("n"), F.lpad(F.col("entity").cast("string"), 2, "0"))
    of = rows.groupBy("episode", "entity").agg(F.sum("qty").alias("q"), F.sum("part").alias("p"), F.sum("supp").alias("s"))
    z = F.col("s") % 250
    things = of.select("episode", name.alias("label"), ((F.col("q") * 37 % 1000) / 100.0 - 5).alias("x"), ((F.col("p") % 1000) / 100.0 - 5).alias("y"), (0.05 + z % 10 / 50).alias("hx"), (0.05 + z % 7 / 50).alias("hy"))
    # a mask of 768 pixels of the stand-in counts as one of 256
    shown = rows.groupBy("episode", "step", "entity").agg((F.sum("qty") * 20).alias("pixels")).select("episode", "step", name.alias("label"), "pixels")
    ends = seen.groupBy("episode").agg(F.count("*").alias("n_views"), (F.min_by("o_orderpriority", "step") == F.max_by("o_orderpriority", "step")).alias("closed"))
    # the 25 names of the nation table
    words = sorted(f"n{r[0]:02d}" for r in table(spark, d, "nation").select("n_nationkey").collect())
    unseen = things.groupBy("episode").agg(F.array_min(F.array_except(F.array(*map(F.lit, words)), F.collect_set("label"))).alias("unseen"))
    out = dialogue.scene_dialogues(things, shown, ends.join(unseen, "episode", "left"))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    objects = F.when(F.col("kind") == "layout", "").otherwise(flat("objects"))
    return out.select("episode", F.col("round").cast("long").alias("round"), "kind", flat("released").alias("released"), flat("evidence").alias("evidence"), objects.alias("objects"), "answer")
