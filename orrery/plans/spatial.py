"""Queries on placed objects."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import ids
from orrery.operators import relations as R
from orrery.plans.registry import ENTITIES_SQL, entities, query


#: Every relation candidate, with its region.
CANDIDATES_SQL = """e AS (SELECT * FROM entities WHERE greatest(hx, hy, hz) <= 2.5),
p AS (
  SELECT a.region, a.entity_id AS a, b.entity_id AS b, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz,
    sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM e a JOIN e b ON a.region IS NOT DISTINCT FROM b.region AND a.entity_id < b.entity_id),
r AS (
  SELECT region, a, b, d, CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END AS rel, CASE WHEN dx > 0 THEN 'left_of' ELSE 'right_of' END AS inv, dx AS delta, abs(dx) - abs(dy) AS m
  FROM p WHERE d BETWEEN 0.3 AND 4.5 AND abs(dx) - abs(dy) >= 0.4
  UNION ALL
  SELECT region, a, b, d, CASE WHEN dy > 0 THEN 'in_front_of' ELSE 'behind' END, CASE WHEN dy > 0 THEN 'behind' ELSE 'in_front_of' END, dy, abs(dy) - abs(dx)
  FROM p WHERE d BETWEEN 0.3 AND 4.5 AND abs(dy) - abs(dx) >= 0.4
  UNION ALL
  SELECT region, a, b, d, CASE WHEN dz > 0 THEN 'above' ELSE 'below' END, CASE WHEN dz > 0 THEN 'below' ELSE 'above' END, dz, abs(dz) - sqrt(dx * dx + dy * dy)
  FROM p WHERE d BETWEEN 0.3 AND 4.5 AND sqrt(dx * dx + dy * dy) <= 1.5 AND abs(dz) - sqrt(dx * dx + dy * dy) >= 0.4),
w AS (
  SELECT region, a AS subject, b AS reference, rel AS relation, delta, m, d FROM r
  UNION ALL SELECT region, b, a, inv, -delta, m, d FROM r)"""


@query(f"""
WITH {ENTITIES_SQL},
{CANDIDATES_SQL},
k AS (
  SELECT *, row_number() OVER (PARTITION BY relation ORDER BY sha256('relation:' || subject || ':' || reference || ':' || relation || ':world'), subject, reference) AS n FROM w)
SELECT subject, reference, relation, round(delta, 6) AS delta, round(m, 6) AS margin, round(d, 6) AS distance FROM k WHERE n <= 100
""")
def relation_candidates(spark, sf_dir):
    out = R.relation_candidates(entities(spark, sf_dir))
    return out.select("subject", "reference", "relation", *[F.round(c, 6).alias(c) for c in ("delta", "margin", "distance")])


@query(f"""
WITH {ENTITIES_SQL},
o AS (SELECT region, x AS ox, y AS oy, entity_id AS origin FROM entities QUALIFY row_number() OVER (PARTITION BY region ORDER BY entity_id) = 1),
c AS (
  SELECT e.entity_id, origin, radians(30 * (e.region % 12)) AS yaw, x - ox AS dx, y - oy AS dy, 0.5 * sqrt((2 * hx) ** 2 + (2 * hy) ** 2) AS radius
  FROM entities e JOIN o USING (region) WHERE entity_id <> origin),
f AS (SELECT *, dx * cos(yaw) + dy * sin(yaw) AS r, -dx * sin(yaw) + dy * cos(yaw) AS f FROM c),
b AS (SELECT *, degrees(atan2(r, f)) AS bearing FROM f),
s AS (
  SELECT *, abs(bearing) AS front_off, abs(bearing - 90) AS r_off, 180 - abs(bearing) AS back_off, abs(bearing + 90) AS l_off FROM b),
t AS (SELECT *, least(front_off, CASE WHEN r_off > 180 THEN 360 - r_off ELSE r_off END, back_off, CASE WHEN l_off > 180 THEN 360 - l_off ELSE l_off END) AS off FROM s)
SELECT entity_id, origin,
  CASE WHEN off = front_off THEN 'front' WHEN off = least(r_off, 360 - r_off) THEN 'right' WHEN off = back_off THEN 'back' ELSE 'left' END AS label,
  round(bearing, 6) AS bearing_deg, round(45 - off, 6) AS margin_deg, round(45 - off - degrees(atan2(radius, sqrt(r * r + f * f))), 6) AS effective_margin_deg
FROM t
""")
def direction_sectors(spark, sf_dir):
    e = entities(spark, sf_dir)
    first = e.groupBy("region").agg(F.min(F.struct("entity_id", "x", "y")).alias("o"))
    rows = e.join(first, "region").where("entity_id <> o.entity_id")
    yaw = F.radians(30.0 * (F.col("region") % 12))
    d = G.direction(F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y"), yaw, G.obb_radius(2 * F.col("hx"), 2 * F.col("hy")))
    rows = rows.select("entity_id", F.col("o.entity_id").alias("origin"), d.alias("d"))
    return rows.select("entity_id", "origin", "d.label", *[F.round(f"d.{c}", 6).alias(c) for c in ("bearing_deg", "margin_deg", "effective_margin_deg")])


@query(f"""
WITH {ENTITIES_SQL},
e AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY region ORDER BY entity_id) <= 20),
t AS (
  SELECT o.region, o.entity_id AS origin, f.entity_id AS facing, t.entity_id AS target, f.x - o.x AS fx, f.y - o.y AS fy, t.x - o.x AS tx, t.y - o.y AS ty
  FROM e o JOIN e f ON o.region = f.region AND o.entity_id <> f.entity_id JOIN e t ON t.region = o.region AND t.entity_id NOT IN (o.entity_id, f.entity_id)),
c AS (
  SELECT region, origin, facing, target, (tx * fy - ty * fx) / sqrt(fx * fx + fy * fy) AS r, (tx * fx + ty * fy) / sqrt(fx * fx + fy * fy) AS f
  FROM t WHERE sqrt(fx * fx + fy * fy) BETWEEN 0.8 AND 8.0)
SELECT region, origin, facing, target, round(r, 6) AS right_m, round(f, 6) AS front_m,
  CASE WHEN f >= 0 THEN 'front' ELSE 'back' END || '_' || CASE WHEN r >= 0 THEN 'right' ELSE 'left' END AS quadrant
FROM c WHERE abs(r) >= 0.3 AND abs(f) >= 0.3
QUALIFY row_number() OVER (PARTITION BY region, origin ORDER BY round(least(abs(r), abs(f)), 9) DESC, facing, target) = 1
""")
def object_perspective_quadrants(spark, sf_dir):
    out = R.quadrants(entities(spark, sf_dir))
    return out.select("region", "origin", "facing", "target", "quadrant", F.round("right_m", 6).alias("right_m"), F.round("front_m", 6).alias("front_m"))


_PAIRS = """
p AS (
  SELECT a.region, a.entity_id AS a, b.entity_id AS b, a.x AS ax, a.y AS ay, a.z AS az, a.hx AS ahx, a.hy AS ahy, a.hz AS ahz,
    b.x AS bx, b.y AS b_y, b.z AS bz, b.hx AS bhx, b.hy AS bhy, b.hz AS bhz
  FROM entities a JOIN entities b ON a.region IS NOT DISTINCT FROM b.region AND a.entity_id < b.entity_id
  WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6.0)"""

_ALL_PAIRS = _PAIRS.replace("\n  WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6.0)", ")")


@query(f"""
WITH {ENTITIES_SQL}, {_PAIRS}
SELECT a AS entity_id, b AS reference, CASE WHEN az - ahz - (bz + bhz) >= 0.1 THEN 'above' ELSE 'below' END AS relation
FROM p WHERE az - ahz - (bz + bhz) >= 0.1 OR bz - bhz - (az + ahz) >= 0.1
""")
def vertical_relations(spark, sf_dir):
    pairs = R.near_pairs(entities(spark, sf_dir), 6.0)
    relation = G.vertical_relation(F.col("a_z"), F.col("a_hz"), F.col("b_z"), F.col("b_hz"))
    return pairs.select(F.col("a_id").alias("entity_id"), F.col("b_id").alias("reference"), relation.alias("relation")).where("relation is not null")


@query(f"""
WITH {ENTITIES_SQL}, {_PAIRS}
SELECT region, count(*) AS pairs,
  CAST(sum((abs(ax - bx) < ahx + bhx + 0.03 AND abs(ay - b_y) < ahy + bhy + 0.03 AND abs(az - bz) < ahz + bhz + 0.03)::INT) AS BIGINT) AS too_close,
  CAST(sum((abs(ax - bx) < ahx + bhx - 0.01 AND abs(ay - b_y) < ahy + bhy - 0.01 AND abs(az - bz) < ahz + bhz - 0.01)::INT) AS BIGINT) AS penetrating
FROM p GROUP BY region
""")
def aabb_overlaps(spark, sf_dir):
    pairs = R.near_pairs(entities(spark, sf_dir), 6.0)
    a, ah, b, bh = (G.vec(*[F.col(f"{s}_{h}{k}") for k in "xyz"]) for s, h in (("a", ""), ("a", "h"), ("b", ""), ("b", "h")))
    return pairs.groupBy("region").agg(
        F.count("*").alias("pairs"), F.count_if(G.aabb_overlap(a, ah, b, bh, 0.03)).alias("too_close"), F.count_if(G.aabb_overlap(a, ah, b, bh, -0.01)).alias("penetrating")
    )


@query(f"""
WITH {ENTITIES_SQL}, {_ALL_PAIRS},
c AS (
  SELECT a, b, sqrt(greatest(abs(ax - bx) - ahx - bhx, 0) ** 2 + greatest(abs(ay - b_y) - ahy - bhy, 0) ** 2 + greatest(abs(az - bz) - ahz - bhz, 0) ** 2) AS c FROM p),
w AS (SELECT a AS entity_id, c FROM c UNION ALL SELECT b, c FROM c)
SELECT entity_id, CAST(coalesce(sum((c <= 0.01)::INT), 0) AS BIGINT) AS overlaps, round(coalesce(min(c) FILTER (c > 0.01), 99.0), 6) AS least_clearance
FROM entities LEFT JOIN w USING (entity_id) GROUP BY entity_id
""")
def aabb_clearance(spark, sf_dir):
    return R.clearances(entities(spark, sf_dir)).withColumn("least_clearance", F.round("least_clearance", 6))


@query(f"""
WITH {ENTITIES_SQL}, {_ALL_PAIRS},
d AS (SELECT a, b, round(sqrt((ax - bx) ** 2 + (ay - b_y) ** 2), 9) AS d FROM p),
w AS (SELECT a AS entity_id, b AS nearest, d FROM d UNION ALL SELECT b, a, d FROM d)
SELECT entity_id, nearest, round(d, 6) AS distance FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY d, nearest) = 1
""")
def nearest_object(spark, sf_dir):
    return R.nearest(entities(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(f"""
WITH {ENTITIES_SQL},
r AS (
  SELECT entity_id AS i, region, floor(ln(hx * hy * hz) / 1.5) AS k, (ln(hx) + ln(hy) + ln(hz)) / 3 AS m, ln(hx) AS a, ln(hy) AS b, ln(hz) AS c
  FROM entities WHERE hx > 0 AND hy > 0 AND hz > 0),
p AS (
  SELECT s.i AS target, t.i AS candidate, greatest(abs((s.a - s.m) - (t.a - t.m)), abs((s.b - s.m) - (t.b - t.m)), abs((s.c - s.m) - (t.c - t.m))) AS d
  FROM r s JOIN r t ON s.region = t.region AND s.k = t.k AND s.i <> t.i)
SELECT target, candidate, round(d, 6) AS aspect_distance FROM p WHERE d <= 0.35
QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(d, 9), candidate) <= 3
""")
def model_swap_candidates(spark, sf_dir):
    return R.swap_candidates(entities(spark, sf_dir)).withColumn("aspect_distance", F.round("aspect_distance", 6))


_MOVES = f"""
WITH {ENTITIES_SQL},
m AS (
  SELECT a.region, a.entity_id AS target, b.entity_id AS anchor, a.x, a.y, a.z, a.hx, a.hy, a.hz, b.x AS bx, b.y AS by_, abs(a.x - b.x) >= abs(a.y - b.y) AS across
  FROM entities a JOIN entities b ON a.region IS NOT DISTINCT FROM b.region AND a.entity_id <> b.entity_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3.0),
p AS (SELECT *, CASE WHEN across THEN 2 * bx - x ELSE x END AS nx, CASE WHEN across THEN y ELSE 2 * by_ - y END AS ny FROM m)
SELECT target, anchor,
  CASE WHEN across THEN CASE WHEN x > bx THEN 'right_of' ELSE 'left_of' END ELSE CASE WHEN y > by_ THEN 'in_front_of' ELSE 'behind' END END AS relation,
  CASE WHEN across THEN CASE WHEN x > bx THEN 'left_of' ELSE 'right_of' END ELSE CASE WHEN y > by_ THEN 'behind' ELSE 'in_front_of' END END AS new_relation,
  round(nx, 6) AS new_x, round(ny, 6) AS new_y
FROM p WHERE NOT EXISTS (
  SELECT 1 FROM entities o WHERE o.region IS NOT DISTINCT FROM p.region AND o.entity_id <> p.target AND o.entity_id <> p.anchor
    AND abs(o.x - p.nx) < o.hx + p.hx + 0.03 AND abs(o.y - p.ny) < o.hy + p.hy + 0.03 AND abs(o.z - p.z) < o.hz + p.hz + 0.03)
"""


@query(_MOVES)
def relation_flip_moves(spark, sf_dir):
    out = R.flip_moves(entities(spark, sf_dir))
    return out.select("target", "anchor", "relation", "new_relation", F.round("new_x", 6).alias("new_x"), F.round("new_y", 6).alias("new_y"))


@query(_MOVES)
def relation_flip_proposals(spark, sf_dir):
    return relation_flip_moves(spark, sf_dir)


@query("""
WITH e AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d,
    CAST(embedding[5] AS DOUBLE) AS vx, CAST(embedding[6] AS DOUBLE) AS vy, CAST(embedding[7] AS DOUBLE) AS vz FROM embeddings),
n AS (
  SELECT vec_id, a / m AS x, b / m AS y, c / m AS z, d / m AS w, vx, vy, vz
  FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS m FROM e) WHERE m > 1e-6)
SELECT vec_id, round((1 - 2 * (y * y + z * z)) * vx + 2 * (x * y - z * w) * vy + 2 * (x * z + y * w) * vz, 6) AS rx,
  round(2 * (x * y + z * w) * vx + (1 - 2 * (x * x + z * z)) * vy + 2 * (y * z - x * w) * vz, 6) AS ry,
  round(2 * (x * z - y * w) * vx + 2 * (y * z + x * w) * vy + (1 - 2 * (x * x + y * y)) * vz, 6) AS rz,
  round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) AS yaw_rad, round(2 * atan2(z, w), 6) AS planar_yaw_rad,
  round(degrees(2 * acos(least(1.0, abs(w)))), 5) AS angle_deg
FROM n
""")
def pose_algebra(spark, sf_dir):
    from orrery.plans.registry import table

    e = F.col("embedding")
    q = G.quat(*[e[i] for i in range(4)])
    rows = table(spark, sf_dir, "embeddings").withColumn("raw", q).where(G.quat_norm(F.col("raw")) > 1e-6)
    rows = rows.withColumn("q", G.quat_normalize(F.col("raw"))).withColumn("v", G.vec(*[e[i] for i in range(4, 7)]))
    r = G.quat_rotate(F.col("q"), F.col("v"))
    still = G.quat(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return rows.select(
        "vec_id", *[F.round(r[k], 6).alias(f"r{k}") for k in "xyz"], F.round(G.yaw_of(F.col("q")), 6).alias("yaw_rad"),
        F.round(G.planar_yaw_of(F.col("q")), 6).alias("planar_yaw_rad"), F.round(G.quat_angle_deg(F.col("q"), still), 5).alias("angle_deg"),
    )


@query(f"""
WITH {ENTITIES_SQL},
o AS (SELECT region, entity_id AS anchor, x AS ox, y AS oy, z AS oz FROM entities QUALIFY row_number() OVER (PARTITION BY region ORDER BY entity_id) = 1),
f AS (SELECT region, x AS fx, y AS fy FROM entities QUALIFY row_number() OVER (PARTITION BY region ORDER BY entity_id) = 2),
c AS (SELECT e.entity_id, region, anchor, atan2(-(fx - ox), fy - oy) AS yaw, x - ox AS dx, y - oy AS dy, z - oz AS dz FROM entities e JOIN o USING (region) JOIN f USING (region))
SELECT entity_id, anchor, round(dx * cos(yaw) + dy * sin(yaw), 6) AS right_m, round(-dx * sin(yaw) + dy * cos(yaw), 6) AS front_m, round(dz, 6) AS up_m,
  CAST(round_even((dx * cos(yaw) + dy * sin(yaw)) / 0.25, 0) AS BIGINT) AS right_bin
FROM c
""")
def canonical_frame(spark, sf_dir):
    e = entities(spark, sf_dir)
    nth = F.row_number().over(W.partitionBy("region").orderBy("entity_id"))
    two = e.withColumn("n", nth).where("n <= 2").groupBy("region").agg(
        F.max(F.when(F.col("n") == 1, F.struct("entity_id", "x", "y", "z"))).alias("o"), F.max(F.when(F.col("n") == 2, F.struct("x", "y"))).alias("f")
    )
    rows = e.join(two.where("f is not null"), "region")
    yaw = G.yaw_facing(F.col("o.x"), F.col("o.y"), F.col("f.x"), F.col("f.y"))
    right, front = G.camera_components(F.col("x"), F.col("y"), F.col("o.x"), F.col("o.y"), yaw)
    return rows.select(
        "entity_id", F.col("o.entity_id").alias("anchor"), F.round(right, 6).alias("right_m"), F.round(front, 6).alias("front_m"),
        F.round(F.col("z") - F.col("o.z"), 6).alias("up_m"), G.quantize(right, 0.25).alias("right_bin"),
    )


@query(f"""
WITH {ENTITIES_SQL}
SELECT entity_id, 'entity-' || substr(sha256('entity' || chr(31) || region || chr(31) || entity_id), 1, 20) AS stable_id,
  'entity-' || substr(sha256(region || chr(31) || entity_id), 1, 20) AS prefixed_id
FROM entities
""")
def entity_ids(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.select("entity_id", ids.stable_id("entity", F.col("region"), F.col("entity_id")).alias("stable_id"), ids.prefixed_id("entity", F.col("region"), F.col("entity_id")).alias("prefixed_id"))
