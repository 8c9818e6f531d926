"""Queries on frames and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import gates as Q
from orrery.operators import raster as R
from orrery.plans.registry import FRAMES_SQL, entities, ENTITIES_SQL, frames, query, table

_F = f"WITH {FRAMES_SQL}"
_EDGE = "(x < 1 OR x >= 7 OR y < 1 OR y >= 7)"


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


_INSTANCES = f"""i AS (
  SELECT view, instance, count(*) AS pixels, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg({_EDGE}::INT), 9) AS outer_share,
    round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 9) AS fill_ratio,
    concat_ws(',', CASE WHEN max(y) = 7 THEN 'bottom' END, CASE WHEN min(x) = 0 THEN 'left' END, CASE WHEN max(x) = 7 THEN 'right' END, CASE WHEN min(y) = 0 THEN 'top' END) AS sides,
    least(max(x) - min(x), max(y) - min(y)) + 1 AS min_side
  FROM pixels GROUP BY view, instance)"""


@query(f"{_F}, {_INSTANCES} SELECT * FROM i")
def instance_stats(spark, d):
    s = _rounded(R.instance_stats(frames(spark, d), 8, 8), "outer_share", "fill_ratio")
    return s.withColumn("sides", F.array_join("sides", ","))


_COLOUR = """c AS (
  SELECT view, round(max(n) / sum(n), 9) AS dominant_share, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS entropy_bits FROM (
    SELECT view, (r // 16) * 256 + (g // 16) * 16 + b // 16 AS bin, count(*) AS n FROM pixels GROUP BY ALL) GROUP BY view),
l AS (SELECT view, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) AS m, stddev_pop(0.2126 * r + 0.7152 * g + 0.0722 * b) AS s FROM pixels GROUP BY view)"""


@query(f"{_F}, {_COLOUR} SELECT view, dominant_share, entropy_bits, round(m + 1e-7, 4) AS light_mean, round(s, 4) AS light_std FROM c JOIN l USING (view)")
def quantised_entropy(spark, d):
    s = _rounded(R.colour_stats(frames(spark, d)), "dominant_share", "entropy_bits")
    return s.withColumn("light_mean", F.round(F.col("light_mean") + 1e-7, 4)).withColumn("light_std", F.round("light_std", 4))


_COLLISION = """k AS (
  SELECT view, count(*) AS top_half, CAST(sum((depth_m > 0)::INT) AS BIGINT) AS valid, CAST(sum((depth_m > 0 AND depth_m < 0.4)::INT) AS BIGINT) AS near,
    CAST(sum((depth_m > 0 AND depth_m < 0.4 AND instance <> 0)::INT) AS BIGINT) AS near_things FROM pixels WHERE y < 4 GROUP BY view)"""


@query(f"{_F}, {_COLLISION} SELECT *, round(near / nullif(valid, 0), 9) AS near_share, round(near_things / nullif(valid, 0), 9) AS near_thing_share FROM k")
def frame_collisions(spark, d):
    return _rounded(R.collision_stats(frames(spark, d), 8, structural=F.col("instance") == 0), "near_share", "near_thing_share")


_CONTEXT = f"""x AS (
  SELECT view, round(quantile_cont(depth_m, 0.1) FILTER (depth_m > 0), 9) AS p10, round(quantile_cont(depth_m, 0.5) FILTER (depth_m > 0), 9) AS p50, round(quantile_cont(depth_m, 0.9) FILTER (depth_m > 0), 9) AS p90,
    round(sum((depth_m > 0 AND depth_m < 0.8)::INT) / nullif(sum((depth_m > 0)::INT), 0), 9) AS close_share,
    round(sum((depth_m > 0 AND depth_m < 0.8 AND {_EDGE})::INT) / nullif(sum({_EDGE}::INT), 0), 9) AS enclosure FROM pixels GROUP BY view),
d AS (SELECT view, instance AS dominant, n AS dominant_pixels FROM (SELECT view, instance, count(*) AS n FROM pixels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY view ORDER BY n DESC, instance) = 1)"""


@query(f"{_F}, {_CONTEXT} SELECT * FROM x JOIN d USING (view)")
def frame_context(spark, d):
    return _rounded(R.context_stats(frames(spark, d)), "p10", "p50", "p90", "close_share", "enclosure")


@query(f"""{_F}, {_COLOUR}, {_COLLISION}, {_CONTEXT},
e AS (SELECT view, avg((instance IN (0, 1))::INT) AS enclosing, count(*) AS size FROM pixels GROUP BY view),
f AS (SELECT view, n, far, edges FROM (
    SELECT view, instance, count(*) AS n, median(depth_m) FILTER (depth_m > 0) AS far, min(x) = 0 AND max(x) = 7 AND min(y) = 0 AS edges FROM pixels WHERE instance <> 0 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY view ORDER BY n DESC, instance) = 1)
SELECT view, concat_ws(',', CASE WHEN dominant_share >= 0.6 AND entropy_bits < 2.75 THEN 'degenerate_rgb' END,
  CASE WHEN coalesce(near_things / nullif(valid, 0), 0) >= 0.35 OR coalesce(near / nullif(valid, 0), 0) >= 0.9 THEN 'camera_collision' END,
  CASE WHEN coalesce(close_share, 0) >= 0.9 THEN 'near_surface_saturation' END,
  CASE WHEN enclosing >= 0.95 AND coalesce(p50, 0) <= 0.9 AND coalesce(p90 - p10, 0) <= 0.6 THEN 'near_enclosure' END,
  CASE WHEN n / size >= 0.6 AND edges AND far <= 0.75 THEN 'foreground_occlusion' END) AS reasons
FROM c JOIN k USING (view) JOIN x USING (view) JOIN e USING (view) LEFT JOIN f USING (view)""")
def frame_gate(spark, d):
    s = Q.frame_evidence(frames(spark, d), 8, 8, F.col("instance") == 0, F.col("instance").isin(0, 1))
    return Q.gated(s, *Q.frame_checks()).select("view", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{_F}, {_INSTANCES} SELECT view, instance, pixels >= 6 AND min_side >= 2 AND outer_share < 0.8 AND fill_ratio >= 0.1 AND length(sides) - length(replace(sides, ',', '')) + (sides <> '')::INT < 2 AS passed FROM i""")
def referent_gate(spark, d):
    s = R.instance_stats(frames(spark, d), 8, 8)
    return Q.gated(s, *Q.referent_checks(6, 2, 0.8, 0.1)).select("view", "instance", "passed")


@query(f"""{_F}, p AS (SELECT view, instance, count(*) AS n, least(max(x) - min(x), max(y) - min(y)) + 1 AS side FROM pixels GROUP BY ALL)
SELECT view, CASE WHEN instance < 2 THEN 'structure' WHEN instance < 4 THEN 'furniture' ELSE 'small' END AS label, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS instances, max(side) AS max_min_side FROM p GROUP BY ALL""")
def category_stats(spark, d):
    labels = spark.createDataFrame([(i, ("structure", "structure", "furniture", "furniture", "small", "small")[i]) for i in range(6)], "instance int, label string")
    return R.category_stats(frames(spark, d), labels)


@query(f"""{_F}, s AS (SELECT view, count(*) FILTER (instance = 1) AS na, count(*) FILTER (instance = 2) AS nb, avg(x) FILTER (instance = 1) AS xa, avg(x) FILTER (instance = 2) AS xb FROM pixels GROUP BY view)
SELECT view, CASE WHEN xa < xb THEN 'left_of' ELSE 'right_of' END AS cue FROM s WHERE na >= 4 AND nb >= 4 AND abs(xa - xb) >= 1.0""")
def mask_pair_cue(spark, d):
    return R.pair_cue(frames(spark, d), 1, 2)


@query(f"""{_F}, j AS (SELECT a.view, a.r AS a, b.r AS b FROM pixels a JOIN pixels b ON b.view = a.view + 1 AND b.y = a.y AND b.x = a.x)
SELECT view, round(avg(abs(a - b)), 6) AS mae, round(10 * log10(65025.0 / nullif(avg((a - b) * (a - b)), 0)), 6) AS psnr_db, round(corr(a, b), 6) AS correlation FROM j GROUP BY view""")
def loop_diagnostics(spark, d):
    p = frames(spark, d)
    out = R.loop_diagnostics(p, p.withColumn("view", F.col("view") - 1))
    return out.select("view", *[F.round(c, 6).alias(c) for c in ("mae", "psnr_db", "correlation")])


@query(f"""{_F}, g AS (SELECT view, y, x, 0.299 * r + 0.587 * g + 0.114 * b AS l FROM pixels),
c AS (SELECT m.view, u.l + w.l + e.l + f.l - 4 * m.l AS lap FROM g m JOIN g u ON u.view = m.view AND u.y = m.y - 1 AND u.x = m.x JOIN g w ON w.view = m.view AND w.y = m.y + 1 AND w.x = m.x
  JOIN g e ON e.view = m.view AND e.y = m.y AND e.x = m.x - 1 JOIN g f ON f.view = m.view AND f.y = m.y AND f.x = m.x + 1)
SELECT view, round(var_pop(lap), 4) AS sharpness FROM c GROUP BY view""")
def sharpness(spark, d):
    return R.sharpness(frames(spark, d)).withColumn("sharpness", F.round("sharpness", 4))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS path FROM pages)
SELECT page_id AS instance, CASE WHEN path LIKE '%.com' THEN 'com' WHEN path LIKE '%.net' THEN 'net' WHEN path LIKE '%.org' THEN 'org' END AS name FROM p WHERE path LIKE '%.com' OR path LIKE '%.net' OR path LIKE '%.org'""")
def renamed_instances(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    # a host read from its end is a path
    path = F.array_join(F.reverse(F.split(host, r"\.")), "/")
    objects = spark.createDataFrame([("com", "com"), ("net", "net"), ("org", "org")], "name string, prefix string")
    return R.renamed_instances(table(spark, d, "pages").select(F.col("page_id").alias("instance"), path.alias("path")), objects)


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'excluded' WHEN c_acctbal < 0 THEN 'excluded' WHEN c_nationkey < 5 THEN 'audit_only' ELSE 'candidate' END AS tier,
  CASE WHEN c_nationkey = 7 THEN 'excluded' WHEN c_nationkey = 3 AND NOT (c_mktsegment = 'MACHINERY' OR c_acctbal < 0) THEN 'candidate'
    WHEN c_mktsegment = 'MACHINERY' THEN 'excluded' WHEN c_acctbal < 0 THEN 'excluded' WHEN c_nationkey < 5 THEN 'audit_only' ELSE 'candidate' END AS decided FROM customer""")
def release_tiers(spark, d):
    c = table(spark, d, "customer")
    tier = Q.tier(F.when(F.col("c_mktsegment") == "MACHINERY", "failed").otherwise("passed"), F.col("c_acctbal") >= 0, F.col("c_nationkey") >= 5)
    decision = F.when(F.col("c_nationkey") == 7, "reject").when(F.col("c_nationkey") == 3, "accept")
    return c.select("c_custkey", tier.alias("tier"), Q.decided(tier, decision).alias("decided"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 'reject_integrity' WHEN o_orderstatus = 'P' THEN 'reject_evidence' WHEN o_orderpriority = '5-LOW' THEN 'reject_visual' WHEN o_totalprice > 300000 THEN 'needs_review' ELSE 'accept' END AS decision FROM orders""")
def adjudications(spark, d):
    x = Q.adjudicated(F.col("o_totalprice") > 1000, F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 300000)
    return table(spark, d, "orders").select("o_orderkey", x.alias("decision"))


@query(f"""WITH {ENTITIES_SQL}, m AS (SELECT entity_id, greatest(hx, hy, hz) AS side, hx * hy * hz AS volume FROM entities)
SELECT entity_id, CASE WHEN side <= 0.45 AND volume <= 0.03 THEN 'tabletop' WHEN side <= 1.2 THEN 'floor' WHEN side <= 2.5 THEN 'large_floor' ELSE 'exclude' END AS placement FROM m""")
def placement_tiers(spark, d):
    return entities(spark, d).select("entity_id", Q.placement(F.array("hx", "hy", "hz"), F.lit(True)).alias("placement"))


@query("""SELECT user_id, count(DISTINCT event_type) AS kinds, CASE WHEN count(*) >= 20 AND count(DISTINCT event_type) >= 8 AND count(DISTINCT CAST(ts AS DATE)) >= 2 THEN 'multi_room_rich' WHEN count(*) >= 20 AND count(DISTINCT event_type) >= 8 THEN 'single_room_rich' ELSE 'sparse' END AS scene_class FROM events GROUP BY 1""")
def scene_classes(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"))
    return s.select("user_id", "kinds", Q.scene_class(F.col("days"), F.col("n"), F.col("kinds")).alias("scene_class"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(least(1, greatest(0, (l_quantity - 10) / 30)), least(1, greatest(0, (l_discount - 0.02) / 0.06)), least(1, greatest(0, (l_tax - 0.01) / 0.07))), 9) AS risk FROM lineitem""")
def risk_scores(spark, d):
    r = Q.risk(Q.signal(F.col("l_quantity"), 10.0, 40.0), Q.signal(F.col("l_discount"), 0.02, 0.08), Q.signal(F.col("l_tax"), 0.01, 0.08))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(r, 9).alias("risk"))
