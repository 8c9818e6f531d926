"""Layout menus, pairs of scenes and exact resampling over the scene tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.operators import evaluation as E
from orrery.operators import menus, pairs
from orrery.operators.relations import top_per
from orrery.plans.durable import cut
from orrery.plans.registry import query, table
from orrery.plans.scenes import entities_of, lines, sql_scene, views

_SIDES = (("F", "_f"), ("O", "_o"))


def _layouts(spark, d: str):
    """Finished and open orders of a customer as two variants of a family: an anchor at the origin, the first view's yaw, and four nations around it."""
    frame = None
    for status, _ in _SIDES:
        one = views(spark, d, f"o_orderstatus = '{status}'").where("step = 0").select(F.col("episode").alias("family"), F.lit(status).alias("variant"), F.lit(0.0).alias("anchor_x"), F.lit(0.0).alias("anchor_y"), F.col("yaw").alias("frame_yaw"))
        frame = one if frame is None else frame.unionByName(one)
    # a family's variant is a scene of its own, so lines are read once for both
    wanted = ", ".join(f"'{status}'" for status, _ in _SIDES)
    rows = lines(spark, d, f"o_orderstatus in ({wanted})", "o_orderstatus as variant").withColumn("episode", F.struct("episode", "variant"))
    few = top_per(entities_of(rows, F.min("view").alias("view")), ["episode"], [F.col("entity")], 4)
    objects = few.select(F.col("episode.episode").alias("family"), "episode.variant", F.col("entity").alias("name"), F.concat(F.lit("c"), F.col("entity").cast("string")).alias("category"), "x", "y", F.lit(0.15).alias("radius"), "view")
    return frame, objects


def _sql_layout(status: str, p: str) -> str:
    return f"""sat{p} AS (SELECT ep, '{status}' AS variant, e, x, y, view FROM ents{p} JOIN (SELECT ep, e, min(v) AS view FROM l{p} GROUP BY ALL) USING (ep, e) QUALIFY row_number() OVER (PARTITION BY ep ORDER BY e) <= 4),
q{p} AS (SELECT s.ep, s.variant, task, 'c' || s.e AS subject, 'c' || r.e AS reference, s.view AS subject_view, r.view AS reference_view, s.x - r.x AS dx, s.y - r.y AS dy, CASE task WHEN 'cross_view_relation' THEN f.yaw ELSE atan2(r.x, -r.y) END AS yaw
  FROM sat{p} AS s JOIN sat{p} AS r ON r.ep = s.ep AND r.e <> s.e AND r.view <> s.view JOIN views{p} AS f ON f.ep = s.ep AND f.step = 0, (SELECT unnest(['cross_view_relation', 'object_anchored_perspective']) AS task)
  WHERE task = 'cross_view_relation' OR sqrt(r.x ** 2 + r.y ** 2) > 1e-9)"""


_QUESTIONS = f"""{sql_scene("_f", "o_orderstatus = 'F'")}, {sql_scene("_o", "o_orderstatus = 'O'")}, {_sql_layout("F", "_f")}, {_sql_layout("O", "_o")},
b AS (SELECT *, b0 + 180 - 360 * floor((b0 + 180) / 360) - 180 AS bearing FROM (SELECT *, degrees(atan2(rr, ff)) AS b0 FROM (SELECT *, dx * cos(yaw) + dy * sin(yaw) AS rr, -dx * sin(yaw) + dy * cos(yaw) AS ff FROM (FROM q_f UNION ALL FROM q_o)))),
g AS (SELECT *, 45 - abs(bearing - mid) AS margin, CASE WHEN sqrt(rr * rr + ff * ff) > 1e-9 THEN degrees(atan2(0.3, sqrt(rr * rr + ff * ff))) ELSE 90 END AS spread FROM (
  SELECT *, CASE WHEN abs(bearing) <= 45 THEN 'front' WHEN abs(bearing) > 135 THEN 'back' WHEN bearing > 0 THEN 'right' ELSE 'left' END AS label, CASE WHEN abs(bearing) <= 45 THEN 0 WHEN bearing > 135 THEN 180 WHEN bearing < -135 THEN -180 WHEN bearing > 0 THEN 90 ELSE -90 END AS mid FROM b)),
asked AS MATERIALIZED (SELECT ep AS family, variant, task, subject, reference, label, margin, margin - spread AS effective, subject_view, reference_view FROM g WHERE round(margin, 9) >= 15 AND round(margin - spread, 9) >= 8)"""


@query(f"""WITH {_QUESTIONS} SELECT family, variant, task, subject, reference, label, round(margin, 6) AS margin_deg, round(effective, 6) AS effective_deg, subject_view, reference_view FROM asked""")
def layout_questions(spark, d):
    """Directions around each customer's anchor that both margins leave clear."""
    out = menus.layout_questions(*_layouts(spark, d))
    return out.select("family", "variant", "task", "subject", "reference", "label", F.round("margin_deg", 6).alias("margin_deg"), F.round("effective_deg", 6).alias("effective_deg"), "subject_view", "reference_view")


@query(f"""WITH {_QUESTIONS},
own AS (SELECT family, task, subject, reference, max(label) FILTER (variant = 'F') AS label FROM asked GROUP BY ALL HAVING count(DISTINCT variant) = 2),
ranks AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY task) - 1 AS t, dense_rank() OVER (PARTITION BY family, task ORDER BY label) - 1 AS l,
  row_number() OVER (PARTITION BY family, task, label ORDER BY sha256(concat_ws('|', 'query-menu', family, task, subject, reference))) AS round FROM own),
turns AS (SELECT *, (l - CAST('0x' || substr(sha256(CAST(family AS VARCHAR)), 1, 8) AS BIGINT) % n_labels + n_labels) % n_labels AS turn, 3 // n_tasks + CASE WHEN t < 3 % n_tasks THEN 1 ELSE 0 END AS budget
  FROM (SELECT *, max(t) OVER (PARTITION BY family) + 1 AS n_tasks, max(l) OVER (PARTITION BY family, task) + 1 AS n_labels FROM ranks)),
picked AS (SELECT *, row_number() OVER (PARTITION BY family, task ORDER BY round, turn) AS nth FROM turns QUALIFY nth <= budget),
full_ AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY t, nth) - 1 AS place FROM picked QUALIFY count(*) OVER (PARTITION BY family) = 3)
SELECT f.family, place, a.variant, f.task, f.subject, f.reference, a.label FROM full_ AS f JOIN asked AS a ON a.family = f.family AND a.task = f.task AND a.subject = f.subject AND a.reference = f.reference""")
def query_menu(spark, d):
    """Three questions a customer that finished and open orders both allow."""
    return menus.query_menu(menus.layout_questions(*_layouts(spark, d)), ("F", "O"), 3, "F")


@query("""WITH c AS (SELECT o_custkey AS c, sum((l_tax >= 0.04)::INT - (l_discount >= 0.05)::INT) AS d, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CAST(c AS VARCHAR)) - 1 AS i, CAST(d AS BIGINT) AS d, n, count(*) OVER () AS clusters FROM c),
r0 AS (SELECT r, clusters, (i * 69621 + r * 16807 + 17) % 2147483647 AS h FROM p, (SELECT unnest(range(10000)) AS r)),
r1 AS (SELECT r, clusters, (xor(h, h >> 15) * 48271) % 2147483647 AS h FROM r0), r2 AS (SELECT r, clusters, (xor(h, h >> 13) * 40692) % 2147483647 AS h FROM r1), r3 AS (SELECT r, (xor(h, h >> 16) * 16807) % 2147483647 % clusters AS i FROM r2),
e AS (SELECT r, sum(d) / sum(n) AS delta FROM r3 JOIN p USING (i) GROUP BY r)
SELECT round((SELECT sum(d) / sum(n) FROM p), 9) AS observed, round(avg(delta), 9) AS mean, round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high,
  (SELECT CAST(sum(n) AS BIGINT) FROM p) AS records, (SELECT count(*) FROM p) AS clusters FROM e""")
def scene_bootstrap(spark, d):
    """The interval of a difference of accuracies, customers drawn with replacement."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = E.bootstrap_draws(rows, "o_custkey", F.expr("l_discount >= 0.05"), F.expr("l_tax >= 0.04"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("observed", "mean", "low", "high")], "records", "clusters")


_MODEL = "'m' || (CAST(sum(p) AS BIGINT) % 3)"


@query(f"""WITH {sql_scene("_b", "o_orderstatus <> 'P'")}, {sql_scene("_v", "true")},
mine AS (SELECT ep, e, {_MODEL} AS model FROM l_b GROUP BY ALL), theirs AS (SELECT ep, e, {_MODEL} AS model FROM l_v GROUP BY ALL),
late AS (SELECT o_custkey AS ep, s_nationkey AS e, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'P' GROUP BY ALL),
target AS (SELECT ep, e AS t FROM late QUALIFY row_number() OVER (PARTITION BY ep ORDER BY q DESC, e) = 1),
pr AS MATERIALIZED (SELECT ep, t, a, c_nationkey AS nat, (['left_of', 'right_of', 'in_front_of', 'behind'])[c_nationkey % 4 + 1] AS says FROM target JOIN (SELECT ents_b.ep, min(e) AS a FROM ents_b JOIN target ON target.ep = ents_b.ep AND t <> e GROUP BY ents_b.ep) USING (ep) JOIN customer ON c_custkey = ep),
both_ AS (SELECT coalesce(b.ep, v.ep) AS ep, coalesce(b.e, v.e) AS e, b.x AS bx, b.y AS b_y, v.x AS vx, v.y AS vy, sqrt((b.x - v.x) ** 2 + (b.y - v.y) ** 2 + (b.z - v.z) ** 2) AS moved, b.e IS NULL OR v.e IS NULL AS alone, b.label AS bl, v.label AS vl
  FROM (SELECT * FROM ents_b WHERE ep IN (SELECT ep FROM pr)) AS b FULL JOIN (SELECT * FROM ents_v WHERE ep IN (SELECT ep FROM pr)) AS v ON b.ep = v.ep AND b.e = v.e),
f AS (SELECT pr.*, (SELECT count(*) FROM both_ AS o WHERE o.ep = pr.ep AND alone) AS unmatched, coalesce((SELECT max(moved) FROM both_ AS o WHERE o.ep = pr.ep AND e <> t), 0) AS drift,
  x.moved, x.bl, x.vl, x.bx - y.bx AS dx0, x.b_y - y.b_y AS dy0, x.vx - y.vx AS dx1, x.vy - y.vy AS dy1, (SELECT model FROM mine WHERE mine.ep = pr.ep AND e = t) AS m0, (SELECT model FROM theirs WHERE theirs.ep = pr.ep AND e = t) AS m1,
  (SELECT max(v) FROM views_b WHERE views_b.ep = pr.ep AND step = 0) = (SELECT max(v) FROM views_v WHERE views_v.ep = pr.ep AND step = 0) AS path,
  (SELECT count(DISTINCT e) FROM m_b WHERE m_b.ep = pr.ep AND e IN (t, a) AND pixels >= 600) = 2 AND (SELECT count(DISTINCT e) FROM m_v WHERE m_v.ep = pr.ep AND e IN (t, a) AND pixels >= 600) = 2 AS evidence
  FROM pr LEFT JOIN both_ AS x ON x.ep = pr.ep AND x.e = t LEFT JOIN both_ AS y ON y.ep = pr.ep AND y.e = a),
h AS (SELECT *, CASE WHEN abs(dx0) >= abs(dy0) THEN CASE WHEN dx0 > 0 THEN 'right_of' ELSE 'left_of' END WHEN dx0 IS NOT NULL THEN CASE WHEN dy0 > 0 THEN 'in_front_of' ELSE 'behind' END END AS r0,
  CASE WHEN abs(dx1) >= abs(dy1) THEN CASE WHEN dx1 > 0 THEN 'right_of' ELSE 'left_of' END WHEN dx1 IS NOT NULL THEN CASE WHEN dy1 > 0 THEN 'in_front_of' ELSE 'behind' END END AS r1, nat >= 12 AS swap FROM f),
k AS (SELECT *, array_to_string([n FOR n IN [CASE WHEN unmatched > 0 THEN 'same_entities' END, CASE WHEN path IS NOT TRUE THEN 'same_camera_trajectory' END, CASE WHEN drift > 0.02 THEN 'single_mutable_entity' END, CASE WHEN NOT evidence THEN 'evidence_available_both_sides' END,
  CASE WHEN r0 IS NULL THEN 'relation_before_matches_plan' END, CASE WHEN coalesce(r1 <> says, true) THEN 'relation_after_matches_plan' END, CASE WHEN coalesce(abs(abs(dx0) - abs(dy0)) < 0.4, true) THEN 'axis_margin_before_m' END, CASE WHEN coalesce(abs(abs(dx1) - abs(dy1)) < 0.4, true) THEN 'axis_margin_after_m' END,
  CASE WHEN NOT swap AND coalesce(r0 = r1, true) THEN 'answers_flip' END, CASE WHEN swap AND m0 IS NULL THEN 'source_model_matches_plan' END, CASE WHEN swap AND coalesce(m1 <> 'm1', true) THEN 'replacement_model_matches_plan' END, CASE WHEN swap AND coalesce(m0 = m1, true) THEN 'asset_model_changed' END,
  CASE WHEN swap AND bl IS NULL THEN 'semantic_category_invariant' END, CASE WHEN swap AND coalesce(moved > 0.08, true) THEN 'target_center_invariance_m' END, CASE WHEN swap AND coalesce(r0 <> r1, true) THEN 'answers_invariant' END] IF n IS NOT NULL], ',') AS failed FROM h)
SELECT ep AS proposal, CASE WHEN failed = '' THEN 'pair-' || substr(sha256('{{"base_episode_id":"b' || ep || '","family_id":"' || nat || '","proposal_id":"' || ep || '","variant_episode_id":"v' || ep || '"}}'), 1, 20) END AS pair_id, CASE WHEN failed = '' THEN 'certified' ELSE 'failed' END AS status, failed,
  CASE WHEN swap THEN 'answer_invariance' ELSE 'answer_flip' END AS signal, r0 AS relation_before, r1 AS relation_after, round(abs(abs(dx0) - abs(dy0)), 6) AS margin_before, round(abs(abs(dx1) - abs(dy1)), 6) AS margin_after, round(moved, 6) AS movement_m, round(drift, 6) AS drift_m FROM k""")
def pair_certificates(spark, d):
    """Each customer with pending orders as a pair: the scene without them and with them, the nation that got most of them as the target."""
    # one reading of the lines for both sides: sums of a view's entities, then of a customer's, with what is late
    old, late = F.col("status") != "P", F.col("status") == "P"
    sums = lines(spark, d, "true", "o_orderstatus as status").groupBy("episode", "view", "status", "entity", "label").agg(*[F.sum(c).alias(c) for c in ("qty", "part", "supp")])
    of_side = lambda p, here: [F.sum(F.when(here, F.col(c))).alias(f"{p}_{c}") for c in ("qty", "part", "supp")] + [F.max(F.when(here, F.col("qty") * 60)).alias(f"{p}_pixels")]
    things = cut(sums.groupBy("episode", "entity", "label").agg(*of_side("b", old), *of_side("v", F.lit(True)), F.sum(F.when(late, F.col("qty"))).alias("late")))
    begins = F.struct(F.col("o_orderdate"), F.col("o_orderkey"))
    orders = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status").groupBy(F.col("o_custkey").alias("episode"))
    orders = orders.agg(F.min(F.when(old, begins)).alias("b"), F.min(begins).alias("v"))
    sides, ends, shown = [], [], []
    for name in "bv":
        key = F.concat(F.lit(name), F.col("episode").cast("string")).alias("episode")
        here = things.where(F.col(f"{name}_qty").isNotNull()).withColumns({c: F.col(f"{name}_{c}") for c in ("qty", "part", "supp", "pixels")})
        at = ("(qty * 37 % 1000) / 100.0D - 5 as x", "(part % 1000) / 100.0D - 5 as y", "(supp % 250) / 100.0D as z", "concat('m', cast(part % 3 as string)) as model")
        sides.append(here.select(key, "entity", *map(F.expr, at), F.col("label").alias("category"), F.col("episode").alias("customer")))
        shown.append(here.where("pixels >= 600").select(key, "entity"))
        ends.append(orders.where(F.col(name).isNotNull()).select(key, F.col("episode").alias("scene"), F.sha2(F.col(f"{name}.o_orderkey").cast("string"), 256).alias("trajectory_sha256")))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("scene"), F.col("c_nationkey").alias("family"))
    episodes = ends[0].unionByName(ends[1]).join(who, "scene")
    target = things.where("late is not null").groupBy("episode").agg(F.max(F.struct("late", (-F.col("entity")).alias("e"))).alias("m")).select(F.col("episode").alias("customer"), (-F.col("m.e")).alias("target"))
    anchor = sides[0].join(target, "customer").where("entity <> target").groupBy("customer", "target").agg(F.min("entity").alias("anchor"))
    at = lambda w: sides[0].select("customer", F.col("entity").alias(w), F.col("x").alias(f"{w}_x"), F.col("y").alias(f"{w}_y"), F.col("model").alias(f"{w}_model"), F.col("category").alias(f"{w}_category"))
    says = F.array(*[F.lit(r) for r in ("left_of", "right_of", "in_front_of", "behind")])[F.col("family") % 4]
    planned = F.when(F.col("target_x").isNotNull(), G.dominant_relation(F.col("target_x") - F.col("anchor_x"), F.col("target_y") - F.col("anchor_y"))["relation"])
    rows = anchor.join(at("target"), ["customer", "target"], "left").join(at("anchor"), ["customer", "anchor"], "left").join(who.withColumnRenamed("scene", "customer"), "customer")
    # one row a customer, read six times
    proposals = cut(rows.select(
        F.col("customer").alias("proposal"), F.when(F.col("family") >= 12, pairs.KINDS[1]).otherwise(pairs.KINDS[0]).alias("kind"), F.concat(F.lit("b"), F.col("customer").cast("string")).alias("base"), F.concat(F.lit("v"), F.col("customer").cast("string")).alias("variant"),
        "target", "anchor", planned.alias("planned_before"), says.alias("planned_after"), F.lit(None).cast("double").alias("yaw"), F.col("target_model").alias("source_model"), F.lit("m1").alias("new_model"), F.col("target_category").alias("category"), F.lit(True).alias("executed"),
    ))
    out = pairs.certify_pairs(proposals, episodes, sides[0].unionByName(sides[1]).drop("customer"), shown[0].unionByName(shown[1]))
    rounded = [F.round(c, 6).alias(c) for c in ("margin_before", "margin_after", "movement_m", "drift_m")]
    return out.select("proposal", "pair_id", "status", F.array_join("failed", ",").alias("failed"), "signal", "relation_before", "relation_after", *rounded)
