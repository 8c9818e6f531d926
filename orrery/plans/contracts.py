"""Queries on answers, targets, exports and schedules against their contracts, over the driver's tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import ids
from orrery.functions import text as T
from orrery.operators import audit as A
from orrery.operators import evaluation as E
from orrery.operators import release as L
from orrery.operators import sampling as S
from orrery.operators import schedule as C
from orrery.plans.metrics import BOOTSTRAP_SQL, ENDS_SQL
from orrery.plans.registry import ENTITIES_SQL, entities, query, table
from orrery.plans.samples import CANDIDATES_SQL

_WORDS = ("前方", "右侧", "后方", "左侧")
_NAMES = "CASE {0} WHEN '前方' THEN 'front' WHEN '右侧' THEN 'right' WHEN '后方' THEN 'back' WHEN '左侧' THEN 'left' END"


def _responses(spark, d):
    """Orders as responses: a letter, a direction or both, with or without tags, to a question of four options."""
    k = F.col("o_orderkey")
    word = lambda i: F.get(F.array(*map(F.lit, _WORDS)), (i % 4).cast("int"))
    letter = F.get(F.array(*map(F.lit, "ABCD")), (k % 4).cast("int"))
    options = F.concat(*[x for i, c in enumerate("ABCD") for x in (F.lit(f" {c}. "), word(k + i))])
    response = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("<cue>c</cue><reasoning>r</reasoning><answer>"), letter, F.lit(". "), word(k + 1), F.lit("</answer>")))
    response = response.when(k % 6 == 2, F.concat(F.lit("先看左侧\n"), word(k))).when(k % 6 == 3, F.concat(F.lit("<answer>"), letter, F.lit("</answer>"))).otherwise(F.concat(F.lit("答案是"), letter))
    key = F.get(F.array(*map(F.lit, "ABCD")), (k % 3).cast("int"))
    label = F.get(F.array(*[F.lit(x) for x in ("front", "right", "back", "left")]), (k % 5 % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", T.response_score(response, options, key, label).alias("score"))


_SCORES = f"""r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderkey AS k, o_orderkey % 6 AS m, ['前方', '右侧', '后方', '左侧'] AS w, ['A', 'B', 'C', 'D'] AS c FROM orders),
v AS (SELECT *, CASE WHEN m IN (1, 3, 4, 5) THEN c[k % 4 + 1] END AS prediction, CASE WHEN m = 1 THEN w[(k + 1) % 4 + 1] WHEN m = 2 THEN w[k % 4 + 1] END AS said FROM r),
o AS (SELECT *, CASE WHEN prediction IS NOT NULL THEN w[(k + k % 4) % 4 + 1] END AS chosen FROM v),
s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, m = 1 AS trace, prediction, {_NAMES.format("chosen")} AS option_label, {_NAMES.format("said")} AS text_label, {_NAMES.format("coalesce(said, chosen)")} AS semantic_label,
  coalesce(prediction = c[k % 3 + 1], false) AS correct, coalesce({_NAMES.format("coalesce(said, chosen)")} = ['front', 'right', 'back', 'left'][k % 5 % 4 + 1], false) AS semantic_correct, chosen = said AS option_text_consistent FROM o)"""


@query(f"WITH {_SCORES} SELECT o_orderkey, prediction, option_label, text_label, semantic_label, correct, semantic_correct, option_text_consistent, trace FROM s")
def response_scores(spark, d):
    return _responses(spark, d).select("o_orderkey", "score.*").withColumn("trace", F.col("trace.cue") & F.col("trace.reasoning") & F.col("trace.answer"))


@query(f"""WITH {_SCORES} SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'all' END AS "grouping", coalesce(o_orderstatus, o_orderpriority) AS key,
  count(*) AS n, avg(correct::INT) AS accuracy, avg(semantic_correct::INT) AS semantic_accuracy, avg(trace::INT) AS trace_rate FROM s GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def zero_shot_summary(spark, d):
    return E.zero_shot_summary(_responses(spark, d), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'existence_denied,no_uncertainty' WHEN 2 THEN 'scene_absence' WHEN 3 THEN '' ELSE 'scene_absence,no_uncertainty' END AS faults,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS asked FROM orders""")
def unknown_answers(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, "没看到不代表不存在，无法确定。").when(k % 5 == 1, "它不存在。").when(k % 5 == 2, "房间里没有灯，所以证据不足。").when(k % 5 == 3, "画面里没有看到灯，信息不足。").otherwise("屋里没有灯。")
    asked = F.when(k % 2 == 0, F.concat(F.lit("先问是否存在门？再问：存在 "), F.col("o_orderpriority"), F.lit("？请回答。"))).otherwise("看到了什么？")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.unknown_faults(said), ",").alias("faults"), T.query_surface(asked).alias("asked"))


@query("""WITH q AS (SELECT p_partkey, substr(p_brand, 1, 7) AS name, p_brand AS longer, CASE WHEN p_partkey % 3 = 0 THEN 'in view 3 ' || p_brand WHEN p_partkey % 3 = 1 THEN 'in view 3 ' || p_brand || ' and in view 4 ' || substr(p_brand, 1, 7) || '.' ELSE substr(p_brand, 1, 7) END AS said FROM part)
SELECT p_partkey, len(list_filter(range(1, length(said) + 1), lambda i: (starts_with(substr(said, i), 'in view 3 ' || name) OR starts_with(substr(said, i), 'in view 4 ' || name)) AND (longer = name OR NOT starts_with(substr(said, i + 10), longer)))) > 0 AS anchored FROM q""")
def surface_anchors(spark, d):
    name, longer = F.substring("p_brand", 1, 7), F.col("p_brand")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("in view 3 "), longer)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("in view 3 "), longer, F.lit(" and in view 4 "), name, F.lit("."))).otherwise(name)
    return table(spark, d, "part").select("p_partkey", T.surface_anchored(said, F.array(F.lit("in view 3 "), F.lit("in view 4 ")), name, F.array(longer, name)).alias("anchored"))


_TRIPLES = f"""{ENTITIES_SQL}, n AS (SELECT *, lead(x) OVER w AS fx, lead(y) OVER w AS fy, lead(x, 2) OVER w AS tx, lead(y, 2) OVER w AS ty, lead(hx, 2) OVER w AS thx, lead(hy, 2) OVER w AS thy FROM entities WINDOW w AS (PARTITION BY region ORDER BY entity_id)),
u AS (SELECT *, (fx - x) / sqrt((fx - x) ** 2 + (fy - y) ** 2) AS ux, (fy - y) / sqrt((fx - x) ** 2 + (fy - y) ** 2) AS uy FROM n WHERE tx IS NOT NULL),
q AS (SELECT *, (tx - x) * uy - (ty - y) * ux AS qr, (tx - x) * ux + (ty - y) * uy AS qf, thx * abs(uy) + thy * abs(ux) AS er, thx * abs(ux) + thy * abs(uy) AS ef FROM u)"""


def _triples(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("region").orderBy("entity_id")
    ahead = [F.lead(c, i).over(w).alias(f"{p}{c}") for i, p, cs in ((1, "f", "x y"), (2, "t", "x y hx hy")) for c in cs.split()]
    return entities(spark, d).select("*", *ahead).where("tx is not null")


@query(f"""WITH {_TRIPLES} SELECT entity_id, CASE WHEN qf >= 0 THEN 'front' ELSE 'back' END || '-' || CASE WHEN qr >= 0 THEN 'right' ELSE 'left' END AS quadrant,
  degrees(least(atan2(abs(qr), abs(qf)), atan2(abs(qf), abs(qr)))) >= 20 AND abs(qr) > er AND abs(qf) > ef AS clear FROM q""")
def anchored_quadrants(spark, d):
    x, y, fx, fy = (F.col(c) for c in ("x", "y", "fx", "fy"))
    n = F.hypot(fx - x, fy - y)
    ux, uy = F.abs((fx - x) / n), F.abs((fy - y) / n)
    right, front = G.object_components(x, y, fx, fy, F.col("tx"), F.col("ty"))
    found = G.object_anchored(right, front, F.col("thx") * uy + F.col("thy") * ux, F.col("thx") * ux + F.col("thy") * uy)
    return _triples(spark, d).select("entity_id", found.alias("q")).select("entity_id", "q.quadrant", "q.clear")


@query(f"""WITH {ENTITIES_SQL}, p AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM entities WINDOW w AS (PARTITION BY region ORDER BY entity_id))
SELECT entity_id, CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END ELSE CASE WHEN dy > 0 THEN 'in_front_of' ELSE 'behind' END END AS view_relation,
  CASE WHEN entity_id % 2 = 0 THEN CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END ELSE CASE WHEN dy > 0 THEN 'in_front_of' ELSE 'behind' END END AS axis_relation,
  CASE WHEN entity_id % 2 = 0 THEN abs(dx) - abs(dy) ELSE abs(dy) - abs(dx) END AS axis_margin FROM p WHERE dx IS NOT NULL""")
def declared_axes(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("region").orderBy("entity_id")
    pairs = entities(spark, d).select("entity_id", *[(F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in "xy"]).where("dx is not null")
    axis = G.axis_relation(F.when(F.col("entity_id") % 2 == 0, "x").otherwise("y"), F.col("dx"), F.col("dy"))
    return pairs.select("entity_id", G.view_relation(F.col("dx"), F.col("dy"))["relation"].alias("view_relation"), axis["relation"].alias("axis_relation"), axis["margin_m"].alias("axis_margin"))


@query("""SELECT o_orderkey, sha256('[' || least('{"a":' || o_custkey || ',"b":1}', '{"a":' || o_orderkey || ',"b":1}') || ',' || greatest('{"a":' || o_custkey || ',"b":1}', '{"a":' || o_orderkey || ',"b":1}') || ']') AS digest,
  'family-' || substr(sha256(CASE WHEN o_orderkey % 2 = 0 THEN 'family' || chr(31) || o_orderstatus ELSE 'family' || chr(31) || o_custkey || chr(31) || o_orderkey || chr(31) || 'canonical' END), 1, 20) AS family_id FROM orders""")
def semantic_ids(spark, d):
    item = lambda c: F.concat(F.lit('{"b": 1, "a": '), F.col(c).cast("string"), F.lit("}"))
    group = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    return table(spark, d, "orders").select(
        "o_orderkey", ids.set_digest(F.array(item("o_orderkey"), item("o_custkey"))).alias("digest"), ids.family_id(group, F.col("o_custkey"), F.col("o_orderkey"), F.lit("canonical")).alias("family_id")
    )


@query("SELECT coalesce(l_returnflag, 'None') || '/' || l_linestatus || '/' || l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def composite_counts(spark, d):
    return A.counts_by(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("""WITH f AS (SELECT o_orderstatus, unnest([{'path': 'status', 'value': '"' || o_orderpriority || '"'}, {'path': 'value.at.x', 'value': CAST(o_orderkey % 3 AS VARCHAR)}, {'path': 'value.at.ys', 'value': '[1,' || o_custkey % 2 || ']'}, {'path': 'value.none', 'value': '{}'}]) AS f FROM orders)
SELECT o_orderstatus, f.path AS path, f.value AS value, count(*) AS n FROM f GROUP BY ALL""")
def field_marginals(spark, d):
    x, y = (F.col("o_orderkey") % 3).cast("string"), (F.col("o_custkey") % 2).cast("string")
    target = F.concat(F.lit('{"none": {}, "at": {"ys": [1, '), y, F.lit('], "x": '), x, F.lit("}}"))
    return A.field_marginals(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", target.alias("target")), ["o_orderstatus"], "o_orderpriority", "target")


@query("""WITH r AS (SELECT o_orderstatus AS part, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS split, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 END AS task, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 5 END AS target FROM orders),
n AS (SELECT part, split, task, target, count(*) AS n FROM r WHERE split IS NOT NULL AND task IS NOT NULL AND target IS NOT NULL GROUP BY ALL), g AS (SELECT part, max(n) AS n FROM n GROUP BY part, split, task), b AS (SELECT part, CAST(sum(n) AS BIGINT) AS n_majority, count(*) AS n_groups FROM g GROUP BY part),
t AS (SELECT part, count(*) AS n_records, count(*) FILTER (split IS NOT NULL AND task IS NOT NULL AND target IS NOT NULL) AS n_valid, count(*) FILTER (split IS NULL) AS no_split, count(*) FILTER (task IS NULL) AS no_task, count(*) FILTER (target IS NULL) AS no_target FROM r GROUP BY part)
SELECT *, n_majority / n_valid AS majority_accuracy FROM t JOIN b USING (part)""")
def partition_targets(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("part"), F.when(k % 10 != 0, F.col("o_orderpriority")).alias("split"), F.when(k % 7 != 0, k % 4).alias("task"), F.when(k % 11 != 0, F.col("o_custkey") % 5).alias("target"))
    return A.partition_targets(rows, "part", "split", "task", "target")


@query("""WITH r AS (SELECT l_partkey AS p, count(*) AS k FROM lineitem GROUP BY 1), f AS (SELECT p, k, p % 10 = 0 AS gone, p % 10 = 1 AS bad FROM r), m AS (
SELECT 'references' AS measure, NULL AS value, k AS n FROM f UNION ALL SELECT 'paths', CASE WHEN p % 2 = 0 THEN 'absolute' ELSE 'relative' END, 1 FROM f UNION ALL SELECT 'missing', NULL, 1 FROM f WHERE gone UNION ALL SELECT 'unreadable', NULL, 1 FROM f WHERE bad
UNION ALL SELECT 'dimensions', (p % 3) || 'x4', 1 FROM f WHERE NOT gone AND NOT bad UNION ALL SELECT 'modes', 'RGB', 1 FROM f WHERE NOT gone AND NOT bad UNION ALL SELECT 'formats', CASE WHEN p % 4 = 0 THEN 'unknown' ELSE 'PNG' END, 1 FROM f WHERE NOT gone AND NOT bad)
SELECT measure, value, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL""")
def image_audit(spark, d):
    path = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "/i/").otherwise("i/"), F.col(c).cast("string"))
    p = F.col("p_partkey")
    files = table(spark, d, "part").where(p % 10 != 0).select(path("p_partkey").alias("path"), F.when(p % 10 != 1, p % 3).alias("width"), F.lit(4).alias("height"), F.lit("RGB").alias("mode"), F.when(p % 4 != 0, "PNG").alias("format"))
    return A.image_audit(table(spark, d, "lineitem").select("l_suppkey", path("l_partkey").alias("path")), files)


@query("""SELECT o_orderkey AS family, CASE o_orderkey % 6 WHEN 1 THEN 'images' WHEN 2 THEN 'question' WHEN 3 THEN 'answer' WHEN 4 THEN 'status,task' ELSE 'not_evaluable' END AS faults FROM orders WHERE o_orderkey % 6 <> 0""")
def frame_pair_faults(spark, d):
    k, v = F.col("o_orderkey"), F.col("variant")
    first = v == "frame_a"
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.lit("frame_a"), F.when(k % 6 == 5, "frame_c").otherwise("frame_b"))).alias("variant")).select(
        k.alias("family"), "variant", F.when(first | (k % 6 != 1), F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1"))).alias("view_ids"),
        F.concat(F.when(first, "以第1张图为准").otherwise("以第2张图为准"), F.when(~first & (k % 6 == 2), "！").otherwise("。")).alias("question"), F.when(first & (k % 6 == 4), "unknown").otherwise("accepted").alias("status"),
        F.when(first | (k % 6 == 3), "left_of").otherwise("right_of").alias("answer"), F.when(first & (k % 6 == 4), "t").otherwise("u").alias("task"), F.lit("p").alias("program"),
    )
    return A.frame_pair_faults(rows).select("family", F.array_join("faults", ",").alias("faults"))


@query(f"""WITH RECURSIVE {ENTITIES_SQL}, {CANDIDATES_SQL}, c AS (SELECT coalesce(region, -1) AS g, region, subject, reference, relation, m FROM w WHERE m >= 0.5 AND subject < reference),
t(g, k, named, subjects, rels, pick) AS (
  SELECT DISTINCT g, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS STRUCT(s VARCHAR, r VARCHAR, l VARCHAR, m DOUBLE)) FROM c
  UNION ALL
  SELECT g, k + 1, list_concat(named, [b.s, b.r]), list_append(subjects, b.s), list_append(rels, b.l), b FROM (
    SELECT t.g, t.k, any_value(t.named) AS named, any_value(t.subjects) AS subjects, any_value(t.rels) AS rels, arg_min({{'s': CAST(c.subject AS VARCHAR), 'r': CAST(c.reference AS VARCHAR), 'l': c.relation, 'm': c.m}}, row(-round(c.m, 9), c.subject, c.reference, c.relation)) AS b
    FROM t JOIN c USING (g) WHERE t.k < 3 AND NOT list_contains(t.subjects, CAST(c.subject AS VARCHAR)) AND NOT (list_contains(t.named, CAST(c.subject AS VARCHAR)) AND list_contains(t.named, CAST(c.reference AS VARCHAR)))
      AND len(list_filter(t.rels, lambda x: x = c.relation)) < 2 GROUP BY t.g, t.k))
SELECT nullif(g, -1) AS region, k AS place, pick.s AS subject, pick.r AS reference, pick.l AS relation, round(pick.m, 6) AS margin FROM t WHERE k > 0 AND g IN (SELECT g FROM t WHERE k = 2)""")
def layout_facts(spark, d):
    return S.relation_layouts(entities(spark, d)).select("region", "place", F.col("subject").cast("string").alias("subject"), F.col("reference").cast("string").alias("reference"), "relation", F.round("margin", 6).alias("margin"))


@query("""WITH b AS (SELECT o_custkey, max(row(o_orderkey % 5, o_totalprice, o_orderkey)) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, b[3] AS job FROM b""")
def representative_jobs(spark, d):
    jobs = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return S.best_per(jobs, ["o_custkey"], F.struct(F.col("o_orderkey") % 5, "o_totalprice", "o_orderkey"), "o_orderkey").withColumnRenamed("o_orderkey", "job")


@query("""WITH g AS (SELECT l_linestatus AS run, CASE WHEN grouping(l_returnflag) = 1 THEN '' ELSE l_returnflag || '_' END AS p, avg((l_discount >= 0.05)::INT) AS record_accuracy, avg((l_tax > 0.04)::INT) FILTER (l_quantity > 49) AS heldout
  FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_linestatus, l_returnflag)))
SELECT run, p || 'record_accuracy' AS metric, record_accuracy AS value FROM g UNION ALL SELECT run, p || 'heldout', heldout FROM g""")
def scalar_metrics(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "run")
    return E.scalar_metrics(rows, "run", "l_returnflag", {"record_accuracy": (F.expr("l_discount >= 0.05"), F.lit(True)), "heldout": (F.expr("l_tax > 0.04"), F.expr("l_quantity > 49"))})


@query(f"""WITH o AS (SELECT o_orderkey AS key, o_custkey AS c, o_totalprice > 150000 AS a, o_orderstatus = 'F' AS b FROM orders),
c AS (SELECT 'record_accuracy' AS k, c, a, b FROM o UNION ALL SELECT 'heldout_composition', c, a, b FROM o WHERE key % 5 = 0), {BOOTSTRAP_SQL} SELECT k AS endpoint, {ENDS_SQL} FROM e GROUP BY k""")
def bootstrap_endpoints(spark, d):
    rows = table(spark, d, "orders")
    ends = {"record_accuracy": F.lit(True), "heldout_composition": F.col("o_orderkey") % 5 == 0}
    out = E.bootstrap_endpoints(rows, "o_custkey", F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F", ends)
    return out.select("endpoint", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("""SELECT o_orderkey AS comparison_id, CASE o_orderkey % 8 WHEN 1 THEN 'draws,repeats' WHEN 2 THEN 'weight' WHEN 3 THEN 'record' WHEN 5 THEN 'facts' WHEN 6 THEN 'arm' ELSE 'record' END AS faults FROM orders WHERE o_orderkey % 8 NOT IN (0, 4)""")
def comparison_faults(spark, d):
    k, i = F.col("o_orderkey"), F.col("i")
    episode = k % 8 < 4
    times = F.when(k % 8 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    draws = table(spark, d, "orders").select("o_orderkey", F.explode(times).alias("i")).select(
        k.alias("comparison_id"), F.when((k % 8 == 6) & (i == 1), F.lit(None)).when(episode, "episode").otherwise("isolated").alias("arm"),
        F.when(episode | (k % 8 == 7), k).otherwise(k * 10 + i).alias("record_id"), F.when((k % 8 == 3) & (i == 1), "x").otherwise("d").alias("record_sha256"),
        F.when(episode, F.array(k * 10, k * 10 + 1)).when(k % 8 == 5, F.array(k * 10)).otherwise(F.array(k * 10 + i)).alias("fact_ids"), F.when(episode, i).otherwise(0).alias("repeat_index"),
        F.when((k % 8 == 2) & (i == 1), 0.25).when(episode, 0.5).otherwise(1.0).alias("sample_weight"),
    )
    return C.comparison_faults(draws).select("comparison_id", F.array_join("faults", ",").alias("faults"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, conv_id % 5 AS m FROM conversations), f AS (SELECT conv_id AS record_id, turn AS message_index, CASE
  WHEN role = 'assistant' THEN concat_ws(',', CASE WHEN m = 1 THEN 'no_span' END, CASE WHEN m = 4 AND turn IS NOT NULL AND n > 1 THEN 'turn_id' END, CASE WHEN m <> 1 AND coalesce(text, '') = '' THEN 'no_text' END, CASE WHEN m = 2 THEN 'digest' END, CASE WHEN m = 3 THEN 'end' END) ELSE '' END AS faults
  FROM (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS n FROM t))
SELECT * FROM f WHERE faults <> ''""")
def span_faults(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("message_index"), "role", "text")
    m = F.col("record_id") % 5
    spans = turns.where((F.col("role") == "assistant") & (m != 1)).select(
        "record_id", "message_index", F.when(m == 4, "t").otherwise(F.concat(F.lit("t"), F.col("message_index").cast("string"))).alias("turn_id"), F.when(m == 2, "x").otherwise(F.sha2("text", 256)).alias("answer_sha256"), (m != 3).alias("supervise_eos")
    )
    return C.span_faults(spans, turns).select("record_id", "message_index", F.array_join("faults", ",").alias("faults"))


@query("""SELECT 'r' || o_orderkey AS record_id, o_orderstatus AS split, 'system' || chr(10) || 'user' || chr(10) || 'assistant' AS roles, 's|' || o_orderpriority || '?|<cue>c</cue><reasoning>r</reasoning><answer>' || o_orderpriority || '</answer>' AS said, 2 AS n_images, 'cue,transform,answer' AS spans FROM orders""")
def sft_records(spark, d):
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"), F.lit("t").alias("task_id"), F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("base_fact_id"), F.lit("s").alias("system"),
        F.array(F.lit("a.png"), F.lit("b.png")).alias("images"), F.concat("o_orderpriority", F.lit("?")).alias("question"), F.lit("c").alias("cue"), F.lit("r").alias("reasoning"), F.col("o_orderpriority").alias("answer"),
    )
    m = F.col("messages")
    said = F.array_join(F.transform(m, lambda x: T.message_text(x["content"])), "|")
    return L.sft_records(rows, "grounded_cot").select(
        "record_id", "split", F.array_join(F.transform(m, lambda x: x["role"]), "\n").alias("roles"), said.alias("said"), F.size(T.message_images(m[1]["content"])).alias("n_images"), F.array_join("role_spans", ",").alias("spans")
    )


@query("""SELECT 'rlvr-' || substr(sha256('rlvr' || chr(31) || o_custkey || chr(31) || o_orderkey), 1, 20) AS record_id, o_orderpriority AS said, 'system,user' AS roles, CASE WHEN o_orderkey % 2 = 0 THEN 'numeric_tolerance' ELSE 'exact' END AS rule,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.2 END END AS tolerance FROM orders WHERE o_orderstatus = 'F'""")
def rlvr_records(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("scene_id"), F.col("o_custkey").alias("episode_id"), k.alias("fact_id"), F.lit("canonical").alias("family_variant"), F.lit("").alias("consistency_group"), F.lit("p").alias("program_id"), F.when(F.col("o_orderstatus") == "F", "train").otherwise("val").alias("split"),
        F.array(F.lit("v.png")).alias("view_ids"), F.col("o_orderpriority").alias("question"), F.when(k % 2 == 0, "number").otherwise("string").alias("answer_kind"), F.when(k % 3 == 0, 0.5).alias("tolerance"),
    )
    out = L.rlvr_records(rows, "s")
    return out.select("record_id", T.message_text(F.col("prompt")[1]["content"]).alias("said"), F.array_join(F.transform("prompt", lambda x: x["role"]), ",").alias("roles"), F.col("reward.rule").alias("rule"), F.col("reward.tolerance").alias("tolerance"))


@query("""WITH r AS (SELECT o_custkey AS b, CASE WHEN o_orderkey % 9 = 0 THEN 'composition_heldout' ELSE 'train_candidate' END AS disposition, o_orderkey % 9 = 0 OR o_orderkey % 90 = 1 AS held, o_orderkey % 50 <> 3 AS ok, ['PT', 'SR', 'MM', 'AUX', 'PT'][o_orderkey % 5 + 1] AS cap, o_orderkey % 70 <> 5 AS train FROM orders),
g AS (SELECT b, count(*) FILTER (disposition = 'train_candidate') AS n, coalesce(list_sort(list_distinct(list(cap) FILTER (disposition = 'train_candidate' AND cap <> 'AUX'))), []) AS caps, count(*) FILTER (disposition = 'train_candidate' AND cap = 'AUX') AS aux,
  count(*) FILTER (disposition = 'train_candidate' AND NOT ok) AS bad, count(*) FILTER (disposition = 'train_candidate' AND NOT train) AS other, count(*) FILTER (held <> (disposition = 'composition_heldout')) AS lost FROM r GROUP BY b),
f AS (SELECT b, n, array_to_string(caps, ',') AS capabilities, concat_ws(',', CASE WHEN bad > 0 THEN 'gates' END, CASE WHEN n NOT BETWEEN 4 AND 6 THEN 'question_count' END, CASE WHEN len(caps) < 3 THEN 'capabilities' END, CASE WHEN NOT list_contains(caps, 'PT') THEN 'backbone' END,
  CASE WHEN aux > 1 THEN 'auxiliary' END, CASE WHEN other > 0 THEN 'split' END, CASE WHEN lost > 0 THEN 'held_out' END) AS failed FROM g)
SELECT b AS batch, n > 0 AND failed = '' AS eligible, n AS n_questions, capabilities, failed FROM f""")
def optimizer_decisions(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("batch"), F.when(k % 9 == 0, "composition_heldout").otherwise("train_candidate").alias("disposition"), F.when((k % 9 == 0) | (k % 90 == 1), "held").otherwise("p").alias("program_id"),
        (k % 50 != 3).alias("passed"), F.get(F.array(*map(F.lit, ("PT", "SR", "MM", "AUX", "PT"))), (k % 5).cast("int")).alias("capability"), F.when(k % 70 != 5, "train").otherwise("val").alias("split"),
    )
    return L.optimizer_decisions(rows, ("held",)).withColumn("capabilities", F.array_join("capabilities", ",")).withColumn("failed", F.array_join("failed", ","))


@query("""SELECT 'parts' AS file_set, count(*) AS n_files, sha256('parts' || chr(10) || string_agg('{"path":"' || n_name || '"}:' || n_nationkey || ':' || sha256(n_name), chr(10) ORDER BY '{"path":"' || n_name || '"}:' || n_nationkey || ':' || sha256(n_name))) AS sha256 FROM nation""")
def file_binding(spark, d):
    files = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.col("n_nationkey").alias("bytes"), F.sha2("n_name", 256).alias("sha256"))
    return L.file_binding(files, "parts")
