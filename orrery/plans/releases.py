"""Queries of witnesses, exports, release checks and dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import dialogue as D
from orrery.operators import release as L
from orrery.operators import witness as N
from orrery.plans.registry import SIGHTINGS_SQL, query, sightings, table

_S = f"WITH {SIGHTINGS_SQL}"


@query(f"""{_S} SELECT episode, entity, step FROM sightings QUALIFY row_number() OVER (PARTITION BY episode, entity ORDER BY (step % 4 = 0), pixels DESC, step) = 1""")
def clean_witness(spark, d):
    s = sightings(spark, d).withColumn("border", F.col("step") % 4 == 0).withColumn("outer_share", F.lit(0.0)).withColumn("min_side", F.lit(1))
    return N.best_witness(s)


@query(f"{_S} SELECT episode, entity, min(step) AS step FROM sightings WHERE pixels >= 40 GROUP BY ALL")
def well_seen(spark, d):
    return N.well_seen(sightings(spark, d), 40)


_MASKS = """m AS (SELECT l_orderkey AS episode, l_linenumber AS step, l_partkey AS entity, l_returnflag AS label, l_quantity AS pixels FROM lineitem)"""


def _masks(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as episode", "l_linenumber as step", "l_partkey as entity", "l_returnflag as label", "l_quantity as pixels")


@query(f"""WITH {_MASKS}, n AS (SELECT episode, label, count(DISTINCT entity) AS n FROM m GROUP BY ALL),
a AS (SELECT episode, step, label, min(entity) AS entity FROM m GROUP BY ALL HAVING count(DISTINCT entity) = 1),
f AS (SELECT episode, entity, label, min(step) AS s FROM a GROUP BY ALL)
SELECT episode, entity, label, CASE WHEN n > 1 THEN s END AS step, 'the ' || label || CASE WHEN n > 1 THEN ' in image ' || (s + 1) ELSE '' END AS phrase FROM f JOIN n USING (episode, label)""")
def entity_references(spark, d):
    return N.references(_masks(spark, d)).withColumn("phrase", N.reference_phrase(F.col("label"), F.col("step")))


@query(f"""WITH {_MASKS}, g AS (SELECT *, CASE WHEN label IN ('A', 'R') THEN 'seat' ELSE label END AS grp FROM m)
SELECT episode, step, grp AS "group", min(entity) AS entity FROM g GROUP BY ALL HAVING count(DISTINCT entity) = 1""")
def unambiguous_bindings(spark, d):
    groups = spark.createDataFrame([("A", "seat"), ("R", "seat")], "label string, group string")
    return N.unambiguous(N.grouped_labels(_masks(spark, d), groups))


@query(f"""WITH {_MASKS}, w AS (SELECT DISTINCT episode, step, unnest(['A', 'N', 'R']) AS grp FROM m)
SELECT episode, step, grp AS "group" FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode = w.episode AND m.step = w.step AND m.label = w.grp AND m.pixels >= 10)""")
def absent_categories(spark, d):
    m = _masks(spark, d).withColumn("group", F.col("label")).withColumn("min_side", F.lit(0))
    wanted = m.select("episode", "step").distinct().select("episode", "step", F.explode(F.array(*map(F.lit, "ANR"))).alias("group"))
    return N.absent_categories(m, wanted, 10)


@query("""WITH t AS (SELECT l_orderkey AS scene, l_linenumber AS view, l_quantity AS x, l_tax * 100 AS y FROM lineitem WHERE l_linestatus = 'O'), s AS (SELECT l_orderkey AS scene, l_linenumber AS source, l_quantity AS x, l_tax * 100 AS y FROM lineitem WHERE l_linestatus = 'F')
SELECT scene, view, source, round(round(sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2), 9), 6) AS distance FROM t JOIN s USING (scene) QUALIFY row_number() OVER (PARTITION BY scene, view ORDER BY round(sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2), 9), source) = 1""")
def nearest_source_views(spark, d):
    v = table(spark, d, "lineitem").selectExpr("l_orderkey as scene", "l_linenumber as view", "l_linenumber as step", "l_quantity as x", "l_tax * 100 as y", "l_linestatus as st")
    return N.nearest_sources(v.where("st = 'O'"), v.where("st = 'F'")).withColumn("distance", F.round("distance", 6))


@query(f"""{_S}, y AS (SELECT episode, step, CAST((step * 53) % 360 AS DOUBLE) AS yaw, entity AS s, CASE WHEN step % 3 = 0 THEN 'left_of' ELSE 'right_of' END AS rel FROM sightings),
p AS (SELECT a.episode, a.s, a.step AS a, b.step AS b, abs((((a.yaw - b.yaw + 180) % 360) + 360) % 360 - 180) AS t, a.rel AS ra, b.rel AS rb FROM y a JOIN y b ON a.episode = b.episode AND a.s = b.s AND a.step < b.step AND a.rel <> b.rel)
SELECT episode, s AS subject, a, b, t AS turn_deg, ra AS relation_a, rb AS relation_b FROM p WHERE t >= 30 QUALIFY row_number() OVER (PARTITION BY episode, s ORDER BY t DESC, a, b) = 1""")
def frame_pairs(spark, d):
    v = sightings(spark, d).selectExpr("episode", "step", "cast(step * 53 % 360 as double) as yaw_deg", "entity as subject", "'camera' as reference", "if(step % 3 = 0, 'left_of', 'right_of') as relation")
    return N.frame_pairs(v).drop("reference")


@query("""SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) AS INT) AS n_variants, count(DISTINCT l_returnflag) = 3 AS complete FROM lineitem GROUP BY 1""")
def sibling_check(spark, d):
    return L.sibling_check(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ("A", "N", "R"))


@query("SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linestatus) = 2")
def common_query_keys(spark, d):
    return L.common_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus", "l_suppkey", 2)


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS a FROM orders GROUP BY ALL), b AS (SELECT o_custkey, a AS base FROM r WHERE o_orderpriority = '1-URGENT')
SELECT o_orderpriority, count(*) AS n, round(avg((a = base)::INT), 9) AS same_rate FROM r JOIN b USING (o_custkey) WHERE o_orderpriority <> '1-URGENT' GROUP BY 1""")
def semantic_rates(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderstatus").alias("a"))
    return L.semantic_rates(rows, "o_custkey", "o_orderpriority", "a", "1-URGENT").withColumn("same_rate", F.round("same_rate", 9))


@query("SELECT shape, count(*) AS n FROM (SELECT string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS shape FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def family_shapes(spark, d):
    return L.family_shapes(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT count(*) AS n_rows, CAST(sum((o_totalprice > 200000)::INT) AS BIGINT) AS n_large, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders")
def release_statistics(spark, d):
    return L.statistics(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], {"n_large": F.col("o_totalprice") > 200000})


@query("""SELECT 'o_orderstatus' AS "grouping", o_orderstatus AS key, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderstatus/o_orderpriority', o_orderstatus || '/' || o_orderpriority, count(*) FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def packet_strata(spark, d):
    return L.strata(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


_QUESTIONS = """q AS (SELECT l_orderkey AS comparison_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id, l_returnflag AS program_id, 'q' || l_partkey AS question, 'a' || l_suppkey AS answer, l_quantity AS priority FROM lineitem)"""


def _questions(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as comparison_id", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as fact_id", "l_returnflag as program_id", "concat('q', l_partkey) as question", "concat('a', l_suppkey) as answer", "l_quantity as priority")


@query(f"WITH {_QUESTIONS} SELECT 'iso-' || fact_id AS record_id, comparison_id, question, answer FROM q WHERE program_id <> 'R'")
def isolated_records(spark, d):
    return L.isolated_records(_questions(spark, d), ("R",)).drop("fact_ids")


@query(f"""WITH {_QUESTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY priority, fact_id) AS k FROM q)
SELECT 'ep-' || comparison_id AS record_id, string_agg(k || '. ' || question, chr(10) ORDER BY k, fact_id, question, answer) AS question, string_agg(k || '. ' || answer, chr(10) ORDER BY k, fact_id, question, answer) AS answer FROM n WHERE k <= 4 GROUP BY comparison_id""")
def episode_records(spark, d):
    return L.episode_records(_questions(spark, d), 4).select("record_id", "question", "answer")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CASE WHEN abs(c_acctbal / 50) >= 175 THEN 'turn around' WHEN abs(c_acctbal / 50) < 5 THEN 'keep facing ahead' ELSE 'turn right by ' || CAST(round_even(c_acctbal / 50, 0) AS INT) || ' degrees' END ELSE CASE WHEN abs(c_acctbal / 50) < 5 THEN 'keep facing ahead' ELSE 'turn left by ' || CAST(round_even(abs(c_acctbal / 50), 0) AS INT) || ' degrees' END END AS phrase FROM customer")
def turn_phrases(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.turn_phrase(F.col("c_acctbal") / 50).alias("phrase"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(p_name, '\\bbolt\\b') THEN 'bolt' END, CASE WHEN regexp_matches(p_name, '\\bring\\b') THEN 'ring' END], lambda x: x IS NOT NULL)), ',') AS hits FROM part")
def lexicon_hits(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.lexicon_hits(F.col("p_name"), ("ring", "bolt")), ",").alias("hits"))


@query(f"""{_S}, v AS (SELECT DISTINCT episode, step, step // 2 AS r FROM sightings)
SELECT episode, CAST(r AS INT) AS round, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS released, CAST(max(count(*)) OVER (PARTITION BY episode, r) AS INT) AS n_released FROM v GROUP BY episode, r""")
def dialogue_releases(spark, d):
    out = D.releases(sightings(spark, d))
    return out.select("episode", "round", F.array_join(F.col("released").cast("array<string>"), ",").alias("released"), F.size("released").alias("n_released"))


@query(f"""{_S}, a AS (SELECT *, step // 2 AS r FROM sightings), k AS (SELECT DISTINCT episode, r FROM a),
l AS (SELECT k.episode, k.r, a.entity, max(a.step) AS evidence FROM k JOIN a ON a.episode = k.episode AND a.r < k.r GROUP BY ALL)
SELECT episode, CAST(r AS INT) AS round, 'last_seen_memory' AS task_type, entity, evidence FROM l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.episode = l.episode AND a.r = l.r AND a.entity = l.entity)
QUALIFY row_number() OVER (PARTITION BY episode, r ORDER BY entity) = 1""")
def memory_rounds(spark, d):
    return D.memory_rounds(sightings(spark, d))


@query(f"""{_S}, f AS (SELECT episode, entity, min(step) // 2 AS r FROM sightings GROUP BY ALL), g AS (SELECT episode, r, string_agg(entity, ',' ORDER BY entity) AS entered, count(*) AS n FROM f GROUP BY ALL)
SELECT episode, CAST(r AS INT) AS round, entered, CAST(coalesce(sum(n) OVER (PARTITION BY episode ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS n_known_before FROM g""")
def entry_rounds(spark, d):
    return D.entry_rounds(sightings(spark, d)).withColumn("entered", F.array_join("entered", ","))
