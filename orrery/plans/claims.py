"""Queries of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import claims as C
from orrery.operators import visibility as V
from orrery.plans.registry import SIGHTINGS_SQL, query, sightings, table


@query(f"""WITH {SIGHTINGS_SQL}, f AS (SELECT episode, entity, min(step) AS a, max(step) AS b FROM sightings GROUP BY ALL)
SELECT episode || ':' || entity AS question_id, 'first_view' AS claim, CAST(a + 1 AS VARCHAR) AS value FROM f UNION ALL SELECT episode || ':' || entity, 'last_view', CAST(b + 1 AS VARCHAR) FROM f""")
def sighting_claims(spark, d):
    return C.sighting_claims(V.beliefs(sightings(spark, d))).drop("views")


@query(f"""WITH {SIGHTINGS_SQL}, f AS (SELECT episode, entity, min(step) AS a, max(step) AS b FROM sightings GROUP BY ALL)
SELECT episode || ':' || entity AS question_id, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS views, '{{{{last_view}}}} of {{{{first_view}}}}' AS template, 'first_view' AS slots FROM f""")
def claim_sheets(spark, d):
    sheets = C.sheet(C.sighting_claims(V.beliefs(sightings(spark, d))))
    b = C.blueprint(sheets, "{{last_view}} of {{first_view}}", ("last_view",))
    views = sheets.select("question_id", F.array_join(F.col("views").cast("array<string>"), ",").alias("views"))
    return b.select("question_id", "template", F.array_join(F.map_keys("slots"), ",").alias("slots")).join(views, "question_id")


@query(f"""WITH {SIGHTINGS_SQL}, f AS (SELECT episode, entity, min(step) AS a, max(step) AS b FROM sightings GROUP BY ALL), q AS (SELECT episode || ':' || entity AS question_id, a + 1 AS x, b + 1 AS y FROM f)
SELECT question_id, 'unlisted_number' AS fault, '7' AS said FROM q WHERE x <> 7 AND y <> 7 UNION ALL SELECT question_id, 'unclaimed_direction', 'left of' FROM q""")
def claim_text_faults(spark, d):
    claims = C.sighting_claims(V.beliefs(sightings(spark, d)))
    said = F.concat(F.lit("first in view "), F.col("claims")["first_view"], F.lit(", then in 7, left_of the door"))
    sheets = C.sheet(claims)
    return C.text_faults(sheets.select("question_id", said.alias("text")), sheets)


@query("SELECT a.l_suppkey * 100000 + a.l_partkey AS fact, b.l_suppkey * 100000 + b.l_partkey AS related FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey * 100000 + a.l_partkey <> b.l_suppkey * 100000 + b.l_partkey")
def related_facts(spark, d):
    return C.related(table(spark, d, "lineitem").withColumn("f", F.col("l_suppkey") * 100000 + F.col("l_partkey")), "l_orderkey", "f")


@query("""WITH x AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49), g AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (FROM x))
SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IN (FROM x) OR l_orderkey IN (FROM g)""")
def excluded_families(spark, d):
    rows = table(spark, d, "lineitem")
    return C.excluded_families(rows, rows.where("l_quantity > 49"), "l_orderkey", "l_partkey")
