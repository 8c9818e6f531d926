"""Claim sheets of questions, and texts held to them: nothing may be said that no claim allows.

A claim is a row (question_id, claim, value, views): a named statement, its
value as text, and the views that show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.plans.durable import parts


def number(value: Column, digits: int = 2) -> Column:
    """A measure as it may be said: so many digits at most, no trailing zeros."""
    said = F.round(value, digits).cast(f"decimal(20, {digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(said, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def relation_claims(rows: DataFrame, evidence: Column) -> DataFrame:
    """Claims of relations (subject, reference, relation, margin, distance), numbered by a stable id; evidence: array of views."""
    qid = F.concat_ws(":", F.col("subject").cast("string"), F.col("reference").cast("string"), F.col("relation"))
    made = F.array(*[F.struct(F.lit(n).alias("claim"), v.alias("value")) for n, v in (("relation", F.col("relation")), ("margin_m", number(F.col("margin"))), ("distance_m", number(F.col("distance"))))])
    return rows.select(qid.alias("question_id"), evidence.alias("views"), F.explode(made).alias("c")).select("question_id", "c.claim", "c.value", "views")


def sighting_claims(first_last: DataFrame) -> DataFrame:
    """Claims of an entity's first and last view (episode, entity, first_step, last_step)."""
    qid = F.concat_ws(":", F.col("episode").cast("string"), F.col("entity"))
    one = lambda n, c: F.struct(F.lit(n).alias("claim"), (F.col(c) + 1).cast("string").alias("value"), F.array(c).alias("views"))
    return first_last.select(qid.alias("question_id"), F.explode(F.array(one("first_view", "first_step"), one("last_view", "last_step"))).alias("c")).select("question_id", "c.*")


def sheet(claims: DataFrame) -> DataFrame:
    """One row a question: its claims as a map, and all views that they need."""
    return claims.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("claim", "value")))).alias("claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("views")))).alias("views"))


def unexposed(sheets: DataFrame, exposed: DataFrame) -> DataFrame:
    """Views that a sheet needs and its question does not show: (question_id, view). exposed: (question_id, view)."""
    need = sheets.select("question_id", F.explode("views").alias("view"))
    return need.join(exposed, ["question_id", "view"], "left_anti")


def blueprint(sheets: DataFrame, template: str, hidden: tuple[str, ...]) -> DataFrame:
    """Answer-blind slots: the template and the claims that may be filled in, without the hidden ones."""
    shown = F.map_filter("claims", lambda k, v: ~k.isin(*hidden))
    return sheets.select("question_id", F.lit(template).alias("template"), shown.alias("slots"))


def text_faults(texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """What texts (question_id, text) say beyond their sheet: (question_id, fault, said).

    Numbers must be values of claims; directions must be the claimed relation.
    """
    joined = texts.join(sheets, "question_id", "left")
    values = F.coalesce(F.map_values("claims"), F.array().cast("array<string>"))
    numbers = F.transform(T.unlisted_numbers(F.col("text"), values), lambda x: F.struct(F.lit("unlisted_number").alias("fault"), x.alias("said")))
    words = F.transform(values, lambda v: F.replace(v, F.lit("_"), F.lit(" ")))
    said = F.array_distinct(T.directions_in(F.replace(F.col("text"), F.lit("_"), F.lit(" "))))
    directions = F.transform(F.array_except(said, words), lambda x: F.struct(F.lit("unclaimed_direction").alias("fault"), x.alias("said")))
    unknown = F.when(F.col("claims").isNull(), F.array(F.struct(F.lit("no_sheet").alias("fault"), F.lit("").alias("said")))).otherwise(F.concat(numbers, directions))
    return joined.select("question_id", F.explode(unknown).alias("f")).select("question_id", "f.*")


def related(facts: DataFrame, group: str, fact: str) -> DataFrame:
    """Pairs of different facts of one family; a family has a few variants."""
    a, b = facts.select(group, F.col(fact).alias("fact")), facts.select(group, F.col(fact).alias("related"))
    return a.where(F.col(group).isNotNull()).join(b, group).where("fact <> related").select("fact", "related")


def linked_by_pair(questions: DataFrame, proofs: DataFrame, a: str, b: str) -> DataFrame:
    """Questions with the proof of the same unordered pair (proofs: a, b, proof), the smallest of several."""
    low, high = F.least(a, b), F.greatest(a, b)
    p = proofs.groupBy(low.alias("lo"), high.alias("hi")).agg(F.min("proof").alias("proof"))
    return questions.withColumn("lo", low).withColumn("hi", high).join(p, ["lo", "hi"], "left").drop("lo", "hi")


def excluded_families(facts: DataFrame, excluded: DataFrame, group: str, fact: str) -> DataFrame:
    """Excluded facts with all siblings of their families. Joins have as many tasks as the facts need."""
    n = parts(facts)
    named = facts.select(group, fact).repartition(n, fact)
    own = named.join(excluded.select(fact).repartition(n, fact).distinct(), fact, "left_semi")
    groups = own.where(F.col(group).isNotNull()).select(group).repartition(n, group).distinct()
    siblings = facts.select(group, fact).repartition(n, group).join(groups, group, "left_semi").select(fact)
    return own.select(fact).distinct().union(siblings.distinct()).distinct()
