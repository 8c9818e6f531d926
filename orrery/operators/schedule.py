"""Paired training schedules with exact rational weights, and message accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.ids import hash_rank_key
from orrery.plans.durable import parts


def arm_pairs(a: DataFrame, b: DataFrame, key: str, fact: str) -> DataFrame:
    """Comparisons of two arms: numbers of records, whether both hold the same multiset of facts.

    Facts are counted in one pass over both arms, in as many tasks as the rows
    need, so no list of facts is built and no arm is joined with the other. A
    null fact or key matches none of the other arm.
    """
    arms = a.select(key, fact, F.lit(1).alias("left")).unionAll(b.select(key, fact, F.lit(0).alias("left")))
    alone = F.when(F.col(key).isNull() | F.col(fact).isNull(), F.col("left"))
    dealt = arms.withColumn("alone", alone).repartition(parts(arms), key, fact)
    counts = dealt.groupBy(key, fact, "alone").agg(F.sum("left").alias("na"), F.sum(1 - F.col("left")).alias("nb"))
    return counts.groupBy(key).agg(F.sum("na").alias("n_left"), F.sum("nb").alias("n_right"), F.bool_and(F.col("na") == F.col("nb")).alias("same_facts"))


def expanded(records: DataFrame, repeats: str, regime: str, salt: str, record: str = "record_id", weighted: bool = True) -> DataFrame:
    """Each record `repeats` times with weight 1/repeats, as (weight_num, weight_den), in hash order: schedule_rank to order by.

    The rank is the hash itself, so no sort of all draws is needed to fix it.
    """
    draws = records.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col(repeats) - 1)))
    rank = hash_rank_key(salt, F.lit(regime), F.col(record), F.col("repeat_index"))
    den = F.col(repeats) if weighted else F.lit(1)
    return draws.withColumn("weight_num", F.lit(1).cast("long")).withColumn("weight_den", den.cast("long")).withColumn("schedule_rank", rank)


def fact_weights(draws: DataFrame, fact: str, lcm: int) -> DataFrame:
    """Each fact's weight as a whole number of 1/lcm: exact where every denominator divides lcm."""
    share = F.col("weight_num") * F.lit(lcm) / F.col("weight_den")
    whole = F.col("weight_num") * F.lit(lcm) % F.col("weight_den") == 0
    return draws.groupBy(fact).agg(F.sum(share.cast("long")).alias("weight"), F.lit(lcm).cast("long").alias("unit"), F.bool_and(whole).alias("exact"))


def draw_order(draws: DataFrame, key: str) -> DataFrame:
    """schedule_index of each draw under a key, from 0."""
    return draws.withColumn("schedule_index", F.row_number().over(W.partitionBy(key).orderBy("schedule_rank")) - 1)


def pixel_exposure(occurrences: DataFrame, sizes: DataFrame, key: str, path: str) -> DataFrame:
    """Sum of width times height over occurrences; null if a size is unknown."""
    joined = occurrences.join(sizes, path, "left")
    area = F.col("width").cast("long") * F.col("height")
    return joined.groupBy(key).agg(F.count("*").alias("n_images"), F.when(F.count("*") == F.count(area), F.sum(area)).alias("pixels"))


#: A run of letters or digits of a script with word breaks, or one character of another kind.
_TOKEN = r"[A-Za-z]+|\d+|[一-鿿]|[^\sA-Za-z\d一-鿿]"


def token_proxy(text: Column) -> Column:
    """Lexemes of a text: words, numbers, and single other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def message_accounting(turns: DataFrame, key: str, role: str, text: str) -> DataFrame:
    return turns.groupBy(key).agg(
        F.count("*").alias("n_turns"), F.count_if(F.col(role) == "assistant").alias("n_replies"), F.sum(F.length(text)).alias("n_chars"), F.sum(token_proxy(F.col(text))).alias("n_lexemes")
    )


def answer_segments(turns: DataFrame, text: str, *keys: str) -> DataFrame:
    """Lines of a reply with their spans in code points: (keys.., line, start, end)."""
    lines = turns.select(*keys, F.split(text, "\n").alias("lines"))
    ends = F.aggregate("lines", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x) + 1))
    rows = lines.withColumn("starts", ends).select(*keys, "starts", F.posexplode("lines").alias("line", "content"))
    start = F.get("starts", F.col("line"))
    return rows.select(*keys, "line", start.alias("start"), (start + F.length("content")).alias("end"))


def comparison_faults(draws: DataFrame) -> DataFrame:
    """Comparisons that are no whole unit of training: (comparison_id, faults).

    draws: (comparison_id, arm, record_id, record_sha256, fact_ids, repeat_index, sample_weight). An episode is one record drawn
    as often as it has facts, repeats numbered from 0, at weights of one over that number. An isolated comparison is
    records of one fact each, none twice, drawn once at weight one.
    """
    k, near = F.size("fact_ids"), lambda a, b: F.abs(a - b) <= 1e-12
    per = draws.groupBy("comparison_id").agg(
        F.count_distinct("arm").alias("arms"), F.count("arm").alias("with_arm"), F.min("arm").alias("arm"), F.count("*").alias("n"), F.count_distinct("record_id").alias("records"),
        F.count_distinct(F.struct("record_id", "record_sha256")).alias("contents"), F.count_distinct("fact_ids").alias("lists"), F.max(k).alias("k"), F.min(k).alias("least_k"),
        F.count_distinct("repeat_index").alias("repeats"), F.min("repeat_index").alias("first"), F.max("repeat_index").alias("last"), F.count_distinct(F.get("fact_ids", F.lit(0))).alias("facts"),
        F.bool_and(F.coalesce(near(F.col("sample_weight"), 1 / k), F.lit(False))).alias("shares"), F.bool_and(F.coalesce(near(F.col("sample_weight"), F.lit(1.0)), F.lit(False))).alias("ones"),
    )
    known = (F.col("arms") == 1) & (F.col("with_arm") == F.col("n")) & F.col("arm").isin("episode", "isolated")
    episode, isolated = known & (F.col("arm") == "episode"), known & (F.col("arm") == "isolated")
    numbered = (F.col("repeats") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    faults = F.array_compact(F.array(
        F.when(~known, "arm"), F.when(episode & (F.col("n") != F.col("k")), "draws"), F.when(episode & ~F.coalesce(numbered, F.lit(False)), "repeats"),
        F.when(episode & (F.col("contents") != 1), "record"), F.when(episode & (F.col("lists") != 1), "facts"), F.when(episode & ~F.col("shares"), "weight"),
        F.when(isolated & (F.col("records") != F.col("n")), "record"), F.when(isolated & ((F.col("k") != 1) | (F.col("least_k") != 1) | (F.col("facts") != F.col("n"))), "facts"),
        F.when(isolated & ~F.coalesce((F.col("first") == 0) & (F.col("last") == 0), F.lit(False)), "repeats"), F.when(isolated & ~F.col("ones"), "weight"),
    ))
    return per.select("comparison_id", faults.alias("faults")).where(F.size("faults") > 0)


def span_faults(spans: DataFrame, messages: DataFrame) -> DataFrame:
    """Assistant turns and the spans that claim them, where they disagree: (record_id, message_index, faults).

    spans: (record_id, message_index, turn_id, answer_sha256, supervise_eos); messages: (record_id, message_index, role, text).
    Each assistant message has one span of its own turn id, with the digest of its text and its end supervised.
    """
    keys = ["record_id", "message_index"]
    ids = spans.groupBy("record_id", "turn_id").agg(F.count("*").alias("n_turn"))
    claimed = spans.join(ids, ["record_id", "turn_id"], "left").groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("turn_id") == "", F.lit(True)) | (F.coalesce("n_turn", F.lit(1)) > 1)).alias("bad_turn"),
        F.min("answer_sha256").alias("sha"), F.count("answer_sha256").alias("n_sha"), F.bool_and(F.coalesce("supervise_eos", F.lit(False))).alias("eos"),
    )
    both = claimed.join(messages.select(*keys, "role", "text"), keys, "full")
    reply, has = F.col("role") == "assistant", F.col("n").isNotNull()
    faults = F.array_compact(F.array(
        F.when(reply & ~has, "no_span"), F.when(has & ~F.coalesce(reply, F.lit(False)), "not_assistant"), F.when(F.col("n") > 1, "repeated"), F.when(F.col("bad_turn"), "turn_id"),
        F.when(has & reply & F.coalesce(F.col("text") == "", F.lit(True)), "no_text"), F.when(has & reply & ~F.equal_null("sha", F.sha2("text", 256)), "digest"), F.when(has & ~F.col("eos"), "end"),
    ))
    return both.select(*keys, faults.alias("faults")).where(F.size("faults") > 0)
