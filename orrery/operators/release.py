"""Release tables: exports with answers kept apart, statistics, sibling completeness, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content(text: Column, images: Column) -> Column:
    """A message's content: its images, then its text."""
    none = F.lit(None).cast("string")
    pictures = F.transform(images, lambda i: F.struct(F.lit("image").alias("type"), none.alias("text"), i.alias("image")))
    return F.concat(pictures, F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("image"))))


def isolated_records(questions: DataFrame, held_out: tuple[str, ...] = ()) -> DataFrame:
    """One training record a question: (record_id, comparison_id, fact_ids, question, answer)."""
    kept = questions.where(~F.col("program_id").isin(*held_out)) if held_out else questions
    return kept.select(F.concat(F.lit("iso-"), F.col("fact_id").cast("string")).alias("record_id"), "comparison_id", F.array("fact_id").alias("fact_ids"), "question", "answer")


def episode_records(questions: DataFrame, most: int = 6, held_out: tuple[str, ...] = ()) -> DataFrame:
    """One record for each comparison group, its questions numbered; `most` bounds a group."""
    from orrery.operators.questions import grouped

    kept = questions.where(~F.col("program_id").isin(*held_out)) if held_out else questions
    few = grouped(kept, ["comparison_id"], F.col("priority"), most)
    items = F.array_sort(F.collect_list(F.struct("place", "fact_id", "question", "answer")))
    line = lambda c: F.array_join(F.transform("q", lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x[c])), "\n")
    rows = few.groupBy("comparison_id").agg(items.alias("q"))
    return rows.select(F.concat(F.lit("ep-"), F.col("comparison_id").cast("string")).alias("record_id"), "comparison_id", F.transform("q", lambda x: x["fact_id"]).alias("fact_ids"), line("question").alias("question"), line("answer").alias("answer"))


def benchmark_export(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs and oracle of what is not for training, sharing the record id alone."""
    rows = questions.where((F.col("split") != "train") & ~F.coalesce(F.col("training_only"), F.lit(False)))
    return rows.select("record_id", "split", "question"), rows.select("record_id", "answer", "task_type")


def oracle_predictions(oracle: DataFrame) -> DataFrame:
    """The answers as predictions: every metric on them is 1."""
    return oracle.select("record_id", F.col("answer").alias("answer_value"))


def state_records(states: DataFrame, bad_frames: DataFrame) -> DataFrame:
    """Observable states of episodes none of whose frames is bad."""
    return states.join(bad_frames.select("episode").distinct(), "episode", "left_anti")


def sibling_check(rows: DataFrame, family: str, variant: str, expected: tuple[str, ...]) -> DataFrame:
    """Families and which expected variants they lack: (family, n_variants, complete)."""
    flags = [F.max((F.col(variant) == v).cast("int")).alias(f"v{i}") for i, v in enumerate(expected)]
    per = rows.groupBy(family).agg(*flags)
    n = sum((F.coalesce(F.col(f"v{i}"), F.lit(0)) for i in range(len(expected))), F.lit(0))
    return per.select(family, n.alias("n_variants"), (n == len(expected)).alias("complete"))


def common_keys(rows: DataFrame, group: str, variant: str, key: str, n: int) -> DataFrame:
    """Query keys that all n variants of a group have."""
    return rows.groupBy(group, key).agg(F.count_distinct(variant).alias("k")).where(F.col("k") == n).drop("k")


def semantic_rates(rows: DataFrame, group: str, variant: str, answer: str, canonical: str) -> DataFrame:
    """For each other variant, the share of groups whose answer is the canonical one's: (variant, n, same_rate)."""
    base = rows.where(F.col(variant) == canonical).select(group, F.col(answer).alias("base"))
    other = rows.where(F.col(variant) != canonical).join(base, group)
    return other.groupBy(variant).agg(F.count("*").alias("n"), F.avg((F.col(answer) == F.col("base")).cast("int")).alias("same_rate"))


def family_shapes(rows: DataFrame, group: str, variant: str) -> DataFrame:
    """How many families have which set of variants."""
    shape = rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(variant)), "+").alias("shape"))
    return shape.groupBy("shape").agg(F.count("*").alias("n"))


def statistics(rows: DataFrame, distinct: list[str], counted: dict[str, Column]) -> DataFrame:
    """One row: n_rows, n_<column> distinct values, and named counts of conditions.

    Distinct values are found by one group-by of exploded (column, value)
    pairs, whose repeats are dropped before the shuffle.
    """
    marks = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in distinct])
    values = rows.select(F.explode(marks).alias("m")).select("m.c", "m.v").where("v is not null").distinct().groupBy("c").agg(F.count("*").alias("n"))
    wide = values.groupBy().pivot("c", distinct).agg(F.first("n"))
    plain = rows.agg(F.count("*").alias("n_rows"), *[F.count_if(cond).alias(name) for name, cond in counted.items()])
    wide = wide.select(*[F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}") for c in distinct])
    return plain.join(wide, F.lit(True))  # one row on either side


def strata(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone and by all together: (grouping, key, n)."""
    cols = [F.col(c) for c in dims]
    out = rows.groupingSets([[c] for c in cols] + [cols], *cols).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in dims])
    used = F.array_compact(F.array(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in dims]))
    key = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"g_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in dims])), "/")
    return out.select(F.array_join(used, "/").alias("grouping"), key.alias("key"), "n")


def capabilities(rows: DataFrame, key: str, sets: str, ignored: str = "AUX") -> DataFrame:
    """The capabilities that a batch covers, sorted; explode and collect_set keep each once a task."""
    one = rows.select(key, F.explode(sets).alias("c")).where(F.col("c") != ignored)
    return one.groupBy(key).agg(F.array_sort(F.collect_set("c")).alias("capabilities"))


def score_spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact percentiles of a value by key."""
    return rows.groupBy(key).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (10, 50, 90)])


def by_tier(rows: DataFrame, split: str, tier: str) -> DataFrame:
    """Records of a split and tier; on a table partitioned by both, only their folders are read."""
    return rows.where((F.col("split") == split) & (F.col("release_tier") == tier))


def sft_records(records: DataFrame, arm: str) -> DataFrame:
    """Chat records of the transform tasks: system, images with the question, and the target; what is trained by arm.

    records: (record_id, task_id, split, scene_id, base_fact_id, system, images, question, cue, reasoning, answer).
    """
    if arm not in ("answer_only", "grounded_cot"):
        raise ValueError(f"no such arm: {arm}")
    tagged = lambda c: F.concat(F.lit(f"<{c}>"), F.col(c), F.lit(f"</{c}>"))
    target = tagged("answer") if arm == "answer_only" else F.concat_ws("", tagged("cue"), tagged("reasoning"), tagged("answer"))
    none = F.array().cast("array<string>")
    said = lambda role, body: F.struct(F.lit(role).alias("role"), body.alias("content"))
    messages = F.array(said("system", content(F.col("system"), none)), said("user", content(F.col("question"), F.coalesce("images", none))), said("assistant", content(target, none)))
    spans = ["answer"] if arm == "answer_only" else ["cue", "transform", "answer"]
    return records.select("record_id", "task_id", "split", "scene_id", "base_fact_id", F.lit(arm).alias("supervision_arm"), messages.alias("messages"), F.array(*map(F.lit, spans)).alias("role_spans"))


def rlvr_records(questions: DataFrame, system: str) -> DataFrame:
    """Prompts of the training questions with how an answer is rewarded; a prompt that holds a hidden word or an id is an error.

    questions: (scene_id, episode_id, fact_id, family_variant, consistency_group, program_id, split, view_ids, question, answer_kind, tolerance).
    """
    from orrery.functions.ids import family_id, stable_id
    from orrery.functions.structs import reward
    from orrery.functions.text import leaks

    clean = F.when(F.coalesce(leaks(F.col("question")), F.lit(False)), F.raise_error(F.concat(F.lit("a prompt tells its answer: "), F.col("fact_id").cast("string")))).otherwise(F.col("question"))
    none = F.array().cast("array<string>")
    said = lambda role, body: F.struct(F.lit(role).alias("role"), body.alias("content"))
    return questions.where("split = 'train'").select(
        stable_id("rlvr", F.col("episode_id"), F.col("fact_id")).alias("record_id"), "scene_id", family_id(F.col("consistency_group"), F.col("scene_id"), F.col("episode_id"), F.col("family_variant")).alias("family_id"),
        F.array(said("system", content(F.lit(system), none)), said("user", content(clean, F.coalesce("view_ids", none)))).alias("prompt"), reward(F.col("answer_kind"), F.col("tolerance")).alias("reward"), "consistency_group", "program_id",
    )


def optimizer_decisions(records: DataFrame, held_out: tuple[str, ...], least: int = 4, most: int = 6, kinds: int = 3, auxiliary: int = 1) -> DataFrame:
    """Whether each batch may train: (batch, eligible, n_questions, capabilities, failed checks).

    records: (batch, disposition, program_id, passed, capability, split). Candidates are rows of disposition
    train_candidate; rows of the held-out programs, and no others, are composition_heldout.
    """
    mine = F.col("disposition") == "train_candidate"
    per = records.groupBy("batch").agg(
        F.count_if(mine).alias("n_questions"), F.array_sort(F.collect_set(F.when(mine & (F.col("capability") != "AUX"), F.col("capability")))).alias("capabilities"), F.count_if(mine & (F.col("capability") == "AUX")).alias("n_aux"),
        F.count_if(mine & ~F.coalesce("passed", F.lit(False))).alias("n_bad"), F.count_if(mine & ~F.coalesce(F.col("split") == "train", F.lit(False))).alias("n_other"),
        F.count_if(F.coalesce(F.col("program_id").isin(*held_out), F.lit(False)) != F.equal_null("disposition", F.lit("composition_heldout"))).alias("n_misplaced"),
    )
    good = {
        "gates": F.col("n_bad") == 0, "question_count": F.col("n_questions").between(least, most), "capabilities": F.size("capabilities") >= kinds, "backbone": F.array_contains("capabilities", "PT"),
        "auxiliary": F.col("n_aux") <= auxiliary, "split": F.col("n_other") == 0, "held_out": F.col("n_misplaced") == 0,
    }
    failed = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in good.items()]))
    return per.select("batch", ((F.col("n_questions") > 0) & (F.size(failed) == 0)).alias("eligible"), "n_questions", "capabilities", failed.alias("failed"))


def file_binding(files: DataFrame, file_set: str) -> DataFrame:
    """One digest over a set of files (path, bytes, sha256), whatever their order: (file_set, n_files, sha256). A list of files is small by nature."""
    entry = F.concat_ws(":", F.to_json(F.struct("path")), F.col("bytes").cast("string"), "sha256")
    return files.agg(F.lit(file_set).alias("file_set"), F.count("*").alias("n_files"), F.sha2(F.concat_ws("\n", F.lit(file_set), F.array_sort(F.collect_list(entry))), 256).alias("sha256"))
