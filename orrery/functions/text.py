"""Reading free-text answers, and text similarity, as Column expressions.

All readers fail closed: contradictory or missing cues give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cue patterns of the answer grammar, as right results need them.
LEFT = (r"\bleft_of\b", r"\bleft\b", "左侧", "左边", "左方", "左(?=[前后])")
RIGHT = (r"\bright_of\b", r"\bright\b", "右侧", "右边", "右方", "右(?=[前后])")
FRONT = (r"\bin_front_of\b", r"\bfront\b", "前方", "前面")
BEHIND = (r"\bbehind\b", r"\bback\b", "后方", "后面")
UNKNOWN = ("(?:还|目前|现在)?(?:无法|不能|不可以|难以)(?:确定|判断|得知)", "(?:证据|信息|观察)不足", "无法得知", "无法确认", "不清楚", "不知道", "未知", "不能断言")
NOT_VISIBLE = ("看不(?:到|见)", "(?:无法|不能|不会|不可以|不可能)(?:够)?看(?:到|见)", "不可见", "不在(?:视野|画面|视线)(?:中|里)?", "不会出现")
VISIBLE = ("(?<![不未没])(?:能|会|可以|能够)(?:够)?看(?:到|见)", "(?<![不未没])看(?:到|见)了?", "(?<!不)可见", "会出现在(?:视野|画面|视线)(?:中|里)?")
NO = r"^(?:不|否|不能|不会|不可以|没有|false|no)[。.!！]?$"
YES = r"^(?:是的?|能|可以|会|有|对|true|yes)[。.!！]?$"
FALSE_CLAIM = (r"^\s*(?:不对|错(?:误|的)?|不正确|不是|否)(?:\s|[，,。.;；！!]|$)", "(?:这个|该|此)?说法[^。；，,]{0,8}(?:不对|错误|有误|不正确|不成立)")
TRUE_CLAIM = (r"^\s*(?:对(?:的)?|正确(?!关系|方向|位置)|是(?:的)?|没错|属实)(?:\s|[，,。.;；！!]|$)", "(?:这个|该|此)?说法[^。；，,]{0,8}(?<!不)(?:正确|成立|属实)")
PRESENT = ("(?<![不未没])(?:能|可以|能够)确定", "(?<![不未没])(?:确实|明确)?存在", "(?<![不未没])有(?:视觉)?证据", r"^\s*(?:是的?|有|对)[。.!！]?\s*$")
ABSENT = ("不(?:存在|成立)", "没有(?:这个|该)?(?:物体|目标|东西)?")
CORRECTION = r"(?:而是|实际(?:上)?|其实|正确(?:的)?(?:空间)?关系\s*(?:是|为)|应(?:该)?\s*(?:是|为))"
FINAL = r"(?:最终答案|答案|结论)\s*(?:是|为)?\s*[:：]\s*"
# Words that a model input must not hold anywhere.
HIDDEN = ("expected_relation", "oracle", "certificate", "scene_ir", "relation_oracle")
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
# Keys, and parts of keys, that a payload without answers must not have (letters and digits alone, lower case).
ANSWER_KEYS = ("answer", "answerkey", "answervalue", "answercontract", "canonicalanswerzh", "certificate", "certificates", "claim", "claims", "claimsheet", "oracle", "groundtruth", "expectedanswer", "rationale")
ANSWER_PARTS = ("answer", "certificate", "claimsheet", "groundtruth", "oracle")

# Direction words of answers with what they stand for, and phrases about what is not known.
DIRECTION_WORDS = (("前方", "front"), ("右侧", "right"), ("后方", "back"), ("左侧", "left"))
NOT_ABSENCE = "(?:不等于|不代表|并不意味(?:着)?|不能说明|无法说明|不说明)不存在"
ABSENCE = "不存在|根本没有"
SCENE_ABSENCE = r"(?:场景|房间|住宅|屋子|屋里|空间)(?:中|里|内)?[^。！？]{0,10}(?<!有)没有(?!\s*(?:观察到|看到|足够|充分|证据))"
UNCERTAIN = "无法确定|不能确定|尚不能确定|无法判断|不能判断|证据不足|信息不足"
QUERY = r"存在\s*([^？?。；;]+)"

RELATIONS = (("left_of", LEFT), ("right_of", RIGHT), ("in_front_of", FRONT), ("behind", BEHIND))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def last_after(text: Column, marker: str) -> Column:
    """What follows the last marker, or null without one."""
    found = F.regexp_extract(text, f"(?is)^.*{marker}(.*)$", 1)
    return F.when(text.rlike(f"(?i){marker}"), found)


def answer_segment(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(text, "[*`]", ""))
    return F.btrim(F.coalesce(last_after(plain, FINAL), plain))


def _one_relation(text: Column) -> Column:
    low = F.lower(text)
    names = F.array_compact(F.array(*[F.when(any_of(low, p), name) for name, p in RELATIONS]))
    return F.when(F.size(names) == 1, names[0])


def relation_in(text: Column) -> Column:
    """The one relation that a text states; what follows its last correction goes first."""
    corrected = last_after(text, CORRECTION)
    low = F.lower(corrected)
    says = F.coalesce(any_of(low, tuple(p for _, ps in RELATIONS for p in ps)), F.lit(False))
    return F.when(says, _one_relation(corrected)).otherwise(_one_relation(text))


def claim_correct(text: Column) -> Column:
    no, yes = any_of(text, FALSE_CLAIM), any_of(text, TRUE_CLAIM)
    return F.when(no != yes, yes)


def visible(text: Column) -> Column:
    """Whether a text says that something is visible; cues inside a negative do not count."""
    low = F.btrim(F.lower(text))
    no = any_of(low, NOT_VISIBLE) | low.rlike(NO)
    rest = F.regexp_replace(low, "(?:" + "|".join(NOT_VISIBLE) + ")", "")
    yes = any_of(rest, VISIBLE) | low.rlike(YES)
    return F.when(no != yes, yes)


def says_unknown(text: Column) -> Column:
    return any_of(text, UNKNOWN)


def structured(text: Column) -> Column:
    """The JSON value of an answer as VARIANT: the whole, the last fenced block, or the final segment; null without."""
    whole = F.try_parse_json(F.btrim(text))
    fenced = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)\s*```"), F.lit(1))
    block = F.when(F.size(fenced) > 0, F.try_parse_json(F.element_at(fenced, -1)))
    return F.coalesce(whole, block, F.try_parse_json(answer_segment(text)))


def _field(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.answer_value.{path}", kind), F.try_variant_get(value, f"$.{path}", kind))


def parse_answer(task: Column, output: Column, category: Column) -> Column:
    """struct(parsed, is_null, relation, claim_correct, visible, status, category) of an answer under its task's grammar.

    parsed is false for an answer that is empty, contradictory or out of its
    grammar; is_null marks a parsed "unknown".
    """
    value = structured(output)
    has_value = value.isNotNull()
    segment = F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), answer_segment(output))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    as_bool = F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    text_or = lambda given, said: F.when(is_object, given).otherwise(said)
    relation = text_or(relation_in(_field(value, "relation", "string")), relation_in(segment))
    claim = text_or(_field(value, "claim_correct", "boolean"), claim_correct(segment))
    seen = F.coalesce(as_bool, text_or(_field(value, "visible", "boolean"), F.when(~says_unknown(segment), visible(segment))))
    unknown = text_or(_field(value, "status", "string") == "unknown", says_unknown(segment) | F.coalesce(has_value & F.is_variant_null(value), F.lit(False)))
    asserted = any_of(segment, PRESENT) | segment.rlike(r"(?<!没)有") & F.contains(segment, category)
    denied = F.coalesce(~visible(segment), F.lit(False)) | any_of(segment, ABSENT)
    present = F.coalesce(as_bool, text_or(_field(value, "status", "string") == "present", ~says_unknown(segment) & ~denied & (F.coalesce(visible(segment), F.lit(False)) | asserted)))
    filled = F.coalesce(F.btrim(output) != "", F.lit(False))
    ok = (
        F.when(task == "counterfactual_verification", claim.isNotNull() & relation.isNotNull())
        .when(task == "egocentric_relation", relation.isNotNull())
        .when(task == "evidence_presence_unknown", unknown)
        .when(task == "evidence_presence_reveal", present & category.isNotNull())
        .when(task == "target_view_prediction", seen.isNotNull())
    )
    ok = filled & F.coalesce(ok, F.lit(False))
    of = lambda tasks, c: F.when(ok & task.isin(*tasks), c)
    return F.struct(
        ok.alias("parsed"), (ok & (task == "evidence_presence_unknown")).alias("is_null"),
        of(("counterfactual_verification", "egocentric_relation"), relation).alias("relation"),
        of(("counterfactual_verification",), claim).alias("claim_correct"), of(("target_view_prediction",), seen).alias("visible"),
        of(("evidence_presence_reveal",), F.lit("present")).alias("status"), of(("evidence_presence_reveal",), category).alias("category"),
    )


def choice(text: Column, choices: Column | None = None) -> Column:
    """A to D: the last answer tag, else the last explicit statement, else a bare last line, else the one choice whose text occurs."""
    tagged = F.regexp_extract_all(text, F.lit(r"(?i)<answer>\s*([A-D])(?:\.|\b)"), F.lit(1))
    stated = F.regexp_extract_all(text, F.lit(r"(?i)(?:答案|answer|选项)\s*(?:是|为|:)?\s*([A-D])(?:\.|\b)"), F.lit(1))
    last = F.element_at(F.split(F.btrim(text), r"\r?\n"), -1)
    bare = F.regexp_extract(last, r"(?i)^\s*([A-D])(?:\..*)?\s*$", 1)
    out = F.coalesce(F.try_element_at(tagged, F.lit(-1)), F.try_element_at(stated, F.lit(-1)), F.when(bare != "", bare))
    if choices is not None:
        held = F.filter(F.sequence(F.lit(0), F.size(choices) - 1), lambda i: F.contains(F.lower(text), F.lower(F.get(choices, i))))
        out = F.coalesce(out, F.when(F.size(held) == 1, F.char(held[0] + 65)))
    return F.upper(out)


def trace_flags(text: Column, tags: tuple[str, ...] = ("cue", "reasoning", "answer")) -> Column:
    return F.struct(*[text.rlike(f"(?s)<{t}>.*?</{t}>").alias(t) for t in tags])


def leaks(json: Column) -> Column:
    """Whether a model input holds a hidden word or an id, anywhere; null for null."""
    return json.rlike("(?i)" + "|".join((*HIDDEN, UUID)))


def answer_keys(json: Column) -> Column:
    """The keys of a JSON text, at any depth, that bear an answer, as written and in order; null for null."""
    strings = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    keys = F.transform(F.filter(strings, lambda x: F.endswith(x, F.lit(":"))), lambda x: F.regexp_extract(x, r'(?s)^"(.*)"\s*:$', 1))

    def bears(key: Column) -> Column:
        plain = F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")
        return plain.isin(*ANSWER_KEYS) | plain.rlike("|".join(ANSWER_PARTS))

    return F.filter(keys, bears)


def option_order(record: Column, labels: Column) -> Column:
    """Labels in the order that hashes of record and label give."""
    keyed = F.transform(labels, lambda x: F.struct(F.sha2(F.concat_ws(":", record, x), 256).alias("h"), x.alias("label")))
    return F.transform(F.array_sort(keyed), lambda s: s["label"])


def ngrams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams; a shorter text is its own; none of an empty one."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(many)


def dice(a: Column, b: Column) -> Column:
    """Similarity of two n-gram sets; two empty ones are equal."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def replaced(text: Column, names: dict[str, str]) -> Column:
    """Each name as its other form, longest names first."""
    for name in sorted(names, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(name), F.lit(names[name]))
    return text


def message_text(content: Column) -> Column:
    """The text parts of a message's content (type, text, image)."""
    return F.array_join(F.transform(F.filter(content, lambda c: c["type"] == "text"), lambda c: c["text"]), "")


def message_images(content: Column) -> Column:
    return F.transform(F.filter(content, lambda c: c["type"] == "image"), lambda c: c["image"])


def rendered(template: Column, slots: dict[str, Column]) -> Column:
    """A template with each {{slot}} filled; a slot that is not there exactly once gives null."""
    out, good = template, F.lit(True)
    for name, value in slots.items():
        mark = "{{" + name + "}}"
        good = good & (F.size(F.split(template, mark.replace("{", r"\{").replace("}", r"\}"))) == 2)
        out = F.replace(out, F.lit(mark), value)
    return F.when(good, out)


def lfs_pointer(text: Column) -> Column:
    """struct(version, oid, size) of a large-file pointer, nulls where it is none."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(part(r"(?m)^version (\S+)$").alias("version"), part(r"(?m)^oid sha256:([0-9a-f]{64})$").alias("oid"), part(r"(?m)^size (\d+)$").cast("long").alias("size"))


def lexicon_hits(text: Column, words: tuple[str, ...]) -> Column:
    """Words of a list that a text holds as whole words, sorted."""
    found = [F.when(text.rlike(rf"(?i)(?<![\w]){w.replace('.', chr(92) + '.')}(?![\w])"), F.lit(w)) for w in sorted(words)]
    return F.array_compact(F.array(*found))


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.]*\w)"), F.lit(1))


def unlisted_numbers(text: Column, allowed: Column) -> Column:
    """Numbers in a sentence that no claim allows."""
    return F.array_except(numbers_in(text), allowed)


#: Longest first, so that "front left" is not read as "left".
DIRECTIONS = ("front left", "front right", "back left", "back right", "in front of", "left of", "right of", "behind", "above", "below", "front", "right", "left", "back")


def directions_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(DIRECTIONS) + r")\b"), F.lit(1))


def turn_phrase(degrees: Column) -> Column:
    """A clockwise turn in words."""
    size = F.abs(degrees)
    side = F.when(degrees >= 0, "right").otherwise("left")
    return F.when(size >= 175, "turn around").when(size < 5, "keep facing ahead").otherwise(F.concat(F.lit("turn "), side, F.lit(" by "), F.rint(size).cast("int").cast("string"), F.lit(" degrees")))


def choice_labels(question: Column) -> Column:
    """Map of letter to text of the options in a question."""
    letters = F.regexp_extract_all(question, F.lit(r"(?m)^\s*([A-D])\.\s*(.+?)\s*$"), F.lit(1))
    labels = F.regexp_extract_all(question, F.lit(r"(?m)^\s*([A-D])\.\s*(.+?)\s*$"), F.lit(2))
    return F.map_from_entries(F.arrays_zip(F.array_distinct(letters).alias("k"), F.slice(labels, F.lit(1), F.size(F.array_distinct(letters))).alias("v")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _direction(word: Column) -> Column:
    """What a direction word stands for; null for any other."""
    out = F.lit(None).cast("string")
    for w, name in DIRECTION_WORDS:
        out = F.when(word == w, name).otherwise(out)
    return out


def direction_label(response: Column) -> Column:
    """The direction that the last answer tag names last, or without a tag the last line; null if there is none."""
    tagged = _last(F.regexp_extract_all(response, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1)))
    scope = F.coalesce(tagged, F.element_at(F.split(_stripped(response), r"\R"), -1))
    return _direction(_last(F.regexp_extract_all(scope, F.lit("(" + "|".join(w for w, _ in DIRECTION_WORDS) + ")"), F.lit(1))))


def option_direction(question: Column, letter: Column) -> Column:
    """The direction that a question's options give a letter; the last of repeated options counts."""
    pattern = F.lit(r"([A-D])\.\s*(" + "|".join(w for w, _ in DIRECTION_WORDS) + ")")
    options = F.arrays_zip(F.regexp_extract_all(question, pattern, F.lit(1)).alias("letter"), F.regexp_extract_all(question, pattern, F.lit(2)).alias("word"))
    return _direction(_last(F.filter(options, lambda o: o["letter"] == letter))["word"])


def response_score(response: Column, question: Column, key: Column, label: Column) -> Column:
    """A response against its key and label: struct of what was read, correct, semantic_correct, option_text_consistent, trace.

    The direction in words goes before that of the chosen option. A response
    from which nothing is read is wrong, not null.
    """
    letter, said = choice(response), direction_label(response)
    option = option_direction(question, letter)
    meant = F.coalesce(said, option)
    return F.struct(
        letter.alias("prediction"), option.alias("option_label"), said.alias("text_label"), meant.alias("semantic_label"),
        F.coalesce(letter == key, F.lit(False)).alias("correct"), F.coalesce(meant == label, F.lit(False)).alias("semantic_correct"),
        (option == said).alias("option_text_consistent"), trace_flags(response).alias("trace"),
    )


def unknown_faults(text: Column) -> Column:
    """How an answer of "unknown" says more than is known: existence_denied, scene_absence, no_uncertainty; none of them is good."""
    denied = F.regexp_replace(text, NOT_ABSENCE, "").rlike(ABSENCE)
    return F.array_compact(F.array(F.when(denied, "existence_denied"), F.when(text.rlike(SCENE_ABSENCE), "scene_absence"), F.when(~text.rlike(UNCERTAIN), "no_uncertainty")))


def query_surface(text: Column) -> Column:
    """What a presence question asks for: what follows its last word of existence; null without one."""
    return _stripped(_last(F.regexp_extract_all(text, F.lit(QUERY), F.lit(1))))


def surface_anchored(question: Column, prefixes: Column, name: Column, names: Column) -> Column:
    """Whether a question says one of the prefixes and then the name, and there no longer one of the names that begins with it."""
    quoted = lambda s: F.regexp_replace(s, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    one_of = lambda a: F.concat(F.lit("(?:"), F.array_join(F.transform(a, quoted), "|"), F.lit(")"))
    rest = F.transform(F.filter(names, lambda n: F.startswith(n, name) & (F.length(n) > F.length(name))), lambda n: F.substring(n, F.length(name) + 1, F.length(n)))
    pattern = F.concat(one_of(prefixes), quoted(name), F.when(F.size(rest) > 0, F.concat(F.lit("(?!"), one_of(rest), F.lit(")"))).otherwise(""))
    return (F.size(prefixes) > 0) & F.rlike(question, pattern)


def entity_name(label: Column, names: Column) -> Column:
    """The name of a label in a map of normal labels to names; one that it lacks is said with spaces for underscores."""
    key = F.replace(F.lower(F.btrim(label)), F.lit(" "), F.lit("_"))
    return F.coalesce(names[key], F.btrim(F.replace(label, F.lit("_"), F.lit(" "))))
