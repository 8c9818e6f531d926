"""Queries on answers and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import ids
from orrery.functions import text as T
from orrery.operators import dedup as D
from orrery.operators.schedule import token_proxy
from orrery.plans.registry import query, table

#: Answers around a turn's own text: {r} is a relation word that the text's length picks.
_FORMS = (
    "{t} It is {r} of the table.",
    "left or {r}, I cannot say. {t}",
    "{t} 说法不对；实际在 {r} 。",
    "{r} ？不，其实是 {r} ！",
    "看不到。",
    "{t} 能看到。",
    "现在能看到，刚才看不见。",
    "{t} 证据不足，还不能确定。",
    "{t}\n答案：B",
    "<cue>{t}</cue><reasoning>{r}</reasoning><answer>C</answer>",
    "{t} 结论是: {\"relation\": \"{r}\"}",
    "{\"answer_value\": {\"relation\": \"{r}\"}}",
    "true",
    "<answer>d.</answer> {t} answer: a",
    "{t}",
)
_WORDS = ("left", "right_of", "前方", "behind", "左侧", "back", "front", "右前")


def _answers(spark, d):
    """An answer of each turn of each conversation, made of its whole text."""
    text = F.coalesce("text", F.lit(""))
    pick = lambda of, by: F.get(F.array(*map(F.lit, of)), (by % len(of)).cast("int"))
    form, word = pick(_FORMS, F.length(text) + F.col("turn")), pick(_WORDS, F.octet_length(text))
    said = F.replace(F.replace(form, F.lit("{r}"), word), F.lit("{t}"), text)
    return table(spark, d, "conversations").select("conv_id", "turn", said.alias("said"))


def _listed(of: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in of) + "]"


_SAID = f"""s AS MATERIALIZED (SELECT conv_id, turn, replace(replace(({_listed(_FORMS)})[(length(t) + turn) % {len(_FORMS)} + 1], '{{r}}', ({_listed(_WORDS)})[strlen(t) % {len(_WORDS)} + 1]), '{{t}}', t) AS said
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))"""


def _any(patterns: tuple[str, ...]) -> str:
    """One pattern, without looking around: a character that must not stand before becomes a start or another one."""
    one = "|".join(f"(?:{p})" for p in patterns)
    return one.replace("(?<![不未没])", "(?:^|[^不未没])").replace("(?<!不)", "(?:^|[^不])").replace("(?=[前后])", "[前后]")


def _sql_one(x: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(lower({x}), '{_any(p)}') THEN '{n}' END" for n, p in T.RELATIONS)
    return f"(CASE WHEN len([n FOR n IN [{found}] IF n IS NOT NULL]) = 1 THEN ([n FOR n IN [{found}] IF n IS NOT NULL])[1] END)"


def _sql_relation(x: str) -> str:
    last = f"regexp_extract({x}, '(?is)^.*{T.CORRECTION}(.*)$', 1)"
    return f"(CASE WHEN regexp_matches(lower({last}), '{_any(tuple(p for _, ps in T.RELATIONS for p in ps))}') THEN {_sql_one(last)} ELSE {_sql_one(x)} END)"


@query(f"WITH {_SAID} SELECT conv_id, turn, {_sql_relation('said')} AS relation FROM s")
def relation_parse(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.relation_in(F.col("said")).alias("relation"))


@query(rf"""WITH {_SAID}, t AS (SELECT *, regexp_extract_all(said, '(?i)<answer>\s*([A-D])(?:\.|\b)', 1) AS tagged, regexp_extract_all(said, '(?i)(?:答案|answer|选项)\s*(?:是|为|:)?\s*([A-D])(?:\.|\b)', 1) AS stated,
  regexp_extract(string_split(trim(said, ' '), chr(10))[-1], '(?i)^\s*([A-D])(?:\..*)?\s*$', 1) AS bare FROM s)
SELECT conv_id, turn, upper(coalesce(tagged[-1], stated[-1], nullif(bare, ''))) AS choice FROM t""")
def choice_parse(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.choice(F.col("said")).alias("choice"))


@query(f"""WITH {_SAID} SELECT conv_id, turn, regexp_matches(said, '(?s)<cue>.*?</cue>') AS cue, regexp_matches(said, '(?s)<reasoning>.*?</reasoning>') AS reasoning,
  regexp_matches(said, '(?s)<answer>.*?</answer>') AS answer FROM s""")
def trace_format(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.trace_flags(F.col("said")).alias("t")).select("conv_id", "turn", "t.*")


@query(f"""WITH {_SAID}, l AS (SELECT *, trim(lower(said), ' ') AS low FROM s),
f AS (SELECT *, regexp_matches(low, '{_any(T.NOT_VISIBLE)}') OR regexp_matches(low, '{T.NO}') AS no, regexp_matches(regexp_replace(low, '{_any(T.NOT_VISIBLE)}', '', 'g'), '{_any(T.VISIBLE)}') OR regexp_matches(low, '{T.YES}') AS yes FROM l)
SELECT conv_id, turn, CASE WHEN no <> yes THEN yes END AS visible, regexp_matches(said, '{_any(T.UNKNOWN)}') AS unknown FROM f""")
def visibility_parse(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.visible(F.col("said")).alias("visible"), T.says_unknown(F.col("said")).alias("unknown"))


@query(f"""WITH {_SAID}, p AS (SELECT *, trim(regexp_replace(said, '[*`]', '', 'g'), ' ') AS plain FROM s),
g AS (SELECT *, trim(CASE WHEN regexp_matches(plain, '{T.FINAL}') THEN regexp_extract(plain, '(?is)^.*{T.FINAL}(.*)$', 1) ELSE plain END, ' ') AS segment FROM p),
v AS (SELECT *, CASE WHEN json_valid(trim(said)) THEN trim(said) WHEN json_valid(segment) THEN segment END AS j FROM g),
o AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(j ->> '$.answer_value.relation', j ->> '$.relation') END AS given FROM v)
SELECT conv_id, turn, trim(said, ' ') <> '' AND (CASE WHEN json_type(j) = 'OBJECT' THEN {_sql_relation("given")} ELSE {_sql_relation("segment")} END) IS NOT NULL AS parsed FROM o""")
def answer_parse(spark, d):
    task, none = F.lit("egocentric_relation"), F.lit(None).cast("string")
    return _answers(spark, d).select("conv_id", "turn", T.parse_answer(task, F.col("said"), none)["parsed"].alias("parsed"))


@query(r"""WITH m AS (SELECT conv_id, turn, coalesce(text, '') || CASE conv_id % 7 WHEN 0 THEN ' see Scene_IR' WHEN 1 THEN ' 123E4567-e89b-12d3-a456-426614174000' WHEN 2 THEN ' x123e4567-e89b-12d3-a456-426614174000' WHEN 3 THEN ' oracles' ELSE '' END AS said FROM conversations)
SELECT conv_id, turn, contains(lower(said), 'expected_relation') OR contains(lower(said), 'oracle') OR contains(lower(said), 'certificate') OR contains(lower(said), 'scene_ir')
  OR regexp_matches(lower(said), '\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b') AS leaks FROM m""")
def leakage_hits(spark, d):
    """Whole texts of conversations, with hidden words and ids planted in some."""
    k = F.col("conv_id") % 7
    planted = F.when(k == 0, " see Scene_IR").when(k == 1, " 123E4567-e89b-12d3-a456-426614174000").when(k == 2, " x123e4567-e89b-12d3-a456-426614174000").when(k == 3, " oracles").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", T.leaks(F.concat(F.coalesce("text", F.lit("")), planted)).alias("leaks"))


@query(r"""WITH j AS (SELECT event_id, json_object('props', try_cast(props AS JSON), 'note', '"oracle": ' || event_id, CASE event_id % 4 WHEN 0 THEN 'Answer-Key' WHEN 1 THEN 'claims' WHEN 2 THEN 'claimed' ELSE 'Ground_Truth_2' END, json_object('rationale', 1)) AS p FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Answer-Key,rationale' WHEN 1 THEN 'claims,rationale' WHEN 2 THEN 'rationale' ELSE 'Ground_Truth_2,rationale' END AS keys FROM j""")
def answer_bearing_keys(spark, d):
    """Payloads of events with keys planted at two depths; a text that looks like a key is none."""
    k = F.col("event_id") % 4
    key = F.when(k == 0, "Answer-Key").when(k == 1, "claims").when(k == 2, "claimed").otherwise("Ground_Truth_2")
    payload = F.concat(F.lit('{"props": '), F.coalesce("props", F.lit("null")), F.lit(', "note": "\\"oracle\\": '), F.col("event_id").cast("string"), F.lit('", "'), key, F.lit('": {"rationale": 1}}'))
    return table(spark, d, "events").select("event_id", F.array_join(T.answer_keys(payload), ",").alias("keys"))


@query("""WITH l AS (SELECT c_custkey, unnest(['front', 'right', 'back', 'left']) AS label FROM customer)
SELECT c_custkey, string_agg(label, ',' ORDER BY sha256(c_custkey || ':' || label), label) AS options FROM l GROUP BY 1""")
def option_order(spark, d):
    labels = F.array(*map(F.lit, ("front", "right", "back", "left")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.option_order(F.col("c_custkey").cast("string"), labels), ",").alias("options"))


@query("""WITH t AS (SELECT url AS text, min(page_id) AS k FROM pages WHERE url IS NOT NULL GROUP BY url),
g AS (SELECT k, unnest(CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 4 THEN [text] ELSE list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) END) AS gram FROM t),
s AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.k < b.k GROUP BY ALL)
SELECT a, b, round(2 * c / (x.n + y.n), 9) AS similarity FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE 2 * c / (x.n + y.n) >= 0.85""")
def near_duplicates(spark, d):
    return D.near_duplicates(table(spark, d, "pages"), "page_id", "url").withColumn("similarity", F.round("similarity", 9))


@query("""WITH t AS (SELECT text, min(conv_id || ':' || turn) AS k FROM conversations WHERE text IS NOT NULL GROUP BY text),
g AS (SELECT k, unnest(CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 4 THEN [text] ELSE list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) END) AS gram FROM t),
s AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.k < b.k GROUP BY ALL)
SELECT a, b, round(2 * c / (x.n + y.n), 9) AS similarity FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE 2 * c / (x.n + y.n) >= 0.85""")
def near_duplicate_turns(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    return D.near_duplicates(rows, "k", "text", words=16).withColumn("similarity", F.round("similarity", 9))


@query("SELECT conv_id * 1000 + turn AS k, min(conv_id * 1000 + turn) OVER (PARTITION BY text) AS class_id FROM conversations")
def text_classes(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return D.classes(rows, "k", "text")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '[A-Za-z]+|\d+|[\x{4e00}-\x{9fff}]|[^\sA-Za-z\d\x{4e00}-\x{9fff}]')) AS BIGINT) AS n_lexemes FROM pages""")
def token_proxy_counts(spark, d):
    return table(spark, d, "pages").select("page_id", token_proxy(F.col("html")).alias("n_lexemes"))


@query("SELECT n_nationkey, replace(replace(lower(n_name), 'united states', 'us'), 'united', 'u') AS name FROM nation")
def localized_names(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.replaced(F.lower("n_name"), {"united": "u", "united states": "us"}).alias("name"))


@query("SELECT c_custkey, 'Where is ' || c_name || ' seen from ' || c_mktsegment || '?' AS question FROM customer")
def rendered_questions(spark, d):
    q = T.rendered(F.lit("Where is {{who}} seen from {{where}}?"), {"who": F.col("c_name"), "where": F.col("c_mktsegment")})
    return table(spark, d, "customer").select("c_custkey", q.alias("question"))


@query("SELECT c_custkey, sha256('scene' || chr(31) || c_name || chr(31) || c_mktsegment) AS request_hash FROM customer")
def request_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", ids.request_hash(F.lit("scene"), F.col("c_name"), F.col("c_mktsegment")).alias("request_hash"))


@query("SELECT conv_id, turn, text LIKE '%\n%' AS multi_line, length(text) AS n_chars FROM conversations WHERE role = 'user'")
def message_parts(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    part = lambda t, x, i: F.struct(F.lit(t).alias("type"), x.alias("text"), i.alias("image"))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("content", F.array(part("image", none, F.lit("view-000")), part("text", F.col("text"), none)))
    said = T.message_text(F.col("content"))
    return rows.select("conv_id", "turn", F.contains(said, F.lit("\n")).alias("multi_line"), F.length(said).cast("long").alias("n_chars"))
