"""Line-first quality rules.

Each line is judged alone: lines of symbols, exclamations, navigation or
boilerplate, and lines that repeat an earlier one, go. A document that loses
too much of its text this way is rejected, and so is one that fails the base
rules (too short, or mostly repeated word sequences).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.columns import numbered, others, place
from orrery.llm.words import WordHashes, hashed_words, mix, raw, runs, slices, window_hashes
from orrery.plans.durable import bounded_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
TERMINAL = ".!?:;…\"'”’»)]"
#: Whole phrases that mark boilerplate, matched without case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "uses cookies",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to",
    "enable javascript",
    "lorem ipsum",
    "skip to content",
    "back to top",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: At least so many percent of the words must stand in lines that pass.
MIN_KEPT_PERCENT = 70
#: Of a line's words, one symbol in so many, and one exclamation mark in so many, are too much.
SYMBOL_EVERY = 5
EXCLAIM_EVERY = 3
#: Shorter lines without final punctuation are navigation.
NAV_WORDS = 4
CHUNK_BYTES = 4 << 20
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE | re.ASCII)
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "base_failed", "kept", "clean_text")


def line_fault(line: str, words: int) -> str | None:
    """The rule that a line with words fails, or None."""
    if sum(map(line.count, SYMBOLS)) * SYMBOL_EVERY > words:
        return "symbols"
    if line.count("!") * EXCLAIM_EVERY > words:
        return "exclamation"
    if words < NAV_WORDS and line.strip(SPACES)[-1] not in TERMINAL:
        return "navigation"
    if _PHRASES.search(line):
        return "boilerplate"
    return None


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with ADDED after its columns (columns of these names, in whatever case, are replaced; any other name may be used).

    n_words; word_chars: code points in words; n_symbols: characters of
    SYMBOLS; n_dup_lines: lines with a word that equal an earlier line;
    n_repeat_words: words in 3-word windows that the text has twice or more;
    base_failed: too few words or too many repeated ones; kept_words: words in
    lines that pass; kept: not base_failed and kept_words at least
    MIN_KEPT_PERCENT of all; clean_text: the text without failed lines (null
    for null). Null and empty texts have no words, so they fail. Blank lines
    are never judged. Repeated rows are judged alike; any length is read whole;
    an empty table gives an empty result.
    """
    names = others(docs, ADDED)
    text = place(docs, text_col)
    base = numbered(docs).select(*dict.fromkeys((*names, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, text, CHUNK_BYTES):
            hashes, ends = hashed_words(raw(batch.column(text)), cache)
            n_words = np.diff(ends)
            repeats = _repeat_words(hashes, ends)
            texts = batch.column(text).to_pylist()
            chars, symbols, dups, kept_words, clean = zip(*[_lines(t) for t in texts], strict=True)
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
            kept = ~failed & (100 * np.array(kept_words) >= MIN_KEPT_PERCENT * n_words)
            cols = [n_words, np.array(chars), np.array(symbols), np.array(dups), repeats, np.array(kept_words), failed, kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, cols), pa.array(clean, pa.string())], names=[*names, *ADDED])

    bounded_batches(docs.sparkSession)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema if f.name in names)
    longs = ", ".join(f"{c} long" for c in ADDED[:6])
    return base.mapInArrow(run, f"{kinds}{longs}, base_failed boolean, kept boolean, clean_text string").toDF(*names.values(), *ADDED)


def _repeat_words(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text, its words in 3-word windows found twice or more in it."""
    n = len(ends) - 1
    h = window_hashes(hashes, 3)
    out = np.zeros(n, np.int64)
    if not len(h):
        return out
    doc = np.repeat(np.arange(n), np.diff(ends))
    at = np.flatnonzero(np.arange(len(h)) + 3 <= ends[doc[: len(h)] + 1])
    keys = h[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    starts = runs(keys[order])
    counts = np.diff(np.append(starts, len(order)))
    twice = at[order[np.repeat(counts > 1, counts)]]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[twice + k] = True
    np.add.at(out, doc[covered], 1)
    return out


def _lines(text: str | None) -> tuple[int, int, int, int, str | None]:
    if not text:
        return 0, 0, 0, 0, text
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dups, kept_words, kept = 0, 0, []
    for line in text.split("\n"):
        words = len(line.encode().split())
        if words:
            if line in seen:
                dups += 1
                continue
            seen.add(line)
            if line_fault(line, words):
                continue
            kept_words += words
        kept.append(line)
    return chars, symbols, dups, kept_words, "\n".join(kept)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
counts AS (
  SELECT d.doc_id, d.r, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d JOIN w USING (r)),
tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
judged AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS dup
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
passed AS (
  SELECT r, CAST(sum(dup::INT) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(sum(n) FILTER (NOT dup
      AND length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 5 <= n
      AND length(regexp_replace(line, '[^!]', '', 'g')) * 3 <= n
      AND (n >= 4 OR regexp_matches(line, '[.!?:;…"''”’»)\]][\x20\x09-\x0D]*$'))
      AND NOT regexp_matches(line, '(?i)all rights reserved|privacy policy|terms of use|terms of service|cookie policy|uses cookies|click here|read more|sign up|log in|subscribe to|enable javascript|lorem ipsum|skip to content|back to top')), 0) AS BIGINT) AS kept_words
  FROM judged GROUP BY r),
all_of AS (
  SELECT c.*, coalesce(p.n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(p.kept_words, 0) AS kept_words
  FROM counts c LEFT JOIN rep USING (r) LEFT JOIN passed p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_words >= 70 * n_words) AS kept
FROM all_of
"""
