"""Tables whose columns may have any names: inside an operator they are numbered by position, so no name of its own can clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(docs: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1 and so on."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The numbered name of a column; one written just so goes before one that differs in case."""
    names = docs.columns
    if name in names:
        return f"c{names.index(name)}"
    return f"c{[n.lower() for n in names].index(name.lower())}"


def others(docs: DataFrame, added: Iterable[str]) -> dict[str, str]:
    """The numbered and the own name of each column that no added one replaces, whatever the case."""
    taken = {a.lower() for a in added}
    return {f"c{i}": n for i, n in enumerate(docs.columns) if n.lower() not in taken}


def row_key(*columns: str):
    """A key of 128 bits of a row's columns: rows that are equal in them share it, nulls and empty texts apart."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    sized = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.unhex(F.md5(F.concat(*sized).cast("binary")))


#: Keys of at most so many rows (16 bytes each, some 60 MB in memory) are broadcast when counted; more go through a shuffle.
KEYS_AT_ONCE = 1 << 20


def by_keys(rows: DataFrame, keys: DataFrame, on: str, how: str, most: int = KEYS_AT_ONCE) -> DataFrame:
    """Rows joined with a written table of keys and flags, which is counted first; what the rows carry is shuffled only if the keys are many."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)
