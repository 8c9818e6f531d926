"""Small reports as text, and the schemas of tables as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report has at most so many rows; more is an error, not a cut.
MOST_ROWS = 10_000


def _rows(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report: aggregate first")
    return df.columns, [["" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    out = [f"# {title}"]
    for name, df in tables.items():
        head, rows = _rows(df)
        clean = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        out += ["", f"## {name}", "", clean(head), "|" + "---|" * len(head), *map(clean, rows)]
    return "\n".join(out) + "\n"


def latex_macros(prefix: str, one_row: DataFrame) -> str:
    """A macro for each column of a one-row table; digits in names become letters."""
    row = one_row.first().asDict()
    letter = str.maketrans("0123456789", "abcdefghij")
    name = lambda c: prefix + "".join(p.capitalize() for p in c.translate(letter).split("_"))
    return "".join(f"\\newcommand{{\\{name(c)}}}{{{'' if v is None else v}}}\n" for c, v in row.items())


def schemas(tables: dict[str, DataFrame]) -> dict[str, str]:
    return {name: df.schema.json() for name, df in tables.items()}


def write_text(df: DataFrame, text: str, path: str) -> None:
    """A text as one file in a folder that Spark can write to."""
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).select(F.col("value")).write.mode("overwrite").text(path)
