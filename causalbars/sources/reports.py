"""Small results as JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN and infinities become null."""
    clean = {c: F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")}
    d = df.withColumns(clean) if clean else df
    return d.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in d.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 50, digits: int = 4) -> str:
    """A table of at most ``limit`` rows; a report is a top-k by nature."""
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"
