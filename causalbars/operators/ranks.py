"""Ranks within a group of any size: offsets of buckets plus the rank inside a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list[str | Column], bucket: Column, name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the 0-based rank of each row within ``by`` in the given order, ties broken by the later order
    columns. ``bucket`` must not decrease along the order; a hot group is spread over its buckets, of
    which only the counts are summed up in one place. ``size``: also add the group's row count."""
    d = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*by).orderBy("_bucket")
    n = d.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select(*by, "_bucket", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    r = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1)
    keys = [*by, "_bucket"]
    cond = [r[k].eqNullSafe(n[k]) for k in keys]
    out = r.join(n.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before", "_size"), [r[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) if cond else r
    out = out.withColumn(name, F.col("_before") + F.col("_r"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_bucket", "_before", "_r", "_size", *(f"_k{i}" for i in range(len(keys))))


def array_split_starts(n: Column, parts: int) -> list[Column]:
    """Where each of ``parts`` nearly equal runs of n rows begins: the first n % parts have one more."""
    q, r = F.floor(n / parts), n % parts
    return [(q * i + F.least(F.lit(i), r)).cast("long") for i in range(parts)]
