"""Dense positions and as-of lookups that never sort a whole series in one task.

Bars are bucketed by (series, UTC day). A small table of bars per bucket gives each bucket's offset; the
rank within the bucket does the rest. An as-of lookup is the same count: bars before the bucket plus
bars in the bucket up to the point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.functions.clock import DAY_NS


def _day(c: str) -> Column:
    return F.expr(f"{c} div {DAY_NS}L")


def _offsets(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return counts.groupBy("series_id", "day").agg(F.sum("n").alias("n"), F.first("step_ns", True).alias("step_ns")).select(
        "series_id", "day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")
    )


def with_positions(bars: DataFrame) -> DataFrame:
    """Adds ``pos``, 0, 1, 2, ... along each series' stamps. A ``day`` (the UTC day) that the bars have is used up."""
    keyed = bars if "day" in bars.columns else bars.withColumn("day", _day("ts"))
    at = _offsets(keyed.groupBy("series_id", "day").agg(F.count(F.lit(1)).alias("n"), F.first("step_ns").alias("step_ns")))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("series_id", "day").orderBy("ts")) - 1)
    return ranked.join(at, ["series_id", "day"]).withColumn("pos", F.col("before") + F.col("_r")).drop("_r", "before", "day")


def locate(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events with the bar positions around them, and their series' zone columns.

    ``pos_t``: the last bar complete at the event (stamp + interval <= event_ns; -1 if none);
    ``pos_fwd``: the first bar stamped at or after it (the number of bars if there is none yet)."""
    dims = bars.groupBy("series_id").agg(*(F.first(c).alias(c) for c in ("symbol", "tz", "rth_from", "rth_to", "rth_minutes", "eth_from", "step_ns", "tick")), F.count(F.lit(1)).alias("n_bars"))
    ev = events.join(dims, "series_id")
    points = ev.select("*", F.inline(F.array(
        F.struct((F.col("event_ns") - F.col("step_ns")).alias("at"), F.lit(1).alias("kind")),  # after a bar at the same stamp: <=
        F.struct(F.col("event_ns").alias("at"), F.lit(-1).alias("kind")),  # before it: <
    ))).withColumn("day", _day("at"))
    only = bars.select("series_id", F.col("ts").alias("at"), F.lit(0).alias("kind"), _day("ts").alias("day"), "step_ns")
    counts = only.groupBy("series_id", "day").agg(F.count(F.lit(1)).alias("n"), F.first("step_ns").alias("step_ns")).unionByName(
        points.groupBy("series_id", "day").agg(F.lit(0).cast("long").alias("n"), F.first("step_ns").alias("step_ns"))
    )
    w = Window.partitionBy("series_id", "day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ids = points.select("series_id", "day", "at", "kind", "event_id")
    seen = ids.unionByName(only.drop("step_ns"), allowMissingColumns=True).withColumn("c", F.count(F.when(F.col("kind") == 0, 1)).over(w)).where("kind <> 0")
    got = seen.join(_offsets(counts), ["series_id", "day"]).groupBy("event_id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("before") + F.col("c") - 1)).alias("pos_t"), F.max(F.when(F.col("kind") == -1, F.col("before") + F.col("c"))).alias("pos_fwd")
    )
    return ev.join(got, "event_id")
