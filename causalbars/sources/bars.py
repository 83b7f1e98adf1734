"""Bars and events: scans, validation, cleaning, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.functions.clock import DAY_NS
from causalbars.runtime import clean_double

OHLCV = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in OHLCV)])


class BarError(ValueError):
    """Bars that break the contract: a missing column, a repeated or NULL stamp."""


def load_bars(spark: SparkSession, path: str, timestamp_col: str = "timestamp", before: str | None = None) -> DataFrame:
    """CSV or parquet bars as ``timestamp, open, high, low, close, volume``; doubles, UTC.

    ``before`` is a plain predicate on the stored column, so parquet row groups at or after it are not
    read (see PushedFilters)."""
    if path.endswith((".csv", ".csv.gz")):
        names = spark.read.option("header", True).csv(path).columns
        raw = spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.TimestampType() if c == timestamp_col else T.DoubleType() if c in OHLCV else T.StringType()) for c in names])).csv(path)
    else:
        raw = spark.read.parquet(path)
    missing = {timestamp_col, *OHLCV} - set(raw.columns)
    if missing:
        raise BarError(f"missing columns: {sorted(missing)}")
    if before is not None:
        kind = dict(raw.dtypes)[timestamp_col]
        raw = raw.where(F.col(timestamp_col) < F.lit(before).cast(kind))
    return raw.select(F.col(timestamp_col).cast("timestamp").alias("timestamp"), *(F.col(c).cast("double").alias(c) for c in OHLCV))


def violations(bars: DataFrame, key: list[str] | None = None, stamp: str = "timestamp") -> DataFrame:
    """Stamps that are NULL or occur more than once per key: ``key..., stamp, n``. Empty if valid."""
    return bars.groupBy(*(key or []), stamp).agg(F.count(F.lit(1)).alias("n")).where(F.col(stamp).isNull() | (F.col("n") > 1))


def validate_bars(bars: DataFrame, key: list[str] | None = None, stamp: str = "timestamp") -> DataFrame:
    bad = violations(bars, key, stamp).limit(5).collect()
    if bad:
        raise BarError(f"stamps not unique: {bad}")
    return bars


def write_panel(df: DataFrame, path: str) -> None:
    """A cross-validation panel, laid out by target and model so that either prunes partitions."""
    df.repartition("target", "model").write.mode("overwrite").partitionBy("target", "model").parquet(path)


def read_panel(spark: SparkSession, path: str, target: str | None = None, model: str | None = None) -> DataFrame:
    """A panel as ``write_panel`` laid it out; a named target or model reads its own folders only."""
    p = spark.read.parquet(path)
    for c, v in (("target", target), ("model", model)):
        p = p if v is None else p.where(F.col(c) == v)
    return p


def read_timestamps(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of stamps of a CSV export, as UTC instants."""
    return spark.read.option("header", True).csv(path).select(F.to_timestamp(column).alias("event_time")).where("event_time is not null")


def zones(instruments: DataFrame) -> DataFrame:
    """Instruments with sessions as minutes and the bar interval in ns, one row per symbol."""
    m = lambda c: (F.split(c, ":")[0].cast("long") * 60 + F.split(c, ":")[1].cast("long"))
    return instruments.dropDuplicates(["symbol"]).select(
        "symbol",
        F.col("timezone_name").alias("tz"),
        m("rth_open").alias("rth_from"),
        m("rth_close").alias("rth_to"),
        F.col("rth_minutes").cast("long").alias("rth_minutes"),
        m("eth_session_start").alias("eth_from"),
        (F.col("bar_seconds") * 1_000_000_000).alias("step_ns"),
        F.col("tick_size").alias("tick"),
    )


def clean_bars(bars: DataFrame, instruments: DataFrame, by_day: bool = False) -> DataFrame:
    """One complete, possible reading per (series, stamp): of copies the last received one counts.

    Rows with a NULL in a key or value, a price of 0 or less, a negative volume or high below low are left
    out, as are symbols without an instrument. The zone columns come from a size-checked join. ``by_day`` adds ``day``, the
    UTC day, and leaves the bars hashed by (series_id, day), so that positions need no second shuffle of them."""
    vals = {c: clean_double(c) for c in OHLCV}
    ok = bars.select("series_id", "symbol", F.col("index_ns").cast("long").alias("ts"), "received_at", "bar_id", *(v.alias(c) for c, v in vals.items())).where(
        "series_id is not null and ts is not null and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 and high >= low"
    )
    keys = ["series_id", "ts"]
    if by_day:
        ok = ok.withColumn("day", F.expr(f"ts div {DAY_NS}L")).where("day is not null").repartition("series_id", "day")  # said here, else a join on the day adds it to one of two equal shuffles
        keys = ["series_id", "day", "ts"]
    one = ok.groupBy(*keys).agg(F.max_by(F.struct("symbol", *OHLCV), F.struct("received_at", "bar_id")).alias("x")).select(*keys, "x.*")
    return one.join(zones(instruments), "symbol")


def clean_events(events: DataFrame) -> DataFrame:
    """One row per event id, the first logged: ``event_id, experiment_id, series_id, event_ns, direction``.

    Events with a NULL key or time or a direction other than -1 and +1 are left out."""
    ok = events.where("event_id is not null and series_id is not null and event_time is not null and direction in (-1, 1)")
    x = F.struct("experiment_id", "series_id", (F.unix_micros("event_time") * 1000).alias("event_ns"), F.col("direction").cast("int").alias("direction"))
    return ok.groupBy("event_id").agg(F.min_by(x, F.struct("logged_at", "series_id", "event_time", "direction")).alias("x")).select("event_id", "x.*")
