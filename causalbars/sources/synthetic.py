"""Seeded bars and events of any size for tests and demonstrations, made where they are needed.

Every number is a hash of (seed, its place, what it is for), so a row does not depend on how the data are
split, and nothing is drawn on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalbars.functions.clock import utc_ns, utc_year

MINUTES = 390
SIGNALS = ("none", "linear", "nonlinear", "tail")


def uniform(seed: int, use: str, *place: str) -> Column:
    """A number in (0, 1) per place and use."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(use), *place), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, use: str, *place: str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, f"{use}.r", *place))) * F.cos(2 * F.pi() * uniform(seed, f"{use}.a", *place))


def bars(spark: SparkSession, days: int, seed: int = 7, start: str = "2020-01-06", vol: float = 0.0004, pull: float = 0.0, base: float = 5000.0, tz: str = "America/New_York") -> DataFrame:
    """One-minute bars of 09:30 to 16:00 on weekdays: ``timestamp, open, high, low, close, volume``.

    Prices move by normal shocks; with ``pull`` above 0 a bar also goes that share of the last ten shocks on.
    Volume is high at both ends of a session. The level goes on from day to day, by sums per day."""
    d = spark.range(-(-days * 7 // 5) + 2).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))
    d = d.where(F.weekday("date") < 5).orderBy("date").limit(days)
    m = d.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1)))).withColumn("shock", normal(seed, "shock", "date", "minute") * vol)
    day = Window.partitionBy("date").orderBy("minute")
    m = m.withColumn("ret", F.col("shock") + pull * F.coalesce(F.sum("shock").over(day.rowsBetween(-10, -1)), F.lit(0.0)))
    level = m.groupBy("date").agg(F.sum("ret").alias("moved"))
    level = level.select("date", F.coalesce(F.sum("moved").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # one row a day
    m = m.join(level, "date").withColumn("at", F.col("before") + F.sum("ret").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    close, open_ = base * F.exp("at"), base * F.exp(F.col("at") - F.col("ret"))
    reach = lambda use: 1 + vol * -F.ln(uniform(seed, use, "date", "minute"))
    busy = F.abs(F.col("minute") - MINUTES / 2) / (MINUTES / 2)
    local = F.unix_date("date") * F.lit(86_400_000_000_000) + (F.col("minute") + 570) * F.lit(60_000_000_000)
    return m.withColumn("tz", F.lit(tz)).select(
        F.timestamp_micros((utc_ns(local) / 1000).cast("long")).alias("timestamp"),
        open_.alias("open"), (F.greatest(open_, close) * reach("up")).alias("high"), (F.least(open_, close) / reach("down")).alias("low"), close.alias("close"),
        F.floor(100 + 400 * busy * uniform(seed, "volume", "date", "minute")).cast("double").alias("volume"),
    )


def event_table(
    spark: SparkSession, weeks: int, per_week: float, seed: int = 11, signal: str = "none", slope: float = 0.35, slope_by_year: dict[int, float] | None = None,
    tail: tuple[float, float] = (1.9, 1.5), drift: float = 0.0, scale: float = 1.0, tie: bool = False, noise: int = 1, since: str = "2015-01-01",
) -> DataFrame:
    """Events with a feature ``x``, ``noise`` features ``x1``... that mean nothing, and a target ``y``.

    ``y`` = ``scale`` * (drift + what ``signal`` makes of x + N(0, 1)): nothing, slope * x, slope * (x^2 - 1), or tail[1]
    where x is above tail[0]. ``slope_by_year`` sets other slopes for years; ``tie`` makes x one of five values.
    Each week has floor(per_week) events and one more by chance, at random times of its first five days."""
    if signal not in SIGNALS:
        raise ValueError(f"signal is one of {SIGNALS}")
    whole = int(per_week)
    w = spark.range(weeks).withColumnRenamed("id", "week")
    k = F.lit(whole) + (uniform(seed, "more", "week") < per_week - whole).cast("int")
    e = w.withColumn("no", F.explode(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))))
    day = 86_400_000_000_000
    e = e.withColumn("event_ns", (F.unix_date(F.lit(since).cast("date")) + F.col("week") * 7) * F.lit(day) + F.floor(uniform(seed, "time", "week", "no") * 5 * 86_400).cast("long") * F.lit(1_000_000_000))
    x = normal(seed, "x", "week", "no")
    e = e.withColumn("x", F.round(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), x))) if tie else x)
    e = e.withColumns({f"x{i}": normal(seed, f"x{i}", "week", "no") for i in range(1, noise + 1)})
    s = F.lit(float(slope))
    for year, other in (slope_by_year or {}).items():
        s = F.when(utc_year("event_ns") == year, F.lit(float(other))).otherwise(s)
    told = {"none": F.lit(0.0), "linear": s * F.col("x"), "nonlinear": s * (F.col("x") * F.col("x") - 1), "tail": F.when(F.col("x") > tail[0], tail[1]).otherwise(0.0)}[signal]
    return e.select(F.format_string("e%d_%d", "week", "no").alias("event_id"), "event_ns", "x", *(f"x{i}" for i in range(1, noise + 1)), (scale * (drift + told + normal(seed, "y", "week", "no"))).alias("y"))
