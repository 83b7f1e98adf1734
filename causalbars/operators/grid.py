"""Irregular readings onto the regular grid of each trading session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.runtime import clean_double

DAY_US = 86_400_000_000


def _minutes(c: str) -> Column:
    part = F.split(F.col(c), ":")
    return part[0].cast("long") * 60 + part[1].cast("long")


def session_slots(bars: DataFrame, instruments: DataFrame) -> DataFrame:
    """Readings with a close inside a session, each with its session and slot.

    Adds ``open_ns`` (UTC ns of the session's start), ``n_slots``, ``step_ns`` and ``slot``. Offsets
    come from the instrument's time zone per local date, so changes of the clock are respected.
    Everything is arithmetic on the row: no shuffle (``instruments`` is one row per symbol and left
    to Catalyst's size check)."""
    zones = instruments.select(
        F.col("symbol").alias("_sym"),
        F.col("timezone_name").alias("_tz"),
        _minutes("rth_open").alias("_from"),
        _minutes("rth_close").alias("_to"),
        (F.col("bar_seconds") * F.lit(1_000_000_000)).alias("step_ns"),
    ).dropDuplicates(["_sym"])
    read = bars.select(
        "series_id",
        F.col("symbol").alias("_sym"),
        F.col("index_ns").cast("long").alias("index_ns"),
        clean_double("close").alias("close"),
        clean_double("volume").alias("volume"),
        F.col("received_at").alias("_seen"),
        F.col("bar_id").alias("_id"),
    ).where(F.col("close").isNotNull() & F.col("index_ns").isNotNull())
    us = F.expr("index_ns div 1000")
    local_us = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col("_tz")))
    at = lambda minute: F.unix_micros(
        F.to_utc_timestamp(F.timestamp_micros(F.col("_day") * DAY_US + F.col(minute) * 60_000_000), F.col("_tz"))
    ) * F.lit(1000)
    return (
        read.join(zones, "_sym")
        .withColumn("_day", F.floor(local_us / F.lit(DAY_US)).cast("long"))
        .withColumn("open_ns", at("_from"))
        .withColumn("_end", at("_to"))
        .where((F.col("index_ns") >= F.col("open_ns")) & (F.col("index_ns") < F.col("_end")))
        .withColumn("n_slots", F.expr("cast(ceil((_end - open_ns) / step_ns) as bigint)"))
        .withColumn("slot", F.expr("(index_ns - open_ns) div step_ns"))
    )


def regular_grid(bars: DataFrame, instruments: DataFrame, max_fill: int = 3) -> DataFrame:
    """One row per interval of each session: ``series_id, slot_ns, close, volume, n_readings, state``.

    A session is a local date on which the series has a reading with a close in regular hours; its
    slots run from the open to the close. Of copies of one stamp the last received counts. A slot
    with readings takes the close of the last one and the sum of volumes (``state`` 'reading'). Runs
    of at most ``max_fill`` empty slots between two readings are filled with a straight line of the
    close and volume 0 ('filled'); longer ones are marked ('gap'), as are those before the first
    ('before') and after the last reading ('after'), with NULL close and volume.

    ``lead`` pairs each reading's slot with the next; only the slots between the two are exploded.
    All steps work on (series, session), which is the one key shuffled on: no key grows with a
    series' length. Rows without close or stamp, or whose symbol has no session, are not readings;
    an empty input gives no rows; a NULL series is a series of its own."""
    key = ["series_id", "open_ns"]
    seen = session_slots(bars, instruments).select(*key, "n_slots", "step_ns", "slot", "index_ns", "close", "volume", "_seen", "_id")
    by_stamp = Window.partitionBy(*key).orderBy("index_ns", F.col("_seen").asc_nulls_first(), "_id")
    last_copy = (
        seen.repartition(*key)
        .withColumn("_next", F.lead("index_ns").over(by_stamp))
        .where(F.col("_next").isNull() | (F.col("_next") != F.col("index_ns")))
    )
    slots = last_copy.groupBy(*key, "slot").agg(
        F.max_by("close", "index_ns").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_readings"),
        F.first("n_slots").alias("n_slots"),
        F.first("step_ns").alias("step_ns"),
    )
    w = Window.partitionBy(*key).orderBy("slot")
    paired = slots.select(
        "*",
        F.lag("slot").over(w).alias("_before"),
        F.lead("slot").over(w).alias("_after"),
        F.lead("close").over(w).alias("_to_close"),
    )
    lo = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.col("slot"))
    hi = F.coalesce(F.col("_after"), F.col("n_slots")) - 1
    out = paired.withColumn("at", F.explode(F.sequence(lo, F.greatest(hi, F.col("slot")))))
    own = F.col("at") == F.col("slot")
    state = (
        F.when(own, "reading")
        .when(F.col("at") < F.col("slot"), "before")
        .when(F.col("_after").isNull(), "after")
        .when(F.col("_after") - F.col("slot") - 1 <= max_fill, "filled")
        .otherwise("gap")
    )
    line = F.col("close") + (F.col("_to_close") - F.col("close")) * (F.col("at") - F.col("slot")) / (F.col("_after") - F.col("slot"))
    return out.withColumn("state", state).select(
        "series_id",
        (F.col("open_ns") + F.col("at") * F.col("step_ns")).alias("slot_ns"),
        F.when(own, F.col("close")).when(F.col("state") == "filled", line).alias("close"),
        F.when(own, F.col("volume")).when(F.col("state") == "filled", F.lit(0.0)).alias("volume"),
        F.when(own, F.col("n_readings")).otherwise(F.lit(0)).alias("n_readings"),
        "state",
    )
