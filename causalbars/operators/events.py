"""Event rules and set operators: boundaries, sessions, de-duplication, cooldown, plugins, chains."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalbars.operators import features
from causalbars.functions.clock import DAY_NS, local_minute
from causalbars.operators.ranks import ranked
from causalbars.operators.targets import SPAN, forward, with_close

# The trials of an experiment, in order.
TARGETS = ("DIR_RETURN_15", "DIR_RETURN_60", "DIR_RETURN_180", "DIR_PATH_SKEW_60")
MODELS = ("RIDGE", "SPLINE", "XGB")
HALVES = ("UPPER_HALF", "LOWER_HALF")


def before(df: DataFrame, stamp: str, cutoff: str) -> DataFrame:
    """Rows stamped before a cutoff, as a predicate that reaches the scan."""
    return df.where(F.col(stamp) < F.lit(cutoff).cast("timestamp"))


def partition_dates(campaigns: DataFrame) -> DataFrame:
    """Development, holdout and lockbox dates with ``valid``: the holdout takes exactly one or two calendar years
    and the lockbox follows at once. Dates that do not parse are NULL and their row is not valid."""
    d = lambda c: F.col(c).try_cast("date")
    dev, end, lock = d("development_end"), d("selection_holdout_end"), d("lockbox_start")
    ok = ((end == F.add_months(dev, 12)) | (end == F.add_months(dev, 24))) & (lock == end)
    return campaigns.select("campaign_id", dev.alias("development_end"), end.alias("holdout_end"), lock.alias("lockbox_start"), F.coalesce(ok, F.lit(False)).alias("valid"))


def known_bars(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars complete at or before the last event of their series: nothing later can matter."""
    last = events.groupBy("series_id").agg(F.max("event_ns").alias("_last"))
    return bars.join(last, "series_id").where(F.col("ts") + F.col("step_ns") <= F.col("_last")).drop("_last")


def in_session(ns: str) -> Column:
    """Whether the local minute lies in regular hours, seconds ignored."""
    m = local_minute(ns)
    return (m >= F.col("rth_from")) & (m < F.col("rth_to"))


def keep_first(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """One event per key, the first in ``order``; combined on the map side, no window."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_x")).select(*key, "_x.*")


def drop_conflicts(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """No event where directions differ at one key; else the first."""
    rest = [c for c in events.columns if c not in key]
    g = events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_x"), F.min("direction").alias("_a"), F.max("direction").alias("_b"))
    return g.where("_a = _b").select(*key, "_x.*")


def cooldown(events: DataFrame, key: list[str], ns: str, gap: Column) -> DataFrame:
    """Greedy by time: an event is kept if it comes ``gap`` ns or more after the last one kept.

    Which events are kept depends on all earlier ones, so no window can say it. But an event that follows a
    gap of quiet is kept whatever came before: it begins a burst of its own. Each burst is folded alone, so a
    hot key is spread over its bursts and only the distance to the previous event, found within days of
    the key, needs an order."""
    day = F.expr(f"{ns} div 86400000000000L")
    d = events.withColumn("_g", gap).withColumn("_day", day)
    w = Window.partitionBy(*key, "_day").orderBy(ns)
    ends = d.groupBy(*key, "_day").agg(F.max(ns).alias("_end"))
    ends = ends.select(*key, "_day", F.lag("_end").over(Window.partitionBy(*key).orderBy("_day")).alias("_before"))
    d = d.join(ends, [*key, "_day"])
    prev = F.coalesce(F.lag(ns).over(w), F.col("_before"))
    d = d.withColumn("_new", F.coalesce(F.col(ns) - prev >= F.col("_g"), F.lit(True)))
    # the start of the burst an event belongs to: the last new one up to it, in its day or carried over
    d = d.withColumn("_s", F.last(F.when(F.col("_new"), F.col(ns)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    carry = d.groupBy(*key, "_day").agg(F.max(F.when(F.col("_new"), F.col(ns))).alias("_l"))
    cw = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*key, "_day", F.last("_l", ignorenulls=True).over(cw).alias("_c"))
    d = d.join(carry, [*key, "_day"]).withColumn("_s", F.coalesce("_s", "_c"))
    b = d.groupBy(*key, "_s").agg(F.array_sort(F.collect_set(ns)).alias("_t"), F.max("_g").alias("_g"))  # one burst
    acc = F.array().cast("array<bigint>")
    kept = F.aggregate("_t", acc, lambda a, x: F.when((F.size(a) == 0) | (x >= F.try_element_at(a, F.lit(-1)) + F.col("_g")), F.concat(a, F.array(x))).otherwise(a))
    return b.select(*key, F.explode(kept).alias(ns))


def event_id(experiment: str, ns: str) -> Column:
    return F.concat(F.col(experiment), F.lit("_E"), F.date_format(F.timestamp_micros(F.expr(f"{ns} div 1000")), "yyyyMMdd'T'HHmmss"))


def window_rows(starts: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Rows of the n positions from ``pos_fwd`` on, which may lie before the first bar."""
    shifted = bars.withColumn("pos", F.col("pos") + SPAN * 4)
    moved = starts.withColumn("pos_fwd", F.col("pos_fwd") + SPAN * 4)
    return forward(moved, shifted, n)


def compare_sets(exported: DataFrame, generated: DataFrame, key: list[str]) -> DataFrame:
    """Full outer comparison of distinct keys: ``exported`` and ``generated`` say where each is."""
    a = exported.select(*key).distinct().withColumn("_a", F.lit(True))
    b = generated.select(*key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(*key, F.col("_a").isNotNull().alias("exported"), F.col("_b").isNotNull().alias("generated"))


def overlaps(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Pairs of rows whose intervals [lo, hi) overlap, each pair once, ``left_id`` before ``right_id``.

    An interval meets others in the calendar years it covers, so the join has a key; a pair that shares several
    years is given in the first one only. Rows without two dates meet none."""
    d = df.select(F.col(key).alias("id"), F.col(lo).try_cast("date").alias("lo"), F.col(hi).try_cast("date").alias("hi")).where("lo is not null and hi is not null").distinct()
    d = d.withColumn("from", F.year(F.least("lo", "hi"))).withColumn("bucket", F.explode(F.sequence("from", F.year(F.greatest("lo", "hi")))))
    a, b = (d.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "lo", "hi", "from"))) for side in ("left", "right"))
    met = (F.col("left_id") < F.col("right_id")) & (F.col("left_lo") < F.col("right_hi")) & (F.col("right_lo") < F.col("left_hi"))
    return a.join(b, "bucket").where(met & (F.col("bucket") == F.greatest("left_from", "right_from"))).select("left_id", "right_id")


def trial_product(spark: SparkSession) -> DataFrame:
    """The 24 trials in their frozen order."""
    rows = [("|".join((t, m, s)), i) for i, (t, m, s) in enumerate(((t, m, s) for t in TARGETS for m in MODELS for s in HALVES), 1)]
    return spark.createDataFrame(rows, "trial_id string, ordinal bigint")


def hash_chain(rows: DataFrame, key: list[str], order: list[str], content: Column, start: str = "GENESIS") -> DataFrame:
    """Per ledger the hash that chains its rows in order: h = sha256(h + content). A ledger's order is its
    meaning, so each is folded as one array; ledgers have a bounded number of entries."""
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, content.alias("_c")))).alias("_x"))
    return g.select(*key, F.size("_x").cast("long").alias("n"), F.aggregate("_x", F.lit(start), lambda a, x: F.sha2(F.concat(a, x["_c"]), 256)).alias("chain"))


def verify_chain(rows: DataFrame, key: list[str], order: list[str], content: Column, stored: str) -> DataFrame:
    """Ledger rows whose stored hash is not that of the chain up to them."""
    s = F.struct(*order, content.alias("_c"), F.col(stored).alias("_h"))
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(s)).alias("_x"))
    prev = F.transform("_x", lambda x, i: F.struct(x.alias("row"), F.when(i == 0, F.lit("GENESIS")).otherwise(F.try_element_at(F.col("_x"), i)["_h"]).alias("prev")))
    e = g.select(*key, F.inline(prev))
    return e.where(~F.col("row._h").eqNullSafe(F.sha2(F.concat("prev", "row._c"), 256))).select(*key, *(F.col(f"row.{o}") for o in order))


def pivots(bars: DataFrame, left: int, right: int) -> DataFrame:
    """The template plugin: an event at the completion of the bar that confirms a pivot, ``right`` bars later.

    A low below the ``left`` lows before it and at most the ``right`` lows after it is a long event, a high
    the other way round a short one; bars that are both are none."""
    c = features.chunked(bars, back=left + right)
    w = Window.partitionBy("series_id", "chunk").orderBy("pos")
    back, fore = w.rowsBetween(-left - right, -right - 1), w.rowsBetween(-right, 0)
    low, high = F.lag("low", right).over(w), F.lag("high", right).over(w)
    up = (low < F.min("low").over(back)) & (low <= F.min("low").over(fore))
    dn = (high > F.max("high").over(back)) & (high >= F.max("high").over(fore))
    d = c.withColumn("_u", up).withColumn("_d", dn).where(F.col("core") & (F.col("pos") >= left + right) & (F.col("_u") != F.col("_d")))
    return d.select("series_id", (F.col("ts") + F.col("step_ns")).alias("event_ns"), F.when(F.col("_u"), 1).otherwise(-1).alias("direction"))


def causality(plugin: Callable[[DataFrame], DataFrame], bars: DataFrame, cutoffs: int = 8, seed: int = 1729) -> DataFrame:
    """One row per series ``series_id, n_cutoffs, n_cut, n_changed``: whether events known at a cutoff depend on later bars.

    Cutoffs are times of the plugin's own events, evenly spread over them, where a look ahead shows first. At
    each the plugin sees the bars complete by then alone (``n_cut`` counts events that come or go), and all bars
    with the later ones at other prices and volumes (``n_changed``). All of these runs are one: each
    (series, cutoff, variant) goes through the plugin as a series of its own. Series without events have no row."""
    full = plugin(bars).select("series_id", "event_ns", "direction")
    times = ranked(full.select("series_id", "event_ns").distinct(), ["series_id"], ["event_ns"], F.expr(f"event_ns div {DAY_NS}L"), "i", "n")
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cutoffs - 1)), lambda k: F.floor(k * (F.col("n") - 1) / (cutoffs - 1)).cast("long")))
    cut = times.where(F.array_contains(at, F.col("i"))).select(F.col("series_id").alias("_s"), "i", F.col("event_ns").alias("_cut"))
    named = lambda s, i, v: F.concat_ws("\x1f", s, i.cast("string"), v)
    b = bars.join(cut, F.col("series_id") == F.col("_s")).withColumn("_late", F.col("ts") + F.col("step_ns") > F.col("_cut"))
    b = b.withColumn("_v", F.explode(F.when(F.col("_late"), F.array(F.lit("changed"))).otherwise(F.array(F.lit("cut"), F.lit("changed")))))
    factor = F.when(F.col("_late"), F.pmod(F.xxhash64("_s", "i", "ts", F.lit(seed)), F.lit(1000)) / 200.0 + 0.2).otherwise(1.0)
    other = b.withColumns({**{c: F.col(c) * factor for c in ("open", "high", "low", "close", "volume")}, "series_id": named(F.col("_s"), F.col("i"), F.col("_v"))})
    seen = plugin(other.select(*bars.columns)).select(F.split("series_id", "\x1f").alias("_k"), "event_ns", "direction")
    seen = seen.select(F.col("_k")[0].alias("_s"), F.col("_k")[1].cast("long").alias("i"), F.col("_k")[2].alias("_v"), "event_ns", "direction")
    got = seen.join(cut, ["_s", "i"]).where("event_ns <= _cut").select("_s", "i", "_v", "event_ns", "direction", F.lit(1).alias("_w"))
    want = full.withColumnRenamed("series_id", "_s").join(cut, "_s").where("event_ns <= _cut").select("_s", "i", F.explode(F.array(F.lit("cut"), F.lit("changed"))).alias("_v"), "event_ns", "direction", F.lit(-1).alias("_w"))
    diff = got.unionByName(want).groupBy("_s", "i", "_v", "event_ns", "direction").agg(F.sum("_w").alias("_w"))
    n = lambda v: F.count(F.when((F.col("_v") == v) & (F.col("_w") != 0), 1))
    return diff.groupBy(F.col("_s").alias("series_id")).agg(F.countDistinct("i").alias("n_cutoffs"), n("cut").alias("n_cut"), n("changed").alias("n_changed"))


def generate(raw: DataFrame, bars: DataFrame, dims: DataFrame, gap: Column) -> DataFrame:
    """Raw plugin events (series_id, event_ns, direction) to a study's: those at the completion of a bar in regular hours,
    one per time and none where directions differ, ``gap`` ns apart, with a whole bar left before the close.

    ``dims``: the zone columns of each series. Order matters: an event that is dropped holds up none after it."""
    e = raw.join(dims, "series_id").withColumn("ts", F.col("event_ns") - F.col("step_ns"))
    e = e.join(bars.select("series_id", "ts"), ["series_id", "ts"], "left_semi").where(in_session("ts"))
    e = drop_conflicts(e.select("series_id", "event_ns", "direction", "step_ns", "tz", "rth_to"), ["series_id", "event_ns"], "direction")
    kept = cooldown(e.select("series_id", "event_ns", "step_ns"), ["series_id"], "event_ns", gap)
    e = with_close(e.join(kept, ["series_id", "event_ns"], "left_semi"))
    return e.where("target_eligible").select("series_id", "event_ns", "direction")


class LadderError(ValueError):
    """A ladder plugin that does not give the declared steps in their order, or whose last step is not the study's events."""


def ladder(steps: dict[str, DataFrame], declared: list[str], final: DataFrame) -> DataFrame:
    """The event sets of a ladder plugin as one table ``step_no, step, series_id, event_ns, direction``.

    The steps must be the declared ones, in their order, and the last the same events as ``final``."""
    if list(steps) != list(declared):
        raise LadderError(f"declared {list(declared)}, got {list(steps)}")
    cols = ["series_id", "event_ns", "direction"]
    last = steps[declared[-1]].select(*cols)
    if not last.exceptAll(final.select(*cols)).isEmpty() or not final.select(*cols).exceptAll(last).isEmpty():
        raise LadderError("the last step is not the study's event set")
    out = None
    for i, (name, df) in enumerate(steps.items()):
        d = df.select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), *cols)
        out = d if out is None else out.unionByName(d)
    return out


def delayed(located: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Events moved to the completion of the bar ``n`` positions after their own; those beyond the data are left out."""
    to = bars.select("series_id", F.col("pos").alias("_to"), (F.col("ts") + F.col("step_ns")).alias("delayed_ns"))
    return located.withColumn("_to", F.col("pos_t") + n).join(to, ["series_id", "_to"]).drop("_to")


def probes(base: dict[str, float | int], multipliers: tuple[float, ...] = (0.75, 1.25)) -> list[tuple[str, float, dict]]:
    """Parameter sets that differ from ``base`` in one number: (parameter, multiplier, parameters), integers rounded half up
    and at least 1, sets like the base left out."""
    out = []
    for name, v in base.items():
        for m in multipliers:
            x = max(1, int(v * m + 0.5)) if isinstance(v, int) else v * m
            if x != v:
                out.append((name, m, {**base, name: x}))
    return out


def trial_sets(trials: DataFrame, by: str) -> DataFrame:
    """How each experiment's trials (target, half, model) stand to the declared product: ``by, n_trials, n_missing, n_unknown,
    n_repeated``."""
    want = trial_product(trials.sparkSession).select(F.col("trial_id").alias("_t"), F.lit(True).alias("_w"))
    n = trials.groupBy(by, F.concat_ws("|", "target", "model", "half").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    g = n.join(want, "_t", "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_trials"), F.count("_w").alias("_ok"), F.count(F.when(F.col("_n") > 1, 1)).alias("n_repeated"))
    size = len(TARGETS) * len(MODELS) * len(HALVES)
    return g.select(by, "n_trials", (size - F.col("_ok")).alias("n_missing"), (F.col("n_trials") - F.col("_ok")).alias("n_unknown"), "n_repeated")


def run_plugin(bars: DataFrame, detect: Callable[[pd.DataFrame, dict], pd.DataFrame], params: dict) -> DataFrame:
    """A pandas plugin ``detect(bars, params) -> [event_time, direction]`` per series, as a grouped map. It sees a
    whole series; plugins that are DataFrame functions, like ``pivots``, need no such group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        idx = pd.DatetimeIndex(pd.to_datetime(g["ts"], utc=True), name="timestamp")
        out = detect(g[["open", "high", "low", "close", "volume"]].set_index(idx), dict(params))
        ns = pd.DatetimeIndex(out["event_time"]).tz_convert("UTC").as_unit("ns").asi8
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "event_ns": ns, "direction": out["direction"].to_numpy("int32")})

    return bars.groupBy("series_id").applyInPandas(run, "series_id string, event_ns bigint, direction int")


class StrictParams(dict):
    """Parameters that refuse unregistered keys and remember which were read."""

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        self.used: set[str] = set()

    def __getitem__(self, key):
        if key not in self:
            raise KeyError(f"unregistered parameter {key!r}")
        self.used.add(key)
        return super().__getitem__(key)

    def get(self, key, default=None):
        raise TypeError("parameters have no defaults: register the key")

    def unused(self) -> set[str]:
        return set(self) - self.used
