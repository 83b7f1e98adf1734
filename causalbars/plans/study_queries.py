"""Queries of the event-study operators over ``bars``, ``study_events`` and the registry tables.

Each query has its counterpart in SQL. Doubles are rounded to ten decimals on both sides, since sums are
taken in another order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalbars.functions.clock import local_day, local_minute, utc_year, week_key
from causalbars.operators import crossval, events, features, graphs, nested, pathstats, positions, stats, targets
from causalbars.plans.data_queries import P4_SQL
from causalbars.runtime import file_bytes, stored, table
from causalbars.sources import bars as bar_source
from causalbars.sources import registry
from causalbars.streaming import resample

DIGITS = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def query(sql: str | None = None, digits: int = DIGITS):
    """Register a query. Points of absurd prices reach 1e7 and more, so summaries of points keep fewer decimals."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d), digits)
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace(f", {DIGITS})", f", {digits})")
        return f

    return add


# ---------------------------------------------------------------- shared inputs
def bars_of(spark: SparkSession, d: str) -> DataFrame:
    return bar_source.clean_bars(table(spark, d, "bars"), table(spark, d, "instruments"))


def placed_bars(spark: SparkSession, d: str) -> DataFrame:
    return positions.with_positions(bars_of(spark, d))


def located(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    b = bars_of(spark, d) if bars is None else bars
    return targets.with_close(positions.locate(bar_source.clean_events(table(spark, d, "study_events")), b))


def eligible(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    return located(spark, d, bars).where("target_eligible")


BASE = """
WITH zone AS (
  SELECT symbol, timezone_name AS tz, bar_seconds * 1000000000 AS step_ns, tick_size AS tick, rth_minutes,
    split_part(rth_open, ':', 1)::BIGINT * 60 + split_part(rth_open, ':', 2)::BIGINT AS rth_from,
    split_part(rth_close, ':', 1)::BIGINT * 60 + split_part(rth_close, ':', 2)::BIGINT AS rth_to,
    split_part(eth_session_start, ':', 1)::BIGINT * 60 + split_part(eth_session_start, ':', 2)::BIGINT AS eth_from
  FROM instruments),
cb AS (
  SELECT series_id, index_ns AS ts, open, high, low, close, volume, zone.*,
    row_number() OVER (PARTITION BY series_id ORDER BY index_ns) - 1 AS pos
  FROM (
    SELECT * FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= low
    QUALIFY row_number() OVER (PARTITION BY series_id, index_ns ORDER BY received_at DESC, bar_id DESC) = 1)
  JOIN zone USING (symbol)),
ce AS (
  SELECT event_id, experiment_id, series_id, epoch_us(event_time) * 1000 AS event_ns, direction FROM study_events
  WHERE direction IN (-1, 1) AND event_time IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY logged_at, series_id, event_time, direction) = 1),
dim AS (SELECT series_id, any_value(symbol) AS symbol, any_value(tz) AS tz, any_value(step_ns) AS step_ns, any_value(tick) AS tick,
    any_value(rth_from) AS rth_from, any_value(rth_to) AS rth_to, any_value(rth_minutes) AS rth_minutes, any_value(eth_from) AS eth_from, count(*) AS n_bars FROM cb GROUP BY 1),
e0 AS (SELECT ce.*, dim.* EXCLUDE (series_id), event_ns - step_ns AS done_ns FROM ce JOIN dim USING (series_id)),
e1 AS (SELECT e0.*, coalesce(b.pos, -1) AS pos_t FROM e0 ASOF LEFT JOIN cb b ON e0.series_id = b.series_id AND e0.done_ns >= b.ts),
e2 AS (SELECT e1.*, coalesce(b.pos, n_bars) AS pos_fwd FROM e1 ASOF LEFT JOIN cb b ON e1.series_id = b.series_id AND e1.event_ns <= b.ts),
ev AS (
  SELECT *, event_ns + step_ns <= close_ns AS target_eligible FROM (
    SELECT *, epoch_us(((make_timestamptz(event_ns // 1000) AT TIME ZONE tz)::DATE + to_minutes(rth_to)) AT TIME ZONE tz) * 1000 AS close_ns FROM e2)),
el AS (SELECT * FROM ev WHERE target_eligible)
"""


def sql(body: str) -> str:
    return BASE + body


# ---------------------------------------------------------------- scans and filters
@query(sql("SELECT series_id, ts, pos, open, high, low, close, volume FROM cb"))
def src1_load_bars(spark, d):
    return placed_bars(spark, d).select("series_id", "ts", "pos", "open", "high", "low", "close", "volume")


@query("SELECT symbol, count(*) AS n, max(bar_time) < TIMESTAMPTZ '2019-01-01 00:00:00+00' AS all_before FROM bars WHERE bar_time < TIMESTAMPTZ '2019-01-01 00:00:00+00' GROUP BY 1")
def src2_bars_before(spark, d):
    b = events.before(table(spark, d, "bars", "symbol", "bar_time"), "bar_time", "2019-01-01 00:00:00+00:00")
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.max("bar_time") < F.lit("2019-01-01 00:00:00+00:00").cast("timestamp")).alias("all_before"))


@query("SELECT series_id, index_ns, count(*) AS n FROM bars GROUP BY 1, 2 HAVING count(*) > 1 OR index_ns IS NULL")
def src3_stamp_violations(spark, d):
    return bar_source.violations(table(spark, d, "bars", "series_id", "index_ns"), ["series_id"], "index_ns")


@query(sql("""SELECT c.campaign_id, count(e.event_id) AS n_development,
  count(e.event_id) FILTER (WHERE event_ns >= epoch_us(development_end::DATE::TIMESTAMP) * 1000) AS n_holdout
FROM campaigns c JOIN experiments_one x USING (campaign_id) JOIN ce e USING (experiment_id)
WHERE event_ns < epoch_us(selection_holdout_end::DATE::TIMESTAMP) * 1000 GROUP BY 1""").replace("el AS (", "experiments_one AS (SELECT DISTINCT experiment_id, campaign_id FROM experiments),\nel AS ("))
def flt1_flt2_partition_views(spark, d):
    ev = bar_source.clean_events(table(spark, d, "study_events"))
    x = table(spark, d, "experiments", "experiment_id", "campaign_id").distinct()
    c = table(spark, d, "campaigns", "campaign_id", "development_end", "selection_holdout_end")
    day = lambda n: F.unix_date(F.col(n).cast("date")) * F.lit(86_400_000_000_000)
    j = ev.join(x, "experiment_id").join(c, "campaign_id").where(F.col("event_ns") < day("selection_holdout_end"))
    return j.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_development"), F.count(F.when(F.col("event_ns") >= day("development_end"), 1)).alias("n_holdout"))


@query("""SELECT campaign_id, development_end::DATE::VARCHAR AS development_end, selection_holdout_end::DATE::VARCHAR AS holdout_end, lockbox_start::DATE::VARCHAR AS lockbox_start,
  (selection_holdout_end::DATE IN (development_end::DATE + INTERVAL 1 YEAR, development_end::DATE + INTERVAL 2 YEAR) AND lockbox_start::DATE = selection_holdout_end::DATE) AS valid
FROM campaigns""")
def flt3_partition_dates(spark, d):
    p = events.partition_dates(table(spark, d, "campaigns"))
    return p.withColumns({c: F.col(c).cast("string") for c in ("development_end", "holdout_end", "lockbox_start")})


@query(sql("SELECT series_id, count(*) AS n FROM cb JOIN (SELECT series_id, max(event_ns) AS last FROM ce GROUP BY 1) USING (series_id) WHERE ts + step_ns <= last GROUP BY 1"))
def flt4_information_boundary(spark, d):
    b, e = bars_of(spark, d), bar_source.clean_events(table(spark, d, "study_events"))
    return events.known_bars(b, e).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT series_id, count(*) AS n FROM (SELECT series_id, extract(hour FROM l) * 60 + extract(minute FROM l) AS m, rth_from, rth_to
  FROM (SELECT *, make_timestamptz(ts // 1000) AT TIME ZONE tz AS l FROM cb)) WHERE m >= rth_from AND m < rth_to GROUP BY 1"""))
def flt5_session_bars(spark, d):
    return bars_of(spark, d).where(events.in_session("ts")).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT series_id, event_ns, min(event_id) AS event_id FROM ce GROUP BY 1, 2"))
def flt6_first_per_time(spark, d):
    return events.keep_first(bar_source.clean_events(table(spark, d, "study_events")), ["series_id", "event_ns"], "event_id").select("series_id", "event_ns", "event_id")


@query(sql("SELECT series_id, event_ns, min(event_id) AS event_id, min(direction)::INT AS direction FROM ce GROUP BY 1, 2 HAVING count(DISTINCT direction) = 1"))
def flt7_drop_conflicts(spark, d):
    e = events.drop_conflicts(bar_source.clean_events(table(spark, d, "study_events")), ["series_id", "event_ns"], "event_id")
    return e.select("series_id", "event_ns", "event_id", "direction")


@query(sql("""SELECT series_id, unnest(kept) AS event_ns FROM (
  SELECT series_id, list_reduce(ts, lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] >= acc[-1] + gap THEN list_append(acc, x[1]) ELSE acc END, []::BIGINT[]) AS kept
  FROM (SELECT series_id, list([event_ns] ORDER BY event_ns) AS ts, any_value(step_ns) * 5 AS gap FROM (SELECT DISTINCT series_id, event_ns, step_ns FROM e0) GROUP BY 1))"""))
def flt8_cooldown(spark, d):
    e = located(spark, d).select("series_id", "event_ns", "step_ns").distinct()
    return events.cooldown(e, ["series_id"], "event_ns", F.col("step_ns") * 5).select("series_id", "event_ns")


@query(sql("SELECT event_id, target_eligible, event_ns + step_ns > close_ns AS too_late FROM ev"))
def flt9_target_timestamp(spark, d):
    return located(spark, d).select("event_id", "target_eligible", (F.col("event_ns") + F.col("step_ns") > F.col("close_ns")).alias("too_late"))


@query(sql("SELECT event_id, pos_t + 1 AS completed_bars, pos_t + 1 >= 480 AS eligible FROM ev"))
def flt10_history(spark, d):
    return located(spark, d).select("event_id", (F.col("pos_t") + 1).alias("completed_bars"), (F.col("pos_t") + 1 >= features.MIN_HISTORY).alias("eligible"))


@query(sql("""SELECT experiment_id, count(*) AS n, count(*) / (SELECT count(DISTINCT strftime(make_timestamptz(ts // 1000) AT TIME ZONE tz, '%G-W%V')) FROM cb) < 2.0 AS below_base FROM ce GROUP BY 1"""))
def flt15_base_frequency(spark, d):
    w = stats.weeks_with_bars(bars_of(spark, d)).where("year is null").first()["n_weeks"]
    e = bar_source.clean_events(table(spark, d, "study_events")).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("below_base", F.col("n") / F.lit(w) < 2.0)


@query(sql("SELECT event_id, experiment_id || '_E' || strftime(make_timestamp(event_ns // 1000), '%Y%m%dT%H%M%S') AS formatted FROM ce"))
def prj1_event_ids(spark, d):
    e = bar_source.clean_events(table(spark, d, "study_events"))
    return e.select("event_id", events.event_id("experiment_id", "event_ns").alias("formatted"))


# ---------------------------------------------------------------- as-of and interval joins
@query(sql("SELECT event_id, series_id, pos_t FROM ev"))
def jn1_last_complete_bar(spark, d):
    return located(spark, d).select("event_id", "series_id", "pos_t")


@query(sql("SELECT event_id, series_id, pos_fwd FROM ev"))
def jn2_first_forward_bar(spark, d):
    return located(spark, d).select("event_id", "series_id", "pos_fwd")


@query(sql("""SELECT event_id, count(b.pos) AS n, min(low) AS lo, max(high) AS hi FROM ev e JOIN cb b ON e.series_id = b.series_id AND b.pos BETWEEN e.pos_t - 59 AND e.pos_t GROUP BY 1"""))
def jn3_trailing_window(spark, d):
    b = placed_bars(spark, d)
    e = located(spark, d, b).withColumn("pos_fwd", F.col("pos_t") - 59).select("event_id", "series_id", "pos_fwd")
    # the window of 60 bars that ends at pos_t begins 59 earlier; positions below 0 do not exist
    f = events.window_rows(e, b, 60)
    return f.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("b_low").alias("lo"), F.max("b_high").alias("hi"))


@query(sql("""SELECT event_id, count(b.pos) AS n, min(low) AS lo, max(high) AS hi FROM ev e JOIN cb b ON e.series_id = b.series_id AND b.pos BETWEEN e.pos_fwd AND e.pos_fwd + 179 GROUP BY 1"""))
def jn4_forward_window(spark, d):
    b = placed_bars(spark, d)
    f = targets.forward(located(spark, d, b).select("event_id", "series_id", "pos_fwd"), b, 180)
    return f.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("b_low").alias("lo"), F.max("b_high").alias("hi"))


@query(sql("""SELECT event_id, event_ns % step_ns = 0 AND EXISTS (SELECT 1 FROM cb b WHERE b.series_id = e0.series_id AND b.ts = e0.done_ns) AS is_completion FROM e0"""))
def jn8_completion_check(spark, d):
    b = bars_of(spark, d)
    e = located(spark, d).withColumn("ts", F.col("event_ns") - F.col("step_ns"))
    hit = e.join(b.select("series_id", "ts"), ["series_id", "ts"], "left_semi").select("event_id", F.lit(True).alias("hit"))
    return e.join(hit, "event_id", "left").select("event_id", (F.coalesce("hit", F.lit(False)) & (F.col("event_ns") % F.col("step_ns") == 0)).alias("is_completion"))


@query(sql("""SELECT series_id, h.event_ns IS NOT NULL AS exported, g.event_ns IS NOT NULL AS generated, count(*) AS n
FROM (SELECT DISTINCT series_id, event_ns FROM ce WHERE direction = 1) h FULL JOIN (SELECT DISTINCT series_id, ts AS event_ns FROM cb) g USING (series_id, event_ns) GROUP BY ALL"""))
def jn11_set_comparison(spark, d):
    a = bar_source.clean_events(table(spark, d, "study_events")).where("direction = 1").select("series_id", "event_ns")
    return events.compare_sets(a, bars_of(spark, d).select("series_id", F.col("ts").alias("event_ns")), ["series_id", "event_ns"]).groupBy("series_id", "exported", "generated").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT campaign_id, TRY_CAST(development_end AS DATE) AS a, TRY_CAST(selection_holdout_end AS DATE) AS z FROM campaigns)
SELECT x.campaign_id AS left_id, y.campaign_id AS right_id FROM c x JOIN c y ON x.campaign_id < y.campaign_id AND x.a < y.z AND y.a < x.z""")
def jn12_interval_overlap(spark, d):
    """Every two campaigns whose holdout intervals overlap."""
    return events.overlaps(table(spark, d, "campaigns"), "campaign_id", "development_end", "selection_holdout_end")


@query(sql("SELECT series_id, (make_timestamptz(ts // 1000) AT TIME ZONE tz)::DATE - DATE '1970-01-01' AS day, min(pos) AS pos, min_by(ts, pos) AS first_ts, min_by(open, pos) AS open, max_by(close, pos) AS close FROM cb GROUP BY 1, 2"))
def w5_first_row_per_group(spark, d):
    """The first bar of each local day of a series, and the day's last close."""
    b = placed_bars(spark, d).withColumn("day", local_day("ts"))
    return b.groupBy("series_id", "day").agg(F.min("pos").alias("pos"), F.min_by("ts", "pos").alias("first_ts"), F.min_by("open", "pos").alias("open"), F.max_by("close", "pos").alias("close"))


# ---------------------------------------------------------------- features
FEATURE_BASE = sql(""", f0 AS (
  SELECT *, ln(close) AS x, lag(close) OVER w AS pc, lag(ln(close)) OVER w AS px FROM cb WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
f1 AS (SELECT *, x - px AS r, abs(close - pc) AS dc, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, sign(close - open) AS sg FROM f0)
""")


def _feature_sql(exprs: dict[str, str], extra: str = "", source: str = "f1", where: str = "") -> str:
    cols = ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())
    names = ", ".join(f'CASE WHEN isnan("{n}") OR isinf("{n}") THEN NULL ELSE round("{n}", {DIGITS}) + 0.0 END AS "{n}"' for n in exprs)
    return f"{FEATURE_BASE}{extra}, g AS (SELECT series_id, pos, {cols} FROM {source} {where}) SELECT event_id, pos_t + 1 AS completed_bars, {names} FROM ev LEFT JOIN g ON ev.series_id = g.series_id AND ev.pos_t = g.pos"


def _w(n: int) -> str:
    return f"OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _past(e: str, n: int) -> str:
    return f"lag({e}, {n}) OVER (PARTITION BY series_id ORDER BY pos)"


def _if(n: int, e: str) -> str:
    return f"CASE WHEN pos >= {n} THEN {e} END"


_VR_EXTRA = ", v0 AS (SELECT series_id, pos, " + ", ".join(f"x - {_past('x', q)} AS q{q}" for q in (1, 2, 4, 8)) + " FROM f1), v1 AS (SELECT series_id, pos, " + ", ".join(
    f"var_pop(q{q}) OVER (PARTITION BY series_id, pos % {q} ORDER BY pos ROWS BETWEEN {(n - 1) // q - 1} PRECEDING AND CURRENT ROW) AS v{q}_{n}" for q in (1, 2, 4, 8) for n in features.VR_WINDOWS
) + " FROM v0)"
_HURST_EXTRA = ", h0 AS (SELECT series_id, pos, " + ", ".join(f"pow(x - {_past('x', k)}, 2) AS d{k}" for k in features.HURST_LAGS) + " FROM f1), h1 AS (SELECT series_id, pos, " + ", ".join(
    f"CASE WHEN avg(d{k}) {_w(n - k)} > 0 THEN ln(avg(d{k}) {_w(n - k)}) END AS y{n}_{k}" for n in features.HURST_WINDOWS for k in features.HURST_LAGS
) + " FROM h0), h2 AS (SELECT * FROM h1)"


def _hurst(n: int) -> str:
    y = [f"y{n}_{k}" for k in features.HURST_LAGS]
    lists = f"list_filter([{', '.join(f'[ln({k}), {v}]' for k, v in zip(features.HURST_LAGS, y))}], lambda p: p[2] IS NOT NULL)"
    return _if(n - 1, f"CASE WHEN len({lists}) >= 4 THEN list_reduce(list_transform({lists}, lambda p: (p[1] - list_avg(list_transform({lists}, lambda z: z[1]))) * p[2]), lambda a, b: a + b) / list_reduce(list_transform({lists}, lambda p: pow(p[1] - list_avg(list_transform({lists}, lambda z: z[1])), 2)), lambda a, b: a + b) / 2 END")


FEATURE_SQL = {
    "f1_returns": _feature_sql({f"RET_{n}": _if(n, f"x - {_past('x', n)}") for n in features.RET}),
    "f2_realized_volatility": _feature_sql({f"RV_{n}": _if(n, f"sqrt(sum(r * r) {_w(n)})") for n in features.RV}),
    "f3_volatility_of_volatility": _feature_sql({f"VOV_{n}": _if(n, f"(stddev_pop(tr) {_w(n)})::FLOAT::DOUBLE") for n in features.VOV}),
    "f4_efficiency_ratio": _feature_sql({f"ER_{n}": _if(n, f"abs(close - {_past('close', n)}) / nullif(sum(dc) {_w(n)}, 0)") for n in features.ER}),
    "f5_brownian_displacement": _feature_sql({f"BROWNIAN_DISP_{n}": _if(n, f"(x - {_past('x', n)}) / nullif(sqrt(sum(r * r) {_w(n)}), 0)") for n in features.BROWNIAN}),
    "f6_variance_ratio": _feature_sql({f"VR_{n}_{q}": _if(n - 1, f"v{q}_{n} / nullif({q} * v1_{n}, 0)") for n in features.VR_WINDOWS for q in features.VR_Q}, _VR_EXTRA, "v1"),
    "f7_hurst": _feature_sql({f"HURST_{n}": _hurst(n) for n in features.HURST_WINDOWS}, _HURST_EXTRA, "h2"),
    "f8_count_balance": _feature_sql({f"COUNT_BALANCE_{n}": _if(n - 1, f"sum(sg) {_w(n)} / {n}.0") for n in features.BALANCE}),
    "f9_body_balance": _feature_sql({f"BODY_BALANCE_{n}": _if(n - 1, f"sum(close - open) {_w(n)} / nullif(sum(abs(close - open)) {_w(n)}, 0)") for n in features.BALANCE}),
    "f10_range_position": _feature_sql({f"RANGE_POS_{n}": _if(n - 1, f"CASE WHEN max(high) {_w(n)} > min(low) {_w(n)} THEN (close - min(low) {_w(n)}) / (max(high) {_w(n)} - min(low) {_w(n)}) ELSE 0.5 END") for n in features.RANGE}),
    "f11_signed_volume": _feature_sql({f"SIGNED_VOLUME_{n}": _if(n - 1, f"sum(sg * volume) {_w(n)} / nullif(sum(volume) {_w(n)}, 0)") for n in features.VOLUME}),
    "f12_minutes_since_open": sql("SELECT event_id, pos_t + 1 AS completed_bars, round(epoch(l - l::DATE) / 60 - rth_from, 10) + 0.0 AS \"minutes_since_RTH_open\" FROM (SELECT *, date_trunc('second', make_timestamptz(event_ns // 1000) AT TIME ZONE tz) AS l FROM ev)"),
    "f13_session_phase": sql("""SELECT event_id, pos_t + 1 AS completed_bars, round(sin(2 * pi() * m / rth_minutes), 10) + 0.0 AS "sin_RTH_phase", round(cos(2 * pi() * m / rth_minutes), 10) + 0.0 AS "cos_RTH_phase"
FROM (SELECT *, epoch(l - l::DATE) / 60 - rth_from AS m FROM (SELECT *, date_trunc('second', make_timestamptz(event_ns // 1000) AT TIME ZONE tz) AS l FROM ev))"""),
    "f14_return_from_open": sql(""", s AS (SELECT *, make_timestamptz(ts // 1000) AT TIME ZONE tz AS l FROM cb),
g AS (SELECT series_id, pos, close, first_value(CASE WHEN extract(hour FROM l) * 60 + extract(minute FROM l) >= rth_from AND extract(hour FROM l) * 60 + extract(minute FROM l) < rth_to THEN open END IGNORE NULLS)
  OVER (PARTITION BY series_id, l::DATE ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM s)
SELECT event_id, pos_t + 1 AS completed_bars, round(ln(close / px), 10) + 0.0 AS "RTH_return_from_open" FROM ev LEFT JOIN g ON ev.series_id = g.series_id AND ev.pos_t = g.pos"""),
    "f15_vwap_distance": sql(""", s AS (SELECT *, l::DATE + CASE WHEN extract(hour FROM l) * 60 + extract(minute FROM l) >= eth_from THEN 1 ELSE 0 END AS sess FROM (SELECT *, make_timestamptz(ts // 1000) AT TIME ZONE tz AS l FROM cb)),
g AS (SELECT series_id, pos, close, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM s WINDOW w AS (PARTITION BY series_id, sess ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, pos_t + 1 AS completed_bars, round(close / vwap - 1, 10) + 0.0 AS "distance_from_causal_session_VWAP" FROM ev LEFT JOIN g ON ev.series_id = g.series_id AND ev.pos_t = g.pos"""),
    "f16_day_of_week": sql("SELECT event_id, pos_t + 1 AS completed_bars, (isodow(make_timestamptz(event_ns // 1000) AT TIME ZONE tz) - 1)::DOUBLE AS day_of_week FROM ev"),
}


def _family(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        b = placed_bars(spark, d)
        f = features.compute_features(located(spark, d, b), b, features.FAMILIES[name])
        if name == "f3_volatility_of_volatility":  # of prices, some absurd: seven digits rather than nine decimals
            f = f.withColumns({c: F.col(c).cast("float").cast("double") for c in features.FAMILIES[name]})
        return f

    run.__name__ = name
    query(FEATURE_SQL[name])(run)


for _name in features.FAMILIES:
    _family(_name)


# ---------------------------------------------------------------- targets
_H = "greatest(least({n}, (close_ns - event_ns) // el.step_ns), 1)"
TARGET_BASE = BASE + ", tg AS (" + " UNION ALL ".join(
    f"SELECT event_id, 'DIR_RETURN_{n}' AS target_name, b0.ts AS target_start_ns, b1.ts + el.step_ns AS target_end_ns, direction * ln(b1.close / b0.open) AS value, {_H.format(n=n)} AS horizon_bars_effective, {_H.format(n=n)} < {n} AS truncated, b1.ts + el.step_ns > close_ns AS crosses_session "
    f"FROM el JOIN cb b0 ON el.series_id = b0.series_id AND b0.pos = pos_fwd JOIN cb b1 ON el.series_id = b1.series_id AND b1.pos = pos_fwd + {_H.format(n=n)} - 1"
    for n in targets.RETURN_TARGETS
) + f""" UNION ALL SELECT event_id, 'DIR_PATH_SKEW_60', t0, t1 + step_ns, CASE WHEN direction > 0 THEN ln(hi / p0) + ln(lo / p0) ELSE -ln(lo / p0) - ln(hi / p0) END, n_eff, n_eff < 60, t1 + step_ns > close_ns FROM (
  SELECT event_id, direction, el.step_ns, close_ns, {_H.format(n=60)} AS n_eff, max(b.high) AS hi, min(b.low) AS lo, min_by(b.open, b.pos) AS p0, min(b.ts) AS t0, max(b.ts) AS t1, count(*) AS n
  FROM el JOIN cb b ON el.series_id = b.series_id AND b.pos BETWEEN pos_fwd AND pos_fwd + {_H.format(n=60)} - 1 GROUP BY ALL) WHERE n = n_eff)
"""  # fmt: skip


def _targets(spark, d, b=None):
    b = placed_bars(spark, d) if b is None else b
    return targets.primary_targets(eligible(spark, d, b), b)


@query(TARGET_BASE + "SELECT event_id, target_name, target_start_ns, target_end_ns, target_end_ns AS effective_target_end_ns, round(value, 10) + 0.0 AS value, horizon_bars_effective, truncated, crosses_session FROM tg")
def tg3_tg4_primary_targets(spark, d):
    return _targets(spark, d)


@query(sql("SELECT event_id, close_ns, (close_ns - event_ns) // step_ns AS bars_left, greatest(least(60, (close_ns - event_ns) // step_ns), 1) AS n_eff_60 FROM el"))
def tg1_tg2_session_close(spark, d):
    return eligible(spark, d).select("event_id", "close_ns", F.expr("(close_ns - event_ns) div step_ns").alias("bars_left"), targets.horizon(60).alias("n_eff_60"))


@query(TARGET_BASE + "SELECT target_name, count(*) AS n_resolved, count(*) FILTER (WHERE crosses_session) AS n_crossing, count(*) FILTER (WHERE truncated) AS n_truncated FROM tg GROUP BY 1")
def tg5_session_check(spark, d):
    return _targets(spark, d).groupBy("target_name").agg(F.count(F.lit(1)).alias("n_resolved"), F.count(F.when(F.col("crosses_session"), 1)).alias("n_crossing"), F.count(F.when(F.col("truncated"), 1)).alias("n_truncated"))


@query(sql("SELECT count(*) AS n_violations FROM el JOIN cb a ON el.series_id = a.series_id AND a.pos = pos_fwd JOIN cb z ON el.series_id = z.series_id AND z.pos = pos_fwd + 59 WHERE z.ts - a.ts > el.step_ns * 59"))
def tg8_span_violations(spark, d):
    b = placed_bars(spark, d)
    return targets.span_violations(eligible(spark, d, b), b, 60)


def with_sigma(spark, d, b):
    """Eligible events with sigma = RV_60 / sqrt(60)."""
    e = eligible(spark, d, b)
    rv = features.bar_features(b, ["RV_60"]).select("series_id", F.col("pos").alias("pos_t"), (F.col("RV_60") / F.sqrt(F.lit(60.0))).alias("sigma"))
    return e.join(rv, ["series_id", "pos_t"], "left")


DIAG_BASE = FEATURE_BASE + f""", sg AS (SELECT series_id, pos, {_if(60, f'sqrt(sum(r * r) {_w(60)})')} / sqrt(60) AS sigma FROM f1),
es AS (SELECT el.*, sigma, b.open AS p0 FROM el JOIN cb b ON el.series_id = b.series_id AND b.pos = pos_fwd LEFT JOIN sg ON el.series_id = sg.series_id AND sg.pos = pos_t),
fw AS (SELECT event_id, direction, event_ns, close_ns, es.step_ns, sigma, p0, (b.pos - pos_fwd) AS j, b.ts, b.high, b.low, b.close,
  lag(b.close) OVER (PARTITION BY event_id ORDER BY b.pos) AS pc,
  CASE WHEN direction > 0 THEN ln(b.high / p0) ELSE -ln(b.low / p0) END AS lf, CASE WHEN direction > 0 THEN ln(b.low / p0) ELSE -ln(b.high / p0) END AS la,
  CASE WHEN direction > 0 THEN b.high - p0 ELSE p0 - b.low END AS fav, CASE WHEN direction > 0 THEN b.low - p0 ELSE p0 - b.high END AS adv
  FROM es JOIN cb b ON es.series_id = b.series_id AND b.pos BETWEEN pos_fwd AND pos_fwd + 119),
fs AS (SELECT *, CASE WHEN j < 60 THEN ln(close / coalesce(pc, p0)) END AS st FROM fw)
"""


def _whole(n: int, e: str, digits: bool = True) -> str:
    x = f"CASE WHEN max(j) >= {n - 1} AND any_value(event_ns) + any_value(step_ns) * {n} <= any_value(close_ns) THEN {e} END"
    return f"round({x}, 10) + 0.0" if digits else x


_DIAG = {f"DIAG_RET_{n}": _whole(n, f"any_value(direction) * ln(max(close) FILTER (WHERE j = {n - 1}) / any_value(p0))") for n in targets.DIAG_RETURNS}
for _n in targets.DIAG_EXCURSIONS:
    _DIAG |= {
        f"DIAG_MFE_{_n}": _whole(_n, f"max(lf) FILTER (WHERE j < {_n})"),
        f"DIAG_MAE_{_n}": _whole(_n, f"min(la) FILTER (WHERE j < {_n})"),
        f"DIAG_TIME_TO_MFE_{_n}": _whole(_n, f"(arg_min(j, [-lf, j]) FILTER (WHERE j < {_n}) + 1)::INT", False),
        f"DIAG_TIME_TO_MAE_{_n}": _whole(_n, f"(arg_min(j, [la, j]) FILTER (WHERE j < {_n}) + 1)::INT", False),
    }
for _k in targets.FIRST_PASSAGE:
    _DIAG[f"DIAG_FIRST_PASSAGE_{_k}".replace(".", "_")] = _whole(60, f"sign(coalesce(min(j) FILTER (WHERE j < 60 AND la <= -sigma * {_k}), 9999) - coalesce(min(j) FILTER (WHERE j < 60 AND lf >= sigma * {_k}), 9999))::INT", False)
_DIAG |= {"DIAG_PATH_LENGTH_60": _whole(60, "sum(abs(st))"), "DIAG_PATH_EFFICIENCY_60": _whole(60, "abs(sum(st)) / nullif(sum(abs(st)), 0)"), "DIAG_FWD_RV_60": _whole(60, "sqrt(sum(st * st))")}


@query(DIAG_BASE + "SELECT event_id, " + ", ".join(f'{e} AS "{n}"' for n, e in _DIAG.items()) + " FROM fs GROUP BY event_id")
def tg7_diagnostic_targets(spark, d):
    b = placed_bars(spark, d)
    return targets.diagnostics(with_sigma(spark, d, b), b)


# ---------------------------------------------------------------- paths
def _paths(spark, d):
    b = placed_bars(spark, d)
    e = with_sigma(spark, d, b)
    p = targets.paths(e, b)
    return p.join(e.select("event_id", "experiment_id", "symbol", "tick"), "event_id").withColumn("year", utc_year("event_ns"))


_PATH_COLS = ", ".join(
    f"coalesce(max(ts) FILTER (WHERE j = {h - 1}) - min(ts) = (any_value(step_ns) * {h - 1}) AND max(ts) FILTER (WHERE j = {h - 1}) + any_value(step_ns) <= any_value(close_ns), false) AS elig_{h}, max(close) FILTER (WHERE j = {h - 1}) AS close_{h}, "
    f"max(fav) FILTER (WHERE j < {h}) AS mfe_{h}, min(adv) FILTER (WHERE j < {h}) AS mae_{h}, (arg_min(j, [-fav, j]) FILTER (WHERE j < {h}) + 1)::INT AS t_mfe_{h}, (arg_min(j, [adv, j]) FILTER (WHERE j < {h}) + 1)::INT AS t_mae_{h}"
    for h in targets.PATH_HORIZONS
)
_TOUCH = ", ".join(f'min(j) FILTER (WHERE lf >= sigma * {k}) + 1 AS "t_fav_{k}", min(j) FILTER (WHERE la <= -sigma * {k}) + 1 AS "t_adv_{k}"' for k in targets.LEVELS)
PATH_BASE = DIAG_BASE + f", pa AS (SELECT event_id, any_value(direction) AS direction, any_value(p0) AS p0, any_value(sigma) AS sigma, any_value(event_ns) AS event_ns, {_PATH_COLS}, {_TOUCH} FROM fw GROUP BY event_id),\npl AS (" + " UNION ALL ".join(
    f"SELECT event_id, direction, p0, sigma, event_ns, {h} AS h, elig_{h} AS elig, close_{h} AS close_h, mfe_{h} AS mfe, mae_{h} AS mae, t_mfe_{h} AS t_mfe, t_mae_{h} AS t_mae FROM pa" for h in targets.PATH_HORIZONS
) + "),\npx AS (SELECT pl.*, ce.experiment_id, dim.symbol, year(make_timestamp(pl.event_ns // 1000)) AS year, direction_ * ln(close_h / p0) AS dir_log FROM (SELECT *, direction AS direction_ FROM pl) pl JOIN (SELECT event_id, experiment_id, series_id FROM ce) ce USING (event_id) JOIN dim USING (series_id))\n"


@query(PATH_BASE + "SELECT event_id, h, elig, close_h, round(mfe, 10) + 0.0 AS mfe_pts, round(mae, 10) + 0.0 AS mae_pts, t_mfe, t_mae FROM pl", digits=6)
def pd1_path_engine(spark, d):
    b = placed_bars(spark, d)
    return targets.path_rows(targets.paths(eligible(spark, d, b), b))


@query(PATH_BASE + "SELECT event_id, round(sigma, 10) + 0.0 AS sigma, " + ", ".join(f'"t_fav_{k}"::INT AS t_fav_{str(k).replace(".", "_")}, "t_adv_{k}"::INT AS t_adv_{str(k).replace(".", "_")}' for k in targets.LEVELS) + " FROM pa")
def pd2_pd4_barrier_touches(spark, d):
    p = _paths(spark, d)
    return p.select("event_id", "sigma", *(F.col(f"`t_{s}_{k}`").alias(f"t_{s}_{str(k).replace('.', '_')}") for k in targets.LEVELS for s in ("fav", "adv")))


_RATE = "count(*) FILTER (WHERE {c}) / count(*)"
_Q = "quantile_cont({c}, {q})"


def _qs(c: str, qs: list[float], name: str) -> str:
    return ", ".join(f"round(quantile_cont({c}, {q}), 10) + 0.0 AS {name}_p{round(q * 100)}" for q in qs)


@query(PATH_BASE + f"""SELECT symbol, h, count(*) AS n, round(avg(dir_log), 10) + 0.0 AS dir_log_mean, {_qs('dir_log', [0.05, 0.25, 0.5, 0.75, 0.95], 'dir_log')}, round(stddev_samp(dir_log), 10) + 0.0 AS dir_log_std,
 round({_RATE.format(c='dir_log > 0')}, 10) AS continuation, round({_RATE.format(c='dir_log < 0')}, 10) AS reversal, round({_RATE.format(c='dir_log = 0')}, 10) AS flat,
 round(avg(mfe), 10) + 0.0 AS mfe_mean, {_qs('mfe', [0.5, 0.75, 0.95], 'mfe')}, round(avg(-mae), 10) + 0.0 AS abs_mae_mean, {_qs('-mae', [0.5, 0.75, 0.95], 'abs_mae')},
 round(avg(mfe + mae), 10) + 0.0 AS dominance_mean, {_qs('mfe + mae', [0.25, 0.5, 0.75], 'dominance')}, round({_RATE.format(c='mfe + mae > 0')}, 10) AS dominance_gt_0,
 round(avg(t_mfe), 10) + 0.0 AS t_mfe_mean, {_qs('t_mfe', [0.5, 0.75, 0.95], 't_mfe')}, round(avg(t_mae), 10) + 0.0 AS t_mae_mean, round({_RATE.format(c='t_mfe < t_mae')}, 10) AS mfe_first, round({_RATE.format(c='t_mae < t_mfe')}, 10) AS mae_first
FROM px WHERE elig GROUP BY 1, 2""", digits=6)
def pd7_excursion_summary(spark, d):
    return pathstats.excursion_summary(_paths(spark, d), ["symbol"])


_LOGF = "CASE WHEN direction > 0 THEN ln((p0 + {m}) / p0) ELSE -ln((p0 - {m}) / p0) END / sigma"


@query(PATH_BASE + f"""SELECT symbol, h, count(*) AS n, round(avg(f), 10) + 0.0 AS mfe_sigma_mean, {_qs('f', [0.5, 0.95], 'mfe_sigma')}, round(avg(a), 10) + 0.0 AS mae_sigma_mean, {_qs('a', [0.5, 0.95], 'mae_sigma')}
FROM (SELECT *, {_LOGF.format(m='mfe')} AS f, -({_LOGF.format(m='mae')}) AS a FROM px WHERE elig AND sigma > 0) GROUP BY 1, 2""")
def pd3_sigma_excursions(spark, d):
    return pathstats.sigma_excursions(_paths(spark, d), ["symbol"])


def _outcome_sql(t: float, s: float, h: int | str) -> str:
    a, b = f'coalesce("t_fav_{t}", 1073741824)', f'coalesce("t_adv_{s}", 1073741824)'
    return f"CASE WHEN least({a}, {b}) > {h} THEN 0 WHEN {a} < {b} THEN 1 WHEN {b} < {a} THEN 2 ELSE 3 END"


_PASSAGE = " UNION ALL ".join(
    f"SELECT event_id, {t}::DOUBLE AS target_sigma, {s}::DOUBLE AS stop_sigma, {h} AS h, {_outcome_sql(t, s, h)} AS code FROM pa WHERE elig_{h} AND sigma IS NOT NULL"
    for t, s in [*((k, k) for k in targets.LEVELS), *pathstats.ASYMMETRIC] for h in pathstats.EXPIRIES
)


@query(PATH_BASE + f"""SELECT direction, target_sigma, stop_sigma, h, count(*) AS n, round({_RATE.format(c='code = 1')}, 10) AS target_first, round({_RATE.format(c='code = 2')}, 10) AS stop_first, round({_RATE.format(c='code = 3')}, 10) AS same_bar, round({_RATE.format(c='code = 0')}, 10) AS neither
FROM ({_PASSAGE}) JOIN (SELECT event_id, direction FROM pa) USING (event_id) GROUP BY 1, 2, 3, 4""")
def pd8_first_passage(spark, d):
    return pathstats.first_passage(_paths(spark, d), ["direction"])


_CELLS = " UNION ALL ".join(
    f"SELECT event_id, direction, event_ns, {e} AS expiry, {s}::DOUBLE AS stop_sigma, {t}::DOUBLE AS target_sigma, {_outcome_sql(t, s, e)} AS code, close_{e} AS close_h, p0, "
    f"CASE WHEN direction > 0 THEN p0 * (exp({t} * sigma) - 1) ELSE p0 * (1 - exp(-{t} * sigma)) END AS win, CASE WHEN direction > 0 THEN p0 * (1 - exp(-{s} * sigma)) ELSE p0 * (exp({s} * sigma) - 1) END AS lose FROM pa WHERE elig_{e} AND sigma IS NOT NULL"
    for e in pathstats.EXPIRIES for s in targets.LEVELS for t in targets.LEVELS
)
CELL_BASE = PATH_BASE + f", cl AS (SELECT *, year(make_timestamp(event_ns // 1000)) AS year, CASE WHEN code = 3 THEN -lose ELSE raw_pnl END AS pnl FROM (SELECT *, CASE code WHEN 1 THEN win WHEN 2 THEN -lose WHEN 0 THEN direction * (close_h - p0) END AS raw_pnl FROM ({_CELLS})))\n"


@query(CELL_BASE + f"""SELECT direction, expiry, stop_sigma, target_sigma, count(*) AS n, round({_RATE.format(c='code = 1')}, 10) AS target_rate, round({_RATE.format(c='code IN (2, 3)')}, 10) AS stop_rate, round({_RATE.format(c='code = 0')}, 10) AS expiry_rate, round({_RATE.format(c='code = 3')}, 10) AS same_bar_rate,
 round(avg(pnl), 10) + 0.0 AS mean_points, round(quantile_cont(pnl, 0.5), 10) + 0.0 AS median_points, round(avg(pnl / lose), 10) + 0.0 AS mean_r, round(quantile_cont(pnl / lose, 0.5), 10) + 0.0 AS median_r,
 round(sum(pnl) FILTER (WHERE pnl > 0) / abs(sum(pnl) FILTER (WHERE pnl < 0)), 10) + 0.0 AS profit_factor, round({_RATE.format(c='pnl > 0')}, 10) AS win_rate, round(avg(pnl) FILTER (WHERE pnl > 0), 10) + 0.0 AS mean_winner, round(avg(pnl) FILTER (WHERE pnl < 0), 10) + 0.0 AS mean_loser,
 {_qs('pnl', [0.05, 0.25, 0.75, 0.95], 'points')}, round(avg(raw_pnl), 10) + 0.0 AS raw_mean_points, count(raw_pnl) AS n_unambiguous FROM cl GROUP BY 1, 2, 3, 4""", digits=6)
def pd5_pd6_bracket_surface(spark, d):
    return pathstats.bracket_surface(_paths(spark, d), ["direction"])


@query(CELL_BASE + """SELECT direction, expiry, stop_sigma, target_sigma, count(*) AS eligible_years, count(*) FILTER (WHERE m > 0) AS positive_years, round(min(m), 10) + 0.0 AS worst_year, round(max(m), 10) + 0.0 AS best_year, round(quantile_cont(m, 0.5), 10) + 0.0 AS median_year
FROM (SELECT direction, year, expiry, stop_sigma, target_sigma, avg(pnl) AS m FROM cl GROUP BY ALL HAVING count(*) >= 20) GROUP BY 1, 2, 3, 4""", digits=6)
def pd6_year_stability(spark, d):
    return pathstats.year_stability(_paths(spark, d), ["direction"], "year")


@query(PATH_BASE + f"SELECT direction, year::BIGINT AS year, h, count(*) AS n, round({_RATE.format(c='dir_log > 0')}, 10) AS continuation, {_qs('mfe', [0.5, 0.95], 'mfe')}, {_qs('-mae', [0.5, 0.95], 'abs_mae')} FROM px WHERE elig GROUP BY 1, 2, 3 HAVING count(*) >= 20", digits=6)
def pd9_yearly_table(spark, d):
    return pathstats.yearly_table(_paths(spark, d), ["direction"], "year")


# ---------------------------------------------------------------- folds, panels and statistics
# A study pools the events of one time zone, so that folds and weeks go by their own clock. Its events have the
# history that the feature bank needs; folds are cut from all of these, whatever becomes of their targets.
PANEL_SCORES = ("RANGE_POS_15", "RANGE_POS_60", "RANGE_POS_120")  # ready scores stand in for the models where SQL is to check
PANEL_TRAIN = 50  # a ready score learns no more than a median
FIT_TRAIN = 100  # studies of one zone are small; MIN_TRAIN of the policy is the operators' own default
BY = ["study", "target", "model"]


def _study_events(spark, d, b):
    e = eligible(spark, d, b).where(F.col("pos_t") + 1 >= features.MIN_HISTORY)
    return stored(e.withColumn("study", F.col("tz")))  # located once; read by folds, targets and features


def _outcomes(e, b):
    """Targets of the study's events that end in their session, one row per event and target."""
    t = targets.inside_session(targets.primary_targets(e, b)).select("event_id", F.col("target_name").alias("target"), F.col("value").alias("y"), F.col("effective_target_end_ns").alias("end_ns"), "truncated")
    return e.select("study", "event_id", "event_ns", "symbol", "step_ns", "direction", "tz").join(t, "event_id")


def _folds(e):
    return crossval.development_folds(e.select("event_id", "event_ns", "tz", "study"), ["study"])


def _score_rows(e, b, names=PANEL_SCORES):
    """The outcomes with each ready score as a model of its own."""
    f = features.compute_features(e, b, names)
    s = f.select("event_id", F.inline(F.array(*(F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in names)))).where("score is not null")
    return _outcomes(e, b).join(s, "event_id")


def _folded(spark, d):
    b = placed_bars(spark, d)
    e = _study_events(spark, d, b)
    return crossval.fold_rows(_score_rows(e, b), _folds(e), ["study"])


def _panel(spark, d):
    p = crossval.score_panel(_folded(spark, d), BY, "score", PANEL_TRAIN)
    return p.select(*BY, "event_id", "event_ns", "symbol", "direction", "fold", "lo", "hi", "score", "threshold", "state", "y", "truncated", "tz").withColumns({"year": utc_year("event_ns"), "week": week_key("event_ns")})


def _range_pos(n: int) -> str:
    return f"CASE WHEN pos >= {n - 1} THEN CASE WHEN max(high) {_w(n)} > min(low) {_w(n)} THEN (close - min(low) {_w(n)}) / (max(high) {_w(n)} - min(low) {_w(n)}) ELSE 0.5 END END"


_BY = "study, target, model"
PANEL_BASE = TARGET_BASE + f""", rp AS (SELECT series_id, pos, {', '.join(f'{_range_pos(int(s.split("_")[-1]))} AS {s}' for s in PANEL_SCORES)} FROM cb),
me AS (SELECT *, tz AS study FROM el WHERE pos_t + 1 >= {features.MIN_HISTORY}),
sc AS (UNPIVOT (SELECT event_id, {', '.join(PANEL_SCORES)} FROM me JOIN rp ON me.series_id = rp.series_id AND me.pos_t = rp.pos) ON {', '.join(PANEL_SCORES)} INTO NAME model VALUE score),
rt AS (SELECT study, tg.target_name AS target, event_id, me.event_ns, me.symbol, me.tz, me.step_ns, me.direction, tg.value AS y, tg.target_end_ns AS end_ns, tg.truncated FROM tg JOIN me USING (event_id) WHERE NOT crosses_session),
ro AS (SELECT rt.*, model, score FROM rt JOIN sc USING (event_id)),
ue AS (SELECT study, tz, event_ns, row_number() OVER (PARTITION BY study ORDER BY event_ns) - 1 AS i, count(*) OVER (PARTITION BY study) AS n FROM me),
ub AS (SELECT study, block, epoch_us((make_timestamptz(event_ns // 1000) AT TIME ZONE tz)::DATE::TIMESTAMP AT TIME ZONE tz) * 1000 AS lo
  FROM ue, (SELECT unnest(range(6)) AS block) WHERE i = block * (n // 6) + least(block, n % 6) AND n >= 6),
bl AS (SELECT study, block, CASE WHEN block > 0 THEN lo END AS lo, lead(lo) OVER (PARTITION BY study ORDER BY block) AS hi FROM ub),
fr AS (SELECT ro.*, block AS fold, lo, hi, CASE WHEN event_ns < lo AND end_ns < lo THEN 'train' WHEN event_ns >= lo AND (hi IS NULL OR event_ns < hi) THEN 'val' END AS role FROM ro JOIN bl USING (study) WHERE block >= 1),
th AS (SELECT {_BY}, fold, quantile_cont(score, 0.5) AS threshold FROM fr WHERE role = 'train' GROUP BY ALL HAVING count(*) >= {PANEL_TRAIN}),
pn AS (SELECT fr.*, threshold, CASE WHEN score > threshold THEN 'UPPER_HALF' WHEN score < threshold THEN 'LOWER_HALF' ELSE 'TIE' END AS state,
  year(make_timestamp(event_ns // 1000)) AS year, strftime(make_timestamptz(event_ns // 1000) AT TIME ZONE tz, '%G-W%V') AS week FROM fr JOIN th USING ({_BY}, fold) WHERE role = 'val'),
ph AS (SELECT *, 'UPPER_HALF' AS half, y AS v, state = 'UPPER_HALF' AS sel FROM pn UNION ALL SELECT *, 'LOWER_HALF', -y, state = 'LOWER_HALF' FROM pn)
"""
_CORE = "count(*) AS n_parent, count(*) FILTER (WHERE sel) AS n_selected, round(avg(v), 10) + 0.0 AS parent_effect, round(avg(v) FILTER (WHERE sel), 10) + 0.0 AS selected_effect, round(avg(v) FILTER (WHERE sel) - avg(v), 10) + 0.0 AS uplift"


@query(PANEL_BASE + "SELECT study, block, lo, hi FROM bl")
def cv1_blocks(spark, d):
    e = _study_events(spark, d, placed_bars(spark, d))
    return crossval.blocks(e.select("event_id", "event_ns", "tz", "study"), 6, ["study"]).select("study", "block", "lo", "hi")


@query(PANEL_BASE + f"SELECT {_BY}, fold, role, count(*) AS n FROM fr WHERE role IS NOT NULL GROUP BY ALL")
def cv2_fold_roles(spark, d):
    return _folded(spark, d).groupBy(*BY, "fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(PANEL_BASE + f"SELECT {_BY}, event_id, event_ns, fold, round(score, 10) + 0.0 AS score, round(threshold, 10) + 0.0 AS threshold, state, round(y, 10) + 0.0 AS y FROM pn")
def cv5_score_panel(spark, d):
    return _panel(spark, d).select(*BY, "event_id", "event_ns", "fold", "score", "threshold", "state", "y")


SLICE_BYTES = 128 << 20  # of bars, whose series are shuffled together for targets and features
MOST_SLICES = 8


def _bank_pieces(spark, d):
    """The study's events, the whole feature bank over slices of the series, the outcomes, and the stored tables behind them.

    Outcomes are stored slice by slice, as the bank's pieces should be, so that the shuffles of one do not lie there with those of another."""
    raw = table(spark, d, "bars")
    n = min(MOST_SLICES, max(1, -(-file_bytes(raw) // SLICE_BYTES)))
    own = F.pmod(F.xxhash64("series_id"), F.lit(n)).cast("int")
    b = positions.with_positions(bar_source.clean_bars(raw, table(spark, d, "instruments"), by_day=True))
    b = stored(b.withColumn("slice", own), "slice", codec="zstd")  # cleaned once; read by events, targets and features
    e = _study_events(spark, d, b)
    slices = [(e.where(own == i), b.where(F.col("slice") == i)) for i in range(n)]
    outcomes = [stored(_outcomes(*s)) for s in slices]
    whole = " and ".join(f"`{n}` is not null" for n in features.NAMES)
    pieces = [features.compute_features(*s, features.NAMES, keep=("study", "event_ns")).where(whole) for s in slices]
    return e, pieces, reduce(DataFrame.unionByName, outcomes), [b, e, *outcomes]


def _bank(spark, d):
    """The study's events with the whole feature bank, and their outcomes: one row an event, one an outcome."""
    e, pieces, rows, _ = _bank_pieces(spark, d)
    return e, reduce(DataFrame.unionByName, pieces), rows


def _fitted(spark, d, fit, parts, **more):
    """``fit`` (walk_forward or importances) of all models on the whole bank; ``parts`` gives the outcomes their role in each part."""
    e, pieces, rows, spent = _bank_pieces(spark, d)
    return fit(reduce(DataFrame.unionByName, pieces), parts(rows, e), ["study"], features.NAMES, min_train=FIT_TRAIN, targets=events.TARGETS, pieces=pieces, spent=spent, **more)


def _in_folds(rows, e):
    return crossval.fold_rows(rows, _folds(e), ["study"])


@query()
def cv6_model_panels(spark, d):
    """Walk-forward of all three models on the whole bank over all primary targets: fits, so no SQL."""
    return _fitted(spark, d, crossval.walk_forward, _in_folds)


SPLIT_BASE = PANEL_BASE + f""", sp AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b),
hd AS (SELECT study, split, block, lo, hi FROM sp JOIN bl ON block IN (a, b)),
sr AS (SELECT {_BY}, event_id, event_ns, y, score, split,
  max(CASE WHEN (lo IS NULL OR event_ns >= lo) AND (hi IS NULL OR event_ns < hi) THEN block END) AS block,
  bool_or(((hi IS NULL OR event_ns < hi) AND (lo IS NULL OR end_ns >= lo)) OR coalesce(event_ns >= hi AND event_ns < hi + step_ns * 180, false) OR coalesce(event_ns >= lo - step_ns * 180 AND event_ns < lo, false)) AS hit
  FROM ro JOIN hd USING (study) GROUP BY ALL),
st AS (SELECT {_BY}, split, quantile_cont(score, 0.5) AS threshold FROM sr WHERE block IS NULL AND NOT hit GROUP BY ALL HAVING count(*) >= {PANEL_TRAIN}),
sq AS (SELECT sr.*, CASE WHEN score > threshold THEN 'UPPER_HALF' WHEN score < threshold THEN 'LOWER_HALF' ELSE 'TIE' END AS state FROM sr JOIN st USING ({_BY}, split) WHERE block IS NOT NULL),
sx AS (SELECT {_BY}, split, count(*) AS n_test, count(*) FILTER (WHERE state = 'UPPER_HALF') AS n_selected, avg(y) FILTER (WHERE state = 'UPPER_HALF') AS selected_effect, avg(y) FILTER (WHERE state = 'UPPER_HALF') - avg(y) AS uplift FROM sq GROUP BY ALL)
"""


def _blocks(e):
    return crossval.blocks(e.select("study", "event_id", "event_ns", "tz"), crossval.GROUPS, ["study"])


def _splits(spark, d):
    b = placed_bars(spark, d)
    e = _study_events(spark, d, b)
    return crossval.split_rows(_score_rows(e, b), _blocks(e), ["study"])


def _split_panel(spark, d):
    r = stored(_splits(spark, d))  # read by thresholds and test rows
    return crossval.score_panel(r.withColumnRenamed("split", "fold").withColumn("role", F.when(F.col("role") == "test", "val").otherwise(F.col("role"))), BY, "score", PANEL_TRAIN).withColumnRenamed("fold", "split")


@query(SPLIT_BASE + f"SELECT {_BY}, split, CASE WHEN block IS NOT NULL THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM sr WHERE block IS NOT NULL OR NOT hit GROUP BY ALL")
def cv8_split_masks(spark, d):
    return _splits(spark, d).groupBy(*BY, "split", "role").agg(F.count(F.lit(1)).alias("n"))


@query(SPLIT_BASE + f"SELECT {_BY}, split, n_test, n_selected, round(selected_effect, 10) + 0.0 AS selected_effect, round(uplift, 10) + 0.0 AS uplift FROM sx")
def cv9_split_results(spark, d):
    return crossval.split_results(_split_panel(spark, d), BY)


@query(SPLIT_BASE + f"SELECT {_BY}, split, block, count(*) AS n_test, count(*) FILTER (WHERE state = 'UPPER_HALF') AS n_selected, round(avg(y) FILTER (WHERE state = 'UPPER_HALF'), 10) + 0.0 AS selected_effect, round(avg(y) FILTER (WHERE state = 'UPPER_HALF') - avg(y), 10) + 0.0 AS uplift FROM sq GROUP BY ALL")
def cv9_group_uplift(spark, d):
    """Uplift in each held-out block of each split."""
    return crossval.split_results(_split_panel(spark, d), BY, "block")


@query()
def cv9_model_splits(spark, d):
    """The combinatorial splits of all three models on the whole bank: fits, so no SQL."""
    p = _fitted(spark, d, crossval.walk_forward, lambda rows, e: crossval.split_rows(rows, _blocks(e), ["study"]), part="split", test="test")
    return crossval.split_results(p, BY)


@query(SPLIT_BASE + f"""SELECT {_BY}, count(*) AS n_valid, round(quantile_cont(selected_effect, 0.5), 10) + 0.0 AS median_effect, round(quantile_cont(uplift, 0.5), 10) + 0.0 AS median_uplift, round(quantile_cont(uplift, 0.1), 10) + 0.0 AS p10_uplift, round(quantile_cont(uplift, 0.9), 10) + 0.0 AS p90_uplift,
 count(*) FILTER (WHERE selected_effect > 0) AS n_effect_positive, count(*) FILTER (WHERE uplift > 0) AS n_uplift_positive, arg_min(split, [uplift, split]) AS worst_split, arg_max(split, [uplift, -split]) AS best_split,
 count(*) = 15 AND quantile_cont(selected_effect, 0.5) > 0 AND quantile_cont(uplift, 0.5) > 0 AND count(*) FILTER (WHERE selected_effect > 0) >= 12 AND count(*) FILTER (WHERE uplift > 0) >= 12 AS passed FROM sx WHERE n_selected > 0 GROUP BY ALL""")
def cv10_pass_rule(spark, d):
    return crossval.pass_rule(crossval.split_results(_split_panel(spark, d), BY), BY)


@query(PANEL_BASE + "SELECT DISTINCT event_id, week FROM pn")
def ag1_week_key(spark, d):
    return _panel(spark, d).select("event_id", "week").distinct()


@query(sql(", w AS (SELECT strftime(make_timestamptz(ts // 1000) AT TIME ZONE tz, '%G-W%V') AS week, year(make_timestamp(ts // 1000)) AS year FROM cb) SELECT year::BIGINT AS year, count(DISTINCT week) AS n_weeks FROM w GROUP BY GROUPING SETS ((year), ())"))
def ag2_weeks_with_bars(spark, d):
    return stats.weeks_with_bars(bars_of(spark, d))


# weeks with bars inside the validation intervals of the folds that gave rows
WEEKS = f""", wf AS (SELECT DISTINCT tz AS study, ts, strftime(make_timestamptz(ts // 1000) AT TIME ZONE tz, '%G-W%V') AS week FROM cb),
wi AS (SELECT DISTINCT wf.study, block AS fold, week FROM wf JOIN bl ON wf.study = bl.study AND (lo IS NULL OR ts >= lo) AND (hi IS NULL OR ts < hi)),
wp AS (SELECT {_BY}, count(DISTINCT week) AS n_weeks FROM (SELECT DISTINCT {_BY}, fold FROM pn) JOIN wi USING (study, fold) GROUP BY ALL)
"""


def _weeks(spark, d, panel):
    return stats.weeks_of_folds(bars_of(spark, d).withColumn("study", F.col("tz")), panel, BY, "study")


@query(PANEL_BASE + WEEKS + f"SELECT {_BY}, n_weeks FROM wp")
def jn7_weeks_in_folds(spark, d):
    return _weeks(spark, d, _panel(spark, d))


@query(PANEL_BASE + WEEKS + f"SELECT {_BY}, half, {_CORE}, any_value(n_weeks) AS n_weeks, round(stddev_samp(v), 10) AS target_sd, round(count(*) / any_value(n_weeks), 10) AS parent_frequency, round(count(*) FILTER (WHERE sel) / any_value(n_weeks), 10) AS selected_frequency, round(count(*) FILTER (WHERE sel) / count(*), 10) AS retention_ratio, round((avg(v) FILTER (WHERE sel) - avg(v)) / stddev_samp(v), 10) + 0.0 AS standardized_uplift FROM ph JOIN wp USING ({_BY}) GROUP BY {_BY}, half")
def ag3_evaluate(spark, d):
    p = _panel(spark, d)
    return stats.evaluate(p, BY, _weeks(spark, d, p))


@query()
def ag4_bootstrap_ci(spark, d):
    return stats.bootstrap_ci(_panel(spark, d), BY)


@query()
def ag5_permutation_p(spark, d):
    return stats.permutation_p(_panel(spark, d), BY)


@query(PANEL_BASE + f"SELECT {_BY}, half, year::BIGINT AS year, {_CORE}, count(*) FILTER (WHERE sel) >= 20 AS eligible FROM ph GROUP BY {_BY}, half, year")
def ag6_yearly(spark, d):
    return stats.by_part(_panel(spark, d), BY, "year")


@query(PANEL_BASE + f""", yy AS (SELECT {_BY}, half, year, count(*) FILTER (WHERE sel) AS n, avg(v) FILTER (WHERE sel) AS e, avg(v) FILTER (WHERE sel) - avg(v) AS u FROM ph GROUP BY {_BY}, half, year HAVING count(*) FILTER (WHERE sel) >= 20)
SELECT {_BY}, half, count(*) AS eligible_years, count(*) FILTER (WHERE e > 0) AS positive_years, count(*) FILTER (WHERE u > 0) AS positive_uplift_years, round(max(abs(n * u)) / nullif(sum(abs(n * u)), 0), 10) AS year_concentration_share,
 CASE WHEN count(*) >= 2 AND sum(n * u) > 0 THEN round(max(n * u) / sum(n * u), 10) + 0.0 END AS year_best_share FROM yy GROUP BY {_BY}, half""")
def ag6_year_consistency(spark, d):
    return stats.year_consistency(_panel(spark, d), BY)


@query(PANEL_BASE + f""", rk AS (SELECT *, (row_number() OVER (PARTITION BY {_BY}, half ORDER BY event_ns, event_id) - 1) * 10 // count(*) OVER (PARTITION BY {_BY}, half) AS batch FROM ph),
ms AS (SELECT {_BY}, half, batch, coalesce(count(*) FILTER (WHERE sel) * (avg(v) FILTER (WHERE sel) - avg(v)), 0) AS m FROM rk GROUP BY {_BY}, half, batch)
SELECT {_BY}, half, CASE WHEN sum(m) > 0 THEN round(max(m) / sum(m), 10) END AS batch_best_share FROM ms GROUP BY {_BY}, half""")
def ag7_batch_concentration(spark, d):
    return stats.batch_concentration(_panel(spark, d), BY)


@query(PANEL_BASE + f"SELECT {_BY}, half, fold, {_CORE}, count(*) FILTER (WHERE sel) >= 20 AS eligible FROM ph GROUP BY {_BY}, half, fold")
def ag8_folds(spark, d):
    return stats.by_part(_panel(spark, d), BY, "fold")


DECILES = f""", rk AS (SELECT *, least((row_number() OVER (PARTITION BY {_BY} ORDER BY score, event_ns, event_id) - 1) * 10 // count(*) OVER (PARTITION BY {_BY}), 9) + 1 AS decile, count(*) OVER (PARTITION BY {_BY}) AS n_all FROM pn),
dc AS (SELECT {_BY}, decile, count(*) AS n, avg(y) AS m FROM rk WHERE n_all >= 10 GROUP BY {_BY}, decile)
"""


@query(PANEL_BASE + DECILES + f"SELECT {_BY}, decile, n, round(m, 10) + 0.0 AS mean_target FROM dc")
def ag9_deciles(spark, d):
    return stats.deciles(_panel(spark, d), BY)


def _ranked(spark, d, panel=None):
    p = _panel(spark, d) if panel is None else panel
    t = stats.evaluate(p, BY, _weeks(spark, d, p)).withColumn("raw_p", F.exp(-40 * F.abs("standardized_uplift")))
    return stats.benjamini_hochberg(t, ["study"], "raw_p", F.concat_ws("|", "target", "model", "half"))


# trials with a stand-in for the resampled p, ranked as the registry ranks them
TRIALS = PANEL_BASE + WEEKS + f""", tr AS (SELECT {_BY}, half, (avg(v) FILTER (WHERE sel) - avg(v)) / stddev_samp(v) AS up, count(*) FILTER (WHERE sel) / any_value(n_weeks) AS freq FROM ph JOIN wp USING ({_BY}) GROUP BY {_BY}, half),
tb AS (SELECT *, least(1, exp(-40 * abs(up)) * count(*) OVER (PARTITION BY study)) AS bonferroni FROM tr),
gr AS (SELECT study, target, half, count(*) AS n_models, quantile_cont(up, 0.5) AS median_up, quantile_cont(bonferroni, 0.5) AS median_p, quantile_cont(freq, 0.5) AS median_freq FROM tb WHERE up > 0 GROUP BY ALL HAVING count(*) >= 2),
gk AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY round(median_up, 9) DESC, round(median_p, 9), round(median_freq, 9) DESC, target, half) AS rank FROM gr)
"""


@query(TRIALS + f"SELECT {_BY}, half, round(up, 10) + 0.0 AS standardized_uplift, row_number() OVER (PARTITION BY study ORDER BY round(up, 9) DESC, round(bonferroni, 9), round(freq, 9) DESC, target, model, half) AS rank FROM tb WHERE up > 0")
def so2_rank_trials(spark, d):
    r = stats.rank_trials(_ranked(spark, d).where("standardized_uplift > 0"), ["study"], ["target", "model", "half"])
    return r.select(*BY, "half", "standardized_uplift", "rank")


@query(TRIALS + "SELECT study, target, half, n_models, round(median_up, 10) + 0.0 AS median_uplift, round(median_p, 10) + 0.0 AS median_bonferroni, round(median_freq, 10) + 0.0 AS median_frequency, rank FROM gk WHERE rank <= 5")
def so3_top_groups(spark, d):
    """The five best groups of target and half with two or more positive models, by their medians."""
    return stats.rank_groups(_ranked(spark, d).where("standardized_uplift > 0"), ["study"], ["target", "half"], "model").where("rank <= 5")


@query()
def ag12_paired_difference(spark, d):
    """Every pair of a study's near groups of one half, by weeks drawn jointly."""
    p = stored(_panel(spark, d))
    g = stats.rank_groups(_ranked(spark, d, p).where("standardized_uplift > 0"), ["study"], ["target", "half"], "model")
    pairs = stats.near_pairs(g, ["study"], "half", "target", "median_uplift")
    return stats.paired_difference(p, ["study"], "target", "model", pairs)


@query(TRIALS + """SELECT a.study, a.half, a.target AS group_a, b.target AS group_b, round(abs(a.median_up - b.median_up), 10) AS difference FROM gk a JOIN gk b ON a.study = b.study AND a.half = b.half AND a.rank < b.rank WHERE abs(a.median_up - b.median_up) <= 0.03""")
def jn13_near_ties(spark, d):
    """Pairs of ranked groups of one half whose medians are near: targets are few, so pairs are."""
    g = stats.rank_groups(_ranked(spark, d).where("standardized_uplift > 0"), ["study"], ["target", "half"], "model")
    return stats.near_pairs(g, ["study"], "half", "target", "median_uplift").select("study", "half", "group_a", "group_b", "difference")


@query(TRIALS.replace("WITH zone", "WITH RECURSIVE zone") + """, ed AS (SELECT a.study, a.half, a.rank AS x, b.rank AS y FROM gk a JOIN gk b ON a.study = b.study AND a.half = b.half AND a.rank <> b.rank WHERE abs(a.median_up - b.median_up) <= 0.03),
cl AS (SELECT study, half, x AS rank, x AS seen FROM (SELECT DISTINCT study, half, x FROM ed) UNION SELECT cl.study, cl.half, cl.rank, ed.y FROM cl JOIN ed ON cl.study = ed.study AND cl.half = ed.half AND cl.seen = ed.x),
cm AS (SELECT study, half, rank, min(seen) AS first FROM cl GROUP BY ALL)
SELECT cm.study, gk.target || '|' || cm.half AS member, dense_rank() OVER (PARTITION BY cm.study ORDER BY first) AS cluster_no, cm.rank, row_number() OVER (PARTITION BY cm.study, first ORDER BY cm.rank) <= 2 AS proposable FROM cm JOIN gk USING (study, rank)""")
def gr1_near_tie_clusters(spark, d):
    """Near ties joined to clusters, the clusters by their best member, the two best members of each marked."""
    g = stored(stats.rank_groups(_ranked(spark, d).where("standardized_uplift > 0"), ["study"], ["target", "half"], "model"))
    return stats.near_tie_clusters(g, "study", "half", "target", "median_uplift")


def _where(dim: str, bucket: str) -> str:
    return f"SELECT {_BY}, half, '{dim}' AS dimension, {bucket} AS bucket, count(*) AS n, count(*) FILTER (WHERE sel) AS s, avg(v) FILTER (WHERE sel) - avg(v) AS u FROM ph GROUP BY {_BY}, half, {bucket}"


@query(PANEL_BASE + f""", wm AS ({_where('year', 'year::VARCHAR')} UNION ALL {_where('hour', "strftime(make_timestamptz(event_ns // 1000) AT TIME ZONE tz, '%H:00')")} UNION ALL {_where('horizon', "CASE WHEN truncated THEN 'truncated' ELSE 'full' END")})
SELECT study, target, half, dimension, bucket, round(quantile_cont(n, 0.5), 10) AS median_events, round(quantile_cont(s, 0.5), 10) AS median_selected, round(quantile_cont(u, 0.5), 10) + 0.0 AS median_uplift FROM wm GROUP BY ALL""")
def ag13_where_map(spark, d):
    return stats.where_map(_panel(spark, d), "model", ["study", "target"])


@query(PANEL_BASE + f"SELECT {_BY}, half, strftime(make_timestamp(event_ns // 1000), '%Y-%m') AS month, {_CORE}, count(*) FILTER (WHERE sel) >= 20 AS eligible FROM ph GROUP BY ALL")
def ag14_monthly(spark, d):
    return stats.by_part(_panel(spark, d).withColumn("month", F.date_format(F.timestamp_micros(F.expr("event_ns div 1000")), "yyyy-MM")), BY, "month")


def _bank_sql() -> str:
    """The families' SQL joined to the whole bank."""
    parts = [f"(SELECT * EXCLUDE (completed_bars) FROM ({FEATURE_SQL[n]}))" for n in list(features.FAMILIES)[1:]]
    return f"SELECT * FROM ({FEATURE_SQL['f1_returns']}) " + " ".join(f"JOIN {p} USING (event_id)" for p in parts)


def _bank_features(spark, d):
    b = placed_bars(spark, d)
    e = located(spark, d, b)
    f = features.compute_features(e, b)
    f = f.withColumns({c: F.col(c).cast("float").cast("double") for c in features.FAMILIES["f3_volatility_of_volatility"]})  # see _family
    return e, f


@query(_bank_sql())
def f18_feature_bank(spark, d):
    return _bank_features(spark, d)[1]


_NAMES = ", ".join(f'"{n}"' for n in features.NAMES)


_BAD = ", ".join(f'count(*) FILTER (WHERE "{n}" IS NULL AND completed_bars >= {features.MIN_HISTORY}) AS "{n}"' for n in features.NAMES)


@query(f"UNPIVOT (SELECT {_BAD} FROM ({_bank_sql()})) ON {_NAMES} INTO NAME feature VALUE n_bad")
def flt11_feature_quality(spark, d):
    return features.quality(_bank_features(spark, d)[1])


_SHIFTED = [n for n in features.NAMES if n != "day_of_week"]


@query(f"""WITH lg AS (SELECT year(make_timestamp(event_ns // 1000)) AS year, feature, x FROM (UNPIVOT (SELECT event_ns, {_NAMES} FROM ({_bank_sql()}) JOIN (SELECT event_id, epoch_us(event_time) * 1000 AS event_ns FROM study_events WHERE direction IN (-1, 1) AND event_time IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY logged_at, series_id, event_time, direction) = 1) USING (event_id) WHERE completed_bars >= {features.MIN_HISTORY}) ON {_NAMES} INTO NAME feature VALUE x) WHERE feature <> 'day_of_week'),
yr AS (SELECT feature, year, avg(x) AS m FROM lg GROUP BY 1, 2), al AS (SELECT feature, avg(x) AS mu, stddev_samp(x) AS sd FROM lg GROUP BY 1)
SELECT feature, round(max(abs(m - mu) / sd), 6) AS shift, count(*) AS n_years FROM yr JOIN al USING (feature) WHERE sd > 0 GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC LIMIT 8""")
def ag15_mean_shifts(spark, d):
    """The eight features whose yearly means stray furthest: a top-k report."""
    e, f = _bank_features(spark, d)
    f = rounded(features.eligible(f), DIGITS).join(e.select("event_id", "event_ns"), "event_id").withColumn("year", utc_year("event_ns"))
    return rounded(stats.mean_shifts(f, _SHIFTED, "year"), 6)


@query(PANEL_BASE + DECILES + f"""SELECT {_BY}, round(corr(decile, r), 10) + 0.0 AS rho FROM (SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY m) + (count(*) OVER (PARTITION BY {_BY}, m) - 1) / 2 AS r FROM dc) GROUP BY ALL HAVING count(*) = 10""")
def ag15_monotonicity(spark, d):
    """Spearman correlation of the deciles with their mean outcomes."""
    return stats.monotonicity(stats.deciles(_panel(spark, d), BY), BY)


@query()
def ag15_family_importance(spark, d):
    """Share of each feature family in each model's importance, averaged over folds."""
    return stats.family_importance(m5_importances(spark, d), ["study", "target", "model"], {n: k for k, v in features.FAMILIES.items() for n in v})


@query()
def ag15_sign_stability(spark, d):
    """How often a linear coefficient has the sign that it has in the first fold; the other models have no coefficients and are not fitted."""
    return stats.sign_stability(_fitted(spark, d, crossval.importances, _in_folds, names=("RIDGE",)), ["study", "target"])


LADDER_STEPS = ("ALL", "SCORE_ABOVE_HALF", "SCORE_ABOVE_HALF_LONG")


@query(PANEL_BASE + f""", ls AS (
  SELECT {_BY}, 0 AS step_no, 'ALL' AS step, year, y FROM pn UNION ALL SELECT {_BY}, 1, 'SCORE_ABOVE_HALF', year, y FROM pn WHERE score > 0.5
  UNION ALL SELECT {_BY}, 2, 'SCORE_ABOVE_HALF_LONG', year, y FROM pn WHERE score > 0.5 AND direction = 1),
lg AS (SELECT {_BY}, step_no, step, year, count(*) AS n, avg(y) AS e FROM ls GROUP BY GROUPING SETS (({_BY}, step_no, step, year), ({_BY}, step_no, step)))
SELECT a.study, a.target, a.model, a.step_no, a.step, a.year::BIGINT AS year, a.n, round(a.e, 10) + 0.0 AS effect, round(a.e - p.e, 10) + 0.0 AS uplift_vs_parent, round(a.e - coalesce(q.e, CASE WHEN a.step_no = 0 THEN a.e END), 10) + 0.0 AS uplift_vs_previous, round(a.n / p.n, 10) AS retention
FROM lg a LEFT JOIN lg p ON a.study = p.study AND a.target = p.target AND a.model = p.model AND a.year IS NOT DISTINCT FROM p.year AND p.step_no = 0 LEFT JOIN lg q ON a.study = q.study AND a.target = q.target AND a.model = q.model AND a.year IS NOT DISTINCT FROM q.year AND q.step_no = a.step_no - 1""")
def ag17_ladder(spark, d):
    s = F.array(
        F.struct(F.lit(0).alias("step_no"), F.lit(LADDER_STEPS[0]).alias("step")),
        F.when(F.col("score") > 0.5, F.struct(F.lit(1).alias("step_no"), F.lit(LADDER_STEPS[1]).alias("step"))),
        F.when((F.col("score") > 0.5) & (F.col("direction") == 1), F.struct(F.lit(2).alias("step_no"), F.lit(LADDER_STEPS[2]).alias("step"))),
    )
    return stats.ladder(_panel(spark, d).select(*BY, "year", "y", F.inline(F.array_compact(s))), BY)


# ---------------------------------------------------------------- multiplicity, ranks, sets, chains
def _trials(spark, d):
    """Sensitivity probes of the registry as trials: the larger the uplift the smaller p."""
    e = table(spark, d, "experiments")
    t = nested.flat_table(e.select("experiment_id", "sensitivity_json").distinct(), "experiment_id", "sensitivity_json", nested.SENSITIVITY, "entry.probes.models", under="groups")
    c = e.select("experiment_id", "campaign_id").distinct()
    up = F.col("entry_probes_models_uplift").try_cast("double")
    t = t.select(F.col("record_key").alias("experiment_id"), F.concat_ws("|", "record_key", "entry_key", "pos_2", "pos_3").alias("trial_id"), F.col("entry_probes_models_model").alias("model"), up.alias("uplift")).where("uplift is not null").distinct()
    return t.join(c, "experiment_id").withColumn("p", F.exp(-F.abs("uplift") * 40))


@query(P4_SQL[: P4_SQL.index("SELECT DISTINCT experiment_id, doc_kind, entry_key, item_no, sub_no")] + """, tu AS (SELECT DISTINCT experiment_id, concat_ws('|', experiment_id, entry_key, item_no, sub_no) AS trial_id, y ->> '$.model' AS model, TRY_CAST(y ->> '$.uplift' AS DOUBLE) AS uplift FROM s2 WHERE doc_kind = 'sensitivity' AND json_type(y) = 'OBJECT'),
tp AS (SELECT campaign_id, trial_id, exp(-abs(uplift) * 40) AS p FROM tu JOIN (SELECT DISTINCT experiment_id, campaign_id FROM experiments) USING (experiment_id) WHERE uplift IS NOT NULL),
tk AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY p, trial_id) AS k, count(*) OVER (PARTITION BY campaign_id) AS m FROM tp)
SELECT campaign_id, trial_id, round(p, 10) AS p, round(least(1, min(p * m / k) OVER (PARTITION BY campaign_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 10) AS q, round(least(1, p * m), 10) AS bonferroni FROM tk""")
def ag10_ag11_multiplicity(spark, d):
    """Benjamini-Hochberg and Bonferroni per campaign, over every trial of the campaign at once."""
    return stats.benjamini_hochberg(_trials(spark, d), ["campaign_id"], "p", "trial_id").select("campaign_id", "trial_id", "p", "q", "bonferroni")


@query(PANEL_BASE + f"SELECT {_BY}, symbol, m, n, rank() OVER (PARTITION BY {_BY} ORDER BY n) + (count(*) OVER (PARTITION BY {_BY}, n) - 1) / 2 AS avg_rank FROM (SELECT {_BY}, symbol, round(avg(y), 10) + 0.0 AS m, count(*) AS n FROM pn GROUP BY ALL)")
def w7_average_rank(spark, d):
    g = _panel(spark, d).groupBy(*BY, "symbol").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("avg_rank", stats.average_rank(BY, "n"))


@query(sql("""SELECT series_id, 'both' AS side, count(*) AS n FROM (SELECT series_id, event_ns FROM ce WHERE direction = 1 INTERSECT SELECT series_id, event_ns FROM ce WHERE direction = -1) GROUP BY 1
UNION ALL SELECT series_id, 'long_only', count(*) FROM (SELECT series_id, event_ns FROM ce WHERE direction = 1 EXCEPT SELECT series_id, event_ns FROM ce WHERE direction = -1) GROUP BY 1"""))
def set2_intersect_except(spark, d):
    e = bar_source.clean_events(table(spark, d, "study_events"))
    a, b = (e.where(F.col("direction") == s).select("series_id", "event_ns") for s in (1, -1))
    n = lambda df, side: df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "long_only"))


@query("""SELECT t || '|' || m || '|' || s AS trial_id, row_number() OVER (ORDER BY ti, mi, si) AS ordinal FROM
(SELECT unnest(['DIR_RETURN_15', 'DIR_RETURN_60', 'DIR_RETURN_180', 'DIR_PATH_SKEW_60']) AS t, unnest([1, 2, 3, 4]) AS ti), (SELECT unnest(['RIDGE', 'SPLINE', 'XGB']) AS m, unnest([1, 2, 3]) AS mi), (SELECT unnest(['UPPER_HALF', 'LOWER_HALF']) AS s, unnest([1, 2]) AS si)""")
def set3_trial_product(spark, d):
    return events.trial_product(spark)


@query("""WITH RECURSIVE x AS (SELECT campaign_id, experiment_id, max(event_hash) AS h, max(sequence_in_campaign)::BIGINT AS s FROM experiments GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY s, experiment_id) AS k FROM x),
c AS (SELECT campaign_id, k, sha256('GENESIS' || experiment_id || coalesce(h, '')) AS v FROM o WHERE k = 1
  UNION ALL SELECT o.campaign_id, o.k, sha256(c.v || o.experiment_id || coalesce(o.h, '')) FROM o JOIN c ON o.campaign_id = c.campaign_id AND o.k = c.k + 1)
SELECT campaign_id, max(k) AS n, max_by(v, k) AS chain FROM c GROUP BY 1""")
def rg7_hash_chain(spark, d):
    e = table(spark, d, "experiments").groupBy("campaign_id", "experiment_id").agg(F.max("event_hash").alias("event_hash"), F.max("sequence_in_campaign").cast("long").alias("seq"))
    return events.hash_chain(e, ["campaign_id"], ["seq", "experiment_id"], F.concat("experiment_id", F.coalesce("event_hash", F.lit(""))))


@query("""SELECT campaign_id, count(DISTINCT experiment_id) AS n_experiments, count(DISTINCT experiment_id) FILTER (WHERE revealed_at <> '') AS n_revealed, max(nullif(created_at, '')) AS last_created FROM experiments GROUP BY 1""")
def ag24_campaign_summary(spark, d):
    e = table(spark, d, "experiments")
    return e.groupBy("campaign_id").agg(F.countDistinct("experiment_id").alias("n_experiments"), F.countDistinct(F.when(F.col("revealed_at") != "", F.col("experiment_id"))).alias("n_revealed"), F.max(F.nullif("created_at", F.lit(""))).alias("last_created"))


_P4_ENTRIES = P4_SQL[: P4_SQL.index("i0 AS (")].rstrip().rstrip(",")
_P4_LEAVES = P4_SQL[: P4_SQL.index("SELECT DISTINCT experiment_id, doc_kind, entry_key, item_no, sub_no")]


@query(_P4_LEAVES + """, tm AS (SELECT DISTINCT experiment_id, split_part(entry_key, '|', 1) AS target, y ->> '$.model' AS model FROM s2 WHERE doc_kind = 'sensitivity' AND json_type(y) = 'OBJECT'),
vl AS (SELECT DISTINCT experiment_id, entry_key, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.label' END AS label FROM e3 WHERE doc_kind = 'verification' AND json_type(v) = 'OBJECT')
SELECT tm.experiment_id, target, model, label FROM tm LEFT JOIN vl ON tm.experiment_id = vl.experiment_id AND vl.entry_key = target || '|' || model WHERE model IS NOT NULL""")
def jn10_left_lookup(spark, d):
    """The verification label of every (target, model) that a sensitivity document has results of; NULL if there is none."""
    e = table(spark, d, "experiments")
    m = nested.registry_table(e, "sensitivity", "entry.probes.models")
    m = m.select("experiment_id", F.split("entry_key", r"\|")[0].alias("target"), F.col("probes_models_model").alias("model")).where("model is not null").distinct()
    v = nested.registry_table(e, "verification", "entry").where("mode is not null or label is not null").select("experiment_id", F.col("entry_key").alias("_k"), "label").distinct()
    return m.withColumn("_k", F.concat_ws("|", "target", "model")).join(v, ["experiment_id", "_k"], "left").drop("_k")


@query("""WITH e AS (SELECT DISTINCT experiment_id, campaign_id, sequence_in_campaign, revealed_at, frozen_at, trial_ledger_hash FROM experiments), o AS (SELECT DISTINCT experiment_id, campaign_id, sequence_in_campaign FROM e)
SELECT 'repeated_experiment' AS check_name, count(*) AS n_violations FROM (SELECT experiment_id FROM experiments GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unknown_campaign', count(*) FROM o ANTI JOIN campaigns USING (campaign_id)
UNION ALL SELECT 'campaign_too_large', count(*) FROM (SELECT campaign_id FROM o GROUP BY 1 HAVING count(DISTINCT experiment_id) > 20)
UNION ALL SELECT 'repeated_sequence', count(*) FROM (SELECT campaign_id FROM o GROUP BY campaign_id, sequence_in_campaign HAVING count(DISTINCT experiment_id) > 1)
UNION ALL SELECT 'revealed_before_frozen', count(DISTINCT experiment_id) FROM e WHERE coalesce(revealed_at, '') <> '' AND (coalesce(frozen_at, '') = '' OR revealed_at < frozen_at)
UNION ALL SELECT 'revealed_unsealed', count(DISTINCT experiment_id) FROM e WHERE coalesce(revealed_at, '') <> '' AND coalesce(trial_ledger_hash, '') = ''""")
def rg8_integrity(spark, d):
    return registry.integrity(table(spark, d, "experiments"), table(spark, d, "campaigns"))


@query(_P4_LEAVES + """, tr AS (SELECT experiment_id, split_part(entry_key, '|', 1) || '|' || (y ->> '$.model') || '|' || split_part(entry_key, '|', 2) AS t, count(*) AS n FROM
  (SELECT DISTINCT experiment_id, entry_key, item_no, sub_no, y FROM s2 WHERE doc_kind = 'sensitivity' AND json_type(y) = 'OBJECT' AND item_no = 0) GROUP BY 1, 2),
tw AS (SELECT t || '|' || m || '|' || s AS t FROM (SELECT unnest(['DIR_RETURN_15', 'DIR_RETURN_60', 'DIR_RETURN_180', 'DIR_PATH_SKEW_60']) AS t), (SELECT unnest(['RIDGE', 'SPLINE', 'XGB']) AS m), (SELECT unnest(['UPPER_HALF', 'LOWER_HALF']) AS s))
SELECT experiment_id, count(*) AS n_trials, 24 - count(tw.t) AS n_missing, count(*) - count(tw.t) AS n_unknown, count(*) FILTER (WHERE n > 1) AS n_repeated FROM tr LEFT JOIN tw USING (t) GROUP BY 1""")
def rg2_trial_sets(spark, d):
    """The trials that each experiment's first probes have results of, against the declared product."""
    m = nested.registry_table(table(spark, d, "experiments"), "sensitivity", "entry.probes.models").where("probes_no = 0").select("experiment_id", "entry_key", "probes_no", "models_no", F.col("probes_models_model").alias("model")).distinct()
    k = F.split("entry_key", r"\|")
    return events.trial_sets(m.select("experiment_id", k[0].alias("target"), F.get(k, F.lit(1)).alias("half"), "model"), "experiment_id")


@query(_P4_LEAVES + """, tu AS (SELECT DISTINCT experiment_id, concat_ws('|', experiment_id, entry_key, item_no, sub_no) AS trial_id, TRY_CAST(y ->> '$.uplift' AS DOUBLE) AS uplift FROM s2 WHERE doc_kind = 'sensitivity' AND json_type(y) = 'OBJECT'),
tp AS (SELECT campaign_id, experiment_id, trial_id, exp(-abs(uplift) * 40) AS p FROM tu JOIN (SELECT DISTINCT experiment_id, campaign_id FROM experiments WHERE coalesce(revealed_at, '') <> '') USING (experiment_id) WHERE uplift IS NOT NULL),
tk AS (SELECT *, row_number() OVER c AS kc, count(*) OVER (PARTITION BY campaign_id) AS mc, row_number() OVER e AS ke, count(*) OVER (PARTITION BY experiment_id) AS me FROM tp WINDOW c AS (PARTITION BY campaign_id ORDER BY p, trial_id), e AS (PARTITION BY experiment_id ORDER BY p, trial_id))
SELECT campaign_id, experiment_id, trial_id, round(least(1, min(p * mc / kc) OVER (PARTITION BY campaign_id ORDER BY kc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 10) AS campaign_q, round(least(1, p * mc), 10) AS campaign_bonferroni,
  round(least(1, min(p * me / ke) OVER (PARTITION BY experiment_id ORDER BY ke ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 10) AS experiment_q, round(least(1, p * me), 10) AS experiment_bonferroni FROM tk""")
def rg4_campaign_recompute(spark, d):
    """Corrections of every revealed trial, always from the whole revealed table: within its experiment and its campaign."""
    shown = table(spark, d, "experiments").where(F.coalesce("revealed_at", F.lit("")) != "").select("experiment_id").distinct()
    t = _trials(spark, d).join(shown, "experiment_id", "left_semi")
    t = stats.benjamini_hochberg(t, ["experiment_id"], "p", "trial_id", "experiment_q").withColumnRenamed("bonferroni", "experiment_bonferroni")
    t = stats.benjamini_hochberg(t, ["campaign_id"], "p", "trial_id", "campaign_q").withColumnRenamed("bonferroni", "campaign_bonferroni")
    return t.select("campaign_id", "experiment_id", "trial_id", "campaign_q", "campaign_bonferroni", "experiment_q", "experiment_bonferroni")


def _pivot_sql(source: str, name: str, left: int = 5, right: int = 3) -> str:
    """Pivot events of each (series_id, k) of ``source``; k tells apart the copies that end at a cutoff."""
    w = "PARTITION BY series_id, k ORDER BY ts ROWS BETWEEN"
    return f"""{name}_w AS (SELECT series_id, k, low, high, lead(ts, {right}) OVER (PARTITION BY series_id, k ORDER BY ts) + step_ns AS event_ns, count(*) OVER ({w} {left} PRECEDING AND 1 PRECEDING) AS nl,
  min(low) OVER ({w} {left} PRECEDING AND 1 PRECEDING) AS left_low, min(low) OVER ({w} CURRENT ROW AND {right} FOLLOWING) AS right_low, max(high) OVER ({w} {left} PRECEDING AND 1 PRECEDING) AS left_high, max(high) OVER ({w} CURRENT ROW AND {right} FOLLOWING) AS right_high FROM {source}),
{name} AS (SELECT series_id, k, event_ns, CASE WHEN low < left_low AND low <= right_low THEN 1 ELSE -1 END AS direction FROM {name}_w
  WHERE nl = {left} AND event_ns IS NOT NULL AND ((low < left_low AND low <= right_low) <> (high > left_high AND high >= right_high)))"""


@query(sql(f""", all_b AS (SELECT *, -1 AS k FROM cb), {_pivot_sql('all_b', 'pf')} SELECT series_id, event_ns, direction::INT AS direction FROM pf"""))
def w10_pivot_events(spark, d):
    return events.pivots(placed_bars(spark, d), 5, 3)


@query(sql(f""", all_b AS (SELECT *, -1 AS k FROM cb), {_pivot_sql('all_b', 'pf')},
pt AS (SELECT series_id, event_ns, row_number() OVER (PARTITION BY series_id ORDER BY event_ns) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT DISTINCT series_id, event_ns FROM pf)),
ct AS (SELECT series_id, i AS k, event_ns AS cutoff FROM pt WHERE i IN (SELECT floor(j * (pt.n - 1) / 7)::BIGINT FROM (SELECT unnest(range(8)) AS j))),
cut_b AS (SELECT cb.*, k FROM cb JOIN ct USING (series_id) WHERE ts + step_ns <= cutoff), {_pivot_sql('cut_b', 'pc')},
df AS (SELECT series_id, k, event_ns, direction, sum(w) AS w FROM (SELECT series_id, k, event_ns, direction, 1 AS w FROM pc UNION ALL SELECT pf.series_id, ct.k, pf.event_ns, direction, -1 FROM pf JOIN ct ON pf.series_id = ct.series_id AND event_ns <= cutoff) GROUP BY ALL)
SELECT series_id, count(DISTINCT k) AS n_cutoffs, count(*) FILTER (WHERE w <> 0) AS n_cut FROM df GROUP BY 1"""))
def ud4_causality_check(spark, d):
    """The pivot plugin at eight of its own event times per series: bars cut off there, and later bars changed. The
    changed bars are random, so SQL checks the cut; that nothing changed is asserted here."""
    c = events.causality(lambda x: events.pivots(positions.with_positions(x), 5, 3), bars_of(spark, d))
    return c.select("series_id", "n_cutoffs", (F.col("n_cut") + F.col("n_changed")).alias("n_cut"))


# pivots as raw events, then the rules in their order
_GENERATED = f""", all_b AS (SELECT *, -1 AS k FROM cb), {_pivot_sql('all_b', 'pf')},
g1 AS (SELECT pf.series_id, pf.event_ns, min(direction) AS direction, any_value(cb.step_ns) AS step_ns, any_value(tz) AS tz, any_value(rth_to) AS rth_to FROM pf JOIN cb ON pf.series_id = cb.series_id AND pf.event_ns - cb.step_ns = cb.ts
  WHERE epoch(make_timestamptz(cb.ts // 1000) AT TIME ZONE tz - (make_timestamptz(cb.ts // 1000) AT TIME ZONE tz)::DATE) // 60 BETWEEN rth_from AND rth_to - 1 GROUP BY 1, 2 HAVING count(DISTINCT direction) = 1),
g2 AS (SELECT series_id, unnest(kept) AS event_ns FROM (
  SELECT series_id, list_reduce(ts, lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] >= acc[-1] + gap THEN list_append(acc, x[1]) ELSE acc END, []::BIGINT[]) AS kept
  FROM (SELECT series_id, list([event_ns] ORDER BY event_ns) AS ts, any_value(step_ns) * 10 AS gap FROM g1 GROUP BY 1))),
ge AS (SELECT series_id, event_ns, direction FROM g1 JOIN g2 USING (series_id, event_ns) WHERE event_ns + step_ns <= epoch_us(((make_timestamptz(event_ns // 1000) AT TIME ZONE tz)::DATE + to_minutes(rth_to)) AT TIME ZONE tz) * 1000)
"""


def _generated(b, left=5, right=3):
    dims = b.groupBy("series_id").agg(*(F.first(c).alias(c) for c in ("step_ns", "tz", "rth_from", "rth_to")))
    return events.generate(events.pivots(b, left, right), b, dims, F.col("step_ns") * 10)


@query(sql(_GENERATED + "SELECT * FROM ge"))
def ud7_generate_events(spark, d):
    """The whole pipeline from a plugin's raw events to a study's."""
    return _generated(placed_bars(spark, d))


STUDY_LADDER = ["PIVOT", "PIVOT_LONG", "PIVOT_LONG_MORNING"]


@query(sql(_GENERATED + """, gl AS (SELECT ge.*, epoch(l - l::DATE) // 60 < 720 AS morning FROM (SELECT ge.*, make_timestamptz(event_ns // 1000) AT TIME ZONE tz AS l FROM ge JOIN dim USING (series_id)) ge)
SELECT step_no, step, series_id, count(*) AS n FROM (SELECT 0 AS step_no, 'PIVOT' AS step, series_id FROM gl UNION ALL SELECT 1, 'PIVOT_LONG', series_id FROM gl WHERE direction = 1 UNION ALL SELECT 2, 'PIVOT_LONG_MORNING', series_id FROM gl WHERE direction = 1 AND morning) GROUP BY ALL"""))
def ud2_ladder_events(spark, d):
    """A ladder of nested steps under the contract of ladder plugins."""
    b = placed_bars(spark, d)
    e = stored(_generated(b).join(b.groupBy("series_id").agg(F.first("tz").alias("tz")), "series_id").withColumn("minute", local_minute("event_ns")))
    up = e.where("direction = 1")
    sets = dict(zip(STUDY_LADDER, (e, up, up.where("minute < 720"))))
    return events.ladder(sets, STUDY_LADDER, up.where("minute < 720")).groupBy("step_no", "step", "series_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql(", " + ", ".join(["all_b AS (SELECT *, -1 AS k FROM cb)", *(_pivot_sql("all_b", f"p{i}", x["left"], x["right"]) for i, (_, _, x) in enumerate([("", 1.0, {"left": 5, "right": 3}), *events.probes({"left": 5, "right": 3})]))]) + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS parameter, {m}::DOUBLE AS multiplier, count(*) AS n_events, count(b.event_ns) AS n_shared FROM p{i} a LEFT JOIN p0 b ON a.series_id = b.series_id AND a.event_ns = b.event_ns AND a.direction = b.direction" for i, (name, m, _) in enumerate([("base", 1.0, {}), *events.probes({"left": 5, "right": 3})]))))
def ag21_parameter_probes(spark, d):
    """The plugin at parameters a quarter off: how many events it gives and how many it shares with the base."""
    b = placed_bars(spark, d)
    base = {"left": 5, "right": 3}
    cols = ["series_id", "event_ns", "direction"]
    own = events.pivots(b, **base).select(*cols, F.lit(True).alias("shared"))
    out = None
    for name, m, params in [("base", 1.0, base), *events.probes(base)]:
        r = events.pivots(b, **params).join(own, cols, "left").agg(F.count(F.lit(1)).alias("n_events"), F.count("shared").alias("n_shared")).select(F.lit(name).alias("parameter"), F.lit(m).alias("multiplier"), "n_events", "n_shared")
        out = r if out is None else out.unionByName(r)
    return out


@query(sql("SELECT event_id, b.ts + b.step_ns AS delayed_ns FROM ev JOIN cb b ON ev.series_id = b.series_id AND b.pos = pos_t + 3"))
def jn11_delay_shift(spark, d):
    b = placed_bars(spark, d)
    return events.delayed(located(spark, d, b), b, 3).select("event_id", "delayed_ns")


# a plugin that claims to know its outcome after one bar
@query(TARGET_BASE + """SELECT event_id, target_name, event_ns + step_ns AS target_end_ns, target_end_ns AS declared_end_ns, greatest(event_ns + step_ns, target_end_ns) AS effective_target_end_ns FROM tg JOIN el USING (event_id)""")
def tg6_effective_ends(spark, d):
    b = placed_bars(spark, d)
    e = eligible(spark, d, b)
    t = targets.primary_targets(e, b).join(e.select("event_id", "event_ns", "step_ns"), "event_id").withColumn("target_end_ns", F.col("event_ns") + F.col("step_ns"))
    return targets.effective_ends(t, targets.declared_ends(e, b)).select("event_id", "target_name", "target_end_ns", "declared_end_ns", "effective_target_end_ns")


_PQ = {"mfe": "mfe", "abs_mae": "-mae"}


@query(PATH_BASE + """, st AS (SELECT px.*, step_no, step FROM px, (SELECT unnest([0, 1, 2]) AS step_no, unnest(['ALL', 'LONG', 'LONG_MORNING']) AS step) JOIN dim ON true
  WHERE dim.series_id = (SELECT series_id FROM ce WHERE ce.event_id = px.event_id) AND (step_no = 0 OR direction = 1) AND (step_no < 2 OR epoch((make_timestamptz(event_ns // 1000) AT TIME ZONE tz) - (make_timestamptz(event_ns // 1000) AT TIME ZONE tz)::DATE) // 60 < 720)),
lw AS (SELECT count(DISTINCT strftime(make_timestamptz(ts // 1000) AT TIME ZONE tz, '%G-W%V')) AS n_weeks FROM cb),
lp AS (SELECT step_no, step, h, count(*) AS n, avg((direction * (close_h - p0) > 0)::INT) AS continuation, """ + ", ".join(f"quantile_cont({e}, {q}) AS {n}_p{round(q * 100)}" for n, e in _PQ.items() for q in (0.5, 0.75, 0.95)) + """ FROM st WHERE elig AND sigma IS NOT NULL GROUP BY ALL),
lz AS (SELECT lp.*, n / n_weeks AS per_week FROM lp, lw)
SELECT a.step_no, a.step, a.h, a.n, """ + ", ".join(f"round(a.{c}, 10) + 0.0 AS {c}" for c in ("continuation", "mfe_p50", "mfe_p75", "mfe_p95", "abs_mae_p50", "abs_mae_p75", "abs_mae_p95", "per_week")) + ", " + ", ".join(f"round(a.{c} - b.{c}, 10) + 0.0 AS d_{c}" for c in ("per_week", "continuation", "mfe_p50", "abs_mae_p50")) + """
FROM lz a LEFT JOIN lz b ON a.h = b.h AND b.step_no = a.step_no - 1""", digits=6)
def pd11_ladder_paths(spark, d):
    p = _paths(spark, d).join(located(spark, d).select("event_id", "tz"), "event_id").withColumn("minute", local_minute("event_ns"))
    long = F.col("direction") == 1
    step = lambda i, name: F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"))
    p = p.select("*", F.inline(F.array_compact(F.array(step(0, "ALL"), F.when(long, step(1, "LONG")), F.when(long & (F.col("minute") < 720), step(2, "LONG_MORNING"))))))
    return pathstats.ladder_paths(p, stats.weeks_with_bars(bars_of(spark, d)).where("year is null").select("n_weeks"))


@query()
def m5_importances(spark, d):
    """Importances and coefficients of the three models, per study, target and fold: fits, so no SQL."""
    return _fitted(spark, d, crossval.importances, _in_folds)


HOLDOUT = ("2019-01-01", "2020-01-01")
_HOLDOUT_NS = [int(datetime.fromisoformat(x).replace(tzinfo=UTC).timestamp()) * 1_000_000_000 for x in HOLDOUT]


@query(PANEL_BASE + f""", hr AS (SELECT *, CASE WHEN event_ns < a AND end_ns < a THEN 'train' WHEN event_ns >= a AND end_ns <= z THEN 'val' END AS role FROM ro, (SELECT epoch_us(TIMESTAMP '{HOLDOUT[0]}') * 1000 AS a, epoch_us(TIMESTAMP '{HOLDOUT[1]}') * 1000 AS z)),
ht AS (SELECT {_BY}, quantile_cont(score, 0.5) AS threshold FROM hr WHERE role = 'train' GROUP BY ALL)
SELECT {_BY}, count(*) AS n, count(*) FILTER (WHERE score > threshold) AS n_selected, round(avg(y) FILTER (WHERE score > threshold), 10) + 0.0 AS selected_effect, round(avg(y) FILTER (WHERE score > threshold) - avg(y), 10) + 0.0 AS uplift FROM hr JOIN ht USING ({_BY}) WHERE role = 'val' GROUP BY ALL""")
def cv12_holdout(spark, d):
    b = placed_bars(spark, d)
    rows = crossval.holdout_rows(_score_rows(_study_events(spark, d, b), b), *_HOLDOUT_NS)
    return _selected(crossval.score_panel(rows, BY, "score", min_train=1))


@query(CELL_BASE + PANEL_BASE[len(BASE):] + f""", hr AS (SELECT *, CASE WHEN event_ns < a AND end_ns < a THEN 'train' WHEN event_ns >= a AND end_ns <= z THEN 'val' END AS role FROM ro, (SELECT epoch_us(TIMESTAMP '{HOLDOUT[0]}') * 1000 AS a, epoch_us(TIMESTAMP '{HOLDOUT[1]}') * 1000 AS z)),
ht AS (SELECT {_BY}, quantile_cont(score, 0.5) AS threshold FROM hr WHERE role = 'train' GROUP BY ALL),
hm AS (SELECT study || '|ALL' AS context, event_id FROM me WHERE event_ns >= epoch_us(TIMESTAMP '{HOLDOUT[0]}') * 1000 AND event_ns < epoch_us(TIMESTAMP '{HOLDOUT[1]}') * 1000
  UNION ALL SELECT study || '|' || target || '|' || model, event_id FROM hr JOIN ht USING ({_BY}) WHERE role = 'val' AND score > threshold),
h6 AS (SELECT context, avg((direction * (close_h - p0) > 0)::INT) AS continuation, avg((direction * (close_h - p0) < 0)::INT) AS reversal, quantile_cont(mfe, 0.5) AS median_mfe, quantile_cont(-mae, 0.5) AS median_abs_mae FROM hm JOIN px USING (event_id) WHERE h = 60 AND elig GROUP BY 1),
hc AS (SELECT context, count(*) FILTER (WHERE m > 0) AS positive_cells, count(*) AS cells FROM (SELECT context, expiry, stop_sigma, target_sigma, avg(pnl) AS m FROM hm JOIN cl USING (event_id) GROUP BY ALL) GROUP BY 1),
hn AS (SELECT context, count(*) AS n_events FROM hm JOIN pa USING (event_id) GROUP BY 1)
SELECT context, n_events, round(continuation, 10) + 0.0 AS continuation, round(reversal, 10) + 0.0 AS reversal, round(median_mfe, 10) + 0.0 AS median_mfe, round(median_abs_mae, 10) + 0.0 AS median_abs_mae, positive_cells, cells FROM hn LEFT JOIN h6 USING (context) LEFT JOIN hc USING (context)""", digits=6)
def pd12_holdout_digest(spark, d):
    """Paths of the holdout's events: all of each study, and those that each score selects."""
    b = placed_bars(spark, d)
    e = _study_events(spark, d, b)
    p = crossval.score_panel(crossval.holdout_rows(_score_rows(e, b), *_HOLDOUT_NS), BY, "score", min_train=1).where("state = 'UPPER_HALF'")
    inside = e.where((F.col("event_ns") >= _HOLDOUT_NS[0]) & (F.col("event_ns") < _HOLDOUT_NS[1]))
    m = inside.select(F.concat_ws("|", "study", F.lit("ALL")).alias("context"), "event_id").unionByName(p.select(F.concat_ws("|", *BY).alias("context"), "event_id"))
    return pathstats.digest(_paths(spark, d).join(m, "event_id"), ["context"])


def _selected(p):
    sel = F.when(F.col("state") == "UPPER_HALF", F.col("y"))
    return p.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.count(sel).alias("n_selected"), F.avg(sel).alias("selected_effect"), (F.avg(sel) - F.avg("y")).alias("uplift"))


@query()
def cv12_model_holdout(spark, d):
    """All three models fitted before the holdout and read on it: fits, so no SQL."""
    return _selected(_fitted(spark, d, crossval.walk_forward, lambda rows, _: crossval.holdout_rows(rows, *_HOLDOUT_NS)))


@query(PANEL_BASE + """, cu AS (SELECT ro.study, target, model, symbol AS config, block, avg(y) FILTER (WHERE score > 0.5) - avg(y) AS u FROM ro JOIN bl ON ro.study = bl.study AND (lo IS NULL OR event_ns >= lo) AND (hi IS NULL OR event_ns < hi) GROUP BY ALL),
cp AS (SELECT a * 6 + b AS split, a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b),
ct AS (SELECT study, target, model, config, split, round(coalesce(sum(u) FILTER (WHERE block NOT IN (a, b)), 0), 12) AS tr, round(coalesce(sum(u) FILTER (WHERE block IN (a, b)), 0), 12) AS te FROM cu, cp GROUP BY ALL),
cr AS (SELECT *, (rank() OVER (PARTITION BY study, target, model, split ORDER BY te) + (count(*) OVER (PARTITION BY study, target, model, split, te) - 1) / 2) / (count(*) OVER (PARTITION BY study, target, model, split) + 1) AS r,
  row_number() OVER (PARTITION BY study, target, model, split ORDER BY tr DESC, config) AS k FROM ct)
SELECT study, target, model, round(avg((r < 0.5)::INT), 10) AS pbo, count(*) AS n_splits FROM cr WHERE k = 1 GROUP BY ALL""")
def cv11_overfitting(spark, d):
    """Each symbol's uplift per block as a configuration."""
    b = placed_bars(spark, d)
    e = _study_events(spark, d, b)
    r = _score_rows(e, b).join(_blocks(e), "study").where((F.col("lo").isNull() | (F.col("event_ns") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("event_ns") < F.col("hi"))))
    u = F.avg(F.when(F.col("score") > 0.5, F.col("y"))) - F.avg("y")
    return crossval.overfitting(r.groupBy(*BY, F.col("symbol").alias("config"), "block").agg(u.alias("uplift")), BY)


@query(sql(""", cm AS (SELECT event_id, unnest(['ALL', side, side || '|' || symbol]) AS context FROM (SELECT *, CASE WHEN direction > 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM ev)),
cl AS (SELECT context, count(*) AS n, list(event_id ORDER BY event_id) AS ids FROM cm GROUP BY 1)
SELECT context, n, min(context) OVER (PARTITION BY ids) AS same_as FROM cl"""))
def pd10_context_groups(spark, d):
    """Contexts (all events, each direction, each direction per symbol); those with the same events go together."""
    e = located(spark, d)
    side = F.when(F.col("direction") > 0, "LONG").otherwise("SHORT")
    m = e.select("event_id", F.explode(F.array(F.lit("ALL"), side, F.concat(side, F.lit("|"), F.col("symbol")))).alias("context"))
    g = pathstats.group_contexts(m)
    return g.select("context", "n", F.min("context").over(Window.partitionBy("fingerprint")).alias("same_as"))


@query(r"""WITH RECURSIVE one AS (SELECT DISTINCT upper(regexp_replace(experiment_id, '^\s+|\s+$', '', 'g')) AS a, upper(regexp_replace(lineage_parent, '^\s+|\s+$', '', 'g')) AS b FROM experiments),
l AS (SELECT a, b FROM one WHERE b <> '' UNION SELECT b, a FROM one WHERE b <> ''),
r AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node, min(other) AS component FROM r GROUP BY 1""")
def gr1_components(spark, d):
    """Families of experiments: components of the parent links, parents outside the registry included."""
    k = lambda c: F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    e = table(spark, d, "experiments", "experiment_id", "lineage_parent").select(k("experiment_id").alias("a"), F.nullif(k("lineage_parent"), F.lit("")).alias("b"))
    return graphs.components(e, "a", "b")


@query("""SELECT event_type AS series_id, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) * 1000 AS ts, arg_min(value, [epoch_us(ts), event_id]) AS open, max(value) AS high, min(value) AS low, arg_max(value, [epoch_us(ts), event_id]) AS close, count(*)::DOUBLE AS volume
FROM events WHERE value IS NOT NULL GROUP BY 1, time_bucket(INTERVAL 5 MINUTE, ts)""")
def src8_bars_from_events(spark, d):
    """Raw events to bars: the same plan runs over a stream."""
    b = resample.bars(table(spark, d, "events"), "event_type", "ts", "value", "event_id", "5 minutes")
    return b.select("series_id", (F.unix_micros("bar_time") * 1000).alias("ts"), "open", "high", "low", "close", "volume")
