"""The bank of trailing-window features, anchored at the last complete bar of each event.

A series is cut into chunks of CHUNK positions; each chunk also gets the HALO bars before it, so a window
never leaves its chunk and a long series is spread over the cluster. One grouped-map pass over the chunks
computes all windows with NumPy. (As window expressions over exact, decimal running sums the bank has some
150 frames; that plan took 246 s where this pass takes 13 s on the same 590,000 bars. Running sums of doubles
are no way out: one absurd price in a chunk blurs the windows after it.)"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.functions.clock import DAY_NS, local_day, local_minute, local_ns

CHUNK = 8192
HALO = 512

# Window lengths in bars, lags and multiples of the bank.
RET = RV = (5, 15, 30, 60, 120, 240)
VOV = (30, 60, 120)
ER = BROWNIAN = (15, 30, 60, 120, 240)
VR_WINDOWS, VR_Q = (60, 120, 240), (2, 4, 8)
HURST_WINDOWS, HURST_LAGS, HURST_MIN = (120, 240, 480), (1, 2, 4, 8, 16), 4
BALANCE = (15, 30, 60)
RANGE = (15, 30, 60, 120)
VOLUME = (15, 30, 60)
MIN_HISTORY = 480

FAMILIES: dict[str, list[str]] = {
    "f1_returns": [f"RET_{n}" for n in RET],
    "f2_realized_volatility": [f"RV_{n}" for n in RV],
    "f3_volatility_of_volatility": [f"VOV_{n}" for n in VOV],
    "f4_efficiency_ratio": [f"ER_{n}" for n in ER],
    "f5_brownian_displacement": [f"BROWNIAN_DISP_{n}" for n in BROWNIAN],
    "f6_variance_ratio": [f"VR_{w}_{q}" for w in VR_WINDOWS for q in VR_Q],
    "f7_hurst": [f"HURST_{w}" for w in HURST_WINDOWS],
    "f8_count_balance": [f"COUNT_BALANCE_{n}" for n in BALANCE],
    "f9_body_balance": [f"BODY_BALANCE_{n}" for n in BALANCE],
    "f10_range_position": [f"RANGE_POS_{n}" for n in RANGE],
    "f11_signed_volume": [f"SIGNED_VOLUME_{n}" for n in VOLUME],
    "f12_minutes_since_open": ["minutes_since_RTH_open"],
    "f13_session_phase": ["sin_RTH_phase", "cos_RTH_phase"],
    "f14_return_from_open": ["RTH_return_from_open"],
    "f15_vwap_distance": ["distance_from_causal_session_VWAP"],
    "f16_day_of_week": ["day_of_week"],
}
#: The 56 names in the order of the bank.
NAMES = [
    *FAMILIES["f1_returns"], *FAMILIES["f2_realized_volatility"], *FAMILIES["f3_volatility_of_volatility"], *FAMILIES["f4_efficiency_ratio"],
    *FAMILIES["f5_brownian_displacement"], *FAMILIES["f6_variance_ratio"], *FAMILIES["f7_hurst"],
    *(x for n in BALANCE for x in (f"COUNT_BALANCE_{n}", f"BODY_BALANCE_{n}")), *FAMILIES["f10_range_position"], *FAMILIES["f11_signed_volume"],
    *FAMILIES["f12_minutes_since_open"], *FAMILIES["f13_session_phase"], *FAMILIES["f14_return_from_open"], *FAMILIES["f15_vwap_distance"], *FAMILIES["f16_day_of_week"],
]


def chunked(bars: DataFrame, back: int = HALO, ahead: int = 0) -> DataFrame:
    """Bars with ``chunk`` and ``core``; the ``back`` bars before a chunk, and ``ahead`` after it, come along
    as copies with ``core`` false."""
    c, at = F.expr(f"pos div {CHUNK}"), F.expr(f"pos % {CHUNK}")
    parts = [F.struct(c.alias("chunk"), F.lit(True).alias("core"))]
    if back:
        parts.append(F.when(at >= CHUNK - back, F.struct((c + 1).alias("chunk"), F.lit(False).alias("core"))))
    if ahead:
        parts.append(F.when((at < ahead) & (c > 0), F.struct((c - 1).alias("chunk"), F.lit(False).alias("core"))))
    return bars.select("*", F.inline(F.array_compact(F.array(*parts))))


def _rows(x: np.ndarray, at: np.ndarray, n: int, f=np.sum) -> np.ndarray:
    """f over the n values that end at each of the positions ``at``; NaN where there are fewer."""
    out, ok = np.full(len(at), np.nan), at >= n - 1
    if ok.any():
        out[ok] = _windowed(np.lib.stride_tricks.sliding_window_view(x, n), at[ok] - n + 1, f)
    return out


def _windowed(view: np.ndarray, i: np.ndarray, f) -> np.ndarray:
    """f over the windows i, in ascending order: of a run of all of them as they lie, of others a thousand copied at a time."""
    if i[-1] - i[0] + 1 == len(i):
        return f(view[i[0] : i[-1] + 1], axis=1)
    return np.concatenate([f(view[j], axis=1) for j in np.array_split(i, -(-len(i) // 1024))])


def _back(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) > n:
        out[n:] = x[:-n]
    return out


def _over(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.where(bottom == 0, np.nan, top / np.where(bottom == 0, 1.0, bottom))


def window_features(o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, v: np.ndarray, want: set[str], at: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The wanted features at the positions ``at`` (every bar if not given) of one run of bars, NaN where undefined."""
    at = np.arange(len(c)) if at is None else at
    x = np.log(c)
    r, dc, body = x - _back(x, 1), np.abs(c - _back(c, 1)), c - o
    sign = np.sign(body)
    out: dict[str, np.ndarray] = {}

    def put(name: str, f) -> None:
        if name in want:
            out[name] = f()

    pc = _back(c, 1)
    tr = np.maximum(h - lo, np.maximum(np.abs(h - pc), np.abs(lo - pc)))
    for n in RET:
        put(f"RET_{n}", lambda: (x - _back(x, n))[at])
        put(f"RV_{n}", lambda: np.sqrt(_rows(r * r, at, n)))
    for n in VOV:
        put(f"VOV_{n}", lambda: _rows(tr, at, n, np.std))
    for n in ER:
        put(f"ER_{n}", lambda: _over(np.abs(c - _back(c, n))[at], _rows(dc, at, n)))
        put(f"BROWNIAN_DISP_{n}", lambda: _over((x - _back(x, n))[at], np.sqrt(_rows(r * r, at, n))))
    for n in BALANCE:
        put(f"COUNT_BALANCE_{n}", lambda: _rows(sign, at, n) / n)
        put(f"BODY_BALANCE_{n}", lambda: _over(_rows(body, at, n), _rows(np.abs(body), at, n)))
        put(f"SIGNED_VOLUME_{n}", lambda: _over(_rows(sign * v, at, n), _rows(v, at, n)))
    for n in RANGE:
        if f"RANGE_POS_{n}" in want:
            top, low = _rows(h, at, n, np.max), _rows(lo, at, n, np.min)
            out[f"RANGE_POS_{n}"] = np.where(top > low, _over(c[at] - low, top - low), np.where(np.isnan(top), np.nan, 0.5))
    for n in VR_WINDOWS:
        names = [q for q in VR_Q if f"VR_{n}_{q}" in want]
        if names:
            one = _rows(r, at, n - 1, np.var)
            for q in names:
                out[f"VR_{n}_{q}"] = _over(_strided_var(x - _back(x, q), at, q, (n - 1) // q), q * one)
    squares = {k: (x - _back(x, k)) ** 2 for k in HURST_LAGS} if any(f"HURST_{n}" in want for n in HURST_WINDOWS) else {}
    for n in HURST_WINDOWS:
        put(f"HURST_{n}", lambda: _slope(np.stack([_rows(squares[k], at, n - k) / (n - k) for k in HURST_LAGS])))
    return out


def _strided_var(d: np.ndarray, at: np.ndarray, q: int, m: int) -> np.ndarray:
    """Variance of the m values at distances 0, q, 2q, ... back from each of the positions ``at``."""
    span = (m - 1) * q + 1
    out, ok = np.full(len(at), np.nan), at >= span - 1
    if ok.any():
        out[ok] = _windowed(np.lib.stride_tricks.sliding_window_view(d, span)[:, ::-q], at[ok] - span + 1, np.var)
    return out


def _slope(v: np.ndarray) -> np.ndarray:
    """Half the least-squares slope of log v on the logs of the lags, over the positive v."""
    ok = v > 0
    y = np.log(np.where(ok, v, 1.0))
    k = np.log(np.array(HURST_LAGS, float))[:, None] * ok
    n = ok.sum(0)
    with np.errstate(all="ignore"):
        top = (k * y).sum(0) - k.sum(0) * y.sum(0) / n
        bottom = (k * k).sum(0) - k.sum(0) ** 2 / n
        return np.where((n >= HURST_MIN) & ~np.isnan(v).any(0), top / bottom / 2, np.nan)


_BAR = ("open", "high", "low", "close", "volume")
_SESSION = ("RTH_return_from_open", "distance_from_causal_session_VWAP")


def _per_bar(wanted: Iterable[str]) -> list[str]:
    per_bar = {x for f, names in FAMILIES.items() if int(f[1:].split("_")[0]) <= 11 for x in names}
    return [n for n in NAMES if n in set(wanted) & per_bar]


def bar_features(bars: DataFrame, wanted: Iterable[str] = NAMES) -> DataFrame:
    """``series_id, pos`` and the wanted per-bar features (all but those of the session and the event's clock)."""
    want = _per_bar(wanted)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        core = g["core"].to_numpy(bool)
        f = window_features(*(g[c].to_numpy(float) for c in _BAR), set(want), np.flatnonzero(core))
        return pd.DataFrame({"series_id": g["series_id"].to_numpy()[core], "pos": g["pos"].to_numpy()[core]} | {n: f[n] for n in want})

    schema = "series_id string, pos bigint" + "".join(f", {n} double" for n in want)
    got = chunked(bars.select("series_id", "pos", *_BAR)).groupBy("series_id", "chunk").applyInPandas(run, schema)
    return got.select("series_id", "pos", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in want))


def _clocked(bars: DataFrame) -> DataFrame:
    """Bars with their local date, their session (it begins at eth_from) and whether they are regular."""
    d = bars.withColumn("date", local_day("ts")).withColumn("_m", local_minute("ts"))
    return d.withColumns({"session": F.col("date") + (F.col("_m") >= F.col("eth_from")).cast("long"), "rth": (F.col("_m") >= F.col("rth_from")) & (F.col("_m") < F.col("rth_to"))}).drop("_m")


def _carried(clocked: DataFrame) -> DataFrame:
    """``series_id, chunk`` and what its sessions and dates hold in chunks before it, for those that reach over its
    start: ``sums`` (session, volume-weighted price, volume), ``opens`` (date, open of its first regular bar)."""
    b = clocked.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    before = lambda key: Window.partitionBy("series_id", key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    s = b.groupBy("series_id", "session", "chunk").agg(F.sum(tp * F.col("volume")).alias("x"), F.sum("volume").alias("v"))
    s = s.withColumns({"x": F.sum("x").over(before("session")), "v": F.sum("v").over(before("session"))}).where("v is not null")
    s = s.groupBy("series_id", "chunk").agg(F.collect_list(F.struct("session", "x", "v")).alias("sums"))
    o = b.groupBy("series_id", "date", "chunk").agg(F.min_by(F.when(F.col("rth"), F.col("open")), F.when(F.col("rth"), F.col("pos"))).alias("o"))
    o = o.withColumn("o", F.first("o", ignorenulls=True).over(before("date"))).where("o is not null")
    o = o.groupBy("series_id", "chunk").agg(F.collect_list(F.struct("date", "o")).alias("opens"))
    return s.join(o, ["series_id", "chunk"], "full")


def _session_features(g: pd.DataFrame, at: np.ndarray, sums: list, opens: list) -> dict[str, np.ndarray]:
    """At the positions ``at`` of a chunk's own bars: the return since the open of the local date's first regular bar so
    far, and the distance from the volume-weighted price since the session's start."""
    session, date, close, volume = (g[c].to_numpy() for c in ("session", "date", "close", "volume"))
    had = {r["session"]: (r["x"], r["v"]) for r in sums}
    w = pd.DataFrame({"session": session, "x": (g["high"].to_numpy() + g["low"].to_numpy() + close) / 3 * volume, "v": volume}).groupby("session")[["x", "v"]].cumsum().to_numpy()[at]
    w += np.array([had.get(k, (0.0, 0.0)) for k in session[at]]).reshape(-1, 2)
    carried = {r["date"]: r["o"] for r in opens}
    regular = np.flatnonzero(g["rth"].to_numpy(bool))
    days, i = np.unique(date[regular], return_index=True)
    begins = dict(zip(days, regular[i]))  # the first regular bar of each date here
    own = np.array([begins.get(k, len(g)) for k in date[at]], dtype=int)
    first = np.where(own <= at, g["open"].to_numpy()[np.minimum(own, len(g) - 1)], np.nan)
    first = np.array([carried.get(k, o) for k, o in zip(date[at], first)], dtype=float)
    with np.errstate(all="ignore"):
        return {"RTH_return_from_open": np.log(close[at] / first), "distance_from_causal_session_VWAP": np.where(w[:, 1] > 0, close[at] / (w[:, 0] / w[:, 1]) - 1, np.nan)}


def event_clock() -> dict[str, Column]:
    mins = (F.floor((local_ns("event_ns") % F.lit(DAY_NS)) / F.lit(1_000_000_000)) / 60.0) - F.col("rth_from")
    ang = mins * (2 * math.pi) / F.col("rth_minutes")
    return {
        "minutes_since_RTH_open": mins,
        "sin_RTH_phase": F.sin(ang),
        "cos_RTH_phase": F.cos(ang),
        "day_of_week": F.pmod(local_day("event_ns") + 3, F.lit(7)).cast("double"),  # 1970-01-01 was a Thursday, Monday is 0
    }


def compute_features(located: DataFrame, bars: DataFrame, wanted: Iterable[str] = NAMES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per located event, never dropped: ``event_id, completed_bars``, the events' columns ``keep`` and the
    wanted features, NULL where undefined. ``bars`` carries positions.

    Events go to the chunks of bars, and only their rows come out: never the features of all bars."""
    want = [n for n in NAMES if n in set(wanted)]
    clock = {k: v for k, v in event_clock().items() if k in want}
    out = located.select("event_id", *keep, "series_id", F.col("pos_t").alias("pos"), (F.col("pos_t") + 1).alias("completed_bars"), *(v.alias(k) for k, v in clock.items()))
    windows, session = _per_bar(want), [n for n in _SESSION if n in want]
    if not windows and not session:
        return out.select("event_id", "completed_bars", *keep, *want)
    out = out.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    if session:
        bars = _clocked(bars)
        out = out.join(_carried(bars), ["series_id", "chunk"], "left")
    right = chunked(bars.select("series_id", "pos", *_BAR, *(["session", "date", "rth"] if session else [])))
    cols = ["event_id", "completed_bars", *keep, *clock]

    def run(e: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        done = {n: np.full(len(e), np.nan) for n in (*windows, *session)}
        if len(e) and len(g):
            e = e.sort_values("pos", ignore_index=True)
            g = g.sort_values("pos", ignore_index=True)
            at = np.searchsorted(g["pos"].to_numpy(), e["pos"].to_numpy())
            ok = (at < len(g)) & (g["pos"].to_numpy()[np.minimum(at, len(g) - 1)] == e["pos"].to_numpy())
            f = window_features(*(g[c].to_numpy(float) for c in _BAR), set(windows), at[ok]) if windows else {}
            if session:
                core = g["core"].to_numpy(bool)
                as_list = lambda x: [] if x is None else list(x)
                f |= _session_features(g[core].reset_index(drop=True), at[ok] - int(np.argmax(core)), as_list(e["sums"].iloc[0]), as_list(e["opens"].iloc[0]))
            for n, x in done.items():
                x[ok] = f[n]
        return pd.DataFrame({c: e[c].to_numpy() for c in cols} | done)

    types = dict(out.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), *(f"`{n}` double" for n in (*windows, *session))])
    got = out.groupBy("series_id", "chunk").cogroup(right.groupBy("series_id", "chunk")).applyInPandas(run, schema)
    return got.select("event_id", "completed_bars", *keep, *(F.when(~F.isnan(n), F.col(n)).alias(n) if n not in clock else F.col(n) for n in want))


def eligible(features: DataFrame) -> DataFrame:
    return features.where(F.col("completed_bars") >= MIN_HISTORY)


def quality(features: DataFrame, wanted: Iterable[str] = NAMES) -> DataFrame:
    """Per feature the undefined values among eligible rows: ``feature, n_bad``; a model run must see none."""
    ok = eligible(features)
    counts = ok.agg(*(F.count(F.when(F.col(n).isNull() | F.isnan(n), 1)).alias(n) for n in wanted))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_bad")) for n in wanted))))
