"""Forward windows: session-truncated targets, diagnostic targets and path excursions.

Events meet the bars of their window by an equi-join on blocks of positions; each block also holds the
bars after it that a window can reach. Targets are conditional aggregates over that join, path excursions
and diagnostics one grouped-map pass over blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.functions.clock import session_close_ns

SPAN = 1024  # bars in a block: the HORIZON copied to each is little beside it
HORIZON = 180

# Horizons in bars and barrier levels in sigma.
RETURN_TARGETS = (15, 60, 180)
SKEW_BARS = 60
DIAG_RETURNS = (5, 120)
DIAG_EXCURSIONS = (15, 30, 60, 120)
FIRST_PASSAGE = (1.0, 0.5)
PATH_HORIZONS = (5, 15, 30, 60, 120)
LEVELS = (0.5, 1.0, 1.5, 2.0)


class TargetSessionError(ValueError):
    """A primary window runs over its session's close."""


def with_close(located: DataFrame) -> DataFrame:
    """Adds ``close_ns``, the regular close of the event's local date, and ``target_eligible``: one whole
    bar fits before it."""
    e = located.withColumn("close_ns", session_close_ns("event_ns"))
    return e.withColumn("target_eligible", F.col("event_ns") + F.col("step_ns") <= F.col("close_ns"))


def horizon(n: int) -> Column:
    """Bars of a window of n truncated at the close, one at least."""
    return F.greatest(F.least(F.lit(n), F.expr("(close_ns - event_ns) div step_ns")), F.lit(1))


#: What ``forward`` leaves the rows of an event together by: aggregates and windows on it need no shuffle.
HERE = ["series_id", "block"]


def forward(events: DataFrame, bars: DataFrame, n: int = HORIZON) -> DataFrame:
    """Event rows times the bars of their next n positions, as ``j`` = 0, 1, ... with ``b_*`` columns, hashed by HERE."""
    at = F.expr(f"pos % {SPAN}")
    own = F.expr(f"pos div {SPAN}")
    blocks = F.array_compact(F.array(own, *(F.when((at < n - SPAN * k) & (own > k), own - k - 1) for k in range(-(-n // SPAN)))))
    b = bars.select("series_id", "pos", *(F.col(c).alias(f"b_{c}") for c in ("ts", "open", "high", "low", "close")), F.explode(blocks).alias("block"))
    e = events.withColumn("block", F.expr(f"pos_fwd div {SPAN}"))
    return e.join(b, ["series_id", "block"]).where((F.col("pos") >= F.col("pos_fwd")) & (F.col("pos") < F.col("pos_fwd") + n)).withColumn("j", (F.col("pos") - F.col("pos_fwd")).cast("int")).drop("pos")


def _own(events: DataFrame) -> list[str]:
    return ["event_id", "direction", "event_ns", "close_ns", "step_ns"]


def primary_targets(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Long form, one row per resolved (event, target): ``event_id, target_name, target_start_ns,
    target_end_ns, effective_target_end_ns, value, horizon_bars_effective, truncated, crosses_session``.

    ``events``: located and eligible. Windows the data do not complete are left out, by stamps only."""
    e = events.select("series_id", "pos_fwd", *_own(events))
    f = forward(e, bars)
    # the four returns and the skew need: open of bar 0, close and stamp of the last bar, extremes inside
    names = {f"DIR_RETURN_{n}": n for n in RETURN_TARGETS} | {f"DIR_PATH_SKEW_{SKEW_BARS}": SKEW_BARS}
    lens = sorted(set(names.values()))
    agg = [F.max(F.when(F.col("j") == 0, F.col("b_open"))).alias("p0"), F.max(F.when(F.col("j") == 0, F.col("b_ts"))).alias("t0")]
    for n in lens:
        last = F.col("j") == horizon(n) - 1
        agg += [F.max(F.when(last, F.col("b_close"))).alias(f"c{n}"), F.max(F.when(last, F.col("b_ts"))).alias(f"t{n}")]
    inside = F.col("j") < horizon(SKEW_BARS)
    agg += [F.max(F.when(inside, F.col("b_high"))).alias("hi"), F.min(F.when(inside, F.col("b_low"))).alias("lo")]
    g = f.groupBy(*HERE, *_own(e)).agg(*agg)
    up, dn = F.ln(F.col("hi") / F.col("p0")), F.ln(F.col("lo") / F.col("p0"))
    rows = []
    for name, n in names.items():
        ret = F.col("direction") * F.ln(F.col(f"c{n}") / F.col("p0"))
        skew = F.when(F.col("direction") > 0, up + dn).otherwise(-dn - up)
        rows.append(F.struct(F.lit(name).alias("target_name"), F.col(f"t{n}").alias("last_ns"), (skew if "SKEW" in name else ret).alias("value"), horizon(n).cast("long").alias("horizon_bars_effective"), (horizon(n) < n).alias("truncated")))
    long = g.select(*_own(e), "t0", F.inline(F.array(*rows))).where("last_ns is not null")
    end = F.col("last_ns") + F.col("step_ns")
    return long.select(
        "event_id", "target_name", F.col("t0").alias("target_start_ns"), end.alias("target_end_ns"),
        end.alias("effective_target_end_ns"),  # the claimed end is the declared one: the completion of the last bar
        "value", "horizon_bars_effective", "truncated", (end > F.col("close_ns")).alias("crosses_session"),
    )


def declared_ends(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``event_id, target_name, declared_end_ns``: the completion of the last bar of each primary target's own horizon, by
    position; NULL if the data end before it."""
    names = {f"DIR_RETURN_{n}": n for n in RETURN_TARGETS} | {f"DIR_PATH_SKEW_{SKEW_BARS}": SKEW_BARS}
    e = events.select("event_id", "series_id", "pos_fwd", F.inline(F.array(*(F.struct(F.lit(k).alias("target_name"), (F.col("pos_fwd") + horizon(n) - 1).alias("pos")) for k, n in names.items()))))
    b = bars.select("series_id", "pos", (F.col("ts") + F.col("step_ns")).alias("declared_end_ns"))
    return e.join(b, ["series_id", "pos"], "left").select("event_id", "target_name", "declared_end_ns")


def effective_ends(targets: DataFrame, declared: DataFrame) -> DataFrame:
    """Targets whose effective end is the later of the claimed and the declared one: a plugin that claims to know an
    outcome early is purged as if it did not."""
    t = targets.drop("effective_target_end_ns").join(declared, ["event_id", "target_name"], "left")
    return t.withColumn("effective_target_end_ns", F.greatest("target_end_ns", "declared_end_ns"))


def inside_session(targets: DataFrame, strict: bool = False) -> DataFrame:
    """Targets that resolve within the event's session. ``strict`` raises if any does not."""
    if strict:
        bad = [r["event_id"] for r in targets.where("crosses_session").select("event_id").limit(5).collect()]
        if bad:
            raise TargetSessionError(f"windows cross the close: {bad}")
    return targets.where(~F.col("crosses_session")).drop("crosses_session")


def span_violations(events: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """One row: how many complete forward windows of n bars span more than n - 1 intervals."""
    f = forward(events.select("event_id", "series_id", "pos_fwd", "step_ns"), bars, n)
    g = f.groupBy(*HERE, "event_id", "step_ns").agg(F.min("b_ts").alias("a"), F.max(F.when(F.col("j") == n - 1, F.col("b_ts"))).alias("z"))
    return g.agg(F.count(F.when(F.col("z") - F.col("a") > F.col("step_ns") * (n - 1), 1)).alias("n_violations"))


MAP_SPAN = 4096  # positions of a block of the grouped-map passes


def _grouped(events: DataFrame, bars: DataFrame, n: int, compute, schema: str) -> DataFrame:
    """Per block of positions: the block's events and its bars, with the n bars after it, go to ``compute`` as
    (events, matrices of the next n bars, which of them exist). Events without a forward bar give no row.

    The dozens of running extremes below make an aggregate whose generated code is too large to be compiled;
    over the events of sf0.1 it took 31 s, this pass takes a few."""
    own, at = F.expr(f"pos div {MAP_SPAN}"), F.expr(f"pos % {MAP_SPAN}")
    cols = ["ts", "open", "high", "low", "close"]
    b = bars.select("series_id", "pos", *cols, F.explode(F.array_compact(F.array(own, F.when((at < n) & (own > 0), own - 1)))).alias("block"))
    e = events.withColumn("block", F.expr(f"pos_fwd div {MAP_SPAN}"))
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(ev: pd.DataFrame, ba: pd.DataFrame) -> pd.DataFrame:
        ba = ba.sort_values("pos")
        i = ev["pos_fwd"].to_numpy() - (ba["pos"].iloc[0] if len(ba) else 0)
        ev, i = ev[i < len(ba)], i[i < len(ba)]
        if not len(ev):
            return pd.DataFrame(columns=names)
        idx = i[:, None] + np.arange(n)
        ok = idx < len(ba)
        m = {c: ba[c].to_numpy()[np.minimum(idx, len(ba) - 1)] for c in cols}
        return pd.DataFrame(compute(ev, m, ok))[names]

    return e.groupBy("series_id", "block").cogroup(b.groupBy("series_id", "block")).applyInPandas(run, schema)


def _running(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running maximum along the rows, and the 1-based bar at which it was first reached."""
    x = np.where(ok, x, -np.inf)
    top = np.maximum.accumulate(x, axis=1)
    before = np.hstack([np.full((len(x), 1), -np.inf), top[:, :-1]])
    return top, np.maximum.accumulate(np.where(x > before, np.arange(1, x.shape[1] + 1), 0), axis=1)


def _nullable(x: np.ndarray, there: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.where(there, x, 0).astype("int32"), ~there)


def _first(hit: np.ndarray) -> pd.arrays.IntegerArray:
    """1-based position of the first hit of each row, NULL if none."""
    return _nullable(hit.argmax(1) + 1, hit.any(1))


def _oriented(ev: pd.DataFrame, m: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    p0, long = m["open"][:, :1], (ev["direction"].to_numpy() > 0)[:, None]
    up, dn = np.log(m["high"] / p0), np.log(m["low"] / p0)
    return p0, long, np.where(long, up, -dn), np.where(long, dn, -up)


def paths(events: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per event: ``p0``, and per horizon h ``elig_h, close_h, mfe_h, mae_h, t_mfe_h, t_mae_h``;
    if ``events`` has ``sigma``, per level ``t_fav_k, t_adv_k`` (first bar at or beyond it, NULL if none).

    The first bar that reaches an extreme counts. Points are in the event's direction. Where the data end
    early the extremes are those of the bars there are, and the path is not eligible."""
    sigma = "sigma" in events.columns
    e = events.select("series_id", "pos_fwd", *_own(events), *(["sigma"] if sigma else []))
    kinds, keep = dict(e.dtypes), _own(events)
    parts = [*(f"{c} {kinds[c]}" for c in keep), *(["sigma double"] if sigma else []), "p0 double"]
    for h in PATH_HORIZONS:
        parts += [f"elig_{h} boolean", f"close_{h} double", f"mfe_{h} double", f"mae_{h} double", f"t_mfe_{h} int", f"t_mae_{h} int"]
    parts += [f"`t_{x}_{k}` int" for k in LEVELS for x in ("fav", "adv")] if sigma else []

    def compute(ev: pd.DataFrame, m: dict[str, np.ndarray], ok: np.ndarray) -> dict:
        p0, long, lf, la = _oriented(ev, m)
        mfe, t_mfe = _running(np.where(long, m["high"] - p0, p0 - m["low"]), ok)
        worst, t_mae = _running(-np.where(long, m["low"] - p0, p0 - m["high"]), ok)
        step, close = ev["step_ns"].to_numpy(), ev["close_ns"].to_numpy()
        out = {c: ev[c].to_numpy() for c in keep} | {"p0": p0[:, 0]}
        for h in PATH_HORIZONS:
            last = m["ts"][:, h - 1]
            there = ok[:, h - 1]
            out |= {
                f"elig_{h}": there & (last - m["ts"][:, 0] == step * (h - 1)) & (last + step <= close),
                f"close_{h}": np.where(there, m["close"][:, h - 1], np.nan),
                f"mfe_{h}": mfe[:, h - 1], f"mae_{h}": -worst[:, h - 1], f"t_mfe_{h}": t_mfe[:, h - 1], f"t_mae_{h}": t_mae[:, h - 1],
            }
        if sigma:
            s = ev["sigma"].to_numpy(float)[:, None]
            out["sigma"] = s[:, 0]
            for k in LEVELS:
                out |= {f"t_fav_{k}": _first(ok & (lf >= k * s)), f"t_adv_{k}": _first(ok & (la <= -k * s))}
        return out

    g = _grouped(e, bars, max(PATH_HORIZONS), compute, ", ".join(parts))
    return g.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in [*(["sigma"] if sigma else []), *(f"close_{h}" for h in PATH_HORIZONS)]})


def path_rows(p: DataFrame) -> DataFrame:
    """``paths`` in long form: ``event_id, h, elig, close_h, mfe_pts, mae_pts, t_mfe, t_mae``."""
    return p.select("event_id", F.inline(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"elig_{h}").alias("elig"), F.col(f"close_{h}").alias("close_h"), F.col(f"mfe_{h}").alias("mfe_pts"), F.col(f"mae_{h}").alias("mae_pts"), F.col(f"t_mfe_{h}").alias("t_mfe"), F.col(f"t_mae_{h}").alias("t_mae")) for h in PATH_HORIZONS))))


def diagnostics(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Report-only targets, one row per event with a forward bar; NULL unless the whole window is in the data and
    before the close. ``events`` may carry ``sigma`` for the first-passage codes (+1, -1, 0)."""
    sigma = "sigma" in events.columns
    e = events.select("series_id", "pos_fwd", *_own(events), *(["sigma"] if sigma else []))
    code = {k: f"DIAG_FIRST_PASSAGE_{k}".replace(".", "_") for k in FIRST_PASSAGE} if sigma else {}
    doubles = [f"DIAG_RET_{n}" for n in DIAG_RETURNS]
    ints = []
    for n in DIAG_EXCURSIONS:
        doubles += [f"DIAG_MFE_{n}", f"DIAG_MAE_{n}"]
        ints += [f"DIAG_TIME_TO_MFE_{n}", f"DIAG_TIME_TO_MAE_{n}"]
    doubles += ["DIAG_PATH_LENGTH_60", "DIAG_PATH_EFFICIENCY_60", "DIAG_FWD_RV_60"]
    ints += list(code.values())

    def compute(ev: pd.DataFrame, m: dict[str, np.ndarray], ok: np.ndarray) -> dict:
        p0, _, lf, la = _oriented(ev, m)
        d = ev["direction"].to_numpy(float)
        ns, step, close = (ev[c].to_numpy() for c in ("event_ns", "step_ns", "close_ns"))
        whole = lambda n: ok[:, n - 1] & (ns + step * n <= close)
        real = lambda n, x: np.where(whole(n), x, np.nan)
        count = lambda n, x: _nullable(x, whole(n))
        fav, t_fav = _running(lf, ok)
        worst, t_adv = _running(-la, ok)
        out = {"event_id": ev["event_id"].to_numpy()} | {f"DIAG_RET_{n}": real(n, d * np.log(m["close"][:, n - 1] / p0[:, 0])) for n in DIAG_RETURNS}
        for n in DIAG_EXCURSIONS:
            out |= {f"DIAG_MFE_{n}": real(n, fav[:, n - 1]), f"DIAG_MAE_{n}": real(n, -worst[:, n - 1])}
            out |= {f"DIAG_TIME_TO_MFE_{n}": count(n, t_fav[:, n - 1]), f"DIAG_TIME_TO_MAE_{n}": count(n, t_adv[:, n - 1])}
        for k, name in code.items():
            s = ev["sigma"].to_numpy(float)[:, None]
            hit = lambda x: np.where(x.any(1), x.argmax(1), 9999)
            u, w = hit((lf >= k * s)[:, :60]), hit((la <= -k * s)[:, :60])
            out[name] = count(60, np.sign(w - u))
        steps = np.log(m["close"][:, :60] / np.hstack([p0, m["close"][:, :59]]))
        length, net = np.abs(steps).sum(1), np.abs(steps.sum(1))
        with np.errstate(all="ignore"):
            out |= {"DIAG_PATH_LENGTH_60": real(60, length), "DIAG_PATH_EFFICIENCY_60": real(60, net / length), "DIAG_FWD_RV_60": real(60, np.sqrt((steps**2).sum(1)))}
        return out

    g = _grouped(e, bars, 120, compute, ", ".join(["event_id string", *(f"{c} double" for c in doubles), *(f"{c} int" for c in ints)]))
    return g.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles})
