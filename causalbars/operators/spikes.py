"""Implausible readings per source: a hidden Markov model over bars plus hard bounds.

Each source is cut by time into blocks of bounded size, so that a source with a third of all rows is
spread over the cluster; a block also gets the nearest readings of the blocks beside it. Per block the
price and the volume chain run through forward-backward over the states normal, spike, stuck and
out-of-range. The emissions carry the definitions, scaled by the source's own exact medians: readings off both
levels around them have no support in the normal state, nor have unchanged runs. A reading is flagged if it
is more likely than not in another state than normal, or breaks a hard bound of what can be."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.runtime import clean_double, cut, stored

STATES = ("normal", "spike", "stuck", "range")
#: chance of each state after each state; normal readings go wrong rarely, stuck ones stay stuck
TRANSITIONS = np.array([[0.997, 0.001, 0.001, 0.001], [0.6, 0.39, 0.005, 0.005], [0.1, 0.005, 0.89, 0.005], [0.6, 0.005, 0.005, 0.39]])
START = np.array([0.97, 0.01, 0.01, 0.01])
EDGE = 16  # readings a block gets from either side
NEAR_BLOCKS = 8  # of blocks that have such readings: enough for runs of eight even if each has one
KINDS = ("price", "level", "volume")  # readings with high, low and close; with a positive close; with a volume
OFF = 1e-12  # chance of what a state does not emit
CHUNK, LAP = 256, 64  # rows of one forward-backward chain, and its warm-up on either side
POINT = 32  # values of a block that share one pair of bounds while a median is being closed in


def forward_backward(lik: np.ndarray, trans: np.ndarray = TRANSITIONS, start: np.ndarray = START) -> np.ndarray:
    """Posterior state probabilities of many chains at once. lik: (chains, steps, states)."""
    c, n, k = lik.shape
    a, b = np.empty_like(lik), np.empty_like(lik)
    f = start * lik[:, 0]
    a[:, 0] = f / f.sum(1, keepdims=True)
    for t in range(1, n):
        f = (a[:, t - 1] @ trans) * lik[:, t]
        a[:, t] = f / f.sum(1, keepdims=True)
    b[:, n - 1] = 1.0
    for t in range(n - 2, -1, -1):
        g = (lik[:, t + 1] * b[:, t + 1]) @ trans.T
        b[:, t] = g / g.sum(1, keepdims=True)
    p = a * b
    return p / p.sum(2, keepdims=True)


def posterior(lik: np.ndarray) -> np.ndarray:
    """forward_backward over one long sequence (n, states), cut into overlapping chunks run side by side."""
    n = len(lik)
    if n == 0:
        return lik
    chunks = -(-n // CHUNK)
    at = np.arange(chunks)[:, None] * CHUNK + np.arange(-LAP, CHUNK + LAP)[None, :]
    pad = (at < 0) | (at >= n)
    x = lik[np.clip(at, 0, n - 1)]
    x[pad] = 1.0
    return forward_backward(x)[:, LAP : LAP + CHUNK].reshape(-1, lik.shape[1])[:n]


def _match(reading: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (reading number, values): length of the unbroken run of equal values over consecutive
    readings that ends at, and that starts at, each row; each counted up to 8."""
    n = len(reading)
    if n == 0:
        return np.zeros(0, int), np.zeros(0, int)
    _, code = np.unique(values, axis=0, return_inverse=True)
    code = code.reshape(-1).astype(np.int64)
    wide = np.int64(reading.max()) + 3
    key = code * wide + reading
    uniq, inv = np.unique(key, return_inverse=True)

    def runs(step: int) -> np.ndarray:
        j = np.searchsorted(uniq, uniq + step)
        ok = (j < len(uniq)) & (uniq[np.minimum(j, len(uniq) - 1)] == uniq + step)
        nxt = np.where(ok, j, -1)
        length, cur = np.ones(len(uniq), int), nxt.copy()
        for _ in range(7):
            live = cur >= 0
            length[live] += 1
            cur = np.where(live, nxt[np.maximum(cur, 0)], -1)
        return length

    return runs(-1)[inv], runs(1)[inv]


def _rolling_median(x: np.ndarray, w: int = 9) -> np.ndarray:
    """Median of the ``w`` values around each; fewer at the ends."""
    h, n = w // 2, len(x)
    out = np.empty(n)
    if n >= w:
        out[h : n - h] = np.median(np.lib.stride_tricks.sliding_window_view(x, w), axis=1)
    for i in range(n) if n < w else (*range(h), *range(n - h, n)):
        out[i] = np.median(x[max(i - h, 0) : i + h + 1])
    return out


def _usual_share(same: np.ndarray, run: int) -> float:
    """Share of the rows outside runs of ``run`` or more that equal a neighbour."""
    free = same[same < run]
    return float(np.clip(np.mean(free > 1), 0.01, 0.5)) if len(free) else 0.01


def emissions(d: np.ndarray, off: np.ndarray, run: np.ndarray, equal: np.ndarray, bad: np.ndarray, p_equal: float) -> np.ndarray:
    """Likelihoods (n, states) of readings at distance d from the usual, in medians.

    Normal readings are heavy-tailed around the usual, now and then equal to a neighbour, but neither ``off`` the levels
    around them nor part of a long ``run``; spikes are off, stuck readings in a run; impossible ones are out of range."""
    eq = np.where(equal, p_equal, 1 - p_equal)
    lik = np.empty((len(d), len(STATES)))
    lik[:, 0] = np.where(off | run, OFF, np.exp(-np.minimum(d, 30.0) / 10.0) / 10.0 * eq)
    lik[:, 1] = np.where(off, 0.02 * eq, OFF)
    lik[:, 2] = np.where(run, 0.1, OFF)
    lik[:, 3] = OFF
    lik[bad] = (OFF, OFF, OFF, 1.0)
    return lik


def judge(
    rows: pd.DataFrame, move: float, vol: float, tick: float, k_price: float, k_volume: float, run: int, wide: int, more: tuple[bool, bool] = (False, False)
) -> pd.DataFrame:
    """Posteriors and flags of one block's rows, which are sorted by stamp; see ``implausible``. ``move``
    and ``vol`` are NaN if unknown; ``more``: the source goes on before, and after, the block."""
    h, lo, c, v, o = (rows[x].to_numpy(float) for x in ("high", "low", "close", "volume", "open"))
    n = len(rows)
    _, t = np.unique(rows["index_ns"].to_numpy(np.int64), return_inverse=True)
    prices = np.stack([h, lo, c], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        bad_price = (prices <= 0).any(1) | (o <= 0) | (h < lo) | (c > h + tick * (1 + 1e-6)) | (c < lo - tick * (1 + 1e-6))
        bad_volume = v < 0
        # the level of each reading: of its copies' closes the one nearest to the rolling median
        ok = ~np.isnan(c) & (c > 0)
        first = np.flatnonzero(ok & np.r_[True, t[1:] != t[:-1]]) if n else np.zeros(0, int)
        tt, cc = t[ok], c[ok]
        _, head = np.unique(tt, return_index=True)
        lev_t, lev = tt[head], cc[head]
        med = _rolling_median(lev)
        if len(lev_t):
            m_row = med[np.searchsorted(lev_t, tt)]
            order = np.lexsort((np.abs(cc - m_row), tt))
            lev = cc[order][np.unique(tt[order], return_index=True)[1]]
            med = _rolling_median(lev)
        scale = move if move > 0 else tick if tick > 0 else 1e-9
        # the distance from the level around it
        if len(lev_t):
            near = np.clip(np.searchsorted(lev_t, t), 0, len(lev_t) - 1)
            dist = np.nanmax(np.where(np.isnan(prices), -1.0, np.abs(prices - med[near][:, None])), axis=1) / scale
        else:
            dist = np.zeros(n)
        dist = np.maximum(dist, 0)

        back = np.ones(n, int)
        ahead = np.ones(n, int)
        full = ~np.isnan(prices).any(1)
        if full.any():
            _, r = np.unique(t[full], return_inverse=True)
            back[full], ahead[full] = _match(r, prices[full])
        same = back + ahead - 1
        vback, vahead = np.ones(n, int), np.ones(n, int)
        some = ~np.isnan(v)
        if some.any():
            _, r = np.unique(t[some], return_inverse=True)
            vback[some], vahead[some] = _match(r, v[some][:, None])
        vsame = np.where(v == 0, 1, vback + vahead - 1)

        # off both levels. Levels before and after a row are the nearest readings that stay near the level around them
        flag_spike = np.zeros(n, bool)
        if len(lev_t):
            normal = np.abs(lev - med) <= k_price / 2 * move
            any_t = np.unique(t[~np.isnan(prices).all(1)])
            nt, nl = lev_t[normal], lev[normal]
            rank = np.searchsorted(any_t, nt)
            r_row = np.searchsorted(any_t, t)
            i = np.searchsorted(nt, t, side="left") - 1
            j = np.searchsorted(nt, t, side="right")
            has_i, has_j = i >= 0, j < len(nt)
            if len(nt):
                li, lj = nl[np.maximum(i, 0)], nl[np.minimum(j, len(nl) - 1)]
                ri = np.where(has_i, rank[np.maximum(i, 0)], r_row - 1)
                rj = np.where(has_j, rank[np.minimum(j, len(nl) - 1)], r_row + 1)
                far_i = np.abs(prices - li[:, None]) > k_price * move
                far_j = np.abs(prices - lj[:, None]) > k_price * move
                far = (far_i | ~has_i[:, None]) & (far_j | ~has_j[:, None]) & ~np.isnan(prices)
                # no level among the readings of the next blocks: more than ``wide`` stand there
                beyond = (~has_i & more[0]) | (~has_j & more[1])
                flag_spike = far.any(1) & (rj - ri - 1 <= wide) & (has_i | has_j) & ~beyond
        vd = np.nan_to_num(np.abs(v) / vol) if vol > 0 else np.zeros(n)
        pp = posterior(emissions(dist, flag_spike, same >= run, same > 1, bad_price, _usual_share(same[full], run)))
        pv = posterior(emissions(vd, v > k_volume * vol, vsame >= run, vsame > 1, bad_volume, _usual_share(vsame[some], run)))
    reason = np.full(n, None, dtype=object)
    for k in (1, 2, 3):  # what is worse stands
        reason[((pp[:, k] > 0.5) | (pv[:, k] > 0.5)) if n else []] = STATES[k]
    reason[(reason == None) & ((pp[:, 0] < 0.5) | (pv[:, 0] < 0.5))] = "spike"  # noqa: E711  not normal, though no one state is likely
    reason[bad_price | bad_volume] = "range"
    return pd.DataFrame(
        {"bar_id": rows["bar_id"].to_numpy(), "p_spike": np.maximum(pp[:, 1], pv[:, 1]), "p_stuck": np.maximum(pp[:, 2], pv[:, 2]), "p_range": np.maximum(pp[:, 3], pv[:, 3]), "reason": reason}
    )


def _told(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with the columns of ``b`` for its (series_id, kind); a NULL series counts as one."""
    b = b.withColumnsRenamed({"series_id": "_s", "kind": "_k"})
    return a.join(b, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_k"))).drop("_s", "_k")


def medians(values: DataFrame) -> DataFrame:
    """The exact median ``x`` per (series_id, kind) of sorted arrays ``xs`` that together hold its values.

    POINT neighbours of an array share their least and largest value; the medians of these, weighted by
    their number, are bounds of the median sought. Only what lies between them is then counted by value."""
    keys = ["series_id", "kind"]
    sizes = values.groupBy(keys).agg(F.sum(F.size("xs")).alias("n")).select(*keys, F.expr("(n - 1) div 2").alias("k1"), F.expr("n div 2").alias("k2"))
    points = values.select(
        *keys, F.expr(f"inline(transform(sequence(0L, (size(xs) - 1) div {POINT}), i -> struct(xs[i * {POINT}] as lo, xs[least(i * {POINT} + {POINT - 1}, size(xs) - 1)] as hi, least({POINT}, size(xs) - i * {POINT}) as w)))")
    )
    along = Window.partitionBy(keys).orderBy(F.col("v").asc_nulls_first())

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("c") > F.col(rank)) & (F.col("c") - F.col("w") <= F.col(rank)), F.col("v")))

    def ranked(df: DataFrame) -> DataFrame:
        return _told(df.groupBy(*keys, "v").agg(F.sum("w").alias("w")).withColumn("c", F.sum("w").over(along)), sizes).groupBy(keys)

    low = ranked(points.withColumnRenamed("lo", "v")).agg(at("k1").alias("lo"))
    bounds = cut(_told(low, ranked(points.withColumnRenamed("hi", "v")).agg(at("k2").alias("hi"))))
    near = _told(values, bounds).select(
        *keys, F.expr("inline(concat(array(struct(cast(null as double) as v, size(filter(xs, x -> x < lo)) as w)), transform(filter(xs, x -> x >= lo and x <= hi), x -> struct(x as v, 1 as w))))")
    )  # the values below the bounds count under NULL, which comes first
    return ranked(near).agg((at("k1") * 0.5 + at("k2") * 0.5).alias("x"))


def implausible(
    bars: DataFrame, instruments: DataFrame, k_price: float = 22.0, k_volume: float = 30.0, run: int = 8, wide: int = 3, block_rows: int = 8192
) -> DataFrame:
    """One row per delivered reading: ``bar_id, p_spike, p_stuck, p_range`` and ``reason`` (NULL if plausible).

    'range': a price of 0 or less, a negative volume, high below low, or close outside low..high by more
    than a tick. 'stuck': high, low and close, or a non-zero volume, unchanged over ``run`` or more
    consecutive stamps. 'spike': a price more than ``k_price`` times the source's median move away from
    the levels before and after it, for at most ``wide`` readings, or a volume above ``k_volume`` times its
    median. NULLs, NaNs and infinities are no values: they neither are cases nor break a run. Copies of one
    stamp are judged each by its own values. A reading without a stamp is held against the range bounds
    only. Medians are exact, of all values of the source (see ``medians``); where one is 0 any other volume, and
    any price off both levels, exceeds it. A source without a move or volume has no such spikes. An unknown
    symbol has tick 0."""
    ins = instruments.select(F.col("symbol").alias("_sym"), F.col("tick_size").alias("tick"), F.col("bar_seconds").alias("_sec")).dropDuplicates(["_sym"])
    keyed = (
        bars.select("bar_id", "series_id", F.col("symbol").alias("_sym"), F.col("index_ns").cast("long").alias("index_ns"), *(clean_double(x).alias(x) for x in ("open", "high", "low", "close", "volume")))
        .join(ins, "_sym", "left")
        # sessions cover about a quarter of the clock, so this span holds about block_rows readings
        .withColumn("block", F.expr(f"index_ns div (coalesce(_sec, 60) * 1000000000L * {block_rows * 4}L)"))
        .select("bar_id", "series_id", "block", "index_ns", "open", "high", "low", "close", "volume", F.coalesce("tick", F.lit(0.0)).alias("tick"))
    )
    bounded = keyed.where("index_ns is null").select(
        "bar_id", F.lit(0.0).alias("p_spike"), F.lit(0.0).alias("p_stuck"),
        F.coalesce(_range_rule(), F.lit(False)).cast("double").alias("p_range"), F.when(_range_rule(), "range").alias("reason"),
    )
    keyed = keyed.where("index_ns is not null")
    cols = ["bar_id", "index_ns", "open", "high", "low", "close", "volume", "tick"]
    kinds = "series_id string, block bigint, kind string, x double, xs array<double>, bar_id bigint, index_ns bigint, open double, high double, low double, close double, volume double, tick double"

    def summarise(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["index_ns", "bar_id"], kind="stable")
        ok = g[g["close"].notna() & (g["close"] > 0)].drop_duplicates("index_ns")
        parts = []
        for kind, x in (("move", np.abs(np.diff(ok["close"].to_numpy(float)))), ("volume", g["volume"].dropna().to_numpy(float))):
            if len(x):
                parts.append(pd.DataFrame({"kind": [kind], "xs": [np.sort(x)]}))
        if len(ok):  # for the move from block to block
            parts.append(pd.DataFrame({"kind": ["ends"], "index_ns": ok["index_ns"].iloc[:1], "x": ok["close"].iloc[0], "close": ok["close"].iloc[-1]}))
        # all rows up to, and from, the EDGE-th reading of each kind on
        has = (g[["high", "low", "close"]].notna().all(axis=1), g["close"] > 0, g["volume"].notna())
        stamps = [np.unique(g["index_ns"][m]) for m in has]
        for kind, edge in (
            ("head", g[g["index_ns"] <= max((x[:EDGE][-1] for x in stamps if len(x)), default=-(2**63))]),
            ("tail", g[g["index_ns"] >= min((x[-EDGE:][0] for x in stamps if len(x)), default=2**63 - 1)]),
        ):
            parts.append(edge.assign(kind=kind, x=np.nan)[["kind", "x", *cols]])
        parts.append(pd.DataFrame({"kind": ["block"], "x": float(sum(1 << i for i, x in enumerate(stamps) if len(x)))}))
        out = pd.concat(parts, ignore_index=True)
        out["series_id"], out["block"] = key[0], key[1]
        out = out.reindex(columns=["series_id", "block", "kind", "x", "xs", *cols])
        out["xs"] = [x if isinstance(x, np.ndarray) else None for x in out["xs"]]
        return out

    summary = cut(keyed.groupBy("series_id", "block").applyInPandas(summarise, kinds))
    across = summary.where("kind = 'ends'").select("series_id", F.abs(F.col("x") - F.lag("close").over(Window.partitionBy("series_id").orderBy("index_ns"))).alias("x"))
    across = across.where("x is not null").select("series_id", F.lit("move").alias("kind"), F.array("x").alias("xs"))
    mid = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("x")))
    usual = medians(summary.where("kind in ('move', 'volume')").select("series_id", "kind", "xs").unionByName(across)).groupBy("series_id").agg(mid("move").alias("move"), mid("volume").alias("vol"))
    blocks = stored(summary.where("kind = 'block'").select("series_id", "block", F.col("x").cast("int").alias("has")))  # a row a block
    # the blocks nearest to each that have a kind of reading, by their number among those
    near = blocks.select("series_id", "block", F.posexplode(F.array(*(F.col("has").bitwiseAND(1 << i) > 0 for i in range(len(KINDS))))).alias("of", "there"))
    upto = Window.partitionBy("series_id", "of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("no", F.coalesce(F.sum(F.col("there").cast("long")).over(upto), F.lit(0)))
    holds = near.where("there").select(F.col("series_id").alias("_s"), "of", "no", F.col("block").alias("_from"))
    null_eq = lambda a, b: a.eqNullSafe(b)
    sides = []
    for kind, first in (("tail", F.col("no") - NEAR_BLOCKS), ("head", F.col("no") + F.col("there").cast("long"))):
        want = near.select("series_id", F.col("block").alias("_target"), F.col("of").alias("_of"), F.explode(F.sequence(first, first + NEAR_BLOCKS - 1)).alias("_no"))
        b = want.join(holds, null_eq(F.col("series_id"), F.col("_s")) & (F.col("_of") == F.col("of")) & (F.col("_no") == F.col("no")))
        b = stored(b.select(F.col("series_id").alias("_s"), "_target", "_from").distinct())
        e = summary.where(F.col("kind") == kind)
        sides.append(e.join(b, null_eq(F.col("series_id"), F.col("_s")) & (F.col("block") == F.col("_from"))).select("series_id", F.col("_target").alias("block"), "kind", *cols))
    u = usual.select(F.col("series_id").alias("_s"), "move", "vol")
    told = blocks.select("series_id", "block").join(u, null_eq(F.col("series_id"), F.col("_s")), "left").select("series_id", "block", F.lit("usual").alias("kind"), "move", "vol")
    context = told.unionByName(sides[0].unionByName(sides[1]), allowMissingColumns=True)
    out_schema = "bar_id bigint, p_spike double, p_stuck double, p_range double, reason string"

    def run_block(own: pd.DataFrame, ctx: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"bar_id": [], "p_spike": [], "p_stuck": [], "p_range": [], "reason": []})
        told = ctx[ctx["kind"] == "usual"]
        move, vol = (float(told[x].astype(float).iloc[0]) if len(told) else np.nan for x in ("move", "vol"))
        halo = ctx[ctx["kind"] != "usual"]
        own = own.assign(_own=True)
        rows = pd.concat([own, halo.assign(_own=False)[[*cols, "_own"]]], ignore_index=True) if len(halo) else own
        rows = rows.sort_values(["index_ns", "bar_id"], kind="stable", ignore_index=True)
        more = bool((halo["index_ns"] < own["index_ns"].min()).any()), bool((halo["index_ns"] > own["index_ns"].max()).any())
        res = judge(rows, move, vol, float(own["tick"].iloc[0]), k_price, k_volume, run, wide, more)
        res = res[rows["_own"].to_numpy(bool)]
        return res.assign(bar_id=res["bar_id"].astype("int64"))

    judged = keyed.groupBy("series_id", "block").cogroup(context.groupBy("series_id", "block")).applyInPandas(run_block, out_schema)
    return judged.unionByName(bounded)


def _range_rule():
    return F.expr("least(open, high, low, close) <= 0 or volume < 0 or high < low or close > high + tick * 1.000001 or close < low - tick * 1.000001")
