"""Percentiles per group over very large columns by distributed multi-select.

Values stay where they are, as sorted blocks. Per round every partition proposes the weighted median of
what it still holds of each target's open range; the weighted median of the proposals is the pivot; the
blocks are counted three ways around it by binary search; one side of the range is ruled out. All
(group, percentile) targets go through a round together; a round moves a few numbers per partition
and target, never values. Ranges of at most FINISH values are gathered and settled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.runtime import cut, stored

BLOCK = 65_536
BUFFER = 1_000_000  # values a task holds while it builds blocks
FINISH = 4096  # values of a target that are settled at once; a task gets its share of all targets
MAX_ROUNDS = 500
MAX_BROADCAST_TARGETS = 200_000  # rows of about 50 bytes


def blocks(values: DataFrame, keys: list[str], value: str = "value", eps: float = 0.0) -> DataFrame:
    """Rows of keys, ``vals`` (sorted) and ``cum`` (running weights), of at most BLOCK values each.

    With ``eps`` > 0 a block keeps one value of every s = 2 * eps * size, at the middle of its s ranks and
    with their weight, so the rank error is at most eps of the values summed up - within a block, hence
    over any union of blocks, be they of partitions, files or days. NULLs and values that are not finite are
    left out."""
    src = values.select(*keys, F.col(value).cast("double").alias("_v")).where(F.abs("_v") < float("inf"))
    schema = ", ".join(f"{c} {t}" for c, t in src.drop("_v").dtypes) + ", vals array<double>, cum array<bigint>"

    def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
        df = pd.concat(parts, ignore_index=True)
        out = []
        for key, g in df.groupby(keys, dropna=False, sort=False):
            x = np.sort(g["_v"].to_numpy(float))
            for a in range(0, len(x), BLOCK):
                y = x[a : a + BLOCK]
                s = max(1, int(2 * eps * len(y)))
                ends = np.minimum(np.arange(s, len(y) + s, s), len(y))
                mids = (np.r_[0, ends[:-1]] + ends - 1) // 2
                out.append((*key, y[mids], ends.astype(np.int64)))
        return pd.DataFrame(out, columns=[*keys, "vals", "cum"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += len(b)
            if n >= BUFFER:
                yield flush(parts)
                parts, n = [], 0
        if n:
            yield flush(parts)

    return src.mapInPandas(run, schema)


def _weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    o = np.argsort(v, kind="stable")
    c = np.cumsum(w[o])
    return float(v[o][np.searchsorted(c, c[-1] / 2)])


def select_ranks(held: DataFrame, keys: list[str], qs: list[float], eps: float = 0.0) -> DataFrame:
    """``keys, q, n, value``: the value of rank max(1, ceil(q * n)) of each group, n its total weight.

    ``eps``: a target is settled by any pivot once its open range holds at most eps * n values. A group
    with only one value, or ties all over, ends in a round; no values, no row."""
    held = cut(held)
    g = [f"_k{i}" for i in range(len(keys))]
    held = held.select(*(F.col(k).alias(x) for k, x in zip(keys, g)), "vals", "cum")
    sized = held.groupBy(*g).agg(F.sum(F.element_at("cum", -1)).alias("n"))
    qarr = F.array(*(F.lit(float(q)) for q in qs))
    # open range (lo, hi); below: values at or under lo; active: values in the range; pivot NULL: none yet
    state = stored(
        sized.withColumn("q", F.explode(qarr))
        .withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long"))
        .withColumn("t", F.xxhash64(*g, "q"))
        .select(*g, "q", "n", "k", "t", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("active"), F.lit(None).cast("double").alias("pivot"), F.lit(None).cast("double").alias("value"))
    )
    small = state.count() <= MAX_BROADCAST_TARGETS

    def at_blocks(todo: DataFrame, cols: list[str]) -> DataFrame:
        lists = todo.groupBy(*g).agg(F.collect_list(F.struct(*cols)).alias("todo"))  # at most len(qs) a group
        cond = [held[x].eqNullSafe(lists[x]) for x in g]
        return held.join(F.broadcast(lists) if small else lists, cond).select("vals", "cum", "todo")

    for _ in range(MAX_ROUNDS):
        open_ = state.where("value is null")
        left = open_.where(F.col("active") > F.greatest(F.lit(FINISH), F.lit(eps) * F.col("n")))
        if left.isEmpty():
            break
        seen = at_blocks(left, ["t", "lo", "hi", "pivot"]).mapInPandas(_propose, "t bigint, lt bigint, eq bigint, gt bigint, m_lt double, m_gt double")
        # the weighted median of at most one proposal a partition and side
        told = seen.groupBy("t").agg(*(F.sum(x).alias(x) for x in ("lt", "eq", "gt")), *(F.percentile(f"m_{x}", 0.5, F.col(x)).alias(f"m_{x}") for x in ("lt", "gt")))
        j = state.join(told, "t", "left")
        first = F.col("pivot").isNull()
        has = F.col("lt").isNotNull()
        down = has & ~first & (F.col("k") <= F.col("below") + F.col("lt"))
        hit = has & ~first & ~down & (F.col("k") <= F.col("below") + F.col("lt") + F.col("eq"))
        up = has & ~first & ~down & ~hit
        state = stored(
            j.select(
                *g, "q", "n", "k", "t",
                F.when(up, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
                F.when(down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
                F.when(up, F.col("below") + F.col("lt") + F.col("eq")).otherwise(F.col("below")).alias("below"),
                F.when(down, F.col("lt")).when(up, F.col("gt")).otherwise(F.col("active")).alias("active"),
                F.when(down, F.col("m_lt")).when(up | (has & first), F.col("m_gt")).otherwise(F.col("pivot")).alias("pivot"),
                F.coalesce("value", F.when(hit, F.col("pivot"))).alias("value"),
            )
        )
    else:
        raise RuntimeError("the selection did not end")
    near = state.where((F.col("value").isNull()) & F.lit(eps > 0) & (F.col("active") <= F.lit(eps) * F.col("n")) & F.col("pivot").isNotNull())
    rest = state.where("value is null").join(near.select("t"), "t", "left_anti")
    last = at_blocks(rest, ["t", "lo", "hi", "below", "k"]).mapInPandas(_gather, "t bigint, r bigint, v array<double>, w array<bigint>")
    settled = last.repartition("t").mapInPandas(_settle, "t bigint, last double")
    out = state.join(settled, "t", "left").select(*(F.col(x).alias(k) for k, x in zip(keys, g)), "q", "n", F.coalesce("value", "last", "pivot").alias("value"))
    return out


def _range(vals: np.ndarray, lo: float, hi: float) -> tuple[int, int]:
    return int(np.searchsorted(vals, lo, "right")), int(np.searchsorted(vals, hi, "left"))


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition and target: counts around the pivot and the weighted medians of both sides."""
    count: dict[int, list[int]] = {}
    med: dict[int, tuple[list, list, list, list]] = {}

    def part(vals: np.ndarray, cum: np.ndarray, i: int, j: int) -> tuple[int, float]:
        if i >= j:
            return 0, 0.0
        base = cum[i - 1] if i else 0
        w = cum[j - 1] - base
        return int(w), float(vals[min(j - 1, int(np.searchsorted(cum, base + (w + 1) // 2)))])

    for b in batches:
        for vals, cum, todo in zip(b["vals"], b["cum"], b["todo"]):
            for x in todo:
                t, lo, hi, p = x["t"], x["lo"], x["hi"], x["pivot"]
                i, j = _range(vals, lo, hi)
                if p is None or np.isnan(p):
                    a0, a1 = i, i
                else:
                    a0, a1 = int(np.searchsorted(vals, p, "left")), int(np.searchsorted(vals, p, "right"))
                lt, ml = part(vals, cum, i, a0)
                eq, _ = part(vals, cum, a0, a1)
                gt, mg = part(vals, cum, a1, j)
                c, m = count.setdefault(t, [0, 0, 0]), med.setdefault(t, ([], [], [], []))
                c[0] += lt
                c[1] += eq
                c[2] += gt
                if lt:
                    m[0].append(ml)
                    m[1].append(lt)
                if gt:
                    m[2].append(mg)
                    m[3].append(gt)
    rows = [(t, *c, _weighted_median(np.array(m[0]), np.array(m[1])) if m[0] else None, _weighted_median(np.array(m[2]), np.array(m[3])) if m[2] else None) for t, c in count.items() for m in [med[t]]]
    yield pd.DataFrame(rows, columns=["t", "lt", "eq", "gt", "m_lt", "m_gt"]).astype({"m_lt": float, "m_gt": float})


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for vals, cum, todo in zip(b["vals"], b["cum"], b["todo"]):
            w = np.diff(np.r_[0, cum])
            for x in todo:
                i, j = _range(vals, x["lo"], x["hi"])
                if i < j:
                    out.append((x["t"], x["k"] - x["below"], vals[i:j], w[i:j]))
        yield pd.DataFrame(out, columns=["t", "r", "v", "w"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The value of rank r among the values of each target, all of which are in one partition."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    df = pd.concat(parts, ignore_index=True)
    t = np.repeat(df["t"].to_numpy(), df["v"].map(len).to_numpy())
    r = np.repeat(df["r"].to_numpy(), df["v"].map(len).to_numpy())
    v, w = np.concatenate(df["v"].to_list()), np.concatenate(df["w"].to_list())
    o = np.lexsort((v, t))
    t, r, v, c = t[o], r[o], v[o], np.cumsum(w[o])
    head = np.r_[True, t[1:] != t[:-1]]
    before = np.repeat((c - w[o])[head], np.diff(np.r_[np.flatnonzero(head), len(t)]))
    reached = np.flatnonzero(c - before >= r)
    first = reached[np.r_[True, t[reached][1:] != t[reached][:-1]]] if len(reached) else reached
    yield pd.DataFrame({"t": t[first], "last": v[first]})


def merge(summaries: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """Summaries put together per ``keys`` and thinned: one block per group that keeps a value of every 2 * eps * size.

    The rank error of the result is at most that of the summaries plus ``eps``. A group's blocks meet in one task, so a
    group is what can be told from summaries of bounded size: a month, not all time."""
    types = dict(summaries.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", vals array<double>, cum array<bigint>"

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate(g["vals"].to_list())
        w = np.concatenate([np.diff(np.r_[0, c]) for c in g["cum"]])
        o = np.argsort(v, kind="stable")
        v, c = v[o], np.cumsum(w[o])
        s = max(1, int(2 * eps * c[-1]))
        ends = np.minimum(np.arange(s, c[-1] + s, s), c[-1])
        mids = (np.r_[0, ends[:-1]] + ends + 1) // 2  # ranks from 1
        at = np.searchsorted(c, mids)
        last = np.r_[at[1:] != at[:-1], True]  # one value for several steps goes once
        return pd.DataFrame([(*key, v[at[last]], ends[last].astype(np.int64))], columns=[*keys, "vals", "cum"])

    return summaries.groupBy(*keys).applyInPandas(run, schema)


def path_values(paths: DataFrame) -> DataFrame:
    """Long form ``symbol, h, event_day, field, value`` of the eligible path rows, each (event_id, h) once.

    Of copies that differ the largest values count; the symbol and day of an event are its own."""
    one = paths.where("elig").groupBy("event_id", "h", "symbol", "event_day").agg(*(F.max(c).alias(c) for c in ("mfe_pts", "mae_pts", "t_mfe")))  # fixed widths: no sort
    return one.select(
        "symbol", "h", "event_day", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in ("mfe_pts", "mae_pts", "t_mfe"))))
    ).where("value is not null")


QS = [0.05, 0.25, 0.5, 0.75, 0.95]


def path_percentiles(paths: DataFrame, qs: list[float] = QS) -> DataFrame:
    """Exact percentiles of the excursion fields per symbol and horizon."""
    keys = ["symbol", "h", "field"]
    return select_ranks(blocks(path_values(paths), keys), keys, qs)


def day_summaries(paths: DataFrame, eps: float = 0.0025) -> DataFrame:
    """What a day's run keeps: per (day, symbol, h, field) blocks from which percentiles come out within
    ``eps`` of the rank. Summaries of any days, files or clusters can be put together with ``union``."""
    return blocks(path_values(paths), ["event_day", "symbol", "h", "field"], eps=eps)


def month_summaries(days: DataFrame, eps: float = 0.0025) -> DataFrame:
    """Day summaries merged per month: what is kept once the days are over."""
    month = F.trunc("event_day", "month")
    return merge(days.withColumn("month", month).drop("event_day"), ["month", "symbol", "h", "field"], eps)


def combine(summaries: DataFrame, qs: list[float] = QS) -> DataFrame:
    """Percentiles per symbol and horizon over all the days or months in ``summaries``."""
    keys = ["symbol", "h", "field"]
    return select_ranks(summaries.select(*keys, "vals", "cum"), keys, qs)


def within(paths: DataFrame, told: DataFrame, eps: float) -> DataFrame:
    """``symbol, h, field, q, n, within``: whether each told percentile stands within ``eps * n`` ranks of the right one.

    The ranks of a value are counted over all values: those below it and those not above it."""
    keys = ["symbol", "h", "field"]
    v = path_values(paths).select(*keys, F.col("value").alias("v"))
    t = told.groupBy(*keys).agg(F.collect_list(F.struct("q", "n", "value")).alias("told"))  # a few percentiles
    each = v.join(t, keys).select(*keys, "v", F.inline("told"))
    c = each.groupBy(*keys, "q", "n").agg(F.count(F.when(F.col("v") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto"))
    k = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    ok = (k >= F.col("below") + 1 - F.lit(eps) * F.col("n")) & (k <= F.col("upto") + F.lit(eps) * F.col("n"))
    return c.select(*keys, "q", "n", ok.alias("within"))
