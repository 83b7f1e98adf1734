import math

import numpy as np
import pytest

from causalbars.llm import percentiles as p

KEYS = ["g", "f"]


def frame(spark, groups):
    rows = [(g, f, float(v) if v is not None else None, "clash") for (g, f), vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, f string, value double, q string").repartition(5)


def exact(vs, q):
    x = sorted(v for v in vs if v is not None and math.isfinite(v))
    return x[max(1, math.ceil(q * len(x))) - 1]


def groups():
    r = np.random.default_rng(3)
    return {
        ("a", "x"): r.standard_cauchy(5000).tolist(), ("a", "y"): [7.0] * 3000, ("b", "x"): [None, 1.0], (None, "x"): [3.0, 1.0, 2.0],
        ("c", "x"): r.integers(0, 5, 4000).tolist(), ("d", "x"): [None, float("nan")], ("e", "x"): [float("inf"), float("-inf"), 0.5],
    }


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(p, "FINISH", 20)
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]
    g = groups()
    got = {(r.g, r.f, r.q): (r.value, r.n) for r in p.select_ranks(p.blocks(frame(spark, g), KEYS), KEYS, qs).collect()}
    want = {(a, b, q): exact(v, q) for (a, b), v in g.items() if a != "d" for q in qs}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[("a", "x", 0.5)][1] == 5000 and got[("b", "x", 0.5)][1] == 1


@pytest.mark.parametrize("eps", [0.02, 0.1])
def test_summaries_combine_within_their_error(spark, eps):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=3000), r.lognormal(size=4000), np.zeros(500)])
    days = [spark.createDataFrame([("a", "x", float(t)) for t in part], "g string, f string, value double") for part in np.array_split(v, 3)]
    held = [p.blocks(d.repartition(2), KEYS, eps=eps) for d in days]
    union = held[0].unionByName(held[1]).unionByName(held[2])
    s = np.sort(v)
    for row in p.select_ranks(union, KEYS, [0.05, 0.5, 0.95]).collect():
        lo, hi = np.searchsorted(s, row.value, "left") + 1, np.searchsorted(s, row.value, "right")
        k = math.ceil(row.q * len(s))
        assert row.n == len(s) and max(lo - k, k - hi, 0) <= eps * len(s) + 1
    assert sum(len(x.vals) for x in union.collect()) < len(v) / (2 * eps * len(v)) * 8


def test_empty(spark):
    assert p.select_ranks(p.blocks(frame(spark, {}), KEYS), KEYS, [0.5]).count() == 0


def test_paths(spark):
    rows = [("e1", "S", 5, True, 1.0, -1.0, 2), ("e1", "S", 5, True, 1.0, -1.0, 2), ("e2", "S", 5, False, 9.0, None, 1 << 30), ("e3", "S", 5, True, None, -3.0, 4), ("e4", "S", 5, None, 5.0, -3.0, 4)]
    df = spark.createDataFrame([(*r[:4], None, *r[4:], "clash") for r in rows], "event_id string, symbol string, h int, elig boolean, event_day date, mfe_pts double, mae_pts double, t_mfe int, value string")
    got = {(r.field, r.q): (r.value, r.n) for r in p.path_percentiles(df, [0.5]).collect()}
    assert got == {("mfe_pts", 0.5): (1.0, 1), ("mae_pts", 0.5): (-3.0, 2), ("t_mfe", 0.5): (2.0, 2)}


def test_merged_summaries_are_small_and_within_their_error(spark):
    r = np.random.default_rng(9)
    parts = [r.lognormal(size=int(n)) for n in r.integers(1, 120, 200)] + [np.full(500, 2.0)]
    df = spark.createDataFrame([(f"d{i}", "a", float(v)) for i, x in enumerate(parts) for v in x], "day string, g string, value double")
    days = p.blocks(df, ["day", "g"], eps=0.01)
    merged = p.merge(days.drop("day"), ["g"], 0.02)
    (row,) = merged.collect()
    s = np.sort(np.concatenate(parts))
    assert len(row.vals) <= 26 and row.cum[-1] == len(s) and list(row.vals) == sorted(row.vals)
    for got in p.select_ranks(merged, ["g"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        lo, hi = np.searchsorted(s, got.value, "left") + 1, np.searchsorted(s, got.value, "right")
        k = max(1, math.ceil(got.q * len(s)))
        assert max(lo - k, k - hi, 0) <= 0.03 * len(s) + 1
