import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalbars.operators import spikes

SCHEMA = "bar_id long, series_id string, symbol string, index_ns long, open double, high double, low double, close double, volume double, note string, tick_size string"
INS = "symbol string, bar_seconds long, tick_size double, close string"
STEP = 300_000_000_000


def rows(n=400, seed=1):
    r = np.random.default_rng(seed)
    c = 100 + np.cumsum(r.choice([-1, 1], n) * r.integers(1, 3, n) * 0.01)
    return [[i, "S", "A", i * STEP, float(x), round(float(x) + 0.02, 6), round(float(x) - 0.02, 6), round(float(x), 6), float(500 + r.integers(0, 300)), "x", "clash"] for i, x in enumerate(c)]


def run(spark, data, **k):
    ins = spark.createDataFrame([("A", 300, 0.01, "clash")], INS)
    out = spikes.implausible(spark.createDataFrame([tuple(x) for x in data], SCHEMA), ins, **k).collect()
    assert len(out) == len(data)
    return {r.bar_id: r.reason for r in out if r.reason}


def test_clean_series_has_no_flags(spark):
    assert run(spark, rows()) == {}


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_kinds(spark, block_rows):
    d = rows()
    d[50][7] += 5.0  # a close far off and outside its bar
    for i in (90, 91, 92):  # three readings at ten times the level
        for k in (4, 5, 6, 7):
            d[i][k] *= 10
    d[130][5] += 4.0  # a high alone
    for i in range(160, 168):  # eight equal bars
        d[i][4:8] = d[160][4:8]
    for i in range(200, 209):
        d[i][8] = 777.0
    d[240][8] = 60_000.0
    d[260][6] = 0.0
    d[270][8] = -1.0
    got = run(spark, d, block_rows=block_rows)
    want = {50: "range", 130: "spike", 240: "spike", 260: "range", 270: "range"} | dict.fromkeys((90, 91, 92), "spike") | dict.fromkeys(range(160, 168), "stuck") | dict.fromkeys(range(200, 209), "stuck")
    assert got == want


def test_a_source_frozen_for_half_its_block(spark):
    d = rows()
    for i in range(100, 300):
        d[i][4:8] = [d[100][7]] * 4
    assert run(spark, d) == dict.fromkeys(range(100, 300), "stuck")


def test_stuck_volumes_among_few_distinct_ones(spark):
    d = rows()
    for i in range(400):
        d[i][8] = (1.0, 1.0, 2.0, 2.0, 3.0)[i % 5]
    for i in range(200, 208):
        d[i][8] = 2.0
    d[199][8], d[208][8] = 3.0, 1.0
    assert run(spark, d) == dict.fromkeys(range(200, 208), "stuck")


def test_level_changes_short_runs_and_nulls_are_no_cases(spark):
    d = rows()
    for i in range(100, 400):  # a lasting change of level
        for k in (4, 5, 6, 7):
            d[i][k] += 10
    for i in range(200, 205):  # a plateau of five readings
        for k in (4, 5, 6, 7):
            d[i][k] += 3
    for i in range(300, 307):  # seven equal bars
        d[i][4:8] = d[300][4:8]
    for i in range(350, 365):  # zero volume is no stuck volume
        d[i][8] = 0.0
    for i in range(20, 30):
        d[i][5:9] = [None, None, None, float("nan")]
    assert run(spark, d) == {}


def test_copies_are_judged_by_their_own_values(spark):
    d = rows()
    bad = list(d[150])
    bad[0] = 1000
    for k in (4, 5, 6, 7):
        bad[k] *= 10
    for i in range(200, 208):
        d[i][4:8] = d[200][4:8]
    other = list(d[203])
    other[0] = 1001
    other[7] += 0.01  # another value for a stamp inside the run: the run itself goes on
    got = run(spark, [*d, bad, other])
    assert got == {1000: "spike"} | dict.fromkeys(range(200, 208), "stuck")


def test_few_readings(spark):
    d = rows(15)
    for k in (4, 5, 6, 7):
        d[7][k] *= 10
    d[11][8] = 60_000.0
    assert run(spark, d) == {7: "spike", 11: "spike"}


def test_medians_of_zero(spark):
    d = rows(60)
    for i in range(60):  # prices that move every fifth reading, and volumes that are mostly 0
        d[i][4:9] = [100.0 + i // 5] * 4 + [0.0]
    d[30][8] = 5.0
    d[42][5] += 0.01
    assert run(spark, d) == {30: "spike", 42: "spike"}


@pytest.mark.parametrize("block_rows", [8192, 8])
def test_small_sources_as_in_sql(spark, block_rows):
    import duckdb

    from causalbars.plans.data_queries import P1_SQL

    r = np.random.default_rng(7)
    d = []
    for s in range(40):
        part = rows(int(r.integers(1, 70)), seed=s)
        for x in part:
            x[0], x[1] = len(d), f"S{s}"
            if s % 3 == 0:
                x[8] = float(r.choice([0, 0, 0, 1, 40]))
            elif r.random() < 0.03:
                x[8] *= 100
            if r.random() < 0.04:
                x[5] += float(r.choice([0.1, 0.3, 2, 50]))
            elif r.random() < 0.03:
                x[4:8] = [y * 3 for y in x[4:8]]
            d.append(x)
    bars = spark.createDataFrame([tuple(x) for x in d], SCHEMA).toPandas()  # noqa: F841
    instruments = spark.createDataFrame([("A", 300, 0.01, "clash")], INS).drop("close").toPandas()  # noqa: F841
    bars = bars.drop(columns="tick_size")
    want = {x[0] for x in duckdb.sql(P1_SQL).fetchall()}
    assert set(run(spark, d, block_rows=block_rows)) == want and len(want) > 50


def test_medians_are_exact(spark):
    r = np.random.default_rng(3)
    parts = [(k, kind, np.sort(np.round(r.normal(size=n), 1 if k == "b" else 9)).tolist()) for k in ("a", "b", None) for kind in ("move", "volume") for n in (1, 17, 48, 300, 33)]
    parts += [("one", "move", [2.0]), ("two", "move", [1.0, 4.0])]
    got = {(x.series_id, x.kind): x.x for x in spikes.medians(spark.createDataFrame(parts, "series_id string, kind string, xs array<double>")).collect()}
    want = {}
    for k, kind, x in parts:
        want.setdefault((k, kind), []).extend(x)
    assert got == pytest.approx({k: np.median(x) for k, x in want.items()}, abs=0)


def test_odd_rows(spark):
    d = rows(30)
    d[3][3] = None  # no stamp: only bounds can be told
    d[4][3] = None
    d[4][5], d[4][6] = 1.0, 2.0
    d[5][1] = None  # no series
    d[6][2] = "unknown"
    got = run(spark, d)
    assert got == {4: "range"}
    ins = spark.createDataFrame([("A", 300, 0.01, "clash")], INS)
    assert spikes.implausible(spark.createDataFrame([], SCHEMA), ins).count() == 0


def test_forward_backward_is_exact():
    """Against the sum over all paths."""
    r = np.random.default_rng(0)
    lik = r.random((1, 4, 4)) + 0.01
    p = spikes.forward_backward(lik)[0]
    want = np.zeros((4, 4))
    for path in np.ndindex(4, 4, 4, 4):
        w = spikes.START[path[0]] * lik[0, 0, path[0]]
        for t in range(1, 4):
            w *= spikes.TRANSITIONS[path[t - 1], path[t]] * lik[0, t, path[t]]
        for t in range(4):
            want[t, path[t]] += w
    assert np.allclose(p, want / want.sum(1, keepdims=True))


def test_chunks_change_nothing_that_matters():
    r = np.random.default_rng(0)
    lik = r.random((1000, 4)) + 0.05
    assert np.abs(spikes.posterior(lik) - spikes.forward_backward(lik[None])[0])[40:].max() < 5e-3  # the first rows feel the start; likelihoods this flat are the worst case


def test_hot_series_is_spread(spark):
    ins = spark.createDataFrame([("A", 300, 0.01, "clash")], INS)
    df = spikes.implausible(spark.createDataFrame([tuple(x) for x in rows(2000)], SCHEMA), ins, block_rows=64)
    assert df.where(F.col("reason").isNotNull()).count() == 0


def test_the_states_decide(spark, monkeypatch):
    """Other posteriors give other rows: nothing but the hard bounds stands without them."""
    n = 60
    c = 100 + np.cumsum(np.random.default_rng(3).choice([-0.5, 0.5], n))
    c[20] += 400
    rows = pd.DataFrame({"bar_id": np.arange(n), "index_ns": np.arange(n) * 60, "open": c, "high": c + 0.25, "low": c - 0.25, "close": c, "volume": 10.0 + np.arange(n) % 7})
    rows.loc[30:39, ["open", "high", "low", "close"]] = [c[30], c[30] + 0.25, c[30] - 0.25, c[30]]
    rows.loc[50, "volume"] = 5000.0
    rows.loc[55, "low"] = -1.0
    judge = lambda: {int(i): r for i, r in zip(*(spikes.judge(rows, 0.5, 13.0, 0.25, 22.0, 30.0, 8, 3)[x] for x in ("bar_id", "reason"))) if r}
    assert judge() == {20: "spike", **{i: "stuck" for i in range(30, 40)}, 50: "spike", 55: "range"}
    monkeypatch.setattr(spikes, "posterior", lambda lik: np.tile([1.0, 0, 0, 0], (len(lik), 1)))
    assert judge() == {55: "range"}
    monkeypatch.setattr(spikes, "posterior", lambda lik: np.tile([0.1, 0.3, 0.3, 0.3], (len(lik), 1)))
    assert len(judge()) == n


def test_a_run_over_blocks_without_readings(spark):
    """Eight equal readings, each in a block of its own, with ten blocks of NULLs between any two."""
    rows = []
    for i in range(30):
        p = 100.0 if 10 <= i < 18 else 100.0 + i
        for k in range(11):
            ns = (i * 11 + k) * 4 * 60 * 10**9
            rows.append((i * 11 + k, "s", "X", ns, *([p, p + 1, p - 1, p, 5.0 + i] if k == 0 else [None] * 5)))
    df = spark.createDataFrame(rows, "bar_id long, series_id string, symbol string, index_ns long, open double, high double, low double, close double, volume double")
    ins = spark.createDataFrame([("X", 0.25, 60)], "symbol string, tick_size double, bar_seconds long")
    got = spikes.implausible(df, ins, block_rows=1).where("reason = 'stuck'").collect()
    assert sorted(r.bar_id for r in got) == [i * 11 for i in range(10, 18)]
