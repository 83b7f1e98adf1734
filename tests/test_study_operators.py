"""Small hand-made cases of the event-study operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causalbars.operators import crossval, events, features, models, pathstats, positions, ranks, stats, targets
from causalbars.sources import bars as bar_source

DAY = 86_400_000_000_000
STEP = 60_000_000_000


def test_cooldown_folds_in_order(spark):
    df = spark.createDataFrame([("S", t * STEP, 5 * STEP) for t in (1, 3, 5, 9, 10, 20)], "series_id string, event_ns long, gap long")
    got = events.cooldown(df, ["series_id"], "event_ns", F.col("gap"))
    assert sorted(r.event_ns // STEP for r in got.collect()) == [1, 9, 20]


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_against_a_loop(spark, seed):
    r = random.Random(seed)
    ts = sorted({r.randrange(0, 6 * DAY, STEP) for _ in range(400)})
    gap = r.choice([STEP * 20, STEP * 400, DAY * 2])
    want, last = [], None
    for t in ts:
        if last is None or t >= last + gap:
            want.append(t)
            last = t
    df = spark.createDataFrame([("S", t, gap) for t in ts], "series_id string, event_ns long, gap long")
    assert sorted(x.event_ns for x in events.cooldown(df, ["series_id"], "event_ns", F.col("gap")).collect()) == want


def test_ranks_over_buckets(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(100), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, i long")
    got = {(x.g, x.i): (x.rank, x.n) for x in ranks.ranked(df, ["g"], ["x", "i"], F.expr("x div 7"), "rank", "n").collect()}
    for g in ("a", "b", None):
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[(g, i)] for _, i in own] == [(k, len(own)) for k in range(len(own))]


@pytest.mark.parametrize("n", [5, 6, 7, 12, 13, 100])
def test_array_split_starts(spark, n):
    got = spark.range(1).select(*ranks.array_split_starts(F.lit(n), 6)).first()
    assert list(got) == [int(a[0]) if len(a) else n for a in np.array_split(np.arange(n), 6)]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("c", f"t{i}", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "c string, t string, p double")
    got = {r.t: (r.q, r.bonferroni) for r in stats.benjamini_hochberg(df, ["c"], "p", "t").collect()}
    assert [round(got[f"t{i}"][0], 4) for i in range(4)] == [0.04, 0.0533, 0.0533, 0.5]
    assert [round(got[f"t{i}"][1], 4) for i in range(4)] == [0.04, 0.16, 0.12, 1.0]


def bars(spark, n=700, seed=3, gap=None):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.001, n)))
    o = np.r_[c[0], c[:-1]]
    h, lo = np.maximum(o, c) * 1.0005, np.minimum(o, c) * 0.9995
    t0 = 1_578_320_940_000_000_000 // STEP * STEP
    rows = [("S", "A", t0 + i * STEP + (DAY if gap and i >= gap else 0), *map(float, (o[i], h[i], lo[i], c[i], 100 + i % 7)), "UTC", 0, 1439, 1439, 1080, STEP, 0.01) for i in range(n)]
    schema = "series_id string, symbol string, ts long, open double, high double, low double, close double, volume double, tz string, rth_from long, rth_to long, rth_minutes long, eth_from long, step_ns long, tick double"
    return spark.createDataFrame(rows, schema), rows


def test_positions_and_lookups(spark):
    df, rows = bars(spark, 3000)
    p = positions.with_positions(df)
    assert [r.pos for r in p.orderBy("ts").collect()] == list(range(3000))
    t = [r[2] for r in rows]
    ev = [("a", t[0]), ("b", t[0] + STEP), ("c", t[1500] + STEP // 2), ("d", t[-1] + STEP), ("e", t[-1] + 40 * DAY), ("f", t[0] - 40 * DAY)]
    e = spark.createDataFrame([(i, "X", "S", at, 1) for i, at in ev], "event_id string, experiment_id string, series_id string, event_ns long, direction int")
    got = {r.event_id: (r.pos_t, r.pos_fwd) for r in positions.locate(e, df).collect()}
    want = {i: (int(np.searchsorted(np.array(t) + STEP, at, "right")) - 1, int(np.searchsorted(t, at, "left"))) for i, at in ev}
    assert got == want


def test_features_do_not_depend_on_chunks(spark, monkeypatch):
    df, rows = bars(spark)
    p = positions.with_positions(df)
    whole = {r.pos: r for r in features.bar_features(p).collect()}
    monkeypatch.setattr(features, "CHUNK", 530)
    cut = {r.pos: r for r in features.bar_features(p).collect()}
    assert whole.keys() == cut.keys()
    for i in whole:
        for n in whole[i].__fields__[2:]:
            a, b = whole[i][n], cut[i][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (i, n)
    c = np.array([r[6] for r in rows])
    assert whole[10]["RET_5"] == pytest.approx(math.log(c[10] / c[5])) and whole[4]["RET_5"] is None
    assert len(features.NAMES) == len(set(features.NAMES)) == 56


def test_flat_prices_are_undefined_ratios(spark):
    x = np.full(600, 5.0)
    f = features.window_features(x, x, x, x, np.zeros(600), set(features.NAMES))
    for n in ("ER_15", "BROWNIAN_DISP_15", "VR_60_2", "HURST_120", "BODY_BALANCE_15", "SIGNED_VOLUME_15"):
        assert np.isnan(f[n]).all(), n
    assert f["RANGE_POS_15"][20] == 0.5 and f["COUNT_BALANCE_15"][20] == 0 and f["RV_5"][20] == 0


def located(spark, df, at, direction=1):
    e = spark.createDataFrame([(f"e{i}", "X", "S", t, direction) for i, t in enumerate(at)], "event_id string, experiment_id string, series_id string, event_ns long, direction int")
    return targets.with_close(positions.locate(e, df))


@pytest.mark.parametrize("direction", [1, -1])
def test_targets_and_paths_by_hand(spark, direction):
    df, rows = bars(spark)
    p = positions.with_positions(df)
    k = 200
    e = located(spark, df, [rows[k][2]], direction).withColumn("sigma", F.lit(0.001))
    t = {r.target_name: r for r in targets.primary_targets(e, p).collect()}
    o, h, lo, c = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 6))
    assert t["DIR_RETURN_15"].value == pytest.approx(direction * math.log(c[k + 14] / o[k]))
    up, dn = np.log(h[k : k + 60] / o[k]).max(), np.log(lo[k : k + 60] / o[k]).min()
    assert t["DIR_PATH_SKEW_60"].value == pytest.approx(up + dn if direction > 0 else -dn - up)
    r = targets.paths(e, p).first()
    fav = h[k : k + 30] - o[k] if direction > 0 else o[k] - lo[k : k + 30]
    assert r.elig_30 and r.mfe_30 == pytest.approx(fav.max()) and r.t_mfe_30 == fav.argmax() + 1
    lf = np.log(h[k : k + 120] / o[k]) if direction > 0 else -np.log(lo[k : k + 120] / o[k])
    hit = np.flatnonzero(lf >= 0.0015)
    assert r["t_fav_1.5"] == (hit[0] + 1 if len(hit) else None)


def test_windows_that_run_over_the_close(spark):
    df, rows = bars(spark, 700, gap=300)
    p = positions.with_positions(df)
    e = located(spark, df, [rows[295][2]])
    t = targets.primary_targets(e, p)
    assert {r.target_name: r.crosses_session for r in t.collect()}["DIR_RETURN_60"]
    with pytest.raises(targets.TargetSessionError):
        targets.inside_session(t, strict=True)
    assert not targets.paths(e, p).first().elig_15


def test_outcome_codes(spark):
    rows = [(3, 5, 10), (5, 3, 10), (4, 4, 10), (11, None, 10), (None, 10, 10)]
    df = spark.createDataFrame(rows, "a int, b int, h int").select(pathstats.outcome(F.col("a"), F.col("b"), F.col("h")).alias("c"))
    assert [r.c for r in df.collect()] == [1, 2, 3, 0, 2]


def test_blocks_follow_array_split(spark):
    r = random.Random(4)
    ts = sorted(r.randrange(0, 90 * DAY) for _ in range(103))
    df = spark.createDataFrame([("s", t, "America/New_York") for t in ts], "s string, event_ns long, tz string")
    got = crossval.blocks(df, 6, ["s"]).orderBy("block").collect()
    import pandas as pd

    want = [None]
    for g in np.array_split(np.arange(103), 6)[1:]:
        local = pd.Timestamp(ts[g[0]], tz="UTC").tz_convert("America/New_York")
        want.append(pd.Timestamp(local.date(), tz="America/New_York").value)
    assert [b.lo for b in got] == want and [b.hi for b in got] == [*want[1:], None]
    assert crossval.blocks(df.limit(5), 6, ["s"]).count() == 0


def test_models_learn_and_agree_with_closed_form():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    day = r.integers(0, 5, 600)
    x = np.c_[x, day]
    y = 0.5 * x[:, 0] + np.where(x[:, 1] > 0, 1.0, -1.0) + 0.1 * r.normal(size=600)
    for name in models.NAMES:
        m = models.make(name, 4).fit(x[:400], y[:400])
        assert np.corrcoef(m.predict(x[400:]), y[400:])[0, 1] > 0.7, name
        assert m.importance().shape == (5,) and m.importance()[:2].sum() > m.importance()[2:4].sum()
    m = models.Ridge(4).fit(x, y)
    z = np.c_[(x[:, :4] - x[:, :4].mean(0)) / x[:, :4].std(0), models.one_hot(day)]
    a = np.c_[z, np.ones(600)]
    pen = np.diag([10.0] * 11 + [0.0])
    w = np.linalg.solve(a.T @ a + pen, a.T @ ((y - y.mean()) / y.std()))
    assert np.allclose(m.predict(x), a @ w * y.std() + y.mean())
    with pytest.raises(models.FeatureError):
        m.predict(np.full((1, 5), np.nan))


def test_spline_basis_sums_to_one():
    x = np.linspace(-3, 3, 50)
    b = models.bspline_basis(x, np.array([-1.0, -0.2, 0.4, 1.0]))
    assert b.shape == (50, 6) and np.allclose(b.sum(1), 1) and (b >= 0).all()


def panel(spark, n=400):
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        up = r.random() < 0.5
        rows.append(("T", f"e{i}", i * DAY // 4, 1 + i % 3, 2000 + i // 150, f"W{i // 28:02d}", "UPPER_HALF" if up else "LOWER_HALF", float(r.normal(0.6 if up else -0.6, 1)), float(r.random())))
    return spark.createDataFrame(rows, "target string, event_id string, event_ns long, fold long, year long, week string, state string, y double, score double"), rows


def test_resampling(spark):
    p, rows = panel(spark)
    ci = {r.half: r for r in stats.bootstrap_ci(p, ["target"], reps=300).collect()}
    core = {r.half: r for r in stats.evaluate(p, ["target"], spark.createDataFrame([("T", 15)], "target string, n_weeks long")).collect()}
    for half in ("UPPER_HALF", "LOWER_HALF"):
        assert 0 < ci[half].ci_low < core[half].uplift < ci[half].ci_high
    pv = {r.half: r.raw_p for r in stats.permutation_p(p, ["target"], reps=200).collect()}
    assert max(pv.values()) <= 0.05
    same = p.withColumn("y", F.col("score"))
    assert min(r.raw_p for r in stats.permutation_p(same, ["target"], reps=200).collect()) > 0.01
    y = np.array([r[7] for r in rows])
    sel = np.array([r[6] == "UPPER_HALF" for r in rows])
    assert core["UPPER_HALF"].uplift == pytest.approx(y[sel].mean() - y.mean())


def test_paired_difference_of_a_group_with_itself_is_zero(spark):
    p, _ = panel(spark)
    both = p.withColumn("g", F.lit("a")).unionByName(p.withColumn("g", F.lit("b"))).withColumn("m", F.lit("M"))
    pairs = spark.createDataFrame([("T", "UPPER_HALF", "a", "b")], "target string, half string, group_a string, group_b string")
    r = stats.paired_difference(both, ["target"], "g", "m", pairs, reps=50).first()
    assert r.difference == 0 and r.ci_low == r.ci_high == 0 and r.contains_zero


def test_paired_difference_against_a_loop(spark):
    p, rows = panel(spark)
    other = p.withColumns({"g": F.lit("b"), "y": F.col("y") * 2 + F.col("score")})
    both = p.withColumn("g", F.lit("a")).unionByName(other).withColumn("m", F.explode(F.array(F.lit("M1"), F.lit("M2"))))
    pairs = spark.createDataFrame([("T", "UPPER_HALF", "a", "b")], "target string, half string, group_a string, group_b string")
    r = stats.paired_difference(both, ["target"], "g", "m", pairs, reps=200).first()
    y, sel = np.array([x[7] for x in rows]), np.array([x[6] == "UPPER_HALF" for x in rows])
    z = y * 2 + np.array([x[8] for x in rows])
    up = lambda v: (v[sel].mean() - v.mean()) / v.std(ddof=1)
    assert r.difference == pytest.approx(up(y) - up(z)) and r.ci_low < r.difference < r.ci_high and r.n_weeks == len({x[5] for x in rows})


def test_permutation_counts_as_a_plain_loop_does(spark):
    """A panel of three weeks has six orders only, so the share of hits is known."""
    import itertools

    y = {"W0": [1.0, 2.0], "W1": [0.0, 5.0, 1.0], "W2": [3.0]}
    st = ["UPPER_HALF", "LOWER_HALF", "UPPER_HALF", "UPPER_HALF", "LOWER_HALF", "LOWER_HALF"]
    rows = [("T", f"e{i}", i, w, s, v) for i, ((w, v), s) in enumerate(zip([(w, v) for w in y for v in y[w]], st))]
    df = spark.createDataFrame(rows, "target string, event_id string, event_ns long, week string, state string, y double")
    upper = np.array([s == "UPPER_HALF" for s in st])
    stat = lambda v: np.array(v)[upper].mean()
    seen = stat([r[5] for r in rows])
    share = np.mean([stat([v for w in o for v in y[w]]) >= seen - 1e-9 for o in itertools.permutations(y)])
    got = {r.half: r.raw_p for r in stats.permutation_p(df, ["target"], reps=3000).collect()}
    assert got["UPPER_HALF"] == pytest.approx(share, abs=0.04)


def test_inner_predictions_never_see_their_own_time(monkeypatch):
    seen = []

    class Fake:
        def fit(self, x, y):
            self.known = set(x[:, 0].astype(int))
            return self

        def predict(self, x):
            seen.append((self.known, x[:, 0].astype(int)))
            return x[:, 0]

    monkeypatch.setattr(models, "make", lambda *a: Fake())
    r = np.random.default_rng(1)
    n = 503
    t = np.sort(r.integers(0, 10_000, n))
    end = t + r.integers(1, 900, n)
    got = crossval.inner_predictions("RIDGE", np.arange(n, dtype=float)[:, None], np.zeros(n), t, end, None)
    parts = np.array_split(np.arange(n), crossval.INNER)
    for known, own in seen:
        assert known == {i for i in range(own[0]) if end[i] < t[own[0]]}
    assert [list(o) for _, o in seen] == [list(x) for x in parts[1:]] and len(got) == n - len(parts[0])


def test_overlapping_intervals(spark):
    r = random.Random(3)
    rows = [(f"c{i}", f"20{r.randrange(10, 14)}-0{r.randrange(1, 10)}-15", f"20{r.randrange(12, 20)}-0{r.randrange(1, 10)}-15") for i in range(40)] + [("x", "", "2012-01-01"), ("y", None, None)]
    got = sorted(tuple(x) for x in events.overlaps(spark.createDataFrame(rows, "id string, a string, b string"), "id", "a", "b").collect())
    full = [x for x in rows if x[1] and x[2]]
    assert got == sorted((a[0], b[0]) for a in full for b in full if a[0] < b[0] and a[1] < b[2] and b[1] < a[2])


def test_overfitting_probability(spark):
    r = np.random.default_rng(0)
    good = [("best", g, 1.0) for g in range(6)] + [(f"c{k}", g, float(r.normal())) for k in range(4) for g in range(6)]
    noise = [(f"c{k}", g, float(r.normal())) for k in range(8) for g in range(6)]
    schema = "config string, block long, uplift double"
    a = crossval.overfitting(spark.createDataFrame(good, schema)).first()
    b = crossval.overfitting(spark.createDataFrame(noise, schema)).first()
    assert a.n_splits == b.n_splits == 15 and a.pbo <= b.pbo <= 1


def test_hash_chain_and_its_check(spark):
    import hashlib

    rows = [("c", i, f"row{i}") for i in range(5)]
    h, stored = "GENESIS", []
    for _, _, c in rows:
        h = hashlib.sha256((h + c).encode()).hexdigest()
        stored.append(h)
    df = spark.createDataFrame([(*r, s) for r, s in zip(rows, stored)], "c string, i long, x string, h string")
    assert events.hash_chain(df, ["c"], ["i"], F.col("x")).first().chain == h
    assert events.verify_chain(df, ["c"], ["i"], F.col("x"), "h").count() == 0
    bad = df.withColumn("x", F.when(F.col("i") == 2, "changed").otherwise(F.col("x")))
    assert [r.i for r in events.verify_chain(bad, ["c"], ["i"], F.col("x"), "h").collect()] == [2]


def test_plugins_and_parameters(spark):
    df, rows = bars(spark, 400)
    p = events.pivots(positions.with_positions(df), 5, 3)
    got = sorted((r.event_ns, r.direction) for r in p.collect())
    lo, hi, t = (np.array([r[i] for r in rows]) for i in (5, 4, 2))
    want = []
    for i in range(5, 397):
        a = lo[i] < lo[i - 5 : i].min() and lo[i] <= lo[i : i + 4].min()
        b = hi[i] > hi[i - 5 : i].max() and hi[i] >= hi[i : i + 4].max()
        if a != b:
            want.append((int(t[i + 3]) + STEP, 1 if a else -1))
    assert got == want
    import pandas as pd

    def detect(b, params):
        x = b[b["close"] > b["close"].shift(params["lag"])]
        return pd.DataFrame({"event_time": x.index, "direction": 1})

    assert events.run_plugin(df, detect, {"lag": 1}).count() > 100
    q = events.StrictParams(a=1, b=2)
    assert q["a"] == 1 and q.unused() == {"b"}
    with pytest.raises(KeyError):
        q["c"]
    n = events.causality(lambda x: events.pivots(positions.with_positions(x), 5, 3), df).first()
    assert n.n_cutoffs == 8 and n.n_cut == n.n_changed == 0
    # an event where the next bar closes higher; one whose bar lies above the mean of all bars
    step = lambda x: x.withColumn("event_ns", F.col("ts") + F.col("step_ns"))
    w = Window.partitionBy("series_id").orderBy("ts")
    ahead = lambda x: step(x).withColumn("up", F.lead("close").over(w) > F.col("close")).where("up").select("series_id", "event_ns", F.lit(1).alias("direction"))
    mean = lambda x: step(x).withColumn("up", F.col("close") > F.avg("close").over(Window.partitionBy("series_id"))).where("up").select("series_id", "event_ns", F.lit(1).alias("direction"))
    assert events.causality(ahead, df).first().n_cut > 0
    assert events.causality(mean, df).first().n_changed > 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5, 10.0), ("2020-01-01 00:01:00", 1.0, 2.0, 0.5, 1.5, 10.0)], "timestamp string, open double, high double, low double, close double, volume double")
    df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(f"{tmp_path}/b")
    b = bar_source.load_bars(spark, f"{tmp_path}/b", before="2020-01-01 00:01:00")
    assert b.count() == 1 and b.dtypes[0] == ("timestamp", "timestamp")
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(timestamp" in plan
    df.toPandas().to_csv(f"{tmp_path}/b.csv", index=False)
    assert bar_source.validate_bars(bar_source.load_bars(spark, f"{tmp_path}/b.csv")).count() == 2
    with pytest.raises(bar_source.BarError):
        bar_source.validate_bars(b.unionByName(b))
    with pytest.raises(bar_source.BarError):
        spark.range(1).write.parquet(f"{tmp_path}/c")
        bar_source.load_bars(spark, f"{tmp_path}/c")
    p = spark.createDataFrame([("A", "M", 1), ("B", "M", 2)], "target string, model string, x int")
    bar_source.write_panel(p, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").where("target = 'A'").count() == 1
    assert bar_source.read_timestamps(spark, f"{tmp_path}/b.csv", "timestamp").count() == 2


def test_stream_of_bars_equals_the_batch(spark, data, tmp_path):
    from causalbars.streaming import resample

    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    late = e.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))  # moves the watermark past all others
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    q = resample.bars(s, "event_type", "ts", "value", "event_id", "5 minutes", "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    late.write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = resample.bars(e, "event_type", "ts", "value", "event_id", "5 minutes")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 100


def test_components(spark):
    from causalbars.operators import graphs

    r = random.Random(1)
    pairs = [(f"n{i:03d}", f"n{r.randrange(max(0, i - 3), i + 1):03d}") for i in range(200) if r.random() < 0.8] + [(f"n{i}", f"n{i + 1}") for i in range(300, 380)] + [("x", None), ("y", "y")]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in pairs:
        if a and b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    want = {a: find(a) for a in list(up)}
    got = {x.node: x.component for x in graphs.components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == want


def test_registry_and_reports(spark, tmp_path):
    from causalbars.sources import registry, reports, synthetic

    df = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "id string, n string, s string")
    registry.replace(df, f"{tmp_path}/reg")
    registry.append(df.limit(1), f"{tmp_path}/reg")
    assert registry.read(spark, f"{tmp_path}/reg", ["n", "missing", "s"]).count() == 3
    registry.replace(df, f"{tmp_path}/reg")
    assert sorted(map(tuple, registry.read(spark, f"{tmp_path}/reg", ["id", "missing", "s"]).collect())) == [("a", "", ""), ("b", "", "x")]
    assert len(list(tmp_path.iterdir())) == 1
    nan = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double")
    assert sorted(r.value for r in reports.json_rows(nan).collect()) == ['{"i":1,"x":null}', '{"i":2,"x":0.5}']
    assert reports.markdown(nan.where("i = 2")) == "| i | x |\n|---|---|\n| 2 | 0.5 |\n"
    b = synthetic.bars(spark, 8, pull=0.3)
    assert b.count() == 8 * 390 == b.select("timestamp").distinct().count() and b.where("high < greatest(open, close) or low > least(open, close)").count() == 0
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, synthetic.bars(spark, 8, pull=0.3).repartition(3).collect()))
    for s, lo, hi in (("linear", 0.2, 0.5), ("none", -0.1, 0.1)):
        assert lo < synthetic.event_table(spark, 300, 4.5, signal=s).stat.corr("x", "y") < hi
    years = synthetic.event_table(spark, 104, 9.0, signal="linear", slope=0.8, slope_by_year={2016: -0.8}, tie=True, noise=2)
    assert years.where("event_ns < 1451606400000000000").stat.corr("x", "y") > 0.4 > -0.4 > years.where("event_ns > 1451606400000000000").stat.corr("x", "y")
    assert years.select("x").distinct().count() == 5 and {"x1", "x2"} <= set(years.columns)
    with pytest.raises(ValueError):
        synthetic.event_table(spark, 1, 1.0, signal="other")


def test_plugin_sources():
    from causalbars.operators.plugins import problems

    good = "def detect_events(bars, params):\n    x = bars['close'].shift(1) > bars['close'].rolling(params['n']).mean()\n    return bars[x]\n"
    assert problems(good) == []
    bad = "import os\nfrom random import choice\nx = 5\ny = b.shift(-1)\ny = b.shift(periods=-n)\nz = b.bfill()\nw = b.rolling(n, center=True)\nv = b.fillna(method='bfill')\nopen('f')\n"
    assert [p.split(":")[0] for p in problems(bad)] == ["1", "2", "3", "4", "5", "6", "7", "8", "9"]
    assert problems("def (") != []


def test_specifications(tmp_path):
    import json

    from causalbars.sources import spec

    frame = spec.Frame("NQ", "1min", 570, 960, 1)
    good = {
        "experiment_id": "E", "campaign_id": "C", "hypothesis": "a pivot is followed by a move", "instrument": "NQ", "data_interval": "1min",
        "partitions": {"development_end": "2019-01-01", "selection_holdout_end": "2020-01-01", "lockbox_start": "2020-01-01"},
        "eligible_session": {"start": "09:31", "end": "16:00"}, "direction_definition": {"rule": "pivot", "values": [1]},
        "event_condition": {"description": "a pivot", "parameters_used": ["left"]}, "deduplication_rule": "first_per_timestamp", "cooldown": {"bars": 5},
        "base_parameters": {"left": 5, "right": 3}, "sensitivity_parameters": ["left"], "expected_information_time": {"rule": "at the bar", "confirmation_delay_bars": "right"},
        "filter_ladder": ["BASE_TRIGGER", "FINAL_EVENT"],
    }
    (tmp_path / "s.json").write_text(json.dumps(good))
    assert spec.checked(spec.load(str(tmp_path / "s.json")), frame, experiment_id="E") == good
    bad = {
        "hypothesis": "TODO", "instrument": "ES", "data_interval": "5min", "partitions": {"development_end": "2019-01-01", "selection_holdout_end": "2019-07-01", "lockbox_start": "2019-07-01"},
        "eligible_session": {"start": "09:30", "end": "16:00"}, "direction_definition": {"rule": "x", "values": [1, -1]}, "event_condition": {"description": "x", "parameters_used": ["up"]}, "deduplication_rule": "any",
        "cooldown": {"bars": True}, "base_parameters": {"left": float("nan")}, "sensitivity_parameters": ["up"], "expected_information_time": {"rule": "x", "confirmation_delay_bars": -1}, "filter_ladder": ["FINAL_EVENT"],
    }
    for part, value in bad.items():
        assert part in {p.split(":")[0] for p in spec.problems(good | {part: value}, frame)}, part
    assert len(spec.problems({}, frame)) == len(spec.KEYS) and spec.problems(good, frame, campaign_id="D")
    with pytest.raises(spec.SpecError):
        spec.checked(good | bad, frame)


def test_ladders_probes_and_panels(spark, tmp_path):
    a = spark.createDataFrame([("s", 1, 1), ("s", 2, -1)], "series_id string, event_ns long, direction int")
    b = a.where("direction = 1")
    assert events.ladder({"A": a, "B": b}, ["A", "B"], b).count() == 3
    for steps, declared, final in (({"B": b, "A": a}, ["A", "B"], b), ({"A": a, "B": b}, ["A", "B"], a), ({"A": a}, ["A", "B"], a)):
        with pytest.raises(events.LadderError):
            events.ladder(steps, declared, final)
    assert events.probes({"n": 5, "x": 2.0, "one": 1}) == [("n", 0.75, {"n": 4, "x": 2.0, "one": 1}), ("n", 1.25, {"n": 6, "x": 2.0, "one": 1}), ("x", 0.75, {"n": 5, "x": 1.5, "one": 1}), ("x", 1.25, {"n": 5, "x": 2.5, "one": 1})]
    t = events.trial_product(spark).select(F.lit("E").alias("e"), *(F.split("trial_id", r"\|")[i].alias(n) for i, n in enumerate(("target", "model", "half"))))
    assert tuple(events.trial_sets(t, "e").first()) == ("E", 24, 0, 0, 0)
    odd = t.where("model <> 'XGB'").unionByName(t.limit(1)).unionByName(t.limit(1).withColumn("target", F.lit("X")))
    assert tuple(events.trial_sets(odd, "e").first()) == ("E", 17, 8, 1, 1)
    p = spark.createDataFrame([("A", "M", 1), ("B", "M", 2), ("B", "N", 3)], "target string, model string, x int")
    bar_source.write_panel(p, f"{tmp_path}/p")
    assert [r.x for r in bar_source.read_panel(spark, f"{tmp_path}/p", "B", "N").collect()] == [3] and bar_source.read_panel(spark, f"{tmp_path}/p").count() == 3
    texts = spark.createDataFrame([("the best bracket is",), ("a bracket",), (None,)], "text string")
    assert [r.phrases for r in pathstats.forbidden_phrases(texts, "text").collect()] == [["BEST BRACKET"]]
