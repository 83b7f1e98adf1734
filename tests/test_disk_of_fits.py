"""What a query leaves on disk while it goes on."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causalbars import runtime
from causalbars.operators import crossval, events, features, positions
from causalbars.plans import study_queries
from causalbars.sources import bars as bar_source


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum("/shuffle_" in f and f.endswith(".data") for f in files.split("\n"))


def test_a_stored_table_leaves_no_shuffle(spark):
    before = _shuffle_files(spark)
    df = runtime.stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffle_files(spark) <= before and df.count() == 7
    assert spark.conf.get(runtime.DROP_SHUFFLES, None) is None  # only while it is written
    assert runtime.stored(df.repartition(3)).count() == 7


def test_bars_are_shuffled_once_for_their_positions(spark, data):
    df = positions.with_positions(bar_source.clean_bars(runtime.table(spark, data, "bars"), runtime.table(spark, data, "instruments"), by_day=True))
    filters = [line.split("Filter ")[1] for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in line and "isnan(open" in line]
    plain = {re.sub(r"#\d+L?", "", x) for x in filters}
    assert len(filters) == 2 and len(plain) == 1  # else one shuffle can't stand for both


def test_outcomes_of_fits_are_stored_before_the_features(spark):
    d = "/root/testdata/sf0.01"  # the smallest tables with series as long as the bank's history
    if not Path(d).exists():
        pytest.skip("no test tables here")
    _, bank, rows = study_queries._bank(spark, d)
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text(rows) and "Aggregate" not in text(rows) and "FlatMapCoGroups" in text(bank)
    assert rows.count() == rows.select("event_id", "target").distinct().count() > 0


def _stored_tables(spark) -> set[str]:
    return {p.name for p in Path(runtime._home(spark).removeprefix("file:")).iterdir()}


def test_fits_in_pieces_drop_the_tables_they_rest_on(spark):
    n = 240
    bank = spark.range(n).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("study"), F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") * 10).alias("event_ns"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("z"))
    rows = bank.select("study", "event_id", F.lit("T1").alias("target"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("fold"), (F.col("event_ns") + 5).alias("end_ns"), (F.col("x") + F.col("z")).alias("y"))
    rows = rows.withColumn("role", F.when(F.col("end_ns") < F.col("fold") * 600, "train").otherwise("val"))
    fit = lambda *tables, **k: crossval.importances(*tables, ["study"], ["x", "z"], names=("RIDGE",), min_train=10, targets=("T1",), **k)
    order = ["study", "fold", "feature"]
    want = fit(bank, rows).toPandas().sort_values(order, ignore_index=True)
    before = _stored_tables(spark)
    own, outcomes = runtime.stored(bank), runtime.stored(rows)
    spent = _stored_tables(spark) - before
    got = fit(own, outcomes, pieces=[own.where("x < 0"), own.where("x >= 0")], spent=[own, outcomes])
    assert len(spent) == 2 and not spent & _stored_tables(spark)
    got = got.toPandas().sort_values(order, ignore_index=True)
    assert len(got) == 12 and got[order].equals(want[order])
    assert got["coefficient"].tolist() == pytest.approx(want["coefficient"].tolist())


def test_slices_of_the_series_give_the_whole_bank(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test tables here")
    key = lambda df: sorted(map(tuple, df.select("study", "event_id", F.round("RET_60", 12), F.round("distance_from_causal_session_VWAP", 12)).collect()))
    outcome = lambda df: sorted(map(tuple, df.select("event_id", "target", "y", "end_ns").collect()))
    _, bank, rows = study_queries._bank(spark, d)
    monkeypatch.setattr(study_queries, "SLICE_BYTES", 1 << 19)
    _, pieces, sliced, spent = study_queries._bank_pieces(spark, d)
    assert len(pieces) == 3 and len(spent) == 5
    found = [key(p) for p in pieces]
    assert all(found) and sorted(sum(found, [])) == key(bank) and outcome(sliced) == outcome(rows)


def test_signs_of_coefficients_need_the_linear_fits_only(spark, monkeypatch, data):
    seen = {}
    empty = spark.createDataFrame([], "study string, target string, model string, fold bigint, feature string, importance double, coefficient double")
    monkeypatch.setattr(study_queries, "_bank_pieces", lambda *a: (None, [empty], None, []))
    monkeypatch.setattr(study_queries, "_in_folds", lambda *a: None)
    monkeypatch.setattr(crossval, "importances", lambda bank, rows, by, columns, **k: seen.update(k, features=columns) or empty)
    assert study_queries.ag15_sign_stability(spark, data).count() == 0
    assert seen["names"] == ("RIDGE",) and seen["features"] == features.NAMES and seen["targets"] == events.TARGETS
