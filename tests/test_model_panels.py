import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causalbars.operators import crossval, features
from causalbars.plans import study_queries as q

DATA = "/root/testdata/sf0.01"  # the smallest tables with series as long as the bank's history


@pytest.fixture(scope="module")
def tables(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


def test_models_see_all_targets_features_and_eligible_events(spark, monkeypatch, tables):
    seen = {}
    monkeypatch.setattr(crossval, "walk_forward", lambda bank, rows, by, names, **k: seen.setdefault("cv6", (bank, rows, names))[1])
    monkeypatch.setattr(crossval, "importances", lambda bank, rows, by, names, **k: seen.setdefault("m5", (bank, rows, names))[1])
    q.cv6_model_panels(spark, tables)
    q.m5_importances(spark, tables)
    assert seen["cv6"][2] == seen["m5"][2] == features.NAMES and set(features.NAMES) <= set(seen["cv6"][0].columns)
    rows = seen["cv6"][1]
    assert {r[0] for r in rows.select("target").distinct().collect()} == {"DIR_RETURN_15", "DIR_RETURN_60", "DIR_RETURN_180", "DIR_PATH_SKEW_60"}
    e = q.eligible(spark, tables).where(F.col("pos_t") + 1 >= features.MIN_HISTORY).select("event_id", "event_ns", "tz", F.col("tz").alias("study")).distinct()
    want = {tuple(r) for r in crossval.development_folds(e, ["study"]).select("study", "fold", "lo", "hi").collect()}
    got = {tuple(r) for r in rows.select("study", "fold", "lo", "hi").distinct().collect()}
    assert got <= want and len({s for s, *_ in got}) == 4


def test_every_model_scores_every_part(spark, tables):
    p = q.cv6_model_panels(spark, tables).toPandas()
    assert set(p["model"]) == {"RIDGE", "SPLINE", "XGB"} and len(set(p["target"])) > 1
    assert not p.duplicated(["target", "model", "event_id"]).any() and p["score"].map(math.isfinite).all()
    assert ((p["score"] > p["threshold"]) == (p["state"] == "UPPER_HALF")).all()
    assert p.groupby("target")["model"].value_counts().groupby("target").nunique().eq(1).all()  # the models see the same events
