"""All-text registry tables: read with missing columns filled, replaced whole, appended to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV or parquet registry as text columns in the given order; a missing column or value is ''."""
    raw = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith("csv") else spark.read.parquet(path)
    have = set(raw.columns)
    return raw.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns))


def replace(df: DataFrame, path: str) -> None:
    """Write beside the table, then rename: a reader sees the old or the new table, never a part."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.parquet(fresh.toString())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def integrity(experiments: DataFrame, campaigns: DataFrame, per_campaign: int = 20) -> DataFrame:
    """``check_name, n_violations`` of the registry's accounting, each one aggregate or join over the whole tables."""
    e = experiments.select("experiment_id", "campaign_id", "sequence_in_campaign", "revealed_at", "frozen_at", "trial_ledger_hash").distinct()
    one = e.select("experiment_id", "campaign_id", "sequence_in_campaign").distinct()
    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")
    parts = {
        "repeated_experiment": experiments.groupBy("experiment_id").count().where("count > 1"),
        "unknown_campaign": one.join(campaigns.select("campaign_id").distinct(), "campaign_id", "left_anti"),
        "campaign_too_large": one.select("campaign_id", "experiment_id").distinct().groupBy("campaign_id").count().where(F.col("count") > per_campaign),
        "repeated_sequence": one.groupBy("campaign_id", "sequence_in_campaign").agg(F.countDistinct("experiment_id").alias("n")).where("n > 1"),
        "revealed_before_frozen": e.where(told("revealed_at") & (~told("frozen_at") | (F.col("revealed_at") < F.col("frozen_at")))).select("experiment_id").distinct(),
        "revealed_unsealed": e.where(told("revealed_at") & ~told("trial_ledger_hash")).select("experiment_id").distinct(),
    }
    out = None
    for name, df in parts.items():
        out = count(df, name) if out is None else out.unionByName(count(df, name))
    return out
