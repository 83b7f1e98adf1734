"""Session helpers shared by every operator: sessions, checkpoints, table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "causalbars", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and cut-off tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests,
    a laptop) a temporary folder of this machine is used, and only with a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="causalbars-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint: it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/causalbars-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, *by: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read from there, for loops of joins.

    A checkpoint keeps the size estimated for its plan; over rounds of joins of a frame with itself that estimate
    squares each time, until the driver only multiplies its digits. A table has the size it has, so that small
    frames are broadcast as well. The files go with the application (``deleteOnExit``), the shuffles behind them at once.
    ``by``: columns with a folder for each of their values, for tables that are read by these."""
    spark = df.sparkSession
    home = _home(spark)
    root = spark._jvm.org.apache.hadoop.fs.Path(home)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    path = f"{home}/{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.option("compression", codec).parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the stored tables that the frames read: nothing may read them, or what rests on them, any more."""
    for spark in {df.sparkSession for df in frames}:
        table_of = re.compile(rf"(.*/{re.escape(_home(spark).rsplit('/', 1)[1])}/[0-9a-f]{{32}})/")
        for path in {m[1] for df in frames if df.sparkSession is spark for f in df.inputFiles() if (m := table_of.match(f))}:
            root = spark._jvm.org.apache.hadoop.fs.Path(path)
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table just read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One parquet table of a data directory; TIMESTAMP_NTZ columns are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if cols:
        df = df.select(*cols)
    ntz = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def clean_double(c: str):
    """A numeric column in which NaN and infinities count as NULL."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
