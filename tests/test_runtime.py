from pyspark.sql import functions as F

from causalbars import runtime


def size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_stored_tables_have_their_own_size(spark):
    """Rounds of joins of a frame with itself: the estimate stays that of the files."""
    df = runtime.stored(spark.range(100).select("id", (F.col("id") + 1).alias("up")))
    first = size(df)
    for _ in range(4):
        up = df.select(F.col("id").alias("up"), F.col("up").alias("u2"))
        df = runtime.stored(df.join(up, "up").select("id", F.col("u2").alias("up")))
    assert size(df) < 4 * first and {(r.id, r.up) for r in df.collect()} == {(i, i + 16) for i in range(85)}


def test_stored_tables_lie_in_the_shared_folder(spark):
    home = runtime.shared_dir(spark).removeprefix("file:")
    df = runtime.stored(spark.range(3).select("id"))
    assert df.count() == 3 and all(f.removeprefix("file://").startswith(home) for f in df.inputFiles())
