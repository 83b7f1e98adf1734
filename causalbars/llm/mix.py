"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.runtime import cut, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary splits text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MAX_TOKENIZER_BYTES = 64_000_000
BITS = 14  # the sampling hash is read 14 bits at a time, twice
CORPUS = "corpus"  # as total: the size of all listed sources together


def canonical(c: Column) -> Column:
    """A source's name whatever its case, surrounding blanks, or ``-`` and blanks for ``_``."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")), r"[-\s]+", "_"), F.lit(""))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the kept columns and ``n_tokens`` of each whole text (NULL and empty: 0)."""
    data = Path(tokenizer).read_bytes()
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is too large to send to every task")
    sent = documents.sparkSession.sparkContext.broadcast(data)
    own = documents.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"{c} {t}" for c, t in own.drop("_text").dtypes) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        count = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(count(t)) if isinstance(t, str) and t else 0 for t in b["_text"]]
            yield b.drop(columns="_text").assign(n_tokens=pd.Series(n, index=b.index, dtype="int64"))

    return own.mapInPandas(run, schema)


def water_fill(sources: DataFrame, total: float | str | None) -> DataFrame:
    """``sources`` (source, target, most, size) with ``tokens``: what each source gives.

    ``total`` None: the most with which every source that has documents can have its target. Otherwise sources are
    clamped at ``most * size`` and what they cannot give goes to the rest in proportion to their targets, again
    and again until all fit, or all are clamped. The rest always stand at one level of tokens per target, which
    only rises; so a turn is one aggregate over the sources, and only the level comes to the driver."""
    cap = F.col("most") * F.col("size").cast("double")
    live = sources.where("target > 0 and size > 0 and most > 0")
    if total is None:
        level = live.agg(F.min(cap / F.col("target"))).first()[0] or 0.0
    else:
        level, clamped = 0.0, -1
        while True:
            over = cap < level * F.col("target") * (1 - 1e-12)
            r = live.agg(
                F.sum("size").alias("all"), F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, cap)).alias("given"), F.sum(F.when(~over, F.col("target"))).alias("weight")
            ).first()
            if r["n"] == clamped or not r["weight"]:
                break
            clamped = r["n"]
            level = ((r["all"] if total == CORPUS else float(total)) - (r["given"] or 0.0)) / r["weight"]
        if r["n"] and not r["weight"]:
            level = float("inf")
    ok = (F.col("target") > 0) & (F.col("size") > 0) & (F.col("most") > 0)
    return sources.withColumn("tokens", F.when(ok, F.least(cap, F.lit(level) * F.col("target"))).otherwise(0.0))


def mixture(
    documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 1729, tokenizer: str = TOKENIZER, size: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: ``doc_id, source, n_tokens, copies`` of each document used; report: per source
    ``target_share, reached_share, size_tokens, mix_tokens, n_documents, max_repeats, max_copies``.

    ``total``: see ``water_fill``. Each source is repeated floor(rate) whole times, rate = its tokens over its size; the
    fraction left is a seeded sample of its documents, taken in the order of a hash of ``doc_id`` until its tokens
    come as near to the target as whole documents allow. No document is used more than ``max_repeats`` times.
    Spellings of a source count as one. Documents of no or an unlisted source, and texts without tokens,
    are not used; the report lists unlisted sources with target 0. Rows with the same ``doc_id`` share
    their fate. ``size`` measures texts by another expression than tokens. Tokens are counted once and kept in a
    checkpoint of a few bytes per document; thresholds come from histograms of the hash, so no source is sorted or
    gathered."""
    want = targets.select(canonical(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target"), F.col("max_repeats").cast("long").alias("most")).where("source is not null and target is not null")
    want = want.groupBy("source").agg(F.sum("target").alias("target"), F.max("most").alias("most"))
    named = documents.withColumn("_src", canonical(F.col("source")))
    counted = token_counts(named, tokenizer, keep=("_src",)) if size is None else named.select("doc_id", "_src", F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
    # 28 bits of the hash, as two numbers
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("long")
    sized = cut(counted.select("doc_id", F.col("_src").alias("source"), "n_tokens", F.shiftright(h, BITS).alias("b1"), h.bitwiseAND((1 << BITS) - 1).alias("b2")))
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("docs"))
    every = stored(want.join(sizes, "source", "full").withColumns({"most": F.coalesce("most", F.lit(0).cast("long")), "size": F.coalesce("size", F.lit(0).cast("long")), "asked": F.col("target").isNotNull(), "target": F.coalesce("target", F.lit(0.0))}))
    filled = water_fill(every.where("asked"), total)
    rate = F.coalesce(F.least(F.try_divide(F.col("tokens"), F.col("size")), F.col("most").cast("double")), F.lit(0.0))
    whole = F.floor(rate + 1e-9).cast("int")
    plan = stored(filled.select("source", whole.alias("whole"), F.greatest(F.lit(0.0), (rate - whole) * F.col("size")).alias("part")))
    use = stored(plan.join(_thresholds(sized, plan), "source", "left").select("source", "whole", F.coalesce("b1", F.lit(-1)).alias("c1"), F.coalesce("b2", F.lit(-1)).alias("c2")))
    mix = (
        sized.join(use, "source")
        .withColumn("copies", F.col("whole") + ((F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") <= F.col("c2")))).cast("int"))
        .where("copies > 0 and n_tokens > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    done = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("max_copies"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = stored(every.join(done, "source", "left"))
    total_mix = both.agg(F.sum("mix_tokens").alias("_all"))  # one row
    report = both.join(F.broadcast(total_mix)).select(
        "source",
        F.col("target").alias("target_share"),
        F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("_all")), F.lit(0.0)).alias("reached_share"),
        F.col("size").alias("size_tokens"),
        zero("mix_tokens").alias("mix_tokens"),
        zero("n_documents").alias("n_documents"),
        F.when(F.col("asked"), F.col("most")).alias("max_repeats"),
        zero("max_copies").alias("max_copies"),
    )
    return mix, report


def _thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the hash bins (b1, b2) up to which its documents make up ``part`` tokens."""
    need = plan.where("part > 0").select("source", "part")  # a row a source, of a size that Catalyst knows
    w = Window.partitionBy("source").orderBy("b1")
    coarse = sized.join(need, "source").groupBy("source", "part", "b1").agg(F.sum("n_tokens").alias("n"))  # at most 2^14 rows a source
    at = coarse.withColumn("upto", F.sum("n").over(w)).where("upto >= part").groupBy("source").agg(F.min_by(F.struct("b1", (F.col("part") - (F.col("upto") - F.col("n"))).alias("left")), "b1").alias("x")).select("source", "x.b1", "x.left")
    w2 = Window.partitionBy("source").orderBy("b2")
    at = stored(at)
    fine = sized.join(at, ["source", "b1"]).groupBy("source", "b1", "left", "b2").agg(F.sum("n_tokens").alias("n")).withColumn("upto", F.sum("n").over(w2))
    # the last bin that brings the sum nearer to what is left
    near = fine.where("upto - n / 2 <= left").groupBy("source").agg(F.max("b2").alias("b2"))
    return at.select("source", "b1").join(near, "source", "left").select("source", "b1", F.coalesce("b2", F.lit(-1)).alias("b2"))
