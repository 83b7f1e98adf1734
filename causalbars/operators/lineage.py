"""Parent-child rows to full hierarchies by tree contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.runtime import stored

MAX_ROUNDS = 400  # contraction is geometric; this only stops a defect from looping for ever
MAX_TURNS = 64  # undoing doubles the steps a turn


def _norm(c: str):
    return F.nullif(F.upper(F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def links(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """One row ``(id, parent)`` per node: blanks and letter case of keys don't count, an unknown or
    empty parent is NULL, repeated rows collapse (of several parents of one node the largest counts)."""
    one = rows.select(F.col(node).alias("id"), _norm(node).alias("k"), _norm(parent).alias("pk"))
    one = one.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("id").alias("id"), F.max("pk").alias("pk"))
    known = one.select(F.col("k").alias("pk"), F.col("id").alias("parent"))
    return one.join(known, "pk", "left").select("id", "parent")


def contract(edges: DataFrame, with_paths: bool) -> tuple[list[DataFrame], DataFrame]:
    """Alternate raking of leaves with splicing of unary nodes until only cycles are left, as self-loops.

    ``edges``: (c, p, d, m, via, hc, hp), d = steps from c up to p, m = least id spliced out of the edge,
    via = the spliced ids from above, hc and hp = hashes of c and p. Returns the records of removed nodes,
    one frame a round, and the self-loops. A unary node is spliced if its own coin shows heads and its
    parent's tails, so no two neighbours go in one round; about a quarter of a chain goes a round, and
    rounds grow with the logarithm of the depth. Two written tables a round; coins are the hashes' last bits,
    rehashed each round, so that all rounds run the same generated code."""
    removed = []
    live = stored(edges)
    heads = lambda c: F.col(c).bitwiseAND(F.lit(1).cast("long")) == 1
    for _ in range(MAX_ROUNDS):
        if live.where("c <> p").isEmpty():
            return removed, live
        kids = live.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("p", "c")
        spliced = (F.col("n") == 1) & (F.col("c") != F.col("p")) & heads("hc") & ~heads("hp")
        marked = stored(live.join(kids, "c", "left").withColumn("what", F.when(F.col("n").isNull(), "rake").when(spliced, "splice").otherwise("keep")))
        removed.append(marked.where("what <> 'keep'").select("c", "p", "d", "via"))
        # the child of a spliced node hangs on that node's parent now; a raked child is gone with it
        up = marked.where("what = 'splice'").select(F.col("c").alias("p"), *(F.col(x).alias(f"{x}2") for x in ("p", "d", "m", "via", "hp")))
        moved = F.col("p2").isNotNull()
        live = stored(
            marked.where("what = 'keep'").join(up, "p", "left").select(
                "c",
                F.coalesce("p2", "p").alias("p"),
                (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
                F.least("m", F.when(moved, F.col("p")), "m2").alias("m"),
                (F.when(moved, F.concat("via2", F.array("p"), "via")).otherwise(F.col("via")) if with_paths else F.col("via")).alias("via"),
                F.xxhash64("hc").alias("hc"),
                F.xxhash64(F.coalesce("hp2", "hp")).alias("hp"),
            )
        )
    raise RuntimeError("the contraction did not end")


def hierarchy(rows: DataFrame, node: str, parent: str, with_paths: bool = False) -> DataFrame:
    """Each node's ``id, parent, root_id, depth`` and, on request, ``path`` (ids from the root down).

    A node without a known parent is its own root at depth 0. Where the ancestry runs into a cycle,
    ``root_id`` is the least id on it, ``depth`` is -1 and ``path`` NULL. Contractions are recorded and
    undone by composing the records: they form a forest whose height is at most twice the rounds, so
    a handful of self-joins resolves every node. Every step is a grouped count or an equi-join, at any size.
    NULL and blank ids are left out; an empty table gives an empty result."""
    tree = stored(links(rows, node, parent))
    empty = F.array().cast("array<string>")
    edges = tree.where("parent is not null").select(
        F.col("id").alias("c"), F.col("parent").alias("p"), F.lit(1).cast("long").alias("d"), F.lit(None).cast("string").alias("m"), empty.alias("via"), F.xxhash64("id").alias("hc"), F.xxhash64("parent").alias("hp")
    )
    removed, loops = contract(edges, with_paths)
    solved = loops.select(F.col("c").alias("id"), F.col("c").alias("up"), F.lit(0).cast("long").alias("d"), F.least("c", "m").alias("r"), F.lit(True).alias("cyc"), empty.alias("path"))
    # tops: roots, and what is left of each cycle
    seg = lambda c: F.array(F.col(c)) if with_paths else empty
    tops = tree.where("parent is null").select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("d"), F.col("id").alias("r"), F.lit(False).alias("cyc"), seg("id").alias("path"))
    tops = tops.unionByName(solved)
    rec = None
    for x in removed:
        x = x.select(F.col("c").alias("id"), F.col("p").alias("up"), "d", F.lit(None).cast("string").alias("r"), F.lit(False).alias("cyc"), (F.concat("via", F.array("c")) if with_paths else empty).alias("path"))
        rec = x if rec is None else rec.unionByName(x)
    state = stored(tops.unionByName(rec) if rec is not None else tops)
    for _ in range(MAX_TURNS):
        if state.where("r is null").isEmpty():
            break
        known = state.select(F.col("id").alias("up"), F.col("up").alias("u2"), F.col("d").alias("d2"), F.col("r").alias("r2"), F.col("cyc").alias("c2"), F.col("path").alias("p2"))
        todo = state.where("r is null").drop("r", "cyc").join(known, "up")
        state = stored(
            todo.select("id", F.col("u2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.col("r2").alias("r"), F.col("c2").alias("cyc"), (F.concat("p2", "path") if with_paths else F.col("path")).alias("path")).unionByName(
                state.where("r is not null")
            )
        )
    else:
        raise RuntimeError("the contraction could not be undone")
    out = state.select("id", F.col("r").alias("root_id"), F.when(F.col("cyc"), F.lit(-1)).otherwise(F.col("d")).cast("long").alias("depth"), F.when(~F.col("cyc"), F.col("path")).alias("path"))
    out = tree.join(out, "id")
    return out if with_paths else out.drop("path")


def descendants(rows: DataFrame, node: str, parent: str, marked: bool = False) -> DataFrame:
    """Every (ancestor, descendant, steps) pair, ``steps`` being the least number of steps up.

    Where the ancestry runs into a cycle, all its members are ancestors of the nodes below it and of each
    other, and each is its own after one turn. ``marked`` adds ``on_cycle``: the ancestor lies on a cycle.
    The result's size is the sum of depths, plus for each node that hangs on a cycle the cycle's length;
    the pairs come from each node's own path, one row at a time. To get paths there as well, the link above
    each cycle's least member is left out: the way down from it to its parent is the cycle."""
    h = hierarchy(rows, node, parent, with_paths=True)
    up = F.transform(F.slice("path", 1, F.col("depth").cast("int")), lambda x, i: F.struct(x.alias("ancestor"), (F.col("depth") - i).alias("steps"), F.lit(False).alias("on_cycle")))
    pairs = h.where("depth > 0").select(F.col("id").alias("descendant"), F.inline(up))
    lost = stored(h.where("depth = -1").select("id", "root_id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("parent"), F.col("parent").alias("above")))
    opened = stored(hierarchy(lost, "id", "parent", with_paths=True).select("id", "root_id", "depth", "path"))
    rings = lost.where("id = root_id").select(F.col("above").alias("id")).join(opened, "id").select("root_id", F.col("path").alias("ring"))
    # a path runs along the cycle and never comes back to it, so the members on it are its first ones
    on = F.size(F.array_intersect("path", "ring"))
    hung = opened.join(rings, "root_id").withColumn("on", on.cast("long")).withColumn("long", F.size("ring").cast("long"))
    before = F.transform(F.slice("path", 1, F.col("depth").cast("int")), lambda x, i: F.struct(x.alias("ancestor"), (F.col("depth") - i).alias("steps"), (i < F.col("on")).alias("on_cycle")))
    # the other members, over the link left out; a member itself comes last
    first = F.least("on", "depth")
    around = F.transform(F.expr("slice(ring, cast(least(on, depth) as int) + 1, cast(long as int))"), lambda x, i: F.struct(x.alias("ancestor"), (F.col("depth") + F.col("long") - first - i).alias("steps"), F.lit(True).alias("on_cycle")))
    pairs = pairs.unionByName(hung.select(F.col("id").alias("descendant"), F.inline(F.concat(before, around))))
    return pairs.select("ancestor", "descendant", "steps", *(["on_cycle"] if marked else []))
