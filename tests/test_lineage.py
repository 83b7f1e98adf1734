import random

import pytest

from causalbars.operators import lineage

SCHEMA = "node string, parent string, id string"


def brute(pairs):
    """Root, depth and path of each node by walking up."""
    key = lambda s: (s or "").strip().upper()
    ids, up = {}, {}
    for n, p in pairs:
        if not key(n):
            continue
        ids[key(n)] = min(ids.get(key(n), n), n)
        up[key(n)] = max(filter(None, [up.get(key(n)), key(p)]), default="")
    out = {}
    for k in ids:
        path, at = [k], k
        while up[at] in ids and up[at] not in path:
            at = up[at]
            path.append(at)
        if up[at] in ids:
            ring = path[path.index(up[at]) :]
            out[ids[k]] = (min(ids[x] for x in ring), -1, None)
        else:
            out[ids[k]] = (ids[at], len(path) - 1, tuple(ids[x] for x in reversed(path)))
    return out


def run(spark, pairs):
    df = spark.createDataFrame([(n, p, "clash") for n, p in pairs], SCHEMA)
    rows = lineage.hierarchy(df, "node", "parent", True).collect()
    return {r.id: (r.root_id, r.depth, tuple(r.path) if r.path is not None else None) for r in rows}


def forest(n, seed):
    r = random.Random(seed)
    rows = [(f"N{i:04d}", f"N{i - 1:04d}" if i and r.random() < 0.8 else (f"N{r.randrange(i):04d}" if i and r.random() < 0.7 else r.choice(["", None, "GONE"]))) for i in range(n)]
    rows += [(f"C{i}", f"C{(i + 1) % 7}") for i in range(7)] + [("L1", "L1"), ("D1", "D2"), ("D2", "D1"), ("T1", "C3"), ("T2", "T1"), ("T3", "L1")]
    rows += [(n, f"  {(p or '').lower()}\t") for n, p in rows[:20] if p]  # delivered again
    r.shuffle(rows)
    return rows


def test_forest_with_cycles(spark):
    pairs = forest(150, 3)
    assert run(spark, pairs) == brute(pairs)


def test_long_chain(spark):
    pairs = [(f"N{i:04d}", f"N{i - 1:04d}" if i else None) for i in range(700)]
    assert run(spark, pairs) == brute(pairs)


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", None)], [(None, "a"), ("  ", "b"), ("x", "none")]])
def test_small(spark, pairs):
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lineage.hierarchy(df, "node", "parent").count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b")], "node string, parent string")
    got = {tuple(r) for r in lineage.descendants(df, "node", "parent").collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 2), ("b", "d", 1)}


def test_descendants_on_and_below_cycles(spark):
    pairs = forest(80, 5) + [("B", "A"), ("A", "C2"), ("SELF", "self")]
    ids = {n.upper(): n for n, _ in pairs}
    up = {n: ids.get(max(((p or "").strip().upper() for m, p in pairs if m == n), default="")) for n in ids.values()}
    want = set()
    for n in up:
        steps, at, seen = 0, n, {}
        while up[at] and up[at] not in seen:
            steps, at = steps + 1, up[at]
            seen[at] = steps
        ring = set()
        if up[at]:
            x = at
            while x not in ring:
                ring.add(x)
                x = up[x]
        want |= {(a, n, k, a in ring) for a, k in seen.items()}
    df = spark.createDataFrame(pairs, "node string, parent string")
    got = [tuple(r) for r in lineage.descendants(df, "node", "parent", marked=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("A", "B", 1, False), ("C2", "B", 2, True), ("C1", "B", 8, True), ("SELF", "SELF", 1, True)} <= want
