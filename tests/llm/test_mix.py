import random

import pytest
from pyspark.sql import functions as F

from causalbars.llm import mix


def fill(spark, sources, total):
    df = spark.createDataFrame(sources, "source string, target double, most long, size long")
    return {r.source: r.tokens for r in mix.water_fill(df, total).collect() if r.tokens}


def test_water_filling(spark):
    s = [("a", 0.5, 1, 100), ("b", 0.3, 2, 100), ("c", 0.2, 10, 100), ("none", 0.0, 9, 50)]
    assert fill(spark, s, None) == pytest.approx({"a": 100, "b": 60, "c": 40})
    assert fill(spark, s, 400) == pytest.approx({"a": 100, "b": 180, "c": 120})
    assert fill(spark, s, 700) == pytest.approx({"a": 100, "b": 200, "c": 400})
    assert fill(spark, s, 10_000) == pytest.approx({"a": 100, "b": 200, "c": 1000})
    assert fill(spark, s, mix.CORPUS) == pytest.approx({"a": 100, "b": 120, "c": 80})
    assert fill(spark, [("x", 0.5, 3, 0)], None) == {}
    assert fill(spark, [("x", 0.5, 3, 0), ("y", 0.5, 1, 10)], None) == pytest.approx({"y": 10})
    assert fill(spark, [("x", 0.5, 3, 0)], 100) == {}


@pytest.mark.parametrize("seed", range(3))
def test_water_filling_against_bisection(spark, seed):
    r = random.Random(seed)
    s = [(f"s{i}", r.random(), r.randrange(1, 5), r.randrange(1, 1000)) for i in range(30)]
    total = 0.6 * sum(m * n for _, _, m, n in s)
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(m * n, mid * w) for _, w, m, n in s) < total else (lo, mid)
    assert fill(spark, s, total) == pytest.approx({k: min(m * n, lo * w) for k, w, m, n in s})


def test_clamped_sources_in_a_mix(spark, docs):
    """The whole corpus as budget: two sources stand at their caps, the third takes up what they lack."""
    out, report = mix.mixture(docs, spark.createDataFrame([("a_one", 0.05, 9), ("b", 0.15, 1), ("tiny", 0.8, 1)], "source string, target_share double, max_repeats long"), mix.CORPUS, size=F.length("text"))
    rep = {r.source: r for r in report.collect()}
    assert rep["b"].mix_tokens == rep["b"].size_tokens and rep["tiny"].mix_tokens == rep["tiny"].size_tokens and rep["b"].reached_share < 0.15
    assert rep["a_one"].reached_share > 0.05 and sum(r.reached_share for r in rep.values()) == pytest.approx(1)
    assert sum(r.mix_tokens for r in rep.values()) == pytest.approx(sum(r.size_tokens for k, r in rep.items() if k in ("a_one", "b", "tiny")), rel=0.01)


DOCS = "doc_id long, source string, text string, n_tokens long, copies string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, "some words of text " * (1 + i % 7), 5, "clash") for s, a, b in (("A-one", 0, 300), (" a_ONE ", 300, 400), ("b", 400, 500), ("tiny", 500, 503), (None, 503, 510), ("other", 510, 520)) for i in range(a, b)]
    rows += [(600, "b", None, 1, ""), (601, "b", "", 1, ""), (602, "tiny", "long text " * 20_000, 1, "")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("a_one", 0.5, 1, "x"), ("b", 0.3, 4, "x"), ("tiny", 0.2, 2, "x"), ("missing", 0.1, 2, "x")], "source string, target_share double, max_repeats long, text string")


def test_shares_and_caps(spark, docs):
    out, report = mix.mixture(docs, targets(spark))
    rows = out.collect()
    most = {"a_one": 1, "b": 4, "tiny": 2}
    assert all(0 < r.copies <= most[r.source] and r.n_tokens > 0 for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    rep = {r.source: r for r in report.collect()}
    total = sum(r.n_tokens * r.copies for r in rows)
    for s in most:
        own = sum(r.n_tokens * r.copies for r in rows if r.source == s)
        assert rep[s].mix_tokens == own and rep[s].reached_share == pytest.approx(own / total)
    assert rep["a_one"].reached_share / rep["b"].reached_share == pytest.approx(0.5 / 0.3, rel=0.1)
    assert rep["missing"].reached_share == 0 and rep["other"].target_share == 0 and rep["other"].mix_tokens == 0
    again = mix.mixture(docs, targets(spark))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other = mix.mixture(docs, targets(spark), seed=2)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_budget_beyond_the_caps(spark, docs):
    _, report = mix.mixture(docs, targets(spark), total=10**9)
    rep = {r.source: r for r in report.collect()}
    for s, k in (("a_one", 1), ("b", 4), ("tiny", 2)):
        assert rep[s].mix_tokens == k * rep[s].size_tokens and rep[s].max_copies == k


def test_counts_are_the_tokenizer_s(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Hello  world, it's 12 o'clock!\n\n", "<|endoftext|> Ünï 中文", "", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mix.token_counts(df).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_empty(spark):
    out, report = mix.mixture(spark.createDataFrame([], DOCS), targets(spark))
    assert out.count() == 0 and report.count() == 4
