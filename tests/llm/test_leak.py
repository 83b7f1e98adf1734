import random

import numpy as np
import pytest

from causalbars.llm import leak
from causalbars.llm.text import words

WORDS = [f"w{a}{b}" for a in "bcdfghjk" for b in "aeioulmnrst"]
R = random.Random(5)
ITEM = [R.choice(WORDS) for _ in range(60)]
ANSWER = [R.choice(WORDS) for _ in range(20)]
SHORT = [R.choice(WORDS) for _ in range(8)]


def noise(n):
    r = random.Random(n)
    return [f"{r.choice('xyz')}{r.choice('aeiou')}{r.randrange(99)}" for _ in range(n)]


def wrap(ws, pre=30, post=30):
    return " ".join([*noise(pre), *ws, *noise(post)])


def run(spark, docs, items=None):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, prompt string, item_id long")
    it = spark.createDataFrame(items if items is not None else [(1, "Read this: " + " ".join(ITEM), " ".join(ANSWER), "c"), (2, None, " ".join(SHORT), "c"), (3, "", None, "c")], "item_id long, prompt string, answer string, text string")
    return {(r.doc_id, r.item_id): r for r in leak.leaks(d, it).collect()}


def changed(ws, at, how):
    ws = list(ws)
    for i in sorted(at, reverse=True):
        if how == "sub":
            ws[i] = "changed"
        elif how == "del":
            del ws[i]
        else:
            ws.insert(i, "added")
    return ws


@pytest.mark.parametrize("how", ["sub", "del", "ins"])
@pytest.mark.parametrize("start", [0, 11, 48])
def test_twelve_words_with_one_error(spark, how, start):
    docs = [(k, wrap(changed(ITEM[start : start + 12 + (how == "del")], [k], how))) for k in range(2, 11)]
    assert set(run(spark, docs)) == {(k, 1) for k in range(2, 11)}


def test_long_passages_with_errors(spark):
    docs = [(1, wrap(changed(ITEM, [5, 15, 25, 35, 45], "sub"))), (2, wrap(changed(ITEM[:30], [8, 17], "del"))), (3, wrap(ITEM[20:32])), (4, wrap(ANSWER, 0, 0))]
    assert set(run(spark, docs)) == {(i, 1) for i in (1, 2, 3, 4)}


def test_no_cases(spark):
    r = random.Random(1)
    shuffled = ITEM[:]
    r.shuffle(shuffled)
    docs = [(1, wrap(ITEM[:11])), (2, wrap(shuffled)), (3, wrap(changed(ITEM[:20], range(0, 20, 4), "sub"))), (4, wrap(SHORT)), (5, ""), (6, None), (7, wrap([]))]
    assert run(spark, docs) == {}


def test_forms(spark):
    base = ITEM[10:24]
    docs = [
        (1, wrap([w.upper() for w in base])),
        (2, wrap([f"<b>{base[0]}</b>", *(f"**{w}**," for w in base[1:])])),
        (3, wrap(base).replace(" ", " ")),
        (4, wrap([w.replace("a", "а").replace("o", "о").replace("e", "е") for w in base])),
        (5, wrap([w[:2] + "­" + w[2:] for w in base])),
        (6, wrap(base).replace(" ", "\\n")),
        (7, wrap(["".join(f"\\u{ord(c):04x}" for c in w) for w in base])),
        (8, wrap(["".join(chr(ord(c) + 0xFEE0) for c in w) for w in base])),
        (9, wrap(base).replace(" ", "&nbsp;<br/>")),
        (10, "\n> ".join(wrap(base).split())),
    ]
    assert set(run(spark, docs)) == {(i, 1) for i, _ in docs}


def test_repeats_very_long_and_reports(spark):
    long = " ".join([*noise(40_000), *ITEM[:40], *noise(40_000)])
    got = run(spark, [(1, long), (1, long), (2, wrap(ITEM[:15]) + " " + wrap(ITEM[30:50]))])
    assert got[(1, 1)].n_words == 40 and got[(1, 1)].n_errors == 0 and got[(1, 1)].at_word == 40_000 and got[(1, 1)].longest_verbatim == 40
    assert got[(2, 1)].n_words == 20


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, wrap(ITEM))], []) == {}


def texts(r, n, size, alphabet):
    return [(i, "prompt", " ".join(r.choice(alphabet) for _ in range(size))) for i in range(n)]


def test_suffix_array_and_searches_against_sorting():
    import bisect

    r = random.Random(2)
    items = leak.Items(texts(r, 6, 40, "abc"))
    ids = np.array([items.vocab.get(r.choice("abcd"), 0) if r.random() > 0.02 else -1 for _ in range(3000)])
    w, sa = leak.suffix_array(ids, items)

    def suffix(x, at):
        out = []
        while at < len(x) and x[at] > 0:
            out.append(int(x[at]))
            at += 1
        return out

    grams = {tuple(suffix(items.ids, q)[: leak.SEED]) for q in items.suffix}
    want = [p for p in range(len(ids)) if tuple(suffix(ids, p)[: leak.SEED]) in grams]
    assert sorted(sa.tolist()) == want and len(want) > 300
    got = [suffix(ids, p)[: items.depth] for p in sa]
    assert got == sorted(got)
    own = [suffix(items.ids, q) for q in items.suffix]
    assert own == sorted(own)
    for depth in (5, 7, 40):
        cut = [x[:depth] for x in got]
        lo, hi = (leak.bound(w, sa, items.w, items.suffix, depth, u) for u in (False, True))
        assert lo.tolist() == [bisect.bisect_left(cut, x[:depth]) for x in own] and hi.tolist() == [bisect.bisect_right(cut, x[:depth]) for x in own]
    n, place = leak.longest(w, sa, items.w, items.suffix, items.depth)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert n.tolist() == [max(common(x, y) for y in got) for x in own]
    assert all(common(suffix(ids, p), x) == k for p, x, k in zip(place, own, n))


def brute(ids, doc, items, least):
    """(text, document) of every passage around any verbatim run of SEED words or more, by all pairs of places."""
    out = set()
    for t, (a, size) in enumerate(zip(items.start.tolist(), items.length.tolist())):
        il = items.ids[a : a + size].tolist()
        for d in set(doc.tolist()):
            text = ids[doc == d].tolist()
            for q in range(size):
                for p in range(len(text)):
                    if text[p] != il[q] or (p and q and text[p - 1] == il[q - 1]):
                        continue
                    k = 0
                    while p + k < len(text) and q + k < size and text[p + k] == il[q + k]:
                        k += 1
                    if k < leak.SEED:
                        continue
                    right, left = leak._extend(text, il, p + k, q + k, 1), leak._extend(text, il, p - 1, q - 1, -1)
                    if any(k + x + y >= least and e + f <= leak.allowed(k + x + y) for x, e in right for y, f in left):
                        out.add((t, d))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_passages_against_all_pairs(seed):
    """Texts that share a stock phrase, in documents that hold pieces of them with errors."""
    r = random.Random(seed)
    stock = [r.choice(WORDS[:30]) for _ in range(r.choice([4, 8, 11]))]
    few = WORDS[: r.choice([6, 25, 80])]
    items = leak.Items([(i, "prompt", " ".join(stock + [r.choice(few) for _ in range(r.randrange(3, 45))])) for i in range(12)])
    parts = []
    for _ in range(60):
        t = r.randrange(12)
        a = int(items.start[t])
        ws = [f"{x}" for x in items.ids[a : a + int(items.length[t])].tolist()]
        lo = r.randrange(0, max(1, len(ws) - 11))
        ws = ws[lo : lo + r.randrange(8, 40)]
        for k in sorted((k for k in range(len(ws)) if r.random() < 0.11), reverse=True):
            ws = changed(ws, [k], r.choice(["sub", "del", "ins"]))
        body = [int(x) if x.isdigit() else 0 for x in ws]
        pre = [items.vocab.get(r.choice(few + ["unknown"]), 0) for _ in range(r.randrange(20))]
        parts.append([*pre, *body, *pre[::-1], -1])
    ids = np.array([x for p in parts for x in p])
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    got = {(t, int(doc[p])) for t, p, *_ in leak.find(ids, doc, items, 12)}
    want = brute(ids, doc, items, 12)
    assert got == want and len(want) > 10


def test_stock_phrase_pairs_nothing():
    """A phrase common to all texts and documents gives no candidates of its own."""
    r = random.Random(7)
    stock = WORDS[:8]
    items = leak.Items([(i, "prompt", " ".join([*stock, *(r.choice(WORDS[10:]) for _ in range(20))])) for i in range(400)])
    doc_words = [[items.vocab[x] for x in stock] + [0] * 10 + [-1] for _ in range(2000)]
    ids = np.array([x for d in doc_words for x in d])
    p, q, n = leak.candidates(ids, np.repeat(np.arange(2000), 19), items, 12)
    assert len(p) == 0


def test_passages_end_with_their_document(spark):
    assert run(spark, [(1, " ".join([*noise(10), *ITEM[:7]])), (2, " ".join([*ITEM[8:14], *noise(10)]))]) == {}


def test_items_in_blocks(spark):
    d = spark.createDataFrame([(i, wrap(ITEM[i : i + 15])) for i in range(8)], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(ITEM[i : i + 15]), None) for i in range(8)], "item_id long, prompt string, answer string")
    whole = {tuple(x) for x in leak.leaks(d, it).collect()}
    assert whole == {tuple(x) for x in leak.leaks(d, it, block_chars=200).collect()} and len(whole) > 8


def test_words():
    assert words("It&#39;s ﬁne — <i>x</i>\\u0041b exam-\nple 0.31") == ["it", "s", "fine", "xab", "example", "0", "31"]


def test_without_leaks(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    f = spark.createDataFrame([(1, 5), (1, 6)], "doc_id long, item_id long")
    assert [r.doc_id for r in leak.without_leaks(d, f).collect()] == [2]
