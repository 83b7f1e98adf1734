"""Evaluation texts leaking into a corpus: suffix arrays of the corpus, shard by shard.

A shard is a run of documents of one partition, of some SHARD_WORDS words. Its suffix array holds, in the order of
their words, the suffixes that begin with SEED words of some test text (any other shares no SEED words with one).
Every test suffix is binary-searched in it: its neighbours there tell its longest verbatim match, and
suffixes with SEED words or more in common stand in one interval around it. Verbatim matches of a whole passage come
straight from intervals. Shorter ones must go on beyond a changed, added or left-out word; test texts and
places are joined on the words on both sides of that gap, so that a phrase common to many texts pairs only those
which agree beyond it. What is left is extended word by word. Test texts travel as a broadcast, in blocks of
bounded size; documents are read once a block and never shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.llm.text import words

#: With at most n // 10 + 1/2 errors (rounded) in n >= 12 words the longest verbatim run has 5 or more.
SEED = 5
#: A run of LONG words or more may have a single word beyond its gap, a shorter one has two (see ``gap_pairs``).
LONG = 10
BLOCK_CHARS = 16_000_000  # characters of the test texts in one broadcast
SHARD_WORDS = 2_000_000
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))  # item words, document words
#: Gaps over which two words are looked for: two errors with a single right word between them take up to five words.
_GAPS = tuple((i, j) for i in range(6) for j in range(6) if i + j and abs(i - j) <= 2)


class Words:
    """Word numbers with a terminator before, between and after the texts: a number of 0 or less ends a suffix."""

    def __init__(self, ids: np.ndarray, bits: int):
        self.bits, self.per = bits, 62 // bits
        self.n = len(ids)
        self.ids = np.concatenate([np.maximum(ids, 0), np.zeros(4 * LONG + self.per, np.int64)])

    def at(self, place: np.ndarray) -> np.ndarray:
        """The word at each place; 0 outside."""
        return np.where((place >= 0) & (place < self.n), self.ids[np.clip(place, 0, self.n)], 0)

    def key(self, place: np.ndarray, n: int) -> np.ndarray:
        """``n`` words (at most ``per``) from each place as one number that sorts as they do; 0s after an end."""
        k = np.zeros(len(place), np.int64)
        live = np.ones(len(place), bool)
        for i in range(n):
            w = self.ids[np.minimum(place + i, self.n)]
            live &= w > 0
            k = (k << self.bits) | np.where(live, w, 0)
        return k

    def ended(self, key: np.ndarray) -> np.ndarray:
        return (key & ((1 << self.bits) - 1)) == 0


def sort_suffixes(w: Words, place: np.ndarray, depth: int) -> np.ndarray:
    """The places in the lexicographic order of their suffixes, of which ``depth`` words count at most.

    Some words at a time: only suffixes that are still tied are looked at further on."""
    order = place.copy()
    group = np.zeros(len(place), np.int64)
    tied = np.arange(len(place))
    for at in range(0, depth, w.per):
        if not len(tied):
            break
        sub, g = order[tied], group[tied]
        k = w.key(sub + at, w.per)
        o = np.lexsort((k, g))
        order[tied], k = sub[o], k[o]  # groups keep their places
        new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]
        size = np.diff(np.r_[np.flatnonzero(new), len(tied)])
        group[tied] = np.repeat(tied[new], size)
        tied = tied[np.repeat(size > 1, size) & ~w.ended(k)]
    return order


def _compare(a: Words, p: np.ndarray, b: Words, q: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0 or 1: how the suffixes of ``a`` at p, cut after ``depth`` words, stand to those of ``b`` at q."""
    out = np.zeros(len(p), np.int8)
    same = np.arange(len(p))
    for at in range(0, depth, a.per):
        n = min(a.per, depth - at)
        x, y = a.key(p[same] + at, n), b.key(q[same] + at, n)
        out[same] = np.sign(x - y)
        same = same[(x == y) & ~a.ended(x)]
        if not len(same):
            break
    return out


def bound(w: Words, sa: np.ndarray, of: Words, q: np.ndarray, depth: int, upper: bool = False) -> np.ndarray:
    """Binary search of each suffix ``q`` of ``of``, cut after ``depth`` words: the first index in ``sa`` whose suffix, cut
    likewise, is not less (``upper``: is greater)."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        c = _compare(w, sa[mid], of, q[live], depth)
        before = (c <= 0) if upper else (c < 0)
        lo[live] = np.where(before, mid + 1, lo[live])
        hi[live] = np.where(before, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def common(a: Words, p: np.ndarray, b: Words, q: np.ndarray) -> np.ndarray:
    """Number of equal words from p and q on."""
    n = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        x = a.at(p[live] + n[live])
        live = live[(x > 0) & (x == b.at(q[live] + n[live]))]
        n[live] += 1
    return n


def longest(w: Words, sa: np.ndarray, of: Words, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest verbatim match of each suffix q in the shard and its place there (-1: none): that with one of
    the two neighbours of where the suffix would stand."""
    n, place = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64)
    at = bound(w, sa, of, q, depth)
    for side in (at - 1, at):
        i = np.flatnonzero((side >= 0) & (side < len(sa)))
        m = common(w, sa[side[i]], of, q[i])
        better = m > n[i]
        n[i[better]], place[i[better]] = m[better], sa[side[i[better]]]
    return n, place


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] numbers) for each i."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Classes:
    """Test suffixes in lexicographic order, those that share their first ``depth`` words in one class."""

    def __init__(self, items: "Items", depth: int):
        long = np.flatnonzero(items.end - items.suffix >= depth)
        q = items.suffix[long]
        new = np.r_[True, _compare(items.w, q[1:], items.w, q[:-1], depth) != 0] if len(q) else np.zeros(0, bool)
        self.depth, self.q, self.begin, self.stop = depth, q, items.begin[long], items.end[long]
        self.cls = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(q)])

    def spans(self, w: Words, sa: np.ndarray, of: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the shard's suffix array that each class has; ``known`` classes only, others are empty."""
        lo, hi = np.zeros(len(self.first), np.int64), np.zeros(len(self.first), np.int64)
        q = self.q[self.first[known]]
        lo[known], hi[known] = bound(w, sa, of, q, self.depth), bound(w, sa, of, q, self.depth, upper=True)
        return lo, hi


class Items:
    """The test texts as word numbers, their suffixes in lexicographic order, and tables of what stands beyond gaps."""

    def __init__(self, rows: list[tuple[int, str, str]], least: int = 12):
        self.vocab: dict[str, int] = {}
        seqs, self.owner, self.field = [], [], []
        for item, name, text in rows:
            ws = words(text)
            if len(ws) >= SEED:
                seqs.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in ws], dtype=np.int64))
                self.owner.append(item)
                self.field.append(name)
        gap = np.array([-1], dtype=np.int64)
        self.start = np.cumsum([1, *(len(s) + 1 for s in seqs)])[:-1] if seqs else np.zeros(0, np.int64)
        self.length = np.array([len(s) for s in seqs], dtype=np.int64)
        self.ids = np.concatenate([gap, *(np.r_[s, gap] for s in seqs)]) if seqs else gap
        self.bits = max(2, (len(self.vocab) + 1).bit_length())
        self.w = Words(self.ids, self.bits)
        self.depth = int(self.length.max()) if seqs else 0
        n = np.maximum(self.length - SEED + 1, 0)
        self.suffix = sort_suffixes(self.w, _spread(self.start, n), self.depth)
        self.text = np.searchsorted(self.start, self.suffix, "right") - 1
        self.begin = self.start[self.text]
        self.end = self.begin + self.length[self.text]
        self.seeds = np.unique(seed_keys(self.ids)[self.suffix])
        self.classes = {d: Classes(self, d) for d in sorted({SEED, LONG, max(least, SEED)})}
        self.beyond = {(d, right, di): self._beyond(self.classes[d], n, right, di) for d, n, far in ((SEED, 2, 6), (LONG, 1, 3)) for right in (True, False) for di in range(far)}

    def _beyond(self, c: Classes, n: int, right: bool, di: int) -> "Beyond":
        step = 1 if right else -1
        edge = c.q + c.depth if right else c.q - 1  # the first word after (before) the run
        first = edge + step * di
        last = first + step * (n - 1)
        ok = np.flatnonzero((last < c.stop) if right else (last >= c.begin))
        return Beyond(gap_key(c.cls[ok], self.w, first[ok], n, step, len(self.vocab)), self.w.at(edge[ok]), c.q[ok], len(self.vocab))


class Beyond:
    """Test suffixes by class and the words beyond a gap, and among equal ones by the first word of the gap."""

    def __init__(self, key: np.ndarray, edge: np.ndarray, q: np.ndarray, vocab: int):
        self.key, rank = np.unique(key, return_inverse=True)
        code = rank * np.int64(vocab + 1) + edge
        o = np.argsort(code, kind="stable")
        self.code, self.q, self.vocab = code[o], q[o], vocab
        self.begin = np.r_[0, np.cumsum(np.bincount(rank, minlength=len(self.key)))] if len(key) else np.zeros(1, np.int64)

    def other(self, key: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the key sought, suffix) of equal keys whose gaps begin with different words."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        i = np.flatnonzero(self.key[r] == key)
        code = r[i] * np.int64(self.vocab + 1) + edge[i]
        a, b = self.begin[r[i]], self.begin[r[i] + 1]
        x, y = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        none = x == y
        x, y = np.where(none, a, x), np.where(none, a, y)
        first, n = np.r_[a, y], np.r_[x - a, b - y]
        return np.repeat(np.r_[i, i], n), self.q[_spread(first, n)]


def gap_key(cls: np.ndarray, w: Words, first: np.ndarray, n: int, step: int, vocab: int) -> np.ndarray:
    """One number for a class and ``n`` words; if it wraps around, equal words are compared later on anyway."""
    k = cls.astype(np.uint64)
    for i in range(n):
        k = k * np.uint64(vocab + 1) + w.at(first + step * i).astype(np.uint64)
    return k


def seed_keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key of the SEED words from each position on, to leave out suffixes that no test text can share."""
    n = len(ids)
    x = np.zeros(n, dtype=np.uint64)
    if n < SEED:
        return x
    v = ids.astype(np.uint64)
    h = np.zeros(n - SEED + 1, dtype=np.uint64)
    for k in range(SEED):
        h = (h ^ v[k : n - SEED + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    x[: n - SEED + 1] = h
    return x


def suffix_array(ids: np.ndarray, items: Items) -> tuple[Words, np.ndarray]:
    """The shard's words and its suffix array: places whose first SEED words stand in a row in some test text."""
    w = Words(ids, items.bits)
    if len(ids) < SEED or not len(items.seeds):
        return w, np.zeros(0, np.int64)
    # two steps: SEED known words in a row, then among those the keys
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    place = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED)
    key = seed_keys(ids)[place]
    j = np.minimum(np.searchsorted(items.seeds, key), len(items.seeds) - 1)
    return w, sort_suffixes(w, place[items.seeds[j] == key], items.depth)


def gap_pairs(w: Words, sa: np.ndarray, doc: np.ndarray, items: Items, c: Classes, lo: np.ndarray, hi: np.ndarray, n: int, gaps: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, test suffix) of one class that also agree in ``n`` words beyond a gap, after or before it, and not
    in the first word of the gap (they would be one longer run).

    No passage is lost. With k errors in n words a passage has at least n - k right ones in k + 1 runs. For one
    error and a run below LONG the other run has two words or more; the same holds beside the longest run if there
    are more errors, but for a single word between two errors, which counts into the gap here. A run of LONG or more
    has one."""
    size = hi - lo
    at = _spread(lo, size)
    place, cls = sa[at], np.repeat(np.arange(len(lo)), size)
    for right in (True, False):
        step = 1 if right else -1
        for di, dj in gaps:
            edge = place + c.depth if right else place - 1
            first = edge + step * dj
            last = first + step * (n - 1)
            ok = (last >= 0) & (last < len(doc))
            ok &= doc[np.clip(last, 0, len(doc) - 1)] == doc[place]
            ok &= (w.at(first) > 0) & (w.at(last) > 0)
            i = np.flatnonzero(ok)
            at, q = items.beyond[(c.depth, right, di)].other(gap_key(cls[i], w, first[i], n, step, len(items.vocab)), w.at(edge[i]))
            yield place[i[at]], q


def runs(w: Words, items: Items, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal verbatim runs (place, place in the test texts, length) around pairs of equal words, each once."""
    p, q = p.copy(), q.copy()
    live = np.arange(len(p))
    while len(live):
        x = w.at(p[live] - 1)
        live = live[(x > 0) & (x == items.w.at(q[live] - 1))]
        p[live] -= 1
        q[live] -= 1
    key = np.unique(p * np.int64(len(items.ids)) + q)
    p, q = key // len(items.ids), key % len(items.ids)
    return p, q, common(w, p, items.w, q)


def candidates(ids: np.ndarray, doc: np.ndarray, items: Items, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verbatim runs that may belong to a passage; see the module."""
    w, sa = suffix_array(ids, items)
    none = np.zeros(0, np.int64)
    if not len(sa):
        return none, none, none
    seeds = items.classes[SEED]
    n, _ = longest(w, sa, items.w, seeds.q, items.depth)
    most = np.maximum.reduceat(n, seeds.first)  # of each class of SEED words the longest match
    lo, hi = seeds.spans(w, sa, items.w, most >= SEED)
    found = list(gap_pairs(w, sa, doc, items, seeds, lo, hi, 2, _GAPS))
    for depth in {LONG, max(least, SEED)}:
        c = items.classes[depth]
        if not len(c.q):
            continue
        lo, hi = c.spans(w, sa, items.w, most[_class_of(seeds, c)] >= depth)
        if depth == LONG:
            found += gap_pairs(w, sa, doc, items, c, lo, hi, 1, _STEPS)
        if depth == max(least, SEED):  # each is a passage by itself
            size = hi - lo
            for k in np.flatnonzero(size):
                qs = c.q[c.first[k] : c.first[k] + c.size[k]]
                found.append((np.tile(sa[lo[k] : hi[k]], len(qs)), np.repeat(qs, size[k])))
    return runs(w, items, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _class_of(outer: Classes, inner: Classes) -> np.ndarray:
    """The class of fewer words that each class of more words belongs to."""
    order = np.argsort(outer.q, kind="stable")
    return outer.cls[order[np.searchsorted(outer.q[order], inner.q[inner.first])]]


def _extend(doc: np.ndarray, item: np.ndarray, j: int, i: int, step: int) -> list[tuple[int, int]]:
    """From the word after (before, for step -1) a match on: (item words covered, errors) at each end of
    a run of equal words."""

    def run(i: int, j: int) -> int:
        n = 0
        while 0 <= i < len(item) and 0 <= j < len(doc) and item[i] == doc[j]:
            i, j, n = i + step, j + step, n + 1
        return n

    out, covered, errors = [(0, 0)], 0, 0
    while True:
        best = None
        for di, dj in _STEPS:
            n = run(i + step * di, j + step * dj)
            if n and (best is None or n - 2 * max(di, dj) > best[0]):
                best = (n - 2 * max(di, dj), di, dj, n)
        if best is None:
            return out
        _, di, dj, n = best
        covered, errors = covered + di + n, errors + max(di, dj)
        i, j = i + step * (di + n), j + step * (dj + n)
        out.append((covered, errors))


def allowed(n: int) -> int:
    """Errors in a passage of n words: one in ten, rounded."""
    return (n + 5) // 10


def find(ids: np.ndarray, doc: np.ndarray, items: Items, least: int) -> list[tuple[int, int, int, int, int]]:
    """(test text, place, words of the test text covered, errors, longest verbatim run) of the best passage around each
    run that holds at least ``least`` words. ``doc``: the number of each word's document."""
    p, q, n = candidates(ids, doc, items, least)
    t = np.searchsorted(items.start, q, "right") - 1
    out = []
    for p0, q0, t0, n0 in zip(p.tolist(), q.tolist(), t.tolist(), n.tolist()):
        a = int(items.start[t0])
        item = items.ids[a : a + int(items.length[t0])]
        w0, w1 = max(0, p0 - 2 * len(item)), min(len(ids), p0 + n0 + 2 * len(item))
        own = doc[w0:w1] == doc[p0]  # a passage ends with its document
        w0, w1 = w0 + int(own.argmax()), w1 - int(own[::-1].argmax())
        text, il = ids[w0:w1].tolist(), item.tolist()
        right = _extend(text, il, p0 + n0 - w0, q0 - a + n0, 1)
        left = _extend(text, il, p0 - 1 - w0, q0 - a - 1, -1)
        best = max(((n0 + r + x, e + f) for r, e in right for x, f in left if e + f <= allowed(n0 + r + x)), default=(0, 0))
        if best[0] >= least:
            out.append((t0, p0, best[0], best[1], n0))
    return out


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document that holds a passage of a test item, with the item: ``doc_id, item_id, field,
    n_words, n_errors, longest_verbatim, at_word`` of the longest passage.

    A passage: ``least`` or more words in a row of the item's prompt or answer, in order, at most one in
    ten of them (rounded) changed, added or left out. Case, punctuation, spacing, markup, escapes and
    character forms don't count. NULL and empty texts hold nothing; long texts are searched whole;
    repeated rows repeat; extra columns are not read. Items of any size: they are searched for in blocks of
    about ``block_chars`` characters, each block broadcast in its turn."""
    size = F.length(F.coalesce("prompt", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
    total = eval_items.agg(F.sum(size.cast("long"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    texts = eval_items.select("item_id", "prompt", "answer", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("_block"))
    out = None
    for i in range(blocks):
        found = _leaks_of(documents, texts.where(F.col("_block") == i), least, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of(documents: DataFrame, texts: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    rows = texts.select("item_id", "prompt", "answer").collect()  # one block
    items = Items([(r["item_id"], f, r[f]) for r in rows for f in ("prompt", "answer") if r[f]], least)
    sent = documents.sparkSession.sparkContext.broadcast(items)
    types = dict(documents.select(id_col).dtypes) | dict(texts.dtypes)
    schema = f"doc_id {types[id_col]}, item_id {types['item_id']}, field string, n_words int, n_errors int, longest_verbatim int, at_word int"

    def search(keys: list, parts: list[np.ndarray]) -> pd.DataFrame:
        items = sent.value
        length = np.array([len(x) for x in parts], dtype=np.int64)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        doc, start = np.repeat(np.arange(len(parts)), length), np.cumsum(length) - length
        best: dict[tuple[int, int], tuple] = {}
        for t, p, n, e, v in find(ids, doc, items, least):
            d = int(doc[p])
            k = (d, items.owner[t])
            if k not in best or (n, -e) > best[k][3:5]:
                best[k] = (keys[d], items.owner[t], items.field[t], n, -e, v, p - int(start[d]))
        return pd.DataFrame([(a, i, f, n, -e, v, p) for a, i, f, n, e, v, p in best.values()], columns=["doc_id", "item_id", "field", "n_words", "n_errors", "longest_verbatim", "at_word"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = sent.value.vocab
        keys, parts, n = [], [], 0
        for b in batches:
            for key, text in zip(b["_id"].to_numpy(dtype=object), b["_text"].to_numpy(dtype=object)):
                ws = words(text) if isinstance(text, str) else []
                keys.append(key)
                parts.append(np.array([*map(number.get, ws, repeat(0)), -1], dtype=np.int64))
                n += len(ws) + 1
            if n >= SHARD_WORDS:
                yield search(keys, parts)
                keys, parts, n = [], [], 0
        yield search(keys, parts)

    return documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no passage of any test item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
