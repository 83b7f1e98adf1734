"""Reading level of English prose: a linear pairwise ranker calibrated by isotonic regression.

What is English, and how hard a word is, are learned as well: words by the grades of the documents that hold
them, the language from bounded samples of texts labelled English and otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.llm.text import _TAG, _tag, plain

#: At most so many labelled documents (the first by a seeded hash of their id) train the ranker.
MAX_LABELLED = 6000
MAX_PAIRS = 60_000  # seeded pairs of those that the ranker sees
#: At most so many texts labelled English, and so many labelled otherwise, teach what English is.
MAX_LANGUAGE = 1500
SEED = 17
LEAST_WORDS = 12
#: A text in which log lines are more than this share of all tokens, those of lists, quotes and tables included, is a log.
LOG_SHARE = 0.5

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*\d\d:\d\d:\d\d\b|^\s*(?:INFO|WARN|ERROR|FAIL|DEBUG)\b")
# marks of lists, headings and prompts end with a blank: *emphasis*, -0.5 or `name` may begin a sentence
_SKIP = re.compile(r"^\s*(?:[-*+$]\s|#{1,6}\s|[•|>]|\d+[.)]\s|```|`[^`]*`\s*$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"\S+")
_END = re.compile(r"[.!?;]+[\"'”’)\]]*(?=\s|$)")


def prose(text: str | None) -> list[str]:
    """The paragraphs of running prose in a text: no code, tables, lists, quotes, headings, log lines or
    lines of a single token. Wrapped lines stay together."""
    return scan(text)[0]


def scan(text: str | None) -> tuple[list[str], int, int]:
    """``prose``, the number of tokens in log lines, and that in all lines outside of code."""
    if not text:
        return [], 0, 0
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if m[2].lower() in ("p", "div", "li", "tr", "h1", "h2", "h3") else _tag(m), text)
    out, cur, logged, total = [], [], 0, 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line or line.isspace():
            if cur:
                out.append("\n".join(cur))
                cur = []
            continue
        n = len(line.split())
        total += n
        if _LOG.match(line):
            logged += n
        elif n >= 2 and not _SKIP.match(line):
            cur.append(line)
    if cur:
        out.append("\n".join(cur))
    return out, logged, total


class Words:
    """Words of a batch as numbers."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []

    def number(self, ws: list[str]) -> list[int]:
        index, names, out = self.index, self.names, []
        for w in ws:
            i = index.get(w)
            if i is None:
                i = index[w] = len(names)
                names.append(w)
            out.append(i)
        return out

    def lengths(self) -> np.ndarray:
        return np.array([len(w) for w in self.names], dtype=float)


def _sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.r_[0.0, np.cumsum(x)]
    return c[at[1:]] - c[at[:-1]]


@dataclass
class Batch:
    """Per document: its words as numbers and counts; see ``read``."""

    words: Words
    ids: np.ndarray
    at: np.ndarray  # bounds of the documents in ids
    par: np.ndarray  # bounds of the paragraphs in ids
    par_doc: np.ndarray
    sentences: np.ndarray
    commas: np.ndarray
    prose: np.ndarray  # whether it is a text with prose of its own, and no log with something pasted in


def read(texts: list[str | None]) -> Batch:
    ws, ids, at, par, par_doc, sentences, commas, logs = Words(), [], [0], [0], [], [], [], []
    for d, text in enumerate(texts):
        s = c = 0
        paragraphs, logged, total = scan(text)
        logs.append(logged > LOG_SHARE * total)
        for p in paragraphs:
            p = plain(p) if ("&" in p or "\\" in p or not p.isascii() or "*" in p or "_" in p) and _mostly_ascii(p) else p.lower()
            got = _WORD.findall(p)
            if len(got) < 3:
                continue
            ids += ws.number(got)
            par.append(len(ids))
            par_doc.append(d)
            s += max(1, len(_END.findall(p)))
            c += p.count(",")
        at.append(len(ids))
        sentences.append(s)
        commas.append(c)
    at = np.array(at)
    return Batch(ws, np.array(ids, dtype=np.int64), at, np.array(par), np.array(par_doc, dtype=np.int64), np.array(sentences, float), np.array(commas, float), (at[1:] - at[:-1] >= LEAST_WORDS) & ~np.array(logs, bool))


class English:
    """Words weighed for and against English: a naive Bayes classifier. Words of neither side say nothing. Without any
    texts of the other side a text is English if more of its words are known than not."""

    def __init__(self, yes: list[str | None], no: list[str | None], smooth: float = 0.5, trims: int = 3):
        b, c = read(yes), read(no)
        names = sorted({*b.words.names, *c.words.names})
        index = {w: i for i, w in enumerate(names)}
        v = len(names)
        counts = []
        for x in (b, c):
            code = np.array([index[w] for w in x.words.names], dtype=np.int64)[x.ids] if len(x.ids) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(x.at) - 1), x.at[1:] - x.at[:-1])
            counts.append((code, doc, len(x.at) - 1))
        keep = [np.ones(n, bool) for _, _, n in counts]
        for _ in range(trims):  # labels err: a text that the others contradict teaches nothing the next time
            n = [np.bincount(code[k[doc]], minlength=v) + smooth for (code, doc, _), k in zip(counts, keep)]
            w = np.log(n[0] / n[0].sum()) - np.log(n[1] / n[1].sum())
            said = [np.bincount(doc, weights=w[code], minlength=k) for code, doc, k in counts]
            keep = [said[0] >= 0, said[1] <= 0]
        some = bool(len(counts[1][0]))
        self.weight, self.unseen = dict(zip(names, w.tolist() if some else np.ones(v).tolist())), 0.0 if some else -1.0

    def __call__(self, b: Batch) -> np.ndarray:
        w = np.array([self.weight.get(x, self.unseen) for x in b.words.names])
        return b.prose & (_sum(w[b.ids], b.at) > 0) if len(b.ids) else np.zeros(len(b.at) - 1, bool)


def _mostly_ascii(p: str) -> bool:
    """Umlauts and accents tell languages apart; look-alike letters and soft hyphens are to be undone."""
    return p.isascii() or any("\u0370" <= c <= "\u04ff" or c in "\xad\u200b\u200c\u200d\ufeff\xa0" or c > "\uff00" for c in p)


NAMES = ("length", "long8", "long11", "sentence", "commas", "lexicon", "hard", "par_length", "par_lexicon")


def features(b: Batch, lexicon: dict[str, float] | None, own: np.ndarray | None = None) -> np.ndarray:
    """(documents, len(NAMES)). ``own``: per word position the word's difficulty, if it differs by document."""
    length = b.words.lengths()
    k = len(b.at) - 1
    n = np.maximum(b.at[1:] - b.at[:-1], 1).astype(float)
    if not len(b.ids):
        return np.zeros((k, len(NAMES)))
    diff = own
    if diff is None:
        base = prior(length)
        diff = np.array([(lexicon or {}).get(w, base[i]) for i, w in enumerate(b.words.names)])[b.ids]
    wl = length[b.ids]
    s = np.maximum(b.sentences, 1)
    pn = np.maximum(b.par[1:] - b.par[:-1], 1)
    return np.stack(
        [
            _sum(wl, b.at) / n,
            _sum((wl >= 8) * 1.0, b.at) / n,
            _sum((wl >= 11) * 1.0, b.at) / n,
            np.log(np.maximum(n / s, 1)),
            b.commas / n,
            _sum(diff, b.at) / n,
            _sum((diff >= 3.6) * 1.0, b.at) / n,
            _weighted_median(_sum(wl, b.par) / pn, pn, b.par_doc, k),
            _weighted_median(_sum(diff, b.par) / pn, pn, b.par_doc, k),
        ],
        axis=1,
    )


def _weighted_median(x: np.ndarray, w: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(k)
    order = np.lexsort((x, doc))
    x, w, doc = x[order], w[order].astype(float), doc[order]
    c = np.cumsum(w)
    start = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    before = (c - w)[start]
    first = np.flatnonzero(start)
    end = np.r_[first[1:], len(x)]
    for a, e, b0 in zip(first, end, before):
        total = c[e - 1] - b0
        out[doc[a]] = x[a + np.searchsorted(c[a:e] - b0, total / 2)]
    return out


def prior(length: np.ndarray) -> np.ndarray:
    """Difficulty of a word that no labelled document holds, by its length."""
    return np.clip(2.4 + 0.16 * (np.asarray(length, float) - 5), 2.2, 4.6)


def learn_lexicon(b: Batch, grade: np.ndarray, weight: float = 6.0) -> tuple[dict[str, float], np.ndarray]:
    """Difficulty of each word: the mean grade of the labelled documents that hold it, drawn towards the
    prior of its length; and, per position, the same without the document itself."""
    v = len(b.words.names)
    doc = np.repeat(np.arange(len(b.at) - 1), b.at[1:] - b.at[:-1])
    pair, inv = np.unique(doc * v + b.ids, return_inverse=True)
    pd_, pw = pair // v, pair % v
    g = grade[pd_]
    n = np.bincount(pw, minlength=v).astype(float)
    s = np.bincount(pw, weights=g, minlength=v)
    base = prior(b.words.lengths())
    full = (s + weight * base) / (n + weight)
    without = (s[pw] - g + weight * base[pw]) / (n[pw] - 1 + weight)
    return dict(zip(b.words.names, full.tolist())), without[inv]


def rank_pairs(x: np.ndarray, grade: np.ndarray, seed: int = SEED, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights of a linear ranker: logistic loss on differences of pairs with different grades, by Newton
    steps; pairs are weighted by the difference of their grades."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(x), (2, MAX_PAIRS))
    keep = np.abs(grade[i] - grade[j]) >= 0.5
    i, j = i[keep], j[keep]
    sign = np.sign(grade[i] - grade[j])
    d = (x[i] - x[j]) * sign[:, None]
    wt = np.ones(len(d))
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(d) else 0):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = -(d * (wt * p)[:, None]).sum(0) / len(d) + ridge * w
        h = (d * (wt * p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, level) of the non-decreasing fit."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[o].tolist(), y[o].tolist()):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, n1, _, hi = blocks.pop()
            v0, n0, lo, _ = blocks.pop()
            blocks.append([(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, lo, hi])
    return np.array([[b[2], b[3]] for b in blocks]).reshape(-1), np.repeat([b[0] for b in blocks], 2)


@dataclass
class Model:
    english: English
    lexicon: dict[str, float]
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def level(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        score = (features(b, self.lexicon) - self.mean) / self.sd @ self.weights
        return score, np.interp(score, self.knots, self.levels)


def fit(texts: list[str | None], grade: np.ndarray, english: list[str | None] = (), other: list[str | None] = ()) -> Model:
    """``grade``: mean grade of each labelled document; all of these are English. ``english`` and ``other``: more texts
    labelled so."""
    b = read(texts)
    use = b.at[1:] - b.at[:-1] >= LEAST_WORDS
    lexicon, own = learn_lexicon(b, grade)
    x = features(b, None, own)[use]
    g = grade[use]
    if not len(g):
        raise ValueError("no labelled document has prose")
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = (x - mean) / sd
    w = rank_pairs(z, g, ridge=0.3 / np.sqrt(max(len(g), 1)))
    knots, levels = isotonic(z @ w, g)
    return Model(English([*texts, *english], list(other)), lexicon, mean, sd, w, knots, levels)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most MAX_LABELLED graded documents, several raters' grades averaged, and MAX_LANGUAGE texts a side
    of a language column, if there is one."""
    grades = labels.where("grade_level is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.avg("grade_level").alias("grade"))
    some = grades.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(MAX_LABELLED)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(some, "_id").where("text is not null").dropDuplicates(["_id"]).orderBy("_id").toPandas()
    told: list[list[str]] = [[], []]
    if lang_col in documents.columns:
        name = F.regexp_extract(F.lower(F.trim(lang_col)), "^[a-z]{2}", 0)
        for i, of in enumerate((name == "en", (name != "en") & (name != ""))):
            some = documents.where(of & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(SEED)).alias("h"), F.col(id_col).alias("_id"))
            told[i] = [r["text"] for r in some.orderBy("h", "_id").limit(MAX_LANGUAGE).select("text").collect()]
    return fit(rows["text"].tolist(), rows["grade"].to_numpy(float), *told)


def reading_levels(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, is_english, score, level`` of every document's own prose.

    ``n_words`` counts words of running prose (see ``prose``); ``is_english`` is told by its words,
    whatever the language column says of it (a sample of that column teaches the words); ``score`` is the ranker's, ``level`` its calibrated grade. A
    text without prose (NULL, empty, a log even if prose is pasted in, a table) or of fewer than LEAST_WORDS words has NULL score
    and level; so has prose in another language. Repeated rows repeat; texts are read whole. The model
    is fitted once and travels as a broadcast: its size is bounded by MAX_LABELLED and MAX_LANGUAGE documents.
    Without any labelled prose a ValueError says so."""
    sent = documents.sparkSession.sparkContext.broadcast(train(documents, labels, id_col, text_col, lang_col))
    schema = f"doc_id {dict(documents.select(id_col).dtypes)[id_col]}, n_words int, is_english boolean, score double, level double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for p in batches:
            b = read([t if isinstance(t, str) else None for t in p["_text"]])
            score, level = model.level(b)
            english = model.english(b)
            yield pd.DataFrame(
                {
                    "doc_id": p["_id"],
                    "n_words": (b.at[1:] - b.at[:-1]).astype(np.int32),
                    "is_english": english,
                    "score": np.where(english, score, np.nan),
                    "level": np.where(english, level, np.nan),
                }
            )

    out = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("score", "level")})
