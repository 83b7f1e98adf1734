import numpy as np
import pytest

from causalbars.llm import reading

EASY = "the dog runs to the big red house and it is a good day for the cat on the mat we go to the shop and see a man".split()
HARD = "notwithstanding the epistemological heterogeneity of institutional misspecification which presupposes the asymptotic identifiability whereas contemporaneous generalization substantiates every methodological discontinuity throughout the intertemporal parameterization".split()


def text(level, seed, n=90):
    r = np.random.default_rng(seed)
    ws = [r.choice(HARD if r.random() < (level - 1) / 5 else EASY) for _ in range(n)]
    size = 6 + 4 * level
    return ". ".join(" ".join(ws[i : i + size]).capitalize() for i in range(0, n, size)) + "."


DOCS = "doc_id long, text string, lang string, level string"
GERMAN = "Der Bereich hält den Kurs und die Schwelle ist nicht über dem Abstand, wenn der Ausschuss es will und das Handeln sich nicht ändert."
FRENCH = "Le comité regarde les courbes et la règle ne change pas, car les seuils sont encore trop loin de la moyenne pour que nous puissions agir."
LOG = "\n".join(f"2021-01-19T10:44:{i:02d}Z INFO walkforward[2] the fold is in the registry and it was not of any use" for i in range(30))


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, text(1 + i % 5, i), "x", "y") for i in range(300)]
    rows += [(1000, None, "", ""), (1001, "", "", ""), (1002, LOG, "", ""), (1003, GERMAN, "", ""), (1004, "Too short.", "", ""), (1005, "| a | b |\n|---|---|\n| the | of |", "", "")]
    rows += [(1006, text(5, 9, 400) + "\n\n" + LOG[:140], "", ""), (1010, text(5, 9, 60) + "\n\n" + LOG, "", ""), (1007, "> " + text(5, 8) + "\n\n" + text(1, 7, 200), "", ""), (1008, (text(5, 6) + "\n\n") * 300, "", ""), (1009, text(5, 9).upper(), "", "")]
    rows += [rows[4]] + [(2000 + i, GERMAN, lang, "") for i, lang in enumerate(("de", "DE", " en ", None))] + [(2010, text(2, 77), "de", ""), (2011, FRENCH, "fr", "")]
    labels = [(i, 1 + i % 5, "r") for i in range(150)] + [(3, None, "r"), (7, 2, "r2"), (5000, 5, "r")]
    d = spark.createDataFrame(rows, DOCS)
    out = reading.reading_levels(d, spark.createDataFrame(labels, "doc_id long, grade_level long, text string")).collect()
    assert len(out) == len(rows)
    return {r.doc_id: r for r in out}


def test_held_out_levels(got):
    held = [(got[i].level, 1 + i % 5) for i in range(150, 300)]
    assert np.mean([(a >= 3.5) == (b >= 4) for a, b in held]) >= 0.9
    assert np.corrcoef(*zip(*held))[0, 1] > 0.9


def test_what_is_no_english_prose(got):
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1010, 2000, 2001, 2002, 2003, 2011):
        assert not got[i].is_english and got[i].level is None and got[i].score is None, i


def test_english_whatever_the_column_says(got):
    assert got[2010].is_english and all(got[i].is_english for i in range(300))


def test_language_without_labels(spark):
    rows = [(i, text(1 + i % 5, i)) for i in range(100)] + [(500, GERMAN), (501, FRENCH)]
    out = reading.reading_levels(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1 + i % 5) for i in range(40)], "doc_id long, grade_level long")).collect()
    assert {r.doc_id: r.is_english for r in out} == {i: i < 500 for i, _ in rows}


def test_own_prose_only(got):
    assert got[1006].level >= 3.5 and got[1008].level >= 3.5 and got[1009].level >= 3.5
    assert got[1007].level < 2.5


@pytest.mark.parametrize("share", [0.15, 0.25, 0.4])
def test_memos_with_log_lines_are_no_logs(share):
    lines = LOG.split("\n")
    per = len(lines[0].split())
    k = max(1, round(share / (1 - share) * 300 / per))
    memo = text(3, 11, 300)
    half = len(memo) // 2
    cut = memo.index(". ", half) + 2
    mixed = memo[:cut] + "\n" + "\n".join(lines[i % 30] for i in range(k)) + "\n" + memo[cut:]
    plain, got = reading.read([memo]), reading.read([mixed])
    assert got.prose.tolist() == [True] and got.at.tolist() == plain.at.tolist()
    # many tables and little prose: the log lines are still no more than a part
    table = "\n".join("| EXP | the of a | 12 | 13 |" for _ in range(60))
    assert reading.read([text(3, 11, 60) + "\n\n" + table + "\n\n" + "\n".join(lines[:8])]).prose.tolist() == [True]
    assert reading.read([text(3, 11, 60) + "\n\n" + LOG]).prose.tolist() == [False]


def test_marks_that_begin_sentences():
    for line in ("*Although* the fold is small it was kept", "-0.5 percent is what the fold has lost", "`fold` is the name that it was given", "#3 of the folds was the one at fault", "$5 is what the run costs"):
        assert reading.prose(line) == [line]
    for line in ("* the fold is small", "- the fold is small", "+ the fold", "# the fold", "## the fold", "> the fold is", "| the | fold |", "1. the fold", "`the fold is`", "$ cat fold", "• the fold"):
        assert reading.prose(line) == []


def test_isotonic():
    k, v = reading.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 5.0]))
    assert np.interp([1, 2, 3, 4], k, v).tolist() == [1.0, 2.5, 2.5, 5.0]


def test_ranker_orders_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    w = reading.rank_pairs(x, np.round(x @ [1.0, -2.0, 0.0]))
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * abs(w[1])


def test_no_labels_is_said(spark):
    d = spark.createDataFrame([(1, text(3, 1), "", "")], DOCS)
    with pytest.raises(ValueError):
        reading.reading_levels(d, spark.createDataFrame([], "doc_id long, grade_level long"))


def test_empty_documents(spark):
    m = reading.fit([text(1 + i % 5, i) for i in range(20)], np.array([1 + i % 5 for i in range(20)], float))
    s, v = m.level(reading.read([]))
    assert len(s) == len(v) == 0
