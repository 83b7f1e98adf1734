import json

from hypothesis import given, settings
from hypothesis import strategies as st

from causalbars.operators import nested
from causalbars.operators.nested import Leaf, Repeated

TREE = Repeated("a", (Leaf("x"),), (Repeated("b", (Leaf("y"),), (Repeated("c", (Leaf("z"),)),)),))


def rebuild(s: nested.Shredder, record: int):
    """The record from its level sequences alone."""
    b = {p: s.levels(p).query("record == @record")[["rep", "def", "value"]].to_numpy(object).tolist() for p in s.columns}
    out: list = []
    for rep, d, v in b["a.x"]:
        if d >= 1:
            out.append({"x": v, "b": []})
    at = -1
    for rep, d, v in b["a.b.y"]:
        at += rep <= 1
        if d >= 2:
            out[at]["b"].append({"y": v, "c": []})
    at, sub = -1, -1
    for rep, d, v in b["a.b.c.z"]:
        if rep <= 1:
            at, sub = at + 1, 0
        elif rep == 2:
            sub += 1
        if d >= 3:
            out[at]["b"][sub]["c"].append({"z": v})
    return out


leaf = st.none() | st.text(max_size=3)
docs = st.lists(st.fixed_dictionaries({"x": leaf, "b": st.lists(st.fixed_dictionaries({"y": leaf, "c": st.lists(st.fixed_dictionaries({"z": leaf}), max_size=3)}), max_size=3)}), max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.lists(docs, max_size=4))
def test_round_trip(records):
    s = nested.Shredder(TREE)
    for i, r in enumerate(records):
        s.add(i, r)
    for i, r in enumerate(records):
        assert rebuild(s, i) == r


def brute(sens, verif):
    out = set()
    for kind, text, lists, leaf in (("sensitivity", sens, ("probes", "models"), "model"), ("verification", verif, ("checks", "findings"), "code")):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            continue
        if not isinstance(doc, dict):
            continue
        if kind == "sensitivity" and isinstance(doc.get("groups"), dict):
            doc = doc["groups"]
        for k, e in doc.items():
            if isinstance(e, str):
                try:
                    e = json.loads(e)
                except ValueError:
                    continue
            if not isinstance(e, dict):
                continue
            as_list = lambda v: [v] if isinstance(v, dict) else v if isinstance(v, list) else []
            for i, item in enumerate(as_list(e.get(lists[0]))):
                if not isinstance(item, dict):
                    continue
                subs = as_list(item.get(lists[1]))
                for j, x in enumerate(subs):
                    if isinstance(x, dict):
                        out.add((kind, k, i, j, x.get(leaf)))
                if kind == "verification" and not subs:
                    out.add((kind, k, i, -1, item.get("family")))
    return out


CASES = [
    (None, ""), ("{}", "{"), ("[1]", "3"), ('{"A|U": "FAILED"}', '{"A|X": {"label": "PASS"}}'),
    ('{"status": "RUN", "groups": {"A|U": {"probes": [{"models": [{"model": "R"}, null, {"model": "S"}]}, {"models": []}, {}]}}}', '{"A|X": {"checks": {"family": "f", "findings": null}}}'),
    ('{"A|U": {"probes": {"models": {"model": "R", "by_year": {"year": 1}}}}}', '{"A|X": {"checks": [{"family": "f", "findings": {"code": "C", "where": {"fold": 1}}}, {"family": "g"}, null]}}'),
    (json.dumps({"B|L": json.dumps({"probes": [{"models": [{"uplift": 0.5}]}]})}), json.dumps({"B|X": json.dumps({"checks": [{"family": "h", "findings": []}]}), "C|X": "NOT_RUN"})),
]


def test_registry_documents(spark):
    df = spark.createDataFrame([(f"E{i}", a, b, "clash") for i, (a, b) in enumerate(CASES)] * 2, "experiment_id string, sensitivity_json string, verification_json string, entry_key string")
    got = {tuple(r) for r in nested.registry_leaves(df).collect()}
    want = {(f"E{i}", *x) for i, (a, b) in enumerate(CASES) for x in brute(a, b)}
    assert got == want and len(want) == 8
    assert nested.registry_leaves(df.limit(0)).count() == 0


def test_long_document_and_levels(spark):
    doc = json.dumps({f"K{i}": {"probes": [{"models": [{"model": "m" * 2000}] * 5}] * 5} for i in range(200)})
    df = spark.createDataFrame([("E", doc)], "k string, j string")
    assert nested.flat_table(df, "k", "j", nested.SENSITIVITY, "entry.probes.models").count() == 5000
    lv = nested.shredded(df, "k", "j", nested.SENSITIVITY).where("path = 'entry.probes.models.model'").groupBy("rep").count().collect()
    assert {r["rep"]: r["count"] for r in lv} == {0: 1, 1: 199, 2: 800, 3: 4000}


def test_registry_tables(spark):
    sens = {"status": "RUN", "groups": {"A|U": "FAILED", "B|U": json.dumps({"verdict": "OK", "probes": [{"parameter": "q", "models": [{"model": "R", "by_year": [{"year": 2019, "uplift": 0.5}, {"year": 2020}]}]}]}), "C|U": '{"verdict": "cut'}}
    verif = {"A|X": "NOT_RUN", "B|X": {"label": "PASS", "checks": [{"family": "f", "findings": [{"code": "C", "where": {"fold": 2, "bars": [7, 9]}}, {"code": "D"}]}, {"family": "g"}]}}
    rows = [("E", json.dumps(sens), json.dumps(verif)), ("E", json.dumps({"groups": dict(reversed(sens["groups"].items()))}), json.dumps(verif, indent=1)), ("F", '{"status": "RUN", "groups": null}', "{")]
    df = spark.createDataFrame(rows, "experiment_id string, sensitivity_json string, verification_json string")
    tell = lambda t, *c: sorted(map(tuple, t.select(*c).collect()), key=str)
    got = nested.registry_entries(df)
    assert tell(got, "experiment_id", "entry_key", "verdict", "label") == [("E", "A|U", "FAILED", None), ("E", "A|X", None, "NOT_RUN"), ("E", "B|U", "OK", None), ("E", "B|X", None, "PASS"), ("E", "C|U", None, None)]
    assert tell(nested.registry_table(df, "sensitivity", "entry.probes"), "entry_key", "probes_no", "probes_parameter", "verdict") == [("B|U", 0, "q", "OK")]
    assert tell(nested.registry_table(df, "sensitivity", "entry.probes.models.by_year"), "entry_key", "by_year_no", "probes_models_by_year_year", "probes_models_by_year_uplift") == [("B|U", 0, "2019", "0.5"), ("B|U", 1, "2020", None)]
    assert tell(nested.registry_table(df, "verification", "entry.checks"), "entry_key", "checks_no", "checks_family") == [("B|X", 0, "f"), ("B|X", 1, "g")]
    bars = nested.registry_table(df, "verification", "entry.checks.findings.where.bars")
    assert tell(bars, "checks_no", "findings_no", "checks_findings_where_fold", "bars_no", "checks_findings_where_bars_bar") == [(0, 0, "2", 0, "7"), (0, 0, "2", 1, "9")]


def test_encoded_root_in_columns_as_in_tables(spark):
    """A document whose ``groups`` is the JSON text of an object comes out of the columns as well."""
    import json

    doc = json.dumps({"status": "x", "groups": json.dumps({"A|UP": {"verdict": "OK", "probes": []}})})
    df = spark.createDataFrame([("e", doc)], "k string, j string")
    flat = nested.flat_table(df, "k", "j", nested.SENSITIVITY, "entry", under="groups").collect()
    cols = nested.shredded(df, "k", "j", nested.SENSITIVITY, under="groups").where("path = 'entry.verdict'").collect()
    assert [r.entry_verdict for r in flat] == [r.value for r in cols] == ["OK"]
