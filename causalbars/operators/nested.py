"""Deeply nested JSON records into related flat tables by columnar shredding.

A record is cut into one column per leaf path. Each entry of a column has a value, a repetition
level (the repeated ancestor at which it repeats; 0 begins a record) and a definition level (how many
of the optional or repeated ancestors are there). The flat table of a repeated ancestor is then
rebuilt from these level sequences alone."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """A scalar, kept as text (numbers as JSON writes them)."""

    name: str


@dataclass(frozen=True)
class Repeated:
    """An array of objects (a bare object counts as an array of one), or, with ``keyed``, a map whose
    keys become the leaf ``key``. ``encoded``: an element may be the JSON text of its object. ``bare``: the
    leaf that an element stands for which is only a string or number."""

    name: str
    leaves: tuple[Leaf, ...] = ()
    repeated: tuple["Repeated", ...] = ()
    keyed: bool = False
    encoded: bool = False
    skip: tuple[str, ...] = field(default=())
    bare: str | None = None


def _leaf_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def leaf_paths(node: Repeated, above: str = "", level: int = 1) -> list[tuple[str, str, int]]:
    """(leaf path, path of its repeated ancestor, that ancestor's repetition level), parents first."""
    at = f"{above}.{node.name}" if above else node.name
    names = ["key"] * node.keyed + [x.name for x in node.leaves]
    return [(f"{at}.{n}", at, level) for n in names] + [p for c in node.repeated for p in leaf_paths(c, at, level + 1)]


class Shredder:
    """Collects the level sequences of a batch of records. Per repetition level there is exactly one
    definition level: an element is there or not; a leaf adds one more if its value is not NULL."""

    def __init__(self, root: Repeated):
        self.root = root
        self.paths = leaf_paths(root)
        self.columns: dict[str, list[tuple[int, int, int, str | None]]] = {p: [] for p, _, _ in self.paths}

    def add(self, record: int, doc: object) -> None:
        """``doc``: what holds the root's elements (a dict for a keyed root)."""
        self._children(record, self.root, self.root.name, doc, 0, 0)

    def _elements(self, node: Repeated, v: object) -> list[tuple[str | None, object]]:
        if node.keyed:
            return [(k, x) for k, x in v.items() if k not in node.skip] if isinstance(v, dict) else []
        if isinstance(v, dict):
            return [(None, v)]
        if node.bare and isinstance(v, (str, int, float)):
            return [(None, v)]
        return [(None, x) for x in v] if isinstance(v, list) else []

    def _absent(self, record: int, node: Repeated, at: str, rep: int, level: int) -> None:
        for p, _, _ in leaf_paths(node, at.rpartition(".")[0], level):
            self.columns[p].append((record, rep, level - 1, None))

    def _children(self, record: int, node: Repeated, at: str, v: object, rep: int, above: int) -> None:
        level, elements = above + 1, self._elements(node, v)
        if not elements:
            self._absent(record, node, at, rep, level)
            return
        for k, x in elements:
            if node.encoded and isinstance(x, str):
                try:
                    y = json.loads(x)
                except ValueError:
                    y = x
                x = y if isinstance(y, (dict, str)) else x
            if node.bare and isinstance(x, (str, int, float)) and not (node.encoded and str(x).lstrip()[:1] in ("{", "[")):  # no cut-off object
                x = {node.bare: x}
            is_object = isinstance(x, dict)
            # an element that is no object keeps its position but is not defined at this level
            defined = level if is_object or node.keyed else level - 1
            if node.keyed:
                self.columns[f"{at}.key"].append((record, rep, level + 1, k))
            for leaf in node.leaves:
                text = _leaf_text(x.get(leaf.name)) if is_object else None
                self.columns[f"{at}.{leaf.name}"].append((record, rep, defined + (text is not None), text))
            for c in node.repeated:
                if defined == level:
                    self._children(record, c, f"{at}.{c.name}", x.get(c.name) if is_object else None, rep, level)
                else:
                    for p, _, _ in leaf_paths(c, at, level + 1):
                        self.columns[p].append((record, rep, defined, None))
            rep = level

    def levels(self, path: str) -> pd.DataFrame:
        return pd.DataFrame(self.columns[path], columns=["record", "rep", "def", "value"])


def positions(record: np.ndarray, rep: np.ndarray, levels: int) -> list[np.ndarray]:
    """The 0-based position at each repetition level 1..levels of every entry, from the repetition
    levels alone: an entry with rep = k advances level k; one with rep < k starts it afresh."""
    n, out = len(rep), []
    at = np.arange(n)
    for k in range(1, levels + 1):
        fresh = rep < k
        run = np.cumsum(rep == k)
        start = np.maximum.accumulate(np.where(fresh, at, 0)) if n else at
        out.append(run - run[start] if n else run)
    return out


def assemble(s: Shredder, table: str, outer: bool = False) -> pd.DataFrame:
    """The flat table of the repeated ancestor ``table`` (its path): the batch's record number, the
    position ``pos_k`` in every repeated ancestor, and the leaves of the ancestors and of itself.

    With ``outer``, a parent without elements gives one row with position -1."""
    own = [(p, lv) for p, at, lv in s.paths if at == table]
    if not own:
        raise KeyError(table)
    level = own[0][1]
    lead = s.levels(own[0][0])
    rec, rep, dfn = (lead[c].to_numpy(dtype=np.int64) for c in ("record", "rep", "def"))
    pos = positions(rec, rep, level)
    there = dfn >= level
    out = {"record": rec}
    for k, p in enumerate(pos, 1):
        out[f"pos_{k}"] = p
    for path, _ in own:
        out[path] = s.levels(path)["value"].to_numpy(dtype=object)
    for path, at, lv in s.paths:  # leaves of the ancestors: entry j of theirs holds while rep > lv
        if lv < level and table.startswith(at + "."):
            col = s.levels(path)
            out[path] = col["value"].to_numpy(dtype=object)[np.cumsum(rep <= lv) - 1] if len(rep) else np.zeros(0, dtype=object)
    df = pd.DataFrame(out)
    parent = dfn >= level - 1
    # an undefined element among defined ones (NULL in an array) is no missing list
    lone = np.ones(len(rep), dtype=bool)
    if len(rep):
        group = np.cumsum(rep < level)
        lone = np.bincount(group, minlength=group[-1] + 1)[group] == 1
    df.loc[~there, f"pos_{level}"] = -1
    return df[there | (parent & ~there & lone)] if outer else df[there]


def parse(text: object) -> object:
    """The decoded document; None if it is NULL, empty or no valid JSON."""
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def holder(text: object, under: str | None) -> dict | None:
    """What holds the root's elements: the decoded document, or its field ``under`` if that is an object or the JSON text
    of one; None if the text is no object."""
    doc = parse(text)
    if not isinstance(doc, dict) or not under:
        return doc if isinstance(doc, dict) else None
    inner = doc.get(under)
    inner = parse(inner) if isinstance(inner, str) else inner
    return inner if isinstance(inner, dict) else doc


def flat_table(df: DataFrame, key: str, json_col: str, root: Repeated, table: str, outer: bool = False, under: str | None = None) -> DataFrame:
    """The flat table of one repeated ancestor over all records of ``df``, in one pass, no shuffle.

    Columns: the key, ``pos_k`` per repeated ancestor and each leaf path with dots as underscores.
    ``under``: the root's elements may lie under this field. NULL, empty, cut-off or otherwise
    invalid documents give no rows; extra columns of ``df`` are not read; repeated rows repeat."""
    paths = leaf_paths(root)
    level = next(lv for _, at, lv in paths if at == table)
    leaves = [p for p, at, lv in paths if at == table] + [p for p, at, lv in paths if lv < level and table.startswith(at + ".")]
    names = ["record_key", *(f"pos_{k}" for k in range(1, level + 1)), *(p.replace(".", "_") for p in leaves)]
    schema = ", ".join([f"record_key {dict(df.select(key).dtypes)[key]}", *(f"pos_{k} bigint" for k in range(1, level + 1)), *(f"{p.replace('.', '_')} string" for p in leaves)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = Shredder(root)
            for i, text in enumerate(b["_doc"].to_numpy(dtype=object)):
                if (doc := holder(text, under)) is not None:
                    s.add(i, doc)
            t = assemble(s, table, outer)
            t.insert(0, "record_key", b["_key"].to_numpy(dtype=object)[t["record"].to_numpy(dtype=np.int64)])
            t = t.drop(columns="record").rename(columns={p: p.replace(".", "_") for p in leaves})
            yield t[names]

    return df.select(F.col(key).alias("_key"), F.col(json_col).alias("_doc")).mapInPandas(run, schema)


def shredded(df: DataFrame, key: str, json_col: str, root: Repeated, under: str | None = None) -> DataFrame:
    """The columns themselves: one row per entry with path, its number in the record, repetition level,
    definition level and value. ``Repeated`` documents come back exactly from these (see tests)."""
    schema = f"record_key {dict(df.select(key).dtypes)[key]}, path string, entry bigint, rep bigint, def bigint, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = Shredder(root)
            for i, text in enumerate(b["_doc"].to_numpy(dtype=object)):
                if (doc := holder(text, under)) is not None:
                    s.add(i, doc)
            keys = b["_key"].to_numpy(dtype=object)
            for p in s.columns:
                t = s.levels(p)
                t.insert(0, "record_key", keys[t["record"].to_numpy(dtype=np.int64)])
                t["path"], t["entry"] = p, t.groupby("record").cumcount()
                yield t[["record_key", "path", "entry", "rep", "def", "value"]]

    return df.select(F.col(key).alias("_key"), F.col(json_col).alias("_doc")).mapInPandas(run, schema)


#: The two documents of the experiment registry.
SENSITIVITY = Repeated(
    "entry",
    (Leaf("verdict"), Leaf("n_reversing_probes")),
    (
        Repeated(
            "probes",
            tuple(map(Leaf, ("parameter", "multiplier", "base", "value", "n_events"))),
            (
                Repeated(
                    "models",
                    tuple(map(Leaf, ("model", "uplift", "n_selected", "standardized_uplift"))),
                    (Repeated("by_year", (Leaf("year"), Leaf("uplift"))),),
                ),
            ),
        ),
    ),
    keyed=True,
    encoded=True,
    skip=("status", "groups"),
    bare="verdict",
)
VERIFICATION = Repeated(
    "entry",
    (Leaf("label"), Leaf("mode"), Leaf("research_results_valid")),
    (
        Repeated(
            "checks",
            (Leaf("family"), Leaf("status")),
            (Repeated("findings", (Leaf("code"), Leaf("severity"), Leaf("where")), (Repeated("where", (Leaf("fold"),), (Repeated("bars", (Leaf("bar"),), bare="bar"),)),)),),
        ),
    ),
    keyed=True,
    encoded=True,
    bare="label",
)


def registry_leaves(experiments: DataFrame) -> DataFrame:
    """Models of the sensitivity probes and findings of the verification checks, keyed by their parents."""
    models = flat_table(experiments, "experiment_id", "sensitivity_json", SENSITIVITY, "entry.probes.models", under="groups")
    findings = flat_table(experiments, "experiment_id", "verification_json", VERIFICATION, "entry.checks.findings", outer=True)
    a = models.select(
        F.col("record_key").alias("experiment_id"), F.lit("sensitivity").alias("doc_kind"), F.col("entry_key"), F.col("pos_2").alias("item_no"), F.col("pos_3").alias("sub_no"), F.col("entry_probes_models_model").alias("leaf_name")
    )
    b = findings.where("pos_2 >= 0").select(
        F.col("record_key").alias("experiment_id"),
        F.lit("verification").alias("doc_kind"),
        F.col("entry_key"),
        F.col("pos_2").alias("item_no"),
        F.col("pos_3").alias("sub_no"),
        F.when(F.col("pos_3") < 0, F.col("entry_checks_family")).otherwise(F.col("entry_checks_findings_code")).alias("leaf_name"),
    )
    return a.unionByName(b).distinct()


def registry_table(experiments: DataFrame, kind: str, table: str) -> DataFrame:
    """One table of the 'sensitivity' or 'verification' documents, each row once: ``experiment_id``,
    ``entry_key``, the position ``<name>_no`` in each repeated ancestor below the entry, and the leaves."""
    root, under = (SENSITIVITY, "groups") if kind == "sensitivity" else (VERIFICATION, None)
    t = flat_table(experiments, "experiment_id", f"{kind}_json", root, table, under=under).drop("pos_1")  # the order of a map means nothing
    names = {f"pos_{k}": f"{x}_no" for k, x in enumerate(table.split("."), 1)} | {"record_key": "experiment_id", "entry_key": "entry_key"}
    return t.select(*(F.col(c).alias(names.get(c, c.removeprefix("entry_"))) for c in t.columns)).distinct()


def registry_entries(experiments: DataFrame) -> DataFrame:
    """The entries of both documents, told apart by ``doc_kind``."""
    a, b = (registry_table(experiments, k, "entry").withColumn("doc_kind", F.lit(k)) for k in ("sensitivity", "verification"))
    return a.unionByName(b, allowMissingColumns=True)
