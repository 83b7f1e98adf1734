"""The p1, p2, p4 and p5 queries: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.operators import grid, lineage, nested, spikes
from causalbars.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "bars"), table(spark, d, "instruments")).where("reason is not null").select("bar_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    h = lineage.hierarchy(table(spark, d, "experiments"), "experiment_id", "lineage_parent")
    return h.select(F.col("id").alias("experiment_id"), "root_id", "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    h = lineage.hierarchy(table(spark, d, "experiments"), "experiment_id", "lineage_parent", with_paths=True)
    return h.select(F.col("id").alias("experiment_id"), "root_id", "depth", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return lineage.descendants(table(spark, d, "experiments"), "experiment_id", "lineage_parent", marked=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_leaves(table(spark, d, "experiments"))


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_entries(table(spark, d, "experiments"))


def p4_probes(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_table(table(spark, d, "experiments"), "sensitivity", "entry.probes")


def p4_models(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_table(table(spark, d, "experiments"), "sensitivity", "entry.probes.models")


def p4_by_year(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_table(table(spark, d, "experiments"), "sensitivity", "entry.probes.models.by_year")


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_table(table(spark, d, "experiments"), "verification", "entry.checks")


def p4_findings(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_table(table(spark, d, "experiments"), "verification", "entry.checks.findings")


def p4_bars(spark: SparkSession, d: str) -> DataFrame:
    return nested.registry_table(table(spark, d, "experiments"), "verification", "entry.checks.findings.where.bars")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "bars"), table(spark, d, "instruments")).where("state <> 'reading'").select("series_id", "slot_ns")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "bars"), table(spark, d, "instruments"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_paths, p2_descendants, p4_found, p4_entries, p4_probes, p4_models, p4_by_year, p4_checks, p4_findings, p4_bars, p5_found, p5_grid)}

P1_SQL = """
WITH b AS (
  SELECT bar_id, series_id, index_ns, open, high, low, close, volume, coalesce(tick_size, 0) AS tick
  FROM bars LEFT JOIN instruments USING (symbol)),
firsts AS (
  SELECT * FROM b WHERE close > 0 QUALIFY row_number() OVER (PARTITION BY series_id, index_ns ORDER BY bar_id) = 1),
usual AS (
  SELECT series_id, median(abs(mv)) AS move FROM (
    SELECT series_id, close - lag(close) OVER (PARTITION BY series_id ORDER BY index_ns) AS mv FROM firsts) GROUP BY series_id),
vols AS (SELECT series_id, median(volume) AS vol FROM b GROUP BY series_id),
mid0 AS (
  SELECT series_id, index_ns, median(close) OVER (PARTITION BY series_id ORDER BY index_ns ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM firsts),
lev AS (
  SELECT b.series_id, b.index_ns, arg_min(b.close, abs(b.close - med)) AS lev
  FROM b JOIN mid0 USING (series_id, index_ns) WHERE b.close > 0 GROUP BY ALL),
mid AS (
  SELECT *, median(lev) OVER (PARTITION BY series_id ORDER BY index_ns ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM lev),
stamps AS (
  SELECT series_id, index_ns, row_number() OVER (PARTITION BY series_id ORDER BY index_ns) AS t
  FROM (SELECT DISTINCT series_id, index_ns FROM b WHERE coalesce(high, low, close) IS NOT NULL)),
norm AS (
  SELECT s.series_id, s.index_ns, t, CASE WHEN abs(lev - med) <= 11 * move THEN lev END AS lev
  FROM stamps s LEFT JOIN mid USING (series_id, index_ns) LEFT JOIN usual USING (series_id)),
around AS (
  SELECT series_id, index_ns, t,
    last_value(lev IGNORE NULLS) OVER pre AS l0, last_value(CASE WHEN lev IS NOT NULL THEN t END IGNORE NULLS) OVER pre AS t0,
    first_value(lev IGNORE NULLS) OVER post AS l1, first_value(CASE WHEN lev IS NOT NULL THEN t END IGNORE NULLS) OVER post AS t1
  FROM norm
  WINDOW pre AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         post AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
spike AS (
  SELECT bar_id FROM b JOIN around USING (series_id, index_ns) JOIN usual USING (series_id)
  WHERE coalesce(t1, t + 1) - coalesce(t0, t - 1) - 1 <= 3 AND (t0 IS NOT NULL OR t1 IS NOT NULL) AND (
    (coalesce(abs(high - l0) > 22 * move, t0 IS NULL AND high IS NOT NULL) AND coalesce(abs(high - l1) > 22 * move, t1 IS NULL AND high IS NOT NULL))
    OR (coalesce(abs(low - l0) > 22 * move, t0 IS NULL AND low IS NOT NULL) AND coalesce(abs(low - l1) > 22 * move, t1 IS NULL AND low IS NOT NULL))
    OR (coalesce(abs(close - l0) > 22 * move, t0 IS NULL AND close IS NOT NULL) AND coalesce(abs(close - l1) > 22 * move, t1 IS NULL AND close IS NOT NULL)))),
q AS (
  SELECT DISTINCT series_id, index_ns, high, low, close, dense_rank() OVER (PARTITION BY series_id ORDER BY index_ns) AS t
  FROM b WHERE high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL),
qr AS (SELECT *, t - row_number() OVER (PARTITION BY series_id, high, low, close ORDER BY t) AS g FROM q),
qn AS (SELECT *, count(*) OVER (PARTITION BY series_id, high, low, close, g) AS n FROM qr),
v AS (
  SELECT DISTINCT series_id, index_ns, volume, dense_rank() OVER (PARTITION BY series_id ORDER BY index_ns) AS t FROM b WHERE volume IS NOT NULL),
vr AS (SELECT *, t - row_number() OVER (PARTITION BY series_id, volume ORDER BY t) AS g FROM v),
vn AS (SELECT *, count(*) OVER (PARTITION BY series_id, volume, g) AS n FROM vr)
SELECT bar_id FROM b WHERE least(open, high, low, close) <= 0 OR volume < 0 OR high < low
  OR close > high + tick * 1.000001 OR close < low - tick * 1.000001
UNION SELECT bar_id FROM b JOIN vols USING (series_id) WHERE volume > 30 * vol
UNION SELECT bar_id FROM b JOIN qn USING (series_id, index_ns, high, low, close) WHERE n >= 8
UNION SELECT bar_id FROM b JOIN vn USING (series_id, index_ns, volume) WHERE n >= 8 AND volume <> 0
UNION SELECT bar_id FROM spike
"""

P2_SQL = r"""
WITH RECURSIVE one AS (
  SELECT min(experiment_id) AS id, k, max(pk) AS pk FROM (
    SELECT experiment_id, nullif(upper(regexp_replace(experiment_id, '^\s+|\s+$', '', 'g')), '') AS k,
      nullif(upper(regexp_replace(lineage_parent, '^\s+|\s+$', '', 'g')), '') AS pk FROM experiments)
  WHERE k IS NOT NULL GROUP BY k),
tree AS (SELECT a.id, b.id AS parent FROM one a LEFT JOIN one b ON a.pk = b.k),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.id, d.root_id, d.depth + 1 FROM tree t JOIN down d ON t.parent = d.id),
lost AS (SELECT * FROM tree WHERE id NOT IN (SELECT id FROM down)),
anc AS (
  SELECT id, parent AS up FROM lost
  UNION SELECT a.id, l.parent FROM anc a JOIN lost l ON a.up = l.id),
onc AS (SELECT id FROM anc WHERE id = up)
SELECT id AS experiment_id, root_id, depth FROM down
UNION ALL SELECT a.id, min(a.up), -1 FROM anc a JOIN onc ON a.up = onc.id GROUP BY a.id
"""

P2_PATHS_SQL = P2_SQL.replace("id AS root_id, 0::BIGINT AS depth", "id AS root_id, 0::BIGINT AS depth, id AS path").replace("d.depth + 1 FROM", "d.depth + 1, d.path || '/' || t.id FROM").replace(
    "root_id, depth FROM down", "root_id, depth, path FROM down").replace("-1 FROM anc", "-1, NULL FROM anc")

P2_DESCENDANTS_SQL = P2_SQL[: P2_SQL.index("down AS (")] + """
walk AS (
  SELECT parent AS ancestor, id AS descendant, 1::BIGINT AS steps, [parent] AS seen FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT t.parent, w.descendant, w.steps + 1, list_append(w.seen, t.parent)
  FROM walk w JOIN tree t ON w.ancestor = t.id WHERE t.parent IS NOT NULL AND NOT list_contains(w.seen, t.parent))
SELECT ancestor, descendant, steps, ancestor IN (SELECT ancestor FROM walk WHERE ancestor = descendant) AS on_cycle FROM walk
"""

P5_SQL = """
WITH z AS (
  SELECT symbol, timezone_name AS tz, bar_seconds * 1000000 AS step, split_part(rth_open, ':', 1)::BIGINT * 60 + split_part(rth_open, ':', 2)::BIGINT AS o,
    split_part(rth_close, ':', 1)::BIGINT * 60 + split_part(rth_close, ':', 2)::BIGINT AS c FROM instruments),
r AS (
  SELECT series_id, index_ns, tz, step, o, c, (make_timestamptz(index_ns // 1000) AT TIME ZONE tz)::DATE AS day
  FROM bars JOIN z USING (symbol) WHERE close IS NOT NULL),
s AS (
  SELECT series_id, index_ns, step, epoch_us((day + to_minutes(o)) AT TIME ZONE tz) AS a, epoch_us((day + to_minutes(c)) AT TIME ZONE tz) AS e FROM r),
i AS (SELECT DISTINCT series_id, a, e, step, (index_ns - a * 1000) // (step * 1000) AS slot FROM s WHERE index_ns >= a * 1000 AND index_ns < e * 1000),
g AS (SELECT series_id, a, step, unnest(range(((e - a + step - 1) // step)::BIGINT)) AS slot FROM (SELECT DISTINCT series_id, a, e, step FROM i))
SELECT series_id, (a + slot * step) * 1000 AS slot_ns FROM g ANTI JOIN i USING (series_id, a, slot)
"""

P4_SQL = """
WITH d AS (
  SELECT DISTINCT experiment_id, 'sensitivity' AS doc_kind, CASE WHEN json_valid(sensitivity_json) THEN sensitivity_json::JSON END AS j FROM experiments
  UNION SELECT DISTINCT experiment_id, 'verification', CASE WHEN json_valid(verification_json) THEN verification_json::JSON END FROM experiments),
e0 AS (
  SELECT experiment_id, doc_kind, CASE WHEN doc_kind = 'sensitivity' AND json_type(j, '$.groups') = 'OBJECT' THEN j -> '$.groups' ELSE j END AS j
  FROM d WHERE json_type(j) = 'OBJECT'),
e1 AS (SELECT experiment_id, doc_kind, unnest(json_keys(j)) AS entry_key, j FROM e0),
e2 AS (SELECT experiment_id, doc_kind, entry_key, json_extract(j, '$."' || entry_key || '"') AS v FROM e1),
e3 AS (
  SELECT experiment_id, doc_kind, entry_key, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$') THEN (v ->> '$')::JSON END ELSE v END AS v FROM e2),
i0 AS (
  SELECT experiment_id, doc_kind, entry_key, v -> (CASE WHEN doc_kind = 'sensitivity' THEN '$.probes' ELSE '$.checks' END) AS a FROM e3 WHERE json_type(v) = 'OBJECT'),
i1 AS (
  SELECT experiment_id, doc_kind, entry_key, CASE WHEN json_type(a) = 'OBJECT' THEN [a] WHEN json_type(a) = 'ARRAY' THEN from_json(a, '["JSON"]') END AS a FROM i0),
i2 AS (SELECT experiment_id, doc_kind, entry_key, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS item_no FROM i1),
s0 AS (
  SELECT experiment_id, doc_kind, entry_key, item_no, x, x -> (CASE WHEN doc_kind = 'sensitivity' THEN '$.models' ELSE '$.findings' END) AS a FROM i2 WHERE json_type(x) = 'OBJECT'),
s1 AS (
  SELECT experiment_id, doc_kind, entry_key, item_no, x, CASE WHEN json_type(a) = 'OBJECT' THEN [a] WHEN json_type(a) = 'ARRAY' THEN from_json(a, '["JSON"]') ELSE [] END AS a FROM s0),
s2 AS (SELECT experiment_id, doc_kind, entry_key, item_no, unnest(a) AS y, generate_subscripts(a, 1) - 1 AS sub_no FROM s1)
SELECT DISTINCT experiment_id, doc_kind, entry_key, item_no, sub_no, y ->> (CASE WHEN doc_kind = 'sensitivity' THEN '$.model' ELSE '$.code' END) AS leaf_name
FROM s2 WHERE json_type(y) = 'OBJECT'
UNION SELECT experiment_id, doc_kind, entry_key, item_no, -1, x ->> '$.family' FROM s1 WHERE doc_kind = 'verification' AND len(a) = 0
"""


def _table_sql(kind: str, *levels: str) -> str:
    """A flat table of one of the documents, by unnesting its arrays one after the other."""
    root = nested.SENSITIVITY if kind == "sensitivity" else nested.VERIFICATION
    bare = f"WHEN json_type(v) = 'VARCHAR' AND left(ltrim(v ->> '$'), 1) NOT IN ('{{', '[') THEN v ->> '$'"
    cols = [f"CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.{x.name}' {bare if x.name == root.bare else ''} END AS {x.name}" for x in root.leaves]
    sql = P4_SQL[: P4_SQL.index("e3 AS (")] + f"""
t0 AS (SELECT experiment_id, entry_key, v, {', '.join(cols)} FROM (
  SELECT experiment_id, entry_key, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN (v ->> '$')::JSON ELSE v END AS v FROM e2
  WHERE doc_kind = '{kind}' AND NOT (doc_kind = 'sensitivity' AND entry_key IN ('status', 'groups'))))"""
    node, path = root, ""
    for i, name in enumerate(levels, 1):
        node = next(c for c in node.repeated if c.name == name)
        path += f"{name}_"
        arr = f"CASE json_type(v -> '$.{name}') WHEN 'ARRAY' THEN from_json(v -> '$.{name}', '[\"JSON\"]') WHEN 'OBJECT' THEN [v -> '$.{name}'] END"
        leaf = lambda x: f"CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.{x}' ELSE v ->> '$' END" if x == node.bare else f"v ->> '$.{x}'"  # noqa: B023, E731
        cols = ", ".join(f"{leaf(x.name)} AS {path}{x.name}" for x in node.leaves)
        there = "true" if node.bare else "json_type(v) = 'OBJECT'"
        sql += f""", u{i} AS (SELECT * EXCLUDE (v, a), unnest(a) AS v, generate_subscripts(a, 1) - 1 AS {name}_no FROM (SELECT *, {arr} AS a FROM t{i - 1} WHERE json_type(v) = 'OBJECT')),
t{i} AS (SELECT *, {cols} FROM u{i} WHERE {there})"""
    return f"{sql} SELECT DISTINCT * EXCLUDE (v) FROM t{len(levels)}"


P4_TABLES = {
    "p4_entries": f"SELECT *, 'sensitivity' AS doc_kind FROM ({_table_sql('sensitivity')}) UNION ALL BY NAME SELECT *, 'verification' AS doc_kind FROM ({_table_sql('verification')})",
    "p4_probes": _table_sql("sensitivity", "probes"),
    "p4_models": _table_sql("sensitivity", "probes", "models"),
    "p4_by_year": _table_sql("sensitivity", "probes", "models", "by_year"),
    "p4_checks": _table_sql("verification", "checks"),
    "p4_findings": _table_sql("verification", "checks", "findings"),
    "p4_bars": _table_sql("verification", "checks", "findings", "where", "bars"),
}

P5_GRID_SQL = P5_SQL[: P5_SQL.index("r AS (")] + """
r AS (
  SELECT series_id, index_ns, close, volume, received_at, bar_id, tz, step, o, c, (make_timestamptz(index_ns // 1000) AT TIME ZONE tz)::DATE AS day
  FROM bars JOIN z USING (symbol) WHERE close IS NOT NULL AND index_ns IS NOT NULL),
s AS (SELECT *, epoch_us((day + to_minutes(o)) AT TIME ZONE tz) AS a, epoch_us((day + to_minutes(c)) AT TIME ZONE tz) AS e FROM r),
l AS (SELECT *, (index_ns - a * 1000) // (step * 1000) AS slot FROM s WHERE index_ns >= a * 1000 AND index_ns < e * 1000
  QUALIFY row_number() OVER (PARTITION BY series_id, a, index_ns ORDER BY received_at DESC NULLS LAST, bar_id DESC) = 1),
t AS (SELECT series_id, a, e, step, slot, max_by(close, index_ns) AS close, sum(volume) AS volume, count(*) AS n FROM l GROUP BY ALL),
g AS (SELECT series_id, a, step, unnest(range(((e - a + step - 1) // step)::BIGINT)) AS slot FROM (SELECT DISTINCT series_id, a, e, step FROM t)),
w AS (SELECT g.*, t.close, t.volume, t.n,
  last_value(CASE WHEN n > 0 THEN g.slot END IGNORE NULLS) OVER before AS s0, last_value(t.close IGNORE NULLS) OVER before AS c0,
  first_value(CASE WHEN n > 0 THEN g.slot END IGNORE NULLS) OVER after AS s1, first_value(t.close IGNORE NULLS) OVER after AS c1
  FROM g LEFT JOIN t USING (series_id, a, slot)
  WINDOW before AS (PARTITION BY g.series_id, g.a ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY g.series_id, g.a ORDER BY g.slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, CASE WHEN n > 0 THEN 'reading' WHEN s0 IS NULL THEN 'before' WHEN s1 IS NULL THEN 'after' WHEN s1 - s0 - 1 <= 3 THEN 'filled' ELSE 'gap' END AS state FROM w)
SELECT series_id, (a + slot * step) * 1000 AS slot_ns, CASE state WHEN 'reading' THEN close WHEN 'filled' THEN c0 + (c1 - c0) * (slot - s0) / (s1 - s0) END AS close,
  CASE state WHEN 'reading' THEN volume WHEN 'filled' THEN 0.0::DOUBLE END AS volume, coalesce(n, 0) AS n_readings, state FROM m
"""

ORACLE_SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_paths": P2_PATHS_SQL, "p2_descendants": P2_DESCENDANTS_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_grid": P5_GRID_SQL} | P4_TABLES
