"""Every core query with SQL gives the same rows as its SQL; the others give rows with a stable schema."""

import pytest

from causalbars.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, data, duck, tmp_path):
    QUERIES[name](spark, data).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    cols = sorted(x[0] for x in duck.execute("DESCRIBE want").fetchall())
    assert cols == sorted(x[0] for x in duck.execute("DESCRIBE got").fetchall())
    names = ", ".join(f'"{c}"' for c in cols)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []


def test_names_of_the_catalogue():
    assert set(SQL) <= set(QUERIES)
    assert {"p1_found", "p2_found", "p4_found", "p5_found"} <= set(SQL)
