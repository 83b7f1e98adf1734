import pytest

from causalbars.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, data, duck, tmp_path):
    QUERIES[name](spark, data).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE_SQL[name]}")
    cols = ", ".join(sorted(x[0] for x in duck.execute("DESCRIBE want").fetchall()))
    got = f"(SELECT {cols} FROM '{tmp_path}/out/*.parquet')"
    assert duck.execute(f"SELECT {cols} FROM want EXCEPT ALL SELECT * FROM {got}").fetchall() == []
    assert duck.execute(f"SELECT * FROM {got} EXCEPT ALL SELECT {cols} FROM want").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0
