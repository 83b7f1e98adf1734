import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from causalbars.runtime import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def data():
    d = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    if not d.exists():
        pytest.skip("no test tables here")
    return str(d)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c
