import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pelagos.session import get_spark

    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    if not path.is_dir():
        pytest.skip("no test tables")
    return str(path)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows_of(frame):
    """Rows as sorted tuples of text, columns by name; whole floats as integers, others to nine digits."""

    def text(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        if isinstance(v, bool) or str(type(v)).find("bool") >= 0:
            return str(bool(v))
        try:
            f = float(v)
        except (TypeError, ValueError):
            return str(v)
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.9g}"

    cols = sorted(frame.columns)
    return cols, sorted(tuple(text(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert rows_of(a) == rows_of(b)

    return check
