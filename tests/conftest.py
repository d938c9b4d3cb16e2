import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def oracle(small):
    import duckdb

    c = duckdb.connect()
    for f in Path(small).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="session")
def same():
    """Whether a Spark result holds the rows of a DuckDB result."""

    def check(df, other):
        a, b = df.toPandas(), other.df()
        assert sorted(a.columns) == sorted(b.columns)
        assert len(a) == len(b)
        a, b = (p[sorted(p.columns)].sort_values(sorted(p.columns)).reset_index(drop=True) for p in (a, b))
        for c in a.columns:
            equal = (a[c].isna() & b[c].isna()) | (a[c] == b[c])
            if not equal.all() and a[c].dtype.kind == "f":
                equal = (a[c] - b[c]).abs() < 1e-5
            assert equal.all(), (c, a[c][~equal].head().tolist(), b[c][~equal].head().tolist())

    return check
