import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    from latticework.session import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def comparable(rows):
    """Rows as sorted tuples: numbers rounded, booleans as numbers."""
    out = [tuple(round(float(x), 9) if isinstance(x, float) else int(x) if isinstance(x, bool) else x for x in r) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def same_as_duck(frame, duck, sql):
    columns = sorted(frame.columns)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    found = comparable([[r[c] for c in columns] for r in frame.collect()])
    assert found == comparable([[r[names.index(c)] for c in columns] for r in cursor.fetchall()])
