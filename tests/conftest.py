import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def spark():
    from pixelfold.session import build_session
    session = build_session("local[8]", "pixelfold-tests", spark__sql__shuffle__partitions="8",
                            spark__ui__enabled="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.fixture
def season(spark):
    """A pure yearly wave every 16 days over three years."""
    import datetime as dt
    import math
    first = dt.date(2001, 1, 1)
    rows = []
    for i in range(0, 1096, 16):
        day = first + dt.timedelta(days=i)
        rows.append((1, day, 0.4 + 0.3 * math.sin(2 * math.pi * i / 365.25)))
    return spark.createDataFrame(rows, "pixel_id long, date date, value double")
