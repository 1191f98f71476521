"""Every query against its SQL in DuckDB, on whole tables."""

import math

import pytest

from pixelfold.queries import ORACLES, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_by_name(df.columns, got) == rows_by_name(columns, cursor.fetchall())
