"""Registration of queries with their reference SQL, and shared formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, and its SQL if it has one."""
    def add(fn):
        def run(spark, sf_dir):
            return tidy(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add


def rounded(col) -> Column:
    """Six decimals; the odd offset keeps decimal ties off the edge, where engines differ in the last bit."""
    return F.floor(col * 1000000 + F.lit(0.50001)) / F.lit(1000000.0)


def tidy(df: DataFrame) -> DataFrame:
    """Dates and instants as text, fractions with six decimals."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expression: str) -> str:
    """``rounded`` in SQL."""
    return f"floor(({expression})*1000000+0.50001::double)/1000000"


def d(expression: str) -> str:
    return f"cast(cast({expression} AS date) AS varchar)"


def t(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"
