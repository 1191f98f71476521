"""Named statistics as aggregate columns.

All quantiles of one aggregation share a single ``percentile`` call, so the
values of a group are ordered once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the statistics (fixed values).
STM_NAMES = (
    "MIN", "Q01", "Q05", "Q10", "Q20", "Q25", "Q30", "Q40", "Q50", "Q60", "Q70", "Q75",
    "Q80", "Q90", "Q95", "Q99", "MAX", "AVG", "STD", "RNG", "IQR", "SKW", "KRT", "NUM",
)
FOLD_NAMES = ("MIN", "Q10", "Q25", "Q50", "Q75", "Q90", "MAX", "AVG", "STD", "RNG", "IQR", "SKW", "KRT", "NUM")

_SIMPLE = {
    "MIN": F.min, "MAX": F.max, "AVG": F.avg, "STD": F.stddev_samp,
    "SKW": F.skewness, "KRT": F.kurtosis, "NUM": F.count,
}


def _quantiles_of(names) -> list[str]:
    wanted = {n for n in names if n[0] == "Q"}
    if "IQR" in names:
        wanted |= {"Q25", "Q75"}
    return sorted(wanted)


def check_names(names, allowed=None):
    for n in names:
        quantile = n[0] == "Q" and n[1:].isdigit() and 1 <= int(n[1:]) <= 99
        if not (n in _SIMPLE or n in ("RNG", "IQR") or quantile):
            raise ValueError(f"unknown statistic {n}")
        if allowed is not None and n not in allowed:
            raise ValueError(f"statistic {n} is not available here")


def statistic_aggregates(names, value="value") -> list[Column]:
    """Aggregates needed for ``names``: simple ones plus one quantile array."""
    v = F.col(value)
    aggs = []
    needed = set(names) | ({"MIN", "MAX"} if "RNG" in names else set())
    for n in ("MIN", "MAX", "AVG", "STD", "SKW", "KRT", "NUM"):
        if n in needed:
            aggs.append(_SIMPLE[n](v).alias(f"_{n}"))
    quantiles = _quantiles_of(names)
    if quantiles:
        shares = F.array(*[F.lit(int(q[1:]) / 100) for q in quantiles])
        aggs.append(F.percentile(v, shares).alias("_Q"))
    return aggs


def rank_error(k: int) -> float:
    """Largest error of a sketched quantile's rank as a share of all values, at 99 percent confidence."""
    return 2.296 / k ** 0.9723


def sketched_aggregates(names, value="value", k=400) -> list[Column]:
    """``statistic_aggregates`` with a mergeable state of bounded size.

    Moments merge as central moments.  Quantiles come from a sketch: each is a
    value of the group whose rank is off by ``rank_error(k)`` of the values at
    most; of groups smaller than ``k`` the ranks are exact.
    """
    v = F.col(value)
    aggs = statistic_aggregates([n for n in names if n[0] != "Q" and n != "IQR"], value)
    quantiles = _quantiles_of(names)
    if quantiles:
        sketch = F.kll_sketch_agg_double(v.cast("double"), F.lit(k))
        at = [F.kll_sketch_get_quantile_double(sketch, F.lit(int(q[1:]) / 100)) for q in quantiles]
        aggs.append(F.when(F.count(v) > 0, F.array(*at)).alias("_Q"))
    return aggs


def statistic_columns(names) -> list[Column]:
    """Final columns over the output of ``statistic_aggregates``, in request order."""
    quantiles = _quantiles_of(names)

    def pick(q):
        return F.element_at(F.col("_Q"), quantiles.index(q) + 1)

    out = []
    for n in names:
        if n == "RNG":
            col = F.col("_MAX") - F.col("_MIN")
        elif n == "IQR":
            col = pick("Q75") - pick("Q25")
        elif n[0] == "Q":
            col = pick(n)
        else:
            col = F.col(f"_{n}")
        out.append(col.alias(n))
    return out
