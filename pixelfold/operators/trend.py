"""Linear trend, and change with its aftereffect, on folded series.

A folded series has at most 366 steps (or one per year), which bounds the
windows below; all of them share the exchange on the key.  The t-test takes
series of any length.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfold.functions.student import critical_values

MAX_STEPS = 366


def significance(slope: Column, error: Column, n: Column, tail: str, conf: float) -> Column:
    """-1, 0 or 1 by a t-test of the slope; 0 without a degree of freedom."""
    table = F.array(*[F.lit(c) for c in critical_values(conf, tail, MAX_STEPS)])
    dof = n - 2
    # longer series: the expansion of the quantile in the degrees of freedom, exact to nine digits from here on
    z = NormalDist().inv_cdf((1 + conf) / 2 if tail == "TWO" else conf)
    terms = ((z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384)
    far = F.lit(z) + sum((F.lit(c) / F.pow(dof, F.lit(i)) for i, c in enumerate(terms, 1)), F.lit(0.0))
    limit = F.when(dof > MAX_STEPS, far).otherwise(F.get(table, F.least(dof, F.lit(MAX_STEPS)).cast("int") - 1)) * error
    result = F.lit(0)
    if tail in ("TWO", "RIGHT"):
        result = F.when(slope > limit, 1).otherwise(result)
    if tail in ("TWO", "LEFT"):
        result = F.when(slope < -limit, -1).otherwise(result)
    return F.when((n >= 3) & slope.isNotNull(), result).otherwise(0)


def trend(folded: DataFrame, tail="TWO", conf=0.95, keys=("pixel_id",), step="step", value="value") -> DataFrame:
    """Mean, offset, slope, R2, significance, RMSE, MAE, largest residual and count."""
    whole = Window.partitionBy(*keys)
    used = folded.where(F.col(value).isNotNull()).withColumns({
        "_m": F.regr_slope(value, step).over(whole), "_b": F.regr_intercept(value, step).over(whole),
    })
    residual = used.withColumn("_r", F.abs(F.col(value) - (F.col("_b") + F.col("_m") * F.col(step))))
    sums = residual.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max("_b").alias("offset"), F.max("_m").alias("slope"),
        F.regr_r2(value, step).alias("r2"), F.sum(F.col("_r") * F.col("_r")).alias("_sse"),
        F.regr_sxx(value, step).alias("_sxx"), F.avg("_r").alias("mae"), F.max("_r").alias("max_residual"),
        F.count(value).alias("n"),
    )
    spread = F.nullif(F.col("_sxx") * (F.col("n") - 2), F.lit(0.0))
    error = F.sqrt(F.col("_sse") / spread)
    return sums.select(
        *keys, "mean", "offset", "slope", "r2",
        significance(F.col("slope"), F.coalesce(error, F.lit(0.0)), F.col("n"), tail, conf).alias("significance"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae", "max_residual", "n")


def cat(folded: DataFrame, change_penalty=False, keys=("pixel_id",), step="step", value="value") -> DataFrame:
    """Largest drop between consecutive steps, and the trends before and after it.

    With ``change_penalty`` a drop is reduced by the rebound of the next step.
    Ties take the earliest step.
    """
    order = Window.partitionBy(*keys).orderBy("_x")
    whole = Window.partitionBy(*keys)
    base = folded.where(F.col(value).isNotNull()).select(*keys, F.col(step).alias("_x"), F.col(value).alias("_y"))
    stepped = base.withColumn("_drop", F.lag("_y").over(order) - F.col("_y"))
    if change_penalty:
        rebound = F.greatest(F.lit(0.0), F.coalesce(F.lead("_y").over(order) - F.col("_y"), F.lit(0.0)))
        stepped = stepped.withColumn("_score", F.col("_drop") - rebound)
    else:
        stepped = stepped.withColumn("_score", F.col("_drop"))
    scored = stepped.withColumn("_top", F.max("_score").over(whole))
    located = scored.withColumn("_at", F.min(F.when(F.col("_score") == F.col("_top"), F.col("_x"))).over(whole))
    early, late = F.col("_x") < F.col("_at"), F.col("_x") >= F.col("_at")

    def part(when: Column, name: str):
        y, x = F.when(when, F.col("_y")), F.when(when, F.col("_x"))
        return [F.avg(y).alias(f"{name}_mean"), F.regr_slope(y, x).alias(f"{name}_slope"),
                F.regr_r2(y, x).alias(f"{name}_r2"), F.count(y).alias(f"{name}_n")]

    at = F.col("_x") == F.col("_at")
    return located.groupBy(*keys).agg(
        F.max("_at").alias("change_step"), F.max(F.when(at, F.col("_drop"))).alias("change"),
        *part(early, "before"), *part(late, "after"))
