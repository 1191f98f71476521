"""Job logs, status events and metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of the two line layouts (fixed names).
LOG_SCHEMA = """
    message string, levelname string, name string, filename string,
    job_id string, user_id string, timestamp string, _corrupt string
"""


def parse_logs(lines: DataFrame, col="line", keep=()) -> DataFrame:
    """Typed columns of JSON log lines; a line that is no JSON is kept in ``bad_line``."""
    parsed = F.from_json(col, LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(*keep, parsed.alias("r"), F.col(col).alias("_line")).select(
        *keep,
        F.when(F.col("r.timestamp").isNotNull(), "timestamped").when(F.col("r.job_id").isNotNull(), "job").otherwise("other").alias("layout"),
        F.try_to_timestamp("r.timestamp").alias("logged_at"),
        F.upper("r.levelname").alias("levelname"),
        "r.message", F.col("r.name").alias("logger"), "r.filename", "r.job_id", "r.user_id",
        F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), F.col("_line")).alias("bad_line"),
    )


def log_rollup(logs: DataFrame, ts="ts", width="1 hour") -> DataFrame:
    """Lines per time bucket, job, user and level."""
    return (
        logs.groupBy(F.window(ts, width).alias("w"), "job_id", "user_id", "levelname")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select(F.col("w.start").alias("bucket"), "job_id", "user_id", "levelname", "lines")
    )


def job_latest_status(events: DataFrame, job="job_id", ts="ts", tie="event_id") -> DataFrame:
    """Current state of every job: its latest event, ties by the larger id.

    The aggregate keeps one row per job and combines before the shuffle; on a
    stream it is the state of an update or complete mode query.
    """
    latest = F.max(F.struct(F.col(ts), F.col(tie), F.col("status")))
    return events.groupBy(job).agg(latest.alias("_l"), F.count(F.lit(1)).alias("events")).select(
        job, F.col(f"_l.{ts}").alias("updated"), F.col("_l.status").alias("status"), "events")


def metric_windows(samples: DataFrame, width="1 minute", phase="Running", ts="ts") -> DataFrame:
    """Mean and maximum per metric and window, from samples of the given phase."""
    return (
        samples.where(F.col("phase") == phase)
        .groupBy(F.window(ts, width).alias("w"), "metric")
        .agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("samples"))
        .select(F.col("w.start").alias("bucket"), "metric", "mean", "peak", "samples")
    )
