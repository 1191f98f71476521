"""Streams of observations.

Every operator works on a streaming DataFrame and, for replay and tests, on a
batch one.  Keyed steps are built-in aggregates or per-event deduplication, so
a pixel with many events combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelfold.functions.dates import day_number
from pixelfold.functions.statistics import FOLD_NAMES, check_names, sketched_aggregates, statistic_columns
from pixelfold.functions.qai import DEFAULT_SCREEN, is_screened
from pixelfold.operators.harmonic import evaluate
from pixelfold.operators.skew import attach
from pixelfold.session import scratch_path


def event_time(df: DataFrame, col="ts") -> DataFrame:
    """Zone-less timestamps become instants; watermarks need them."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def stream_nrt(stream: DataFrame, coef: DataFrame, origin, k=3.0, modes=1, trend=False, key="pixel_id", salts=1) -> DataFrame:
    """Alerts: observations whose residual from the stored season model exceeds ``k`` RMSE.

    A stream-static join with the coefficient table; append mode.  The table is
    read again in every micro-batch, so it should be a written one.  ``salts``
    above 1 spreads the events of a busy pixel over as many tasks, and copies
    the table as often.
    """
    model = coef.select(key, "coef", "rmse")
    joined = stream.join(model, key) if salts == 1 else attach(stream, model, [key], ["ts"], "inner", salts)
    expected = evaluate(day_number(F.to_date("ts")), origin, modes, trend)
    scored = joined.withColumn("residual", F.col("value") - expected).drop("coef")
    return scored.where(F.abs("residual") > F.lit(float(k)) * F.col("rmse"))


def stream_screen(stream: DataFrame, flags=DEFAULT_SCREEN, delay="1 day", identity=("event_id",)) -> DataFrame:
    """Quality screen; repeats of an observation within the watermark are dropped."""
    clean = stream.where(~is_screened(flags))
    return clean.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(identity))


def stream_fold_tumbling(stream: DataFrame, width="1 day", delay="1 day", keys=("pixel_id",)) -> DataFrame:
    """Mean and count per key and tumbling window."""
    return _windowed(stream, F.window("ts", width), delay, keys)


def stream_moving(stream: DataFrame, width="2 days", slide="1 day", delay="1 day", keys=("pixel_id",)) -> DataFrame:
    """Moving mean per key over sliding windows."""
    return _windowed(stream, F.window("ts", width, slide), delay, keys)


def _windowed(stream, window, delay, keys):
    return (
        stream.withWatermark("ts", delay)
        .groupBy(*keys, window.alias("w"))
        .agg(F.avg("value").alias("value"), F.count("value").alias("n"))
        .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "n")
    )


def stream_fold(stream: DataFrame, names=FOLD_NAMES, width="1 day", delay="1 day", keys=("pixel_id",), k=400) -> DataFrame:
    """Any of the fold statistics per key and tumbling window, in the requested order.

    A window's state has a bounded size whatever it holds; see
    ``statistics.sketched_aggregates`` for the error of its quantiles.
    """
    check_names(names, FOLD_NAMES)
    return (
        stream.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", width).alias("w"))
        .agg(*sketched_aggregates(names, "value", k))
        .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *statistic_columns(names))
    )


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of the Parquet files at ``path`` (a folder, or one file of a folder)."""
    folder, _, leaf = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if leaf.endswith(".parquet") and not _is_folder(spark, path):
        return reader.option("pathGlobFilter", leaf).parquet(folder)
    return reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def stream_sink(stream: DataFrame, path: str, checkpoint: str, mode="append", partition_by=(), available_now=True):
    """Start writing a stream to Parquet; with ``available_now`` it ends after what is there."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def replay(stream: DataFrame, label="replay", groups=()) -> DataFrame:
    """Run a stream over everything available and read the written table back.

    With ``groups`` the stream is a running aggregate by these columns: every
    batch writes the groups it changed, under its number, and the last state of
    each group is read, so windows that are still open at the end are there too.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    if not groups:
        query = stream_sink(stream, path, checkpoint)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated replaces its own files
        batch.write.mode("overwrite").parquet(f"{path}/_n={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).limit(1).count():
        return spark.createDataFrame([], stream.schema)
    states = spark.read.option("basePath", path).parquet(*[f"{path}/_n=*"])
    last = states.groupBy(*groups).agg(F.max_by(F.struct(*stream.columns), "_n").alias("row"))
    return last.select("row.*")
