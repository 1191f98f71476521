"""Queries over streams, logs, user functions and sinks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from pixelfold.functions.statistics import rank_error
from pixelfold.operators import user_fn
from pixelfold.queries import fixtures as fx
from pixelfold.queries.base import d, query, r, t
from pixelfold.queries.fixtures import FIRST, ctes
from pixelfold.queries.series import HARMONIC, season_model
from pixelfold.session import scratch_path
from pixelfold.sinks.writers import stac_result, write_cube
from pixelfold.sources import logs
from pixelfold.streaming import jobs
from pixelfold.streaming import observations as so


def observation_stream(spark, sf):
    path = f"{sf}/events.parquet"
    return fx.stream_obs(so.read_events(spark, path, spark.read.parquet(path).schema))


@query("stream_nrt", ctes("obs", "stream_obs", **HARMONIC, a=f"""
SELECT event_id, pixel_id, ts, value/20 AS value, rmse,
  value/20 - (c0 + c1*cos(2*pi()*(cast(ts AS date) - date '{FIRST}')/365.25::double) + c2*sin(2*pi()*(cast(ts AS date) - date '{FIRST}')/365.25::double)) AS residual
FROM stream_obs JOIN coef USING (pixel_id)""") + f"""
SELECT event_id, pixel_id, {t('ts')} AS ts, {r('value')} AS value, {r('residual')} AS residual FROM a WHERE abs(residual) > 1.5*rmse""")
def _nrt(spark, sf):
    scaled = observation_stream(spark, sf).withColumn("value", F.col("value") / 20)
    # the model is fitted once and stored
    path, model = scratch_path(spark, "model"), season_model(spark, sf)
    model.write.parquet(path)
    alerts = so.stream_nrt(scaled, spark.read.schema(model.schema).parquet(path), FIRST, 1.5)
    return so.replay(alerts.select("event_id", "pixel_id", "ts", "value", "residual"), "nrt")


@query("stream_screen", ctes("stream_obs") + f"""
SELECT event_id, pixel_id, {t('ts')} AS ts, {r('value')} AS value, qai FROM stream_obs
WHERE qai IS NULL OR NOT (qai & 1 = 1 OR (qai >> 1) & 3 IN (1, 2, 3) OR (qai >> 3) & 1 = 1 OR (qai >> 4) & 1 = 1 OR (qai >> 8) & 1 = 1 OR (qai >> 9) & 1 = 1)""")
def _screen(spark, sf):
    """Every event arrives twice; the second copy is dropped."""
    once, again = observation_stream(spark, sf), observation_stream(spark, sf)
    clean = so.stream_screen(once.unionByName(again), delay="40 days")
    return so.replay(clean.select("event_id", "pixel_id", "ts", "value", "qai"), "screen")


@query("stream_fold_tumbling", ctes("stream_obs") + f"""
SELECT pixel_id, {t('day')} AS "start", {t('day + interval 1 day')} AS "end", {r('avg(value)')} AS value, count(value) AS n
FROM (SELECT *, date_trunc('day', ts)::timestamp AS day FROM stream_obs) GROUP BY pixel_id, day""")
def _tumbling(spark, sf):
    return so.replay(so.stream_fold_tumbling(observation_stream(spark, sf)), "fold", ("pixel_id", "start"))


@query("stream_moving", ctes("stream_obs") + f"""
SELECT pixel_id, {t('day')} AS "start", {t('day + interval 2 day')} AS "end", {r('avg(value)')} AS value, count(value) AS n
FROM (SELECT *, date_trunc('day', ts)::timestamp - to_days(k) AS day FROM stream_obs, (VALUES (0), (1)) v(k)) GROUP BY pixel_id, day""")
def _moving(spark, sf):
    return so.replay(so.stream_moving(observation_stream(spark, sf)), "moving", ("pixel_id", "start"))


@query("stream_sink", ctes("stream_obs") + f"""
SELECT event_id, pixel_id, {t('ts')} AS ts, sensor, {r('value')} AS value, qai FROM stream_obs""")
def _sink(spark, sf):
    return so.replay(observation_stream(spark, sf), "sink")


def log_lines(spark, sf):
    """Events as log lines: two JSON layouts, and lines that are no JSON."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    job = F.to_json(F.struct(
        F.concat(F.lit("got "), "event_type").alias("message"), F.lit("info").alias("levelname"), F.lit("batch").alias("name"),
        F.lit("run.sh").alias("filename"), F.concat(F.lit("j-"), F.col("user_id").cast("string")).alias("job_id"), F.lit("u1").alias("user_id")))
    timed = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("WARNING").alias("levelname"), F.col("event_type").alias("message")))
    line = F.when(F.col("event_type") == "click", timed).when(F.col("event_type") == "error", F.concat(F.lit("panic: "), "event_type")).otherwise(job)
    return fx.table(spark, sf, "events").select("event_id", line.alias("line"))


@query("parse_logs", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'timestamped' WHEN 'error' THEN 'other' ELSE 'job' END AS layout,
  CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS logged_at,
  CASE event_type WHEN 'click' THEN 'WARNING' WHEN 'error' THEN NULL ELSE 'INFO' END AS levelname,
  CASE event_type WHEN 'click' THEN event_type WHEN 'error' THEN NULL ELSE 'got ' || event_type END AS message,
  CASE WHEN event_type NOT IN ('click', 'error') THEN 'batch' END AS logger, CASE WHEN event_type NOT IN ('click', 'error') THEN 'run.sh' END AS filename,
  CASE WHEN event_type NOT IN ('click', 'error') THEN 'j-' || user_id END AS job_id, CASE WHEN event_type NOT IN ('click', 'error') THEN 'u1' END AS user_id,
  CASE event_type WHEN 'error' THEN 'panic: ' || event_type END AS bad_line
FROM events""")
def _parse(spark, sf):
    return logs.parse_logs(log_lines(spark, sf), keep=["event_id"])


@query("log_rollup", f"""
SELECT {t("date_trunc('hour', ts)")} AS bucket, 'j-' || user_id % 10 AS job_id, 'u-' || user_id AS user_id, upper(event_type) AS levelname, count(*) AS lines
FROM events GROUP BY ALL""")
def _rollup(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("j-"), (F.col("user_id") % 10).cast("string")).alias("job_id"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("user_id"), F.upper("event_type").alias("levelname"))
    return logs.log_rollup(rows)


@query("job_latest_status", f"""
SELECT user_id AS job_id, {t('arg_max(ts, (ts, event_id))')} AS updated, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events
FROM events GROUP BY 1""")
def _latest(spark, sf):
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("status"))
    return logs.job_latest_status(rows)


@query("stream_job_status", f"""
SELECT user_id AS job_id, {t('arg_max(ts, (ts, event_id))')} AS updated, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events,
  max(ts) + interval 6 hour < (SELECT max(ts) FROM events) - interval 1 hour AS idle FROM events GROUP BY 1""")
def _job_status(spark, sf):
    """The same from a stream, with the jobs that have fallen silent."""
    path = f"{sf}/events.parquet"
    events = so.read_events(spark, path, spark.read.parquet(path).schema).select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("status"))
    states = jobs.latest_states(spark, jobs.stream_job_status(events, "6 hours", "1 hour"), scratch_path(spark, "jobs"), scratch_path(spark, "jobs-state"))
    return states.drop("late")


@query("stream_fold", ctes("stream_obs") + f"""
SELECT pixel_id, {t('week')} AS "start", {r('min(value)')} AS "MIN", {r('max(value)')} AS "MAX", {r('avg(value)')} AS "AVG", {r('stddev_samp(value)')} AS "STD",
  {r('max(value) - min(value)')} AS "RNG", {r('CASE WHEN stddev_pop(value) > 0 THEN avg((value - m)**3)/stddev_pop(value)**3 END')} AS "SKW",
  {r('CASE WHEN stddev_pop(value) > 0 THEN kurtosis_pop(value) END')} AS "KRT", count(value) AS "NUM", true AS ranked
FROM (SELECT *, avg(value) OVER (PARTITION BY pixel_id, week) AS m FROM (SELECT *, time_bucket(interval 7 day, ts, timestamp '1970-01-01') AS week FROM stream_obs))
GROUP BY pixel_id, week""")
def _stream_fold(spark, sf):
    """All fourteen statistics by week; quantiles are compared by their rank among the window's values."""
    names = ("MIN", "MAX", "AVG", "STD", "RNG", "SKW", "KRT", "NUM", "Q10", "Q25", "Q50", "Q75", "Q90", "IQR")
    folded = so.replay(so.stream_fold(observation_stream(spark, sf), names, "7 days"), "weeks", ("pixel_id", "start"))
    path = f"{sf}/events.parquet"
    values = fx.stream_obs(spark.read.parquet(path)).groupBy("pixel_id", F.window("ts", "7 days").start.alias("start")).agg(
        F.sort_array(F.collect_list("value")).alias("v"))
    near = lambda q, p: (F.size(F.filter("v", lambda x: x < F.col(q))) <= (p + rank_error(400)) * F.col("NUM") + 1) & (
        F.size(F.filter("v", lambda x: x <= F.col(q))) >= (p - rank_error(400)) * F.col("NUM") - 1)
    ranked = reduce(lambda a, b: a & b, [near(q, int(q[1:]) / 100) for q in names if q[0] == "Q"], F.col("IQR") == F.col("Q75") - F.col("Q25"))
    return folded.join(values, ["pixel_id", "start"]).select("pixel_id", "start", *names[:8], ranked.alias("ranked"))


@query("metric_windows", f"""
SELECT {t("time_bucket(interval 15 minutes, ts)")} AS bucket, 'm' || user_id % 4 AS metric, {r('avg(value)')} AS mean, {r('max(value)')} AS peak, count(*) AS samples
FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def _metrics(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("metric"), "value",
        F.when(F.col("event_type") == "error", "Failed").otherwise("Running").alias("phase"))
    return logs.metric_windows(rows, "15 minutes")


@query("apply_user_fn", ctes("obs_raw") + f"""
SELECT pixel_id, count(*) AS "rows", {r('sum(value*2)')} AS total FROM obs_raw GROUP BY 1""")
def _apply(spark, sf):
    """Each unit sums its rows; the gather adds the parts of a pixel."""
    def partial(frame: pd.DataFrame, context: dict) -> pd.DataFrame:
        scaled = frame["value"] * context["scale"]
        return pd.DataFrame({"pixel_id": [frame["pixel_id"].iloc[0]], "rows": [len(frame)], "total": [scaled.sum()]})

    raw = fx.obs_raw(spark, sf).select("pixel_id", "l_orderkey", "l_linenumber", "value")
    parts = user_fn.apply_user_fn(raw, ["pixel_id"], partial, "pixel_id long, rows long, total double", {"scale": 2.0}, parts=4)
    return parts.groupBy("pixel_id").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))


@query("map_user_fn", ctes("grid") + f"""SELECT scene_id, x, y, {r('("BNIR"-"RED")/("BNIR"+"RED")')} AS ndvi FROM grid""")
def _map(spark, sf):
    def ndvi(frame: pd.DataFrame, context: dict) -> pd.DataFrame:
        red, nir = frame[context["red"]], frame[context["nir"]]
        return frame[["scene_id", "x", "y"]].assign(ndvi=(nir - red) / (nir + red))

    grid = fx.grid(spark, sf).select("scene_id", "x", "y", "RED", "BNIR")
    return user_fn.map_user_fn(grid, ndvi, "scene_id long, x int, y int, ndvi double", {"red": "RED", "nir": "BNIR"})


@query("expand_user_fn", ctes("scenes") + """
SELECT item_id, cloud_cover, visit, cloud_cover + visit AS expected FROM scenes, (VALUES (0), (1), (2)) v(visit) WHERE visit <= item_id % 3""")
def _expand(spark, sf):
    def revisits(item_id, cloud_cover):
        for visit in range(1 + item_id % 3):
            yield visit, cloud_cover + visit

    items = fx.scenes(spark, sf).select("item_id", "cloud_cover")
    return user_fn.expand_user_fn(items, revisits, "visit int, expected long", ["item_id", "cloud_cover"])


@query("agg_user_fn", ctes("obs_raw") + f"SELECT pixel_id, {r('sum(value)')} AS result FROM obs_raw GROUP BY 1")
def _agg(spark, sf):
    raw = fx.obs_raw(spark, sf).select("pixel_id", "value")
    return user_fn.agg_user_fn(raw, ["pixel_id"], lambda values: float(values.sum()), "value", parts=(4, 2))


@query("write_cube", ctes("obs_raw") + f"""
SELECT l_orderkey, l_linenumber, pixel_id, tile_x, tile_y, {d('date')} AS date, {r('value')} AS value FROM obs_raw""")
def _write(spark, sf):
    """Written by tile and read back."""
    product = fx.obs_raw(spark, sf).select("l_orderkey", "l_linenumber", "pixel_id", "tile_x", "tile_y", "date", "value")
    path = write_cube(product, scratch_path(spark, "cube"), "product")
    return spark.read.schema(product.schema).parquet(path)


@query("stac_result", ctes("obs_raw", k="""
SELECT tile_x, tile_y, min(pixel_id) AS west, min(l_linenumber) AS south, max(pixel_id) AS east, max(l_linenumber) AS north,
  min(date)::varchar AS "start", max(date)::varchar AS "end", count(*) AS items FROM obs_raw GROUP BY 1, 2""",
                           n="""SELECT printf('product-X%04d_Y%04d', tile_x, tile_y) AS id, *,
  's3://bucket/out/product/tile_x=' || tile_x || '/tile_y=' || tile_y AS href FROM k""") + """
SELECT id, west, south, east, north, "start", "end", items, href,
  '{"type":"Feature","id":"' || id || '","bbox":[' || concat_ws(',', west, south, east, north) || '],"properties":{"start":"' || "start"
  || '","end":"' || "end" || '","rows":' || items || '},"assets":{"data":{"href":"' || href || '"}}}' AS document FROM n""")
def _stac(spark, sf):
    product = fx.obs_raw(spark, sf).withColumns({"x": F.col("pixel_id"), "y": F.col("l_linenumber").cast("long")})
    return stac_result(product, "s3://bucket/out", "product", direct_s3=True)
