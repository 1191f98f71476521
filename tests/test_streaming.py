import bisect
import datetime as dt
import glob
import random
import shutil

import pytest
from pyspark.sql import functions as F

from pixelfold.functions.statistics import FOLD_NAMES, rank_error, statistic_aggregates, statistic_columns
from pixelfold.operators import harmonic
from pixelfold.sources import logs
from pixelfold.streaming import jobs
from pixelfold.streaming import observations as so

SCHEMA = "event_id long, pixel_id long, ts timestamp, value double, qai int"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def write(spark, path, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/batch={n}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, 1, at(1, 1), 10.0, 0), (2, 1, at(1, 5), 20.0, 0)], 0)
    write(spark, src, [(3, 1, at(6), 1.0, 0)], 1)
    write(spark, src, [(6, 1, at(6, 1), 1.0, 0)], 2)  # from here on the watermark of batch 1 counts
    write(spark, src, [(4, 1, at(1, 6), 99.0, 0), (5, 1, at(5, 1), 3.0, 0)], 3)
    out = {r.start.day: (r.value, r.n) for r in so.replay(so.stream_fold_tumbling(stream(spark, src))).collect()}
    assert out[1] == (15.0, 2)  # event 4 came too late
    assert 6 not in out  # its window is still open


def test_finished_replay_has_open_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, 1, at(1, 1), 10.0, 0), (2, 1, at(9), 20.0, 0)], 0)
    write(spark, src, [(3, 1, at(9, 1), 40.0, 0), (4, 2, at(9, 2), 1.0, 0)], 1)
    out = so.replay(so.stream_fold_tumbling(stream(spark, src)), "all", ("pixel_id", "start")).collect()
    assert sorted((r.pixel_id, r.start.day, r.value, r.n) for r in out) == [(1, 1, 10.0, 1), (1, 9, 30.0, 2), (2, 9, 1.0, 1)]


def test_sliding_windows_overlap(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, 1, at(2, 1), 10.0, 0), (2, 1, at(3, 1), 20.0, 0), (3, 1, at(20), 0.0, 0)], 0)
    out = {r.start.day: r.value for r in so.replay(so.stream_moving(stream(spark, src))).collect()}
    assert out[1] == 10.0 and out[2] == 15.0 and out[3] == 20.0


def test_screen_drops_repeats_and_flags(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, 1, at(1), 1.0, 0), (2, 1, at(1), 1.0, 4)], 0)
    write(spark, src, [(1, 1, at(1), 1.0, 0), (3, 1, at(1), 1.0, None)], 1)
    assert sorted(r.event_id for r in so.replay(so.stream_screen(stream(spark, src))).collect()) == [1, 3]


@pytest.mark.parametrize("salts", [1, 8])
def test_alerts_equal_the_batch_result(spark, tmp_path, season, salts):
    coef = harmonic.harmonic_fit(season, "2001-01-01", 1, False)
    noisy = coef.withColumn("rmse", F.lit(0.1))
    rows = [(i, 1, at(1 + i % 28, i % 24), 0.1 * (i % 11), 0) for i in range(200)]
    src = str(tmp_path / "in")
    write(spark, src, rows, 0)
    live = so.replay(so.stream_nrt(stream(spark, src), noisy, "2001-01-01", 2.0, salts=salts))
    batch = so.stream_nrt(spark.createDataFrame(rows, SCHEMA), noisy, "2001-01-01", 2.0)
    pick = lambda df: sorted((r.event_id, round(r.residual, 9)) for r in df.collect())
    assert pick(live) == pick(batch) and 0 < live.count() < 200


def test_a_folder_and_a_single_file_can_be_streamed(spark, tmp_path):
    folder = str(tmp_path / "events.parquet")
    spark.createDataFrame([(1, 1, at(1), 1.0, 0)], SCHEMA).coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    assert so.replay(so.read_events(spark, folder, schema)).count() == 1
    single = tmp_path / "flat"
    single.mkdir()
    shutil.copy(glob.glob(folder + "/part-*")[0], single / "events.parquet")
    assert so.replay(so.read_events(spark, str(single / "events.parquet"), schema)).count() == 1


def test_latest_status_as_a_stream(spark, tmp_path):
    rows = [(1, 7, at(1), 0.0, 0), (2, 7, at(3), 0.0, 0), (3, 8, at(2), 0.0, 0)]
    src = str(tmp_path / "in")
    write(spark, src, rows[:1], 0)
    write(spark, src, rows[1:], 1)
    events = stream(spark, src).select(F.col("pixel_id").alias("job_id"), "ts", "event_id", F.concat(F.lit("s"), "event_id").alias("status"))
    query = logs.job_latest_status(events).writeStream.outputMode("complete").format("memory").queryName("latest_status").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.job_id: (r.status, r.events) for r in spark.table("latest_status").collect()} == {7: ("s2", 2), 8: ("s3", 1)}


EVENT = "job_id string, ts timestamp, event_id long, status string"


def event_stream(spark, path, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{path}/batch={n}")
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_job_status_out_of_order_equals_batch(spark, tmp_path):
    batches = [
        [("a", at(1, 1), 1, "queued"), ("b", at(1, 2), 2, "queued")],
        [("a", at(1, 5), 5, "done"), ("a", at(1, 5), 4, "running"), ("c", at(1, 6), 6, "queued")],
        [("a", at(1, 3), 3, "running"), ("b", at(1, 7), 7, "running"), (None, at(1, 7), 8, "odd")],  # late for a, in time for the watermark
    ]
    events = event_stream(spark, str(tmp_path / "in"), batches)
    states = jobs.latest_states(spark, jobs.stream_job_status(events, "4 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = logs.job_latest_status(spark.createDataFrame([r for b in batches for r in b], EVENT))
    got = {r.job_id: r for r in states.collect()}
    assert {j: (r.updated, r.status, r.events) for j, r in got.items()} == {r.job_id: (r.updated, r.status, r.events) for r in batch.collect()}
    assert (got["a"].late, got["b"].late) == (1, 0) and not any(r.idle for r in got.values())


def test_silent_jobs_become_idle_and_wake(spark, tmp_path):
    batches = [
        [("a", at(1), 1, "running"), ("b", at(1), 2, "running")],
        [("b", at(9), 3, "running")],   # the watermark passes two days after the first events
        [("c", at(9, 1), 4, "queued")],
        [("a", at(9, 2), 5, "done"), ("c", at(2), 6, "too late")],
    ]
    events = event_stream(spark, str(tmp_path / "in"), batches)
    states = jobs.latest_states(spark, jobs.stream_job_status(events, "2 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.job_id, r.status, r.idle, r.events) for r in states.collect()} == {
        ("a", "done", False, 2), ("b", "running", False, 2), ("c", "queued", False, 1)}
    seen = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert {(r.job_id, r.updated) for r in seen.where("idle").collect()} == {("a", at(1))}
    # without a last word everybody ends idle
    quiet = event_stream(spark, str(tmp_path / "in2"), [*batches[:1], [("z", at(20), 9, "running")]])
    last = jobs.latest_states(spark, jobs.stream_job_status(quiet, "2 days", "1 day"), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert {(r.job_id, r.idle) for r in last.collect()} == {("a", True), ("b", True), ("z", False)}


def test_stream_fold_has_all_statistics_within_its_error(spark, tmp_path):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) ** 3 for _ in range(20_000)]
    rows = [(i, 1, at(1 + i % 2, i % 24), v, 0) for i, v in enumerate(values)] + [(-1, 2, at(1), 7.0, 0), (-2, 3, at(1), None, 0)]
    src = str(tmp_path / "in")
    for n in range(4):
        write(spark, src, rows[n::4], n)
    folded = so.replay(so.stream_fold(stream(spark, src), width="1 day"), "all", ("pixel_id", "start"))
    assert folded.columns[3:] == list(FOLD_NAMES)
    exact = spark.createDataFrame(rows, SCHEMA).groupBy("pixel_id", F.window("ts", "1 day").start.alias("start")).agg(
        *statistic_aggregates([n for n in FOLD_NAMES if n[0] != "Q" and n != "IQR"])).select(
        "pixel_id", "start", *statistic_columns([n for n in FOLD_NAMES if n[0] != "Q" and n != "IQR"]))
    want = {(r.pixel_id, r.start): r.asDict() for r in exact.collect()}
    for r in folded.collect():
        for n, v in want[r.pixel_id, r.start].items():
            assert getattr(r, n) == (v if not isinstance(v, float) else pytest.approx(v)), n
        if r.pixel_id == 1:
            group = sorted(v for i, v in enumerate(values) if 1 + i % 2 == r.start.day)
            for q in ("Q10", "Q25", "Q50", "Q75", "Q90"):
                place = bisect.bisect(group, getattr(r, q)) / len(group)
                assert abs(place - int(q[1:]) / 100) <= rank_error(400) + 2 / len(group), q
        else:
            assert (r.Q50, r.NUM) == ((7.0, 1) if r.pixel_id == 2 else (None, 0))
    with pytest.raises(ValueError):
        so.stream_fold(stream(spark, src), ("Q33",))


def test_job_events_without_an_identifier_count(spark, tmp_path):
    rows = [("a", at(1, 1), None, "queued"), ("a", at(1, 2), None, "running"), ("b", at(1, 2), 2, "queued")]
    events = event_stream(spark, str(tmp_path / "in"), [rows])
    states = jobs.latest_states(spark, jobs.stream_job_status(events, "4 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.job_id, r.updated, r.status, r.events) for r in states.collect()} == {("a", at(1, 2), "running", 2), ("b", at(1, 2), "queued", 1)}
