"""Streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import capture
from scriptorium.session import table
from scriptorium.streaming import capture_stream as S


@pytest.fixture(scope="module")
def source(spark, sf_dir, tmp_path_factory):
    """The events in order, in four files: four micro-batches."""
    path = str(tmp_path_factory.mktemp("events"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for day in range(4):
        events.where(F.expr(f"(day(ts) - 1) div 8 = {day}")).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_hourly(spark, sf_dir, source):
    got = run(spark, S.hourly(S.read_events(spark, source, 1)), "hourly", "update")
    got = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = capture.hourly(table(spark, sf_dir, "events")).select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gaps_across_batches(spark, sf_dir, source):
    got = run(spark, S.keystroke_gaps(S.read_events(spark, source, 1)), "gaps")
    want = capture.keystroke_gaps(table(spark, sf_dir, "events")).where("gap_ms >= 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_and_dedup(spark, sf_dir, source):
    n = table(spark, sf_dir, "events").count()
    assert run(spark, S.first_seen(S.read_events(spark, source, 8)), "once").select("event_id").distinct().count() == n
    assert run(spark, S.sessions(S.read_events(spark, source, 8)), "sessions").agg(F.sum("events")).first()[0] > 0.9 * n


def test_rate_limit(spark, source):
    got = run(spark, S.rate_limiter(1)(S.read_events(spark, source, 8)), "limited")
    assert got.where("allowed").count() > 0 and got.count() == 1000


def test_snapshot_changes(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 10), ("a", "2024-01-01 01:00:00", 3000), ("a", "2024-01-01 02:00:00", 5), ("b", "2024-01-01 00:00:00", 6000)]
    spark.createDataFrame(rows, "path string, t string, size_now long").select("path", F.to_timestamp("t").alias("ts"), "size_now").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("path string, ts timestamp, size_now long").parquet(str(tmp_path / "s"))
    got = [(r["path"], r["change"]) for r in run(spark, S.snapshot_changes(stream), "changes").orderBy("path", "ts").collect()]
    assert got == [("a", "new"), ("a", "paste"), ("a", "delete"), ("b", "paste")]


def test_learning(spark, sf_dir):
    from scriptorium.operators import learning

    rows = learning.feature_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).cache()
    assert learning.calibrated(learning.cross_validate(rows, 2)).count() == rows.count()
    assert 0 <= learning.ensemble(rows, {"logistic": 1.0, "svm": 0.5}).agg(F.max("score")).first()[0] <= 1
