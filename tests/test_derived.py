"""Derived data: found again without a scan, computed once, gone when a file changes."""

import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.sources import derived


def jobs(spark, run):
    """The jobs that a call starts."""
    group = f"derived-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_second_call_runs_no_scan(spark, tmp_path):
    path = str(tmp_path / "volume")
    spark.range(1000).withColumn("v", F.col("id") % 7).coalesce(2).write.parquet(path)
    scans = []

    def compute():
        scans.append(1)
        return spark.read.parquet(path).agg(F.min("v").alias("low"), F.max("v").alias("high"))

    volume = derived.files_hash(spark, [path])
    first, started = jobs(spark, lambda: derived.derived(spark, volume, "range", compute))
    assert started > 0 and first.first() == (0, 6)
    again, started = jobs(spark, lambda: derived.derived(spark, derived.files_hash(spark, [path]), "range", compute))
    assert started == 0 and scans == [1] and again.first() == (0, 6) and again.schema == first.schema
    assert path not in "".join(again.inputFiles())
    derived.derived(spark, volume, "other", compute)
    assert scans == [1, 1]
    spark.range(5).withColumn("v", F.lit(99).cast("long")).coalesce(1).write.mode("append").parquet(path)
    assert derived.files_hash(spark, [path]) != volume
    derived.forget(spark, volume, "range")
    derived.derived(spark, volume, "range", compute)
    assert scans == [1, 1, 1]


def test_several_ask_at_once(spark, monkeypatch):
    monkeypatch.setattr(derived, "LOOK", 0.02)
    calls, out = [], []

    def compute():
        calls.append(1)
        time.sleep(0.5)
        return spark.range(3).toDF("n")

    volume = uuid.uuid4().hex  # results outlive a session
    asking = [threading.Thread(target=lambda: out.append(derived.derived(spark, volume, "rows", compute).count())) for _ in range(6)]
    for t in asking:
        t.start()
    for t in asking:
        t.join()
    assert calls == [1] and out == [3] * 6


def test_errors_and_lost_owners(spark, monkeypatch):
    monkeypatch.setattr(derived, "LOOK", 0.02)

    def fails():
        raise ValueError("no")

    volume = uuid.uuid4().hex
    with pytest.raises(ValueError):
        derived.derived(spark, volume, "failing", fails)
    assert derived.derived(spark, volume, "failing", lambda: spark.range(2).toDF("n")).count() == 2
    system, claim = derived._file_system(spark, derived._folder(spark, volume, "left") + ".claim")
    system.createNewFile(claim)  # by one who is gone
    assert derived.derived(spark, volume, "left", lambda: spark.range(4).toDF("n"), patience=0.1).count() == 4
