import os
import time

import pytest

from tapisan.sources import sinks
from tapisan.streaming.jobs import Jobs


def test_jobs(spark):
    jobs = Jobs(spark)
    batch = lambda: (spark.range(10).count(), 4)
    done = jobs.wait(jobs.start("all", [batch] * 3))
    assert (done.status, done.processed, done.saved) == ("COMPLETED", 30, 12)
    assert jobs.wait(jobs.start("target", [batch] * 9, target=5)).saved == 8

    def fails():
        raise ValueError("no page")

    bad = jobs.wait(jobs.start("bad", [batch, fails, batch]))
    assert (bad.status, bad.saved, bad.error) == ("FAILED", 4, "no page")
    def slow():
        time.sleep(0.3)
        return spark.range(10).count(), 1

    j = jobs.start("slow", [slow] * 100)
    end = time.time() + 30
    while jobs.get(j).processed < 1 and time.time() < end:
        time.sleep(0.05)
    jobs.pause(j)
    time.sleep(1.5)
    n = jobs.get(j).processed
    time.sleep(0.8)
    assert jobs.get(j).status == "PAUSED" and jobs.get(j).processed == n
    jobs.resume(j)
    jobs.stop(j)
    assert jobs.wait(j, 30).status == "STOPPED" and jobs.get(j).processed < 1000
    assert {r.status for r in jobs.all().collect()} == {"COMPLETED", "FAILED", "STOPPED"} and len(jobs.get(j).events) > 3
    with pytest.raises(KeyError):
        jobs.get("none")


def test_sinks_swap(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.read.parquet(path).filter("id > 0"), path)  # computed from what it replaces
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_table(spark.range(3).selectExpr("assert_true(id < 2)", "id"), path)
    assert spark.read.parquet(path).count() == 2 and os.listdir(tmp_path) == ["runs"]
    bridge = spark.createDataFrame([("r", "a", 0), ("r", "b", 1)], "run_id string, article_id string, pos int")
    for _ in range(2):
        sinks.append_bridge(bridge, str(tmp_path / "bridge"), "r")
    assert spark.read.parquet(str(tmp_path / "bridge")).count() == 2
    file = str(tmp_path / "schedule.json")
    assert sinks.read_settings(spark, file) == {}
    sinks.write_settings(spark, {"hour": 1}, file)
    sinks.write_settings(spark, {"hour": 2}, file)
    assert sinks.read_settings(spark, file) == {"hour": 2}
