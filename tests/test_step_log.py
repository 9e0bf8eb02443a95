"""Streams of a training log against the same log as a table."""

import random

import pytest
from pyspark.sql import functions as F

from duotext.operators import training_log
from duotext.sources import versions
from duotext.streaming import step_log

SCHEMA = "run string, epoch int, at long, phase string, loss double, accuracy double, seconds double"


def log(n=90, seed=3):
    rnd = random.Random(seed)
    rows = []
    for at in range(n):
        loss = rnd.choice([None, float("nan"), 0.5, rnd.random() * 1.5, rnd.random() / (1 + at)])
        rows.append((rnd.choice(["hot", "hot", "a", "b", None]), at // 30, at, rnd.choice(["train", "valid"]), loss, rnd.random(), 30.0 * at))
    return rows


@pytest.fixture
def arrive(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    return add


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def test_flags_of_a_log_that_arrives_in_parts(spark, tmp_path, arrive):
    rows, out, checkpoint = log(), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def go():
        flagged = step_log.best_so_far_stream(stream(spark, tmp_path), "loss", "at", "run")
        step_log.write_flags(flagged, out, checkpoint, availableNow=True).awaitTermination(120)

    arrive(rows[:20])
    arrive(rows[20:25])
    go()
    arrive(rows[25:70])  # the query has ended meanwhile, and goes on from its checkpoint
    arrive(rows[70:])
    go()
    go()
    found = spark.read.parquet(out).orderBy("at").collect()
    table = spark.createDataFrame(rows, SCHEMA)
    expected = training_log.best_so_far(table.withColumn("loss", F.nanvl("loss", F.lit(None).cast("double"))), "loss", "at", "run").orderBy("at").collect()
    assert [r.at for r in found] == list(range(90))
    assert [r.saved for r in found] == [r.saved for r in expected] and any(r.saved for r in found)


def test_statistics_of_a_log_that_arrives_in_parts(spark, tmp_path, arrive):
    rows, out, checkpoint = [r for r in log() if r[4] == r[4]], str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in (rows[:30], rows[30:]):
        arrive(part)
        step_log.write_epoch_stats(stream(spark, tmp_path), out, checkpoint, availableNow=True).awaitTermination(120)
    newest = versions.versions(spark, out)[-1]
    expected = training_log.epoch_stats(spark.createDataFrame(rows, SCHEMA))
    assert versions.manifest(spark, newest)["recipe"] == {"batch": 1}

    def shown(df):
        return sorted((r.epoch, round(r.train_loss, 9), round(r.valid_loss, 9), round(r.valid_accuracy, 9), r.train_time, r.valid_time) for r in df.collect())

    assert shown(spark.read.parquet(newest)) == shown(expected)


def test_a_late_row_is_judged_by_what_came_before_it(spark, tmp_path, arrive):
    out = str(tmp_path / "out")
    arrive([("a", 0, 5, "valid", 0.4, 0.0, 0.0)])
    arrive([("a", 0, 3, "valid", 0.6, 0.0, 0.0), ("a", 0, 7, "valid", 0.3, 0.0, 0.0)])
    flagged = step_log.best_so_far_stream(stream(spark, tmp_path), "loss", "at", "run")
    step_log.write_flags(flagged, out, str(tmp_path / "c"), availableNow=True).awaitTermination(120)
    assert [(r.at, r.saved) for r in spark.read.parquet(out).orderBy("at").collect()] == [(3, False), (5, True), (7, True)]
