"""Streams out of order: rows wait for the watermark and are folded in event-time order."""

import datetime
import glob
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from streamlearn.plans import LearnerConfig, fold_models, fold_predictions
from streamlearn.session import checkpoint_dir
from streamlearn.sources import fixtures as FX
from streamlearn.streaming.online import replay_source, run_to_completion, stream_learn

CFG = [LearnerConfig.of("Perceptron", "perceptron"), LearnerConfig.of("AROW", "arow", r=0.1), LearnerConfig.of("kernel", "batch_kpa", gamma=0.5)]


def _rows(df):
    return {(r.stream, r.algo, r.id): (r.pred, round(r.score, 9), r.pos) for r in df.collect()}


def test_shuffled_files_equal_the_batch_fold(spark):
    s = FX.user_stream(spark, SF_SMALL)
    src = replay_source(s.withColumn("block", F.floor(F.datediff("ts", F.lit("2020-01-01")) / 6)), "block", close="20 days", files=2, rows_per_file=60)
    newest = max(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/src-*"), key=os.path.getmtime)
    assert len(glob.glob(newest + "/*.parquet")) > 12                     # blocks of many files
    out = run_to_completion(stream_learn(src, CFG, delay="6 days"))
    assert _rows(out) == _rows(fold_predictions(s, CFG))
    assert out.filter("stream is null").count() == 0                     # the closing row never gets out


def test_whole_table_in_one_shuffled_block(spark):
    """Delay as long as the table: nothing is folded before the end, from a warm start."""
    s = FX.user_stream(spark, SF_SMALL)
    start = fold_models(s, CFG[:1])
    src = replay_source(s.withColumn("block", F.lit(0)), "block", close="90 days", files=3)
    out = run_to_completion(stream_learn(src, CFG[:1], start, delay="40 days"))
    assert _rows(out) == _rows(fold_predictions(s, CFG[:1], init=start))


def test_late_rows_do_not_count_and_waiting_rows_stay(spark):
    at = lambda d, n=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, seconds=n)
    rows = [("a", at(0, 1), 1, 0), ("a", at(0, 0), 0, 0), ("a", at(9), 9, 1), ("b", at(1), 5, 1),      # block 1 moves the watermark to day 8
            ("a", at(2), 2, 2), ("a", at(8, 5), 8, 2),                                                  # the trigger that first sees that watermark
            ("a", at(3), 3, 3), ("a", at(8, 9), 10, 3), ("a", at(20), 20, 4)]                           # row 3 is late
    df = spark.createDataFrame([(s, t, i, [float(i), 1.0], 1.0, b) for s, t, i, b in rows], "stream string, ts timestamp, id long, x array<double>, y double, block int")
    src = replay_source(df.coalesce(1), "block", files=1, shuffle=False)                                # a file and a trigger per block
    out = run_to_completion(stream_learn(src, CFG[:1], delay="1 day"))
    got = {s: [r.id for r in sorted(out.filter(F.col("stream") == s).collect(), key=lambda r: r.pos)] for s in "ab"}
    assert got == {"a": [0, 1, 2, 8, 10, 9], "b": [5]}                    # row 20 still waits


def test_equal_times_and_paused_rows(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, i, [1.0], 1.0, i % 3 != 0, 0) for i in (4, 2, 0, 1, 3)] + [("a", t, 1, [1.0], -1.0, True, 0)],
                               "stream string, ts timestamp, id long, x array<double>, y double, active boolean, block int")
    out = run_to_completion(stream_learn(replay_source(df, "block", close="2 days"), CFG[:1], delay="1 day")).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.pos)] == [1, 1, 2, 4]


def test_streams_of_one_bucket_stay_apart(spark):
    """Few buckets of many streams: a state entry holds all streams of its bucket (before, one a stream); long ids stay whole."""
    s = FX.user_stream(spark, SF_SMALL).withColumn("id", F.col("id") + F.lit(2**60))
    cfg = CFG[:1]
    src = replay_source(s.withColumn("block", F.floor(F.datediff("ts", F.lit("2020-01-01")) / 10)), "block", close="30 days", files=2)
    out = run_to_completion(stream_learn(src, cfg, delay="10 days", buckets=2))
    assert _rows(out) == _rows(fold_predictions(s, cfg))
