"""Streaming predict-then-learn equals the batch fold when files arrive in order."""

import datetime

from pyspark.sql import functions as F

from conftest import SF_SMALL
from streamlearn.plans import LearnerConfig, fold_models, fold_predictions
from streamlearn.sources import fixtures as FX
from streamlearn.streaming.online import ordered_file_source, run_to_completion, stream_learn, stream_periods


def _blocks(df, ts="ts"):
    return df.withColumn("block", F.floor(F.datediff(ts, F.lit("2020-01-01")) / 6))


def test_stream_learn_equals_batch(spark):
    s = FX.user_stream(spark, SF_SMALL)
    sdf, _ = ordered_file_source(_blocks(s), "block")
    cfg = [LearnerConfig.of("Perceptron", "perceptron"), LearnerConfig.of("kernel", "batch_kpa", gamma=0.5)]
    out = run_to_completion(stream_learn(sdf.drop("block"), cfg))
    last = {(r.stream, r.algo): r.p + 1 for r in out.groupBy("stream", "algo").agg(F.max("pos").alias("p")).collect()}
    batch = {(r.stream, r.algo): r.n for r in fold_models(s, cfg).collect()}
    assert last == batch
    got = {(r.stream, r.algo, r.id): (r.pred, round(r.score, 9)) for r in out.collect()}
    want = {(r.stream, r.algo, r.id): (r.pred, round(r.score, 9)) for r in fold_predictions(s, cfg).collect()}
    assert got == want


def test_stream_periods_drop_late_rows(spark):
    """Append mode: rows later than the watermark do not count, and open periods are not sent."""
    ev = FX.event_features(spark, SF_SMALL)
    feats = [f"n_{t}" for t in FX.EVENT_TYPES]
    first, last = ev.agg(F.min("timestamp"), F.max("timestamp")).first()
    ts = F.col("timestamp")
    late = ev.filter(ts < first + datetime.timedelta(days=1)).withColumn("user_id", F.lit(-1).cast("long"))
    close = ev.limit(1).withColumn("timestamp", F.lit(last + datetime.timedelta(days=3)).cast(ev.schema["timestamp"].dataType))
    days = _blocks(ev, "timestamp")
    sdf, _ = ordered_file_source(days.unionByName(late.withColumn("block", F.lit(99999).cast("long")))
                                 .unionByName(close.withColumn("block", F.lit(999999).cast("long"))), "block", ["timestamp"])
    out = run_to_completion(stream_periods(sdf, feats, width="1 hour", delay="1 day"))
    from streamlearn.operators.aggregate import aggregate_periods
    b = aggregate_periods(ev, feats, period="1 hour").withColumn("ts", F.col("ts").cast("timestamp"))
    assert out.count() == b.count() and out.exceptAll(b.select(out.columns)).count() == 0
