"""Streaming predict-then-learn with keyed model state.

``stream_learn`` keeps one model per (stream, config) in Spark's state store
(``applyInPandasWithState``), the streams of a hash bucket in one entry.  Rows may arrive in any order: a key's rows wait in
its state until the watermark has passed them, then they are folded in (ts, id)
order; an event-time timeout wakes keys that get no new rows.  No row at or below
the watermark can still arrive (Spark drops it as late), so without late rows the
result equals the batch fold (T1) row for row.  State holds the models and the
rows of the last ``delay``; it survives restarts through the query checkpoint.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from streamlearn.operators.score import attribute, score_linear
from streamlearn.plans.fold import STATE_COLS
from streamlearn.plans.learners import LearnerConfig
from streamlearn.session import checkpoint_dir, written


def stream_periods(sdf: DataFrame, features: Sequence[str], ts: str = "timestamp", label: str = "label",
                   width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window period aggregates (sum of features, +1 if any
    positive); rows later than the watermark are dropped."""
    # event time must be TIMESTAMP (session time zone, UTC here) for the watermark
    sdf = sdf.withColumn(ts, F.col(ts).cast("timestamp"))
    g = sdf.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
    aggs = [F.sum(F.col(c).cast("double")).alias(c) for c in features]
    aggs.append(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_lab"))
    out = g.agg(*aggs)
    return out.select(F.col("w.start").alias("ts"), *features,
                      F.when(F.col("_lab") > 0, 1.0).otherwise(-1.0).alias("y"))


OUT_SCHEMA = ("stream string, algo string, id long, ts timestamp, x array<double>, y double, pred double, score double, "
              "pos long, w_before array<double>")
STATE_SCHEMA = "streams binary"
_HELD = ("ts", "id", "x", "y", "active")


def _learn_fn(configs: Sequence[LearnerConfig], wait: bool):
    cfgs = [c.shipped() for c in configs]

    def learn(name, saved, rows, upto, out):
        """Fold a stream's rows up to a time (None: all); its models in ``saved`` go on, the rows that wait are returned."""
        order = sorted(range(len(rows["ts"])), key=lambda i: (rows["ts"][i], rows["id"][i] is not None, rows["id"][i]))
        ready = order if upto is None else [i for i in order if rows["ts"][i] <= upto]
        pos0 = saved.get("_pos", 0)
        for c in cfgs:
            learner, pos = None, pos0
            for i in ready:
                if not rows["active"][i]:                       # W6: paused rows are skipped
                    continue
                x, y = [float(v) for v in rows["x"][i]], rows["y"][i]
                if learner is None:
                    learner = c.make(len(x))
                    if c.label in saved:
                        learner.load(saved[c.label])
                before = list(learner.w)
                p, s = learner.step_row(x, y, rows["id"][i], 1.0) if learner.rowwise else learner.step(x, y)
                out.append((name, c.label, rows["id"][i], rows["ts"][i], x, y, p, s, pos, before))
                pos += 1
            if learner is not None:
                saved[c.label] = learner.state() | {"mistakes": learner.mistakes}
        saved["_pos"] = pos0 + sum(1 for i in ready if rows["active"][i])
        rest = order[len(ready):]
        return {c: [rows[c][i] for i in rest] for c in _HELD}

    def fn(key, pdfs, state):
        held = pickle.loads(state.get[0]) if state.exists else {}           # stream -> [models, waiting rows]
        for pdf in (() if state.hasTimedOut else pdfs):          # this bucket's new rows, one Arrow batch at a time
            new = [pdf["ts"].astype("datetime64[us]").astype(np.int64).tolist(), [None if v is None else int(v) for v in pdf["id"]],
                   pdf["x"].tolist(), pdf["y"].tolist(), pdf["active"].tolist() if "active" in pdf.columns else [True] * len(pdf)]
            for n, (name, *row) in enumerate(zip(pdf["stream"], *new)):
                if name not in held:                            # T15: the start models came with the rows
                    start = pdf["start"].iloc[n] if "start" in pdf.columns else None
                    held[name] = [{r["algo"]: json.loads(r["state"]) for r in start} if start is not None else {}, {c: [] for c in _HELD}]
                for c, v in zip(_HELD, row):
                    held[name][1][c].append(v)
        watermark = state.getCurrentWatermarkMs() if wait else 0
        out = []
        for name, entry in held.items():
            if entry[1]["ts"]:
                entry[1] = learn(name, entry[0], entry[1], watermark * 1000 if wait else None, out)
        state.update((pickle.dumps(held),))
        first = min((entry[1]["ts"][0] for entry in held.values() if entry[1]["ts"]), default=None)
        if first is not None:                                   # wake up once the watermark is beyond the first waiting row
            state.setTimeoutTimestamp(max(watermark + 1, first // 1000))
        if not out:
            return
        table = pd.DataFrame(out, columns=["stream", "algo", "id", "ts", "x", "y", "pred", "score", "pos", "w_before"])
        table["id"] = table["id"].astype("Int64")
        table["ts"] = pd.to_datetime(table["ts"], unit="us")
        yield table

    return fn


def stream_learn(sdf: DataFrame, configs: Sequence[LearnerConfig], init: DataFrame | None = None, delay: str | None = None,
                 buckets: int = 512) -> DataFrame:
    """W2 (+ W6 via an optional boolean ``active`` column): streaming predict-then-learn per stream key with persistent
    model state, in event-time order.

    ``delay`` is how far rows may be out of order: rows wait until the watermark (largest ``ts`` less ``delay``) has
    passed them; rows that come later still are dropped.  Without ``delay`` nothing waits: the rows of a micro-batch are
    sorted and folded at once, for sources whose files arrive in order.  Streams are dealt by hash into ``buckets``, whose
    streams share one entry of the state store: a call for every single stream costs far more than its few new rows.  A task
    holds one bucket's models and waiting rows, so very many streams want more buckets.  T15: ``init`` is a model table (stream, algo, w, ...); a
    stream-static join lays a stream's models beside its rows, and its first rows start from them.  Emits one row per
    (row, config) with the row's x and the pre-update weights."""
    cols = ["stream", "id", "x", "y"] + (["active"] if "active" in sdf.columns else [])
    d = sdf.select(F.col("ts").cast("timestamp").alias("ts"), *cols)
    if delay is not None:
        d = d.withWatermark("ts", delay)
    if init is not None:
        state = F.struct("algo", F.to_json(F.struct(*[c for c in STATE_COLS if c in init.columns])).alias("state"))
        start = written(init.groupBy("stream").agg(F.collect_list(state).alias("start")), "models")      # one entry a configuration
        d = d.join(start, "stream", "left")                  # written once: every micro-batch would compute the models anew
    # ids travel as text, for pandas has no long column with nulls; rows without a stream (a closing row) are a bucket of their own
    bucket = F.when(F.col("stream").isNull(), -1).otherwise(F.pmod(F.xxhash64("stream"), F.lit(buckets)).cast("int"))
    return d.withColumn("id", F.col("id").cast("string")).withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        _learn_fn(configs, delay is not None), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout)


def stream_score(sdf: DataFrame, models: DataFrame, on: Sequence[str] = ("stream",), tie: float = 1.0) -> DataFrame:
    """Frozen-model scoring, a stream-static join with the model table, which is written once: Spark computes the static
    side of a join anew in every micro-batch."""
    return score_linear(sdf, written(models, "models"), on=list(on), tie=tie, broadcast_models=not on)


def stream_alerts(preds: DataFrame, k: int = 3, names: Sequence[str] | None = None) -> DataFrame:
    """Rows predicted +1 with their true class text and top-k attribution
    computed with the pre-update weights (``w_before``) and the row's ``x``."""
    a = preds.filter(F.col("pred") == 1.0).withColumn("true_class", F.when(F.col("y") > 0, "threat").otherwise("benign"))
    return attribute(a, "x", "w_before", k, names)


def stream_rates(preds: DataFrame, keys: Sequence[str] = ("stream", "algo")) -> DataFrame:
    """Running FNR / FPR / threat counters per stream (update-mode aggregate)."""
    yp, pp = F.col("y") > 0, F.col("pred") > 0
    c = lambda e: F.sum(F.when(e, 1).otherwise(0)).cast("long")
    g = preds.groupBy(*keys).agg(c(yp & pp).alias("tp"), c(~yp & pp).alias("fp"), c(~yp & ~pp).alias("tn"),
                                 c(yp & ~pp).alias("fn"), c(pp).alias("threats"), F.count(F.lit(1)).alias("seen"))
    return (g.withColumn("fnr", F.when(F.col("fn") + F.col("tp") > 0, F.col("fn") / (F.col("fn") + F.col("tp"))).otherwise(0.0))
             .withColumn("fpr", F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0)))


def run_to_completion(sdf: DataFrame) -> DataFrame:
    """Run an append-mode query with ``trigger(availableNow=True)`` into parquet files in the shared
    checkpoint folder and return them as a batch DataFrame."""
    spark = sdf.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (sdf.writeStream.outputMode("append").format("parquet").option("path", base + "/out")
           .option("checkpointLocation", base + "/_chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(base + "/out")


def run_updates(sdf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode aggregate; every micro-batch's changed rows are written under its batch number (a repeated
    batch replaces its own files), and the last row of each key is returned."""
    spark = sdf.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/updates-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
    q = (sdf.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", base + "/_chk")
           .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(base + "/out")
    rest = [c for c in sdf.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def replay_source(df: DataFrame, block: str, ts: str = "ts", close: str | None = None, files: int = 8, rows_per_file: int = 100_000,
                  shuffle: bool = True) -> DataFrame:
    """Replay a table as a file stream: its blocks (column ``block``, e.g. days) arrive one after another, each written by
    all tasks at once into files of bounded rows; ``files`` are read per trigger.

    With ``shuffle`` rows are dealt at random inside a block, so they are out of order by up to a block's length.
    ``close`` is an interval: a last row so long after the last real one, null in all other columns, moves the watermark."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/src-{uuid.uuid4().hex}"
    rows = df.drop(block)
    for (value,) in sorted(df.select(block).distinct().collect()):              # one value a block
        part = df.filter(F.col(block) == F.lit(value)).drop(block)
        part = part.repartition(files, F.rand(7)) if shuffle else part
        part.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(base)
    if close:
        last = rows.agg(F.max(ts).alias("m"))
        last.select(*[(F.col("m") + F.expr(f"interval {close}")).cast(t).alias(c) if c == ts else F.lit(None).cast(t).alias(c)
                      for c, t in rows.dtypes]).write.mode("append").parquet(base)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(base)


def ordered_file_source(df: DataFrame, part_col: str, order: Sequence[str] = ("ts",)) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared checkpoint folder as one file per ``part_col`` value (e.g. day), value after value,
    and open it as a file stream of one file per trigger: files are taken by age, so they arrive in order.
    Each block is one task's work: for small tables; ``replay_source`` has no such limit."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/src-{uuid.uuid4().hex}"
    for (value,) in sorted(df.select(part_col).distinct().collect()):           # one value a file
        (df.filter(F.col(part_col) == F.lit(value)).coalesce(1).sortWithinPartitions(*[c for c in order if c in df.columns])
           .write.mode("append").parquet(base))
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(base)
    return sdf, base
