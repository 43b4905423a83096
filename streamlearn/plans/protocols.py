"""Training and evaluation protocols (T1-T16) built on the keyed fold.

Multi-epoch protocols are short driver loops (one Spark job per epoch, at most
``max_epochs``); the per-epoch model table is checkpointed to the shared
checkpoint folder so lineage stays one epoch long and a lost executor
re-reads files.  Data never passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.functions.hashing import hash32
from streamlearn.operators.aggregate import vector_moments
from streamlearn.operators.metrics import SELECT_METRICS, confusion_counts, rates, selection_metric
from streamlearn.operators.order import DEFAULT_ORDER, min_rows
from streamlearn.operators.scan import _changes, prefix_scan, whole_runs
from streamlearn.operators.score import BLOCK_PARTS, _packed, score_linear
from streamlearn.plans.fold import MODEL_FIELDS, STATE_COLS, fold_models, fold_predictions
from streamlearn.plans.learners import LearnerConfig
from streamlearn.session import reliable_checkpoint, written


def predict_then_learn(df, configs, keys=("stream",), order=DEFAULT_ORDER, **kw) -> DataFrame:
    """Single pass, one prediction per row and config (made before the update)."""
    return fold_predictions(df, configs, keys, order, **kw)


def _val_scores(val: DataFrame, models: DataFrame, keys, metric="f1", tie=1.0) -> DataFrame:
    s = score_linear(val, models.select(*keys, "algo", "w", "b"), on=list(keys), tie=tie)
    c = confusion_counts(s, [*keys, "algo"])
    return c.select(*keys, "algo", selection_metric(metric).alias("val_score"))


def fit_epochs(train: DataFrame, val: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",),
               max_epochs: int = 10, patience: int = 3, metric: str = "f1", seed: int = 42,
               order=DEFAULT_ORDER) -> DataFrame:
    """Multi-epoch training with early stopping.

    Epoch e folds the rows in hash(42 + e, id) order starting from the current
    state (t keeps counting).  The validation score (``metric``: f1, recall,
    fnr_min, accuracy) of each epoch's model is compared with the best so far;
    a strict improvement keeps that model, otherwise a miss is counted, and a
    (key, config) stops after ``patience`` misses: later epochs neither fold nor
    compare it, so its result does not depend on other configurations.  With one
    epoch the rows are folded in time order.  Returns the best model per (key,
    config) with ``epoch``.  Each epoch folds once; its model table is written
    to the checkpoint folder before it is scored.
    """
    keys = list(keys)
    best = state = None
    train, val = (train, val) if max_epochs == 1 else (written(train, "train"), written(val, "val"))
    for e in range(max_epochs):
        if max_epochs > 1:
            d, o = train.withColumn("_o", hash32("id", seed + e)), ["_o", "id", "x", "y"]
        else:
            d, o = train, list(order)
        if best is not None:
            live = best.filter(F.col("misses") < patience).select(*keys, "algo")
            state = state.join(live, [*keys, "algo"], "left_semi")
            d = d.join(live.select(*keys).distinct(), keys, "left_semi")
        m = reliable_checkpoint(fold_models(d, configs, keys, o, init=state, init_only=True))
        cur = (m.join(_val_scores(val, m, keys, metric), [*keys, "algo"], "left")
                .withColumn("val_score", F.coalesce("val_score", F.lit(0.0))).withColumn("epoch", F.lit(e)))
        state = m.select(*keys, "algo", *STATE_COLS)
        if best is None:
            best = reliable_checkpoint(cur.withColumn("misses", F.lit(0)))
        else:
            best = reliable_checkpoint(_keep_better(best, cur, keys))
        if max_epochs == 1 or best.filter(F.col("misses") < patience).isEmpty():
            break
    return best


def online_to_batch(train: DataFrame, val: DataFrame, configs: Sequence[LearnerConfig], epochs: int = 10, metrics: Sequence[str] = SELECT_METRICS,
                    keys=("stream",), seed: int = 42) -> DataFrame:
    """``epochs`` shuffled epochs, each from the whole state of the one before, without stopping; for every metric the first
    epoch of the best validation score.  One fold per epoch serves all metrics.

    Returns one row per (key, algo, metric) with ``epoch``, ``val_score`` and the model's state."""
    keys, state, tables = list(keys), None, []
    by = [*keys, "algo"]
    train = written(train, "train")
    for e in range(epochs):
        m = fold_models(train.withColumn("_o", hash32("id", seed + e)), configs, keys, ["_o", "id", "x", "y"], init=state)
        state = written(m.select(*by, *STATE_COLS), "epoch")
        tables.append(state.withColumn("epoch", F.lit(e)))
    models = tables[0]
    for t in tables[1:]:
        models = models.unionByName(t)
    c = confusion_counts(score_linear(val, models.select(*by, "epoch", "w", "b"), on=keys), [*by, "epoch"])
    scored = models.join(c.select(*by, "epoch", F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[selection_metric(m) for m in metrics])).alias("_s")),
                         [*by, "epoch"], "left")
    each = scored.select(*models.columns, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col("_s")[m], F.lit(0.0)).alias("val_score")) for m in metrics])).alias("_m"))
    w = Window.partitionBy(*by, "metric").orderBy(F.desc("val_score"), "epoch")
    return each.select(*models.columns, "_m.metric", "_m.val_score").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def with_class_weights(df: DataFrame, keys=("stream",)) -> DataFrame:
    """A6 on rows: ``wt`` = n / (2 n_class) within the key (1 where the other class is empty does not arise: the row's own class has a row)."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("_p"))
    w = F.col("_n") / (2.0 * F.when(F.col("y") > 0, F.col("_p")).otherwise(F.col("_n") - F.col("_p")))
    return df.join(c, list(keys)).withColumn("wt", w).drop("_n", "_p")


def kernel_epochs(df: DataFrame, configs: Sequence[LearnerConfig], epochs: int = 3, keys=("stream",),
                  shuffle: bool = False, seed: int = 42, order=DEFAULT_ORDER) -> DataFrame:
    """``epochs`` passes of a batch kernel rule in one fold; the epoch leads the order of the rows.

    ``shuffle`` orders each epoch by hash(seed + epoch, id) (R9); otherwise every epoch is in time order.  K12's
    epochs run over rows that a task holds (``plans.epochs``), but for long streams.
    """
    from streamlearn.plans.epochs import epoch_models, has_epochs

    def folded(df):
        d, by = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))), order
        if shuffle:
            # hash32 takes a fixed seed, so each epoch's key is its own expression
            key = F.coalesce(*[F.when(F.col("epoch") == e, hash32("id", seed + e)) for e in range(epochs)])
            d, by = d.withColumn("_o", key), ["_o", "id", "x", "y"]
        return fold_models(d, configs, keys, ["epoch", *by], streams=(df, 1))
    if has_epochs(df, [c.shipped() for c in configs], epochs):
        return epoch_models(df, configs, epochs, keys, order, seed if shuffle else None, MODEL_FIELDS, folded)
    return folded(df)


def multi_kernel(df: DataFrame, gamma: float = 0.1, members: int = 5, spread: float = 2.0, epochs: int = 30,
                 beta: float = 1.5, max_sv: int = 1000, keys=("stream",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members are K12 rules with gammas spread geometrically over [gamma/spread, gamma*spread], trained for
    ``epochs`` shuffled passes with class weights; scores are averaged (C4) and the F-beta threshold tuned per key (T13).

    Returns (models, mean scores of the training rows, thresholds)."""
    from streamlearn.operators.score import ensemble_mean, score_kernel_keyed
    steps = [0.0] if members == 1 else [2.0 * i / (members - 1) - 1.0 for i in range(members)]
    cfg = [LearnerConfig.of(f"member{i}", "batch_kogc", gamma=gamma * spread ** e, max_sv=max_sv) for i, e in enumerate(steps)]
    weighted = written(with_class_weights(df, keys), "weighted")
    models = written(kernel_epochs(weighted, cfg, epochs, keys, shuffle=True), "models")
    scores = written(ensemble_mean(score_kernel_keyed(df, models, cfg, keys), keys), "mean-scores")
    return models, scores, tune_threshold(scores, beta, list(keys))


def continue_online(df: DataFrame, models: DataFrame, configs, keys=("stream",), order=DEFAULT_ORDER) -> DataFrame:
    """Warm-start pass over new rows: ``w`` (and bias) carried over, every
    other state part reset (confidence 1, gradients 0, t 0)."""
    init = models.select(*keys, "algo", "w", F.lit(None).cast("array<double>").alias("sigma"),
                         F.lit(None).cast("array<double>").alias("g"),
                         F.lit(None).cast("array<double>").alias("g1t"), "b", F.lit(None).cast("long").alias("t"))
    return fold_predictions(df, configs, keys, order, init=init)


def pass_through(train: DataFrame, test: DataFrame, configs, keys=("stream",)) -> DataFrame:
    """T4: one pass over train then test (per key); predictions of the test part."""
    u = train.withColumn("part_pos", F.lit(0)).unionByName(test.withColumn("part_pos", F.lit(1)))
    p = fold_predictions(u, configs, keys, ["part_pos", "ts", "id", "x", "y"], passthrough=["part_pos"])
    return p.filter(F.col("part_pos") == 1).drop("part_pos")


def fit_freeze_score(train: DataFrame, test: DataFrame, configs, keys=("stream",), tie=1.0,
                     order=DEFAULT_ORDER) -> DataFrame:
    """T5: train once, freeze, score the test rows (joined on the key)."""
    m = fold_models(train, configs, keys, order)
    return score_linear(test, m.select(*keys, "algo", "w", "b"), on=list(keys), tie=tie)


def prequential(preds: DataFrame, keys=("stream", "algo"), pos: str = "pos") -> DataFrame:
    """Compare the prediction at t with the truth at t+1; the last row drops.  A prefix scan from the end, so a
    long stream spans tasks."""
    d = prefix_scan(preds, keys, [f"-{pos}"], previous={"_next": "y"})
    return d.filter(F.col("_next").isNotNull()).withColumn("y", F.col("_next")).drop("_next")


def best_of_shuffles(train: DataFrame, val: DataFrame, configs, k: int = 10, keys=("stream",),
                     metric: str = "f1", seed: int = 42) -> DataFrame:
    """K independent shuffles (each from zero) run in parallel as an
    extra key; the best by validation score per (key, config) wins (first
    shuffle on a tie)."""
    spark = train.sparkSession
    sh = spark.range(k).select(F.col("id").cast("int").alias("shuffle"))
    # the shuffle's own mix enters before the rounds of the hash, so the orders are unrelated
    d = train.crossJoin(F.broadcast(sh)).withColumn("_o", hash32(F.col("id").bitwiseXOR(hash32("shuffle", seed + 7)), seed))
    m = reliable_checkpoint(fold_models(d, configs, [*keys, "shuffle"], ["_o", "id", "x", "y"], streams=(train, k)))
    sc = _val_scores(val.crossJoin(F.broadcast(sh)), m, [*keys, "shuffle"], metric)
    j = m.join(sc, [*keys, "shuffle", "algo"])
    w = Window.partitionBy(*keys, "algo").orderBy(F.desc("val_score"), F.col("shuffle"))
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _count_blocks(batches, models: int = 128):
    """M2 counts of every model of a packed row on the row's packed validation points, each counted as often as it has
    rows; dot products run left to right."""
    for rb in batches:
        for w, number, x, y, times in zip(*(rb.column(c).to_pylist() for c in ("w", "_m", "x", "y", "n"))):
            m, positive, times = np.frombuffer(number, np.int64), np.frombuffer(y) != -1.0, np.frombuffer(times, np.int64)
            each = np.stack([times * positive, times * ~positive], 1).astype(np.float64)     # whole numbers, so sums are exact
            x, w = np.frombuffer(x).reshape(len(positive), -1), np.frombuffer(w).reshape(len(m), -1)
            hit = np.zeros((len(m), 2), np.int64)
            for a in range(0, len(m), models):
                part = w[a:a + models]                       # the bias is the last coordinate
                s = np.zeros((len(part), len(x)))
                for j in range(x.shape[1]):
                    s += part[:, j, None] * x[None, :, j]
                s += part[:, -1, None]
                said = ~np.isfinite(s) | (s >= 0)            # a score that is not finite counts as 0, a tie as +1
                hit[a:a + models] = said.astype(np.float64) @ each
            tp, fp = hit.T
            n, rest = each.sum(0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (m, tp, fp, rest - fp, n - tp)], names=["_m", "tp", "fp", "tn", "fn"])


def pooled_scores(val: DataFrame, models: DataFrame, metric: str = "f1") -> DataFrame:
    """``models`` (a written table) with ``val_score``: every model on all rows of ``val``, whatever their key.

    Equal rows are scored once and counted as often as they occur.  These points and the models travel as packed blocks,
    a pair of blocks is one matrix product; no pair of point and model becomes a row, and nothing passes through the
    driver.  Without validation rows the result is empty."""
    tasks = val.sparkSession.sparkContext.defaultParallelism
    numbered = models.withColumn("_m", F.monotonically_increasing_id())
    left = (numbered.select(F.concat("w", F.array(F.coalesce("b", F.lit(0.0)))).alias("x"), "_m").repartition(tasks)
                    .mapInArrow(_packed("x", "_m"), "x binary, _m binary").withColumnRenamed("x", "w"))
    points = val.groupBy("x", F.col("y").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    right = points.mapInArrow(_packed("x", "y", "n"), "x binary, y binary, n binary").repartition(BLOCK_PARTS)
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    counts = (pairs.mapInArrow(_count_blocks, "_m long, tp long, fp long, tn long, fn long")
                   .groupBy("_m").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))
    return numbered.join(counts.select("_m", selection_metric(metric).alias("val_score")), "_m").drop("_m")


def fit_per_entity(train: DataFrame, val: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",), epochs: int = 3,
                   min_train: int = 10, refit: Sequence[str] = (), metric: str = "f1", seed: int = 42) -> DataFrame:
    """One model per entity with at least ``min_train`` training rows: the first best of ``epochs`` shuffled epochs
    by validation score pooled over all rows of ``val`` (other entities' rows).

    Epoch e folds in hash(seed + e, id) order, from the state of the epoch before; configurations labelled in
    ``refit`` have no incremental step and start every epoch from zero.  Returns the models with ``epoch`` and
    ``val_score``; ``average_models`` makes the consensus of them."""
    keys, state, tables = list(keys), None, []
    data = written(min_rows(train, min_train, keys), "train")
    for e in range(epochs):
        m = reliable_checkpoint(fold_models(data.withColumn("_o", hash32("id", seed + e)), configs, keys, ["_o", "id", "x", "y"], init=state))
        tables.append(m.withColumn("epoch", F.lit(e)))
        state = m.filter(~F.col("algo").isin(list(refit))).select(*keys, "algo", *STATE_COLS)
    models = tables[0]
    for t in tables[1:]:
        models = models.unionByName(t)
    w = Window.partitionBy(*keys, "algo").orderBy(F.desc("val_score"), "epoch")
    return pooled_scores(val, models, metric).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def average_models(models: DataFrame, by: Sequence[str] = ("algo",)) -> DataFrame:
    """Consensus model = coordinate-wise mean of weights (and bias) over keys, one row per ``by`` group with a
    d-length array.  Whole vectors are aggregated, on the map side first."""
    # the bias travels as a last coordinate, so the models are read once
    e = models.select(*by, F.concat("w", F.array(F.coalesce("b", F.lit(0.0)))).alias("_w"))
    m = vector_moments(e, "_w", by)
    return m.select(*by, F.slice("mean", F.lit(1), F.size("mean") - 1).alias("w"), F.element_at("mean", -1).alias("b"),
                    F.col("n").alias("n_models"))


def adapt_per_entity(df: DataFrame, w0: DataFrame, configs, keys=("stream",), order=DEFAULT_ORDER) -> DataFrame:
    """Every entity starts from the same model ``w0`` (one row per config,
    broadcast) and adapts along its own sequence."""
    ents = df.select(*keys).distinct()
    init = ents.crossJoin(F.broadcast(w0.select("algo", *[c for c in STATE_COLS if c in w0.columns])))
    for c in STATE_COLS:
        if c not in init.columns:
            init = init.withColumn(c, F.lit(None).cast("long" if c == "t" else ("double" if c == "b" else "array<double>")))
    return fold_predictions(df, configs, keys, order, init=init)


def adapt_and_freeze(df: DataFrame, w0: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",), refit: Sequence[str] = (),
                     window: int = 100, order=DEFAULT_ORDER) -> DataFrame:
    """T11 whole: ``adapt_per_entity`` beside the frozen baseline (``algo`` + "/frozen": ``w0`` on every row, not adapted).

    Configurations labelled in ``refit`` have no incremental step: after row i they are fitted anew on rows
    i - ``window`` .. i.  Returns keys, algo, id, ts, y, pred, score."""
    cfg = [LearnerConfig.of(c.label, "refit", inner=c.name, W=window, **dict(c.params)) if c.label in refit else c for c in configs]
    w0 = reliable_checkpoint(w0.select("algo", "w", "b"))
    cols = [*keys, "algo", "id", "ts", "y", "pred", "score"]
    frozen = score_linear(df, w0).withColumn("algo", F.concat("algo", F.lit("/frozen")))
    return adapt_per_entity(df, w0, cfg, keys, order).select(*cols).unionByName(frozen.select(*cols))


def exact_percentiles(df: DataFrame, col: str, shares: Sequence[float]) -> list[float]:
    """Linearly interpolated percentiles of a whole column without gathering it: distinct values are counted and
    range-sorted, partitions are numbered through, and a pass over the sorted values fetches those (at most two per
    share) at the wanted positions, found by binary search in the running counts."""
    counts = written(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
                       .repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id()), "values")
    sizes = sorted((r["p"], r["s"]) for r in counts.groupBy("p").agg(F.sum("n").alias("s")).collect())     # one number a partition
    total = sum(n for _, n in sizes)
    if not total:
        return []
    at = [q * (total - 1) for q in shares]
    need = np.array(sorted({int(a) for a in at} | {min(int(a) + 1, total - 1) for a in at}), np.int64)
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0] + [n for _, n in sizes]).tolist()))
    held = [p for p, n in sizes if ((need >= starts[p]) & (need < starts[p] + n)).any()]                   # only these are read

    def hits(batches):
        done = {}
        for rb in batches:
            ps, vs, ns = (rb.column(c).to_numpy() for c in ("p", "v", "n"))
            for p in np.unique(ps).tolist():
                here = ps == p
                upto = done.get(p, starts[p]) + np.cumsum(ns[here])
                lo = upto[0] - ns[here][0]
                mine = need[(need >= lo) & (need < upto[-1])]
                done[p] = int(upto[-1])
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(vs[here][np.searchsorted(upto, mine, "right")])], names=["i", "v"])
    rows = counts.filter(F.col("p").isin(held)).repartition("p").sortWithinPartitions("p", "v").mapInArrow(hits, "i long, v double").collect()
    value = {r["i"]: r["v"] for r in rows}                                                                 # at most two a share
    return [value[int(a)] + (a - int(a)) * (value[min(int(a) + 1, total - 1)] - value[int(a)]) for a in at]


def grouped_percentiles(df: DataFrame, g: Sequence[str], col: str, shares: Sequence[float], name: str = "_thr") -> DataFrame:
    """``exact_percentiles`` of every group at once: (g, ``name`` array).

    Distinct values of a group are counted (map-side) and numbered by one keyed prefix scan, so a group with a third
    of all rows is spread over tasks.  A value that covers the positions [a, b) of its group answers the shares whose
    position, or the one after it, lies there; only those rows meet their group again."""
    g = list(g)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*g, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = written(prefix_scan(counts, g, ["_v"], {"_b": "_c"}), "values")
    sizes = upto.groupBy(*g).agg(F.max("_b").alias("_N"))
    share = np.array(list(shares), np.float64)
    d = upto.join(sizes, g).select(*g, "_v", (F.col("_b") - F.col("_c")).alias("_a"), "_b", "_N")
    schema = T.StructType([d.schema[c] for c in g] + [T.StructField("_k", T.IntegerType()), T.StructField("lo", T.DoubleType()),
                                                      T.StructField("hi", T.DoubleType()), T.StructField("f", T.DoubleType())])

    def hits(batches):
        for rb in batches:
            v, a, b, n = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("_v", "_a", "_b", "_N"))
            for k, q in enumerate(share):
                at = q * (n - 1)
                low = np.floor(at).astype(np.int64)
                is_low, is_high = (low >= a) & (low < b), (np.minimum(low + 1, n - 1) >= a) & (np.minimum(low + 1, n - 1) < b)
                here = np.flatnonzero(is_low | is_high)
                if len(here):
                    lo, hi = pa.array(v[here], mask=~is_low[here]), pa.array(v[here], mask=~is_high[here])
                    yield pa.RecordBatch.from_arrays([*[rb.column(c).take(pa.array(here)) for c in g], pa.array(np.full(len(here), k, np.int32)), lo, hi,
                                                      pa.array((at - low)[here])], names=schema.names)
    ends = d.mapInArrow(hits, schema).groupBy(*g, "_k").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("f").alias("f"))
    one = ends.select(*g, F.struct("_k", (F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))).alias("t")).alias("e"))
    return one.groupBy(*g).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias(name))


def tune_threshold(train_scores: DataFrame, beta: float = 1.5, g: Sequence[str] = (), score: str = "score",
                   y: str = "y") -> DataFrame:
    """candidates = exact percentiles 1..99 of the training scores; rows at or above a candidate are
    predicted +1; the one maximising F-beta wins (1e-9 in denominators, strict >, so the first best).

    Scores are written once.  A task finds by binary search how many of the 99 sorted candidates a row reaches and
    counts rows per (group, bucket); each of the <= 100 bucket rows adds its counts to the candidates it reaches.
    Groups of up to ``GROUP_ROWS`` rows do all of that in one task, many groups at a time (``_small_groups``).
    """
    g = list(g)
    pcts = [i / 100.0 for i in range(1, 100)]
    one = F.when(F.col(y) > 0, 1).otherwise(0)
    d = written(train_scores.select(*g, F.col(score).cast("double").alias("_s"), one.alias("_y")), "scores")
    if not g:
        return _best_threshold(d, g, pcts, beta)
    sizes = d.filter("_s is not null").groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= GROUP_ROWS:
        return _small_groups(d, g, pcts, beta)
    large = written(sizes.filter(F.col("_n") > GROUP_ROWS).select(*g), "large-groups")
    return _small_groups(d.join(large, g, "left_anti"), g, pcts, beta).unionByName(_best_threshold(d.join(large, g, "left_semi"), g, pcts, beta))


#: Rows of a group whose threshold is tuned in one task, and rows of the groups that are handled together, about.
GROUP_ROWS, GROUP_BLOCK = 100_000, 32_768


def _small_groups(d: DataFrame, g: list[str], shares: Sequence[float], beta: float) -> DataFrame:
    """``_best_threshold`` of groups that fit in a task: one shuffle, then the candidates, counts and F-beta of all groups of
    a block as matrices (groups x candidates)."""
    counts = (d.filter(" and ".join(["_s is not null", *[f"`{c}` is not null" for c in g]])).repartition(*g)
               .groupBy(*g, "_s").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")).sortWithinPartitions(*g, "_s"))
    schema = T.StructType([*[d.schema[c] for c in g], T.StructField("k", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("tp", T.LongType()),
                           T.StructField("fp", T.LongType()), T.StructField("fn", T.LongType()), T.StructField("fbeta", T.DoubleType())])
    share, b2 = np.array(list(shares), np.float64), beta * beta

    def best(b):
        start = np.concatenate([[0], np.flatnonzero(_changes(b, g))])
        m = np.diff([*start, b.num_rows])
        of, width = np.repeat(np.arange(len(m)), m), len(share) + 1
        s, pos, neg = (b.column(b.num_columns - 3 + j).to_numpy(zero_copy_only=False) for j in range(3))
        upto = np.cumsum(pos + neg)
        before = upto[start] - (pos + neg)[start]
        n = np.add.reduceat(pos + neg, start)[:, None]
        at = share * (n - 1)
        low = np.floor(at).astype(np.int64)
        lo, hi = (s[np.searchsorted(upto, before[:, None] + i, "right")] for i in (low, np.minimum(low + 1, n - 1)))
        t = lo + (at - low) * (hi - lo)
        reached = np.concatenate([(t[of[i:i + 8192]] <= s[i:i + 8192, None]).sum(1) for i in range(0, len(s), 8192)])
        tp, fp = (np.bincount(of * width + reached, v, len(m) * width).astype(np.int64).reshape(-1, width)[:, ::-1].cumsum(1)[:, ::-1][:, 1:] for v in (pos, neg))
        fn = np.add.reduceat(pos, start)[:, None] - tp
        p, r = tp / (tp + fp + 1e-9), tp / (tp + fn + 1e-9)
        f = (1 + b2) * p * r / (b2 * p + r + 1e-9)
        k = f.argmax(1)                                      # the first best
        take = lambda v: pa.array(v[np.arange(len(m)), k])
        return pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(start)) for j in range(len(g))], pa.array((k + 1).astype(np.int32)), take(t), take(tp), take(fp), take(fn),
                                           take(f)], names=schema.names)

    def run(batches):
        for b in whole_runs(batches, g, GROUP_BLOCK):
            with np.errstate(all="ignore"):
                yield best(b)
    return counts.mapInArrow(run, schema)


def _best_threshold(d: DataFrame, g: list[str], pcts: Sequence[float], beta: float) -> DataFrame:
    """The threshold of a written table of scores ``_s`` and labels ``_y`` (1 or 0), per group; a group may be spread over tasks."""
    if g:
        cand = written(grouped_percentiles(d, g, "_s", pcts), "candidates")
        d = d.filter("_s is not null").groupBy(*g, "_s").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")).join(cand, g)

        def reached(batches):
            for rb in batches:
                t = np.asarray(rb.column("_thr").flatten(), np.float64).reshape(rb.num_rows, -1)
                b = (t <= rb.column("_s").to_numpy()[:, None]).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[rb.column(x) for x in g], pa.array(b), rb.column("_pos"), rb.column("_neg")], names=[*g, "_b", "_pos", "_neg"])
        kept = T.StructType([d.schema[x] for x in g] + [T.StructField("_b", T.IntegerType()), T.StructField("_pos", T.LongType()), T.StructField("_neg", T.LongType())])
        c = d.mapInArrow(reached, kept).groupBy(*g, "_b").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    else:
        thr = exact_percentiles(d, "_s", pcts)
        cand = d.sparkSession.createDataFrame([(thr,)] if thr else [], "_thr array<double>")
        edges = np.array(thr, np.float64)

        def counted(batches):
            total = np.zeros((len(edges) + 1, 2), np.int64)
            for rb in batches:
                known = rb.column(0).is_valid().to_numpy(zero_copy_only=False)
                b = np.searchsorted(edges, rb.column(0).to_numpy(zero_copy_only=False)[known], "right")
                pos = rb.column(1).to_numpy()[known]
                total[:, 0] += np.bincount(b[pos == 1], minlength=len(total))
                total[:, 1] += np.bincount(b[pos == 0], minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])],
                                             names=["_b", "_pos", "_neg"])
        c = (d.select("_s", "_y").mapInArrow(counted, "_b int, _pos long, _neg long")
              .groupBy("_b").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")).filter("_pos + _neg > 0"))
    tot = c.groupBy(*g).agg(F.sum("_pos").alias("_P"))
    above = (c.filter(F.col("_b") >= 1)
              .select(*g, F.explode(F.sequence(F.lit(1), F.col("_b"))).alias("k"), "_pos", "_neg")
              .groupBy(*g, "k").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp")))
    ks = cand.select(*g, F.posexplode("_thr").alias("k", "threshold")).withColumn("k", F.col("k") + 1)
    cc = ks.join(above, [*g, "k"], "left").join(tot, g) if g else \
        ks.join(above, ["k"], "left").crossJoin(tot)
    cc = (cc.withColumn("tp", F.coalesce("tp", F.lit(0)).cast("long"))
            .withColumn("fp", F.coalesce("fp", F.lit(0)).cast("long"))
            .withColumn("fn", (F.col("_P") - F.col("tp")).cast("long")).drop("_P"))
    b2 = beta * beta
    p = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-9)
    r = F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9)
    cc = cc.withColumn("fbeta", (1 + b2) * p * r / (b2 * p + r + 1e-9))
    w = Window.partitionBy(*g).orderBy(F.desc("fbeta"), F.col("k")) if g else \
        Window.partitionBy(F.lit(0)).orderBy(F.desc("fbeta"), F.col("k"))
    return cc.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: Rows of one shard where the number of shards is not given.
ROWS_PER_SHARD = 250_000


def _kernel_class(c: LearnerConfig):
    """The kernel rule of a configuration, None for linear rules."""
    from streamlearn.plans.kernels import KERNEL_LEARNERS
    return KERNEL_LEARNERS.get(c.name)


def merge_kernels(models: DataFrame, configs: Sequence[LearnerConfig], shards: int, by: Sequence[str]) -> DataFrame:
    """The mean of shards' kernel models: the union of their vectors, told apart by row id, with alphas summed and divided
    by the number of shards, in the order of (shard, insertion); beyond a rule's budget the vectors of largest |alpha| stay."""
    by = list(by)
    budget = {c.label: dict(c.params).get("max_sv", 1000 if c.name.startswith("batch_") else None) for c in configs}
    limit = F.coalesce(*[F.when(F.col("algo") == k, F.lit(v)) for k, v in budget.items() if v is not None], F.lit(2**31 - 1))
    d = F.floor(F.size("sigma") / F.size("w")).cast("int")
    e = (models.filter(F.size("w") > 0).withColumn("_d", d)
               .select(*by, "shard", "sigma", "g", "_d", F.posexplode("w").alias("_i", "_w"))
               .select(*by, F.struct("shard", "_i").alias("_at"), F.element_at("g", F.col("_i") + 1).alias("_id"), "_w",
                       F.slice("sigma", F.col("_i") * F.col("_d") + 1, F.col("_d")).alias("_x")))
    # a vector without an id is one of its own
    own = F.when(F.isnan("_id"), F.col("_at"))
    v = (e.groupBy(*by, "_id", own.alias("_own")).agg((F.sum("_w") / F.lit(float(shards))).alias("_w"), F.min_by("_x", "_at").alias("_x"), F.min("_at").alias("_at")))
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("_w")), "_at")
    v = v.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    m = v.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_w", "_x", "_id"))).alias("_v"))          # at most a budget of vectors
    m = m.select(*by, F.transform("_v", lambda s: s["_w"]).alias("w"), F.flatten(F.transform("_v", lambda s: s["_x"])).alias("sigma"),
                 F.transform("_v", lambda s: s["_id"]).alias("g"))
    none = F.array().cast("array<double>")
    t = models.groupBy(*by).agg(F.max("t").alias("t"))
    return (t.join(m, by, "left").select(*by, *[F.coalesce(c, none).alias(c) for c in ("w", "sigma", "g")],
                                         F.array(F.lit(0.0), F.lit(0.0)).alias("g1t"), F.lit(0.0).alias("b"), "t"))


def fit_mixed(df: DataFrame, configs, shards: int | None = None, epochs: int = 1, keys=("stream",),
              order=DEFAULT_ORDER, seed: int = 42, val: DataFrame | None = None, patience: int = 3, metric: str = "f1") -> DataFrame:
    """Parameter mixing for a very large stream.  Rows are split into
    ``shards`` by hash(id); every shard folds (in order) from the same start
    model, shard models are averaged per key, and the average seeds the next
    epoch.  One shard equals the exact sequential fold.  Without ``shards`` their
    number follows from the rows of the largest key.  (Iterative parameter
    mixing, McDonald et al. 2010.)

    Linear models are averaged by coordinate; kernel models are merged as a union of vectors (``merge_kernels``; rules
    whose vectors carry more than an alpha, or that keep running gradients, are refused).  Linear and kernel rules do not mix in one call.

    With ``val`` the average of every round is scored on it (``metric``) as in T2: a strict improvement keeps it, and a
    (key, configuration) stops after ``patience`` misses.  The result then has ``epoch``, ``val_score`` and ``misses``."""
    from streamlearn.operators.score import score_kernel_keyed
    from streamlearn.plans.kernels import KRDA, KAdaRDA
    keys, configs = list(keys), list(configs)
    kernels = [_kernel_class(c) for c in configs]
    kernel = all(kernels)
    if not kernel and any(kernels):
        raise ValueError("mix linear and kernel rules in separate calls")
    if any(k.MORE or issubclass(k, (KRDA, KAdaRDA)) for k in kernels if k):
        raise ValueError("only kernel rules whose vectors carry nothing but an alpha can be merged")
    if shards is None:
        most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        shards = max(1, -(-most // ROWS_PER_SHARD))
    d = df.withColumn("shard", F.pmod(hash32("id", seed), F.lit(shards)).cast("int"))
    by, state, best = [*keys, "algo"], None, None
    none = F.lit(None).cast("array<double>")
    for e in range(epochs):
        init, live = None, None
        if best is not None:
            live = best.filter(F.col("misses") < patience).select(*by)
            state = state.join(live, by, "left_semi")
            d = d.join(live.select(*keys).distinct(), keys, "left_semi")
        if state is not None:
            sh = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
            init = state.crossJoin(F.broadcast(sh))
        folded = fold_models(d, configs, [*keys, "shard"], order, init=init, init_only=live is not None)
        if kernel:
            mean = merge_kernels(folded, configs, shards, by).select(*by, *STATE_COLS)
        else:
            mean = average_models(folded, by=by).select(*by, "w", none.alias("sigma"), none.alias("g"), none.alias("g1t"), "b", F.lit(None).cast("long").alias("t"))
        state = reliable_checkpoint(mean)
        if val is None:
            continue
        if kernel:
            c = confusion_counts(score_kernel_keyed(val, state, configs, keys), by)
            scores = c.select(*by, selection_metric(metric).alias("val_score"))
        else:
            scores = _val_scores(val, state, keys, metric)
        cur = (state.join(scores, by, "left").withColumn("val_score", F.coalesce("val_score", F.lit(0.0))).withColumn("epoch", F.lit(e)))
        best = reliable_checkpoint(cur.withColumn("misses", F.lit(0)) if best is None else _keep_better(best, cur, keys))
        if best.filter(F.col("misses") < patience).isEmpty():
            break
    if val is not None:
        return best
    return state.select(*by, *(STATE_COLS if kernel else ["w", "b"]))


def _keep_better(best: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The better of two rounds' models per (key, configuration), counting misses; one that did not run stays as it is."""
    by = [*keys, "algo"]
    b = best.alias("b").join(cur.alias("c"), by, "left")
    ran = F.col("c.epoch").isNotNull()
    better = ran & (F.col("c.val_score") > F.col("b.val_score"))
    return b.select(*by, *[F.when(better, F.col(f"c.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cur.columns if c not in by],
                    F.when(better, F.lit(0)).when(ran, F.col("b.misses") + 1).otherwise(F.col("b.misses")).alias("misses"))


def logistic_baseline(train: DataFrame, l2: float = 0.01, max_iter: int = 1000):
    """L2-regularised logistic regression baseline (pyspark.ml, distributed
    L-BFGS).  C = 1/l2 in the reference's solver corresponds to regParam =
    l2 / n here; the intercept is not penalised, so coefficients are close
    but not identical."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    n = train.count()
    d = train.select(array_to_vector("x").alias("features"), F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("label"))
    lr = LogisticRegression(regParam=l2 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return lr.fit(d)


#: The reference's gamma grid.
GAMMA_GRID = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0)


def tune_gamma(train: DataFrame, val: DataFrame, gammas: Sequence[float] = GAMMA_GRID, max_sv: int = 200,
               epochs: int = 1, keys=("stream",)) -> DataFrame:
    """The gamma of the best validation F1 per key (first on a tie).  All gammas are configurations of one
    fold (K9); the validation rows meet the models of their key in a second fold that does not learn."""
    from streamlearn.operators.score import score_kernel_keyed
    keys = list(keys)
    cfg = [LearnerConfig.of(f"{i:03d}", "batch_kpa", gamma=g, C=1.0, max_sv=max_sv) for i, g in enumerate(gammas)]
    models = kernel_epochs(train, cfg, epochs, keys)
    c = confusion_counts(score_kernel_keyed(val, models, cfg, keys), [*keys, "algo"])
    c = c.withColumn("val_score", selection_metric("f1"))
    w = Window.partitionBy(*keys).orderBy(F.desc("val_score"), "algo")
    grid = F.array(*[F.lit(float(g)) for g in gammas])
    return (c.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
             .select(*keys, F.element_at(grid, F.col("algo").cast("int") + 1).alias("gamma"), "val_score"))
