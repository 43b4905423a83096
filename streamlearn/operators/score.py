"""Scoring and attribution.

Model tables are small (one row per stream and config, or a support-vector
budget) and are joined, not collected.  ``score_linear`` broadcasts a model
table only when it is keyed by config alone; per-stream models are joined on
the stream key (a shuffle-free join when both sides are partitioned on it).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.functions.labels import sign_pred
from streamlearn.functions.vectors import dot
from streamlearn.session import written


def score_linear(df: DataFrame, models: DataFrame, on: Sequence[str] = (), tie: float = 1.0,
                 threshold: float | None = None, broadcast_models: bool | None = None) -> DataFrame:
    """score = w.x + b, pred = sign(score) (tie value on 0) or, with a
    threshold, +1 if score > threshold else -1.  ``models`` holds ``w`` and
    optionally ``b`` plus the join keys ``on`` and any config columns."""
    m = models.select(*on, *[c for c in models.columns if c not in on and c not in df.columns])
    if "b" not in m.columns:
        m = m.withColumn("b", F.lit(0.0))
    if broadcast_models is None:
        broadcast_models = not on
    m = F.broadcast(m) if broadcast_models else m
    j = df.join(m, list(on)) if on else df.crossJoin(m)
    # one evaluation of the dot product: the guard looks at the one value of an array
    s = F.array(dot("x", "w") + F.coalesce(F.col("b"), F.lit(0.0)))
    j = j.withColumn("score", F.transform(s, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))[0])
    if threshold is None:
        return j.withColumn("pred", sign_pred("score", tie))
    return j.withColumn("pred", F.when(F.col("score") > threshold, 1.0).otherwise(-1.0))


def score_kernel(df: DataFrame, svs: DataFrame, gamma: float | str = 1.0, block: int = 20_000) -> DataFrame:
    """f(x) = sum_j alpha_j exp(-gamma ||x - sv_j||^2) on every row; pred = +1 if f >= 0 (no vector: 0).

    ``svs`` has ``x`` and ``alpha``; ``gamma`` is a number or a column of ``svs``.  Rows keep their columns.
    Up to ``block`` vectors (counted first) travel with the task, in one pass over the rows.  With more vectors every
    distinct ``x`` is scored once: these and the vectors travel as packed blocks, a pair of blocks is one matrix product, and
    the sums go back to the rows by ``x``.  Nothing passes through the driver, no pair of a row and a vector becomes a row,
    and disk holds the two tables and a few partial sums of each distinct ``x``.
    """
    g = F.col(gamma) if isinstance(gamma, str) else F.lit(float(gamma))
    sv = svs.select(F.col("x").alias("v"), F.col("alpha").cast("double").alias("a"), g.cast("double").alias("g"))
    n = sv.count()
    if n > block:
        out = _score_blocks(df, sv)
    else:
        rows = sorted((list(r["v"]), r["a"], r["g"]) for r in sv.collect()) if n else []         # at most `block` vectors
        out = df.withColumn("score", F.lit(0.0))
        out = _add_kernel_block(out, rows) if rows else out
    return out.withColumn("pred", F.when(F.col("score") >= 0, 1.0).otherwise(-1.0))


def _matrix(col) -> np.ndarray:
    """An Arrow column of vectors of one length as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), len(flat) // max(len(col), 1))


def _kernel_sums(m: np.ndarray, v: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """sum_j a_j exp(-g_j ||row - v_j||^2) of every row of ``m``, at most 4 million kernel values at a time."""
    norms, out = (v * v).sum(1), np.zeros(len(m))
    step = max(1, 4_000_000 // max(len(v), 1))
    for i in range(0, len(m), step):
        p = m[i:i + step]
        d = np.maximum((p * p).sum(1)[:, None] + norms - 2.0 * (p @ v.T), 0.0)
        out[i:i + step] = np.exp(-g * d) @ a
    return out


def _add_kernel_block(df: DataFrame, rows) -> DataFrame:
    v, a, g = (np.array(c, dtype=np.float64) for c in zip(*rows))

    def run(batches):
        for b in batches:
            x, k = b.column(b.schema.get_field_index("x")), b.schema.get_field_index("score")
            if len(x):
                yield b.set_column(k, "score", pa.array(_kernel_sums(_matrix(x), v, a, g)))
    return df.mapInArrow(run, df.schema)


#: Partitions of the smaller side of a product of packed blocks: every one of them is read by every task's rows.
BLOCK_PARTS = 4


def _packed(*names: str):
    """One row per Arrow batch: the matrix of its first column (vectors) and its further columns, as bytes."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                cols = [np.ascontiguousarray(_matrix(b.column(0)), np.float64)] + [b.column(j).to_numpy(zero_copy_only=False) for j in range(1, len(names))]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=list(names))
    return run


def _score_blocks(df: DataFrame, sv: DataFrame) -> DataFrame:
    """Scores of the distinct ``x`` (rows of a kernel sum depend on nothing else), joined back to the rows."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    points = written(df.select("x").distinct().withColumn("_row", F.monotonically_increasing_id()), "kernel-points")
    left = points.repartition(tasks).mapInArrow(_packed("x", "_row"), "x binary, _row binary")
    right = sv.select("v", "a", "g").mapInArrow(_packed("v", "a", "g"), "v binary, a binary, g binary").repartition(BLOCK_PARTS)

    def meet(batches):
        for b in batches:
            for x, row, v, a, g in zip(*(b.column(c).to_pylist() for c in ("x", "_row", "v", "a", "g"))):
                row, a = np.frombuffer(row, np.int64), np.frombuffer(a)
                part = _kernel_sums(np.frombuffer(x).reshape(len(row), -1), np.frombuffer(v).reshape(len(a), -1), a, np.frombuffer(g))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(part)], names=["_row", "_part"])

    parts = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(meet, "_row long, _part double")
    total = parts.groupBy("_row").agg(F.sum("_part").alias("score"))
    scored = points.join(total, "_row").select("x", F.col("score").alias("_score"))
    return df.join(scored, "x", "left").select(*[c for c in df.columns if c != "score"], F.coalesce("_score", F.lit(0.0)).alias("score"))


def _sums(x: np.ndarray, models) -> np.ndarray:
    """Scores (rows x models) under models (gamma, empty, alphas, vectors); summed over the vectors in order of insertion, to the
    last bit as a learner does.  At most 2 million kernel values at a time."""
    out = np.empty((len(x), len(models)))
    sizes = [len(m[2]) for m in models]
    v, a, g = np.concatenate([m[3] for m in models]), np.concatenate([m[2] for m in models]), np.repeat([-m[0] for m in models], sizes)
    ends, step = np.cumsum(sizes).tolist(), max(1, 2_000_000 // max(len(v), 1))
    for i in range(0, len(x), step):
        rows, k = x[i:i + step], 0.0
        for j in range(x.shape[1]):
            part = v[:, j] - rows[:, j, None]
            part *= part
            k = k + part
        k = np.exp(k * g)
        k *= a
        for m, (end, n) in enumerate(zip(ends, sizes)):
            out[i:i + step, m] = np.cumsum(k[:, end - n:end], axis=1)[:, -1] if n else models[m][1]
    return out


def score_kernel_keyed(df: DataFrame, models: DataFrame, configs, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """C3 with a model per key and configuration: rows meet the models of their key, which do not learn.

    The model rows travel in front of the key's rows, so memory is one key's models however many rows it has.  All rows of a
    key in an Arrow batch are scored as one matrix; the columns are those of ``fold_predictions``.
    """
    from streamlearn.operators.scan import _changes
    from streamlearn.plans.fold import DEFAULT_ORDER, _start_rows, _unpack
    from streamlearn.plans.kernels import KERNEL_LEARNERS
    keys, configs = list(keys), list(configs)
    rules = [(KERNEL_LEARNERS[c.name], float(dict(c.params).get("gamma", 1.0))) for c in configs]
    none = F.lit(None).cast("array<double>")
    # a score takes alphas and vectors only
    start = _start_rows(models.select(*keys, "algo", "w", "sigma", none.alias("g"), none.alias("g1t"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("t")), configs, keys)
    cols = list(dict.fromkeys([*keys, "ts", "id", "x", "y"]))
    d = df.select(*cols).withColumn("_k", F.lit(1)).unionByName(start, allowMissingColumns=True)
    d = d.repartition(*keys).sortWithinPartitions(*keys, "_k", *DEFAULT_ORDER)
    kinds = {f.name: f.dataType for f in d.schema.fields}
    d = d.select(*keys, "_k", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("algo", T.StringType()), T.StructField("id", kinds["id"]),
                           T.StructField("ts", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("pred", T.DoubleType()),
                           T.StructField("score", T.DoubleType()), T.StructField("pos", T.LongType())])
    labels = pa.array([c.label for c in configs], pa.string())

    def run(batches):
        held, packed, last, pos = {}, {}, None, 0            # the key's models by configuration; those not unpacked yet
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            K = len(keys)
            change = _changes(b, keys)
            ends = [tuple(b.column(j)[i].as_py() for j in range(K)) for i in (0, n - 1)]
            change[0] = ends[0] != last
            last = ends[1]
            data, x, number = b.column(K).to_numpy() == 1, b.column(K + 1), b.column(K + 2).to_numpy(zero_copy_only=False)
            if x.null_count:
                raise TypeError("a row has no features")
            flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64)
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))])
            rows, which, scores, preds, places = [], [], [], [], []
            edges = np.union1d(np.flatnonzero(change), np.flatnonzero(data[1:] != data[:-1]) + 1).tolist()
            for lo, hi in zip([0, *(e for e in edges if e)], [*(e for e in edges if e), n]):
                if change[lo]:
                    held, packed, pos = {}, {}, 0
                if not data[lo]:
                    packed |= {int(number[r]): flat[upto[r]:upto[r + 1]] for r in range(lo, hi)}
                    continue
                m = hi - lo
                if packed or held:
                    width = int(upto[lo + 1] - upto[lo])
                    if (np.diff(upto[lo:hi + 1]) != width).any():
                        raise ValueError("rows of a stream have different numbers of features")
                    for c, v in packed.items():
                        st = _unpack(v)
                        w, sigma = (st["w"], st["sigma"]) if st["w"] is not None else (np.empty(0), np.empty(0))
                        held[c] = rules[c][1], rules[c][0].EMPTY, w, np.reshape(sigma, (len(w), width))
                    packed, mine = {}, sorted(held)
                    with np.errstate(all="ignore"):
                        s = _sums(flat[upto[lo]:upto[hi]].reshape(m, width), [held[c] for c in mine])
                    rows.append(np.repeat(np.arange(lo, hi), len(mine)))
                    which.append(np.tile(mine, m))
                    scores.append(s.ravel())
                    preds.append(np.stack([rules[c][0].labels(s[:, i]) for i, c in enumerate(mine)], axis=1).ravel())
                    places.append(np.repeat(np.arange(pos, pos + m), len(mine)))
                pos += m
            if rows:
                r, score, pred, place = (np.concatenate(v) for v in (rows, scores, preds, places))
                r, algo = pa.array(r), labels.take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([*[b.column(j).take(r) for j in range(K)], algo, b.column(K + 3).take(r), b.column(K + 4).take(r), b.column(K + 2).take(r),
                                                  pa.array(pred), pa.array(score), pa.array(place)], names=schema.names)
    return d.mapInArrow(run, schema).withColumn("ts", F.timestamp_micros("ts").cast(kinds["ts"]))


def ensemble_mean(scores: DataFrame, keys: Sequence[str] = ("stream",), threshold: float = 0.0,
                  carry: Sequence[str] = ("y",)) -> DataFrame:
    """C4: mean of the members' scores of each row, +1 at the threshold or above."""
    m = scores.groupBy(*keys, "id").agg(F.avg("score").alias("score"), *[F.first(c).alias(c) for c in carry])
    return m.withColumn("pred", F.when(F.col("score") >= threshold, 1.0).otherwise(-1.0))


def score_multi_kernel(df: DataFrame, svs: DataFrame, member: str = "member", gamma: str = "gamma",
                       threshold: float = 0.0) -> DataFrame:
    """C4 for members without keys: the mean of their scores is one sum with alphas divided by their number."""
    n = svs.select(member).distinct().count()
    out = score_kernel(df, svs.withColumn("alpha", F.col("alpha") / F.lit(float(max(n, 1)))), gamma=gamma)
    return out.withColumn("pred", F.when(F.col("score") >= threshold, 1.0).otherwise(-1.0))


def attribute(df: DataFrame, x: str, w: str, k: int = 3, names: Sequence[str] | None = None) -> DataFrame:
    """Append ``top``: the k largest contributions x_j w_j with their share (percent) of the positive total (1 if
    that is not positive).  Row-local array functions only."""
    total = F.aggregate("_c", F.lit(0.0), lambda a, v: a + F.greatest(v, F.lit(0.0)))
    d = df.withColumn("_c", F.zip_with(x, w, lambda a, b: a * b)).withColumn("_t", F.when(total > 0, total).otherwise(F.lit(1.0)))
    label = (lambda i: F.array(*[F.lit(n) for n in names])[i]) if names else (lambda i: F.concat(F.lit("f"), i.cast("string")))
    items = F.transform("_c", lambda v, i: F.struct((-v).alias("neg"), i.alias("feature"), label(i).alias("name"),
                                                    v.alias("contribution"), (F.lit(100.0) * v / F.col("_t")).alias("percent")))
    top = F.transform(F.slice(F.array_sort(items), 1, k),
                      lambda s: F.struct(*[s[n].alias(n) for n in ("feature", "name", "contribution", "percent")]))
    return d.withColumn("top", top).drop("_c", "_t")


def explain(df: DataFrame, models: DataFrame, on: Sequence[str] = (), k: int = 3,
            names: Sequence[str] | None = None) -> DataFrame:
    """Top-k attributions of each row under the model of its key (or the one model)."""
    m = models.select(*on, "w")
    j = df.join(m, list(on)) if on else df.crossJoin(F.broadcast(m))
    return attribute(j, "x", "w", k, names).drop("w")
