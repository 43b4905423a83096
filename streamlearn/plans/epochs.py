"""Epochs of K12 over streams whose rows a task holds: rows are shuffled once, a kernel value is computed once.

K12 learns from signs alone: a row that is missed adds 2 wt y to the alpha of its own vector.  A task that holds the rows
of a stream therefore keeps f at all of its points: a miss adds the step times a row of the kernel matrix, and a row that
is not missed costs a look-up.  Epochs are orders of the held rows, not copies of them in a shuffle.  As in ``lockstep``,
many streams (and all configurations) take a step as one numpy operation.

Such an f and the keyed fold's, summed over the vectors in order of insertion, differ by rounding only, and by less than
a bound (``_learn``).  Where |f| is within the bound the fold's own sum decides.  So every decision, and with them the
models and counts, equals the keyed fold's to the last bit (tests).

Streams of more rows than ``HELD`` or than a budget has vectors go the keyed fold's way.  Streams with null ids, with
an id at several points or with labels besides -1 and +1 are learned by the scalar rule, in the same task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.functions.hashing import hash32_array
from streamlearn.operators.scan import _changes, whole_runs
from streamlearn.plans.learners import LearnerConfig
from streamlearn.plans.lockstep import KERNEL_STREAMS, dealt

#: Rows of the longest stream that is held; rows of a block, about; bytes of the kernel matrices of the streams that step together.
HELD, BLOCK_ROWS, KERNEL_BYTES = 1024, 32_768, 64 << 20

_NEVER = np.iinfo(np.int64).max


def has_epochs(df: DataFrame, configs: Sequence[LearnerConfig], epochs: int) -> bool:
    """Whether the configurations are K12 rules, and ids are whole numbers."""
    return (epochs > 1 and all(c.code is None and c.name == "batch_kogc" and {k for k, _ in c.params} <= {"gamma", "max_sv"} for c in configs)
            and dict(df.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"))


def _learn(x, held, y, wt, orders, gammas):
    """K12 on S streams and M gammas: x (S, E, d) points, held (S, P) the point of every row, y (+-1; 0: no row) and wt
    (S, P), ``orders`` the rows' order (S, P) in every epoch, rows that are none last.  Streams come in order of their
    rows, most first.  Returns alphas and steps of insertion (S M, E) and misses by label (two of S M).

    The bound: after T misses whose steps sum up to A in size, f kept up to date and f summed over the alphas differ from the
    exact sum by about (T + 1) u A and (T + E + 1) u A (recursive sums; kernel values are at most 1).  ``near`` is more than
    both at an epoch's end, were all of its rows missed."""
    (S, E, d), M, P = x.shape, len(gammas), held.shape[1]
    lanes = S * M
    dist, v = np.zeros((S, E, E)), np.empty((S, E, E))
    for j in range(d):
        np.subtract(x[:, None, :, j], x[:, :, None, j], out=v)
        v *= v
        dist += v
    kernel = np.empty((S, M, E, E))
    for m, g in enumerate(gammas):
        np.exp(np.multiply(dist, -g, out=v), out=kernel[:, m])
    del dist, v
    kernel = kernel.reshape(lanes * E, E)
    f, alpha, first = np.zeros((lanes, E)), np.zeros((lanes, E)), np.full((lanes, E), _NEVER)
    flat, alphas, firsts = f.reshape(-1), alpha.reshape(-1), first.reshape(-1)      # views
    missed, size = np.zeros((2, lanes), np.int64), np.zeros(lanes)                  # misses of label -1 and of label +1; size of the steps
    rows = (y != 0).sum(1)
    active = [int(np.searchsorted(-rows, -t, "left")) * M for t in range(P)]        # lanes that have a row t
    steps, eps = 2.0 * wt * y, 4.0 * np.finfo(np.float64).eps
    most = np.repeat(np.abs(steps).sum(1), M)
    each = lambda v: np.ascontiguousarray(np.repeat(v, M, axis=0).T)
    part, moved, base = np.empty((lanes, E)), np.empty((lanes, E)), np.arange(lanes) * E
    for e, o in enumerate(orders):
        at_all = each(np.take_along_axis(held, o, 1)) + base
        step_all, yes_all = each(np.take_along_axis(steps, o, 1)), each(np.take_along_axis(y, o, 1) > 0)
        near, misses = (missed.sum(0) + P + E + 4) * eps * (size + most), np.zeros((P, lanes), bool)
        for t in range(P):
            a = active[t]
            if not a:
                break
            at = at_all[t, :a]
            v = flat.take(at)
            said = v > 0
            sure = np.abs(v) > near[:a]
            if not sure.all():                               # NaN is not sure
                u = np.flatnonzero(~sure)
                terms = np.where(first[u] == _NEVER, 0.0, kernel[at[u]] * alpha[u])
                said[u] = np.cumsum(np.take_along_axis(terms, np.argsort(first[u], axis=1), 1), axis=1)[:, -1] > 0
            j = np.not_equal(said, yes_all[t, :a], out=misses[t, :a]).nonzero()[0]
            n = len(j)
            if n:
                at, c = at.take(j), step_all[t].take(j)
                alphas[at] += c
                firsts[at] = np.minimum(firsts.take(at), e * P + t)
                k = kernel.take(at, axis=0, out=part[:n], mode="clip")
                k *= c[:, None]
                k += f.take(j, axis=0, out=moved[:n], mode="clip")
                f[j] = k
        missed += (misses & ~yes_all).sum(0), (misses & yes_all).sum(0)
        size += np.where(misses, np.abs(step_all), 0.0).sum(0)
    return alpha, first, missed


def _alone(configs, x, ids, y, wt, orders):
    """The scalar rules on one stream's rows."""
    learners = [c.make(x.shape[1]) for c in configs]
    counts = np.zeros((len(configs), 4), np.int64)
    for o in orders:
        for r in o.tolist():
            for c, learner in enumerate(learners):
                p, _ = learner.step_row(x[r], float(y[r]), ids[r], float(wt[r]))
                counts[c, (0 if p != -1.0 else 3) if y[r] != -1.0 else (1 if p != -1.0 else 2)] += 1
    return learners, counts


def _orders(ids, known, other, epochs, seed):
    """The order of the rows (last axis) in every epoch: by hash, for ids that are not known ``other``; rows stay as they are where
    that ties, and without a seed."""
    for e in range(epochs):
        if seed is None:
            yield np.broadcast_to(np.arange(ids.shape[-1]), ids.shape)
        else:
            yield np.argsort(np.where(known, hash32_array(ids, seed + e), other), axis=-1, kind="stable")


def _lists(values, sizes, kind):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values)).cast(kind)


class _Block:
    """Whole streams, sorted by key and order: their columns, and models as Arrow batches."""

    def __init__(self, batch, keys, configs, epochs, seed, schema):
        self.keys, self.configs, self.epochs, self.seed, self.schema = [batch.column(j) for j in range(len(keys))], configs, epochs, seed, schema
        self.start = np.concatenate([[0], np.flatnonzero(_changes(batch, keys))])
        self.n = np.diff([*self.start, batch.num_rows])
        ids, x, y, wt = (batch.column(len(keys) + j) for j in range(4))
        if x.null_count:
            raise TypeError("a row has no features")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        self.y, self.wt = (np.asarray(v.to_numpy(zero_copy_only=False), np.float64) for v in (y, wt))
        self.width = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        self.x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64)
        self.at = np.cumsum(self.width) - self.width

    def points(self, rows, d):
        return self.x[self.at[rows][:, None] + np.arange(d)]

    def models(self):
        of = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((self.ids, of))
        new = np.ones(len(of), bool)
        new[1:] = (of[order[1:]] != of[order[:-1]]) | (self.ids[order[1:]] != self.ids[order[:-1]])
        number = np.empty(len(of), np.int64)
        number[order] = np.cumsum(new) - 1                   # of the (stream, id)
        point = order[new]                                   # its first row
        odd = ~self.known | (np.abs(self.y) != 1) | (self.width != self.width[self.start][of])
        for d in np.unique(self.width).tolist():
            rows = np.flatnonzero((self.width == d) & (self.width[point[number]] == d))
            odd[rows] |= (self.points(rows, d) != self.points(point[number[rows]], d)).any(1)
        odd = np.logical_or.reduceat(odd, self.start)
        for s in np.flatnonzero(odd).tolist():
            yield self.one(s)
        number -= number[order][np.cumsum(self.n) - self.n][of]          # within the stream
        held = np.maximum.reduceat(number, self.start) + 1               # points of a stream
        for d in np.unique(self.width[self.start][~odd]).tolist():
            todo = np.flatnonzero(~odd & (self.width[self.start] == d))
            todo = todo[np.argsort(-self.n[todo], kind="stable")]
            while len(todo):
                fits = np.maximum.accumulate(held[todo]) ** 2 * np.arange(1, len(todo) + 1) * (8 * len(self.configs)) <= KERNEL_BYTES
                g = max(1, int(fits.sum()))
                yield self.together(todo[:g], number, d)
                todo = todo[g:]

    def together(self, streams, number, d):
        S, M, n = len(streams), len(self.configs), self.n[streams]
        there = np.arange(n[0]) < n[:, None]
        rows = np.where(there, self.start[streams][:, None] + np.arange(n[0]), 0)
        held = np.where(there, number[rows], 0)
        E = int(held.max()) + 1
        x, names = np.zeros((S, E, d)), np.zeros((S, E))
        s, p = np.nonzero(there)
        x[s, held[s, p]], names[s, held[s, p]] = self.points(rows[s, p], d), self.ids[rows[s, p]]
        orders = _orders(self.ids[rows], there, 1 << 32, self.epochs, self.seed)
        y = np.where(there, self.y[rows], 0.0)
        with np.errstate(all="ignore"):
            alpha, first, missed = _learn(x, held, y, np.where(there, self.wt[rows], 0.0), orders, [float(dict(c.params).get("gamma", 1.0)) for c in self.configs])
        order = np.argsort(first, axis=1)
        sizes = (first != _NEVER).sum(1)
        kept = np.arange(E) < sizes[:, None]
        of = np.repeat(np.arange(S), M)[:, None]
        g = names[of, order][kept]
        seen, positive = np.repeat(n, M) * self.epochs, np.repeat((y > 0).sum(1), M) * self.epochs
        counts = [positive - missed[1], missed[0], seen - positive - missed[0], missed[1]]
        return self.batch(np.repeat(streams, M), seen, missed.sum(0), np.take_along_axis(alpha, order, 1)[kept], x[of, order][kept].ravel(), g, sizes, d, counts)

    def one(self, s):
        rows = np.arange(self.start[s], self.start[s] + self.n[s])
        d = int(self.width[rows[0]])
        if (self.width[rows] != d).any():
            raise ValueError("rows of a stream have different numbers of features")
        ids = [int(i) if k else None for i, k in zip(self.ids[rows], self.known[rows])]
        learners, counts = _alone(self.configs, self.points(rows, d), ids, self.y[rows], self.wt[rows], _orders(self.ids[rows], self.known[rows], -1, self.epochs, self.seed))
        states, M = [v.state() for v in learners], len(learners)
        w, sigma, g = (np.concatenate([np.asarray(v[k], np.float64) for v in states]) for k in ("w", "sigma", "g"))
        return self.batch(np.full(M, s), np.full(M, len(rows) * self.epochs), np.array([v.mistakes for v in learners]), w, sigma, g,
                          np.array([len(v["w"]) for v in states]), d, counts.T)

    def batch(self, streams, seen, missed, w, sigma, g, sizes, d, counts):
        kind = {f.name: f.type for f in self.schema}
        none = np.zeros(len(streams))
        labels = pa.array([c.label for c in self.configs]).take(pa.array(np.tile(np.arange(len(self.configs)), len(streams) // len(self.configs))))
        cols = [k.take(pa.array(self.start[streams])) for k in self.keys] + [labels, pa.array(seen), pa.array(missed)]
        cols += [_lists(w, sizes, kind["w"]), _lists(sigma, sizes * d, kind["sigma"]), _lists(g, sizes, kind["g"]),
                 _lists(np.zeros(2 * len(streams)), np.full(len(streams), 2), kind["g1t"]), pa.array(none), pa.array(seen), *map(pa.array, counts)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def epoch_models(df: DataFrame, configs: Sequence[LearnerConfig], epochs: int, keys: Sequence[str], order: Sequence[str], seed: int | None,
                 fields: Sequence[T.StructField], rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Final models (``fields``: those of the keyed fold) after ``epochs`` epochs, each in ``order`` or, with a ``seed``, in order
    of hash(seed + epoch, id).  ``rest`` gives the models of streams that are too long to be held."""
    keys, configs = list(keys), list(configs)
    limit = min([HELD] + [m for c in configs if (m := dict(c.params).get("max_sv", 1000)) is not None])
    count = F.count(F.lit(1))
    streams, longest = df.groupBy(*keys).agg(count.alias("n")).agg(count, F.max("n")).first()
    tasks = df.sparkSession.sparkContext.defaultParallelism
    order = ["id", "x", "y"] if seed is not None else list(order)
    weight = F.col("wt").cast("double") if "wt" in df.columns else F.lit(1.0)
    d, parts = dealt(df, keys, max(1, -(-streams // KERNEL_STREAMS), min(tasks, streams // 32)))
    d = d.repartition(parts, "_pt")
    if (longest or 0) > limit:
        d = d.withColumn("_n", count.over(Window.partitionBy("_pt", *keys))).filter(F.col("_n") <= limit)
    d = d.sortWithinPartitions(*keys, *order).select(*keys, "id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), weight.alias("wt"))
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("algo", T.StringType()), *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(schema)
        for b in whole_runs(batches, keys, BLOCK_ROWS):
            yield from _Block(b, keys, configs, epochs, seed, target).models()
    models = d.mapInArrow(run, schema)
    if (longest or 0) <= limit:
        return models
    long = df.withColumn("_n", count.over(Window.partitionBy(*keys))).filter(F.col("_n") > limit).drop("_n")
    return models.unionByName(rest(long))
