"""Sliding windows (F4) of many streams in lock step.

A window trains its inner rule on the last W rows before every prediction, so the work is rows x W steps that follow one
another.  Streams do not depend on each other: as in ``plans.lockstep`` they are dealt into cohorts and read position by
position, and a step is a few numpy operations on (coordinates x rules x streams).  The inner rules are those that add a
multiple of x (``STEPS``); predictions equal the keyed fold's.  Memory is W rows for every stream of a cohort.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.plans.learners import LearnerConfig
from streamlearn.plans.lockstep import dealt

#: Rows held in the windows of a cohort, about, and its streams at most; fewer streams in all are folded one by one.
HELD_ROWS, STREAMS, LEAST_STREAMS = 262_144, 1024, 16


def _said(s, tie):
    return np.where(s > 0, 1.0, np.where(s < 0, -1.0, tie)) if tie <= 0 else np.where(s < 0, -1.0, tie)


def _pa(s, y, n2, good):
    loss = 1.0 - y * _said(s, 0.0)
    return (loss > 0) & good, loss / (n2 * n2) * y


def _pa_study(s, y, n2, good):
    m = y * s
    return (m < 1.0) & good, (1.0 - m) / n2 * y


def _perceptron(s, y, n2, good, tie=0.0):
    return _said(s, float(tie)) != y, y


def _gradient(s, y, n2, good):
    return y * s < 1.0, y


def _ogc_live(s, y, n2, good, eta=0.1):
    return y * s < 1.0, float(eta) * y


#: Inner rules: whether a step is taken and what of x it adds, from the score, y, the square of x and whether that is positive (else it is given as 1).
STEPS = {"pa": _pa, "pa_study": _pa_study, "perceptron": _perceptron, "gradient": _gradient, "ogc_live": _ogc_live}


def has_windows(configs: Sequence[LearnerConfig]) -> bool:
    """Whether all rules are sliding windows of one length over a rule of ``STEPS``."""
    ps = [dict(c.params) for c in configs]
    return (all(c.code is None and c.name == "sliding" and p.get("inner", "pa_study") in STEPS for c, p in zip(configs, ps))
            and len({int(p.get("W", 250)) for p in ps}) == 1)


def window_cohorts(df: DataFrame, keys: Sequence[str], configs: Sequence[LearnerConfig]) -> int:
    """How many cohorts the streams fill; 0 where there are too few streams."""
    n = df.select(F.xxhash64(*keys).alias("h")).agg(F.approx_count_distinct("h")).first()[0] or 0
    size = max(32, min(STREAMS, HELD_ROWS // max(int(dict(configs[0].params).get("W", 250)), 1)))
    return 0 if n < LEAST_STREAMS else max(-(-n // size), min(df.sparkSession.sparkContext.defaultParallelism, n // 8))


class _Windows:
    """The windows and models of the streams of a cohort that still have rows; a column of the arrays is a stream."""

    def __init__(self, configs, d):
        ps = [dict(c.params) for c in configs]
        self.W, self.d, self.pos, self.finite = int(ps[0].get("W", 250)), d, 0, True
        more = [{k: v for k, v in p.items() if k not in ("inner", "W")} for p in ps]
        self.rules = [(STEPS[p.get("inner", "pa_study")], m) for p, m in zip(ps, more)]
        self.at = None                                       # key -> column

    def begin(self, keys):
        n = len(keys)
        self.at = {k: j for j, k in enumerate(keys)}
        self.x, self.y, self.n2, self.good = np.empty((self.W, self.d, n)), np.empty((self.W, n)), np.empty((self.W, n)), np.empty((self.W, n), bool)
        self.w = np.zeros((self.d, len(self.rules), n))

    def keep(self, columns):
        """Streams that have ended leave."""
        self.x, self.y, self.n2, self.good, self.w = (np.ascontiguousarray(v[..., columns]) for v in (self.x, self.y, self.n2, self.good, self.w))
        place = {c: j for j, c in enumerate(columns.tolist())}
        self.at = {k: place[c] for k, c in self.at.items() if c in place}

    def score(self, x):
        s = np.zeros(self.w.shape[1:])
        for j in range(self.d):
            s += self.w[j] * x[j]
        return s

    def train(self, k):
        x, y, n2, good = self.x[k], self.y[k], self.n2[k], self.good[k]
        part = self.w * x[:, None, :]
        s = part[0]
        for j in range(1, self.d):
            s += part[j]
        c, taken = np.empty_like(s), np.empty(s.shape, bool)
        for r, (rule, more) in enumerate(self.rules):
            taken[r], c[r] = rule(s[r], y, n2, good, **more)
        if self.finite:
            np.multiply(np.where(taken, c, 0.0), x[:, None, :], out=part)
            self.w += part
        else:                                                # no step is no step, also where x is infinite or no number
            self.w = np.where(taken, self.w + c * x[:, None, :], self.w)

    def step(self, keys, x, y):
        """Rows of one position, of all streams that have one: predictions (rules x rows), in the rows' order."""
        if self.at is None:
            self.begin(keys)
        col = np.fromiter((self.at[k] for k in keys), np.int64, len(keys))
        if len(keys) < len(self.at):
            self.keep(np.sort(col))
            col = np.fromiter((self.at[k] for k in keys), np.int64, len(keys))
        order = np.argsort(col)
        x, y = np.ascontiguousarray(x[order].T), y[order]
        slot, full = self.pos % self.W, self.pos >= self.W
        with np.errstate(all="ignore"):
            if full:
                for k in (*range(slot, self.W), *range(slot)):          # the oldest row first
                    self.train(k)
            s = self.score(x) if full else np.full((len(self.rules), len(y)), np.nan)
            n2 = np.zeros(len(y))
            for j in range(self.d):
                n2 += x[j] * x[j]
        p = np.where(s < 0, -1.0, 1.0) if full else s
        self.finite = self.finite and bool(np.isfinite(x).all())
        self.x[slot], self.y[slot], self.good[slot] = x, y, n2 > 0
        self.n2[slot] = np.where(n2 > 0, n2, 1.0)
        self.pos += 1
        return p[:, col], s[:, col]


def window_predictions(df: DataFrame, configs: Sequence[LearnerConfig], keys: Sequence[str], order: Sequence[str], cohorts: int) -> DataFrame:
    """What ``fold_predictions`` returns: keys, algo, id, ts, y, pred, score, pos."""
    keys, configs, k = list(keys), list(configs), len(keys)
    cols = list(dict.fromkeys([*keys, *order, "id", "ts", "x", "y"]))
    d, parts = dealt(df.select(*cols, F.size("x").alias("_d")), keys, cohorts)
    place = F.row_number().over(Window.partitionBy("_pt", "_co", *keys).orderBy(*order)).cast("long") - 1
    d = (d.repartition(parts, "_pt").withColumn("_pos", place)
          .select("_co", "_d", "_pos", *keys, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_ts"), F.col("y").cast("double").alias("y"), "x")
          .sortWithinPartitions("_co", "_d", "_pos"))
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("algo", T.StringType()), df.schema["id"], T.StructField("ts", T.LongType()),
                           T.StructField("y", T.DoubleType()), T.StructField("pred", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("pos", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        target, group, windows, rest = to_arrow_schema(schema), None, None, None
        labels = [c.label for c in configs]

        def steps(b):
            """Rows of whole positions, step by step; ``b`` is in order."""
            nonlocal group, windows
            n = b.num_rows
            co, dim, pos = (b.column(j).to_numpy() for j in range(3))
            names = list(zip(*[b.column(3 + j).to_pylist() for j in range(k)]))
            y, x = np.array(b.column(k + 5).to_numpy(), np.float64), b.column(k + 6).combine_chunks()
            if b.column(k + 5).null_count or x.null_count or x.flatten().null_count:
                raise TypeError("a label or a feature is null")          # the keyed fold fails there too
            edge = np.flatnonzero((co[1:] != co[:-1]) | (dim[1:] != dim[:-1]) | (pos[1:] != pos[:-1])) + 1
            pred, score = np.empty((len(labels), n)), np.empty((len(labels), n))
            for a, e in zip([0, *edge.tolist()], [*edge.tolist(), n]):
                if group != (co[a], dim[a]):
                    group, windows = (co[a], dim[a]), _Windows(configs, int(dim[a]))
                part = np.asarray(x.slice(a, e - a).flatten(), np.float64).reshape(e - a, -1)
                pred[:, a:e], score[:, a:e] = windows.step(names[a:e], part, y[a:e])
            for r, label in enumerate(labels):
                values = [*[b.column(3 + j).combine_chunks() for j in range(k)], pa.array([label] * n, pa.string()), b.column(k + 3).combine_chunks(),
                          b.column(k + 4).combine_chunks(), pa.array(y), pa.array(pred[r]), pa.array(score[r]), b.column(2).combine_chunks()]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, target)], schema=target)

        for b in batches:
            b = pa.Table.from_batches([b])
            b = b if rest is None else pa.concat_tables([rest, b])
            if not b.num_rows:
                continue
            co, dim, pos = (b.column(j).to_numpy() for j in range(3))
            last = np.flatnonzero((co != co[-1]) | (dim != dim[-1]) | (pos != pos[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0    # the last position may go on in the next batch
            if whole:
                yield from steps(b.slice(0, whole))
            rest = b.slice(whole)
        if rest is not None and rest.num_rows:
            yield from steps(rest)

    out = d.mapInArrow(run, schema)
    return out.withColumn("ts", F.timestamp_micros("ts").cast(df.schema["ts"].dataType))
