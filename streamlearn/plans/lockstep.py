"""Keyed folds in lock step: all streams of a cohort take step t as one numpy operation.

The keyed fold walks one stream after another, row by row.  Here rows are laid out position-major: streams are dealt by
hash into cohorts of bounded size, a window numbers the rows of every stream, and a task reads a cohort in order of
position.  The rows of one position belong to different streams, so a rule's step is a few operations on matrices
(streams x d).  The arithmetic is the scalar rules', operation by operation, with sums from left to right, so models are
equal to the last bit.  Start models of linear rules come as rows at position 0.  When only a few streams of a cohort still have rows (one of them is long), those go on as scalar
learners.  Memory is the states of a cohort's streams, however many rows they have.

``RULES`` holds the rules that have a lock-step form; ``fold_models`` uses it where every configuration has one and
there are enough streams to fill cohorts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.plans.kernels import EPS
from streamlearn.plans.learners import LearnerConfig, scw_phi

#: Streams of a cohort, about: for linear rules, for kernel rules, whose states hold vectors, and for kernel rules without a budget.
LINEAR_STREAMS, KERNEL_STREAMS, OPEN_STREAMS = 4096, 256, 1024
#: Rules without a budget: rows of a cohort, about, and the rows of a stream after which it goes on as scalar learners.
OPEN_ROWS, OPEN_STEPS = 65_536, 512
#: Fewer streams than this are folded one by one; so are the last few of a cohort that still have rows.
LEAST_STREAMS, FEW = 256, 6


def _sign(s, tie):
    return np.where(s > 0, 1.0, np.where(s < 0, -1.0, tie))


def _dot(a, b):
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


class Rule:
    """States of many streams as arrays that grow by doubling; one row per stream."""
    DATA: dict[str, float] = {}                 # names of (streams x d) arrays and their first values
    FULL = None

    def __init__(self, d: int, **params):
        self.d, self.room, self.params = d, 0, params
        self.a = {n: np.zeros((0, d)) for n in ("w", *self.DATA)}
        self.t = np.zeros(0, np.int64)
        self.b = np.zeros(0)                    # carried along: no lock-step rule has a bias
        self.mistakes = np.zeros(0, np.int64)
        self.setup(**params)

    def setup(self):
        pass

    def grow(self, n: int) -> None:
        if n > self.room:
            more = max(n, 2 * self.room, 64) - self.room
            for k, v in self.a.items():
                self.a[k] = np.concatenate([v, np.full((more, *v.shape[1:]), self.DATA.get(k, 0.0))])
            self.t, self.mistakes, self.b = (np.concatenate([v, np.zeros(more, v.dtype)]) for v in (self.t, self.mistakes, self.b))
            self.room += more

    def add(self, i, step, x):
        self.a["w"][i] += step[:, None] * x

    def state(self, i: int) -> dict:
        get = lambda n: self.a[n][i].tolist() if n in self.a else None
        return {"w": get("w"), "sigma": get("sigma"), "g": get("g"), "g1t": get("g1t"), "b": float(self.b[i]), "t": int(self.t[i])}

    def step(self, i, x, y, ids, weight):  # pragma: no cover - abstract
        raise NotImplementedError


class PA(Rule):
    def step(self, i, x, y, ids, weight):
        p = _sign(_dot(x, self.a["w"][i]), 0.0)
        loss = 1.0 - y * p
        self.mistakes[i] += loss > 0
        n2 = _dot(x, x)
        h = (loss > 0) & (n2 > 0)
        self.add(i[h], loss[h] / (n2[h] * n2[h]) * y[h], x[h])
        return p


class PAStudy(Rule):
    def step(self, i, x, y, ids, weight):
        s = _dot(x, self.a["w"][i])
        m = y * s
        self.mistakes[i] += m < 1
        n2 = _dot(x, x)
        h = (m < 1) & (n2 > 0)
        self.add(i[h], (1.0 - m[h]) / n2[h] * y[h], x[h])
        return _sign(s, 1.0)


class Perceptron(Rule):
    def setup(self, tie=0.0):
        self.tie = float(tie)

    def step(self, i, x, y, ids, weight):
        p = _sign(_dot(x, self.a["w"][i]), self.tie)
        h = p != y
        self.mistakes[i] += h
        self.add(i[h], y[h], x[h])
        return p


class OGC(Rule):
    def step(self, i, x, y, ids, weight):
        p = _sign(_dot(x, self.a["w"][i]), 0.0)
        c = (y - p) / (np.sqrt(_dot(x, x)) + 1e-8)
        h = c != 0
        self.mistakes[i] += h
        self.add(i[h], c[h], x[h])
        return p


class Gradient(Rule):
    def setup(self, eta=1.0):
        self.eta = float(eta)

    def step(self, i, x, y, ids, weight):
        s = _dot(x, self.a["w"][i])
        h = y * s < 1
        self.mistakes[i] += h
        self.add(i[h], self.eta * y[h], x[h])
        return _sign(s, 1.0)


class OGCLive(Gradient):
    def setup(self, eta=0.1):
        self.eta = float(eta)


class _Confidence(Rule):
    DATA = {"sigma": 1.0}

    def variance(self, x, sigma):
        v = np.zeros(len(x))
        for j in range(self.d):
            v += x[:, j] * x[:, j] * sigma[:, j]
        return v

    def move(self, i, x, y, a, b):
        sigma = self.a["sigma"][i]
        self.a["w"][i] += (a * y)[:, None] * sigma * x
        self.a["sigma"][i] = np.maximum(sigma - b[:, None] * sigma * sigma * x * x, 1e-10)


class AROW(_Confidence):
    def setup(self, r=0.1):
        self.r = float(r)

    def step(self, i, x, y, ids, weight):
        s = _dot(x, self.a["w"][i])
        lt = 1.0 - y * s
        h = lt > 0
        self.mistakes[i] += h
        i, x, y, lt = i[h], x[h], y[h], lt[h]
        den = self.variance(x, self.a["sigma"][i]) + self.r
        good = den > 0
        safe = np.where(good, den, 1.0)
        self.move(i, x, y, np.where(good, lt / safe, 0.0), np.where(good, 1.0 / safe, 0.0))
        return _sign(s, 1.0)


def _scw_rates(v, m, phi, C, eps=0.0):
    """``learners.scw_rates`` of many streams."""
    p2 = phi * phi
    hypot = lambda a, b: np.fromiter(map(math.hypot, a, b), np.float64, len(a))
    alpha = (hypot(0.5 * m * p2, phi * np.sqrt(v * (1.0 + p2))) - m * (1.0 + 0.5 * p2)) / (v * (1.0 + p2) + eps)
    alpha = np.minimum(C, np.maximum(0.0, alpha))
    shift = alpha * v * phi
    root = 0.5 * (hypot(shift, 2.0 * np.sqrt(v)) - shift)
    return alpha, alpha * phi / (root + shift + 1e-8)


class SCW(_Confidence):
    def setup(self, C=1.0, eta=0.9):
        self.C, self.phi = float(C), scw_phi(float(eta))

    def step(self, i, x, y, ids, weight):
        s = _dot(x, self.a["w"][i])
        v, m, phi = self.variance(x, self.a["sigma"][i]), y * s, self.phi
        h = phi * np.sqrt(v) - m > 0
        self.mistakes[i] += h
        self.move(i[h], x[h], y[h], *_scw_rates(v[h], m[h], phi, self.C))
        return _sign(s, 1.0)


class _Averaged(Rule):
    DATA = {"g": 0.0, "g1t": 0.0}

    def gradient(self, i, x, y, squares):
        self.t[i] += 1
        t = self.t[i].astype(np.float64)
        s = _dot(x, self.a["w"][i])
        h = 1.0 - y * s > 0
        self.mistakes[i] += h
        grad = -y[:, None] * x
        mean = ((t - 1) / t)[:, None] * self.a["g"][i]
        mean[h] += (1.0 / t[h])[:, None] * grad[h]
        self.a["g"][i] = mean
        if squares:
            self.a["g1t"][i[h]] += grad[h] * grad[h]
        return s, t, mean


class RDA(_Averaged):
    def setup(self, lam=1e-4, gamma=1.0):
        self.lam, self.gamma = float(lam), float(gamma)

    def step(self, i, x, y, ids, weight):
        s, t, g = self.gradient(i, x, y, False)
        k = np.sqrt(t) / self.gamma
        self.a["w"][i] = np.where(np.abs(g) > self.lam, -k[:, None] * (g - self.lam * np.copysign(1.0, g)), 0.0)
        return _sign(s, 1.0)


class AdaRDA(_Averaged):
    def setup(self, lam=1.0, eta=1.0, delta=1.0):
        self.lam, self.eta, self.delta = float(lam), float(eta), float(delta)

    def step(self, i, x, y, ids, weight):
        s, t, g = self.gradient(i, x, y, True)
        side = np.where(g != 0, -np.copysign(1.0, g), 0.0)
        h = self.delta + np.sqrt(self.a["g1t"][i]) + 1e-8
        self.a["w"][i] = np.where(np.abs(g) > self.lam, side * (self.eta * t)[:, None] / h, 0.0)
        return _sign(s, 1.0)


class _Kernel(Rule):
    """Vectors of a stream fill its row of the arrays from the left, in order of insertion; empty places have alpha 0."""
    MORE = ()                                   # names of the numbers of a vector besides id and alpha

    def setup(self, gamma=1.0, max_sv=1000, **more):
        self.gamma, self.max_sv = float(gamma), max_sv
        self.a, self.n, self.width = {}, np.zeros(0, np.int64), 0
        self.rules(**more)

    def rules(self):
        pass

    def grow(self, n):
        if n > self.room:
            more = max(n, 2 * self.room, 64) - self.room
            self.t, self.mistakes, self.n = (np.concatenate([v, np.zeros(more, np.int64)]) for v in (self.t, self.mistakes, self.n))
            self.room += more
            self.resize(self.width)

    def resize(self, width):
        """Room for all streams and ``width`` vectors each; one (streams x vectors) array per coordinate."""
        for name, fill in (*((f"x{j}", 0.0) for j in range(self.d)), ("alpha", 0.0), ("id", np.nan), *((n, 0.0) for n in self.MORE)):
            new = np.full((self.room, width), fill)
            old = self.a.get(name)
            if old is not None:
                new[:len(old), :old.shape[1]] = old
            self.a[name] = new
        self.width = width

    def set(self, i, place, x, alpha, ids):
        for j in range(self.d):
            self.a[f"x{j}"][i, place] = x[:, j]
        self.a["alpha"][i, place], self.a["id"][i, place] = alpha, ids

    def part(self, i):
        """What takes the streams' rows of an array, as far as vectors go; None where there is no vector."""
        m = int(self.n[i].max(initial=0))
        if not m:
            return None
        whole = len(i) > 1 and i[0] == 0 and i[-1] == len(i) - 1 and (np.diff(i) == 1).all()     # then no copy is needed
        return (lambda v: v[:len(i), :m]) if whole else (lambda v: v[i, :m])

    def near(self, part, x):
        """Kernel values of the rows with their streams' vectors."""
        d = 0.0
        for j in range(self.d):
            v = part(self.a[f"x{j}"]) - x[:, j, None]
            v *= v
            d += v
        d *= -self.gamma
        return np.exp(d, out=d)

    def score(self, i, x):
        """f, summed over vectors in order of insertion."""
        part = self.part(i)
        if part is None:
            return np.zeros(len(i))
        k = self.near(part, x)
        k *= part(self.a["alpha"])
        return np.cumsum(k, axis=1, out=k)[:, -1]

    def own(self, i, ids):
        m = int(self.n[i].max(initial=0))
        if not m:
            return np.full(len(i), -1)
        same = self.a["id"][i, :m] == ids[:, None]
        return np.where(same.any(1), same.argmax(1), -1)

    def put(self, i, x, ids, alpha):
        """Add ``alpha`` to the row's own vector, or insert one."""
        at = self.own(i, ids)
        known = at >= 0
        self.a["alpha"][i[known], at[known]] += alpha[known]
        i, x, ids, alpha = (v[~known] for v in (i, x, ids, alpha))
        full = self.n[i] >= self.max_sv if self.max_sv is not None else np.zeros(len(i), bool)
        if full.any():
            j = i[full]
            if self.FULL == "smallest":
                place = np.abs(self.a["alpha"][j, :self.max_sv]).argmin(1)
            else:                                            # the oldest leaves
                for v in self.a.values():
                    v[j, :self.max_sv - 1] = v[j, 1:self.max_sv]
                place = np.full(len(j), self.max_sv - 1)
            self.set(j, place, x[full], alpha[full], ids[full])
        j = i[~full]
        if len(j):
            if int(self.n[j].max()) >= self.width:
                self.resize(max(8, 2 * self.width) if self.max_sv is None else min(max(8, 2 * self.width), max(self.max_sv, 8)))
            self.set(j, self.n[j], x[~full], alpha[~full], ids[~full])
            self.n[j] += 1

    def state(self, i):
        m = int(self.n[i])
        x = np.stack([self.a[f"x{j}"][i, :m] for j in range(self.d)], axis=1)
        return {"w": self.a["alpha"][i, :m].tolist(), "sigma": x.ravel().tolist(), "g": self.a["id"][i, :m].tolist(),
                "g1t": [0.0, 0.0], "b": 0.0, "t": int(self.t[i])}


class BatchKernelOGC(_Kernel):
    FULL = "smallest"

    def step(self, i, x, y, ids, weight):
        self.t[i] += 1
        p = np.where(self.score(i, x) > 0, 1.0, -1.0)
        h = p != y
        self.mistakes[i] += h
        self.put(i[h], x[h], ids[h], 2.0 * weight[h] * y[h])
        return p


class BatchKernelPA(_Kernel):
    FULL = "oldest"

    def rules(self, C=1.0):
        self.C = float(C)

    def step(self, i, x, y, ids, weight):
        self.t[i] += 1
        f = self.score(i, x)
        hinge = 1.0 - y * f
        h = hinge > 0
        self.mistakes[i] += h
        self.put(i[h], x[h], ids[h], np.minimum(self.C, hinge[h] / (1.0 + EPS)) * y[h])
        return np.where(f >= 0, 1.0, -1.0)


class _SinglePass(_Kernel):
    """K1-K7: every row that is taken is a vector of its own; streams go in order of their slots."""
    EMPTY, FULL = 0.0, "oldest"

    def setup(self, max_sv=None, **params):
        super().setup(max_sv=max_sv, **params)

    def step(self, i, x, y, ids, weight):
        self.t[i] += 1
        part = self.part(i)
        if part is None:
            k, f, none = None, np.full(len(i), self.EMPTY), np.ones(len(i), bool)
        else:
            none = self.n[i] == 0
            k = self.near(part, x)
            f = np.where(none, self.EMPTY, np.cumsum(k * part(self.a["alpha"]), axis=1)[:, -1])
        h, alpha, more = self.learn(i, y, f, k, none, part)
        self.mistakes[i] += h
        if h.any():
            self.insert(i[h], x[h], ids[h], alpha, more)
        return np.where(f >= 0, 1.0, -1.0)

    def learn(self, i, y, f, k, none, part):  # pragma: no cover - abstract
        """Which rows are taken, and the alphas and further numbers of those."""
        raise NotImplementedError

    def insert(self, i, x, ids, alpha, more):
        full = self.n[i] >= self.max_sv if self.max_sv is not None else np.zeros(len(i), bool)
        if full.any():                                       # the oldest leaves
            j = i[full]
            for v in self.a.values():
                v[j, :self.max_sv - 1] = v[j, 1:self.max_sv]
            self.n[j] -= 1
        if int(self.n[i].max()) >= self.width:
            self.resize(max(8, 2 * self.width) if self.max_sv is None else min(max(8, 2 * self.width), max(self.max_sv, 8)))
        place = self.n[i]
        self.set(i, place, x, alpha, ids)
        for n, v in zip(self.MORE, more):
            self.a[n][i, place] = v
        self.n[i] += 1

    def state(self, i):
        rest = np.stack([self.a[n][i, :int(self.n[i])] for n in ("id", *self.MORE)], axis=1)
        return super().state(i) | {"g": rest.ravel().tolist()}


class KernelPA(_SinglePass):
    EMPTY = 1.0

    def learn(self, i, y, f, k, none, part):
        h = np.where(f >= 0, 1.0, -1.0) != y
        return h, 2.0 / (1.0 + EPS) * y[h], ()


class KernelPerceptron(_SinglePass):
    EMPTY = 1.0

    def learn(self, i, y, f, k, none, part):
        h = np.where(f >= 0, 1.0, -1.0) != y
        return h, y[h], ()


class KernelOGC(_SinglePass):
    def learn(self, i, y, f, k, none, part):
        e = y - np.sign(f)
        h = e != 0
        return h, e[h] / (1.0 + EPS), ()


class _Variance(_SinglePass):
    MORE = ("conf",)

    def variance(self, k, none, part):
        if k is None:
            return np.ones(len(none))
        return np.where(none, 1.0, np.cumsum(k * k * part(self.a["conf"]), axis=1)[:, -1] + EPS)


class KernelAROW(_Variance):
    def rules(self, r=0.1):
        self.r = float(r)

    def learn(self, i, y, f, k, none, part):
        hinge = 1.0 - y * f
        h = hinge > 0
        den = self.variance(k, none, part)[h] + self.r
        return h, hinge[h] / den * y[h], (1.0 / (1.0 + 1.0 / den),)


class KernelSCW(_Variance):
    def rules(self, C=1.0, eta=0.9):
        self.C, self.phi = float(C), scw_phi(float(eta))

    def learn(self, i, y, f, k, none, part):
        v, m = self.variance(k, none, part), y * f
        h = self.phi * np.sqrt(v) > m
        a, b = _scw_rates(v[h], m[h], self.phi, self.C, EPS)
        return h, a * y[h], (1.0 / (1.0 + b),)


class _KernelAveraged(_SinglePass):
    """The running mean of the (scalar) hinge gradient, and the sum of its squares."""

    def rules(self, lam=0.01, **more):
        self.lam, self.mean, self.squares = float(lam), np.zeros(0), np.zeros(0)
        self.rates(**more)

    def grow(self, n):
        super().grow(n)
        self.mean, self.squares = (np.concatenate([v, np.zeros(self.room - len(v))]) for v in (self.mean, self.squares))

    def learn(self, i, y, f, k, none, part):
        t, g = self.t[i].astype(np.float64), np.where(1.0 - y * f > 0, -y, 0.0)
        self.mean[i] = ((t - 1.0) / t) * self.mean[i] + (1.0 / t) * g
        self.squares[i] += g * g
        c = self.coefficient(t, self.mean[i], self.squares[i])
        h = c != 0
        return h, c[h] * y[h], ()

    def state(self, i):
        return super().state(i) | {"g1t": [float(self.mean[i]), float(self.squares[i])]}


class KernelRDA(_KernelAveraged):
    def rates(self, rda_gamma=1.0):
        self.scale = float(rda_gamma)

    def coefficient(self, t, mean, squares):
        return -(np.sqrt(t) / self.scale) * np.copysign(np.maximum(np.abs(mean) - self.lam, 0.0), mean)


class KernelAdaRDA(_KernelAveraged):
    def rates(self, eta=1.0, delta=1.0):
        self.eta, self.delta = float(eta), float(delta)

    def coefficient(self, t, mean, squares):
        c = -np.copysign(self.eta * t / (self.delta + np.sqrt(squares) + EPS), mean)
        return np.where(np.abs(mean) <= self.lam, 0.0, c)


RULES = {"pa": PA, "pa_study": PAStudy, "perceptron": Perceptron, "ogc": OGC, "gradient": Gradient, "ogc_live": OGCLive, "arow": AROW, "scw": SCW,
         "rda": RDA, "adarda": AdaRDA, "batch_kogc": BatchKernelOGC, "batch_kpa": BatchKernelPA, "kpa": KernelPA, "kperceptron": KernelPerceptron,
         "kogc": KernelOGC, "karow": KernelAROW, "krda": KernelRDA, "kscw": KernelSCW, "kadarda": KernelAdaRDA}


def has_lockstep(configs: Sequence[LearnerConfig], start: bool = False) -> bool:
    """Whether all rules have a lock-step form; with ``start``, one that takes start models (linear rules)."""
    return all(c.code is None and c.name in RULES and not dict(c.params).get("frozen")
               and not (start and issubclass(RULES[c.name], _Kernel)) for c in configs)


def _open(config: LearnerConfig) -> bool:
    """Whether the rule keeps vectors without a budget."""
    return issubclass(RULES[config.name], _SinglePass) and dict(config.params).get("max_sv") is None


def cohort_count(df: DataFrame, keys: Sequence[str], configs: Sequence[LearnerConfig], times: int = 1) -> int:
    """How many cohorts the streams fill (at least one per task); 0 where there are too few streams."""
    n, rows = (times * (v or 0) for v in df.select(F.xxhash64(*keys).alias("h")).agg(F.approx_count_distinct("h"), F.count(F.lit(1))).first())
    if any(issubclass(RULES[c.name], _Kernel) and not _open(c) for c in configs):
        least = -(-n // KERNEL_STREAMS)
    elif any(_open(c) for c in configs):
        least = max(-(-n // OPEN_STREAMS), min(-(-rows // OPEN_ROWS), n))
    else:
        least = -(-n // LINEAR_STREAMS)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return 0 if n < LEAST_STREAMS else max(least, min(tasks, n // 32))


def dealt(df: DataFrame, keys: Sequence[str], cohorts: int) -> tuple[DataFrame, int]:
    """Add ``_co``, the cohort, and ``_pt``, a number whose hash deals equally many cohorts to each of the partitions.

    Spark deals rows by a hash of the column modulo the partitions, which leaves some of few values in one partition; a
    number that hashes there is looked up for each partition instead (for many partitions chance evens out)."""
    spark = df.sparkSession
    parts = min(cohorts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    cohorts = -(-cohorts // parts) * parts
    d = df.withColumn("_co", F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(cohorts)).cast("int"))
    p = F.pmod("_co", F.lit(parts))
    if parts <= 256:
        tried = spark.range(40 * parts).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"), F.col("id").cast("int").alias("v"))
        value = {r["p"]: r["v"] for r in tried.groupBy("p").agg(F.min("v").alias("v")).collect()}       # one row a partition
        p = F.element_at(F.array(*[F.lit(value.get(k, k)) for k in range(parts)]), p + 1)
    return d.withColumn("_pt", p), parts


class _Cohort:
    """The streams of a cohort in one task: slots, rules, counts, and scalar learners for the last long streams."""

    def __init__(self, configs, d, init_only=False):
        self.configs, self.d, self.init_only = configs, d, init_only
        self.rules = [RULES[c.name](d, **dict(c.params)) for c in configs]
        self.slots, self.rows = {}, np.zeros(0, np.int64)
        self.counts = np.zeros((len(configs), 0, 4), np.int64)       # tp, fp, tn, fn
        self.begun = np.zeros((len(configs), 0), bool)               # which streams have a start model of the configuration
        self.tails = {}

    def slot(self, keys):
        out = np.empty(len(keys), np.int64)
        for n, k in enumerate(keys):
            out[n] = self.slots.setdefault(k, len(self.slots))
        if len(self.slots) > len(self.rows):
            more = max(len(self.slots), 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros(more, np.int64)])
            self.counts = np.concatenate([self.counts, np.zeros((len(self.configs), more, 4), np.int64)], axis=1)
            self.begun = np.concatenate([self.begun, np.zeros((len(self.configs), more), bool)], axis=1)
            for r in self.rules:
                r.grow(len(self.slots))
        return out

    def load(self, i, c, states):
        """Start models of configuration ``c`` for the streams ``i``; the states as ``fold._start_rows`` packs them."""
        from streamlearn.plans.fold import _unpack
        rule = self.rules[c]
        self.begun[c, i] = True
        for j, v in zip(i.tolist(), states):
            for name, part in _unpack(v).items():
                if part is None:
                    continue
                if name in ("b", "t"):
                    getattr(rule, name)[j] = part
                elif name in rule.a:
                    rule.a[name][j] = part

    def step(self, i, x, y, ids, weight):
        self.rows[i] += 1
        yes = y != -1.0
        for c, rule in enumerate(self.rules):
            if self.init_only and not self.begun[c, i].all():
                u = self.begun[c, i]
                j, said, true = i[u], rule.step(i[u], x[u], y[u], ids[u], weight[u]) != -1.0, yes[u]
            else:
                j, said, true = i, rule.step(i, x, y, ids, weight) != -1.0, yes
            self.counts[c, j, np.where(true, np.where(said, 0, 3), np.where(said, 1, 2))] += 1

    def step_alone(self, i, x, y, rid, weight):
        if i not in self.tails:
            self.tails[i] = []
            for c, r in zip(self.configs, self.rules):
                learner = c.make(self.d)
                learner.load(r.state(i))
                learner.mistakes = int(r.mistakes[i])
                self.tails[i].append(learner)
        self.rows[i] += 1
        for c, learner in enumerate(self.tails[i]):
            p, _ = learner.step_row(x, y, rid, weight) if learner.rowwise else learner.step(x, y)
            self.counts[c, i, (0 if p != -1.0 else 3) if y != -1.0 else (1 if p != -1.0 else 2)] += 1

    def counted(self, k):
        """The columns of ``COUNTS`` for all streams and configurations, and the keys' columns in front."""
        slots = np.fromiter(self.slots.values(), np.int64, len(self.slots))
        keys, c = list(self.slots), len(self.configs)
        wrong = np.stack([r.mistakes[slots] for r in self.rules])
        for i, tail in self.tails.items():
            wrong[:, np.searchsorted(slots, i)] = [learner.mistakes for learner in tail]       # slots count up as the keys came
        columns = [[key[j] for key in keys] * c for j in range(k)] + [np.repeat([cfg.label for cfg in self.configs], len(keys))]
        columns += [np.tile(self.rows[slots], c), wrong.ravel()]
        return columns + [self.counts[:, slots, n].ravel() for n in range(4)]

    def models(self):
        for key, i in self.slots.items():
            if not self.rows[i]:                             # a start model without rows
                continue
            for c, cfg in enumerate(self.configs):
                if self.init_only and not self.begun[c, i]:
                    continue
                tail = self.tails.get(i)
                st = tail[c].state() if tail else self.rules[c].state(i)
                wrong = tail[c].mistakes if tail else int(self.rules[c].mistakes[i])
                yield key, cfg.label, int(self.rows[i]), wrong, st, self.counts[c, i].tolist()


def lockstep_models(df: DataFrame, configs: Sequence[LearnerConfig], keys: Sequence[str], order: Sequence[str], cohorts: int,
                    fields: Sequence[T.StructField], init: DataFrame | None = None, init_only: bool = False, counts: bool = False,
                    position: str | None = None) -> DataFrame:
    """Final models (``fields``: those of the keyed fold) of every (key, configuration); with ``counts``, their counts alone.

    ``position`` names a column that numbers a stream's rows from 0 already; then no window does.

    ``init`` (keys, algo and a linear state) holds start models; with ``init_only`` a key runs just the configurations in it."""
    keys, configs = list(keys), list(configs)
    cols = list(dict.fromkeys([*keys, *[c for c in order if c in df.columns], *([position] if position else []), "id", "x", "y",
                               *(["wt"] if "wt" in df.columns else [])]))
    weight = F.col("wt").cast("double") if "wt" in df.columns else F.lit(1.0)
    rows, group = df.select(*cols, F.size("x").alias("_d")), ["_pt", "_co", *keys]
    if init is not None:
        from streamlearn.plans.fold import _start_rows
        start = _start_rows(init.filter("w is not null"), configs, keys).withColumn("_d", F.col("x")[0].cast("int"))
        rows = rows.withColumn("_k", F.lit(1)).unionByName(start, allowMissingColumns=True)
        group = [*group, "_k"]
    if {"_co", "_pt"} <= set(df.columns):                    # dealt by the caller, before its own steps
        d = df.select(*cols, F.size("x").alias("_d"), "_co", "_pt")
    else:
        d, parts = dealt(rows, keys, cohorts)
        d = d.repartition(parts, "_pt")
    place = F.col(position) + 1 if position else F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    if init is not None:
        place = F.when(F.col("_k") == 1, place).otherwise(0)
    d = (d.withColumn("_pos", place)
          .select("_co", "_d", "_pos", *keys, F.col("id").cast("double").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), weight.alias("_wt"))
          .sortWithinPartitions("_co", "_d", "_pos"))
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("algo", T.StringType()), *fields])
    k, only, endless = len(keys), init_only and init is not None, any(_open(c) for c in configs)
    linear = not all(issubclass(RULES[c.name], _Kernel) for c in configs)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        target, cohort, group = to_arrow_schema(schema), None, None

        def table():
            if counts:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cohort.counted(k), target)], schema=target)
            rows = list(cohort.models())
            cols = [[r[0][j] for r in rows] for j in range(k)] + [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
            cols += [[r[4][n] for r in rows] for n in ("w", "sigma", "g", "g1t", "b", "t")] + [[r[5][n] for r in rows] for n in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            co, dim, pos = (b.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            names = list(zip(*[b.column(3 + j).to_pylist() for j in range(k)]))
            ids, y, w = (np.array(b.column(3 + k + j).to_numpy(zero_copy_only=False), np.float64) for j in (0, 2, 3))
            x = b.column(4 + k)
            if (endless or counts) and b.column(5 + k).null_count or counts and linear and (x.null_count or x.flatten().null_count):
                raise TypeError("a label or a feature is null")          # the keyed fold fails there too
            edge = np.flatnonzero((co[1:] != co[:-1]) | (dim[1:] != dim[:-1]) | (pos[1:] != pos[:-1])) + 1
            for a, e in zip([0, *edge.tolist()], [*edge.tolist(), n]):
                if group != (co[a], dim[a]):
                    if cohort is not None:
                        yield table()
                    group, cohort = (co[a], dim[a]), _Cohort(configs, int(dim[a]), only)
                i = cohort.slot(names[a:e])
                if pos[a] == 0:
                    states = x.slice(a, e - a).to_pylist()
                    for c in np.unique(y[a:e]).astype(int).tolist():
                        mine = np.flatnonzero(y[a:e] == c)
                        cohort.load(i[mine], c, [states[j] for j in mine.tolist()])
                    continue
                part = np.asarray(x.slice(a, e - a).flatten(), np.float64).reshape(e - a, -1)
                if endless:                                  # in order of the slots a step may go without copies
                    o = np.argsort(i, kind="stable")
                    i, part = i[o], part[o]
                    ids[a:e], y[a:e], w[a:e] = ids[a:e][o], y[a:e][o], w[a:e][o]
                alone = np.fromiter((s in cohort.tails for s in i.tolist()), bool, e - a) if cohort.tails else np.zeros(e - a, bool)
                if endless and pos[a] > OPEN_STEPS or e - a <= FEW and a > 0 and e < n and pos[a] > 1:      # the whole step is in this batch: few streams are left
                    alone[:] = True
                for j in np.flatnonzero(alone).tolist():
                    rid = ids[a + j]
                    cohort.step_alone(int(i[j]), part[j].tolist(), float(y[a + j]), None if rid != rid else int(rid), float(w[a + j]))
                if not alone.all():
                    u = ~alone
                    cohort.step(i[u], part[u], y[a:e][u], ids[a:e][u], w[a:e][u])
        if cohort is not None:
            yield table()
    return d.mapInArrow(run, schema)
