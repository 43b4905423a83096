"""Approximate nearest neighbours by learned partitions (largest inner product).

Fit, on a bounded sample of vectors (``SAMPLE`` rows, chosen by a hash of the id):
the sample's neighbour graph is cut into balanced partitions (balanced bisections
along principal directions, then moves that raise the number of neighbours inside a
partition without unbalancing it), and a small neural classifier learns, from a
vector alone, how its neighbours are spread over the partitions.  The number of
partitions a query is sent to is the least that finds ``TARGET`` of the sample's
neighbours.

Index: every row goes to its most probable partition.  Neighbouring partitions form
groups of bounded size; a larger partition is a group of several blocks, dealt by a
hash of the id, so a crowded partition or a group of equal vectors is split.  Search:
a query travels once to each block of a group that holds some of its most probable
partitions, with their names; a task multiplies, partition by partition, the queries
that visit it with its rows and returns the best of the block; a second grouping
keeps the ``k`` best of all.  Scores are computed again from the original vectors in
double precision, row by row, so equal vectors score equal and ties go to the smaller id.

The number of partitions grows with the table (a partition for ``PER_PARTITION`` rows),
as far as the sample can tell partitions apart (``SAMPLE_PER_PARTITION`` of its rows).

Defined results: null vectors, all-zero and empty vectors and vectors with null or
non-finite components take no part; every other row is a candidate of its own, rows with
an equal or a null id too (null ids tie last and ask nothing); a query is a row, and is no
neighbour of itself; vectors meet those of their own length (of the most frequent length
by partitions, of any other by an exact scan in blocks); fewer candidates than ``k`` give
all; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamlearn.llm.common import read, stash

#: Vectors the partitions and the classifier are fitted on, at most.
SAMPLE = 8_192
#: Share of the sample's neighbours that routing must find.
TARGET = 0.95
#: Rows of the table, and of the sample at least, for one partition; neighbours in the graph.
PER_PARTITION, SAMPLE_PER_PARTITION, NEIGHBOURS = 128, 32, 20
#: Candidates, and queries, of one matrix product.
BLOCK, QUERY_BLOCK = 8_192, 1_024


# ------------------------------------------------------------------ learning
def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for each row, itself excluded."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 12) -> np.ndarray:
    """Part of each row; no part exceeds its even share by more than ``slack``."""
    part = np.zeros(len(x), np.int64)
    stack = [(np.arange(len(x)), 0, parts)]
    while stack:
        rows, first, n = stack.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        direction = np.linalg.svd(y[:4096], full_matrices=False)[2][0]
        order = np.argsort(y @ direction, kind="stable")
        cut = len(rows) * (n // 2) // n
        stack += [(rows[order[:cut]], first, n // 2), (rows[order[cut:]], first + n // 2, n - n // 2)]
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    dst = graph.ravel()
    for _ in range(rounds):
        inside = np.zeros((len(x), parts))
        np.add.at(inside, (src, part[dst]), 1.0)                # neighbours, in both directions
        np.add.at(inside, (dst, part[src]), 1.0)
        gain = inside - inside[np.arange(len(x)), part][:, None]
        to = gain.argmax(1)
        want = np.nonzero(gain[np.arange(len(x)), to] > 0)[0]
        want = want[np.argsort(-gain[want, to[want]], kind="stable")]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in want[: max(1, len(want) // 2)]:                # half of them: neighbours that swap would chase each other
            if size[to[i]] < most:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


@dataclasses.dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer: a vector's probabilities over the partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The ``probes`` most probable partitions of each row."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def _train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, rate: float = 0.01, seed: int = 5):
    """Adam on the cross entropy with soft targets."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            grads = [x[rows].T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g + 1e-4 * w[2], g.sum(0)]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.99 * v[i] + 0.01 * gr * gr
                w[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit_router(x: np.ndarray, target: float = TARGET, neighbours: int = NEIGHBOURS, rows: int | None = None) -> Router:
    """Partition the sample's graph, train the classifier on three quarters of it and set the probes on the rest.

    ``rows`` is the size of the table that the sample stands for."""
    n, d = x.shape if len(x) else (0, 1)
    parts = max(1, min((rows or n) // PER_PARTITION, n // SAMPLE_PER_PARTITION))
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    k = min(neighbours, n - 1)
    graph = neighbour_graph(x, k)
    part = balanced_partition(x, graph, parts)
    soft = np.zeros((n, parts))
    np.add.at(soft, (np.repeat(np.arange(n), k), part[graph.ravel()]), 0.7 / k)
    soft[np.arange(n), part] += 0.3
    known = np.arange(n) % 4 > 0
    w = _train(x[known], soft[known])
    router = Router(*w, parts)
    home = router.home(x)                                       # where the index would put the sample
    order = np.argsort(-router.logits(x[~known]), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    at = np.sort(np.take_along_axis(rank, home[graph[~known]], axis=1).ravel())
    probes = int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1
    return dataclasses.replace(router, probes=min(parts, probes))


# --------------------------------------------------------------- distributed
def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with v as doubles: the rows that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.filter(ok).filter(~bad & F.exists("embedding", lambda e: e != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Router:
    """Fit on at most ``sample`` rows of ``usable`` vectors of the most frequent length, chosen by a hash."""
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return fit_router(np.zeros((0, 1)))
    chosen, n = rows.filter(F.size("v") == size["n"]), size["count"]
    if n > sample:
        chosen = chosen.filter(F.pmod(F.xxhash64("vec_id", "v", F.lit(29)), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / n)))
    got = sorted((r["v"] for r in chosen.select("v").limit(2 * sample).collect()))[:sample]         # the share, give or take its spread
    return fit_router(np.array(got, dtype=np.float64), rows=n)


def index(rows: DataFrame, router: Router) -> DataFrame:
    """``(vec_id, v, part)``: every row in its most probable partition; a length the router does not know is a partition of its own (below zero)."""
    def run(batches):
        for b in batches:
            size = _lengths(b.column(1))
            part, known = -size.astype(np.int32), size == router.w1.shape[0]
            if known.any():
                part[known] = router.home(_matrix(b.column(1).filter(pa.array(known))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], names=["vec_id", "v", "part"])
    return stash(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, part int"), "index")


def _groups(sizes: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Group and its number of blocks of every partition: partitions fill up groups of ``BLOCK`` rows; those below zero stay alone."""
    out, group, room = {}, -1, 0
    for part, n in sorted(sizes):
        if part < 0 or n > room:
            group, room = group + 1, 0 if part < 0 else max(BLOCK, n)
        room -= n if part >= 0 else 0
        out[part] = group
    total = {}
    for part, n in sizes:
        total[out[part]] = total.get(out[part], 0) + n
    return {part: (g, max(1, -(-total[g] // BLOCK))) for part, g in out.items()}


def _route(queries: DataFrame, router: Router, groups: dict[int, tuple[int, int]]) -> DataFrame:
    """``(asked, query_id, q, grp, parts)``: a query's number, and the partitions it visits in each group."""
    def run(batches):
        for b in batches:
            size = _lengths(b.column(2))
            known = np.flatnonzero(size == router.w1.shape[0])
            visits = [[p] for p in (-size).tolist()]
            if len(known):
                for i, parts in zip(known.tolist(), router.route(_matrix(b.column(2).take(pa.array(known)))).tolist()):
                    visits[i] = parts
            at, grp, parts = [], [], []
            for i, own in enumerate(visits):
                by = {}
                for p in own:
                    if p in groups:                              # a partition without rows holds nothing
                        by.setdefault(groups[p][0], []).append(p)
                at += [i] * len(by)
                grp += by
                parts += by.values()
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns], pa.array(grp, pa.int32()), pa.array(parts, pa.list_(pa.int32()))],
                                             names=["asked", "query_id", "q", "grp", "parts"])
    q = stash(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).withColumn("asked", F.monotonically_increasing_id()), "queries")
    return q.select("asked", "query_id", "q").mapInArrow(run, "asked long, query_id long, q array<double>, grp int, parts array<int>")


_HIT = "asked long, query_id long, vec_id long, score double"


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best candidates (left) of each query (right) in one block, by partition."""
        names = ["asked", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        no_id = left.column("vec_id").is_null().to_numpy()
        ids, c = left.column("vec_id").fill_null(0).to_numpy(), _matrix(left.column("v").combine_chunks())
        part = left.column("part").to_numpy()
        asked, qid, q = right.column("asked").to_numpy(), right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks())
        lists = right.column("parts").combine_chunks()
        who, what = np.repeat(np.arange(len(q)), _lengths(lists)), lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(part, kind="stable")
        found = []                                               # (query, candidate, score) of each partition
        for p, a, e in zip(*[x.tolist() for x in _runs(part[order])]):
            rows, all_asks = order[a:e], who[what == p]
            for i in range(0, len(all_asks), 256):
                asks = all_asks[i:i + 256]
                s = q[asks] @ c[rows].T
                if s.shape[1] > k + 1:
                    # a matrix product may round equal rows apart: take all near the bound, then score row by row
                    floor = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)]
                    at, cand = np.nonzero(s >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None])
                else:
                    at, cand = (x.ravel() for x in np.indices(s.shape))
                found.append((asks[at], rows[cand], (c[rows[cand]] * q[asks[at]]).sum(axis=1)))
        if not found:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        ask, cand, score = (np.concatenate(x) for x in zip(*found))
        # the query's own row: of rows with its id and its vector one is left out
        own = np.flatnonzero((ids[cand] == qid[ask]) & ~no_id[cand])
        own = own[(c[cand[own]] == q[ask[own]]).all(axis=1)]
        keep = np.ones(len(ask), bool)
        keep[own[np.unique(ask[own], return_index=True)[1]]] = False
        ask, cand, score = ask[keep], cand[keep], score[keep]
        order = np.lexsort((ids[cand], no_id[cand], -score, ask))
        ask, cand, score = ask[order], cand[order], score[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(ask)) + 1]) if len(ask) else np.zeros(0, int)
        place = np.arange(len(ask)) - np.repeat(first, np.diff(np.append(first, len(ask))))
        ask, cand, score = (x[place < k] for x in (ask, cand, score))
        return pa.table([pa.array(asked[ask]), pa.array(qid[ask]), pa.array(ids[cand], mask=no_id[cand]), pa.array(score)], names=names)
    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of a sorted array."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    return values[starts], starts, np.append(starts[1:], len(values))


def search(indexed: DataFrame, queries: DataFrame, router: Router, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of what the partitions of each query hold.

    ``queries`` has ``vec_id`` and ``v`` of rows of the table; a query is no neighbour of itself.
    """
    spark = indexed.sparkSession
    groups = _groups([(r["part"], r["n"]) for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()])        # one number a partition
    routed = stash(_route(queries, router, groups), "routed")
    asked = {r["grp"]: -(-r["n"] // QUERY_BLOCK) for r in routed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame([(p, g, n, asked.get(g, 0)) for p, (g, n) in groups.items()] or [(0, 0, 0, 0)], "part int, grp int, blocks long, asks long")
    by_group = table.select("grp", "blocks", "asks").distinct()
    mine = lambda n, *c: F.pmod(F.xxhash64(*c, F.lit(3)), n)
    all_of = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))
    left = (indexed.join(F.broadcast(table), "part").withColumn("block", mine(F.col("blocks"), "vec_id"))
                   .withColumn("ask", all_of(F.col("asks"))).select("grp", "block", "ask", "part", "vec_id", "v"))
    right = (routed.join(F.broadcast(by_group), "grp").withColumn("ask", mine(F.col("asks"), "asked"))
                   .withColumn("block", all_of(F.col("blocks"))).select("grp", "block", "ask", "asked", "query_id", "q", "parts"))
    key = ["grp", "block", "ask"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), _HIT)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, rows: DataFrame, queries: list[int], k: int = 20) -> float:
    """Share of the exact k best (by brute force over all rows) of the given query ids that were found."""
    picked = {r["vec_id"]: np.array(r["v"]) for r in rows.filter(F.col("vec_id").isin(queries)).collect()}
    ids = sorted(picked)
    if not ids:
        return 1.0
    q = np.stack([picked[i] for i in ids])

    def run(batches):
        for b in batches:
            s = _matrix(b.column(1)) @ q.T
            for j, i in enumerate(ids):
                own = b.column(0).to_numpy() != i
                top = np.argsort(-np.where(own, s[:, j], -np.inf), kind="stable")[: k + 1]
                top = top[own[top]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i)), b.column(0).take(pa.array(top)), pa.array(s[top, j])],
                                                 names=["query_id", "vec_id", "score"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    total = true.count()
    return true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / max(total, 1)


def op2_learned_partitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = stash(usable(read(spark, sf, "embeddings")), "vectors")
    router = fit(rows)
    return search(index(rows, router), rows.filter(F.col("vec_id") % 20 == 0), router)


QUERIES = {"op2_learned_partitions": op2_learned_partitions}
ORACLES: dict[str, str] = {}
