import dataclasses

import numpy as np

from streamlearn.llm import ann as A

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors: dict, ids, k=20):
    out = {}
    for i in ids:
        s = sorted(((-float((np.float64(vectors[i]) * np.float64(v)).sum()), j) for j, v in vectors.items() if j != i))
        out[i] = [j for _, j in s[:k]]
    return out


def run(spark, rows, k=20, router=None):
    table = A.stash(A.usable(spark.createDataFrame(rows, SCHEMA)), "t")
    router = router or A.fit(table)
    got = A.search(A.index(table, router), table.filter("vec_id % 20 = 0"), router, k).orderBy("query_id", "rank").collect()
    out = {}
    for r in got:
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_graph_partitions_are_balanced_and_join_neighbours():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (100, 8)) for c in rng.normal(0, 3, (4, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = A.neighbour_graph(x, 5)
    part = A.balanced_partition(x, g, 4)
    assert np.bincount(part, minlength=4).max() <= np.ceil(100 * 1.05)
    assert (part[g] == part[:, None]).mean() > 0.8


def test_recall_of_the_query(spark):
    found = A.stash(A.op2_learned_partitions(spark, SF), "found")
    rows = A.stash(A.usable(spark.read.parquet(f"{SF}/embeddings.parquet")), "rows")
    ids = [r["query_id"] for r in found.select("query_id").distinct().collect()]
    assert len(ids) == 100 and found.count() == 2000
    assert A.recall(found, rows, ids) >= 0.9


def test_recall_with_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(A, "PER_PARTITION", 64)
    monkeypatch.setattr(A, "BLOCK", 50)
    monkeypatch.setattr(A, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    got = run(spark, rows)
    want = brute(dict(rows), got)
    share = np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want])
    assert len(got) == 75 and share >= 0.9


def test_exact_when_all_partitions_are_visited(spark, monkeypatch):
    monkeypatch.setattr(A, "PER_PARTITION", 40)
    monkeypatch.setattr(A, "BLOCK", 30)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)).astype(np.float32)
    rows = [(i, [float(a) for a in base[i % 60]]) for i in range(200)]        # every vector several times: ties
    router = A.fit_router(np.array([v for _, v in rows]))
    got = run(spark, rows, router=dataclasses.replace(router, probes=router.parts))
    assert router.parts > 1 and got == brute(dict(rows), got)


def exact(rows, k=20):
    """{query row: [(vec_id, score)]} over every usable row but the query's own, lengths apart."""
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for n, (i, q) in enumerate(rows):
        if i is not None and i % 20 == 0:
            s = [(-float((np.float64(np.float32(q)) * np.float64(np.float32(v))).sum()), j is None, j or 0) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q)]
            out.append((i, [(None if no else j, -x) for x, no, j in sorted(s)[:k]]))
    return sorted(out, key=repr)


def asked(spark, rows, k=20, **kw):
    """The query's answers in the form of ``exact``; rows with equal ids answer one after another."""
    table = A.stash(A.usable(spark.createDataFrame(rows, SCHEMA)), "t")
    router = A.fit(table)
    if kw.get("all_parts"):
        router = dataclasses.replace(router, probes=router.parts)
    got = A.search(A.index(table, router), table.filter("vec_id % 20 = 0"), router, k).collect()
    by = {}
    for r in got:
        by.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    return by, router


def test_awkward_rows(spark):
    """Every valid row is a candidate: repeated and null ids, and vectors of a rarer length among their own kind."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (20, [-1.0, 0.0]), (11, [1.0, 0.0]), (40, [1.0, 0.0, 0.0]), (40, [0.0, 2.0, 0.0])]
    by, _ = asked(spark, rows)
    want = {}
    for i, hits in exact(rows):
        for rank, h in enumerate(hits, 1):
            want.setdefault((i, rank), []).append(h)
    assert {k: sorted(v, key=repr) for k, v in by.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert want[0, 1] == [(0, 1.0)] * 2 and (0, 4) in want and len(want[40, 1]) == 2
    assert run(spark, []) == {} and run(spark, [(3, [1.0])]) == {}
    extra = spark.createDataFrame([(0, [1.0], 5, 6), (1, [2.0], 5, 6)], SCHEMA + ", part int, v int")
    assert sorted(A.usable(extra).columns) == ["v", "vec_id"] and A.usable(extra).count() == 2


def test_repeated_ids_and_two_lengths_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(A, "PER_PARTITION", 40)
    monkeypatch.setattr(A, "BLOCK", 60)
    monkeypatch.setattr(A, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 90)), [float(x) for x in np.float32(rng.normal(size=6 if rng.random() < 0.8 else 3))]) for _ in range(400)]
    rows += rows[:60]                                                     # whole rows repeated
    by, router = asked(spark, rows, all_parts=True)
    want = {}
    for i, hits in exact(rows):
        for rank, h in enumerate(hits, 1):
            want.setdefault((i, rank), []).append(h)
    assert router.parts > 4
    assert {k: sorted(v, key=repr) for k, v in by.items()} == {k: sorted(v, key=repr) for k, v in want.items()}


def test_partitions_grow_with_the_table():
    x = np.random.default_rng(0).normal(size=(640, 4))
    assert [A.fit_router(x[:n], rows=m).parts for n, m in ((640, 640), (640, 1280), (640, 10**6), (100, 10**6), (640, 100))] == [5, 10, 20, 3, 1]
    assert A._groups([(0, 5000), (1, 3000), (2, 3000), (3, 20_000), (-3, 9)]) == {-3: (0, 1), 0: (1, 1), 1: (1, 1), 2: (2, 1), 3: (3, 3)}
