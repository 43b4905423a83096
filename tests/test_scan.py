"""Keyed prefix scans and what is built on them, against plain loops; one key holds most rows and spans partitions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from streamlearn.operators import metrics as M
from streamlearn.operators import order as R
from streamlearn.operators.scan import prefix_scan
from streamlearn.plans.protocols import exact_percentiles, grouped_percentiles, prequential, tune_threshold


@pytest.fixture
def many_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(n=900, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randrange(-2, 5) if rng.random() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("down", [False, True])
def test_prefix_scan(spark, many_partitions, keys, down):
    data = rows()
    df = spark.createDataFrame(data, "k string, i long, v int").repartition(5)
    out = prefix_scan(df, keys, ["-i" if down else "i"], {"s": "v"}, "pos", {"before": "v"})
    want, state = {}, defaultdict(lambda: (0, 0, None))
    for k, i, v in sorted(data, key=lambda r: -r[1] if down else r[1]):
        key = k if keys else 0
        s, p, last = state[key]
        want[i] = (s + (v or 0), p, last)
        state[key] = (s + (v or 0), p + 1, v)
    assert {r["i"]: (r["s"], r["pos"], r["before"]) for r in out.collect()} == want
    assert out.columns == ["k", "i", "v", "s", "pos", "before"]


def test_one_key_and_empty(spark, many_partitions):
    df = spark.range(500).selectExpr("'all' as k", "id as i", "1 as v")
    out = prefix_scan(df, ["k"], ["i"], {"s": "v"}, "pos").collect()
    assert all(r["s"] == r["i"] + 1 and r["pos"] == r["i"] for r in out) and len(out) == 500
    assert prefix_scan(df.limit(0), ["k"], ["i"], {"s": "v"}, "pos").collect() == []


def test_hot_streams_of_m7_t6_r10_r11(spark, many_partitions):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else "cold", i, float(rng.choice([-1, 1])), float(rng.choice([-1, 1]))) for i in range(600)]
    df = spark.createDataFrame(data, "stream string, pos long, y double, pred double")
    seen, want = defaultdict(list), {}
    for s, i, y, p in data:
        seen[s].append((y, p))
        fn = sum(y > 0 > p for y, p in seen[s])
        tp = sum(y > 0 and p > 0 for y, p in seen[s])
        want[i] = (fn / (fn + tp) if fn + tp else 0.0, sum(p > 0 for _, p in seen[s]), len(seen[s]))
    got = {r["pos"]: (r["fnr"], r["threats"], r["seen"]) for r in M.running_rates(df, ["stream"], ["pos"]).collect()}
    assert got == want
    by = defaultdict(list)
    for s, i, y, p in data:
        by[s].append((i, y, p))
    after = {a[0]: b[1] for v in by.values() for a, b in zip(v, v[1:])}
    assert {r["pos"]: r["y"] for r in prequential(df, ["stream"]).collect()} == after
    x = df.selectExpr("stream", "pos as id", "pos as ts", "array(pred) as x", "y")
    chunk = {r["id"]: r["chunk_pos"] for r in R.round_chunk(x, 7, 50, order=["ts", "id"]).collect()}
    assert chunk == {i: (k - 350) % len(v) for v in by.values() for k, (i, _, _) in enumerate(v) if (k - 350) % len(v) < 50}
    for least in (1, 10_000):
        old, R._blocks.__defaults__ = R._blocks.__defaults__, (least,)
        try:
            back = {r["id"]: (r["win_n"], r["win_sum"] or 0.0) for r in R.trailing_window(x, 7, order=["ts", "id"]).collect()}
            full = {r["id"]: [(w["x"][0], w["y"]) for w in r["win"]] for r in R.window_rows(x, 7, order=["ts", "id"]).collect()}
        finally:
            R._blocks.__defaults__ = old
        last = {i: v[max(0, k - 7):k] for v in by.values() for k, (i, _, _) in enumerate(v)}
        assert back == {i: (len(w), sum(y for _, y, _ in w)) for i, w in last.items()}
        assert full == {i: [(p, y) for _, y, p in w] for i, w in last.items()}


def test_percentiles_of_groups(spark, many_partitions):
    rng = random.Random(11)
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([rng.random(), 0.5, 0.25])) for _ in range(800)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    shares = [i / 100 for i in range(1, 100)]
    by = defaultdict(list)
    for g, v in data:
        if v is not None:
            by[g].append(v)
    got = {r["g"]: r["_thr"] for r in grouped_percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(by)
    for g, v in by.items():
        assert np.allclose(got[g], np.percentile(v, [100 * s for s in shares]), atol=1e-12)
    every = [v for _, v in data if v is not None]
    assert np.allclose(exact_percentiles(df, "v", shares), np.percentile(every, [100 * s for s in shares]), atol=1e-12)


def test_threshold_by_group_equals_alone(spark, many_partitions):
    rng = random.Random(2)
    data = [(g, rng.choice([-1.0, 1.0]), round(rng.gauss(0, 1), 1)) for g in "ab" for _ in range(150)]
    df = spark.createDataFrame(data, "g string, y double, score double")
    both = {r["g"]: (r["k"], r["threshold"], r["tp"], r["fp"], r["fn"]) for r in tune_threshold(df, 1.5, ["g"]).collect()}
    for g in "ab":
        r = tune_threshold(df.filter(f"g = '{g}'"), 1.5).first()
        assert both[g][:1] + both[g][2:] == (r["k"], r["tp"], r["fp"], r["fn"]) and math.isclose(both[g][1], r["threshold"])
