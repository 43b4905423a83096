"""T10 and T11 against plain loops: small entities, best epochs, the frozen baseline and refits."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from streamlearn.functions.hashing import hash32
from streamlearn.operators.order import entity_split
from streamlearn.plans import LearnerConfig
from streamlearn.plans.protocols import adapt_and_freeze, average_models, fit_per_entity
from streamlearn.sources import fixtures as FX

CFG = [LearnerConfig.of("Perceptron", "perceptron"), LearnerConfig.of("AROW", "arow", r=0.1)]


def dot(x, w):
    s = 0.0
    for a, b in zip(x, w):
        s += a * b
    return s


def f1(w, rows):
    said = [(dot(x, w) >= 0, y > 0) for x, y in rows]
    tp, fp, fn = sum(a and b for a, b in said), sum(a and not b for a, b in said), sum(b and not a for a, b in said)
    p, r = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
    return 2 * p * r / (p + r) if p + r else 0.0


@pytest.fixture(scope="module")
def parts(spark):
    s = entity_split(FX.user_stream(spark, SF_SMALL), "stream", (0.2, 0.2), seed=42).cache()
    part = lambda p: s.filter(F.col("part") == p).drop("part")
    train = part("train")
    small = train.agg(F.min("stream")).first()[0]                # this user keeps 9 rows
    few = train.filter(F.col("stream") == small).orderBy("id").limit(9)
    return train.filter(F.col("stream") != small).unionByName(few), part("val"), part("test"), small


def test_models_of_large_entities_by_their_best_epoch(spark, parts):
    train, val, _, small = parts
    got = fit_per_entity(train, val, CFG, refit=["AROW"]).cache()
    pooled = [(r.x, r.y) for r in val.collect()]
    rows = train.select("*", *[hash32("id", 42 + e).alias(f"o{e}") for e in range(3)]).toPandas()
    want = {}
    for k, g in rows.groupby("stream"):
        for c in CFG:
            m, best = c.make(3), (-1.0, 0, None)
            for e in range(3):
                m = c.make(3) if c.label == "AROW" else m
                for x, y in g.sort_values([f"o{e}", "id"])[["x", "y"]].itertuples(index=False):
                    m.step(list(x), y)
                if (score := f1(m.w, pooled)) > best[0]:
                    best = (score, e, list(m.w))
            if k != small:
                want[(k, c.label)] = best
    assert {(r.stream, r.algo): (pytest.approx(r.val_score), r.epoch, pytest.approx(list(r.w))) for r in got.collect()} == want
    assert {e for _, e, _ in want.values()} > {0}
    mean = {r.algo: (list(r.w), r.n_models) for r in average_models(got).collect()}
    for c in CFG:
        ws = [w for (_, a), (_, _, w) in want.items() if a == c.label]
        assert mean[c.label] == (pytest.approx([sum(v) / len(ws) for v in zip(*ws)]), len(ws))


def test_adapted_refitted_and_frozen(spark, parts):
    test = parts[2]
    w0 = {"Perceptron": [0.5, -0.25, 0.125], "AROW": [-0.5, 0.25, 1.0]}
    table = spark.createDataFrame([(a, w, 0.0) for a, w in w0.items()], "algo string, w array<double>, b double")
    got = {(r.stream, r.algo, r.id): r.pred for r in adapt_and_freeze(test, table, CFG, refit=["AROW"], window=20).collect()}
    want = {}
    for k, g in test.toPandas().sort_values(["ts", "id"], kind="mergesort").groupby("stream"):
        X, Y, ids = [list(x) for x in g.x], list(g.y), list(g.id)
        step = CFG[0].make(3)
        step.w, now = list(w0["Perceptron"]), list(w0["AROW"])
        for i, (x, y) in enumerate(zip(X, Y)):
            for a, w in w0.items():
                want[(k, f"{a}/frozen", ids[i])] = 1.0 if dot(x, w) >= 0 else -1.0
            want[(k, "Perceptron", ids[i])] = step.step(x, y)[0]
            want[(k, "AROW", ids[i])] = 1.0 if dot(x, now) >= 0 else -1.0
            again = CFG[1].make(3)
            for j in range(max(0, i - 20), i + 1):
                again.step(X[j], Y[j])
            now = again.w
    assert got == want
