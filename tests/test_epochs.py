"""K16's parts over many streams: epochs in the task, scores and thresholds as matrices; equal to the row-by-row forms."""

import random

import numpy as np
import pytest

from streamlearn.functions.hashing import hash32_array, hash32_int
from streamlearn.operators import scan, score
from streamlearn.plans import LearnerConfig, epochs, fold_models, fold_predictions, protocols
from streamlearn.plans.kernels import KERNEL_LEARNERS
from streamlearn.plans.protocols import kernel_epochs, tune_threshold, with_class_weights

MEMBERS = [LearnerConfig.of(f"m{i}", "batch_kogc", gamma=g) for i, g in enumerate((0.25, 0.7, 1.0))]


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else None if isinstance(v, float) and v != v else v


def table(df, by):
    got = {tuple(r[c] for c in by): plain(tuple(r)) for r in df.collect()}
    assert len(got) == df.count()
    return got


def streams(spark, odd=False):
    """Streams of 1 to 30 rows and one of 90, of two widths; few values, so points and scores tie.  ``odd``: null ids and keys, ids
    at several points, labels of 0, null features."""
    rng = random.Random(4)
    rows = []
    for s in range(40):
        for i in range(90 if s == 7 else 1 + s * 7 % 30):
            x = [rng.randrange(-4, 5) / 4 for _ in range(2 if s % 3 else 4)]
            rows.append((f"s{s}", len(rows) * 37 - 9000, x, rng.choice([-1.0, 1.0]), rng.choice([0.5, 1.0, 2.5])))
    rows += [r[:3] + (-r[3], 1.0) for r in rows[::9]]                    # an id twice at its point
    if odd:
        for s in range(0, 40, 4):
            x = lambda: [rng.choice([-0.5, 0.25, None]) for _ in range(2 if s % 3 else 4)]
            rows += [(f"s{s}", None, x(), 1.0, 1.0)] * 2 + [(f"s{s}", 5, x(), rng.choice([-1.0, 0.0, 1.0]), 0.5) for _ in range(3)]
        rows += [(None, i, [i / 4, 1.0], rng.choice([-1.0, 1.0]), 1.0) for i in range(9)]
    return spark.createDataFrame(rows, "stream string, id long, x array<double>, y double, wt double").selectExpr("stream", "timestamp_seconds(id) as ts", "id", "x", "y", "wt")


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("shuffle", [True, False])
def test_epochs_equal_the_keyed_fold(spark, monkeypatch, odd, shuffle):
    df = streams(spark, odd).localCheckpoint()
    monkeypatch.setattr(epochs, "KERNEL_BYTES", 40_000)
    for held, block in ((1024, 50), (1024, 32_768), (20, 100)):          # 20: longer streams go the old way
        monkeypatch.setattr(epochs, "HELD", held)
        monkeypatch.setattr(epochs, "BLOCK_ROWS", block)
        got = table(kernel_epochs(df, MEMBERS, 5, shuffle=shuffle), ["stream", "algo"])
        with monkeypatch.context() as m:
            m.setattr(epochs, "has_epochs", lambda *a: False)
            want = table(kernel_epochs(df, MEMBERS, 5, shuffle=shuffle), ["stream", "algo"])
        assert got == want
    assert max(len(r[4]) for r in got.values()) > 30


def test_a_small_budget_and_other_rules(spark, monkeypatch):
    df = streams(spark).localCheckpoint()
    small = [LearnerConfig.of("small", "batch_kogc", gamma=0.5, max_sv=4), LearnerConfig.of("free", "batch_kogc", gamma=0.5, max_sv=None)]
    got = table(kernel_epochs(df, small, 3, shuffle=True), ["stream", "algo"])
    monkeypatch.setattr(epochs, "has_epochs", lambda *a: False)
    assert got == table(kernel_epochs(df, small, 3, shuffle=True), ["stream", "algo"])
    monkeypatch.undo()
    assert not epochs.has_epochs(df, [*small, LearnerConfig.of("pa", "batch_kpa")], 3) and not epochs.has_epochs(df, small, 1)
    assert kernel_epochs(df.limit(0), MEMBERS, 3, shuffle=True).count() == 0


def test_epochs_are_not_copies_of_the_rows(spark):
    """The epochs of K12 were an explode, so every shuffle and sort had the rows as often as there are epochs."""
    df = with_class_weights(streams(spark).drop("wt"))
    plan = kernel_epochs(df, MEMBERS, 30, shuffle=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_scores_equal_the_learners(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = streams(spark, odd=True).localCheckpoint()
        rules = [LearnerConfig.of(n, n, gamma=0.3 + i / 10) for i, n in enumerate(KERNEL_LEARNERS)]
        models = fold_models(streams(spark), rules, lockstep=False).filter("not (stream = 's3' or (stream = 's5' and algo = 'kogc'))").localCheckpoint()
        still = [LearnerConfig.of(c.label, c.name, **dict(c.params, frozen=True)) for c in rules]
        got, want = score.score_kernel_keyed(df, models, rules), fold_predictions(df, still, init=models, init_only=True)
        assert got.schema == want.schema
        assert sorted(map(plain, got.collect()), key=str) == sorted(map(plain, want.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_thresholds_of_small_groups_equal_those_of_large_ones(spark, monkeypatch):
    rng = random.Random(5)
    data = [(None if g == 7 else f"g{g}", g % 3, rng.choice([-1.0, 1.0]) if g % 5 else 1.0, rng.choice([rng.gauss(0, 1), 0.1 * 3, round(rng.gauss(0, 1), 1), -0.0, None, float("nan") if g % 11 == 0 else 2.0]))
            for g in range(40) for _ in range(rng.choice([1, 2, 10, 99, 150]))] + [("none", 0, 1.0, None)]
    df = spark.createDataFrame(data, "g string, h int, y double, score double").localCheckpoint()
    groups = {r[:2] for r in data if r[0] and r[3] is not None}
    got = []
    for rows, block in ((100_000, 20), (0, 20), (120, 32_768)):
        monkeypatch.setattr(protocols, "GROUP_ROWS", rows)
        monkeypatch.setattr(protocols, "GROUP_BLOCK", block)
        t = tune_threshold(df, 1.5, ["g", "h"])
        got.append((t.schema, table(t, ["g", "h"])))
    assert got[0] == got[1] == got[2] and set(got[0][1]) == groups
    monkeypatch.undo()
    monkeypatch.setattr(protocols, "grouped_percentiles", None)          # spread over tasks only where groups are large
    assert tune_threshold(df, 1.5, ["g", "h"]).count() == len(groups)


def test_hash_and_whole_runs():
    import pyarrow as pa
    keys = np.array([-5, 0, 7, 2**31, 2**32 + 7, 2**40 - 1], np.int64)
    assert hash32_array(keys, 43).tolist() == [hash32_int(int(k), 43) for k in keys]
    b = pa.RecordBatch.from_pydict({"k": [None, None, "a", "a", "a", "b", "b", "c"], "v": list(range(8))})
    for size in (1, 2, 3, 100):
        runs = list(scan.whole_runs([b.slice(i, 2) for i in range(0, 8, 2)] + [b.slice(0, 0)], ["k"], size))
        assert sum((r.column(1).to_pylist() for r in runs), []) == list(range(8))
        ends = [set(r.column(0).to_pylist()) for r in runs]
        assert sum(map(len, ends)) == 4                                  # no key in two
