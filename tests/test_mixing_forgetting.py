"""Step forgetting (F5), online-to-batch (T7), mixing with stopping and of kernel shards (T16), against plain loops."""

import numpy as np
import pytest

from conftest import SF_SMALL
from streamlearn.plans import LearnerConfig, fold_models
from streamlearn.plans.continual import forgetting_summary, step_forgetting
from streamlearn.plans.protocols import average_models, fit_epochs, fit_mixed, online_to_batch  # noqa: F401
from streamlearn.sources import fixtures as FX

RULES = [LearnerConfig.of("PA", "pa_study"), LearnerConfig.of("Perceptron", "perceptron", tie=1.0), LearnerConfig.of("AROW", "arow", r=0.5)]


def plain_forgetting(rows, config, W):
    """Every past row scored anew before and after each step."""
    learner = config.make(len(rows[0][0]))
    said = lambda w, x: 1.0 if sum(a * b for a, b in zip(x, w)) >= 0 else -1.0
    out = []
    for j in range(W, len(rows)):
        before = list(learner.w)
        for x, y in rows[j - W:j]:
            learner.step(list(x), y)
        after = list(learner.w)
        lost = [said(before, x) == y and said(after, x) != y for x, y in rows[W:j]]
        out.append(sum(lost) / len(lost) if lost else 0.0)
    return out


@pytest.mark.parametrize("W", [3, 20])
def test_step_forgetting(spark, W):
    s = FX.user_stream(spark, SF_SMALL)
    got = {(r.stream, r.algo): r for r in forgetting_summary(step_forgetting(s, RULES, W)).collect()}
    for user, g in s.toPandas().sort_values(["ts", "id"]).groupby("stream"):
        rows = list(zip(g.x, g.y))
        for c in RULES:
            want = plain_forgetting(rows, c, W)
            r = got[user, c.label]
            assert r.steps == len(want) and np.isclose(r.forgetting, np.mean(want)) and np.isclose(r.deviation, np.std(want))


def test_many_rows_outgrow_the_first_matrix(spark):
    df = spark.range(150).selectExpr("'a' as stream", "timestamp_seconds(id) as ts", "id", "array(cast(id % 7 as double) - 3, 1d) as x", "if(id % 3 = 0, 1d, -1d) as y")
    steps = step_forgetting(df, RULES[:1], 5).orderBy("id").collect()
    want = plain_forgetting([([(i % 7) - 3.0, 1.0], 1.0 if i % 3 == 0 else -1.0) for i in range(150)], RULES[0], 5)
    assert [r.forgetting for r in steps] == pytest.approx(want) and sum(want) > 0


def halves(spark):
    s = FX.user_stream(spark, SF_SMALL)
    return s.filter("id % 4 > 0"), s.filter("id % 4 = 0")


def test_mixing_with_one_shard_and_stopping(spark):
    """Patience counts per key and rule; the kept round is the first best one of those that ran."""
    tr, va = halves(spark)
    cfg = RULES[:2]
    runs = {}
    for rounds in (1, 2, 3, 4):
        for r in fit_mixed(tr, cfg, shards=2, epochs=rounds, val=va, patience=99).collect():
            runs.setdefault((r.stream, r.algo), []).append((r.epoch, r.val_score))
    kept = {(r.stream, r.algo): r for r in fit_mixed(tr, cfg, shards=2, epochs=4, val=va, patience=99).collect()}
    stopped = {(r.stream, r.algo): r for r in fit_mixed(tr, cfg, shards=2, epochs=4, val=va, patience=1).collect()}
    for k, best in runs.items():
        assert (kept[k].epoch, kept[k].val_score) == best[-1] and kept[k].misses == 3 - kept[k].epoch
        first = next((i for i in range(1, 4) if best[i] == best[i - 1]), None)             # the first round without improvement ends it
        assert stopped[k].epoch == best[-1 if first is None else first][0]


KERNELS = [LearnerConfig.of("perceptron", "kperceptron", gamma=0.5), LearnerConfig.of("pa", "batch_kpa", gamma=0.5, C=1.0, max_sv=30),
           LearnerConfig.of("ogc", "batch_kogc", gamma=0.5, max_sv=1000)]


def test_kernel_shards_merge(spark):
    s = FX.user_stream(spark, SF_SMALL)
    one = {(r.stream, r.algo): (list(r.w), list(r.sigma)) for r in fit_mixed(s, KERNELS, shards=1).collect()}
    exact = {(r.stream, r.algo): (list(r.w), list(r.sigma)) for r in fold_models(s, KERNELS).collect()}
    assert one == exact
    two = fit_mixed(s, KERNELS, shards=3, epochs=2).collect()
    assert all(len(r.w) <= 30 for r in two if r.algo == "pa") and all(len(r.sigma) == 3 * len(r.w) == 3 * len(r.g) for r in two)
    best = fit_mixed(s, KERNELS[:1], shards=2, epochs=3, val=s, patience=1)
    assert best.count() == s.select("stream").distinct().count() and {"epoch", "val_score", "misses"} <= set(best.columns)


def test_rules_that_do_not_merge(spark):
    s = FX.user_stream(spark, SF_SMALL)
    for cfg in ([LearnerConfig.of("a", "karow")], [LearnerConfig.of("a", "krda")], [KERNELS[0], RULES[0]]):
        with pytest.raises(ValueError):
            fit_mixed(s, cfg, shards=2)


def test_online_to_batch_is_the_unstopped_epochs(spark):
    tr, va = halves(spark)
    got = {(r.stream, r.algo): r for r in online_to_batch(tr, va, RULES, 3, ["f1", "recall"]).collect() if r.metric == "f1"}
    want = {(r.stream, r.algo): r for r in fit_epochs(tr, va, RULES, max_epochs=3, patience=99).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k].epoch, got[k].val_score, list(got[k].w)) == (r.epoch, r.val_score, list(r.w))
