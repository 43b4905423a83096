"""Rules defined here, in a module the workers cannot import, run in folds, mixing, windows and streams."""

import random

import pytest

from streamlearn.plans import learners as L
from streamlearn.plans.fold import fold_models, fold_predictions
from streamlearn.plans.protocols import fit_epochs, fit_mixed
from streamlearn.streaming.online import run_to_completion, stream_learn

RATE = 0.25


def pull(w, x, y):
    return [a + RATE * y * b for a, b in zip(w, x)]


class Pull(L.Learner):
    """Always moves towards y x; uses a function and a constant of its module."""

    def step(self, x, y):
        s = self.score(x)
        p = 1.0 if s >= 0 else -1.0
        self.mistakes += p != y
        self.w = pull(self.w, x, y)
        return p, s


def init(d):
    return {"w": [0.0] * d, "t": 0}


def step(state, x, y, score):
    return {"w": pull(state["w"], x, y), "t": state["t"] + 1}


def predict(state, x):
    s = sum(a * b for a, b in zip(state["w"], x))
    return (1.0 if s > 0.5 else -1.0), s


@pytest.fixture(autouse=True)
def rules():
    L.register("pull_class", Pull)
    L.register("pull_spec", L.LearnerSpec(init, step, predict))
    yield
    for n in ("pull_class", "pull_spec"):
        L.LEARNERS.pop(n)


def stream(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), i, [rng.randrange(-8, 9) / 8, 1.0], rng.choice([-1.0, 1.0])) for i in range(80)]
    return data, spark.createDataFrame(data, "stream string, id long, x array<double>, y double").selectExpr("stream", "timestamp_seconds(id) as ts", "id", "x", "y")


def plain(data, at=0.0, strict=False):
    w, said, wrong = {}, {}, {}
    for s, i, x, y in data:
        v = w.get(s, [0.0, 0.0])
        f = sum(a * b for a, b in zip(v, x))
        said[i] = 1.0 if (f > at if strict else f >= at) else -1.0
        wrong[s] = wrong.get(s, 0) + (said[i] != y)
        w[s] = pull(v, x, y)
    return w, said, wrong


CFG = [L.LearnerConfig.of("class", "pull_class"), L.LearnerConfig.of("spec", "pull_spec"), L.LearnerConfig.of("built in", "perceptron")]


def test_batch(spark):
    data, df = stream(spark)
    w, said, wrong = plain(data)
    _, spec_said, spec_wrong = plain(data, 0.5, True)
    m = {(r["stream"], r["algo"]): r for r in fold_models(df, CFG).collect()}
    for s in "ab":
        assert m[s, "class"]["w"] == w[s] and m[s, "class"]["mistakes"] == wrong[s]
        assert m[s, "spec"]["w"] == w[s] and m[s, "spec"]["mistakes"] == spec_wrong[s] and m[s, "spec"]["t"] == m[s, "spec"]["n"]
    p = {(r["algo"], r["id"]): r["pred"] for r in fold_predictions(df, CFG).collect()}
    assert {i: p["class", i] for i in said} == said and {i: p["spec", i] for i in said} == spec_said


def test_mixing_epochs_and_windows(spark):
    data, df = stream(spark)
    w, _, _ = plain(data)
    one = {(r["stream"], r["algo"]): r["w"] for r in fit_mixed(df, CFG[:2], shards=1).collect()}
    assert one == {(s, a): w[s] for s in "ab" for a in ("class", "spec")}
    assert fit_mixed(df, CFG[:2], shards=3, epochs=2).count() == 4
    assert fit_epochs(df, df, CFG[:2], max_epochs=2).count() == 4
    inner = [L.LearnerConfig.of("window", "sliding", inner="pull_class", W=5), L.LearnerConfig.of("refit", "refit", inner="pull_spec", W=5)]
    assert fold_predictions(df, inner).count() == 2 * len(data)


def test_streaming(spark, tmp_path):
    data, df = stream(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = run_to_completion(stream_learn(sdf, CFG))
    _, said, _ = plain(data)
    _, spec_said, _ = plain(data, 0.5, True)
    got = {(r["algo"], r["id"]): r["pred"] for r in out.collect()}
    assert {i: got["class", i] for i in said} == said and {i: got["spec", i] for i in said} == spec_said


def test_plain_names_and_errors():
    assert L.LearnerConfig.of("x", "perceptron").shipped().code is None
    with pytest.raises(TypeError):
        L.register("no", 3)
