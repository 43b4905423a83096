"""Model tables beside a stream are computed once, not in every micro-batch."""

from pyspark.sql import functions as F

from streamlearn.plans import LearnerConfig
from streamlearn.streaming import run_to_completion, stream_learn, stream_rates, stream_score
from streamlearn.streaming.online import replay_source, run_updates


def counted(spark, schema, rows):
    """The rows as a table, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def row(r):
        seen.add(1)
        return r
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(row), schema), seen


def events(spark):
    df = spark.range(400).selectExpr("cast(id % 4 as string) as stream", "timestamp_seconds(id * 86400) as ts", "id", "array(id % 7 / 2.0D, 1.0D) as x",
                                     "if(id % 3 = 0, 1.0D, -1.0D) as y")
    return df, replay_source(df.withColumn("block", F.floor(F.col("id") / 80)), "block")       # five blocks, five micro-batches


def test_scoring(spark):
    df, src = events(spark)
    models, seen = counted(spark, "stream string, w array<double>", [(str(n), [1.0, -n / 2]) for n in range(4)])
    out = run_updates(stream_rates(stream_score(src, models), ["stream"]), ["stream"])
    got = {r["stream"]: (r["threats"], r["seen"]) for r in out.collect()}
    want = {str(n): (sum(i % 7 / 2 - n / 2 >= 0 for i in range(n, 400, 4)), 100) for n in range(4)}
    assert got == want and seen.value == 4


def test_learning_from_start_models(spark):
    df, src = events(spark)
    cfg = [LearnerConfig.of("Perceptron", "perceptron")]
    start, seen = counted(spark, "stream string, algo string, w array<double>", [(str(n), "Perceptron", [0.5, -n / 2]) for n in range(4)])
    out = run_to_completion(stream_learn(src, cfg, start)).collect()
    first = {r["stream"]: list(r["w_before"]) for r in out if r["pos"] == 0}
    assert len(out) == 400 and first == {str(n): [0.5, -n / 2] for n in range(4)} and seen.value == 4
