"""Scenario grid (T14): class ratios x outlier recipe x rules x methods over many streams in one fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlearn.functions.hashing import hash32_int, with_hash32
from streamlearn.operators.drift import outlier_factor
from streamlearn.operators.order import DEFAULT_ORDER
from streamlearn.plans.fold import fold_counts
from streamlearn.plans.learners import LearnerConfig
from streamlearn.plans.lockstep import cohort_count, dealt, has_lockstep


def scenarios(df: DataFrame, ratios: Sequence[float] = (0.5, 0.7, 0.9), seed: int = 42, keys: Sequence[str] = ("stream",),
              order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """R8 then D2-D5 within every key, once for each positive ratio: (keys, ratio, idx, ts, id, x, y).

    A class that has the wanted number of rows keeps those of smallest hash; a smaller one is drawn with replacement
    (draw i takes the row at time rank hash63(i) mod size).  Rows stay in time order, draws after one another.
    """
    keys = list(keys)
    of, cls = Window.partitionBy(*keys), Window.partitionBy(*keys, "y")
    grid = df.sparkSession.createDataFrame([(float(r),) for r in ratios], "ratio double")
    d = (with_hash32(df.select(*keys, "ts", "id", "x", "y"), "_h", "id", seed)
           .withColumn("_i", F.row_number().over(of.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(of))
           .withColumn("_size", F.count(F.lit(1)).over(cls)).withColumn("_rank", F.row_number().over(cls.orderBy(*order)) - 1)
           .withColumn("_pick", F.row_number().over(cls.orderBy("_h", "id", "_i")) - 1)
           .crossJoin(F.broadcast(grid)))
    pos = F.floor(F.col("_n") * F.col("ratio"))
    d = d.withColumn("_want", F.when(F.col("y") > 0, pos).otherwise(F.col("_n") - pos))
    # a row's places in the scenario: kept once; of a class drawn from, -1 as the source of its rank; all draws of a class with its first row
    short, known = F.col("_want") > F.col("_size"), F.lit(True)
    for c in [*keys, "y"]:
        known = known & F.col(c).isNotNull()
    seq = lambda a, b: F.sequence(F.lit(a).cast("long"), b)
    places = (F.when(short & (F.col("_rank") == 0) & known, seq(-1, F.col("_want") - 1)).when(short, seq(-1, F.lit(-1).cast("long")))
               .when(F.col("_pick") < F.col("_want"), seq(0, F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")))
    d = d.withColumn("_short", short).withColumn("_draw", F.explode(places))
    # hash63 of a draw, whose upper half is zero: a class has its own seed
    pos = F.col("y") > 0
    d = with_hash32(with_hash32(d, "_a", "_draw", (pos, seed + 1), seed + 2), "_b", "_draw", (pos, seed + 3), seed + 4)
    upper = lambda h, s: h.bitwiseXOR(F.when(pos, F.lit(hash32_int(0, s))).otherwise(F.lit(hash32_int(0, s + 1))))
    side = F.pmod(F.shiftright(upper(F.col("_a"), seed + 2), 1) * F.lit(2 ** 32) + upper(F.col("_b"), seed + 4), F.col("_size"))
    draws = F.col("_short") & (F.col("_draw") >= 0)
    row = F.when(~draws, F.struct("ts", "id", "x", "_i", "_h"))
    d = d.select(*keys, "ratio", "y", "_draw", F.when(draws, side).otherwise(F.col("_rank")).alias("_rank"), row.alias("_row"))
    source = Window.partitionBy(*keys, "ratio", "y", "_rank").orderBy("_draw")
    r = (d.withColumn("_row", F.first("_row").over(source)).filter(F.col("_draw") >= 0)
          .select(*keys, "ratio", *[F.col(f"_row.{c}").alias(c) for c in ("ts", "id", "x", "_i", "_h")], "y", "_draw"))
    w, wy = Window.partitionBy(*keys, "ratio"), Window.partitionBy(*keys, "ratio", "y")
    r = (r.withColumn("idx", F.row_number().over(w.orderBy("_i", "_draw")) - 1).withColumn("cr", F.row_number().over(wy.orderBy("_i", "_draw")) - 1)
          .withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_np", F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).over(w))
          .withColumn("_nn", F.col("_n") - F.col("_np")))
    r = r.withColumn("_f", outlier_factor(seed, unit=F.col("_h").cast("double") / F.lit(2.0 ** 32)))
    # the factor is looked at twice, or Spark would compute it anew for every coordinate
    x = F.when(F.col("_f") == 1.0, F.col("x")).otherwise(F.transform("x", lambda v: v * F.col("_f")))
    return r.select(*keys, "ratio", "idx", "ts", "id", x.alias("x"), "y")


def run_grid(df: DataFrame, online: Sequence[LearnerConfig], kernel: Sequence[LearnerConfig], ratios: Sequence[float] = (0.5, 0.7, 0.9),
             seed: int = 42, keys: Sequence[str] = ("stream",), by: Sequence[str] = ()) -> DataFrame:
    """Every rule, online and kernel, on every scenario in one fold; counts pooled over the keys (per ``by``).

    Result rows (by, ratio, algo, method, f1, accuracy, gain); gain is kernel less online F1 of the rule.  ``online``
    and ``kernel`` name the rules alike.  A prediction of 0 counts as +1 (P11).
    """
    keys, by = list(keys), list(by)
    both = [LearnerConfig(f"{m}:{c.label}", c.name, c.params) for m, cs in (("online", online), ("kernel", kernel)) for c in cs]
    d, near, cohorts = df.select(*keys, "ts", "id", "x", "y"), [], 0
    if has_lockstep(both):
        cohorts = cohort_count(df, keys, both, len(ratios))
    if cohorts:                                              # dealt once: all steps on a stream stay in the partition of its cohort
        d, parts = dealt(d, keys, cohorts)
        d = d.repartition(parts, "_pt").withColumn("_st", F.xxhash64(*keys))
        near = ["_st", "_pt", "_co"]                         # sorts compare a hash first, not long keys
    m = fold_counts(scenarios(d, ratios, seed, [*near, *keys]), both, [*keys, "ratio"], ["idx"], cohorts, "idx")
    name = F.split("algo", ":", 2)
    c = m.groupBy(*by, "ratio", name[1].alias("algo"), name[0].alias("method")).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "tn", "fn")])
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    r = c.select(*by, "ratio", "algo", "method", f1.alias("f1"),
                 ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"))
    side = lambda v: F.max(F.when(F.col("method") == v, F.col("f1"))).over(Window.partitionBy(*by, "ratio", "algo"))
    return r.withColumn("gain", side("kernel") - side("online"))
