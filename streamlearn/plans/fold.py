"""Keyed sequential folds: predict-then-learn per (stream, config) key.

Physical plan::

    input (keys, order cols, x, y [, passthrough])
      -> repartition(keys)                      one shuffle, hash on the key
      -> sortWithinPartitions(keys, _k, order)  external sort, spills
      -> mapInArrow(fold)                       O(model state) memory per task

Rows of a key arrive contiguously and in order; the fold walks Arrow batches,
keeps only the current key's models, and emits a prediction per row and/or
one model row when the key ends.  Nothing is collected per group.

Many configurations run inside one pass (one shuffle for all of them).  With
``split_configs=True`` the input is crossed with the (small, broadcast)
config list and partitioned by (key, config) instead, so a hot stream's
configurations spread over tasks.  A single stream is sequential by
definition; ``plans.protocols.fit_mixed`` is the parallel alternative.

Warm starts: an ``init`` DataFrame (keys, algo, w, sigma, g, g1t, b, t) is
unioned in as marker rows sorted before the key's data rows, a state in one vector.  With
``init_only`` a key runs just the configurations that have an init row.

Kernel rules also get the row's id and, where the input has a column ``wt``,
its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.plans.learners import LearnerConfig

DEFAULT_ORDER = ("ts", "id", "x", "y")

MODEL_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("mistakes", T.LongType()),
    T.StructField("w", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.ArrayType(T.DoubleType())),
    T.StructField("g", T.ArrayType(T.DoubleType())),
    T.StructField("g1t", T.ArrayType(T.DoubleType())),
    T.StructField("b", T.DoubleType()),
    T.StructField("t", T.LongType()),
    T.StructField("tp", T.LongType()),
    T.StructField("fp", T.LongType()),
    T.StructField("tn", T.LongType()),
    T.StructField("fn", T.LongType()),
]
STATE_COLS = ["w", "sigma", "g", "g1t", "b", "t"]


def _arrow_type(dt: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dt)


_VECTORS, _NUMBERS = ["w", "sigma", "g", "g1t"], ["b", "t"]


def _start_rows(init: DataFrame, configs, keys) -> DataFrame:
    """Start models as rows like the data's: ``y`` is the number of the configuration, ``x`` the whole state in one vector
    (the vectors' lengths, -1 for null; what is set of the numbers, their values; the vectors).  Columns of their own
    beside every row would make Spark's generated code of the sort many times slower."""
    number = F.coalesce(*[F.when(F.col("algo") == c.label, F.lit(float(n))) for n, c in enumerate(configs)])
    none = F.array().cast("array<double>")
    length = [F.coalesce(F.when(F.col(v).isNotNull(), F.size(v).cast("double")), F.lit(-1.0)) for v in _VECTORS]
    known = [F.col(v).isNotNull().cast("double") for v in _NUMBERS]
    value = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in _NUMBERS]
    state = F.concat(F.array(*length, *known, *value), *[F.coalesce(F.col(v).cast("array<double>"), none) for v in _VECTORS])
    return (init.withColumn("y", number).withColumn("x", state).select(*dict.fromkeys([*keys, "y", "x"]), F.lit(0).alias("_k"))
                .filter(F.col("y").isNotNull()))


def _unpack(v: list) -> dict:
    st, at = {}, len(_VECTORS) + 2 * len(_NUMBERS)
    for n, name in enumerate(_VECTORS):
        size = int(v[n])
        st[name] = None if size < 0 else v[at:at + size]
        at += max(size, 0)
    b, t = (v[len(_VECTORS) + len(_NUMBERS) + n] if v[len(_VECTORS) + n] else None for n in range(2))
    return st | {"b": b, "t": None if t is None else int(t)}


def _fold_fn(configs, key_names, pass_names, emit_preds, emit_models, split, out_fields, has_init, init_only, has_weight,
             phase_name=None):
    # in split mode the fold key ends with "algo", which is emitted once, as algo
    out_keys = key_names[:-1] if split else key_names
    cfg_by_label = {c.label: c for c in configs}
    out_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out_fields])
    out_names = [f.name for f in out_fields]

    def fn(batches):
        cur = None          # current key tuple
        phase = None        # value of the snapshot column in the current key
        models = None       # list of (label, learner)
        inits = {}          # label -> state dict for the current key
        pos = 0
        out = {n: [] for n in out_names}

        def flush_models(key):
            for label, L in models:
                st = L.state()
                for i, k in enumerate(out_keys):
                    out[k].append(key[i])
                for n in pass_names:
                    out[n].append(None)
                if phase_name:
                    out[phase_name].append(phase)
                    st = {n: list(v) if isinstance(v, list) else v for n, v in st.items()}     # the learner goes on
                out["algo"].append(label)
                if emit_preds:
                    for n in ("id", "ts", "y", "pred", "score", "pos"):
                        out[n].append(None)
                out["_kind"].append(1)
                out["n"].append(pos)
                out["mistakes"].append(L.mistakes)
                for n in STATE_COLS:
                    out[n].append(st[n])
                cm = counts[label]
                out["tp"].append(cm[0]); out["fp"].append(cm[1]); out["tn"].append(cm[2]); out["fn"].append(cm[3])

        counts = {}

        def start(key, d):
            sel = [cfg_by_label[key[-1]]] if split else configs
            for c in sel:
                counts[c.label] = [0, 0, 0, 0]
            ms = []
            for c in sel:
                if init_only and c.label not in inits:
                    continue
                L = c.make(d)
                if c.label in inits:
                    L.load(inits[c.label])
                ms.append((c.label, L))
            return ms

        for rb in batches:
            cols = rb.to_pydict()
            keys = [cols[k] for k in key_names]
            xs, ys, ids, tss = cols["x"], cols["y"], cols["id"], cols["ts"]
            kinds = cols["_k"] if has_init else None
            weights = cols["wt"] if has_weight else None
            passes = [cols[n] for n in pass_names]
            phases = cols[phase_name] if phase_name else None
            for i in range(rb.num_rows):
                key = tuple(kc[i] for kc in keys)
                if key != cur:
                    if cur is not None and models is not None and emit_models:
                        flush_models(cur)
                    cur, models, pos = key, None, 0
                    inits = {}
                if has_init and kinds[i] == 0:
                    inits[configs[int(ys[i])].label] = _unpack(xs[i])
                    continue
                x, y = xs[i], ys[i]
                if models is None:
                    models = start(key, len(x))
                elif phase_name and phases[i] != phase:
                    flush_models(cur)
                if phase_name:
                    phase = phases[i]
                for label, L in models:
                    p, s = L.step_row(x, y, ids[i], weights[i] if has_weight else 1.0) if L.rowwise else L.step(x, y)
                    # running M2 counts (-1 negative, anything else positive)
                    counts[label][(0 if p != -1.0 else 3) if y != -1.0 else (1 if p != -1.0 else 2)] += 1
                    if emit_preds:
                        for j, k in enumerate(out_keys):
                            out[k].append(key[j])
                        for j, n in enumerate(pass_names):
                            out[n].append(passes[j][i])
                        out["algo"].append(label)
                        out["id"].append(ids[i])
                        out["ts"].append(tss[i])
                        out["y"].append(y)
                        out["pred"].append(p)
                        out["score"].append(s)
                        out["pos"].append(pos)
                        out["_kind"].append(0)
                        if emit_models:
                            for n in ("n", "mistakes", "w", "sigma", "g", "g1t", "b", "t", "tp", "fp", "tn", "fn"):
                                out[n].append(None)
                pos += 1
            if out["_kind"]:
                yield pa.RecordBatch.from_pydict(out, schema=out_schema)
                out = {n: [] for n in out_names}
        if cur is not None and models is not None and emit_models:
            flush_models(cur)
        if out["_kind"]:
            yield pa.RecordBatch.from_pydict(out, schema=out_schema)

    return fn


def _fold(df: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",), order=DEFAULT_ORDER,
          init: DataFrame | None = None, emit_preds=True, emit_models=False,
          split_configs=False, passthrough: Sequence[str] = (), init_only=False, snapshots: str | None = None) -> DataFrame:
    configs = [c.shipped() for c in configs]
    keys, order, passthrough = list(keys), list(order), list(passthrough)
    if snapshots:
        order = [snapshots, *[c for c in order if c != snapshots]]
    spark = df.sparkSession
    base_cols = list(dict.fromkeys(keys + ["ts", "id", "x", "y"] + [c for c in order if c not in ("ts", "id", "x", "y")] + passthrough
                                  + (["wt"] if "wt" in df.columns else [])))
    data = df.select(*base_cols)
    fold_keys = keys
    if split_configs:
        cfg = spark.createDataFrame([(c.label,) for c in configs], "algo string")
        data = data.crossJoin(F.broadcast(cfg))   # bounded: one row per configuration
        fold_keys = keys + ["algo"]
    has_init = init is not None
    if has_init:
        ini = _start_rows(init, configs, fold_keys)
        data = data.withColumn("_k", F.lit(1)).unionByName(ini, allowMissingColumns=True)
        sort_cols = fold_keys + ["_k"] + order
    else:
        sort_cols = fold_keys + order
    data = data.repartition(*fold_keys).sortWithinPartitions(*sort_cols)
    ts_type = dict((f.name, f.dataType) for f in data.schema.fields)["ts"]
    data = data.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))

    sch = {f.name: f for f in data.schema.fields}
    out_fields = [T.StructField(k, sch[k].dataType) for k in keys]
    out_fields += [T.StructField(n, sch[n].dataType) for n in passthrough]
    if snapshots:
        out_fields.append(sch[snapshots])
    out_fields.append(T.StructField("algo", T.StringType()))
    if emit_preds:
        out_fields += [T.StructField("id", sch["id"].dataType), T.StructField("ts", sch["ts"].dataType),
                       T.StructField("y", T.DoubleType()), T.StructField("pred", T.DoubleType()),
                       T.StructField("score", T.DoubleType()), T.StructField("pos", T.LongType())]
    out_fields.append(T.StructField("_kind", T.IntegerType()))
    if emit_models:
        out_fields += MODEL_FIELDS
    fn = _fold_fn(configs, fold_keys, passthrough, emit_preds, emit_models, split_configs,
                  out_fields, has_init, init_only and has_init, "wt" in df.columns, snapshots)
    out = data.mapInArrow(fn, T.StructType(out_fields))
    if emit_preds:
        out = out.withColumn("ts", F.timestamp_micros("ts").cast(ts_type))
    return out


def fold_predictions(df: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",),
                     order=DEFAULT_ORDER, init: DataFrame | None = None, split_configs=False,
                     passthrough: Sequence[str] = (), init_only=False, lockstep: bool | None = None) -> DataFrame:
    """One prequential prediction per (row, config): keys, algo, id, ts, y, pred, score, pos.

    Sliding windows (F4) of many streams go in lock step (``plans.windows``); ``lockstep`` forces or forbids that."""
    from streamlearn.plans.windows import has_windows, window_cohorts, window_predictions
    if lockstep is not False and init is None and not split_configs and not passthrough and has_windows(configs):
        cohorts = window_cohorts(df, list(keys), configs) or (1 if lockstep else 0)
        if cohorts:
            return window_predictions(df, configs, keys, order, cohorts)
    out = _fold(df, configs, keys, order, init, True, False, split_configs, passthrough, init_only)
    return out.drop("_kind")


def fold_models(df: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",),
                order=DEFAULT_ORDER, init: DataFrame | None = None, split_configs=False, init_only=False, lockstep: bool | None = None,
                streams: tuple[DataFrame, int] | None = None, snapshots: str | None = None) -> DataFrame:
    """The final model per (key, config): keys, algo, n, mistakes, w, sigma, g, g1t, b, t,
    plus the prequential M2 counts tp, fp, tn, fn of the pass.

    Where there are many streams, and all rules have a lock-step form (``plans.lockstep``; with start models, linear rules), the
    streams of a cohort step together; the models are the same.  ``lockstep`` forces or forbids that; ``streams`` is a
    smaller table to count the streams on, and how many streams here each of its keys stands for.

    ``snapshots`` names a column that leads the row order; a persistent model is then returned after each of its values
    (keys, that column, algo, ...), from the same single pass."""
    from streamlearn.plans.lockstep import cohort_count, has_lockstep, lockstep_models
    configs = [c.shipped() for c in configs]
    if lockstep is not False and not split_configs and not snapshots and has_lockstep(configs, init is not None):
        rows, times = streams or (df, 1)
        cohorts = cohort_count(rows, [k for k in keys if k in rows.columns], configs, times) or (1 if lockstep else 0)
        if cohorts:
            return lockstep_models(df, configs, keys, order, cohorts, MODEL_FIELDS, init, init_only)
    out = _fold(df, configs, keys, order, init, False, True, split_configs, init_only=init_only, snapshots=snapshots)
    return out.drop("_kind")


COUNT_FIELDS = [f for f in MODEL_FIELDS if f.name in ("n", "mistakes", "tp", "fp", "tn", "fn")]


def fold_counts(df: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",), order=DEFAULT_ORDER, cohorts: int = 0,
                position: str | None = None) -> DataFrame:
    """The counts of ``fold_models`` (keys, algo, n, mistakes, tp, fp, tn, fn) without the models, whose vectors would travel
    for nothing.  ``cohorts`` is what ``plans.lockstep.cohort_count`` gave (0: one stream after another), ``position`` a column
    that numbers a stream's rows from 0 in the order."""
    from streamlearn.plans.lockstep import lockstep_models
    configs = [c.shipped() for c in configs]
    if cohorts:
        return lockstep_models(df, configs, keys, order, cohorts, COUNT_FIELDS, counts=True, position=position)
    return _fold(df, configs, keys, order, None, False, True).select(*keys, "algo", *[f.name for f in COUNT_FIELDS])


def fold_both(df: DataFrame, configs: Sequence[LearnerConfig], keys=("stream",),
              order=DEFAULT_ORDER, init: DataFrame | None = None, split_configs=False,
              passthrough: Sequence[str] = (), materialize=True):
    """Predictions and final models from one pass; the pass is checkpointed
    (shared checkpoint folder) so the two outputs do not recompute the fold."""
    from streamlearn.session import reliable_checkpoint
    out = _fold(df, configs, keys, order, init, True, True, split_configs, passthrough)
    if materialize:
        out = reliable_checkpoint(out)
    keys = list(keys)
    preds = out.filter(F.col("_kind") == 0).select(*keys, *passthrough, "algo", "id", "ts", "y", "pred", "score", "pos")
    models = out.filter(F.col("_kind") == 1).select(*keys, "algo", *[f.name for f in MODEL_FIELDS])
    return preds, models
