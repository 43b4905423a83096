"""Row order, positions, splits and sampling.

Exact positional operators never use a window without ``partitionBy`` (that
would pull the table through one task).  The global position (R2) is built
from a range-partitioned, locally sorted copy: each row's position is the
rows-before-its-partition offset (a table with one row per partition) plus
its rank inside the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.functions.hashing import hash32, hash63
from streamlearn.operators.scan import prefix_scan
from streamlearn.session import written

DEFAULT_ORDER = ("ts", "id", "x", "y")
_LOW33 = (1 << 33) - 1


def order_stream(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """Total order; per key it is a local sort after hash partitioning."""
    if keys:
        return df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return df.orderBy(*order)


def with_index(df: DataFrame, order: Sequence[str] = DEFAULT_ORDER, keys: Sequence[str] = (),
               col: str = "idx", method: str = "auto", num_partitions: int | None = None,
               within: str | None = None, within_col: str = "cidx") -> DataFrame:
    """R2: 0-based position in ``order`` (globally, or within each key).

    ``method``:
      * ``range`` -- range-partition on (keys, order), number rows inside each
        partition, add per-partition offsets; per-key positions subtract the
        key's first global position.  Any key size, incl. one hot key.
      * ``window`` -- ``row_number()`` over ``partitionBy(keys)``; best for many
        small keys (no checkpoint), a single huge key lands in one task.
      * ``auto`` -- ``range`` without keys, ``window`` with keys.

    ``within`` names a column of few values (a class): ``within_col`` then is the row's position among the rows of its
    class, from the same pass (range method).
    """
    keys, order = list(keys), list(order)
    if method == "auto":
        method = "range" if not keys else "window"
    if method == "window":
        if not keys:
            raise ValueError("window method needs keys")
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(col, F.row_number().over(w) - 1)
    parts = [num_partitions] if num_partitions else []      # else the session's number, coalesced by AQE
    # Range bounds use the scalar sort columns; rows tying on them stay together.
    scalar = [c for c in keys + order if dict(df.dtypes).get(c, "").split("<")[0] not in ("array", "struct", "map")]
    ranged = df.repartitionByRange(*parts, *scalar).sortWithinPartitions(*keys, *order)
    ranged = written(_numbered(ranged, within), "index")       # positions must not change on recomputation
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a tiny table, ordered once
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wo), F.lit(0))).select("_pid", "_off")
    out = ranged.join(F.broadcast(offsets), "_pid").withColumn(col, F.col("_off") + F.col("_loc"))
    if within:
        wc = Window.partitionBy(within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        by = (ranged.groupBy("_pid", within).agg(F.count(F.lit(1)).alias("_cnt"))
                    .withColumn("_coff", F.coalesce(F.sum("_cnt").over(wc), F.lit(0))).select("_pid", within, "_coff"))
        # one row per partition and class
        out = out.join(F.broadcast(by), ["_pid", within]).withColumn(within_col, F.col("_coff") + F.col("_cloc")).drop("_coff", "_cloc")
    if keys:
        first = out.groupBy(*keys).agg(F.min(col).alias("_first"))
        out = out.join(_small(first), keys).withColumn(col, F.col(col) - F.col("_first")).drop("_first")
    return out.select(*df.columns, col, *([within_col] if within else []))


def _numbered(df: DataFrame, within: str | None) -> DataFrame:
    """Add the partition (``_pid``), the position in it (``_loc``) and, with a class column of few values, the position
    among the rows of the class in it (``_cloc``)."""
    if not within:
        mid = F.monotonically_increasing_id()
        return df.withColumn("_mid", mid).select(*df.columns, F.shiftright("_mid", 33).cast("int").alias("_pid"),
                                                 F.col("_mid").bitwiseAND(F.lit(_LOW33)).alias("_loc"))
    schema = T.StructType(df.schema.fields + [T.StructField("_pid", T.IntegerType()), T.StructField("_loc", T.LongType()), T.StructField("_cloc", T.LongType())])

    def number(batches):
        pid, done, seen = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            values, at = np.unique(b.column(b.schema.get_field_index(within)).to_numpy(zero_copy_only=False), return_inverse=True)
            local = np.zeros(b.num_rows, np.int64)
            for i, v in enumerate(values.tolist()):
                here = np.nonzero(at == i)[0]
                local[here] = seen.get(v, 0) + np.arange(len(here))
                seen[v] = seen.get(v, 0) + len(here)
            loc = done + np.arange(b.num_rows)
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(loc), pa.array(local)], names=schema.names)
    return df.mapInArrow(number, schema)


#: Groups up to which a table of one row per group is broadcast.
SMALL_GROUPS = 10_000


def _small(groups: DataFrame) -> DataFrame:
    """Broadcast a table of one row per group if it is small (class labels are), so that a hot group is not shuffled."""
    return F.broadcast(groups) if groups.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS else groups


def with_counts(df: DataFrame, keys: Sequence[str], col: str = "_n", few: bool = False) -> DataFrame:
    if keys:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(col))
        return df.join(_small(counts) if few else counts, list(keys))
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(col))))  # one row


def _cut(df: DataFrame, fracs: Sequence[float], names: Sequence[str], idx="idx", n="_n", col="part"):
    """Assign parts by cumulative boundaries floor(cum_frac * n); the last part takes the rest."""
    expr = None
    cum = 0.0
    for f, name in zip(fracs[:-1], names[:-1]):
        cum += f
        cond = F.col(idx) < F.floor(F.lit(cum) * F.col(n))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return df.withColumn(col, expr)


def temporal_split(df: DataFrame, frac: float = 0.8, keys: Sequence[str] = (),
                   order: Sequence[str] = DEFAULT_ORDER, method: str = "auto") -> DataFrame:
    """First int(frac * n) rows in time order are ``train``, the rest ``test``."""
    d = with_index(df, order, keys, method=method)
    d = with_counts(d, keys)
    return _cut(d, [frac, 1.0 - frac], ["train", "test"]).drop("_n")


def hash_split(df: DataFrame, fracs: Sequence[float] = (0.8, 0.2), names: Sequence[str] = ("train", "test"),
               seed: int = 42, keys: Sequence[str] = (), id_col: str = "id", method: str = "auto") -> DataFrame:
    """Seeded shuffle (order by hash(seed, id)) then exact cuts."""
    d = df.withColumn("_h", hash32(id_col, seed))
    d = with_index(d, ["_h", id_col, "x", "y"] if "x" in df.columns else ["_h", id_col], keys, method=method)
    d = with_counts(d, keys)
    return _cut(d, fracs, names).drop("_n", "_h")


def train_val_test(df: DataFrame, seed: int = 42, keys: Sequence[str] = (),
                   order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """R4 (64/16/20): the last 20% in time order is ``test``; the first 80% is
    shuffled by hash and cut 80/20 into ``train``/``val``."""
    t = temporal_split(df, 0.8, keys, order).withColumnRenamed("part", "_tp").drop("idx")
    head = t.filter(F.col("_tp") == "train").drop("_tp")
    tail = t.filter(F.col("_tp") == "test").drop("_tp").withColumn("part", F.lit("test"))
    hv = hash_split(head, (0.8, 0.2), ("train", "val"), seed, keys).drop("idx")
    return hv.unionByName(tail)


def stratified_split(df: DataFrame, fracs: Sequence[float] = (0.6, 0.2, 0.2),
                     names: Sequence[str] = ("train", "val", "test"), seed: int = 42,
                     label: str = "y", id_col: str = "id") -> DataFrame:
    """Per class, shuffle by hash and cut at the same fractions.

    Classes are few and may be huge, so the class-local position comes from the
    range method (never one task per class)."""
    d = df.withColumn("_h", hash32(id_col, seed))
    d = with_index(d, ["_h", id_col], col="_all", within=label, within_col="idx").drop("_all")
    d = with_counts(d, [label], few=True)
    return _cut(d, fracs, names).drop("_n", "_h")


def entity_split(df: DataFrame, entity: str = "stream", fracs: Sequence[float] = (0.2, 0.2),
                 seed: int = 42) -> DataFrame:
    """Entity-disjoint split.  Distinct entities are shuffled by hash; the
    first round(0.2 m) go to ``test``, the next round(0.2 m) to ``val``, the
    rest to ``train`` (round half to even).  Integer-like ids are hashed as
    numbers (so SQL can repeat it), other ids by their text."""
    number = F.coalesce(F.col(entity).try_cast("long"), F.xxhash64(F.col(entity).cast("string")))
    ents = df.select(entity).distinct().withColumn("_h", hash32(number, seed))
    ents = with_index(ents, ["_h", entity], method="range", col="_r")
    ents = with_counts(ents, [])
    a = F.bround(F.lit(fracs[0]) * F.col("_n"), 0)
    b = a + F.bround(F.lit(fracs[1]) * F.col("_n"), 0)
    ents = ents.select(entity, F.when(F.col("_r") < a, "test").when(F.col("_r") < b, "val")
                       .otherwise("train").alias("part"))
    return df.join(ents, entity)


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly n rows without replacement, those of the n smallest (hash, id).

    Only hash and id are sorted, to find the n-th; the rows are then filtered.  Of rows tying with the n-th, as many
    as are missing are taken."""
    if n <= 0:
        return df.limit(0)
    h = hash32(id_col, seed)
    pos = with_index(df.select(h.alias("_h"), F.col(id_col).alias("_id")), ["_h", "_id"])
    last = pos.filter(F.col("idx") == n - 1).first()
    if last is None:
        return df
    less = (h < last["_h"]) | ((h == last["_h"]) & (F.col(id_col) < last["_id"]))
    before = pos.filter((F.col("_h") == last["_h"]) & (F.col("_id") == last["_id"])).agg(F.min("idx")).first()[0]
    return df.filter(less).unionByName(df.filter((h == last["_h"]) & (F.col(id_col) == last["_id"])).limit(n - before))


def class_local_index(df: DataFrame, label: str = "y", order: Sequence[str] = DEFAULT_ORDER,
                      col: str = "cidx") -> DataFrame:
    """Position of each row within its class in ``order`` (range method)."""
    return with_index(df, order, col="_all", within=label, within_col=col).drop("_all")


def resample_ratio(df: DataFrame, ratio: float = 0.5, seed: int = 42, label: str = "y",
                   order: Sequence[str] = DEFAULT_ORDER, id_col: str = "id") -> DataFrame:
    """Class-ratio resampling to the original size n.

    n_pos = int(n * ratio), n_neg = n - n_pos.  A class with at least k rows
    keeps its k rows of smallest hash (without replacement); a smaller class is
    drawn with replacement: draw i picks class row ``hash63(i) mod size``.
    Output keeps time order (``idx``, then ``draw``); duplicates are kept.
    """
    spark = df.sparkSession
    d = with_index(df, order, [], col="idx", within=label, within_col="_ci")
    sizes = {r[0]: r[1] for r in d.groupBy(label).count().collect()}   # two scalars
    n = sum(sizes.values())
    n_pos = int(n * ratio)
    want = {1.0: n_pos, -1.0: n - n_pos}
    parts = []
    for cls, k in want.items():
        size = sizes.get(cls, 0)
        sub = d.filter(F.col(label) == F.lit(cls))
        if k <= 0 or size == 0:
            continue
        if k <= size:
            # the k-th smallest (hash, id, position) from a sort of those columns alone, then a filter
            key = [hash32(id_col, seed), F.col(id_col), F.col("idx")]
            names = ["_h", "_id", "_x"]
            pos = with_index(sub.select(*[c.alias(m) for c, m in zip(key, names)]), names, col="_r")
            last = pos.filter(F.col("_r") == k - 1).first()
            upto = F.struct(*[c.alias(m) for c, m in zip(key, names)]) <= F.struct(*[F.lit(last[m]).cast("long").alias(m) for m in names])
            parts.append(sub.filter(upto).withColumn("draw", F.lit(0).cast("long")))
        else:
            draws = spark.range(k).select(F.col("id").alias("draw"),
                                          F.pmod(hash63("id", seed + (1 if cls > 0 else 2)), F.lit(size)).alias("_ci"))
            parts.append(sub.join(draws, "_ci").select(*sub.columns, "draw"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_ci")


def epoch_order(df: DataFrame, epoch: int, base_seed: int = 42, id_col: str = "id", col: str = "_ord") -> DataFrame:
    """Per-epoch shuffle key, seed = 42 + epoch."""
    return df.withColumn(col, hash32(id_col, base_seed + epoch))


def round_chunk(df: DataFrame, r: int, C: int = 500, keys: Sequence[str] = ("stream",),
                order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """Rows [r*C, r*C + C) mod n of each stream, with their chunk position (places by a keyed prefix scan)."""
    d = with_counts(prefix_scan(df, keys, order, position="idx"), keys)
    p = F.pmod(F.col("idx") - F.lit(r * C), F.col("_n"))
    return d.withColumn("chunk_pos", p).filter(F.col("chunk_pos") < C).drop("_n")


def trailing_window(df: DataFrame, W: int = 250, keys: Sequence[str] = ("stream",),
                    order: Sequence[str] = DEFAULT_ORDER, value: str = "y") -> DataFrame:
    """Statistics of the previous W rows (rows j-W .. j-1) of each stream.

    The window runs inside blocks of a stream, so a task holds a block and not a stream."""
    w = Window.partitionBy(*keys, "_blk").orderBy("_i").rowsBetween(-W, -1)
    d = (_blocks(df, W, keys, order).withColumn("win_n", F.count(F.col(value)).over(w))
         .withColumn("win_sum", F.sum(F.col(value)).over(w)))
    return d.filter("_own").drop("_i", "_blk", "_own")


def window_rows(df: DataFrame, W: int = 250, keys: Sequence[str] = ("stream",),
                order: Sequence[str] = DEFAULT_ORDER, col: str = "win") -> DataFrame:
    """R11 with the rows: each row carries the (x, y) of the previous W rows of its stream, at most W of them; by definition W
    rows a row, held for one block of a stream at a time."""
    w = Window.partitionBy(*keys, "_blk").orderBy("_i").rowsBetween(-W, -1)
    d = _blocks(df, W, keys, order).withColumn(col, F.collect_list(F.struct("x", "y")).over(w))
    return d.filter("_own").drop("_i", "_blk", "_own")


def _blocks(df: DataFrame, W: int, keys: Sequence[str], order: Sequence[str], least: int = 10_000) -> DataFrame:
    """Each row in its block of a stream, and the last W rows of a block once more in front of the next (``_own`` false)."""
    size = max(least, 4 * W)                                # at most a quarter more rows
    d = prefix_scan(df, keys, order, position="_i").withColumn("_blk", F.floor(F.col("_i") / size))
    late = F.col("_i") % size >= size - W
    both = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (d.withColumn("_ahead", F.explode(both)).withColumn("_blk", F.col("_blk") + F.col("_ahead"))
             .withColumn("_own", F.col("_ahead") == 0).drop("_ahead"))


def eval_slice(df: DataFrame, K: int = 200, keys: Sequence[str] = ("stream",),
               order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """First K rows per task; tasks with fewer than K rows are skipped.  The row limit reaches the window, so a map
    task hands on at most K rows of a task (``row_number() <= K`` is pushed below the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (min_rows(df, K, keys).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= K).drop("_rn"))


def min_rows(df: DataFrame, k: int = 10, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Keep streams with at least k rows (semi join on a grouped count)."""
    big = df.groupBy(*keys).count().filter(F.col("count") >= k).drop("count")
    return df.join(big, list(keys), "left_semi")
