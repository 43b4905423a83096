"""Keyed prefix scans: running sums, positions and earlier values along a key's order, however long the key.

A window over (key, order) puts a key's rows into one task.  Here rows are range-partitioned on (keys, order) and
sorted inside partitions, so a long key spans neighbouring partitions.  Each task scans its rows with numpy.  Only the
first key of a partition can have begun before it; what it brings along is computed from one summary row per partition
(its first and last key and the sums of the last key's run), so the carry has as many rows as there are partitions.
The scanned table is written before the summaries are read, so nothing can change between the two passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.session import written

_NESTED = ("array", "struct", "map")


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """True where a row's key differs from the row before it (the first row: False)."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = _column(batch, k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return change


def whole_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key as batches of whole keys, of about ``rows`` rows (or one longer key)."""
    waiting, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        n += b.num_rows
        if n >= rows:
            b = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            edges = np.flatnonzero(_changes(b, keys))
            cut = int(edges[-1]) if len(edges) else 0        # the last key may go on
            if cut:
                yield b.slice(0, cut)
            waiting, n = [b.slice(cut)], b.num_rows - cut
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in range partitions of (keys, order); rows that tie on the scalar columns stay together."""
    kinds = dict(df.dtypes)
    by = [(c.removeprefix("-"), F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc()) for c in [*keys, *order]]
    scalar = [e for c, e in by if kinds[c].split("<")[0] not in _NESTED]
    return df.repartitionByRange(*scalar).sortWithinPartitions(*[e for _, e in by])


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str] | None = None,
                position: str | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """Append running values per key in ``order`` (a name with "-" in front sorts downwards).

    ``sums`` maps a new column to the integer column it adds up, the row's own value included (null adds 0);
    ``position`` names a column for the 0-based place of a row in its key; ``previous`` maps a new column to a scalar
    column whose value in the row before it takes (null in a key's first row).  Keys compare null-safe; without keys the
    table is one sequence.  Rows equal in ``order`` are taken as they are sorted.
    """
    keys, previous = list(keys), dict(previous or {})
    totals = dict(sums or {}) | ({position: None} if position else {})
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [*df.schema.fields, *[T.StructField(c, T.LongType()) for c in totals], *[T.StructField(c, kinds[v]) for c, v in previous.items()],
              T.StructField("_sp", T.IntegerType()), T.StructField("_sn", T.LongType()), T.StructField("_sf", T.BooleanType())]
    names = [f.name for f in fields]

    def scan(batches):
        part, done, at_first = TaskContext.get().partitionId(), 0, True
        carry, before, last_key = dict.fromkeys(totals, 0), {}, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = _changes(batch, keys)
            ends = [tuple(_column(batch, k)[i].as_py() for k in keys) for i in (0, n - 1)]
            change[0] = done > 0 and ends[0] != last_key
            starts, run = np.flatnonzero(change), np.cumsum(change)      # run 0: still the key of the batch before
            cols = list(batch.columns)
            for c, v in totals.items():
                value = np.ones(n, np.int64) if v is None else _column(batch, v).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                out = total - np.concatenate([[-carry[c]], total[starts] - value[starts]])[run]
                carry[c] = int(out[-1])
                cols.append(pa.array(out - 1 if v is None else out))
            for c, v in previous.items():
                col = _column(batch, v)
                moved = pa.concat_arrays([before.get(c, pa.nulls(1, col.type)), col.slice(0, n - 1)])
                before[c] = col.slice(n - 1)
                cols.append(pc.if_else(pa.array(change), pa.nulls(n, col.type), moved))
            first = at_first & (run == 0)
            at_first = bool(first[-1])
            cols += [pa.array(np.full(n, part, np.int32)), pa.array(done + np.arange(n)), pa.array(first)]
            done, last_key = done + n, ends[1]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    table = written(_ranged(df, keys, order).mapInArrow(scan, T.StructType(fields)), "scan")
    head = F.struct(*keys, F.lit(0).alias("_x"))
    tail = F.struct(*dict.fromkeys([*keys, *totals, *previous.values(), "_sf"]))
    parts = sorted(table.groupBy("_sp").agg(F.min_by(head, "_sn").alias("h"), F.max_by(tail, "_sn").alias("t")).collect())   # one row a partition
    carried, held, last = [], dict.fromkeys(totals, 0), None
    for p, h, t in parts:
        same = last is not None and all(h[k] == last[k] for k in keys)
        brought = held if same else dict.fromkeys(totals, 0)
        carried.append((p, *[brought[c] for c in totals], *[last[v] if same else None for v in previous.values()]))
        held = {c: t[c] + (v is None) + (brought[c] if t["_sf"] else 0) for c, v in totals.items()}
        last = t
    slots = {c: f"_s{i}" for i, c in enumerate([*totals, *previous])}
    carry = df.sparkSession.createDataFrame(carried, T.StructType([T.StructField("_sp", T.IntegerType()), *[T.StructField(slots[c], T.LongType()) for c in totals],
                                                                   *[T.StructField(slots[c], kinds[v]) for c, v in previous.items()]]))
    out = table.join(F.broadcast(carry), "_sp")
    for c in totals:
        out = out.withColumn(c, F.col(c) + F.when(F.col("_sf"), F.col(slots[c])).otherwise(0))
    for c in previous:
        out = out.withColumn(c, F.when(F.col("_sn") == 0, F.col(slots[c])).otherwise(F.col(c)))
    return out.select(*df.columns, *totals, *previous)
