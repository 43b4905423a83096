"""Helpers shared by the operators of this package.

Text operators run as ``mapInArrow`` over the rows of a DataFrame: Spark deals
out the partitions, a task sees one Arrow batch at a time and cuts it into
slices of bounded bytes, so memory does not depend on the table or on a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn import checkpoint_dir

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_bucket(col: str, mod: int):
    """``crc32(id as text) mod m``; a null id has no bucket (null)."""
    return F.crc32(F.col(col).cast("string")) % F.lit(mod)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes (one row at least).

    Only the texts of one run are Python objects at a time."""
    column = batch.column(batch.schema.get_field_index(text_col))
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > limit:
            yield batch.slice(start, i - start), as_bytes(column.slice(start, i - start))
            start, size = i, 0
        size += n
    if start < len(column):
        yield batch.slice(start), as_bytes(column.slice(start))


def with_computed(df: DataFrame, make: Callable[[], Callable[[list[bytes]], dict[str, object]]],
                  fields: Sequence[tuple[str, str]], text_col: str = "text",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed from the text column.

    ``make()`` runs once in each task and returns the function from a list of
    texts (bytes) to a dict of column values.  ``keep`` names the input columns
    that stay (all by default).  A computed column replaces an input column of
    the same name, as ``withColumn`` does.
    """
    new = [n for n, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    inner = {f.name for f in kept} | {text_col}
    src = df.select(*[F.col(f"`{c}`") for c in df.columns if c in inner])
    kept_names = [f.name for f in kept]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept]
                          + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in fields])

    def run(batches):
        compute = make()
        for batch in batches:
            for part, texts in slices(batch, text_col):
                out = compute(texts)
                arrays = [part.column(part.schema.get_field_index(n)) for n in kept_names]
                arrays += [v if isinstance(v := out[n], pa.Array) else pa.array(v) for n in new]
                yield pa.RecordBatch.from_arrays(arrays, names=kept_names + new)

    return src.mapInArrow(run, schema)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Keep the rows whose text the task-local predicate accepts; all columns stay, no shuffle."""
    def run(batches):
        accept = make()
        for batch in batches:
            for part, texts in slices(batch, text_col):
                yield part.filter(pa.array(np.asarray(accept(texts), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def rewrite_text(df: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bytes]]], text_col: str = "text") -> DataFrame:
    """Replace the text column in place; null texts stay null, other columns are untouched."""
    def run(batches):
        rewrite = make()
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            for part, texts in slices(batch, text_col):
                there = part.column(k).is_valid().to_pylist()
                new = [t.decode() if ok else None for t, ok in zip(rewrite(texts), there)]
                yield part.set_column(k, text_col, pa.array(new, pa.string()))

    return df.mapInArrow(run, df.schema)


def bounded_labels(labels: DataFrame, label: str, max_rows: int, mod: int, held: int) -> list[tuple[int, int]]:
    """At most about ``max_rows`` training labels, chosen by a hash of the id.

    Rows without id or label, and the held-out bucket ``crc32(id) mod m = held``,
    take no part.  A document with several label rows gets their rounded mean.
    The rows come back sorted by id, so a fit does not depend on task order.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_bucket("doc_id", mod) != held))
                  .groupBy("doc_id").agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y")))
    n = rows.count()
    if n > max_rows:
        # uniform hash of the id: the share max_rows / n, with room for its spread, then an exact limit
        part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000))
        rows = rows.filter(part < F.lit(int(1_000_000 * max_rows / n) + 1))
    got = sorted((r[0], r[1]) for r in rows.collect())
    return got[:max_rows] if len(got) > max_rows else got


def labelled_documents(docs: DataFrame, sample: list[tuple[int, int]]) -> DataFrame:
    """The sampled documents (doc_id, text, y); the broadcast side is the bounded sample."""
    spark = docs.sparkSession
    lab = spark.createDataFrame(sample, "doc_id long, y int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab), "doc_id")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files, and several
    readers do not compute the rows again.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
