"""Line dedup: lines that many documents share stay only in the last of them.

A line's key is the line with ASCII blanks stripped at both ends and A-Z lower-cased.
Long keys are exploded as 128-bit hashes, once for the counts and once for the join, so
nothing is written between.  A key's documents are counted with map-side partial sums;
keys over the threshold meet the lines again in an equi-join, the hits meet the last
document of their key (a key held by a third of all documents makes a skewed partition
here, which adaptive execution splits), and each document gets the list of keys it loses.
A task then walks the lines of a text by position and joins those that stay.  Texts
travel once, in the join with those lists; lines themselves never do.

Defined results: a null or empty text is one empty line; a document is an id, so rows with
the same ``doc_id`` count once for a key and lose the same keys; null ids count as one id,
smaller than any other; a text that loses all lines becomes empty; repeated rows stay
repeated; an empty table gives no rows.  Columns that the operator adds replace columns of
the same name, all others pass through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.llm.common import read, slices

#: Code points that a key has at least, and documents that hold it at least, before lines go.
LEAST_CHARS, MIN_DOCS = 40, 5
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> tuple[int, int] | None:
    """Hash of a line's key as two longs; None for keys under ``least`` code points."""
    key = line.strip(BLANKS).lower()                 # bytes: only A-Z change
    if len(key) < least or (len(key) < 4 * least and len(key.decode(errors="replace")) < least):
        return None
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def long_lines(docs: DataFrame, least: int = LEAST_CHARS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc, a, b)``: the distinct long keys of every row."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                at, a, b = [], [], []
                for i, text in enumerate(texts):
                    keys = {line_key(x, least) for x in text.split(b"\n")} - {None}
                    at += [i] * len(keys)
                    a += [k[0] for k in keys]
                    b += [k[1] for k in keys]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 names=["doc", "a", "b"])
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def lost_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc, lost array<struct<a,b>>)``: the keys each document loses, for documents that lose any."""
    often = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("a", "b")
    # rows of one id count once; both readers of the hits share this shuffle
    hits = lines.join(often, ["a", "b"]).select("doc", "a", "b").repartition("doc", "a", "b").distinct()
    last = hits.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= min_docs).drop("n")
    return (hits.join(last, ["a", "b"]).filter(F.col("doc").isNull() | (F.col("doc") < F.col("last")))
                .groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("lost")))


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, min_docs: int = MIN_DOCS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The table with its texts without the lost lines, ``n_lines`` (before) and ``n_dropped``."""
    lost = lost_lines(long_lines(docs, least, text_col, id_col), min_docs)
    new = {text_col, "n_lines", "n_dropped"}
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    cols = [F.col(f"d.`{f.name}`") for f in kept]
    joined = (docs.alias("d").join(lost.alias("l"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("l.doc")), "left")
                  .select(*cols, F.col(f"d.`{text_col}`").alias("_line_text"), F.col("l.lost").alias("_line_lost")))
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part, raw in slices(batch, "_line_text"):
                texts, n_lines, n_dropped = [], [], []
                lost = part.column(part.schema.get_field_index("_line_lost"))
                for i, text in enumerate(raw):
                    lines = text.split(b"\n")
                    keys = {(k["a"], k["b"]) for k in lost[i].as_py()} if lost[i].is_valid else ()
                    stay = [x for x in lines if line_key(x, least) not in keys] if keys else lines
                    texts.append(b"\n".join(stay).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string()),
                                                  pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)
    return joined.mapInArrow(run, schema)


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": f"""
WITH l AS (SELECT doc_id, p, x, translate(trim(x, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
 s AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
 d AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id < s.last AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""}
