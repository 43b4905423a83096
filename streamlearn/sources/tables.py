"""Sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_datasets(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Read one parquet file or every matching file in a folder, tagging
    each row with ``dataset`` = file stem (from the scan's ``_metadata``)."""
    glob = path if path.endswith(".parquet") else os.path.join(path, pattern)
    df = spark.read.parquet(glob)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    return df.withColumn("dataset", stem)


def canonical_datasets(df: DataFrame, col: str = "dataset") -> DataFrame:
    """``X_train`` / ``X_test`` collapse to ``X``; distinct, sorted."""
    return (df.select(F.regexp_replace(F.col(col), r"_(train|test)$", "").alias("dataset"))
              .distinct().orderBy("dataset"))


def csv_to_parquet(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """S3: CSV with header -> parquet; returns the written table."""
    spark.read.csv(src, header=True, inferSchema=True).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every DOUBLE/FLOAT column (report formatting)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_results(df: DataFrame, path: str, digits: int = 4) -> None:
    """Result sink, CSV with header and floats rounded to ``digits``."""
    round_doubles(df, digits).write.mode("overwrite").option("header", True).csv(path)


def profile(df: DataFrame, entity: str = "user_id", label: str = "label",
            approx: bool = False) -> DataFrame:
    """One-row profile: rows, columns, has entity/label, distinct labels/entities.

    A single aggregation pass; ``approx`` switches to HyperLogLog counts, which
    keep the per-task state bounded on very large tables.
    """
    cols = df.columns
    distinct = F.approx_count_distinct if approx else F.countDistinct
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs.append(distinct(label).alias("n_labels") if label in cols else F.lit(None).cast("long").alias("n_labels"))
    aggs.append(distinct(entity).alias("n_entities") if entity in cols else F.lit(None).cast("long").alias("n_entities"))
    return (df.agg(*aggs)
              .withColumn("n_columns", F.lit(len(cols)))
              .withColumn("has_entity", F.lit(entity in cols))
              .withColumn("has_label", F.lit(label in cols)))


def missing_datasets(expected: DataFrame, found: DataFrame, col: str = "dataset") -> DataFrame:
    """Every expected name with ``found`` flag, the number missing and an
    overall status (``success`` when none is missing, else ``partial``)."""
    exp = expected.select(col).distinct()
    got = found.select(col).distinct().withColumn("_found", F.lit(True))
    j = exp.join(got, col, "left").select(col, F.coalesce("_found", F.lit(False)).alias("found"))
    summary = j.agg(F.sum(F.when(~F.col("found"), 1).otherwise(0)).cast("long").alias("n_missing"))
    # summary is exactly one row, so the broadcast cross join adds two columns
    return (j.crossJoin(F.broadcast(summary))
             .withColumn("status", F.when(F.col("n_missing") == 0, "success").otherwise("partial")))


def union_streams(dfs: Sequence[DataFrame], tags: Sequence[str], tag_col: str = "part") -> DataFrame:
    """Union by name with an origin tag and its position, so the original
    order (part, then in-part order) can be restored with a sort."""
    out = None
    for i, (d, t) in enumerate(zip(dfs, tags)):
        d = d.withColumn(tag_col, F.lit(t)).withColumn(tag_col + "_pos", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
