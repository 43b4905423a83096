"""Display-name helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_words(col) -> Column:
    """'_' -> ' ' then title case (first letter of each word upper, rest lower)."""
    return F.initcap(F.lower(F.regexp_replace(_c(col), "_", " ")))


def feature_label(df: DataFrame, col: str, dictionary: DataFrame,
                  key: str = "name", desc: str = "description") -> DataFrame:
    """Readable feature name: dictionary lookup, else title-cased fallback.

    Spark broadcasts the dictionary if it is small enough, and joins by shuffle beyond that.
    """
    d = dictionary.select(F.col(key).alias("_fl_key"), F.col(desc).alias("_fl_desc"))
    out = df.join(d, df[col] == d["_fl_key"], "left")
    return out.withColumn(col + "_label", F.coalesce(F.col("_fl_desc"), title_words(col))) \
              .drop("_fl_key", "_fl_desc")


def short_name(col, mapping: dict[str, str]) -> Column:
    """Mapped short label, falling back to the name itself."""
    if not mapping:
        return _c(col)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(m[_c(col)], _c(col))


def base_task(col) -> Column:
    """Part of a task name before the first '_'."""
    return F.substring_index(_c(col), "_", 1)
