"""Projections, filters and labels (P1-P13) as single ``select``/``filter`` steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.functions.labels import is_finite_vec, to_pm1

# Column-name conventions of the input tables.
TIME_COLS = ("Time", "timestamp")
LABEL_COLS = ("label", "Class")
ENTITY_COL = "user_id"
RESERVED = ("Time", "timestamp", "user_id", "label", "Class")

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns minus the reserved time/entity/label names (schema order)."""
    skip = set(RESERVED) | set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def assemble(cols: Sequence[str]):
    """Features as one ARRAY<DOUBLE> in the given fixed column order."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def to_stream(df: DataFrame, stream: str | None = ENTITY_COL, prefer_label: str = "label",
              label_mode: str = "zero_neg", id_col: str | None = None,
              exclude: Sequence[str] = ()) -> DataFrame:
    """Canonicalise a raw table to ``(stream, ts, id, x, y)``.

    Time column: ``Time`` else ``timestamp``; label: ``prefer_label`` if present,
    else the other of ``label``/``Class``; features: numeric columns minus the
    reserved names.  Missing columns raise with the list of what is missing.
    """
    cols = df.columns
    tcol = next((c for c in TIME_COLS if c in cols), None)
    order = [prefer_label] + [c for c in LABEL_COLS if c != prefer_label]
    lcol = next((c for c in order if c in cols), None)
    missing = ([] if tcol else ["Time|timestamp"]) + ([] if lcol else ["label|Class"])
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    ex = list(exclude) + ([id_col] if id_col else [])
    feats = feature_columns(df, ex)
    sid = F.col(stream).cast("string") if stream and stream in cols else F.lit("all")
    ident = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    return df.select(sid.alias("stream"), F.col(tcol).alias("ts"), ident.alias("id"),
                     assemble(feats).alias("x"), to_pm1(lcol, label_mode).alias("y"))


def drop_entity(df: DataFrame, entity: str = ENTITY_COL) -> DataFrame:
    """P4."""
    return df.drop(entity)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P7."""
    return df.na.drop(subset=list(subset) if subset else None)


def append_const(df: DataFrame, v: float = 1.0, col: str = "x") -> DataFrame:
    """Append a constant feature (e.g. ``user_count = 1``)."""
    return df.withColumn(col, F.concat(F.col(col), F.array(F.lit(float(v)))))


def finite_rows(df: DataFrame, col: str = "x") -> DataFrame:
    """P10: keep rows whose features are all finite."""
    return df.filter(is_finite_vec(col))
