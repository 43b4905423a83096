"""Column-level helpers (all built-in Spark expressions, no Python UDFs)."""

from streamlearn.functions.vectors import dot, sq_norm, scale, add, axpy
from streamlearn.functions.hashing import hash32, hash_unit, sql_hash32, sql_hash_unit
from streamlearn.functions.labels import to_pm1, to_01, coerce_zero, is_finite_vec, sign_pred
from streamlearn.functions.names import feature_label, short_name, base_task

__all__ = [
    "dot", "sq_norm", "scale", "add", "axpy",
    "hash32", "hash_unit", "sql_hash32", "sql_hash_unit",
    "to_pm1", "to_01", "coerce_zero", "is_finite_vec", "sign_pred",
    "feature_label", "short_name", "base_task",
]
