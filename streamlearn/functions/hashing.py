"""Deterministic integer hashing for seeded shuffles and random draws.

Random choices must agree between Spark and the SQL oracle, so they come from
an integer mix written with 64-bit arithmetic that never overflows (every
intermediate value stays below 2^59): the common 32-bit "xor-shift-multiply"
finaliser applied to ``(key mod 2^32) xor seed_mix``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the mix (public 32-bit integer hash constants).
_M32 = 4294967296          # 2^32
_MULT = 73244475           # 0x45d9f3b
_GOLDEN = 2654435769       # 0x9E3779B9, spreads the seed


def _seed_mix(seed: int) -> int:
    return (seed * _GOLDEN + 1) % _M32


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(key, seed: int = 0) -> Column:
    """Hash a BIGINT key column to [0, 2^32)."""
    h = F.pmod(_c(key).cast("long"), F.lit(_M32)).bitwiseXOR(F.lit(_seed_mix(seed)))
    h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(_MULT), F.lit(_M32))
    h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(_MULT), F.lit(_M32))
    return h.bitwiseXOR(F.shiftright(h, 16))


def hash32_int(key: int, seed: int = 0) -> int:
    """``hash32`` of a Python number."""
    h = key % _M32 ^ _seed_mix(seed)
    for _ in range(2):
        h = (h ^ h >> 16) * _MULT % _M32
    return h ^ h >> 16


def hash32_array(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """``hash32`` of an array of whole numbers."""
    h = np.mod(keys, _M32).astype(np.uint64) ^ np.uint64(_seed_mix(seed))
    for _ in range(2):
        h = (h ^ h >> np.uint64(16)) * np.uint64(_MULT) % np.uint64(_M32)
    return (h ^ h >> np.uint64(16)).astype(np.int64)


def with_hash32(df: DataFrame, name: str, key, *seeds) -> DataFrame:
    """Add ``hash32`` as a column: every step a projection of its own, for as one expression each step is written out twice
    in the next.  One seed, or pairs (condition, seed) of which the first true one counts and, last, a seed."""
    mix = F.lit(_seed_mix(seeds[-1]))
    for cond, seed in reversed(seeds[:-1]):
        mix = F.when(cond, F.lit(_seed_mix(seed))).otherwise(mix)
    h = F.col(name)
    df = df.withColumn(name, F.pmod(_c(key).cast("long"), F.lit(_M32)).bitwiseXOR(mix))
    for _ in range(2):
        df = df.withColumn(name, F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(_MULT), F.lit(_M32)))
    return df.withColumn(name, h.bitwiseXOR(F.shiftright(h, 16)))


def hash_unit(key, seed: int = 0) -> Column:
    """Uniform double in [0, 1) derived from ``hash32``."""
    return hash32(key, seed).cast("double") / F.lit(float(_M32))


def sql_hash32(key_sql: str, seed: int = 0) -> str:
    """The same hash as a DuckDB/ANSI SQL expression string (for oracles)."""
    h = f"xor((({key_sql})::BIGINT % {_M32} + {_M32}) % {_M32}, {_seed_mix(seed)})"
    h = f"((xor({h}, ({h}) >> 16) * {_MULT}) % {_M32})"
    h = f"((xor({h}, ({h}) >> 16) * {_MULT}) % {_M32})"
    return f"xor({h}, ({h}) >> 16)"


def sql_hash_unit(key_sql: str, seed: int = 0) -> str:
    return f"(({sql_hash32(key_sql, seed)})::DOUBLE / {float(_M32)})"


def hash63(key, seed: int = 0) -> Column:
    """Hash a BIGINT key column to [0, 2^63): two 32-bit hashes, both halves of the key in each."""
    k, high = _c(key).cast("long"), F.shiftright(_c(key).cast("long"), 32)
    half = lambda s: hash32(k, s).bitwiseXOR(hash32(high, s + 1))
    return F.shiftright(half(seed), 1) * F.lit(_M32) + half(seed + 2)


def sql_hash63(key_sql: str, seed: int = 0) -> str:
    """The same hash as a SQL expression string."""
    half = lambda s: f"xor({sql_hash32(key_sql, s)}, {sql_hash32(f'(({key_sql})::BIGINT >> 32)', s + 1)})"
    return f"((({half(seed)}) >> 1) * {_M32} + {half(seed + 2)})"
