"""Operators on keys: one row per key, null keys apart, dimensions without repeated keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_null_keys(df: DataFrame, key: str | Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and the rejected rows without one."""
    key = F.col(key) if isinstance(key, str) else key
    return df.filter(key.isNotNull()), df.filter(key.isNull())


def latest_per_key(df: DataFrame, key: str, latest: str) -> DataFrame:
    """One row per key: the greatest ``latest``, ties to the greatest other columns in order.

    ``max`` of a struct combines before the shuffle, so a key with very many rows
    sends one row per task. As an aggregate the result is provably unique on the key.
    """
    rest = [name for name in df.columns if name not in (key, latest)]
    best = df.groupBy(key).agg(F.max(F.struct(latest, *rest)).alias("best"))
    values = [F.col(key) if n == key else F.col(f"best.{n}").alias(n) for n in df.columns]
    return best.select(*values)


def require_unique(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dimension, refused if it has more than one row for some key; null keys match nothing.

    One aggregate over the keys, meant for a stored dimension.
    """
    keyed = dimension.dropna(subset=list(keys))
    if not keyed.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"the dimension has more than one row for some {', '.join(keys)}")
    return dimension
