"""Tables that cut a plan in two, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.workdir import work_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet and read again."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_of(df: DataFrame) -> Column:
    """All columns of a row in one struct, safe from names that clash."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def _hashable(field: T.StructField) -> Column:
    """The column, or text in its place where it holds maps, which have no hash.

    A map's entries are sorted by their keys; a map inside another type is as it is stored.
    """
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.MapType):
        keys = F.array_sort(F.map_keys(column))
        values = F.transform(keys, lambda key: F.element_at(column, key))
        return F.to_json(F.struct(keys.alias("k"), values.alias("v")))
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column


def row_marks(df: DataFrame) -> list[Column]:
    """Two hashes, mark1 and mark2, that are equal for rows that are alike."""
    columns = [_hashable(field) for field in df.schema.fields]
    return [F.xxhash64(F.lit(1), *columns).alias("mark1"), F.xxhash64(F.lit(2), *columns).alias("mark2")]
