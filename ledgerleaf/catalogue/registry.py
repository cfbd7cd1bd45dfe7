"""A query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    oracle: str | None


def comparable(df: DataFrame) -> DataFrame:
    """Dates and decimals as text, the decimals with all digits of their scale."""

    def shown(field: T.StructField):
        if isinstance(field.dataType, T.DateType | T.DecimalType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def query(run: Run, oracle: str | None = None) -> Query:
    return Query(lambda spark, sf_dir: comparable(run(spark, sf_dir)), oracle)
