"""Partitioned catalog tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession

_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def append_table(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
    path: str | None = None,
) -> None:
    """Appends; the first call creates the table (at ``path`` if one is given)."""
    writer = df.write.format(fmt).partitionBy(*partition_by).mode("append")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def replace_table_partitions(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
    path: str | None = None,
) -> None:
    """Replaces the partitions that the data holds, so a repeated load changes nothing.

    The overwrite mode is set on the session: a table insert does not read it from
    the writer's options.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        append_table(df, table, partition_by, fmt, path)
        return
    before = spark.conf.get(_OVERWRITE_MODE)
    spark.conf.set(_OVERWRITE_MODE, "dynamic")
    try:
        df.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(_OVERWRITE_MODE, before)


def drop_partitions(spark: SparkSession, table: str, rows: Iterable[Row]) -> None:
    """Drops the partitions named by ``rows``, whose fields are the partition columns."""
    specs = []
    for row in rows:
        parts = [f"{name} = {_literal(value)}" for name, value in row.asDict().items()]
        specs.append(f"PARTITION ({', '.join(parts)})")
    if specs:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(specs)}")


def _literal(value: object) -> str:
    if value is None:
        return "null"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"
