"""Append to a JDBC table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_jdbc(
    df: DataFrame, url: str, table: str, properties: dict[str, str], connections: int = 16
) -> None:
    """Appends rows, one transaction per partition, over at most ``connections`` at a time.

    A task that is lost after its commit is run again, so an append can double rows;
    reconciliation by file shows it.
    """
    (
        df.write.option("truncate", "false")
        .option("numPartitions", connections)
        .jdbc(url, table, mode="append", properties=properties)
    )
