"""JDBC calls without a database: what Spark's reader and writer are asked for."""

from datetime import date
from unittest.mock import MagicMock

import pytest
from pyspark.sql import Row

from ledgerleaf.plans import jobs, settlement
from ledgerleaf.plans.settlement import JdbcTarget, load_jdbc
from ledgerleaf.sinks import append_jdbc
from ledgerleaf.sources import count_by_file_sql, read_jdbc_query, read_jdbc_table
from ledgerleaf.sources import jdbc as jdbc_source

URL = "jdbc:x:y"
PROPERTIES = {"user": "u", "password": "p"}


def test_query_runs_in_the_database():
    spark = MagicMock()
    read_jdbc_query(spark, URL, "select 1", PROPERTIES)
    spark.read.format.assert_called_once_with("jdbc")
    reader = spark.read.format.return_value
    reader.option.assert_called_once_with("url", URL)
    reader.option.return_value.option.assert_called_once_with("query", "select 1")


def test_table_is_read_in_ranges(monkeypatch):
    asked = []

    def query(spark, url, text, properties):
        asked.append(text)
        return MagicMock(first=lambda: (1, 900))

    monkeypatch.setattr(jdbc_source, "read_jdbc_query", query)
    spark = MagicMock()
    read_jdbc_table(spark, URL, "orders", PROPERTIES, "id", 4)
    assert asked == ["select min(id) as lo, max(id) as hi from orders"]
    spark.read.jdbc.assert_called_once_with(
        URL,
        "orders",
        column="id",
        lowerBound="1",
        upperBound="900",
        numPartitions=4,
        properties=PROPERTIES,
    )


def test_table_is_read_by_conditions():
    spark = MagicMock()
    read_jdbc_table(spark, URL, "t", PROPERTIES, conditions=["a < 1", "a >= 1"])
    spark.read.jdbc.assert_called_once_with(
        URL, "t", predicates=["a < 1", "a >= 1"], properties=PROPERTIES
    )


def test_snapshot_writes_what_was_read(spark, monkeypatch, tmp_path):
    rows = spark.range(10)
    monkeypatch.setattr(jobs, "read_jdbc_table", lambda *_: rows)
    with pytest.raises(ValueError, match="single_task"):
        jobs.snapshot_jdbc(spark, URL, "t", PROPERTIES, str(tmp_path / "out"))
    jobs.snapshot_jdbc(spark, URL, "t", PROPERTIES, str(tmp_path / "out"), single_task=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_append_limits_connections_and_keeps_the_table():
    df = MagicMock()
    append_jdbc(df, URL, "t", PROPERTIES, connections=3)
    df.write.option.assert_called_once_with("truncate", "false")
    df.write.option.return_value.option.assert_called_once_with("numPartitions", 3)
    writer = df.write.option.return_value.option.return_value
    writer.jdbc.assert_called_once_with(URL, "t", mode="append", properties=PROPERTIES)


def test_count_text_runs_as_sql(spark):
    rows = [("a", date(2024, 1, 1)), ("a", date(2024, 1, 1)), ("b", date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "FILE_NAME string, FILE_DATE date")
    df.createOrReplaceTempView("counted")
    found = spark.sql(count_by_file_sql("counted", ["2024-01-01"])).collect()
    assert [(r.FILE_NAME, r.ROW_CNT) for r in found] == [("a", 2)]
    assert spark.sql(count_by_file_sql("counted")).count() == 2


@pytest.mark.parametrize("held, appended", [({}, 2), ({"a": 1}, 1), ({"a": 1, "b": 1}, 0)])
def test_only_new_files_are_appended(spark, monkeypatch, held, appended):
    written = []
    counts = spark.createDataFrame(
        list(held.items()), "FILE_NAME string, ROW_CNT bigint"
    )
    monkeypatch.setattr(settlement, "read_jdbc_query", lambda *_: counts)
    monkeypatch.setattr(settlement, "append_jdbc", lambda df, *_: written.extend(df.collect()))
    rows = spark.createDataFrame([("a",), ("b",)], "FILE_NAME string")
    good = [Row(FILE_NAME=name, FILE_DATE=date(2024, 1, 1)) for name in "ab"]
    load_jdbc(rows, JdbcTarget(URL, "t", PROPERTIES), good)
    assert len(written) == appended


def test_connection_values_are_not_printed():
    assert "password" not in repr(JdbcTarget(URL, "t", PROPERTIES))
