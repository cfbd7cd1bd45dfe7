"""Files of several headers, faults told apart, and parts of a database table."""

import re
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.operators import reconcile_content, row_prints
from ledgerleaf.sources import csv_headers, read_csv_files, split_conditions, split_points_sql
from ledgerleaf.sources.faults import faulty_paths, is_file_fault, without_faulty
from ledgerleaf.sources.jdbc import _pivots_sql

SCHEMA = T.StructType().add("id", "integer").add("name", "string")


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    paths = [
        write(tmp_path, "a.csv", "id,name\n1,x\n2,N/A\n"),
        write(tmp_path, "b c%20+.csv", 'name,id\n"y, z",3\n'),
        write(tmp_path, "d.csv", "extra,name,id\r\ne,w,4\r\n"),
        write(tmp_path, "e.csv", "id,name\n5,v\n"),
        write(tmp_path, "bom.csv", "﻿id,name\n6,u\n"),
        write(tmp_path, "empty.csv", ""),
        write(tmp_path, "head.csv", "id,more,name\n"),
    ]
    headers = {row.header: len(row.files) for row in csv_headers(spark, paths).collect()}
    assert headers == {"id,name": 3, "name,id": 1, "extra,name,id": 1, "id,more,name": 1}
    df = read_csv_files(spark, paths, SCHEMA, ["N/A"])
    assert df.dtypes == [("id", "int"), ("name", "string"), ("extra", "string"), ("more", "string")]
    assert sorted(map(tuple, df.collect())) == [
        (1, "x", None, None),
        (2, None, None, None),
        (3, "y, z", None, None),
        (4, "w", "e", None),
        (5, "v", None, None),
        (6, "u", None, None),
    ]


def test_a_file_without_a_declared_column_is_refused(spark, tmp_path):
    paths = [write(tmp_path, "a.csv", "id,name\n1,x\n"), write(tmp_path, "b.csv", "id\n2\n")]
    with pytest.raises(ValueError, match="name"):
        read_csv_files(spark, paths, SCHEMA)


def test_headers_of_files_in_many_parts(spark, tmp_path):
    write(tmp_path, "a.csv", "id,name\n" + "".join(f"{i},n{i}\n" for i in range(3000)))
    write(tmp_path, "b.csv", "name,id\n" + "".join(f"n{i},{i}\n" for i in range(3000, 6000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv_files(spark, str(tmp_path), SCHEMA)
        assert df.filter(F.col("name") == F.concat(F.lit("n"), "id")).count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_files(spark, tmp_path):
    assert read_csv_files(spark, write(tmp_path, "empty.csv", ""), SCHEMA).collect() == []


def test_only_errors_about_files_blame_files(spark, tmp_path):
    good, absent = write(tmp_path, "a b.txt", "x\n"), str(tmp_path / "none.txt")
    spoiled = write(tmp_path, "s p%20.txt", "y\n")
    (tmp_path / ".s p%20.txt.crc").write_bytes(b"crc\0\0\0\2\0" + b"\1\2\3\4")
    paths, seen = [good, absent, spoiled], []

    def work(part):
        seen.append(part)
        return spark.read.text(part).count()

    assert without_faulty(paths, work)[0] == 1
    assert seen == [paths, [good, spoiled], [good]]

    def fails(part):
        seen.append(part)
        spark.range(1).select(F.raise_error(F.lit(f"no file: {part[0]}"))).collect()

    seen.clear()
    with pytest.raises(Exception, match="no file") as raised:
        without_faulty(paths, fails)
    assert seen == [paths] and not is_file_fault(raised.value) and faulty_paths(raised.value, paths) == []


def test_a_folder_is_blamed_for_its_files(spark, tmp_path):
    folder = tmp_path / "delivery"
    folder.mkdir()
    write(folder, "part-1", "x\n")
    (folder / ".part-1.crc").write_bytes(b"crc\0\0\0\2\0" + b"\1\2\3\4")
    others = write(tmp_path, "delivery2", "z\n")
    rows, faults = without_faulty([str(folder), others], lambda part: spark.read.text(part).count())
    assert rows == 1 and list(faults) == [str(folder)] and "\tat " not in faults[str(folder)]


KEYS = {
    "skewed": lambda i: 7 if i % 3 else i,
    "null": lambda i: None if i % 2 else i // 4,
    "all null": lambda i: None,
    "text": lambda i: f"it's {i % 5}",
    "day": lambda i: date(2024, 1, 1 + i % 3),
    "moment": lambda i: datetime(2024, 1, 1, i % 3, 5, 6) if i % 4 else None,
    "decimal": lambda i: Decimal(i % 9) / 4,
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("parts", [1, 7])
def test_parts_are_of_equal_size_and_a_row_is_in_one(spark, kind, parts):
    rows = [(KEYS[kind](i), i) for i in range(300)]
    types = {"text": "string", "day": "date", "moment": "timestamp_ntz", "decimal": "decimal(9,2)"}
    df = spark.createDataFrame(rows, f"k {types.get(kind, 'int')}, id int")
    df.createOrReplaceTempView("split_test")
    points = spark.sql(split_points_sql("split_test", "k", "id", parts)).collect()
    conditions = split_conditions(points, "k", "id")
    held = [[row.id for row in df.filter(text).collect()] for text in conditions]
    assert len(held) == parts and Counter(i for one in held for i in one) == Counter(range(300))
    assert {len(one) for one in held} <= {300 // parts, -(-300 // parts)}


@pytest.mark.parametrize("kind", KEYS)
def test_points_between_pivots_are_those_of_one_sort(spark, kind):
    """Few rows a group and a pivot, so that the points lie between pivots of all groups."""
    types = {"text": "string", "day": "date", "moment": "timestamp_ntz", "decimal": "decimal(9,2)"}
    rows = [(KEYS[kind](i), i - 400) for i in range(1_103)]
    spark.createDataFrame(rows, f"k {types.get(kind, 'int')}, id int").createOrReplaceTempView("pivot_test")
    order = "CASE WHEN k IS NULL THEN 0 ELSE 1 END, k, id"
    dealt = spark.sql(f"SELECT k, id, ntile(9) OVER (ORDER BY {order}) AS n FROM pivot_test").collect()
    first = {}
    for row in sorted(dealt, key=lambda row: (row.n, row.k is not None, row.k if row.k is not None else 0, row.id)):
        first.setdefault(row.n, (row.n, row.k, row.id))
    text = split_points_sql("pivot_test", "k", "id", 9, deal="MOD(id, 3)", every=4)
    assert sorted(tuple(row) for row in spark.sql(text).collect()) == [first[n] for n in range(1, 10)]


def test_no_window_holds_the_whole_table(spark):
    """The windows over all groups see pivots only, one in ``every`` rows."""
    spark.range(40_000).selectExpr("id % 7 AS k", "id").createOrReplaceTempView("wide_test")
    text = split_points_sql("wide_test", "k", "id", 8)
    alone = re.findall(r"(\w+\([^()]*\)) OVER \(ORDER", text)
    assert alone == ["ROW_NUMBER()"] and "NTILE" not in text
    assert spark.sql(_pivots_sql("wide_test", "k", "id", "MOD(id, 4)", 512)).count() == 4 * (10_000 // 512)
    points = spark.sql(split_points_sql("wide_test", "k", "id", 8, deal="MOD(id, 4)")).collect()
    met = spark.table("wide_test").selectExpr(*[f"{c} AS c" for c in split_conditions(points, "k", "id")][:1])
    assert len(points) == 8 and met.filter("c").count() == 5_000


def test_points_of_any_position_are_enough():
    points = [Row(2, 5, 30), Row(1, None, 1)]
    assert split_conditions(points, "k", "id") == [
        "(k IS NULL OR k < 5 OR (k = 5 AND id < 30))",
        "(k > 5 OR (k = 5 AND id >= 30))",
    ]


def test_content_is_compared_as_a_multiset(spark):
    def side(*rows):
        return row_prints(spark.createDataFrame(rows, "FILE_NAME string, FILE_DATE date, a int, b string"))

    day = date(2024, 1, 1)
    one = side(("same", day, 1, "x"), ("same", day, 1, "x"), ("null", None, None, "y"), ("twice", day, 1, "x"), ("twice", day, 1, "x"), ("gone", day, 1, "x"))
    two = side(("same", day, 1, "x"), ("same", day, 1, "x"), ("null", None, 0, "y"), ("twice", day, 2, "z"), ("twice", day, 2, "z"), ("new", day, 1, "x"))
    states = {r.FILE_NAME: (r.count_state, r.content_state) for r in reconcile_content(one, two).collect()}
    assert states == {
        "same": ("success", "success"),
        "null": ("success", "fail"),
        "twice": ("success", "fail"),
        "gone": ("fail", "fail"),
        "new": ("fail", "fail"),
    }
