"""Runs registered queries beside their SQL and compares every row.

Usage: python tests/compare.py SF_DIR [QUERY ...]
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerleaf.catalogue import QUERIES  # noqa: E402


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value: object) -> object:
    return round(value, 9) if isinstance(value, float) else value


def spark_rows(df: DataFrame) -> Counter:
    order = sorted(df.columns)
    return Counter(tuple(plain(v) for v in row) for row in df.select(*order).collect())


def oracle_rows(sf_dir: str, text: str) -> Counter:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.execute(text)
    names = [column[0] for column in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(row[i]) for i in order) for row in found.fetchall())
    return sorted(names), rows


def difference(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """None where both sides agree, else what differs."""
    df = QUERIES[name].run(spark, sf_dir)
    names, expected = oracle_rows(sf_dir, QUERIES[name].oracle)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} against {names}"
    actual = spark_rows(df)
    if actual == expected:
        return None if actual else "no rows"
    extra, lacking = actual - expected, expected - actual
    return f"spark only {list(extra)[:2]}, sql only {list(lacking)[:2]} ({extra.total()} rows)"


if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = session()
    for query_name in chosen:
        begun = time.time()
        try:
            result = difference(spark, folder, query_name)
        except Exception as problem:  # noqa: BLE001
            result = f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{query_name:24} {time.time() - begun:6.1f}s {result or 'ok'}", flush=True)
