"""Exact duplicates beside grouping by whole texts."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import exact_dedup as dedup
from tests.llm.oracle import oracle_difference

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def plain(rows):
    found = defaultdict(list)
    for row in rows:
        found[re.sub(r"[\x20\x09-\x0d]", "", row.text or "")].append(row)
    result = []
    for text, members in found.items():
        members.sort(key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        for place, row in enumerate(members):
            result.append((row.doc_id, members[0].doc_id, len(members), place == 0, sha))
    return sorted(result, key=str)


def sorted_rows(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_whole_table_equals_grouping_by_text_and_the_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted_rows(dedup.op11_exact_dedup(docs))
    assert rows == plain(docs.collect())
    assert any(not row[3] for row in rows)
    assert oracle_difference(spark, SF, "op11_exact_dedup") is None


@pytest.mark.parametrize("key_bits, deepest, held", [(64, 20, 1 << 24), (64, 5, 2000), (3, 20, 1 << 24), (1, 4, 500)])
def test_split_buckets_chains_and_small_memory_change_nothing(spark, key_bits, deepest, held):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    index = dedup.build_index(docs, 4000, deepest, key_bits, held)
    assert sorted_rows(dedup.groups(index)) == plain(docs.collect())
    assert len(index.directory.buckets) == 1 << index.directory.depth > 1
    assert index.directory.depth <= deepest


def test_directory_splits_only_overfull_buckets(spark):
    step = 1 << 58
    keys = [(i * step + j, 10) for i in range(4) for j in range(2)] + [(5 * step + (j << 46), 10) for j in range(64)]
    entries = spark.createDataFrame(keys, "key long, bytes long")
    grown = dedup.grow_directory(entries, 4, 100, 20)
    slots = [key >> (64 - grown.depth) for key, _ in keys]
    held = defaultdict(int)
    for (_, size), slot in zip(keys, slots, strict=True):
        held[int(grown.buckets[slot])] += size
    assert max(held.values()) <= 100 and grown.depth > 10
    assert len({int(grown.buckets[s]) for s in slots[:8]}) < 8
    assert list(grown.buckets) == sorted(grown.buckets) and list(grown.owners) == sorted(grown.owners)


def test_a_key_that_does_not_divide_stays_one_bucket(spark):
    entries = spark.createDataFrame([(7, 1000)] * 9 + [(-7, 5)], "key long, bytes long")
    grown = dedup.grow_directory(entries, 4, 100, 20)
    assert (grown.depth, len(grown.owners)) == (1, 2)


def test_nulls_blanks_ties_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [
        (None, None),
        (4, ""),
        (3, " \t\n\x0b\x0c\r"),
        (3, " \t\n\x0b\x0c\r"),
        (9, "a b"),
        (8, "ab"),
        (None, "a\nb"),
        (6, "a b"),
        (1, "é " * 200_000),
        (2, "é" * 200_000),
        (5, "a b"),
        (7, "A b"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    more = docs.selectExpr("*", "1 AS row", "2 AS key", "'x' AS entry", "4 AS kept", "5 AS owner", "6 AS slot")
    assert sorted_rows(dedup.op11_exact_dedup(docs)) == plain(docs.collect()) == sorted_rows(dedup.op11_exact_dedup(more))


def test_hot_group_comes_as_one_entry_per_task(spark):
    docs = spark.range(3000, numPartitions=6).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text")
    )
    index = dedup.build_index(docs)
    sha = F.lower(F.hex("sha")) == hashlib.sha256(b"sametext").hexdigest()
    assert index.buckets.filter(sha).count() == 6
    assert {r.group_size for r in index.buckets.filter(sha).collect()} == {1000}


def test_empty_table(spark):
    found = dedup.op11_exact_dedup(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
