"""The manifest beside a plain tree of Python lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import merkle
from tests.llm.oracle import oracle_difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def joined(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, more=0):
    n_chars = None if row.n_chars is None else row.n_chars + more
    values = (row.doc_id, row.source, row.lang, n_chars, row.text)
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(hashes):
    found = [hashes]
    while len(found[-1]) > 1:
        found.append([joined(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row.lang, []).append(row)
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
    trees = [levels([leaf_of(r) for r in groups[lang]]) for lang in langs]
    top = levels([tree[-1][0] for tree in trees])
    found = []
    for number, lang in enumerate(langs):
        for at, row in enumerate(groups[lang]):
            tampered = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
            folded, proof = leaf_of(row, int(tampered)), []
            for tree, pos in ((trees[number], at), (top, number)):
                for level in tree[:-1]:
                    pair = level[pos // 2 * 2 : pos // 2 * 2 + 2]
                    proof += [h for i, h in enumerate(pair) if i != pos % 2]
                    pair[pos % 2] = folded
                    folded, pos = joined(*pair), pos // 2
            root = top[-1][0]
            leaf, subroot = trees[number][0][at], trees[number][-1][0]
            found.append((row.doc_id, leaf, subroot, root, joined(*proof), folded, folded == root))
    return sorted(found, key=str)


def got(docs):
    return sorted(map(tuple, merkle.op13_merkle_manifest(docs).collect()), key=str)


def test_whole_table_equals_the_plain_trees_and_the_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = got(docs)
    assert rows == plain(docs.collect())
    assert 0 < sum(not row[-1] for row in rows) < len(rows) / 4
    assert oracle_difference(spark, "/root/testdata/sf0.001", "op13_merkle_manifest") is None


@pytest.mark.parametrize("size", [1, 2, 3, 129, 1023, 1024, 1025, 4097])
def test_tree_sizes_about_the_blocks(spark, size):
    docs = spark.range(size).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text "), "id").alias("text"),
        F.lit("en").alias("lang"),
        F.lit("a").alias("source"),
        F.lit(5).cast("long").alias("n_chars"),
    )
    assert got(docs) == plain(docs.collect())


def test_nulls_empty_and_long_texts_repeated_rows_and_clashing_columns(spark):
    rows = [
        (None, None, None, None, None),
        (None, "", "en", "a", 0),
        (3, "x" * 200_000, "en", "a", None),
        (7, "é", None, "ü", 2**63 - 1),
        *[(5, "same", "en", "a", 4)] * 3,
        (5, "other", "en", "a", 5),
        *[(i, f"t{i}", f"l{i}", "s", i) for i in range(90)],
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.selectExpr("*", "1 AS row", "2 AS tree", "'x' AS leaf", "4 AS pos", "5 AS key", "6 AS kind")
    assert got(docs) == plain(docs.collect()) == got(more)


def test_empty_table(spark):
    found = merkle.op13_merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_change_shows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leaf = merkle.digest(merkle.framed([F.col("doc_id"), F.col("text")]))
    changed = merkle.digest(merkle.framed([F.col("doc_id"), F.concat("text", F.lit(" "))]))
    start = F.when(F.col("doc_id") % 50 == 3, changed)
    rows = merkle.proofs(merkle.build(docs, leaf, start, group="source")).collect()
    assert len(rows) == docs.count()
    assert {r.key for r in rows if not r.verified} == {r.key for r in rows if r.key % 50 == 3}
