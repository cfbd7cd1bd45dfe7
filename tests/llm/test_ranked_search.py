"""Ranked search beside scores of every document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import ranked_search as ranked
from tests.llm.oracle import oracle_difference

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, best=50):
    counted = [(row.doc_id, Counter(terms(row.text))) for row in docs]
    counted = [(doc_id, tf) for doc_id, tf in counted if tf]
    n_docs, n_terms = len(counted), sum(tf.total() for _, tf in counted)
    df = Counter(term for _, tf in counted for term in tf)
    asked = defaultdict(set)
    for item in items:
        asked[item.item_id] |= set(terms(item.text))
    found = []
    for item_id, own in asked.items():
        scores = []
        for doc_id, tf in counted:
            m = 50 + (50 * tf.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in own
                if t in tf
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (*s[:2], s[2] or 0))[:best], 1):
            found.append((item_id, rank, doc_id, -score))
    return sorted(found, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_tables_equal_the_scores_of_every_document_and_the_sql(spark):
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    expected = plain(docs.collect(), items.collect())
    assert rows_of(ranked.op12_ranked_search(docs, items)) == expected
    assert len(expected) > 20 * items.count()
    assert oracle_difference(spark, SF, "op12_ranked_search") is None


@pytest.mark.parametrize("best, share, size, block", [(3, 32, 40, 1 << 20), (50, 1, 7, 2000), (5, 10**9, 13, 700)])
def test_slices_blocks_and_kinds_of_lists_change_nothing(spark, best, share, size, block):
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    found = ranked.search(docs.repartition(3), items, best, share, size, block)
    assert rows_of(found) == plain(docs.collect(), items.collect(), best)


def test_lists_without_essential_documents_are_only_looked_up(monkeypatch):
    """Of 10,000 documents with a common term only those near the threshold are kept."""
    n = 10_000
    query = ranked.Query(
        [np.array([0, 1])], np.array([5000, 10]), np.array([False, False]), n, 10 * n
    )
    own = [[0, 1] if i % 100 == 0 else [1] for i in range(n)]
    table = pa.table(
        {
            "doc_id": pa.array(range(n), pa.int64()),
            "place": pa.array(range(n), pa.int64()),
            "n": pa.array([10] * n, pa.int64()),
            "terms": pa.array(own, pa.list_(pa.int32())),
            "counts": pa.array([[1] * len(x) for x in own], pa.list_(pa.int32())),
        }
    )
    best, seen = ranked._Best(50), []
    monkeypatch.setattr(best, "add", lambda scores, rows: seen.append(len(scores)))
    ranked._search_item(ranked._Lists(table, query), query, query.items[0], best)
    assert seen == [100]


def test_nulls_ties_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [
        (5, "alpha beta"),
        (4, "Alpha, BETA!"),
        (4, "alpha beta"),
        (None, "alpha beta"),
        (7, None),
        (8, ""),
        (9, "  ...  "),
        (10, "état É été ÉTÉ alpha"),
        (11, "word " * 60_000 + "gamma"),
        (12, "x1 1x alpha-beta_gamma"),
    ]
    asked = [
        (1, "alpha alpha beta"),
        (1, "GAMMA"),
        (2, "été"),
        (None, "x1"),
        (3, None),
        (4, ""),
        (6, "absent"),
        (7, "word"),
    ]
    docs, items = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(asked, ITEMS)
    expected = plain(docs.collect(), items.collect())
    assert rows_of(ranked.op12_ranked_search(docs, items)) == expected
    more = docs.selectExpr("*", "1 AS place", "2 AS n", "3 AS terms", "4 AS score", "5 AS item_id")
    assert rows_of(ranked.op12_ranked_search(more, items.selectExpr("*", "1 AS doc_id", "2 AS size"))) == expected


def test_ties_rank_by_id_over_all_partitions(spark):
    text = F.when(F.col("id") < 500, "one two").otherwise("three")
    docs = spark.range(1000).select((499 - F.col("id")).alias("doc_id"), text.alias("text")).repartition(7)
    items = spark.createDataFrame([(1, "one")], ITEMS)
    found = ranked.search(docs, items, slice_docs=20).collect()
    assert [(r.rank, r.doc_id) for r in sorted(found, key=lambda r: r.rank)] == [(i + 1, i) for i in range(50)]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    found = ranked.op12_ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
