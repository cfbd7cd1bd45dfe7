"""Repeated stretches against every window of every text."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import suffix_dedup


def slow_stretches(rows, size=50):
    """From distinct (doc_id, text) with their number of rows."""
    texts = {}
    for doc, text in rows:
        key = (doc, text)
        texts[key] = texts.get(key, 0) + 1
    seen = {}
    split = {k: (k[1] or "").encode().split() for k in texts}
    for key, words in split.items():
        for i in range(len(words) - size + 1):
            gram = tuple(words[i : i + size])
            seen[gram] = seen.get(gram, 0) + texts[key]
    found = []
    for (doc, _), words in split.items():
        covered = [False] * len(words)
        for i in range(len(words) - size + 1):
            if seen[tuple(words[i : i + size])] > 1:
                covered[i : i + size] = [True] * size
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and covered[j]:
                j += 1
            if j > i:
                found.append((doc, i, j, j - i))
            i = max(j, i + 1)
    return sorted(found, key=str)


def run(docs, **limits):
    return sorted(map(tuple, suffix_dedup.repeated_passages(docs, **limits).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == slow_stretches(rows) != []


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_in_part(spark, seed):
    """Short passages over few words: contexts that agree more or less far on both sides."""
    rng = random.Random(seed)
    base = [str(rng.randrange(40)) for _ in range(300)]
    rows = []
    for doc in range(120):
        at = rng.randrange(250)
        piece = base[at : at + rng.randrange(5, 40)]
        noise = [str(rng.randrange(1000)) for _ in range(rng.randrange(30))]
        rows.append((doc, " ".join(noise + piece + [str(rng.randrange(50)) for _ in range(rng.randrange(9))] + piece[::-1])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(docs, min_words=12, gram=3, window=7) == slow_stretches(rows, 12) != []


def test_odd_rows(spark):
    common = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, common), (4, "other " + common.replace(" ", "\n\t")), (5, common.upper()),
        (6, "short"), (7, "same " * 70), (8, " ".join(f"x{i}" for i in range(200_000))), (None, "a b " + common + " c"),
        (9, " ".join(f"r{i}" for i in range(55))), (9, " ".join(f"r{i}" for i in range(55))), (10, " ".join(f"w{i}" for i in range(49))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("x"), "digest": F.lit(1), "part": F.lit(2)})
    assert run(docs) == slow_stretches(rows)
    assert run(docs.limit(0)) == []
    assert run(docs.filter("doc_id = 6")) == []


def test_common_passage_over_many_partitions(spark):
    """Equal suffixes that fill whole partitions of the sort."""
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage if i % 3 else f"own{i} " + passage + f" end{i}") for i in range(300)] + [(1000, "alone " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(docs) == slow_stretches(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_window_must_fit(spark):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string"), min_words=20)
