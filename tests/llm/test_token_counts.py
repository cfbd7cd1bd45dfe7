"""Counts of a separator scan against the tokenizer and against plain splitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import token_counts, tokens


def slow_counts(rows):
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return sorted(((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, token_counts.op7_token_counts(docs).collect()), key=str) == slow_counts(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (2, ""), (None, "a <|endoftext|> b"), (None, None), (3, " \n "), (4, "long words, " * 50_000), (5, "é日本"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"file": F.lit("x"), "ordinal": F.lit(1)})
    assert sorted(map(tuple, token_counts.op7_token_counts(docs).collect()), key=str) == slow_counts(rows)
    assert token_counts.op7_token_counts(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block_bytes):
    """Documents over many blocks, empty ones at edges, an unfinished last one."""
    rng = np.random.default_rng(block_bytes)
    files, expected = [], []
    for name, lengths, rest in (("a", [0, 0, 5, 1, 90, 0, 3], 0), ("b", rng.integers(0, 9, 40).tolist(), 4), ("c", [], 7), ("d", [2], 0)):
        ids = [x for n in lengths for x in [*rng.integers(0, 9, n).tolist(), 9]] + [1] * rest
        path = tmp_path / name
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((str(path), 2 * len(ids)))
        expected += [(str(path), i, n) for i, n in enumerate(lengths + [rest] * (rest > 0))]
    files.append((str(tmp_path / "none"), 0))
    table = spark.createDataFrame(files, "file string, size long")
    found = token_counts.count_tokens(table, end=9, block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_documents_are_not_broadcast(spark):
    """Stored tables are far smaller than their rows in memory, which a broadcast would hold on the driver."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    counted = token_counts.op7_token_counts(docs)
    assert sorted(map(tuple, counted.collect()), key=str) == slow_counts([(i, "a few words") for i in range(100)])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_hold_whole_ids(spark):
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([], "file string, size long"), block_bytes=3)


def test_a_vocabulary_beyond_two_bytes_is_refused(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "ID", "<u1")
    with pytest.raises(Exception, match="more ids"):
        token_counts.write_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
