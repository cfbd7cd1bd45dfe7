"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerleaf.llm import simhash

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(fps))]


def expected(rows):
    fps = [slow_fingerprint(text) for _, text in rows]
    parts = slow_components([doc for doc, _ in rows], fps)
    return sorted(
        ((doc, f"{fp:016x}", part) for (doc, _), fp, part in zip(rows, fps, parts, strict=True)),
        key=str,
    )


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op2_simhash(docs).collect()), key=str) == expected(rows)


def test_odd_rows(spark):
    long_text = "ab " * 200_000
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (None, "One two"), (5, "one TWO"), (5, "one TWO"), (7, "x"),
        (8, "é É\x0bö\x0c1 2 3"), (9, long_text), (10, long_text + "c"), (None, "alone here"), (11, "\x85 \xa0 u"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"fp": F.lit("x"), "node": F.lit(1), "component": F.lit(2), "_row": F.lit(3)}
    )
    assert sorted(map(tuple, simhash.op2_simhash(docs).collect()), key=str) == expected(rows)
    assert simhash.op2_simhash(docs.limit(0)).collect() == []


def test_keep_first(spark):
    rows = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(7))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert simhash.keep_first(docs.limit(0)).collect() == []


def test_masks_cover_every_triple():
    rng = np.random.default_rng(1)
    for bits in [list(range(64)), [3, 9, 11, 12, 40, 41, 50, 63]]:
        masks = simhash.covering(bits)
        for _ in range(2_000):
            away = sum(1 << int(b) for b in rng.choice(bits, 3, replace=False))
            assert any(not mask & away for mask in masks)


@pytest.mark.parametrize("direct", [2, 50])
def test_large_buckets_lose_no_link(spark, monkeypatch, direct):
    """Chains and clusters of fingerprints through the second division."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**64, 20, np.uint64)}
    for start in list(fps)[:4]:
        for _ in range(150):
            for bit in rng.integers(0, 64, 3):
                start ^= 1 << int(bit)
            fps.add(start)
    center = 0x0123456789ABCDEF
    fps |= {center ^ int(rng.integers(0, 2**12)) for _ in range(300)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == slow_components(range(len(fps)), fps)
