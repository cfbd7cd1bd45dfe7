"""The mix against its SQL, plain arithmetic and its own copies."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import mixing, oracles
from tests.compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.01"


def plain_targets(sizes):
    """Reshares what is above the limit until nothing is; sizes in the order of the weights."""
    total, weights = sum(sizes), [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    held = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(held.values())
        share = {i: rest * weights[i] / sum(weights[k] for k in free) for i in free}
        above = [i for i in free if share[i] > 3 * sizes[i]]
        if not above:
            return [held.get(i, share.get(i)) for i in range(len(sizes))]
        held |= {i: 3 * sizes[i] for i in above}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, mark int").withColumn("_time", F.lit(1))


def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, expected = oracle_rows(SF, oracles.MIXING)
    assert spark_rows(mixing.op6_mixing(docs)) == expected


@pytest.mark.parametrize(
    "words", [{"a": [3, 5], "b": [400], "c": [10] * 30, None: [7, 0]}, {"a": [0]}, {"é": [5], "z": [900], "A": [1]}]
)
def test_targets_and_copies(spark, words):
    rows, i = [], 0
    for source, sizes in words.items():
        for n in sizes:
            i += 1
            rows.append((i, " \t".join(f"w{i}_{k}" for k in range(n)), source, "x", 1))
    out = mixing.op6_mixing(docs_of(spark, rows)).collect()
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    targets = dict(zip(names, plain_targets([sum(words[s]) for s in names]), strict=True))
    source_of = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(names, 0)
    for r in out:
        source = source_of[r.doc_id]
        assert r.target == pytest.approx(targets[source]) and r.source_size == sum(words[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for source in names:
        assert abs(taken[source] - targets[source]) <= 0.5 + 1e-9
    # The mix itself holds the same words, in whole copies but for the last.
    texts = {r[0]: r[1] for r in rows}
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size", "mark", "_time"]
    held = {}
    for r in mixed.collect():
        assert texts[r.doc_id].startswith(r.text)
        held[r.doc_id] = held.get(r.doc_id, 0) + len(r.text.split())
    assert held == {r.doc_id: r.taken for r in out if r.taken}


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "", "a", None, 1), (1, "x y", "a", "q", 2), (1, "x y", "a", "q", 2),
        (2, "w " * 100_000, "b", "q", 3), (3, "\x85 \xa0", "b", "q", 4), (4, " \n\x0b", None, "q", 5),
    ]
    docs = docs_of(spark, rows)
    first = sorted(map(tuple, mixing.op6_mixing(docs).collect()), key=str)
    assert len(first) == len(rows) and first == sorted(map(tuple, mixing.op6_mixing(docs.repartition(3)).collect()), key=str)
    assert mixing.op6_mixing(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs).count() > 0


def test_sorted_by_finish_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    times = [r.finish for r in mixing.op6_mixing(docs).collect()]
    assert times == sorted(times)


def test_rows_that_differ_in_a_map_stay_apart(spark):
    rows = [(1, "a b c", "s", {"k": str(i)}, [{"x": i}]) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, meta map<string,string>, more array<map<string,int>>")
    mixed = mixing.mix(docs)
    assert sorted((r.meta["k"], r.more[0]["x"]) for r in mixed.collect()) == [("1", 1), ("2", 2)]
    assert mixed.columns == docs.columns
