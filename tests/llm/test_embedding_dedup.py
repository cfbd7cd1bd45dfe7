"""Links and components of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import embedding_dedup
from ledgerleaf.llm.tables import stored


def good(vector, label):
    return label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def expected(rows):
    """From (vec_id, vector, label)."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    usable = [i for i, (_, v, label) in enumerate(rows) if good(v, label)]
    groups = {}
    for i in usable:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for members in groups.values():
        units = np.array([rows[i][1] for i in members], float)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        near[np.ix_(members, members)] = units @ units.T >= 0.93
    np.fill_diagonal(near, False)
    part = [None] * n
    for i in range(n):
        if part[i] is None:
            members, front = {i}, [i]
            while front:
                for k in np.flatnonzero(near[front.pop()]):
                    if int(k) not in members:
                        members.add(int(k))
                        front.append(int(k))
            ids = [rows[k][0] for k in members if rows[k][0] is not None]
            for k in members:
                part[k] = min(ids, default=-1)
    part = [None if p == -1 else p for p in part]
    return sorted(((r[0], int(near[i].sum()), part[i], r[0] == part[i]) for i, r in enumerate(rows)), key=str)


def run(vectors):
    return sorted(map(tuple, embedding_dedup.op8_embedding_dedup(vectors).collect()), key=str)


def test_whole_table(spark):
    """All given vectors, every third with noisy copies of several strengths."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    rng = np.random.default_rng(2)
    for k, (_, vector, label) in enumerate(rows[::3]):
        for strength in (0.02, 0.04, 0.045, 0.06):
            noisy = np.array(vector) + rng.normal(size=len(vector)) * strength
            rows.append((10_000 + 10 * k + int(strength * 100), noisy.tolist(), label))
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    actual, wanted = run(table), expected(rows)
    assert all(a[1] <= w[1] for a, w in zip(actual, wanted))
    recall = sum(a[1] for a in actual) / sum(w[1] for w in wanted)
    assert recall >= 0.97
    same = sum(a == w for a, w in zip(actual, wanted))
    assert same >= 0.95 * len(wanted)


@pytest.mark.parametrize("block", [8, 512])
def test_large_groups_and_chains(spark, monkeypatch, block):
    """A cloud of near copies, exact copies, and a chain whose ends are far apart."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    rows = [center + rng.normal(size=16) * 0.05 for _ in range(120)]
    rows += [rng.normal(size=16) for _ in range(80)]
    rows += [rows[150]] * 40
    turn = 0.3
    rows += [np.array([np.cos(turn * k), np.sin(turn * k)] + [0.0] * 14) for k in range(15)]
    order = rng.permutation(len(rows))
    data = [(int(i), [float(x) for x in rows[k]], int(k % 2 if k < 200 else 0)) for i, k in enumerate(order)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    assert run(vectors) == expected(data)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [1.0, inf], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (None, [1.0, 0.1], 1),
        (10, [1.0, 0.0], 2), (11, [1.0], 1), (12, [3.0], 1), (13, [1e-200, 1e-200], 3), (14, [1e200, 1e200], 3),
        (None, [5.0, 5.0, 1.0], 4), (None, [5.0, 5.0, 1.0], 4), (15, [1.0, 0.0, 0.0], 1), (16, [-0.0, 1.0], 5), (17, [0.0, 1.0], 5),
    ]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    vectors = vectors.withColumns({"node": F.lit("x"), "group": F.lit(1), "cell": F.lit(2)})
    small = [(i, v if v is None or not good(v, 1) else [x / max(map(abs, v)) for x in v], lab) for i, v, lab in data]
    assert run(vectors) == expected(small)
    assert run(vectors.limit(0)) == []
    assert run(vectors.filter("vec_id < 4")) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_traversal_is_the_order_of_all_cells():
    rng = np.random.default_rng(1)
    index = embedding_dedup.Index(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)), 20)
    units = rng.normal(size=(30, 8))
    a, b = index.distances(units)
    sums = (a[:, :, None] + b[:, None, :]).reshape(30, -1)
    assert (index.nearest(units) == sums.argsort(axis=1, kind="stable")[:, :20]).all()
    assert (index.cells(units) == index.nearest(units)[:, 0]).all()


def test_visits_without_links(spark):
    """Where no vector has a link, the visits still find neighbours at the limit and nearer."""
    rng = np.random.default_rng(5)
    units = rng.normal(size=(8_000, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rows = [(k, k, k, 0, v.tolist()) for k, v in enumerate(units)]
    nodes = spark.createDataFrame(rows, "hash1 long, hash2 long, node long, group long, embedding array<double>").repartition(4)
    nodes = stored(nodes, "test-nodes")
    index = embedding_dedup.fit(nodes)
    index.visits = embedding_dedup.visits_for(nodes, index)
    found = 0
    for k in range(400):
        away = rng.normal(size=64)
        away -= away @ units[k] * units[k]
        cosine = rng.uniform(0.93, 1)
        near = cosine * units[k] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
        a, b = index.nearest(units[k : k + 1])[0], index.nearest(near[None])[0]
        found += bool(np.isin(index.cells(near[None]), a)[0] or np.isin(index.cells(units[k : k + 1]), b)[0])
    assert found >= 0.95 * 400
