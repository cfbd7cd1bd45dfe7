"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, span a grid of cells; a vector lies in the cell
of its nearest centroids. A vector's search visits the cells in the order of the sum of both
halves' distances (the order of a multi-sequence traversal) and ends after as many cells as
``RECALL`` of a sample of queries need to find all links that brute force finds for them. Where fewer
than ``LEAST_LINKED`` of the sample have links, the cells also have to reach ``PLANTED_RECALL`` of
neighbours planted at the cosine limit beside each query. What shares a cell is
verified by exact cosines in blocks; a link that either end finds counts for both.

The codebooks are fitted on at most ``FIT_ROWS`` vectors and the trial takes at most
``TRIAL_ROWS`` queries, both the smallest by hash; every vector is indexed, the trial's queries
meet all vectors, and every vector searches. Vectors that are alike are one row until the end.
A cell with many vectors or visitors is dealt out in blocks of ``BLOCK``, and tasks hand over
counts and spanning links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.components import components
from ledgerleaf.llm.tables import stored

COSINE = 0.93
RECALL = 0.999
FIT_ROWS = 20_000
TRIAL_ROWS = 1_024
# With fewer linked queries in the trial, planted neighbours set the visits too.
LEAST_LINKED = 200
PLANTED_RECALL = 0.97
# Neighbours planted beside each query.
PLANTED = 4
# Vectors per cell that the codebooks' size aims at.
PER_CELL = 8
MOST_CENTROIDS = 512
BLOCK = 512
_SEED = 7


@dataclass
class Index:
    """Codebooks of the two halves, and how many cells a search visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int = 1

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return _distances(units[:, :cut], self.left), _distances(units[:, cut:], self.right)

    def cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.distances(units)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def nearest(self, units: np.ndarray) -> np.ndarray:
        """The cells that each search visits: one row for each vector, nearest first.

        The n-th nearest cell pairs the i-th and j-th centroids of the halves with i * j <= n, so
        no other pairs are looked at.
        """
        a, b = self.distances(units)
        n = min(self.visits, a.shape[1] * b.shape[1])
        order_a, order_b = a.argsort(axis=1, kind="stable")[:, :n], b.argsort(axis=1, kind="stable")[:, :n]
        i, j = np.nonzero(
            np.outer(np.arange(1, order_a.shape[1] + 1), np.arange(1, order_b.shape[1] + 1)) <= n
        )
        sums = np.take_along_axis(a, order_a, 1)[:, i] + np.take_along_axis(b, order_b, 1)[:, j]
        first = sums.argsort(axis=1, kind="stable")[:, :n]
        rows = np.arange(len(units))[:, None]
        return order_a[rows, i[first]] * len(self.right) + order_b[rows, j[first]]

    def rank(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a search visits up to the given ones."""
        a, b = self.distances(unit[None])
        sums = (a[0][:, None] + b[0][None, :]).ravel()
        return np.array([np.count_nonzero(sums <= x) for x in sums[cells]]) if len(cells) < 8 else np.searchsorted(np.sort(sums), sums[cells], "right")


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids**2).sum(axis=1)[None] - 2 * rows @ centroids.T + (rows**2).sum(axis=1)[:, None]


def _centroids(rows: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    found = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(10):
        nearest = _distances(rows, found).argmin(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=k)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision, shorter ones filled up with zeros."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    rows = np.zeros((len(column), dim))
    rows[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    # Scaled first, so that squares neither vanish nor overflow.
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


# Can a row have links: a label, and a vector of finite numbers other than all zeros.
_USABLE = (
    "coalesce(label IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)"
    " AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0), false)"
)


def fit(nodes: DataFrame) -> Index | None:
    """Codebooks from the smallest ``FIT_ROWS`` rows by hash; None if there is no row."""
    n, dim = nodes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    sample = nodes.orderBy("hash1", "hash2").limit(FIT_ROWS).select("embedding").toArrow()
    units = _units(sample.column(0).combine_chunks(), max(dim, 2))
    k = min(len(units), MOST_CENTROIDS, max(2, math.isqrt(n // PER_CELL)))
    cut = units.shape[1] // 2
    return Index(_centroids(units[:, :cut], k), _centroids(units[:, cut:], k))


def _trial_maker(index: Index, queries: pa.Table) -> Callable:
    units = _units(queries.column("embedding").combine_chunks(), index.dim)
    groups, own = np.asarray(queries.column("group")), np.asarray(queries.column("node"))

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deepest = np.zeros(len(units), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _units(batch.column("embedding"), index.dim)
            cells = index.cells(rows)
            group, node = np.asarray(batch.column("group")), np.asarray(batch.column("node"))
            near = (units @ rows.T >= COSINE) & (groups[:, None] == group) & (own[:, None] != node)
            for q in np.flatnonzero(near.any(axis=1)):
                deepest[q] = max(deepest[q], index.rank(units[q], cells[near[q]]).max())
        at = np.flatnonzero(deepest)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(deepest[at])], names=["query", "visits"])

    return trial


def _planted_ranks(index: Index, units: np.ndarray) -> np.ndarray:
    """Sorted numbers of cells to visit until one end finds the other, for neighbours at the limit."""
    rng = np.random.default_rng(_SEED)
    ranks = []
    for unit in units:
        away = rng.normal(size=(PLANTED, len(unit)))
        away -= (away @ unit)[:, None] * unit
        away /= np.sqrt((away**2).sum(axis=1, keepdims=True))
        planted = COSINE * unit + math.sqrt(1 - COSINE**2) * away
        own, cells = index.cells(unit[None]), index.cells(planted)
        there = index.rank(unit, cells)
        ranks.extend(min(n, index.rank(v, own)[0]) for n, v in zip(there, planted, strict=True))
    return np.sort(ranks)


def visits_for(nodes: DataFrame, index: Index) -> int:
    """Cells to visit so that ``RECALL`` of a sample of queries find all their links.

    The links of the sample are those of a comparison with all vectors; if they are few, planted
    ones count beside them. A third more cells than the sample needs are visited, and two at least.
    """
    queries = nodes.orderBy("hash2", "hash1").limit(TRIAL_ROWS).select("node", "group", "embedding").toArrow()
    tried = nodes.select("node", "group", "embedding").mapInArrow(
        _trial_maker(index, queries), "query long, visits long"
    )
    # At most one row for each query of the trial.
    deepest = sorted(r.visits for r in tried.groupBy("query").agg(F.max("visits").alias("visits")).collect())
    needed = deepest[math.ceil(RECALL * len(deepest)) - 1] if deepest else 1
    if len(deepest) < LEAST_LINKED:
        ranks = _planted_ranks(index, _units(queries.column("embedding").combine_chunks(), index.dim))
        needed = max(needed, int(ranks[math.ceil(PLANTED_RECALL * len(ranks)) - 1]))
    return max(2, math.ceil(needed * 4 / 3))


def _indexer(index: Index) -> Callable:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(at, 4 * BLOCK)
                units = _units(part.column("embedding"), index.dim)
                cells, visited = index.cells(units), index.nearest(units)
                offsets = np.arange(0, visited.size + 1, visited.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(visited.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cells.astype(np.int32)), lists], names=[*part.schema.names, "cell", "visited"]
                )

    return entries


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and a column that connect all rows and columns that ``near`` connects."""
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = near.any(axis=0)
    open_rows = near.any(axis=1)
    while left.any():
        front = np.array([int(left.argmax())])
        left[front] = False
        while len(front):
            hit = near[:, front] & open_rows[:, None]
            new = np.flatnonzero(hit.any(axis=1))
            rows.append(new)
            columns.append(front[hit[new].argmax(axis=1)] if len(new) else new)
            open_rows[new] = False
            reach = near[new] & left[None, :]
            front = np.flatnonzero(reach.any(axis=0)) if len(new) else new
            if len(front):
                rows.append(new[reach[:, front].argmax(axis=0)])
                columns.append(front)
            left[front] = False
    return np.concatenate(rows), np.concatenate(columns)


_FOUND = "node long, other long, n long"


def _verifier(index: Index) -> Callable:
    def verify(table: pa.Table) -> pa.Table:
        """One block of a cell against one block of its visitors.

        Gives rows with a node's count of links, and rows with a link to another node.
        """
        visitor = np.asarray(table.column("visitor"))
        units = _units(table.column("embedding").combine_chunks(), index.dim)
        nodes, copies = np.asarray(table.column("node")), np.asarray(table.column("copies"))
        cells = np.asarray(table.column("own_cell"))
        q, b = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        near = (units[q] @ units[b].T >= COSINE) & (nodes[q][:, None] != nodes[b])
        if not near.any():
            return pa.table({x: pa.array([], pa.int64()) for x in ("node", "other", "n")})
        counts = near @ copies[b]
        # Links that the vector of the cell does not find itself count for it here.
        hit = np.flatnonzero(near.any(axis=0))
        visited = np.zeros((len(hit), len(q)), bool)
        for k, row in enumerate(index.nearest(units[b[hit]])):
            visited[k] = np.isin(cells[q], row)
        back = (near[:, hit].T & ~visited) @ copies[q]
        x, y = _spanning(near)
        with_count, with_back = counts > 0, back > 0
        none = pa.nulls(int(with_count.sum() + with_back.sum()), pa.int64())
        return pa.table(
            {
                "node": np.concatenate([nodes[q][with_count], nodes[b[hit]][with_back], nodes[q[x]]]),
                "other": pa.chunked_array([none, pa.array(nodes[b[y]])]),
                "n": np.concatenate([counts[with_count], back[with_back], np.zeros(len(x), np.int64)]),
            }
        )

    return verify


def links(nodes: DataFrame, index: Index) -> DataFrame:
    """Rows node, other, n: counts of links (other is null) and links that span the components.

    ``nodes``: node, group, copies, embedding.
    """
    indexed = stored(
        nodes.select("node", "group", "copies", "embedding").mapInArrow(
            _indexer(index),
            "node long, group long, copies long, embedding array<double>, cell int, visited array<int>",
        ),
        "indexed",
    )
    plain = ["node", "group", "copies", "embedding", F.col("cell").alias("own_cell")]
    visits = indexed.select("node", "group", F.explode("visited").alias("cell"))
    held = indexed.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("held"))
    came = visits.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("came"))
    # A cell whose only visitor is its only vector has nothing to compare.
    sizes = stored(
        held.join(came, ["group", "cell"]).filter("held > 1 or came > 1").select(
            "group", "cell", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("came") / BLOCK).cast("int").alias("turns")
        ),
        "cells",
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    vectors = indexed.select(*plain, "cell").join(sizes, ["group", "cell"])
    visitors = indexed.select(*plain, F.explode("visited").alias("cell")).join(sizes, ["group", "cell"])
    key = ["group", "cell", "block", "turn"]
    rest = ["node", "copies", "embedding", "own_cell", "visitor"]
    both = vectors.select("*", some("blocks").alias("block"), every("turns").alias("turn"), F.lit(False).alias("visitor")).select(
        *key, *rest
    ).unionByName(
        visitors.select("*", some("turns").alias("turn"), every("blocks").alias("block"), F.lit(True).alias("visitor")).select(*key, *rest)
    )
    return both.groupBy(*key).applyInArrow(_verifier(index), _FOUND)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows are linked when their labels are equal and the cosine of their vectors is at least
    ``COSINE``; vectors of different sizes are not compared. Rows that cannot have links stand
    alone. Null ids name no component unless there is no other. Other columns are not used.
    """
    slim = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    hashes = {"hash1": F.xxhash64("label", "embedding"), "hash2": F.xxhash64("embedding", "label", F.lit(_SEED))}
    alike = slim.filter(_USABLE).withColumns(hashes).withColumn("group", F.xxhash64("label", F.size("embedding")))
    nodes = stored(
        alike.groupBy("hash1", "hash2").agg(
            F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("group").alias("group"),
            F.first("embedding").alias("embedding"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    named = nodes.select("hash1", "hash2", "node", "copies", "first_id")
    index = fit(nodes)
    if index is None:
        alone = F.col("vec_id").alias("component_id")
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"))
    index.visits = visits_for(nodes, index)
    found = stored(links(nodes, index), "found-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    parts = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = named.join(counts, "node", "left").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    grouped = stored(joined, "grouped")
    least = stored(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "least-ids")
    result = grouped.join(least, "component").select(
        "hash1", "hash2", (F.coalesce("others", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    own = slim.filter(_USABLE).select("vec_id", hashes["hash1"].alias("hash1"), hashes["hash2"].alias("hash2"))
    linked = own.join(result, ["hash1", "hash2"]).select("vec_id", "n_links", "component_id")
    lone = slim.filter(f"NOT {_USABLE}")
    rows = linked.unionByName(
        lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    return near_duplicates(vectors)
