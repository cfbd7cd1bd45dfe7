"""Near-duplicates by 64-bit SimHash fingerprints and covering hashing.

A pair within ``RADIUS`` differing bits has to meet in some table. Bit ``i`` of a
fingerprint gets a nonzero vector of ``RADIUS + 1`` bits; table ``v`` looks at the bits
whose vector has an odd number of ones in common with ``v``. The vectors of at most
``RADIUS`` differing bits span less than the whole space, so some ``v`` is orthogonal to
them all, and its table sees no difference. There are 15 tables of 32 to 36 of the 64 bits.

Equal fingerprints are one node before any table is made. A table's bucket with more than
``DIRECT`` fingerprints is divided by the same covering of the bits that its own table does
not see, which leaves at most ``2**17`` different fingerprints in a bucket, however many
documents there are. Buckets are compared in blocks of arrays and give a spanning forest
of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.components import components
from ledgerleaf.llm.tables import row_marks, row_of, stored
from ledgerleaf.llm.words import Words, plain_texts, slices

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
# Fingerprints of a bucket that are compared without a second division.
DIRECT = 1_000
_BLOCK = 1_024
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """SimHash of lower-case words: a bit is set if over half of the shingles' hashes set it."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        part = hashes[at : at + _SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over_half = np.packbits(2 * set_bits > n, bitorder="little")
    return int(over_half.view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprint of each whole text as a signed long; 0 where there is no word."""
    for batch in texts:
        found = []
        for text in plain_texts(batch).cast(pa.large_binary()):
            found.append(fingerprint(text.as_py().lower().split()))
        yield pa.array(np.array(found, np.uint64).astype(np.int64), pa.int64())


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bits: any ``radius`` of the bits are outside some mask."""
    size = 1 << (radius + 1)
    vectors = {bit: 1 + k % (size - 1) for k, bit in enumerate(bits)}
    return [
        sum(1 << bit for bit, v in vectors.items() if (v & table).bit_count() % 2)
        for table in range(1, size)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = covering(list(range(BITS)))
INNER = [covering([b for b in range(BITS) if not mask >> b & 1]) for mask in MASKS]


def _tables(fp: Column, masks: list[Column]) -> Column:
    """An array of a struct per table: its number and the bits that it sees."""
    return F.array(
        *[F.struct(F.lit(t).alias("table"), fp.bitwiseAND(m).alias("key")) for t, m in enumerate(masks)]
    )


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of values within ``radius`` bits of each other.

    A search from value to value: each step compares one block of reached values with the
    values not reached yet, so that every value is the start of one comparison.
    """
    left = np.arange(len(values))
    sources, targets = [], []
    reached: list[int] = []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
            continue
        front, reached = np.array(reached[:_BLOCK]), reached[_BLOCK:]
        hit = np.full(len(left), -1)
        for at in range(0, len(left), _BLOCK):
            part = values[left[at : at + _BLOCK]]
            near = np.bitwise_count(part[:, None] ^ values[front][None, :]) <= radius
            found = near.any(axis=1)
            hit[at : at + _BLOCK][found] = near.argmax(axis=1)[found]
        new = hit >= 0
        sources.append(front[hit[new]])
        targets.append(left[new])
        reached += left[new].tolist()
        left = left[~new]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *sources]), np.concatenate([none, *targets])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b"]
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        values, nodes = batch.column("fps"), batch.column("nodes")
        for k in range(batch.num_rows):
            fps = np.array(values[k].values).view(np.uint64)
            ids = np.array(nodes[k].values)
            x, y = forest(fps)
            a.append(ids[x])
            b.append(ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names)


def links(nodes: DataFrame) -> DataFrame:
    """Links a, b that connect all nodes whose fingerprints are within the radius.

    ``nodes`` has one row per different fingerprint: fp and node, an id.
    """
    masks = [F.lit(_signed(m)) for m in MASKS]
    rows = nodes.select("fp", "node", F.explode(_tables(F.col("fp"), masks)).alias("t")).select(
        "fp", "node", "t.table", "t.key"
    )
    sizes = stored(rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = rows.join(sizes, ["table", "key"])
    # One list of structs keeps fingerprints and nodes in step.
    members = F.collect_list(F.struct("fp", "node")).alias("members")
    split = [F.col("members.fp").alias("fps"), F.col("members.node").alias("nodes")]
    direct = shared.filter(F.col("n") <= DIRECT).groupBy("table", "key").agg(members).select(*split)
    inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in INNER])
    chosen = F.element_at(inner, F.col("table") + 1)
    second = F.transform(
        F.sequence(F.lit(1), F.lit(len(MASKS))),
        lambda i: F.struct(i.alias("table2"), F.col("fp").bitwiseAND(F.element_at(chosen, i)).alias("key2")),
    )
    divided = (
        shared.filter(F.col("n") > DIRECT)
        .select("fp", "node", "table", "key", F.explode(second).alias("s"))
        .select("fp", "node", "table", "key", "s.table2", "s.key2")
        .groupBy("table", "key", "table2", "key2")
        .agg(members)
        .filter(F.size("members") > 1)
        .select(*split)
    )
    return direct.unionByName(divided).mapInArrow(_bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (long) and component_id.

    Documents are linked when their fingerprints differ in at most ``RADIUS`` bits; the
    component is named by its smallest doc_id, null only where no row of it has one.
    Null and empty texts have fingerprint 0, linked like any other.
    """
    hashed = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    # The fingerprint itself is the node, so that null ids cannot get lost.
    nodes = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = stored(
        named.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest"
    )
    ids = named.join(smallest, "component").select("fp", "component_id")
    return hashed.join(ids, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint as 16 hex digits, component_id."""
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_duplicates(docs).select("doc_id", shown, "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    It is a row of the smallest doc_id, nulls last; among rows of that id that of the smallest
    hash of all columns, and of rows that are alike one. Texts are shuffled once, after rows
    that are alike have met on the map side.
    """
    marked = docs.select(*row_marks(docs), row_of(docs).alias("row"))
    slim = stored(
        docs.select(F.col("doc_id").alias("id"), *row_marks(docs), fingerprints(F.col("text")).alias("fp")), "fingerprints"
    )
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark1", "mark2").alias("best")
    nodes = stored(slim.select("fp", best).groupBy("fp").agg(F.min("best").alias("best")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "best", F.coalesce("component", "fp").alias("component")
    )
    winners = named.groupBy("component").agg(F.min("best").alias("best")).select("best.mark1", "best.mark2")
    one = marked.groupBy("mark1", "mark2").agg(F.first("row").alias("row"))
    return one.join(stored(winners, "winners"), ["mark1", "mark2"], "left_semi").select("row.*")
