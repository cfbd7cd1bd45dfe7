"""Exact duplicates by an extendible-hash index on files that all tasks share.

Texts are compared without white space. Every task of the first pass keeps one entry for
each different text it sees, so a text with many copies is one entry a task. An entry's key
is the head of its text's SHA-256; a directory maps the leading bits of keys to buckets, and
doubles as long as a bucket is overfull, splitting that bucket alone. Tasks own ranges of
buckets, balanced by bytes: they read their entries in the order of the keys, chain those
of one key, and tell texts in a chain apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored
from ledgerleaf.llm.words import plain_texts, slices

# Bytes of entries in a bucket before it is split.
BUCKET_BYTES = 4 << 20
# The directory has at most 2**DEEPEST pointers; a bucket at that depth grows on.
DEEPEST = 20
# Levels that one count of the entries lets the directory grow.
ROUND = 4
# Bytes of different texts that a task holds before it writes them down.
HELD_BYTES = 16 << 20
# Bytes of an entry beside its text.
ENTRY_BYTES = 96
KEY_BITS = 64

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_HEAD = "key long, bytes long, sha binary, text binary, rows long, points long, best_row long"
_OWNED = "entry long, keep_id {id}, keep_row long, group_size long, sha binary"


def _squeezed(text: pa.Array) -> tuple[bytes, list[int], list[int]]:
    """The texts' bytes without white space, their bounds, and code points before."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    bounds = np.frombuffer(text.buffers()[1], kind)[text.offset :][: len(text) + 1].astype(np.int64)
    if bounds[-1] == bounds[0]:
        return b"", [0] * len(bounds), [0] * len(text)
    data = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]

    def before(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags)])[bounds]

    keep = ~_SPACE[data]
    points = np.diff(before((data & 0xC0) != 0x80))
    return data[keep].tobytes(), before(keep).tolist(), points.tolist()


def _better(a: tuple, b: tuple) -> bool:
    """Whether row ``a`` stays before ``b``: points, doc_id, row; a null doc_id comes last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1] and None not in (a[1], b[1]):
        return a[1] < b[1]
    return (a[1] is None, a[2]) < (b[1] is None, b[2])


class _Held:
    """Entries of the texts seen since the last write, and the rows that have them."""

    def __init__(self, first_entry: int, key_bits: int):
        self.first, self.key_bits = first_entry, key_bits
        self.entries: dict[bytes, int] = {}
        self.best: list[tuple] = []
        self.counts: list[int] = []
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, text: bytes, points: int, doc_id: object, row: int) -> None:
        at = self.entries.setdefault(text, len(self.entries))
        mine = (points, doc_id, row)
        if at == len(self.best):
            self.best.append(mine)
            self.counts.append(0)
            self.bytes += len(text)
        elif _better(mine, self.best[at]):
            self.best[at] = mine
        self.counts[at] += 1
        self.rows.append((doc_id, row, at))

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        """All rows; the best row of each entry carries the entry itself."""
        texts = list(self.entries)
        n = len(self.rows)
        columns: dict[str, list] = {
            name: [None] * n for name in ("key", "bytes", "sha", "text", "rows", "points", "best_row")
        }
        place = {row: i for i, (_, row, _) in enumerate(self.rows)}
        for at, text in enumerate(texts):
            points, _, row = self.best[at]
            sha = hashlib.sha256(text).digest()
            key = int.from_bytes(sha[:8], "big") >> (64 - self.key_bits) << (64 - self.key_bits)
            i = place[row]
            columns["key"][i] = key - (1 << 64) if key >> 63 else key
            columns["bytes"][i] = len(text) + ENTRY_BYTES
            columns["sha"][i], columns["text"][i] = sha, text
            columns["rows"][i], columns["points"][i], columns["best_row"][i] = self.counts[at], points, row
        arrays = {
            "doc_id": pa.array([r[0] for r in self.rows], id_type),
            "row": pa.array([r[1] for r in self.rows], pa.int64()),
            "entry": pa.array([self.first + r[2] for r in self.rows], pa.int64()),
        }
        for name, values in columns.items():
            kind = pa.binary() if name in ("sha", "text") else pa.int64()
            arrays[name] = pa.array(values, kind)
        return pa.RecordBatch.from_pydict(arrays)


def _placer(key_bits: int, held_bytes: int) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        row, entry, held, id_type = base, base, _Held(base, key_bits), None
        for batch in batches:
            text, ids = plain_texts(batch.column("text")), batch.column("doc_id")
            id_type = ids.type
            for a, b in slices(text):
                raw, bounds, points = _squeezed(text.slice(a, b - a))
                for i, doc_id in enumerate(ids.slice(a, b - a).to_pylist()):
                    held.add(raw[bounds[i] : bounds[i + 1]], points[i], doc_id, row)
                    row += 1
                if held.bytes >= held_bytes or len(held.rows) >= held_bytes // ENTRY_BYTES:
                    entry += len(held.entries)
                    yield held.batch(id_type)
                    held = _Held(entry, key_bits)
        if held.rows:
            yield held.batch(id_type)

    return place


@dataclass(frozen=True)
class Directory:
    """``depth`` leading bits of a key are the slot; ``buckets`` has each slot's bucket.

    Buckets ascend with the keys. ``owners`` has each bucket's owner.
    """

    depth: int
    buckets: np.ndarray
    owners: np.ndarray


def grow_directory(
    entries: DataFrame, owners: int, bucket_bytes: int = BUCKET_BYTES, deepest: int = DEEPEST
) -> Directory:
    """The directory for entries with ``key`` and ``bytes``.

    What reaches the driver is one row per bucket and ``2**ROUND`` per overfull one, so at
    most ``2**deepest``, whatever the number of entries. A bucket with one key is left.
    """
    spark = entries.sparkSession
    total = entries.agg(F.sum("bytes"), F.min("key"), F.max("key")).first()
    size = int(total[0] or 0)
    # Prefix and depth of a bucket, with its bytes.
    full: dict[tuple[int, int], int] = {}
    over = {(0, 0): size} if size > bucket_bytes and total[1] != total[2] else {}
    if not over:
        full[0, 0] = size
    depth = 0
    while over and depth < deepest:
        step = min(ROUND, deepest - depth)
        chosen = spark.createDataFrame([(prefix,) for prefix, _ in over], "prefix long")
        finer = _prefix("key", depth + step)
        counted = (
            entries.select("key", "bytes", _prefix("key", depth).alias("of"))
            .join(F.broadcast(chosen), F.col("of") == F.col("prefix"))
            .groupBy(finer.alias("child"))
            .agg(F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        )
        levels = {depth + step: {r.child: (int(r.bytes), r.low, r.high) for r in counted.collect()}}
        for d in range(depth + step, depth, -1):
            levels[d - 1] = {}
            for child, (held, low, high) in levels[d].items():
                other = levels[d - 1].get(child >> 1, (0, low, high))
                levels[d - 1][child >> 1] = (held + other[0], min(low, other[1]), max(high, other[2]))
        for d in range(depth + 1, depth + step + 1):
            halves = [(p << 1 | bit, d) for p, _ in over for bit in (0, 1)]
            over = {}
            for prefix, _ in halves:
                held, low, high = levels[d].get(prefix, (0, 0, 0))
                if held > bucket_bytes and low != high:
                    over[prefix, d] = held
                else:
                    full[prefix, d] = held
        depth += step
    full |= over
    deep = max(d for _, d in full)
    order = sorted(full, key=lambda b: b[0] << (deep - b[1]))
    buckets = np.repeat(np.arange(len(order)), [1 << (deep - d) for _, d in order])
    weights = np.array([full[b] for b in order], float)
    before = np.cumsum(weights) - weights
    owned = (before * min(owners, len(order)) / max(weights.sum(), 1)).astype(np.int64)
    return Directory(deep, buckets, owned)


def _prefix(key: str, depth: int):
    """The leading bits of a key; a shift by all 64 bits would be none."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one owner's entries, which come in the order of their keys."""
    key, chain, done = None, {}, []

    def close() -> None:
        for members, best, rows, sha in chain.values():
            done.extend((entry, best[1], best[2], rows, sha) for entry in members)

    id_type = None
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for row in zip(*[batch.column(name).to_pylist() for name in batch.schema.names], strict=True):
            own, entry, doc_id, sha, text, rows, points, best_row = row
            if own != key:
                close()
                key, chain = own, {}
            mine = (points, doc_id, best_row)
            # A chain is looked through by the texts' bytes.
            members, best, total, _ = chain.get(text, ([], mine, 0, sha))
            members.append(entry)
            chain[text] = (members, mine if _better(mine, best) else best, total + rows, sha)
        if len(done) > 10_000:
            yield _owned_batch(done, id_type)
            done.clear()
    close()
    if done:
        yield _owned_batch(done, id_type)


def _owned_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), id_type, pa.int64(), pa.int64(), pa.binary())
    names = ("entry", "keep_id", "keep_row", "group_size", "sha")
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], list(names)
    )


@dataclass(frozen=True)
class Index:
    """``rows``: every row with its entry; ``buckets``: every entry with its bucket and group."""

    rows: DataFrame
    directory: Directory
    buckets: DataFrame


def build_index(
    docs: DataFrame,
    bucket_bytes: int = BUCKET_BYTES,
    deepest: int = DEEPEST,
    key_bits: int = KEY_BITS,
    held_bytes: int = HELD_BYTES,
) -> Index:
    """The index of all rows; null texts are empty, and texts of white space alone too.

    Rows are told apart by their place, so null and repeated ids are fine. Fewer
    ``key_bits`` make chains longer and change no result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", "text").mapInArrow(
        _placer(key_bits, held_bytes), f"doc_id {kind}, row long, entry long, {_HEAD}"
    )
    rows = stored(placed, "dedup-entries")
    entries = rows.filter(F.col("best_row").isNotNull())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = grow_directory(entries, tasks, bucket_bytes, deepest)
    # One row per slot, 2**DEEPEST at most.
    slots = spark.createDataFrame(
        pa.table(
            {
                "slot": np.arange(len(directory.buckets)),
                "bucket": directory.buckets,
                "owner": directory.owners[directory.buckets].astype(np.int32),
            }
        )
    )
    owned = (
        entries.withColumn("slot", _prefix("key", directory.depth))
        .join(F.broadcast(slots), "slot")
        .repartitionById(int(directory.owners[-1]) + 1, "owner")
        .sortWithinPartitions("key", "bytes", "entry")
        .select("key", "entry", "doc_id", "sha", "text", "rows", "points", "best_row")
        .mapInArrow(_owner, _OWNED.format(id=kind))
    )
    return Index(rows, directory, stored(owned, "dedup-buckets"))


def groups(index: Index) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return (
        index.rows.select("doc_id", "row", "entry")
        .join(index.buckets, "entry")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def op11_exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and blank texts are one group. Of equal texts the longest original stays, then the
    smallest doc_id; a null doc_id comes last. Of repeated rows one stays. An empty table
    gives no rows.
    """
    return groups(build_index(docs))
