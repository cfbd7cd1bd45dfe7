"""Harmonic packing of documents' token ids into sequences.

Lengths are parted into classes: class k has those over capacity / (k + 1) and up to
capacity / k, and a bin of class k takes k documents, whole. What is longer than a sequence
fills whole ones first; the shortest documents, below the last class, fill bins one after
another. The room that a full bin has left is filled by the documents that come next: those
are cut, one a bin, and their rest goes on to its own class. Every partition fills its own
bins, with no shuffle. What a partition's last bins hold is put into full sequences and into
ones whose lengths are powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerleaf.llm.tokens import WordTokenizer, tokenizer_path
from ledgerleaf.llm.words import plain_texts, slices

CAPACITY = 4096
END = 2

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids array<int>"
)


# Classes of a fixed number of documents; shorter documents fill bins without one.
CLASSES = 32
# The shortest piece, as a share of the capacity, but for ends of documents.
SHORT_SHARE = 64


@dataclass
class Piece:
    """Ids of a document from ``start`` on; ``tokens`` is the document's number of ids."""

    doc_id: object
    tokens: int
    start: int
    ids: np.ndarray

    def split(self, at: int) -> tuple[Piece, Piece]:
        return replace(self, ids=self.ids[:at]), replace(self, start=self.start + at, ids=self.ids[at:])


class Packer:
    """Fills the bins of one partition; ``done`` has the pieces of full ones."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.classes = min(CLASSES, capacity)
        self.short = max(1, capacity // SHORT_SHARE)
        self.open: dict[int, list[Piece]] = {}
        self.sizes: dict[int, int] = {}
        # Bins that have all their documents and some room.
        self.waiting: deque[tuple[list[Piece], int]] = deque()
        self.done: list[tuple[Piece, int, int]] = []

    def add(self, piece: Piece) -> None:
        """Whole sequences first, then room that waits, then the bin of the rest's class."""
        while len(piece.ids) >= self.capacity:
            full, piece = piece.split(self.capacity)
            self._emit([full])
        while len(piece.ids) and self.waiting:
            piece = self._fill(piece)
        if len(piece.ids):
            # The text's other ids need not be kept.
            self._place(replace(piece, ids=piece.ids.copy()))

    def _fill(self, piece: Piece) -> Piece:
        """Puts ids into the first room that waits; returns those that are left."""
        members, room = self.waiting.popleft()
        size = len(piece.ids)
        take = min(size, room)
        if take == size and 0 < room - take < self.short < size:
            # Else the next piece would be a short one.
            take = size - self.short
        one, rest = piece.split(take)
        members.append(replace(one, ids=one.ids.copy()))
        if room > take:
            self.waiting.appendleft((members, room - take))
        else:
            self._emit(members)
        return rest

    def _place(self, piece: Piece) -> None:
        size = len(piece.ids)
        k = min(self.capacity // size, self.classes)
        if k == self.classes and self.sizes.get(k, 0) + size > self.capacity:
            self._close(k)
        self.open.setdefault(k, []).append(piece)
        self.sizes[k] = self.sizes.get(k, 0) + size
        if k < self.classes and len(self.open[k]) == k:
            self._close(k)

    def _close(self, k: int) -> None:
        members, room = self.open.pop(k), self.capacity - self.sizes.pop(k)
        rest = None
        if 0 < room < self.short < len(members[-1].ids) - room:
            members[-1], rest = members[-1].split(len(members[-1].ids) - self.short)
            room += self.short
        if room:
            self.waiting.append((members, room))
        else:
            self._emit(members)
        if rest is not None:
            self._place(rest)

    def _emit(self, members: list[Piece]) -> None:
        offset = 0
        for piece in members:
            self.done.append((piece, self.sequence, offset))
            offset += len(piece.ids)
        self.sequence += 1

    def finish(self) -> None:
        """Full sequences of what is left, and one for each binary digit of the rest."""
        left = [piece for members, _ in self.waiting for piece in members]
        left += [piece for k in sorted(self.open) for piece in self.open[k]]
        total = sum(len(piece.ids) for piece in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << m for m in range(self.capacity.bit_length() - 2, -1, -1) if total % self.capacity >> m & 1]
        pieces = iter(left)
        piece = next(pieces, None)
        for size in sizes:
            members = []
            while size:
                one, piece = piece.split(min(size, len(piece.ids)))
                members.append(one)
                size -= len(one.ids)
                piece = piece if len(piece.ids) else next(pieces, None)
            self._emit(members)
        self.waiting.clear()
        self.open.clear()
        self.sizes.clear()


def _batch(done: list[tuple[Piece, int, int]], id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    pieces = [piece for piece, _, _ in done]
    ids = [piece.ids.astype("<u4") for piece in pieces]
    columns = {
        "doc_id": pa.array([piece.doc_id for piece in pieces], id_type),
        "start": np.array([piece.start for piece in pieces], np.int64),
        "length": np.array([len(one) for one in ids], np.int64),
        "ids_crc32": np.array([zlib.crc32(one.tobytes()) for one in ids], np.int64),
        "doc_tokens": np.array([piece.tokens for piece in pieces], np.int64),
        "sequence_id": np.array([sequence for _, sequence, _ in done], np.int64),
        "offset": np.array([offset for _, _, offset in done], np.int64),
    }
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(columns["length"])]).astype(np.int32)
        values = pa.array(np.concatenate(ids).astype(np.int32))
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), values)
    return pa.RecordBatch.from_pydict(columns)


def _packer(path: str, capacity: int, end: int, with_ids: bool) -> Callable:
    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        id_type = None

        def finished() -> Iterator[pa.RecordBatch]:
            if packer.done:
                yield _batch(packer.done, id_type, with_ids)
                packer.done.clear()

        for batch in batches:
            text, names = plain_texts(batch.column("text")), batch.column("doc_id")
            id_type = names.type
            for a, b in slices(text):
                ids, bounds = tokenizer.encode(text.slice(a, b - a), end)
                for i, doc_id in enumerate(names.slice(a, b - a).to_pylist()):
                    own = ids[bounds[i] : bounds[i + 1]]
                    packer.add(Piece(doc_id, len(own), 0, own))
                yield from finished()
        packer.finish()
        yield from finished()

    return pack_partition


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end: int = END,
    path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of each document: its place in the document and in a sequence.

    ``capacity`` is a power of two. A document is its text's ids, then ``end``; null and
    empty texts are the end alone. ``doc_id`` is only carried along, so null and repeated
    ids are fine. ``sequence_id`` is unique; a sequence's pieces fill it from offset 0. A piece
    is shorter than capacity / ``SHORT_SHARE`` only where it ends a document, where a bin holds
    nothing longer, or among the last few of a partition.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = SCHEMA if with_ids else SCHEMA.removesuffix(", ids array<int>")
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_packer(path or tokenizer_path(), capacity, end, with_ids), schema)


def op9_packing(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, with_ids=False)
