"""Words of whole Arrow text columns, found and hashed as arrays instead of one by one.

A word is a run of bytes other than space and 9 to 13, or than the bytes given as gaps;
null texts have no words. Texts
are worked on in slices of rows, so memory follows the slice, or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20_240_601).integers(0, 2**64, 260, np.uint64)
_BYTE_CODES = _RANDOM[:256]
# Odd multipliers, so that they have inverses modulo 2**64.
_BYTE_BASE, _WORD_BASE, OTHER_BASE = (int(x) | 1 for x in _RANDOM[256:259])


def slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text; a longer text stands alone."""
    ends = np.frombuffer(text.buffers()[1], _offset_type(text))[text.offset :][: len(text) + 1]
    at = 0
    while at < len(text):
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(text))
        yield at, to
        at = to


def _offset_type(text: pa.Array) -> type:
    return np.int64 if pa.types.is_large_string(text.type) else np.int32


def plain_texts(text: pa.Array) -> pa.Array:
    """Text without nulls in one array."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    return text.fill_null("") if text.null_count else text


class Words:
    """Bytes and word bounds of some texts.

    ``starts`` and ``ends`` hold the words' places in ``data``; the words of text ``i`` are
    those from ``first[i]`` up to ``first[i + 1]``, its bytes those from ``bounds[i]`` on.
    """

    def __init__(self, text: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE):
        text = plain_texts(text)
        bounds = np.frombuffer(text.buffers()[1], _offset_type(text))
        bounds = bounds[text.offset :][: len(text) + 1].astype(np.int64)
        if text.buffers()[2] is None:
            data = np.zeros(0, np.uint8)
        else:
            data = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.data = _LOWER[data] if lower else data
        inside = ~gaps[data]
        begins, closes = inside.copy(), inside.copy()
        if len(data):
            # A word also begins and closes where its text does.
            edge = np.zeros(len(data) + 1, bool)
            edge[self.bounds] = True
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.hashes_of(self.starts, self.ends)

    def hashes_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(_BYTE_CODES[self.data], starts, ends, _BYTE_BASE)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, ``n`` of each at least."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        made = []
        for factor in (base, pow(base, -1, 2**64)):
            row = np.full(max(n, 1 << 16), factor, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        kept = _POWERS[base] = (made[0], made[1])
    return kept[0][:n], kept[1][:n]


def forget_powers() -> None:
    """Empties the table of powers, which would travel with functions sent to tasks."""
    _POWERS.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of the hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(
    codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE
) -> np.ndarray:
    """Hash of each span of 64-bit codes: equal spans, wherever they stand, hash alike."""
    up, down = _powers(base, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    kept = lengths > 0
    starts, lengths = starts[kept], lengths[kept]
    steps = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    steps[0] = starts[0]
    steps[at] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return np.cumsum(steps)
