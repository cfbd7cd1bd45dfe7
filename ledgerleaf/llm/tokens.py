"""Token ids of whole texts, by a public tokenizer, once per different word.

The tokenizer's pattern never joins what white space parts, nor letters with the full
stops and signs after them. So each run of non-space bytes, its last signs apart, is encoded
alone, and its ids are kept by the hash of its bytes. A text's ids are the ids of these
pieces one after another. New pieces of plain letters, the most by far, are encoded many in
one call, without the general rules that leave them as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from ledgerleaf.llm.words import Words, ragged

WORD_BPE = "word_bpe_49k.json"
# Words that are remembered; beyond them the memory starts anew.
REMEMBERED = 1 << 20
# Pieces in one call.
_TOGETHER = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Second bytes, after 0xC3, of letters; the two left out are signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SIGN = np.zeros(256, bool)
_SIGN[list(b".,;:!?$%&*#")] = True
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words with the signs after a letter apart; each text's first."""
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return starts, ends, words.first
    core = np.maximum.accumulate(np.where(_SIGN[data], 0, np.arange(1, len(data) + 1)))[ends - 1]
    last = data[core - 1]
    letter = _LETTER[last] | (_LATIN[last] & (data[core - 2] == 0xC3) & (core - 2 >= starts))
    split = (core < ends) & (core > starts) & letter
    at = np.flatnonzero(split)
    moved = np.concatenate([[0], np.cumsum(split)])[words.first]
    return np.insert(starts, at + 1, core[at]), np.insert(ends, at, core[at]), words.first + moved


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """``path`` is a file of the tokenizers library with a pattern that drops white space.

    With ``special`` false, the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # For pieces of plain letters in lower case: one word each, ended by its last token.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.plain.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self._forget()

    def _encode_plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case pieces of plain letters, and each one's number of ids."""
        shown = [" ".join(pieces[i : i + _TOGETHER]) for i in range(0, len(pieces), _TOGETHER)]
        spelled = [
            " ".join(w.encode().decode("latin-1").translate(self.letters) for w in one.split(" "))
            for one in shown
        ]
        found = self.plain.encode_batch_fast(spelled, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.flatnonzero(self.closes[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _encode_other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for one in found for x in one), np.uint32, int(lengths.sum())), lengths

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Adds words by their sorted new keys."""
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        plain = np.array([_PLAIN.fullmatch(w) is not None for w in words], bool)
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for mine, encode in ((plain, self._encode_plain), (~plain, self._encode_other)):
            chosen = np.flatnonzero(mine)
            if not len(chosen):
                continue
            ids, sizes = encode([words[i].lower() if mine is plain else words[i] for i in chosen])
            lengths[chosen] = sizes
            starts[chosen] = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, ids])
        slots = np.arange(len(self.starts), len(self.starts) + len(keys))
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, slots)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the keys, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.slots[at], self.keys[at] == keys

    def encode(self, text: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and the bounds of each text in it.

        ``end`` is an id that follows each text. Null counts as empty.
        """
        words = Words(text)
        begins, closes, firsts = _pieces(words)
        keys, first, inverse = np.unique(
            words.hashes_of(begins, closes), return_index=True, return_inverse=True
        )
        slots, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            before = len(self.keys)
            raw = words.data.tobytes()
            piece = lambda i: raw[begins[first[i]] : closes[first[i]]].decode()
            self._learn(keys[new], [piece(i) for i in new])
            if len(self.keys) < before + len(new):
                lost = np.flatnonzero(known)
                self._learn(keys[lost], [piece(i) for i in lost])
            slots, _ = self._find(keys)
        starts, lengths, ids = self.starts[slots][inverse], self.lengths[slots][inverse], self.ids
        sums = np.concatenate([[0], np.cumsum(lengths)])
        bounds = sums[firsts]
        if end is not None:
            starts = np.insert(starts, firsts[1:], len(ids))
            lengths = np.insert(lengths, firsts[1:], 1)
            ids = np.append(ids, np.uint32(end))
            bounds = bounds + np.arange(len(bounds))
        return ids[ragged(starts, lengths)], bounds
