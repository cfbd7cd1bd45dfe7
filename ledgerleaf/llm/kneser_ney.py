"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has word n-grams of up to three words. It is fitted on all trusted documents that are
not held out, so it has no bound. What it rests on, the counts of trigrams and what is known of
bigrams and words as such and as contexts, is dealt out by ranges of 56-bit keys and lies in one
file a range in the shared folder, as steps between ascending keys; probabilities are put together
where they are used. To be scored, documents are cut into blocks of some megabytes. Each block asks
the ranges for the counts of its different n-grams, and block and answers meet in one task. Both
go over the texts in waves, a part of the keys or of the documents each, as what is shuffled for
all of them would be several times the input. Words that make up more than one in ``FREQUENT`` of
the fitted words, so few, go to every task and are not asked for.

A caller can set the bounds ``TRAIN_DOCS``, ``TRAIN_WORDS`` and ``TRAIN_TOTAL``, which are none here.
Then the documents of the smallest hashes are fitted on, one of each language in turn, and the
model goes to every task whole.

A document is kept unless its perplexity is above its language's cutoff: the ``QUANTILE`` of the
trusted documents of that language that are not for fitting, times ``MARGIN``. A language with
fewer than ``LEAST_TRUSTED`` of them takes the quantile of all languages, if the model has at least
``LEAST_FITTED`` documents of it; a language that the model does not know has no cutoff. Documents
without a language take that of all languages where they have no own. A short text's mean varies, so ``SPREAD / sqrt(words)`` is added for the document.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored
from ledgerleaf.llm.words import Words, forget_powers, mixed, plain_texts, slices
from ledgerleaf.workdir import work_dir

# Documents for fitting, and words of one and of all of them: every one, unless a caller sets a bound.
TRAIN_DOCS = math.inf
TRAIN_WORDS = math.inf
TRAIN_TOTAL = math.inf
# What is known of words with a greater share of the fitted words than one in this many goes to every task.
FREQUENT = 1 << 20
# Text whose trigrams share a file of counts.
SHARD_BYTES = 4 << 20
# Fitting and asking go over the texts in up to so many waves, one for each of these bytes of text;
# what a wave shuffles is gone before the next one.
WAVE_BYTES = 8 << 20
FIT_WAVES = 10
ASK_WAVES = 12
# Text of the documents that ask the model together.
BLOCK_BYTES = 8 << 20
# Of the trusted documents one in this many is kept for the quantiles.
HELD_OUT = 4
QUANTILE = 0.99
MARGIN = 1.15
LEAST_TRUSTED = 30
# A language with fewer documents in the model is not judged by other languages' cutoff.
LEAST_FITTED = 20
SPREAD = 4.0
# Log perplexities are sorted into steps of this size before quantiles are taken.
STEP = 0.002
# Stands before each document's first word.
START = 1


_ODD_V, _ODD_W = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Keys have 56 bits; those of a shard are a range of their upper 16.
_KEY, _RANGE = np.uint64(8), np.uint64(40)
_LOW = np.uint64((1 << 40) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _ODD_V + b) >> _KEY


def _triple(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of trigrams, in the range of their context's key."""
    return (context & ~_LOW) | (mixed(context * _ODD_W + w) >> np.uint64(24))


def _contexts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, and those of the one and two words before it."""
    w = words.hashes()
    first = words.first[:-1][words.counts > 0]
    second = words.first[:-1][words.counts > 1] + 1
    v, u = np.roll(w, 1), np.roll(w, 2)
    v[first] = START
    u[first] = START
    u[second] = START
    return w, v, u


def _grams(text: pa.Array, most: float = math.inf) -> tuple[np.ndarray, ...]:
    """For each word of texts with up to ``most`` words: hashes of it and the word before, keys of
    the context, the bigram and the trigram."""
    found = []
    for a, b in slices(text):
        words = Words(text.slice(a, b - a), lower=True)
        w, v, u = _contexts(words)
        if most < math.inf:
            chosen = np.repeat(words.counts <= most, words.counts)
            w, v, u = w[chosen], v[chosen], u[chosen]
        context = _pair(u, v)
        found.append((w, v, context, _pair(v, w), _triple(context, w)))
    if not found:
        return tuple(np.zeros(0, np.uint64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> _RANGE) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


def _least_key(shard: int, shards: int) -> np.uint64:
    return np.uint64(-(-shard * 65_536 // shards) << 40)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, all of one length, in as few whole bytes a number as each array needs."""
    n, sizes, parts = len(arrays[0]), [], []
    for array in arrays:
        array = np.ascontiguousarray(array, "<u8")
        size = (int(array.max()).bit_length() + 7) // 8 if n else 0
        sizes.append(size)
        parts.append(np.ascontiguousarray(array.view(np.uint8).reshape(n, 8)[:, :size]).tobytes())
    return b"".join([np.array([n, *sizes], "<u8").tobytes(), *parts])


def _unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    n, *sizes = (int(x) for x in np.frombuffer(data, "<u8", arrays + 1))
    at, found = 8 * (arrays + 1), []
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
        found.append(wide.view("<u8").ravel())
        at += n * size
    return found


def _steps(key: np.ndarray, least: np.uint64) -> np.ndarray:
    """Ascending keys as the steps between them."""
    return np.diff(key, prepend=least)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _different(*keys: np.ndarray) -> np.ndarray:
    """The different keys, ascending; sorted, as ``np.unique`` takes several times as long by a hash table."""
    key = np.sort(np.concatenate(keys))
    return key[_starts(key)]


def _kinds_of(n: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sum of each run, and how many of its counts are one, two and more."""
    return [_sums(x.astype(np.uint64), starts) for x in (n, n == 1, n == 2, n > 2)]


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in range(1, 5)]


def _discounts(counts: list[int]) -> list[float]:
    """The discounts of n-grams seen once, twice and more often, from counts of counts."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    return [min(max(d, 0.1), k) for k, d in zip((0.9, 1.9, 2.9), raw, strict=True)]


def _write(name: str, data: bytes) -> None:
    """A file of the shared folder, whole or not at all, however often its task runs."""
    files, place = fs.FileSystem.from_uri(name)
    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
    own = f"{place}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, place)


def _read(name: str) -> bytes:
    files, place = fs.FileSystem.from_uri(name)
    with files.open_input_file(place) as held:
        return held.read()


def _write_counts(name: str, *parts: bytes) -> None:
    """Parts of a shard, compressed: most counts are one."""
    sizes = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    _write(name, sizes + pa.compress(b"".join(parts), codec="zstd", asbytes=True))


def _read_counts(name: str) -> list[bytes]:
    data = _read(name)
    parts = int(np.frombuffer(data, "<u8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u8", parts, 8)).tolist()
    whole = pa.decompress(data[8 * (parts + 1) :], ends[-1], codec="zstd", asbytes=True)
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


# What is known of a word or a bigram: how many different words stand before it, and, as a context,
# the sum of the counts after it and how many of these are one, two and more.
_KNOWN = ("n", "total", "k1", "k2", "k3")
_OTHERS = pa.schema([("shard", pa.int32()), ("part", pa.binary())])


def _dealer(shards: int, wave: int, waves: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wave's trigrams, for the shard of their context and for that of their last two words."""
        for batch in batches:
            text = plain_texts(batch.column("text"))
            for a, b in slices(text, BLOCK_BYTES):
                w, v, context, pair, triple = _grams(text.slice(a, b - a), TRAIN_WORDS)
                by_context, by_pair = _shard_of(context, shards), _shard_of(pair, shards)
                at = np.flatnonzero((by_context % waves == wave) | (by_pair % waves == wave))
                _, first, n = np.unique(triple[at], return_index=True, return_counts=True)
                at = at[first]
                heads, tails = np.argsort(context[at]), np.argsort(pair[at])
                counts, tails = n[heads], at[tails]
                heads = at[heads]
                own = np.arange(wave, shards, waves)
                bounds = [np.searchsorted(by[rows], [own, own + 1]).T for by, rows in ((by_context, heads), (by_pair, tails))]
                rows = []
                for shard, (h0, h1), (t0, t1) in zip(own, *bounds, strict=True):
                    if h0 == h1 and t0 == t1:
                        continue
                    least, h, t = _least_key(int(shard), shards), heads[h0:h1], tails[t0:t1]
                    rows.append((
                        shard,
                        _packed(_steps(context[h], least), triple[h], counts[h0:h1]),
                        _packed(_steps(pair[t], least), triple[t], v[t] >> _KEY, w[t] >> _KEY),
                    ))
                if rows:
                    shard, head, tail = zip(*rows, strict=True)
                    arrays = [pa.array(shard, pa.int32()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["shard", "heads", "tails"])

    return dealt


def _met(rows: pa.Table, name: str, arrays: int, least: np.uint64) -> list[np.ndarray]:
    """The arrays of all rows, one row after another, the first with steps turned into keys."""
    parts = [_unpacked(x.as_py(), arrays) for x in rows.column(name)]
    for part in parts:
        part[0] = np.cumsum(part[0], dtype=np.uint64) + least
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _gram_counter(folder: str, shards: int):
    def counted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Writes the counts of a shard; gives on what its bigrams add to words, and counts of counts."""
        shard = key[0].as_py()
        least = _least_key(shard, shards)
        context, triple, n = _met(rows, "heads", 3, least)
        order = np.lexsort((triple, context))
        context, triple, n = context[order], triple[order], n[order]
        at = _starts(context, triple)
        n, context, triple = _sums(n, at), context[at], triple[at]
        at = _starts(context)
        contexts, after = context[at], _kinds_of(n, at)
        pair, other, v, w = _met(rows, "tails", 4, least)
        order = np.lexsort((other, pair))
        order = order[_starts(pair[order], other[order])]
        at = _starts(pair[order])
        before = np.diff(np.append(at, len(order))).astype(np.uint64)
        order = order[at]
        pair, v, w = pair[order], v[order], w[order]
        keys = _different(contexts, pair)
        known = np.zeros((5, len(keys)), np.uint64)
        known[0, np.searchsorted(keys, pair)] = before
        known[1:, np.searchsorted(keys, contexts)] = after
        order = np.argsort(triple)
        _write_counts(
            f"{folder}/grams-{shard}", _packed(_steps(keys, least), *known), _packed(_steps(triple[order], least), n[order])
        )
        words = _different(v, w)
        parts = np.zeros((5, len(words)), np.uint64)
        parts[0] = np.bincount(np.searchsorted(words, w), minlength=len(words))
        order = np.argsort(v)
        at = _starts(v[order])
        parts[1:, np.searchsorted(words, v[order][at])] = _kinds_of(before[order], at)
        counts = np.array([*_counts_of_counts(n), *_counts_of_counts(before), n.sum(), len(pair)], np.int64)
        edges = np.searchsorted(_shard_of(words, shards), np.arange(shards + 1))
        found = [(-1, counts.tobytes())]
        for to in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[to], edges[to + 1])
            found.append((to, _packed(_steps(words[own], _least_key(to, shards)), *parts[:, own])))
        to, part = zip(*found, strict=True)
        return pa.table([pa.array(to, pa.int32()), pa.array(part, pa.binary())], schema=_OTHERS)

    return counted


def _word_counter(folder: str, shards: int, common: float):
    def counted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Writes what is known of a shard's words; gives on its frequent words, and counts of counts."""
        shard = key[0].as_py()
        least = _least_key(shard, shards)
        word, *known = _met(rows, "part", 6, least)
        order = np.argsort(word, kind="stable")
        word = word[order]
        at = _starts(word)
        word, known = word[at], [_sums(x[order], at) for x in known]
        _write_counts(f"{folder}/words-{shard}", _packed(_steps(word, least), *known))
        n = known[0]
        counts = [*_counts_of_counts(n), (n > 2).sum(), n.sum(), (n > 0).sum()]
        often = np.maximum(n, known[1]) > common
        part = [np.array(counts, np.int64).tobytes(), _packed(word[often], *[x[often] for x in known])]
        return pa.table([pa.array([-1, shard], pa.int32()), pa.array(part, pa.binary())], schema=_OTHERS)

    return counted


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Each job's shuffle files go as it ends, so that a wave's do not lie beside the next one's."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _waves(size: int, most: int) -> int:
    return min(most, 1 + size // WAVE_BYTES)


def tables(trusted: DataFrame) -> dict | None:
    """The counts of a table of texts, in a folder of files by ranges of keys, and what all keys have in common.

    None without any word.
    """
    spark = trusted.sparkSession
    size = _bytes(trusted)
    waves = _waves(size, FIT_WAVES)
    shards = min(max(12 * waves, -(-size // SHARD_BYTES)), 1 << 16)
    folder = work_dir(spark, "counts")
    texts, others = trusted.select("text"), []
    with _tidy(spark):
        for wave in range(waves):
            dealt = texts.mapInArrow(_dealer(shards, wave, waves), "shard int, heads binary, tails binary")
            counted = dealt.groupBy("shard").applyInArrow(_gram_counter(folder, shards), "shard int, part binary")
            others.append(stored(counted, "word-parts"))
        parts = spark.read.schema(others[0].schema).parquet(*[name for part in others for name in part.inputFiles()])
        # Of few numbers a shard, and fewer than FREQUENT words of a kind.
        own = [np.frombuffer(x, np.int64) for x in parts.filter("shard < 0").toArrow().column("part").to_pylist()]
        grams = np.sum(own, axis=0) if own else np.zeros(10, np.int64)
        if not grams[8]:
            return None
        counter = _word_counter(folder, shards, grams[8] / FREQUENT)
        counted = parts.filter("shard >= 0").groupBy("shard").applyInArrow(counter, "shard int, part binary")
        found = stored(counted, "word-counts").toArrow()
        _dropped(parts)
    found = sorted(zip(found.column("shard").to_pylist(), found.column("part").to_pylist(), strict=True))
    words = np.sum([np.frombuffer(part, np.int64) for shard, part in found if shard < 0], axis=0)
    often = [_unpacked(part, 6) for shard, part in found if shard >= 0]
    d = [_discounts(list(x)) for x in (words[:4], grams[4:8], grams[:4])]
    total, kinds = float(words[5]), int(words[6])
    rest = (d[0][0] * words[0] + d[0][1] * words[1] + d[0][2] * words[4]) / total / (kinds + 1)
    base = {"d": np.array(d), "total": np.array([total]), "rest": np.array([rest])}
    base |= _named("w", [np.concatenate(x) for x in zip(*often, strict=True)])
    return {"folder": folder, "shards": shards, "base": base}


def _named(kind: str, arrays: list[np.ndarray]) -> dict[str, np.ndarray]:
    names = ("key", "n") if kind == "t" else ("key", *_KNOWN)
    return {f"{kind}_{name}": array for name, array in zip(names, arrays, strict=True)}


def _shard_counts(folder: str, shard: int, shards: int) -> dict[str, np.ndarray]:
    """All that the files of a shard hold, as arrays with ascending keys."""
    grams = _present(f"{folder}/grams-{shard}", [_packed(*[np.zeros(0)] * n) for n in (6, 2)])
    words = _present(f"{folder}/words-{shard}", [_packed(*[np.zeros(0)] * 6)])
    model = {}
    for kind, data in (("g", grams[0]), ("t", grams[1]), ("w", words[0])):
        key, *counts = _unpacked(data, 2 if kind == "t" else 6)
        model |= _named(kind, [np.cumsum(key, dtype=np.uint64) + _least_key(shard, shards), *counts])
    return model


def _present(name: str, otherwise: list[bytes]) -> list[bytes]:
    files, place = fs.FileSystem.from_uri(name)
    return _read_counts(name) if files.get_file_info(place).type == fs.FileType.File else otherwise


def fit(trusted: DataFrame) -> dict[str, np.ndarray] | None:
    """The model of a bounded table of texts, as sorted arrays; None without any word."""
    found = tables(trusted)
    if found is None:
        return None
    own = [_shard_counts(found["folder"], shard, found["shards"]) for shard in range(found["shards"])]
    return found["base"] | {name: np.concatenate([x[name] for x in own]) for name in own[0]}


def _look(model: dict[str, np.ndarray], kind: str, keys: np.ndarray) -> list[np.ndarray]:
    """What is known of each key, zeros where nothing is."""
    asked, back = np.unique(keys, return_inverse=True)
    return [x[back] for x in _of_sorted(model, kind, asked)]


def _of_sorted(model: dict[str, np.ndarray], kind: str, asked: np.ndarray) -> list[np.ndarray]:
    key, *counts = (model[f"{kind}_{name}"] for name in (("key", "n") if kind == "t" else ("key", *_KNOWN)))
    if not len(key):
        return [np.zeros(len(asked), np.uint64) for _ in counts]
    at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    hit = key[at] == asked
    return [np.where(hit, x[at], np.uint64(0)) for x in counts]


def _mix(d: np.ndarray, n: np.ndarray, context: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order from a word's counts, its context's and the order below."""
    _, total, k1, k2, k3 = context
    taken = n - np.concatenate([[0.0], d])[np.minimum(n, 3).astype(np.int64)]
    return np.where(total > 0, (taken + (d[0] * k1 + d[1] * k2 + d[2] * k3) * lower) / np.maximum(total, 1), lower)


def log_probabilities(model: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """Natural log probability of each word after the two before it."""
    w, v, u = _contexts(words)
    if not len(w):
        return np.zeros(0)
    d, context, pair = model["d"], _pair(u, v), _pair(v, w)
    # One question for each different word and pair, as what is and as what stands before.
    of_words = _look(model, "w", np.concatenate([w, v]) >> _KEY)
    of_pairs = _look(model, "g", np.concatenate([pair, context]))
    n, own = len(w), of_words[0][: len(w)]
    taken = own - np.concatenate([[0.0], d[0]])[np.minimum(own, 3).astype(np.int64)]
    p = taken / model["total"][0] + model["rest"][0]
    p = _mix(d[1], of_pairs[0][:n], [x[n:] for x in of_words], p)
    return np.log(_mix(d[2], _look(model, "t", _triple(context, w))[0], [x[n:] for x in of_pairs], p))


def _scorer(model) -> Callable:
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            text = plain_texts(batch)
            sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for a, b in slices(text):
                words = Words(text.slice(a, b - a), lower=True)
                totals = np.concatenate([[0.0], np.cumsum(log_probabilities(model, words))])
                sums.append(totals[words.first[1:]] - totals[words.first[:-1]])
                counts.append(words.counts)
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts).astype(np.int64))], names=["logp", "n"]
            )

    return score


def _saved(spark: SparkSession, model: dict[str, np.ndarray]) -> str:
    """The model as one file in the shared folder, from which each task reads it."""
    name = work_dir(spark, "kneser-ney")
    buffer = io.BytesIO()
    np.savez(buffer, **model)
    _write(name, buffer.getvalue())
    return name


def _read_back(name: str) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(_read(name))))


def scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang, n_words and log_perplexity (natural, per word; null without words)."""
    # A broadcast would be on every machine's disk twice.
    name = _saved(docs.sparkSession, model)

    @F.arrow_udf("struct<logp: double, n: bigint>")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _scorer(_read_back(name))(texts)

    rows = docs.select("doc_id", "lang", scored("text").alias("s"))
    return rows.select(
        "doc_id", "lang", F.col("s.n").alias("n_words"), (-F.col("s.logp") / F.nullif(F.col("s.n"), F.lit(0))).alias("log_perplexity")
    )


def _blocks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and block: stored rows, of which consecutive ones share a block."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            text = plain_texts(batch.column("text"))
            for a, b in slices(text, BLOCK_BYTES):
                part = [batch.column(name).slice(a, b - a) for name in ("doc_id", "lang")]
                arrays = [*part, text.slice(a, b - a), pa.array(np.full(b - a, block, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "text", "block"])
                block += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "lang", "text")
    return stored(rows.mapInArrow(numbered, f"doc_id {kind}, lang string, text string, block long"), "blocks")


def _questions(text: pa.Array, frequent: np.ndarray) -> list[np.ndarray]:
    """The different pairs, trigrams and words of a block, ascending; words that tasks have are left out."""
    w, v, context, pair, triple = _grams(text)
    # A context is the pair before, unless a text begins.
    first = np.flatnonzero(v == np.uint64(START))
    pairs = _different(pair, context[first])
    words = _different(w >> _KEY, v[first[:1]] >> _KEY)
    return [pairs, _different(triple), words[~np.isin(words, frequent, assume_unique=True)]]


def _asks_maker(name: str, shards: int):
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _read_back(name)["w_key"]
        for batch in batches:
            block, text = np.asarray(batch.column("block")), plain_texts(batch.column("text"))
            at = _starts(block)
            for a, b in zip(at, [*at[1:], len(block)], strict=True):
                asked = _questions(text.slice(a, b - a), frequent)
                edges = [np.searchsorted(_shard_of(key, shards), np.arange(shards + 1)) for key in asked]
                to = np.flatnonzero(sum(np.diff(edge) for edge in edges))
                if not len(to):
                    continue
                columns = [
                    [_packed(_steps(key[edge[s] : edge[s + 1]], _least_key(s, shards))) for s in to.tolist()]
                    for key, edge in zip(asked, edges, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(to), block[a])), pa.array(to.astype(np.int32)), *[pa.array(x, pa.binary()) for x in columns]],
                    names=["block", "shard", "g", "t", "w"],
                )

    return asks


_ASKED = "block long, shard int, g binary, t binary, w binary"


def _answerer(folder: str, shards: int):
    def answered(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The counts of a shard in place of the keys that blocks ask for, in the same order."""
        shard = key[0].as_py()
        model, least = _shard_counts(folder, shard, shards), _least_key(shard, shards)
        columns = [rows.column("block"), rows.column("shard")]
        for kind in "gtw":
            asked = (np.cumsum(_unpacked(x.as_py(), 1)[0], dtype=np.uint64) + least for x in rows.column(kind))
            columns.append(pa.array([_packed(*_of_sorted(model, kind, x)) for x in asked], pa.binary()))
        return pa.table(columns, names=["block", "shard", "g", "t", "w"])

    return answered


def _block_scorer(name: str):
    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        base = _read_back(name)
        model, answers = dict(base), answers.sort_by("shard")
        asked = _questions(plain_texts(rows.column("text")), base["w_key"])
        for kind, key in zip("gtw", asked, strict=True):
            parts = [_unpacked(x.as_py(), 1 if kind == "t" else 5) for x in answers.column(kind)]
            counts = [np.concatenate(x) for x in zip(*parts, strict=True)] or [key] * (1 if kind == "t" else 5)
            model |= _named(kind, [key, *counts])
        order = np.argsort(np.concatenate([model["w_key"], base["w_key"]]))
        model |= {f"w_{k}": np.concatenate([model[f"w_{k}"], base[f"w_{k}"]])[order] for k in ("key", *_KNOWN)}
        result = pa.concat_tables(
            pa.Table.from_batches([pa.RecordBatch.from_struct_array(s)])
            for s in _scorer(model)(iter([plain_texts(rows.column("text"))]))
        ) if rows.num_rows else pa.table({"logp": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        return pa.table([rows.column("doc_id"), rows.column("lang"), result.column("n"), result.column("logp")], names=["doc_id", "lang", "n_words", "logp"])

    return scored


def table_scores(docs: DataFrame, model: dict) -> DataFrame:
    """What ``scores`` gives, from counts of any size."""
    spark, folder, shards = docs.sparkSession, model["folder"], model["shards"]
    name = _saved(spark, model["base"])
    # Powers that the driver made would travel with the functions.
    forget_powers()
    kind = docs.schema["doc_id"].dataType.simpleString()
    waves, found = _waves(_bytes(docs), ASK_WAVES), []
    turn = F.pmod(F.xxhash64("doc_id", F.lit("wave")), F.lit(waves))
    with _tidy(spark):
        for wave in range(waves):
            blocks = _blocks(docs.filter(turn == wave) if waves > 1 else docs)
            asked = blocks.select("block", "text").mapInArrow(_asks_maker(name, shards), _ASKED)
            answers = asked.groupBy("shard").applyInArrow(_answerer(folder, shards), _ASKED)
            rows = (
                blocks.groupBy("block").cogroup(answers.groupBy("block"))
                .applyInArrow(_block_scorer(name), f"doc_id {kind}, lang string, n_words long, logp double")
            )
            found.append(stored(rows, "wave-scores"))
            _dropped(blocks)
    rows = spark.read.schema(found[0].schema).parquet(*[name for part in found for name in part.inputFiles()])
    return rows.select("doc_id", "lang", "n_words", (-F.col("logp") / F.nullif(F.col("n_words"), F.lit(0))).alias("log_perplexity"))


def _dropped(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    for name in table.inputFiles():
        files, place = fs.FileSystem.from_uri(name)
        files.delete_file(place)


def cutoffs(trusted: DataFrame) -> DataFrame:
    """Per language the greatest log perplexity that is kept, from lang and log_perplexity."""
    step = F.floor(F.col("log_perplexity") / STEP)
    steps = trusted.filter("log_perplexity IS NOT NULL").groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))

    def quantile(keys: list[str]) -> DataFrame:
        merged = steps.groupBy(*keys, "step").agg(F.sum("n").alias("n"))
        # As many steps as there are values of log perplexity, however many documents.
        grouped = merged.groupBy(*keys).agg(
            F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("step", "n"))).alias("steps")
        )
        reached = F.aggregate(
            "steps",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("step")),
            lambda s, x: F.struct(
                (s["n"] + x["n"]).alias("n"),
                F.when(s["step"].isNull() & (s["n"] + x["n"] >= F.lit(QUANTILE) * F.col("total")), x["step"]).otherwise(s["step"]).alias("step"),
            ),
        )["step"]
        return grouped.select(*keys, "total", ((reached + 1) * STEP + F.log(F.lit(MARGIN))).alias("cutoff"))

    overall = quantile([]).select(F.col("cutoff").alias("all_cutoff"))
    return quantile(["lang"]).crossJoin(F.broadcast(overall)).select(
        "lang", F.when(F.col("total") >= LEAST_TRUSTED, F.col("cutoff")).otherwise(F.col("all_cutoff")).alias("cutoff"), "all_cutoff",
        (F.col("total") >= LEAST_TRUSTED).alias("enough"),
    )


_WORD = r"[^\x20\x09-\x0D]+"


def _bounded(slim: DataFrame, n: Column, good: DataFrame) -> DataFrame:
    """doc_id and lang of the documents for fitting within the bounds."""
    fitting = slim.withColumn("size", n).filter((n >= 1) & (n <= TRAIN_WORDS)).join(good, "doc_id", "left_semi")
    # Each language's smallest hashes; of the documents of one id the first is the id's language.
    hashed = fitting.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.sum("size").alias("size"))
    hashed = hashed.withColumn("hash", F.xxhash64("doc_id", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = hashed.withColumn("turn", turn).filter(F.col("turn") <= TRAIN_DOCS).orderBy("turn", "hash", "doc_id").limit(TRAIN_DOCS)
    # A bounded list of ids; the words up to each one's end.
    words = F.sum("size").over(Window.orderBy("turn", "hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    listed = chosen.select("doc_id", "lang", words.alias("words")).filter(F.col("words") <= TRAIN_TOTAL)
    return stored(listed.select("doc_id", "lang"), "training-ids")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, n_words, log_perplexity, cutoff, kept.

    ``labels`` (doc_id, quality, toxic) tells trusted documents: quality 1, toxic not 1. Rows of
    one doc_id share its label. Documents without words are not kept. Without trusted documents
    there is no model, and every document with a word is kept, cutoff and perplexity null.
    """
    good = labels.filter("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) <> 1").select("doc_id").distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT))
    slim = docs.select("doc_id", "text", "lang")
    n = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    if TRAIN_DOCS == TRAIN_TOTAL == math.inf:
        fitting = slim.filter(F.col("text").rlike(_WORD)).join(good.filter(place > 0), "doc_id", "left_semi")
        with _tidy(docs.sparkSession):
            fitting = stored(fitting, "trusted")
        picked = stored(fitting.groupBy("doc_id").agg(F.min("lang").alias("lang")), "fitted-ids")
        model = tables(fitting)
        _dropped(fitting)
    else:
        picked = _bounded(slim, n, good.filter(place > 0))
        model = fit(slim.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"))
    if model is None:
        none = F.lit(None).cast("double")
        return slim.select("doc_id", "lang", n.alias("n_words"), none.alias("log_perplexity"), none.alias("cutoff"), (n > 0).alias("kept"))
    scored = stored((table_scores if "folder" in model else scores)(slim, model), "scores")
    held_out = scored.join(good.filter(place == 0), "doc_id", "left_semi")
    limits = stored(cutoffs(held_out), "cutoffs")
    everywhere = limits.agg(F.max("all_cutoff").alias("all_cutoff"))
    known = picked.groupBy(F.col("lang").alias("_known")).agg(F.count(F.lit(1)).alias("fitted"))
    joined = scored.join(limits.select(F.col("lang").alias("_lang"), F.when(F.col("enough"), F.col("cutoff")).alias("own_cutoff")), F.col("lang").eqNullSafe(F.col("_lang")), "left").crossJoin(
        F.broadcast(everywhere)
    ).join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("_known")), "left")
    fits = (F.col("fitted") >= LEAST_FITTED) | F.col("lang").isNull()
    cutoff = F.coalesce("own_cutoff", F.when(fits, F.col("all_cutoff"))) + F.lit(SPREAD) / F.sqrt(F.nullif("n_words", F.lit(0)))
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("log_perplexity") <= cutoff, F.lit(True))
    return joined.select("doc_id", "lang", "n_words", "log_perplexity", cutoff.alias("cutoff"), kept.alias("kept"))


def op3_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, n_words, log_perplexity, cutoff, kept."""
    return classify(docs, labels)
