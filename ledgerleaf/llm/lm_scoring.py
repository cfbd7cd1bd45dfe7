"""Log probabilities of whole texts under a self-attention model of subword ids.

The corpus gives three things, all from the documents that are not held out: the count of every
word, from which the base score follows; the model's vocabulary; and the model itself. Every
text is split into ids once, and its ids are stored: what counts them, trains on them and scores
them reads them there. Every task trains on all the texts it has, once, and the tasks' models are averaged, weighted by their tokens, in groups of ``TOGETHER``
until few are left. The model has a fixed size, so tasks get it whole. Words are looked up in two ways: those
that make up more than one in ``FREQUENT`` tokens, so fewer than that many, go to every task; the
others of a document are joined to the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import attention
from ledgerleaf.llm.tables import stored
from ledgerleaf.llm.tokens import WordTokenizer, tokenizer_path
from ledgerleaf.llm.words import Words, plain_texts, ragged, slices

END = 49_407
TOGETHER = 64
# Words of the documents that one model is trained on.
SHARD_WORDS = 4_000_000
# A shard with fewer batches, such as the one of a small corpus, is gone over again.
LEAST_STEPS = 800
FREQUENT = 1 << 20
# The word that stands for the end of a text; no other word is empty.
_END_WORD = ""
# Rows of one hand-over while words are counted.
_COUNTED_BYTES = 2 << 20
# Ids that are scored at once.
_SCORED_BYTES = 1 << 17


def remainder() -> Column:
    """crc32 of doc_id as text; that of the empty text where it is null."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _texts_of(words: Words, chosen: np.ndarray) -> pa.Array:
    """The chosen words as an array of strings."""
    starts, sizes = words.starts[chosen], words.ends[chosen] - words.starts[chosen]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = np.ascontiguousarray(words.data[ragged(starts, sizes)])
    return pa.StringArray.from_buffers(len(chosen), pa.py_buffer(offsets), pa.py_buffer(data))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = plain_texts(batch.column("text"))
        for a, b in slices(text, _COUNTED_BYTES):
            words = Words(text.slice(a, b - a), lower=True)
            _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_texts_of(words, first), pa.array(n)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([_END_WORD]), pa.array([batch.num_rows])], names=["word", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """Every different token of the training texts with its count: word, n."""
    counted = train.select("text").mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def _id_type(path: str) -> type:
    """The smallest type that holds all ids of the tokenizer."""
    return np.uint16 if WordTokenizer(path).tokenizer.get_vocab_size() <= 1 << 16 else np.uint32


def _packed(ids: np.ndarray, bounds: np.ndarray, kind: type) -> pa.Array:
    """Each text's ids as bytes."""
    data = np.ascontiguousarray(ids.astype(kind))
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(packed: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, and the bounds of each text in it."""
    if not len(packed):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :][: len(packed) + 1]
    bounds = offsets.astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(packed.buffers()[2], kind)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _split(train: DataFrame, path: str) -> DataFrame:
    """The ids of texts (place, text) with an end after each: place, ids."""
    kind = _id_type(path)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path, special=False)
        for batch in batches:
            text = plain_texts(batch.column("text"))
            for a, b in slices(text):
                ids = _packed(*tokenizer.encode(text.slice(a, b - a), END), kind)
                yield pa.RecordBatch.from_arrays([batch.column("place").slice(a, b - a), ids], names=["place", "ids"])

    return train.select("place", "text").mapInArrow(split, "place long, ids binary")


def subword_counts(split: DataFrame, path: str) -> np.ndarray:
    """The count of every id of the tokenizer in split texts (ids)."""
    kind, size = _id_type(path), WordTokenizer(path).tokenizer.get_vocab_size()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            ids, _ = _unpacked(batch.column("ids"), kind)
            sums += np.bincount(ids, minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["id", "n"])

    rows = split.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(size, np.int64)
    sums[np.asarray(rows.column("id"))] = np.asarray(rows.column("n"))
    return sums


def pair_counts(counts: DataFrame, vocabulary: attention.Vocabulary, path: str) -> np.ndarray:
    """How often places stand after places, from the word counts.

    Within words the counts are exact. After a word's last id the next word's first id, or the
    end, is taken to have its share of all of these.
    """
    width, height = attention.HEAD + 1, attention.HEAD + 2

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path, special=False)
        sums = np.zeros((height + 1) * width)
        for batch in batches:
            word = plain_texts(batch.column("word"))
            for a, b in slices(word):
                ids, bounds = tokenizer.encode(word.slice(a, b - a), END)
                place, n = vocabulary.place[ids], np.asarray(batch.column("n"))[a:b]
                first, last, each = bounds[:-1], bounds[1:] - 2, np.repeat(n, np.diff(bounds))
                inside = np.ones(len(ids), bool)
                inside[bounds[1:] - 1] = False
                inside[first] = False
                at = np.flatnonzero(inside)
                # Row BEGIN has what begins a word, or ends the text; the row below what ends words.
                keys = [place[at - 1] * width + place[at], attention.BEGIN * width + place[first]]
                full = last >= first
                keys.append(height * width + place[last[full]])
                weights = np.concatenate([each[at], n, n[full]])
                sums += np.bincount(np.concatenate(keys), weights, len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at].astype(np.int64))], names=["id", "n"])

    # As many rows as there are pairs of places at most.
    rows = counts.mapInArrow(split, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((height + 1) * width)
    sums[np.asarray(rows.column("id"))] = np.asarray(rows.column("n"))
    pairs, ends = sums[: height * width].reshape(height, width), sums[height * width :]
    begins = pairs[attention.BEGIN]
    pairs[:width] += ends[:, None] * (begins / max(begins.sum(), 1))
    return pairs


def _train_maker(shared, path: str):
    kind = _id_type(path)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters, vocabulary = shared.value[0], attention.restored(shared.value[1])
        trainer, kept = attention.Trainer(parameters, vocabulary), []
        for batch in batches:
            packed = batch.column("ids")
            for a, b in slices(packed):
                part = _unpacked(packed.slice(a, b - a), kind)
                trainer.learn(*part)
                # No more than the tokens of these steps.
                kept = [*kept, part] if trainer.steps < LEAST_STEPS else []
        tokens = trainer.tokens
        while kept and trainer.steps < LEAST_STEPS:
            for part in kept:
                trainer.learn(*part)
        if tokens:
            row = [[TaskContext.get().partitionId()], [float(tokens)], [attention.flat(trainer.m)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int64()), pa.array(row[1]), pa.array(row[2], pa.list_(pa.float32()))],
                names=["part", "tokens", "model"],
            )

    return train


def _average(table: pa.Table) -> pa.Table:
    """One model of a group of models."""
    tokens = np.asarray(table.column("tokens"))
    mean = sum(t * np.asarray(m.values) for t, m in zip(tokens, table.column("model"), strict=True)) / tokens.sum()
    part = table.column("part")[0].as_py() // TOGETHER
    return pa.table(
        {"part": [part], "tokens": [float(tokens.sum())], "model": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))}
    )


_MODELS = "part long, tokens double, model array<float>"


def _place() -> Column:
    """Where a text stands among others, wherever it lies in the input."""
    return F.xxhash64("doc_id", "text")


def _shards(split: DataFrame, words: int) -> DataFrame:
    """The ids, a partition for each shard, in an order that does not depend on the input's."""
    shards = max(1, round(words / SHARD_WORDS))
    dealt = split.select("place", "ids", F.pmod("place", F.lit(shards)).cast("int").alias("shard"))
    return dealt.repartitionById(shards, "shard").sortWithinPartitions("place", "ids").select("ids")


def fit(train: DataFrame, counts: DataFrame, path: str) -> tuple[dict[str, np.ndarray], attention.Vocabulary]:
    """Trains on every row of ``train`` (doc_id, text); as it starts, the model knows the counts."""
    return fit_split(stored(_split(train.withColumn("place", _place()), path), "ids"), counts, path)


def fit_split(split: DataFrame, counts: DataFrame, path: str) -> tuple[dict[str, np.ndarray], attention.Vocabulary]:
    """``fit`` on texts' stored ids (place, ids)."""
    spark = split.sparkSession
    vocabulary = attention.Vocabulary(subword_counts(split, path), END)
    vocabulary.follow(pair_counts(counts, vocabulary, path))
    parameters = attention.new_parameters()
    shared = spark.sparkContext.broadcast((parameters, vars(vocabulary)))
    words = counts.agg(F.sum("n")).first()[0] or 0
    models = stored(_shards(split, words).mapInArrow(_train_maker(shared, path), _MODELS), "models")
    while models.count() > TOGETHER:
        together = models.groupBy(F.floor(F.col("part") / TOGETHER).alias("together"))
        models = stored(together.applyInArrow(_average, _MODELS), "models")
    # At most TOGETHER models of a fixed size.
    found = models.orderBy("part").toArrow()
    if found.num_rows:
        mean = np.asarray(_average(found).column("model")[0].values)
        parameters = attention.unflat(mean, parameters)
    return parameters, vocabulary


def _base_maker(shared, path: str):
    """Each text's ids, the sums of its frequent words, and its other words."""
    kind = _id_type(path)

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        tokenizer = WordTokenizer(path, special=False)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            text = plain_texts(batch.column("text"))
            for a, b in slices(text):
                part = text.slice(a, b - a)
                ids = _packed(*tokenizer.encode(part, END), kind)
                words = Words(part, lower=True)
                owner, hashes = words.text_of_word(), words.hashes()
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                known = np.bincount(owner[hit], minlength=b - a)
                sums = np.bincount(owner[hit], logs[at[hit]], b - a) if len(keys) else np.zeros(b - a)
                # The other words of each text, each different one with its number.
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((hashes[rest], owner[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(order)))
                offsets = pa.array(np.searchsorted(owner[order][first], np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + b - a)),
                        *[batch.column(name).slice(a, b - a) for name in ("doc_id", "held_out", "place")],
                        pa.array(words.counts + 1), pa.array(known.astype(np.int64)), pa.array(sums.astype(np.float64)),
                        ids,
                        pa.ListArray.from_arrays(offsets, _texts_of(words, order[first])),
                        pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                    ],
                    names=["row", "doc_id", "held_out", "place", "n_tokens", "n_frequent", "base_frequent", "ids", "words", "numbers"],
                )
                row += b - a

    return base


_BASE = (
    "row long, doc_id long, held_out boolean, place long, n_tokens long, n_frequent long, base_frequent double, "
    "ids binary, words array<string>, numbers array<int>"
)


def _score_maker(shared, path: str):
    kind = _id_type(path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters, vocabulary = shared.value[0], attention.restored(shared.value[1])
        for batch in batches:
            packed, found = batch.column("ids"), []
            for a, b in slices(packed, _SCORED_BYTES):
                ids, bounds = _unpacked(packed.slice(a, b - a), kind)
                sums = np.concatenate([[0.0], np.cumsum(attention.log_probabilities(parameters, vocabulary, ids, bounds))])
                found.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.log(10))
            rest = batch.drop_columns(["ids"])
            yield rest.append_column("score", pa.array(np.concatenate([*found, np.zeros(0)])))

    return score


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base_frequent double, score double"


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text and its end; null texts are empty, null ids
    count as the empty text. Where no document is for training, the model is untrained and no
    token known.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.filter(remainder() % 10 != 0)
    counts = stored(word_counts(train), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    divisor = total + 0.1 * (kinds + 1)

    # Fewer than FREQUENT rows, whatever the corpus.
    frequent = counts.filter(F.col("n") > F.lit(total / FREQUENT)).filter(F.col("word") != _END_WORD)
    known = frequent.toArrow()
    words = Words(known.column("word").combine_chunks()) if known.num_rows else None
    keys = words.hashes() if words else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    logs = np.log10((np.asarray(known.column("n")).astype(float) + 0.1) / divisor)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], logs[order]))

    marked = rows.select("doc_id", (remainder() % 10 == 0).alias("held_out"), _place().alias("place"), "text")
    # Once stored, a row has its number for good.
    base = stored(marked.mapInArrow(_base_maker(shared, path), _BASE), "base")
    model = fit_split(base.filter(~F.col("held_out")).select("place", "ids"), counts, path)
    shared = docs.sparkSession.sparkContext.broadcast((model[0], vars(model[1])))
    named = base.select("row", "doc_id", "held_out", "n_tokens", "n_frequent", "base_frequent", "ids")
    scored = stored(named.mapInArrow(_score_maker(shared, path), _SCORED), "scored")
    pairs = base.select("row", F.explode(F.arrays_zip("words", "numbers")).alias("w"))
    rare = pairs.select("row", F.col("w.words").alias("word"), F.col("w.numbers").alias("k"))
    found = rare.join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(divisor))
    per_text = found.groupBy("row").agg(
        F.sum(F.col("k") * log).alias("base_rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("n_rare"),
    )
    joined = scored.join(stored(per_text, "rare-words"), "row", "left")
    ends = counts.filter(F.col("word") == _END_WORD).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    end_log = float(np.log10((ends + 0.1) / divisor))
    zero = F.lit(0)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_frequent") + F.coalesce("base_rare", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        "score",
    )


def op5_lm_scoring(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(docs)
