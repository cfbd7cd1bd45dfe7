"""Repeated passages by a sparse suffix array.

Of all suffixes (a document's words from some word on) only those are kept that start at a
minimiser: the smallest hash of ``GRAM`` words among ``WINDOW`` places in a row. Which place
that is depends on the words there alone, so every passage of ``MIN_WORDS`` words has its
suffix, at the same place in each of its copies. The suffixes are sorted over all documents
by the hash of the ``PREFIX`` words that a passage has after its minimiser at least, then by
the hash of all words that passages with this minimiser can reach to the left and right.
Neighbours are compared along the sorted rows, across the edges of partitions too:

- neighbours alike in both repeat every passage around their minimisers;
- neighbours alike in the prefix only are extended: each place to the left where a passage can
  begin gives a passage of ``MIN_WORDS`` words, and these are sorted and compared likewise.

Overlapping passages are joined into the longest repeated stretches. No row stands for a pair,
so a passage that thousands of documents share costs no more than as many different ones, and
a group of equal suffixes is cut anywhere by the sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored
from ledgerleaf.llm.words import OTHER_BASE, Words, plain_texts, slices, span_hashes

MIN_WORDS = 50
GRAM = 8
WINDOW = 31

# A document is known by its id and its text's digest, so repeated ids do no harm.
_KEY = "doc_id long, digest long"
# A place, and how far to the left passages with it begin at least and at most.
_ROW = f"prefix long, reach long, {_KEY}, place int, most int, least int"
_SEEN = f"{_ROW}, before int, after int, part int, edge int"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def minimisers(words: Words, min_words: int, gram: int, window: int) -> dict[str, np.ndarray]:
    """The kept places of all texts: text, place (word of all), most and least steps to the left."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < min_words:
        return {name: none for name in ("text", "place", "most", "least")}
    hashes = words.hashes()
    at = np.arange(n - gram + 1)
    grams = span_hashes(hashes, at, at + gram)
    owner = words.text_of_word()
    starts = np.arange(n - min_words + 1)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[: len(starts)]
    place = starts + views.argmin(axis=1)
    inside = owner[starts] == owner[starts + min_words - 1]
    starts, place = starts[inside], place[inside]
    if not len(starts):
        return {name: none for name in ("text", "place", "most", "least")}
    # One run of starts for each place.
    new = np.append(True, place[1:] != place[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    kept = place[first]
    return {"text": owner[kept], "place": kept, "most": kept - starts[first], "least": kept - starts[last]}


def _suffix_maker(min_words: int, gram: int, window: int) -> Callable:
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain_texts(batch.column("text"))
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                found = minimisers(words, min_words, gram, window)
                place, owner = found["place"], found["text"]
                low, high = words.first[owner], words.first[owner + 1]
                codes = words.hashes()
                prefix = span_hashes(codes, place, place + min_words - window + 1)
                left = span_hashes(codes, np.maximum(place - window + 1, low), place, OTHER_BASE)
                right = span_hashes(codes, place, np.minimum(place + min_words, high), OTHER_BASE)
                reach = span_hashes(
                    np.stack([left, right], 1).ravel(), np.arange(0, 2 * len(left), 2), np.arange(2, 2 * len(left) + 2, 2)
                ) if len(left) else left
                rows = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(prefix), _long(reach), batch.column("doc_id").take(rows), batch.column("digest").take(rows),
                        pa.array((place - low).astype(np.int32)), pa.array(found["most"].astype(np.int32)),
                        pa.array(found["least"].astype(np.int32)),
                    ],
                    names=["prefix", "reach", "doc_id", "digest", "place", "most", "least"],
                )

    return suffixes


def _likeness(prefix: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Of each row but the first with the row before: 0, 1 alike in the prefix, 2 in both."""
    alike = prefix[1:] == prefix[:-1]
    return alike.astype(np.int32) + (alike & (reach[1:] == reach[:-1]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likeness of sorted rows with the rows before and after; rows like neither are left out.

    The first and last row of a partition always stay, marked 1 and 2 (3 if it is one row).
    """
    part = TaskContext.get().partitionId()
    held, held_before, edge = None, 0, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.concat_batches([held, batch])
        prefix, reach = table.column("prefix").to_numpy(), table.column("reach").to_numpy()
        steps = _likeness(prefix, reach)
        before = np.concatenate([[held_before], steps]).astype(np.int32)
        n = table.num_rows - 1
        edges = np.zeros(n, np.int32)
        if n:
            edges[0] = edge
            keep = (before[:n] > 0) | (steps > 0) | (edges > 0)
            chosen = pa.array(np.flatnonzero(keep))
            yield _with_likeness(table.take(chosen), before[:n][keep], steps[keep], part, edges[keep])
            edge = 0
        held, held_before = table.slice(n), int(before[n])
    if held is not None:
        yield _with_likeness(held, np.array([held_before]), np.array([0]), part, np.array([edge + 2]))


def _with_likeness(rows, before, after, part, edge) -> pa.RecordBatch:
    more = [before, after, np.full(len(before), part), edge]
    arrays = [*rows.columns, *[pa.array(np.asarray(x).astype(np.int32)) for x in more]]
    return pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, "before", "after", "part", "edge"])


def compared(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ``_ROW`` sorted over all partitions, with their likeness to both neighbours.

    Rows unlike both are left out, but for some at edges. The rows at the edges of partitions,
    two for each, meet their neighbours in one small table.
    """
    order = ["prefix", "reach", "doc_id", "digest", "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = stored(ordered.mapInArrow(_compare, _SEEN), name)
    across = Window.orderBy("part", "edge")
    alike = lambda side: (
        F.when(side("prefix") != F.col("prefix"), 0).when(side("reach") != F.col("reach"), 1)
        .when(side("prefix").isNotNull(), 2).otherwise(0)
    )
    edges = seen.filter("edge > 0").withColumns(
        {
            "before": F.when(F.col("edge").isin(1, 3), alike(lambda c: F.lag(c).over(across))).otherwise(F.col("before")),
            "after": F.when(F.col("edge").isin(2, 3), alike(lambda c: F.lead(c).over(across))).otherwise(F.col("after")),
        }
    )
    return seen.filter("edge = 0").unionByName(edges).filter("before > 0 or after > 0").drop("part", "edge")


def _passage_maker(min_words: int) -> Callable:
    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain_texts(batch.column("text"))
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                codes = words.hashes()
                places = batch.column("places").slice(a, b - a)
                owner = np.repeat(np.arange(b - a), np.diff(np.array(places.offsets)))
                flat = places.flatten()
                place, most, least = (flat.field(k).to_numpy() for k in range(3))
                # Every start of a passage with this minimiser.
                count = most - least + 1
                owner, begin = np.repeat(owner, count), np.repeat(place - most, count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                local = begin + step
                start = words.first[owner] + local
                rows = pa.array(owner + a)
                zero = pa.array(np.zeros(len(rows), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(span_hashes(codes, start, start + min_words)),
                        _long(span_hashes(codes, start, start + min_words, OTHER_BASE)),
                        batch.column("doc_id").take(rows), batch.column("digest").take(rows),
                        pa.array(local.astype(np.int32)), zero, zero,
                    ],
                    names=["prefix", "reach", "doc_id", "digest", "place", "most", "least"],
                )

    return passages


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """The stretches of words covered by passages of ``min_words`` words that occur elsewhere too.

    One row per stretch: doc_id, start_word, end_word (words of the text before its begin and
    up to its end), n_words. Another place counts if it is in another document or elsewhere in
    the same one; the first occurrence is reported like the others. Words are compared as they
    are written, white space between them is not. Rows alike in doc_id and text are copies of
    each other and are reported once. Null, empty and shorter texts have none.
    """
    if gram + window - 1 > min_words:
        raise ValueError("a passage must hold a whole window of minimisers")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text")
    suffixes = stored(keyed.mapInArrow(_suffix_maker(min_words, gram, window), _ROW), "suffixes")
    alike = compared(suffixes, "suffix-neighbours")
    whole = alike.filter("before = 2 or after = 2").select(
        "doc_id", "digest", (F.col("place") - F.col("most")).alias("start"),
        (F.col("place") - F.col("least") + min_words).alias("end"),
    )
    # Rows beside one that is alike in the prefix only.
    open_ = (
        alike.filter("before = 1 or after = 1")
        .groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_list(F.struct("place", "most", "least"))).alias("places"))
        .withColumnsRenamed({"doc_id": "_doc_id", "digest": "_digest"})
    )
    chosen = keyed.join(
        open_, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("digest") == F.col("_digest"))
    ).select("doc_id", "digest", "text", "places")
    extended = compared(chosen.mapInArrow(_passage_maker(min_words), _ROW), "passage-neighbours")
    found = extended.filter("before = 2 or after = 2").select(
        "doc_id", "digest", F.col("place").alias("start"), (F.col("place") + min_words).alias("end")
    )
    # Copies of a repeated row have the same spans, which meet as one.
    return _stretches(whole.unionByName(found).distinct())


def _stretches(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document joined."""
    of_doc = Window.partitionBy("doc_id", "digest").orderBy("start", "end")
    reached = F.max("end").over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= reached, 0).otherwise(1)
    numbered = spans.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(of_doc))
    joined = numbered.groupBy("doc_id", "digest", "stretch").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word")
    )
    return joined.select(
        "doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
    )


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per repeated stretch: doc_id, start_word, end_word, n_words."""
    return repeated_passages(docs)
