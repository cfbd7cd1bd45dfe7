"""Ranked lexical search: the best documents of a corpus for each item of a query set.

The corpus is scanned once for the query set's terms: each document's row then has its
matching terms and their counts. Counts over all rows give the weights. Documents are then
searched a slice at a time, each slice's rows turned into lists by term. For an item, the
lists that are short in the whole corpus are summed into one accumulator per document, term
by term. These accumulators are then one more list, with the greatest sum as its bound, and
the long lists are merged with it document by document: lists whose bounds together stay
below the item's threshold bring no document in, and are looked up only for documents that
can still reach it. The threshold is the last of the best scores that the task has seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored
from ledgerleaf.llm.words import Words, plain_texts, ragged, slices

BEST = 50
# A list is short if it has at most one document in this many.
SHORT_SHARE = 32
# Bytes of item texts that are searched for in one pass over the corpus.
BLOCK_BYTES = 8 << 20
# Postings and documents of a slice.
SLICE_POSTINGS = 1 << 20
SLICE_DOCS = 1 << 15
# Parts in which an item's results from all tasks are cut down before they meet.
SALTS = 32

# Term bytes: digits, letters, and all of characters beyond ASCII.
_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_MATCHES = "doc_id long, place long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id long, place long, score long"


class Vocabulary:
    """The terms of some items, found among the words of texts by hash and then by bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        words = Words(pa.array([t.decode() for t in terms], pa.string()), gaps=_GAPS)
        hashes = words.hashes()
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        self.data, self.starts, self.sizes = words.data, words.starts, words.ends - words.starts

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and each one's term."""
        hashes = words.hashes()
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hits = np.flatnonzero(self.hashes[at] == hashes)
        terms = self.order[at[hits]]
        sizes = words.ends[hits] - words.starts[hits]
        same = sizes == self.sizes[terms]
        hits, terms, sizes = hits[same], terms[same], sizes[same]
        if not len(hits):
            return hits, terms
        mine = words.data[ragged(words.starts[hits], sizes)]
        equal = mine == self.data[ragged(self.starts[terms], sizes)]
        same = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        return hits[same], terms[same]


def _matcher(vocabulary: Vocabulary) -> Callable:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            text, ids = plain_texts(batch.column("text")), batch.column("doc_id")
            for a, b in slices(text):
                words = Words(text.slice(a, b - a), lower=True, gaps=_GAPS)
                hits, terms = vocabulary.find(words)
                doc = np.searchsorted(words.first, hits, "right") - 1
                pairs, counts = np.unique(doc * len(vocabulary.terms) + terms, return_counts=True)
                doc, terms = np.divmod(pairs, len(vocabulary.terms))
                ends = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
                    for x in (terms, counts)
                ]
                places = np.arange(place + a, place + b)
                columns = [ids.slice(a, b - a).cast(pa.int64()), places, words.counts.astype(np.int64), *lists]
                rows = pa.table(columns, names=["doc_id", "place", "n", "terms", "counts"])
                # Documents without any term are in no count.
                yield from rows.filter(pa.array(words.counts > 0)).to_batches()
            place += len(batch)

    return match


@dataclass(frozen=True)
class Query:
    """Items as arrays of terms, with the weights of terms and which lists are short."""

    items: list[np.ndarray]
    weights: np.ndarray
    short: np.ndarray
    documents: int
    total: int


class _Best:
    """The best documents of one item so far."""

    def __init__(self, size: int):
        self.size = size
        self.scores = np.zeros(0, np.int64)
        self.rows = np.zeros((0, 3), np.int64)

    def threshold(self) -> int:
        """A document needs as much to be among the best: 1 at least."""
        return int(self.scores[-1]) if len(self.scores) == self.size else 1

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        scores, rows = np.concatenate([self.scores, scores]), np.concatenate([self.rows, rows])
        # Score down, then null ids last, ids and places up.
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], -scores))[: self.size]
        self.scores, self.rows = scores[order], rows[order]


class _Lists:
    """A slice of documents by term."""

    def __init__(self, table: pa.Table, query: Query):
        table = table.combine_chunks()
        ids = table["doc_id"].combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        self.rows = np.column_stack([null, ids.fill_null(0).to_numpy(), table["place"].to_numpy()])
        n = table["n"].to_numpy()
        lists = table["terms"].combine_chunks()
        term = lists.flatten().to_numpy()
        tf = table["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        m = 50 + (50 * n * query.documents) // query.total
        part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.value = part[order] * query.weights[term[order]]
        self.ends = np.searchsorted(term[order], np.arange(len(query.weights) + 1))

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[term], self.ends[term + 1])
        return self.doc[part], self.value[part]

    def accumulated(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of some lists, and the sums of their values."""
        sums = np.zeros(len(self.rows), np.int64)
        for term in terms:
            doc, value = self.list(term)
            sums[doc] += value
        doc = np.flatnonzero(sums)
        return doc, sums[doc]


def _search_item(lists: _Lists, query: Query, terms: np.ndarray, best: _Best) -> None:
    short = query.short[terms]
    merged = [lists.accumulated(terms[short]), *[lists.list(t) for t in terms[~short]]]
    merged = [(doc, value) for doc, value in merged if len(doc)]
    if not merged:
        return
    least = best.threshold()
    for _, value in merged:
        # Scores of one list are already reached by so many documents.
        if len(value) >= best.size:
            least = max(least, int(np.partition(value, -best.size)[-best.size]))
    merged.sort(key=lambda one: one[1].max())
    bounds = np.cumsum([one[1].max() for one in merged])
    if bounds[-1] < least:
        return
    # From here on a list can bring in a document.
    first = int(np.searchsorted(bounds, least))
    sums = np.zeros(len(lists.rows), np.int64)
    for doc, value in merged[first:]:
        sums[doc] += value
    docs = np.flatnonzero(sums)
    scores = sums[docs]
    for i in range(first - 1, -1, -1):
        open_ = scores + bounds[i] >= least
        docs, scores = docs[open_], scores[open_]
        doc, value = merged[i]
        at = np.searchsorted(doc, docs)
        at[at == len(doc)] = 0
        hit = doc[at] == docs
        scores[hit] += value[at[hit]]
    kept = scores >= least
    best.add(scores[kept], lists.rows[docs[kept]])


def _searcher(query: Query, size: int, slice_docs: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(size) for _ in query.items]

        def work(held: list[pa.RecordBatch]) -> None:
            lists = _Lists(pa.Table.from_batches(held), query)
            for terms, one in zip(query.items, best, strict=True):
                _search_item(lists, query, terms, one)

        held, postings, docs = [], 0, 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            docs += len(batch)
            if postings >= SLICE_POSTINGS or docs >= slice_docs:
                work(held)
                held, postings, docs = [], 0, 0
        if held:
            work(held)
        for item, one in enumerate(best):
            if len(one.scores):
                null = pa.array(one.rows[:, 0] == 1)
                ids = pa.compute.if_else(null, pa.scalar(None, pa.int64()), pa.array(one.rows[:, 1]))
                numbers = pa.array(np.full(len(ids), item, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [numbers, ids, pa.array(one.rows[:, 2]), pa.array(one.scores)],
                    ["item", "doc_id", "place", "score"],
                )

    return search


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[dict]:
    """Items' terms, in blocks that hold about ``block_bytes`` of text; one text at least."""
    sized = items.select("item_id", "text", F.octet_length("text").alias("size")).filter("size > 0")
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        mine = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        table = mine.select("item_id", "text").toArrow()
        words = Words(table["text"].combine_chunks(), lower=True, gaps=_GAPS)
        terms: dict = {}
        for number, item_id in enumerate(table["item_id"].to_pylist()):
            own = range(words.first[number], words.first[number + 1])
            terms.setdefault(item_id, set()).update(words.word(i) for i in own)
        if terms := {item: own for item, own in terms.items() if own}:
            yield terms


def _weights(matches: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Weights of terms and their numbers of documents; documents and terms in all."""
    whole = matches.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
    held = matches.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(terms, np.int64)
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    weights = [math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * d + 1))) for d in df.tolist()]
    return np.array(weights, np.int64), df, whole.docs, int(whole.total or 0)


def _search_block(docs: DataFrame, items: dict, best: int, short_share: int, slice_docs: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(sorted(set().union(*items.values())))
    numbers = {term: i for i, term in enumerate(vocabulary.terms)}
    rows = docs.select("doc_id", "text").mapInArrow(_matcher(vocabulary), _MATCHES)
    matches = stored(rows, "search-matches")
    weights, df, documents, total = _weights(matches, len(numbers))
    lists = [np.array(sorted(numbers[t] for t in own), np.int64) for own in items.values()]
    query = Query(lists, weights, df * short_share <= documents, documents, total)
    found = matches.filter(F.size("terms") > 0).mapInArrow(_searcher(query, best, slice_docs), _FOUND)
    named = spark.createDataFrame(
        pa.table({"item": np.arange(len(items), dtype=np.int32), "item_id": pa.array(items, pa.int64())})
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    part = F.pmod("place", F.lit(SALTS)).alias("part")
    found = found.select("*", part)
    for keys in (["item", "part"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("rank")
        found = found.select("item", "part", "doc_id", "place", "score", rank).filter(F.col("rank") <= best)
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    short_share: int = SHORT_SHARE,
    slice_docs: int = SLICE_DOCS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``best`` documents of each item: item_id, rank, doc_id, score.

    The rows of one item_id, null too, are one item. Items without terms, or with terms that
    no document has, have no rows. Null texts have no terms; equal scores rank by doc_id,
    null last, then by place, so repeated rows rank one after another. The other parameters
    change the order of work and no result.
    """
    found = [_search_block(docs, block, best, short_share, slice_docs) for block in _blocks(items, block_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole


def op12_ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per benchmark item, its 50 best documents: item_id, rank, doc_id, score."""
    return search(docs, items)
