"""Token counts of documents in flat token files, found by their separators alone.

A flat file holds the ids of one document after another, each followed by an end-of-document
id, with no index. It is read in blocks of equal size by as many tasks as there are blocks: each
searches its ids for separators at once and hands over the lengths of the documents that lie
inside, the tokens before its first separator and the place of its last. A prefix scan over a
file's blocks then gives each block the number of documents before it and the tokens that its
first document has in earlier blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored
from ledgerleaf.llm.tokens import WordTokenizer, tokenizer_path
from ledgerleaf.llm.words import plain_texts, slices
from ledgerleaf.workdir import work_dir

# <|endoftext|> of the vocabulary, which is small enough for two bytes an id.
END = 49_407
ID = "<u2"
BLOCK_BYTES = 4 << 20


def _writer(folder: str, path: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path, special=False)
        if tokenizer.tokenizer.get_vocab_size() > 1 << 8 * np.dtype(ID).itemsize:
            raise ValueError("the vocabulary has more ids than two bytes can tell apart")
        # Another attempt of the task writes another file, and only rows of one attempt stay.
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        files, place = fs.FileSystem.from_uri(name)
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        documents, at = 0, 0
        with files.open_output_stream(place) as out:
            for batch in batches:
                text = plain_texts(batch.column("text"))
                for a, b in slices(text):
                    ids, _ = tokenizer.encode(text.slice(a, b - a), END)
                    raw = ids.astype(ID).tobytes()
                    out.write(raw)
                    at += len(raw)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n), pa.array(np.arange(documents, documents + n)),
                        batch.column("doc_id"), pa.array(np.full(n, at)),
                    ],
                    names=["file", "ordinal", "doc_id", "written"],
                )
                documents += n

    return write


def write_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the texts' ids to flat files in the shared folder, one for each partition.

    Returns which document stands at which place of which file: file, ordinal, doc_id, written
    (bytes of the file so far). Strings of special tokens in a text are ordinary text, so the
    separator is nowhere else. Null counts as empty. ``path`` is a vocabulary of at most 65,536
    ids; a larger one is refused.
    """
    folder = work_dir(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"file string, ordinal long, doc_id {kind}, written long"
    return stored(rows.mapInArrow(_writer(folder, path or tokenizer_path()), schema), "token-files")


def _scanner(end: int, dtype: str) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                files, place = fs.FileSystem.from_uri(row["file"])
                with files.open_input_file(place) as source:
                    ids = np.frombuffer(source.read_at(row["bytes"], row["begin"]), dtype)
                found = np.flatnonzero(ids == end)
                rows.append(
                    row
                    | {"tokens": len(ids), "first_token": row["begin"] // width, "separators": len(found)}
                    | {"inside": (np.diff(found) - 1).tolist(), "head": int(found[0]) if len(found) else None}
                    | {"last": row["begin"] // width + int(found[-1]) if len(found) else None}
                )
            yield pa.RecordBatch.from_pylist(rows, _SCANNED)

    return scan


_SCANNED = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("begin", pa.int64()), ("bytes", pa.int64()), ("tokens", pa.int64())]
    + [("first_token", pa.int64()), ("separators", pa.int64()), ("inside", pa.list_(pa.int64()))]
    + [("head", pa.int64()), ("last", pa.int64())]
)
_SCANNED_SQL = (
    "file string, block long, begin long, bytes long, tokens long, first_token long, separators long, "
    "inside array<long>, head long, last long"
)


def count_tokens(files: DataFrame, end: int = END, dtype: str = ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens of each document of flat files: file, ordinal, n_tokens without the separator.

    ``files`` has a row per file: file (a URI or absolute path that every executor can read) and
    size in bytes. Ids after the last separator of a file count as a document too.
    """
    if block_bytes % np.dtype(dtype).itemsize:
        raise ValueError("a block must hold whole ids")
    step = F.lit(block_bytes)
    blocks = files.filter("size > 0").select(
        "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))).alias("block")
    )
    spread = blocks.select(
        "file", "block", (F.col("block") * step).alias("begin"),
        F.least(step, F.col("size") - F.col("block") * step).cast("long").alias("bytes"),
    ).repartition("file", "block")
    scanned = stored(spread.mapInArrow(_scanner(end, dtype), _SCANNED_SQL), "scanned-blocks")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.withColumns(
        {
            "documents_before": F.coalesce(F.sum("separators").over(earlier), F.lit(0).cast("long")),
            # The first token of the document that goes on here.
            "began": F.coalesce(F.max("last").over(earlier) + 1, F.lit(0).cast("long")),
        }
    )
    first = F.col("first_token") - F.col("began") + F.col("head")
    closed = placed.filter("separators > 0").select(
        "file", "documents_before", F.posexplode(F.concat(F.array(first), "inside")).alias("k", "n_tokens")
    ).select("file", (F.col("documents_before") + F.col("k")).alias("ordinal"), "n_tokens")
    open_ = scanned.groupBy("file").agg(
        F.sum("separators").alias("ordinal"),
        (F.sum("tokens") - F.coalesce(F.max("last") + 1, F.lit(0))).cast("long").alias("n_tokens"),
    ).filter("n_tokens > 0")
    return closed.unionByName(open_)


def op7_token_counts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and n_tokens, through flat token files and a scan of them."""
    written = write_tokens(docs)
    files = written.groupBy("file").agg(F.max("written").alias("size"))
    # Stored, a document takes a few bytes, which says nothing of its rows in memory: both sides are
    # as long as the corpus, so that neither may be broadcast.
    counted = count_tokens(files).hint("merge")
    return written.select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
