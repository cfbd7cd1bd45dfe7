"""Completeness of files and agreement of row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.schemas import ROOT_TAG, ROW_TAG
from ledgerleaf.sources.markup import OUTSIDE, ends_in, visible
from ledgerleaf.sources.xml import has_record

# How a file of XML records is read.
CUT, JOINED, WHOLE = "cut", "joined", "whole"


def closes_root(chunk: Column, root_tag: str = ROOT_TAG) -> Column:
    return chunk.contains(f"</{root_tag}>")


def is_complete(lines: DataFrame, column: str, root_tag: str = ROOT_TAG) -> bool:
    """Whether any line of one file closes the root; stops at the first that does."""
    return bool(lines.filter(closes_root(F.col(column), root_tag)).take(1))


def file_status(
    chunks: DataFrame, root_tag: str = ROOT_TAG, row_tag: str = ROW_TAG
) -> DataFrame:
    """Per file: does its text close the root, records found, and the form to read it in.

    One pass over the text for all files; each task sends one row per file. ``cuttable``:
    the plain text can be cut at row tags; a comment or a CDATA section could hold a tag.
    ``form``: CUT, also if every section ends in the chunk in which it begins; JOINED if
    one does not, in which case the other columns hold for joined chunks only; WHOLE where
    opening tags and records differ in number.
    """
    chunk = F.col("chunk")
    text = visible(chunk)
    records = F.count_if(has_record(text, row_tag))
    openings = F.sum(F.regexp_count(text, F.lit(rf"<{row_tag}[\s/>]")))
    hidden = F.bool_or(chunk.contains("<!--") | chunk.contains("<![CDATA["))
    torn = F.bool_or(ends_in(chunk) != OUTSIDE)
    return chunks.groupBy("FILE_NAME").agg(
        F.bool_or(closes_root(text, root_tag)).alias("complete"),
        records.alias("records"),
        ((records == openings) & ~hidden).alias("cuttable"),
        F.when(torn, JOINED).when(records == openings, CUT).otherwise(WHOLE).alias("form"),
    )


def read_in_full(chunks: DataFrame, row_tag: str = ROW_TAG) -> DataFrame:
    """Per file of a read that skips what is unreadable: FILE_NAME and whether nothing is lacking.

    Every byte of a file is in a chunk or in the tag after it.
    """
    tag = len(f"</{row_tag}>".encode())
    seen = F.sum(F.octet_length("chunk") + F.lit(tag))
    files = chunks.groupBy("FILE_NAME", "file").agg((seen >= F.max("file_size")).alias("readable"))
    return files.groupBy("FILE_NAME").agg(F.bool_and("readable").alias("readable"))


def row_counts(df: DataFrame, alias: str = "ROW_CNT") -> DataFrame:
    """Rows per file; combines before the shuffle, so a huge file is no hot group."""
    return df.groupBy("FILE_NAME", "FILE_DATE").agg(F.count(F.lit(1)).alias(alias))


def agreement(delivered: Column, held: Column) -> Column:
    """The state of two counts: ``success`` where they are equal, else ``fail``."""
    return F.when(delivered == held, "success").otherwise("fail")


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target counts by file, ``success`` where they agree, else ``fail``.

    Both sides are counts (FILE_NAME, FILE_DATE, ROW_CNT), one row per file. A file
    that one side lacks has no count there and fails.
    """
    left = source.withColumnRenamed("ROW_CNT", "source_count").alias("s")
    right = target.withColumnRenamed("ROW_CNT", "target_count").alias("t")
    same_file = F.col("s.FILE_NAME").eqNullSafe(F.col("t.FILE_NAME")) & F.col(
        "s.FILE_DATE"
    ).eqNullSafe(F.col("t.FILE_DATE"))
    return left.join(right, same_file, "full").select(
        F.coalesce("s.FILE_NAME", "t.FILE_NAME").alias("FILE_NAME"),
        F.coalesce("s.FILE_DATE", "t.FILE_DATE").alias("FILE_DATE"),
        "source_count",
        "target_count",
        agreement(F.col("source_count"), F.col("target_count")).alias("count_state"),
    )


def row_prints(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per file and a print of their content that does not depend on their order.

    The print is the sum and the exclusive or of two hashes of each row, so equal rows count as
    often as they occur. It combines before the shuffle, like a count. ``columns`` limits the
    rows to what both sides of a comparison hold; the file's name and date are in it anyway.
    """
    chosen = sorted(columns or [name for name in df.columns if name not in ("FILE_NAME", "FILE_DATE")])
    # Nulls have no part in a hash: where they are is one more value.
    gaps = F.concat(*[F.when(F.col(name).isNull(), "1").otherwise("0") for name in chosen])
    one, other = (F.xxhash64(F.lit(seed), gaps, *chosen) for seed in (1, 2))
    return df.groupBy("FILE_NAME", "FILE_DATE").agg(
        F.count(F.lit(1)).alias("ROW_CNT"),
        F.concat_ws("/", F.sum(one.cast("decimal(20,0)")), F.hex(F.bit_xor(other))).alias("PRINT"),
    )


def reconcile_content(source: DataFrame, target: DataFrame) -> DataFrame:
    """``reconcile`` with a content_state, ``success`` if both sides hold the same rows.

    Both sides are ``row_prints``. Equal counts with other content fail in content_state alone.
    """
    prints = [
        side.select("FILE_NAME", "FILE_DATE", F.col("PRINT").alias(name))
        for side, name in ((source, "source_print"), (target, "target_print"))
    ]
    counts = reconcile(source.drop("PRINT"), target.drop("PRINT")).alias("c")
    for side, name in zip(prints, ("s", "t"), strict=True):
        same = F.col("c.FILE_NAME").eqNullSafe(F.col(f"{name}.FILE_NAME")) & F.col("c.FILE_DATE").eqNullSafe(
            F.col(f"{name}.FILE_DATE")
        )
        counts = counts.join(side.alias(name), same, "left").select("c.*", side.columns[-1]).alias("c")
    state = agreement(F.col("source_print"), F.col("target_print")).alias("content_state")
    return counts.select(
        "FILE_NAME", "FILE_DATE", "source_count", "target_count", "count_state", state
    )


def preview(df: DataFrame, rows: int, order_by: str) -> DataFrame:
    """The first rows in a stated order; each task sends at most that many."""
    return df.orderBy(order_by).limit(rows)
