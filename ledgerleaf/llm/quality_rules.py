"""Quality rules whose cutoffs follow the data: quantile sketches per language and source.

Every text is measured whole. Each measure goes into a sketch of logarithmic buckets
(relative error ``ACCURACY``) per language and source; such sketches merge by adding
counts, so they combine before the shuffle, do not depend on the order of rows, and those
of small groups are merged up to their language and to all rows. A cutoff is the median
plus ``SPREAD`` times the distance between the quartiles, and at least the measure's
``SLACK``. The cutoffs are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.tables import row_of, stored
from ledgerleaf.llm.words import Words, plain_texts, slices, span_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ACCURACY = 0.01
SPREAD = 6.0
# Sketches of fewer documents are merged up.
LEAST_DOCUMENTS = 50
# What a document may always have of each measure: the share of words.
SLACK = {"symbols": 0.10, "dup_lines": 0.40, "repeats": 0.40}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_CODES = np.random.default_rng(77).integers(0, 2**64, 256, np.uint64)


def _seen_before(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: does its value occur again in its group; does it occur earlier."""
    order = np.lexsort((value, group))
    same = np.zeros(len(order), bool)
    same[1:] = (group[order][1:] == group[order][:-1]) & (value[order][1:] == value[order][:-1])
    again, earlier = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order] = same
    again[order] = same
    again[order[:-1]] |= same[1:]
    return again, earlier


def _sum_per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, null taken for empty."""
    words = Words(text)
    data, bounds = words.data, words.bounds
    inside = np.zeros(len(data) + 1, np.int64)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    inside = np.cumsum(inside)[:-1].astype(bool)
    counts = {
        "n_words": words.counts,
        # Bytes that go on a code point do not count.
        "word_chars": _sum_per_text(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _sum_per_text(_SYMBOL[data], bounds),
    }

    # Lines: from each text's begin or line feed to the next line feed or text's end.
    feeds = np.flatnonzero(data == 10)
    line_of = np.searchsorted(bounds, feeds, "right") - 1
    texts = np.arange(len(bounds) - 1)
    starts = np.concatenate([bounds[:-1], feeds + 1])
    owners = np.concatenate([texts, line_of])
    order = np.lexsort((starts, owners))
    starts, owners = starts[order], owners[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.append(owners[1:] != owners[:-1], True)[: len(owners)]
    ends[last] = bounds[1:][owners[last]]
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owners = starts[with_word], ends[with_word], owners[with_word]
    _, earlier = _seen_before(owners, span_hashes(_LINE_CODES[data], starts, ends))
    counts["n_dup_lines"] = np.bincount(owners[earlier], minlength=len(texts))
    counts["n_lines"] = np.bincount(owners, minlength=len(texts))

    # Three-word windows of one text that occur in it again.
    owner = words.text_of_word()
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    again, _ = _seen_before(owner[at], span_hashes(words.hashes(), at, at + 3))
    repeated = np.zeros(len(words), bool)
    for step in range(3):
        repeated[at[again] + step] = True
    counts["n_repeat_words"] = _sum_per_text(repeated, words.first)
    return counts


_COUNTS_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])


@F.arrow_udf(_COUNTS_TYPE)
def measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A struct of the counts of a text column."""
    for batch in texts:
        batch = plain_texts(batch)
        parts = [measure(batch.slice(a, b - a)) for a, b in slices(batch)] or [measure(batch)]
        columns = [pa.array(np.concatenate([p[n] for p in parts]), pa.int64()) for n in COUNTS]
        yield pa.StructArray.from_arrays(columns, names=list(COUNTS))


def base_failed() -> Column:
    repeats = F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeats


def shares() -> dict[str, Column]:
    """The measures that get cutoffs; null where there is nothing to measure."""
    words = F.nullif("n_words", F.lit(0))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.nullif("n_lines", F.lit(0)),
        "repeats": F.col("n_repeat_words") / words,
    }


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts per language, source and measure: lang, source, measure, bucket, n."""
    width = float(np.log((1 + ACCURACY) / (1 - ACCURACY)))
    values = [F.struct(F.lit(name).alias("measure"), v.alias("value")) for name, v in shares().items()]
    rows = measured.select("lang", "source", F.explode(F.array(*values)).alias("m"))
    # The lowest bucket is for zero.
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / F.lit(width)))
    return (
        rows.filter("m.value is not null")
        .groupBy("lang", "source", "m.measure", F.coalesce(bucket, F.lit(-1 << 20)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _cutoffs_of(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the number of documents and each quartile of the merged sketches."""
    ratio = (1 + ACCURACY) / (1 - ACCURACY)
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    value = F.when(F.col("bucket") == F.lit(-1 << 20), F.lit(0.0)).otherwise(
        F.lit(2 / (ratio + 1)) * F.pow(F.lit(ratio), F.col("bucket"))
    )
    buckets = F.array_sort(F.collect_list(F.struct("bucket", value.alias("value"), "n")))
    grouped = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("total"), buckets.alias("buckets"))

    def quantile(q: float) -> Column:
        def step(seen, x):
            reached = F.when(
                seen["value"].isNull() & (seen["n"] + x["n"] >= F.lit(q) * F.col("total")), x["value"]
            ).otherwise(seen["value"])
            return F.struct((seen["n"] + x["n"]).alias("n"), reached.alias("value"))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("value"))
        return F.aggregate("buckets", start, step)["value"]

    low, middle, high = (quantile(q) for q in (0.25, 0.5, 0.75))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("measure"))
    cutoff = F.greatest(middle + F.lit(SPREAD) * (high - low), slack)
    return grouped.select(*keys, "measure", "total", cutoff.alias("cutoff"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per language and source with a ``max_<measure>`` for each measure.

    A group of fewer than ``LEAST_DOCUMENTS`` takes its language's cutoffs, such a
    language those of all rows.
    """
    narrow = _cutoffs_of(sketch, ["lang", "source"])
    by_lang = _cutoffs_of(sketch, ["lang"]).withColumnsRenamed(
        {"total": "lang_total", "cutoff": "lang_cutoff", "lang": "lang_"}
    )
    overall = _cutoffs_of(sketch, []).select("measure", F.col("cutoff").alias("all_cutoff"))
    enough = F.lit(LEAST_DOCUMENTS)
    chosen = (
        F.when(F.col("total") >= enough, F.col("cutoff"))
        .when(F.col("lang_total") >= enough, F.col("lang_cutoff"))
        .otherwise(F.col("all_cutoff"))
    )
    joined = narrow.join(
        by_lang.withColumnRenamed("measure", "measure_"),
        F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("measure") == F.col("measure_")),
    ).join(overall, "measure")
    return joined.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == name, chosen)).alias(f"max_{name}") for name in SLACK]
    )


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with lang, source and the counts.

    ``limits`` comes from ``cutoffs``; null languages and sources are groups of their own.
    A stored table of limits is broadcast if Spark finds it small.
    """
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(
        limits,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    passed = F.lit(True)
    for name, share in shares().items():
        passed = passed & ~F.coalesce(share > F.col(f"max_{name}"), F.lit(False))
    return joined.withColumns({"base_failed": base_failed()}).withColumns(
        {"kept": ~F.col("base_failed") & passed}
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all the columns and rows they came with.

    Needs text, lang and source; null texts count as empty and fail. Texts are measured
    twice, once for the sketches and once in place, so that they are not shuffled.
    """
    rows = docs.select(
        row_of(docs).alias("row"),
        "lang",
        "source",
        measures(F.col("text")).alias("m"),
    ).select("row", "lang", "source", "m.*")
    limits = stored(cutoffs(sketches(rows.drop("row"))), "cutoffs")
    return verdicts(rows, limits).filter("kept").select("row.*")


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, n_lines, base_failed and kept."""
    rows = docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m"))
    measured = stored(rows.select("doc_id", "lang", "source", "m.*"), "measures")
    limits = stored(cutoffs(sketches(measured)), "cutoffs")
    return verdicts(measured, limits).select("doc_id", *COUNTS, "base_failed", "kept")
