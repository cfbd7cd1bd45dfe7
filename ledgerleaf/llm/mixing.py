"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order, up to ``EPOCHS`` times over. A copy's
virtual finish time is the number of its source's words up to its end divided by the source's
target, so all sources reach their targets at time 1. The copies are sorted by that time over
all sources and the mix ends at time 1, which is the total budget; a copy that stands across
the end is cut there.

Words up to a document are counted in two steps: sums of buckets of the shuffled order, then
sums within a bucket. There are as many buckets as the root of the number of rows, so neither
step has a large group, whatever a source's share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import row_marks, row_of, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source of ``sized`` (source, size): source_no, source_size, target.

    Sources in the order of their code points, null last, weigh 5, 2, 1, 5 and so on. The
    budget is the sum of all sizes. A source whose share would be above ``EPOCHS`` times its
    size gets that much, and the others share the rest by weight: taken in the order of
    EPOCHS * size / weight, such sources come first.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    ranked = sums.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    most = F.lit(EPOCHS) * F.col("source_size")
    order = Window.orderBy(most / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything)
    before = F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1))
    weight_on = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (budget - F.coalesce(before, F.lit(0))) / weight_on).withColumn(
        "place", F.row_number().over(order)
    )
    open_ = F.col("level") * F.col("weight") <= most
    # The first source that is not held back has the level of all that follow.
    first = F.min(F.when(open_, F.struct("place", "level"))).over(everything)
    target = F.when(F.col("place") < first["place"], most.cast("double")).otherwise(first["level"] * F.col("weight"))
    return levels.select("source", "source_no", "source_size", target.alias("target"))


def queue(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (any columns, text and source among them) in the mix.

    Gives mark1 and mark2 (hashes of the row), doc_id, mark (its place in the shuffled order) and
    ``queue``: size, source_size, target, start (words of its source before it in the
    shuffled order), finish (virtual time) of its first copy, and taken, the words of each of
    its copies that the mix takes. Null and empty texts have size 0, null sources are one
    source. The order follows a digest of doc_id and text, so another
    run gives the same; rows that are alike in both can stand for each other.
    """
    mark = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = stored(
        docs.select(
            "source",
            size_of(F.col("text")).alias("size"),
            mark.alias("mark"),
            "doc_id",
            *row_marks(docs),
        ),
        "sizes",
    )
    buckets = max(1, math.isqrt(rows.count()))
    known = stored(targets(rows), "targets").withColumnRenamed("source", "source_")
    high = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    numbered = rows.join(known, F.col("source").eqNullSafe(F.col("source_"))).withColumn(
        "bucket", (high * F.lit(buckets) / F.lit(2.0**32)).cast("long")
    )
    in_source = Window.partitionBy("source_no").orderBy("bucket")
    offsets = (
        numbered.groupBy("source_no", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("source_no", "bucket", (F.sum("words").over(in_source) - F.col("words")).alias("words_before"))
    )
    in_bucket = Window.partitionBy("source_no", "bucket").orderBy("mark", "size")
    inside = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = numbered.withColumn("inside", inside).join(stored(offsets, "offsets"), ["source_no", "bucket"])
    start = F.col("words_before") + F.col("inside")
    budget = F.floor(F.col("target") + 0.5)
    left = [budget - start - F.lit(e) * F.col("source_size") for e in range(EPOCHS)]
    taken = F.array(*[F.greatest(F.lit(0).cast("long"), F.least("size", n)) for n in left])
    return placed.select(
        "doc_id",
        "mark",
        "mark1",
        "mark2",
        F.struct(
            "size",
            "source_size",
            "target",
            start.alias("start"),
            ((start + F.col("size")) / F.nullif("target", F.lit(0.0))).alias("finish"),
            taken.alias("taken"),
        ).alias("queue"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its first ``n`` words."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself in the order of virtual finish times, with the columns of ``docs``.

    A document comes once per copy that is taken; the copy at the end of its source's share
    keeps its first words only; its other columns stay as they are. Documents without words
    are not taken.
    """
    queued = queue(docs)
    copies = queued.select("mark1", "mark2", "mark", "queue", F.posexplode("queue.taken").alias("copy", "words")).filter("words > 0")
    finish = (F.col("queue.start") + F.col("words") + F.col("copy") * F.col("queue.source_size")) / F.col("queue.target")
    slim = copies.select(
        "mark1",
        "mark2",
        F.struct(finish.alias("finish"), "mark", "copy").alias("_time"),
        F.when(F.col("words") < F.col("queue.size"), F.col("words")).alias("_words"),
    )
    # Rows that are alike are one row here, and as many in the queue.
    one = docs.select(*row_marks(docs), row_of(docs).alias("row")).groupBy("mark1", "mark2").agg(F.first("row").alias("row"))
    joined = one.join(stored(slim, "copies"), ["mark1", "mark2"]).orderBy("_time")
    text = F.col("row.text")
    cut = F.when(F.col("_words").isNull(), text).otherwise(first_words(text, F.col("_words")))
    return joined.select(*[cut.alias(n) if n == "text" else F.col(f"row.`{n}`") for n in docs.columns])


def op6_mixing(docs: DataFrame) -> DataFrame:
    """Per row, by virtual finish time: doc_id, size, source_size, target, taken and the time."""
    queued = queue(docs.select("doc_id", "text", "source"))
    taken = F.aggregate("queue.taken", F.lit(0).cast("long"), lambda a, x: a + x)
    return queued.select(
        "doc_id",
        "queue.size",
        "queue.source_size",
        "queue.target",
        taken.alias("taken"),
        F.col("queue.finish").alias("finish"),
    ).orderBy("finish", "doc_id")
