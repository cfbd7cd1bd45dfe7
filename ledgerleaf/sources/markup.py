"""Comments and CDATA sections in XML text that is cut at closing row tags.

A section may hide a row tag, so a chunk of the cut text may begin inside one. What a chunk
does is a function of three states: it begins outside, in a comment or in CDATA, and ends in
one of them. These functions are composed within each block of a file, in one pass over its
chunks' functions in order, and then over the blocks of the file, whose number is small. So every chunk's state
is known without reading a file in one task, and only chunks that a section cuts apart are
brought together again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.schemas import ROW_TAG
from ledgerleaf.sources.xml import file_name
from ledgerleaf.workdir import staged

OUTSIDE, COMMENT, CDATA = range(3)

# What opens and closes the two kinds of sections.
_OPENER = {COMMENT: "<!--", CDATA: "<![CDATA["}
_CLOSER = {COMMENT: "-->", CDATA: "]]>"}
# An open section reaches to the end of the text.
_SECTION = r"<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)"
_CLOSED = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>"
_PLAIN = r"<(?!!--|!\[CDATA\[)[^<]*|[^<]+"
_IDENTITY = [OUTSIDE, COMMENT, CDATA]


def _begun(chunk: Column, state: Column | None) -> Column:
    """The chunk with the opener of the section it begins in."""
    if state is None:
        return chunk
    opener = F.when(state == COMMENT, _OPENER[COMMENT]).when(state == CDATA, _OPENER[CDATA])
    return F.concat(F.coalesce(opener, F.lit("")), chunk)


def _escaped(section: Column) -> Column:
    """The content of a CDATA section as ordinary text."""
    size = len(_OPENER[CDATA])
    closed = section.endswith(_CLOSER[CDATA])
    length = F.length(section) - size - F.when(closed, len(_CLOSER[CDATA])).otherwise(0)
    text = F.substring(section, F.lit(size + 1), length)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def visible(chunk: Column, state: Column | None = None) -> Column:
    """The chunk without comments, and with CDATA as escaped text.

    ``state`` is that in which the chunk begins, outside if not given.
    """
    text = _begun(chunk, state)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){_SECTION}|{_PLAIN}"), F.lit(0))

    def shown(piece: Column) -> Column:
        comment, cdata = (piece.startswith(_OPENER[kind]) for kind in (COMMENT, CDATA))
        return F.when(comment, "").when(cdata, _escaped(piece)).otherwise(piece)

    return F.when(text.contains("<!"), F.array_join(F.transform(pieces, shown), "")).otherwise(text)


def ends_in(chunk: Column, state: Column | None = None) -> Column:
    """The state in which a chunk ends that begins in ``state``."""
    text = _begun(chunk, state)
    # Of what closed sections leave, the first opener is that of the open one.
    left = F.regexp_replace(text, F.lit(f"(?s){_CLOSED}"), F.lit(" "))
    opener = F.regexp_extract(left, "<!--|<!\\[CDATA\\[", 0)
    found = F.array_position(F.array(F.lit(_OPENER[COMMENT]), F.lit(_OPENER[CDATA])), opener).cast("int")
    return F.when(text.contains("<!"), found).otherwise(OUTSIDE)


def placed_chunks(
    spark: SparkSession, paths: str | list[str], row_tag: str = ROW_TAG, name: Column | None = None
) -> DataFrame:
    """FILE_NAME, file, block, id and chunk; ids ascend within a block of a file.

    Ids hold for one read only: store these rows before using them twice.
    """
    lines = spark.read.option("lineSep", f"</{row_tag}>").text(paths)
    return lines.select(
        (file_name() if name is None else name).alias("FILE_NAME"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("chunk"),
    )


_ENDS = "array<struct<state: int, lead: bigint>>"


def _composed_maker():
    import pyarrow as pa

    def composed(batches: Iterator) -> Iterator:
        """Of marks in order, what a block does from its begin to each of them, for each state."""
        at, ends = None, []
        for batch in batches:
            found = []
            rows = zip(*[batch.column(name).to_pylist() for name in ("file", "block", "id", "to")], strict=True)
            for file, block, mark, to in rows:
                if (file, block) != at:
                    at, ends = (file, block), [(state, None) for state in range(len(to))]
                ends = [(to[state], mark if state == 0 else lead) for state, lead in ends]
                found.append([{"state": state, "lead": lead} for state, lead in ends])
            kind = pa.list_(pa.struct([("state", pa.int32()), ("lead", pa.int64())]))
            columns = [batch.column(name) for name in ("file", "block", "id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=["file", "block", "id", "ends"])

    return composed


def hidden_spans(placed: DataFrame) -> DataFrame:
    """Chunks that belong together: id, the state in which it begins, and the first one's id.

    A chunk that ends in a section leads the ones after it, up to that in which all sections
    are closed. Chunks that stand alone are left out. Marks, the chunks that may open or close
    a section, are gone over once in the order of their block, so the work is in proportion to
    their number, and no block's marks meet in one row.
    """
    # A chunk does nothing to the state unless it opens or closes a section.
    chunk, where = F.col("chunk"), ["file", "block"]
    signs = [chunk.contains(sign) for sign in ("<!", *_CLOSER.values())]
    to = F.array(*[ends_in(chunk, F.lit(state)) for state in _IDENTITY])
    marks = placed.filter(signs[0] | signs[1] | signs[2]).select(*where, "id", to.alias("to"))
    in_order = marks.repartition(*where).sortWithinPartitions(*where, "id")
    composed = staged(
        in_order.mapInArrow(_composed_maker(), f"file string, block bigint, id bigint, ends {_ENDS}"), "settlement-marks"
    )
    nothing = ", ".join(f"named_struct('state', {state}, 'lead', cast(NULL AS bigint))" for state in _IDENTITY)
    whole = composed.groupBy(*where).agg(F.max_by("ends", "id").alias("ends"))
    bounds = placed.groupBy(*where).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    blocks = bounds.join(whole, where, "left").withColumn("ends", F.coalesce("ends", F.expr(f"array({nothing})")))
    # Over the blocks of a file, one row each: the state in which each one begins, and the first
    # chunk of the section that is open there.
    scan = (
        "aggregate(parts, named_struct('at', cast(array() AS array<struct<block: bigint, state: int, lead: bigint, "
        "low: bigint, high: bigint>>), 'state', 0, 'lead', cast(NULL AS bigint)), (a, b) -> named_struct("
        "'at', concat(a.at, array(named_struct('block', b.block, 'state', a.state, 'lead', a.lead, "
        "'low', b.low, 'high', b.high))), "
        "'state', b.ends[a.state].state, 'lead', coalesce(b.ends[a.state].lead, a.lead))).at"
    )
    starts = staged(
        blocks.groupBy("file")
        .agg(F.sort_array(F.collect_list(F.struct("block", "ends", "low", "high"))).alias("parts"))
        .select("file", F.explode(F.expr(scan)).alias("start"))
        .select("file", "start.*"),
        "settlement-blocks",
    )
    # Each mark's outcome holds for the chunks up to the next mark, that of a block's begin to the first.
    own = F.get("ends", F.col("state"))
    outcomes = composed.join(starts, where).select(
        *where, "high", F.col("id").alias("after"), own["state"].alias("state"), F.coalesce(own["lead"], "lead").alias("lead")
    )
    begins = starts.select(*where, "high", (F.col("low") - 1).alias("after"), "state", "lead")
    until = F.lead("after").over(Window.partitionBy(*where).orderBy("after"))
    runs = outcomes.unionByName(begins).withColumn("until", F.coalesce(until, "high"))
    inner = runs.filter((F.col("state") != OUTSIDE) & (F.col("after") < F.col("until"))).select(
        F.explode(F.sequence(F.col("after") + 1, "until")).alias("id"), "state", "lead"
    )
    # The chunk before an open section's first inner one is its lead, once for each section.
    leads = inner.select(F.col("lead").alias("id"), F.lit(OUTSIDE).alias("state"), "lead").distinct()
    return inner.unionByName(leads)


def joined_chunks(placed: DataFrame, spans: DataFrame, row_tag: str = ROW_TAG) -> DataFrame:
    """FILE_NAME and chunk: the text cut at the row tags that no section hides, all visible.

    Both frames are to be stored ones. What a comment hides is gone before chunks are brought
    together, so only the text of one record meets in one row. The text meets its spans once,
    whatever is done with the result.
    """
    told = staged(placed.join(spans, "id", "left"), "settlement-told")
    chunk, state = F.col("chunk"), F.col("state")
    alone = told.filter(F.col("lead").isNull()).select("FILE_NAME", visible(chunk).alias("chunk"))
    # The row tag that a CDATA section holds is part of its text.
    tag = F.when(state == CDATA, f"&lt;/{row_tag}&gt;").otherwise("")
    parts = told.filter(F.col("lead").isNotNull()).select(
        "FILE_NAME", "file", "lead", "block", "id", F.concat(tag, visible(chunk, state)).alias("text")
    )
    whole = (
        parts.filter(F.length("text") > 0)
        .groupBy("FILE_NAME", "file", "lead")
        .agg(F.sort_array(F.collect_list(F.struct("block", "id", "text"))).alias("parts"))
        .select("FILE_NAME", F.array_join("parts.text", "").alias("chunk"))
    )
    return alone.unionByName(whole)
