"""XML records, one per row tag.

``xml_chunks`` reads files as text cut after each closing row tag. Spark splits such
a read at any size, so one huge file is many tasks; ``read_xml`` needs one task per
file. The cut form assumes that row tags do not nest, do not close themselves and have no
space in the closing tag. Comments and CDATA sections go through ``markup``, which also
joins what a section with a row tag in it cuts apart. ``operators.quality.file_status``
tells per file which form holds; a file where none does goes through ``read_xml``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.schemas import ROW_TAG

_BROKEN = "_broken_record"


def file_name() -> Column:
    """The file's own name: ``_metadata`` holds it with URL escapes (but a bare ``+``)."""
    escaped = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(escaped)


def xml_chunks(
    spark: SparkSession,
    paths: str | list[str],
    row_tag: str = ROW_TAG,
    name: Column | None = None,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Columns FILE_NAME and chunk; with ``skip_unreadable`` file and file_size too.

    ``name`` gives the file's name where a delivery is a folder of parts and not one
    file: a partition column of the read, or an expression on ``_metadata``. With
    ``skip_unreadable`` a file that breaks a read ends where it does so, without an error.
    """
    name = file_name() if name is None else name
    lines = spark.read.option("lineSep", f"</{row_tag}>").option("ignoreCorruptFiles", skip_unreadable)
    source = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size")]
    columns = [name.alias("FILE_NAME"), F.col("value").alias("chunk"), *(source if skip_unreadable else [])]
    return lines.text(paths).select(*columns)


def has_record(chunk: Column, row_tag: str = ROW_TAG) -> Column:
    return chunk.rlike(rf"<{row_tag}[\s>]")


def _with_broken(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])


def xml_records(
    chunks: DataFrame, schema: T.StructType, row_tag: str = ROW_TAG
) -> DataFrame:
    """FILE_NAME, the record's fields, REJECTED and REJECT_TEXT.

    A field that a record lacks is null. A record that does not parse is REJECTED and
    comes with its text.
    """
    body = F.regexp_extract("chunk", rf"(?s)<{row_tag}[\s>].*", 0)
    record = F.from_xml(
        F.concat(body, F.lit(f"</{row_tag}>")),
        _with_broken(schema).simpleString(),
        {"columnNameOfCorruptRecord": _BROKEN},
    )
    broken = F.col(f"record.{_BROKEN}")
    return (
        chunks.filter(has_record(F.col("chunk"), row_tag))
        .select("FILE_NAME", record.alias("record"))
        .select(
            "FILE_NAME",
            *[f"record.{field}" for field in schema.names],
            broken.isNotNull().alias("REJECTED"),
            broken.alias("REJECT_TEXT"),
        )
    )


def read_xml(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType,
    row_tag: str = ROW_TAG,
    name: Column | None = None,
) -> DataFrame:
    """The same rows by the XML reader, one task per file.

    Here a rejected record has no text: the reader would give that of the whole file.
    """
    name = file_name() if name is None else name
    reader = spark.read.schema(_with_broken(schema)).option("rowTag", row_tag)
    rows = reader.option("columnNameOfCorruptRecord", _BROKEN).xml(paths)
    # Spark refuses a read of the column of broken records alone.
    any_text = F.length(F.coalesce(F.col(schema.names[0]).cast("string"), F.lit(""))) >= 0
    return rows.select(
        name.alias("FILE_NAME"),
        *schema.names,
        (F.col(_BROKEN).isNotNull() & any_text).alias("REJECTED"),
        F.lit(None).cast("string").alias("REJECT_TEXT"),
    )
