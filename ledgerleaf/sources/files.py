"""CSV, Parquet and catalog tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value in the card files.
MISSING = [
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header that must equal the schema's names in number and order.

    Without ``enforceSchema=False`` the header is ignored and an added column would
    shift all that follow. Quotes inside a quoted value are doubled; a backslash is a
    character like any other.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("escape", '"').csv(path)


def read_csv_by_name(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    missing: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """CSV whose columns are found by header name, in any order.

    Declared columns come first with their types, further ones follow as text. One call
    takes files of one header; ``read_csv_files`` takes files of several.
    Texts listed in ``missing`` become null. Quotes inside a quoted value are doubled.
    Values with line breaks need ``multi_line``, which makes each file one task.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    raw = reader.option("escape", '"').option("multiLine", multi_line).csv(path)
    absent = [name for name in schema.names if name not in raw.columns]
    if absent:
        raise ValueError(f"columns missing from {path}: {', '.join(absent)}")

    def value(name: str):
        column = F.col("`" + name.replace("`", "``") + "`")
        return F.when(~column.isin(*missing), column) if missing else column

    declared = [value(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    others = [value(name).alias(name) for name in raw.columns if name not in schema.names]
    return raw.select(*declared, *others)


def _decoded(path: Column) -> Column:
    """A path of ``_metadata`` as a reader takes it: without URL escapes (a bare ``+`` is none)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per header line: header, and files, the paths of the files that begin with it.

    One job for all files. A task sends the first line of each file whose beginning it reads;
    the rest of the text is scanned as lines and not parsed. An empty file has no header.
    """
    source = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    ]
    begins = spark.read.text(path).select(*source).filter(F.col("block") == 0)
    headers = begins.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    # A mark of the byte order and the carriage return of a line's end are not part of a name.
    header = F.regexp_replace("header", "^\ufeff|\r$", "")
    files = F.sort_array(F.collect_list(_decoded(F.col("file")))).alias("files")
    return headers.groupBy(header.alias("header")).agg(files)


def read_csv_files(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    missing: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """CSV files that may differ in the number and order of their columns, found by name.

    Files of one header are read together, and the groups united by name: declared columns
    first with their types, which every file has to have, then all further columns of any file
    as text, in the order of their names, null where a file lacks them. Names with line breaks
    are not supported.
    """
    groups = csv_headers(spark, path).collect()
    if not groups:
        return spark.createDataFrame([], schema)
    parts = [read_csv_by_name(spark, row.files, schema, missing, multi_line) for row in groups]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    others = sorted(set(whole.columns) - set(schema.names))
    return whole.select(*[F.col("`" + name.replace("`", "``") + "`") for name in [*schema.names, *others]])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
