"""Settlement files to a partitioned table, with audit: many files in one job.

Order of work: names and completeness, then all records parsed once into a staged table,
and from there the table, the rejects, the database copy and the logs. The two targets share
no transaction, so the one whose load can be repeated without effect (the table) goes first.

A file's text is scanned twice: to inspect it and to parse it. Files in which a comment or a
CDATA section hides a row tag are staged as text in between. A file that cannot be read fails
alone; any other failure is none of the files' and is not tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import functions as fn
from ledgerleaf.operators import (
    CUT,
    JOINED,
    WHOLE,
    agreement,
    daily_audit,
    file_status,
    load_log,
    local_moment,
    read_in_full,
    table_log,
)
from ledgerleaf.schemas import (
    SETTLEMENT_DECIMALS,
    SETTLEMENT_RECORD,
    SETTLEMENT_TEXT_COLUMNS,
)
from ledgerleaf.sinks import append_jdbc, append_table, drop_partitions, replace_table_partitions
from ledgerleaf.sources import (
    absent_paths,
    base_name,
    count_by_file_sql,
    hidden_spans,
    is_file_fault,
    joined_chunks,
    message,
    placed_chunks,
    read_jdbc_query,
    read_xml,
    select_settlement_files,
    visible,
    without_faulty,
    xml_chunks,
    xml_records,
)
from ledgerleaf.workdir import staged

PARTITIONS = ["TRN_DATE", "FILE_NAME"]

OUTCOME = (
    "FILE_NAME string, FILE_DATE date, source_count bigint, target_count bigint, "
    "rejected_count bigint, error string"
)


class LoadFailed(Exception):
    """Some files were not loaded; raised after all others are done and logged."""


@dataclass
class JdbcTarget:
    url: str
    table: str
    properties: dict[str, str] = field(repr=False)


@dataclass
class LogNames:
    job_name: str
    dag_id: str
    task_id: str


def settlement_rows(records: DataFrame, run_date: Column, mask_cards: bool = True) -> DataFrame:
    """The 32 target columns; amounts are still text."""
    texts = [
        F.col(f"FLD_{number:03d}").alias(name)
        for number, name in enumerate(SETTLEMENT_TEXT_COLUMNS, start=4)
    ]
    rows = records.select(
        fn.parse_compact_date(F.col("FLD_001")).alias("STTL_DATE"),
        fn.parse_compact_date(F.col("FLD_002")).alias("TRN_DATE"),
        fn.parse_compact_datetime(F.col("FLD_002"), F.col("FLD_003")).alias("TRN_TIME"),
        *texts,
        "FILE_NAME",
        run_date.alias("INSERT_DATE"),
        fn.file_date(F.col("FILE_NAME")).alias("FILE_DATE"),
    )
    if mask_cards:
        rows = rows.withColumn("CARD_NUMBER", fn.mask_card(F.col("CARD_NUMBER")))
    return rows


def with_decimals(rows: DataFrame) -> DataFrame:
    """Amount and fees as decimal(38,10), for the table copy."""
    return rows.withColumns({name: fn.to_decimal(F.col(name)) for name in SETTLEMENT_DECIMALS})


def settlement_records(
    spark: SparkSession,
    cut: Sequence[str],
    whole: Sequence[str] = (),
    name: Column | None = None,
    joined: DataFrame | None = None,
) -> DataFrame:
    """Records of files read in cut form, of joined chunks, and of files that need the whole-file reader."""
    parts = []
    if cut:
        chunks = xml_chunks(spark, list(cut), name=name)
        parts.append(xml_records(chunks.withColumn("chunk", visible(F.col("chunk"))), SETTLEMENT_RECORD))
    if joined is not None:
        parts.append(xml_records(joined, SETTLEMENT_RECORD))
    if whole:
        parts.append(read_xml(spark, list(whole), SETTLEMENT_RECORD, name=name))
    return reduce(DataFrame.unionByName, parts)


def joined_text(spark: SparkSession, paths: list[str], name: Column | None = None) -> DataFrame:
    """FILE_NAME and chunk of files in which sections hide row tags."""
    placed = staged(placed_chunks(spark, paths, name=name), "settlement-text")
    return joined_chunks(placed, staged(hidden_spans(placed), "settlement-spans"))


@dataclass
class Inspection:
    """``files``: one row per path: path, FILE_NAME, FILE_DATE, records, cuttable, form, error.
    ``joined``: the text of the files of that form, None if there are none.
    """

    files: list[Row]
    joined: DataFrame | None


def _scan(
    spark: SparkSession, paths: list[str], name: Column | None, name_of: Callable[[str], str]
) -> tuple[dict[str, dict], dict[str, str]]:
    """Status of the files by name, and the error of each path that cannot be read.

    If one file breaks the scan, a second scan skips what is unreadable and tells, for all
    of them at once, which files it could not read to their end.
    """

    def by_name(rows: DataFrame) -> dict[str, dict]:
        return {row.FILE_NAME: row.asDict() for row in rows.collect()}

    try:
        return by_name(file_status(xml_chunks(spark, paths, name=name))), {}
    except Exception as problem:
        if not is_file_fault(problem):
            raise
    faults = absent_paths(spark, paths)
    left = [path for path in paths if path not in faults]
    if not left:
        return {}, faults
    chunks = xml_chunks(spark, left, name=name, skip_unreadable=True)
    status = by_name(file_status(chunks).join(read_in_full(chunks), "FILE_NAME"))
    for path in left:
        if not status.get(name_of(path), {"readable": False})["readable"]:
            faults[path] = f"File cannot be read to its end: {path}"
    return status, faults


def inspect(
    spark: SparkSession,
    paths: list[str],
    name: Column | None = None,
    name_of: Callable[[str], str] = base_name,
) -> Inspection:
    """What the text of all files tells, in one scan, and one row for each path of the list."""
    status, faults = _scan(spark, list(paths), name, name_of)
    torn = [p for p in paths if p not in faults and status.get(name_of(p), {}).get("form") == JOINED]
    joined = None
    if torn:
        joined = joined_text(spark, torn, name)
        for row in file_status(joined).collect():
            # Their sections are resolved: what is left to tell is whether the tags add up.
            form = JOINED if row.form == CUT else WHOLE
            status[row.FILE_NAME] |= {"complete": row.complete, "records": row.records, "form": form}
    columns = ("complete", "records", "cuttable", "form")
    rows = []
    for path in paths:
        found = status.get(name_of(path), {})
        rows.append((path, name_of(path), faults.get(path), *[found.get(key) for key in columns]))
    listing = spark.createDataFrame(
        rows,
        "path string, FILE_NAME string, problem string, complete boolean, records bigint, "
        "cuttable boolean, form string",
    )
    day = fn.file_date(F.col("FILE_NAME"))
    error = (
        F.when(day.isNull(), F.concat(F.lit("File name has no date: "), "FILE_NAME"))
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(
            ~F.coalesce("complete", F.lit(False)),
            F.concat(F.lit("File is not complete: "), "FILE_NAME"),
        )
    )
    checked = listing.select(
        "path", "FILE_NAME", day.alias("FILE_DATE"), "records", "cuttable", "form", error.alias("error")
    )
    return Inspection(checked.collect(), joined)


def inspect_files(
    spark: SparkSession,
    paths: list[str],
    name: Column | None = None,
    name_of: Callable[[str], str] = base_name,
) -> list[Row]:
    return inspect(spark, paths, name, name_of).files


def load_table(
    rows: DataFrame,
    table: str,
    names: list[str],
    fmt: str = "parquet",
    path: str | None = None,
    compact: bool = False,
) -> None:
    """Loads files into the table in place of what it holds of them.

    Partitions hold one file each, so replacing them cannot touch other files. An
    earlier delivery of the same file may cover more dates; partitions that only it has
    are dropped once the new rows are in, so a load that fails loses nothing.

    Read tasks write their own rows, without a shuffle: a task sees one file and few
    dates. Where dates are scattered through the files, ``compact`` brings the rows of
    a partition together first; ``rebalance`` splits a partition that is too large.
    """
    spark = rows.sparkSession
    if compact:
        rows = rows.hint("rebalance", *[F.col(name) for name in PARTITIONS])
    if fmt == "delta" and spark.catalog.tableExists(table):
        # One commit, so that a load that fails loses nothing.
        quoted = ", ".join("'" + name.replace("'", "\\'") + "'" for name in names)
        writer = rows.write.format(fmt).mode("overwrite")
        writer.option("replaceWhere", f"FILE_NAME IN ({quoted})").saveAsTable(table)
        return
    chosen = _name_list(spark, names)
    earlier = _data_files(spark, table, chosen)
    replace_table_partitions(rows, table, PARTITIONS, fmt, path)
    if earlier is not None:
        now = _table_files(spark, table, chosen)
        stale = now.join(earlier, "data_file").select(*PARTITIONS).distinct()
        drop_partitions(spark, table, stale.collect())


def _name_list(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """File names as a small table; a join with it prunes partitions, however long the list."""
    listed = spark.createDataFrame([(name,) for name in names], "FILE_NAME string")
    return staged(listed.coalesce(1), "file-names")


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of the named files. A table's partitions of other files are not read.

    Only a filtered side prunes the other one, hence the filter that keeps every name.
    """
    chosen = F.broadcast(names.filter(F.col("FILE_NAME") >= ""))
    return rows.join(chosen, "FILE_NAME", "left_semi").select(*rows.columns)


def rows_of_files(spark: SparkSession, table: str, names: Sequence[str]) -> DataFrame:
    """The table's rows of the named files."""
    return _named(spark.table(table), _name_list(spark, names))


def _table_files(spark: SparkSession, table: str, names: DataFrame) -> DataFrame:
    """The table's data files that hold the named deliveries, with their partitions."""
    held = spark.table(table).select(*PARTITIONS, F.col("_metadata.file_path").alias("data_file"))
    return _named(held, names).distinct()


def _data_files(spark: SparkSession, table: str, names: DataFrame) -> DataFrame | None:
    """Data files of the named deliveries before a load, kept in the shared folder."""
    if not spark.catalog.tableExists(table):
        return None
    return staged(_table_files(spark, table, names).select("data_file"), "data-files")


def load_settlement(
    spark: SparkSession,
    paths: str | list[str],
    table: str,
    names: LogNames,
    write_log: Callable[[str, DataFrame], None],
    run_date: date | None = None,
    jdbc: JdbcTarget | None = None,
    mask_cards: bool = True,
    fmt: str = "parquet",
    path: str | None = None,
    compact: bool = False,
    name: Column | None = None,
    name_of: Callable[[str], str] = base_name,
) -> DataFrame:
    """Loads settlement files and returns the outcome per file.

    ``write_log`` receives ``load_log``, ``table_log`` and ``daily_audit`` frames, and
    ``rejects`` if a record did not parse, and stores them where the caller wants. A file
    that cannot be read fails alone; if the table cannot be written, all files fail. Raises
    ``LoadFailed`` at the end if any file failed.

    Where a delivery is a folder of parts, ``name_of`` gives the file's name for a path
    of the list and ``name`` the same name for a row that is read.
    """
    started = datetime.now(UTC)
    files = select_settlement_files(paths, name_of)
    file_names = [name_of(p) for p in files]
    if len(set(file_names)) < len(file_names):
        raise ValueError("two paths have the same file name")
    if not files:
        return _outcome(spark, [], {}, {}, {}, {})
    today = F.to_date(local_moment(started))
    run = today if run_date is None else F.lit(run_date)
    inspected = inspect(spark, files, name, name_of)
    checked = inspected.files
    good = [row for row in checked if row.error is None]
    table_errors = {row.FILE_NAME: row.error for row in checked if row.error is not None}
    source_counts = {row.FILE_NAME: row.records for row in good}
    table_counts: dict[str, int] = {}
    rejected_counts: dict[str, int] = {}

    def parse(part: list[str]) -> DataFrame:
        wanted = set(part)
        forms = {form: [r for r in good if r.form == form and r.path in wanted] for form in (CUT, JOINED, WHOLE)}
        cut, whole = ([r.path for r in forms[form]] for form in (CUT, WHOLE))
        torn = [r.FILE_NAME for r in forms[JOINED]]
        joined = inspected.joined
        if joined is not None:
            # Of the staged text only files that passed go on.
            joined = _named(joined, _name_list(spark, torn)) if torn else None
        return staged(
            settlement_records(spark, cut, whole, name, joined), "settlement-records"
        )

    records, faults = without_faulty([row.path for row in good], parse)
    table_errors |= {name_of(path): problem for path, problem in faults.items()}
    loaded_files = [row for row in good if row.path not in faults]

    def rows() -> DataFrame:
        return settlement_rows(records.filter(~F.col("REJECTED")), run, mask_cards)

    if loaded_files:
        parsed, rejected_counts = _parsed_counts(records)
        # Only the whole-file reader knows what such a file's records are.
        whole = [row.FILE_NAME for row in loaded_files if row.form == WHOLE]
        source_counts |= {file: parsed.get(file, 0) for file in whole}
        part_names = [row.FILE_NAME for row in loaded_files]
        try:
            load_table(with_decimals(rows()), table, part_names, fmt, path, compact)
            table_counts = _counts(rows_of_files(spark, table, part_names))
        except Exception as problem:  # noqa: BLE001 - every file of the batch gets its log row
            table_errors |= dict.fromkeys(part_names, message(problem))
            loaded_files = []

    if loaded_files and rejected_counts:
        rejects = records.filter("REJECTED").select("FILE_NAME", "REJECT_TEXT")
        write_log("rejects", rejects.withColumn("INSERT_DATE", run))

    jdbc_errors: dict[str, str] = {}
    jdbc_counts: dict[str, int] = {}
    if jdbc is not None and loaded_files:
        try:
            jdbc_counts = load_jdbc(rows(), jdbc, loaded_files)
        except Exception as problem:  # noqa: BLE001 - every file of the batch gets its log row
            jdbc_errors = {row.FILE_NAME: message(problem) for row in loaded_files}

    ended = datetime.now(UTC)
    errors = jdbc_errors | table_errors
    tabled = _outcome(spark, checked, source_counts, table_counts, rejected_counts, table_errors)
    total = _outcome(spark, checked, source_counts, table_counts, rejected_counts, errors)
    write_log("load_log", load_log(total, started, ended, ended, names.job_name))
    write_log(
        "table_log", table_log(tabled, table, started, ended, names.dag_id, names.task_id, today)
    )
    write_log("daily_audit", daily_audit(tabled, table, names.task_id, today))
    if jdbc is not None:
        copied = _outcome(spark, checked, source_counts, jdbc_counts, rejected_counts, errors)
        write_log("daily_audit", daily_audit(copied, jdbc.table, names.task_id, today))
    if errors:
        raise LoadFailed(
            f"{len(errors)} of {len(files)} files failed: {', '.join(sorted(errors))}"
        )
    return total


def load_jdbc(rows: DataFrame, target: JdbcTarget, good: list[Row]) -> dict[str, int]:
    """Appends the files that the database does not hold yet; returns its counts by file."""
    spark = rows.sparkSession
    days = sorted({row.FILE_DATE.isoformat() for row in good})
    count_sql = count_by_file_sql(target.table, days)

    def held() -> dict[str, int]:
        counts = read_jdbc_query(spark, target.url, count_sql, target.properties).collect()
        # By position: databases differ in the case of column names.
        return {row[0]: int(row[-1]) for row in counts}

    before = held()
    new = [row.FILE_NAME for row in good if row.FILE_NAME not in before]
    if not new:
        return before
    append_jdbc(_named(rows, _name_list(spark, new)), target.url, target.table, target.properties)
    return held()


def _parsed_counts(records: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Records and rejected records by file, one entry per file with any."""
    counted = records.groupBy("FILE_NAME").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("REJECTED").alias("rejected")
    )
    found = counted.collect()
    return {r.FILE_NAME: r.n for r in found}, {r.FILE_NAME: r.rejected for r in found if r.rejected}


def _counts(rows: DataFrame) -> dict[str, int]:
    """Rows by file; one entry per file of the list that is being loaded."""
    counted = rows.groupBy("FILE_NAME").agg(F.count(F.lit(1)).alias("n"))
    return {row.FILE_NAME: row.n for row in counted.collect()}


def _outcome(
    spark: SparkSession,
    checked: list[Row],
    source_counts: dict[str, int],
    target_counts: dict[str, int],
    rejected_counts: dict[str, int],
    errors: dict[str, str],
) -> DataFrame:
    """Counts of each checked file and their state, and its error if it has one.

    What was delivered should be what the target holds and what was rejected. A file
    without records is in agreement with a target that holds none of it.
    """
    rows = [
        (
            row.FILE_NAME,
            row.FILE_DATE,
            source_counts.get(row.FILE_NAME, 0),
            target_counts.get(row.FILE_NAME, 0),
            rejected_counts.get(row.FILE_NAME, 0),
            errors.get(row.FILE_NAME),
        )
        for row in checked
    ]
    held = F.col("target_count") + F.col("rejected_count")
    return spark.createDataFrame(rows, OUTCOME).withColumn(
        "count_state", agreement(F.col("source_count"), held)
    )
