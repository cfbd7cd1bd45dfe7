"""Log and audit rows as DataFrames, one row per file.

Start and end are UTC wall-clock times; the rows hold them in the bank's zone.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import clip_error, local_time
from ledgerleaf.schemas import DAILY_AUDIT_COLUMNS, LOAD_LOG_COLUMNS, TABLE_LOG_COLUMNS


def local_moment(moment: datetime) -> Column:
    """As text first: a datetime literal would pass through the session's zone."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(UTC).replace(tzinfo=None)
    return local_time(F.lit(moment.isoformat(" ")).cast("timestamp_ntz"))


def load_log(
    outcome: DataFrame, started: datetime, ended: datetime, inserted: datetime, job_name: str
) -> DataFrame:
    """Load log of ``outcome`` (FILE_NAME, FILE_DATE, source_count, target_count, error).

    A file with an error is ``Fail`` with counts of 0. Where ``outcome`` has a
    rejected_count, a loaded file's error text tells how many records were rejected.
    """
    failed = F.col("error").isNotNull()
    error = F.col("error")
    if "rejected_count" in outcome.columns:
        rejected = F.concat(F.lit("Rejected records: "), F.col("rejected_count"))
        error = F.when(failed, error).when(F.col("rejected_count") > 0, rejected)
    return outcome.select(
        "FILE_NAME",
        F.when(failed, "Fail").otherwise("Success").alias("PARSE_STATUS"),
        F.when(failed, 0).otherwise(F.col("source_count")).cast("long").alias("FILE_ROW_CNT"),
        F.when(failed, 0).otherwise(F.col("target_count")).cast("long").alias("PARSE_ROW_CNT"),
        clip_error(error).alias("ERROR_DESC"),
        local_moment(inserted).alias("INSERT_DATE"),
        F.year(local_moment(inserted)).alias("INSERT_YEAR"),
        local_moment(started).alias("START_DT"),
        local_moment(ended).alias("END_DT"),
        F.lit(job_name).alias("JOB_NAME"),
        "FILE_DATE",
    ).select(*LOAD_LOG_COLUMNS)


def table_log(
    outcome: DataFrame,
    table: str,
    started: datetime,
    ended: datetime,
    dag_id: str,
    task_id: str,
    report_date: Column | None = None,
) -> DataFrame:
    """Table-load log of the files that were loaded; report date first, today if not given."""
    loaded = outcome.filter(F.col("error").isNull())
    return loaded.select(
        (F.current_date() if report_date is None else report_date).alias("report_date"),
        F.col("FILE_NAME").alias("source_table_name"),
        F.lit(table).alias("hms_table_name"),
        local_moment(started).alias("start_time"),
        local_moment(ended).alias("end_time"),
        F.col("target_count").cast("long").alias("hms_count"),
        F.lit(dag_id).alias("dag_id"),
        F.lit(task_id).alias("task_id"),
        F.lit("Success").alias("task_state"),
        F.lit(None).cast("string").alias("task_error_message"),
    ).select(*TABLE_LOG_COLUMNS)


def daily_audit(
    outcome: DataFrame, target: str, task_id: str, report_date: Column | None = None
) -> DataFrame:
    """Daily audit: both counts and their state per file; a failed file has none of the three."""
    loaded = F.col("error").isNull()
    return outcome.select(
        (F.current_date() if report_date is None else report_date).alias("report_date"),
        F.concat(F.lit(f"{task_id}/"), "FILE_NAME").alias("source_name"),
        F.lit(target).alias("target_name"),
        F.col("FILE_DATE").alias("start_dt"),
        F.col("FILE_DATE").alias("end_dt"),
        F.when(loaded, F.col("source_count")).alias("source_count"),
        F.when(loaded, F.col("target_count")).alias("target_count"),
        F.when(loaded, F.col("count_state")).alias("count_state"),
    ).select(*DAILY_AUDIT_COLUMNS)
