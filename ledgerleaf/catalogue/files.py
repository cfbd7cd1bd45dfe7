"""Queries that write the given tables to the shared folder and read them back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import functions as fn
from ledgerleaf.catalogue import oracle as sql
from ledgerleaf.catalogue.registry import Query, query
from ledgerleaf.catalogue.standins import (
    BRONZE_CARDS_SQL,
    BRONZE_CUSTOMERS_SQL,
    FIELDS,
    IS_BROKEN,
    IS_REMARKED,
    IS_TRUNCATED,
    SECOND_DELIVERY,
    SOURCE,
    bronze_cards,
    bronze_customers,
    derive,
    derive_sql,
    table,
)
from ledgerleaf.operators import (
    daily_audit,
    file_status,
    is_complete,
    load_log,
    reconcile,
    reconcile_content,
    row_counts,
    row_prints,
    table_log,
)
from ledgerleaf.plans.settlement import LoadFailed, LogNames, load_settlement
from ledgerleaf.schemas import (
    CARD_TRANSACTIONS,
    CUSTOMERS,
    ROOT_TAG,
    ROW_TAG,
    SETTLEMENT_RECORD,
    SETTLEMENT_TEXT_COLUMNS,
)
from ledgerleaf.sinks import append_table, write_csv, write_parquet, write_partitions
from ledgerleaf.sources import (
    count_by_file_sql,
    read_csv,
    read_csv_by_name,
    read_csv_files,
    read_parquet,
    read_xml,
    split_conditions,
    split_points_sql,
    xml_chunks,
    xml_records,
)
from ledgerleaf.workdir import work_dir

RUN_DATE = date(2024, 6, 30)
_STARTED = datetime(2024, 6, 30, 1, 0, 0)
_ENDED = datetime(2024, 6, 30, 1, 30, 0)

_RECORD = {"source": SOURCE, **FIELDS}


def _name() -> Column:
    """A delivery is a folder of part files; the folder carries the file's name.

    As a partition column it is constant per file, and a filter on it skips folders.
    """
    return F.col("source")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "cards")
    write_csv(bronze_cards(spark, sf_dir), path)
    return read_csv_by_name(spark, path, CARD_TRANSACTIONS)


def csv_headers_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries of cards whose headers differ in order, one with a column more."""
    cards = bronze_cards(spark, sf_dir).withColumn("key", F.col("transaction_id").cast("long"))
    names = CARD_TRANSACTIONS.names
    orders = [names, names[::-1], [*names[5:], *names[:5], "note"]]
    paths = [work_dir(spark, f"cards {i}+%20") for i in range(len(orders))]
    for i, (path, order) in enumerate(zip(paths, orders, strict=True)):
        part = cards.filter(F.col("key") % len(orders) == i)
        write_csv(part.withColumn("note", F.concat(F.lit("n"), "key")).select(*order), path)
    return read_csv_files(spark, paths, CARD_TRANSACTIONS)


def csv_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "customers")
    write_csv(bronze_customers(spark, sf_dir), path)
    return read_csv(spark, path, CUSTOMERS)


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "lineitem")
    write_parquet(table(spark, sf_dir, "lineitem"), path)
    return read_parquet(spark, path)


def landing(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of settlement deliveries made from orders: complete ones, and cut ones.

    Those of December are cut: they have their records but no closing root tag. Those of
    January hold a comment, so they may not be cut at row tags. ``rebalance`` splits a
    source that holds many rows over several part files.
    """
    orders = table(spark, sf_dir, "orders")
    whole, cut = work_dir(spark, "complete"), work_dir(spark, "truncated")
    complete = derive(orders.filter(f"NOT ({IS_TRUNCATED})"), _RECORD)
    (
        complete.hint("rebalance", F.col("source"))
        .write.format("xml")
        .option("rowTag", ROW_TAG)
        .option("rootTag", ROOT_TAG)
        .option("declaration", "")
        .partitionBy("source")
        .save(whole)
    )
    remark = F.lit(f"<{ROOT_TAG}><!-- remark --></{ROOT_TAG}>").alias("value")
    remarked = derive(orders.filter(IS_REMARKED), {"source": SOURCE}).distinct()
    remarked.select("source", remark).write.mode("append").partitionBy("source").text(whole)
    truncated = derive(orders.filter(IS_TRUNCATED), _RECORD)
    _write_records(truncated.select("source", _record_text().alias("value")), cut)
    return [whole, cut]


def _record_text() -> Column:
    return F.to_xml(F.struct(*FIELDS), {"rowTag": ROW_TAG})


def _write_records(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", F.col("source")).write.partitionBy("source").text(path)


def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-file reader on the complete deliveries; the cut ones have no root to read."""
    whole, cut = landing(spark, sf_dir)
    complete = read_xml(spark, whole, SETTLEMENT_RECORD, name=_name())
    truncated = xml_records(xml_chunks(spark, cut, name=_name()), SETTLEMENT_RECORD)
    return complete.unionByName(truncated).drop("REJECTED", "REJECT_TEXT")


def xml_cut_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splittable form on the same deliveries."""
    parts = [
        xml_records(xml_chunks(spark, folder, name=_name()), SETTLEMENT_RECORD)
        for folder in landing(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1]).drop("REJECTED", "REJECT_TEXT")


def _completeness(spark: SparkSession, folders: list[str]) -> DataFrame:
    status = [file_status(xml_chunks(spark, folder, name=_name())) for folder in folders]
    return status[0].unionByName(status[1]).drop("form")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completeness(spark, landing(spark, sf_dir))


def closing_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any text of a folder closes the root; stops at the first that does."""
    closes = [is_complete(spark.read.text(f), "value") for f in landing(spark, sf_dir)]
    kinds = spark.createDataFrame([("complete", closes[0]), ("cut", closes[1])], "kind string, closes boolean")
    return kinds


def _delivered_name(path: str) -> str:
    return path.rsplit("source=", 1)[-1]


def _load(
    spark: SparkSession,
    sf_dir: str,
    folders: list[str],
    loaded: str,
    path: str,
    write_log: Callable[[str, DataFrame], None] = lambda *_: None,
) -> DataFrame:
    """The settlement job on all deliveries in the folders; files that fail are left to its logs."""
    names = derive(table(spark, sf_dir, "orders"), {"source": SOURCE, "late": IS_TRUNCATED}).distinct()
    # One entry per delivery, the list that the job is given.
    paths = [f"{folders[row.late if len(folders) > 1 else 0]}/source={row.source}" for row in names.collect()]
    # For every record: no pattern, which would take a tenth of the parse.
    name = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/source=", -1), "/", 1)
    log_names = LogNames("CARD", "daily", "load")
    try:
        load_settlement(
            spark, paths, loaded, log_names, write_log, RUN_DATE, path=path, name=name, name_of=_delivered_name
        )
    except LoadFailed:
        pass
    return spark.table(loaded)


def _new_table(spark: SparkSession) -> tuple[str, str]:
    path = work_dir(spark, "settlement")
    return "settlement_" + path.rsplit("-", 1)[-1], path


def xml_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settlement job on all deliveries; those that are not complete fail."""
    return _load(spark, sf_dir, landing(spark, sf_dir), *_new_table(spark))


def settlement_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice into one table: the second delivery of March files has even orders only."""
    loaded, path = _new_table(spark)
    folders = landing(spark, sf_dir)
    _load(spark, sf_dir, folders, loaded, path)
    again = work_dir(spark, "again")
    chosen = table(spark, sf_dir, "orders").filter(f"NOT ({IS_TRUNCATED}) AND ({SECOND_DELIVERY})")
    rows = derive(chosen, _RECORD).select("source", _record_text().alias("value"))
    end = rows.select("source", F.lit(f"</{ROOT_TAG}>").alias("value")).distinct()
    _write_records(rows.unionByName(end), again)
    return _load(spark, sf_dir, [again, folders[1]], loaded, path)


def xml_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a closing field tag among the deliveries: what the job rejects."""
    folder = work_dir(spark, "broken")
    records = derive(table(spark, sf_dir, "orders"), {**_RECORD, "bad": IS_BROKEN})
    text = F.when(F.col("bad"), F.replace(_record_text(), F.lit("</FLD_004>"))).otherwise(_record_text())
    rows = records.select("source", text.alias("value"))
    end = rows.select("source", F.lit(f"</{ROOT_TAG}>").alias("value")).distinct()
    _write_records(rows.unionByName(end), folder)
    logs: dict[str, DataFrame] = {}
    held = _load(spark, sf_dir, [folder], *_new_table(spark), logs.__setitem__)
    order = F.regexp_extract("REJECT_TEXT", "<FLD_004>([0-9]+)", 1)
    rejected = logs["rejects"].select("FILE_NAME", order.alias("order_id"), F.lit(True).alias("rejected"))
    kept = held.select("FILE_NAME", F.col(SETTLEMENT_TEXT_COLUMNS[0]).alias("order_id"), F.lit(False).alias("rejected"))
    return rejected.unionByName(kept)


_HIDDEN = "Shop </TRN> & <TRN>"
_HAS_HIDDEN = "o_orderkey % 11 = 0"
_HIDING = {**FIELDS, "FLD_020": f"case when {_HAS_HIDDEN} then '{_HIDDEN}' else {FIELDS['FLD_020']} end"}


def xml_hidden_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on deliveries in which comments hold records and CDATA holds row tags."""
    folder = work_dir(spark, "hiding")
    records = derive(table(spark, sf_dir, "orders"), {"source": SOURCE, "key": "o_orderkey", **_HIDING})
    text = F.to_xml(F.struct(*_HIDING), {"rowTag": ROW_TAG})
    escaped = _HIDDEN.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    text = F.replace(text, F.lit(escaped), F.lit(f"<![CDATA[{_HIDDEN}]]>"))
    plain = ~text.contains("<![CDATA[")
    remark = F.concat(F.lit("<!-- was: "), text, F.lit("\n"), text, F.lit(" -->\n"), text)
    text = F.when((F.col("key") % 7 == 0) & plain, remark).otherwise(text)
    rows = records.select("source", text.alias("value"))
    end = rows.select("source", F.lit(f"</{ROOT_TAG}>").alias("value")).distinct()
    _write_records(rows.unionByName(end), folder)
    return _load(spark, sf_dir, [folder], *_new_table(spark))


def settlement_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records found in the delivered text against rows in the loaded table."""
    folders = landing(spark, sf_dir)
    delivered = _completeness(spark, folders).select(
        "FILE_NAME",
        fn.file_date(F.col("FILE_NAME")).alias("FILE_DATE"),
        F.col("records").alias("ROW_CNT"),
    )
    return reconcile(delivered, row_counts(_load(spark, sf_dir, folders, *_new_table(spark))))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.col("event_type").alias("kind")
    )


def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one partitioned table, counted by partition."""
    path = work_dir(spark, "appended")
    name = "appended_" + path.rsplit("-", 1)[-1]
    events = _events(spark, sf_dir)
    append_table(events, name, ["kind"], path=path)
    append_table(events.filter(F.col("kind") == "click"), name, ["kind"])
    return spark.sql(f"SELECT kind, count(1) AS n FROM {name} GROUP BY kind")


def table_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one day in a table partitioned by day; other partitions are not read."""
    path = work_dir(spark, "by_day")
    name = "by_day_" + path.rsplit("-", 1)[-1]
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.to_date("ts").alias("day")
    )
    append_table(events.hint("rebalance", "day"), name, ["day"], path=path)
    chosen = spark.table(name).filter(F.col("day") == F.lit(date(2024, 1, 2)))
    return chosen.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def dynamic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites one partition with negated values; the others stay."""
    path = work_dir(spark, "replaced")
    events = _events(spark, sf_dir)
    write_partitions(events, path, ["kind"])
    changed = events.filter(F.col("kind") == "click").withColumn("value", -F.col("value"))
    write_partitions(changed, path, ["kind"])
    return read_parquet(spark, path).select("event_id", "user_id", "value", "kind")


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name, date and status of each order's record."""
    orders = derive(
        table(spark, sf_dir, "orders"), {"FILE_NAME": SOURCE, "status": "o_orderstatus"}
    )
    return orders.withColumn("FILE_DATE", fn.file_date(F.col("FILE_NAME")))


_TARGET_RULE = (
    "NOT (status = 'P' AND FILE_NAME LIKE '%-06-01.xml') AND FILE_NAME NOT LIKE '%-03-01.xml'"
)


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """June files lack some rows in the target, March files are missing from it."""
    delivered = _delivered(spark, sf_dir)
    return reconcile(row_counts(delivered), row_counts(delivered.filter(_TARGET_RULE)))


def reconcile_content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows on both sides; in May files one amount differs, in July two rows swap theirs."""
    rows = derive(
        table(spark, sf_dir, "orders"),
        {"FILE_NAME": SOURCE, "order_id": "o_orderkey", "customer": "o_custkey", "amount": "o_totalprice"},
    ).withColumn("FILE_DATE", fn.file_date(F.col("FILE_NAME")))
    month, odd = F.month("FILE_DATE"), F.col("order_id") % 2 == 1
    changed = rows.withColumn("amount", F.when((month == 5) & odd, F.col("amount") + 1).otherwise(F.col("amount")))
    swapped = changed.withColumns(
        {
            "order_id": F.when(month == 7, F.col("customer")).otherwise(F.col("order_id")),
            "customer": F.when(month == 7, F.col("order_id")).otherwise(F.col("customer")),
        }
    )
    # The order of the rows and their number of tasks play no part.
    return reconcile_content(row_prints(rows), row_prints(swapped.repartition(5, "customer")))


def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a table on a key that a third of the rows share and many lack.

    The text that a database would run is run by Spark on a view. ``met`` counts the conditions
    that a row meets.
    """
    derive(table(spark, sf_dir, "orders"), {"k": _SPLIT_KEY, "o_orderkey": "o_orderkey"}).createOrReplaceTempView(
        "split_rows"
    )
    points = spark.sql(split_points_sql("split_rows", "k", "o_orderkey", _PARTS)).collect()
    conditions = [F.expr(text) for text in split_conditions(points, "k", "o_orderkey")]
    met = sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))
    part = F.coalesce(*[F.when(c, number) for number, c in enumerate(conditions, 1)])
    rows = spark.table("split_rows").select(part.alias("part"), met.alias("met"))
    return rows.groupBy("part", "met").agg(F.count(F.lit(1)).alias("n"))


_PARTS = 8
_SPLIT_KEY = (
    "case when o_orderkey % 3 = 0 then 7 when o_orderkey % 5 = 0 then cast(null as int) "
    "else cast(o_custkey as int) end"
)


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciled counts, with an error for each file that the table lacks."""
    missing = F.col("target_count").isNull()
    text = F.concat(F.lit("File is not complete: "), "FILE_NAME")
    return _reconciled(spark, sf_dir).withColumn("error", F.when(missing, text))


def row_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts(_delivered(spark, sf_dir))


def remote_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count text that a database would run, here run by Spark on a view."""
    _delivered(spark, sf_dir).createOrReplaceTempView("delivered_records")
    return spark.sql(count_by_file_sql("delivered_records", ["1996-05-01", "1997-08-01"]))


def daily_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = _outcome(spark, sf_dir)
    return daily_audit(outcome, "settlement", "load", F.lit(RUN_DATE))


def load_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_log(_outcome(spark, sf_dir), _STARTED, _ENDED, _ENDED, "CARD")


def table_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = _outcome(spark, sf_dir)
    return table_log(
        outcome, "settlement", _STARTED, _ENDED, "daily", "load", F.lit(RUN_DATE)
    )


_RECORD_SQL = derive_sql({"FILE_NAME": SOURCE, **FIELDS}, "orders")
_COMPLETE_SQL = derive_sql(
    {"FILE_NAME": SOURCE, **FIELDS}, f"orders WHERE NOT ({IS_TRUNCATED})"
)
_MASKED = "'**** **** **** ' || right(FLD_008, 4)"
_TEXTS = ", ".join(
    f"{_MASKED} AS {name}"
    if name == "CARD_NUMBER"
    else f"CAST(try_cast(FLD_{n:03d} AS DECIMAL(38, 10)) AS VARCHAR) AS {name}"
    if name in ("AMOUNT", "ACQ_FEE", "ISS_FEE")
    else f"FLD_{n:03d} AS {name}"
    for n, name in enumerate(SETTLEMENT_TEXT_COLUMNS, start=4)
)
_SETTLEMENT = f"""
SELECT CAST(CAST(try_strptime(FLD_001, '%Y%m%d') AS DATE) AS VARCHAR) AS STTL_DATE,
  CAST(CAST(try_strptime(FLD_002, '%Y%m%d') AS DATE) AS VARCHAR) AS TRN_DATE,
  try_strptime(FLD_002 || FLD_003, '%Y%m%d%H%M%S') AS TRN_TIME, {_TEXTS}, FILE_NAME,
  '{RUN_DATE}' AS INSERT_DATE, substr(FILE_NAME, 9, 10) AS FILE_DATE
FROM ({_COMPLETE_SQL})
"""
_SECOND_SQL = derive_sql(
    {"FILE_NAME": SOURCE, **FIELDS}, f"orders WHERE NOT ({IS_TRUNCATED}) AND ({SECOND_DELIVERY})"
)

_DELIVERED = f"SELECT {SOURCE} AS FILE_NAME, o_orderstatus AS status FROM orders"
_OUTCOME = f"""
SELECT s.FILE_NAME, substr(s.FILE_NAME, 9, 10) AS FILE_DATE, source_count, target_count,
  CASE WHEN source_count = target_count THEN 'success' ELSE 'fail' END AS count_state,
  target_count IS NOT NULL AS loaded
FROM (SELECT FILE_NAME, count(*) AS source_count FROM ({_DELIVERED}) GROUP BY ALL) s
LEFT JOIN (SELECT FILE_NAME, count(*) AS target_count FROM ({_DELIVERED})
  WHERE {_TARGET_RULE} GROUP BY ALL) t ON s.FILE_NAME = t.FILE_NAME
"""
_AT = "TIMESTAMP '2024-06-30 05:00:00'"
_TO = "TIMESTAMP '2024-06-30 05:30:00'"

QUERIES: dict[str, Query] = {
    "csv_roundtrip": query(
        csv_roundtrip,
        "SELECT * REPLACE (CAST(transaction_amount AS VARCHAR) AS transaction_amount) "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "csv_headers_differ": query(
        csv_headers_differ,
        "SELECT * REPLACE (CAST(transaction_amount AS VARCHAR) AS transaction_amount), "
        "CASE WHEN transaction_id::BIGINT % 3 = 2 THEN 'n' || transaction_id END AS note "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "csv_declared": query(
        csv_declared,
        "SELECT * REPLACE (nullif(full_name, '') AS full_name, nullif(phone, '') AS phone) "
        f"FROM ({BRONZE_CUSTOMERS_SQL})",
    ),
    "parquet_roundtrip": query(
        parquet_roundtrip, "SELECT * FROM lineitem"
    ),
    "xml_roundtrip": query(xml_roundtrip, _RECORD_SQL),
    "xml_cut_roundtrip": query(xml_cut_roundtrip, _RECORD_SQL),
    "completeness": query(
        completeness,
        f"SELECT {SOURCE} AS FILE_NAME, NOT ({IS_TRUNCATED}) AS complete, count(*) AS records, "
        f"NOT ({IS_REMARKED}) AS cuttable FROM orders GROUP BY ALL",
    ),
    "closing_tag": query(
        closing_tag,
        f"SELECT 'complete' AS kind, count(*) FILTER (NOT ({IS_TRUNCATED})) > 0 AS closes FROM orders "
        "UNION ALL SELECT 'cut', FALSE",
    ),
    "xml_settlement": query(xml_settlement, _SETTLEMENT),
    "settlement_reload": query(settlement_reload, _SETTLEMENT.replace(_COMPLETE_SQL, _SECOND_SQL)),
    "xml_rejects": query(
        xml_rejects,
        f"SELECT {SOURCE} AS FILE_NAME, cast(o_orderkey AS VARCHAR) AS order_id, {IS_BROKEN} AS rejected FROM orders",
    ),
    "xml_hidden_tags": query(
        xml_hidden_tags,
        _SETTLEMENT.replace(_COMPLETE_SQL, derive_sql({"FILE_NAME": SOURCE, **_HIDING}, "orders")),
    ),
    "settlement_reconcile": query(
        settlement_reconcile,
        "SELECT FILE_NAME, substr(FILE_NAME, 9, 10) AS FILE_DATE, n AS source_count, "
        "CASE WHEN whole THEN n END AS target_count, "
        "CASE WHEN whole THEN 'success' ELSE 'fail' END AS count_state "
        f"FROM (SELECT {SOURCE} AS FILE_NAME, NOT ({IS_TRUNCATED}) AS whole, count(*) AS n "
        "FROM orders GROUP BY ALL)",
    ),
    "table_append": query(
        table_append,
        "SELECT event_type AS kind, count(*) * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END "
        "AS n FROM events GROUP BY event_type",
    ),
    "table_filter_count": query(
        table_filter_count,
        "SELECT '2024-01-02' AS day, count(*) AS n FROM events "
        "WHERE CAST(ts AS DATE) = DATE '2024-01-02' GROUP BY 1",
    ),
    "dynamic_overwrite": query(
        dynamic_overwrite,
        "SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN -value ELSE value END AS "
        "value, event_type AS kind FROM events",
    ),
    "row_counts": query(
        row_counts_query,
        "SELECT FILE_NAME, substr(FILE_NAME, 9, 10) AS FILE_DATE, count(*) AS ROW_CNT "
        f"FROM ({_DELIVERED}) GROUP BY ALL",
    ),
    "remote_count": query(
        remote_count,
        "SELECT FILE_NAME, substr(FILE_NAME, 9, 10) AS FILE_DATE, count(*) AS ROW_CNT "
        f"FROM ({_DELIVERED}) WHERE substr(FILE_NAME, 9, 10) IN ('1996-05-01', '1997-08-01') "
        "GROUP BY ALL",
    ),
    "reconcile": query(
        _reconciled,
        "SELECT FILE_NAME, FILE_DATE, source_count, target_count, count_state "
        f"FROM ({_OUTCOME})",
    ),
    "reconcile_content": query(
        reconcile_content_query,
        "SELECT FILE_NAME, substr(FILE_NAME, 9, 10) AS FILE_DATE, count(*) AS source_count, "
        "count(*) AS target_count, 'success' AS count_state, CASE "
        "WHEN substr(FILE_NAME, 14, 2) = '05' AND bool_or(o_orderkey % 2 = 1) THEN 'fail' "
        "WHEN substr(FILE_NAME, 14, 2) = '07' AND bool_or(o_orderkey <> o_custkey) THEN 'fail' "
        f"ELSE 'success' END AS content_state FROM (SELECT *, {SOURCE} AS FILE_NAME FROM orders) GROUP BY FILE_NAME",
    ),
    "split_points": query(
        split_points,
        f"SELECT part, 1 AS met, count(*) AS n FROM (SELECT ntile({_PARTS}) OVER "
        "(ORDER BY k NULLS FIRST, o_orderkey) AS part "
        f"FROM (SELECT *, {_SPLIT_KEY} AS k FROM orders)) GROUP BY part",
    ),
    "daily_audit": query(
        daily_audit_query,
        f"SELECT '{RUN_DATE}' AS report_date, 'load/' || FILE_NAME AS source_name, "
        "'settlement' AS target_name, FILE_DATE AS start_dt, FILE_DATE AS end_dt, "
        "CASE WHEN loaded THEN source_count END AS source_count, target_count, "
        f"CASE WHEN loaded THEN count_state END AS count_state FROM ({_OUTCOME})",
    ),
    "load_log": query(
        load_log_query,
        "SELECT FILE_NAME, CASE WHEN loaded THEN 'Success' ELSE 'Fail' END AS PARSE_STATUS, "
        "CASE WHEN loaded THEN source_count ELSE 0 END AS FILE_ROW_CNT, "
        "COALESCE(target_count, 0) AS PARSE_ROW_CNT, CASE WHEN NOT loaded "
        f"THEN 'File is not complete: ' || FILE_NAME END AS ERROR_DESC, {_TO} AS INSERT_DATE, "
        f"2024 AS INSERT_YEAR, {_AT} AS START_DT, {_TO} AS END_DT, 'CARD' AS JOB_NAME, "
        f"FILE_DATE FROM ({_OUTCOME})",
    ),
    "table_log": query(
        table_log_query,
        f"SELECT '{RUN_DATE}' AS report_date, FILE_NAME AS source_table_name, "
        f"'settlement' AS hms_table_name, {_AT} AS start_time, {_TO} AS end_time, "
        "target_count AS hms_count, 'daily' AS dag_id, 'load' AS task_id, "
        "'Success' AS task_state, CAST(NULL AS VARCHAR) AS task_error_message "
        f"FROM ({_OUTCOME}) WHERE loaded",
    ),
}
