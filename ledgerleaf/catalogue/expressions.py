"""Queries for single expressions, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import functions as fn
from ledgerleaf.catalogue import oracle as sql
from ledgerleaf.catalogue.registry import Query, query
from ledgerleaf.catalogue.standins import (
    BRONZE_CARDS_SQL,
    BRONZE_CUSTOMERS_SQL,
    FIELDS,
    SOURCE,
    bronze_cards,
    bronze_customers,
    derive,
    derive_sql,
    table,
)
from ledgerleaf.operators import preview, split_null_keys

_CARD_ID = "transaction_id"
_CUSTOMER_ID = "customer_fin"
_SALT = "bank"

# A record's key and file name besides its fields.
_RECORD = {"record_id": "o_orderkey", "FILE_NAME": SOURCE, **FIELDS}
_RECORD_SQL = derive_sql(_RECORD, "orders")


def filter_status_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fn.same_ignoring_case(F.col("transaction_status"), "Completed")
    return bronze_cards(spark, sf_dir).filter(kept).select(_CARD_ID, "transaction_status")


def upper_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_cards(spark, sf_dir).select(
        _CARD_ID,
        F.upper("currency").alias("currency"),
        fn.title_case(F.col("card_type")).alias("card_type"),
        fn.title_case(F.col("transaction_type")).alias("transaction_type"),
        fn.title_case(F.col("channel")).alias("channel"),
        fn.title_case(F.col("city")).alias("city"),
    )


def mask_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = fn.mask_card(F.col("card_number")).alias("card_number")
    return bronze_cards(spark, sf_dir).select(_CARD_ID, masked)


def mask_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = fn.mask_iban(F.col("iban")).alias("iban")
    return bronze_cards(spark, sf_dir).select(_CARD_ID, masked)


def card_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fn.card_key(F.col("card_number"), _SALT).alias("card_key")
    return bronze_cards(spark, sf_dir).select(_CARD_ID, key)


def to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = fn.to_bool(F.col("is_international")).alias("is_international")
    return bronze_cards(spark, sf_dir).select(_CARD_ID, flag)


def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("full_name")
    return bronze_customers(spark, sf_dir).select(
        _CUSTOMER_ID,
        fn.name_part(name, 0).alias("first_token"),
        fn.name_part(name, 1).alias("second_token"),
    )


def ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.ascii_fold(F.col("text")).alias("folded")
    )


def fold_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in several scripts, beside the customer's own."""
    names = F.array(*[F.lit(name) for name in _SCRIPT_NAMES])
    chosen = F.get(names, (F.col("c_custkey") % len(_SCRIPT_NAMES)).cast("int"))
    text = F.concat(chosen, F.lit(" "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.ascii_fold(text).alias("folded"))


# Names as customers write them, with the form that is expected.
_SCRIPT_NAMES = {
    "Ελένη Ψαρρού": "Elene Psarrou",
    "Андрій Їжак": "Andrii Yizhak",
    "Ђорђе Љубић": "Djordje Ljubitsh",
    "Қанат Өмірұлы": "Kanat Omiruly",
    "გიორგი ჟვანია": "giorgi zhvania",
    "ﬁona Ａhmed №５": "fiona Ahmed No5",
    "Şəhriyar Öğüz": "Sehriyar Oguz",
}


def city_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = fn.normalize_city(F.col("city")).alias("city")
    return bronze_cards(spark, sf_dir).select(_CARD_ID, city)


def phone_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = fn.az_phone(F.col("phone"))
    return bronze_customers(spark, sf_dir).select(
        _CUSTOMER_ID, cleaned.alias("phone"), fn.phone_valid(cleaned).alias("phone_valid")
    )


def gender_marital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_customers(spark, sf_dir).select(
        _CUSTOMER_ID,
        fn.gender_label(F.col("gender")).alias("gender"),
        fn.marital_label(F.col("marital_status")).alias("marital_status"),
    )


def safe_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_customers(spark, sf_dir).select(
        _CUSTOMER_ID,
        fn.parse_date(F.col("birth_date")).alias("birth_date"),
        fn.parse_date(F.col("registration_date")).alias("registration_date"),
    )


def safe_compact_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), _RECORD).select(
        "record_id",
        fn.parse_compact_date(F.col("FLD_001")).alias("sttl_date"),
        fn.parse_compact_date(F.col("FLD_002")).alias("trn_date"),
    )


def safe_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = fn.parse_datetime(F.col("transaction_datetime")).alias("transaction_datetime")
    return bronze_cards(spark, sf_dir).select(_CARD_ID, moment)


def ts_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), _RECORD).select(
        "record_id",
        fn.parse_compact_datetime(F.col("FLD_002"), F.col("FLD_003")).alias("trn_time"),
    )


def safe_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), _RECORD).select(
        "record_id", *[fn.to_decimal(F.col(f)).alias(f) for f in ("FLD_011", "FLD_013", "FLD_016")]
    )


def file_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    names = {
        "record_id": "o_orderkey",
        "name": f"case when o_orderkey % 5 = 0 then lower({SOURCE}) when o_orderkey % 5 = 1 "
        f"then upper({SOURCE}) when o_orderkey % 5 = 2 then concat('X', {SOURCE}) "
        f"when o_orderkey % 5 = 3 then 'PERTRANS2024-13-01.xml' else {SOURCE} end",
    }
    return derive(orders, names).select(
        "record_id",
        "name",
        fn.is_settlement_name(F.col("name")).alias("selected"),
        fn.file_date(F.col("name")).alias("file_date"),
    )


def error_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.clip_error(F.col("text")).alias("clipped")
    )


def local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = fn.local_time(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", local.alias("local_ts"), F.year(local).alias("local_year")
    )


def key_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = split_null_keys(bronze_customers(spark, sf_dir), "customer_id")
    return rejected.select("customer_fin", "full_name", "phone")


def preview_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(bronze_cards(spark, sf_dir), 20, "iban").select("iban")


_NAME_SQL = f"""
SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN lower({SOURCE})
  WHEN o_orderkey % 5 = 1 THEN upper({SOURCE}) WHEN o_orderkey % 5 = 2
  THEN concat('X', {SOURCE}) WHEN o_orderkey % 5 = 3 THEN 'PERTRANS2024-13-01.xml'
  ELSE {SOURCE} END AS name FROM orders
"""


def _decimal(field: str) -> str:
    return f"CAST(try_cast({field} AS DECIMAL(38, 10)) AS VARCHAR) AS {field}"


QUERIES: dict[str, Query] = {
    "filter_status_ci": query(
        filter_status_ci,
        f"SELECT transaction_id, transaction_status FROM ({BRONZE_CARDS_SQL}) "
        "WHERE lower(transaction_status) = 'completed'",
    ),
    "upper_title": query(
        upper_title,
        f"SELECT transaction_id, upper(currency) AS currency, {sql.title('card_type')} AS "
        f"card_type, {sql.title('transaction_type')} AS transaction_type, "
        f"{sql.title('channel')} AS channel, {sql.title('city')} AS city "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "mask_card": query(
        mask_card,
        "SELECT transaction_id, '**** **** **** ' || right(card_number, 4) AS card_number "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "mask_iban": query(
        mask_iban,
        "SELECT transaction_id, 'AZ' || repeat('*', 22) || right(iban, 4) AS iban "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "card_digest": query(
        card_digest,
        f"SELECT transaction_id, sha256('{_SALT}' || card_number) AS card_key "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "to_bool": query(
        to_bool,
        f"SELECT transaction_id, {sql.boolean('is_international')} AS is_international "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "name_split": query(
        name_split,
        "SELECT customer_fin, string_split(full_name, ' ')[1] AS first_token, "
        f"string_split(full_name, ' ')[2] AS second_token FROM ({BRONZE_CUSTOMERS_SQL})",
    ),
    "ascii_fold": query(
        ascii_fold, f"SELECT doc_id, {sql.fold('text')} AS folded FROM documents"
    ),
    "fold_scripts": query(
        fold_scripts,
        f"SELECT c_custkey, {list(_SCRIPT_NAMES.values())}[c_custkey % {len(_SCRIPT_NAMES)} + 1] "
        "|| ' ' || c_name AS folded FROM customer",
    ),
    "city_normalize": query(
        city_normalize,
        f"SELECT transaction_id, {sql.fold(sql.title('city'))} AS city "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "phone_clean": query(
        phone_clean,
        "SELECT customer_fin, phone, COALESCE(regexp_full_match(phone, '\\+994[0-9]{9}'), "
        f"FALSE) AS phone_valid FROM (SELECT customer_fin, {sql.phone('phone')} AS phone "
        f"FROM ({BRONZE_CUSTOMERS_SQL}))",
    ),
    "gender_marital": query(
        gender_marital,
        f"SELECT customer_fin, {sql.GENDER} AS gender, {sql.MARITAL} AS marital_status "
        f"FROM ({BRONZE_CUSTOMERS_SQL})",
    ),
    "safe_date": query(
        safe_date,
        f"SELECT customer_fin, CAST({sql.day('birth_date')} AS VARCHAR) AS birth_date, "
        f"CAST({sql.day('registration_date')} AS VARCHAR) AS registration_date "
        f"FROM ({BRONZE_CUSTOMERS_SQL})",
    ),
    "safe_compact_date": query(
        safe_compact_date,
        "SELECT record_id, CAST(CAST(try_strptime(FLD_001, '%Y%m%d') AS DATE) AS VARCHAR) AS "
        "sttl_date, CAST(CAST(try_strptime(FLD_002, '%Y%m%d') AS DATE) AS VARCHAR) AS trn_date "
        f"FROM ({_RECORD_SQL})",
    ),
    "safe_ts": query(
        safe_ts,
        f"SELECT transaction_id, {sql.moment('transaction_datetime')} AS transaction_datetime "
        f"FROM ({BRONZE_CARDS_SQL})",
    ),
    "ts_concat": query(
        ts_concat,
        "SELECT record_id, try_strptime(FLD_002 || FLD_003, '%Y%m%d%H%M%S') AS trn_time "
        f"FROM ({_RECORD_SQL})",
    ),
    "safe_decimal": query(
        safe_decimal,
        f"SELECT record_id, {_decimal('FLD_011')}, {_decimal('FLD_013')}, {_decimal('FLD_016')} "
        f"FROM ({_RECORD_SQL})",
    ),
    "file_name_parts": query(
        file_name_parts,
        "SELECT record_id, name, starts_with(upper(name), 'PERTRANS') AND "
        "ends_with(name, '.xml') AS selected, CAST(CAST(try_strptime(substr(name, 9, 10), "
        f"'%Y-%m-%d') AS DATE) AS VARCHAR) AS file_date FROM ({_NAME_SQL})",
    ),
    "error_clip": query(
        error_clip,
        "SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text "
        "ELSE left(text, 2000) || right(text, 2000) END AS clipped FROM documents",
    ),
    "local_time": query(
        local_time,
        "SELECT event_id, ts + INTERVAL 4 HOUR AS local_ts, "
        "year(ts + INTERVAL 4 HOUR) AS local_year FROM events",
    ),
    "key_rejects": query(
        key_rejects,
        f"SELECT customer_fin, full_name, phone FROM ({BRONZE_CUSTOMERS_SQL}) "
        "WHERE customer_id IS NULL",
    ),
    "preview": query(
        preview_orders, f"SELECT iban FROM ({BRONZE_CARDS_SQL}) ORDER BY iban LIMIT 20"
    ),
}
