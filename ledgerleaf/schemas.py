"""Declared schemas and the fixed values that results depend on."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Bronze customer columns, in file order.
CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.IntegerType()),
        *_text(
            "full_name", "gender", "birth_date", "customer_fin", "email", "phone", "address",
            "registration_date", "marital_status", "education_level", "customer_segment",
        ),
    ]
)

# Bronze card-transaction columns. They are found by name, so the order in
# a file is free. Card number and IBAN are text: as numbers they lose digits when a value
# is missing.
CARD_TRANSACTIONS = T.StructType(
    [
        *_text("transaction_id"),
        T.StructField("customer_id", T.IntegerType()),
        *_text("card_number", "iban", "transaction_datetime"),
        T.StructField("transaction_amount", T.DecimalType(18, 2)),
        *_text(
            "currency", "card_type", "transaction_type", "merchant_category",
            "transaction_status", "channel", "city", "is_international",
        ),
    ]
)

TITLE_CASED = [
    "card_type",
    "transaction_type",
    "merchant_category",
    "transaction_status",
    "channel",
    "city",
]

CARD_KEYS = ["card_number", "card_type", "iban"]
MERCHANT_KEYS = ["merchant_category", "city", "channel", "is_international"]

# The fact's columns, in order.
FACT_COLUMNS = [
    "transaction_id",
    "transaction_datetime",
    "customer_id",
    "card_number",
    "card_type",
    "iban",
    "merchant_category",
    "city",
    "channel",
    "is_international",
    "currency_code",
    "transaction_amount",
    "azn_ekv",
    "transaction_type",
    "transaction_status",
]

# First letter of a gender, marital statuses, and the label of all others.
GENDERS = {"m": "Male", "f": "Female"}
MARITAL_STATUSES = {"Single": "Single", "Married": "Married"}
UNKNOWN = "Unknown"

# Rate of each currency to the manat.
RATES = {"AZN": Decimal("1.0000"), "USD": Decimal("1.7000"), "EUR": Decimal("1.8500")}

RATE_SCHEMA = T.StructType(
    [
        T.StructField("currency_code", T.StringType(), False),
        T.StructField("conversion_rate", T.DecimalType(9, 4), False),
    ]
)

# Settlement file layout.
SETTLEMENT_PREFIX = "PERTRANS"
SETTLEMENT_SUFFIX = ".xml"
ROOT_TAG = "OPERATIONS"
ROW_TAG = "TRN"

SETTLEMENT_RECORD = T.StructType(
    [T.StructField(f"FLD_{n:03d}", T.StringType()) for n in range(1, 30)]
)

# Names of fields 004 to 029, in field order.
SETTLEMENT_TEXT_COLUMNS = [
    "APPROVAL_CODE",
    "SERVICE_BRAND",
    "ISSUER_PRODUCT",
    "SERVICE_REFERENCE",
    "CARD_NUMBER",
    "ACQ_REF_NO",
    "RTR_REF_NO",
    "AMOUNT",
    "CCY",
    "ACQ_FEE",
    "ACQ_FEE_CCY",
    "ACQ_FEE_SIGN",
    "ISS_FEE",
    "ISS_FEE_SIGN",
    "ISS_FEE_CCY",
    "MMC",
    "MERCHANT_NAME",
    "MERCHANT_ID",
    "TERMINAL_ID",
    "TRN_TYPE",
    "CARD_INPUT",
    "CARD_PRE_IND",
    "OPER_ENV",
    "TRN_LIFECYCLE",
    "ACQ_ID_ACQ",
    "ACQ_ID_ISS",
]

SETTLEMENT_DECIMALS = ["AMOUNT", "ACQ_FEE", "ISS_FEE"]

# Columns of the log and audit tables. Row counts are bigint, to hold any file.
LOAD_LOG_COLUMNS = [
    "FILE_NAME",
    "PARSE_STATUS",
    "FILE_ROW_CNT",
    "PARSE_ROW_CNT",
    "ERROR_DESC",
    "INSERT_DATE",
    "INSERT_YEAR",
    "START_DT",
    "END_DT",
    "JOB_NAME",
    "FILE_DATE",
]

TABLE_LOG_COLUMNS = [
    "report_date",
    "source_table_name",
    "hms_table_name",
    "start_time",
    "end_time",
    "hms_count",
    "dag_id",
    "task_id",
    "task_state",
    "task_error_message",
]

DAILY_AUDIT_COLUMNS = [
    "report_date",
    "source_name",
    "target_name",
    "start_dt",
    "end_dt",
    "source_count",
    "target_count",
    "count_state",
]
