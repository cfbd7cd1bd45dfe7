"""SQL texts shared by the checks; dates as text, amounts as double."""

from __future__ import annotations

from ledgerleaf.catalogue.standins import BRONZE_CARDS_SQL, BRONZE_CUSTOMERS_SQL

FOLD_FROM = "əƏıİşŞçÇöÖğĞüÜáàâäãåéèêëíìîïñóòôõúùûýÁÀÂÄÃÅÉÈÊËÍÌÎÏÑÓÒÔÕÚÙÛÝрийукн"
FOLD_TO = "eEiIsScCoOgGuUaaaaaaeeeeiiiinoooouuuyAAAAAAEEEEIIIINOOOOUUUYriiukn"


def title(text: str) -> str:
    runs = f"regexp_extract_all({text}, '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def fold(text: str) -> str:
    single = f"translate({text}, '{FOLD_FROM}', '{FOLD_TO}')"
    return f"replace(replace(replace({single}, 'ß', 'ss'), 'Ю', 'Iu'), 'Щ', 'Shch')"


def day(text: str, pattern: str = "____-__-__", fmt: str = "%Y-%m-%d") -> str:
    return f"CASE WHEN {text} LIKE '{pattern}' THEN CAST(try_strptime({text}, '{fmt}') AS DATE) END"


def moment(text: str) -> str:
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
    return (
        f"CASE WHEN regexp_matches({text}, '{shape}') "
        f"THEN try_strptime({text}, '%Y-%m-%d %H:%M:%S') END"
    )


def phone(text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN {text} IS NULL OR {text} = '' THEN NULL "
        f"WHEN starts_with({digits}, '994') THEN '+' || {digits} "
        f"WHEN starts_with({digits}, '0') THEN '+994' || substr({digits}, 2) "
        f"ELSE '+994' || {digits} END"
    )


def boolean(text: str) -> str:
    return f"COALESCE(lower({text}) IN ('true', '1'), FALSE)"


GENDER = (
    "CASE WHEN lower(gender) LIKE 'm%' THEN 'Male' "
    "WHEN lower(gender) LIKE 'f%' THEN 'Female' ELSE 'Unknown' END"
)
MARITAL = (
    "CASE WHEN marital_status IN ('Single', 'Married') THEN marital_status ELSE 'Unknown' END"
)

SILVER_CUSTOMERS = f"""
SELECT customer_id, full_name, {GENDER} AS gender,
  CAST({day("birth_date")} AS VARCHAR) AS birth_date, customer_fin, lower(email) AS email,
  {phone("phone")} AS phone, address,
  CAST({day("registration_date")} AS VARCHAR) AS registration_date,
  {MARITAL} AS marital_status, education_level, customer_segment,
  {fold("string_split(full_name, ' ')[1]")} AS first_name,
  {fold("string_split(full_name, ' ')[2]")} AS last_name
FROM ({BRONZE_CUSTOMERS_SQL})
"""

SILVER_CARDS_EXACT = f"""
SELECT transaction_id, customer_id, '**** **** **** ' || right(card_number, 4) AS card_number,
  'AZ**********************' || right(iban, 4) AS iban,
  {moment("transaction_datetime")} AS transaction_datetime, transaction_amount,
  upper(currency) AS currency, {title("card_type")} AS card_type,
  {title("transaction_type")} AS transaction_type,
  {title("merchant_category")} AS merchant_category,
  {title("transaction_status")} AS transaction_status, {title("channel")} AS channel,
  {title("city")} AS city, {boolean("is_international")} AS is_international
FROM ({BRONZE_CARDS_SQL}) WHERE lower(transaction_status) = 'completed'
"""

SILVER_CARDS = f"""
SELECT * REPLACE (CAST(transaction_amount AS VARCHAR) AS transaction_amount)
FROM ({SILVER_CARDS_EXACT})
"""

DIM_CUSTOMER = f"""
SELECT * FROM ({SILVER_CUSTOMERS}) WHERE customer_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY customer_id
  ORDER BY registration_date DESC NULLS LAST, full_name DESC NULLS LAST, gender DESC,
    birth_date DESC NULLS LAST, customer_fin DESC) = 1
"""

RATES = "(VALUES ('AZN', 1.0), ('USD', 1.7), ('EUR', 1.85)) AS r(currency_code, rate)"


def dim_date(key: str) -> str:
    return f"""
SELECT DISTINCT {key} AS date, year({key}) AS year, month({key}) AS month, day({key}) AS day,
  strftime({key}, '%a') AS weekday, COALESCE(isodow({key}) IN (6, 7), FALSE) AS is_weekend
FROM ({SILVER_CARDS_EXACT})
"""


DIM_CARD = f"SELECT DISTINCT card_number, card_type, iban FROM ({SILVER_CARDS_EXACT})"
DIM_MERCHANT = f"""
SELECT DISTINCT merchant_category, city, channel, is_international FROM ({SILVER_CARDS_EXACT})
"""
