"""Queries for the silver tables, the dimensions, the joins and the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.catalogue import oracle as sql
from ledgerleaf.catalogue.registry import Query, query
from ledgerleaf.catalogue.standins import BRONZE_CARDS_SQL, bronze_cards, bronze_customers
from ledgerleaf.plans import gold, silver
from ledgerleaf.schemas import CARD_KEYS, MERCHANT_KEYS


def silver_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.customers(bronze_customers(spark, sf_dir))


def silver_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.card_transactions(bronze_cards(spark, sf_dir))


def dim_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate table against the currencies that occur, with or without a rate."""
    seen = bronze_cards(spark, sf_dir).select(F.upper("currency").alias("currency"))
    return gold.with_rate(seen.distinct(), gold.dim_currency(spark))


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_date(silver_card(spark, sf_dir))


def dim_date_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_date(silver_card(spark, sf_dir), grain="day")


def dim_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_card(silver_card(spark, sf_dir))


def dim_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_merchant(silver_card(spark, sf_dir))


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dim_customer(silver_customer(spark, sf_dir))


def join_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole customer dimension beside each transaction."""
    facts = silver_card(spark, sf_dir).select("transaction_id", "customer_id")
    return gold.with_customer(facts, dim_customer(spark, sf_dir))


def join_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card dimension by its three keys; ``in_dimension`` is null where none matches."""
    facts = silver_card(spark, sf_dir).select("transaction_id", *CARD_KEYS)
    return gold.with_card(facts, gold.dim_card(facts).withColumn("in_dimension", F.lit(True)))


def join_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merchant dimension by its four keys, some of which are null."""
    facts = silver_card(spark, sf_dir).select("transaction_id", *MERCHANT_KEYS)
    dimension = gold.dim_merchant(facts).withColumn("in_dimension", F.lit(True))
    return gold.with_merchant(facts, dimension)


def join_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = silver_card(spark, sf_dir).select("transaction_id", "transaction_datetime")
    return gold.with_date(facts, gold.dim_date(facts)).drop("date")


def fact_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with a day key, and the day's row of the date dimension."""
    cards = silver_card(spark, sf_dir)
    fact = gold.fact_card_transaction(cards, silver_customer(spark, sf_dir), grain="day")
    days = gold.dim_date(cards, "day").withColumnRenamed("date", "transaction_date")
    chosen = fact.select("transaction_id", "transaction_datetime", "transaction_date")
    return chosen.join(days, "transaction_date", "left")


def join_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = silver_card(spark, sf_dir).select("transaction_id", "currency")
    return gold.with_rate(facts, gold.dim_currency(spark))


def fact_card_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.fact_card_transaction(
        silver_card(spark, sf_dir), silver_customer(spark, sf_dir)
    )


_FACT = f"""
SELECT t.transaction_id, t.transaction_datetime, t.customer_id, t.card_number, t.card_type,
  t.iban, t.merchant_category, t.city, t.channel, t.is_international,
  t.currency AS currency_code, CAST(t.transaction_amount AS VARCHAR) AS transaction_amount,
  CAST(t.transaction_amount * CAST(r.rate AS DECIMAL(9, 4)) AS VARCHAR) AS azn_ekv,
  t.transaction_type, t.transaction_status
FROM ({sql.SILVER_CARDS_EXACT}) t
LEFT JOIN ({sql.DIM_CUSTOMER}) c ON t.customer_id = c.customer_id
LEFT JOIN ({sql.DIM_CARD}) k ON t.card_number = k.card_number AND t.card_type = k.card_type
  AND t.iban = k.iban
LEFT JOIN ({sql.DIM_MERCHANT}) m ON t.merchant_category = m.merchant_category
  AND t.city = m.city AND t.channel = m.channel AND t.is_international = m.is_international
LEFT JOIN ({sql.dim_date("transaction_datetime")}) d ON t.transaction_datetime = d.date
LEFT JOIN {sql.RATES} ON t.currency = r.currency_code
"""

QUERIES: dict[str, Query] = {
    "silver_customer": query(silver_customer, sql.SILVER_CUSTOMERS),
    "silver_card": query(silver_card, sql.SILVER_CARDS),
    "dim_currency": query(
        dim_currency,
        "SELECT s.currency, r.currency_code, CAST(CAST(r.rate AS DECIMAL(9, 4)) AS VARCHAR) AS conversion_rate FROM "
        f"(SELECT DISTINCT upper(currency) AS currency FROM ({BRONZE_CARDS_SQL})) s "
        f"LEFT JOIN {sql.RATES} ON s.currency = r.currency_code",
    ),
    "dim_date": query(dim_date, sql.dim_date("transaction_datetime")),
    "dim_date_by_day": query(
        dim_date_by_day,
        "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM "
        f"({sql.dim_date('CAST(transaction_datetime AS DATE)')})",
    ),
    "dim_card": query(dim_card, sql.DIM_CARD),
    "dim_merchant": query(dim_merchant, sql.DIM_MERCHANT),
    "dim_customer": query(dim_customer, sql.DIM_CUSTOMER),
    "join_customer": query(
        join_customer,
        "SELECT t.customer_id, t.transaction_id, c.* EXCLUDE (customer_id) "
        f"FROM ({sql.SILVER_CARDS_EXACT}) t LEFT JOIN ({sql.DIM_CUSTOMER}) c "
        "ON t.customer_id = c.customer_id",
    ),
    "join_card": query(
        join_card,
        "SELECT t.card_number, t.card_type, t.iban, t.transaction_id, k.in_dimension FROM "
        f"({sql.SILVER_CARDS_EXACT}) t LEFT JOIN (SELECT *, TRUE AS in_dimension "
        f"FROM ({sql.DIM_CARD})) k ON t.card_number = k.card_number "
        "AND t.card_type = k.card_type AND t.iban = k.iban",
    ),
    "join_merchant": query(
        join_merchant,
        "SELECT t.merchant_category, t.city, t.channel, t.is_international, t.transaction_id, "
        f"m.in_dimension FROM ({sql.SILVER_CARDS_EXACT}) t LEFT JOIN "
        f"(SELECT *, TRUE AS in_dimension FROM ({sql.DIM_MERCHANT})) m "
        "ON t.merchant_category = m.merchant_category AND t.city = m.city "
        "AND t.channel = m.channel AND t.is_international = m.is_international",
    ),
    "join_date": query(
        join_date,
        "SELECT t.transaction_id, t.transaction_datetime, d.year, d.month, d.day, d.weekday, "
        f"d.is_weekend FROM ({sql.SILVER_CARDS_EXACT}) t LEFT JOIN "
        f"({sql.dim_date('transaction_datetime')}) d ON t.transaction_datetime = d.date",
    ),
    "join_rate": query(
        join_rate,
        "SELECT t.transaction_id, t.currency, r.currency_code, CAST(CAST(r.rate AS DECIMAL(9, 4)) AS VARCHAR) AS "
        f"conversion_rate FROM ({sql.SILVER_CARDS_EXACT}) t LEFT JOIN {sql.RATES} "
        "ON t.currency = r.currency_code",
    ),
    "fact_card_transaction": query(fact_card_transaction, _FACT),
    "fact_by_day": query(
        fact_by_day,
        "SELECT t.transaction_id, t.transaction_datetime, CAST(d.date AS VARCHAR) AS "
        "transaction_date, d.year, d.month, d.day, d.weekday, d.is_weekend "
        f"FROM ({sql.SILVER_CARDS_EXACT}) t LEFT JOIN "
        f"({sql.dim_date('CAST(transaction_datetime AS DATE)')}) d "
        "ON CAST(t.transaction_datetime AS DATE) = d.date",
    ),
}
