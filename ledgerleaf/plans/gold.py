"""Silver to gold: five dimensions and one fact."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import latest_per_key
from ledgerleaf.schemas import CARD_KEYS, FACT_COLUMNS, MERCHANT_KEYS, RATE_SCHEMA, RATES


def dim_currency(spark: SparkSession, rates: Mapping[str, Decimal] = RATES) -> DataFrame:
    """The rates as literals of the plan, so that their size is known to the optimizer."""
    code, rate = RATE_SCHEMA.fields
    rows = [
        F.struct(
            F.lit(name).alias(code.name), F.lit(value).cast(rate.dataType).alias(rate.name)
        )
        for name, value in rates.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], RATE_SCHEMA)


def date_key(moment: Column, grain: str = "timestamp") -> Column:
    """The date dimension's key: the moment itself, or its day."""
    if grain not in ("timestamp", "day"):
        raise ValueError(f"grain must be 'timestamp' or 'day', not {grain!r}")
    return moment if grain == "timestamp" else F.to_date(moment)


def dim_date(transactions: DataFrame, grain: str = "timestamp") -> DataFrame:
    key = date_key(F.col("transaction_datetime"), grain).alias("date")
    return transactions.select(key).distinct().select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.date_format("date", "E").alias("weekday"),
        F.coalesce(F.weekday("date") >= 5, F.lit(False)).alias("is_weekend"),
    )


def dim_card(transactions: DataFrame) -> DataFrame:
    return transactions.select(*CARD_KEYS).distinct()


def dim_merchant(transactions: DataFrame) -> DataFrame:
    return transactions.select(*MERCHANT_KEYS).distinct()


def dim_customer(customers: DataFrame) -> DataFrame:
    """One row per customer: the latest registration. Rows without an id are left out."""
    known = customers.filter(F.col("customer_id").isNotNull())
    return latest_per_key(known, "customer_id", "registration_date")


def fact_card_transaction(
    transactions: DataFrame,
    customers: DataFrame,
    rates: Mapping[str, Decimal] = RATES,
    grain: str = "timestamp",
) -> DataFrame:
    """The fact: five left joins, of which only the rate reaches a column.

    The other four right sides are aggregates on their join keys, so the optimizer
    knows that they neither add nor drop rows and removes them: the fact is one scan
    with a join to the rates, without a shuffle. With ``grain="day"`` a last column,
    ``transaction_date``, is the key of a date dimension of days.
    """
    fact = with_rate(transactions, dim_currency(transactions.sparkSession, rates))
    fact = with_date(fact, dim_date(transactions, grain), grain)
    fact = with_merchant(fact, dim_merchant(transactions))
    fact = with_card(fact, dim_card(transactions))
    fact = with_customer(fact, dim_customer(customers))
    in_manat = F.col("transaction_amount") * F.col("conversion_rate")
    day = [F.col("date").alias("transaction_date")] if grain == "day" else []
    return fact.withColumns({"azn_ekv": in_manat, "currency_code": F.col("currency")}).select(
        *FACT_COLUMNS, *day
    )


# Left joins to dimensions of one row per key. Null keys match nothing; adaptive execution
# splits keys with many rows.


def with_customer(fact: DataFrame, customer: DataFrame) -> DataFrame:
    return fact.join(customer, "customer_id", "left")


def with_card(fact: DataFrame, card: DataFrame) -> DataFrame:
    return fact.join(card, CARD_KEYS, "left")


def with_merchant(fact: DataFrame, merchant: DataFrame) -> DataFrame:
    return fact.join(merchant, MERCHANT_KEYS, "left")


def with_date(fact: DataFrame, dates: DataFrame, grain: str = "timestamp") -> DataFrame:
    keyed = fact.withColumn("date", date_key(F.col("transaction_datetime"), grain))
    return keyed.join(dates, "date", "left")


def with_rate(fact: DataFrame, rate: DataFrame) -> DataFrame:
    """Left join to the rates; a currency without a rate has a null rate."""
    return fact.join(rate, F.col("currency") == F.col("currency_code"), "left")
