"""Jobs: read, transform, write. Paths and connections are parameters."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.operators import require_unique
from ledgerleaf.plans import gold, silver
from ledgerleaf.schemas import CARD_KEYS, CARD_TRANSACTIONS, CUSTOMERS, MERCHANT_KEYS, RATES
from ledgerleaf.sinks import write_csv, write_parquet
from ledgerleaf.sources import read_csv, read_csv_files, read_jdbc_table, read_parquet
from ledgerleaf.sources.files import MISSING
from ledgerleaf.workdir import staged

_REJECTED = "_rejected"


def build_silver_customers(
    spark: SparkSession, source: str, target: str, rejects: str, as_csv: bool = False
) -> None:
    """Customers CSV to silver; rows without a valid id go to ``rejects`` as text, in Parquet.

    The source is scanned once, into a staged table of two partitions, one for each output.
    """
    write = write_csv if as_csv else write_parquet
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in CUSTOMERS.names])
    known, unknown = customer_parts(read_csv(spark, source, as_text))
    write(silver.customers(known), target)
    write_parquet(unknown, rejects)


def customer_parts(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers with a valid id, which is typed, and the others as text, by one scan."""
    customer_id = F.col("customer_id").try_cast(CUSTOMERS["customer_id"].dataType)
    flagged = staged(bronze.withColumn(_REJECTED, customer_id.isNull()), "customers", [_REJECTED])
    known, unknown = (flagged.filter(c).drop(_REJECTED) for c in (~F.col(_REJECTED), F.col(_REJECTED)))
    return known.withColumn("customer_id", customer_id), unknown


def build_silver_cards(
    spark: SparkSession, source: str, target: str, as_csv: bool = False
) -> None:
    bronze = read_csv_files(spark, source, CARD_TRANSACTIONS, MISSING)
    write = write_csv if as_csv else write_parquet
    write(silver.card_transactions(bronze), target)


def build_gold(
    spark: SparkSession,
    customers: str,
    transactions: str,
    target: str,
    grain: str = "timestamp",
    rates: Mapping[str, Decimal] = RATES,
    as_csv: bool = False,
) -> None:
    """The star schema under ``target``, one folder per table.

    Each dimension reads only its own columns of the silver Parquet, is staged, and is refused
    before it is written if it repeats a key. With ``grain="day"`` the fact's ``transaction_date`` is the date key.
    """
    write = write_csv if as_csv else write_parquet
    customer = read_parquet(spark, customers)
    cards = read_parquet(spark, transactions)
    dimensions = {
        "dim_currency": (gold.dim_currency(spark, rates), ["currency_code"]),
        "dim_date": (gold.dim_date(cards, grain), ["date"]),
        "dim_card": (gold.dim_card(cards), CARD_KEYS),
        "dim_merchant": (gold.dim_merchant(cards), MERCHANT_KEYS),
        "dim_customer": (gold.dim_customer(customer), ["customer_id"]),
    }
    for name, (rows, keys) in dimensions.items():
        write(require_unique(staged(rows, name), keys), f"{target}/{name}")
    fact = gold.fact_card_transaction(cards, customer, rates, grain)
    write(fact, f"{target}/fact_card_transaction")


def snapshot_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    target: str,
    split_column: str | None = None,
    partitions: int = 32,
    conditions: list[str] | None = None,
    single_task: bool = False,
    tie_column: str | None = None,
) -> None:
    """A database table to Parquet, read in parallel parts.

    ``split_column`` or ``conditions`` divide it, ``tie_column`` into parts of equal size; a table that is to go through one task
    has to be named as such by ``single_task``.
    """
    if split_column is None and not conditions and not single_task:
        raise ValueError("give split_column or conditions, or choose single_task")
    rows = read_jdbc_table(
        spark, url, table, properties, split_column, partitions, conditions, tie_column
    )
    write_parquet(rows, target)
