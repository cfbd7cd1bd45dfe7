"""Bronze and settlement rows made from the given tables.

Each stand-in is a list of plain SQL expressions that both engines run over the whole
table, so a query and its check see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.schemas import SETTLEMENT_RECORD

# Bronze card transactions from orders.
CARDS = {
    "transaction_id": "cast(o_orderkey as string)",
    "customer_id": "cast(o_custkey as int)",
    "card_number": "case when o_orderkey % 97 = 0 then null "
    "else concat('4', lpad(cast(o_custkey as string), 15, '0')) end",
    "iban": "concat('AZ21NABZ', lpad(cast(o_custkey as string), 20, '0'))",
    "transaction_datetime": "case when o_orderkey % 11 = 0 "
    "then substr(cast(o_orderdate as string), 1, 10) "
    "when o_orderkey % 13 = 0 then 'bad' when o_orderkey % 17 = 0 then '2024-02-30 00:00:00' "
    "when o_orderkey % 19 = 0 then null else cast(o_orderdate as string) end",
    "transaction_amount": "cast(o_totalprice as decimal(18, 2))",
    "currency": "case when o_orderkey % 23 = 0 then null when o_orderkey % 4 = 0 then 'azn' "
    "when o_orderkey % 4 = 1 then 'Usd' when o_orderkey % 4 = 2 then 'EUR' else 'gbp' end",
    "card_type": "case when o_orderkey % 37 = 0 then concat(' ', chr(34), 'gold', chr(34), ', ', chr(92), 'x ') "
    "else lower(o_orderpriority) end",
    "transaction_type": "case when o_orderkey % 3 = 0 then 'point-of-sale' "
    "when o_orderkey % 3 = 1 then concat('atm', chr(39), 's fee') else 'e2e test' end",
    "merchant_category": "case when o_custkey % 5 = 0 then 'BUILDING' "
    "when o_custkey % 5 = 1 then 'auto parts' when o_custkey % 5 = 2 then 'home-and-garden' "
    "when o_custkey % 5 = 3 then 'Machinery' else '24h food' end",
    "transaction_status": "case when o_orderkey % 29 = 0 then null "
    "when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'COMPLETED' "
    "when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'Completed ' "
    "else 'pending' end",
    "channel": "case when o_orderkey % 4 = 0 then ' iPhone' when o_orderkey % 4 = 1 "
    "then 'mobile-app' when o_orderkey % 4 = 2 then 'POS' else null end",
    "city": "case when o_custkey % 31 = 0 then null "
    "else concat('gəncə-bakı ', cast(o_custkey % 25 as string)) end",
    "is_international": "case when o_orderkey % 6 = 0 then 'True' when o_orderkey % 6 = 1 "
    "then 'true' when o_orderkey % 6 = 2 then '1' when o_orderkey % 6 = 3 then '0' "
    "when o_orderkey % 6 = 4 then 'TRUE' else null end",
}

# Bronze customers from customer. Keys repeat in pairs and some are missing.
CUSTOMERS = {
    "customer_id": "case when c_custkey % 89 = 0 then null "
    "else cast(floor(c_custkey / 2) as int) end",
    "full_name": "case when c_custkey % 7 = 0 then 'Şəhriyar Öğüz' "
    "when c_custkey % 7 = 1 then 'Ana Maria Lopez' when c_custkey % 7 = 2 then 'Two  Spaces' "
    "when c_custkey % 14 = 3 then 'Юрий Щукин' when c_custkey % 7 = 3 then '' when c_custkey % 7 = 4 then null "
    "when c_custkey % 7 = 5 then concat('José ', c_name) else c_name end",
    "gender": "case when c_custkey % 5 = 0 then 'm' when c_custkey % 5 = 1 then 'Female' "
    "when c_custkey % 5 = 2 then 'x' when c_custkey % 5 = 3 then 'MALE' else null end",
    "birth_date": "case when c_custkey % 6 = 0 then '31/01/1990' "
    "when c_custkey % 6 = 1 then '1990-02-30' when c_custkey % 6 = 2 then '1990-1-5' "
    "when c_custkey % 6 = 3 then null else concat('19', "
    "cast(50 + c_custkey % 50 as string), '-03-', cast(10 + c_custkey % 20 as string)) end",
    "customer_fin": "concat('FIN', cast(c_custkey as string))",
    "email": "concat(c_name, '@Example.COM')",
    "phone": "case when c_custkey % 8 = 0 then '+994 50 111-22-33' "
    "when c_custkey % 8 = 1 then concat('050', lpad(cast(c_custkey as string), 7, '0')) "
    "when c_custkey % 8 = 2 then concat('50-', lpad(cast(c_custkey as string), 7, '1')) "
    "when c_custkey % 8 = 3 then concat('00994', lpad(cast(c_custkey as string), 9, '5')) "
    "when c_custkey % 8 = 4 then 'abc' when c_custkey % 8 = 5 then '' "
    "when c_custkey % 8 = 6 then null else concat('(0', cast(c_custkey as string), ')') end",
    "address": "case when c_custkey % 5 = 0 then concat(' He said ', chr(34), 'hi', chr(34), ', ok ', "
    "chr(92)) when c_custkey % 5 = 1 then concat(chr(34), 'a', chr(34), chr(34), ',', chr(92), chr(34)) "
    "when c_custkey % 5 = 2 then concat(chr(92), 'n, ', chr(34)) "
    "else concat('Nizami ', cast(c_nationkey as string)) end",
    "registration_date": "case when c_custkey % 10 = 9 then 'unknown' else concat('20', "
    "cast(10 + c_custkey % 13 as string), '-0', cast(1 + c_custkey % 9 as string), '-15') end",
    "marital_status": "case when c_custkey % 5 = 0 then 'Single' when c_custkey % 5 = 1 "
    "then 'Married' when c_custkey % 5 = 2 then 'single' when c_custkey % 5 = 3 "
    "then 'Divorced' else null end",
    "education_level": "case when c_custkey % 2 = 0 then 'Bachelor' else null end",
    "customer_segment": "c_mktsegment",
}

# Settlement records from orders: the file a record comes in, and its fields.
SOURCE = "concat('PERTRANS', substr(cast(o_orderdate as string), 1, 7), '-01.xml')"
IS_TRUNCATED = "substr(cast(o_orderdate as string), 6, 2) = '12'"
IS_REMARKED = "substr(cast(o_orderdate as string), 6, 2) = '01'"
SECOND_DELIVERY = "substr(cast(o_orderdate as string), 6, 2) <> '03' OR o_orderkey % 2 = 0"
IS_BROKEN = "o_orderkey % 53 = 0"
_MONTH = "concat(replace(substr(cast(o_orderdate as string), 1, 7), '-', ''), '01')"
_AMOUNT = "cast(cast(o_totalprice as decimal(18, 2)) as string)"
_FIELDS = {
    1: "replace(substr(cast(o_orderdate as string), 1, 10), '-', '')",
    2: f"case when o_orderkey % 101 = 0 then '20240230' else {_MONTH} end",
    3: "concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), "
    "lpad(cast(o_orderkey % 60 as string), 2, '0'), '07')",
    4: "cast(o_orderkey as string)",
    5: "case when o_orderkey % 2 = 0 then 'VISA' else 'MC' end",
    8: CARDS["card_number"],
    9: "concat('A', cast(o_custkey as string))",
    11: f"case when o_orderkey % 103 = 0 then '1,5' else {_AMOUNT} end",
    12: "upper(" + CARDS["currency"] + ")",
    13: "concat('0.', lpad(cast(o_orderkey % 100 as string), 2, '0'))",
    14: "'AZN'",
    16: "case when o_orderkey % 3 = 0 then null else '1.25' end",
    20: "concat('Shop & <', o_orderpriority, '>')",
    23: "o_orderstatus",
}
FIELDS = {
    name: _FIELDS.get(number, "cast(null as string)")
    for number, name in enumerate(SETTLEMENT_RECORD.names, start=1)
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in expressions.items()])


def derive_sql(expressions: dict[str, str], source: str) -> str:
    columns = ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())
    return f"SELECT {columns} FROM {source}"


def bronze_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), CARDS)


def bronze_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "customer"), CUSTOMERS)


BRONZE_CARDS_SQL = derive_sql(CARDS, "orders")
BRONZE_CUSTOMERS_SQL = derive_sql(CUSTOMERS, "customer")
