from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from ledgerleaf.plans import gold, jobs, silver
from ledgerleaf.schemas import CARD_TRANSACTIONS, CUSTOMERS
from ledgerleaf.sinks import write_csv
from ledgerleaf.sources import read_csv, read_csv_by_name
from ledgerleaf.sources.files import MISSING

CUSTOMER_ROWS = [
    (1, "Şəhriyar Öğüz", "m", "1990-01-02", "F1", "A@B.Az", "0501112233", "x", "2020-01-01")
    + ("Single", None, "VIP"),
    (1, "Newer Name", "f", "1990-01-02", "F1", "A@B.Az", "abc", "x", "2021-01-01")
    + ("single", None, "VIP"),
    (2, "One", None, "2024-02-30", "F2", None, None, "x", "31/01/2024", "Divorced", None, "M"),
    (None, "No Id", None, None, None, None, None, None, None, None, None, None),
]


def card(tid, customer, **changes):
    row = {
        "transaction_id": tid,
        "customer_id": customer,
        "card_number": "4169738812345678",
        "iban": "AZ21NABZ00000000137010001944",
        "transaction_datetime": "2024-01-06 10:00:00",
        "transaction_amount": Decimal("10.10"),
        "currency": "usd",
        "card_type": "debit",
        "transaction_type": "point-of-sale",
        "merchant_category": "e2e test",
        "transaction_status": "COMPLETED",
        "channel": "atm's fee",
        "city": "bakı",
        "is_international": "True",
    }
    return tuple((row | changes).values())


CARD_ROWS = [
    card("1", 1),
    card("2", 1, transaction_datetime="2024-01-07 00:00:00", currency="GBP"),
    card("3", 9, transaction_datetime="2024-01-08 00:00:00", city=None),
    card("4", 2, card_number="9999999912345678", transaction_datetime="bad", currency=None),
    card("5", 2, transaction_status="Completed "),
    card("6", 2, transaction_status=None),
    card("7", None, transaction_datetime="2024-01-06 23:00:00"),
]


@pytest.fixture(scope="module")
def customers(spark):
    return silver.customers(spark.createDataFrame(CUSTOMER_ROWS, CUSTOMERS))


@pytest.fixture(scope="module")
def cards(spark):
    return silver.card_transactions(spark.createDataFrame(CARD_ROWS, CARD_TRANSACTIONS))


def test_silver_customers(customers):
    assert customers.columns == [*CUSTOMERS.names, "first_name", "last_name"]
    row = customers.filter("full_name LIKE '%z'").first()
    assert (row.first_name, row.last_name, row.gender) == ("Sehriyar", "Oguz", "Male")
    assert (row.email, row.phone) == ("a@b.az", "+994501112233")
    two = customers.filter("customer_id = 2").first()
    assert (two.last_name, two.birth_date, two.registration_date) == (None, None, None)
    assert (two.marital_status, two.gender) == ("Unknown", "Unknown")


def test_silver_cards(cards):
    assert cards.columns == CARD_TRANSACTIONS.names
    assert {r.transaction_id for r in cards.collect()} == {"1", "2", "3", "4", "7"}
    row = cards.filter("transaction_id = '1'").first()
    assert row.transaction_datetime == datetime(2024, 1, 6, 10)
    assert (row.card_number, row.currency) == ("**** **** **** 5678", "USD")
    assert (row.transaction_type, row.merchant_category) == ("Point-Of-Sale", "E2E Test")
    assert (row.channel, row.city, row.is_international) == ("Atm'S Fee", "Bakı", True)


def test_silver_has_no_python_worker_and_no_shuffle(customers, cards):
    for df in (customers, cards):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


def test_dimensions(spark, cards, customers):
    dates = {r.date: r for r in gold.dim_date(cards).collect()}
    assert len(dates) == 5
    saturday = dates[datetime(2024, 1, 6, 10)]
    assert (saturday.year, saturday.month, saturday.day) == (2024, 1, 6)
    assert (saturday.weekday, saturday.is_weekend) == ("Sat", True)
    assert dates[datetime(2024, 1, 7)].is_weekend and not dates[datetime(2024, 1, 8)].is_weekend
    assert (dates[None].weekday, dates[None].is_weekend) == (None, False)
    assert gold.dim_date(cards, grain="day").count() == 4
    with pytest.raises(ValueError):
        gold.dim_date(cards, grain="hour")
    assert gold.dim_card(cards).count() == 1
    assert gold.dim_merchant(cards).count() == 2
    assert {r.full_name for r in gold.dim_customer(customers).collect()} == {"Newer Name", "One"}
    assert Counter(map(tuple, gold.dim_currency(spark).collect())) == Counter(
        [("AZN", Decimal(1)), ("USD", Decimal("1.7")), ("EUR", Decimal("1.85"))]
    )


def test_fact_keeps_every_transaction_once(cards, customers):
    fact = gold.fact_card_transaction(cards, customers)
    found = {r.transaction_id: r for r in fact.collect()}
    assert fact.count() == len(found) == 5
    assert found["1"].azn_ekv == Decimal("17.170000")
    assert found["2"].azn_ekv is None and found["2"].currency_code == "GBP"
    assert found["4"].azn_ekv is None and found["3"].customer_id == 9
    assert len(fact.columns) == 15


def test_fact_plan_has_one_join_and_no_shuffle(cards, customers):
    plan = gold.fact_card_transaction(cards, customers)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("Join") == 1 and "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in text


def test_joined_star(cards, customers):
    joined = gold.with_customer(cards, gold.dim_customer(customers))
    names = {r.transaction_id: r.full_name for r in joined.collect()}
    assert names == {"1": "Newer Name", "2": "Newer Name", "3": None, "4": "One", "7": None}
    dated = gold.with_date(cards, gold.dim_date(cards, "day"), "day")
    days = {r.transaction_id: r.weekday for r in dated.collect()}
    assert days == {"1": "Sat", "2": "Sun", "3": "Mon", "4": None, "7": "Sat"}


def test_jobs_from_csv_to_star(spark, tmp_path):
    base = str(tmp_path)
    write_csv(spark.createDataFrame(CUSTOMER_ROWS, CUSTOMERS), f"{base}/customers")
    write_csv(spark.createDataFrame(CARD_ROWS, CARD_TRANSACTIONS), f"{base}/cards")
    jobs.build_silver_customers(spark, f"{base}/customers", f"{base}/sc", f"{base}/rejects")
    jobs.build_silver_cards(spark, f"{base}/cards", f"{base}/st")
    assert spark.read.parquet(f"{base}/rejects").count() == 1
    jobs.build_gold(spark, f"{base}/sc", f"{base}/st", f"{base}/gold")
    fact = spark.read.parquet(f"{base}/gold/fact_card_transaction")
    assert fact.count() == 5
    assert fact.schema["azn_ekv"].dataType.simpleString() == "decimal(28,6)"
    assert spark.read.parquet(f"{base}/gold/dim_customer").count() == 2
    jobs.build_gold(spark, f"{base}/sc", f"{base}/st", f"{base}/gold_csv", as_csv=True)
    header = spark.read.option("header", True).csv(f"{base}/gold_csv/dim_date")
    assert header.columns == ["date", "year", "month", "day", "weekday", "is_weekend"]


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rejected_customers_keep_their_text(spark, tmp_path):
    lines = [",".join(CUSTOMERS.names), "12x,A B" + "," * 10, "7,C D" + "," * 10]
    path = write_text(tmp_path / "c.csv", "\n".join(lines) + "\n")
    jobs.build_silver_customers(spark, path, f"{tmp_path}/s", f"{tmp_path}/r")
    assert [r.customer_id for r in spark.read.parquet(f"{tmp_path}/s").collect()] == [7]
    (rejected,) = spark.read.parquet(f"{tmp_path}/r").collect()
    assert (rejected.customer_id, rejected.full_name) == ("12x", "A B")


def test_customers_and_rejects_come_from_one_scan(spark, tmp_path, monkeypatch):
    lines = [",".join(CUSTOMERS.names), "12x,A B" + "," * 10, "7,C D" + "," * 10]
    path = write_text(tmp_path / "c.csv", "\n".join(lines) + "\n")
    plans, stage = [], jobs.staged

    def watched(rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stage(rows, *args)

    monkeypatch.setattr(jobs, "staged", watched)
    parts = jobs.customer_parts(read_csv(spark, path, as_text(CUSTOMERS)))
    assert len(plans) == 1 and plans[0].count("FileScan csv") == 1
    for part in parts:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan and plan.count("FileScan parquet") == 1
        assert "PartitionFilters: [isnotnull(_rejected" in plan and part.columns == CUSTOMERS.names
    assert [[r.full_name for r in part.collect()] for part in parts] == [["C D"], ["A B"]]


def as_text(schema):
    return T.StructType([T.StructField(name, T.StringType()) for name in schema.names])


@pytest.mark.parametrize("as_csv", [False, True])
def test_a_dimension_with_repeated_keys_is_not_written(spark, tmp_path, monkeypatch, as_csv):
    base = str(tmp_path)
    write_csv(spark.createDataFrame(CUSTOMER_ROWS, CUSTOMERS), f"{base}/customers")
    write_csv(spark.createDataFrame(CARD_ROWS, CARD_TRANSACTIONS), f"{base}/cards")
    jobs.build_silver_customers(spark, f"{base}/customers", f"{base}/sc", f"{base}/rejects")
    jobs.build_silver_cards(spark, f"{base}/cards", f"{base}/st")
    monkeypatch.setattr(jobs.gold, "dim_customer", lambda df: df)
    with pytest.raises(ValueError, match="customer_id"):
        jobs.build_gold(spark, f"{base}/sc", f"{base}/st", f"{base}/gold", as_csv=as_csv)
    assert not (tmp_path / "gold" / "dim_customer").exists()


def test_quotes_in_customers_reach_silver(spark, tmp_path):
    """Quotes, commas, backslashes and outer spaces, as a standard writer puts them."""
    names = ['He said "hi", ok', ' "', "a\\", 'b\\"c', " x , y "]
    rows = [[str(i), n, "m", "", "", "", "", n, "", "", "", n] for i, n in enumerate(names)]
    lines = [",".join(CUSTOMERS.names)]
    lines += [",".join('"' + v.replace('"', '""') + '"' for v in row) for row in rows]
    path = write_text(tmp_path / "c.csv", "\n".join(lines) + "\n")
    jobs.build_silver_customers(spark, path, f"{tmp_path}/s", f"{tmp_path}/r")
    found = spark.read.parquet(f"{tmp_path}/s").orderBy("customer_id").collect()
    assert [(r.full_name, r.address, r.customer_segment) for r in found] == [(n, n, n) for n in names]
    jobs.build_silver_customers(spark, path, f"{tmp_path}/csv", f"{tmp_path}/r2", as_csv=True)
    again = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert [r.address for r in again.orderBy("customer_id").collect()] == names


def test_day_grain_of_the_whole_star(spark, tmp_path):
    base = str(tmp_path)
    write_csv(spark.createDataFrame(CUSTOMER_ROWS, CUSTOMERS), f"{base}/customers")
    write_csv(spark.createDataFrame(CARD_ROWS, CARD_TRANSACTIONS), f"{base}/cards")
    jobs.build_silver_customers(spark, f"{base}/customers", f"{base}/sc", f"{base}/rejects")
    jobs.build_silver_cards(spark, f"{base}/cards", f"{base}/st")
    jobs.build_gold(spark, f"{base}/sc", f"{base}/st", f"{base}/gold", grain="day")
    fact = spark.read.parquet(f"{base}/gold/fact_card_transaction")
    days = spark.read.parquet(f"{base}/gold/dim_date")
    assert fact.columns[-1] == "transaction_date"
    dated = fact.filter("transaction_datetime IS NOT NULL")
    assert dated.join(days, dated["transaction_date"] == days["date"]).count() == dated.count() > 0


def test_dotted_column_names(spark, tmp_path):
    names = [*CARD_TRANSACTIONS.names, "amount.usd", "a`b"]
    path = write_text(tmp_path / "t.csv", ",".join(names) + "\n" + ",".join("1" * len(names)) + "\n")
    df = read_csv_by_name(spark, path, CARD_TRANSACTIONS, MISSING)
    assert df.columns == names and df.first()["amount.usd"] == "1"


def test_customer_header_must_match(spark, tmp_path):
    names = list(CUSTOMERS.names)
    names.insert(8, "city")
    path = write_text(tmp_path / "c.csv", ",".join(names) + "\n" + ",".join("1" * 13) + "\n")
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, path, CUSTOMERS).collect()


def test_card_columns_are_found_by_name(spark, tmp_path):
    names = list(reversed(CARD_TRANSACTIONS.names)) + ["branch"]
    values = dict.fromkeys(names, "NA") | {"customer_id": "x", "city": ' "" q', "branch": "b"}
    values["card_number"], values["iban"] = "0012", '"say ""hi"""'
    line = ",".join(values[n] for n in names)
    path = write_text(tmp_path / "t.csv", ",".join(names) + "\n" + line + "\n")
    df = read_csv_by_name(spark, path, CARD_TRANSACTIONS, MISSING)
    assert df.columns == [*CARD_TRANSACTIONS.names, "branch"]
    row = df.first()
    assert (row.card_number, row.iban, row.branch) == ("0012", 'say "hi"', "b")
    assert (row.customer_id, row.currency, row.transaction_amount) == (None, None, None)
    short = write_text(tmp_path / "s.csv", "transaction_id\n1\n")
    with pytest.raises(ValueError, match="columns missing"):
        read_csv_by_name(spark, short, CARD_TRANSACTIONS)
