from collections import Counter
from datetime import UTC, date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerleaf import operators as op
from ledgerleaf.plans import gold


def rows(df):
    return Counter(map(tuple, df.collect()))


relaxed = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
key = st.one_of(st.none(), st.integers(0, 8), st.just(3))


def test_hot_and_null_keys_are_split_by_adaptive_execution(spark):
    """Half of the rows on one card, some without a key: the joins of the star need no help."""
    facts = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot"))
        .when(F.col("id") % 50 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("id").cast("string"))
        .alias("card_number"),
        F.lit("Visa").alias("card_type"),
        F.lit("AZ").alias("iban"),
        F.sha2(F.col("id").cast("string"), 256).alias("wide"),
    )
    dimension = gold.dim_card(facts).withColumn("in_dimension", F.lit(True))
    stored = dimension.repartition(4)
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings_}
    try:
        for name, value in settings_.items():
            spark.conf.set(name, value)
        joined = gold.with_card(facts, stored)
        found = joined.groupBy().agg(
            F.count(F.lit(1)), F.count("in_dimension"), F.count_distinct("wide")
        )
        assert tuple(found.collect()[0]) == (200_000, 196_000, 200_000)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "skew=true" in plan


def test_dimension_with_repeated_keys_is_refused(spark):
    dimension = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    with pytest.raises(ValueError, match="more than one row"):
        op.require_unique(dimension, ["k"])
    once = dimension.filter("v <> 'b'")
    assert op.require_unique(once, ["k"]) is once


def test_latest_per_key_has_a_stated_rule(spark):
    df = spark.createDataFrame(
        [
            (1, "a", date(2020, 1, 1)),
            (1, "b", date(2021, 1, 1)),
            (1, "c", None),
            (2, "x", None),
            (2, "y", None),
            (3, None, date(2020, 1, 1)),
        ],
        "k int, n string, d date",
    )
    assert rows(op.latest_per_key(df, "k", "d").select("k", "n")) == Counter(
        [(1, "b"), (2, "y"), (3, None)]
    )


def test_null_keys_are_rejected_not_lost(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    known, rejected = op.split_null_keys(df, "k")
    assert (known.count(), rejected.count()) == (2, 1)


def counts(spark, *values):
    return spark.createDataFrame(
        list(values), "FILE_NAME string, FILE_DATE date, ROW_CNT bigint"
    )


DAY = date(2024, 1, 1)


def test_reconcile_equal_unequal_and_one_sided(spark):
    source = counts(spark, ("a", DAY, 3), ("b", DAY, 3), ("c", DAY, 1), ("n", None, 2))
    target = counts(spark, ("a", DAY, 3), ("b", DAY, 2), ("d", DAY, 1), ("n", None, 2))
    result = {r.FILE_NAME: r.count_state for r in op.reconcile(source, target).collect()}
    assert result == {"a": "success", "b": "fail", "c": "fail", "d": "fail", "n": "success"}


@pytest.fixture
def outcome(spark):
    return spark.createDataFrame(
        [("a", DAY, 3, 3, "success", None), ("b", DAY, 4, 0, "fail", "x" * 5000)],
        "FILE_NAME string, FILE_DATE date, source_count bigint, target_count bigint, "
        "count_state string, error string",
    )


AT = datetime(2023, 12, 31, 21, 0)


def test_load_log(outcome):
    good, bad = op.load_log(outcome, AT, AT, AT, "JOB").orderBy("FILE_NAME").collect()
    assert good.asDict() == {
        "FILE_NAME": "a",
        "PARSE_STATUS": "Success",
        "FILE_ROW_CNT": 3,
        "PARSE_ROW_CNT": 3,
        "ERROR_DESC": None,
        "INSERT_DATE": datetime(2024, 1, 1, 1, 0),
        "INSERT_YEAR": 2024,
        "START_DT": datetime(2024, 1, 1, 1, 0),
        "END_DT": datetime(2024, 1, 1, 1, 0),
        "JOB_NAME": "JOB",
        "FILE_DATE": DAY,
    }
    assert (bad.PARSE_STATUS, bad.FILE_ROW_CNT, bad.PARSE_ROW_CNT) == ("Fail", 0, 0)
    assert len(bad.ERROR_DESC) == 4000


def test_log_times_do_not_depend_on_the_session_zone(spark, outcome):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = op.load_log(outcome, AT, AT, AT.replace(tzinfo=UTC), "JOB").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.START_DT == row.INSERT_DATE == datetime(2024, 1, 1, 1, 0)


def test_table_log_and_daily_audit(outcome):
    log = op.table_log(outcome, "t", AT, AT, "dag", "task")
    assert log.columns[0] == "report_date" and [r.source_table_name for r in log.collect()] == ["a"]
    good, bad = op.daily_audit(outcome, "t", "task").orderBy("source_name").collect()
    assert (good.source_name, good.source_count, good.count_state) == ("task/a", 3, "success")
    assert (bad.source_count, bad.target_count, bad.count_state) == (None, None, None)
    assert bad.start_dt == bad.end_dt == DAY
