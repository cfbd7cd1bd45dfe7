from collections import Counter, defaultdict
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import file_status, is_complete
from ledgerleaf.plans import settlement
from ledgerleaf.plans.settlement import JdbcTarget, LoadFailed, LogNames, load_settlement
from ledgerleaf.schemas import SETTLEMENT_RECORD
from ledgerleaf.sinks import append_table
from ledgerleaf.sources import (
    read_table,
    read_xml,
    select_settlement_files,
    xml_chunks,
    xml_records,
)

NAMES = LogNames("JOB", "dag", "task")
RUN = date(2024, 6, 30)


def record(number, day="20240101", amount="12.50", indent="  "):
    return (
        f"{indent}<TRN>\n<FLD_001>{day}</FLD_001><FLD_002>{day}</FLD_002>"
        f"<FLD_003>10203{number % 10}</FLD_003><FLD_004>{number}</FLD_004>"
        f"<FLD_008>416973881234{number:04d}</FLD_008><FLD_011>{amount}</FLD_011>"
        f"<FLD_020>A &amp; B</FLD_020>\n{indent}</TRN>\n"
    )


def deliver(folder, name, *records, end="</OPERATIONS>\n"):
    path = folder / name
    path.write_text('<?xml version="1.0"?>\n<OPERATIONS>\n' + "".join(records) + end)
    return str(path)


class Logs:
    def __init__(self):
        self.rows = defaultdict(list)

    def __call__(self, name, df):
        self.rows[name] += df.collect()


@pytest.fixture
def table(spark, request):
    name = f"t_{abs(hash(request.node.name))}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_selection():
    names = "in/PERTRANS2024-01-01.xml,pertrans2024-01-02.xml,PERTRANSx.XML,other.xml,a.txt"
    assert select_settlement_files(names) == [
        "in/PERTRANS2024-01-01.xml",
        "pertrans2024-01-02.xml",
    ]


def test_cut_read_equals_whole_file_read_at_any_split(spark, tmp_path):
    path = deliver(tmp_path, "PERTRANS2024-01-01.xml", *[record(i) for i in range(2000)])
    whole = read_xml(spark, path, SETTLEMENT_RECORD)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10007")
    try:
        chunks = xml_chunks(spark, path)
        assert chunks.rdd.getNumPartitions() > 20
        cut = Counter(map(tuple, xml_records(chunks, SETTLEMENT_RECORD).collect()))
        status = file_status(chunks).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert cut == Counter(map(tuple, whole.collect())) and cut.total() == 2000
    assert (status.complete, status.records, status.cuttable) == (True, 2000, True)


def test_completeness_of_one_file(spark, tmp_path):
    good = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1))
    cut = deliver(tmp_path, "PERTRANS2024-01-02.xml", record(1), end="  <TRN><FLD_0")
    assert is_complete(spark.read.text(good), "value")
    assert not is_complete(spark.read.text(cut), "value")


def test_load(spark, tmp_path, table):
    bad_amount = record(3, day="20240230", amount="1,5")
    one = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1), record(2), bad_amount)
    two = deliver(tmp_path, "pertrans2024-01-02 a+b%c.xml", record(4, day="20240103"))
    empty = deliver(tmp_path, "PERTRANS2024-01-03.xml")
    logs = Logs()
    outcome = load_settlement(spark, [one, two, empty, "x.txt"], table, NAMES, logs, RUN)
    assert Counter(r.count_state for r in outcome.collect()) == Counter(success=3)
    loaded = spark.table(table)
    assert loaded.count() == 4 and len(loaded.columns) == 32
    row = loaded.filter("APPROVAL_CODE = '1'").first()
    assert (row.STTL_DATE, row.TRN_DATE) == (date(2024, 1, 1), date(2024, 1, 1))
    assert row.TRN_TIME == datetime(2024, 1, 1, 10, 20, 31)
    assert (row.AMOUNT, row.MERCHANT_NAME) == (Decimal("12.5"), "A & B")
    assert (row.CARD_NUMBER, row.ISS_FEE) == ("**** **** **** 0001", None)
    assert (row.FILE_NAME, row.FILE_DATE) == ("PERTRANS2024-01-01.xml", date(2024, 1, 1))
    assert row.INSERT_DATE == RUN
    bad = loaded.filter("APPROVAL_CODE = '3'").first()
    assert (bad.TRN_DATE, bad.TRN_TIME, bad.AMOUNT) == (None, None, None)
    assert Counter(r.PARSE_STATUS for r in logs.rows["load_log"]) == Counter(Success=3)
    counts = {r.source_table_name: r.hms_count for r in logs.rows["table_log"]}
    assert sorted(counts.values()) == [0, 1, 3]
    assert {r.count_state for r in logs.rows["daily_audit"]} == {"success"}


def test_failed_files_are_logged_and_the_others_loaded(spark, tmp_path, table):
    good = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1))
    cut = deliver(tmp_path, "PERTRANS2024-01-02.xml", record(1), record(2), end="  <TRN><FLD_0")
    dateless = deliver(tmp_path, "PERTRANS-2024.xml", record(1))
    absent = str(tmp_path / "PERTRANS2024-01-09.xml")
    logs = Logs()
    with pytest.raises(LoadFailed, match="3 of 4 files failed"):
        load_settlement(spark, [dateless, cut, absent, good], table, NAMES, logs, RUN)
    assert [r.FILE_NAME for r in spark.table(table).collect()] == ["PERTRANS2024-01-01.xml"]
    status = {r.FILE_NAME: r for r in logs.rows["load_log"]}
    assert status["PERTRANS2024-01-01.xml"].PARSE_STATUS == "Success"
    assert "not complete" in status["PERTRANS2024-01-02.xml"].ERROR_DESC
    assert "no date" in status["PERTRANS-2024.xml"].ERROR_DESC
    assert status["PERTRANS2024-01-09.xml"].PARSE_STATUS == "Fail"
    assert {r.FILE_ROW_CNT for r in status.values() if r.PARSE_STATUS == "Fail"} == {0}
    failed = [r for r in logs.rows["daily_audit"] if r.count_state is None]
    assert len(failed) == 3


def test_broken_records_are_rejected_and_counted(spark, tmp_path, table):
    broken = record(7).replace("A &amp; B", "A & B") + record(8).replace("</FLD_004>", "")
    cut = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1), broken, record(2))
    whole = deliver(tmp_path, "PERTRANS2024-01-02.xml", record(3), "<!-- x -->", record(4))
    logs = Logs()
    outcome = load_settlement(spark, [cut, whole], table, NAMES, logs, RUN)
    counts = {r.FILE_DATE.day: (r.source_count, r.target_count, r.rejected_count, r.count_state) for r in outcome.collect()}
    assert counts == {1: (4, 2, 2, "success"), 2: (2, 2, 0, "success")}
    assert sorted(r.APPROVAL_CODE for r in spark.table(table).collect()) == ["1", "2", "3", "4"]
    assert sorted(r.REJECT_TEXT.count("<FLD_004>7<") for r in logs.rows["rejects"]) == [0, 1]
    text = {r.FILE_NAME: r.ERROR_DESC for r in logs.rows["load_log"]}
    assert text == {"PERTRANS2024-01-01.xml": "Rejected records: 2", "PERTRANS2024-01-02.xml": None}


def test_broken_record_in_a_file_read_whole(spark, tmp_path, table):
    broken = "<TRN/>\n" + record(8).replace("A &amp; B", "A & B")
    path = deliver(tmp_path, "PERTRANS2024-01-02.xml", record(3), broken)
    logs = Logs()
    outcome = load_settlement(spark, [path], table, NAMES, logs, RUN).first()
    assert outcome.source_count == outcome.target_count + outcome.rejected_count
    assert spark.table(table).count() == outcome.target_count >= 1
    assert {r.REJECT_TEXT for r in logs.rows["rejects"]} <= {None}


def spoil(path):
    """A wrong checksum beside the file makes every read of it fail."""
    folder, name = path.rsplit("/", 1)
    with open(f"{folder}/.{name}.crc", "wb") as out:
        out.write(b"crc\0\0\0\2\0" + b"\1\2\3\4" * 99)


def counting(monkeypatch, *names):
    """Counts the calls of functions of the job, which go on as they are."""
    calls = Counter()

    def wrapped(name, function):
        def call(*args, **kwargs):
            calls[name] += 1
            return function(*args, **kwargs)

        return call

    for name in names:
        monkeypatch.setattr(settlement, name, wrapped(name, getattr(settlement, name)))
    return calls


def errors_by_day(logs):
    return {r.FILE_NAME[-6:-4]: r.ERROR_DESC for r in logs.rows["load_log"]}


def test_unreadable_files_are_found_together_and_the_others_loaded(spark, tmp_path, table, monkeypatch):
    paths = [deliver(tmp_path, f"PERTRANS2024-01-0{i}.xml", *[record(j) for j in range(99)]) for i in range(1, 8)]
    for path in (paths[1], paths[4]):
        spoil(path)
    absent = [str(tmp_path / f"PERTRANS2024-01-1{i}.xml") for i in range(3)]
    # A file that hides row tags beside the unreadable ones, and one of these.
    hiding = "".join(hidden_records("short")[0])
    deliver(tmp_path, "PERTRANS2024-01-07.xml", hiding)
    deliver(tmp_path, "PERTRANS2024-01-05.xml", hiding)
    spoil(paths[4])
    calls, logs = counting(monkeypatch, "xml_chunks"), Logs()
    with pytest.raises(LoadFailed, match="5 of 10 files failed"):
        load_settlement(spark, paths + absent, table, NAMES, logs, RUN)
    # The scan that broke, one for all faults, and the parse.
    assert calls["xml_chunks"] == 3
    held = Counter(r.FILE_NAME[-6:-4] for r in spark.table(table).select("FILE_NAME").collect())
    assert held == Counter({"01": 99, "03": 99, "04": 99, "06": 99, "07": len(hidden_records("short")[1])})
    errors = errors_by_day(logs)
    assert {day for day, text in errors.items() if text is None} == {"01", "03", "04", "06", "07"}
    assert "cannot be read" in errors["02"] and "does not exist" in errors["11"]


def test_an_empty_file_is_not_complete(spark, tmp_path, table):
    empty = tmp_path / "PERTRANS2024-01-01.xml"
    empty.write_text("")
    (row,) = settlement.inspect_files(spark, [str(empty)])
    assert row.error == "File is not complete: PERTRANS2024-01-01.xml"


def test_a_file_that_breaks_the_parse_is_left_out(spark, tmp_path, table, monkeypatch):
    paths = [deliver(tmp_path, f"PERTRANS2024-01-0{i}.xml", record(i)) for i in range(1, 5)]
    look = settlement.inspect

    def then_spoil(*args):
        found = look(*args)
        spoil(paths[2])
        return found

    monkeypatch.setattr(settlement, "inspect", then_spoil)
    calls, logs = counting(monkeypatch, "settlement_records"), Logs()
    with pytest.raises(LoadFailed, match="1 of 4 files failed"):
        load_settlement(spark, paths, table, NAMES, logs, RUN)
    assert calls["settlement_records"] == 2
    assert "FAILED_READ_FILE" in errors_by_day(logs)["03"]
    assert sorted(r.APPROVAL_CODE for r in spark.table(table).collect()) == ["1", "2", "4"]


def test_a_target_that_cannot_be_written_is_tried_once(spark, tmp_path, table):
    paths = [deliver(tmp_path, f"PERTRANS2024-01-{i:02}.xml", record(i)) for i in range(1, 31)]
    taken = tmp_path / "taken"
    taken.write_text("a file, where the table's folder should be")
    logs = Logs()
    with pytest.MonkeyPatch.context() as patch:
        calls = counting(patch, "load_table", "settlement_records", "file_status")
        with pytest.raises(LoadFailed, match="30 of 30 files failed"):
            load_settlement(spark, paths, table, NAMES, logs, RUN, path=str(taken / "table"))
    assert calls == Counter(load_table=1, settlement_records=1, file_status=1)
    assert len(set(errors_by_day(logs).values())) == 1 and None not in errors_by_day(logs).values()


def test_a_failure_of_the_code_is_no_file_s(spark, tmp_path, table, monkeypatch):
    paths = [deliver(tmp_path, f"PERTRANS2024-01-0{i}.xml", record(i)) for i in range(1, 5)]
    calls = []

    def broken(*_):
        calls.append(1)
        raise RuntimeError("scan broke")

    monkeypatch.setattr(settlement, "file_status", broken)
    with pytest.raises(RuntimeError, match="scan broke"):
        load_settlement(spark, paths, table, NAMES, Logs(), RUN)
    assert calls == [1]


def test_text_is_read_twice_whatever_is_rejected_or_copied(spark, tmp_path, table, database, monkeypatch):
    broken = record(8).replace("</FLD_004>", "")
    paths = [deliver(tmp_path, f"PERTRANS2024-01-0{i}.xml", record(i), broken) for i in (1, 2)]
    paths.append(deliver(tmp_path, "PERTRANS2024-01-03.xml", record(3), "<TRN/>"))
    calls, logs = counting(monkeypatch, "xml_chunks", "read_xml"), Logs()
    outcome = load_settlement(spark, paths, table, NAMES, logs, RUN, jdbc=JdbcTarget("jdbc:x", "copy", {}))
    assert calls == Counter(xml_chunks=2, read_xml=1)
    assert {r.rejected_count for r in outcome.collect()} == {0, 1} and len(logs.rows["rejects"]) == 2
    assert len(database) == 4


def hidden_records(kind):
    """Records and remarks, with the numbers of those that count."""
    text, counted = [], []
    for i in range(600):
        if i % 10 == 3:
            text.append(f"<!-- off: {record(i)} {record(i)} -->")
        elif i % 10 == 5:
            shop = "<FLD_020><![CDATA[a <TRN> b </TRN> & <!-- c]]></FLD_020>"
            text.append(record(i).replace("<FLD_020>A &amp; B</FLD_020>", shop))
            counted.append(i)
        else:
            text.append(record(i).replace("<FLD_004>", "<!-- note --><FLD_004>"))
            counted.append(i)
        if kind == "long" and i == 300:
            text.append("<!--" + "".join(record(j) for j in range(700, 1000)) + "-->")
    return text, counted


@pytest.mark.parametrize("kind", ["short", "long"])
def test_sections_that_hide_row_tags_leave_a_file_cuttable(spark, tmp_path, table, monkeypatch, kind):
    text, counted = hidden_records(kind)
    large = deliver(tmp_path, "PERTRANS2024-01-01.xml", *text)
    small = deliver(tmp_path, "PERTRANS2024-01-02.xml", record(2000))
    expected = Counter(map(tuple, read_xml(spark, large, SETTLEMENT_RECORD).drop("REJECT_TEXT").collect()))
    assert expected.total() == len(counted)

    def never(*_, **__):
        raise AssertionError("read as a whole")

    monkeypatch.setattr(settlement, "read_xml", never)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20011")
    try:
        (row, other) = settlement.inspect_files(spark, [large, small])
        assert (row.form, row.cuttable, row.records) == ("joined", False, len(counted))
        assert (other.form, other.cuttable, row.error, other.error) == ("cut", True, None, None)
        joined = settlement.joined_text(spark, [large])
        assert joined.rdd.getNumPartitions() > 5
        records = xml_records(joined, SETTLEMENT_RECORD).drop("REJECT_TEXT")
        assert Counter(map(tuple, records.collect())) == expected
        outcome = load_settlement(spark, [large, small], table, NAMES, Logs(), RUN)
        assert {r.target_count for r in outcome.collect()} == {len(counted), 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    shops = spark.table(table).filter("APPROVAL_CODE = '5'").select("MERCHANT_NAME").first()
    assert shops.MERCHANT_NAME == "a <TRN> b </TRN> & <!-- c"
    assert sorted(int(r.APPROVAL_CODE) for r in spark.table(table).collect()) == [*counted, 2000]


def test_a_long_list_of_files_prunes_partitions(spark, tmp_path, table):
    paths = [deliver(tmp_path, f"PERTRANS2024-01-0{i}.xml", record(i)) for i in (1, 2, 3)]
    load_settlement(spark, paths, table, NAMES, Logs(), RUN)
    names = ["PERTRANS2024-01-02.xml", *[f"PERTRANS{i}.xml" for i in range(5000)]]
    df = settlement.rows_of_files(spark, table, names)
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(FILE_NAME" in plan and "PERTRANS4999" not in plan


def first_again(folder, name):
    return deliver(folder, name, record(1), record(2, day="20240102"))


@pytest.mark.parametrize("external", [False, True])
def test_repeated_load_changes_nothing_and_a_shorter_delivery_replaces(
    spark, tmp_path, table, external
):
    at = str(tmp_path / "table") if external else None
    other = deliver(tmp_path, "PERTRANS2024-01-05.xml", record(9, day="20240101"))
    name = "PERTRANS2024-01-01.xml"
    first = deliver(
        tmp_path, name, record(1), record(2, day="20240102"), record(3, day="20240230")
    )
    for _ in range(2):
        load_settlement(spark, [first, other], table, NAMES, Logs(), RUN, path=at)
        assert spark.table(table).count() == 4
    again = deliver(tmp_path, name, record(1, amount="7"))
    load_settlement(spark, [again], table, NAMES, Logs(), RUN, path=at)
    kept = spark.table(table).select("FILE_NAME", "APPROVAL_CODE", "AMOUNT").collect()
    assert Counter(map(tuple, kept)) == Counter(
        [(name, "1", Decimal(7)), ("PERTRANS2024-01-05.xml", "9", Decimal("12.5"))]
    )
    load_settlement(spark, [first_again(tmp_path, name)], table, NAMES, Logs(), RUN, path=at)
    assert spark.table(table).count() == 3


def test_a_new_file_joins_those_in_the_table(spark, tmp_path, table):
    for number in (1, 2):
        path = deliver(tmp_path, f"PERTRANS2024-01-0{number}.xml", record(number))
        load_settlement(spark, [path], table, NAMES, Logs(), RUN)
        assert spark.table(table).count() == number


def test_a_failed_load_keeps_the_earlier_rows(spark, tmp_path, table, monkeypatch):
    path = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1))
    load_settlement(spark, [path], table, NAMES, Logs(), RUN)

    def fail(*_):
        raise RuntimeError("disk full")

    monkeypatch.setattr(settlement, "replace_table_partitions", fail)
    with pytest.raises(LoadFailed):
        load_settlement(spark, [path], table, NAMES, Logs(), RUN)
    assert spark.table(table).count() == 1


UNCUTTABLE = {
    "closes itself": ("<TRN/>\n", 3),
    "space in the closing tag": (record(7).replace("</TRN>", "</TRN >"), 3),
    "comment": ("<!-- <TRN> </TRN> -->", 2),
    "cdata": ("<TRN><FLD_004>5</FLD_004><FLD_020><![CDATA[</TRN>]]></FLD_020></TRN>", 3),
}


@pytest.mark.parametrize("case", UNCUTTABLE)
def test_a_file_that_cannot_be_cut_is_read_whole(spark, tmp_path, table, case):
    text, expected = UNCUTTABLE[case]
    path = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1), text, record(2))
    (row,) = settlement.inspect_files(spark, [path])
    assert not row.cuttable and row.error is None
    outcome = load_settlement(spark, [path], table, NAMES, Logs(), RUN).first()
    assert spark.table(table).count() == expected
    assert (outcome.source_count, outcome.count_state) == (expected, "success")


def test_logs_can_go_to_tables(spark, tmp_path, table):
    path = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1))
    for _ in range(2):
        load_settlement(
            spark, path, table, NAMES, lambda n, rows: append_table(rows, f"{table}_{n}", []), RUN
        )
    for name in ("load_log", "table_log", "daily_audit"):
        assert spark.table(f"{table}_{name}").count() == 2
        spark.sql(f"DROP TABLE {table}_{name}")


@pytest.fixture
def database(spark, monkeypatch):
    """Stands in for the database: rows appended, and their counts by file."""
    held = []

    def counts(*_):
        found = Counter(row.FILE_NAME for row in held)
        return spark.createDataFrame(list(found.items()), "FILE_NAME string, ROW_CNT bigint")

    monkeypatch.setattr(settlement, "append_jdbc", lambda df, *_: held.extend(df.collect()))
    monkeypatch.setattr(settlement, "read_jdbc_query", counts)
    return held


def test_copy_to_a_database(spark, tmp_path, table, database):
    one = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1), record(2, amount="1,5"))
    two = deliver(tmp_path, "PERTRANS2024-01-02.xml", record(3))
    target, logs = JdbcTarget("jdbc:x", "copy", {}), Logs()
    load_settlement(spark, [one], table, NAMES, logs, RUN, jdbc=target)
    load_settlement(spark, [one, two], table, NAMES, logs, RUN, jdbc=target)
    assert Counter(row.AMOUNT for row in database) == Counter(["12.50", "1,5", "12.50"])
    audit = [r for r in logs.rows["daily_audit"] if r.target_name == "copy"]
    assert [r.count_state for r in audit] == ["success"] * 3


def test_a_failed_copy_leaves_the_table_log_right(spark, tmp_path, table, database, monkeypatch):
    def fail(*_):
        raise RuntimeError("no connection")

    monkeypatch.setattr(settlement, "append_jdbc", fail)
    one, logs = deliver(tmp_path, "PERTRANS2024-01-01.xml", record(1)), Logs()
    with pytest.raises(LoadFailed):
        load_settlement(
            spark, [one], table, NAMES, logs, RUN, jdbc=JdbcTarget("jdbc:x", "copy", {})
        )
    assert logs.rows["load_log"][0].ERROR_DESC == "no connection"
    assert logs.rows["table_log"][0].hms_count == 1
    states = {r.target_name: r.count_state for r in logs.rows["daily_audit"]}
    assert states == {table: "success", "copy": None}


def test_compact_load_gives_the_same_rows(spark, tmp_path, table):
    path = deliver(tmp_path, "PERTRANS2024-01-01.xml", *[record(i) for i in range(50)])
    records = settlement.settlement_records(spark, [path])
    rows = settlement.with_decimals(settlement.settlement_rows(records, F.lit(RUN)))
    settlement.load_table(rows, table, ["PERTRANS2024-01-01.xml"], compact=True)
    assert Counter(map(tuple, read_table(spark, table).select(*rows.columns).collect())) == (
        Counter(map(tuple, rows.collect()))
    )


def test_target_count_prunes_to_the_files_partitions(spark, tmp_path, table):
    paths = [deliver(tmp_path, f"PERTRANS2024-01-0{i}.xml", record(i)) for i in (1, 2, 3)]
    load_settlement(spark, paths, table, NAMES, Logs(), RUN)
    df = spark.table(table).filter(F.col("FILE_NAME") == "PERTRANS2024-01-02.xml")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(FILE_NAME" in plan


def test_two_paths_with_one_name_are_refused(spark, table):
    with pytest.raises(ValueError, match="same file name"):
        load_settlement(spark, ["a/PERTRANS1.xml", "b/PERTRANS1.xml"], table, NAMES, Logs())


def test_unmasked_on_request(spark):
    raw = spark.createDataFrame([("f", "4169738812345678")], "FILE_NAME string, FLD_008 string")
    others = [name for name in SETTLEMENT_RECORD.names if name != "FLD_008"]
    empty = [F.lit(None).cast("string").alias(name) for name in others]
    rows = settlement.settlement_rows(raw.select("*", *empty), F.lit(RUN), mask_cards=False)
    assert rows.first().CARD_NUMBER == "4169738812345678"
