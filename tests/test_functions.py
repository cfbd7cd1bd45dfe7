"""Every expression on literal rows, edge rows included."""

import unicodedata
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerleaf import functions as fn


def apply(spark, function, values, kind="string"):
    rows = [(i, value) for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, c {kind}")
    found = df.select("i", function(F.col("c")).alias("r")).orderBy("i").collect()
    return [row.r for row in found]


CASES = {
    "title_case": (
        fn.title_case,
        {
            "point-of-sale": "Point-Of-Sale",
            "atm's fee": "Atm'S Fee",
            "e2e test": "E2E Test",
            " iPhone": " Iphone",
            "GƏNCƏ": "Gəncə",
            "a\tb\nc": "A\tB\nC",
            "": "",
            None: None,
        },
    ),
    "mask_card": (
        fn.mask_card,
        {"4169738812345678": "**** **** **** 5678", "12": "**** **** **** 12", None: None},
    ),
    "mask_iban": (
        fn.mask_iban,
        {"AZ21NABZ00000000137010001944": "AZ" + "*" * 22 + "1944", None: None},
    ),
    "ascii_fold": (
        fn.ascii_fold,
        {
            "Şəhriyar Öğüz": "Sehriyar Oguz",
            "İlqar ıÇç": "Ilqar iCc",
            "Straße Æsir œuvre": "Strasse AEsir oeuvre",
            "Łódź Ñandú": "Lodz Nandu",
            "é": "e",
            "“x” – y…": '"x" - y...',
            "Юрий Щукин Əли": "Iurii Shchukin Eli",
            "Ёж, подъезд, Царь": "Iozh, pod'ezd, Tsar'",
            "Ərəb Ελλάς": "Ereb Ellas",
            "Ελένη Ξενάκη Χρήστος Ψαρρός Θεόφιλος": "Elene Xenake Khrestos Psarros Theophilos",
            "Андрій Їжак, Євген Ґалаґан, Ђорђе Њ": "Andrii Yizhak, Ievgen Galagan, Djordje Nj",
            "Қазақстан Ғү Өң Әһ": "Kazakstan Gu On Eh",
            "გიორგი მჭედლიშვილი Ჟ": "giorgi mchedlishvili Zh",
            "ﬁona Ａhmed １２ ½ № ™ STRAẞE": "fiona Ahmed 12 1/2 No TM STRASSE",
            "é e\u0301 ΐ": "e e i",
            "中 ع ѫ 𝐀 €": "中 ع ѫ 𝐀 €",
            "": "",
            None: None,
        },
    ),
    "az_phone": (
        fn.az_phone,
        {
            "+994 50 111-22-33": "+994501112233",
            "0501112233": "+994501112233",
            "501112233": "+994501112233",
            "00994501112233": "+9940994501112233",
            "abc": "+994",
            "": None,
            None: None,
        },
    ),
    "phone_valid": (fn.phone_valid, {"+994501112233": True, "+994": False, None: False}),
    "first_name": (
        lambda c: fn.name_part(c, 0),
        {"Ana": "Ana", "Ana Maria Lopez": "Ana", "Two  Spaces": "Two", "": "", None: None},
    ),
    "last_name": (
        lambda c: fn.name_part(c, 1),
        {"Ana": None, "Ana Maria Lopez": "Maria", "Two  Spaces": "", "": None, None: None},
    ),
    "gender": (
        fn.gender_label,
        {"m": "Male", "Female": "Female", "MALE": "Male", "x": "Unknown", None: "Unknown"},
    ),
    "marital": (
        fn.marital_label,
        {"Single": "Single", "Married": "Married", "single": "Unknown", "Divorced": "Unknown"}
        | {None: "Unknown"},
    ),
    "to_bool": (
        fn.to_bool,
        {"True": True, "true": True, "1": True, "TRUE": True, "0": False, "yes": False}
        | {None: False},
    ),
    "status": (
        lambda c: F.coalesce(fn.same_ignoring_case(c, "completed"), F.lit(False)),
        {"COMPLETED": True, "Completed ": False, " completed": False, "pending": False}
        | {None: False},
    ),
    "date": (
        fn.parse_date,
        {
            "2024-01-02": date(2024, 1, 2),
            "2024-1-5": None,
            "2024-02-30": None,
            "31/01/2024": None,
            "2024-01-1 ": None,
            None: None,
        },
    ),
    "compact_date": (
        fn.parse_compact_date,
        {"20240102": date(2024, 1, 2), "20240230": None, "2024-01-02": None, "2024": None},
    ),
    "datetime": (
        fn.parse_datetime,
        {
            "2024-01-02 03:04:05": datetime(2024, 1, 2, 3, 4, 5),
            "2024-1-2 3:4:5": datetime(2024, 1, 2, 3, 4, 5),
            "2024-01-02": None,
            "bad": None,
            "2024-02-30 00:00:00": None,
            " 2024-01-02 03:04:05": None,
            None: None,
        },
    ),
    "decimal": (
        fn.to_decimal,
        {"12.5": Decimal("12.5"), "1,5": None, "": None, "-3": Decimal(-3), None: None},
    ),
    "city": (fn.normalize_city, {"gəncə-BAKI şəhəri": "Gence-Baki Seheri", None: None}),
    "settlement_name": (
        fn.is_settlement_name,
        {
            "PERTRANS2024-01-01.xml": True,
            "pertrans2024-01-01.xml": True,
            "PERTRANS2024-01-01.XML": False,
            "XPERTRANS.xml": False,
        },
    ),
    "file_date": (
        fn.file_date,
        {"PERTRANS2024-01-31_2.xml": date(2024, 1, 31), "PERTRANS2024-13-01.xml": None},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_expression(spark, name):
    function, cases = CASES[name]
    assert apply(spark, function, cases) == list(cases.values())


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text("aBzÇşəıİ é1-' .\t中_", max_size=12), min_size=30, max_size=60))
def test_title_case_equals_python(spark, texts):
    assert apply(spark, fn.title_case, texts) == [text.title() for text in texts]


def test_accented_latin_folds_to_its_base_letter(spark):
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
    expected = [b for c, b in bases.items() if b.isascii()]
    folded = apply(spark, fn.ascii_fold, [c for c, b in bases.items() if b.isascii()])
    assert folded == expected and len(expected) > 350


def test_what_unicode_holds_for_equivalent_folds_to_it(spark):
    letters = [chr(c) for c in (*range(0xFF21, 0xFF5B), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07))]
    plain = {c: unicodedata.normalize("NFKD", c) for c in letters}
    known = {c: text for c, text in plain.items() if text != c and text.isascii()}
    assert len(known) > 80 and apply(spark, fn.ascii_fold, list(known)) == list(known.values())


def test_modern_letters_of_four_scripts_leave_ascii_only(spark):
    ranges = ((0x391, 0x3CF), (0x400, 0x460), (0x10D0, 0x10F1), (0xC0, 0x180))
    letters = [chr(c) for low, high in ranges for c in range(low, high) if chr(c).isalpha()]
    left = [c for c, text in zip(letters, apply(spark, fn.ascii_fold, letters), strict=True) if not text.isascii()]
    # Letters that Unicode parts into ASCII and another sign, and the eng and kra.
    assert left == list("ĿŀŉŊŋ")


def test_clip_error_keeps_head_and_tail(spark):
    long, short = "a" * 3000 + "b" * 3000, "x" * 3999
    assert apply(spark, fn.clip_error, [long, short, None]) == [
        "a" * 2000 + "b" * 2000,
        short,
        None,
    ]


def test_compact_datetime(spark):
    df = spark.createDataFrame(
        [("20240102", "030405"), ("20240230", "030405"), ("20240102", None), ("20240102", "3")],
        "d string, t string",
    )
    moment = fn.parse_compact_datetime(F.col("d"), F.col("t"))
    assert [r[0] for r in df.select(moment).collect()] == [
        datetime(2024, 1, 2, 3, 4, 5),
        None,
        None,
        None,
    ]


def test_local_time_does_not_depend_on_the_session_zone(spark):
    df = spark.range(1).select(F.lit("2024-01-01 22:30:00").cast("timestamp_ntz").alias("t"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            local = df.select(fn.local_time(F.col("t"))).first()[0]
            assert local == datetime(2024, 1, 2, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_card_key_tells_cards_apart(spark):
    keys = apply(spark, lambda c: fn.card_key(c, "s"), ["11111234", "22221234", None])
    assert keys[0] != keys[1] and len(keys[0]) == 64 and keys[2] is None
