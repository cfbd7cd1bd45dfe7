"""Sections of text cut at row tags, beside a parser that reads a text from its begin."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerleaf.sources import hidden_spans, joined_chunks, placed_chunks, visible
from ledgerleaf.sources.markup import CDATA, COMMENT, OUTSIDE, ends_in
from ledgerleaf.workdir import staged

SIGNS = ["<!--", "-->", "<![CDATA[", "]]>", "</TRN>", "<TRN>", "a", "&amp;", "<x>", "-", "]", ">", "\n", "<!", "é"]


def plain_chunks(text):
    """Visible text between the closing row tags that no section hides."""
    found, at, chunk = [], 0, ""
    while at < len(text):
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            at = len(text) if end < 0 else end + 3
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at + 9)
            inside = text[at + 9 : len(text) if end < 0 else end]
            chunk += inside.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            at = len(text) if end < 0 else end + 3
        elif text.startswith("</TRN>", at):
            found.append(chunk)
            at, chunk = at + 6, ""
        else:
            chunk, at = chunk + text[at], at + 1
    return [c for c in [*found, chunk] if c]


@pytest.mark.parametrize("size", ["128m", "400"])
def test_any_text_at_any_split(spark, tmp_path, size):
    rng = random.Random(7)
    texts = {}
    for i in range(14):
        # Whatever is open at the end is closed there.
        text = "".join(rng.choice(SIGNS) for _ in range(rng.choice([4, 40, 900]))) + "--> ]]> --> </TRN>"
        (tmp_path / f"f{i}.xml").write_text(text)
        texts[f"f{i}.xml"] = text
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        placed = staged(placed_chunks(spark, str(tmp_path)), "test-text")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spans = staged(hidden_spans(placed), "test-spans")
    assert spans.filter(F.col("state") == CDATA).count() > 0 < spans.filter(F.col("state") == COMMENT).count()
    found = {}
    for row in joined_chunks(placed, spans).filter("chunk <> ''").collect():
        found.setdefault(row.FILE_NAME, []).append(row.chunk)
    for name, text in texts.items():
        assert Counter(found.get(name, [])) == Counter(plain_chunks(text)), text


def test_one_chunk_in_each_state(spark):
    text = "a --> b ]]> c <!-- d -- e"
    df = spark.createDataFrame([(text, s) for s in (OUTSIDE, COMMENT, CDATA)], "chunk string, state int")
    chunk, state = F.col("chunk"), F.col("state")
    rows = {r.state: r for r in df.select("state", visible(chunk, state).alias("shown"), ends_in(chunk, state).alias("end")).collect()}
    assert [rows[s].shown for s in (OUTSIDE, COMMENT, CDATA)] == ["a --> b ]]> c ", " b ]]> c ", "a --&gt; b  c "]
    assert [rows[s].end for s in (OUTSIDE, COMMENT, CDATA)] == [COMMENT] * 3


def test_short_and_null_chunks(spark):
    texts = ["", None, "<!-->", "<!--->", "<!---->", "<![CDATA[]]>", "<![CDATA[]>", "<!", "]]>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, chunk string")
    rows = df.select("i", visible(F.col("chunk")).alias("shown"), ends_in(F.col("chunk")).alias("end")).orderBy("i").collect()
    assert [r.shown for r in rows] == ["", None, "", "", "", "", "]&gt;", "<!", "]]>"]
    assert [r.end for r in rows] == [OUTSIDE, OUTSIDE, COMMENT, COMMENT, OUTSIDE, OUTSIDE, CDATA, OUTSIDE, OUTSIDE]


def test_the_work_of_marks_is_in_proportion_to_them(spark, tmp_path):
    """In one block 20,000 sections that tags cut apart, and no list of a block's marks."""
    records = 20_000
    (tmp_path / "many.xml").write_text("<TRN><![CDATA[a </TRN> b]]></TRN>" * records)
    placed = staged(placed_chunks(spark, str(tmp_path)), "test-many")
    hidden = hidden_spans(placed)
    plan = hidden._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    spans = staged(hidden, "test-many-spans")
    # Of each record the chunk that opens the section, and the one that closes it.
    states = {row.state: (row["count"], row.leads) for row in spans.groupBy("state").agg(F.count("id").alias("count"), F.countDistinct("lead").alias("leads")).collect()}
    assert states == {OUTSIDE: (records, records), CDATA: (records, records)}
    chunks = joined_chunks(placed, spans).filter("chunk <> ''").groupBy("chunk").count().collect()
    assert [tuple(row) for row in chunks] == [("<TRN>a &lt;/TRN&gt; b", records)]
