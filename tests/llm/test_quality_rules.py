"""Counts against plain Python, verdicts against SQL, and odd rows."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import oracles, quality_rules
from tests.compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "é# 日本 *", "l1\n\nl1\n", "a b c\x0ba b\x0cc",
    "word " * 40_000, "# $ % & | < > *", "\x85 \xa0", "a b c d a b c x d a b", "👍|👍 <b>\n<b>",
]


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


@pytest.mark.parametrize("texts", [ODD, ODD[::-1], ["a"], []])
def test_counts(texts):
    found = quality_rules.measure(pa.array(texts, pa.string()))
    expected = [slow_counts(t) for t in texts]
    for name in quality_rules.COUNTS:
        assert found[name].tolist() == [e[name] for e in expected], name


def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, expected = oracle_rows(SF, oracles.QUALITY_RULES)
    assert spark_rows(quality_rules.op10_quality_rules(docs)) == expected


def test_odd_rows(spark):
    rows = [(i if i % 4 else None, t, [None, "en"][i % 2], [None, "s", "t"][i % 3]) for i, t in enumerate(ODD * 2)]
    clean = " ".join(f"w{i}" for i in range(80))
    rows += [(100 + i, clean, "en", "s") for i in range(60)] + [(200, " ".join(f"w{i}#" for i in range(80)), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "row": F.lit(2), "m": F.lit(3), "max_symbols": F.lit(4)})
    out = quality_rules.op10_quality_rules(docs).collect()
    assert len(out) == len(rows)
    counts = lambda r: tuple(r[n] for n in quality_rules.COUNTS)
    assert sorted(map(counts, out)) == sorted(tuple(slow_counts(t)[n] for n in quality_rules.COUNTS) for _, t, _, _ in rows)
    for r in out:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    kept = {r.doc_id for r in out if r.kept}
    assert kept == set(range(100, 160))
    passed = quality_rules.apply_rules(docs)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == kept
    assert quality_rules.op10_quality_rules(docs.limit(0)).collect() == []
    assert quality_rules.apply_rules(docs.limit(0)).collect() == []


def test_junk_goes_and_clean_stays(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_rules.op10_quality_rules(docs).join(labels, "doc_id").collect()
    long = [r for r in rows if r.n_words >= 50]
    assert all(r.kept for r in long if r.quality == 1 and not r.base_failed)
    assert not any(r.kept for r in long if r.quality == 0)
