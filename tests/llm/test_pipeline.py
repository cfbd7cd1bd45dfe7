"""The pipeline against a plain run of its stages."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerleaf.llm import mixing, pii, quality_rules, tokens
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_whole_run(spark):
    """Quality, groups and packing by brute force; pseudonyms and the mix have tests of their own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.op10_quality_rules(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    ids = sorted(texts)
    parts = slow_components(ids, [slow_fingerprint(texts[i]) for i in ids])
    kept = docs.filter(F.col("doc_id").isin(sorted(set(parts))))
    expected = mixing.mix(pii.protect(kept, pii.SAMPLE_KEY)).collect()
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    streams = {}
    for r in expected:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        streams.setdefault(r.doc_id, []).append(ids)
    rows = corpus_pipeline.run(spark, SF).collect()
    wanted = sum(len(s) for copies in streams.values() for s in copies)
    assert sum(r.length for r in rows) == wanted
    assert {r.doc_id for r in rows} == set(streams)
    for r in rows:
        part = [s[r.start : r.start + r.length] for s in streams[r.doc_id] if len(s) == r.doc_tokens]
        assert list(r.ids) in part
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).unionByName(
        spark.createDataFrame(
            [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "short", None, None, 5)], docs.schema
        )
    )
    for name, rows in (("empty", docs.limit(0)), ("odd", odd)):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.run(spark, folder).collect() == []
