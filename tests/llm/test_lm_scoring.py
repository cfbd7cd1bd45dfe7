"""Base scores against plain counting, the model's sums and gradients, and held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import attention, lm_scoring
from ledgerleaf.llm.tables import stored

TESTDATA = "/root/testdata"


def slow_base(rows):
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    out = lambda doc: zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0
    counts = Counter(t for doc, text in rows if not out(doc) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [
        (doc, out(doc), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n,
         sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text)))
        for doc, text in rows
    ]


def same(found, expected):
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(found) == len(expected)
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] < 0 and math.isfinite(a[6])


@pytest.mark.parametrize(("size", "frequent"), [("sf0.1", 1 << 20), ("sf0.01", 2_000)])
def test_whole_table(spark, monkeypatch, size, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{TESTDATA}/{size}/documents.parquet")
    found = lm_scoring.op5_lm_scoring(docs).collect()
    same(found, slow_base([(r.doc_id, r.text) for r in docs.collect()]))
    if size == "sf0.1":
        # The smaller table's held-out texts are mostly words that the base has counted.
        held = [r for r in found if r.held_out]
        assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_every_training_document_is_trained_on(spark, monkeypatch):
    """The tasks' tokens add up to those of all training texts, each gone over once."""
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 0)
    path = lm_scoring.tokenizer_path()
    texts = [f"plain words {i} of text" for i in range(40)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = stored(lm_scoring.word_counts(train), "test-counts")
    seen, kept = [], lm_scoring._average
    monkeypatch.setattr(lm_scoring, "_average", lambda table: (seen.append(table.column("tokens")), kept(table))[1])
    parameters, _ = lm_scoring.fit(train, counts, path)
    ids, _ = lm_scoring.WordTokenizer(path, special=False).encode(pa.array(texts), lm_scoring.END)
    assert sum(t.as_py() for column in seen for t in column) == len(ids)
    start = attention.new_parameters()
    assert any((parameters[k] != start[k]).any() for k in start)


def test_most_held_out_texts_beat_the_base(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    held = [r for r in lm_scoring.op5_lm_scoring(docs).collect() if r.held_out]
    # Some texts are near copies of training texts, whose rare words the base has counted.
    assert sum(r.score > r.base_score for r in held) > 0.6 * len(held)


def test_odd_rows(spark):
    rows = [(i, f"some words Here {i % 3}") for i in range(12)]
    rows += [(None, None), (None, "x"), (20, ""), (21, " \n"), (22, "long text " * 30_000), (3, "some words Here 0"), (3, "other"), (23, "é日本 \x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "digest": F.lit(2)})
    same(lm_scoring.op5_lm_scoring(docs).collect(), slow_base(rows))
    assert lm_scoring.op5_lm_scoring(docs.limit(0)).collect() == []


def _model(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = attention.Vocabulary(rng.integers(0, 50, 1_400), 1_399)
    vocabulary.follow(rng.integers(0, 9, (attention.HEAD + 2, attention.HEAD + 1)))
    return vocabulary, attention.new_parameters(), rng


def test_probabilities_sum_to_one():
    vocabulary, m, rng = _model()
    prefix = rng.integers(0, 1_400, 29)
    total = 0.0
    ids = np.concatenate([np.append(prefix, i) for i in range(1_400)])
    found = attention.log_probabilities(m, vocabulary, ids, np.arange(0, len(ids) + 1, 30))
    total = np.exp(found[29::30]).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_only_earlier_tokens_count():
    """A token's probability is the same whatever follows, and whatever text stands beside it."""
    vocabulary, m, rng = _model(1)
    ids = rng.integers(0, 1_400, 100)
    whole = attention.log_probabilities(m, vocabulary, ids, np.array([0, 100]))
    for cut in (1, 7, 24, 25, 50):
        short = attention.log_probabilities(m, vocabulary, ids[:cut], np.array([0, cut]))
        assert short == pytest.approx(whole[:cut], abs=1e-5)
    beside = attention.log_probabilities(m, vocabulary, np.concatenate([ids[::-1], ids]), np.array([0, 100, 200]))
    assert beside[100:] == pytest.approx(whole, abs=1e-5)


def test_gradients():
    vocabulary, m, rng = _model(2)
    m = {k: a.astype(float) for k, a in m.items()}
    ids, bounds = rng.integers(0, 1_400, 120), np.array([0, 30, 31, 120])
    inputs, there, first = attention.windows(vocabulary.place[ids], bounds)
    at = (first[:, None] + np.arange(attention.STRIDE))[there[:, attention.CONTEXT:]]
    assert sorted(at) == list(range(120))
    loss = lambda: -(attention.log_probabilities(m, vocabulary, ids, bounds) - np.where(
        vocabulary.place[ids] == attention.HEAD, vocabulary.tail[ids], 0)).mean()
    g = attention.gradients(m, vocabulary, inputs, there, vocabulary.place[ids][at])
    for name, a in m.items():
        spots = np.argsort(-np.abs(g[name]).ravel())[:3]
        for spot in spots:
            i, old = np.unravel_index(spot, a.shape), a.flat[spot]
            a.flat[spot] = old + 1e-4
            up = loss()
            a.flat[spot] = old - 1e-4
            down = loss()
            a.flat[spot] = old
            assert (up - down) / 2e-4 == pytest.approx(g[name][i], rel=1e-2, abs=1e-6)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 20_000)
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    found = []
    for parts in (1, 4, 16):
        rows = lm_scoring.op5_lm_scoring(docs.repartition(parts)).collect()
        found.append({r.doc_id: (r.score, r.base_score) for r in rows})
    for doc_id, scores in found[0].items():
        for other in found[1:]:
            assert other[doc_id] == pytest.approx(scores, rel=1e-3)


def test_rows_of_logits_far_apart_have_their_own_probabilities():
    """One number is taken off all rows where that is enough, each row's greatest where it is not."""
    logits = np.array([[0, 1, 2, -1e9], [-500, -501, -502, -503], [300, 301, 299, 0]], np.float32)
    for rows in (logits, logits[:1], logits[1:2], logits[:0]):
        plain = rows.astype(float) - rows.max(axis=1, keepdims=True, initial=-np.inf)
        total = np.exp(plain).sum(axis=1, keepdims=True)
        assert attention._softmax(rows) == pytest.approx(np.exp(plain) / total, abs=1e-6)
        assert attention._log_sums(rows) == pytest.approx(np.log(total)[:, 0] + rows.max(axis=1, initial=-np.inf), rel=1e-6)


def test_a_step_takes_few_calls_however_many_classes(monkeypatch):
    """Exponentials of all classes' members are taken at once, not class by class."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, attention.HEAD, 1_500)
    vocabulary = attention.Vocabulary(np.bincount(ids, minlength=49_408), 49_407)
    trainer, calls, plain = attention.Trainer(attention.new_parameters(), vocabulary), [], attention._softmax
    monkeypatch.setattr(attention, "_softmax", lambda logits: calls.append(logits.shape) or plain(logits))
    trainer.learn(ids, np.array([0, len(ids)]))
    assert trainer.tokens == len(ids) and len(calls) == 3 * trainer.steps


def test_stored_ids_are_trained_on_and_scored_without_splitting_texts_again(monkeypatch):
    """A training or scoring task never splits a text: it reads the ids that were stored."""
    path = lm_scoring.tokenizer_path()
    texts = ["plain words of a text", "", "other words, others still " * 40]
    ids, bounds = lm_scoring.WordTokenizer(path, special=False).encode(pa.array(texts), lm_scoring.END)
    packed = lm_scoring._packed(ids, bounds, lm_scoring._id_type(path))
    for a, b in ((0, 3), (1, 3), (2, 2)):
        found, places = lm_scoring._unpacked(packed.slice(a, b - a), np.uint16)
        assert found.tolist() == ids[bounds[a] : bounds[b]].tolist()
        assert places.tolist() == (bounds[a : b + 1] - bounds[a]).tolist()

    def fail(*_):
        raise AssertionError("split again")

    vocabulary, m = attention.Vocabulary(np.bincount(ids, minlength=49_408), lm_scoring.END), attention.new_parameters()
    monkeypatch.setattr(lm_scoring.WordTokenizer, "encode", fail)
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 0)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("", (), {"get": lambda: type("", (), {"partitionId": lambda: 0})}))
    shared = type("", (), {"value": (m, vars(vocabulary))})
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), packed], names=["doc_id", "ids"])
    (model,) = lm_scoring._train_maker(shared, path)(iter([batch]))
    trainer = attention.Trainer(m, vocabulary)
    trainer.learn(ids, bounds)
    assert model.column("tokens").to_pylist() == [len(ids)]
    assert np.asarray(model.column("model")[0].values) == pytest.approx(attention.flat(trainer.m), abs=1e-6)
    (scored,) = lm_scoring._score_maker(shared, path)(iter([batch]))
    logs = attention.log_probabilities(m, vocabulary, ids, bounds)
    expected = [logs[a:b].sum() / math.log(10) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert scored.column("score").to_pylist() == pytest.approx(expected)
    assert scored.column("doc_id").to_pylist() == [1, 2, 3]


def test_a_step_takes_no_greatest_of_its_logits(monkeypatch):
    """Logits are gone over for their greatest only where their exponentials' sums are out of range."""
    vocabulary, m, rng = _model(3)
    ids = rng.integers(0, 1_400, 700)
    inputs, there, first = attention.windows(vocabulary.place[ids], np.array([0, 300, 700]))
    at = (first[:, None] + np.arange(attention.STRIDE))[there[:, attention.CONTEXT:]]
    tops, plain = [], attention._exp
    monkeypatch.setattr(attention, "_exp", lambda logits: tops.append((found := plain(logits))[2]) or found)
    attention.gradients(m, vocabulary, inputs, there, vocabulary.place[ids][at])
    assert len(tops) == 3 and not any(np.any(top) for top in tops)
