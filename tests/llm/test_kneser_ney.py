"""The model against plain dictionaries, held-out accuracy, and odd rows."""

import math
import os
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import kneser_ney as kn
from ledgerleaf.llm.words import Words

SF = "/root/testdata/sf0.01"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def slow_words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))


def slow_model(texts):
    """Probability of a word after two others, straight from the definition."""
    three = Counter()
    for text in texts:
        words = ["<s>", "<s>", *slow_words(text)]
        three.update(zip(words, words[1:], words[2:]))
    two, one = Counter(), Counter()
    for _, v, w in three:
        two[v, w] += 1
    for _, w in two:
        one[w] += 1

    def discount(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        if not n[1] or not n[2]:
            return [0.75] * 3
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.75]
        return [min(max(d, 0.1), k) for k, d in zip((0.9, 1.9, 2.9), raw)]

    d = {1: discount(one), 2: discount(two), 3: discount(three)}
    sums, left = defaultdict(int), defaultdict(float)
    for order, counts in ((1, {(w,): c for w, c in one.items()}), (2, two), (3, three)):
        for gram, c in counts.items():
            sums[gram[:-1], order] += c
            left[gram[:-1], order] += d[order][min(c, 3) - 1]

    def p(gram):
        order = len(gram)
        lower = p(gram[1:]) if order > 1 else 1 / (len(one) + 1)
        total = sums.get((gram[:-1], order))
        if not total:
            return lower
        c = {1: one.get(gram[0], 0), 2: two.get(gram, 0), 3: three.get(gram, 0)}[order]
        c = one.get(gram[0], 0) if order == 1 else c
        own = (c - d[order][min(c, 3) - 1]) / total if c else 0
        return own + left[gram[:-1], order] / total * lower

    return p


def test_probabilities(spark):
    texts = ["a b c a b d a b c", "b c a b", "a a a b", "", "x y a b c", "The The cat", "c a b c a d d b a"] * 2 + ["a b e f g"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = kn.fit(rows)
    p = slow_model(texts)
    for text in ["a b c", "zz a b zz", "the cat a b e", "q", "e f g a a a b d b"]:
        words = ["<s>", "<s>", *text.split()]
        found = kn.log_probabilities(model, Words(pa.array([text]), lower=True))
        assert found == pytest.approx([math.log(p(tuple(words[i : i + 3]))) for i in range(len(words) - 2)], abs=1e-4)
    kinds = {w for t in texts for w in t.lower().split()}
    for context in (("a", "b"), ("zz", "a"), ("<s>", "<s>")):
        assert sum(p((*context, w)) for w in kinds) + p((*context, "??")) == pytest.approx(1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = kn.op3_quality_classifier(docs, labels)
    rows = out.join(labels, "doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(kn.HELD_OUT)) == 0).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.45 * len(bad)
    assert out.count() == docs.count()


def test_quantiles_per_language(spark):
    rows = [("a", i / 100) for i in range(200)] + [("b", 5.0)] + [(None, 7 + i / 100) for i in range(100)] + [("a", None)]
    found = {r.lang: r.cutoff for r in kn.cutoffs(spark.createDataFrame(rows, "lang string, log_perplexity double")).collect()}
    extra = math.log(kn.MARGIN)
    assert found["a"] == pytest.approx(1.97 + extra, abs=0.01)
    assert found[None] == pytest.approx(7.98 + extra, abs=0.01)
    assert found["b"] == pytest.approx(7.97 + extra, abs=0.01)


def test_odd_rows(spark):
    rows = [(i, "good words in a good row " * (i % 5 + 1), "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (None, "good words", "en"), (102, "zz yy xx " * 60_000, None), (3, "good words in", "en"), (104, " \n", "xx")]
    labels = [(i, 1, 0) for i in range(40)] + [(3, 1, 0), (5, 1, None), (None, 1, 0), (102, 0, None), (101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n_words": F.lit("x"), "cutoff": F.lit(1), "w": F.lit(2)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("q"))
    out = kn.op3_quality_classifier(docs, known).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert not kept[100] and not kept[101] and not kept[104] and kept[None] and kept[7] and not kept[102]
    unlabelled = kn.op3_quality_classifier(docs, known.limit(0)).collect()
    assert {r.doc_id for r in unlabelled if not r.kept} == {100, 101, 104}
    assert kn.op3_quality_classifier(docs.limit(0), known).collect() == []


def test_fit_takes_existing_short_documents_of_each_language(spark, monkeypatch):
    """Absent ids and long documents take no places, and a rare language has its share."""
    monkeypatch.setattr(kn, "TRAIN_DOCS", 60)
    monkeypatch.setattr(kn, "TRAIN_WORDS", 50)
    rows = [(i, f"common words number {i % 7} here", "en") for i in range(400)]
    rows += [(1_000 + i, "seltene Worte stehen hier", "de") for i in range(40)]
    rows += [(2_000 + i, "long " * 60, "en") for i in range(400)] + [(3_000, "rare words only", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i != 3_000] + [(10_000 + i, 1, 0) for i in range(4_000)], "doc_id long, quality int, toxic int")
    texts, plain = [], kn.fit
    monkeypatch.setattr(kn, "fit", lambda trusted: (texts.extend(r.text for r in trusted.collect()), plain(trusted))[1])
    out = {r.doc_id: r for r in kn.op3_quality_classifier(docs, labels).collect()}
    assert len(texts) == 60 and not any(t.startswith("long") for t in texts)
    assert sum(t.startswith("seltene") for t in texts) >= 20
    assert out[3_000].kept and out[3_000].cutoff is None and out[1_000].kept


def test_whole_query_equals_the_plain_model(spark):
    """Perplexities, cutoffs and verdicts of all documents of the smallest tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    found = {r.doc_id: r for r in kn.op3_quality_classifier(docs, labels).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(kn.HELD_OUT)).alias("place")
    places = {
        r.doc_id: r.place for r in labels.filter("quality = 1 AND coalesce(toxic, 0) <> 1").select("doc_id", place).collect()
    }
    texts = {r.doc_id: (r.lang, slow_words(r.text)) for r in docs.collect()}
    fitted = [i for i, (_, words) in texts.items() if places.get(i, 0) > 0 and 0 < len(words) <= kn.TRAIN_WORDS]
    assert 20 < len(fitted) <= kn.TRAIN_DOCS
    p = slow_model([" ".join(texts[i][1]) for i in fitted])

    def log_perplexity(words):
        padded = ["<s>", "<s>", *words]
        return -sum(math.log(p(tuple(padded[i : i + 3]))) for i in range(len(words))) / len(words) if words else None

    expected = {i: log_perplexity(words) for i, (_, words) in texts.items()}
    assert set(found) == set(texts)
    for i, value in expected.items():
        assert found[i].log_perplexity == (value if value is None else pytest.approx(value, abs=1e-4))
        assert found[i].n_words == len(texts[i][1])

    def cutoff(ids):
        steps = sorted(math.floor(expected[i] / kn.STEP) for i in ids)
        reached = next(s for n, s in enumerate(steps, 1) if n >= kn.QUANTILE * len(steps))
        return (reached + 1) * kn.STEP + math.log(kn.MARGIN)

    held = [i for i in texts if places.get(i) == 0 and expected[i] is not None]
    own = {lang: [i for i in held if texts[i][0] == lang] for lang in {lang for lang, _ in texts.values()}}
    known = Counter(texts[i][0] for i in fitted)
    rejected = 0
    for i, (lang, words) in texts.items():
        limit = None
        if len(own[lang]) >= kn.LEAST_TRUSTED:
            limit = cutoff(own[lang])
        elif known[lang] >= kn.LEAST_FITTED:
            limit = cutoff(held)
        if not words:
            assert not found[i].kept
            continue
        if limit is None:
            assert found[i].kept and found[i].cutoff is None
            continue
        limit += kn.SPREAD / math.sqrt(len(words))
        assert found[i].cutoff == pytest.approx(limit, abs=1.5 * kn.STEP)
        if abs(expected[i] - limit) > 2 * kn.STEP:
            assert found[i].kept == (expected[i] <= limit)
        rejected += not found[i].kept
    assert rejected > 0


def test_fit_takes_every_trusted_document(spark):
    """More documents than an earlier bound, long ones too; the model is not fitted on some of them."""
    words = [f"w{i} x{i} y{i}" for i in range(2_900)]
    rows = [(i, text, "en") for i, text in enumerate(words)] + [(5_000, "long " * 20_500 + "tail end", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.log_perplexity for r in kn.op3_quality_classifier(docs, labels).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(kn.HELD_OUT)).alias("place")
    fitted = {r.doc_id for r in docs.select("doc_id", place).filter("place > 0").collect()}
    p = slow_model([text for i, text, _ in rows if i in fitted])
    assert len(fitted) > 2_000
    for i, text, _ in rows[::300] + rows[-1:]:
        padded = ["<s>", "<s>", *text.split()]
        expected = -sum(math.log(p(tuple(padded[at : at + 3]))) for at in range(len(padded) - 2)) / (len(padded) - 2)
        assert out[i] == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("frequent", [4, 1 << 20])
def test_blocks_that_ask_give_the_whole_models_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(kn, "FREQUENT", frequent)
    monkeypatch.setattr(kn, "BLOCK_BYTES", 60)
    texts = ["a b c a b d a b c", "b c a b", "a a a b", "", None, "x y a b c", "The The cat", " ", "zz a b zz e f g"] * 3
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    trusted = docs.filter("doc_id % 9 < 6").select("text")
    plain = {r.doc_id: r for r in kn.scores(docs, kn.fit(trusted)).collect()}
    found = {r.doc_id: r for r in kn.table_scores(docs, kn.tables(trusted)).collect()}
    assert set(found) == set(plain)
    for i, row in plain.items():
        assert found[i].n_words == row.n_words
        assert found[i].log_perplexity == (row.log_perplexity if row.log_perplexity is None else pytest.approx(row.log_perplexity, abs=1e-6))


def test_waves_leave_little_on_disk(spark, monkeypatch):
    """Several waves and shards give the whole model's scores; what a wave shuffles or stores is gone after it."""
    texts = [" ".join(f"w{(i * k + k * k // 3) % 997}" for k in range(1, 300)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = docs.filter("doc_id % 3 > 0").select("text")
    plain = {r.doc_id: r for r in kn.scores(docs, kn.fit(trusted)).collect()}
    monkeypatch.setattr(kn, "WAVE_BYTES", 40_000)
    monkeypatch.setattr(kn, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(kn, "BLOCK_BYTES", 20_000)
    before, made, store = spark.conf.get(CLEANUP), [], kn.stored
    monkeypatch.setattr(kn, "stored", lambda rows, name: made.append((name, store(rows, name))) or made[-1][1])
    model = kn.tables(trusted)
    found = {r.doc_id: r for r in kn.table_scores(docs, model).collect()}
    assert spark.conf.get(CLEANUP) == before
    names = [name for name, _ in made]
    assert names.count("word-parts") == kn.FIT_WAVES and names.count("blocks") == kn.ASK_WAVES
    fitted = sum(len(t.split()) for i, t in enumerate(texts) if i % 3 > 0)
    left = [os.path.getsize(f.removeprefix("file:")) for name, t in made if name in ("blocks", "word-parts") for f in t.inputFiles() if os.path.exists(f.removeprefix("file:"))]
    folder = model["folder"].removeprefix("file:")
    # A trigram's three hashes alone are 24 bytes.
    assert not left and sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 14 * fitted
    assert set(found) == set(plain)
    for i, row in plain.items():
        assert (found[i].n_words, found[i].log_perplexity) == (row.n_words, pytest.approx(row.log_perplexity, abs=1e-9))
