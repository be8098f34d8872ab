"""The quality classifier: its parts by plain code, held-out accuracy, odd inputs."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")
TEXTS = ["One two,  two!! 3 é\tü", "", None, "a", " \n ", "abc abc abc " * 40, "x" * 5_000, "日本 語 ... 12ab", "end"]


def bucket(word):
    return int(quality.words(np.frombuffer(word, np.uint8), np.zeros(1, np.int64))[0][0])


def plain_words(text):
    return [bucket(w) for w in WORD.findall((text or "").encode())]


@pytest.mark.parametrize("stretch", [quality.STRETCH, 64])
def test_words_by_pattern(monkeypatch, stretch):
    monkeypatch.setattr(quality, "STRETCH", stretch)
    texts = TEXTS if stretch > 64 else [t for t in TEXTS if t is None or len(t) < 5_000]
    got = [[] for _ in texts]
    for at in (0, 3):
        for found, row in quality.stretches(pa.array([t or "" for t in ["pad"] * at + texts]).slice(at)):
            for b, r in zip(found.tolist(), row.tolist()):
                got[r].append(b)
        assert got == [plain_words(t) for t in texts]
        got = [[] for _ in texts]


def test_hashes_are_of_the_word_alone():
    assert plain_words("same x same y same")[::2] == [bucket(b"same")] * 3
    assert len({bucket(str(i).encode()) for i in range(2_000)}) > 1_800


def test_word_vectors_by_plain_sums(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS] * 2, "text string").repartition(5)
    places, signs = quality._index()
    sums = np.zeros((quality.BUCKETS, quality.WIDTH))
    for t in TEXTS * 2:
        w = plain_words(t)
        for i, b in enumerate(w):
            for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                if i != j:
                    sums[b, places[w[j]]] += signs[w[j]]
    size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    assert np.allclose(quality.word_vectors(docs), sums / np.where(size > 0, size, 1), atol=1e-6)
    assert not quality.word_vectors(docs.limit(0)).any()


def test_features_by_plain_sums():
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    got = quality.pooled(pa.array([t or "" for t in TEXTS]), vectors)
    for t, g in zip(TEXTS, got):
        w = plain_words(t)
        v = vectors[w].astype(float)
        if not w:
            assert not g.any()
            continue
        near = sum(float(a @ b) for a, b in zip(v, v[1:])) / len(w)
        again = sum(a == b for a, b in zip(w, w[1:])) / len(w)
        assert np.allclose(g, [*v.mean(axis=0), *v.std(axis=0), near, again], atol=1e-6)


def test_held_out_accuracy_and_calibration(spark):
    rows = queries.op13_quality(spark, SF).collect()
    docs, labels = (table(spark, SF, t).collect() for t in ("documents", "labels"))
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels}
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([p == y for _, p, y in held]) > 0.93
    score, y = np.array([s for s, _, _ in held]), np.array([y for _, _, y in held])
    assert np.mean(score[y == 1]) > np.mean(score[y == 0]) + 0.6 and abs(score.mean() - y.mean()) < 0.07


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality._temperature(3 * z, y) == pytest.approx(3, rel=0.06)


def test_labels_are_never_inputs_and_held_out_rows_teach_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    text = pa.array([r["text"] or "" for r in docs.select("text").limit(50).collect()])
    a, b = (quality.learn(docs.repartition(n), t).score(text) for n, t in ((3, labels), (5, turned)))
    assert np.allclose(a, b, atol=1e-9)


def test_quality_odd(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in "id y key tie x score quality_score block salt sums a.b".split()})
    labels = spark.createDataFrame([(0, 1, None), (3, 0, 1), (3, 1, 1), (5, None, 0), (None, 1, 1), (99, 1, 1), (6, 7, 0)], "doc_id long, quality int, text int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = quality.scored(docs, quality.learn(docs, some))
        assert got.columns[:-1] == docs.columns and got.columns[-1] == "quality_score_"
        assert all(0 <= r["quality_score_"] <= 1 for r in got.collect()) and got.count() == len(data)
    empty = quality.learn(docs.limit(0), labels.limit(0))
    assert quality.scored(docs.limit(0), empty).count() == 0 and quality.scored(docs, empty).first()["quality_score_"] == 0.5
