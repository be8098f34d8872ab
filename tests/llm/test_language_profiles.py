"""Language profiles and out-of-place distances in plain code, for all documents of a table."""

import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, langid
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    """Counts of n-grams, each as the number that breaks ties."""
    out, words, word = Counter(), [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            word += low if len(low) == 1 else c
        elif word:
            words.append(word)
            word = ""
    row = [0] + [x for w in words for x in [*map(ord, w), 0]]
    for i, a in enumerate(row):
        if a:
            out[a] += 1
        if i + 1 < len(row) and (a or row[i + 1]):
            out[1 << 63 | a << 21 | row[i + 1]] += 1
        if i + 2 < len(row) and row[i + 1]:
            out[a << 42 | row[i + 1] << 21 | row[i + 2]] += 1
    return out


def best(counts, ranks=langid.RANKS):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ranks]]


def test_every_prediction_by_plain_code(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    learned = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    profiles = {k: {g: i for i, g in enumerate(best(v))} for k, v in learned.items()}
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert len(got) == len(rows) and len(profiles) == 4
    for r in rows:
        own = best(plain_grams(r["text"] or ""))
        if not own:
            wanted = ("und", 0.0)
        else:
            apart = {k: sum(abs(p[g] - i) if g in p else langid.RANKS for i, g in enumerate(own)) for k, p in profiles.items()}
            name = min(sorted(apart), key=apart.get)
            wanted = (name, 1 - apart[name] / (langid.RANKS * len(own)))
        g = got[r["doc_id"]]
        assert g["lang_pred"] == wanted[0] and g["score"] == pytest.approx(wanted[1], abs=1e-12)


def test_new_columns_take_no_others_place(spark):
    docs = spark.createDataFrame([(1, "some words", 5, "x", "y", 2)], "doc_id long, text string, score int, lang_pred string, fingerprint string, `a.b` int")
    got = langid.identify(docs, langid.Profiles({}))
    assert got.columns == [*docs.columns, "lang_pred_", "score_"] and got.first()["score"] == 5 and got.first()["lang_pred_"] == "und"
    marked = fingerprints.with_fingerprint(docs)
    assert marked.columns == [*docs.columns, "fingerprint_"] and marked.first()["fingerprint"] == "y"


def test_dotted_names_through_the_pipeline(spark):
    import corpus_pipeline
    from tidemark.llm.common import durable

    docs = table(spark, SF, "documents").withColumns({"a.b": F.lit(1), "c`d": F.lit("x"), "score": F.lit(2)})
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        held = durable(stage(spark, held, SF), "dotted")
        if name != "packed":
            assert held.columns == docs.columns, name
    assert held.count() > 0
