"""Language identification by rank-order n-gram profiles.

A profile is the ``ranks`` most frequent 1- to 3-grams of letters (words are padded with a blank;
everything that is not a letter is a blank), most frequent first. A document's profile is compared
with each language's by the out-of-place distance: the sum, over the document's n-grams, of how far
the rank is from the language's, with ``ranks`` for an n-gram the language does not have. The nearest
language is predicted; its score is 1 - distance / largest possible distance.

Profiles are learned from at most ``per_language`` documents of each language, those with the
smallest hash of their id; documents in the held-out fold are never learned from. Profiles are
``ranks`` numbers per language. Predictions use the whole text and nothing else.

Odd cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there
is nothing to learn from; equal distances go to the language first in order; rows with a null id are
predicted but not learned from, and are not held out; repeated rows are predicted alike; an empty
table gives no rows; very long texts are counted whole; new columns are named so that they clash with none.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import unused_name

RANKS = 400
PER_LANGUAGE = 1_500
SIZES = (1, 2, 3)
UNKNOWN = "und"
#: Folds by crc32 of the id as text; this one is held out.
FOLDS, HELD_OUT = 4, 2
_BITS = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or 0 for what is not a letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L" and not 0xD800 <= cp <= 0xDFFF:
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, and how often each occurs."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    letter = codes != 0
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # One blank at most between words, and one at either end.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep].astype(np.uint64)
    codes = np.concatenate([[np.uint64(0)], codes, [np.uint64(0)]])
    one = codes[codes != 0]
    two = (codes[:-1] << _BITS) | codes[1:]
    three = (codes[:-2] << (_BITS * np.uint64(2))) | (codes[1:-1] << _BITS) | codes[2:]
    # A gram with a blank at an end keeps it: "_a" is a, "a_" is a << 21. Its size is marked in the top bit pair.
    two = two[two != 0] | np.uint64(1 << 63)
    three = three[codes[1:-1] != 0]
    found, counts = np.unique(np.concatenate([one, two, three | np.uint64(0)]), return_counts=True)
    return found, counts


def profile(found: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by number."""
    if len(found) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        at = counts >= least
        found, counts = found[at], counts[at]
    return found[np.lexsort((found, -counts))][:ranks]


class Profiles:
    def __init__(self, by_language: dict[str, np.ndarray], ranks: int = RANKS):
        self.ranks = ranks
        self.languages = sorted(k for k, v in by_language.items() if len(v))
        every = np.unique(np.concatenate([by_language[k] for k in self.languages])) if self.languages else np.empty(0, np.uint64)
        self.known = every
        #: Rank of each known n-gram in each language; ``ranks`` where it has none; a last row for unknown ones.
        self.rank = np.full((len(every) + 1, len(self.languages)), -1, dtype=np.int64)
        for j, k in enumerate(self.languages):
            self.rank[np.searchsorted(every, by_language[k]), j] = np.arange(len(by_language[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        found, counts = grams(text)
        own = profile(found, counts, self.ranks)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = len(self.known) - 1
        at = np.where(self.known[at] == own, at, len(self.known))
        rank = self.rank[at]
        apart = np.where(rank < 0, self.ranks, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1.0 - apart[best] / (self.ranks * len(own)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, ranks: int = RANKS, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from the documents that are not held out."""
    key = F.pmod(F.xxhash64(F.col(doc_id), F.lit("langid")), F.lit(1 << 40))
    labelled = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    # The sample is chosen by ids alone, then its texts are fetched: a threshold per language on the
    # hash. Twice the sample is cut out by the language's count first, so a task ranks that many rows
    # however large the language is.
    counts = labelled.groupBy(F.col(lang).alias("lang")).count().collect()  # a row for each language
    cut = F.lit(0).cast("long")
    for row in counts:
        cut = F.when(F.col(lang) == row["lang"], F.lit(min(1 << 40, int((1 << 40) * (2 * per_language / row["count"])))).cast("long")).otherwise(cut)
    chosen = labelled.filter(key < cut).select(F.col(lang).alias("lang"), key.alias("key"))
    order = W.partitionBy("lang").orderBy("key")
    limits = chosen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).groupBy("lang").agg(F.max("key").alias("top")).collect()
    wanted = F.lit(False)
    for row in limits:
        wanted = wanted | ((F.col(lang) == row["lang"]) & (key <= row["top"]))
    # Rows that repeat the id at the border count as well.
    exact = W.partitionBy("lang").orderBy("key", F.xxhash64("text"))
    sample = labelled.filter(wanted).select(F.col(lang).alias("lang"), key.alias("key"), F.col(text).alias("text"))
    sample = sample.withColumn("r", F.row_number().over(exact)).filter(F.col("r") <= per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = held.setdefault(name, {})
                for g, n in zip(*(x.tolist() for x in grams(t)), strict=True):
                    mine[g] = mine.get(g, 0) + n
        for name, mine in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine), pa.string()), pa.array(np.fromiter(mine.keys(), np.uint64, len(mine)).view(np.int64)), pa.array(list(mine.values()), pa.int64())], names=["lang", "gram", "n"])

    summed = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Ties by the unsigned number, as in ``profile``.
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(2**63)))
    best = summed.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), unsigned))).filter(F.col("r") <= ranks)
    table: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "gram", "r").collect():  # ranks numbers for each language
        table.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return Profiles({k: np.array([g for _, g in sorted(v)], dtype=np.int64).view(np.uint64) for k, v in table.items()}, ranks)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two new last columns, the predicted language and its score, named ``to`` and ``score`` or longer."""
    to = unused_name(docs, to)
    score = unused_name(docs.withColumn(to, F.lit(None)), score)
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def predicted(column):
        import pandas as pd

        got = [held.value.predict(t if isinstance(t, str) else None) for t in column]
        return pd.DataFrame({"lang": [g[0] for g in got], "score": [g[1] for g in got]})

    both = unused_name(docs, "language")
    return docs.withColumn(both, predicted(F.col(text))).withColumns({to: F.col(both)["lang"], score: F.col(both)["score"]}).drop(both)
