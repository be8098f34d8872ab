"""Mixing sources to target weights, in DataFrame and SQL operations only.

Tokens (here words) are summed per source. Each source's share of the budget is its weight's, but
no more than ``most`` times what it has; what is cut off is shared again by weight until no source is
above its limit. That fixed point is a water level: a source takes min(weight x level, limit).
A source's repetition rate is target / size; each document is taken floor(rate) times, plus once more
if a uniform number hashed from the seed and its id is below the fraction.

Odd cases: a null or empty text has size 0 and is taken like any other document; a null source is a
source of its own, the last; null ids share one random number; repeated rows decide alike; a source
without words has target 0 and rate 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD_PATTERN, durable, unused_name

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash of the seed and the key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10)
    return bits.cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size): a row for each source.

    The windows run over one row per source, not over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", cycle.alias("weight"))
    limit = F.col("source_size") * F.lit(most)
    ranked = ranked.withColumn("limit", limit).withColumn("fills_at", F.col("limit") / F.col("weight"))
    # Sources fill up in the order of limit / weight. With the first k full, the others share what is
    # left at a level that rises with k while those k belong to the full ones and falls after.
    below = W.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    target = F.least(F.col("weight") * F.max("level").over(everything), F.col("limit"))
    return levels.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def sized(docs: DataFrame, text: str = "text", to: str = "size") -> DataFrame:
    return docs.withColumn(to, word_count(F.col(text)))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``; the text isn't shuffled.

    New columns whose names the input has already are lengthened by underscores. ``size`` names a column
    that holds the sizes already; else words are counted where they are summed and again for each row.
    The rates, one row per source, are a written table, so the planner knows their size: it broadcasts
    them below its own limit, and beyond it joins by source and splits hot sources.
    """
    names = {n: unused_name(docs, n) for n in ("size", "source_size", "target", "copies", "of", "rate")}
    size = size or names["size"]
    rows = docs if size in docs.columns else sized(docs, text, size)
    per_source = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    columns = {"source": names["of"], "source_size": names["source_size"], "target": names["target"], "rate": names["rate"]}
    rates = durable(targets(per_source, weights, budget, most).select(*[F.col(k).alias(v) for k, v in columns.items()]), "rates")
    joined = rows.join(rates, F.col(source).eqNullSafe(F.col(names["of"])), "left")
    whole = F.floor(names["rate"])
    extra = (uniform(F.col(doc_id), seed) < F.col(names["rate"]) - whole).cast("long")
    return joined.withColumn(names["copies"], (whole + extra).cast("int")).drop(names["of"], names["rate"])


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each document as often as it was taken."""
    number = unused_name(mixed, "copy")
    return mixed.filter(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(number)
