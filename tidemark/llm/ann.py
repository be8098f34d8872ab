"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by ``tables`` groups of quantised Gaussian projections (2-stable, so distances
carry over). A query visits, per table, its own bucket and then perturbed buckets: each projection may
step to the neighbouring cell, and sets of steps are visited in the order of their estimated failure
(the sum of squared distances to the crossed borders). Candidates of all tables are merged and ranked
by the exact measure in double precision.

The measure is the largest inner product. Vectors are scaled by the largest norm and extended by one
coordinate to unit length (a query by 0), which turns the largest inner product into the smallest
Euclidean distance, the one p-stable hashing is made for.

Equal vectors are one class: the class is hashed once, and a query takes from each class its smallest
ids, as many as it returns plus one for its own row. That is exact, since ties go to smaller ids.

Execution: every class is sent to its bucket of each table, every query to the buckets it probes, and
only what meets in a bucket is scored. A bucket of more than ``BLOCK`` classes is split into blocks,
its queries go to each of them. A task keeps the best rows of each query it has seen and returns those
alone, and of them none below what the query's last row is known to reach (from ``SOME`` vectors with the
smallest hashes); a window merges the tasks' rows.

Two numbers follow the data. The projections of a table grow with the logarithm of the number of
classes, so buckets stay small. The number of probes is fitted: for ``SAMPLE`` queries (those with the
smallest hash of their id, whatever the input) one scan finds the exact neighbours, and the fewest
probes that reach ``GOAL`` of them are used for all queries, ``MOST_PROBES`` at most.

A query with fewer than ``top`` rows probes on, eight times as many buckets a round, and if all
``MOST_PROBES`` are visited every block of the index.

Odd cases: vectors that are null, zero, or hold null or non-finite components take no part, neither
as queries nor as candidates; nor do vectors of another dimension than the most frequent one (the
smallest of those that are equally frequent); equal scores are ordered by id; rows that repeat an id
with one vector are one candidate, with several vectors one for each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import durable, partitions

TABLES = 8
WIDTH = 2.5
TOP = 20
BLOCK = 8_192
SEED = 7
SAMPLE = 64
GOAL = 0.95
MOST_PROBES = 1_024
#: Vectors, a sixteenth of the classes at most, whose scores say from below what a query's last row reaches.
SOME = 2_048
#: Scored pairs that a task holds before it drops all but the best.
_HELD = 1_000_000
FOUND = "query_id long, rep long, score double"


def hashes_for(classes: int) -> int:
    """Projections of a table: half the binary logarithm of the number of classes."""
    return min(16, max(4, round(math.log2(max(2, classes)) / 2)))


def steps(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of steps over the 2 x hashes borders in order of nearness (0 nearest), in the order of
    their expected scores; no set steps one projection both ways (ranks i and 2m-1-i)."""
    import heapq

    m = hashes
    # Expected squared border distance by rank, as in the multiprobe scheme.
    score = [(j * (j + 1)) / (4.0 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + ((2 * m + 1 - j) * (2 * m + 2 - j)) / (4.0 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(score[0], (0,))]
    while heap and len(out) < probes:
        cost, held = heapq.heappop(heap)
        if all(2 * m - 1 - i not in held for i in held):
            out.append(held)
        last = held[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - score[last] + score[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (cost + score[last + 1], (*held, last + 1)))
    return out


class Hashing:
    """The projections of all tables, the same in every task."""

    def __init__(self, dimension: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.a = rng.standard_normal((dimension, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.mix = rng.integers(1, 2**63, hashes, dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number for each row of cells (..., hashes)."""
        return (cells.astype(np.int64).astype(np.uint64) * self.mix).sum(axis=-1, dtype=np.uint64)


def probe_keys(hashing: Hashing, spots: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """(tables, probes) bucket numbers of one query, in estimated success order per table."""
    low = np.floor(spots)
    part = spots - low
    # Borders: crossing down costs part, crossing up costs 1 - part.
    cost = np.concatenate([part, 1 - part], axis=1)
    order = np.argsort(cost, axis=1, kind="stable")
    m = hashing.hashes
    step = np.where(order < m, np.uint64(2**64 - 1), np.uint64(1))
    delta = step * hashing.mix[order % m]
    base = hashing.keys(low)
    table = np.zeros((len(sets), 2 * m), dtype=np.uint64)
    for i, s in enumerate(sets):
        table[i, list(s)] = 1
    return base[:, None] + (table[None] * delta[:, None, :]).sum(axis=2, dtype=np.uint64)




class Search:
    """What every task needs to know: projections, probing order, the longest norm, and some vectors."""

    def __init__(self, dimension: int, tables: int, hashes: int, width: float, seed: int, norm: float, some: np.ndarray):
        self.hashing = Hashing(dimension + 1, tables, hashes, width, seed)
        self.sets = steps(hashes, MOST_PROBES)
        self.norm, self.some = norm, some
        self.spread = np.random.default_rng(seed + 1).integers(1, 2**63, tables, dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table, one number for table and cells."""
        scaled = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        keys = self.hashing.keys(np.floor(self.hashing.project(np.column_stack([scaled, rest]))))
        return self._numbers(keys)

    def probes(self, q: np.ndarray, first: int, last: int) -> Iterator[np.ndarray]:
        """For each query (tables, probes): the buckets it visits, from the ``first`` to before the ``last``."""
        unit = q / np.linalg.norm(q, axis=1)[:, None]
        spots = self.hashing.project(np.column_stack([unit, np.zeros(len(q))]))
        for spot in spots:
            yield self._numbers(probe_keys(self.hashing, spot, self.sets[:last])[:, first:].T).T

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(31))) * self.spread
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, dimension) in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _repeat(batch: pa.RecordBatch, times: int) -> pa.Array:
    return pa.array(np.repeat(np.arange(batch.num_rows), times))


class Best:
    """The best ``top`` classes of each query among those offered."""

    def __init__(self, top: int):
        self.top = top
        self.number: dict[int, int] = {}
        self.floor = np.empty(0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def floors(self, queries: list[int], given: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter((self.number.setdefault(q, len(self.number)) for q in queries), dtype=np.int64, count=len(queries))
        if len(self.number) > len(self.floor):
            self.floor = np.concatenate([self.floor, np.full(max(1024, len(self.number)), -np.inf)])
        return at, np.maximum(self.floor[at], given)

    def offer(self, at: np.ndarray, reps: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((at, reps, scores))
        self.size += len(at)
        if self.size > _HELD:
            self.cut()

    def cut(self) -> None:
        if not self.parts:
            return
        at, reps, scores = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((reps, -scores, at))
        at, reps, scores = at[order], reps[order], scores[order]
        # A class met in several tables stands side by side: its scores are equal.
        keep = np.ones(len(at), dtype=bool)
        keep[1:] = (at[1:] != at[:-1]) | (reps[1:] != reps[:-1])
        at, reps, scores = at[keep], reps[keep], scores[keep]
        first = np.searchsorted(at, at, side="left")
        rank = np.arange(len(at)) - first
        last = rank == self.top - 1
        self.floor[at[last]] = scores[last]
        keep = rank < self.top
        self.parts = [(at[keep], reps[keep], scores[keep])]
        self.size = int(keep.sum())

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        names = np.fromiter(self.number.keys(), dtype=np.int64, count=len(self.number))
        for at, reps, scores in self.parts:
            for lo in range(0, len(at), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[at[part]]), pa.array(reps[part]), pa.array(scores[part])], names=["query_id", "rep", "score"])


def _score(best: Best, reps: np.ndarray, x: np.ndarray, queries: list[int], q: np.ndarray, given: np.ndarray | float = -np.inf) -> None:
    most, step = np.sqrt((x * x).sum(axis=1).max()), max(1, 1_000_000 // len(x))
    for first in range(0, len(q), step):
        part = q[first : first + step]
        at, floor = best.floors(queries[first : first + step], given if np.isscalar(given) else given[first : first + step])
        # One product finds what may be among the best, then each score is summed up by itself.
        slack = 1e-9 * np.linalg.norm(part, axis=1) * most
        i, j = np.nonzero(part @ x.T >= (floor - slack)[:, None])
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            best.offer(at[a], reps[b], (part[a] * x[b]).sum(axis=1))


def meet(top: int):
    """The best classes of each query from rows (bucket, block, query_id, id, vector, least) sorted by bucket
    and block, the classes (null query_id, their smallest id) before the queries. A block's classes are held.
    ``least`` is a score that the last of a query's best reaches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        key, reps, held = None, [], []
        ready: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block = (batch.column(i).to_numpy() for i in (0, 1))
            asks = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            ids, x, least = batch.column(3).to_numpy(), _vectors(batch.column(4)), batch.column(5).to_numpy()
            new = (np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            cuts = [0, *(np.nonzero(new)[0] + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts, cuts[1:]):
                this = int(bucket[lo]), int(block[lo])
                if this != key:
                    key, reps, held, ready = this, [], [], None
                if not asks[lo]:
                    reps.append(ids[lo:hi])
                    held.append(x[lo:hi].copy())
                elif held:
                    if ready is None:
                        ready = np.concatenate(reps), np.concatenate(held)
                    _score(best, *ready, ids[lo:hi].tolist(), x[lo:hi], least[lo:hi])
        yield from best.batches()

    return walk


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): finite vectors without nulls, not zero, of the most frequent dimension."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    if dict(rows.dtypes)["vector"] not in ("array<float>", "array<double>"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.filter("vec_id is not null and vector is not null").filter(~F.exists("vector", bad)).filter(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return rows.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def _nearest_of_sample(classes: DataFrame, sample: list, search: Broadcast, top: int) -> list:
    """(query_id, buckets): the buckets of the exact nearest classes of a few queries."""
    ids, q = [r["vec_id"] for r in sample], np.array([r["vector"] for r in sample], dtype=np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = Best(top + 1), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, x = batch.column(0).to_numpy(), _vectors(batch.column(1))
            _score(best, reps, x, ids, q)
            best.cut()
            kept = set(best.parts[0][1].tolist())
            at = [i for i, r in enumerate(reps.tolist()) if r in kept]
            for i, row in zip(at, search.value.buckets(x[at]) if at else ()):
                known[int(reps[i])] = row
            known = {k: v for k, v in known.items() if k in kept}
        for batch in best.batches():
            rows = [known[r].tolist() for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=["query_id", "rep", "score", "buckets"])

    found = classes.select("rep", "vector").mapInArrow(scan, FOUND + ", buckets array<long>")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1).select("query_id", "rep", "buckets").collect()  # SAMPLE x (top + 1) rows


def fitted_probes(classes: DataFrame, asked: DataFrame, search: Broadcast, top: int, goal: float = GOAL, sample: int = SAMPLE) -> int:
    """The fewest probes by which ``goal`` of the exact neighbours of ``sample`` queries are met."""
    few = asked.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(sample).collect()
    if not few:
        return 1
    rank: list[int] = []
    own = {r["vec_id"]: np.array([r["vector"]], dtype=np.float64) for r in few}
    visits = {k: next(search.value.probes(v, 0, MOST_PROBES)) for k, v in own.items()}
    for row in _nearest_of_sample(classes, few, search, top):
        if row["rep"] != row["query_id"]:
            hit = visits[row["query_id"]] == np.array(row["buckets"], dtype=np.int64)[:, None]
            rank.append(int(hit.any(axis=0).argmax()) + 1 if hit.any() else MOST_PROBES)
    rank.sort()
    return rank[max(0, math.ceil(goal * len(rank)) - 1)] if rank else 1


def _dealt_classes(classes: DataFrame, search: Broadcast, whole: bool = True) -> DataFrame:
    """(bucket, id, vector), or the bucket alone: a row for each table."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, 2_000) for lo in range(0, batch.num_rows, 2_000)):
                buckets = search.value.buckets(_vectors(part.column(1)))
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1))], names=["bucket"])
                    continue
                at = _repeat(part, buckets.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1)), part.column(0).take(at), part.column(1).take(at)], names=["bucket", "id", "vector"])

    kind = dict(classes.dtypes)["vector"]
    return classes.select("rep", "vector").mapInArrow(deal, f"bucket long, id long, vector {kind}" if whole else "bucket long")


def _dealt_queries(asked: DataFrame, search: Broadcast, first: int, last: int, top: int) -> DataFrame:
    """(bucket, id, vector, least): a row for each bucket a query visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = search.value.some
        for batch in batches:
            for part in (batch.slice(lo, 500) for lo in range(0, batch.num_rows, 500)):
                q = _vectors(part.column(1))
                buckets = [np.unique(b) for b in search.value.probes(q, first, last)]
                least = np.full(len(q), -np.inf)
                if len(some) > top:
                    slack = 1e-9 * np.linalg.norm(q, axis=1) * search.value.norm
                    least = np.partition(q @ some.T, len(some) - top - 1, axis=1)[:, len(some) - top - 1] - slack
                at = pa.array(np.repeat(np.arange(len(buckets)), [len(b) for b in buckets]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), part.column(0).take(at), part.column(1).take(at), pa.array(least).take(at)], names=["bucket", "id", "vector", "least"])

    kind = dict(asked.dtypes)["vector"]
    return asked.select("vec_id", "vector").mapInArrow(deal, f"bucket long, id long, vector {kind}, least double")


def _large(buckets: DataFrame, block: int) -> DataFrame:
    """(bucket, blocks): the buckets of more than ``block`` classes."""
    sizes = buckets.groupBy("bucket").count().filter(F.col("count") > block)
    return durable(sizes.select("bucket", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "buckets")


def _round(dealt: DataFrame, large: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(query_id, rep, score) of what meets."""
    n = partitions(dealt.sparkSession)
    one = F.coalesce(F.col("blocks"), F.lit(1))
    base = dealt.join(large, "bucket", "left").select("bucket", F.pmod(F.xxhash64("id"), one).alias("block"), F.lit(None).cast("long").alias("query_id"), "id", "vector", F.lit(0.0).alias("least"))
    spread = asked.join(large, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("block"), F.col("id").alias("query_id"), "id", "vector", "least")
    rows = base.unionByName(spread).repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", F.col("query_id").asc_nulls_first())
    return rows.mapInArrow(meet(top + 1), FOUND)


def search(
    vectors: DataFrame,
    every: int = 20,
    top: int = TOP,
    tables: int = TABLES,
    hashes: int | None = None,
    width: float = WIDTH,
    probes: int | None = None,
    block: int = BLOCK,
    seed: int = SEED,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its nearest others.

    ``hashes`` and ``probes`` follow from the data unless they are given.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    # A class keeps the smallest ids only: as many as can be returned, and the query's own. They are
    # found by rank within parts of a class first, so a class of any size is summed up in parallel.
    parts = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    keep = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1)
    classes = _smallest(parts, top + 1).groupBy("vector").agg(keep.alias("ids"))
    classes = durable(classes.withColumn("rep", F.col("ids")[0]), "classes")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = classes.agg(F.count("*").alias("n"), F.max(length).alias("norm"), F.first(F.size("vector")).alias("d")).first()
    asked = durable(rows.filter(F.col("vec_id") % every == 0).distinct(), "asked")
    n_some = min(SOME, stats["n"] // 16)
    some = classes.orderBy(F.xxhash64("rep", F.lit("some")), "rep").limit(n_some).select("vector").toArrow().column(0).combine_chunks()
    some = _vectors(some) if n_some else np.empty((0, stats["d"] or 1))
    held = spark.sparkContext.broadcast(Search(stats["d"] or 1, tables, hashes or hashes_for(stats["n"]), width, seed, stats["norm"] or 1.0, some))
    probes = probes or fitted_probes(classes, asked, held, top)
    dealt, large = _dealt_classes(classes, held), _large(_dealt_classes(classes, held, False), block)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "rep")
    found, left, first, last = None, asked, 0, min(probes, MOST_PROBES)
    while True:
        if first < MOST_PROBES:
            more = _round(dealt, large, _dealt_queries(left, held, first, last, top), top)
        else:
            # Every block of the index, as buckets of their own.
            n_blocks = max(1, -(-stats["n"] // block))
            base = classes.select(F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).alias("bucket"), F.col("rep").alias("id"), "vector")
            every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
            more = _round(base, large.limit(0), left.select(every_block.alias("bucket"), F.col("vec_id").alias("id"), "vector", F.lit(float("-inf")).alias("least")), top)
        more = more if found is None else more.unionByName(found)
        # Equal rows of several tasks have one rank.
        best = more.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= top + 1)
        found = durable(best.groupBy("query_id", "rep").agg(F.first("score").alias("score")), "found")
        # Queries with fewer rows than they could have.
        enough = found.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= min(top + 1, stats["n"] or 0)).select("vec_id")
        if first >= MOST_PROBES:
            break
        left = durable(left.join(enough, "vec_id", "left_anti"), "left")
        if left.isEmpty():
            break
        first, last = last, min(8 * last, MOST_PROBES)
    # Of the rows of classes, those of the smallest ids; the query's own row goes.
    many = classes.filter(F.size("ids") > 1).select("rep", "ids")
    out = found.join(many, "rep", "left").select("query_id", F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id"), "score").filter("vec_id <> query_id")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _smallest(parts: DataFrame, n: int) -> DataFrame:
    """(vector, part, ids): the n smallest ids of each part of each class."""
    ranked = parts.withColumn("_r", F.row_number().over(W.partitionBy("vector", "part").orderBy("vec_id"))).filter(F.col("_r") <= n)
    return ranked.groupBy("vector", "part").agg(F.collect_list("vec_id").alias("ids"))
