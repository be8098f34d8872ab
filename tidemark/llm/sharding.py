"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` places on a ring of 2^64 points; a document's place is the hash of its
text, so equal texts share a place. A virtual node owns the arc that ends at it. Documents of an arc
go to its shard until that shard is full; those over continue clockwise to the next virtual nodes'
shards. A shard's capacity is its part of the row count, exact to one row, so with all capacities
together equal to the rows, counts end at most one apart ("rows"). The arcs propose in rounds: in
round r every arc offers what is left of it to the r-th virtual node clockwise, arcs in ring order.

Only row counts per arc are needed for that plan (shards x vnodes numbers, whatever the input), so
it is made on the driver: for each arc, which ranks go to which shard and slot. A document's rank in
its arc is a rank in a small cell of the arc plus the cell's offset; cells of one text are split
by a hash of the id, so a text that a third of all rows share is ranked by many tasks, and equal
texts still have neighbouring ranks.

Odd cases: a null text counts as no bytes and has the empty text's place; repeated rows each take a
slot; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import durable

SHARDS = 8
VNODES = 64
#: Cells of an arc: by place within the arc, and by a hash of the id.
FINE, SALTS = 4, 16
SALT = "ring-1"


def ring(shards: int, vnodes: int, salt: str = SALT) -> tuple[np.ndarray, np.ndarray]:
    """Places (sorted, unsigned 64 bits) and the shards that own them. A shard's places don't depend
    on the number of shards."""
    rows = sorted((int.from_bytes(hashlib.blake2b(f"{salt}/{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in rows], dtype=np.uint64), np.array([s for _, s in rows], dtype=np.int64)


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(demand: np.ndarray, owners: np.ndarray, capacity: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc: (rows, shard, first slot), in the order of the arc's ranks."""
    left, room, filled = demand.copy(), list(capacity), [0] * len(capacity)
    out: list[list[tuple[int, int, int]]] = [[] for _ in demand]
    n = len(owners)
    for step in range(n):
        if not left.any():
            break
        for arc in np.nonzero(left)[0]:
            shard = int(owners[(arc + step) % n])
            taken = min(int(left[arc]), room[shard])
            if taken:
                out[arc].append((taken, shard, filled[shard]))
                filled[shard] += taken
                room[shard] -= taken
                left[arc] -= taken
    assert not left.any(), "the capacities are below the demand"
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, doc_id: str = "doc_id", text: str = "text", salt: str = SALT) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home): ``home`` is the shard the ring names first."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("place"),
    )
    places, owners = ring(shards, vnodes, salt)
    n = len(places)
    held = spark.sparkContext.broadcast((places, owners))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, _ = held.value
        for batch in batches:
            at = batch.column(3).to_numpy().view(np.uint64)
            arc = np.searchsorted(ends, at, side="left") % n
            begin, end = ends[arc - 1], ends[arc]
            wide = np.maximum((end - begin) // np.uint64(FINE), np.uint64(1))  # wraps around past zero, as the ring does
            fine = np.minimum((at - begin - np.uint64(1)) // wide, np.uint64(FINE - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc), pa.array(fine)], names=[*batch.schema.names, "arc", "fine"])

    placed = rows.mapInArrow(locate, "doc_id long, size long, text_crc32 long, place long, arc long, fine long")
    placed = placed.withColumn("cell", F.col("fine") * SALTS + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    placed = durable(placed.drop("fine"), "placed")
    counted = placed.groupBy("arc", "cell").count().collect()  # at most arcs x FINE x SALTS rows
    cells = np.zeros((n, FINE * SALTS), dtype=np.int64)
    for r in counted:
        cells[r["arc"], r["cell"]] = r["count"]
    demand = cells.sum(axis=1)
    segments = plan(demand, owners, capacities(int(demand.sum()), shards))
    before = np.cumsum(cells, axis=1) - cells
    starts = spark.sparkContext.broadcast((before, _segments(segments)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, (arcs, froms, to, slots) = starts.value
        top = int(froms.max(initial=0)) + 1
        keys = arcs * top + froms
        for batch in batches:
            arc, cell = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            rank = first[arc, cell] + batch.column(5).to_numpy() - 1
            at = np.searchsorted(keys, arc * top + np.minimum(rank, top - 1), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(to[at], pa.int32()), pa.array(slots[at] + rank - froms[at]), pa.array(owners[arc], pa.int32())], names=["doc_id", "size", "text_crc32", "shard", "slot", "home"])

    ordered = W.partitionBy("arc", "cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = placed.select("doc_id", "size", "text_crc32", "arc", "cell", F.row_number().over(ordered).cast("long").alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, size long, text_crc32 long, shard int, slot long, home int")


def _segments(segments: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = []
    for arc, parts in enumerate(segments):
        at = 0
        for taken, to, slot in parts:
            rows.append((arc, at, to, slot))
            at += taken
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return columns[:, 0], columns[:, 1], columns[:, 2], columns[:, 3]
