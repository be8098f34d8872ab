"""Best-fit packing of documents into fixed-length sequences by bin completion.

Only the counts of the piece lengths matter, at most one number for each length up to ``capacity``,
so the plan is made on the driver from that bounded histogram, whatever the number of documents:

* a best-fit decreasing packing of the histogram is the incumbent;
* if it uses more bins than the lower bound, bin completion searches for a better one: around the
  longest piece left, the undominated fillings of the remaining room are tried, least waste first; a
  branch is left when the waste so far cannot beat the incumbent. The search ends at the lower bound.

``Limits`` bound the search: a filling is applied to as many bins at once as the counts allow, at most
``fillings`` fillings are tried around a piece, found in ``steps`` steps, and the search ends after
``nodes`` of them, or ``nodes_a_length`` for each distinct length if that is more (one full packing needs
about one for each). The best packing found is kept, best fit at least. With ``EXACT`` there are no limits
and the packing is as short as any, in time that is exponential in the number of lengths.

The plan is a list of (filling, number of bins). Pieces are then ranked within their length, in
parallel (ranks within small cells plus the cells' offsets), and a piece's length and rank tell its
sequence and its place there.

Odd cases: a null text counts as empty; the empty text is one piece that holds only the end id;
repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import durable, partitions
from .tokens import encoder

CAPACITY = 2048
CELLS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Plan = list[tuple[tuple[int, ...], int]]


@dataclass(frozen=True)
class Limits:
    """Bounds of the search; None is no bound."""

    nodes: int | None = 1_000
    nodes_a_length: int = 3
    fillings: int | None = 8
    steps: int | None = 400
    #: Whether a filling is also tried on fewer bins than it could fill.
    fewer: bool = False


LIMITS = Limits()
EXACT = Limits(None, 0, None, None, True)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins any packing needs: by total length, and by pieces that leave no room for each other."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts, reverse=True)
    for k in {s for s in sizes if 2 * s <= capacity} | {0}:
        large = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity - k >= s and 2 * s > capacity]
        rest = sum(s * n for s, n in counts.items() if k <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, large + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Longest first, each into the open bin with the least room that takes it; equal bins go together."""
    open_bins: dict[int, list[list]] = {}  # room -> [filling, bins]
    rooms: list[int] = []  # sorted
    import bisect

    def put(room: int, filling: tuple[int, ...], bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append([filling, bins])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, left)
                bins = left // each
                put(capacity - each * size, (size,) * each, bins)
                left -= each * bins
                continue
            room = rooms[at]
            group = open_bins[room]
            filling, bins = group.pop()
            if not group:
                del open_bins[room]
                rooms.pop(at)
            each = min(room // size, left)
            used = min(bins, left // each)
            put(room - each * size, filling + (size,) * each, used)
            left -= each * used
            if bins > used:
                put(room, filling, bins - used)
    return [(f, n) for group in open_bins.values() for f, n in group]


def fillings(room: int, sizes: list[int], counts: dict[int, int], most: int | None = LIMITS.fillings, steps: int | None = LIMITS.steps) -> list[tuple[int, ...]]:
    """Undominated sets of pieces that fit in ``room``, least waste first.

    A filling is dominated if one of its pieces could be swapped for a longer one that still fits, or
    another piece still fits; only sets that are full in that sense are listed. Sizes are tried
    longest first; with a bound on the steps a perfect filling ends the search.
    """
    found: dict[tuple[int, ...], int] = {}
    budget = [float("inf") if steps is None else steps]
    smallest = min(sizes, default=room + 1)

    def walk(at: int, left: int, held: tuple[int, ...]) -> bool:
        budget[0] -= 1
        if left < smallest or at >= len(sizes):
            found.setdefault(held, left)
            return left == 0
        grown = False
        for i in range(at, len(sizes)):
            if budget[0] <= 0:
                break
            size = sizes[i]
            if size <= left and held.count(size) < counts[size]:
                grown = True
                if walk(i, left - size, (*held, size)) and steps is not None:
                    return True
        if not grown:
            found.setdefault(held, left)
        return False

    walk(0, room, ())
    whole = sorted(found.items(), key=lambda x: (x[1], len(x[0]), tuple(-s for s in x[0])))
    kept: list[tuple[int, ...]] = []
    for filling, left in whole:
        if any(s - t <= left and s > t and counts[s] > filling.count(s) for t in filling for s in sizes if s > t and s - t <= left):
            continue
        kept.append(filling)
        if len(kept) == most:
            break
    return kept or [f for f, _ in whole[:1]]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, limits: Limits = LIMITS) -> tuple[Plan, int]:
    """A packing plan and the lower bound on its number of bins."""
    counts = {s: n for s, n in counts.items() if n}
    bound = lower_bound(counts, capacity) if counts else 0
    best = best_fit_decreasing(counts, capacity)
    used = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    budget = [float("inf") if limits.nodes is None else max(limits.nodes, limits.nodes_a_length * len(counts))]

    # One table of what is left and one list of fillings, changed on the way down and restored on the way up.
    order, left, plan = sorted(counts, reverse=True), counts.copy(), []

    def search(at: int, rest: int, bins: int, waste: int) -> None:
        nonlocal best, used
        budget[0] -= 1
        if not rest:
            if bins < used:
                best, used = plan.copy(), bins
            return
        if used == bound or budget[0] <= 0:
            return
        # With one bin less than the incumbent, so much may be wasted in all.
        if waste > (used - 1) * capacity - total or bins + -(-rest // capacity) >= used:
            return
        while not left[order[at]]:
            at += 1
        large = order[at]
        left[large] -= 1
        tried = fillings(capacity - large, [s for s in order[at:] if left[s] and s <= capacity - large], left, limits.fillings, limits.steps)
        left[large] += 1
        for filling in tried:
            whole = (large, *filling)
            each = {s: whole.count(s) for s in whole}
            most = min(left[s] // n for s, n in each.items())
            for times in range(most, 0 if limits.fewer else most - 1, -1):
                for s, n in each.items():
                    left[s] -= times * n
                plan.append((whole, times))
                search(at, rest - times * sum(whole), bins + times, waste + times * (capacity - sum(whole)))
                plan.pop()
                for s, n in each.items():
                    left[s] += times * n
                if used == bound or budget[0] <= 0:
                    return

    if counts and used > bound:
        import sys

        deep = sys.getrecursionlimit()
        sys.setrecursionlimit(max(deep, 20_000))
        try:
            search(0, total, 0, 0)
        finally:
            sys.setrecursionlimit(deep)
    return best, bound


def layout(plan: Plan) -> dict[str, np.ndarray]:
    """The plan by length: from which rank on a run of pieces goes to which sequences and places.

    A run is the pieces of one length in all bins of one filling: rank ``first + b * each + k`` is the
    ``k``-th such piece of the filling's bin ``b``.
    """
    rows, sequence, ranks = [], 0, {}
    for filling, bins in plan:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            each = filling.count(size)
            rows.append((size, ranks.get(size, 0), each, sequence, offset))
            ranks[size] = ranks.get(size, 0) + each * bins
            offset += each * size
        sequence += bins
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {k: columns[:, i] for i, k in enumerate(("length", "first", "each", "sequence", "offset"))}


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The token pieces of whole texts. Only documents beyond the capacity are cut: all pieces but
    the first are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(t.as_py())
                n, at, piece = len(ids), 0, 0
                size = n % capacity or capacity if n > capacity else n
                while at < n:
                    rows.append((key.as_py(), piece, at, size, zlib.crc32(ids[at : at + size].astype("<u4").tobytes())))
                    at, piece, size = at + size, piece + 1, capacity
            keys, numbers, starts, sizes, crcs = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def place(cut: DataFrame, capacity: int = CAPACITY, limits: Limits = LIMITS) -> DataFrame:
    """Pieces (a written table with ``length`` and columns that tell rows apart) with their
    ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    celled = cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CELLS)).cast("int"))
    counted = celled.groupBy("length", "_cell").agg(F.count("*").alias("n")).collect()  # at most capacity x CELLS rows
    counts: dict[int, int] = {}
    firsts: dict[tuple[int, int], int] = {}
    for r in sorted(counted, key=lambda r: (r["length"], r["_cell"])):
        firsts[r["length"], r["_cell"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    plan, _ = complete_bins(counts, capacity, limits)
    first = np.zeros((capacity + 1, CELLS), dtype=np.int64)
    for (size, cell), at in firsts.items():
        first[size, cell] = at
    held = spark.sparkContext.broadcast((layout(plan), first))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, starts = held.value
        top = int(runs["first"].max(initial=0)) + 1
        keys = runs["length"] * top + runs["first"]
        for batch in batches:
            size = batch.column(3).to_numpy()
            rank = starts[size, batch.column(5).to_numpy()] + batch.column(6).to_numpy() - 1
            at = np.searchsorted(keys, size * top + np.minimum(rank, top - 1), side="right") - 1
            over = rank - runs["first"][at]
            each = runs["each"][at]
            sequence = runs["sequence"][at] + over // each
            offset = runs["offset"][at] + over % each * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ordered = W.partitionBy("length", "_cell").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = celled.select("doc_id", "piece", "start", "length", "ids_crc32", "_cell", F.row_number().over(ordered).cast("long").alias("_rank"))
    return ranked.mapInArrow(find, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, limits: Limits = LIMITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    return place(durable(pieces(docs, capacity, doc_id, text), "pieces"), capacity, limits)
