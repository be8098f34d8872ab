"""Product-quantised vector codes in exact integers, with codebooks found by Exponion search.

Each component becomes floor(``SCALE`` x component); a vector is cut into ``PARTS`` equal parts. A part
position's codebook starts as that part of the ``ENTRIES`` vectors of smallest id. Each round assigns every
part to the nearest entry (squared Euclidean distance, ties to the lower index) and moves an entry to the
componentwise floor of its parts' mean; an entry without parts stays.

Exponion search: a part starts at its previous entry ``a``, at distance d. Every entry keeps the others in
order of distance from itself. An entry nearer than the best one so far, at distance b, lies within d + b of
``a`` by the triangle inequality, so ``a``'s list is scanned only that far, and the radius shrinks as b does.
The squared radius is rounded up; distances are exact integers throughout (float64 where all sums of products
stay below 2**53, 64-bit integers beyond), so the result is that of a full search.

A round reads one written table of integer vectors with their entries and writes the next; its tasks also
write their sums for each entry, and only those (``PARTS`` x ``ENTRIES`` x (width + 1) numbers) go to the
driver. A table goes when the next one is written.

Odd cases: vectors that are null or hold a null or non-finite component are dropped; shorter vectors count as
padded with zeros to the longest, and that to a multiple of ``PARTS``; equal ids are ordered by their
vectors; null ids come after all others; repeated rows are coded alike; with fewer than ``ENTRIES`` rows
the codebooks are smaller; an empty table gives no rows. Components of 2**28 and more are an error, as their
squared distances leave 64 bits. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import discard, durable, partitions

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Distances computed in one step of a scan: few rows take more neighbours at a time.
STEP = 1 << 14
#: Rows assigned together.
ROWS = 1 << 16


class Codebook:
    """One part position's entries, and for each of them all entries in order of distance, then index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        e = self.entries
        apart = ((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        #: Products of integers and their sums are exact in float64 below 2**53.
        self.small = bool(len(e) == 0 or np.abs(e).max() < 1 << 22)
        self.real, self.square = e.astype(np.float64), (e * e).sum(axis=1).astype(np.float64)

    def distances(self, rows: np.ndarray, squares: np.ndarray | None, some: np.ndarray) -> np.ndarray:
        """Squared distances of ``rows`` to some entries; ``squares``: the rows' own, where float64 is exact."""
        if squares is not None:
            return rows @ self.real[some].T * -2 + squares[:, None] + self.square[some]
        return np.stack([((rows - c) ** 2).sum(axis=1) for c in self.entries[some]], axis=1)

    def nearest(self, rows: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row, started at the previous entries."""
        rows, best = rows.astype(np.int64), previous.astype(np.int64)
        least = ((rows - self.entries[best]) ** 2).sum(axis=1)
        squares = None
        if self.small and (not len(rows) or np.abs(rows).max() < 1 << 22):
            rows, least = rows.astype(np.float64), least.astype(np.float64)
            squares = np.einsum("ij,ij->i", rows, rows)
        by_entry = np.argsort(best, kind="stable")
        borders = np.flatnonzero(np.diff(best[by_entry], prepend=-1, append=-1))
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            todo = by_entry[lo:hi]
            found, low = self._scan(int(best[todo[0]]), rows[todo], None if squares is None else squares[todo], least[todo])
            best[todo], least[todo] = found, low
        return best, least.astype(np.int64)

    def _scan(self, at: int, rows: np.ndarray, squares: np.ndarray | None, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, apart = self.order[at], self.apart[at]
        best, least = np.full(len(rows), at), least.copy()
        start, todo, lo = np.sqrt(least.astype(np.float64)), np.arange(len(rows)), 0
        while lo < len(order):
            # The squared radius (d + b)**2, rounded up.
            reach = (start[todo] + np.sqrt(least[todo].astype(np.float64))) ** 2 * (1 + 1e-12) + 1
            inside = apart[lo] <= reach
            todo = todo[inside]
            if not len(todo):
                break
            end = int(np.searchsorted(apart, reach[inside].max(), side="right"))
            step = min(max(16, STEP // len(todo)), end - lo)
            # In order of the index, so that the first of equal distances is the lowest one.
            some = np.sort(order[lo : lo + step])
            whole = len(todo) == len(rows)
            found = self.distances(rows if whole else rows[todo], squares if whole or squares is None else squares[todo], some)
            k = found.argmin(axis=1)
            low, index = found[np.arange(len(k)), k], some[k]
            nearer = (low < least[todo]) | ((low == least[todo]) & (index < best[todo]))
            best[todo[nearer]], least[todo[nearer]] = index[nearer], low[nearer]
            lo += step
        return best, least


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, integer vectors of those) of a list column; ``width`` 0: the longest one here."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), np.where(valid, size, 0))
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(column), dtype=bool)
    bad[owner[~np.isfinite(values)]] = True
    kept = np.flatnonzero(valid & ~bad)
    width = width or (int(size[kept].max()) if len(kept) else 0)
    out = np.zeros((len(column), width), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(np.where(valid, size, 0))])[:-1]
    place = np.arange(len(values)) - starts[owner]
    ok = ~bad[owner]
    scaled = np.floor(values[ok] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 1 << 28:
        raise ValueError("a component is too large for exact distances in 64 bits")
    out[owner[ok], place[ok]] = scaled.astype(np.int64)
    return kept, out[kept]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``ROWS``."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(lo, ROWS))
            n += held[-1].num_rows
            if n >= ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    return table.column(i).chunk(0) if table.column(i).num_chunks else pa.array([], table.schema.field(i).type)


def _packed(q: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    held = np.ascontiguousarray(q)
    stride = held.shape[1] * held.itemsize
    ends = np.arange(len(held) + 1, dtype=np.int64) * stride
    return pa.Array.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(held)]).cast(pa.binary())


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column without nulls, which are all of one length."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=kind).reshape(len(column), width)


class Rounds:
    """What a round's tasks need: the codebooks and the layout of the integer vectors."""

    def __init__(self, books: list[np.ndarray], width: int, kind: str):
        self.books, self.width, self.kind = [Codebook(b) for b in books], width, kind
        self.part = width // PARTS

    def assign(self, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distance over all parts)."""
        out, error = np.zeros((len(q), PARTS), np.int64), np.zeros(len(q), np.int64)
        for j, book in enumerate(self.books):
            out[:, j], least = book.nearest(q[:, j * self.part : (j + 1) * self.part], codes[:, j])
            error += least
        return out, error


def _starting(vectors: DataFrame, vec_id: str, vector: str, entries: int) -> tuple[int, str, np.ndarray]:
    """(width, integer type, the integer vectors of the smallest ids): the driver gets ``entries`` rows."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & finite)
    most = kept.agg(F.max(F.size("v")).alias("n"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("m")).first()
    largest = (most["m"] or 0.0) * SCALE
    if largest >= 1 << 28:
        raise ValueError("a component is too large for exact distances in 64 bits")
    width = -(-(most["n"] or 0) // PARTS) * PARTS
    first = kept.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q")).orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    start = np.zeros((len(first), width), dtype=np.int64)
    for i, row in enumerate(first):
        start[i, : len(row["q"])] = row["q"]
    return width, "<i2" if largest < (1 << 15) - 1 else "<i4", start


def _round(rows: DataFrame, state: Rounds, schema: str, first: bool) -> DataFrame:
    """The next table of (vec_id, label, q, code), and a row with the sums of each slot (part and entry) a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b.entries), state.part + 1), np.int64) for b in state.books]
        kinds = None
        for some in _gathered(batches):
            kinds = some.schema
            if first:
                kept, q = integers(_column(some, 2), state.width)
                some, codes = some.take(pa.array(kept)).combine_chunks(), np.zeros((len(kept), PARTS), np.int64)
            else:
                q, codes = _matrix(_column(some, 2), state.kind, state.width).astype(np.int64), _matrix(_column(some, 3), "u1", PARTS)
            if not len(q):
                continue
            codes, _ = state.assign(q, codes)
            for j, held in enumerate(sums):
                for c in range(state.part):
                    held[:, c] += np.bincount(codes[:, j], weights=q[:, j * state.part + c], minlength=len(held)).astype(np.int64)
                held[:, -1] += np.bincount(codes[:, j], minlength=len(held))
            n = len(q)
            yield pa.RecordBatch.from_arrays([_column(some, 0), _column(some, 1), _packed(q.astype(state.kind)), _packed(codes.astype("u1")), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=["vec_id", "label", "q", "code", "slot", "sums"])
        if kinds is not None:
            used = [(j * ENTRIES + e, held[e]) for j, held in enumerate(sums) for e in np.flatnonzero(held[:, -1])]
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kinds.field(1).type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.list_(pa.int64()))], names=["vec_id", "label", "q", "code", "slot", "sums"])

    return rows.mapInArrow(run, schema)


def _moved(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries after a round. What the driver gets has a row for each slot and component at most."""
    totals = table.filter("slot is not null").select("slot", F.posexplode("sums").alias("at", "x")).groupBy("slot", "at").agg(F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    part = books[0].shape[1] if books else 0
    held = np.zeros((PARTS * ENTRIES, part + 1), dtype=np.int64)
    for slot, at, x in totals.collect():
        held[slot, at] = x
    for j, book in enumerate(out):
        mine = held[j * ENTRIES : j * ENTRIES + len(book)]
        used = mine[:, -1] > 0
        book[used] = mine[used, :-1] // mine[used, -1:]
    return out


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Rounds]:
    """(written table of vec_id, label, q and code, the final codebooks); the codes are those of the last round."""
    if not 0 < entries <= ENTRIES:
        raise ValueError("an entry's index has one byte")
    width, kind, start = _starting(vectors, vec_id, vector, entries)
    part = width // PARTS
    books = [start[:, j * part : (j + 1) * part] for j in range(PARTS)]
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("q"))
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, q binary, code binary, slot int, sums array<long>"
    held = None
    for at in range(rounds):
        source = rows if held is None else held.filter("slot is null").select("vec_id", "label", "q", "code")
        table = durable(_round(source, Rounds(books, width, kind), schema, held is None), "codes")
        if held is not None:
            discard(held)
        held = table
        books = _moved(held, books)
    return held.filter("slot is null").select("vec_id", "label", "q", "code"), Rounds(books, width, kind)


def coded(table: DataFrame, state: Rounds) -> DataFrame:
    """(vec_id, label, code, error): hex digits of each part's entry, and the squared distance over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches):
            q = _matrix(_column(some, 2), state.kind, state.width).astype(np.int64)
            codes, error = state.assign(q, _matrix(_column(some, 3), "u1", PARTS))
            digits = [bytes(c).hex() for c in codes.astype("u1")]
            yield pa.RecordBatch.from_arrays([_column(some, 0), _column(some, 1), pa.array(digits, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, f"vec_id long, label {table.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """(written) ``rows`` with ``label_error``, the error summed over equal labels, nulls together.

    Labels with more than one in 4 x partitions of all rows are fewer than 4 x partitions: they are broadcast;
    the rows of all others are shuffled by label.
    """
    totals = durable(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    share = 4 * partitions(rows.sparkSession)
    whole = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(totals.filter(F.col("n") * share > whole).select(F.col("label").alias("l"), "label_error"))
    cold = totals.filter(F.col("n") * share <= whole).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    return rows.join(hot, same).drop("l").unionByName(rows.join(hot, same, "left_anti").join(cold, same).drop("l"))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), codebooks by part)."""
    table, state = train(vectors, vec_id, vector, label, rounds, entries)
    rows = durable(coded(table, state), "coded")
    return with_label_error(rows), [b.entries for b in state.books]
