"""Near-duplicate classes by a MinHash LSH forest, with every link confirmed on the full sets.

A text's words are runs of characters other than ASCII white space, A-Z lower-cased; its set is its
distinct ``shingle``-word shingles (with fewer words, the whole sequence as one; without words,
empty). Two texts are linked if the intersection of their sets is at least ``percent`` / 100 of the
union; classes are the connected components of the links.

1. ``sketch`` reads each text once: size of the set, a digest of the set, MinHash signature.
2. Texts with equal sets are one class at once; its smallest id goes on for all of them, so a group
   of exact copies of any size is one row from here.
3. Forest: ``trees`` orders, each sorted by ``depth`` values of the signature. Neighbours in an order
   share the longest prefixes. Each row is compared with the ``window`` rows after it as long as they
   share ``least`` values: in a sparse region that is every row with this short prefix, in a dense
   one only those with the longest prefixes, so the depth adapts to the region. An order is a global
   sort, cut into ranges of about equal size whatever prefixes are frequent. This finds most links early;
   step 5 finds all others, so neither the window, nor ``forests`` (the candidates of a stretch that are
   kept for a start), nor the border of a range or batch decides what is linked.
4. Confirmation of the candidates on the full sets. Texts of candidates alone are fetched (a bitmap of
   bounded size keeps the others out of the shuffle), and a block of candidates shares them.
5. The rest: a region is all rows that share the first ``least`` values of a tree. In every region that
   holds more than one class so far, rows of different classes are compared: pair by pair in regions of
   up to ``region`` rows, where signatures that agree well enough (``MARGIN``) are confirmed; rows of
   larger regions are joined by their rarest shingles (``rarest``).
6. ``components`` joins the confirmed links.

A pair at 0.8 is lost with a chance below 1e-4: by sharing no region (0.36 ** 16, below 1e-7) or by a
signature that agrees in less than 0.62 of its values (2e-5).

Odd cases: a null text counts as empty; empty sets are linked with nothing and are their own class;
rows that repeat an id are one document for the links (each of its texts links it), and each row is returned; a row with a null id
takes its copies' class, and without one has a null class and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, durable, partitions, unused_name
from .components import components

TREES, DEPTH = 16, 6
HASHES = TREES * DEPTH
LEAST = 2
WINDOW = 32
FORESTS = 3
#: How far below the threshold an estimate may be: some four and a half standard errors: the estimate of a true link is below that with a chance of 2e-5.
MARGIN = 0.18
#: A region of up to so many rows is compared pair by pair.
REGION = 1024
#: Of more rows that share a rare shingle the signatures are not compared beforehand.
CROWD = 4096
#: A bitmap has at most 2 ^ 26 bits (8 MB); the table of shingle counts has 2 ^ 20 cells (4 MB).
BITMAP_BITS = 26
CELL_BITS = 20
ROW = "region long, doc_id long, class long, n long, signature binary"
#: Documents, and characters or shingles, of a block that is confirmed in one task.
_GROUP_DOCS = 256
_GROUP_TEXT = 1 << 22
_GROUP_SHINGLES = 1 << 19
_WORDS_HELD = 150_000


class Shingler:
    """Sets of 64-bit shingle hashes from texts."""

    def __init__(self, shingle: int):
        import xxhash

        self.shingle = shingle
        digest, held = xxhash.xxh3_64_intdigest, {}

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > _WORDS_HELD:
                    self.clear()
                self[word] = got = digest(word)
                return got

        self.words = Words(held)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.shingle, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - size + 1, np.uint64(size) * np.uint64(0x9E3779B97F4A7C15))
            for i in range(size):
                out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
                out ^= out >> np.uint64(32)
        return np.unique(out)


class Signer:
    def __init__(self, hashes: int = HASHES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.add = rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)
        self.multiply = rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """16-bit values of the smallest hashes."""
        x = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.add), np.uint32(2**32 - 1))
        for at in range(0, len(x), 1024):
            np.minimum(least, ((x[at : at + 1024, None] ^ self.add) * self.multiply).min(axis=0), out=least)
        return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


SKETCH = "doc_id long, n_shingles long, set_key binary, signature binary"


def sketch(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sign = Shingler(shingle), Signer()
        for batch in batches:
            ns, keys, signs = [], [], []
            for t in batch.column(1):
                found = cut(t.as_py())
                ns.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signs.append(sign(found).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(read, SKETCH)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, signature) to a row for each tree: its sort key (tree, then the tree's values), id, low bytes of all values."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(len(ids), HASHES)
        low = (whole & np.uint16(255)).astype(np.uint8)
        labels = whole.reshape(len(ids), TREES, DEPTH).astype(">u2")
        for t in range(TREES):
            head = np.full((len(ids), 1), t, dtype=np.uint8)
            key = np.hstack([head, np.ascontiguousarray(labels[:, t]).view(np.uint8).reshape(len(ids), 2 * DEPTH)])
            yield pa.RecordBatch.from_arrays([_binary(key), pa.array(ids), _binary(low)], names=["label", "doc_id", "low"])


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1]
    offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, forests: int) -> np.ndarray:
    """Indices of the edges of so many edge-disjoint maximum spanning forests."""
    left = np.lexsort((b, a, -weight))
    kept = []
    for _ in range(forests):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x] = top
                x = up
            return top

        over = []
        for at, x, y in zip(left.tolist(), a[left].tolist(), b[left].tolist(), strict=True):
            x, y = root(x), root(y)
            if x == y:
                over.append(at)
            else:
                parent[x] = y
                kept.append(at)
        left = np.array(over, dtype=np.int64)
        if not len(left):
            break
    return np.array(sorted(kept), dtype=np.int64)


def neighbours(enough: float, window: int = WINDOW, least: int = LEAST, forests: int = FORESTS):
    """Candidates (a, b, likeness) from rows in forest order."""
    head = 1 + 2 * least

    def pairs(labels: np.ndarray, ids: np.ndarray, low: np.ndarray, new: int) -> pa.RecordBatch | None:
        """Pairs whose second row is at ``new`` or after."""
        n = len(ids)
        border = np.ones(n, dtype=np.int64)
        border[1:] = (labels[1:, :head] != labels[:-1, :head]).any(axis=1)
        region = np.cumsum(border)
        found = []
        for step in range(1, min(window, n - 1) + 1):
            second = np.nonzero(region[step:] == region[:-step])[0] + step
            second = second[second >= new]
            if not len(second):
                if step == 1 and new == 0:
                    break
                continue
            like = (low[second] == low[second - step]).mean(axis=1)
            good = like >= enough
            found.append((ids[second[good] - step], ids[second[good]], like[good]))
        if not found:
            return None
        x, y, like = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b = np.minimum(x, y), np.maximum(x, y)
        other = a != b
        a, b, like = a[other], b[other], like[other]
        if not len(a):
            return None
        at = spanning(a, b, like, forests)
        return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(like[at])], names=["a", "b", "likeness"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            labels = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(n, 1 + 2 * DEPTH)
            ids = batch.column(1).to_numpy()
            low = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(n, HASHES)
            new = 0
            if held is not None:
                new = len(held[1])
                labels, ids, low = (np.concatenate(c) for c in zip(held, (labels, ids, low), strict=True))
            if (out := pairs(labels, ids, low, new)) is not None:
                yield out
            held = labels[-window:].copy(), ids[-window:].copy(), low[-window:].copy()

    return walk


def candidates(reps: DataFrame, percent: int, window: int = WINDOW) -> DataFrame:
    """(a, b, likeness) with a < b from (doc_id, signature)."""
    n = partitions(reps.sparkSession)
    rows = reps.select("doc_id", "signature").mapInArrow(_grow, "label binary, doc_id long, low binary")
    ordered = rows.repartitionByRange(n, "label", "doc_id").sortWithinPartitions("label", "doc_id")
    pairs = ordered.mapInArrow(neighbours(percent / 100 - MARGIN, window), "a long, b long, likeness double")
    return pairs.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


#: Regions are numbered by an odd multiple of (tree, first values), so their high bits are mixed and the tree can be told from the number.
_SPREAD = 0x9E3779B97F4A7C15
_BACK = pow(_SPREAD, -1, 1 << 64)


def _region_numbers(whole: np.ndarray, tree: int) -> np.ndarray:
    key = np.full(len(whole), tree, dtype=np.uint64)
    for i in range(LEAST):
        key = key << np.uint64(16) | whole[:, tree, i].astype(np.uint64)
    return (key * np.uint64(_SPREAD)).view(np.int64)


def _whole(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), TREES, DEPTH)


class Marks:
    """A bitmap over the highest bits of 64-bit numbers; it may hold more numbers than were put in, never less."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    def __contains__(self, _):
        raise TypeError("ask for arrays")

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        place = numbers.view(np.uint64) >> self.shift
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64) & 1).astype(bool)


def marks(numbers: DataFrame, column: str, most: int = BITMAP_BITS) -> Marks:
    """The bitmap of a column of well mixed numbers: 16 bits or more for each, up to 2 ^ ``most`` bits.

    Beyond some 2 ^ (``most`` - 2) numbers it keeps less and less back, which costs time, not results.
    """
    n = numbers.count()
    bits = min(most, max(12, (16 * n).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = numbers.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # at most 2 ^ (most - 6) rows
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return Marks(out, bits)


def _by_region(only: Broadcast | None):
    """(doc_id, class, n, signature) to a row for each region the row is in, or for those marked."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(3))
            for t in range(TREES):
                region = _region_numbers(whole, t)
                if only is None:
                    yield pa.RecordBatch.from_arrays([pa.array(region), batch.column(1)], names=["region", "class"])
                    continue
                at = pa.array(np.flatnonzero(only.value.holds(region)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(region).take(at), *batch.take(at).columns], names=["region", "doc_id", "class", "n", "signature"])

    return walk


def _in_any(only: Broadcast):
    """The rows of (doc_id, class, n, signature) that are in some marked region."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(3))
            found = np.zeros(batch.num_rows, dtype=bool)
            for t in range(TREES):
                found |= only.value.holds(_region_numbers(whole, t))
            yield batch.filter(pa.array(found))

    return walk


def _compare(enough: float, percent: int):
    """Candidates (a, b) of different classes from rows (region, doc_id, class, n, signature) sorted by
    region; of the regions a pair shares, only the first tree's gives it."""

    def pairs(region: int, ids: np.ndarray, classes: np.ndarray, n: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = (region * _BACK) % (1 << 64) >> (16 * LEAST)
        order = np.lexsort((ids, classes))
        ids, classes, n, whole = (c[order] for c in (ids, classes, n, whole))
        # Sorted by class: a row meets those after its class.
        ends = np.searchsorted(classes, classes, side="right")
        for at in range(len(ids) - 1):
            to = np.arange(ends[at], len(ids))
            to = to[(100 * np.minimum(n[to], n[at]) >= percent * np.maximum(n[to], n[at])) & (ids[to] != ids[at])]
            if not len(to):
                continue
            same = whole[to] == whole[at]
            good = same.mean(axis=1) >= enough
            shared = same[good].reshape(-1, TREES, DEPTH)[:, :, :LEAST].all(axis=2)
            good[good] = shared.argmax(axis=1) == tree
            if good.any():
                b = ids[to[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, ids[at])), pa.array(np.maximum(b, ids[at]))], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if sum(len(h[0]) for h in held) > 1:
                yield from pairs(region, *(np.concatenate(c) for c in zip(*held, strict=True)))

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            regions, ids, classes, n = (batch.column(i).to_numpy() for i in range(4))
            whole = _whole(batch.column(4)).reshape(size, HASHES)
            cuts = [0, *(np.nonzero(np.diff(regions))[0] + 1).tolist(), size]
            for lo, hi in zip(cuts, cuts[1:]):
                if int(regions[lo]) != region:
                    yield from finish()
                    region, held = int(regions[lo]), []
                held.append((ids[lo:hi], classes[lo:hi], n[lo:hi], whole[lo:hi]))
        yield from finish()

    return walk


def _mixed(rows: DataFrame) -> DataFrame:
    """(region, n): the regions that hold more than one class."""
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("region", "n")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each cell's shingles occur, in chunks of one size."""
    cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    for batch in batches:
        for b in batch.column(0):
            np.add.at(cells, np.frombuffer(b.as_py(), dtype=np.uint64) >> np.uint64(64 - CELL_BITS), 1)
    if cells.any():
        chunks = cells.reshape(-1, 1 << 14)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks))), pa.array([c.tobytes() for c in chunks], pa.binary())], names=["chunk", "cells"])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(b, dtype=np.uint32).astype(np.uint64)
            held[k] = held[k] + more if k in held else more
    for k, v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "cells"])


def _prefixes(often: Broadcast, percent: int, only: Broadcast | None):
    """(hashes, doc_id, class, n, signature) to a row for each shingle of its prefix; see ``rarest``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = often.value
        for batch in batches:
            regions, at = [], []
            for i, b in enumerate(batch.column(0)):
                h = np.frombuffer(b.as_py(), dtype=np.uint64)
                n = count[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                first = np.lexsort((h, n))[: len(h) - -(-percent * len(h) // 100) + 1]
                # A cell counted once holds a shingle no other text has.
                region = h[first[n[first] > 1]].view(np.int64)
                if only is not None:
                    region = region[only.value.holds(region)]
                regions.append(region)
                at.append(np.full(len(region), i))
            if not regions:
                continue
            region, at = pa.array(np.concatenate(regions)), pa.array(np.concatenate(at))
            if only is None:
                yield pa.RecordBatch.from_arrays([region, batch.column(2).take(at)], names=["region", "class"])
            else:
                yield pa.RecordBatch.from_arrays([region, *batch.select([1, 2, 3, 4]).take(at).columns], names=["region", "doc_id", "class", "n", "signature"])

    return walk


def _sharers(enough: float, percent: int):
    """(low, high, doc_id): the rows that a pair of blocks has to compare, from rows (region, block, doc_id,
    class, n, signature) sorted by region. Rows whose signatures are far apart need not meet."""

    def needed(blocks: np.ndarray, ids: np.ndarray, classes: np.ndarray, n: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, int, int]]:
        order = np.lexsort((ids, classes))
        blocks, ids, classes, n, whole = (c[order] for c in (blocks, ids, classes, n, whole))
        ends = np.searchsorted(classes, classes, side="right")
        for at in range(len(ids) - 1):
            to = np.arange(ends[at], len(ids))
            to = to[100 * np.minimum(n[to], n[at]) >= percent * np.maximum(n[to], n[at])]
            if not len(to):
                continue
            to = to[(whole[to] == whole[at]).mean(axis=1) >= enough]
            for other in to.tolist():
                low, high = min(blocks[at], blocks[other]), max(blocks[at], blocks[other])
                yield low, high, ids[at]
                yield low, high, ids[other]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        region, held = None, []

        def finish() -> None:
            if sum(len(h[0]) for h in held) > 1:
                seen.update(needed(*(np.concatenate(c) for c in zip(*held, strict=True))))

        def out() -> pa.RecordBatch:
            columns = zip(*seen, strict=True) if seen else ((), (), ())
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["low", "high", "doc_id"])
            seen.clear()
            return got

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            regions, blocks, ids, classes, n = (batch.column(i).to_numpy() for i in range(5))
            whole = _whole(batch.column(5)).reshape(size, HASHES)
            cuts = [0, *(np.nonzero(np.diff(regions))[0] + 1).tolist(), size]
            for lo, hi in zip(cuts, cuts[1:]):
                if int(regions[lo]) != region:
                    finish()
                    region, held = int(regions[lo]), []
                held.append((blocks[lo:hi], ids[lo:hi], classes[lo:hi], n[lo:hi], whole[lo:hi]))
            if len(seen) > 500_000:
                yield out()
        finish()
        yield out()

    return walk


def _verify_blocks(enough: float, percent: int):
    """Links (a, b) between different classes, enough to join the classes that are linked at all, from
    groups (low, high) of rows (low, high, block, doc_id, class, n, signature, hashes)."""

    def links(low: int, high: int, blocks: np.ndarray, ids: np.ndarray, classes: np.ndarray, n: np.ndarray, whole: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        group = np.unique(classes, return_inverse=True)[1]  # joined as links are found
        for at in range(len(ids) - 1):
            to = np.arange(at + 1, len(ids))
            mine = group[to] != group[at]
            if low != high:
                mine &= blocks[to] != blocks[at]
            to = to[mine & (100 * np.minimum(n[to], n[at]) >= percent * np.maximum(n[to], n[at]))]
            if not len(to):
                continue
            like = (whole[to] == whole[at]).mean(axis=1)
            to, like = to[like >= enough], like[like >= enough]
            for other in to[np.argsort(-like, kind="stable")].tolist():
                if group[other] != group[at] and _alike(sets[at], sets[other], percent):
                    group[group == group[other]] = group[at]
                    yield min(ids[at], ids[other]), max(ids[at], ids[other])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                blocks, ids, classes, n, signatures, hashes = zip(*held, strict=True)
                whole = np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(len(held), HASHES)
                found = list(links(*key, np.array(blocks), np.array(ids), np.array(classes), np.array(n), whole, [np.frombuffer(h, dtype=np.uint64) for h in hashes]))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (low, high) != key:
                    yield from finish()
                    key, held = (low, high), []
                held.append(row)
        yield from finish()

    return walk


def rarest(docs: DataFrame, chosen: DataFrame, shingle: int, percent: int, doc_id: str, text: str, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join all linked classes of ``chosen`` (doc_id, class, n, signature).

    The join by prefixes: in any common order of all shingles, two sets that are alike enough share one of
    the first n - ceil(percent n / 100) + 1 shingles of each. The order here is rarest first, by counts of
    all texts in a table of fixed size (shingles that share a cell count together; any order gives the same
    result). Texts that only have a passage or a template in common don't meet: their own shingles come first.

    Rows that share such a shingle are dealt to blocks of bounded size by the smallest id they meet. A pair
    of blocks compares those of its rows that share a shingle and whose signatures agree well enough, or,
    where more than ``crowd`` rows share it, all of them; no pair of rows leaves a task but links.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for batch in batches:
            sets = [of(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), batch.column(2)], names=["hashes", "doc_id", "class", "n", "signature"])

    texts = texts_of(docs, chosen.select(F.col("doc_id").alias("id")), doc_id, text).select(F.col("id").alias("doc_id"), "text")
    sets = chosen.groupBy("doc_id").agg(F.first("class").alias("class"), F.first("signature").alias("signature")).join(texts, "doc_id").select("doc_id", "class", "signature", "text")
    sets = durable(sets.mapInArrow(cut, "hashes binary, doc_id long, class long, n long, signature binary"), "dense")
    chunks = sets.select("hashes").mapInArrow(_counts, "chunk long, cells binary")
    summed = chunks.repartition(min(n, 1 << (CELL_BITS - 14)), "chunk").mapInArrow(_sum_chunks, "chunk long, cells binary").toArrow()  # one table of cells
    cells = np.zeros((1 << (CELL_BITS - 14), 1 << 14), dtype=np.uint32)
    for k, b in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist(), strict=True):
        cells[k] = np.frombuffer(b, dtype=np.uint32)
    often = spark.sparkContext.broadcast(cells.reshape(-1))
    mixed = durable(_mixed(sets.mapInArrow(_prefixes(often, percent, None), "region long, class long")), "regions")
    only = spark.sparkContext.broadcast(marks(mixed, "region"))
    rows = durable(sets.mapInArrow(_prefixes(often, percent, only), ROW).join(mixed.select("region", F.col("n").alias("size")), "region"), "prefixes")
    least = rows.groupBy("region").agg(F.min("doc_id").alias("near"))
    near = rows.select("region", "doc_id").join(least, "region").groupBy("doc_id").agg(F.min("near").alias("near")).join(sets.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id")
    crowds = near.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / _GROUP_DOCS), F.ceil(F.sum("n") / _GROUP_SHINGLES)).alias("blocks"))
    placed = durable(near.join(crowds, "near").select("doc_id", F.xxhash64("near", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("block")), "blocks")
    blocked = rows.join(placed, "doc_id").select("region", "block", "doc_id", "class", "n", "signature", "size")
    ordered = blocked.filter(F.col("size") <= crowd).drop("size").repartition(n, "region").sortWithinPartitions("region")
    met = ordered.mapInArrow(_sharers(percent / 100 - MARGIN, percent), "low long, high long, doc_id long")
    # Where very many rows share a shingle, all blocks it is in meet.
    wide = blocked.filter(F.col("size") > crowd).select("region", "block", "doc_id")
    each = wide.join(wide.select("region", F.col("block").alias("other")).distinct(), "region")
    met = durable(met.unionByName(each.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id")).distinct(), "met")
    sent = met.join(placed, "doc_id").join(sets, "doc_id")
    dealt = sent.select("low", "high", "block", "doc_id", "class", "n", "signature", "hashes").repartition(n, "low", "high").sortWithinPartitions("low", "high", "class", "doc_id")
    return dealt.mapInArrow(_verify_blocks(percent / 100 - MARGIN, percent), "a long, b long")


def across(reps: DataFrame, classed: DataFrame, docs: DataFrame, shingle: int, percent: int, doc_id: str = "doc_id", text: str = "text", region: int = REGION) -> tuple[DataFrame, DataFrame | None]:
    """Candidates (a, b), and links (a, b), between different classes, from (doc_id, n, signature) and
    (node, component): all candidates of regions of up to ``region`` rows, and links from the larger ones."""
    spark = reps.sparkSession
    known = reps.join(classed, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("class"), "n", "signature")
    known = durable(known, "classed")
    mixed = durable(_mixed(known.mapInArrow(_by_region(None), "region long, class long")), "regions")
    small, large = mixed.filter(F.col("n") <= region), mixed.filter(F.col("n") > region)
    held = spark.sparkContext.broadcast(marks(small, "region"))
    # The marks let a few rows of other regions pass; the join drops them.
    rows = known.mapInArrow(_by_region(held), ROW).join(small.select("region"), "region", "left_semi")
    ordered = rows.repartition(partitions(spark), "region").sortWithinPartitions("region")
    found = ordered.mapInArrow(_compare(percent / 100 - MARGIN, percent), "a long, b long").distinct()
    if large.isEmpty():
        return found, None
    wide = spark.sparkContext.broadcast(marks(large, "region"))
    chosen = durable(known.mapInArrow(_in_any(wide), "doc_id long, class long, n long, signature binary"), "chosen")
    return found, rarest(docs, chosen, shingle, percent, doc_id, text)


def marked(docs: DataFrame, ids: DataFrame, doc_id: str):
    """A column that is true for every row whose id is in ``ids`` (id), and for few others."""
    held = docs.sparkSession.sparkContext.broadcast(marks(ids.select(F.xxhash64(F.col("id").cast("long")).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def found(h):
        import pandas as pd

        return pd.Series(held.value.holds(h.to_numpy()))

    return found(F.xxhash64(F.col(doc_id).cast("long")))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class the document with the smallest id stays, and of
    rows that repeat an id one. Only rows that may have to go are shuffled."""
    found = durable(classes(docs, shingle, percent, doc_id, text), "classes")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    known, stays, suspect, whole = (unused_name(docs, n) for n in ("known", "stays", "suspect", "whole"))
    suspects = durable(repeated.filter("n > 1 or not kept").select(F.col("doc_id").alias(known), F.col("kept").alias(stays)), "suspects")
    both = docs.withColumn(suspect, F.coalesce(marked(docs, suspects.select(F.col(known).alias("id")), doc_id), F.lit(False)))
    unclear = both.filter(F.col(suspect)).drop(suspect)
    judged = unclear.join(suspects, unclear[doc_id].cast("long") == suspects[known], "left")
    own = columns_of(docs)
    clear = judged.filter(F.col(known).isNull()).select(own)
    # Of rows that repeat an id the one with the smallest text, by a partial aggregate.
    first = judged.filter(F.col(stays)).groupBy(known).agg(F.min_by(F.struct(*own), F.coalesce(F.col(text), F.lit(""))).alias(whole))
    one = first.select(*[F.col(whole)[c].alias(c) for c in docs.columns])
    return both.filter(~F.col(suspect)).select(own).unionByName(clear).unionByName(one)


def texts_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text) of every document in ``ids`` (id); an id with several texts has a row for each."""
    ids = durable(ids.distinct(), "ids")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id is not null")
    return rows.filter(marked(rows, ids, "id")).join(ids, "id", "left_semi").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return bool(same) and 100 * same >= percent * (len(x) + len(y) - same)


def _verify(shingle: int, percent: int):
    """(a, b) that are alike enough from groups (low, high) of rows: first the texts (id, text), then the pairs (id, b)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(shingle)
        key, held = None, {}

        for batch in batches:
            a, b = [], []
            for low, high, one, other, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if (low, high) != key:
                    key, held = (low, high), {}
                if text.is_valid:
                    held.setdefault(one, []).append(cut(text.as_py()))
                elif any(_alike(x, y, percent) for x in held.get(one, ()) for y in held.get(other, ())):
                    a.append(one)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return check


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose full sets are alike enough.

    Documents are dealt to blocks of bounded size by the smallest id among them and their partners, so
    documents of one crowd mostly share blocks. A group is a pair of blocks; each text a group needs is
    sent to it once, however many pairs it is in there.
    """
    n = partitions(pairs.sparkSession)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = texts.groupBy("id").agg(F.sum(F.length("text")).alias("size"))
    near = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("near")).join(sizes, "id")
    crowds = near.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / _GROUP_DOCS), F.ceil(F.sum("size") / _GROUP_TEXT)).alias("blocks"))
    placed = durable(near.join(crowds, "near").select("id", F.xxhash64("near", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")), "blocks")
    left, right = (placed.select(F.col("id").alias(s), F.col("block").alias(f"block_{s}")) for s in "ab")
    low, high = F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")
    met = durable(pairs.select("a", "b").join(left, "a").join(right, "b").select(low, high, "a", "b"), "met")
    needed = met.select("low", "high", F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id").select("low", "high", "id", F.lit(None).cast("long").alias("other"), "text")
    rows = needed.unionByName(met.select("low", "high", F.col("a").alias("id"), F.col("b").alias("other"), F.lit(None).cast("string").alias("text")))
    # Nulls sort first: a group's texts come before its pairs.
    ordered = rows.repartition(n, "low", "high").sortWithinPartitions("low", "high", "other", "id")
    return ordered.mapInArrow(_verify(shingle, percent), "a long, b long")


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of ``docs``."""
    sketches = durable(sketch(docs, shingle, doc_id, text), "sketches")
    sets = sketches.filter("n_shingles > 0")
    reps = durable(sets.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "sets")
    named = reps.filter("doc_id is not null")
    pairs = durable(candidates(named, percent, window), "candidates")
    texts = durable(texts_of(docs, _ends(pairs), doc_id, text), "texts")
    links = durable(confirm(pairs, texts, shingle, percent), "links")
    joined = components(links)
    last, more = across(named, joined, docs, shingle, percent, doc_id, text, region)
    last = durable(last, "candidates")
    found = confirm(last, durable(texts_of(docs, _ends(last), doc_id, text), "texts"), shingle, percent)
    joined = components(links.unionByName(found if more is None else found.unionByName(more)))
    to = reps.select("set_key", F.col("doc_id").alias("rep")).join(joined, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("of_set"))
    rows = sketches.select("doc_id", "n_shingles", "set_key").join(to, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("of_set")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
