"""Fill-in-the-middle: texts cut at two token borders and put together again around the gap.

A token is a word with the white space before it, or the white space at the end of the text. What cuts
the text is an automaton over its UTF-8 bytes (white space is ASCII, so a chunk may start inside a
character): state 0 is white space or the start, state 1 is inside a word, and a word ends where state 1
reads white space. A text of ``n`` tokens has ``n - 1`` such ends.

A giant text (more than ``chunk`` bytes) is scanned by many tasks:

1. it is split into chunks of ``chunk`` bytes, which are dealt by their numbers;
2. each chunk emits its ``Transition``: the state it leaves and the ends it counts, for each state it may
   be entered in;
3. transitions compose associatively, so the chunks' entry states and the ends before them follow by
   doubling, from the chunks' summaries alone;
4. the cut after token ``k`` lies in the chunk whose ends reach ``k``; only that chunk is read again to
   find the byte.

Shorter texts are one chunk, scanned in place. Chunk summaries are small: a text has fewer than 2**31
bytes, so fewer than 2**31 / ``chunk`` of them.

Odd cases: a null text counts as empty; the empty text has no tokens and stays plain, and so does a text
that holds a mark; a null id is hashed as no digits; repeated rows are cut alike; an empty table gives no
rows; new columns are named so that they clash with none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, unused_name

#: Marks of the parts, their order by form, and the shares of each form in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, 42
CHUNK = 1 << 16
#: The automaton. NEXT[state][class] and ENDS[state][class], class 1 being white space.
NEXT = np.array([[1, 0], [1, 0]])
ENDS = np.array([[0, 0], [0, 1]])
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Transition(NamedTuple):
    """By entry state: the state a stretch of text is left in, and the word ends in it."""

    leave: tuple[int, int]
    ends: tuple[int, int]


NOTHING = Transition((0, 1), (0, 0))


def transition(data: np.ndarray) -> Transition:
    """Of one chunk of bytes. After its first byte the state is the class of the byte before."""
    if not len(data):
        return NOTHING
    space = _SPACE[data]
    inside = int(np.count_nonzero(space[1:] & ~space[:-1]))
    first, last = int(space[0]), int(not space[-1])
    return Transition((last, last), tuple(inside + int(ENDS[s, first]) for s in (0, 1)))


def compose(a: Transition, b: Transition) -> Transition:
    """``a`` and then ``b``."""
    return Transition(tuple(b.leave[a.leave[s]] for s in (0, 1)), tuple(a.ends[s] + b.ends[a.leave[s]] for s in (0, 1)))


def prefixes(leave: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compositions of the first 1, 2, ... of many transitions (arrays of n x 2), by doubling."""
    leave, ends, step = leave.copy(), ends.copy(), 1
    while step < len(leave):
        before, counted = leave[:-step], ends[:-step]
        rows = np.arange(len(before))[:, None]
        left, total = leave[step:][rows, before], counted + ends[step:][rows, before]
        leave[step:], ends[step:] = left, total
        step *= 2
    return leave, ends


def end_after(data: np.ndarray, state: int, rank: int) -> int:
    """The offset of the ``rank``-th word end (from 1) in a chunk entered in ``state``."""
    space = _SPACE[data]
    before = np.concatenate([[state == 0], space[:-1]])
    return int(np.flatnonzero(space & ~before)[rank - 1])


def _cut(data: np.ndarray, n: int, k: int, chunk: tuple[int, int, int] | None, size: int) -> int:
    """The byte where the first ``k`` of ``n`` tokens end. ``chunk``: its number, entry state and the rank there."""
    if k <= 0:
        return 0
    if k >= n:
        return len(data)
    if chunk is None:
        return end_after(data, 0, k)
    at, state, rank = chunk
    return at * size + end_after(data[at * size : (at + 1) * size], state, rank)


def _chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


_MADE = "struct<n: bigint, form: string, prefix: bigint, middle: bigint, output: string>"
_PLACE = "struct<chunk: bigint, state: bigint, rank: bigint>"


def _rearrange(size: int):
    """(text, h1 .. h4, n, places) to the tokens, the form, the parts' code points and the output."""

    @F.arrow_udf(_MADE)
    def made(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array, tokens: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = []
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        draws = zip(*(h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)), strict=True)
        for t, (a, b, c, d), n, *places in zip(text, draws, tokens, first, second, strict=True):
            raw = t.as_buffer()
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
            n = n.as_py()
            if n is None:
                n = transition(data).ends[0] + 1 if len(data) else 0
            whole = data.tobytes()
            if not len(data) or c % 100 >= RATE or any(m in whole for m in marks):
                rows.append((n, "plain", None, None, whole))
                continue
            at = [None if p.as_py() is None else tuple(p.as_py().values()) for p in places]
            low, high = sorted((int(a % (n + 1)), int(b % (n + 1))))
            i, j = (_cut(data, n, k, place, size) for k, place in zip((low, high), at, strict=True))
            p, m, s = whole[:i], whole[i:j], whole[j:]
            form = "spm" if d % 100 < SPM_RATE else "psm"
            parts = (marks[1], s, marks[0], p, marks[2], m) if form == "spm" else (marks[0], p, marks[1], s, marks[2], m)
            rows.append((n, form, _chars(p), _chars(m), b"".join(parts)))
        kinds = {"n": pa.int64(), "form": pa.string(), "prefix": pa.int64(), "middle": pa.int64(), "output": pa.binary()}
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
        return pa.StructArray.from_arrays([*columns[:-1], columns[-1].view(pa.string())], names=list(kinds))

    return made


def draws(doc_id: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first 32 hex digits of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def chunks(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """(key, number, data) of the (key, text) rows: ``size`` bytes each, dealt to all tasks by their numbers."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(text.as_buffer())
                at = list(range(0, len(data), size))
                for lo in range(0, len(at), 64):
                    some = at[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(np.arange(lo, lo + len(some))), pa.array([bytes(data[i : i + size]) for i in some], pa.binary())], names=["key", "number", "data"])

    return texts.select("key", "text").mapInArrow(split, "key string, number long, data binary").repartition(partitions(texts.sparkSession), "key", "number")


def summaries(dealt: DataFrame) -> DataFrame:
    """(key, number, leave0, leave1, ends0, ends1) of each chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [transition(np.frombuffer(d.as_buffer(), np.uint8)) for d in batch.column(2)]
            columns = np.array([(*t.leave, *t.ends) for t in got], dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in columns]], names=["key", "number", "leave0", "leave1", "ends0", "ends1"])

    return dealt.mapInArrow(scan, "key string, number long, leave0 long, leave1 long, ends0 long, ends1 long")


def selected(scanned: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, n, first, second): tokens of each giant text and the chunks of the two cuts of each id that has it.

    ``wanted``: (key, id, h1, h2), a row for each id of a text. A text's summaries meet in one row.
    """
    entries = F.array_sort(F.collect_list(F.struct("number", "leave0", "leave1", "ends0", "ends1"))).alias("parts")
    by_text = scanned.groupBy("key").agg(entries)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = parts.values
                leave, ends = (np.stack([held.field(f"{name}{s}").to_numpy() for s in (0, 1)], axis=1) for name in ("leave", "ends"))
                left, total = prefixes(leave, ends)
                # The text is entered in state 0: the entry state of a chunk is what the ones before it leave.
                state = np.concatenate([[0], left[:-1, 0]])
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([int(total[-1, 0]) + 1]), pa.array([total[:, 0]], pa.list_(pa.int64())), pa.array([state], pa.list_(pa.int64()))], names=["key", "n", "reach", "state"])

    counted = by_text.mapInArrow(resolve, "key string, n long, reach array<long>, state array<long>")

    def place(k: Column) -> Column:
        """The first chunk whose ends reach ``k``, its entry state and the rank there; null at the borders."""
        at = F.array_size(F.filter("reach", lambda x: x < k)).cast("long")
        before = F.when(at > 0, F.element_at("reach", at.cast("int"))).otherwise(F.lit(0))
        held = F.struct(at.alias("chunk"), F.element_at("state", (at + 1).cast("int")).alias("state"), (k - before).alias("rank"))
        return F.when((k > 0) & (k < F.col("n")), held).cast(_PLACE)

    # A text with very many ids is copied to some tasks, at most one time for each partition.
    salt = F.pmod(F.xxhash64("id"), F.lit(partitions(scanned.sparkSession)))
    salted = wanted.withColumn("salt", salt)
    copies = counted.join(salted.select("key", "salt").distinct(), "key")
    low, high = (f(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)) for f in (F.least, F.greatest))
    return salted.join(copies, ["key", "salt"]).select("key", "id", "n", place(low).alias("first"), place(high).alias("second"))


def rearranged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """``docs`` with a new last column: a struct of n, form, prefix, middle (code points) and output."""
    to, key, ident, h = (unused_name(docs, c) for c in ("infill", "text_key", "id_key", "draws"))
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(h, F.array(*draws(doc_id, seed)))
    four = [F.col(h)[i] for i in range(4)]
    made = _rearrange(chunk)
    none = F.lit(None).cast(_PLACE)
    short = rows.filter(F.octet_length(whole) <= chunk).select(*names, made(whole, *four, F.lit(None).cast("long"), none, none).alias(to))
    # Copies of a giant text are scanned once; what equal rows of a task share is dropped before the shuffle.
    giant = rows.filter(F.octet_length(whole) > chunk).withColumn(key, F.sha2(whole, 256)).withColumn(ident, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    scanned = summaries(chunks(giant.select(F.col(key).alias("key"), whole.alias("text")).dropDuplicates(["key"]), chunk))
    wanted = giant.select(F.col(key).alias("key"), F.col(ident).alias("id"), four[0].alias("h1"), four[1].alias("h2")).distinct()
    places = selected(scanned, wanted).select(F.col("key").alias("_k"), F.col("id").alias("_i"), F.struct("n", "first", "second").alias("_places"))
    met = giant.alias("g").join(places.alias("p"), (F.col(f"g.{key}") == F.col("p._k")) & (F.col(f"g.{ident}") == F.col("p._i")), "left")
    found = met.select(*[F.col(f"g.`{c.replace('`', '``')}`") for c in docs.columns], made(F.coalesce(F.col(f"g.{text}"), F.lit("")), *[F.col(f"g.{h}")[i] for i in range(4)], F.col("p._places.n"), F.col("p._places.first"), F.col("p._places.second")).alias(to))
    return short.unionAll(found)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks can't arise across borders, and a text with one stays plain."""
    parts = F.split(output, "<[PSM]>", -1)
    in_order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(in_order)
