"""Training-order materialisation of token sequences.

1. ``token_sequences`` puts the documents in the order of (doc_id, hash of the text, text), null ids
   first, tokenises whole texts and cuts each document's ids into sequences of ``length`` ids (the last
   may be shorter; it is padded on disk).
2. ``assign_slots`` numbers the sequences 0 .. N-1 in that order and gives each a global slot: a keyed
   Feistel permutation over the smallest even power of two of at least N, walked along its cycle until
   it falls below N. Every sequence computes its own slot; slots are a permutation of 0 .. N-1 for any
   key and N. Slots follow from the key and the documents alone, not from files, partitions or cores.
3. ``in_training_order`` range-partitions by slot, so each partition holds whole shards in order.
4. ``write_shards`` writes each shard as a file of fixed-stride records in slot order: slot ``s`` is
   at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``, so a reader can resume at any
   slot with one seek. A shard is written under another name and then renamed; a repeated task
   writes the same bytes again.

Odd cases: a null text counts as empty; an empty text is one sequence that holds only the end id;
repeated rows are sequences of their own; an empty table has no sequences and no shards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import durable, partitions
from .tokens import END_ID, encoder

LENGTH = 512
PER_SHARD = 8192
ROUNDS = 4
KEY = "epoch-0"
PAD_ID = END_ID


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}/{i}".encode(), digest_size=8).digest(), "little") for i in range(rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: str = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index in 0 .. n-1: a bijection of 0 .. n-1 fixed by the key."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key, rounds)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(range, row, doc_id, part, n_tokens, ids): little-endian unsigned 16-bit ids; each text ends with id 0.

    ``range`` and ``row`` are the sequence's place in the documents' order: a range partition, and the
    sequences before it there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        here, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keys, parts, sizes, ids = [], [], [], []
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    whole = encode(t)
                    if whole.max() > 0xFFFF:
                        raise ValueError("this vocabulary has ids beyond 16 bits")
                    whole = whole.astype("<u2")
                    for i, at in enumerate(range(0, len(whole), length)):
                        keys.append(key)
                        parts.append(i)
                        sizes.append(len(whole[at : at + length]))
                        ids.append(whole[at : at + length].tobytes())
                rows = pa.array(np.arange(row, row + len(keys)))
                row += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), here, dtype=np.int32)), rows, pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], names=["range", "row", "doc_id", "part", "n_tokens", "ids"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("key"))
    # The hash splits the rows that repeat an id.
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    return ordered.select("doc_id", "text").mapInArrow(cut, "range int, row long, doc_id long, part int, n_tokens int, ids binary")


def assign_slots(sequences: DataFrame, key: str = KEY) -> DataFrame:
    """``sequences`` (a written table, see ``durable``) with ``slot`` for ``range`` and ``row``.

    The driver gathers one count for each range.
    """
    spark = sequences.sparkSession
    counts = sequences.groupBy("range").agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(max((r["range"] for r in counts), default=-1) + 2, dtype=np.int64)
    for r in counts:
        sizes[r["range"] + 1] = r["n"]
    starts = np.cumsum(sizes)
    total = int(starts[-1])
    held = spark.sparkContext.broadcast(starts)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = feistel(held.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(slot)], names=[*batch.schema.names[2:], "slot"])

    rows = sequences.select("range", "row", "doc_id", "part", "n_tokens", "ids")
    return rows.mapInArrow(slots, "doc_id long, part int, n_tokens int, ids binary, slot long")


def in_training_order(slotted: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Rows with ``shard`` and ``record``, dealt so that a partition holds whole shards in slot order."""
    n = partitions(slotted.sparkSession)
    placed = slotted.withColumn("shard", F.expr(f"slot div {per_shard}")).withColumn("record", F.expr(f"slot % {per_shard}").cast("int"))
    return placed.repartitionByRange(n, "shard").sortWithinPartitions("shard", "record")


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes the shards into ``folder`` (any place pyarrow's file systems reach) and lists them.

    Returns (shard, path, records, bytes, crc32), a row for each shard. A record is ``length`` ids
    of two bytes; a short sequence is padded with ``PAD_ID``.
    """
    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        state: dict = {}

        def finish() -> pa.RecordBatch:
            state["out"].close()
            place.move(state["held"], state["path"])
            return pa.RecordBatch.from_pylist([{"shard": state["shard"], "path": state["path"], "records": state["n"], "bytes": state["n"] * stride, "crc32": state["crc"]}])

        def begin(shard: int) -> None:
            path = f"{root}/shard-{shard:08d}.bin"
            held = f"{root}/.{shard:08d}-{hashlib.blake2b(np.random.default_rng().bytes(16), digest_size=6).hexdigest()}"
            state.update(shard=shard, path=path, held=held, out=place.open_output_stream(held), n=0, crc=0)

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state.get("shard") != shard:
                    if state:
                        yield finish()
                    begin(shard)
                record = ids + np.full((stride - len(ids)) // 2, PAD_ID, "<u2").tobytes()
                state["out"].write(record)
                state["n"] += 1
                state["crc"] = zlib.crc32(record, state["crc"])
        if state:
            yield finish()

    return ordered.select("shard", "ids").mapInArrow(write, "shard long, path string, records long, bytes long, crc32 long")


def read_record(folder: str, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """One sequence by its slot, padding included: a single seek into one shard."""
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(folder)
    with place.open_input_file(f"{root}/shard-{slot // per_shard:08d}.bin") as f:
        f.seek((slot % per_shard) * 2 * length)
        return np.frombuffer(f.read(2 * length), dtype="<u2")


def training_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The records of all shards, in training order: doc_id, part, n_tokens, ids, slot, shard, record."""
    sequences = durable(token_sequences(docs, length, doc_id, text), "sequences")
    return in_training_order(assign_slots(sequences, key), per_shard)
