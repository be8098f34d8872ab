"""Merkle fingerprints of documents.

A text is a tree: document -> sections -> paragraphs -> sentences; each node's hash is that of its
children's hashes, whole, of which the string prints the beginning. Paragraphs are lines. A section
ends at a blank line, or after a paragraph whose own hash says so (one in eight), so an insertion
does not move the later section borders. Leaves are sentences; a sentence of more than
``LONG`` characters is cut at words whose hash says so, so one long line is still a tree.

A fingerprint is the whole tree as one string::

    root ( ";" section-hash ( "," paragraph-hash [ ":" leaf-hashes ] )* )*

Roots test equality. ``likeness`` and ``differing_branches`` skip every branch whose hash the other
tree also holds and look only into the rest, down to the leaves.

Results in odd cases: a null text counts as empty; the empty text has a root and no sections; two
empty texts have likeness 1, an empty and a non-empty one 0. Repeated rows are fingerprinted row by
row. Columns of the input other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partition_keys, partitions, unused_name

LONG = 160
LEAF_HEX = 8
NODE_HEX = 10
ROOT_HEX = 32
SECTION_ODDS = 8
WORD_CUT_ODDS = 8
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*|[.!?]+\s*")
_WORD = re.compile(r"\s*\S+\s*")


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(paragraph: str) -> list[bytes]:
    out = []
    for sentence in _SENTENCE.findall(paragraph):
        if len(sentence) <= LONG:
            out.append(_hash(sentence.encode("utf-8", "surrogatepass")))
            continue
        words, held, size = _WORD.findall(sentence) or [sentence], [], 0
        for word in words:
            held.append(word)
            size += len(word)
            if size >= LONG or _hash(word.encode("utf-8", "surrogatepass"))[0] % WORD_CUT_ODDS == 0:
                out.append(_hash("".join(held).encode("utf-8", "surrogatepass")))
                held, size = [], 0
        if held:
            out.append(_hash("".join(held).encode("utf-8", "surrogatepass")))
    return out


def fingerprint(text: str | None) -> str:
    """The Merkle tree of ``text`` as a string; null and empty give the same tree."""
    sections: list[tuple[bytes, list[str]]] = []
    paragraphs: list[str] = []
    hashes: list[bytes] = []

    def close() -> None:
        if paragraphs:
            sections.append((_hash(b"s" + b"".join(hashes)), paragraphs.copy()))
            paragraphs.clear()
            hashes.clear()

    for line in (text or "").split("\n") if text else ():
        leaves = _leaves(line)
        whole = _hash(b"p" + b"".join(leaves))
        hashes.append(whole)
        paragraphs.append(whole.hex()[:NODE_HEX] + (":" + "".join(x.hex()[:LEAF_HEX] for x in leaves) if leaves else ""))
        if not line.strip() or whole[0] % SECTION_ODDS == 0:
            close()
    close()
    root = _hash(b"d" + b"".join(h for h, _ in sections)).hex()[:ROOT_HEX]
    return ";".join([root, *(",".join([h.hex()[:NODE_HEX], *ps]) for h, ps in sections)])


def _tree(printed: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    root, *sections = printed.split(";")
    out = []
    for section in sections:
        head, *paragraphs = section.split(",")
        rows = []
        for p in paragraphs:
            name, _, leaves = p.partition(":")
            rows.append((name, [leaves[i : i + LEAF_HEX] for i in range(0, len(leaves), LEAF_HEX)]))
        out.append((head, rows))
    return root, out


def _weight(leaves: list[str]) -> int:
    return max(1, len(leaves))


def likeness(a: str, b: str) -> float:
    """Twice the leaves both trees hold over all leaves of both; equal branches are not entered."""
    if a.partition(";")[0] == b.partition(";")[0]:
        return 1.0
    left, right = a.split(";")[1:], b.split(";")[1:]
    total = common = 0

    def size(section: str) -> int:
        return sum(max(1, len(p.partition(":")[2]) // LEAF_HEX) for p in section.split(",")[1:])

    total = sum(map(size, left)) + sum(map(size, right))
    if not left or not right or not total:
        return 0.0
    same = Counter(left) & Counter(right)
    common = sum(size(s) * n for s, n in same.items())

    def rest(sections: list[str]) -> Counter:
        over, out = same.copy(), Counter()
        for s in sections:
            if over[s] > 0:
                over[s] -= 1
                continue
            for p in s.split(",")[1:]:
                name, _, leaves = p.partition(":")
                if leaves:
                    out.update(leaves[i : i + LEAF_HEX] for i in range(0, len(leaves), LEAF_HEX))
                else:
                    out[name] += 1
        return out

    common += sum((rest(left) & rest(right)).values())
    return 2.0 * common / total


def differing_branches(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers in the first tree of the paragraphs the second does not hold."""
    (root_a, left), (root_b, right) = _tree(a), _tree(b)
    if root_a == root_b:
        return []
    heads = Counter(h for h, _ in right)
    names = Counter(n for _, ps in right for n, _ in ps)
    out = []
    for i, (head, paragraphs) in enumerate(left):
        if heads[head] > 0:
            heads[head] -= 1
            names.subtract(n for n, _ in paragraphs)
            continue
        for j, (name, _) in enumerate(paragraphs):
            if names[name] > 0:
                names[name] -= 1
            else:
                out.append((i, j))
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the Merkle fingerprint of each row's whole text in a new last column, named ``to`` or longer."""

    @F.pandas_udf("string")
    def printed(column):
        return column.map(lambda t: fingerprint(t if isinstance(t, str) else ""))

    return docs.withColumn(unused_name(docs, to), printed(F.col(text)))


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


#: What ``revisions`` returns.
REVISIONS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_changed long"


def _compared(rows: Iterable[tuple[int | None, str, bool, bool]]) -> Iterator[tuple]:
    """Rows in order; each but a copy is set against the row after it in its bucket."""
    before = None
    for doc_id, text, copy, bucket in rows:
        now = (doc_id, text, fingerprint(text), bucket)
        if before is not None:
            assert before[3] == bucket, "the last row of a bucket has no follower"
            yield _one(before, now)
        before = None if copy else now
    assert before is None, "the last row of a bucket has no follower"


def _one(own: tuple, following: tuple) -> tuple:
    doc_id, text, printed, _ = own
    changed = edited(text, following[1])
    after = fingerprint(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        printed,
        after,
        likeness(printed, after),
        likeness(printed, following[2]),
        printed.count(";"),
        len(differing_branches(after, printed)),
    )


def revisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The next document in falling id order lends the edited text its last third; the one after the
    last is the first. Null ids come last; rows of one id are ordered by a hash of their text, then by
    the text. A table of one row is its own follower; an empty table gives no rows.

    Plan: quantiles of the ids cut the order into as many buckets as there are shuffle partitions, a
    partition for each; an id that fills several buckets, or null, is cut by the hash. The first row of
    each bucket is also sent to the bucket before it, so buckets are compared independently and a task
    holds two texts at a time. The text is shuffled once.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("key"))
    n = partitions(spark)
    stats = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q"), F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    times = Counter(stats["q"] or [])
    cuts = sorted(times, reverse=True)
    # Falling order: ids above the highest cut, then from each cut down to the next; null ids are last.
    # A cut that several quantiles fall on is an id with as many buckets of its own.
    firsts = [1]
    for c in cuts:
        firsts.append(firsts[-1] + (times[c] + 1 if times[c] > 1 else 1))
    nulls = max(1, -(-(stats["n"] - stats["named"]) * n // max(1, stats["n"])))
    spread = lambda parts: F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * parts), parts - 1)
    if cuts:
        listed = F.array(*[F.lit(c).cast("long") for c in cuts])
        above = F.size(F.filter(listed, lambda c: F.col("doc_id") <= c))
        at = F.when(above == 0, F.lit(0)).otherwise(F.element_at(F.array(*[F.lit(f) for f in firsts[:-1]]), F.greatest(above, F.lit(1))))
        own_parts = F.element_at(F.array(*[F.lit(times[c]) for c in cuts]), F.greatest(above, F.lit(1)))
        is_cut = F.element_at(listed, F.greatest(above, F.lit(1))) == F.col("doc_id")
        number = at + F.when((above == 0) | (own_parts == 1), F.lit(0)).when(is_cut, spread(own_parts)).otherwise(own_parts)
        number = F.when(F.col("doc_id").isNull(), F.lit(firsts[-1]) + spread(F.lit(nulls))).otherwise(number)
    else:
        number = spread(F.lit(nulls))
    own = rows.withColumn("bucket", number.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("falling"), F.col("key"))
    heads = own.groupBy("bucket").agg(F.min(order).alias("head")).orderBy("bucket").collect()  # a row for each bucket
    used = [h["bucket"] for h in heads]
    before = {b: used[i - 1] for i, b in enumerate(used)}
    name = F.xxhash64("doc_id", "key")
    named = {r["name"]: before[r["bucket"]] for r in _names(spark, heads, name)}
    sent_to = F.try_element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in named]), F.array(*[F.lit(b) for b in named.values()])), name) if named else F.lit(None).cast("int")
    mapped = own.withColumn("at", F.when(sent_to.isNull(), F.array("bucket")).otherwise(F.array(F.col("bucket"), sent_to)))
    sent = mapped.select("doc_id", "key", "text", F.posexplode("at").alias("copy", "bucket"))
    # In a bucket: its own rows in falling order, then the next bucket's first row.
    to = F.element_at(F.array(*[F.lit(k).cast("long") for k in partition_keys(spark, n)]), F.pmod("bucket", F.lit(n)) + 1)
    dealt = sent.withColumn("to", to).repartition(n, "to").sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), "key", "text")
    return dealt.select("doc_id", "text", "copy", "bucket").mapInArrow(_compare_batches, REVISIONS)


def _names(spark, heads: list, name) -> list:
    """(bucket, name): the hash by which a bucket's first row is known."""
    rows = [(h["bucket"], None if h["head"]["last"] else -h["head"]["falling"], h["head"]["key"]) for h in heads]
    return spark.createDataFrame(rows, "bucket int, doc_id long, key long").select("bucket", name.alias("name")).collect()


_REVISION_TYPES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("n_sections", pa.int64()),
        ("n_changed", pa.int64()),
    ]
)


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        over = None  # the bucket whose first copy has been seen: later copies of it are of the same row
        for batch in batches:
            columns = batch.to_pydict()
            for doc_id, text, copy, bucket in zip(columns["doc_id"], columns["text"], columns["copy"], columns["bucket"], strict=True):
                if copy and over == bucket:
                    continue
                over = bucket if copy else None
                yield doc_id, text, bool(copy), bucket

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), _REVISION_TYPES.types, strict=True)], schema=_REVISION_TYPES)

    held, size = [], 0
    for row in _compared(rows()):
        held.append(row)
        size += len(row[3]) + len(row[4])
        if len(held) >= 500 or size >= 4_000_000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)
