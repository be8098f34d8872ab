"""Fill-in-the-middle and vector codes against plain code, and odd inputs."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import infill, queries, vector_codes
from tidemark.llm.common import discard, durable, table

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASHING = "infill infill_ text_key id_key draws key number data n form prefix middle output parts reach state _k _i label_ q slot sums v `tick a.b"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    """(n, form, prefix, middle, output) by a regular expression and slices."""
    text = text or ""
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    n = len(ends) - 1
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = [
    (1, None),
    (2, ""),
    (3, "word"),
    (4, " \n\t "),
    (5, "\x0b two words\x0c "),
    (6, "with a <S> mark " * 40),
    (7, "x " * 30_000),
    (8, "é ü ß 日本 語 " * 50),
    (9, "no break spaces are letters"),
    (10, "<<P > < S> almost <"),
    (11, "q" * 5_000),
    (None, "no id " * 30),
    (12, "the same row again and again " * 30),
    (12, "the same row again and again " * 30),
    (13, "the same row again and again " * 30),
]


@pytest.mark.parametrize("chunk", [3, 64, infill.CHUNK])
def test_infill_by_plain_code(spark, chunk):
    """Small chunks send texts through the scan by chunks, with borders inside words, spaces and characters."""
    rows = ODD + [(i, f"{'w' * (i % 7)}  {i} tail\n" * (i % 40)) for i in range(20, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.rearranged(docs, chunk=chunk).select("doc_id", "text", "infill.*", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in got), key=key) == sorted(((i, *plainly(i, t)) for i, t in rows), key=key)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_infill_query(spark):
    docs = table(spark, SF, "documents").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_fim_scan(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        n, form, prefix, middle, output = plainly(r["doc_id"], r["text"])
        assert got[r["doc_id"]] == (n, form, prefix, middle, sha(output), sha(r["text"] or ""))


def test_infill_clashing_names(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING.split()})
    for chunk in (3, infill.CHUNK):
        got = infill.rearranged(docs, chunk=chunk)
        assert got.columns[:-1] == docs.columns and got.count() == len(ODD)
        assert got.select(f"{got.columns[-1]}.n").count() == len(ODD)
    assert infill.rearranged(docs.limit(0)).count() == 0


def test_transitions_compose():
    rng = np.random.default_rng(1)
    for _ in range(50):
        data = rng.choice(np.frombuffer(b"a \nb", np.uint8), size=rng.integers(0, 60))
        cuts = sorted(rng.integers(0, len(data) + 1, 4).tolist())
        parts = [infill.transition(x) for x in np.split(data, cuts)]
        left = infill.NOTHING
        for p in parts:
            left = infill.compose(left, p)
        right = infill.NOTHING
        for p in reversed(parts):
            right = infill.compose(p, right)
        whole = infill.transition(data) if len(data) else infill.NOTHING
        assert left == right == whole
        leave, ends = infill.prefixes(np.array([p.leave for p in parts]), np.array([p.ends for p in parts]))
        assert tuple(leave[-1]) == whole.leave and tuple(ends[-1]) == whole.ends


# Vector codes


def brute_codes(rows, entries=256, rounds=4):
    """Every distance of every part to every entry, in Python integers."""
    kept = [(i, label, [math.floor(1024 * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(r[2]) for r in kept), default=0) // 4) * 4
    q = np.array([r[2] + [0] * (width - len(r[2])) for r in kept], dtype=np.int64).reshape(len(kept), width)
    parts = np.split(q, 4, axis=1)
    books = [p[:entries].copy() for p in parts]

    def assign():
        apart = [np.stack([((p - e) ** 2).sum(axis=1) for e in b], axis=1) if len(b) else np.zeros((0, 1), int) for p, b in zip(parts, books)]
        return np.stack([a.argmin(axis=1) for a in apart], axis=1), sum(a.min(axis=1) for a in apart)

    for _ in range(rounds):
        code, _ = assign()
        for j, (p, b) in enumerate(zip(parts, books)):
            for e in range(len(b)):
                mine = p[code[:, j] == e]
                if len(mine):
                    b[e] = [math.floor(x) for x in mine.sum(axis=0) // len(mine)]
    code, error = assign()
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[1]] = by_label.get(r[1], 0) + int(e)
    digest = sha(",".join(str(x) for b in books for x in b.ravel().tolist()))
    return [(r[0], "".join(f"{c:02x}" for c in cs), int(e), by_label[r[1]], digest) for r, cs, e in zip(kept, code.tolist(), error)]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(str(x) for x in r))


def test_codes_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert in_order(queries.op12_exponion_codes(spark, SF).collect()) == in_order(brute_codes(rows))


def coded(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got, books = vector_codes.compress(df, **options)
    return in_order((*r, vector_codes.codebooks_sha256(books)) for r in got.select("vec_id", "code", "error", "label_error").collect())


def test_codes_of_ties_and_clusters(spark):
    """Small integers make equal distances and unused entries; clusters make the radius cut."""
    rng = np.random.default_rng(5)
    small = [(int(i), (rng.integers(-1, 2, 8) / 1024).tolist(), int(i) % 3) for i in rng.permutation(300)]
    assert coded(spark, small, entries=40) == in_order(brute_codes(small, 40))
    centres = rng.normal(0, 5, (30, 8))
    close = [(i, (centres[i % 30] + rng.normal(0, 0.01, 8)).astype(np.float32).tolist(), None if i % 5 == 0 else 7) for i in range(900)]
    assert coded(spark, close, entries=64, rounds=2) == in_order(brute_codes(close, 64, 2))


def test_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.5, nan, 1.0, 1.0], 1), (3, [0.5, None, 1.0, 1.0], 1), (4, [inf, 0.0, 0.0, 0.0], 2), (5, [0.25, -0.3, 0.1, 0.0], None), (5, [0.25, -0.3, 0.1, 0.0], None), (5, [0.2, 0.3, 0.1, 0.0], 2), (None, [1.0, 2.0, 3.0, 4.0], 2), (7, [0.0, 0.0, 0.0, 0.0], 1), (8, [], 1), (9, [1.0, -1.0], 1), (10, [0.1] * 5, 1)]
    got = coded(spark, rows)
    assert got == in_order(brute_codes(rows)) and len(got) == 8
    assert coded(spark, rows[:1]) == [] and coded(spark, []) == []
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [1e30] * 4, 1)])


def test_search_is_exact_and_cuts(monkeypatch):
    """The scan equals a full one from any start, and looks at few entries where they lie in clusters."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 6))
    entries = (centres[:, None, :] + rng.integers(-20, 20, (16, 16, 6))).reshape(256, 6)
    rows = centres[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 6))
    apart = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    book, seen = vector_codes.Codebook(entries), []
    held = book.distances
    book.distances = lambda r, s, some: seen.append(len(r) * len(some)) or held(r, s, some)
    for start in (np.zeros(2000, int), rng.integers(0, 256, 2000), apart.argmin(axis=1)):
        seen.clear()
        best, least = book.nearest(rows, start)
        assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    assert sum(seen) < 2000 * 256 / 2
    monkeypatch.setattr(vector_codes, "STEP", 16)
    again = vector_codes.Codebook(entries)
    held = again.distances
    again.distances = lambda r, s, some: seen.append(len(r) * len(some)) or held(r, s, some)
    seen.clear()
    assert (again.nearest(rows, apart.argmin(axis=1))[0] == apart.argmin(axis=1)).all() and sum(seen) < 2000 * 256 / 8
    far = rng.integers(-(1 << 27), 1 << 27, (50, 4))
    big = vector_codes.Codebook(far)
    assert (big.nearest(far, np.zeros(50, int))[0] == np.arange(50)).all()


def test_a_discarded_table_is_gone(spark, tmp_path):
    import os

    held = durable(spark.range(3).toDF("x"), "gone")
    place = held._written.removeprefix("file:").replace("//", "/", 1)
    assert os.path.isdir(place) and held.count() == 3
    discard(held)
    assert not os.path.isdir(place)
