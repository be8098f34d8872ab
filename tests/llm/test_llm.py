"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import os
import zlib

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, components, fingerprints, langid, mixing, near_dedup, packing, pii, sharding, tokens, training_order, url_filter
from tidemark.llm.common import durable, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "word", None, "a", 4),
    (4, "the same text of several words here", "en", "a", 35),
    (5, "the same text of several words here", "en", "b", 35),
    (5, "the same text of several words here", "en", "b", 35),
    (None, "no id but some words", "en", None, 20),
    (7, "x " * 30_000, "en", "b", 60_000),
    (8, "\n\n  \t", "de", "c", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = "size bucket language lang_pred lang_score known stays suspect whole source_size target copies of rate copy number r n key block class id text_a rep _known"
    return spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit(1) for n in names.split()})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from tidemark.llm import common

    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    def session(master, warehouse):
        none = SimpleNamespace(isDefined=lambda: False)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda folder: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: warehouse if "warehouse" in k else None), sparkContext=context)

    assert common.shared_dir(session("local[2]", "/tmp/w")) == "/tmp/w/_checkpoints"
    assert common.shared_dir(session("yarn", "hdfs://n/w")) == "hdfs://n/w/_checkpoints"
    for wrong in ("/tmp/w", "file:///tmp/w", "file:/tmp/w"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session("yarn", wrong))


# 1 fingerprints


def test_revisions_by_brute_force(docs):
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.revisions(docs).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, nxt = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + nxt[:n]
        g = got[r["doc_id"]]
        assert g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and g["n_chars"] == len(text)
        assert g["fingerprint"] == fingerprints.fingerprint(text) and g["edited_fingerprint"] == fingerprints.fingerprint(changed)
        assert g["near_next"] == pytest.approx(likeness(text, nxt)) and g["near_edited"] == pytest.approx(likeness(text, changed))


def likeness(a, b):
    """Of the sections, then of the paragraphs' leaves in the other sections, how many both texts hold."""
    left, right = (fingerprints._tree(fingerprints.fingerprint(x))[1] for x in (a, b))
    if a == b:
        return 1.0
    size = lambda sections: sum(max(1, len(leaves)) for _, ps in sections for _, leaves in ps)
    total, both = size(left) + size(right), 0
    for head, ps in list(left):
        twin = next((x for x in right if x == (head, ps)), None)
        if twin is not None:
            left.remove((head, ps))
            right.remove(twin)
            both += size([(head, ps)])
    bags = [[x for _, ps in side for name, leaves in ps for x in (leaves or [name])] for side in (left, right)]
    for x in bags[0]:
        if x in bags[1]:
            bags[1].remove(x)
            both += 1
    return 2 * both / total if total and a and b else 0.0


def test_a_leaf_changes_all_its_branch():
    a = "One is here. Two is there.\n\nThree."
    (_, left), (_, right) = (fingerprints._tree(fingerprints.fingerprint(x)) for x in (a, a.replace("Two", "Four")))
    assert left[0][0] != right[0][0] and left[0][1][0][0] != right[0][1][0][0] and left[0][1][0][1][0] == right[0][1][0][1][0]
    long = ["\n".join(f"{w} {i} {w}." for i in range(6000)) for w in ("this", "that")]
    assert fingerprints.likeness(*map(fingerprints.fingerprint, long)) < 1e-5


def test_revisions_of_hot_ids(spark):
    """An id that fills several buckets is cut by the hash of the text; the order is still one ring."""
    rng = np.random.default_rng(3)
    data = [(7, f"seven {i}") for i in range(400)] + [(None, f"null {i}") for i in range(400)] + [(int(i), f"own {i}") for i in rng.permutation(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    key = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    ring = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    wanted = sorted((str(i), hashlib.sha256(fingerprints.edited(t, ring[(at + 1) % len(ring)][1]).encode()).hexdigest()) for at, (i, t) in enumerate(ring))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprints.revisions(df).collect()) == wanted


def test_fingerprint_locates_edits():
    a = "\n".join(f"Paragraph {i} says this. And that." for i in range(40))
    b = a.replace("Paragraph 17", "Paragraph seventeen")
    fa, fb = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    assert fingerprints.likeness(fa, fa) == 1 and 0.9 < fingerprints.likeness(fa, fb) < 1
    assert len(fingerprints.differing_branches(fa, fb)) == 1
    assert fingerprints.likeness(fingerprints.fingerprint(""), fa) == 0
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("")


def test_revisions_odd(odd, none):
    assert fingerprints.revisions(odd).count() == len(ODD)
    assert fingerprints.revisions(none).count() == 0
    assert fingerprints.revisions(odd.filter("doc_id = 3")).first()["near_next"] == 1


# 2 training order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(training_order.feistel(np.arange(n), n, "k")) == list(range(n))


def test_shards_round_trip(docs, tmp_path):
    ordered = durable(training_order.training_order(docs, length=64, per_shard=100), "ordered")
    folder = f"file://{tmp_path}/shards"
    listed = training_order.write_shards(training_order.in_training_order(ordered.drop("shard", "record"), 100), folder, 64, 100).collect()
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(x["records"] for x in listed) == len(rows)
    for r in rows[:50]:
        got = training_order.read_record(folder, r["slot"], 64, 100)
        assert got[: r["n_tokens"]].astype("<u2").tobytes() == bytes(r["ids"]) and not got[r["n_tokens"] :].any()


def test_slots_follow_from_the_documents_alone(spark, docs):
    """Slots by brute force, whatever the partitions of the input."""
    key = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    encode, number = tokens.encoder(), []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], key[r["doc_id"]])):
        number += [(r["doc_id"], i) for i in range(-(-len(encode(r["text"] or "")) // 64))]
    slots = dict(zip(number, training_order.feistel(np.arange(len(number)), len(number), "k").tolist(), strict=True))
    for parts in (1, 7):
        got = training_order.training_order(docs.repartition(parts, "source"), length=64, key="k").collect()
        assert {(r["doc_id"], r["part"]): r["slot"] for r in got} == slots
    with pytest.raises(Exception, match="16 bits"):
        training_order.token_sequences(docs.limit(1).withColumn("text", F.lit("x")), tokenizer=wide_vocabulary()).count()


def wide_vocabulary():
    """The public vocabulary with an added token beyond 16 bits that is a plain letter."""
    import json
    import shutil
    import tempfile

    import public_tokenizers

    folder = tempfile.mkdtemp()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        held = json.load(f)
    held["added_tokens"].append({"id": 70_000, "content": "x"})
    with open(f"{folder}/wide.json", "w", encoding="utf-8") as f:
        json.dump(held, f)
    shutil.copy(public_tokenizers.path("byte_bpe_50k.tiktoken"), f"{folder}/wide.tiktoken")
    return f"{folder}/wide.json"


def test_training_order_odd(odd, none):
    assert training_order.training_order(none).count() == 0
    rows = training_order.training_order(odd).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows}[1] == 1


# tokens


def test_ids_are_those_of_tokenizers(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.encoder()
    for text in [r["text"] for r in docs.collect()] + ["", "  a\n \n b  ", "it's 12 <|endoftext|> x", "<|endoftext|><|endoftext|>  <|endoftext|", " <|endoftext|> ", "\t　é"]:
        assert encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


# 3 url filter


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example.net/en/1", None),
            (2, "http://A.Example.net/xx", ""),
            (3, "http://alias.com/1", '<link href="http://b.net/x" rel="canonical">'),
            (4, "http://alias.com/2", '<meta http-equiv="refresh" content="0; url=http://alias.com/1">'),
            (5, "http://alias.com/3", '<link rel=canonical href="http://c.net/x"><link rel="canonical" href="http://o.org/fr/1">'),
            (6, None, None),
            (7, "no scheme", "<p>"),
            (8, "https://x.org/fr/9", None),
            (9, "http://net", None),
        ],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    assert got[1]["rule"] == "example.net/en/" and got[2]["rule"] == "net/" and got[2]["host"] == "a.example.net"
    assert got[6]["host"] == "" and got[7]["path"] == "" and got[9]["rule"] is None
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_targets_are_resolved(spark):
    from urllib.parse import urljoin

    bases = ["http://a.b/c/d?q#f", "http://a.b", "http://a.b/", "http://a.b/c/d/e/"]
    targets = ["g", "./g", "g/", "/g", "//h/g", "?y", "g?y/../z", "../g", "../../g", "../../../g", "..", ".", "./", "../", "g/./h/../i", "x:y", "http://z/w", "/a/../b/./c", "g;x=1/../y"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    for r in df.withColumn("got", url_filter.resolved(F.col("b"), F.col("t"))).collect():
        wanted = urljoin(r["b"], r["t"])
        assert r["got"] == wanted, r


def test_longest_rule_and_ties(spark):
    rules = [("b.c", "/x", "block"), ("c", "/x", "allow"), ("a.b.c", "/", "allow"), ("b.c", "/y", "allow"), ("c", "/yyy", "block"), ("c", "/y/y", "allow")]
    df = spark.createDataFrame([("a.b.c", "/x"), ("b.c", "/x1"), ("z.c", "/x"), ("xc", "/x"), ("b.c", "/yyy"), ("a.b.c", "/q"), ("", "")], "host string, path string")
    wanted = ["a.b.c/", "b.c/x", "c/x", None, "b.c/y", "a.b.c/", None]
    for compiled in (0, 100):
        got = {(r["host"], r["path"]): (r["rule"], r["said"]) for r in url_filter.with_rule(df, rules, compiled).collect()}
        assert [got[k][0] for k in map(tuple, df.collect())] == wanted
        assert got["b.c", "/yyy"][1] == "allow" and got["z.c", "/x"][1] == "allow"


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(0, i) for i in range(400, 460)] + [(i, i + 1) for i in range(500, 540)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# 4 packing


def test_bin_completion_against_all_packings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 11, 7).tolist()
        counts = {s: sizes.count(s) for s in sizes}
        plan, bound = packing.complete_bins(counts, 10)
        used = sum(n for _, n in plan)
        assert sorted(s for f, n in plan for s in f * n) == sorted(sizes) and all(sum(f) <= 10 for f, _ in plan)

        def least(rest, rooms):
            if not rest:
                return len(rooms)
            out = least(rest[1:], [*rooms, 10 - rest[0]])
            for i, r in enumerate(rooms):
                if r >= rest[0]:
                    out = min(out, least(rest[1:], [*rooms[:i], r - rest[0], *rooms[i + 1 :]]))
            return out

        best = least(sorted(sizes, reverse=True), [])
        exact = sum(n for _, n in packing.complete_bins(counts, 10, packing.EXACT)[0])
        assert bound <= best == exact <= used and used == best


def test_bin_completion_beats_its_incumbent():
    counts = {5: 1, 4: 2, 3: 1, 2: 2}
    assert sum(n for _, n in packing.best_fit_decreasing(counts, 10)) == 3
    assert sum(n for _, n in packing.complete_bins(counts, 10)[0]) == 2
    assert sum(n for _, n in packing.complete_bins(counts, 10, packing.EXACT)[0]) == 2
    held = packing.Limits(nodes=0, nodes_a_length=0)
    assert sum(n for _, n in packing.complete_bins(counts, 10, held)[0]) == 3


def test_bin_completion_reaches_leaves_with_many_lengths():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.3, 0.8, 5000).astype(int), 1, 2048).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, bound = packing.complete_bins(counts)
    used = {}
    for filling, bins in plan:
        assert sum(filling) <= 2048
        for n in filling:
            used[n] = used.get(n, 0) + bins
    assert used == counts
    assert bound <= sum(n for _, n in plan) < sum(n for _, n in packing.best_fit_decreasing(counts, 2048))


def test_pack(docs, odd, none):
    for d in (docs, odd):
        rows = packing.pack(d).collect()
        encode = tokens.encoder()
        texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append(r)
            ids = encode(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes()) and len(ids) == r["length"]
        for held in by.values():
            held.sort(key=lambda r: r["offset"])
            ends = list(itertools.accumulate(r["length"] for r in held))
            assert [r["offset"] for r in held] == [0, *ends[:-1]] and ends[-1] <= 2048
        assert len(rows) >= d.count()
    assert packing.pack(none).count() == 0


# 5 nearest neighbours


def test_search_recall_and_scores(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got = {}
    for r in ann.search(e).collect():
        got.setdefault(r["query_id"], []).append(r)
    hit = 0
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, held in got.items():
        s = (x * x[ids == q][0]).sum(axis=1)
        keep = ids != q
        best = ids[keep][np.lexsort((ids[keep], -s[keep]))][:20]
        held.sort(key=lambda r: r["rank"])
        assert len(held) == 20 and [r["rank"] for r in held] == list(range(1, 21))
        assert all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12 for r in held)
        hit += len(set(best) & {r["vec_id"] for r in held})
    assert hit / (20 * len(got)) >= 0.9


def test_search_in_many_blocks(spark):
    """Clusters of unequal norms, small blocks and few probes: every query is full, and recall holds."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    x[100:1100] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    for probes, block, least in ((None, 50, 0.9), (1, 30, 0.0)):
        got = {}
        for r in ann.search(df, every=50, probes=probes, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hit = 0
        assert set(got) == set(range(0, 3000, 50))
        for q, held in got.items():
            held.sort()
            s = (x * x[q]).sum(axis=1)
            s[q] = -np.inf
            best = np.lexsort((np.arange(3000), -s))[:20].tolist()
            assert len(held) == 20 and [r for r, _, _ in held] == list(range(1, 21))
            assert all(score == s[v] for _, v, score in held) and [(-s[v], v) for _, v, _ in held] == sorted((-s[v], v) for _, v, _ in held)
            hit += len(set(best) & {v for _, v, _ in held})
        assert hit / (20 * len(got)) >= least


def test_search_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (20, [1.0, None]), (40, [0.5, 0.5]), (60, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 40), (0, 4, 3), (40, 1, 0), (40, 2, 1), (40, 3, 2), (40, 4, 3)]
    assert ann.search(df.limit(0)).count() == 0


# 6 language


def test_language_held_out(docs, odd, none):
    p = langid.learn(docs)
    got = langid.identify(docs, p).filter(langid.held_out(F.col("doc_id")))
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    # The odd rows have a column of that name already, which stays.
    rows = {r["doc_id"]: r for r in langid.identify(odd, p).collect()}
    assert rows[1]["lang_pred_"] == rows[2]["lang_pred_"] == rows[8]["lang_pred_"] == "und" and rows[4]["lang_pred_"] == "en" and rows[4]["lang_pred"] == 1
    assert langid.identify(none, langid.learn(none)).count() == 0


# 7 mixing


def test_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 500, "d": 0, None: 300}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in sizes}
        over = {s for s in open_ if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    assert got == pytest.approx(target)


def test_mix(docs, odd, none):
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert all(r["copies"] in (0, 1, 2) and r["size"] == len((r["text"] or "").encode().split()) for r in rows)
    assert mixing.emit(mixed).count() == sum(r["copies"] for r in rows)
    assert mixed.select("doc_id", "copies").exceptAll(mixing.mix(docs).select("doc_id", "copies")).count() == 0
    other = mixing.mix(odd)
    assert other.count() == len(ODD) and "size_" in other.columns
    assert mixing.mix(mixing.sized(docs, to="words"), size="words").select("doc_id", "copies").exceptAll(mixed.select("doc_id", "copies")).count() == 0
    assert mixing.mix(none).count() == 0


# 8 personal data


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("mail a.b@c.de now", "email:5:13"),
        ("a@b@c.d", "email:2:7"),
        ("at 10.0.0.255 and 10.0.0.256", "ip:3:13"),
        ("1.2.3.4.5.6.7.8", "ip:0:7,ip:8:15"),
        ("4111 1111 1111 1111", "card:0:19"),
        ("4111 1111 1111 1112", ""),
        ("+1 (269) 555-3296", "phone:0:17"),
        ("+1 (269) 555-3296 4524132264652876", "phone:0:17,card:18:34"),
        ("GB82 WEST 1234 5698 7654 32", "iban:0:27"),
        ("call 212 555 0199 today", "phone:5:17"),
        ("scores 212 555 0199 today", ""),
        ("ssn 078-05-1120", "national_id:4:15"),
        ("é a@b.cd", "email:2:8"),
        ("0" * 5000 + ".1.2.3", "ip:0:5006"),
        ("9" * 5000 + ".1.2.3", ""),
        ("0" * 5000 + "255.0000.2.3", "ip:0:5012"),
        # The account number scores higher than the bare group of digits within it, which a nearby word supports.
        ("call GB82 WEST 1234 5698 7654 32", "iban:5:32"),
    ],
)
def test_spans(text, wanted):
    assert pii.printed(pii.spans(text)[1]) == wanted


def test_base_spans_by_plain_patterns(docs):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in [r["text"] for r in docs.collect()] + ["a" * 50 + "@b", "x@y.z@q.r", "@@a@b.c", "1.1.1.1.1", "0 " * 40]:
        got = [s for s in pii.base_spans(text)[0]]
        plain = [("email", m.start(), m.end()) for m in email.finditer(text)]
        plain += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        plain += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
        plain += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert got == sorted(plain, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_many_spans_take_time_in_proportion():
    import time

    began = time.time()
    found = pii.spans("card 4111111111111111 call 212 555 0199 a@b.cd +1 (269) 555-3296 4524132264652876 " * 20_000)[1]
    assert len(found) == 100_000 and time.time() - began < 60


def test_pii_odd(odd, none):
    assert pii.detect(odd).count() == len(ODD) and pii.detect(none).count() == 0
    assert pii.redact(odd).filter("text is null").count() == 1
    assert pii.redacted("mail a.b@c.de now", pii.spans("mail a.b@c.de now")[1]) == "mail [email] now"


# 9 sharding


def test_shards_are_even(docs, odd, none):
    for d in (docs, odd):
        rows = sharding.shard(d).collect()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        n = d.count()
        assert sorted(len(by.get(s, [])) for s in range(8)) == sorted(n // 8 + (s < n % 8) for s in range(8))
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(none).count() == 0


def test_growth_moves_little(spark):
    """A ninth shard takes a ninth of the rows; bounded loads move some more, a hot text's rows among them."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one hot text' ELSE concat('text ', id) END AS text")
    for some, most in ((rows.filter("doc_id % 3 > 0"), 0.25), (rows, 0.35)):
        a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(some, n).collect()} for n in (8, 9))
        assert 1 / 9 - 0.01 <= sum(a[k] != b[k] for k in a) / len(a) <= most


def test_shards_by_brute_force(spark, docs):
    """Rows in ring order, one by one: each takes the next place clockwise in a shard with room."""
    rows = docs.select("doc_id", "text").union(spark.range(10_000, 10_200).selectExpr("id", "'one hot text'"))
    got = {r["doc_id"]: r for r in sharding.shard(rows).collect()}
    places, owners = sharding.ring(8, sharding.VNODES)
    place = {r["doc_id"]: r["p"] % 2**64 for r in rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    home = {k: int(owners[np.searchsorted(places, np.uint64(p)) % len(places)]) for k, p in place.items()}
    assert home == {k: r["home"] for k, r in got.items()}
    room, n = sharding.capacities(len(got), 8), len(places)
    arcs = {}
    for k, p in place.items():
        arcs.setdefault(int(np.searchsorted(places, np.uint64(p)) % n), []).append(k)
    left, count = {a: len(v) for a, v in arcs.items()}, {}
    for step in range(n):
        for a in sorted(left):
            shard = int(owners[(a + step) % n])
            taken = min(left[a], room[shard])
            left[a] -= taken
            room[shard] -= taken
            count[a, shard] = count.get((a, shard), 0) + taken
    of = {k: a for a, v in arcs.items() for k in v}
    seen = {}
    for k, r in got.items():
        seen[of[k], r["shard"]] = seen.get((of[k], r["shard"]), 0) + 1
    assert seen == {k: v for k, v in count.items() if v}


# 10 near-duplicates


def brute(rows, shingle, percent):
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        size = min(shingle, len(w))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        same = len(sets[i] & sets[j])
        if same and 100 * same >= percent * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("shingle", [2, 5])
def test_classes_by_brute_force(docs, shingle):
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], shingle, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(docs, shingle).collect()}
    assert got == wanted


def crowd(spark, size, pairs):
    """Texts of mutual similarity 0.75; text 2 i and text 2 i + 1 of the first pairs have 0.81."""
    rows = []
    for i in range(size):
        both = [f"p{i // 2}_{k}" for k in range(7)] if i < 2 * pairs else [f"q{i}_{k}" for k in range(7)]
        rows.append((i, " ".join([f"core{k}" for k in range(172)] + both + [f"own{i}_{k}" for k in range(21)])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("window", [near_dedup.WINDOW, 1])
def test_single_partners_in_a_dense_region(spark, window):
    size, pairs = 500, 40
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(crowd(spark, size, pairs), shingle=1, window=window).collect()}
    assert got == {i: i - i % 2 if i < 2 * pairs else i for i in range(size)}


@pytest.mark.parametrize("region", [2, 50])
def test_dense_regions_are_joined_by_rare_shingles(spark, docs, region):
    """Nothing is lost where regions count as large and no row has a neighbour to be compared with."""
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(crowd(spark, 300, 30), shingle=1, window=1, region=region).collect()}
    assert got == {i: i - i % 2 if i < 60 else i for i in range(300)}
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(docs, 2, window=1, region=region).collect()}
    assert got == wanted


def test_marks_hold_all_numbers(spark):
    x = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    held = near_dedup.marks(spark.createDataFrame([(int(v),) for v in x], "h long"), "h")
    other = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    assert held.holds(x).all() and held.holds(other).mean() < 0.1
    few = near_dedup.marks(spark.createDataFrame([(int(v),) for v in x], "h long"), "h", most=12)
    assert few.holds(x).all()


def test_classes_odd(odd, none):
    rows = near_dedup.classes(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert got[5]["component_id"] == 4 and not got[5]["kept"] and got[2]["component_id"] == 2 and got[1]["n_shingles"] == 0
    kept = [r["doc_id"] for r in near_dedup.one_of_each(odd).collect()]
    assert sorted(k for k in kept if k) == [1, 2, 3, 4, 7, 8] and None in kept
    assert near_dedup.classes(none).count() == 0 and near_dedup.one_of_each(none).count() == 0


# pipeline


def test_pipeline(spark, docs, odd, none):
    for d in (docs, odd, none):
        held = d
        for name, stage in corpus_pipeline.STAGES:
            before = held
            held = durable(stage(spark, held, SF), "test")
            if name != "packed":
                assert held.columns == d.columns, name
            if name == "personal_data":
                assert held.count() == before.count()
        assert held.columns[:2] == ["doc_id", "piece"]
    assert corpus_pipeline.run(spark, SF).count() > 0


# intermediate tables


def test_durable_writes_parts_only_and_verifies_them(spark):
    wanted = [(i, str(i * 7)) for i in range(2000)]
    held = durable(spark.createDataFrame(wanted, "id long, t string").repartition(3), "parts")
    files = [f.removeprefix("file://") for f in held.inputFiles()]
    assert sorted(os.listdir(os.path.dirname(files[0]))) == sorted(map(os.path.basename, files))
    assert sorted(map(tuple, held.collect())) == wanted
    whole = open(files[0], "rb").read()
    caught = 0
    for at in range(64, len(whole) // 2, len(whole) // 12):  # no changed byte is read as other data
        with open(files[0], "wb") as f:
            f.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        try:
            got = held.collect()
        except (Py4JError, PySparkException):
            caught += 1
        else:
            assert sorted(map(tuple, got)) == wanted
    assert caught > 0
