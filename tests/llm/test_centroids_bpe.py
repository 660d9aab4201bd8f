"""Centroid clustering and byte-level BPE against plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest


def plain(rows, k=16, rounds=3, size=64):
    """k-means over Python's integers: every vector against every centroid."""
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d2(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = [[] for _ in centers]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centers = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centers, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total = lambda c: sum(d for _, j, d in out if c is None or j == c)
    big = (1 << 63) - 1
    return sorted(((-1 if i is None else i), c, min(d, big), min(total(c), big), min(total(None), big), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in out)


SCHEMA = "cluster string, vec_id long, embedding array<double>, distance int, `a.b` int"


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64)) * spread
    rows = [(i, (middle[i % 5] + rng.normal(size=64) * 0.2).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # copies and ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[7][1]), (n + 50, [0.0] * 64), (n + 51, [0.0] * 63), (n + 52, [math.nan] + [0.0] * 63), (n + 53, [math.inf] + [0.0] * 63), (n + 54, [None] + [0.0] * 63), (n + 55, None), (n + 56, [])]
    return rows


def run(spark, rows, parts=3, **kw):
    from folioscope.llm.centroids import cluster

    df = spark.createDataFrame([("c", i, v, 0, 0) for i, v in rows], SCHEMA).repartition(parts)
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in cluster(df, **kw).collect())


@pytest.mark.parametrize("rows", [vectors(200, 1), vectors(150, 2, 40.0), vectors(60, 3, 1e7), vectors(60, 4, 1e25), vectors(3, 5)[:9], [(i, [float(i % 2)] * 64) for i in range(30)]], ids=["near", "far", "beyond int32", "beyond long", "few", "ties"])
def test_clusters(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_other_sizes(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(5)]) for i in range(120)]
    assert run(spark, rows, k=7, rounds=6, size=5) == plain(rows, 7, 6, 5)
    assert run(spark, rows, k=7, rounds=0, size=5) == plain(rows, 7, 0, 5)
    assert run(spark, [], parts=1) == [] and run(spark, [(1, None)], parts=1) == []


def test_scan_stops():
    """Far centroids aren't looked at, and one at exactly twice the distance still is, as it may tie with a smaller number."""
    from folioscope.llm.centroids import Centers

    c = Centers([[0, 4], [0, 0], [100, 0]])
    got = c.nearest(np.array([[0, 2], [0, 1]]), np.array([1, 1]))
    assert got[0].tolist() == [0, 1] and got[1].tolist() == [4, 1]


PARTS = ["word", "Ünï", "it's", "'s", "'S", "x.", "###", "a1", "12", "…", "日本", "\x00", " ", " ", " ", "\n", "\n", "\n\n", "\t", "\r", " ", "　", "\u0085", "᠎", "'", "''", "'re", "'ll", "'v", "don't,", "😀", "é", "<|endoftext|>", "٣", "Ⅳ", "\x1c"]


def library():
    import public_tokenizers
    import tiktoken

    from folioscope.llm.byte_bpe import ranks_path, read_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path()), special_tokens={})


def test_pretokens():
    """Any text gives the library's ids; so does one of every code point."""
    from folioscope.llm.byte_bpe import Coder, ranks_path

    rng, lib, coder = random.Random(3), library(), Coder(ranks_path())
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    points = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x110000))]
    texts += ["".join(points[k : k + 4000]) for k in range(0, len(points), 4000)] + ["a" + c + "1" for c in points[::97]] + ["", "'", "'s", "a'", " ", "z" * 50000, "日" * 9000]
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        assert coder.texts([t.encode() for t in part]).to_pylist() == [lib.encode_ordinary(t) for t in part]


def test_chunks_meet():
    """Sure boundaries of a chunk are those of the whole text, wherever it is cut."""
    from folioscope.llm.byte_bpe import _begins, sure

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(12)).encode()
        whole = set(_begins(text).tolist())
        for end in range(1, len(text)):
            if text[end] & 0xC0 != 0x80:
                assert set(sure(text[:end], False).tolist()) <= whole | {0}


@pytest.mark.parametrize("step,overlap", [(16, 4), (64, 24), (200, 200), (1 << 16, 1 << 12)])
def test_byte_bpe(spark, step, overlap):
    from folioscope.llm.byte_bpe import decode, encode

    rng, lib = random.Random(8), library()
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += [None, "", " ", "x" * 700, " " * 500 + "y", "日本語" * 200, "　" * 99 + "'s", "a " * 300, "a " * 300, texts[0]]
    rows = [(i % 35 if i else None, t, "old", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, `chunk_of` int").repartition(3)
    got = decode(encode(df, step=step, overlap=overlap))
    assert got.columns == ["doc_id", "text", "chunk_of", "ids", "decoded"]
    found = sorted(((r["doc_id"], r["text"], list(r["ids"]), bytes(r["decoded"])) for r in got.collect()), key=repr)
    assert found == sorted(((i, t, lib.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows), key=repr)
    assert encode(df.limit(0), step=step).count() == 0


def test_decode_odd_ids(spark):
    from folioscope.llm.byte_bpe import decode

    df = spark.createDataFrame([(1, None), (2, []), (3, [31373, None, -1, 10**6, 0])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] and bytes(r["decoded"]) for r in decode(df).collect()} == {1: None, 2: b"", 3: b"hello" + "�".encode() * 3 + b"!"}
