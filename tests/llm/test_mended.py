"""Odd blocks, colliding words and contexts, many shards in one task, and repeated words."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("odd", [("", True), ("zzz", True), ("zz a yy", True), ("zzz", False)], ids=str)
def test_lm_score_odd_block(spark, depth, odd):
    """A block of one short document scores as it does beside others."""
    from folioscope.llm.lm_score import score

    rng = random.Random(depth)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(60)), i % 7 == 2) for i in range(20)] + [(99, *odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    apart = df.where("doc_id < 99").coalesce(1).unionByName(df.where("doc_id = 99").coalesce(1))
    table = lambda x: {r["doc_id"]: tuple(r)[1:] for r in score(x, depth=depth).collect()}
    got, want = table(apart), table(df.coalesce(1))
    assert got.keys() == want.keys() and len(got) == 21
    for i, x in want.items():
        assert got[i][:4] == x[:4] and all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(got[i][4:], x[4:], strict=True))


def colliding():
    """Words of 16 bytes whose hashes without a key are equal."""
    from folioscope.llm.common import _LENGTH, mix

    first, times = mix(np.array([0, 0xA0761D6478BD642F], np.uint64) + _LENGTH)
    times |= np.uint64(1)
    after = lambda w: mix((mix(np.array([16], np.uint64) * _LENGTH ^ first) ^ w) * times)
    a, b = (np.frombuffer(x, "<u8") for x in (b"internat", b"overtone"))
    end = np.frombuffer(b"ionaliza", "<u8")
    return a.tobytes() + end.tobytes(), b.tobytes() + (after(a) ^ after(b) ^ end).tobytes()


def test_keyed_hashes():
    """Words made to collide don't under a secret key, nor under two keys at once."""
    from folioscope.llm.common import new_key, word_hashes

    x, y = colliding()
    data = np.frombuffer(x + y, np.uint8)
    h = lambda key: word_hashes(data, np.array([0, 16]), np.array([16, 32]), key)
    assert x != y and h(0)[0] == h(0)[1]
    keys = [new_key() for _ in range(50)]
    assert len(set(keys)) == 50 and all(h(k)[0] != h(k)[1] for k in keys) and len({int(h(k)[0]) for k in keys}) == 50


def first_key_collides(n: int):
    """In place of word_hashes: everything is equal until `n` calls have been made with one key or another."""
    from folioscope.llm.common import word_hashes

    def hashes(data, starts, ends, key=0):
        return np.full(len(starts), 7, np.uint64) if key < n else word_hashes(data, starts, ends, key)

    return hashes


def test_equal_contexts_end(monkeypatch):
    """Contexts of one anchor and one hash are hashed anew by another key until all that are equal are so by bytes."""
    from folioscope.llm import suffix_dedup as s
    from folioscope.llm.common import Block, enc

    rng = random.Random(1)
    texts = [bytes(rng.choices(range(97, 123), k=50)) for _ in range(4)]
    texts.append(texts[0])
    ids, lens = np.arange(5), np.full(5, 50)
    block = Block(0, ids, np.zeros(5, bool), lens, np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    monkeypatch.setattr(s, "word_hashes", first_key_collides(3))
    runs = s.Runs(block)
    runs.anchor[:] = 5
    reps, slot = runs.contexts()
    same = lambda i, j: runs.block.data[runs.first[i] : runs.last[i] + 50].tobytes() == runs.block.data[runs.first[j] : runs.last[j] + 50].tobytes()
    assert all(same(i, reps[slot[i]]) for i in range(len(slot))) and len(reps) < len(slot)
    sent = enc(np.array([9, 0, 0], np.uint64), np.array([3, 1, 2]), np.array([50, 50, 50], np.uint8), np.frombuffer(texts[0] + texts[1] + texts[0], np.uint8))
    rep = s._contexts_of([(0, sent)])[6]
    assert rep.tolist() == [2, 1, 2]


def test_many_shards_in_a_task(spark, tmp_path):
    """More files of one task than three digits number."""
    from folioscope.llm.token_output import token_output

    n = 1003
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = token_output(df, str(tmp_path / "t"), shard_bytes=1).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    start = 0
    for i, r in enumerate(rows):
        assert (r["doc_id"], r["start"]) == (i, start)
        start += r["n_tokens"]
    assert len(rows) == n and len({r["file"] for r in rows}) == n


def test_shards_of_a_job_whose_id_looks_like_a_number(spark, tmp_path, monkeypatch):
    """Files are in order whatever the id of the job that wrote them."""
    from folioscope.llm import token_output as t

    def named(docs, path, write=t.write_tokens, **kw):
        write(docs, path, **kw)
        for f in list((tmp_path / "t").iterdir()):
            f.rename(f.with_name(re.sub(r"-[0-9a-f-]{36}-", "-c6c093ad-c043-43ea-91b1-c152d8d9673f-", f.name)))

    monkeypatch.setattr(t, "write_tokens", named)
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    rows = sorted(map(tuple, t.token_output(df.coalesce(1), str(tmp_path / "t"), shard_bytes=1).select("doc_id", "start", "n_tokens", "file").collect()))
    assert all(r[3].startswith("part-") and "-c6c093ad-" in r[3] for r in rows) and len({r[3] for r in rows}) == 60
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:k]) for k in range(60)]


def test_repeated_words_take_little_memory():
    """Places times windows are worked through, not kept."""
    from folioscope.llm.decontaminate import Bench, _hit_words

    n, m = 20_000, 600
    bench = Bench([("z", "0 " * m), ("y", "0 1 " * 40)], 13)
    tracemalloc.start()
    counts, found = bench.matches([b"0 " * n, b"0 " * 12, b"1 0 " * 30], 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and counts.tolist() == [n, 12, 60]
    assert _hit_words(n, found[0]) == n and {m_["item_id"] for m_ in found[0]} == {"z"} and max(m_["words"] for m_ in found[0]) == m
    assert len(found[0]) == (n - 12) + (m - 12) - 1 and not found[1] and _hit_words(60, found[2]) == 60


def test_no_table_stays(spark):
    """Scoring leaves nothing in the catalog."""
    from folioscope.llm.lm_score import score

    before = {t.name for t in spark.catalog.listTables()}
    df = spark.createDataFrame([(1, "a b a b a b", False), (2, "a b", True)], "doc_id long, text string, held_out boolean")
    assert score(df).count() == 2 and {t.name for t in spark.catalog.listTables()} == before
