"""MinHash near-dedup: universal hash minima, banding, signature verification, large-star / small-star components.

1. Every block gives each document its set of shingles (64-bit hashes), the set's 128-bit digest, ``BANDS * ROWS``
   minima of universal hashes, one key per band, and one byte of each minimum.  Documents with one digest are one
   class; from here on classes travel, so copies cost one row.
2. Classes that share a band key are candidates.  A key's hub is its member with the most band mates (ties: by
   digest), so that near copies choose the same hub in most bands.  Members are compared with the hub only.
3. Compared pairs must agree in at least ``SIGNATURE`` of the minima, then in the full sets, rebuilt from whole texts.
4. After components of those links, a key whose members lie in several components is open: its members are joined
   again, now by the shingles of their prefixes.  With the shingles of a set in order of how many open sets hold them, two
   sets of the wanted similarity must share one among the n - ceil(0.8 n) + 1 rarest of either; sizes and places
   in the prefix bound the intersection further (prefix, length and positional filter, all exact).  A pair is thus left out
   only if other links connect it already or its similarity is too low; no task forms all pairs of a group.

With 48 bands of 6 rows a pair of similarity 0.8 shares a key with probability 1 - 5e-7, and its minima agree in 0.68
of 288 or more with probability 1 - 3e-7.

Scale: keys, minima and links shuffle, texts only for candidates, which are fetched from the packed blocks by their place.
Classes have long ids from a written table.  Hubs are aggregated with partial sums; no task holds a key's members.  Joins
on hot keys or hubs are inner joins, which AQE splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import block_of, drop, lower_ascii, mix, new_key, pack, pieces, rows_of, word_hashes, word_spans, written

WIDTH, PERCENT = 2, 80
BANDS, ROWS = 48, 6
SIGNATURE = 0.68
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = (_SEEDS[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[1::2] >> np.uint64(32)).astype(np.uint32)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_OUT = pa.schema([("block_id", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])


def shingles(data: np.ndarray, offs: np.ndarray, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, sorted by document and hash; offs: where documents start, and the end."""
    data = lower_ascii(data)
    starts, ends = word_spans(data)
    words, doc = word_hashes(data, starts, ends, key), np.searchsorted(offs[1:], starts, "right")
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    found, owner = [], []
    for size in range(1, width + 1):  # whole sequences of documents under `width` words, else windows
        n = len(words) - size + 1
        if n <= 0:
            break
        fit = (doc[:n] == doc[size - 1 :]) & ((count[doc[:n]] == size) if size < width else True)
        at = np.flatnonzero(fit)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = mix(h * _STEP + words[at + k])
        found.append(h)
        owner.append(doc[at])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], d[new]


def signatures(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their minima) of sorted shingles."""
    at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    x, out = (h >> np.uint64(32)).astype(np.uint32), np.empty((len(at), len(_A)), np.uint32)
    for k in range(len(_A)):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return d[at], out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is in the key."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * _STEP + minima[:, k::ROWS].astype(np.uint64))
    return key.view(np.int64)


def _sign(width: int, key: int):
    def run(batches):
        for row in rows_of(batches):
            block = block_of(row)
            for a, b in block.chunks():
                offs = block.offs[a : b + 1] - block.offs[a]
                h, d = shingles(block.data[block.offs[a] : block.offs[b]], offs, width, key)
                n = np.bincount(d, minlength=b - a)
                cls, keys, sig = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if len(h):
                    have, minima = signatures(h, d)
                    at = np.concatenate([[0], np.cumsum(n)])[have]
                    one, two = np.add.reduceat(h, at), np.add.reduceat(mix(h ^ _STEP), at)
                    for i, x, y, k, m in zip(have.tolist(), one, two, band_keys(minima), minima.astype(np.uint8), strict=True):
                        cls[i], keys[i], sig[i] = x.tobytes() + y.tobytes() + int(n[i]).to_bytes(4, "big"), k.tolist(), m.tobytes()
                ids = block.id_column().slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block.block_id)), pa.array(np.arange(a, b)), ids, pa.array(n.astype(np.int64)), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=_OUT)

    return run


def _agree(batches):
    """Pairs whose minima agree often enough, from (a, b, a_sig, b_sig)."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= SIGNATURE))


def sets(texts: list[bytes], width: int, key: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    h, d = shingles(np.frombuffer(b" ".join(texts) + b" ", np.uint8), offs, width, key)
    return np.split(h, np.cumsum(np.bincount(d, minlength=len(texts)))[:-1])


def _confirm(width: int, percent: int, key: int):
    def run(batches):
        hub, have = None, None
        for batch in pieces(batches, 16):
            ok = []
            hubs, members = batch.column(3).to_pylist(), sets(batch.column(2).to_pylist(), width, key)
            for text, x in zip(hubs, members, strict=True):
                if text != hub:
                    hub, have = text, sets([text], width, key)[0]
                both = len(np.intersect1d(have, x, assume_unique=True))
                ok.append(100 * both >= percent * (len(have) + len(x) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _spell(width: int, key: int):
    """(cls, root, n, shingle) of (cls, root, text)."""

    def run(batches):
        for batch in pieces(batches, 16):
            found = sets(batch.column(2).to_pylist(), width, key)
            n = np.array([len(x) for x in found], np.int64)
            cols = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n) for k in (0, 1)] + [np.repeat(n, n), np.concatenate(found).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cls", "root", "n", "shingle"])

    return run


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root (the smallest node reachable) of (a, b) links, for the nodes that have links."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, state = written(links, name), None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large, old = written(large, name), links
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(old, large)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text under ``width`` words is one shingle.  Documents
    are linked from ``percent`` of the union on, and the smallest doc_id of a component stays.  Null or empty
    texts have no shingles, are linked with nothing and stay.  A null doc_id never represents real ones; a component
    of null ids alone has a null component_id and all its rows stay.  Rows that repeat a doc_id are linked by
    their texts only.  An empty table gives an empty result; other columns don't take part.
    """
    blocks, key = pack(docs, id_col, text_col), new_key()
    rows = written(blocks.mapInArrow(_sign(width, key), "block_id long, at long, doc_id long, n_shingles long, digest binary, keys array<long>, sig binary"), "minima")
    some = rows.where("digest is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first(F.struct("block_id", "at", "n_shingles", "keys", "sig")).alias("one"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "least", "one.*"), "classes")
    spread = classes.select("cls", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1")
    members = written(spread.join(shared, "key"), "members")
    score = members.groupBy("cls").agg(F.sum("mates").alias("score"))
    rank = F.shiftleft("score", 20).bitwiseOR(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)))
    hubs = written(members.join(score, "cls").groupBy("key").agg(F.max_by("cls", rank).alias("hub")), "hubs")
    sigs = classes.select("cls", "sig")
    texts = _texts(blocks, members.select("cls").distinct().join(classes.select("cls", "block_id", "at"), "cls"))
    drop(blocks)

    def side(table: DataFrame, end: str, column: str) -> DataFrame:
        return table.select(F.col("cls").alias(end), F.col(column).alias(f"{end}_{column}"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b")
        likely = written(pairs.select("a", "b", "a_sig", "b_sig").mapInArrow(_agree, "a long, b long"), name)
        full = likely.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
        out = written(full.select("a", "b", "a_text", "b_text").mapInArrow(_confirm(width, percent, key), "a long, b long"), name)
        drop(likely)
        return out

    first = verified(members.join(hubs, "key").where("cls != hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct(), "links")
    comp = components(first)
    # a pair of one hub and one other member is settled: the rest needs three members at least
    placed = members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    parts = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("all")).where("low != high and all > 2")
    open_ = written(placed.join(parts.select("key"), "key").select("cls", "root").distinct(), "open")
    more = verified(_by_prefix(open_.join(texts, "cls").select("cls", "root", "text"), width, percent, key), "more")
    if not more.isEmpty():
        comp = components(first.unionByName(more))
    roots = classes.select("cls", "digest", "least").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("digest", "least", F.coalesce("root", "cls").alias("root"))
    best = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(roots.join(best, "root").select("digest", "component_id"), "named")
    drop(members, hubs, texts, open_)
    linked = some.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _by_prefix(open_: DataFrame, width: int, percent: int, key: int) -> DataFrame:
    """(a, b) of the (cls, root, text) rows in different components that may have the wanted similarity."""
    words = written(open_.mapInArrow(_spell(width, key), "cls long, root long, n long, shingle long"), "spelled")
    often = words.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one set only come first in every prefix and join with nothing: they count, but don't travel
    common = words.join(often, "shingle")
    place = Window.partitionBy("cls").orderBy("df", "shingle")
    ranked = common.withColumn("nth", F.row_number().over(place)).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("cls")))
    at = F.col("nth") + F.col("n") - F.col("known")  # from 1
    prefix = ranked.withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = written(prefix.select("shingle", "cls", "root", "n", "at"), "prefixes")
    x, y = (prefix.select("shingle", *[F.col(c).alias(f"{e}_{c}") for c in ("cls", "root", "n", "at")]) for e in "xy")
    most = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) + 1
    fits = (F.col("x_cls") < F.col("y_cls")) & (F.col("x_root") != F.col("y_root")) & ((100 + percent) * most >= percent * (F.col("x_n") + F.col("y_n")))
    pairs = x.join(y, "shingle").where(fits).select(F.col("y_cls").alias("a"), F.col("x_cls").alias("b")).distinct()
    return written(pairs, "pairs")


def _texts(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, text (binary) of (cls, block_id, at) rows."""

    def run(batches):
        for row in rows_of(batches):
            block, want = block_of(row), row["want"]
            for k in range(0, len(want), 100):
                part = want[k : k + 100]
                yield pa.RecordBatch.from_arrays([pa.array([w["cls"] for w in part], pa.int64()), pa.array([block.text(w["at"]) for w in part], pa.binary())], names=["cls", "text"])

    # a block's documents bound its list
    lists = wanted.groupBy("block_id").agg(F.collect_list(F.struct("cls", "at")).alias("want"))
    return written(blocks.join(lists, "block_id").mapInArrow(run, "cls long, text binary"), "texts", "zstd")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: per component one row of the smallest doc_id.

    Rows that repeat the doc_id that stays are one document and stay together; rows without doc_id stay.
    """
    gone = near_groups(docs, id_col, text_col, width, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
