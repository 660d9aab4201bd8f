"""Shared pieces: written tables in the cluster's shared folder, packed blocks of text, block exchanges, hashes.

Packed blocks.  ``pack`` writes the texts once as rows of a few MB (``ids``, ``lens``, zstd ``data``) in the
shared folder.  A block is re-read, never re-cut, so every later pass sees the same rows in the same order; a
row is known by (block_id, index), which keeps repeated doc_ids apart.

Scale of an exchange: blocks x buckets messages.  Both sizes follow the corpus between fixed bounds: 10 million messages
at 30 GB, 160 million of 6 kB at 1 TB.  At 100 TB a message holds a few keys and its frame costs about half as much again.

Block exchange.  ``exchange`` deals what each block emits to buckets, reduces every bucket, and ``finish`` brings
each bucket's answer back to the block that asked.  The answers are aligned with what the block emitted, so no
positions travel.  Blocks emit each distinct hash once, which is the map-side combine that keeps hot keys small:
a key has one entry per block at most, however many rows hold it.
"""

from __future__ import annotations

import ctypes
import functools
import os
import secrets
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and most raw text bytes of a block, and of the text behind one bucket of an exchange.  Between them both
#: follow the corpus (``SHARES`` blocks), so that blocks x buckets messages keep a payload worth sending.
BLOCK_BYTES, MAX_BLOCK_BYTES = 4 << 20, 32 << 20
BUCKET_BYTES, MAX_BUCKET_BYTES = 12 << 20, 192 << 20
SHARES = 4096
MIN_BUCKETS = 8
#: Rows of an Arrow batch that go to Python at once; bounds a worker's memory.
ARROW_ROWS = 1000
#: Stands for a null doc_id where ids are compared: no real one is larger.  Which ids are null is kept beside them.
NULL_ID = np.iinfo(np.int64).max
BLOCK_SCHEMA = "block_id long, n long, raw long, ids binary, nulls binary, lens binary, data binary"
SENT = "bucket int, block_id long, payload binary"


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a local session, where all share one machine, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex[:12]}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a written table: cuts the lineage, survives lost executors.  Its shuffle files go once it is written."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def drop(*tables: DataFrame | str) -> None:
    """Deletes tables made by written(), or at a path, once nothing reads them any more."""
    for df in tables:
        spark = SparkSession.active() if isinstance(df, str) else df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df if isinstance(df, str) else df._folio_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a written table dealt by `key` to as many buckets as there are shuffle partitions, so that joins on it move
    the other side only."""
    spark, width = df.sparkSession, shuffle_width(df.sparkSession)
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(width, key).write.option("compression", "uncompressed").bucketBy(width, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: the entry goes, the files and what is known of their buckets stay
    out._folio_path = path
    return out


def pieces(batches, rows: int = ARROW_ROWS):
    """Arrow batches cut to `rows` rows, so that a worker's arrays stay small whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def find_package(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- arrays as bytes


def enc(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd payload, with the bytes of like significance side by side."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = (np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T) if a.dtype.itemsize > 1 else a).tobytes()
        parts += [a.dtype.str[1:].encode().ljust(4), np.uint64(len(raw)).tobytes(), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def dec(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for _ in range(n):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        size = int(np.frombuffer(raw, np.uint64, 1, at + 4)[0])
        body = np.frombuffer(raw, np.uint8, size, at + 12)
        at += 12 + size
        if kind.itemsize > 1:
            planes, body = body.reshape(kind.itemsize, -1), np.empty((size // kind.itemsize, kind.itemsize), np.uint8)
            for k, plane in enumerate(planes):
                body[:, k] = plane
            body = body.reshape(-1).view(kind)
        out.append(body if kind.itemsize > 1 else body.view(kind))
    return out


# ---------------------------------------------------------------- hashes

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public-domain MurmurHash3 constants)."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


#: One random odd 64-bit value per byte value.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Rolling:
    """Rabin-Karp hashes in Z/2^64 from prefix sums: hash(i, j) = sum of x[t] * base^(t - i) for i <= t < j."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        self._grow(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]

    def windows(self, x: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of `width` symbols; empty where x is shorter."""
        if len(x) < width:
            return np.zeros(0, np.uint64)
        p = self.prefix(x)
        return (p[width:] - p[:-width]) * self.down[: len(x) - width + 1]


CHARS = Rolling(0x9E3779B97F4A7C15)
_SPACES = np.ones(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of the words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after lower-casing A-Z).
IN_WORD = _SPACES
IN_TERM = np.zeros(256, bool)
IN_TERM[48:58] = IN_TERM[97:123] = IN_TERM[128:] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = inside[data]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: Words above this many bytes are hashed one by one.
LONG_WORD = 128


def new_key() -> int:
    """A secret of one run: what it hashes, nobody can have made to collide."""
    return secrets.randbits(64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of every word: 8 bytes at a time through the finaliser, so no word structure cancels out.

    With a key from new_key() words that collide can't be known beforehand, and hashes by two keys collide independently.
    Without one, equal hashes only bring words together, and bytes must decide.
    """
    n = ends - starts
    first, times = mix(np.array([key, key ^ 0xA0761D6478BD642F], np.uint64) + _LENGTH)
    times |= np.uint64(1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix((mix(n.astype(np.uint64) * _LENGTH ^ first) ^ (eight[starts] & _KEEP[np.minimum(n, 8)])) * times)
    more, k = np.flatnonzero(n > 8), 8
    while len(more) and k < LONG_WORD:
        h[more] = mix((h[more] ^ (eight[starts[more] + k] & _KEEP[np.minimum(n[more] - k, 8)])) * times)
        k += 8
        more = more[n[more] > k]
    for i in more.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(first))
    return h


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rep: np.ndarray) -> bool:
    """Whether every word has the bytes of the word that stands for it."""
    n, other = ends - starts, starts[rep]
    if not np.array_equal(n, n[rep]):
        return False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    more, k = np.flatnonzero((n > 0) & (starts != other)), 0
    while len(more) and k < LONG_WORD:
        if np.any((eight[starts[more] + k] ^ eight[other[more] + k]) & _KEEP[np.minimum(n[more] - k, 8)]):
            return False
        k += 8
        more = more[n[more] > k]
    return all(np.array_equal(data[starts[i] : ends[i]], data[other[i] : other[i] + n[i]]) for i in more.tolist())


# ---------------------------------------------------------------- packed blocks


class Block:
    """ids, lens and bytes of some documents; each text is followed by one space, which belongs to none."""

    def __init__(self, block_id: int, ids: np.ndarray, no_id: np.ndarray, lens: np.ndarray, data: np.ndarray) -> None:
        self.block_id, self.ids, self.no_id, self.data = block_id, ids, no_id, data
        self.null, self.lens = lens < 0, np.maximum(lens, 0)
        self.offs = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lens + 1, out=self.offs[1:])

    def chunks(self, size: int = 1 << 20):
        """(first doc, last doc + 1) of runs of whole documents of about `size` bytes."""
        at, n = 0, len(self.ids)
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.offs, self.offs[at] + size, "right")) - 1)
            yield at, min(to, n)
            at = to

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.no_id)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i] + self.lens[i]].tobytes()


def pack_bytes(block_id: int, ids: np.ndarray, nulls: np.ndarray, lens: np.ndarray, parts: list[bytes]) -> dict:
    raw = b" ".join(parts) + b" "
    return {"block_id": block_id, "n": len(ids), "raw": len(raw), "ids": ids.tobytes(), "nulls": np.packbits(nulls).tobytes(), "lens": lens.tobytes(), "data": zstandard.ZstdCompressor(level=1).compress(raw)}


_BLOCK_ARROW = pa.schema([("block_id", pa.int64()), ("n", pa.int64()), ("raw", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("data", pa.binary())])


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """ids (null: NULL_ID), which of them are null, lens (null: -1) and texts as bytes of a batch of (doc_id, text)."""
    ids = batch.column(0).cast(pa.int64())
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    lens = np.fromiter((-1 if t is None else len(t) for t in texts), np.int64, len(texts))
    return ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False), nulls, lens, [t or b"" for t in texts]


def _packer(block_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        first, seq = TaskContext.get().partitionId() << 32, 0
        ids, nulls, lens, parts, size = [], [], [], [], 0

        def full():
            return pa.RecordBatch.from_pylist([pack_bytes(first + seq, np.concatenate(ids), np.concatenate(nulls), np.concatenate(lens), parts)], schema=_BLOCK_ARROW)

        for batch in batches:
            i, z, n, t = columns(batch)
            at = 0
            while at < len(i):
                ends = np.cumsum(np.maximum(n[at:], 0) + 1)
                to = at + max(0 if parts else 1, int(np.searchsorted(ends, block_bytes - size, "right")))
                if to > at:
                    ids.append(i[at:to])
                    nulls.append(z[at:to])
                    lens.append(n[at:to])
                    parts += t[at:to]
                    size += int(ends[to - at - 1])
                if to < len(i) or size >= block_bytes:
                    yield full()
                    seq += 1
                    ids, nulls, lens, parts, size = [], [], [], [], 0
                at = to
        if parts:
            yield full()

    return run


def share(total: int, least: int, most: int) -> int:
    return min(max(total // SHARES, least), most)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Writes the documents as packed blocks in the shared folder. Other columns don't travel."""
    find_package(docs.sparkSession)
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if block_bytes is None:
        total = two.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        block_bytes = share(total, BLOCK_BYTES, MAX_BLOCK_BYTES)
    return written(two.mapInArrow(_packer(block_bytes), BLOCK_SCHEMA), "blocks", "uncompressed")


def block_of(row: dict) -> Block:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
    nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=row["n"]).astype(bool)
    return Block(row["block_id"], np.frombuffer(row["ids"], np.int64), nulls, np.frombuffer(row["lens"], np.int64), data)


@functools.lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def trim() -> None:
    """Gives memory that arrays have left back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if (release := _libc()) is not None:
        release(0)


def rows_of(batches):
    """Rows of Arrow batches one at a time, so that one block's arrays live at once."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
    trim()


def n_buckets(blocks: DataFrame) -> int:
    """Buckets follow the size of the corpus, so that a bucket's share stays the same up to SHARES * BUCKET_BYTES of text."""
    total = blocks.agg(F.sum("raw")).first()[0] or 0
    return max(MIN_BUCKETS, -(-total // share(total, BUCKET_BYTES, MAX_BUCKET_BYTES)))


_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("payload", pa.binary())])


def exchange(blocks: DataFrame | None, emit, reduce, more: DataFrame | None = None) -> DataFrame:
    """emit(row) gives (bucket, payload) pairs; reduce(bucket, [(block_id, payload)]) gives (block_id, payload) pairs.

    more: rows (bucket, block_id, payload) that are there already.
    """

    def send(batches):
        for row in rows_of(batches):
            out = list(emit(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([row["block_id"]] * len(out), pa.int64()), pa.array([p for _, p in out], pa.binary())], schema=_SENT_ARROW)

    def gather(key, table):
        bucket = key[0].as_py()
        got = list(zip(table.column("block_id").to_pylist(), table.column("payload").to_pylist(), strict=True))
        out = list(reduce(bucket, got))
        del got
        trim()
        return pa.Table.from_arrays([pa.array([bucket] * len(out), pa.int32()), pa.array([b for b, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], schema=_SENT_ARROW)

    sent = blocks.mapInArrow(send, SENT) if blocks is not None else more
    if blocks is not None and more is not None:
        sent = sent.unionByName(more)
    return sent.groupBy("bucket").applyInArrow(gather, SENT)


def listed(answers: DataFrame, name: str) -> DataFrame:
    """block_id with the list of (bucket, payload) that came back to it; a bucket answers a block once."""
    return answers.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))


def split_sorted(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each bound, bounds) of sorted 64-bit keys, where bucket = floor(key * buckets / 2^64)."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges, "left"), [len(keys)]])


def runs_from(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered_by(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places some window of `width` that begins at one of the starts covers."""
    mark = np.zeros(n, bool)
    mark[starts] = True
    first, last = runs_from(mark)
    step = np.zeros(n + width + 1, np.int32)
    np.add.at(step, first, 1)
    np.subtract.at(step, last - 1 + width, 1)
    return np.cumsum(step[:n], dtype=np.int32) > 0


def group_min(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry the smallest of the values that share its key."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    least = np.minimum.reduceat(values[order], np.flatnonzero(new)) if len(k) else values
    out = np.empty_like(values)
    out[order] = least[np.cumsum(new) - 1] if len(k) else least
    return out
