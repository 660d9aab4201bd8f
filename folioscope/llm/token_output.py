"""Token-ID output: one zstandard frame per document, a document index and a trailing seek table with checksums.

File format (one shard per file, documents in ascending doc_id order):

    frame 0 .. n-1   ids of one document as little-endian unsigned 32-bit integers, an independent zstd frame
    frame n          the doc_ids of the shard as little-endian signed 64-bit integers, then one byte each, 1 where the
                     doc_id is null; an independent zstd frame
    skippable frame  zstd seekable-format seek table: per frame compressed size, decompressed size and the low 32
                     bits of the XXH64 of the decompressed bytes; then number of frames, descriptor, magic number

A reader takes the last 9 bytes, then the table, then the index frame, then the frames it wants: four range reads
for one document.  ``token_output`` leaves the first and last doc_id of every file in ``_ranges`` beside the files, so that
``fetch`` opens only the files that can hold what it looks for.  Shards are written by Spark's own text writer, one row per file: the row is the shard up to the
seek table's magic number, and that number is the writer's line separator.  So files go to any file system that
Spark reaches, with its commit protocol, and no task writes beside it.

Scale: one range shuffle of texts by doc_id; a worker holds one shard (``SHARD_BYTES`` of compressed ids).
"""

from __future__ import annotations

import functools
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, find_package, new_path, same_words, shuffle_width, word_hashes, written

SHARD_BYTES = 16 << 20
RANGES = "_ranges"
#: Pieces a worker remembers before it forgets those it has met only once; changes speed only.
CACHE_PIECES = 400_000
#: Text that is cut to pieces at once.
ENCODE_BYTES = 1 << 20
#: zstd seekable format: skippable-frame magic, seekable magic, descriptor with the checksum flag.
SKIP_MAGIC, SEEK_MAGIC, SEEK_FLAGS = 0x184D2A5E, 0x8F92EAB1, 0x80
_LETTERS, _PUNCTUATION = (np.isin(np.arange(256), list(x.encode())) for x in (string.ascii_letters, string.punctuation))
_TAIL = struct.pack("<I", SEEK_MAGIC)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts with the tokenizers library, as little-endian bytes.

    The tokenizer's pre-tokens never reach over the border before a single space between two non-spaces, around a
    newline between two of them, or from a letter to punctuation, so texts split there.  Pieces are found, hashed and told
    apart in numpy (equal hashes are checked byte by byte), and each is encoded once per worker; new ones that begin with
    the space go to the library in one call, and each begins with a token that begins with the space.  Texts with
    other spacing are encoded whole, and so are those that hold an added token's content (``<|endoftext|>``), which the
    library reads as that token wherever it stands.
    """

    def __init__(self, path: str) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tk.get_added_tokens_decoder().values()]
        vocab = self.tk.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.ends = re.compile(r"^[\s\u180e]|[\s\u180e]$")
        self.keep({}, np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def keep(self, slots: dict[bytes, int], size: np.ndarray, ids: np.ndarray) -> None:
        """slots: number of each known piece; its ids are pool[at : at + size], size -1 where it can't stand alone."""
        self.slots = slots
        self.pool, self.at, self.size, self.used = Growing(np.uint32), Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.add(size, ids)

    def add(self, size: np.ndarray, ids: np.ndarray) -> None:
        real = np.maximum(size, 0)
        self.at.extend(self.pool.n + np.cumsum(real) - real)
        self.pool.extend(ids)
        self.size.extend(size)
        self.used.extend(np.zeros(len(size), np.int64))

    def gather(self, piece: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.at[piece] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def forget(self) -> None:
        """Drops the pieces that came up once only."""
        often = (self.used.data > 1).tolist()
        stay = [(k, i) for k, i in self.slots.items() if often[i]]
        old = np.array([i for _, i in stay], np.int64)
        size = self.size[old]
        self.keep({k: i for i, (k, _) in enumerate(stay)}, size, self.gather(old, np.maximum(size, 0)))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, keys: list[bytes]) -> None:
        """Ids of new pieces, in groups: what can't stand alone, what has no space before it, what has."""
        bad, plain, spaced, odd = [], [], [], self.ends.search
        for k in keys:
            if k[0] == 32:
                (bad if len(k) == 1 or odd(k[1:].decode()) else spaced).append(k)
            else:
                (bad if k != b"\n" and odd(k.decode()) else plain).append(k)
        found = [(bad, np.full(len(bad), -1, np.int64), np.zeros(0, np.uint32))]
        ids = [e.ids for e in self.tk.encode_batch_fast([k.decode() for k in plain], add_special_tokens=False)]
        found.append((plain, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32)))
        for k in range(0, len(spaced), 4096):
            part = spaced[k : k + 4096]
            ids = np.array(self.tk.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(cuts) != len(part) + 1:
                each = [self.whole(p.decode()) for p in part]
                ids, cuts = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
            found.append((part, np.diff(cuts), ids))
        for part, size, ids in found:
            first = len(self.slots)
            self.slots.update(zip(part, range(first, first + len(part)), strict=True))
            self.add(size, ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8)."""
        if len(self.slots) > CACHE_PIECES:
            self.forget()
        stops = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
        mark = np.zeros(len(data), bool)  # the zeros around texts
        mark[stops] = True
        line = data == 10
        begin = (data == 32) | line | mark
        begin[1:] |= mark[:-1] | line[:-1] | (_LETTERS[data[:-1]] & _PUNCTUATION[data[1:]])
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        mark, byte = mark[starts], data[starts]
        # a newline before a space or newline is a token of its own; two of them, or one at the end, may be one token
        after = np.append((byte == 32) | (byte == 10) | mark, True)[1:]
        bare = (byte == 10) & ~mark & after
        odd = bare & np.append(bare | mark, True)[1:]
        text = np.searchsorted(stops, starts, "right") - 1
        odd = np.bincount(text[odd], minlength=len(texts))[: len(texts)] > 0
        real = np.flatnonzero(~mark)
        starts, ends, text = starts[real], ends[real], text[real]
        h = word_hashes(data, starts, ends)
        order = np.argsort(h)
        k = h[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        rep, slot = order[new], np.empty(len(h), np.int64)
        slot[order] = np.cumsum(new) - 1
        if not same_words(data, starts, ends, rep[slot]):
            return [self.whole(t.decode()).astype("<u4").tobytes() for t in texts]
        raw = data.tobytes()
        keys = list(map(raw.__getitem__, map(slice, starts[rep].tolist(), ends[rep].tolist())))
        if missing := [k for k in keys if k not in self.slots]:
            self.learn(missing)
        mine = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        self.used[mine] += np.bincount(slot, minlength=len(keys))
        piece = mine[slot]
        size = self.size[piece]
        odd |= np.bincount(text[size < 0], minlength=len(texts)) > 0
        for a in self.added:
            if a in raw:
                odd |= [a in t for t in texts]
        size[odd[text]] = 0
        ids = self.gather(piece, size).astype("<u4").tobytes()
        cuts = 4 * np.concatenate([[0], np.cumsum(np.bincount(text, size, len(texts)).astype(np.int64))])
        return [self.whole(t.decode()).astype("<u4").tobytes() if o else ids[a:b] for t, o, a, b in zip(texts, odd.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.n, self.data = 0, np.zeros(1 << 12, kind)

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + len(x), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def __getitem__(self, k):
        return self.data[k]

    def __setitem__(self, k, x) -> None:
        self.data[k] = x


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Encoder:
    """One per worker process: what a task has learned serves the next ones."""
    return Encoder(path)


def shard(ids: list[int | None], docs: list[bytes]) -> bytes:
    """A shard's bytes without the last four, which are the seekable magic number."""
    zstd, out, table = zstandard.ZstdCompressor(level=1, write_content_size=True), [], []
    index = np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes() + bytes(i is None for i in ids)
    for raw in [*docs, index]:
        frame = zstd.compress(raw)
        out.append(frame)
        table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
    body = b"".join(table)
    return b"".join(out) + struct.pack("<II", SKIP_MAGIC, len(body) + 9) + body + struct.pack("<IB", len(table), SEEK_FLAGS)


class Shard:
    """Reads a shard through ``read(offset, size)`` and decompresses only what is asked for."""

    def __init__(self, read, size: int) -> None:
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.read, self.table = read, np.frombuffer(read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        index, n = self.frame(n - 1), n - 1
        self.ids, self.no_id = np.frombuffer(index, "<i8", n), np.frombuffer(index, bool, n, 8 * n)

    @classmethod
    def of(cls, raw: bytes) -> Shard:
        return cls(lambda at, n: raw[at : at + n], len(raw))

    def frame(self, k: int) -> bytes:
        size, full, check = map(int, self.table[k])
        raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.at[k]), size), max_output_size=full)
        if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def document(self, doc_id: int) -> np.ndarray:
        k = int(np.searchsorted(self.ids, doc_id))
        if k == len(self.ids) or self.ids[k] != doc_id or self.no_id[k]:
            raise KeyError(doc_id)
        return np.frombuffer(self.frame(k), "<u4")


def _parts(texts: list[bytes]):
    """(first, end) of runs of texts of about ENCODE_BYTES."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= ENCODE_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _writer(path: str, end_id: int, shard_bytes: int):
    def run(batches):
        encode, end = coder(path).encode, np.array([end_id], "<u4").tobytes()
        ids, docs, size = [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([shard(ids, docs)], pa.binary())], names=["shard"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _parts(texts):
                for key, raw in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids.append(key)
                    docs.append(raw + end)
                    size += len(raw) // 2
                    if size >= shard_bytes:
                        yield full()
                        ids, docs, size = [], [], 0
        if ids:
            yield full()

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes all documents' ids, each with end_id after it, as shards in ascending doc_id order.

    Null text is empty: the document is the end id alone.  Rows that repeat a doc_id are documents of their own,
    ordered by text.  A null doc_id comes last and reads back as null.  An empty table gives no shard.
    """
    find_package(docs.sparkSession)
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = two.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    rows = dealt.mapInArrow(_writer(tokenizer or tokenizer_path(), end_id, shard_bytes), "shard binary")
    rows.select(F.col("shard").cast("string").alias("value")).write.option("lineSep", _TAIL.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read_index(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """One row per document: file, at (place in the file), doc_id, n_tokens, ids_crc32; all frames are verified."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                s = Shard.of(raw)
                n = len(s.ids)
                crc = [zlib.crc32(s.frame(i)) if digest else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(s.ids, mask=s.no_id), pa.array((s.table[:n, 1] // 4).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "at", "doc_id", "n_tokens", "ids_crc32"])

    find_package(spark)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, at long, doc_id long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents; only files whose range can hold them are read, only their frames decompressed."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                s = Shard.of(batch.column(1)[k].as_py())
                hit = np.flatnonzero(np.isin(s.ids, doc_ids) & ~s.no_id)
                if len(hit):
                    yield pa.RecordBatch.from_pylist([{"doc_id": int(s.ids[i]), "ids": np.frombuffer(s.frame(i), "<u4").astype(np.int64).tolist()} for i in hit], schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    find_package(spark)
    ranges, paths = f"{path}/{RANGES}", path
    if _exists(spark, ranges):
        want = spark.createDataFrame([(i,) for i in doc_ids], "want long")
        found = spark.read.parquet(ranges).join(want, (F.col("want") >= F.col("low")) & (F.col("want") <= F.col("high"))).select("file").distinct()
        paths = [f"{path}/{r['file']}" for r in found.collect()]  # at most a few files per wanted document
    if not paths:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "doc_id long, ids array<long>")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_output(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Writes the documents, reads the files back, and gives doc_id, start, n_tokens, ids_crc32, file, at.

    start: ids of all documents before it.  Sums are added up over the ranges of the shuffle (a row each), over the files
    of a range in the order they were written, then within each file, so no task sees more than one shard's documents.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, **kw)
    index = written(read_index(spark, path), "index")  # small, and the files are then decoded once
    index.groupBy("file").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).write.parquet(f"{path}/{RANGES}")
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", number(r"^part-(\d+)").alias("task"), number(r"-c(\d+)\.[^-]*$").alias("nth"))  # the job's id in between may hold -c1, too
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tasks = files.groupBy("task").agg(F.sum("n").alias("all"))  # a row per range of the shuffle
    tasks = tasks.select("task", (F.sum("all").over(upto(Window.orderBy("task"))) - F.col("all")).alias("ahead"))
    files = files.join(tasks, "task").select("file", (F.col("ahead") + F.sum("n").over(upto(Window.partitionBy("task").orderBy("nth"))) - F.col("n")).alias("base"))
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = index.join(files, "file").withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "at")
