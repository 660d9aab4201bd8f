"""Byte-level BPE: overlapping chunks cut to pre-tokens in parallel, stitched where their boundaries agree, then encoded.

1. A text is cut to chunks of ``STEP`` bytes that reach ``OVERLAP`` bytes into their successor.  Each chunk is cut to
   pre-tokens on its own, by whichever task has it.  The pattern never looks back, so once two chunks have one boundary in
   common they agree from there on; a chunk owns the pre-tokens from its boundary in common with the chunk before to that
   with the chunk after.  Boundaries near a chunk's end that later text could move don't count.
2. Where two chunks don't meet within the overlap (one long pre-token), that text is cut again with both sizes eight times as large,
   until they do or the text is one chunk.
3. Each chunk's own pre-tokens are encoded, and a text's ids are its chunks' in order.  A text of one chunk has nothing to stitch
   and never leaves its task; only longer ones are written, dealt by chunk, and put together again.

Pre-tokens are found in numpy over bytes with one class per code point (letter, number, space, other), taken from the
library's own pattern engine.  Equal pre-tokens are told by hash, checked byte by byte, and encoded once per worker.
Decoding concatenates the ids' bytes.

Scale: one pass over short texts without a shuffle; longer ones cost one write and one shuffle of their chunks.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import drop, find_package, pieces, same_words, shuffle_width, trim, word_hashes, written
from folioscope.llm.token_output import Growing

STEP, OVERLAP, GROWTH = 64 << 10, 4 << 10, 8
#: Text that is cut to pre-tokens at once, and pre-tokens a worker remembers; change speed only.
CUT_BYTES, CACHE_PIECES = 1 << 20, 400_000
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Bytes that stand for an id outside the vocabulary, or a null one.
UNKNOWN = "�".encode()
_APOSTROPHE = 39
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")  # what may follow an apostrophe as one pre-token


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the library's patterns have it."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), "<u4")] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        first, more = data[lead].astype(np.int64), [(padded[lead + k] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
        two, three = first < 0xE0, first < 0xF0
        point = np.where(two, (first & 0x1F) << 6 | more[0], np.where(three, (first & 0xF) << 12 | more[0] << 6 | more[1], (first & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        for k, has in ((1, slice(None)), (2, ~two), (3, ~three)):
            at = lead[has] + k
            fits = at < len(out)
            out[at[fits]] = kind[has][fits]
    return out


def boundaries(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where a pre-token begins; edges: places around texts, whose bytes belong to none and count as boundaries."""
    kind = byte_classes(data)
    kind[edges] = EDGE
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = change.copy()
    after = np.flatnonzero(change[1:] & (kind[:-1] == SPACE) & (kind[1:] != EDGE)) + 1  # what follows white space
    last = after - 1
    for _ in range(2):  # its last character, of three bytes at most
        last -= (data[last] & 0xC0) == 0x80
    begin[last] = True
    begin[after[data[last] == 32]] = False
    mark = np.flatnonzero(data == _APOSTROPHE)
    mark = mark[begin[mark] & change[mark]]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one, two = data[mark + 1], data[mark + 2]  # an edge at the latest
        size = np.isin(one, list(_ONE)).astype(np.int64)
        for x in _TWO:
            size[(one == x[0]) & (two == x[1])] = 2
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        begin[mark + 1 + size] = True  # also true where the letters end
    begin[edges] = True
    return begin


class Coder:
    """Ids of pre-tokens, each encoded by the library once and then remembered."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.ranks = read_ranks(path)
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.keep()

    def keep(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool, self.at, self.size = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def learn(self, keys: list[bytes]) -> None:
        ids = [[r] if (r := self.ranks.get(k)) is not None else self.bpe.encode_single_piece(k) for k in keys]
        size = np.array([len(x) for x in ids], np.int64)
        first = len(self.slots)
        self.slots.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.at.extend(self.pool.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.pool.extend(np.array([i for x in ids for i in x], np.int32))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each pre-token, and all ids."""
        if len(self.slots) > CACHE_PIECES:
            self.keep()
        h = word_hashes(data, starts, ends)
        order = np.argsort(h)
        k = h[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        rep, slot = order[new], np.empty(len(h), np.int64)
        slot[order] = np.cumsum(new) - 1
        if not same_words(data, starts, ends, rep[slot]):
            rep = slot = np.arange(len(h))
        raw = data.tobytes()
        keys = list(map(raw.__getitem__, map(slice, starts[rep].tolist(), ends[rep].tolist())))
        if missing := [k for k in dict.fromkeys(keys) if k not in self.slots]:
            self.learn(missing)
        piece = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))[slot]
        size = self.size[piece]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[piece] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        return size, ids

    def texts(self, texts: list[bytes]) -> pa.ListArray:
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
        starts = np.flatnonzero(boundaries(data, edges))
        ends, text = np.append(starts[1:], len(data)), np.searchsorted(edges, starts, "right") - 1
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, edges)] = False
        size, ids = self.encode(data, starts[real], ends[real])
        n = np.bincount(text[real], size, len(texts)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per worker process."""
    return Coder(path)


def _whole(path: str, text_at: int):
    """Texts of one chunk each."""

    def run(batches):
        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            size = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, size[at] + CUT_BYTES, "right")) - 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, coder(path).texts(texts[at:to])], names=[*batch.schema.names, "ids"])
                at = to
        trim()

    return run


def chunk_starts(text: bytes, step: int) -> list[int]:
    """First byte of every chunk: a character's first byte at or before each multiple of step."""
    out = []
    for at in range(0, len(text), step):
        while at and text[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return out


def _chunks(step: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = chunk_starts(text, step)
                for k, at in enumerate(starts):
                    last = k + 1 == len(starts)
                    end = len(text) if last else min(len(text), starts[k + 1] + overlap)
                    yield pa.RecordBatch.from_pylist([{"chunk_of": key, "k": k, "at": at, "next": len(text) if last else starts[k + 1], "last": last or end == len(text), "data": text[at:end]}], schema=_CHUNK)

    return run


_CHUNK = pa.schema([("chunk_of", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("last", pa.bool_()), ("data", pa.binary())])
CHUNK = "chunk_of long, k long, at long, next long, last boolean, data binary"


def _begins(data: bytes) -> np.ndarray:
    """First bytes of pre-tokens of data, one place further on (after the edge)."""
    x = np.frombuffer(b"\0" + data + b"\0", np.uint8)
    return np.flatnonzero(boundaries(x, np.array([0, len(x) - 1])))[1:-1] - 1


def sure(data: bytes, last: bool) -> np.ndarray:
    """The boundaries that text after the chunk can't move: not its last three bytes, nor inside white space at its end."""
    begin = _begins(data)
    if last:
        return begin
    x = np.frombuffer(data, np.uint8)
    solid = np.flatnonzero(byte_classes(x) != SPACE)
    return begin[begin <= min(len(x) - 4, int(solid[-1]) + 1 if len(solid) else 0)]


def _seams(overlap: int):
    """Boundaries in the zones that a chunk shares with the one before (head) and the one after (tail), as places in the text."""

    def run(batches):
        for batch in batches:
            for c in batch.to_pylist():
                begin = sure(c["data"], c["last"]) + c["at"]
                head, tail = begin[begin <= c["at"] + overlap], begin[begin >= c["next"]]
                yield pa.RecordBatch.from_arrays([pa.array([c["chunk_of"]]), pa.array([c["k"]]), pa.array([head.tolist()], pa.list_(pa.int64())), pa.array([tail.tolist()], pa.list_(pa.int64()))], names=["chunk_of", "k", "head", "tail"])

    return run


def _own(path: str):
    """Ids of the pre-tokens from `since` to `upto` of each chunk."""

    def run(batches):
        for batch in batches:
            for c in batch.to_pylist():
                part = c["data"][c["since"] - c["at"] :]
                begin = np.append(_begins(part), len(part))
                n = int(np.searchsorted(begin, c["upto"] - c["since"]))
                _, ids = coder(path).encode(np.frombuffer(part, np.uint8), begin[:n], begin[1 : n + 1])
                yield pa.RecordBatch.from_arrays([pa.array([c["chunk_of"]]), pa.array([c["k"]]), pa.array([ids.tolist()], pa.list_(pa.int32()))], names=["chunk_of", "k", "ids"])
        trim()

    return run


def _stitched(long: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """chunk_of and ids of the texts (chunk_of, data)."""
    width, done = shuffle_width(long.sparkSession), None
    while True:
        cut = long.select("chunk_of", "data").mapInArrow(_chunks(step, overlap), CHUNK).repartition(width, "chunk_of", "k")
        seams = written(cut.mapInArrow(_seams(overlap), "chunk_of long, k long, head array<long>, tail array<long>"), "seams")
        heads = seams.select("chunk_of", (F.col("k") - 1).alias("k"), "head")
        met = seams.select("chunk_of", "k", "tail").join(heads, ["chunk_of", "k"]).select("chunk_of", "k", F.array_min(F.array_intersect("tail", "head")).alias("met"))
        met = written(met, "met")
        open_ = met.where("met is null").select("chunk_of").distinct()
        ends = met.select("chunk_of", "k", F.col("met").alias("ends"))
        begins = met.select("chunk_of", (F.col("k") + 1).alias("k"), F.col("met").alias("begins"))
        owned = cut.join(open_, "chunk_of", "left_anti").join(ends, ["chunk_of", "k"], "left").join(begins, ["chunk_of", "k"], "left")
        owned = owned.withColumns({"since": F.coalesce("begins", F.lit(0)), "upto": F.coalesce("ends", F.col("next"))}).drop("begins", "ends")
        ids = owned.mapInArrow(_own(path), "chunk_of long, k long, ids array<int>").groupBy("chunk_of").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        ids = ids.select("chunk_of", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
        done = ids if done is None else done.unionByName(ids)
        if open_.isEmpty():
            return done
        long = written(long.join(open_, "chunk_of", "left_semi"), "open-texts")
        step, overlap = step * GROWTH, overlap * GROWTH


def encode(docs: DataFrame, text_col: str = "text", ranks: str | None = None, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """docs with the column ids: array<int> of the ids of each whole text, without special tokens.

    Null and empty texts have no ids.  Rows that repeat stay; a column of docs named ids is replaced, other columns are
    kept as they are.  An empty table gives an empty result.  ``overlap`` is at most ``step``.
    """
    find_package(docs.sparkSession)
    path = ranks or ranks_path()
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "ids"])
    size = F.octet_length(F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = base.where(F.coalesce(size, F.lit(0)) <= step).mapInArrow(_whole(path, base.columns.index(text_col)), schema)
    key = "chunk_of"
    while key in base.columns:
        key += "_"
    long = written(base.where(size > step).withColumn(key, F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        drop(long)
        return out
    texts = long.select(F.col(key).alias("chunk_of"), F.col(f"`{text_col}`").cast("binary").alias("data"))
    ids = _stitched(texts, path, step, min(overlap, step)).withColumnRenamed("chunk_of", key)
    return out.unionByName(long.join(ids, key, "left").drop(key))


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """docs with the column out_col: the bytes of each row's ids, one after another.

    Null ids give null, no ids no bytes; an id outside the vocabulary or null within the array gives U+FFFD's bytes.  A column
    of docs named out_col is replaced.
    """
    find_package(docs.sparkSession)
    path = ranks or ranks_path()
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col])
    at = base.columns.index(ids_col)

    def run(batches):
        data, first, size = token_bytes(path)
        for batch in pieces(batches):
            column, out = batch.column(at), []
            for i in range(batch.num_rows):
                if not column[i].is_valid:
                    out.append(None)
                    continue
                x = column[i].values.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                x = np.where((x < 0) | (x >= len(size) - 1), len(size) - 1, x)
                n = size[x]
                upto = np.cumsum(n)
                out.append(data[np.repeat(first[x] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])
        trim()

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out_col, T.BinaryType())]))


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids' bytes, and where each id's begin and how many they are; the last entry stands for unknown ids."""
    ranks = read_ranks(path)
    table = [UNKNOWN] * (max(ranks.values()) + 2)
    for token, rank in ranks.items():
        table[rank] = token
    size = np.array([len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size
