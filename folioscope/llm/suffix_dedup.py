"""Dedup of repeated bytes: a sieve by anchors, then a logarithmic family of sorted windows for those it can't settle.

1. Sieve.  Of the ``K``-byte strings in each window of ``WIDTH`` bytes the one with the least hash is the window's
   anchor; equal windows have equal anchors.  Blocks send their distinct anchors, buckets answer which ones another
   block has too.  Windows whose anchor only one document has cannot repeat and go no further.
2. Family.  The other windows travel as contexts (the bytes of a run of windows with one anchor), each distinct
   context once per block with the smallest doc_id that holds it, to the bucket of their anchor.  There documents come
   in doc_id order in batches.  A batch gets its windows in byte order, is merge-scanned against
   every level of the family for full-length matches, and becomes a level; levels of like size merge, so there are
   as many levels as the logarithm of the batches.  The answer is one bit per window: a smaller document has it.
3. Blocks mark those windows and merge them to maximal spans of bytes.

``SuffixIndex`` keeps levels as Parquet tables of contexts for batches that come one after another: a new batch is
matched against all levels and itself, becomes a level, and levels of one size merge.  It has no sieve, as any anchor
may come up again.  ``suffix_dedup`` is the case of one batch that no other follows.

Equal contexts settle most copies; they are found by 64-bit hashes and compared byte by byte, and hashed anew by another key as long
as any two with one hash differ.  Windows are compared by their bytes.
The suffixes are those at anchors, to the depth of a window, not at every byte.  Scale: texts are packed once; anchors are
about one in 13 bytes and cost about 6 bytes each in the shuffle; contexts travel only for passages in two documents at
least, to buckets that have room for six bytes of context per byte of text.  An anchor that more than ``HOT_BLOCKS``
blocks have is hot: its windows part by the ``SIDE`` bytes before or after it, whichever they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import (
    BYTE,
    CHARS,
    NULL_ID,
    Block,
    block_of,
    covered_by,
    dec,
    enc,
    drop,
    exchange,
    find_package,
    listed,
    mix,
    n_buckets,
    new_path,
    pack,
    rows_of,
    runs_from,
    same_words,
    split_sorted,
    word_hashes,
    written,
)

WIDTH, K = 50, 25
SPAN = WIDTH - K + 1
#: Windows of one batch of the family.
BATCH = 1 << 15
#: Buckets of contexts for each of anchors; blocks that make an anchor hot; bytes beside it that part its windows.
SPREAD, HOT_BLOCKS, SIDE = 6, 1024, (SPAN - 1) // 2
#: Stands for the documents of earlier batches: smaller than all others.
EARLIER = np.iinfo(np.int64).min
_LEVEL = -1  # stands for no block: contexts of a level
_INDEX = np.uint64((1 << 30) - 1)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    n, have = x, 1
    while 2 * have <= width:
        n = np.minimum(n[:-have], n[have:])
        have *= 2
    return n if have == width else np.minimum(n[: len(x) - width + 1], n[width - have : width - have + len(x) - width + 1])


class Runs:
    """Runs of windows with one anchor in a block: anchor hash and place, first and last window, document."""

    def __init__(self, block: Block) -> None:
        self.block = block
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in block.chunks():
            base = block.offs[a]
            data = block.data[base : block.offs[b]]
            fit = np.flatnonzero(block.lens[a:b] >= WIDTH) + a
            if not len(fit):
                continue
            prefix = CHARS.prefix(BYTE[data])
            h = mix((prefix[K:] - prefix[:-K]) * CHARS.down[: len(data) - K + 1])
            least = sliding_min((h & ~_INDEX) | np.arange(len(h), dtype=np.uint64), SPAN)
            step = np.zeros(len(data) + 1, np.int8)
            step[block.offs[fit] - base] = 1
            step[block.offs[fit] - base + block.lens[fit] - WIDTH + 1] -= 1
            at = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
            anchor = (least[at] & _INDEX).astype(np.int64)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
            first = at[new]
            last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            doc = np.searchsorted(block.offs[a + 1 : b + 1] - base, first, "right") + a
            for c, x in zip(cols, (h[anchor[new]], anchor[new] + base, first + base, last + base, doc), strict=True):
                c.append(x)
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
        self.anchor, self.place, self.first, self.last, self.doc = (np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds, strict=True))
        self.ids = block.ids[self.doc]
        self.keys, self.slot = np.unique(self.anchor, return_inverse=True)

    def only(self, on: np.ndarray, hot: np.ndarray) -> None:
        """Keeps the runs of the anchors in `on`; those of hot ones become two, by which side of the anchor they hold."""
        stay = np.flatnonzero(on[self.slot])
        far = hot[self.slot[stay]]
        near, far = stay[~far], stay[far]
        parts = [(self.anchor[near], near, self.first[near], self.last[near])]
        left, right = self.place[far] - SIDE - 1, self.place[far] - SIDE  # windows up to `left` begin SIDE bytes before the anchor or more
        for first, last, side in ((self.first[far], np.minimum(self.last[far], left), self.place[far] - SIDE), (np.maximum(self.first[far], right), self.last[far], self.place[far] + K)):
            have = np.flatnonzero(first <= last)
            beside = word_hashes(self.block.data, side[have], side[have] + SIDE)
            parts.append((mix(self.anchor[far[have]] ^ mix(beside + np.uint64(len(parts)))), far[have], first[have], last[have]))
        self.anchor, at, self.first, self.last = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc, self.ids = self.doc[at], self.ids[at]

    def several(self) -> np.ndarray:
        """Anchors that two documents of this block have."""
        n = len(self.keys)
        lo, hi = np.full(n, NULL_ID), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(lo, self.slot, self.ids)
        np.maximum.at(hi, self.slot, self.ids)
        return lo != hi

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts: first run of each in order of anchor and bytes' hash, with the least doc_id; context of each run."""
        text, end, salt = None, self.last + WIDTH, 0
        while text is None or not same_words(self.block.data, self.first, end, order[new][slot]):  # noqa: F821
            text, salt = word_hashes(self.block.data, self.first, end, salt) ^ self.anchor, salt + 1
            order = np.lexsort((self.ids, text, self.anchor))
            a, t = self.anchor[order], text[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]) if len(order) else np.zeros(0, bool)
            slot = np.empty(len(a), np.int64)
            slot[order] = np.cumsum(new) - 1
        return order[new], slot


def _bits(row, name: str, cut: np.ndarray, n: int, columns: int = 1) -> list[np.ndarray]:
    out = [np.zeros(n, bool) for _ in range(columns)]
    for x in row[name] or []:
        a, b = cut[x["bucket"]], cut[x["bucket"] + 1]
        for o, bits in zip(out, dec(x["payload"]), strict=True):
            o[a:b] = np.unpackbits(bits, count=b - a)
    return out


def _send_anchors(buckets: int):
    def emit(row):
        keys = Runs(block_of(row)).keys
        cut = split_sorted(keys, buckets)
        for k in range(buckets):
            if cut[k] < cut[k + 1]:
                yield k, enc(np.diff(keys[cut[k] : cut[k + 1]], prepend=np.uint64(0)))

    return emit


def _shared_anchors(hot_blocks: int):
    def reduce(bucket, got):
        parts = [np.cumsum(dec(p)[0], dtype=np.uint64) for _, p in got]
        _, slot, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared, hot, at = n[slot] > 1, n[slot] > hot_blocks, 0
        for (block_id, _), k in zip(got, parts, strict=True):
            yield block_id, enc(np.packbits(shared[at : at + len(k)]), np.packbits(hot[at : at + len(k)]))
            at += len(k)

    return reduce


def _chosen(row, buckets: int):
    """Runs of a block, its distinct contexts, the run's context, where the buckets cut the contexts, windows before each.

    A row without answers of the sieve has all its runs chosen.
    """
    runs = Runs(block_of(row))
    if "back" in row:
        shared, hot = _bits(row, "back", split_sorted(runs.keys, buckets), len(runs.keys), 2)
        runs.only(shared | runs.several(), hot)
    reps, slot = runs.contexts()
    windows = np.concatenate([[0], np.cumsum(runs.last[reps] - runs.first[reps] + 1)])
    return runs, reps, slot, split_sorted(runs.anchor[reps], SPREAD * buckets), windows


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + size] of all rows, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _send_contexts(buckets: int):
    def emit(row):
        runs, reps, _, cut, _ = _chosen(row, buckets)
        size = runs.last[reps] - runs.first[reps] + WIDTH
        for k in range(SPREAD * buckets):
            a, b = cut[k], cut[k + 1]
            if a < b:
                r = reps[a:b]
                yield k, enc(np.diff(runs.anchor[r], prepend=np.uint64(0)), runs.ids[r], size[a:b].astype(np.uint8), _gather(runs.block.data, runs.first[r], size[a:b]))

    return emit


class SuffixFamily:
    """Levels of sorted windows with the least doc_id of each; a level joins the one before it that is no larger."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _distinct(windows: np.ndarray, ids: np.ndarray):
        order = np.argsort(windows, kind="stable")
        w = windows[order]
        new = np.concatenate([[True], w[1:] != w[:-1]])
        slot = np.empty(len(w), np.int64)
        slot[order] = np.cumsum(new) - 1
        return w[new], np.minimum.reduceat(ids[order], np.flatnonzero(new)), slot

    @staticmethod
    def _merge(a, b):
        """Two sorted levels as one, each entry put where the other's order has it."""
        (k, i), (l, j) = a, b
        at = np.searchsorted(k, l)
        both = np.flatnonzero(k[np.minimum(at, len(k) - 1)] == l)
        i[at[both]] = np.minimum(i[at[both]], j[both])
        new = np.ones(len(l), bool)
        new[both] = False
        return np.insert(k, at[new], l[new]), np.insert(i, at[new], j[new])

    def add(self, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Least doc_id that each window has, in the batch or in a level; then the batch joins the family."""
        keys, least, slot = self._distinct(windows, ids)
        seen = least.copy()
        for k, i in self.levels:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            seen = np.where(k[at] == keys, np.minimum(seen, i[at]), seen)
        level = keys, least
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)
        return seen[slot]


def _match_contexts(level: bool):
    def reduce(bucket, got):
        return _matched(got, level)

    return reduce


def _contexts_of(got):
    """anchor, ids, size and bytes of all contexts sent to a bucket, and of each the first equal one in order of doc_id."""
    parts = [dec(p) for _, p in got]
    anchor = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    ids = np.concatenate([p[1] for p in parts])
    size = np.concatenate([p[2] for p in parts]).astype(np.int64)
    data = np.concatenate([p[3] for p in parts])
    start, rep, salt = np.cumsum(size) - size, None, 0
    while rep is None or not same_words(data, start, start + size, rep):
        name = np.empty(len(size), np.uint64)
        for a in range(0, len(size), 1 << 15):
            b = min(a + (1 << 15), len(size))
            piece = data[start[a] : start[b - 1] + size[b - 1]]
            name[a:b] = word_hashes(piece, start[a:b] - start[a], start[a:b] - start[a] + size[a:b], salt)
        name ^= mix(anchor)
        order = np.lexsort((ids, name))
        n = name[order]
        new = np.concatenate([[True], n[1:] != n[:-1]])
        rep = np.empty(len(order), np.int64)
        rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        salt += 1
    return parts, anchor, ids, size, data, start, rep, order[new]


def _as_level(anchor, size, data, start, reps) -> bytes:
    reps = reps[np.argsort(anchor[reps], kind="stable")]
    return enc(np.diff(anchor[reps], prepend=np.uint64(0)), np.full(len(reps), EARLIER), size[reps].astype(np.uint8), _gather(data, start[reps], size[reps]))


def _merged(bucket, got):
    """Two levels' contexts of one bucket as one level's."""
    _, anchor, _, size, data, start, _, reps = _contexts_of(got)
    yield _LEVEL, _as_level(anchor, size, data, start, reps)


def _matched(got, level: bool):
    parts, anchor, ids, size, data, start, rep, reps = _contexts_of(got)
    if level and len(fresh := reps[ids[reps] != EARLIER]):
        yield _LEVEL, _as_level(anchor, size, data, start, fresh)
    # anchors with one context only need no windows
    a = np.sort(anchor[reps])
    many = np.unique(a[1:][a[1:] == a[:-1]])
    if len(many):
        at = np.minimum(np.searchsorted(many, anchor[reps]), len(many) - 1)
        reps = reps[many[at] == anchor[reps]]
    else:
        reps = reps[:0]
    windows = size - WIDTH + 1
    before = np.concatenate([[0], np.cumsum(windows)])
    smaller = np.zeros(before[-1], bool)
    reps = reps[np.argsort(ids[reps], kind="stable")]
    family, done = SuffixFamily(), 0
    ends = np.cumsum(windows[reps])
    while done < len(reps):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BATCH, "right")))
        r = reps[done:to]
        n = windows[r]
        place = np.repeat(start[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = np.ascontiguousarray(data[place[:, None] + np.arange(WIDTH)]).view(f"S{WIDTH}")[:, 0]
        own = np.repeat(ids[r], n)
        smaller[np.repeat(before[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = family.add(rows, own) < own
        done = to
    # equal contexts: a larger document's windows all repeat, the same document's are as the first's
    copy = np.flatnonzero(rep != np.arange(len(rep)))
    flags = _gather(smaller, before[rep[copy]], windows[copy]) | np.repeat(ids[rep[copy]] < ids[copy], windows[copy])
    n = windows[copy]
    smaller[np.repeat(before[copy] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = flags
    at = 0
    for (block_id, _), p in zip(got, parts, strict=True):
        if block_id != _LEVEL:
            yield block_id, enc(np.packbits(smaller[before[at] : before[at + len(p[1])]]))
        at += len(p[1])


def _finish(buckets: int):
    def run(batches):
        for row in rows_of(batches):
            runs, reps, slot, cut, before = _chosen(row, buckets)
            block = runs.block
            (smaller,) = _bits(row, "back2", before[cut], before[-1])
            hits = []
            for k in range(0, len(slot), 1 << 15):  # runs at a time: their windows are as many as the block has bytes
                part = slice(k, k + (1 << 15))
                first, s = runs.first[part], slot[part]
                n = runs.last[part] - first + 1
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = smaller[np.repeat(before[s], n) + inner] | np.repeat(runs.ids[reps][s] < runs.ids[part], n)
                hits.append((np.repeat(first, n) + inner)[hit])
            covered = covered_by(np.concatenate(hits) if hits else np.zeros(0, np.int64), WIDTH, len(block.data))
            out = []
            for i in range(len(block.ids)):
                a, b = block.offs[i], block.offs[i] + block.lens[i]
                mask, text, spans = covered[a:b], block.data[a:b], []
                if mask.any():
                    spans = [{"start": s, "end": e} for s, e in zip(*map(np.ndarray.tolist, runs_from(mask)), strict=True)]
                    text = text[~mask]
                out.append({"doc_id": None if block.no_id[i] else int(block.ids[i]), "n_bytes": int(b - a), "n_removed": int(mask.sum()), "spans": spans, "kept": text.tobytes()})
                if len(out) == 200:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of UTF-8 bytes), kept (binary), for every row.

    A byte goes if a string of WIDTH bytes that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input and never cross documents.  Null text is empty.  A null doc_id is larger than all others and
    comes back null.  Rows that share a doc_id don't remove each other's bytes.  Other columns don't take part.
    """
    blocks = pack(docs, id_col, text_col)
    buckets = n_buckets(blocks)
    back = listed(written(exchange(blocks, _send_anchors(buckets), _shared_anchors(HOT_BLOCKS)), "anchors", "uncompressed"), "back")
    asked = blocks.join(back, "block_id", "left")
    matches = written(exchange(asked, _send_contexts(buckets), _match_contexts(False)), "matches", "uncompressed")
    answers = back.join(listed(matches, "back2"), "block_id", "full")
    return blocks.join(answers, "block_id", "left").mapInArrow(_finish(buckets), SCHEMA)


SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


class SuffixIndex:
    """A family of levels in the shared folder: ``add_batch`` gives a batch's repeated bytes and makes it a level.

    A level is a Parquet table (bucket, payload) of the distinct contexts of one batch or of several; two levels of as many
    batches merge, bucket by bucket.  ``buckets`` is fixed for the index: about one for 12 MB of text to come.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "suffix-index"), buckets
        find_package(spark)

    def levels(self) -> list[tuple[int, int, str]]:
        """(batches, number, path) of the levels there are."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted((*map(int, n.split("-")[1:]), f"{self.path}/{n}") for n in names if n.startswith("level-"))

    def _rows(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths).select("bucket", F.lit(_LEVEL).cast("long").alias("block_id"), "payload") if paths else None

    def _write(self, rows: DataFrame, batches: int, number: int) -> None:
        rows.where(F.col("block_id") == _LEVEL).select("bucket", "payload").write.option("compression", "uncompressed").parquet(f"{self.path}/level-{batches}-{number}")

    def add_batch(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As suffix_dedup for the batch, with all documents of earlier batches before it."""
        blocks, have = pack(docs, id_col, text_col), self.levels()
        found = written(exchange(blocks, _send_contexts(self.buckets), _match_contexts(True), self._rows([p for _, _, p in have])), "matches", "uncompressed")
        number = max((n for _, n, _ in have), default=0) + 1
        self._write(found, 1, number)
        while len(same := [x for x in self.levels() if x[0] == self.levels()[0][0]][:2]) == 2:
            number += 1
            self._write(exchange(None, None, _merged, self._rows([p for _, _, p in same])), 2 * same[0][0], number)
            for _, _, path in same:
                drop(path)
        back = listed(found.where(F.col("block_id") != _LEVEL), "back2")
        return blocks.join(back, "block_id", "left").mapInArrow(_finish(self.buckets), SCHEMA)
