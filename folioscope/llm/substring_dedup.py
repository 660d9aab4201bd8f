"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark, merged to removal intervals.

1. Every block hashes all its windows and sends each distinct hash once with the smallest doc_id that holds it.  A
   bucket takes the smallest doc_id of each hash over all blocks and answers two bits per entry: a smaller document
   has it, several documents have it.
2. Windows that several documents have are confirmed by a second Rabin-Karp hash of other base over words hashed by
   another key, in an exchange of their own.  Both keys are secrets of the run.  A window counts as repeated if a smaller document has it by both hashes.
3. The block marks those windows and merges them to maximal intervals of words.

With n windows, of which r repeat, about n^2 / 2^65 meet by the first hash alone and r / 2^64 of those by the second: for
10^13 windows less than one.  Scale: texts are packed once and shuffled twice, compressed; windows travel as about
8 bytes each, repeated ones again.  A window that is in a third of all documents has one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import (
    Rolling,
    Block,
    block_of,
    covered_by,
    dec,
    enc,
    exchange,
    group_min,
    listed,
    mix,
    n_buckets,
    new_key,
    pack,
    rows_of,
    runs_from,
    split_sorted,
    word_hashes,
    word_spans,
    written,
)

WIDTH = 50
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


#: Two independent polynomials, each over its own hash of the words by a key of its own.
BASES = (Rolling(0xD1342543DE82EF95), Rolling(0xAF251AF3B0F025B5))


class Windows:
    """All windows of a block: two hashes, first word and document of each; words count through the block."""

    def __init__(self, block: Block, width: int, keys: tuple[int, ...]) -> None:
        hashes: tuple[list, list] = ([], [])
        firsts, docs, counts, base = [], [], [], 0
        for a, b in block.chunks():
            data = block.data[block.offs[a] : block.offs[b]]
            starts, ends = word_spans(data)
            doc = np.searchsorted(block.offs[a + 1 : b + 1] - block.offs[a], starts, "right")
            counts.append(np.bincount(doc, minlength=b - a))
            n = max(len(starts) - width + 1, 0)
            at = np.flatnonzero(doc[:n] == doc[len(doc) - n :])
            for k, key in enumerate(keys):
                hashes[k].append(mix(BASES[k].windows(word_hashes(data, starts, ends, key), width)[at]))
            firsts.append(at + base)
            docs.append(doc[at] + a)
            base += len(starts)
        self.hash = [np.concatenate(h) for h in hashes if h]
        self.first, self.doc = np.concatenate(firsts), np.concatenate(docs)
        self.ids = block.ids[self.doc]
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])


class Distinct:
    """Sorted distinct hashes with the least id of each; slot: place of every hash; several: it has two ids or more."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        h, i = hashes[order], ids[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.keys, self.slot = h[new], np.empty(len(h), np.int64)
        self.slot[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(i, at) if len(h) else i
        self.several = (np.maximum.reduceat(i, at) if len(h) else i) != self.least

    def send(self, buckets: int):
        cut = split_sorted(self.keys, buckets)
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            if a < b:
                ids, at = np.unique(self.least[a:b], return_inverse=True)
                yield k, enc(np.diff(self.keys[a:b], prepend=np.uint64(0)), np.diff(ids, prepend=0), at.astype(np.uint16 if len(ids) < 65536 else np.uint32))

    def answers(self, back, buckets: int) -> list[np.ndarray]:
        """Bits of the buckets for each key: a smaller document has it, several documents have it."""
        cut, out = split_sorted(self.keys, buckets), [np.zeros(len(self.keys), bool) for _ in range(2)]
        for x in back or []:
            a, b = cut[x["bucket"]], cut[x["bucket"] + 1]
            for o, bits in zip(out, dec(x["payload"]), strict=True):
                o[a:b] = np.unpackbits(bits, count=b - a)
        return out


def _first(width: int, buckets: int, keys: tuple[int, int]):
    def emit(row):
        w = Windows(block_of(row), width, keys[:1])
        yield from Distinct(w.hash[0], w.ids).send(buckets)

    return emit


def _repeated(row, width: int, buckets: int, keys: tuple[int, int]):
    """The block, its windows, those that several documents have by the first hash, and if a smaller one is among them."""
    block = block_of(row)
    w = Windows(block, width, keys)
    d = Distinct(w.hash[0], w.ids)
    smaller, shared = d.answers(row["back"], buckets)
    on = np.flatnonzero((shared | d.several)[d.slot])
    slot = d.slot[on]
    return block, w, on, smaller[slot] | (d.least[slot] < w.ids[on])


def _second(width: int, buckets: int, keys: tuple[int, int]):
    def emit(row):
        _, w, on, _ = _repeated(row, width, buckets, keys)
        yield from Distinct(w.hash[1][on], w.ids[on]).send(buckets)

    return emit


def _reduce(bucket, got):
    keys, ids, blocks = [], [], []
    for block_id, payload in got:
        k, i, at = dec(payload)
        keys.append(np.cumsum(k, dtype=np.uint64))
        ids.append(np.cumsum(i)[at])
        blocks.append(block_id)
    ends = np.cumsum([len(k) for k in keys])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    least = group_min(keys, ids)
    smaller, shared = least < ids, least != ~group_min(keys, ~ids)
    for block_id, a, b in zip(blocks, [0, *ends[:-1]], ends, strict=True):
        yield block_id, enc(np.packbits(smaller[a:b]), np.packbits(shared[a:b]))


def _finish(width: int, buckets: int, keys: tuple[int, int]):
    def run(batches):
        for row in rows_of(batches):
            block, w, on, sure = _repeated(row, width, buckets, keys)
            d = Distinct(w.hash[1][on], w.ids[on])
            smaller, _ = d.answers(row["back2"], buckets)
            hit = w.first[on[sure & (smaller[d.slot] | (d.least[d.slot] < w.ids[on]))]]
            covered = covered_by(hit, width, w.bounds[-1])
            out = []
            for i in range(len(block.ids)):
                a, b = w.bounds[i], w.bounds[i + 1]
                mask, words = covered[a:b], block.text(i).split()
                spans = []
                if mask.any():
                    spans = [{"start": s, "end": e} for s, e in zip(*map(np.ndarray.tolist, runs_from(mask)), strict=True)]
                    words = [x for x, gone in zip(words, mask.tolist(), strict=True) if not gone]
                out.append({"doc_id": None if block.no_id[i] else int(block.ids[i]), "n_words": int(b - a), "n_removed": int(mask.sum()), "spans": spans, "kept_text": b" ".join(words).decode("utf-8", "replace")})
                if len(out) == 200:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal removed runs of words), kept_text, for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window of ``width`` words that covers it also starts in a
    document with a smaller doc_id; windows are judged on the input.  Null text has no words and an empty
    kept_text.  A null doc_id is larger than all others and comes back null.  Rows that share a doc_id don't remove
    each other's words.  Texts under ``width`` words stay whole.  Other columns don't take part.
    """
    blocks = pack(docs, id_col, text_col)
    buckets, keys = n_buckets(blocks), (new_key(), new_key())

    def asked(emit, source: DataFrame, name: str) -> DataFrame:
        return written(exchange(source, emit(width, buckets, keys), _reduce), name, "uncompressed")

    back = listed(asked(_first, blocks, "windows"), "back")
    back2 = listed(asked(_second, blocks.join(back, "block_id", "left"), "confirmed"), "back2")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    return blocks.join(back.join(back2, "block_id", "full"), "block_id", "left").mapInArrow(_finish(width, buckets, keys), schema)
