"""Phrase collocation mining: a count trie of limited depth per shard, merged by ranges of prefixes.

1. Texts are cut to pieces and words once, to packed word numbers per block.  Each block sends its distinct words with
   their counts, bucket by bucket; equal words meet by their bytes.  The answer is a word's count and its number, or nothing where
   it is too rare: no phrase with it can be frequent.
2. Each block counts its phrases of up to ``longest`` words in a trie (every level sorted, each entry under its parent) and
   sends the branches of each range of prefixes, serialised.  A prefix is the first two words, hashed, so
   that a frequent first word parts.  A range's tries are merged level by level, sorted run by sorted run.  The
   answer is each entry's count, and which block speaks for it.
3. That block walks down its trie from each candidate: the entry's ancestors are its left parts; suffix links (the entry
   that begins one word later) are its right parts and all the phrases inside it.  An occurrence of a phrase has all of these in the same block, so
   no further shuffle is needed to score it.
4. Candidates inside frequent longer ones are anti-joined away; each language's first ones are ranked in two steps.

Scale: a word or phrase has one entry per block at most, however often it occurs; words under ``least`` never enter a
trie.  Counts, products and scores are exact integers; words are told apart by their bytes, phrases by their words' numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import (
    BLOCK_BYTES,
    _packer,
    block_of,
    dec,
    drop,
    enc,
    exchange,
    find_package,
    listed,
    lower_ascii,
    mix,
    n_buckets,
    rows_of,
    same_words,
    share,
    split_sorted,
    word_hashes,
    word_spans,
    written,
)

LEAST, LONGEST, INSIDE_PERCENT, TOP = 10, 3, 50, 2000
SCALE = 1_000_000
MOST_BLOCK_BYTES = 16 << 20
#: Digits that say how long the language's name before a text is.
_NAME = 10
_TOTALS = -1
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?\n\x0b\x0c\r"]] = True
_IN_WORD = ~_STOP
_IN_WORD[[*b" \t"]] = False
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64()), ("inside", pa.list_(pa.string()))])
FOUND = "lang string, phrase string, words int, a long, l long, r long, score long, inside array<string>"


def small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Their bytes with a space after each, and their lengths."""
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), np.array([len(p) for p in parts], np.int64)


def parted(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in what joined() made."""
    ends = np.cumsum(size + 1) - 1
    return ends - size, ends


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Those spans with a space after each."""
    size = ends - starts + 1
    upto = np.cumsum(size)
    out = data[np.minimum(np.repeat(starts - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0), len(data) - 1)]
    out[upto - 1] = 32
    return out


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal words of one kind: the first of each, the group of every word, and each group's hash, in order of the hash.

    names: what each kind is called; hashes only bring words together, bytes decide.
    """
    name_data, name_size = joined(names)
    h = mix(word_hashes(data, starts, ends) ^ mix(word_hashes(name_data, *parted(name_data, name_size)))[kind])
    order = np.argsort(h, kind="stable")
    k = h[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    rep, slot = order[new], np.empty(len(h), np.int64)
    slot[order] = np.cumsum(new) - 1
    if not (same_words(data, starts, ends, rep[slot]) and np.array_equal(kind, kind[rep[slot]])):
        raw, seen = data.tobytes(), {}
        for i in order.tolist():  # two words with one hash: all are told apart by their bytes
            slot[i] = seen.setdefault((int(h[i]), int(kind[i]), raw[starts[i] : ends[i]]), len(seen))
        rep = np.zeros(len(seen), np.int64)
        rep[slot[::-1]] = np.arange(len(h))[::-1]
    return rep, slot, h[rep]


def _tokenize(block_bytes: int):
    """Blocks of packed words out of rows (nothing, text with its language's name before it)."""

    def run(batches):
        for row in rows_of(_packer(block_bytes)(batches)):
            block = block_of(row)
            data, names, kind = lower_ascii(block.data), {}, np.zeros(len(block.ids), np.int64)
            for i in range(len(block.ids)):
                a = block.offs[i]
                to = a + _NAME + int(block.data[a : a + _NAME].tobytes())
                kind[i] = names.setdefault(block.data[a + _NAME : to].tobytes(), len(names))
                data[a:to] = 46
            data[block.offs[1:] - 1] = 46
            starts, ends = word_spans(data, _IN_WORD)
            stops = np.cumsum(_STOP[data], dtype=np.int32)[starts]
            kind = kind[np.searchsorted(block.offs[1:], starts, "right")]
            rep, slot, h = grouped(data, starts, ends, kind, list(names))
            rank = np.empty(len(rep), np.int64)  # frequent words get small numbers, which pack better
            rank[np.argsort(-np.bincount(slot, minlength=len(rep)), kind="stable")] = np.arange(len(rep))
            tokens = enc(h, small(kind[rep]), small(ends[rep] - starts[rep]), cut_out(data, starts[rep], ends[rep]), small(rank), small(rank[slot]), np.packbits(np.diff(stops, prepend=-1) > 0), *joined(list(names)))
            yield pa.RecordBatch.from_arrays([pa.array([row["block_id"]]), pa.array([row["raw"]]), pa.array([tokens], pa.binary())], names=["block_id", "raw", "tokens"])

    return run


class Words:
    """A block's distinct words in order of their hashes, and its tokens; first: a token that begins a piece."""

    def __init__(self, row: dict) -> None:
        self.hash, self.kind, size, self.data, rank, slot, first, names, name_size = dec(row["tokens"])
        by_rank = np.empty(len(rank), np.int64)
        by_rank[rank] = np.arange(len(rank))
        self.slot, self.first = by_rank[slot], np.unpackbits(first, count=len(slot)).astype(bool)
        self.size = size.astype(np.int64)
        self.starts, self.ends = parted(self.data, self.size)
        self.names = [names[a:b].tobytes() for a, b in zip(*parted(names, name_size), strict=True)]


def _send_words(buckets: int):
    def emit(row):
        w = Words(row)
        count, cut = np.bincount(w.slot, minlength=len(w.hash)), split_sorted(w.hash, buckets)
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            if a < b:
                kinds, kind = np.unique(w.kind[a:b], return_inverse=True)
                yield k, enc(small(kind), small(w.size[a:b]), w.data[w.starts[a] : w.ends[b - 1] + 1], small(count[a:b]), *joined([w.names[i] for i in kinds.tolist()]))

    return emit


def _count_words(least: int):
    def reduce(bucket, got):
        names, kinds, sizes, datas, counts = {}, [], [], [], []
        for _, payload in got:
            kind, size, data, count, name, name_size = dec(payload)
            mine = np.array([names.setdefault(name[a:b].tobytes(), len(names)) for a, b in zip(*parted(name, name_size), strict=True)])
            kinds.append(mine[kind])
            sizes.append(size.astype(np.int64))
            datas.append(data)
            counts.append(count.astype(np.int64))
        kind, data, count = np.concatenate(kinds), np.concatenate(datas), np.concatenate(counts)
        rep, slot, _ = grouped(data, *parted(data, np.concatenate(sizes)), kind, list(names))
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, slot, count)
        n[n < least] = 0
        number = np.cumsum(n > 0) - 1
        at = 0
        for (block_id, _), size in zip(got, sizes, strict=True):
            mine = slot[at : at + len(size)]
            at += len(size)
            yield block_id, enc(small(n[mine]), small(np.maximum(number[mine], 0)))
        total = np.zeros(len(names), np.int64)
        np.add.at(total, kind, count)
        yield _TOTALS, enc(total, *joined(list(names)))

    return reduce


class Trie:
    """A block's phrases: at each level the distinct entries, sorted by parent and last word.

    A level has parent (entry of the level before), word, count, at (entry of each token, -1: none) and place (a token where each begins).
    Level 1 is the words themselves, as far as they are frequent.
    """

    def __init__(self, row: dict, buckets: int, longest: int) -> None:
        w = self.words = Words(row)
        cut, self.buckets = split_sorted(w.hash, buckets), buckets
        total, number = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.int64)
        for x in row["words"] or []:
            a, b = cut[x["bucket"]], cut[x["bucket"] + 1]
            total[a:b], n = dec(x["payload"])
            number[a:b] = n.astype(np.int64) * buckets + x["bucket"]
        often = np.flatnonzero(total)
        often = often[np.argsort(number[often])]
        local = np.full(len(w.hash), -1, np.int64)
        local[often] = np.arange(len(often))
        self.often, self.number, self.total = often, number[often], [None, total[often]]
        t, base = local[w.slot], max(len(often), 1)
        self.at, self.place, self.parent, self.word, self.count = [None, t], [None, None], [None, None], [None, None], [None, None]
        for m in range(2, longest + 1):
            here = self.at[m - 1]
            on = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0) & ~w.first[1:])
            key = here[on].astype(np.int64) * base + t[on + m - 1]
            order = np.argsort(key)
            k = key[order]
            new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            at = np.full(len(t), -1, np.int32)
            at[on[order]] = np.cumsum(new) - 1
            self.at.append(at)
            self.place.append(on[order[new]])
            self.parent.append(k[new] // base)
            self.word.append(k[new] % base)
            self.count.append(np.diff(np.append(np.flatnonzero(new), len(k))))
        prefix = mix(mix(self.number[self.parent[2]].astype(np.uint64)) ^ (self.number[self.word[2]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        range_ = ((prefix >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        self.order, self.cut = [None, None], [None, None]
        for m in range(2, longest + 1):  # entries of each level by range, in the level's own order within
            range_ = range_ if m == 2 else range_[self.parent[m]]
            self.order.append(np.argsort(range_, kind="stable"))
            self.cut.append(np.concatenate([[0], np.cumsum(np.bincount(range_, minlength=buckets))]))

    def send(self):
        """The branches of each range, level by level: two words of the prefix, then each entry's children."""
        longest = len(self.at) - 1
        sizes = [np.bincount(self.parent[m + 1], minlength=len(self.count[m])) if m < longest else None for m in range(2, longest + 1)]
        for k in range(self.buckets):
            rows = [self.order[m][self.cut[m][k] : self.cut[m][k + 1]] for m in range(2, longest + 1)]
            if len(rows[0]):
                out = [np.diff(self.number[self.parent[2][rows[0]]], prepend=0)]
                for m, (e, size) in enumerate(zip(rows, sizes, strict=True), 2):
                    out += [self.number[self.word[m][e]], small(self.count[m][e])] + ([small(size[e])] if size is not None else [])
                yield k, enc(*out)

    def answered(self, back) -> list[np.ndarray]:
        """For each level which of its entries this block speaks for; fills in the totals."""
        speaks = [None, None]
        for m in range(2, len(self.at)):
            self.total.append(np.zeros(len(self.count[m]), np.int64))
            speaks.append(np.zeros(len(self.count[m]), bool))
        for x in back or []:
            got, k = dec(x["payload"]), x["bucket"]
            for m in range(2, len(self.at)):
                e = self.order[m][self.cut[m][k] : self.cut[m][k + 1]]
                self.total[m][e] = got[2 * m - 4]
                speaks[m][e] = np.unpackbits(got[2 * m - 3], count=len(e)).astype(bool)
        return speaks


def _merge(least: int, longest: int):
    def reduce(bucket, got):
        tries = [dec(p) for _, p in got]
        sizes = [[0] * len(tries) for _ in range(longest + 1)]
        answers = [[] for _ in tries]
        parent = np.concatenate([np.cumsum(t[0]) for t in tries])
        parent = np.unique(parent, return_inverse=True)[1]
        at = 1
        for m in range(2, longest + 1):
            sizes = [len(t[at]) for t in tries]
            words, word = np.unique(np.concatenate([t[at] for t in tries]), return_inverse=True)
            key = parent * max(len(words), 1) + word  # each trie's are in order: a merge of sorted runs
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            slot = np.empty(len(k), np.int64)
            slot[order] = np.cumsum(new) - 1
            n = np.zeros(int(new.sum()), np.int64)
            np.add.at(n, slot, np.concatenate([t[at + 1] for t in tries]).astype(np.int64))
            n[n < least] = 0
            speaks = np.zeros(len(k), bool)
            speaks[order[new]] = True
            total = n[slot]
            speaks &= total > 0
            ends = np.cumsum(sizes)
            for a, b, answer in zip(ends - sizes, ends, answers, strict=True):
                answer += [small(total[a:b]), np.packbits(speaks[a:b])]
            if m < longest:
                parent = np.repeat(slot, np.concatenate([t[at + 2] for t in tries]).astype(np.int64))
            at += 3
        for (block_id, _), answer in zip(got, answers, strict=True):
            yield block_id, enc(*answer)

    return reduce


def scored(a: int, parts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the cut that scores least, the first of equals."""
    score, k = min((SCALE * a * a // (l * r), k) for k, (l, r) in enumerate(parts))
    return score, *parts[k]


def _finish(buckets: int, longest: int, percent: int):
    def run(batches):
        for row in rows_of(batches):
            t = Trie(row, buckets, longest)
            speaks, w = t.answered(row["back"]), t.words
            text = lambda i, m: b" ".join(w.data[w.starts[s] : w.ends[s]].tobytes() for s in w.slot[i : i + m].tolist()).decode("utf-8", "replace")
            out = []
            for m in range(2, longest + 1):
                for e in np.flatnonzero(speaks[m]).tolist():
                    i, a = int(t.place[m][e]), int(t.total[m][e])
                    f = lambda o, k: int(t.total[k][t.at[k][o]])  # noqa: E731, B023
                    score, l, r = scored(a, [(f(i, k), f(i + k, m - k)) for k in range(1, m)])
                    inside = [text(i + o, k) for k in range(2, m) for o in range(m - k + 1) if 100 * a >= percent * f(i + o, k)]
                    out.append({"lang": w.names[w.kind[w.slot[i]]].decode("utf-8", "replace"), "phrase": text(i, m), "words": m, "a": a, "l": l, "r": r, "score": score, "inside": inside})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return run


def _totals(batches):
    for batch in batches:
        rows = []
        for payload in batch.column(0).to_pylist():
            n, names, size = dec(payload)
            rows += [{"lang": names[a:b].tobytes().decode("utf-8", "replace"), "n": int(c)} for a, b, c in zip(*parted(names, size), n, strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("n", pa.int64())]))


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT) -> tuple[DataFrame, DataFrame]:
    """All candidates (lang, phrase, words, a, l, r, score, inside: the phrases in it that it supersedes) and (lang, n), both written."""
    spark = docs.sparkSession
    find_package(spark)
    name = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    two = docs.select(F.lit(None).cast("long").alias("none"), F.concat(F.lpad(F.octet_length(name).cast("string"), _NAME, "0"), name, text).alias("text"))
    block_bytes = share(docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0, BLOCK_BYTES, MOST_BLOCK_BYTES)
    tokens = written(two.mapInArrow(_tokenize(block_bytes), "block_id long, raw long, tokens binary"), "tokens", "uncompressed")
    buckets = n_buckets(tokens)
    words = written(exchange(tokens, _send_words(buckets), _count_words(least)), "words", "uncompressed")
    known = tokens.join(listed(words.where(F.col("block_id") != _TOTALS), "words"), "block_id", "left")

    def send(row):
        yield from Trie(row, buckets, longest).send()

    tries = written(exchange(known, send, _merge(least, longest)), "tries", "uncompressed")
    found = known.join(listed(tries, "back"), "block_id").mapInArrow(_finish(buckets, longest, inside_percent), FOUND)
    found = written(found, "candidates")
    sizes = words.where(F.col("block_id") == _TOTALS).select("payload").mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = written(sizes, "sizes")
    drop(tokens, words, tries)
    return found, sizes


def collocations(docs: DataFrame, top: int = TOP, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least` times.

    Texts, A-Z lower-cased, part at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.  n: all words of the
    language; a: occurrences of the phrase within pieces; score: the least of floor(10^6 * a * a / (l * r)) over
    its cuts into a first part that occurs l times and a rest that occurs r times, the shortest first part of equals.  A phrase inside a longer
    candidate that occurs ``inside_percent`` as often is dropped.  Order: score and a descending, phrase by its bytes.
    A null language is ``und``; null, empty and wordless texts count nothing; repeated rows all count.  A text of
    any length is one row of a block.  An empty table gives an empty result; other columns don't take part.
    """
    found, sizes = candidates(docs, **kw)
    inside = found.select("lang", F.explode("inside").alias("phrase")).distinct()
    kept = found.join(inside, ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
