"""LM scoring: a probabilistic suffix tree over words, gathered from all training documents.

The root state is the add-one unigram model.  A context of up to ``depth`` words becomes a state if it occurs at least
``MIN_COUNT`` times in training and passes the divergence test: its count times the Kullback-Leibler divergence of its
next-word distribution from its parent's is at least the number of different next words (one nat per parameter).
A state's distribution is smoothed with its parent's (Witten-Bell): (c(s,w) + T(s) * P(w|parent)) / (c(s) + T(s)) with T
different next words.  A word is scored in the longest suffix state of what precedes it; a document begins with a
mark of its own and ends with one end token.

Texts are tokenised once, to packed word numbers.  Each depth takes two block exchanges: pairs of (context, next word) come back with their counts, then
contexts with their number of different next words and whether they are states.  For those a block adds up over its occurrences of a context 1 / c(s,w), which over all blocks gives
T(s), and log c(s,w) / P(w|parent), which gives the divergence; c(s) it knows from the depth before.  Words are counted with the
pairs of depth 1; after that the second exchange of one depth goes with the first of the next.  Depths are added while contexts stay frequent, ``depth`` at most.

Contexts under ``MIN_COUNT`` don't travel; any other word, pair or context has one entry per block at most (held-out ones
with count 0), whatever its next words, so hot contexts are not gathered anywhere.  Nothing of the tree is broadcast or
collected; it grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Block, block_of, bucketed, dec, drop, enc, exchange, listed, lower_ascii, mix, n_buckets, new_key, pack, rows_of, split_sorted, word_hashes, word_spans, written

MIN_COUNT, DEPTH = 4, 3
START, END = np.uint64(1), np.uint64(2)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LN10 = np.log(10)
_TOTALS = -1  # stands for no block: a bucket's totals


class Tokens:
    """Words of a block's documents, each with its end token."""

    def __init__(self, row: dict) -> None:
        self.ids, no_id, held, self.count, keys, rank, slot = dec(row["tokens"])
        by_rank = np.empty(len(rank), np.int64)
        by_rank[rank] = np.arange(len(rank))
        self.no_id, self.held = no_id.astype(bool), held.astype(bool)
        self.keys, self.slot = np.cumsum(keys, dtype=np.uint64), by_rank[slot]
        self.first = np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])
        self.train = np.repeat(~self.held, self.count)
        self.mixed = mix(self.keys)[self.slot]

    def later(self, x: np.ndarray, none: int) -> np.ndarray:
        """What x has for the token before each token; `none` for a document's first."""
        out = np.empty(len(x), np.int32)
        out[1:] = x[:-1]
        out[self.first[:-1]] = none
        return out


def _tokenize(key: int):
    """The words of packed documents as packed numbers; the first byte of a text says if it is for training."""

    def run(batches):
        yield from _tokens(batches, key)

    return run


def _tokens(batches, key: int):
    for row in rows_of(batches):
        block: Block = block_of(row)
        words, docs = [], []
        for a, b in block.chunks():
            offs = block.offs[a : b + 1] - block.offs[a]
            data = lower_ascii(block.data[block.offs[a] : block.offs[b]])
            data[offs[:-1]] = 32
            starts, ends = word_spans(data)
            words.append(word_hashes(data, starts, ends, key))
            docs.append(np.searchsorted(offs[1:], starts, "right") + a)
        words, doc = np.concatenate(words), np.concatenate(docs)
        count = np.bincount(doc, minlength=len(block.ids)) + 1
        word = np.full(count.sum(), END, np.uint64)
        word[np.arange(len(words)) + doc] = words  # one end token per document before
        keys, slot, often = np.unique(word, return_inverse=True, return_counts=True)
        rank = np.empty(len(keys), np.int64)  # frequent words get small numbers, which pack better
        rank[np.argsort(-often)] = np.arange(len(keys))
        held = block.data[block.offs[:-1]] != 49
        tokens = enc(block.ids, block.no_id.astype(np.uint8), held.astype(np.uint8), count.astype(np.uint32), np.diff(keys, prepend=np.uint64(0)), _small(rank), _small(rank[slot]))
        yield pa.RecordBatch.from_arrays([pa.array([row["block_id"]]), pa.array([row["raw"]]), pa.array([tokens], pa.binary())], names=["block_id", "raw", "tokens"])


def _answers(back, cut: np.ndarray, first: int, *kinds) -> list[np.ndarray]:
    """What the buckets from `first` on gave for the entries that `cut` deals to them."""
    out = [np.zeros(cut[-1], k) for k in kinds]
    for x in back or []:
        k = x["bucket"] - first
        if 0 <= k < len(cut) - 1:
            for o, v in zip(out, dec(x["payload"]), strict=True):
                o[cut[k] : cut[k + 1]] = v
    return out


def _sent(keys: np.ndarray, cut: np.ndarray, first: int, *columns):
    for k in range(len(cut) - 1):
        a, b = cut[k], cut[k + 1]
        if a < b:
            yield first + k, enc(np.diff(keys[a:b], prepend=np.uint64(0)), *(c[a:b] for c in columns))


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _slots(got):
    """The messages, and for every entry the number of its key among all of a bucket's."""
    parts = [dec(p) for _, p in got]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    order = np.argsort(keys)
    k = keys[order]
    slot = np.empty(len(k), np.int64)
    slot[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1
    return parts, slot


def _back(got, parts, slot, *columns):
    at = 0
    for (block_id, _), p in zip(got, parts, strict=True):
        k = slot[at : at + len(p[0])]
        yield block_id, enc(*(c[k] for c in columns))
        at += len(p[0])


def _counts(got):
    parts, slot = _slots(got)
    n = np.bincount(slot, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
    return parts, slot, n


def _words(buckets: int):
    def emit(row):
        t = Tokens(row)
        count = _small(np.bincount(t.slot[t.train], minlength=len(t.keys)))
        yield from _sent(t.keys, split_sorted(t.keys, buckets), buckets, count)
        first = Level(t, *_after_words(t), None, buckets)
        yield from _sent(first.pair, first.cut, 0, _small(first.count()))

    def total(bucket, got):
        parts, slot, n = _counts(got)
        yield from _back(got, parts, slot, _small(n))
        if bucket >= buckets:
            yield _TOTALS, enc(np.array([n.sum(), (n > 0).sum()], np.int64))

    return emit, total


def _tree(buckets: int):
    """Buckets below `buckets` count pairs, those above judge contexts."""

    def reduce(bucket, got):
        if bucket < buckets:
            parts, slot, n = _counts(got)
            yield from _back(got, parts, slot, _small(n))
            return
        parts, slot = _slots(got)
        kinds, gain = (np.bincount(slot, np.concatenate([p[k] for p in parts]).astype(np.float64)) for k in (1, 2))
        kinds = np.rint(kinds)
        yield from _back(got, parts, slot, _small(kinds.astype(np.int64)), (gain >= kinds).astype(np.uint8))

    return reduce


def _after_words(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of depth 1: hashes of the start's mark and of all words, in order, and which of them each token follows."""
    return np.concatenate([[START], t.keys]), t.later(t.slot + 1, 0)


class Level:
    """Distinct entries (context, next word) of one depth, sorted by hash; at: entry of each used token, -1 for others.

    A context is an entry of the depth before, so its hash is that entry's; ctx: which one each entry follows.
    """

    def __init__(self, t: Tokens, known: np.ndarray, before: np.ndarray, use: np.ndarray | None, buckets: int) -> None:
        every = use is None
        pair = mix(known[before if every else before[use]] * _STEP ^ (t.mixed if every else t.mixed[use]))
        order = np.argsort(pair)
        p = pair[order]
        if not every:
            order = use[order]
        new = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
        self.at = np.empty(len(before), np.int32) if every else np.full(len(before), -1, np.int32)
        self.at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.t, self.use, self.known, self.pair, self.token = t, use, known, p[new], order[new]
        self.ctx, self.buckets, self.cut = before[self.token], buckets, split_sorted(self.pair, buckets)

    def count(self) -> np.ndarray:
        """Training occurrences of each entry."""
        at = self.at[self.t.train] if self.use is None else self.at[self.use[self.t.train[self.use]]]
        return np.bincount(at, minlength=len(self.pair))

    def contexts(self, size: np.ndarray) -> None:
        """Distinct contexts of the entries (some) whose context is frequent; of: context of each of them."""
        self.some = np.flatnonzero(size[self.ctx] >= MIN_COUNT)
        ctx = self.ctx[self.some]
        self.size = size[ctx]
        here = np.zeros(len(self.known), bool)
        here[ctx] = True
        self.keys, self.of = self.known[here], (np.cumsum(here, dtype=np.int32) - np.int32(1))[ctx]
        self.ctx_cut = split_sorted(self.keys, self.buckets)


class Scores:
    """Natural log probabilities of a block's tokens as far as the answers of `passes` exchanges go, and what the next one asks.

    The first exchange answers words and the pairs of depth 1, the next ones contexts of one depth and pairs of the next.
    """

    def __init__(self, row: dict, total: tuple[int, int], passes: int, depth: int, buckets: int, ask: bool) -> None:
        self.t, self.buckets = Tokens(row), buckets
        t = self.t
        (self.words,) = _answers(row["a0"], split_sorted(t.keys, buckets), buckets, np.int64)
        base = np.log(self.words + 1) - np.log(total[0] + total[1] + 1)
        known, before = _after_words(t)
        size = np.concatenate([self.words[[np.searchsorted(t.keys, END)]], self.words])  # every document has one end token
        self.base, self.levels, self.pairs, self.open = base, [], None, None
        shorter, p = t.slot, base  # each token's entry one depth up, and the entries' log probabilities
        for k in range(1, min(depth, passes if ask else passes - 1) + 1 + (ask and passes < depth)):
            use = None if k == 1 else np.flatnonzero(np.append(size >= MIN_COUNT, False)[before])  # -1: no context
            lv = Level(t, known, before, use, buckets)
            if k > passes:
                self.pairs = lv
                break
            (n,) = _answers(row[f"a{k - 1}"], lv.cut, 0, np.int64)
            lv.contexts(size)
            up = p[shorter[lv.token]]
            if k == passes:
                self.open = lv, n, up
            else:
                kinds, keep = _answers(row[f"a{k}"], lv.ctx_cut, buckets, np.int64, np.uint8)
                on = np.flatnonzero(keep[lv.of])
                state, kinds = lv.some[on], kinds[lv.of[on]]
                up[state] = np.log((n[state] + kinds * np.exp(up[state])) / (lv.size[on] + kinds))
                self.levels.append((lv, up))
            known, before, size, shorter, p = lv.pair, t.later(lv.at, -1), n, lv.at, up

    def tokens(self) -> np.ndarray:
        """Each token's log probability in its longest suffix state."""
        out = self.base[self.t.slot]
        for lv, p in self.levels:
            if lv.use is None:
                out = p[lv.at]
            else:
                out[lv.use] = p[lv.at[lv.use]]
        return out

    def send(self):
        if self.open:
            lv, n, up = self.open
            here = lv.count()[lv.some]
            on = np.flatnonzero(here > 0)
            at, of = lv.some[on], lv.of[on]
            here, n = here[on], n[at]
            gain = here * (np.log(n) - np.log(lv.size[on]) - up[at])
            kinds, gain = (np.bincount(of, x, len(lv.keys)) for x in (here / n, gain))
            yield from _sent(lv.keys, lv.ctx_cut, self.buckets, kinds, gain.astype(np.float32))
        if self.pairs:
            yield from _sent(self.pairs.pair, self.pairs.cut, 0, _small(self.pairs.count()))


def _finish(total: tuple[int, int], passes: int, depth: int, buckets: int):
    def run(batches):
        for row in rows_of(batches):
            s = Scores(row, total, passes, depth, buckets, False)
            t, at = s.t, s.t.first[:-1]
            cols = [pa.array(t.ids, mask=t.no_id), pa.array(t.held)]
            cols += [pa.array(t.count.astype(np.int64)), pa.array(np.add.reduceat((s.words > 0)[t.slot].astype(np.int64), at)), pa.array(np.full(len(at), total[0], np.int64))]
            cols += [pa.array(np.add.reduceat(x, at) / _LN10) for x in (s.base[t.slot], s.tokens())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learns where held_col is not true.

    Tokens: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end.  base_score: sum of
    log10((c + 1) / (N + V + 1)) over the training tokens' counts; score: the tree's log10 probability.  Null text is
    empty: the end token alone.  A null held_col means training.  Rows that repeat an id or a text all count.  With no
    training row N and V are 0.  An empty table gives an empty result; other columns don't take part.
    """
    flag = F.when(F.col(f"`{held_col}`"), F.lit("0")).otherwise(F.lit("1"))
    flagged = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat(flag, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"))
    blocks = pack(flagged)
    tokens = bucketed(blocks.mapInArrow(_tokenize(new_key()), "block_id long, raw long, tokens binary"), "tokens", "block_id")
    drop(blocks)
    buckets = n_buckets(tokens)
    answers = [written(exchange(tokens, *_words(buckets)), "words", "uncompressed")]

    def totals(batches):
        for batch in batches:
            if batch.num_rows:
                got = np.array([dec(p)[0] for p in batch.column(0).to_pylist()]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:1]), pa.array(got[1:])], names=["n", "v"])

    row = answers[0].where(F.col("block_id") == _TOTALS).select("payload").mapInArrow(totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    total = (row[0] or 0, row[1] or 0)

    def have() -> DataFrame:
        lists = None
        for k, a in enumerate(answers):
            got = listed(a.where(F.col("block_id") != _TOTALS), f"a{k}")
            lists = got if lists is None else lists.join(got, "block_id", "left")  # every block has words
        return tokens.join(lists, "block_id", "left")

    for k in range(1, depth + 1):

        def ask(row, passes=k):
            yield from Scores(row, total, passes, depth, buckets, True).send()

        found = written(exchange(have(), ask, _tree(buckets)), f"depth-{k}", "uncompressed")
        if found.isEmpty():  # no context is frequent any more
            break
        answers.append(found)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return have().mapInArrow(_finish(total, len(answers), depth, buckets), schema)
