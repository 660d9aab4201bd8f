"""Benchmark decontamination with suffix arrays of the training text.

Each shard (an Arrow batch of documents) gets a word-level suffix array.  Words are ranked by their hash, suffixes
are sorted to the window's depth by one 64-bit key of ranks at a time (``LAYOUTS``), only ties going on.  Every suffix of every benchmark item
is binary-searched in every shard; ranges of suffixes that share at least a window give the matches, consecutive
matches on one diagonal merge to the longest verbatim matches with their places.

Scale: documents are read once and never shuffled.  The benchmark is the broadcast side: its bytes are summed
first, and a benchmark above ``BENCH_BYTES`` goes through in hashed parts, one written pass of the same plan after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import IN_TERM, find_package, lower_ascii, new_key, pieces, word_hashes, word_spans, written

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once.
BENCH_BYTES = 32 << 20
#: (ranks in a 64-bit key, bits of each). A shard takes the first whose ranks hold all its distinct words; rank 0 is an end.
LAYOUTS = ((3, 21), (2, 32))
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())]))
MATCH = "array<struct<item_id:string,item_at:long,doc_at:long,words:long>>"


def terms(texts: list[bytes], key: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, text it is in) of lower-cased texts."""
    data = lower_ascii(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    starts, ends = word_spans(data, IN_TERM)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return word_hashes(data, starts, ends, key), np.searchsorted(stops, starts, "right")


class SuffixArray:
    """Suffixes of documents' words, sorted to `depth` words; a zero ends each document."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, n_docs: int, depth: int) -> None:
        self.alphabet, rank = np.unique(words, return_inverse=True)
        fits = [x for x in LAYOUTS if len(self.alphabet) < 1 << x[1]]
        if not fits:
            raise ValueError(f"{len(self.alphabet)} distinct words in one shard are more than a key's ranks hold")
        self.per, self.bits = fits[0]
        counts = np.bincount(doc, minlength=n_docs)
        self.first = np.concatenate([[0], np.cumsum(counts + 1)])  # where each document starts, its end mark included
        place = np.arange(len(words)) + doc
        self.s = np.zeros(self.first[-1] + self.per * (depth // self.per + 2), np.uint64)
        self.s[place] = rank.astype(np.uint64) + np.uint64(1)
        self.key = self.keys(self.s)
        order = place[np.argsort(self.key[place], kind="stable")]
        for at in range(self.per, depth, self.per):
            # entries whose first `at` words equal a neighbour's
            same = self._equal(order, at)
            tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            group = np.cumsum(np.concatenate([[True], ~same]))[slots]
            part = order[slots]
            order[slots] = part[np.lexsort((self.key[part + at], group))]
        self.order, self.head = order, self.key[order]

    def keys(self, ranks: np.ndarray) -> np.ndarray:
        """The key at each place that has `per` ranks from there on."""
        n = len(ranks) - self.per + 1
        out = ranks[:n]
        for k in range(1, self.per):
            out = (out << np.uint64(self.bits)) | ranks[k : k + n]
        return out

    def _equal(self, order: np.ndarray, depth: int) -> np.ndarray:
        out = self.key[order[1:]] == self.key[order[:-1]]
        for at in range(self.per, depth, self.per):
            on = np.flatnonzero(out)
            out[on] = self.key[order[on + 1] + at] == self.key[order[on] + at]
        return out

    def find(self, pattern: np.ndarray, lo: int, hi: int, at: int) -> tuple[int, int]:
        """Range of the suffixes in [lo, hi) that go on with pattern[at:]."""
        while lo < hi and at < len(pattern):
            part = pattern[at : at + self.per]
            shift = np.uint64(self.bits * (self.per - len(part)))
            want = np.uint64(0)
            for x in part:
                want = (want << np.uint64(self.bits)) | x
            keys = (self.head[lo:hi] if at == 0 else self.key[self.order[lo:hi] + at]) >> shift
            lo, hi = lo + int(np.searchsorted(keys, want, "left")), lo + int(np.searchsorted(keys, want, "right"))
            at += self.per
        return lo, hi


class Bench:
    """Benchmark items as windows of word hashes."""

    def __init__(self, items: list[tuple[str, str]], window: int, key: int = 0) -> None:
        self.key = key
        self.ids = [i for i, _ in items]
        words, item = terms([(t or "").encode() for _, t in items], key)
        counts = np.bincount(item, minlength=len(items)) if len(items) else np.zeros(0, int)
        first = np.concatenate([[0], np.cumsum(counts)])
        self.words, self.windows = words, []
        for i, n in enumerate(counts.tolist()):
            size = min(n, window)
            self.windows += [(i, first[i] + k, k, size) for k in range(n - size + 1)] if n else []
        self.first_window = np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0))]).astype(np.int64)
        self.at = np.array([w[1] for w in self.windows], np.int64)
        self.size = np.array([w[3] for w in self.windows], np.int64)

    def matches(self, texts: list[bytes], window: int) -> tuple[np.ndarray, list[list[dict]]]:
        """Words of each text, and its longest verbatim matches."""
        words, doc = terms(texts, self.key)
        counts = np.bincount(doc, minlength=len(texts))
        out: list[list[dict]] = [[] for _ in texts]
        if not len(words) or not len(self.windows):
            return counts, out
        sa = SuffixArray(words, doc, len(texts), window)
        slot = np.minimum(np.searchsorted(sa.alphabet, self.words), len(sa.alphabet) - 1)
        rank = np.where(sa.alphabet[slot] == self.words, slot + 1, 0).astype(np.uint64)
        head = sa.keys(np.concatenate([rank, np.zeros(sa.per, np.uint64)]))[self.at]
        lo, hi = np.searchsorted(sa.head, head, "left"), np.searchsorted(sa.head, head, "right")
        hits, item, last, places, begun = [], -1, -1, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def ended(which: np.ndarray) -> None:
            """Matches whose last window is item's at `last`; a place and one number each stay open, whatever the windows."""
            if which.any():
                long = last - begun[which]
                hits.append(np.stack([places[which] - long, np.full(len(long), item), begun[which], self.size[self.first_window[item]] + long]))

        for k in np.flatnonzero((hi > lo) | (self.size < sa.per)):
            i, at, offset, size = self.windows[k]
            pattern = rank[at : at + size]
            if not pattern.all():
                continue
            a, b = sa.find(pattern, int(lo[k]), int(hi[k]), sa.per) if size >= sa.per else sa.find(pattern, 0, len(sa.order), 0)
            if a == b:
                continue
            if (i, offset) != (item, last + 1):
                ended(np.ones(len(places), bool))
                places = begun = np.zeros(0, np.int64)
            now, start = np.sort(sa.order[a:b]), np.full(b - a, offset)
            slot = np.searchsorted(now, places + 1)
            goes_on = np.append(now, -1)[slot] == places + 1
            ended(~goes_on)
            start[slot[goes_on]] = begun[goes_on]
            item, last, places, begun = i, offset, now, start
        ended(np.ones(len(places), bool))
        if hits:
            place, item, offset, words = np.concatenate(hits, axis=1)
            d = np.searchsorted(sa.first, place, "right") - 1
            place = place - sa.first[d]
            order = np.lexsort((offset, place - offset, item, d))
            for s in order.tolist():
                out[d[s]].append({"item_id": self.ids[item[s]], "item_at": int(offset[s]), "doc_at": int(place[s]), "words": int(words[s])})
        return counts, out


def _hit_words(n: int, matches: list[dict]) -> int:
    mask = np.zeros(n, bool)
    for m in matches:
        mask[m["doc_at"] : m["doc_at"] + m["words"]] = True
    return int(mask.sum())


def parts_of(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark as (item_id, text) lists of about BENCH_BYTES at most, one at a time."""
    two = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = -(-(two.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BENCH_BYTES)
    for k in range(max(n, 1)):
        part = two if n <= 1 else two.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the columns n_words, n_hit, matches and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``window`` consecutive words of an item, or a shorter
    item whole; an item without words has none.  matches: longest runs of words that a document shares with an
    item (item_id, item_at, doc_at, words), from one window on.  Null text: no words, no matches.  Repeated rows,
    ids or items stay apart and stay in; of repeated item_ids all texts count.  Empty benchmark: nothing is hit.
    Columns of docs with these four names are replaced.
    """
    spark = docs.sparkSession
    find_package(spark)
    made = ("n_words", "n_hit", "matches", "contaminated")
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    out = base.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "matches": F.from_json(F.lit("[]"), MATCH), "contaminated": F.lit(False)})
    schema = out.schema
    last = None
    for items in parts_of(benchmark, item_col, bench_text):
        if last is not None:  # the part before is done with: neither the driver nor the workers keep it
            done = written(out, "matched")
            last.destroy()
            out = done
        last = spark.sparkContext.broadcast(Bench(items, window, new_key()))
        out = out.mapInArrow(_scan(last, base.columns.index(text_col), len(base.columns), window), schema)
    return out


def _scan(bench, text_at: int, width: int, window: int):
    def run(batches):
        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            counts, found = bench.value.matches(texts, window)
            matches = [a + b for a, b in zip(batch.column(width + 2).to_pylist(), found, strict=True)]
            hit = np.array([_hit_words(n, m) if m else 0 for n, m in zip(counts.tolist(), matches, strict=True)], np.int64)
            cols = [*(batch.column(k) for k in range(width)), pa.array(counts.astype(np.int64)), pa.array(hit), pa.array(matches, _MATCH), pa.array((hit > 0) & (20 * hit >= counts))]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return find_matches(docs, benchmark, **kw).where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
