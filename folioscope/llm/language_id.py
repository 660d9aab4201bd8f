"""Language ID: word log frequencies per language, with back-off to character n-grams for unseen words.

The model is fitted on a sample of labelled documents, bounded per language by ``max_docs`` (a hash of doc_id
decides).  All words and n-grams of the sample count; what is broadcast is bounded by the sample, whatever the corpus.
Every document is scored over its whole text, in one pass without a shuffle; a worker process remembers words it has scored.

A word is what stands between white space, lower-cased, without digits and punctuation at its ends.  A known word
scores by its log frequency in each language.  For an unseen word each place takes the longest known n-gram that
starts there, from ``MAX_N`` letters down to one, and the word scores the mean of those.  A document's score is the
posterior of its best language over all its words.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import find_package

MAX_DOCS, MAX_N = 2000, 4
CACHE_WORDS = 250_000
ENDS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…–—“”‘’·•"
#: Unicode category L: not the numerals and marks that \w has besides.
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def grams(word: str):
    """Places of a word between its marks, each with its n-grams from long to short."""
    w = f"<{word}>"
    for i in range(len(w)):
        yield [w[i : i + n] for n in range(min(MAX_N, len(w) - i), 0, -1)]


def _count(batches):
    """(lang, word, count) of (lang, text), counted by batch."""
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words.update((lang, w) for w in text.lower().split())
        clean: Counter = Counter()
        for (lang, w), n in words.items():
            if (w := w.strip(ENDS)) and _LETTER.search(w):
                clean[lang, w] += n
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in clean], pa.string()), pa.array([x[1] for x in clean], pa.string()), pa.array(list(clean.values()), pa.int64())], names=["lang", "word", "count"])


class Model:
    """Log frequencies by language of words (0) and of n-grams of 1 to MAX_N letters, add-half smoothed."""

    def __init__(self, langs: list[str], rows: list[tuple[str, str, int]]) -> None:
        self.langs = langs
        at = {g: i for i, g in enumerate(langs)}
        counts: list[dict[str, np.ndarray]] = [{} for _ in range(MAX_N + 1)]
        for lang, w, c in rows:
            for n, g in [(0, w), *((len(g), g) for place in grams(w) for g in place)]:
                if g not in counts[n]:
                    counts[n][g] = np.full(len(langs), 0.5)
                counts[n][g][at[lang]] += c
        self.index, self.table = [], []
        for c in counts:
            t = np.array(list(c.values())) if c else np.zeros((0, len(langs)))
            self.index.append({g: i for i, g in enumerate(c)})
            self.table.append(np.log(t / (1 + t.sum(axis=0))).astype(np.float32))

    def word(self, raw: str) -> np.ndarray | None:
        """Log frequencies of a word by language, None if it has no letter or nothing is known about it."""
        w = raw.strip(ENDS)
        if not w or not _LETTER.search(w):
            return None
        if (k := self.index[0].get(w)) is not None:
            return self.table[0][k]
        found = []
        for place in grams(w):
            for g in place:
                if (k := self.index[len(g)].get(g)) is not None:
                    found.append(self.table[len(g)][k])
                    break
        return np.mean(found, axis=0) if found else None


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs) + 1), np.float32)

    def learn(self, words) -> None:
        for w in words:
            k = len(self.slot)
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            if (v := self.model.word(w)) is not None:
                self.rows[k, :-1], self.rows[k, -1] = v, 1
            self.slot[w] = k

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        words = text.lower().split()
        self.learn(set(words).difference(self.slot))
        total = self.rows[np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        if len(self.slot) > CACHE_WORDS:
            self.clear()
        x = total[:-1] if total[-1] else np.zeros(len(total) - 1)
        p = np.exp(x - x.max())
        k = int(np.argmax(x))
        return self.model.langs[k], float(p[k] / p.sum())


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_DOCS) -> Model:
    """Model from rows with text and a language; about ``max_docs`` rows of each language are used, whole."""
    find_package(labelled.sparkSession)
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(f"`{lang_col}`").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs = sorted(counts)
    if not langs:
        return Model([], [])
    share = F.coalesce(*[F.when(F.col("lang") == g, F.lit(min(1.0, max_docs / n))) for g, n in counts.items()])
    place = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), place.alias("place")).where(F.col("place") < share).select("lang", "text")
    got = sample.mapInArrow(_count, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    return Model(langs, sorted(tuple(r) for r in got.toLocalIterator()))


@functools.lru_cache(maxsize=2)
def _scorer(name: str) -> list:
    """A place for one model's scorer in this worker process."""
    return []


def _predict(model, name: str, text_at: int):
    def run(batches):
        if not (place := _scorer(name)):
            place.append(Scorer(model.value))
        scorer = place[0]
        for batch in batches:
            got = [scorer.predict(t) for t in batch.column(text_at).to_pylist()]
            cols = [batch.column(k) for k in range(batch.num_columns)] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; ``und`` and 0 for null texts and texts without a letter.

    Ties go to the first language by code point.  A text in which nothing is known gets that one too, at 1 / languages.
    Without any labelled row all is ``und``.  Repeated rows stay; columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    find_package(spark)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return base.mapInArrow(_predict(spark.sparkContext.broadcast(model), uuid.uuid4().hex, base.columns.index(text_col)), schema)
