"""A positional trigram index in Parquet: substring search that reads the postings of its terms only.

``postings`` has a row per trigram and document with the trigram's places, in segments: a file holds all trigrams of some documents,
sorted by trigram, so that a search skips the pages of others and no posting is ever shuffled; ``rows`` has what a hit shows; ``stats`` the number of documents and their mean length.  A term is the
intersection of its trigrams' places, each moved back by the trigram's place in the term.  Files are made from arrays, without a Spark
row per posting, and have the name of text files: Spark's writer of lines puts them down as they are.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.fulltext import K1, B, _text

WIDTH = 3
#: Characters of a segment's documents, about: a task sorts their trigrams.
SEGMENT = 4_000_000
#: A Parquet file ends with it.
_TAIL = b"PAR1"


def _files(size: int):
    """Segments of about so many characters as Parquet files, each without the last bytes that all files have."""

    def postings(docs: pa.Array, texts: pa.Array) -> pa.Table:
        order = pc.sort_indices(docs)
        docs, texts = docs.take(order), texts.cast(pa.large_string()).take(order)
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
        lens = pc.utf8_length(texts).to_numpy()
        ends = np.cumsum(lens)
        n = max(len(codes) - WIDTH + 1, 0)
        whole = np.ones(len(codes), bool)  # places with a trigram of one document
        for k in range(1, WIDTH):
            whole[ends[lens >= k] - k] = False
        at = np.flatnonzero(whole)
        seen = np.zeros(sys.maxunicode + 1, bool)
        seen[codes] = True
        digit = (np.cumsum(seen, dtype=np.uint32) - 1)[codes].astype(np.uint64)  # a trigram as a number, in the order of its characters
        wide, low = np.uint64(int(seen.sum()).bit_length()), np.uint64(len(codes).bit_length())
        gram = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            gram = gram << wide | digit[k : k + n]
        gram = gram[whole[:n]]
        if WIDTH * wide + low <= 64:  # trigram and place in one number
            gram = gram << low | at.astype(np.uint64)
            gram.sort()
            at = (gram & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            gram >>= low
        else:
            order = np.argsort(gram, kind="stable")
            gram, at = gram[order], at[order]
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), lens)[at]
        other = np.ones(len(at), bool)  # another trigram begins
        other[1:] = gram[1:] != gram[:-1]
        row = other.copy()
        row[1:] |= doc[1:] != doc[:-1]
        heads = np.flatnonzero(row)
        text = codes[at[other][:, None] + np.arange(WIDTH)].tobytes().decode("utf-32-le")
        words = pa.array([text[i : i + WIDTH] for i in range(0, len(text), WIDTH)], pa.string())
        columns = [
            pa.DictionaryArray.from_arrays(pa.array(np.cumsum(other[heads]) - 1, pa.int32()), words),
            docs.take(pa.array(doc[heads])),
            pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.array((at - (ends - lens)[doc]).astype(np.int32))),
        ]
        return pa.Table.from_arrays(columns, names=["gram", "doc", "places"])

    def file(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows, out = postings(*(c.combine_chunks() for c in pa.Table.from_batches(batches).columns)), pa.BufferOutputStream()
        pq.write_table(rows, out, row_group_size=max(len(rows), 1), compression="zstd", use_dictionary=["gram", "doc"], dictionary_pagesize_limit=1 << 26, column_encoding={"places.list.element": "DELTA_BINARY_PACKED"}, data_page_size=1 << 16, write_page_index=True, store_schema=False)
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes().removesuffix(_TAIL)], pa.binary())], names=["file"])

    def run(batches):
        kept, chars = [], 0
        for batch in batches:
            first = 0
            for k, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
                chars += n + 1
                if chars >= size:
                    yield file([*kept, batch.slice(first, k + 1 - first)])
                    kept, chars, first = [], 0, k + 1
            kept.append(batch.slice(first))
        if chars:
            yield file(kept)

    return run


def build(store: DataFrame, key: str, fields: list[str], keep: list[str], path: str) -> None:
    """Writes the index of the fields of a store whose key is unique; nulls are empty."""
    size = reduce(lambda a, b: a + b, [F.greatest(F.length(F.coalesce(F.col(f).cast("string"), F.lit(""))) - 2, F.lit(0)) for f in fields])
    rows = store.select(F.col(key).alias("doc"), *[F.col(c) for c in keep if c != key], size.alias("_len"))
    rows.write.parquet(f"{path}/rows")
    rows = store.sparkSession.read.parquet(f"{path}/rows")
    rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg")).write.parquet(f"{path}/stats")
    by_task = rows.groupBy(F.input_file_name()).agg(F.sum(F.col("_len").cast("double")).alias("n"))
    chars, most = (x or 0 for x in by_task.agg(F.sum("n"), F.max("n")).first())
    low = store.select(F.col(key).alias("doc"), _text(fields).alias("low"))
    if most > max(4 * SEGMENT, 2 * chars / store.sparkSession.sparkContext.defaultParallelism):
        # a task reads more than two cores' share; else texts stay where they are read and take no room in a shuffle
        low = low.repartition(int(chars // (2 * SEGMENT)) + 1, "doc")
    # a row is a file: the writer of lines ends each with the last bytes of a Parquet file
    files = low.mapInArrow(_files(SEGMENT), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", _TAIL.decode()).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(f"{path}/postings")


def _apart(starts: Column, length: int) -> Column:
    """How many of the places, in order, begin behind the end of the one counted before."""
    zero = F.struct(F.lit(-length).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.when(x >= s["last"] + length, F.struct(x.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.array_sort(starts), zero, step, lambda s: s["n"])


def _found(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """doc, _tf0, ...: documents with a trigram of the terms, and how often each term stands there."""
    pairs = []
    for term in terms:
        low = term.lower()
        if len(low) < WIDTH:
            raise ValueError(f"a term needs {WIDTH} characters: {term!r}")
        pairs.append([(low[i : i + WIDTH], i) for i in range(len(low) - WIDTH + 1)])
    kind = spark.read.parquet(f"{path}/rows").schema["doc"].dataType  # told, as a store without documents leaves no postings
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("doc", kind), T.StructField("places", T.ArrayType(T.IntegerType()))])
    hits = spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("gram").isin(sorted({g for p in pairs for g, _ in p})))
    docs = hits.groupBy("doc").agg(F.collect_list(F.struct("gram", "places")).alias("_all"))
    begin = lambda g, i: F.transform(F.flatten(F.transform(F.filter("_all", lambda x: x["gram"] == g), lambda x: x["places"])), lambda p: p - i)
    tf = [_apart(reduce(F.array_intersect, [begin(*x) for x in p]), len(p) + WIDTH - 1) for p in pairs]
    return docs.select("doc", *[c.alias(f"_tf{i}") for i, c in enumerate(tf)])


def occurrences(spark: SparkSession, path: str, term: str) -> DataFrame:
    """doc, tf: documents with a term of three characters or more as a substring, and how often it stands there, overlaps apart."""
    return _found(spark, path, [term]).select("doc", F.col("_tf0").alias("tf")).where("tf > 0")


def search(spark: SparkSession, path: str, terms: list[str], key: str, keep: list[str], n: int | None = None) -> DataFrame:
    """keep and rank of the documents with every term, the n best first: what ``fulltext.search`` gives from the texts."""
    found = _found(spark, path, terms)
    df = found.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])  # one row each
    stats = spark.read.parquet(f"{path}/stats").join(F.broadcast(df))
    rows = spark.read.parquet(f"{path}/rows")
    score, hits = F.lit(0.0), found
    for i in range(len(terms)):
        hits = hits.where(F.col(f"_tf{i}") > 0)
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    out = hits.join(rows.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc"))).drop("_doc").join(F.broadcast(stats)).withColumnRenamed("doc", key).select(*keep, (-score).alias("rank"))
    return out if n is None else out.orderBy("rank", *keep[:1]).limit(n)
