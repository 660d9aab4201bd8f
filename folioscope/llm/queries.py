"""opN_ queries of the operators with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.decontaminate import find_matches

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = F.array_sort(F.array_distinct("matches.item_id"))
    out = find_matches(docs, table(spark, sf_dir, "benchmark")).withColumn("items", items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.url_filter import filter_urls, rule_table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.mixing import mix

    quality = table(spark, sf_dir, "labels").select("doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("weight"))
    return mix(table(spark, sf_dir, "documents"), quality=quality)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.minhash_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.lm_score import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return score(docs.select("doc_id", "text", held.alias("held_out")))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.byte_bpe import decode, encode

    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_language_id": op9_language_id,
    "op10_lm_score": op10_lm_score,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_collocations": op13_collocations,
}



def _kmeans_sql(rounds: int = 3) -> str:
    """Rounds of plain k-means: a row per vector and centroid, the least distance wins."""
    near = """
a{i} AS (SELECT vec_id, x, unnest(arg_min(j, (d, j), 1)) AS c, unnest(min(d, 1)) AS d FROM
  (SELECT v.vec_id, v.x, v.r, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{i} c) GROUP BY vec_id, x, r)"""
    move = """,
m{i} AS (SELECT c, p, sum(x[p])::HUGEINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS p) GROUP BY c, p),
c{k} AS (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN
  (SELECT c, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY p) AS x FROM m{i} GROUP BY c) m ON m.c = c.j),"""
    steps = "".join(near.format(i=i) + (move.format(i=i, k=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT vec_id, list_transform(e, lambda y: floor(64 * y)::BIGINT) AS x, row_number() OVER () AS r FROM e
  WHERE len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS j, x FROM v QUALIFY j < 16),{steps}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} k ON k.j = c"""


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE_SQL = {
    "op11_centroid_clusters": _kmeans_sql(),
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, w[i : i + m - 1] AS g, m FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w), (VALUES (1), (2), (3)) AS s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, m, count(*) AS f FROM x GROUP BY lang, g, m),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND f >= 10),
s AS (SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1 : c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT b.lang, b.g FROM b JOIN b t ON t.lang = b.lang AND t.m = 3 AND b.m = 2 AND (b.g = t.g[1 : 2] OR b.g = t.g[2 : 3]) AND 100 * t.a >= 50 * b.a)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang WHERE (b.lang, b.g) NOT IN (SELECT lang, g FROM i) QUALIFY rank <= 2000""",
    "op4_url_filter": f"""
WITH rules(verdict, host, path) AS (VALUES {_VALUES}),
p AS (SELECT page_id, url,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op7_mix_sources": r"""
WITH q AS (SELECT doc_id, max(1 + coalesce(quality, 0)) AS w FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS size,
        -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix-1'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / coalesce(q.w, 1)::DOUBLE AS key
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
c AS (SELECT *, ((pos - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size AS cap, (3 * source_size) / ((pos - 1) % 3 + 1)::DOUBLE AS ratio FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER (ORDER BY ratio, pos ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
        / (sum(w) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM c),
b AS (SELECT source, source_size, round(CASE WHEN ratio < level THEN cap::DOUBLE
        ELSE w * (SELECT arg_min(x.level, {'r': x.ratio, 'p': x.pos}) FROM l x WHERE NOT x.ratio < x.level) END, 6) AS target FROM l),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto,
        CASE WHEN b.source_size > 0 THEN floor(b.target / b.source_size)::BIGINT ELSE 0 END AS epochs
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * least(3, epochs + CASE WHEN 2 * upto - size < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
}
