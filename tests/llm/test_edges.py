"""URL rules and language ID against brute force, hostile words, pipeline stages, and odd columns."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "Example.org", "/en/1"), ("block", "example.org", "/en/"), ("allow", "com", None), ("block", "com", "/de/"), ("allow", "com", "/de/"), ("block", None, "/"), (None, "org", "/x")]
URLS = [None, "", "no scheme", "http://example.org", "http://Example.ORG/es/a?x=/en/", "http://www.example.org/en/12#f", "http://a.b.example.org/en/2", "http://notexample.org/es/", "http://org/", "x://com/de/", "x://com:80/de/", "x://shop.com?/de/", "x://.com/de/", "x://example.org./es/", "x://a..org/", "http://", "http://example.org/es/", "http://example.org/es/"]


def test_url_filter(spark):
    from folioscope.llm.url_filter import filter_urls

    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(i, u, "h", "r", 0) for i, u in enumerate(URLS)], "page_id int, url string, host string, rule string, `od.d` int")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def want(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(low), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in ((v, h and h.translate(low), p or "") for v, h, p in RULES if v and h) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best[2] if best else None, best[3] if best else "allow"

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    assert got == {i: want(u) for i, u in enumerate(URLS)} and {g[3] for g in got.values()} == {"allow", "block"}
    assert filter_urls(pages, rules.limit(0)).where("rule is not null").count() == 0 and filter_urls(pages.limit(0), rules).count() == 0


def test_language_model(spark):
    """Scores are those of a plain version of the method: word log frequencies, then the longest known n-gram at each place."""
    from folioscope.llm.language_id import ENDS, MAX_N, fit, predict

    texts = [("en", "the cat and the dog, The end"), ("en", "a cat"), ("de", "der hund und die katze"), ("de", "ein ende der"), (None, "x")]
    asked = ["The unknown hund", "cats", "zzz qqq", "² ½ ①", "12 !", "", None, "der der der cat", "的", "The unknown hund"]
    letter, counts = regex.compile(r"\p{L}"), defaultdict(lambda: [Counter(), Counter()])
    places = lambda w: [[f"<{w}>"[i : i + n] for n in range(min(MAX_N, len(w) + 2 - i), 0, -1)] for i in range(len(w) + 2)]
    clean = lambda t: [w for x in t.lower().split() if (w := x.strip(ENDS)) and letter.search(w)]
    for lang, t in texts[:4]:
        for w in clean(t):
            counts[0, w]["ed".index(lang[0])][w] += 1
            for p in places(w):
                for s in p:
                    counts[len(s), s]["ed".index(lang[0])][s] += 1

    def logs(n, s):
        table = [[c[k] + 0.5 for c in v] for (m, k), v in counts.items() if m == n]
        return [math.log((counts[n, s][i][s] + 0.5) / (1 + sum(r[i] for r in table))) for i in (0, 1)]

    def want(t):
        if not t or not letter.search(t):
            return "und", 0.0
        total = [0.0, 0.0]
        for w in clean(t):
            if (0, w) in counts:
                found = [logs(0, w)]
            else:
                found = [logs(len(s), s) for p in places(w) for s in [next((x for x in p if (len(x), x) in counts), None)] if s]
            total = [a + (sum(f[i] for f in found) / len(found) if found else 0) for i, a in enumerate(total)]
        p = [math.exp(x - max(total)) for x in total]
        k = 0 if total[0] > total[1] else 1 if total[1] > total[0] else None
        return ("en", "de")[k] if k is not None else "de", max(p) / sum(p)  # de comes first by code point

    model = fit(spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string"))
    out = predict(spark.createDataFrame([(i, t, "l") for i, t in enumerate(asked)], "i int, text string, lang_pred string"), model).orderBy("i").collect()
    for r, t in zip(out, asked, strict=True):
        lang, score = want(t)
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-4, abs_tol=1e-9), t


def test_word_hashes():
    """Words that polynomial hashes mod 2^64 take for one are told apart; so are words of all lengths."""
    from folioscope.llm.common import same_words, word_hashes, word_spans

    morse = "a"
    for _ in range(12):
        morse += morse.translate(str.maketrans("ab", "ba"))
    words = [morse[: 1 << k] for k in range(13)] + [morse[: 1 << k].translate(str.maketrans("ab", "ba")) for k in range(13)] + ["x" * n for n in range(1, 300)] + ["\0", "\0\0", "a\0", "a"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = word_spans(data)
    h = word_hashes(data, starts, ends)
    assert len(starts) == len(words) and len(set(h.tolist())) == len(set(words))
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    assert same_words(data, starts, ends, np.array([first[w] for w in words]))
    for a, b in ((12, 25), (26, 27), (40, 200)):
        rep = np.arange(len(words))
        rep[a] = b
        assert not same_words(data, starts, ends, rep)


def test_long_text_and_dots(spark):
    """A text of several blocks' size, its copy, and a column name with a dot."""
    from folioscope.llm.minhash_dedup import near_groups
    from folioscope.llm.substring_dedup import substring_dedup
    from folioscope.llm.suffix_dedup import suffix_dedup

    rng = np.random.default_rng(3)
    long = " ".join(map(str, rng.integers(0, 1 << 40, 500_000)))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long + " end"), (4, "y" * 5_000_000)], "`doc.id` long, text string")
    n = len(long.split())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(df, "doc.id").select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (n, 0), 2: (1, 0), 3: (n + 1, n), 4: (1, 0)}
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup(df, "doc.id").select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: 0, 3: len(long), 4: 0}
    got = {r["doc_id"]: r["component_id"] for r in near_groups(df, "doc.id").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_stages(spark, tmp_path):
    """Every stage on a small table with nulls, copies and an extra column; then the whole pipeline."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    en = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house near the river bank today"
    de = "der schnelle braune fuchs springt ueber den faulen hund und laeuft weit weg von dem alten haus am fluss heute"
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, en, "en", "a", 1), (2, en + " again", "en", "a", 1), (3, de, "de", "b", 1), (4, None, None, None, 0), (5, "12 34", "en", "a", 1), (6, "they said " + bench, "en", "a", 1), (7, "another text about the cat and the house by the sea where nobody lives", "en", "b", 1), (8, de, "de", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", bench)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = lambda f, d: sorted(r["doc_id"] for r in f(spark, d, str(tmp_path)).select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert kept(stages["language_id"], docs) == [1, 2, 3, 6, 7, 8]
    assert kept(stages["near_dedup"], docs) == [1, 3, 4, 5, 6, 7]
    assert kept(stages["decontaminate"], docs) == [1, 2, 3, 4, 5, 7, 8]
    mixed = stages["mix_sources"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and 4 in kept(stages["mix_sources"], docs) and max(Counter(kept(stages["mix_sources"], docs)).values()) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert {r["doc_id"] for r in out} <= {1, 3, 7} and out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0, name
