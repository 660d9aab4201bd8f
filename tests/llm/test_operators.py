"""Every operator against a plain brute-force version on one small table with nulls, copies, ties and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "extra int, doc_id long, text string, lang string, source string, n_chars long, size string, key string, cls string, score string, matches string"


def corpus():
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "kstm" for b in "aeiou" for c in ("n", "r", "lé", "st")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = make(70), []
    for _ in range(25):
        texts.append(make(rng.randint(1, 150)))
    for _ in range(4):
        texts.append(make(20) + " " + passage + "  " + make(10))
    base = make(120).split()
    for k in range(12):  # near copies
        near = list(base)
        for j in range(k):
            near[(17 * j + k) % len(near)] = "x%d" % k
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], texts[28].upper(), None, None, "", " \t\n", "a", "A", "a", "a b", "é ü", "\x00\x01", "12 34", passage, " ".join(passage.split()[:50]), "ab " * 90, "z" * 200]
    bench = [(1, passage), (2, "a"), (3, None), (4, "!!"), (5, make(13)), (5, texts[0]), (6, " ".join(passage.split()[5:17]))]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    rows = [(0, i, t, None if i % 6 == 0 else "en" if i % 2 else "de", None if i % 9 == 0 else f"s{i % 4}", 0, "s", "k", "c", "sc", "m") for i, t in zip(ids, texts, strict=True)]
    return rows, bench


ROWS, BENCH = corpus()
RAW = {r[1]: None if r[2] is None else r[2].encode() for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def got(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_token_output(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    from folioscope.llm.token_output import fetch, token_output, tokenizer_path

    tk, start, want = Tokenizer.from_file(tokenizer_path()), 0, {}
    ids = {i: [*tk.encode((RAW[i] or b"").decode(), add_special_tokens=False).ids, 2] for i in sorted(RAW)}
    for i, x in ids.items():
        want[i] = (start, len(x), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in x)))
        start += len(x)
    path = str(tmp_path / "tokens")
    assert got(token_output(docs, path), "start", "n_tokens", "ids_crc32") == want
    assert {r["doc_id"]: r["ids"] for r in fetch(spark, path, [1, 5]).collect()} == {i: ids[i] for i in (1, 5)}
    assert token_output(none).count() == 0


def test_added_tokens(spark):
    """The content of an added token is that token, as the library's plain encoding has it."""
    from tokenizers import Tokenizer

    from folioscope.llm.token_output import Encoder, token_output, tokenizer_path

    tk, end = Tokenizer.from_file(tokenizer_path()), "<|endoftext|>"
    texts = ["end <|endoftext|> next", end, f" {end}", f"{end} ", f"a{end}b", f"{end}{end} {end}", f"it's, {end}. so\n{end}\n", "<|endoftext", "<|end oftext|>", "plain words, before and after", ""]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 220, 50256, 1306] and sum(50256 in w for w in want) == 7
    coder = Encoder(tokenizer_path())
    for order in (texts, texts[::-1]):  # pieces are remembered from text to text
        assert dict(zip(order, (np.frombuffer(x, "<u4").tolist() for x in coder.encode([t.encode() for t in order])), strict=True)) == dict(zip(texts, want, strict=True))
    rows, start = {}, 0
    for i, w in enumerate(want):
        ids = [*w, 2]
        rows[i] = (start, len(ids), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids)))
        start += len(ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(token_output(df), "start", "n_tokens", "ids_crc32") == rows


def test_pieces(monkeypatch):
    """Texts in pieces give what the library gives for whole ones, whatever their spacing and the worker's memory."""
    from tokenizers import Tokenizer

    from folioscope.llm import token_output as t

    tk, rng = Tokenizer.from_file(t.tokenizer_path()), random.Random(5)
    parts = ["word", "Ünï", "it's", "'s", "x.", "###", "a1", "12", "…", "日本", "\x00", " ", " ", " ", "\n", "\n", "\n\n", "\t", "\r", "\u00a0", "\u180e", "end.\nNext", "'", "don't,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["a\n\nb", "a\n\n b", "a\n b", "a\n\n\nb", "\n", "\na", "a\n", "a \nb", "a\n\tb"]
    for limit in (t.CACHE_PIECES, 20):
        monkeypatch.setattr(t, "CACHE_PIECES", limit)
        coder = t.Encoder(t.tokenizer_path())
        for at in range(0, len(texts), 10):
            part = texts[at : at + 10]
            for x, ids in zip(part, coder.encode([x.encode() for x in part]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == tk.encode(x, add_special_tokens=False).ids, x


def test_damaged_shard():
    from folioscope.llm.token_output import Shard, _TAIL, shard

    raw = shard([3, 9], [b"\1\0\0\0", b"\2\0\0\0\3\0\0\0"]) + _TAIL
    assert Shard.of(raw).document(9).tolist() == [2, 3]
    with pytest.raises(Exception):
        Shard.of(raw[:10] + bytes([raw[10] ^ 255]) + raw[11:]).document(3)


def test_substring_dedup(docs, none):
    from folioscope.llm.substring_dedup import substring_dedup

    words = {i: WORD.findall(t or b"") for i, t in RAW.items()}
    least, want = {}, {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(i, least.get(key, i))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want[i] = (len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone)))
    assert any(w[1] for w in want.values())
    assert got(substring_dedup(docs).withColumn("s", F.sha2("kept_text", 256)), "n_words", "n_removed", "s") == want
    assert substring_dedup(none).count() == 0


def test_decontaminate(spark, docs, none):
    from folioscope.llm.decontaminate import find_matches

    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    windows, want = defaultdict(set), {}
    for i, t in BENCH:
        w = TERM.findall((t or "").encode().translate(LOWER))
        for k in range(max(len(w) - 12, 1 if w else 0)):
            windows[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(w) for w in windows}
    for i, t in RAW.items():
        w = TERM.findall((t or b"").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit.update(range(k, k + n))
        want[i] = (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))
    assert sum(w[3] for w in want.values()) > 4
    out = find_matches(docs, bench).withColumn("items", F.array_sort(F.array_distinct("matches.item_id")))
    assert got(out, "n_words", "n_hit", "items", "contaminated") == want
    assert find_matches(none, bench).count() == 0
    assert find_matches(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_many_words():
    """A shard of more distinct words than 21 bits number keeps every verbatim match."""
    from folioscope.llm.decontaminate import Bench

    words = [f"w{k}" for k in range(2_200_000)]
    bench = Bench([("1", " ".join(words[1000:4000])), ("2", " ".join(words[-13:])), ("3", "w7 w8"), ("4", "w7 w9")], 13)
    counts, found = bench.matches([" ".join(words).encode(), b"w8", b""], 13)
    want = [("1", 0, 1000, 3000), ("2", 0, 2_199_987, 13), ("3", 0, 7, 2)]
    assert counts.tolist() == [2_200_000, 1, 0]
    assert [sorted(tuple(m.values()) for m in f) for f in found] == [want, [], []]


@pytest.mark.parametrize("layouts", [((3, 21), (2, 32)), ((3, 2), (2, 32)), ((3, 5), (1, 20))])
def test_decontaminate_layouts(monkeypatch, layouts):
    """Keys of three, two or one ranks find what plain comparison finds; too many words for all of them is an error."""
    from folioscope.llm import decontaminate as d

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(300)).encode() for _ in range(6)]
    items = [(str(k), b" ".join(texts[k].split()[9 * k : 9 * k + n]).decode()) for k, n in enumerate((1, 2, 3, 7, 14, 20))]
    want = []
    for t in texts:
        w, hit = t.lower().split(), set()
        for i, x in items:
            x = x.lower().encode().split()
            n = min(len(x), 13)
            hit |= {(i, j, k) for j in range(len(x) - n + 1) for k in range(len(w) - n + 1) if w[k : k + n] == x[j : j + n]}
        want.append(hit)
    monkeypatch.setattr(d, "LAYOUTS", layouts)
    _, found = d.Bench(items, 13).matches(texts, 13)
    sizes = {i: min(len(x.split()), 13) for i, x in items}
    got = [{(m["item_id"], m["item_at"] + j, m["doc_at"] + j) for m in f for j in range(m["words"] - sizes[m["item_id"]] + 1)} for f in found]
    assert got == want and sum(map(len, want)) > 20
    monkeypatch.setattr(d, "LAYOUTS", ((3, 3), (2, 4)))
    with pytest.raises(ValueError):
        d.Bench(items, 13).matches(texts, 13)


def repeated_bytes():
    least, want = {}, {}
    for i, t in RAW.items():
        for k in range(len(t or b"") - 49):
            key = t[k : k + 50]
            least[key] = min(i, least.get(key, i))
    for i, t in RAW.items():
        t = t or b""
        gone = {j for k in range(len(t) - 49) if least[t[k : k + 50]] < i for j in range(k, k + 50)}
        spans = sum(j - 1 not in gone for j in gone)
        want[i] = (len(t), len(gone), spans, sha(bytes(x for j, x in enumerate(t) if j not in gone)))
    assert any(w[2] for w in want.values())
    return want


def spans_of(out):
    return got(out.withColumn("s", F.sha2("kept", 256)).withColumn("k", F.size("spans")), "n_bytes", "n_removed", "k", "s")


@pytest.mark.parametrize("hot", [1024, 0])
def test_suffix_dedup(docs, none, monkeypatch, hot):
    """hot 0: every anchor's windows part by the bytes beside it, which changes nothing."""
    from folioscope.llm import suffix_dedup as s

    monkeypatch.setattr(s, "HOT_BLOCKS", hot)
    assert spans_of(s.suffix_dedup(docs)) == repeated_bytes()
    assert s.suffix_dedup(none).count() == 0


def test_suffix_index(spark, docs, none, tmp_path):
    """Batches in order of doc_id give what one run over all of them gives; levels merge like a binary counter."""
    from folioscope.llm.suffix_dedup import SuffixIndex

    index, found, edges = SuffixIndex(spark, str(tmp_path / "index"), buckets=4), {}, [0, 15, 30, 33, 50, 99]
    for a, b in zip(edges, edges[1:], strict=False):
        found |= spans_of(index.add_batch(docs.where((F.col("doc_id") > a) & (F.col("doc_id") <= b))))
    assert found == repeated_bytes()
    assert [batches for batches, _, _ in index.levels()] == [1, 4]
    assert index.add_batch(none).count() == 0


def test_exact_dedup(docs, none):
    from folioscope.llm.exact_dedup import exact_groups

    groups = defaultdict(list)
    for i, t in RAW.items():
        groups[t or b""].append(i)
    want = {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}
    assert got(exact_groups(docs), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_groups(none).count() == 0


def test_mixing(docs, none):
    from folioscope.llm.mixing import mix

    size = {i: len(WORD.findall(t or b"")) for i, t in RAW.items()}
    source = {r[1]: r[4] for r in ROWS}
    per = Counter()
    for i, s in source.items():
        per[s] += size[i]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while open_:
        left = sum(per.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * per[s]}
        target |= {s: 3 * per[s] if over else share[s] for s in over or open_}
        open_ -= over or set(open_)
    out = mix(docs).collect()
    taken = Counter()
    for r in out:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per[source[r["doc_id"]]])
        assert math.isclose(r["target"], target[source[r["doc_id"]]], abs_tol=1e-5)
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(out) == len(ROWS) and all(abs(taken[s] - target[s]) <= max(size.values()) for s in names)
    assert sorted(map(str, out)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert mix(none).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, none, width):
    from folioscope.llm.minhash_dedup import near_groups

    sets = {}
    for i, t in RAW.items():
        w = WORD.findall((t or b"").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert sum(not w[2] for w in want.values()) >= 5
    assert got(near_groups(docs, width=width), "n_shingles", "component_id", "kept") == want
    assert near_groups(none).count() == 0


def test_components(spark):
    from folioscope.llm.minhash_dedup import components

    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 140)}


def test_language_id(docs, none):
    from folioscope.llm.language_id import fit, predict

    out = got(predict(docs, fit(docs)), "lang_pred", "score")
    letter = re.compile(r"[^\W\d_]")
    for i, t in RAW.items():
        lang, score = out[i]
        assert 0 <= score <= 1 and (lang == "und") == (t is None or not letter.search(t.decode())), i
        assert lang in ("und", "en", "de")
    assert predict(none, fit(none)).count() == 0 and predict(docs, fit(none)).where("lang_pred != 'und'").count() == 0


def test_language_accuracy(spark):
    from folioscope.llm.language_id import fit, predict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = predict(docs.where(held), fit(docs.where(~held))).where("lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert out > 0.95


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_lm_score(docs, none, depth):
    from folioscope.llm.lm_score import MIN_COUNT, score

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in RAW}
    toks = {i: [*WORD.findall((t or b"").translate(LOWER)), None] for i, t in RAW.items()}
    uni, tree = Counter(), defaultdict(Counter)
    for i, w in toks.items():
        if not held[i]:
            uni.update(w)
            for k, x in enumerate(w):
                for n in range(1, depth + 1):
                    if n <= k + 1:
                        tree[tuple((["^", *w])[k + 1 - n : k + 1])][x] += 1
    n, v = sum(uni.values()), len(uni)

    def prob(ctx, x):
        if not ctx:
            return (uni[x] + 1) / (n + v + 1)
        up, seen = prob(ctx[1:], x), tree[ctx]
        total = sum(seen.values())
        if total < MIN_COUNT or sum(c * math.log(c / total / prob(ctx[1:], y)) for y, c in seen.items()) < len(seen):
            return up
        return (seen[x] + len(seen) * up) / (total + len(seen))

    rows = docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)
    out = got(score(rows, depth=depth), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    states = 0
    for i, w in toks.items():
        base = sum(math.log10(prob((), x)) for x in w)
        full = sum(math.log10(prob(tuple((["^", *w])[max(0, k + 1 - depth) : k + 1]), x)) for k, x in enumerate(w))
        assert out[i][:4] == (held[i], len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(out[i][4], base, rel_tol=1e-9) and math.isclose(out[i][5], full, rel_tol=1e-9), i
        states += not math.isclose(base, full)
    assert states > 10
    assert score(none.withColumn("held_out", F.lit(False))).count() == 0


def test_repeated_and_null_ids(spark):
    """Rows that share an id, or have none, come back each."""
    from folioscope.llm.exact_dedup import exact_groups
    from folioscope.llm.lm_score import score
    from folioscope.llm.minhash_dedup import near_groups
    from folioscope.llm.mixing import mix
    from folioscope.llm.substring_dedup import substring_dedup
    from folioscope.llm.suffix_dedup import suffix_dedup
    from folioscope.llm.token_output import token_output

    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "other words", None), (None, "a b c", "s"), (None, None, None), (None, "x " * 60, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for f in (exact_groups, near_groups, mix, substring_dedup, suffix_dedup, token_output):
        assert f(df).count() == len(rows), f
    assert score(df.withColumn("held_out", F.lit(None).cast("boolean"))).count() == len(rows)
    near = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_groups(df).collect())
    assert near == sorted([("1", "1", True)] * 3 + [("None", "1", False), ("None", "None", True), ("None", "None", True)])
