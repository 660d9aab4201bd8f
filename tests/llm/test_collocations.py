"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

SCHEMA = "score int, lang string, text string, phrase string, `n.x` int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, longest=3, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    found, inside = [], set()
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            score, k = min((1000000 * a * a // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1))
            found.append((p, a, f[p[: 1 + k]], f[(p[0], *p[1 + k :])], score))
            inside |= {q for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if 100 * a >= percent * f[q := (p[0], *p[i : i + m])]}
    out, rank = [], Counter()
    for p, a, l, r, score in sorted(found, key=lambda x: (-x[4], -x[1], " ".join(x[0][1:]).encode())):
        if p not in inside and rank[p[0]] < top:
            rank[p[0]] += 1
            out.append((p[0], rank[p[0]], " ".join(p[1:]), a, l, r, n[p[0]], score))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "Ünï", "x", "日本", "it's", "\x00", "b", "c", "new york city", "in the middle of"]
    gaps = [" "] * 8 + ["\t", "  ", ". ", ",", "\n", " !", "\x0b"]
    make = lambda: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 120)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und", "", "x.y z\n"]), make()) for _ in range(n)]
    return rows + [("en", None), (None, None), ("en", ""), ("fr", ". ,"), *rows[:20], ("en", "ha " * 3000), ("de", "q" * 70000)]


def run(spark, rows, parts=3, **kw):
    from folioscope.llm.collocations import collocations

    return sorted(tuple(r) for r in collocations(spark.createDataFrame([(0, lang, t, "p", 1) for lang, t in rows], SCHEMA).repartition(parts), **kw).collect())


def test_collocations(spark):
    rows = texts(1)
    got = run(spark, rows)
    assert got == plain(rows) and len(got) > 50
    assert run(spark, [], parts=1) == [] and run(spark, [("en", None), ("en", " ")], parts=2) == []


@pytest.mark.parametrize("kw", [dict(least=2, longest=5, percent=30, top=40), dict(least=1, longest=2, percent=50, top=10**6), dict(least=40, longest=4, percent=100, top=3)], ids=str)
def test_other_limits(spark, kw):
    rows = texts(2, 50)
    assert run(spark, rows, parts=7, **{"inside_percent" if k == "percent" else k: v for k, v in kw.items()}) == plain(rows, **kw)


def test_equal_hashes(monkeypatch):
    """Words whose hashes are all equal are still told apart, within a kind and between kinds."""
    from folioscope.llm import collocations as c

    data, size = c.joined([b"a", b"bb", b"a", b"c", b"bb", b"a"])
    kind = np.array([0, 0, 0, 1, 1, 0])
    monkeypatch.setattr(c, "word_hashes", lambda d, a, b: np.zeros(len(a), np.uint64))
    rep, slot, h = c.grouped(data, *c.parted(data, size), kind, [b"en", b"de"])
    assert slot.tolist() == [0, 1, 0, 2, 3, 0] and rep.tolist() == [0, 1, 3, 4] and len(set(h.tolist())) == 1


def test_scores_pass_64_bits():
    from folioscope.llm.collocations import scored

    a = 4 * 10**12
    assert scored(a, [(a * 3, a * 5), (a * 2, a * 9), (a * 15, a)]) == (1000000 // 18, a * 2, a * 9)
    assert scored(a, [(a * 3, a * 5), (a * 15, a)])[1:] == (a * 3, a * 5)


def test_many_words(spark):
    """More pairs times words than 32 bits hold, in one block."""
    words = [f"w{k}" for k in range(50_000)]
    rows = [("en", " ".join(words)), ("en", " ".join(words[::-1]))]
    assert run(spark, rows, parts=1, least=1, top=10**6) == plain(rows, least=1, top=10**6)
