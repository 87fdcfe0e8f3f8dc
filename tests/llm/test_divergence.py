"""Divergence of sources against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from aeroscope.llm import divergence


def brute(rows, least, top):
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    n, total, docs, groups = {}, {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low))
        n.setdefault((lang, source), Counter()).update(found)
        total.setdefault(lang, Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, source in groups:
        kept = [w for w, d in docs[lang].items() if d >= least]
        p = lambda c: [1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept]
        own, all_ = p(n[lang, source]), p(total[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(s, sum(map(f, own, p(n[l, s])))) for l, s in groups if l == lang and s != source]
        terms = [(w, f(a, b)) for w, a, b in zip(kept, own, all_) if n[lang, source][w] and a > b]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, i, v, k) for k, (i, v) in enumerate(found, 1)]
    return sorted(out)


def made(seed, docs, sources):
    rng = random.Random(seed)
    words = ["The", "été", "naïve", "a1b", "x-y", "ÀÉ", "文字", "Zz", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    rows = []
    for _ in range(docs):
        lang = rng.choice(["en", "en", "de", None, "fr"])
        n = 0 if lang == "fr" else rng.choice([0, 1, 5, 60])
        rows.append((rng.choice([" ".join(rng.choice(words[: rng.choice([5, 208])]) for _ in range(n))] * 9 + [None]), lang, rng.choice([*sources, None])))
    return rows


@pytest.mark.parametrize("seed,tile,least", [(2, 50, 1), (3, 2048, 10)])
def test_brute_force(spark, seed, tile, least):
    rows = made(seed, 300, [f"s{i}" for i in range(6)])
    df = spark.createDataFrame([(*r, 1, {"k": 1}, "x") for r in rows], "text string, lang string, source string, n int, size map<string,int>, `term.a` string").repartition(3)
    got = divergence.audit(df, least=least, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, divergence.TOP)


def test_blocks_of_sources(spark):
    rows = made(7, 300, [f"s{i}" for i in range(divergence.SIDE + 5)])
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df, least=2).collect())) == brute(rows, 2, divergence.TOP)


def test_empty_table_long_texts_and_slices(spark, monkeypatch):
    df = spark.createDataFrame([("x", "en", "a")], "text string, lang string, source string")
    assert divergence.audit(df.limit(0)).count() == 0
    text = ("Ab çd " * 1000 + "e" * 5000 + "7").encode()
    monkeypatch.setattr(divergence, "SLICE", 777)
    found = [w for part in divergence.terms(text) for w in part]
    assert found == ["ab".encode(), "çd".encode()] * 1000 + [b"e" * 5000]


@pytest.mark.parametrize("seed", range(8))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    rows = rng.choice([-1, 0, 0, 0, 1, 2, 50], size=(6, 1 << rng.integers(0, 9)))
    rows[1] = rows[0]
    forest = divergence.Forest(rows)
    calls = []

    def price(a, b):
        calls.append(len(a))
        return abs(forest.leaves[a] - forest.leaves[b])

    for i in range(6):
        for j in range(6):
            assert forest.walk(forest.roots[i], forest.roots[j], price) == abs(rows[i] - rows[j]).sum()
    assert forest.roots[0] == forest.roots[1]
    assert max(calls) <= len(forest.leaves) ** 2  # a pair of leaves is priced once
    same = divergence.Forest(np.zeros((5, 256), dtype=int))
    assert same.nodes() == 9  # one node a level
