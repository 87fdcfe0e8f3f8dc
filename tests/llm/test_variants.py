"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aeroscope.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, out = {}, []
    for w in n:
        best = min(((-n[v], v) for v in n if near(w, v)), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], sum(near(w, v) for v in n), n.get(form[w])))
    return sorted(out)


def edited(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abeéßÀ÷z")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["listen", "silent", "enlist", "a" * 40, "aaaaaa", "Übungen"]
    pool = []
    for w in base:
        more = [edited(rng, w) for _ in range(8)]
        pool += [w] * 60 + more * 3 + [edited(rng, v) for v in more if v]
    rng.shuffle(pool)
    return [(i, rng.choice(["; ", " ", "9", "ł", "文"]).join(pool[i::80])) for i in range(80)]


@pytest.mark.parametrize("seed,cell,sample", [(1, 4096, 50_000), (2, 8, 40), (3, 3, 1000)])
def test_brute_force(spark, seed, cell, sample):
    rows = [*made(seed), (None, "listen Listen LISTEN"), (None, None), (500, ""), (501, "silent " * 700), (501, "silent " * 700)]
    df = spark.createDataFrame([(*r, 1, {"k": 1}, "x") for r in rows], "doc_id bigint, text string, n int, word map<string,int>, `a.best` string").repartition(3)
    got = variants.variants(df, cell=cell, sample=sample)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, expected = sorted(map(tuple, got.collect())), brute(rows)
    assert got == expected and sum(r[1] is not None for r in expected) >= 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert variants.variants(df).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_searches_lose_nothing(seed, monkeypatch):
    monkeypatch.setattr(variants, "LEAF", 4)
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abcé"[: 2 + seed % 3]) for _ in range(rng.randint(6, 8))) for _ in range(400)})
    for n in (6, 7, 8):
        points, queries = [w for w in words if len(w) == n], [w for w in words if abs(len(w) - n) <= 1]
        got = [(queries[a], points[b]) for q, p in variants.near_pairs(points, queries) for a, b in zip(q.tolist(), p.tolist())]
        assert sorted(got) == sorted((a, b) for a in queries for b in points if near(a, b))


def test_chains_of_forms(spark):
    steps = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)]
    df = spark.createDataFrame(steps, "word string, form string")
    got = dict(map(tuple, variants.follow(df, 5 * 5**21).collect()))
    assert got == {w: "w20" for w, _ in steps}


def test_slices(monkeypatch):
    monkeypatch.setattr(variants, "SLICE", 10)
    text = "abcdefghij klmÜü " * 9 + "x" * 50 + "9y"
    assert [w for part in variants.runs(text) for w in part] == [b"abcdefghij", "klmÜü".encode("latin-1")] * 9 + [b"x" * 50, b"y"]


def test_vectors_of_long_words():
    word = "abÿ" * 300
    assert np.array_equal(variants.vectors(variants.codes([word]))[0][variants.AXIS[[97, 98, 255]]], [300, 300, 300])
