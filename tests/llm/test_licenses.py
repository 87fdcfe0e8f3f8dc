"""License scan against brute force."""

import math
import re

from aeroscope.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, templates=licenses.TEMPLATES, rare=licenses.RARE, enough=licenses.ENOUGH):
    docs = [words_of(t) for t in texts]
    sets = [set(d) for d in docs]
    idf = {w: round(math.log((len(docs) + 1) / (sum(w in s for s in sets) + 1)) + 1, 9) for t in templates for w in t.words()}
    out = []
    for d in docs:
        base = [(i, label) for p, label in BASE.items() for i in range(len(d)) if d[i : i + len(p.split())] == p.split()]
        own, best = set(), 0.0
        for t in templates:
            tw, phrase = t.words(), t.phrase.split()
            index = sorted(set(tw), key=lambda w: (-idf[w], w))[:rare]
            at = {w: tw.index(w) for w in index}
            total = sum(idf[w] for w in index)
            for begin in {i - at[w] for i, w in enumerate(d) if w in at}:
                hit = [w for w in index if 0 <= begin + at[w] < len(d) and d[begin + at[w]] == w]
                p = begin + t.phrase_at()
                share = round(sum(idf[w] for w in hit) / total, 6)
                if p >= 0 and d[p : p + len(phrase)] == phrase and share >= enough:
                    own.add(t.label)
                    best = max(best, share)
        labels = {x for _, x in base}
        starts = [i for i, _ in base]
        out.append((
            len(d), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)),
            max(best, 0.5 if base else 0.0),
        ))
    return out


TEXTS = [
    None, "", "license", "MIT license", "Released under the MIT License. the MIT-license", "x general public license " * 3, "Apache License, Version 2.0 and Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under cc by nc 4 1", "Licensed under CC BY-NC 4.0.", "Ümit license mit é license public license",
    "word " * 50_000 + "Released under the MIT License", "license mit " * 20_000, "Released under the MIT License. the MIT-license",
    " ".join(licenses.TEMPLATES[5].words()), "gnu lesser general public license", *(t.notice.upper() for t in licenses.TEMPLATES), *["the quick brown fox is under this work"] * 30,
]


def same(a, b):
    return all(abs(x - y) < 1e-5 if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_brute_force(spark):
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, row int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    expected = brute(TEXTS)
    assert len(got) == len(TEXTS)
    for i, e in enumerate(expected):
        assert same(got[i], e), (TEXTS[i] and TEXTS[i][:80], got[i], e)


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, TEXTS[6]), (1, TEXTS[6]), (None, TEXTS[7])], "doc_id bigint, text string")
    got = licenses.scan(df)
    rows = [tuple(r)[1:] for r in got.collect()]
    assert sorted(r[5] for r in rows) == ["apache,apache-2.0", "apache,apache-2.0", "gpl,gpl-3.0"]
    assert licenses.scan(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
