"""Suffix dedup against brute force."""

import hashlib
import random

import pytest

from aeroscope.llm import suffixes


def brute(texts, least):
    """Per text: bytes, removed, spans, hash of the rest."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for s in range(len(d) - least + 1):
            seen[d[s : s + least]] = seen.get(d[s : s + least], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - least + 1):
            if seen[d[s : s + least]] > 1:
                gone[s : s + least] = b"\1" * least
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n, passage):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(passage)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            cut = rng.randint(0, len(p))
            parts += [" ".join(word() for _ in range(rng.randint(0, 20))), rng.choice([p, p[:cut], p[cut:], p[: cut // 2] + "X" + p[cut // 2 :]])]
        out.append("".join(parts))
    return [*out, None, "", out[0], "a" * 500, "ab" * 300, "x" * 12, out[1] + out[1]]


@pytest.mark.parametrize("least,gram,batches", [(40, 8, 4), (25, 32, 1), (64, 16, 7)])
def test_brute_force(spark, least, gram, batches):
    rows = texts(least, 60, 30)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(rows)], "doc_id bigint, text string, row int, s string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, least=least, gram=gram, batches=batches).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, least)


def test_repeated_rows_and_null_ids(spark):
    p = "some passage that is long enough to count as one here"
    rows = [(1, p), (1, p), (None, p + " more"), (2, "other"), (None, "q" * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, least=20, gram=8).collect())
    assert got == sorted(brute([t for _, t in rows], 20))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_levels_grow_geometrically(spark):
    docs = suffixes.keyed(spark.createDataFrame([(i, t) for i, t in enumerate(texts(3, 40, 40))], "doc_id bigint, text string"), "doc_id", "text")
    entries = suffixes.suffixes(docs, 40, 8).cache()
    family = suffixes.SuffixFamily(spark, suffixes.ENTRY.format(id="bigint"))
    for i in range(6):
        family.add(entries.where(f"pmod(row, 6) = {i}"))
        sizes = sorted(x.size for x in family.levels)
        assert all(b > 2 * a for a, b in zip(sizes, sizes[1:]))
    assert sum(x.size for x in family.levels) == entries.count()


def test_pieces_of_a_long_text():
    sampler = suffixes.Sampler(200, 32)
    rng = random.Random(5)
    text = bytes(rng.randrange(256) for _ in range(suffixes.PIECE + 5000))
    found = list(sampler.entries(text))
    windows = [s + i for _, _, s, n, _ in found for i in range(n)]
    assert windows == list(range(len(text) - 199))


def test_a_long_text_without_repeats_stays_whole(spark):
    rng = random.Random(11)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3 * suffixes.PIECE + 5000))
    cells = [(s + o, s, n) for _, _, s, n, o in suffixes.Sampler(200, 32).entries(text.encode())]
    assert len({p for p, _, _ in cells}) == len(cells)  # one entry per sampled suffix
    df = spark.createDataFrame([(1, text), (2, "short and other")], "doc_id bigint, text string")
    assert [r.n_removed for r in suffixes.remove_repeats(df).collect()] == [0, 0]
