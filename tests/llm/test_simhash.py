"""Bit-sliced comparison, fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash

from aeroscope.llm import simhash


def ball(seed, n, spread):
    """Random fingerprints, many of them a few bits from each other."""
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(spread):
            out.add(x)
            for b in rng.integers(0, 64, size=int(rng.integers(0, 4))):
                x ^= 1 << int(b)
    return np.array(sorted(out)[:n], dtype=np.uint64)


def brute(a, b, radius):
    return {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= radius}


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
@pytest.mark.parametrize("sizes", [(5, 3), (70, 130), (200, 64)])
def test_near_is_exact(radius, sizes):
    a, b = ball(1, sizes[0], 6), ball(1, sizes[1], 6)
    found = {(int(i), int(j)) for q, c in simhash.near(a, b, radius) for i, j in zip(q, c)}
    assert found == brute(a, b, radius)


def test_forest_keeps_components():
    forest = simhash.Forest(6)
    kept = forest.add(np.array([0, 2, 0, 1]), np.array([1, 3, 1, 2])) + forest.add(np.array([0, 4]), np.array([3, 5]))
    assert len(kept) == 4
    assert len(set(forest.label.tolist())) == 2


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("tile,radius", [(4096, 4), (16, 4), (16, 2)])
def test_links_keep_components(spark, tile, radius):
    fps = ball(3, 400, 40)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = simhash.links(df, radius, tile).collect()
    as_int = [int(x) for x in fps.view(np.int64)]
    expected = roots(as_int, [(as_int[i], as_int[j]) for i, j in brute(fps, fps, radius) if i != j])
    assert roots(as_int, [(r.u, r.v) for r in found]) == expected


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \t", "One", "a b C", "a b c d", "Éa\x0bb\x0cç d e f\x1cg h", "x y " * 500, "word " * 30_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 4, 42) == plain(text)


def test_documents(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 6
    rows = [
        (5, base), (3, base.upper()), (9, base + "x"), (7, None), (8, ""), (7, None), (None, "quite another text of many words " * 4), (2, "lone words here that match nothing else at all"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fp = [plain(t or "") for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4]
    top = roots(range(len(rows)), links)
    ids = {r: min((rows[i][0] for i in top if top[i] == r and rows[i][0] is not None), default=None) for r in top.values()}
    assert got == {(rows[i][0], ids[top[i]]) for i in top}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(top.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
