"""Best-fit decreasing against a plain version; token ids against the library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from aeroscope.llm import packing, tokens

VOCABULARY = tokens.vocabulary_path()


def plain(lengths, size):
    """Free capacity of each window, one piece at a time."""
    windows = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i, room in enumerate(windows) if room >= n), key=lambda i: windows[i], default=None)
        if best is None:
            windows.append(size)
            best = -1
        windows[best] -= n
    return sorted(windows)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 8, 32, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, windows = sorted(packing.plan_windows(histogram, size)), {}
    for i, (n, first, window, each, offset) in enumerate(plan):
        last = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else histogram[n]
        for rank in range(first, last):
            nth = rank - first
            windows.setdefault(window + nth // each, []).append((offset + nth % each * n, n))
    assert sum(map(len, windows.values())) == len(lengths)
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
    assert sorted(size - sum(n for _, n in p) for p in windows.values()) == plain(lengths, size)
    assert sorted(windows) == list(range(len(windows)))


TEXTS = [
    None, "", " ", "Hello, World! it's 42", "naïve Ångström İstanbul ﬁ é é", "a\x1cb c d e\x85f", "<|endoftext|> in a text", "don't we'll I'VE", "x" * 9000,
    "word " * 5000, "日本語 テキスト", "!! ! !?! a!b", "same text", "same text", "tab\tline\nend",
]


def test_ids_are_the_library_s():
    library = Tokenizer.from_file(VOCABULARY)
    texts = [t or "" for t in TEXTS]
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.encoder(VOCABULARY)(texts) == expected
    assert tokens.encoder(VOCABULARY)(texts) == expected  # once more, all words known


@pytest.mark.parametrize("size", [7, 2048])
def test_pieces(spark, size):
    library = Tokenizer.from_file(VOCABULARY)
    rows = [(i // 2 if i != 3 else None, t, 1, "z") for i, t in enumerate(TEXTS)] + [(0, None, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int, rank string").repartition(3)
    got = packing.pack(df, VOCABULARY, size=size).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), size):
            piece = np.array(ids[at : at + size], dtype="<u4").tobytes()
            expected.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), len(ids)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in got)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(size - sum(n for _, n in p) for p in windows.values()) == plain([e[2] for e in expected], size)
    assert packing.pack(df.limit(0), VOCABULARY, size=size).count() == 0


def test_ids_of_all_scripts_and_long_texts(monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    texts = [f"a{chr(i)}b{chr(i)} {chr(i)}x" for i in range(0, 0x3100, 3)] + ["ΟΔΟΣ ΣΑΣ. ΑΣ Σ", "İI ß ẞ Å é́", " ́x ́", "one two, " * 3000, "x" * 40_000]
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.encoder(VOCABULARY)(texts) == expected
    tokens.encoder.cache_clear()
    monkeypatch.setattr(tokens, "KNOWN", 100)
    monkeypatch.setattr(tokens, "LEARNT", 7)
    assert [x for i in range(0, len(texts), 50) for x in tokens.encoder(VOCABULARY)(texts[i : i + 50])] == expected
    tokens.encoder.cache_clear()
