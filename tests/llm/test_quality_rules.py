"""Signals against brute force, and the label model against labels that it never saw."""

import re

import numpy as np
import pytest

from aeroscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@pytest.mark.parametrize("text", [
    "", " \n\t", "a", "a b c a b c a", "a a a a a", "x y z\nx y z\n\nx y z \n", "É\x1cç # | <b> ñ\x0bé\x0c\r\n a", "one two three four one two three five " * 3, "a b c d",
])
def test_signals(text):
    assert quality.signals(text)[:5] == plain(text)


def test_fit_finds_accuracies():
    rng = np.random.default_rng(7)
    good = rng.random(20_000) < 0.7
    true = np.array([0.95, 0.9, 0.85, 0.6])
    right = rng.random((len(good), 4)) < true
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 4)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(np.array(model.on_good) - true).max() < 0.04
    assert np.abs(np.array(model.on_bad) - true).max() < 0.06


def test_edges(spark):
    prose = "The quick brown fox jumps over lazy dogs while seven small children watch them from behind the old garden wall. "
    words = prose + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + "."
    rows = [(1, None), (2, ""), (3, words), (3, words), (None, words), (4, "a b c " * 40_000), (5, "$$$ ### |||| " * 10 + words)]
    df = spark.createDataFrame([(i, t, True, 0) for i, t in rows], "doc_id bigint, text string, kept boolean, n_words int")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].base_failed and by[2].base_failed and not by[1].kept and by[4].base_failed
    assert by[3].kept and by[None].kept and by[3].posterior == by[None].posterior
    assert quality.judge(df.limit(0)).count() == 0


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.posterior for r in got if r.quality]
    bad = [r.posterior for r in got if not r.quality]
    assert np.mean([x >= 0.5 for x in good]) > 0.98
    assert np.mean([x < 0.5 for x in bad]) > 0.9
