"""Multiple-instance learning: held-out accuracy, located sentences and edge cases."""

import random
import zlib

import numpy as np

from aeroscope.llm import toxicity

BAD = ["vileword", "grotwort", "sloeren"]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "in", "ed", "ing", "st", "ou"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        said = [" ".join(word() for _ in range(rng.randint(4, 15))).capitalize() + "." for _ in range(rng.randint(1, 30))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            at = rng.randrange(len(said))
            said[at] = f"{word()} {rng.choice(BAD)}{rng.choice(['', 'an', 'en'])} {word()}."
        out.append((i, " ".join(said), toxic))
    return out


def test_held_out_accuracy_and_location(spark):
    rows = corpus(1, 1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (99_999, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.judge(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.99
    found = toxicity.locate(docs, model).collect()
    text = {i: t for i, t, _ in rows}
    assert {r.doc_id for r in found if truth[r.doc_id]} == {i for i in truth if truth[i] and got[i].predicted}
    assert np.mean([any(b in text[r.doc_id][r.start : r.end] for b in BAD) for r in found]) > 0.98


def test_labels_of_held_out_documents_do_not_matter(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    honest = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    lied = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert toxicity.train(docs, honest) == toxicity.train(docs, lied)


def test_edges(spark):
    model = toxicity.Model(-3.0, {"=vileword": 9.0})
    rows = [(1, None), (2, ""), (3, "vileword"), (3, "vileword"), (None, "Fine. A VileWord! Fine."), (4, "fine " * 100_000 + "vileword"), (5, "ok.vileword.ok")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, predicted int")
    got = toxicity.judge(df, model).collect()
    assert sorted(r.predicted for r in got) == [0, 0, 1, 1, 1, 1, 1]
    assert all(0 <= r.score <= 1 for r in got)
    none = next(r for r in got if r.doc_id is None)
    assert "Fine. A VileWord! Fine."[none.worst_start : none.worst_end].strip() == "A VileWord!"
    assert toxicity.judge(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    blank = toxicity.train(df.limit(0), empty)
    assert blank.weights == {} and [r.predicted for r in toxicity.judge(df, blank).collect()] == [0] * 7


def test_spans_cover_the_text():
    for text in ("", "a", "A. B! C", "...", "x\n\ny?z", "no end"):
        spans = list(toxicity.sentences(text))
        assert "".join(text[a:b] for a, b in spans) == text


def test_tokens_cut_by_a_sentence_end():
    model = toxicity.Model(-3.0, {"=idiot": 9.0, "=vileword": 4.0, "=mild": 0.5})
    scorer = model.scorer()
    assert scorer.score('He said "you idiot!" and left.') > 0.9
    for text in ('"You idiot!" he said.', "a vileword.Next one", "mild then ok.idiot", "(mild vileword.) mild", "vileword.***", "x.idiot.y mild", " .idiot", "idiot", "A. B\nidiot\n"):
        plain = []
        for a, b in toxicity.sentences(text):
            z = sum(model.weights.get(f, 0.0) for t in set(text[a:b].split()) for f in toxicity.features(t))
            if z:
                plain.append((a, b, 1 / (1 + float(np.exp(-model.bias - z)))))
        assert scorer.spans(text) == plain, text
