"""Line dedup against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from aeroscope.llm import lines


def brute(rows, run, long_lines=False):
    """Texts without lines covered by a window, or a long line, that stands earlier; rows are (id, text) without equals."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), [None] * len(rows)
    for i in order:
        text = rows[i][1]
        if text is None:
            continue
        ls = text.split("\n")
        gone = set()
        places = [(s, run) for s in range(len(ls) - run + 1)]
        if long_lines and run > 1:
            places += [(s, 1) for s, x in enumerate(ls) if len(x) >= lines.LONG_CHARS or len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= lines.LONG_WORDS]
        for s, n in places:
            w = tuple(ls[s : s + n])
            if not any(re.search(r"[^\x20\x09-\x0D]", x) for x in w):
                continue
            if w in seen:
                gone |= set(range(s, s + n))
            seen.add(w)
        out[i] = "\n".join(x for j, x in enumerate(ls) if j not in gone)
    return out


ROWS = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\ny\nc\nd"), (3, None), (4, ""), (5, "a\nb\nc\nd"), (6, "a"), (7, "q\nq\nq\nq"), (8, "\n\n\na\n\n\n"), (9, "\n\n\nz\n\n\n"),
    (10, "\n".join(f"l{i % 97}" for i in range(20_000))), (11, "b\nc"), (None, "d\ne\nf"), (12, "e\nf\nd\ne\n"), (13, "a \nb"),
]


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_brute_force(spark, run):
    df = spark.createDataFrame([(t, i, "s", 5, "h") for i, t in ROWS], "text string, doc_id bigint, s string, spans int, selected string")
    got = lines.dedup_lines(df, run=run)
    assert got.columns == [*df.columns, "_spans"]
    assert {(r.doc_id, r.text) for r in got.collect()} == {(i, t) for (i, _), t in zip(ROWS, brute(ROWS, run))}


def test_equal_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (1, "a\nb\nc"), (2, "a\nb")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(df).collect())
    assert len(got) == 4
    assert sum(t.count("a\nb") for _, t in got) in (1, 2)  # one document's copy stays: the row pair's or the longer row's
    assert (2, "") in got
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    plan = lines.dedup_lines(df).withColumn("n", F.size("_spans"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_lines_are_repeats_of_their_own(spark):
    passage, script = " ".join(f"w{i}" for i in range(60)), "\u6587" * 120
    words = lambda n: " ".join(f"v{i}" for i in range(n))
    rows = [
        (1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd\n{passage}"), (3, passage), (4, f"{words(19)}\n{script}"), (5, words(19)), (6, words(20)), (7, f"{script}\ne\n\t{words(20)}"),
        (8, words(20)), (9, " " * 200), (10, " " * 200), (11, f"{passage}\nb\nf"), (None, passage),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r._spans) for r in lines.dedup_lines(df).collect()}
    assert {i: t for i, (t, _) in got.items()} == dict(rows) | {2: "c\nd", 3: "", 7: f"e\n\t{words(20)}", 8: "", 11: "f", None: ""}
    assert [tuple(x) for x in got[2][1]] == [(1, 1), (3, 3)] and [tuple(x) for x in got[11][1]] == [(0, 1)]
    assert {r.text for r in lines.dedup_lines(df, long_words=None).where("doc_id in (2, 3)").collect()} == {rows[1][1], passage}
