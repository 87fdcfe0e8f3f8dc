"""Sequence scores, matching, clusters and percentiles against plain brute force."""

import json
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from aeroscope.functions import fuzzy
from aeroscope.idioms import carry, running, top_k_cosine
from aeroscope.operators import alert_eval, asr_eval, chunk_eval, extraction, kex_eval, matching


def brute_edits(ref, hyp):
    m, n = len(ref), len(hyp)
    d = [[i + j if not i * j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = d[i - 1][j - 1] if ref[i - 1] == hyp[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    i, j, s, de, ins = m, n, 0, 0, 0
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            continue
        best = min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
        if best == d[i - 1][j - 1]:
            s, i, j = s + 1, i - 1, j - 1
        elif best == d[i - 1][j]:
            de, i = de + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, de + i, ins + j, m - s - de - i


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_edit_operations(ref, hyp):
    assert fuzzy.edit_operations(ref, hyp) == brute_edits(ref, hyp)


def test_edit_operations_wide():
    random.seed(5)
    a = [random.choice("abcdef") for _ in range(400)]
    b = [random.choice("uvwxyz") for _ in range(330)]
    assert fuzzy.edit_operations(a, b) == brute_edits(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=15), st.text("abé", max_size=15))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j] + 1 if x == y else 0, row[j + 1], 0) for j, y in enumerate(b)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    assert fuzzy.lcs_length(a, b) == row[-1]


def brute_greedy(left, right, threshold):
    pairs = sorted((-fuzzy.ratio_of(a, b), i, j) for i, a in left for j, b in right if fuzzy.ratio_of(a, b) >= threshold)
    ui, uj, out = set(), set(), set()
    for s, i, j in pairs:
        if i not in ui and j not in uj:
            ui.add(i), uj.add(j), out.add((i, j))
    return out


def test_greedy_match_small_and_rounds(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 6)))
    left = [(g, i, word()) for g in (1, 2) for i in range(40)]
    right = [(g, j, word()) for g in (1, 2) for j in range(35)]
    l = spark.createDataFrame(left, "g int, i long, txt string")
    r = spark.createDataFrame(right, "g int, j long, txt string")
    want = {(g, i, j) for g in (1, 2) for i, j in brute_greedy([x[1:] for x in left if x[0] == g], [x[1:] for x in right if x[0] == g], 0.5)}
    got = {(x["g"], x["i"], x["j"]) for x in matching.greedy_match(l, r, ["g"], 0.5).collect()}
    assert got == want
    assert {(x["g"], x["i"], x["j"]) for x in matching.greedy_match(l, r, ["g"], 0.5, held=0).collect()} == want
    pairs = l.join(r, "g").select("g", "i", "j", fuzzy.indel_ratio(l["txt"], r["txt"]).alias("score")).where("score >= 0.5")
    rounds = {(x["g"], x["i"], x["j"]) for x in matching.greedy_pairs(pairs, ["g"], small=10).collect()}
    assert rounds == want


@pytest.mark.parametrize("seed", range(20))
def test_best_first_is_greedy(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab" if seed % 2 else "abcdeé ") for _ in range(rng.randint(0, 7)))
    pool = [word() for _ in range(12)]
    left = [(i, rng.choice(pool) if rng.random() < 0.7 else word()) for i in rng.sample(range(100), 30)]
    right = [(j, rng.choice(pool) if rng.random() < 0.7 else word()) for j in rng.sample(range(100), 25)]
    threshold = rng.choice([0.3, 0.5, 0.7, 1.0])
    found, _ = matching.best_first(matching.Side(*zip(*left)), matching.Side(*zip(*right)), threshold)
    assert {(i, j) for i, j, _ in found} == brute_greedy(left, right, threshold)
    text = dict(left), dict(right)
    assert all(s == fuzzy.ratio_of(text[0][i], text[1][j]) for i, j, s in found)


def test_tied_copies_are_one_text_pair(spark):
    left, right = [(1, i, "climb to level") for i in range(1000)], [(1, j, "climb to levels") for j in range(1000)]
    l, r = spark.createDataFrame(left, "g int, i long, txt string"), spark.createDataFrame(right, "g int, j long, txt string")
    got = matching.greedy_match(l, r, ["g"], 0.5).collect()
    assert {(x["i"], x["j"]) for x in got} == {(i, i) for i in range(1000)}
    found, scored = matching.best_first(matching.Side(*zip(*[x[1:] for x in left])), matching.Side(*zip(*[x[1:] for x in right])), 0.5)
    assert scored == 1 and len(found) == 1000


def test_few_pairs_are_scored_where_texts_have_near_copies():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha bravo climb level turn heading runway contact tower descend".split()) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(60)]
    left, right = list(enumerate(texts)), [(j, t[1:]) for j, t in enumerate(texts)]
    found, scored = matching.best_first(matching.Side(*zip(*left)), matching.Side(*zip(*right)), 0.5)
    assert {(i, j) for i, j, _ in found} == brute_greedy(left, right, 0.5) and scored < 60 * 60 / 10


def test_clusters(spark):
    random.seed(11)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([("r", "k", u, v) for u, v in edges], "run string, kind string, u long, v long")
    got = {r["node"]: r["cluster"] for r in kex_eval.clusters(df).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_cluster_stats(spark):
    rows = spark.createDataFrame(
        [("r", 1.0, "entity", i, i, k, k) for i, k in enumerate(["a", "a", "a", "b", "c"])],
        "run string, page double, kind string, n long, seq long, key string, exact string",
    )
    v = spark.createDataFrame([("r", "entity", 2, 3, 0.9, True), ("r", "entity", 0, 1, 0.5, False)], "run string, kind string, i long, j long, score double, is_duplicate boolean")
    labels = kex_eval.clusters(kex_eval.duplicate_edges(rows, v))
    s = kex_eval.cluster_stats(labels, rows, v).first()
    # edges: (0,1)=0.5 judged, (0,2)=(1,2)=1 by key, (2,3)=0.9 judged
    assert s["size"] == 4 and abs(s["avg_similarity"] - (0.5 + 1 + 1 + 0.9) / 4) < 1e-9
    d = {r["kind"]: r for r in kex_eval.duplication(rows, kex_eval.cluster_stats(labels, rows, v)).collect()}
    assert d["entity"]["unique_items"] == 1 and d[None]["duplication_rate"] == 0.8


def test_wer_rows(spark):
    df = spark.createDataFrame([("m", 1, "a b c", "a x c d"), ("m", 2, "", "x"), ("m", 3, "a b", "")], "model string, sample_id long, ref string, hyp string")
    got = {r["sample_id"]: r for r in asr_eval.measures(df).collect()}
    assert got[1]["wer"] == 2 / 3 and (got[1]["substitutions"], got[1]["insertions"], got[1]["hits"]) == (1, 1, 2)
    assert got[2]["wer"] == 1.0 and got[2]["num_ref_words"] == 0 and got[2]["mer"] is None
    assert got[3]["wer"] == 1.0 and got[3]["wip"] == 0.0


def test_latency_percentiles(spark):
    random.seed(2)
    vals = [random.choice([0.0, -1.0, random.random() * 1000, 5.0]) for _ in range(997)]
    got = alert_eval.latency_stats(spark.createDataFrame([("c", v) for v in vals], "c string, ms double"), ["c"]).first()
    s = sorted(v for v in vals if v > 0)
    assert got["count"] == len(s)
    assert (got["p50"], got["p95"], got["p99"]) == (s[len(s) // 2], s[int(len(s) * 0.95)], s[int(len(s) * 0.99)])


def test_running_blocks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["s"] for r in running(df, ["k"], "id", {"s": F.col("v")}, block=64).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    q, it = rng.normal(size=(30, 8)), rng.normal(size=(200, 8))
    qs = spark.createDataFrame([("g", i, i * 5, [float(x) for x in v]) for i, v in enumerate(q)], "grp string, q_id long, q_seq long, q_vec array<double>")
    its = spark.createDataFrame([("g", i, i, [float(x) for x in v]) for i, v in enumerate(it)], "grp string, i_id long, i_seq long, i_vec array<double>")
    got = {}
    for r in top_k_cosine(qs, its, 4, before=True, block=16).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["i_id"]))
    for i, v in enumerate(q):
        c = it[: i * 5]
        if len(c):
            s = c @ v / (np.linalg.norm(c, axis=1) * np.linalg.norm(v))
            assert [x for _, x in sorted(got[i])] == list(np.argsort(-s, kind="stable")[:4])


def test_chunk_integrity(spark):
    m = spark.createDataFrame([("m", 1.0, 0, "One is."), ("m", 1.0, 1, "Two is"), ("m", 1.0, 2, "here. Three.")], "model string, page double, chunk int, text string")
    assert abs(chunk_eval.page_integrity(m).first()["boundary_integrity"] - 2 / 3) < 1e-9
    s = spark.createDataFrame([(0, "One is."), (1, "Two is here."), (2, "Three.")], "seq int, text string")
    assert abs(chunk_eval.document_integrity(m, s).first()["boundary_integrity"] - 2 / 3) < 1e-9


def quadratic_scan(text):
    """A scan of the rest of the text from every brace."""
    start = text.find("{")
    while start >= 0:
        depth, quote, skip = 0, "", False
        for pos in range(start, len(text)):
            c = text[pos]
            if skip:
                skip = False
            elif quote:
                skip, quote = c == "\\", "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        if json.loads(text[start : pos + 1]):
                            return text[start : pos + 1]
                    except ValueError:
                        pass
                    break
        start = text.find("{", start + 1)
    return None


def test_one_pass_finds_the_same_json():
    rng = random.Random(18)
    parts = ["{", "}", '"', "'", "\\", "a", " ", "1", ":", '{"a":1}', "{'b'", '{"c":"}"}', "{}"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert extraction._scan_balanced(text) == quadratic_scan(text), text


def test_a_megabyte_of_braces_takes_one_pass():
    start = time.process_time()
    for text in ("{" * 1_000_000, "{" * 300_000 + "}" * 300_000, '{"' * 300_000):
        assert extraction._scan_balanced(text) is None
    assert extraction._scan_balanced('{\\"\'' * 100_000 + '{"ok": 1}') == '{"ok": 1}'
    assert time.process_time() - start < 60


def test_first_json(spark):
    cases = {
        'x ```json\n{"a": 1}\n``` {"b": 2}': '{"a": 1}',
        'pre {bad} {"k": "}"} post': '{"k": "}"}',
        "none": None,
        '{} {"z": [1, {"y": 2}]}': '{"z": [1, {"y": 2}]}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["j"] for r in df.select("t", extraction.first_json(F.col("t")).alias("j")).collect()} == cases


def test_lines_keep_digits(spark):
    df = spark.createDataFrame([("1 one\n2 two 10\n",)], "t string")
    assert df.select(extraction.segments(F.col("t"), "line")).first()[0] == ["1 one", "2 two 10"]


def test_asr_modes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sample_id long, text string")
    h = spark.createDataFrame([("m", 1, "a"), ("n", 2, None)], "model string, sample_id long, text string")
    assert asr_eval.pair_samples(t, h).count() == 2
    got = {(r["model"], r["sample_id"]): r["hyp"] for r in asr_eval.pair_samples(t, h, "any_model").collect()}
    assert got == {("m", 1): "a", ("m", 2): "", ("n", 1): "", ("n", 2): ""}


def test_chunk_audit_orders_by_page_then_chunk(spark):
    """Chunk numbers far beyond a thousand stay inside their page."""
    from aeroscope.operators import extraction

    chunks = spark.createDataFrame([("r", 1.0, 1600), ("r", 2.0, 500), ("r", 1.5, 3)], "run string, page double, chunk int")
    seen = spark.createDataFrame([("r", 1.0, 1600, "a"), ("r", 2.0, 500, "b")], "run string, page double, chunk int, id string")
    got = {(x["page"], x["chunk"]): x["entity_total"] for x in extraction.chunk_audit({"entity": seen}, chunks).collect()}
    assert got == {(1.0, 1600): 1, (1.5, 3): 1, (2.0, 500): 2}


def test_long_triggers_are_different_records(spark):
    from aeroscope.operators import extraction

    same = "keep the distance of five miles from every other aircraft "
    rows = [("r", 1.0, 0, i, "altitude", same + end) for i, end in enumerate(("below", "above", "below"))]
    df = spark.createDataFrame(rows, "run string, page double, chunk int, idx int, rule_type string, trigger_text string")
    assert sorted(x["idx"] for x in extraction.accumulate(df, "krule").collect()) == [0, 1]


def test_positions_do_not_collide(spark):
    from aeroscope.operators import kex_eval

    df = spark.createDataFrame([("gt", 1.0, 0, 100_000, 1, "a"), ("gt", 1.0, 1, 0, 2, "b")], "run string, page double, chunk int, idx int, seq int, text string")
    assert kex_eval.keyed({"entity": df}).select("n").distinct().count() == 2


def test_ids_that_repeat_over_pages(spark):
    """Each record is resolved by its own references."""
    from aeroscope.operators import knowledge

    rules = spark.createDataFrame(
        [("r", 1.0, 0, 0, "RULE001", ["E001"], "see E001"), ("r", 2.0, 0, 0, "RULE001", ["E002", "E001"], "see E001 and E002")],
        "run string, page double, chunk int, idx int, id string, refs array<string>, said string",
    )
    entities = spark.createDataFrame(
        [("r", 1.0, 0, 0, "E001", "one"), ("r", 1.0, 0, 1, "E002", "old"), ("r", 2.0, 0, 0, "E002", "two")],
        "run string, page double, chunk int, idx int, id string, text string",
    )
    none = spark.createDataFrame([], "run string, page double, chunk int, idx int, id string, subject_text string, predicate string, object_text string")
    got = {x["page"]: x["resolved"] for x in knowledge.resolve_ids(rules, "refs", entities, F.col("text")).collect()}
    assert got == {1.0: ["one"], 2.0: ["two", "one"]}
    texts = {x["page"]: x["resolved_text"] for x in knowledge.resolve_text(rules, "said", entities, none).collect()}
    assert texts == {1.0: 'see "one"', 2.0: 'see "one" and "two"'}


def test_carry_over_blocks(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.choice([None, None, None, f"v{k}{p}"])) for k in ("a", None, "b") for p in rng.sample(range(-50, 400), 120)]
    df = spark.createDataFrame(rows, "k string, p bigint, v string")
    for block in (7, 50, 10_000):
        for before in (False, True):
            got = {(r.k, r.p): r.last for r in carry(df, ["k"], "p", {"last": F.col("v")}, block, before).collect()}
            for k, p, _ in rows:
                seen = [v for q, v in sorted((q, v) for key, q, v in rows if key == k and v and (q < p or q == p and not before))]
                assert got[k, p] == (seen[-1] if seen else None)


def test_top_k_by_slices(spark):
    """Copies of a vector tie and go by seq; ids may be texts; queries may want different numbers; no pair of blocks is held."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(7, 5)).astype(np.float32)
    vecs = [base[i % 7] if i % 11 else None for i in range(150)]
    qs = spark.createDataFrame([(g, f"q{i}", i, [float(x) for x in base[i % 7]], i % 4) for g in "ab" for i in range(0, 150, 3)], "grp string, q_id string, q_seq long, q_vec array<float>, want int")
    its = spark.createDataFrame([(g, f"i{i}", i, None if v is None else [float(x) for x in v]) for g in "ab" for i, v in enumerate(vecs)], "grp string, i_id string, i_seq long, i_vec array<float>")
    rows = top_k_cosine(qs, its, F.col("want"), before=True, block=16)
    got = {}
    for r in rows.collect():
        got.setdefault((r.grp, r.q_id), []).append((r["rank"], r.i_id))
    doubles = base.astype(float)
    cos = {(a, b): float(np.round(doubles[a] @ doubles[b] / np.linalg.norm(doubles[a]) / np.linalg.norm(doubles[b]), 12)) for a in range(7) for b in range(7)}
    for g in "ab":
        for i in range(0, 150, 3):
            order = sorted(range(i), key=lambda j: (1.0 if vecs[j] is None else -cos[i % 7, j % 7], j))
            assert [x for _, x in sorted(got.get((g, f"q{i}"), []))] == [f"i{j}" for j in order[: i % 4]]
    assert "collect_list" not in rows._jdf.queryExecution().analyzed().toString()


def test_equal_pairs_are_scored_once(spark):
    """Scores of copies, nulls and empty texts are those of each pair by itself; texts are normalised before any sample id is there."""
    from aeroscope.operators import asr_eval as asr

    said = ["climb FL090", "turn left", "", None, "climb FL090"]
    truth = spark.createDataFrame([(i, said[i % 5]) for i in range(20)], "sample_id long, text string")
    heard = spark.createDataFrame([(m, i, said[(i + (m == "b") * (i % 3)) % 5]) for m in "ab" for i in range(20)], "model string, sample_id long, text string")
    for mode in ("intersection", "any_model"):
        got = asr.score_asr(truth, heard, mode)
        alone = asr.measures(asr.pair_samples(truth, heard, mode, True))
        assert got.columns == alone.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, alone.collect())) and got.count() == 40
        assert "word_edits" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_need_no_bounds(monkeypatch):
    """Equal texts are paired before any bound is drawn up, copies in the order of their ids."""
    asked = []
    own = matching.bounds
    monkeypatch.setattr(matching, "bounds", lambda left, right: asked.append((len(left), len(right))) or own(left, right))
    left = [(i, f"text {i % 40}") for i in range(100)] + [(200, "climb to levels")]
    right = [(j, f"text {j % 40}") for j in range(100)] + [(300, "climb to level")]
    found, scored = matching.best_first(matching.Side(*zip(*left)), matching.Side(*zip(*right)), 0.7)
    assert {(i, j) for i, j, _ in found} == {*((i, i) for i in range(100)), (200, 300)} == brute_greedy(left, right, 0.7)
    assert asked == [(1, 1)] and scored == 1


def test_groups_that_run_over_batches(spark):
    """Sorted groups stream by: they may end anywhere in a batch, be one-sided, or have null or NaN keys."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    nan = float("nan")
    left = [(g, p, i, f"level {i} of {g}") for g in "abc" for p in (0.0, 1.0, nan) for i in range(5)] + [(None, 1.0, 1, "x"), ("d", 1.0, 1, "x"), ("a", 2.0, 1, None)]
    right = [(g, p, j, f"levels {j} of {g}" if j % 2 else f"level {j} of {g}") for g in "abc" for p in (-0.0, 1.0, nan) for j in range(7)] + [(None, 1.0, 1, "x"), ("a", 2.0, 1, None)]
    l, r = (spark.createDataFrame(rows, f"g string, p double, {n} long, txt string") for rows, n in ((left, "i"), (right, "j")))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = matching.greedy_match(l, r, ["g", "p"], 0.6).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for g in "abc":
        for p in ("0.0", "1.0", "nan"):
            want = brute_greedy([(x[2], x[3]) for x in left if x[0] == g and str(x[1]) == p], [(x[2], x[3]) for x in right if x[0] == g and str(abs(x[1])) == p], 0.6)
            assert {(x["i"], x["j"]) for x in got if x["g"] == g and str(abs(x["p"])) == p} == want and len(want) == 5
    assert len(got) == 45
