"""Every stage against brute force on its own input, on the smallest data set."""

import hashlib
import itertools
import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from aeroscope.llm import mixing, packing, toxicity
from aeroscope.llm.common import saved
from aeroscope.llm.queries import MIX_BLOCK, MIX_SHARES
from aeroscope.llm.tokens import vocabulary_path

from .test_lines import brute as brute_lines
from .test_simhash import plain, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="data not here")


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, outputs):
    before, calm, cut, single, mixed, packed = outputs
    assert len(cp.STAGES) == 5
    assert all(df.columns == before.columns and df.schema.simpleString() == before.schema.simpleString() for df in outputs[1:5])

    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = model.scorer()
    assert texts(calm) == [(i, t) for i, t in texts(before) if scorer.score(t or "") < cp.TOXIC]

    rows = texts(calm)
    assert texts(cut) == [(i, t) for (i, _), t in zip(rows, brute_lines(rows, 2, True))]
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    rows = texts(cut)
    prints = [plain(t or "") for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert texts(single) == [rows[i] for i in sorted(set(roots(range(len(rows)), near).values()))]

    known = set(MIX_SHARES) - {mixing.REST}
    of = {}
    for r in single.collect():
        of.setdefault(r.source if r.source in known else mixing.REST, []).append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    shares = {s: n for s, n in MIX_SHARES.items() if s in of}
    slots, total, at = mixing.edf_period(shares), sum(shares.values()), {}
    for s, ids in of.items():
        for k, (_, i) in enumerate(sorted(ids)):
            b = k // MIX_BLOCK
            at[i] = b // shares[s] * total + slots[s][b % shares[s]]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(at)

    library = Tokenizer.from_file(vocabulary_path())
    sizes = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect()}
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == sizes


def test_run_is_the_chain_of_stages(spark, outputs):
    got = cp.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, outputs[-1].collect()))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_repeats_and_more_columns(spark):
    clean = "First line of quite ordinary words here.\nSecond line that says a little more than that.\nThird line ends it."
    rows = [
        (1, clean, "en", "src0", len(clean), "x"), (1, clean, "en", "src0", len(clean), "x"), (None, "No id but a text of its own, with some words.", None, None, None, None),
        (None, None, None, None, None, None), (3, None, "en", "src1", 0, "y"), (4, "", "en", "src1", 0, "y"), (5, "long " * 50_000, "de", "src2", 250_000, "y"),
        (6, clean, "en", "src0", len(clean), "z"), (7, "Another text, of another source, that stands alone here.", "fr", "other", 50, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string")
    calm = cp.drop_toxic(spark, docs, SF)
    assert calm.count() == len(rows)
    cut = cp.drop_repeated_lines(spark, calm, SF)
    found = cut.collect()
    assert len(found) == len(rows) and cut.columns == docs.columns
    assert [r.text for r in found if r.doc_id == 1] == [clean, clean] and [r.text for r in found if r.doc_id == 6] == [""]
    single = cp.drop_near_copies(spark, cut, SF).collect()
    assert sorted((r.doc_id for r in single), key=lambda i: (i is None, i)) == [1, 3, 5, 7, None]
    assert [r.text for r in single if r.doc_id is None] == ["No id but a text of its own, with some words."]
    mixed = cp.mix_sources(spark, spark.createDataFrame(single, docs.schema), SF)
    assert mixed.columns == docs.columns
    assert cp.pack_tokens(spark, cut, SF).where("doc_tokens > 1").count() > 5


def test_mixing_keeps_every_document(spark):
    sources = ["src0"] * 100 + ["src1"] * 30 + ["src2"] * 3 + [None, "unlisted"]
    docs = spark.createDataFrame([(i, f"text {i}", "en", s, 6, "x") for i, s in enumerate(sources)], "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string")
    got = [r.doc_id for r in cp.mix_sources(spark, docs, SF).collect()]
    assert sorted(got) == list(range(len(sources)))
    slot = {r.row.doc_id: r.slot for r in mixing.mix(docs, MIX_SHARES, MIX_BLOCK).collect()}
    assert [slot[i] for i in got] == sorted(slot.values())


def test_packing_gets_every_mixed_document(spark, outputs):
    _, _, _, single, mixed, packed = outputs
    assert texts(mixed) == texts(single)
    library = Tokenizer.from_file(vocabulary_path())
    pieces = {}
    for r in packed.collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts(single)}


def test_weights_hold_in_the_packed_sequences(spark):
    """Up to the end of any range of sequences each source has its share of the documents, to within a block, while it lasts."""
    shares, block, slots = {"a": 3, "b": 2, mixing.REST: 1}, 2, 10
    sources = ["a"] * 130 + ["b"] * 100 + ["c", None] * 60 + ["none"] * 3
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * (i * 37 % 90), "en", s) for i, s in enumerate(sources)], "doc_id bigint, text string, lang string, source string")
    packed = packing.pack_mixed(docs, shares, block, vocabulary_path(), size=64, slots=slots).collect()
    slot = {r.row.doc_id: r.slot for r in mixing.mix(docs, shares, block).collect()}
    spans = {}
    for r in packed:
        spans.setdefault(slot[r.doc_id] // slots, set()).add(r.sequence_id)
    ordered = [sorted(spans[k]) for k in sorted(spans)]
    assert [i for x in ordered for i in x] == list(range(sum(map(len, ordered))))  # one range after the other
    held = 0
    for k, ids in zip(sorted(spans), ordered):
        upto = (k + 1) * slots
        if upto > min(130 // block * 6 // 3, 100 // block * 6 // 2, 123 // block * 6):
            break
        held += 1
        here = {r.doc_id for r in packed if r.sequence_id <= ids[-1]}
        for name, n in shares.items():
            own = sum((sources[i] if sources[i] in shares else mixing.REST) == name for i in here)
            assert abs(own / block - upto * n / 6) < 1
    assert held >= 5
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    brief = [x for x in fill.values() if sum(n for _, n in x) < 48]
    assert len(brief) <= 2 * len(ordered)


def test_packing_follows_the_mix(spark, outputs):
    _, _, _, _, mixed, packed = outputs
    slot = {r.row.doc_id: r.slot for r in mixing.mix(mixed, MIX_SHARES, MIX_BLOCK).collect()}
    last = -1
    for k, group in itertools.groupby(sorted(packed.collect(), key=lambda r: r.sequence_id), key=lambda r: slot[r.doc_id] // packing.SLOTS):
        assert k > last
        last = k


def test_packing_reads_the_order_of_the_mix(spark, monkeypatch):
    """Sequences follow the rows as the stage before wrote them, whatever ids and sources say."""
    monkeypatch.setattr(packing, "SLOTS", 8)
    many = 8 * MIX_BLOCK
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * (i * 37 % 90), "en", f"src{i % 3}", 9) for i in range(300)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for order in (F.col("doc_id").desc(), F.md5(F.col("doc_id").cast("string"))):
        written = saved(docs.repartition(3).orderBy(order), "test-order")
        place = {r.doc_id: n for n, r in enumerate(docs.orderBy(order).collect())}
        packed = cp.pack_tokens(spark, written, SF).collect()
        ranges = [place[r.doc_id] // many for r in sorted(packed, key=lambda r: r.sequence_id)]
        assert ranges == sorted(ranges) and set(ranges) == set(range(-(-300 // many))) and {r.doc_id for r in packed} == set(place)
