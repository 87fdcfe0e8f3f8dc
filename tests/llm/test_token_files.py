"""Coded token files: exact round trips, and the query's rows against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from aeroscope.llm import rans, token_files
from aeroscope.llm.queries import op13
from aeroscope.llm.tokens import vocabulary_path
from aeroscope.session import scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, rans.CHECK, rans.CHECK + 1, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 5000])
def test_codec_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    table = rans.Table.from_bytes(rans.Table.of_counts(list(zip(found.tolist(), counts.tolist()))).to_bytes())
    assert not n or table.freq.sum() == 1 << table.scale
    raw = rans.encode(table, ids)
    segments = [(b, i) for b in map(rans.Block.of, raw) for i in range(len(b.at))]
    random.Random(n).shuffle(order := list(range(len(segments))))  # each segment by itself, in any order
    parts = dict(zip(order, rans.decode(table, [segments[k] for k in order])))
    assert np.array_equal(np.concatenate([ids[:0], *[parts[k] for k in range(len(segments))]]), ids)
    if n > rans.BLOCK:
        share = counts / n
        assert len(b"".join(raw)) < 1.1 * n * -(share * np.log2(share)).sum() / 8


def test_counts_of_any_size():
    table = rans.Table.of_counts([(7, 10**18), (3, 1), (9, 1), (4, 0)])
    assert table.ids.tolist() == [3, 7, 9] and table.freq.sum() == 1 << table.scale and table.freq.min() >= 1
    wide = rans.Table.of_counts([(i, 1) for i in range(1 << 20)])
    assert wide.scale == 22 and wide.freq.sum() == 1 << 22
    with pytest.raises(ValueError):
        rans.encode(table, np.array([5], dtype=np.uint32))


def expected(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) in their order."""
    library, start, out = Tokenizer.from_file(vocabulary_path()), 0, []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, op13(spark, SF).collect())) == expected(rows)


def test_documents_over_many_blocks_and_units(spark, monkeypatch):
    monkeypatch.setattr(token_files, "UNIT", 50_000)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("some few words that come again".split()) for _ in range(n))) for i, n in enumerate([3, 150_000, 0, 10, 70_000, 1, 40_000, 200_000, 2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder = scratch(spark, "token-test")
    token_files.write_tokens(df, folder, vocabulary_path())
    got = token_files.read_tokens(spark, folder, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    store, base = fs.FileSystem.from_uri(folder)
    assert not [f for f in store.get_file_info(fs.FileSelector(base)) if f.base_name == "spool"]


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(5, "b c"), (None, "no id"), (2, None), (2, None), (2, ""), (5, "a"), (None, None), (9, "<|endoftext|> \x1c x"), (1, "z")]
    df = spark.createDataFrame([(*r, 1, "p", "i", {"k": 1}) for r in rows], "doc_id bigint, text string, nth int, part string, `ids.x` string, start map<string,int>")
    got = token_files.through_files(df, vocabulary_path()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is None, i or 0, n, c) for i, _, n, c in expected(rows))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [1, 2, 2, 2, 5, 5, 9, None, None]
    empty = token_files.through_files(df.limit(0), vocabulary_path())
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_damage_is_seen(spark):
    df = spark.createDataFrame([(1, "some text " * 500)], "doc_id bigint, text string")
    folder = scratch(spark, "token-test")
    token_files.write_tokens(df, folder, vocabulary_path())
    store, base = fs.FileSystem.from_uri(folder)
    (path,) = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".ids")]
    with store.open_input_stream(path) as f:
        raw = bytearray(f.read())
    raw[300] ^= 1
    with store.open_output_stream(path) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="checksum of block 0"):
        token_files.read_tokens(spark, folder).collect()


def test_counts_are_summed_by_parts(spark):
    rows = [(p, [p % 3, 7 + p], [1, p]) for p in range(23)]
    counts = spark.createDataFrame(rows, "part bigint, ids array<bigint>, counts array<bigint>")
    expected = {0: 8, 1: 8, 2: 7}
    for p in range(23):
        expected[7 + p] = expected.get(7 + p, 0) + p
    for fan in (2, 4, 100):
        assert dict(token_files.total_counts(counts, 23, fan)) == expected
    assert token_files.total_counts(counts.limit(0), 0) == []
