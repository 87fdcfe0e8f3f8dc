"""Further columns of any name and type, which the operators must neither lose, mix up nor stumble over."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from aeroscope.llm import licenses, lines, mixing, packing, simhash, suffixes
from aeroscope.llm.common import row_hash
from aeroscope.llm.tokens import vocabulary_path

from .test_suffixes import brute as repeats

PASSAGE = " ".join(f"word{i}" for i in range(60))
NAMES = ["_row", "__hash", "_hash", "_spans", "_spans_", "_id", "row", "h", "tie", "place", "fp", "a.b", "x`y", "text.z", "range", "pieces"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"Line one of it.\n{PASSAGE}\nan end", f"Other start.\n{PASSAGE}\nother end", f"Other start.\n{PASSAGE}\nother end", "mit license: permission is granted", None, ""]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id here, but some words", None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.concat_ws("-", F.lit(str(k)), F.col("doc_id").cast("string")))
    return df.withColumn("m", F.create_map(F.lit("k"), F.col("n_chars"), F.lit("j"), F.lit(2))).withColumn("deep", F.array(F.struct(F.create_map(F.lit("k"), F.lit(1)).alias("m"))))


def rows_of(df):
    return {r.doc_id: r.asDict(recursive=True) for r in df.collect()}


def plain(df):
    return df.select("doc_id", "text", "source")


def test_keep_one(spark, docs):
    got, all_ = simhash.keep_one(docs), rows_of(docs)
    assert got.columns == docs.columns and got.count() < docs.count()
    assert rows_of(got) == {i: all_[i] for i in (r.doc_id for r in simhash.keep_one(plain(docs)).collect())}


def test_dedup_lines(spark, docs):
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_spans__"]
    texts = {r.doc_id: r.text for r in lines.dedup_lines(plain(docs)).collect()}
    assert texts[1] == "Other start.\nother end"
    assert rows_of(got.drop("_spans__")) == {i: r | {"text": texts[i]} for i, r in rows_of(docs).items()}


def test_mix(spark, docs):
    shares = {"src0": 2, "src1": 1, mixing.REST: 1}
    got, all_ = mixing.mix(docs, shares, 1), rows_of(docs)
    assert rows_of(got.select("row.*")) == all_
    assert sorted((str(r.row.doc_id), r.slot) for r in got.collect()) == sorted((str(r.row.doc_id), r.slot) for r in mixing.mix(plain(docs), shares, 1).collect())


@pytest.mark.parametrize("operator", [simhash.near_duplicates, suffixes.remove_repeats, licenses.scan, lambda df: packing.pack_mixed(df, cp.MIX_SHARES, 4, vocabulary_path())])
def test_same_as_without(spark, docs, operator):
    got, bare = operator(docs), operator(plain(docs))
    own = [c for c in got.columns if c not in ("row_hash", "keeper", "sequence_id", "offset")]
    assert sorted(map(str, got.select(own).collect())) == sorted(map(str, bare.select(own).collect()))


def test_stages(spark, docs):
    df = docs
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, "/root/testdata/sf0.001")
        assert df.columns == docs.columns and df.schema.simpleString() == docs.schema.simpleString()
    assert cp.STAGES[-1][1](spark, df, "/root/testdata/sf0.001").count() == df.count()


def test_rows_that_a_short_hash_takes_for_one(spark):
    """Two rows without an id whose 32-bit hashes are equal: each loses its own bytes only."""
    text = F.concat(*[F.sha2(F.concat(F.lit(x), F.col("id").cast("string")), 512) for x in "abc"])
    made = spark.range(300_000).select(text.alias("text"), F.hash(F.lit(None).cast("bigint"), text).alias("h"))
    first, second = made.groupBy("h").agg(F.sort_array(F.collect_list("text")).alias("texts")).where(F.size("texts") > 1).orderBy("h").first().texts[:2]
    rows = [(None, first), (None, second), (5, "x" + first[:250])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert df.where("doc_id IS NULL").select(F.hash("doc_id", "text").alias("h")).distinct().count() == 1
    assert df.select(row_hash(df).alias("h")).distinct().count() == 3
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, repeats([t for _, t in rows], 200)))
    assert sorted(x[2] for x in got) == [0, 250, 250]
