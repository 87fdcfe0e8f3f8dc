"""Writers on their own."""

import csv
import glob

from pyspark.sql import functions as F

from aeroscope.session import scratch
from aeroscope.sources import readers, writers


def test_wide_rows_of_many_files(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("m1").alias("model"), F.format_string("f%05d", "id").alias("file"), F.col("id").cast("string").alias("text"), F.lit(1).alias("seq"))
    more = spark.createDataFrame([("m2", "f00003", 'a, "b"', 1), ("m2", "f00003", "later\nline", 2), ("m2", "f00005", None, 1)], "model string, file string, text string, seq int")
    results = rows.unionByName(more)
    wide = {r.model: r.cells for r in writers.wide_rows(results).collect()}
    assert wide["m1"] == [str(i) for i in range(n)]
    assert len(wide["m2"]) == n and wide["m2"][3] == "later\nline" and set(wide["m2"]) == {"", "later\nline"}
    path = scratch(spark, "wide-test")
    writers.write_wide_rows(results, path)
    found = {}
    for name in glob.glob(path.removeprefix("file://") + "/part-*"):
        with open(name, newline="") as f:
            header, *lines = csv.reader(f)
        assert header == ["model", *[f"f{i:05}" for i in range(n)]]
        found |= {x[0]: x[1:] for x in lines}
    assert found == wide


def test_no_results(spark):
    empty = spark.createDataFrame([], "model string, file string, text string, seq int")
    assert writers.wide_rows(empty).count() == 0


def test_bundle_reads_like_its_files(spark, tmp_path):
    rows = [(f"gt/pagina_{i}_errors.json", f'[{{"type": "t{i}", "chunk_index": {i}}}]') for i in range(50)]
    files = spark.createDataFrame(rows, "name string, value string").repartition(3)
    writers.write_bundle(files, f"{tmp_path}/one.bundle")
    writers.write_files(files, f"{tmp_path}/many")
    assert len(glob.glob(f"{tmp_path}/one.bundle/part-*")) <= 3 and len(glob.glob(f"{tmp_path}/many/gt/*")) == 50
    bundled, single = (sorted(tuple(r) for r in readers.read_errors(spark, p).select("run", "page", "type", "chunk_index").collect()) for p in (f"{tmp_path}/one.bundle", f"{tmp_path}/many/gt"))
    assert bundled == single == sorted(("gt", float(i), f"t{i}", i) for i in range(50))


def test_media_of_truth_that_repeats(spark):
    truth = spark.createDataFrame([("d:10:00:01",), ("d:10:00:01",), ("e:10:00:02",)], "sample_id string")
    media = spark.createDataFrame([("/m/x_10_00_01_b.wav",), ("/m/x_10_00_01_a.wav",)], "path string")
    assert [tuple(r) for r in readers.map_media(truth, media, "hour").collect()] == [("d:10:00:01", "/m/x_10_00_01_a.wav")] * 2


def test_truth_comes_back_as_it_was_written(spark):
    texts = [None, "", " ", " a ", "\ta\n", "\n", "\r", "a\rb", "\r\na", "\\", 'a\\"', '"', '""', ' "q" ', '"\x00', "\x00", "a,\x00\n", "#", ",", "\uffff", "\ufeff", "null", "\u2028", "\x85a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "sample_id bigint, text string")
    path = scratch(spark, "truth-test")
    writers.write_truth(rows.repartition(3), path)
    found = {int(r.sample_id): r.text for r in readers.read_truth(spark, path, "csv").collect()}
    assert found == dict(enumerate(texts))


def test_split_truth_keeps_white_space(spark):
    rows = spark.createDataFrame([("1", " a\t", "test"), ("2", " ", "test"), ("3", None, "test")], "audio_id string, transcription string, split string")
    path = scratch(spark, "split-test")
    rows.write.options(**writers.CSV).csv(path)
    assert [tuple(r) for r in readers.read_split_truth(spark, path, "test").collect()] == [("1", " a\t", "test")]
