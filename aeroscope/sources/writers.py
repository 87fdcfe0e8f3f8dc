"""Writers: tables of the engine to files."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeroscope.idioms import join_nulls

#: White space around a text is part of it; null is an empty cell, an empty text a quoted one.
CSV = {
    "header": "true", "escape": '"', "quote": '"', "nullValue": "", "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def wide_results(results: DataFrame, files: Sequence[str] | None = None) -> DataFrame:
    """One row per model, one column per file in name order; the later duplicate wins, missing is ''."""
    wide = results.groupBy("model").pivot("file", list(files) if files else None).agg(F.max_by("text", "seq"))
    names = sorted(c for c in wide.columns if c != "model")
    return wide.select("model", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def wide_rows(results: DataFrame) -> DataFrame:
    """Rows (model, cells) of the wide table: one text per file in name order; the later duplicate wins, missing is ''.

    Assembled from long rows, without a column per file: as many files as a row can hold, and no list of them on the driver.
    """
    found = results.groupBy("model", "file").agg(F.max_by("text", "seq").alias("text"))
    names = results.select("file").where("file IS NOT NULL").distinct().agg(F.collect_list("file")).scalar()
    grid = results.select("model").distinct().select("model", F.explode(names).alias("file"))
    cells = join_nulls(grid, found, ["model", "file"], "left")
    return cells.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("file", F.coalesce("text", F.lit("")).alias("text")))).alias("c")).select(
        "model", F.col("c.text").alias("cells")
    )


def csv_line(values: Column) -> Column:
    """An array of texts as one line."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(values, lambda v: F.when(v.rlike('[",\\r\\n]'), quoted(v)).otherwise(v)), ",")


def write_wide_rows(results: DataFrame, path: str, first: str = "model") -> None:
    """The wide table as CSV: every part of the output has the header and some models' rows, written as they come."""
    names = results.select("file").where("file IS NOT NULL").distinct().agg(F.sort_array(F.collect_list("file")).alias("names"))
    (header,) = names.select(csv_line(F.concat(F.array(F.lit(first)), "names"))).first()  # the line that every part begins with

    def lines(batches):
        kind = pa.schema([("value", pa.string())])
        yield pa.record_batch([pa.array([header])], schema=kind)
        for batch in batches:
            yield pa.record_batch(batch.columns, schema=kind)

    rows = wide_rows(results).select(csv_line(F.concat(F.array(F.coalesce("model", F.lit(""))), "cells")).alias("value"))
    rows.mapInArrow(lines, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def write_wide(df: DataFrame, path: str) -> None:
    df.write.options(**CSV).mode("overwrite").csv(path)


def append_wide(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both tables over the union of their columns; missing is ''."""
    both = old.unionByName(new, allowMissingColumns=True)
    names = ["model", *sorted(c for c in both.columns if c != "model")]
    return both.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def write_bundle(files: DataFrame, path: str) -> None:
    """Many small text files (name, value) in few large ones; `readers.text_files` reads a path that ends in `.bundle`."""
    files.select("name", "value").write.parquet(path)


def write_files(files: DataFrame, path: str) -> None:
    """One file per row (name, value), written side by side by the tasks; a name may hold folders. Equal names: one stays."""

    def write(batches):
        store, base = fs.FileSystem.from_uri(path)
        folders = set()
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                target = f"{base}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                with store.open_output_stream(target) as out:
                    out.write((value or "").encode())
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], names=["n"])

    files.select("name", "value").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def write_results(results: DataFrame, path: str) -> None:
    """JSON results and a one-row header with their number."""
    results.write.mode("overwrite").json(f"{path}/results")
    results.agg(F.count("*").alias("total_results")).write.mode("overwrite").json(f"{path}/header")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def merge_checkpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """Many checkpoint folders to the rows of one wide table; empty texts are skipped."""
    rows = spark.read.schema("model string, file string, text string, seq bigint").json(pattern)
    return wide_rows(rows.where(F.coalesce("text", F.lit("")) != ""))


def write_pages(df: DataFrame, path: str) -> None:
    """One folder per page."""
    df.write.mode("overwrite").partitionBy("page").json(path)


def ranked_summary(scores: DataFrame, by: Column | str, descending: bool = True) -> DataFrame:
    """Scores with their rank; one row per model."""
    c = F.col(by) if isinstance(by, str) else by
    w = Window.orderBy(F.desc(c) if descending else F.asc(c), "model")
    return scores.withColumn("rank", F.row_number().over(w))


def write_summary(ranked: DataFrame, path: str) -> None:
    ranked.write.mode("overwrite").json(path)


def write_truth(truth: DataFrame, path: str) -> None:
    """Truth CSV sorted by id."""
    truth.orderBy("sample_id").write.options(**CSV).mode("overwrite").csv(path)


def write_snapshots(snapshot: DataFrame, aircraft: DataFrame, path: str) -> None:
    """One JSON text per snapshot."""
    snapshot_json(snapshot, aircraft).write.mode("overwrite").text(path)


def snapshot_json(snapshot: DataFrame, aircraft: DataFrame) -> DataFrame:
    planes = aircraft.groupBy("snapshot_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("callsign", F.struct(
            "callsign",
            F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "altitude", "heading", "speed").alias("position"),
            "flight_phase", F.col("wake").alias("wake_turbulence"),
        ).alias("v"))))).alias("aircrafts")
    )
    return snapshot.join(planes, "snapshot_id").select(
        F.to_json(F.struct("snapshot_id", "sector_id", "msa", "aircrafts")).alias("value")
    )


def manifest(rules: DataFrame) -> DataFrame:
    """Distinct rules per status; the last row of a rule counts."""
    last = rules.groupBy("rule_id").agg(F.max_by("status", "seq").alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("n"))


def page_matrix(pages: DataFrame, value: str, page_numbers: Sequence[float] | None = None) -> DataFrame:
    """Model by page matrix of one measure, missing = 0."""
    wide = pages.groupBy("model").pivot("page", list(page_numbers) if page_numbers else None).agg(F.first(value))
    return wide.na.fill(0)
