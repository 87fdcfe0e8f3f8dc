"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from aeroscope.session import scratch

#: Bytes of one Arrow batch, so that a task's memory does not depend on how long texts are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow on batches bounded by bytes as well as by rows."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df.mapInArrow(fn, schema)


def rows_out(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples as one Arrow batch."""
    rows = list(rows)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it while a column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _unordered(kind: DataType) -> bool:
    """Whether a type holds a map or a variant, which have no hash."""
    if isinstance(kind, StructType):
        return any(_unordered(f.dataType) for f in kind)
    return isinstance(kind, (MapType, VariantType)) or (isinstance(kind, ArrayType) and _unordered(kind.elementType))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64 bits of all columns (or those named), of any type; the order of a map's entries doesn't matter."""

    def plain(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(quoted(name))
        if isinstance(kind, MapType) and not _unordered(kind.keyType) and not _unordered(kind.valueType):
            return F.array_sort(F.map_entries(c))
        return F.to_json(F.struct(c.alias("v"))) if _unordered(kind) else c

    return F.xxhash64(*[plain(c) for c in columns or df.columns])


def saved(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes intermediate data of our own in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def early_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job go when it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)
