"""What the training-data operators share: tables, scratch space and null-safe inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the session names for checkpoints, which all executors share.

    Only where none is set and all runs on one machine (tests) a temporary folder is named; a
    cluster without the setting is an error, since executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor re-reads, never recomputes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def digest(text_col: str = "text") -> Column:
    """16 bytes that tell whole texts apart; null for a null text."""
    return F.unhex(F.md5(text_col))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def annotated(df: DataFrame, column: str, fields: str, make: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``df`` with further columns (``fields``, as DDL) computed from ``column``; every row and column stays in place. Narrow.

    ``make`` is called once a task and gives a function from values to one array for each field.
    """
    new = StructType.fromDDL(fields)
    at, names = df.columns.index(column), [*df.columns, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, *found(part.column(at).to_pylist())], names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
