"""Reading raw files and logs, and writing packages and reports."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.json_text import file_records, flatten_json, line_problem
from quarry.functions.text import source_type
from quarry.operators.analytics import csv_cell
from quarry.operators.maintenance import package_manifest

SUPPORTED = ["txt", "md", "csv", "json", "jsonl"]
CHUNK = "id string, vector array<float>, properties struct<content string, source_file string, source_type string, chunk_index int, chunk_strategy string, chunk_size int, chunk_overlap int, created_at string>, source_sha256 string"


def file_key(path: str) -> Column:
    """The name of a row's file: its path under ``path``, or its last part if ``path`` is the file itself.

    Files of one name in two folders stay apart. A file outside ``path`` as it is written (a pattern,
    say) has its whole path.
    """
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root = re.sub(r"^[a-z0-9]+:/+", "/", path, flags=re.IGNORECASE).rstrip("/")
    at = F.instr(whole, F.lit(root))
    below = F.regexp_replace(F.substring(whole, at + len(root), F.lit(1 << 30)), "^/", "")
    return F.when(at == 0, whole).when(below == "", F.substring_index(whole, "/", -1)).otherwise(below)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_type, text: one row per file."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(file_key(path).alias("source_file"), F.col("value").alias("text"))
    return rows.withColumn("source_type", source_type(F.col("source_file")))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """source_file, pos (from 1), cells, header: every later row of each file, with the file's first row as header.

    Quoted line breaks and doubled quotes are part of a cell; every cell is kept, also empty ones at the
    end, and rows may have any number. Blank lines are no rows. A file with line breaks in cells
    cannot be split, so each file is read by one task, its rows one after the other.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(file_key(path).alias("source_file"), F.col("value").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = (r for r in csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline="")) if r)
                header, at = next(rows, None), 1
                while held := list(islice(rows, 10_000)):
                    columns = [pa.array([name] * len(held)), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string())), pa.array([header] * len(held), pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["source_file", "pos", "cells", "header"])
                    at += len(held)

    return raw.mapInArrow(run, "source_file string, pos long, cells array<string>, header array<string>")


def json_records(df: DataFrame, c: str = "text") -> DataFrame:
    """``df`` without ``c``, with ordinal and record: the items of a top-level array that holds an object or array, else the value.

    Records are as they are written in the file; those without text are left out and their ordinals
    with them. A file that is no JSON or over a limit has none: see ``json_failures``.
    """
    others = [x for x in df.columns if x != c]
    return df.select(*others, F.inline(file_records(c)["items"])).select(*others, "ordinal", "record")


def json_failures(df: DataFrame, c: str = "text") -> DataFrame:
    """``df`` without ``c``, with reason: the files that have no records because something is wrong with them."""
    return df.select(*[x for x in df.columns if x != c], file_records(c)["problem"].alias("reason")).where("reason is not null")


def read_jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    """source_file, line (from 1), record: every line of the files, gzip too; no file is held whole.

    Large files are read in blocks. Lines are numbered within their block, and each block by the
    lines of the blocks before it.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(file_key(path).alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("record"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for batch in batches:
            out = []
            for own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n = own, 1 if own != key else n + 1
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["source_file", "_block", "record", "_n"])

    lines = raw.mapInArrow(number, "source_file string, _block long, record string, _n long")
    before = W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("source_file", "_block").agg(F.max("_n").alias("_lines")).withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    out = lines.join(blocks, ["source_file", "_block"]).withColumn("line", F.col("_before") + F.col("_n"))
    bare = F.when(F.col("line") == 1, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return out.select("source_file", "line", F.regexp_replace(bare, "\r$", "").alias("record"))


def jsonl_quality(lines: DataFrame, longest: int = 10_000_000, most: int = 1_000_000) -> DataFrame:
    """source_file, line, reason: the first line that fails each file.

    Blank lines at the end are fine. Each line must hold one JSON value, without NaN or Infinity
    outside strings.
    """
    blank = F.col("record").isNull() | F.col("record").rlike("^[ \\t\\r]*$")
    last = lines.where(~blank & (F.col("line") <= most)).groupBy("source_file").agg(F.max("line").alias("_last"))
    reason = (
        F.when(F.col("line") > most, "too many lines")
        .when(blank, F.when(F.col("line") < F.col("_last"), "blank line"))
        .when(F.octet_length("record") > longest, "long line")
        .otherwise(line_problem("record"))
    )
    bad = lines.join(last, "source_file", "left").withColumn("reason", reason).where("reason is not null")
    return bad.groupBy("source_file").agg(F.min(F.struct("line", "reason")).alias("x")).select("source_file", "x.line", "x.reason")


def accepted_and_skipped(files: DataFrame) -> DataFrame:
    """name, accepted, reason by supported type.

    Gzipped JSON Lines count, gzipped JSON only from an archive (a column ``archived``), nothing else gzipped.
    """
    low = F.lower("name")
    archived = F.coalesce(F.col("archived"), F.lit(False)) if "archived" in files.columns else F.lit(False)
    ok = source_type(F.col("name")).isin(SUPPORTED) & (~low.endswith(".json.gz") | archived)
    suffix = F.regexp_extract(F.substring_index(low, "/", -1), r"[^.].*(\.[^./]+)$", 1)
    return files.select("name", ok.alias("accepted"), F.when(~ok, F.concat(F.lit("unsupported type '"), F.when(suffix == "", "none").otherwise(suffix), F.lit("'"))).alias("reason"))


def write_chunk_package(chunks: DataFrame, path: str) -> None:
    """One JSON object a chunk under ``path``; counts, dimensions, unresolved chunks and fidelity in ``path``/manifest."""
    rows = chunks.select("id", "vector", "properties", "source_sha256")
    rows.write.json(f"{path}/chunks")
    package_manifest(rows.withColumn("package", F.lit("chunks")), "package").drop("package").coalesce(1).write.json(f"{path}/manifest")


def read_chunk_package(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a package; a line that is none has _corrupt_record."""
    return spark.read.schema(f"{CHUNK}, _corrupt_record string").option("mode", "PERMISSIVE").json(f"{path}/chunks")


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, line, record of the lines of a package that hold no chunk."""
    lines = read_jsonl_records(spark, f"{path}/chunks")
    read = F.from_json("record", f"{CHUNK}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_c", read).where(F.col("_c._corrupt_record").isNotNull() | F.col("_c.id").isNull()).select("source_file", "line", "record")


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of a log; torn lines and those without key are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")


def audit_cells(df: DataFrame, columns: list[str], maps: tuple[str, ...] = ()) -> DataFrame:
    """The columns as safe CSV cells, maps as JSON."""
    return df.select(*[csv_cell(F.to_json(c) if c in maps else F.col(c).cast("string")).alias(c) for c in columns])


def write_audit_csv(df: DataFrame, path: str, columns: list[str], maps: tuple[str, ...] = ()) -> None:
    audit_cells(df, columns, maps).write.csv(path, header=True)
