"""Removing boilerplate lines with a check on what is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import overlap_estimate, part_name, record_summary, record_title
from quarry.operators.chunking import greedy_parts


def document_lines(docs: DataFrame) -> DataFrame:
    """source_file, line, text of every line."""
    return docs.where("text is not null").select("source_file", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def boilerplate_decisions(lines: DataFrame, documents: int) -> DataFrame:
    """source_file, line: bare page numbers, and lines that stand in at least ``documents`` documents.

    Distinct (line, document) pairs are counted through digests, so a line of every document is
    summed before it is shuffled.
    """
    keyed = lines.withColumn("_t", F.trim("text")).where("_t <> ''").withColumn("_h", F.xxhash64("_t"))
    often = keyed.select("_h", "source_file").distinct().groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("_h")
    repeated = keyed.join(often, "_h", "left_semi").select("source_file", "line")
    numbers = keyed.where(F.col("_t").rlike(r"^(?i)(page )?[0-9]+( (of|/) [0-9]+)?$")).select("source_file", "line")
    return repeated.unionByName(numbers).distinct()


def window_lines(docs: DataFrame, limit: int = 3000) -> DataFrame:
    """source_file, window, line, text, send: every line with its window of whole lines; a longer line is alone, not sent."""
    rows = docs.where("text is not null").select("source_file", F.split("text", "\n").alias("l"))
    sizes = F.transform("l", lambda x: F.char_length(x) + 1)
    out = rows.select("source_file", F.posexplode(F.arrays_zip(F.col("l").alias("t"), greedy_parts(sizes, limit, 0).alias("w"))).alias("line", "x"))
    return out.select("source_file", F.col("x.w").alias("window"), "line", F.col("x.t").alias("text"), (F.char_length("x.t") + 1 <= limit).alias("send"))


def apply_removals(lines: DataFrame, decisions: DataFrame, longest: int = 200, share: float = 0.2) -> DataFrame:
    """source_file, kept_lines, removed_chars, fallback: the decisions hold unless they take too much.

    With a column ``window`` in ``lines``, each window is tested by itself.
    """
    by = ["source_file", *(["window"] if "window" in lines.columns else [])]
    marked = lines.join(decisions.select("source_file", "line").distinct().withColumn("gone", F.lit(True)), ["source_file", "line"], "left")
    gone, n = F.coalesce("gone", F.lit(False)), F.char_length("text") + 1
    per = marked.groupBy(*by).agg(F.sum(n).alias("chars"), F.sum(F.when(gone, n).otherwise(0)).alias("removed"), F.max(F.when(gone, F.char_length("text"))).alias("longest"), F.sum(gone.cast("long")).alias("gone_lines"), F.count("*").alias("lines"))
    fallback = F.when(F.col("longest") > longest, "removed-long-line").when(F.col("removed") > share * F.col("chars"), "removed-too-much")
    out = per.withColumn("fallback", fallback)
    keep = F.col("fallback").isNotNull()
    return out.select(*by, F.when(keep, F.col("lines")).otherwise(F.col("lines") - F.col("gone_lines")).alias("kept_lines"), F.when(keep, 0).otherwise(F.col("removed")).alias("removed_chars"), "fallback")


def cleaned_documents(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """source_file, text after the removals that hold, per window where ``lines`` has windows."""
    by = ["source_file", *(["window"] if "window" in lines.columns else [])]
    held = apply_removals(lines, decisions).where("fallback is null").select(*by)
    named = decisions.select("source_file", "line").distinct()
    gone = lines.join(named, ["source_file", "line"], "left_semi").join(held, by, "left_semi").select("source_file", "line")
    kept = lines.join(gone, ["source_file", "line"], "left_anti")
    return kept.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def label_record_parts(records: DataFrame) -> DataFrame:
    """name, part, of, records, part_name, title, summary of every part of a CSV or JSON file, from its data.

    ``records``: name, part (from 1), ordinal, key, fields (names). Fields are listed in the order in
    which they are first seen.
    """
    by = ["name", "part"]
    ends = records.groupBy(*by).agg(F.count("*").alias("records"), F.min(F.struct("ordinal", "key")).alias("first"), F.max(F.struct("ordinal", "key")).alias("last"))
    # Of equal lists of fields only the first counts, so that few are taken apart.
    lists = records.groupBy(*by, "fields").agg(F.min("ordinal").alias("ordinal"))
    seen = lists.select(*by, "ordinal", F.posexplode("fields").alias("at", "field")).groupBy(*by, "field").agg(F.min(F.struct("ordinal", "at")).alias("seen"))
    named = seen.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "field"))), lambda x: x["field"]).alias("fields"))
    of = records.select(*by).distinct().groupBy("name").agg(F.count("part").alias("of"))
    out = ends.join(named, by, "left").join(of, "name").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    name = F.when(F.col("of") > 1, part_name(F.col("name"), F.col("part"))).otherwise(F.col("name"))
    summary = record_summary(F.col("records"), F.col("fields"), F.col("first.key"), F.col("last.key"))
    return out.select(*by, "of", "records", name.alias("part_name"), record_title(F.col("name"), F.col("part"), F.col("of")).alias("title"), summary.alias("summary"))


def check_parts(parts: DataFrame) -> DataFrame:
    """key, chars, records, estimate, ok: parts against the limits of text, records and chunks; parts: key, text."""
    out = parts.groupBy("key").agg(F.sum(F.char_length("text")).cast("long").alias("chars"), F.count("*").alias("records"))
    out = out.withColumn("estimate", overlap_estimate(F.col("chars")))
    return out.withColumn("ok", (F.col("chars") <= 10_000_000) & (F.col("records") <= 1_000_000) & (F.col("estimate") <= 10_000))
