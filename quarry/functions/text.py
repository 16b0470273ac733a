"""Column functions on names, texts, settings, scores and status values."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_CHUNK, MOST_CHUNKS, MOST_TEXT = 6000, 10_000, 10_000_000
PART = r"(?s)^(.*) \(part [1-9][0-9]*\)$"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def normalise_text(c: Column) -> Column:
    """Without leading BOM; LF line ends; NFC (ASCII texts skip the Python step); no control characters but tab and LF."""
    c = F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")
    c = F.when(c.rlike("^[\\x00-\\x7f]*$"), c).otherwise(_nfc(c))
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", "")


def source_type(name: Column) -> Column:
    """Type by suffix; before .gz only that of JSON and JSON Lines counts. Empty for any other."""
    low = F.lower(name)
    zipped = F.regexp_extract(low, r"\.(jsonl?)\.gz$", 1)
    return F.when(zipped != "", zipped).otherwise(F.regexp_extract(low, r"\.(txt|md|csv|json|jsonl|pdf|docx|html)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(\.jsonl?\.gz|\.[^./]+)$", "")


def part_name(base: Column, n: Column) -> Column:
    return F.concat(base, F.lit(" (part "), n.cast("string"), F.lit(")"))


def base_of(name: Column) -> Column:
    """The name without one ``(part N)`` suffix."""
    return F.when(name.rlike(PART), F.regexp_extract(name, PART, 1)).otherwise(name)


def in_family(source: Column, name: Column) -> Column:
    """Whether a stored name is ``name`` itself or one of its parts."""
    return (source == name) | (source.rlike(PART) & (F.regexp_extract(source, PART, 1) == name))


def output_kind(kind: Column) -> Column:
    """What a prepared file of a type is written as: text, csv or jsonl."""
    return F.when(kind.isin("txt", "md", "pdf", "docx"), "text").when(kind == "csv", "csv").otherwise("jsonl")


def prepared_names(name: Column, count: Column) -> Column:
    """The names of the ``count`` prepared parts of a raw file, with the suffix of its output kind."""
    kind = output_kind(source_type(name))
    suffix = F.when(kind == "text", ".md").when(kind == "csv", ".csv").otherwise(".jsonl")
    return part_files(stem(name), suffix, count)


def part_files(stem_: Column, suffix: Column, count: Column) -> Column:
    """Names of ``count`` part files, numbered only if there are several."""
    several = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(stem_, F.lit("-part-"), F.lpad(i.cast("string"), 3, "0"), suffix))
    return F.when(count > 1, several).otherwise(F.array(F.concat(stem_, suffix)))


def canonical_name(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def aliases(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.array_distinct(F.array(F.concat(F.upper(F.substring(c, 1, 1)), rest), F.concat(F.lower(F.substring(c, 1, 1)), rest)))


def label(c: Column, most: int = 40) -> Column:
    """White space runs as one space, trimmed, cut with an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.char_length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def position_key(position: Column) -> Column:
    return F.concat(F.lit("record "), F.format_number(position, 0))


def record_key(first_cell: Column, position: Column) -> Column:
    """The first cell as label, else ``record N`` with thousands commas."""
    return F.coalesce(F.nullif(label(first_cell), F.lit("")), position_key(position))


class Number(str):
    """A JSON number as it is written."""


def compact_json(x) -> str:
    if isinstance(x, Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact_json(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(compact_json, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


@F.pandas_udf(StringType())
def _first_value(s: pd.Series) -> pd.Series:
    def first(text: str | None) -> str | None:
        try:
            found = json.loads(text or "", parse_int=Number, parse_float=Number)
        except ValueError:
            return None
        value = next(iter(found.values()), None) if isinstance(found, dict) else None
        return value if value is None or isinstance(value, str) else compact_json(value)

    return s.map(first)


def json_record_key(record: Column, position: Column) -> Column:
    """The first top-level value of a JSON object as label; its position if there is none, or it is null or blank."""
    return record_key(_first_value(record), position)


def record_title(name: Column, n: Column, of: Column, most: int = 150) -> Column:
    """The name, with ``, part n of N`` if there are several; the name is cut to keep the title short."""
    one = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    tail = F.when(of > 1, F.concat(F.lit(", part "), n.cast("string"), F.lit(" of "), of.cast("string"))).otherwise("")
    room = F.lit(most) - F.char_length(tail)
    return F.concat(F.when(F.char_length(one) > room, F.concat(F.substring(one, F.lit(1), room - 1), F.lit("…"))).otherwise(one), tail)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def record_summary(count: Column, fields: Column, first: Column, last: Column, most_fields: int = 20, most_words: int = 80) -> Column:
    """``<n> records. Fields: a, b. First: x; last: y.`` with as many names as fit, then how many more there are."""
    n = F.size(fields)

    def text(shown: Column) -> Column:
        more = F.when(n > shown, F.concat(F.lit(", and "), F.format_number(n - shown, 0), F.lit(" more"))).otherwise("")
        named = F.when(n <= 0, "none").otherwise(F.concat(F.array_join(F.slice(fields, F.lit(1), shown), ", "), more))
        ends = F.when(count > 0, F.concat(F.lit(" First: "), first, F.lit("; last: "), last, F.lit("."))).otherwise("")
        return F.concat(F.format_number(count, 0), F.when(count == 1, " record").otherwise(" records"), F.lit(". Fields: "), named, F.lit("."), ends)

    top = F.greatest(F.least(n, F.lit(most_fields)), F.lit(1))
    fitting = F.filter(F.sequence(F.lit(1), top), lambda shown: words(text(shown)) <= most_words)
    return text(F.coalesce(F.array_max(fitting), F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine: 1 - cosine; dot: minus the product; l2-squared: the squared distance."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "dot":
        return -dot(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def score(d: Column, metric: str) -> Column:
    return {"cosine": 1 - d, "dot": -d, "l2-squared": 1 / (1 + d)}[metric]


def citation_text(content: Column) -> Column:
    return F.substring(content, 1, 200)


def overlap_windows(length: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` at stride ``size - overlap`` that cover a text; the last ends at its end."""
    more = F.ceil((length - size) / F.lit(size - overlap))
    return F.when(length <= 0, 0).otherwise(1 + F.greatest(F.lit(0), more)).cast("long")


def overlap_estimate(length: Column) -> Column:
    return (1 + F.greatest(F.lit(0), F.ceil((length - 1000) / F.lit(800)))).cast("long")


def part_limit(strategy: Column, size: Column, overlap: Column) -> Column:
    """The most text one part may hold under its strategy's limits on chunks and output."""
    cap, text = F.lit(MOST_CHUNKS), F.lit(MOST_TEXT)
    stride = size - overlap
    # A text of w windows is longer than size + (w - 2) * stride, and w - 1 overlaps are written twice.
    windows = F.greatest(F.least(cap, F.floor((text + size - overlap - 1) / size)), F.lit(1))
    overlapped = F.least(size + (windows - 1) * stride, text - (windows - 1) * overlap)
    return F.when(strategy == "overlap", overlapped).when(strategy == "language", F.least(text, cap * F.greatest(stride, F.lit(1)))).when(strategy == "semantic", text).otherwise(F.least(text, cap * size)).cast("long")


def http_result(status: Column) -> Column:
    return F.when(status < 400, "success").when(status < 500, "refused").otherwise("error")


def job_result(status: Column) -> Column:
    return F.when(status == "completed", "succeeded").when(status.isin("failed", "partial", "cancelled"), "failed").otherwise("interrupted")


def parse_iso_utc(c: Column) -> Column:
    """A time from ISO 8601 text; null if it is none. Without offset it is UTC, whatever the session's zone."""
    c = F.trim(c)
    day, offset = c.rlike(r"^\d{4}-\d\d-\d\d$"), c.rlike(r"(?i)(z|[+-]\d\d(:?\d\d)?(:\d\d)?)$") & c.rlike(r"\d\d:\d\d|T\d\d")
    return F.try_to_timestamp(F.when(day, F.concat(c, F.lit("T00:00:00Z"))).when(offset, c).otherwise(F.concat(c, F.lit("Z"))))


def normal_property(c: Column, kind: str, name: str = "") -> Column:
    """A property as text that tells equal values alike: whole numbers without point, times in UTC.

    ``kind`` is its Spark type. ``created_at`` is a time also where it is text.
    """
    if kind.startswith("timestamp"):
        return F.concat(F.lit("t"), F.unix_micros(c.cast("timestamp")).cast("string"))
    if name == "created_at" and kind == "string":
        at = parse_iso_utc(c)
        return F.when(at.isNotNull(), F.concat(F.lit("t"), F.unix_micros(at).cast("string"))).otherwise(F.concat(F.lit("s"), c))
    if kind in ("float", "double"):
        whole = (c == F.floor(c)) & (F.abs(c) < 2.0**63)
        return F.concat(F.lit("n"), F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("double").cast("string")))
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.concat(F.lit("n"), F.regexp_replace(c.cast("string"), r"\.0+$", ""))
    return F.concat(F.lit("s"), c.cast("string")) if kind == "string" else F.to_json(F.struct(c.alias("v")))


def property_digest(properties: dict[str, str]) -> Column:
    """Digest of the non-null properties (name to Spark type) as JSON with sorted keys, values as ``normal_property`` has them."""
    return F.sha2(F.to_json(F.struct(*[normal_property(F.col(c), properties[c], c).alias(c) for c in sorted(properties)])), 256)


def vector_digest(v: Column) -> Column:
    """Digest of a vector as 32-bit numbers. A null or empty vector, a null component, and one that is not a finite 32-bit number, are an error."""
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4028234663852886e38))
    text = F.concat_ws(",", F.transform(v, lambda x: (x.cast("float") + F.lit(0.0).cast("float")).cast("string")))
    return F.when(F.coalesce(fine, F.lit(False)), F.sha2(text, 256)).otherwise(F.raise_error(F.lit("missing or invalid vector")))


def document_header(title: Column, summary: Column) -> Column:
    """``# title`` and the summary, or null where the header is not usable."""
    header = F.concat(F.lit("# "), title, F.lit("\n\n"), summary)
    usable = (F.char_length(title) <= 150) & ~title.contains("\n") & (F.trim(title) != "") & (F.size(F.split(F.trim(summary), " +")) <= 80) & (F.char_length(header) <= 2000)
    return F.when(usable, header)


@F.pandas_udf(StringType())
def _first_object(s: pd.Series) -> pd.Series:
    decode = json.JSONDecoder().raw_decode

    def first(text: str | None) -> str | None:
        at = (text or "").find("{")
        while at >= 0:
            try:
                return text[at : decode(text, at)[1]]
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return s.map(first)


def reply_object(c: Column) -> Column:
    """The first JSON object in a model's reply, prose and fences tolerated; null without one.

    Every brace is tried with a JSON decoder, so nested objects and braces within strings are whole.
    """
    return _first_object(c)


def removal_lines(c: Column, n: Column) -> Column:
    """The ``remove`` list of a reply, sorted and distinct, if it holds only integers from 1 to n, else null."""
    found = F.from_json(reply_object(c), "remove array<int>")["remove"]
    return F.when(F.forall(found, lambda i: i.isNotNull() & (i >= 1) & (i <= n)), F.array_sort(F.array_distinct(found)))


def usable_pair(reply: Column) -> Column:
    """question, answer, ground_truth of a reply's object; null unless all are non-blank (ground_truth defaults to answer)."""
    x = F.from_json(reply_object(reply), "question string, answer string, ground_truth string")
    truth = F.coalesce(x["ground_truth"], x["answer"])
    filled = [F.trim(F.regexp_replace(v, r"(?U)\s+", " ")) != "" for v in (x["question"], x["answer"], truth)]
    return F.when(filled[0] & filled[1] & filled[2], F.struct(x["question"].alias("question"), x["answer"].alias("answer"), truth.alias("ground_truth")))
