"""JSON as text: records as they are written, lines of ``path: value``, and verdicts on lines.

Spark's own JSON functions rewrite numbers, sort keys or take more than one value for one, so texts pass
through Arrow batches here. A text that is too large or nested too deeply gets a reason, and never stops a job.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: Characters that one flattened record may hold, and the most records of a file.
MOST_FLAT, MOST_RECORDS = 1 << 28, 1_000_000
BLANK = re.compile(r"[ \t\n\r]*")


class Number(str):
    """A JSON number as it is written."""


class TooLarge(ValueError):
    """A record whose lines would hold more than is allowed."""


class Constant(ValueError):
    """NaN or Infinity outside a string."""


def refuse(name: str) -> None:
    raise Constant(name)


DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=refuse)


def lines_of(value: object, most: int) -> list[str]:
    """``path: value`` lines in the order of the text, at most ``most`` characters with line ends."""
    out: list[str] = []
    left = most

    def word(x: object) -> str:
        return x if isinstance(x, str) else json.dumps(x)

    def visit(x: object, path: str) -> None:
        nonlocal left
        if isinstance(x, dict):
            for k, v in x.items():
                visit(v, f"{path}.{k}" if path else k)
            return
        if isinstance(x, list):
            if any(isinstance(v, (dict, list)) for v in x):
                for i, v in enumerate(x):
                    visit(v, f"{path}[{i}]")
                return
            if not x:
                return
            x = ", ".join(map(word, x))
        line = f"{path}: {word(x)}" if path else word(x)
        left -= len(line) + 1
        if left < 0:
            raise TooLarge
        out.append(line)

    visit(value, "")
    return out


def records_in(text: str) -> tuple[list[tuple[int, str]], str | None]:
    """((position from 1, text as written) of the records of a JSON file, why it has none).

    The items of a top-level array that holds an object or array are records, otherwise the whole value
    is one. Records without text are left out. One bad record fails the file.
    """
    at = BLANK.match(text).end()
    value, end = DECODER.raw_decode(text, at)
    if BLANK.match(text, end).end() < len(text):
        return [], "invalid JSON"
    if isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
        items, place = [], BLANK.match(text, at + 1).end()
        for v in value:
            _, stop = DECODER.raw_decode(text, place)
            items.append((v, text[place:stop]))
            place = BLANK.match(text, BLANK.match(text, stop).end() + 1).end()
    else:
        items = [(value, text[at:end])]
    kept = []
    for i, (v, raw) in enumerate(items, 1):
        try:
            if "\n".join(lines_of(v, MOST_FLAT)).strip():
                kept.append((i, raw))
        except TooLarge:
            return [], f"record {i} is too large"
        if len(kept) > MOST_RECORDS:
            return [], "too many records"
    return kept, None


FILE = StructType().add("items", ArrayType(StructType().add("ordinal", LongType()).add("record", StringType()))).add("problem", StringType())


@F.pandas_udf(FILE)
def file_records(s: pd.Series) -> pd.DataFrame:
    """Records of each text of a JSON file, or the problem with it; a null text has neither."""
    items, problems = [], []
    for text in s:
        try:
            found, problem = records_in(text.removeprefix("\ufeff")) if text is not None else ([], None)
        except Constant:
            found, problem = [], "not a number"
        except (ValueError, RecursionError):
            found, problem = [], "invalid JSON"
        items.append([{"ordinal": i, "record": r} for i, r in found])
        problems.append(problem)
    return pd.DataFrame({"items": items, "problem": pd.Series(problems, dtype=object)})


def problem_of(text: str | None) -> str | None:
    """Why a line is not one JSON value, or that its record is too large; None where it is fine."""
    try:
        value, end = DECODER.raw_decode(text or "", BLANK.match(text or "").end())
        if BLANK.match(text, end).end() < len(text):
            return "invalid JSON"
        lines_of(value, MOST_FLAT)
    except Constant:
        return "not a number"
    except TooLarge:
        return "record too large"
    except (ValueError, RecursionError):
        return "invalid JSON"
    return None


@F.pandas_udf(StringType())
def line_problem(s: pd.Series) -> pd.Series:
    """``problem_of`` each line."""
    return s.map(problem_of)


@F.pandas_udf(StringType())
def _flat(s: pd.Series) -> pd.Series:
    def flat(text: str | None) -> str | None:
        try:
            return None if text is None else "\n".join(lines_of(json.loads(text, parse_int=Number, parse_float=Number, parse_constant=refuse), MOST_FLAT))
        except (ValueError, RecursionError):
            return None

    return s.map(flat)


def flatten_json(c: Column) -> Column:
    """``path: value`` lines in the order of the text, numbers as written.

    Null where it is no JSON or would hold more than MOST_FLAT characters: long keys over many values
    can make a small text very large. ``line_problem`` and ``file_records`` say why.
    """
    return _flat(c)
