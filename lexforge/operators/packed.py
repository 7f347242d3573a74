"""Splitting fields that hold several values in one string (problem 6)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators.records import one_per_id

# Characters that separate values outside quotes and brackets.
DELIMITERS = ";,/|\t\n\r\v\f；，｜／、"
# Opening quote -> closing quote.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "＂": "＂"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
CLOSING = {*QUOTES.values(), *BRACKETS.values()}

_D, _S = re.escape(DELIMITERS), re.escape("".join({*QUOTES, *QUOTES.values(), *BRACKETS, *BRACKETS.values()}))
_MARKED, _PLAIN = re.compile(rf"[\\{_S}]"), re.compile(f"[{_D}]")
_LEXEME = re.compile(rf'\\u[0-9a-fA-F]{{4}}|\\.|[{_D}]|[{_S}]|[^\\{_D}{_S}]+|\\', re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


def _unescape(x: str) -> str:
    if len(x) == 6:
        return chr(int(x[2:], 16))
    return _ESCAPED.get(x[1:], x[1:]) if len(x) == 2 else x


def split_packed(text: str | None) -> list[str]:
    """The values of one string, in order, by a finite-state pass over its lexemes.

    States: before a value, in a plain value, in a quoted value, after the closing quote; brackets in plain values
    keep a stack. A delimiter ends a value only outside quotes and at depth 0. A quote opens only at the start of a
    value; inside it, a doubled quote and a backslash stand for the character itself. [..] or {..} around the whole
    string only enclose it. An opening quote or bracket that is never closed is an ordinary character. Values are
    trimmed; empty ones are left out, and a bare null inside [..] or {..} is no value. Null, empty and blank strings
    give no values.

    Whether a quote closes is known before the pass (see _closing). Brackets may be found unclosed at its end; they
    are ordinary then and the pass is made again, until none is left: each time there are fewer. A string without any
    mark needs no states: it is cut at its delimiters.
    """
    if not text or text.isspace():
        return []
    if not _MARKED.search(text):
        return [v for x in _PLAIN.split(text) if (v := x.strip())]
    lex = _LEXEME.findall(text)
    literal: set[int] = set()
    while True:
        values, again = _pass(lex, literal)
        if not again:
            return values
        literal.update(again)


def _closing(lex: list[str], last: int) -> list[bool]:
    """Per lexeme: whether a doubling quote opened there is closed before `last`.

    Inside it two quotes in a row stand for one, so it closes at the first run of an odd number of quotes after it.
    One scan from the end: the length of the run that begins at the next lexeme, and whether a later run is odd.
    """
    out = [False] * (last + 1)
    run, later = 0, False
    for i in range(last - 1, -1, -1):
        out[i] = run % 2 == 1 or later
        if lex[i] == '"':
            run += 1
        elif run:
            later = later or run % 2 == 1
            run = 0
    return out


def _enclosed(lex: list[str]) -> tuple[int, int]:
    """The span of lexemes inside brackets around the whole string, or all of it."""
    a, b = 0, len(lex)
    while a < b and lex[a].isspace():
        a += 1
    while b > a and lex[b - 1].isspace():
        b -= 1
    if b - a >= 2 and lex[a] in "[{" and lex[b - 1] == BRACKETS[lex[a]]:
        depth, close, quote = 0, BRACKETS[lex[a]], None
        for i in range(a, b):
            x = lex[i]
            if quote:
                quote = None if x == quote else quote
            elif x in QUOTES and i > a and (lex[i - 1] in BRACKETS or lex[i - 1][-1] in DELIMITERS or lex[i - 1].isspace()):
                quote = QUOTES[x]
            elif x == lex[a]:
                depth += 1
            elif x == close:
                depth -= 1
                if depth == 0:
                    return (a + 1, b - 1) if i == b - 1 else (0, len(lex))
    return 0, len(lex)


def _pass(lex: list[str], literal: set[int]) -> tuple[list[str], list[int]]:
    first, last = _enclosed(lex) if not literal else (0, len(lex))
    if literal and 0 not in literal:
        first, last = _enclosed(lex)
    enclosed = (first, last) != (0, len(lex))
    final = {x: i for i, x in enumerate(lex[:last]) if x in CLOSING}
    closing = _closing(lex, last)
    values: list[str] = []
    value: list[str] = []
    raw: list[str] = []
    stack: list[tuple[str, int]] = []
    quote, quoted, filled, opened, skip = None, False, False, -1, False

    def end() -> None:
        text = "".join(value).strip()
        if text and not (enclosed and not quoted and text.lower() == "null"):
            values.append(text)

    for i in range(first, last):
        x = lex[i]
        if quote is not None:
            raw.append(x)
            if skip:
                skip = False
            elif x == quote:
                if quote == '"' and i + 1 < last and lex[i + 1] == '"':
                    value.append('"')
                    skip = True
                else:
                    quote = None
            elif x[0] == "\\":
                value.append(_unescape(x))
            else:
                value.append(x)
        elif not stack and x in DELIMITERS:
            end()
            value, raw, quoted, filled = [], [], False, False
        elif quoted and not x.isspace():  # text after the closing quote: the marks belong to the value
            raw.append(x)
            value, quoted, filled = [*raw], False, True
        elif not quoted and i not in literal and x in QUOTES and not filled and (closing[i] if x == '"' else final.get(QUOTES[x], -1) > i):
            value, raw, quoted, opened = [], [x], True, i
            quote = QUOTES[x]
        else:
            raw.append(x)
            if x in BRACKETS and i not in literal and final.get(BRACKETS[x], -1) > i:
                stack.append((BRACKETS[x], i))
            elif stack and x == stack[-1][0]:
                stack.pop()
            if not quoted:
                filled = filled or not x.isspace()
                value.append(_unescape(x) if x[0] == "\\" else x)
    if quote is not None:
        return values, [opened]
    if stack:
        return values, [i for _, i in stack]
    end()
    return values, []


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_packed_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else split_packed(x) for x in texts.to_pylist()], pa.list_(pa.string()))


def explode_packed(df: DataFrame, id_col: str, field: Column | str, label: str) -> DataFrame:
    """field STRING, record_id, value_pos INT (from 1), value STRING: one row per value of the packed column.

    One row of an id counts (see one_per_id). Null, empty and blank strings give no rows; repeated values are kept.
    """
    value = F.col(field) if isinstance(field, str) else field
    rows = one_per_id(df, id_col, value.cast("string").alias("_packed")).filter(F.length(F.trim("_packed")) > 0)
    return rows.select(F.lit(label).alias("field"), F.col(id_col).cast("bigint").alias("record_id"), F.posexplode(split_packed_udf("_packed")).alias("_p", "value")).select("field", "record_id", (F.col("_p") + 1).cast("int").alias("value_pos"), "value")
