from __future__ import annotations

import csv
import io

import pytest
from conftest import needs_data, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.operators import packed
from lexforge.operators.packed import explode_packed, split_packed


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("", []),
        ("  \t", []),
        (";;, ", []),
        ("a;b", ["a", "b"]),
        (" a ; b ;; a", ["a", "b", "a"]),
        ("a, b/c|d\te\nf，g；h", list("abcdefgh")),
        ('x;"x, y"', ["x", "x, y"]),
        ("“x / y”; z", ["x / y", "z"]),
        ('"say ""hi"" now",b', ['say "hi" now', "b"]),
        (r'["say \"hi\"", "b; c", null, "é"]', ['say "hi"', "b; c", "é"]),
        ('{a,"b, c"}', ["a", "b, c"]),
        ("{Food shared,Means}", ["Food shared", "Means"]),
        ("a (b; c); d", ["a (b; c)", "d"]),
        ("a (b; c", ["a (b", "c"]),
        ('"open; b', ['"open', "b"]),
        ('"a" b; c', ['"a" b', "c"]),
        ('x"y"z;w', ['x"y"z', "w"]),
        ('""; x', ["x"]),
        (r"a\;b;c", ["a;b", "c"]),
        ("null;a", ["null", "a"]),
        ("[]", []),
        ("δ’; κα’", ["δ’", "κα’"]),
    ],
)
def test_values(text, values):
    assert split_packed(text) == values


@pytest.mark.parametrize("text", ["(" * 200_000, "“a;" * 100_000, '"' * 199_999, '"a"";' * 50_000, "([{" * 60_000 + ")", "a(;" * 60_000 + ")"])
def test_unclosed_marks_end(text):
    assert split_packed(text)


def test_long_text():
    text = ";".join(f'"v{i}, w"' for i in range(100_000))
    assert split_packed(text) == [f"v{i}, w" for i in range(100_000)]


plain = st.text(st.characters(codec="utf-8", exclude_categories=("C", "Z")), min_size=1, max_size=8).filter(lambda x: not set(x) & set("\\[]{}()“”„«»＂"))


@settings(max_examples=300, deadline=None)
@given(st.lists(plain, min_size=1, max_size=6))
def test_quoted_round_trip(values):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, delimiter=";", lineterminator="").writerow(values)
    assert split_packed(out.getvalue()) == [v for v in (x.strip() for x in values) if v]


def test_records(spark):
    df = spark.createDataFrame([(1, "a;b"), (1, "a;b"), (2, None), (None, "x"), (3, "")], "id bigint, f string")
    assert rows(explode_packed(df, "id", "f", "t.f")) == [("t.f", 1, 1, "a"), ("t.f", 1, 2, "b")]


@needs_data
def test_empty_and_clashing_columns(spark, empty_dir, wide_dir):
    from conftest import DATA

    from lexforge.plans.problems import p6_found

    assert p6_found(spark, empty_dir).count() == 0
    assert rows(p6_found(spark, wide_dir)) == rows(p6_found(spark, DATA))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a" ,;()[]{}\\“”n', max_size=30))
def test_closing_is_known_before_the_pass(text):
    """Any string ends, and with every mark it leaves unclosed taken as ordinary nothing is lost but delimiters, marks and escapes."""
    values = packed.split_packed(text)
    kept = sum(c == "a" for c in text)
    assert sum(v.count("a") for v in values) == kept


def test_many_unclosed_marks():
    assert packed.split_packed(", ".join(['"a" (b'] * 200)) == ['"a" (b'] * 200
    assert packed.split_packed("; ".join(f"(x{i}" for i in range(120))) == [f"(x{i}" for i in range(120)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ,;/|\t\n、\u00a0\u2003\x1f", max_size=20))
def test_strings_without_marks(text):
    lex = packed._LEXEME.findall(text)
    assert packed.split_packed(text) == (packed._pass(lex, set())[0] if text.strip() else [])
