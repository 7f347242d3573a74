from __future__ import annotations

import re

import pytest
from conftest import DATA, needs_data, rows

from lexforge.llm import unify
from lexforge.llm.queries import p1_forms, p1_found, p1_frame_lemmas


@pytest.mark.parametrize(
    ("dirty", "form"),
    [
        ("λόγος", "λόγος"),
        ("λόγος", "λόγος"),
        ("λόγος", "λόγος"),
        ("​λό­γος﻿", "λόγος"),
        ("  ὅ 　τι ", "ὅ τι"),
        ("δ'", "δ’"),
        ("δ᾽", "δ’"),
        ("δʼ", "δ’"),
        ("ὅς２", "ὅς2"),
        ("ὅς²", "ὅς2"),
        ("ϰαί", "καί"),
        ("\U0001d70fε", "τε"),
        ("µέν", "μέν"),
        ("ｖｅｌ", "vel"),
        ("vel", "vel"),
        ("​", ""),
        ("", ""),
    ],
)
def test_folding(dirty, form):
    assert unify.fold_characters(dirty) == form
    assert unify.fold_characters(form) == form


def test_clean_pattern_accepts_only_folded_words():
    p = re.compile(unify.CLEAN_PATTERN.replace(r"\z", r"\Z"))  # as Java writes it
    for x in ("λόγος", "δ’", "ὅς2", "ὅ τι", "vel", "ᾠδή", "Ἀχιλλεύς"):
        assert p.match(x)
    for x in ("λόγoς", "λόγος", "λόγος ", "ὅ  τι", "λόγος\n", "", "δ'", "ϰαί", "аб"):
        assert not p.match(x)


def test_readings():
    assert unify.is_mixed("τoν") and unify.is_mixed("τа") and not unify.is_mixed("аб") and not unify.is_mixed("vel") and not unify.is_mixed("τόν")
    assert unify.greek_reading("τóv") == "τόν"
    assert unify.greek_reading("lόγος") is None
    assert unify.greek_reading("λόγoc") == "λόγος"
    assert unify.greek_reading("cοφός") == "σοφός"
    assert unify.latin_reading("οm") == "om"


def test_vocabulary_decides(spark):
    values = spark.createDataFrame([("τov",), ("cοdd",), ("ξopη",), ("lόγος",), (None,), ("",), ("τον",), ("τov",), ("тоν",), ("тор",), ("мод",)], "value string")
    vocabulary = spark.createDataFrame([("τον",), ("codd",)], "word string")
    got = {r["value"]: (r["form"], r["open"]) for r in unify.consistent_forms(values, vocabulary).collect()}
    assert got == {"τov": ("τον", False), "cοdd": ("codd", False), "ξopη": ("ξορη", True), "lόγος": ("lόγος", True), "": ("", False), "тоν": ("τον", False), "тор": ("тор", False), "мод": ("мод", False)}


@needs_data
def test_found_is_what_differs(spark, empty_dir, wide_dir):
    forms = p1_forms(spark, DATA)
    assert rows(p1_found(spark, DATA)) == rows(forms.filter("form <> value OR open").select("field", "record_id", "token_pos"))
    assert rows(p1_found(spark, wide_dir)) == rows(p1_found(spark, DATA))
    assert p1_found(spark, empty_dir).count() == 0
    assert p1_frame_lemmas(spark, DATA).filter("lemma_id IS NULL AND greek_lemma IS NOT NULL").count() == 0
