"""One consistent form for visually identical text (problem 1)."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.session import cut

BROADCAST_WORDS = 200_000

# Base letters of other scripts that look like a Greek letter, and the Greek letter.
LOOK_ALIKES = {
    "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "Y": "Υ", "X": "Χ",
    "a": "α", "i": "ι", "k": "κ", "n": "η", "o": "ο", "p": "ρ", "t": "τ", "u": "υ", "v": "ν", "w": "ω", "x": "χ", "y": "γ", "c": "ς", "ɑ": "α", "ı": "ι", "ɩ": "ι", "ɛ": "ε", "ɣ": "γ", "ɸ": "φ", "ʋ": "υ",
    "А": "Α", "В": "Β", "Г": "Γ", "Е": "Ε", "З": "Ζ", "Н": "Η", "І": "Ι", "К": "Κ", "М": "Μ", "О": "Ο", "П": "Π", "Р": "Ρ", "Т": "Τ", "У": "Υ", "Ф": "Φ", "Х": "Χ",
    "а": "α", "е": "ε", "і": "ι", "к": "κ", "о": "ο", "п": "π", "р": "ρ", "т": "τ", "у": "γ", "ф": "φ", "х": "χ", "с": "ς", "ѵ": "ν", "ԝ": "ω",
}
# Marks written for elision.
APOSTROPHES = "'`´ʹʼʽˈ΄᾽᾿`´‘’‛′＇ʹ᾿"
_APOSTROPHE = {ord(c): "’" for c in APOSTROPHES}
_SPACES = re.compile(r"\s+")

#: A value that matches is in the consistent form already: composed Greek words or plain Latin words.
#: The class leaves out code points of the Greek blocks that NFC or NFKC replaces, and symbols.
_GREEK = "".join(chr(c) for lo, hi in ((0x386, 0x3CE), (0x1F00, 0x1FFC)) for c in range(lo, hi + 1) if unicodedata.category(chr(c))[0] == "L" and unicodedata.normalize("NFKC", chr(c)) == chr(c))
_WORD = rf"(?:[{_GREEK}]+’?|[A-Za-z]+)[0-9]*"
CLEAN_PATTERN = rf"\A{_WORD}(?: {_WORD})*\z"


def _script(c: str) -> str:
    """G(reek), L(atin), X (another script) or empty for what is no letter; c is a base letter (NFD)."""
    if not c.isalpha():
        return ""
    o = ord(c)
    return "G" if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF else "L" if o < 0x2B0 else "X"


def scripts_of(word: str) -> set[str]:
    return {_script(c) for c in unicodedata.normalize("NFD", word)} - {""}


def is_mixed(word: str) -> bool:
    """Whether letters of two scripts meet in the word."""
    return len(scripts_of(word)) > 1


def fold_characters(text: str) -> str:
    """text with elision marks unified, compatibility forms replaced, nothing invisible, single spaces, composed (NFC).

    No letter changes its script here but by compatibility (mathematical and full-width letters, Greek symbols).
    """
    out = unicodedata.normalize("NFKC", text.translate(_APOSTROPHE))
    kept = []
    for c in out:
        kind = unicodedata.category(c)
        if c.isspace() or kind[0] == "Z":
            kept.append(" ")
        elif kind not in ("Cf", "Cc", "Cn", "Co", "Cs") and c not in "͏ᅟᅠ឴឵ㅤ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️":
            kept.append(c)
    return unicodedata.normalize("NFC", _SPACES.sub(" ", "".join(kept)).strip().translate(_APOSTROPHE))


def greek_reading(word: str) -> str | None:
    """A mixed-script word with every look-alike as its Greek letter, or None where a letter has none.

    Accents stay; a final-form sigma inside the word becomes a medial one.
    """
    out = []
    for c in unicodedata.normalize("NFD", word):
        if _script(c) in ("L", "X"):
            if c not in LOOK_ALIKES:
                return None
            c = LOOK_ALIKES[c]
        out.append(c)
    for i, c in enumerate(out):
        if c == "ς" and any(_script(x) for x in out[i + 1 :]):
            out[i] = "σ"
    return unicodedata.normalize("NFC", "".join(out))


def latin_reading(word: str) -> str | None:
    """A mixed-script word with every Greek letter as the Latin letter it looks like, or None."""
    back = {g: x for x, g in reversed(LOOK_ALIKES.items()) if x.isascii()}
    out = []
    for c in unicodedata.normalize("NFD", word):
        if _script(c) in ("G", "X"):
            c = back.get(LOOK_ALIKES.get(c, c), "")
            if not c:
                return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def dominant_greek(word: str) -> bool:
    """Whether the word's letters are mostly Greek, those of other scripts that have no Greek look-alike counting twice."""
    g = x = 0
    for c in unicodedata.normalize("NFD", word):
        s = _script(c)
        g += s == "G"
        x += (s in ("L", "X")) * (1 if c in LOOK_ALIKES else 2)
    return g >= x


_READINGS = [("folded", pa.string()), ("first", pa.string()), ("second", pa.string()), ("mixed", pa.bool_())]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n == "mixed" else T.StringType()) for n, _ in _READINGS])))
def _readings(values: pa.Array) -> pa.Array:
    """Per word of a value: its folded form, whether its scripts are mixed, and then its readings, that of the dominant script first.

    A word wholly in a third script has readings too, as it may be a known word in look-alikes; it isn't mixed."""
    out = []
    for v in values.to_pylist():
        words = []
        for w in fold_characters(v or "").split(" "):
            first = second = None
            found = scripts_of(w)
            if len(found) > 1 or "X" in found:
                first, second = greek_reading(w), latin_reading(w)
                if not dominant_greek(w):
                    first, second = second, first
            words.append({"folded": w, "first": first, "second": second, "mixed": len(found) > 1})
        out.append(words)
    return pa.array(out, pa.list_(pa.struct(_READINGS)))


def is_clean(value: Column) -> Column:
    return value.rlike(CLEAN_PATTERN)


def consistent_forms(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """value, form, open: the consistent form of every distinct value (column value) that the clean pattern doesn't accept.

    vocabulary has column word: corpus words; what isn't in the consistent form does no harm, as it equals no reading.
    The readings of mixed words, counted first, are broadcast if few, so the corpus isn't shuffled for them. A word of one script is folded only. In a mixed-script
    word the look-alikes are replaced by letters of the dominant script if the result is in the vocabulary, else by
    those of the other script if that is. If neither is a known word the dominant script decides alone, as every value
    must come out in a consistent form, and open is true: the form is the most likely one, but no corpus word bears it
    out. A word wholly in a third script is replaced only by a known word, and isn't open. A word with a letter that has no look-alike in the
    other script has no reading in that script. Null values have no row; a value of only invisible characters has the
    form ''.
    """
    dirty = values.filter(F.col("value").isNotNull() & ~is_clean(F.col("value"))).select("value").distinct()
    words = cut(dirty.select("value", F.posexplode(_readings("value")).alias("pos", "w")).select("value", "pos", "w.*"), "words")
    readings = words.select(F.explode(F.array_compact(F.array("first", "second"))).alias("word")).distinct()
    if readings.count() <= BROADCAST_WORDS:
        known = vocabulary.select("word").join(F.broadcast(readings), "word", "left_semi").distinct()
    else:
        known = vocabulary.select("word").distinct().join(readings, "word", "left_semi")
    known = cut(known, "known")
    fixed = (
        words.join(known.select(F.col("word").alias("first"), F.lit(True).alias("k1")), "first", "left")
        .join(known.select(F.col("word").alias("second"), F.lit(True).alias("k2")), "second", "left")
        .withColumn("unknown", F.expr("mixed AND k1 IS NULL AND k2 IS NULL"))
        .withColumn("form", F.expr("CASE WHEN k1 THEN first WHEN k2 THEN second WHEN mixed THEN coalesce(first, folded) ELSE folded END"))
    )
    return fixed.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("f"), F.bool_or("unknown").alias("open")).select("value", F.concat_ws(" ", F.col("f.form")).alias("form"), "open")


def words_of(text: Column) -> Column:
    """The runs of Greek letters in a text, with a following elision mark."""
    return F.regexp_extract_all(text, F.lit(rf"([{_GREEK}]+’?)"), F.lit(1))
