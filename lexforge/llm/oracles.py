"""DuckDB SQL of the queries on visually identical text and on frequencies, from the same fixed values as the operators.

DuckDB has no compatibility normalization, so the replacements are built by rule from Python's character tables, as
translations of single characters; characters that become several are left as they are.
"""

from __future__ import annotations

import unicodedata as ud

from lexforge.llm.unify import _GREEK, _WORD, APOSTROPHES, LOOK_ALIKES

_PLANES = [*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _translate(x: str, pairs: dict[str, str]) -> str:
    return f"translate({x}, {_quote(''.join(pairs))}, {_quote(''.join(pairs.values()))})" if pairs else x


def _script(c: str) -> str:
    if not c.isalpha():
        return ""
    o = ord(c)
    return "G" if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF else "L" if o < 0x2B0 else "X"


def _single(table: dict[str, str], scripts: str) -> dict[str, str]:
    """Composed letters with a base in table (of the scripts given) and what they become, both single characters."""
    out = {}
    for o in [*range(0x41, 0x530), *range(0x1E00, 0x2000), 0xA64B]:
        c = chr(o)
        base, marks = ud.normalize("NFD", c)[:1], ud.normalize("NFD", c)[1:]
        if ud.normalize("NFC", c) == c and _script(base) and _script(base) in scripts and base in table:
            to = ud.normalize("NFC", table[base] + marks)
            if len(to) == 1:
                out[c] = to
    return out


def _class(chars: object) -> str:
    return "[" + "".join(sorted(chars)) + "]"


_COMPAT = {c: n for c in map(chr, _PLANES) if len(n := ud.normalize("NFKC", c)) == 1 and n != c and ud.category(n)[0] in "LN" and c not in APOSTROPHES}
_TO_GREEK = _single(LOOK_ALIKES, "LX")
_BACK = {g: x for x, g in reversed(LOOK_ALIKES.items()) if x.isascii()}
_TO_LATIN = _single({g: x for g, x in _BACK.items()} | {c: _BACK[g] for c, g in LOOK_ALIKES.items() if g in _BACK and not c.isascii()}, "GX")
_APOS = dict.fromkeys(APOSTROPHES, "’")
_INVISIBLE = r"[\p{Cf}\p{Cc}\p{Co}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FE00}-\x{FE0F}]"
_BLANK = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"
_G, _L = r"[\x{0370}-\x{0373}\x{0376}\x{0377}\x{037B}-\x{037D}\x{037F}\x{0386}\x{0388}-\x{03F5}\x{03F7}-\x{03FF}\x{1F00}-\x{1FBC}\x{1FC2}-\x{1FCC}\x{1FD0}-\x{1FDB}\x{1FE0}-\x{1FEC}\x{1FF2}-\x{1FFC}]", r"[A-Za-zªµº\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{1E00}-\x{1EFF}]"


def _fold(x: str) -> str:
    x = _translate(_translate(x, _APOS), _COMPAT)
    x = f"regexp_replace(regexp_replace({x}, {_quote(_BLANK)}, ' ', 'g'), {_quote(_INVISIBLE)}, '', 'g')"
    return _translate(f"nfc_normalize(trim(regexp_replace({x}, ' +', ' ', 'g')))", _APOS)


def _count(x: str, chars: str) -> str:
    return f"len(regexp_extract_all({x}, {_quote(chars)}))"


def _sigma(x: str) -> str:
    """A final-form sigma before a later letter as a medial one."""
    return rf"(CASE WHEN regexp_matches({x}, '\p{{L}}') THEN replace(regexp_extract({x}, '^(.*)(\p{{L}}[^\p{{L}}]*)$', 1), 'ς', 'σ') || regexp_extract({x}, '^(.*)(\p{{L}}[^\p{{L}}]*)$', 2) ELSE {x} END)"


_TOK = "(SELECT passage_id, token_pos, t.lemma AS lemma, t.form AS form FROM (SELECT passage_id, generate_subscripts(tokens, 1) AS token_pos, unnest(tokens) AS t FROM (SELECT DISTINCT ON (passage_id) passage_id, tokens FROM passages)))"
_VALUES = f"SELECT 'passages.tokens.lemma' AS field, passage_id AS record_id, CAST(token_pos AS INT) AS token_pos, lemma AS value FROM {_TOK} UNION ALL SELECT 'passages.tokens.form', passage_id, CAST(token_pos AS INT), form FROM {_TOK} UNION ALL SELECT 'lemma_frames.greek_lemma', row_id, 0, greek_lemma FROM (SELECT DISTINCT ON (row_id) row_id, greek_lemma FROM lemma_frames)"
_CLEAN = f"regexp_full_match(value, {_quote(f'{_WORD}(?: {_WORD})*')})"
_VOCABULARY = f"SELECT unnest(regexp_extract_all(text, {_quote(f'[{_GREEK}]+’?')})) AS word FROM passages UNION ALL SELECT lemma FROM {_TOK} UNION ALL SELECT form FROM {_TOK} UNION ALL SELECT greek_lemma FROM lemmas UNION ALL SELECT greek_lemma FROM lemma_frames"

_FORMS = f"""
vals AS (SELECT * FROM ({_VALUES}) WHERE value IS NOT NULL),
dirty AS (SELECT DISTINCT value FROM vals WHERE NOT {_CLEAN}),
words AS (SELECT value, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT value, string_split({_fold('value')}, ' ') AS ws FROM dirty)),
scripts AS (SELECT *, {_count('w', _G)} AS g, {_count('w', _L)} AS l, {_count('w', chr(92) + 'p{L}')} AS n, {_count('w', _class(_TO_GREEK))} AS alike FROM words),
readings AS (SELECT *, (CAST(g > 0 AS INT) + CAST(l > 0 AS INT) + CAST(n > g + l AS INT)) > 1 AS mixed,
  CASE WHEN alike = n - g THEN {_sigma(_translate('w', _TO_GREEK))} END AS greek,
  CASE WHEN {_count('w', _class(_TO_LATIN))} = n - l THEN {_translate('w', _TO_LATIN)} END AS latin,
  g >= alike + 2 * (n - g - alike) AS by_greek FROM scripts),
ordered AS (SELECT *, CASE WHEN mixed OR n > g + l THEN CASE WHEN by_greek THEN greek ELSE latin END END AS first, CASE WHEN mixed OR n > g + l THEN CASE WHEN by_greek THEN latin ELSE greek END END AS second FROM readings),
known AS (SELECT DISTINCT word FROM ({_VOCABULARY}) WHERE word IN (SELECT first FROM ordered UNION ALL SELECT second FROM ordered)),
chosen AS (SELECT o.*, a.word IS NOT NULL AS k1, b.word IS NOT NULL AS k2 FROM ordered o LEFT JOIN known a ON o.first = a.word LEFT JOIN known b ON o.second = b.word),
forms AS (SELECT value, string_agg(CASE WHEN k1 THEN first WHEN k2 THEN second WHEN mixed THEN coalesce(first, w) ELSE w END, ' ' ORDER BY pos) AS form, bool_or(mixed AND NOT k1 AND NOT k2) AS open FROM chosen GROUP BY value)"""
_LEMMAS = f"SELECT passage_id, token_pos, nullif(coalesce(form, value), '') AS term FROM (SELECT passage_id, token_pos, lemma AS value FROM {_TOK}) LEFT JOIN forms USING (value)"
_GRAMS = f"SELECT 'passages.tokens.lemma' AS field, passage_id AS id, unnest([terms[i:i + k - 1] FOR k IN [1, 2, 3] IF i + k - 1 <= len(terms)]) AS ngram FROM (SELECT passage_id, terms, unnest(range(1, len(terms) + 1)) AS i FROM (SELECT passage_id, list(term ORDER BY token_pos) AS terms FROM ({_LEMMAS}) GROUP BY 1)) UNION ALL SELECT 'lemmas.homer_count', lemma_id, [CAST(homer_count AS VARCHAR)] FROM (SELECT DISTINCT ON (lemma_id) * FROM lemmas) WHERE homer_count IS NOT NULL"
_TERMS = f"SELECT field, ngram[1] AS term, count(*) AS n, count(DISTINCT id) AS records, CASE WHEN count(DISTINCT id) = 1 THEN 'rare' WHEN count(DISTINCT id) > CASE WHEN field = 'lemmas.homer_count' THEN 0.1 * (SELECT count(DISTINCT lemma_id) FROM lemmas) ELSE 0.5 * (SELECT count(DISTINCT passage_id) FROM passages) END THEN 'common' END AS mark FROM grams WHERE len(ngram) = 1 GROUP BY 1, 2"
_COUNTED = f"WITH {_FORMS}, grams AS (SELECT * FROM ({_GRAMS}) WHERE len(list_filter(ngram, lambda x: x IS NULL)) = 0)"

ORACLE = {
    "p1_found": f"WITH {_FORMS} SELECT field, record_id, token_pos FROM vals JOIN forms USING (value) WHERE form <> value OR open",
    "p1_forms": f"WITH {_FORMS} SELECT field, record_id, token_pos, value, coalesce(form, value) AS form, coalesce(open, false) AS open FROM vals LEFT JOIN forms USING (value)",
    "p1_frame_lemmas": f"WITH {_FORMS} SELECT row_id, coalesce(form, value) AS greek_lemma, lemma_id FROM (SELECT DISTINCT ON (row_id) row_id, greek_lemma AS value FROM lemma_frames) LEFT JOIN forms USING (value) LEFT JOIN (SELECT DISTINCT ON (lemma_id) lemma_id, greek_lemma FROM lemmas) l ON coalesce(form, value) = l.greek_lemma",
    "p5_ngrams": f"{_COUNTED} SELECT field, ngram, count(*) AS n, count(DISTINCT id) AS records FROM grams GROUP BY 1, 2",
    "p5_terms": f"{_COUNTED} {_TERMS}",
    "p5_found": f"{_COUNTED} SELECT field, term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
}
