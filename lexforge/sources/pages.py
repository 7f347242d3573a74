"""Pages and notes: one HTML or Markdown document per record, made in the tasks, and small reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.glossing import gloss_key, gloss_line, gloss_markdown

_STYLE = "body{font:16px/1.5 serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .5em}.g{color:#777;font-size:80%}mark{background:#fe8}mark.t{background:#8cf}"
# shows the rows whose text holds what is typed and whose column equals what is chosen
_FILTER = "function pick(){const q=document.getElementById('q').value.toLowerCase(),s=[...document.querySelectorAll('select')];document.querySelectorAll('tbody tr').forEach(r=>{r.hidden=!(r.textContent.toLowerCase().includes(q)&&s.every(x=>!x.value||r.cells[+x.dataset.c].textContent===x.value))})}"


def page(title: str, body: str, script: str = "") -> str:
    tail = f"<script>{script}</script>" if script else ""
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style><h1>{escape(title)}</h1>{body}{tail}</html>'


def _table(names: list[str], rows: list[tuple]) -> str:
    cell = lambda tag, x: f"<{tag}>{escape('' if x is None else str(x))}</{tag}>"
    return f"<table><thead><tr>{''.join(cell('th', n) for n in names)}</tr></thead><tbody>" + "".join(f"<tr>{''.join(cell('td', x) for x in r)}</tr>" for r in rows) + "</tbody></table>"


def table_page(df: DataFrame, title: str, filters: tuple[str, ...] = (), most: int = 5_000) -> str:
    """A page with a table that can be searched and filtered by columns; more than `most` rows are an error, as a page holds them all."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: split the table over pages")
    names = df.columns
    pick = []
    for c in filters:
        values = sorted({str(r[c]) for r in rows if r[c] is not None})
        pick.append(f'<select data-c="{names.index(c)}" onchange="pick()"><option value="">{escape(c)}</option>' + "".join(f"<option>{escape(v)}</option>" for v in values) + "</select>")
    return page(title, f'<p><input id="q" oninput="pick()" placeholder="search">{"".join(pick)}</p>' + _table(names, [tuple(r) for r in rows]), _FILTER)


def marked_text(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """text with nested marks: spans are (start, end inclusive, class, title), of which those that cross one marked before are cut at its end."""
    out: list[str] = []
    ends: list[int] = []
    ordered = sorted((s for s in spans if 0 <= s[0] <= s[1] < len(text)), key=lambda s: (s[0], -s[1]))
    k = 0
    for i, c in enumerate(text):
        while k < len(ordered) and ordered[k][0] == i:
            _, end, kind, title = ordered[k]
            ends.append(min(end, ends[-1]) if ends else end)
            out.append(f'<mark class="{escape(kind)}" title="{escape(title)}">')
            k += 1
        out.append(escape(c))
        while ends and ends[-1] == i:
            ends.pop()
            out.append("</mark>")
    return "".join(out)


def _spans(sets: list[dict | None] | None) -> Iterator[tuple[dict, list[tuple[int, int, str, str]]]]:
    for a in sets or []:
        if a is None:
            continue
        found = [(a["target"], "t", a["frameName"] or "")] if a["target"] is not None else []
        found += [(f, "fe", f["name"] or "") for f in a["FEs"] or [] if f is not None]
        yield a, [(s["start"], s["end"], kind, name) for s, kind, name in found if s["start"] is not None and s["end"] is not None]


def _passage(r: dict) -> str:
    text, body = r["text"] or "", []
    for a, spans in _spans(r["annotationSets"]):
        rows = [("Target", (a["target"] or {}).get("text"), a["luName"])] + [(f["name"], f["text"], f["itype"]) for f in a["FEs"] or [] if f is not None]
        body.append(f"<h2>{escape(a['frameName'] or '–')} <small>{escape(a['frameStatus'] or '')}</small></h2><p>{marked_text(text, spans)}</p>" + _table(["element", "text", "unit or kind"], rows))
    return page(r["source"] or str(r["sentence_id"]), f"<p>{escape(text)}</p><p class=g>{escape(r['translation'] or '')}</p>" + "".join(body))


def _documents(df: DataFrame, key: str, make: Callable[[dict], str], name: str) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(key), pa.array([make(r) for r in b.to_pylist()], pa.string())], names=[key, name])

    return df.mapInArrow(run, f"{key} {kind}, {name} string")


def passage_pages(sentences: DataFrame) -> DataFrame:
    """sentence_id, html: a page per annotated sentence, each set with its target and elements marked in the text (K9).

    sentences: sentence_id, source, text, translation, annotationSets. Null sets and elements are skipped; spans outside
    the text are not marked.
    """
    return _documents(sentences.select("sentence_id", "source", "text", "translation", "annotationSets"), "sentence_id", _passage, "html")


def _note(r: dict, glosses: Mapping[str, str]) -> str:
    lines = [f"# {r['lemma']}", "", *([r["gloss"], ""] if r["gloss"] else []), "| Sense | Frame | Status | Core elements |", "|---|---|---|---|"]
    for x in r["frames"] or []:
        lines.append("| " + " | ".join((x[c] or "–").replace("|", "\\|").replace("\n", " ") for c in ("sense", "frame", "status", "core")) + " |")
    return gloss_markdown("\n".join([*lines, "", *([r["note"], ""] if r["note"] else [])]), glosses)


def lemma_notes(frames: DataFrame, glosses: Mapping[str, str]) -> DataFrame:
    """lemma, markdown: a note per lemma with its senses and frames in a table, its Greek glossed.

    frames: lemma, gloss, note, sense, frame, status, core. A lemma's rows come in the order of sense and frame.
    glosses is a small dictionary by gloss_key, sent to the tasks.
    """
    row = F.struct("sense", "frame", "status", "core")
    by_lemma = frames.filter("lemma IS NOT NULL").groupBy("lemma").agg(F.min("gloss").alias("gloss"), F.min("note").alias("note"), F.array_sort(F.collect_set(row)).alias("frames"))
    known = {gloss_key(k): v for k, v in glosses.items()}
    return _documents(by_lemma, "lemma", lambda r: _note(r, known), "markdown")


def terms_table(rows: DataFrame, glosses: Mapping[str, str], most: int = 5_000) -> str:
    """A Markdown table of a small result with its Greek glossed."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: ("" if x is None else str(x)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in found]]
    return gloss_markdown("\n".join(lines), {gloss_key(k): v for k, v in glosses.items()})


def glossed_column(df: DataFrame, key: str, column: str, glosses: Mapping[str, str]) -> DataFrame:
    """key, glossed: a column of lines with its Greek glossed (F25), in the tasks; null stays null."""
    known = {gloss_key(k): v for k, v in glosses.items()}
    return _documents(df.select(key, F.col(column).alias("t")), key, lambda r: None if r["t"] is None else gloss_line(r["t"], known), "glossed")


def text_report(title: str, sections: Mapping[str, DataFrame], most: int = 1_000) -> str:
    """A report: per section its rows as 'column: value' lines, or as columns where it has several rows (K5).

    A section of more than `most` rows is an error: a report is for summaries.
    """
    out = [title, "=" * len(title)]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {name} has more than {most} rows")
        show = lambda x: "–" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
        out += ["", name]
        if len(rows) == 1:
            out += [f"  {c}: {show(v)}" for c, v in zip(df.columns, rows[0], strict=True)]
        else:
            cells = [df.columns, *[[show(v) for v in r] for r in rows]]
            width = [max(len(r[j]) for r in cells) for j in range(len(df.columns))]
            out += ["  " + "  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in cells]
    return "\n".join(out) + "\n"
