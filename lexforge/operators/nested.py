"""Nested records as flat node tables with interval labels (problem 2)."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = "record_table string, doc_id bigint, pre int, post int, depth int, kind string, pos int, fields map<string,string>"
_ARROW = pa.schema([("record_table", pa.string()), ("doc_id", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])


def _refuse(x: str) -> None:
    raise ValueError(x)


def parse_whole(text: str | None) -> object:
    """The JSON value, or None where the text is not one whole JSON value."""
    try:
        return json.loads(text.lstrip("﻿"), parse_constant=_refuse) if text else None
    except (ValueError, RecursionError):
        return None


def _scalar(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def label_tree(root: object, root_kind: str, containers: frozenset[str], rename: Mapping[str, str], unwrap: str | None = None) -> list[tuple]:
    """(pre, post, depth, kind, pos, fields) of every node of one record, depth first.

    Nodes are objects and the scalars of lists; scalar members of an object are its fields. A node's kind is the
    (renamed) key that holds it, its pos the place in the stored list from 1, nulls included. A lone object counts
    as a list of one, and JSON text under a key of containers as what it encodes. pre and post come from one
    counter, raised on entering and on leaving, so b lies in a exactly if a.pre < b.pre and b.post < a.post.
    """
    out: list[list] = []
    clock = 0
    todo: list[tuple] = []  # an explicit stack: records may be nested deeper than Python's own stack

    def push(value: object, kind: str, depth: int) -> None:
        if isinstance(value, str) and kind in containers:
            value = parse_whole(value)
        items = value if isinstance(value, list) else [value]
        for pos in range(len(items), 0, -1):
            if items[pos - 1] is not None:
                todo.append((items[pos - 1], kind, pos, depth))

    if unwrap and isinstance(root, dict) and unwrap in root:
        root = root[unwrap]
    if isinstance(root, str):
        root = parse_whole(root)
    push(root, root_kind, 0)
    while todo:
        x, kind, pos, depth = todo.pop()
        clock += 1
        if pos < 0:  # leaving
            x[1] = clock
            continue
        row = [clock, 0, depth, kind, pos, []]
        out.append(row)
        todo.append((row, "", -1, 0))
        if isinstance(x, dict):
            inner = []
            for key, value in x.items():
                key = rename.get(key, key)
                if isinstance(value, (dict, list)) or (key in containers and isinstance(value, str)):
                    inner.append((value, key))
                elif value is not None:
                    row[5].append((key, _scalar(value)))
            for value, key in reversed(inner):
                push(value, key, depth + 1)
        elif isinstance(x, list):
            push(x, kind, depth + 1)
        else:
            row[5].append(("value", _scalar(x)))
    return [tuple(r) for r in out]


def label_nodes(docs: DataFrame, record_table: str, root_kind: str, *, containers: tuple[str, ...] = (), rename: Mapping[str, str] | None = None, unwrap: str | None = None) -> DataFrame:
    """The node table (NODE_SCHEMA) of docs, which has doc_id BIGINT and payload STRING (JSON).

    Payloads that are null, empty or not whole JSON have no nodes. doc_id is copied; it must mark a record.
    """
    held, names = frozenset(containers), dict(rename or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _ARROW]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in label_tree(parse_whole(text), root_kind, held, names, unwrap):
                    for c, v in zip(cols, (record_table, doc, *node), strict=True):
                        c.append(v)
                if len(cols[0]) > 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
                    cols = [[] for _ in _ARROW]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("payload").cast("string")).mapInArrow(run, NODE_SCHEMA)


def linked_nodes(docs: DataFrame, record_table: str, root_kind: str, kinds: Mapping[str, tuple[str, ...]], links: Mapping[str, tuple[str, str | None]], *, containers: tuple[str, ...] = (), rename: Mapping[str, str] | None = None, unwrap: str | None = None) -> DataFrame:
    """record_table, doc_id, pre, post, depth, kind, pos, value, <links>: label_nodes and link_by_interval in one pass over docs.

    kinds: the kinds that come out, with the fields of which the first present is value. links: column -> (ancestor
    kind, field), the field (its place where None) of the nearest node of that kind whose interval contains the node,
    as text; null if there is none. Nothing but these columns leaves the pass.
    """
    held, names = frozenset(containers), dict(rename or {})
    above = sorted({k for k, _ in links.values()})
    given = [(above.index(k), [f for kk, f in links.values() if kk == k].index(f)) for k, f in links.values()]
    wanted = [[f for kk, f in links.values() if kk == k] for k in above]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*list(_ARROW)[:-1], pa.field("value", pa.string()), *[pa.field(c, pa.string()) for c in links]])
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stacks: list[list[tuple]] = [[] for _ in above]
                for pre, post, depth, kind, pos, members in label_tree(parse_whole(text), root_kind, held, names, unwrap):
                    for stack in stacks:
                        while stack and stack[-1][0] < pre:
                            stack.pop()
                    if kind in kinds:
                        has = dict(members)
                        value = next((has[f] for f in kinds[kind] if f in has), None)
                        found = [stacks[n][-1][1][m] if stacks[n] else None for n, m in given]
                        for c, v in zip(cols, (record_table, doc, pre, post, depth, kind, pos, value, *found), strict=True):
                            c.append(v)
                    if kind in above:
                        n, has = above.index(kind), dict(members)
                        stacks[n].append((post, [str(pos) if f is None else has.get(f) for f in wanted[n]]))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    out = NODE_SCHEMA.split(", fields")[0] + ", value string" + "".join(f", {c} string" for c in links)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("payload").cast("string")).mapInArrow(run, out)


def link_by_interval(nodes: DataFrame, ancestors: Mapping[str, Mapping[str, Column]], in_order: bool = False) -> DataFrame:
    """nodes plus, per ancestor kind, the named columns of the nearest node of that kind that contains it (null if none).

    A walk over a record's nodes in pre-order keeps those still open on a stack, which the labels tell: a node lies in
    another exactly if it began later and ends before it. So kinds may contain themselves at any depth, and nodes left
    out before don't matter. in_order: nodes come as label_nodes gives them, a record's nodes together in pre-order
    (filtered perhaps); then nothing is shuffled. Otherwise they are brought into that order by one shuffle by record.
    """
    given = {name: f"_l{n}_{m}" for n, cols in enumerate(ancestors.values()) for m, name in enumerate(cols)}
    kept = nodes.withColumns({given[name]: F.when(F.col("kind") == kind, c) for kind, cols in ancestors.items() for name, c in cols.items()})
    if not in_order:
        kept = kept.repartition("record_table", "doc_id").sortWithinPartitions("record_table", "doc_id", "pre")
    kinds = list(ancestors)
    names = [list(cols) for cols in ancestors.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        stacks: list[list[tuple]] = []
        for b in batches:
            key = list(zip(*[b.column(c).to_pylist() for c in ("record_table", "doc_id")], strict=True))
            pre, post, kind = (b.column(c).to_pylist() for c in ("pre", "post", "kind"))
            values = [list(zip(*[b.column(given[name]).to_pylist() for name in cols], strict=True)) for cols in names]
            found: list[list] = [[] for _ in kinds]
            for i, k in enumerate(key):
                if k != at:
                    at, stacks = k, [[] for _ in kinds]
                for n, stack in enumerate(stacks):
                    while stack and stack[-1][0] < pre[i]:
                        stack.pop()
                    found[n].append(stack[-1][1] if stack else None)
                    if kind[i] == kinds[n]:
                        stack.append((post[i], values[n][i]))
            plain = [c for c in b.schema.names if c not in given.values()]
            cols = {c: b.column(c) for c in plain}
            for n, at_kind in enumerate(names):
                for m, name in enumerate(at_kind):
                    cols[name] = pa.array([None if f is None else f[m] for f in found[n]], b.column(given[name]).type)
            yield pa.record_batch(list(cols.values()), names=list(cols))

    schema = T.StructType([*nodes.schema.fields, *[T.StructField(name, kept.schema[given[name]].dataType) for name in given]])
    return kept.mapInArrow(run, schema)


def node_table(nodes: DataFrame, kind: str, columns: Mapping[str, str], *links: str) -> DataFrame:
    """The flat table of one kind: its labels and place, the named fields cast to the DDL types given (null where they don't fit), and link columns."""
    return nodes.filter(F.col("kind") == kind).select("record_table", "doc_id", "pre", "post", "depth", "pos", *[F.col("fields").getItem(c).try_cast(t).alias(c) for c, t in columns.items()], *links)
