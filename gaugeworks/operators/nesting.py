"""Deeply nested records as flat node tables linked by interval containment.

A depth-first walk numbers every node of a record on entry (``pre``) and on exit
(``post``): the record itself, every object, every list and every plain value in a list.
Node A contains node B exactly if A.pre < B.pre and B.post < A.post, so the rows of one
node table find their parent in another without stored paths, and a record can be
rebuilt from its rows (:func:`rebuilt`). The walk is per record and keeps a stack of
its own, so depth is bounded by the JSON parser only; nothing is shuffled.

An *entry* is an object that is an element of a list, or an entry of an object at one of
the map keys that the caller names. Two things need knowledge of other records: an
object where the field otherwise holds a list of objects counts as its only element. The
keys that hold lists of objects are gathered in a first pass over all records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.runtime import bounded_rows

#: So many distinct keys that hold lists of objects are carried to the tasks at most.
LIST_KEYS_LIMIT = 50_000


def whole_object(raw: str | None) -> dict | None:
    """The record of a line; None for null, broken JSON and anything but an object."""
    if not raw:
        return None
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def as_list(value: object) -> list | None:
    """A list, or a list given as JSON text."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and value.lstrip()[:1] == "[":
        try:
            found = json.loads(value)
        except (ValueError, RecursionError):
            return None
        return found if isinstance(found, list) else None
    return None


#: At a quote: a key and the beginning of a list, or of JSON text of one, in which an object may follow.
_LIST_KEY = re.compile(r'"(?=((?:[^"\\]|\\.)*+)"\s*+:\s*+(?:"\s*\[|\[(?:[\s,\[\]\d.eE+\-a-z]|"(?:[^"\\]|\\.)*+")*+\{))')


def list_keys(record: dict) -> set[str]:
    """Keys under which ``record`` holds a list with an object in it."""
    found: set[str] = set()
    todo: list[tuple[str, object]] = list(record.items())
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo.extend(value.items())
        elif (items := as_list(value)) is not None:
            if any(isinstance(x, dict) for x in items):
                found.add(key)
            todo.extend((key, x) for x in items)
    return found


#: Kinds of nodes. An ``entry`` and an ``only`` element are objects, ``list_text`` is a list given as JSON text.
RECORD, OBJECT, MAP, ENTRY, ONLY, LIST, LIST_TEXT, VALUE = "record", "object", "map", "entry", "only", "list", "list_text", "value"
ENTRIES, LISTS = (ENTRY, ONLY), (LIST, LIST_TEXT)
#: Characters of paths after which rows are handed on.
FLUSH = 32_000_000


class Node:
    """One node: where it stands, its interval and its plain fields."""

    __slots__ = ("path", "table", "kind", "key", "pos", "pre", "post", "fields", "entry", "up")

    def __init__(self, path: str, table: str, kind: str, key: str | None, pos: int | None, pre: int):
        self.path, self.table, self.kind, self.key, self.pos, self.pre, self.post = path, table, kind, key, pos, pre, 0
        self.fields: dict[str, object] = {}


def walk(record: dict, keys: set[str], map_keys: set[str], values: bool = True, fields: bool = True) -> list[Node]:
    """The nodes of one record in order of entry, numbered depth first without recursion;
    plain values in lists have their numbers even where they (``values``) or plain fields
    (``fields``) aren't asked for."""
    clock, root = 1, Node("", "", RECORD, None, None, 1)
    found, stack = [root], [(root, iter(record.items()))]
    while stack:
        node, children = stack[-1]
        listed = node.kind in LISTS
        for key, x in children:
            inside: object = x
            kind_of = x.__class__
            if kind_of is dict:
                kind = ENTRY if node.kind == MAP or listed else MAP if key in map_keys else ONLY if key in keys else OBJECT
            elif kind_of is list:
                kind = LIST
            elif listed:
                if not values:
                    clock += 2
                    continue
                kind = VALUE
            elif kind_of is str and (x[:1] == "[" or x[:1].isspace()) and (inside := as_list(x)) is not None:
                kind = LIST_TEXT
            else:
                if fields:
                    node.fields[key] = x
                continue
            if node.kind == MAP or listed:
                at, of = f"{node.path}[{key}]", node.table
            else:
                at, of = (f"{node.path}.{key}", f"{node.table}.{key}") if node.path else (key, key)
                at = f"{at}[0]" if kind == ONLY else at
            clock += 1
            child = Node(at, of, kind, None if listed else key, key if listed else None, clock)
            found.append(child)
            if kind == VALUE:
                child.fields["value"] = x
                clock += 1
                child.post = clock
                continue
            stack.append((child, iter(enumerate(inside) if kind in LISTS else inside.items())))
            break
        else:
            clock += 1
            node.post = clock
            stack.pop()
    return found


def link(nodes_: list[Node]) -> None:
    """Sets ``up`` (pre of the smallest interval around a node, 0 for none) and ``entry`` (path
    of the nearest entry around it, '' for none). Nodes come in order of ``pre``; the
    intervals that are open form a stack."""
    stack: list[Node] = []
    entries: list[Node] = []
    for node in nodes_:
        while stack and stack[-1].post < node.pre:
            stack.pop()
        while entries and entries[-1].post < node.pre:
            entries.pop()
        node.up = stack[-1].pre if stack else 0
        node.entry = entries[-1].path if entries else ""
        stack.append(node)
        if node.kind in ENTRIES:
            entries.append(node)


def _text(value: object) -> str | None:
    return value if value is None or value.__class__ is str else json.dumps(value)


_TYPES = {type(None): "null", str: "text", bool: "boolean"}


def _field_map(nodes_: list[Node], typed: bool) -> pa.Array:
    """The plain fields of nodes as a map column, made of flat lists."""
    offsets, names, texts, kinds = [0], [], [], []
    for n in nodes_:
        if n.fields:
            names.extend(n.fields)
            for v in n.fields.values():
                texts.append(_text(v))
                if typed:
                    kinds.append(_TYPES.get(v.__class__, "number"))
        offsets.append(len(names))
    values = pa.array(texts, pa.string())
    if typed:
        values = pa.StructArray.from_arrays([values, pa.array(kinds, pa.string())], ["value", "type"])
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), values)


def _untyped(value: str | None, kind: str) -> object:
    return value if kind in ("text", "null") else json.loads(value)


def rebuilt(rows: list) -> dict:
    """The record of its rows from :func:`all_nodes`: of each node the containing one is the
    smallest interval around it. Lists given as JSON text come back as lists."""
    made, stack = {}, []
    for row in sorted(rows, key=lambda r: r["pre"]):
        own = {k: _untyped(v["value"], v["type"]) for k, v in row["fields"].items()}
        value = [] if row["kind"] in LISTS else own["value"] if row["kind"] == VALUE else own
        while stack and stack[-1][1] < row["pre"]:
            stack.pop()
        if not stack:
            made = value
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        else:
            stack[-1][0][row["key"]] = value
        stack.append((value, row["post"]))
    return made


def gathered_list_keys(df: DataFrame, raw: str) -> set[str]:
    """Keys that hold a list of objects in some record; their number is checked.

    Only lines in whose text a key not yet known may hold one are parsed: in a task, few."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not found.issuperset(_LIST_KEY.findall(text)) and (record := whole_object(text)) is not None:
                    found |= list_keys(record)
        yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(found), pa.string())})

    seen = df.select(raw).mapInArrow(gather, "key string").distinct()
    return {r[0] for r in bounded_rows(seen, LIST_KEYS_LIMIT, "keys that hold lists of objects")}


_STRING, _LONG = ("string", pa.string()), ("bigint", pa.int64())
# SQL type, and a function that makes the column of nodes
_COLUMNS = {
    "node": (_STRING[0], lambda ns: pa.array([n.path for n in ns], _STRING[1])),
    "parent": (_STRING[0], lambda ns: pa.array([n.entry for n in ns], _STRING[1])),
    "node_table": (_STRING[0], lambda ns: pa.array([n.table for n in ns], _STRING[1])),
    "kind": (_STRING[0], lambda ns: pa.array([n.kind for n in ns], _STRING[1])),
    "key": (_STRING[0], lambda ns: pa.array([n.key for n in ns], _STRING[1])),
    "pos": ("int", lambda ns: pa.array([n.pos for n in ns], pa.int32())),
    "up": (_LONG[0], lambda ns: pa.array([n.up for n in ns], _LONG[1])),
    "pre": (_LONG[0], lambda ns: pa.array([n.pre for n in ns], _LONG[1])),
    "post": (_LONG[0], lambda ns: pa.array([n.post for n in ns], _LONG[1])),
    "texts": ("map<string,string>", lambda ns: _field_map(ns, False)),
    "typed": ("map<string,struct<value:string,type:string>>", lambda ns: _field_map(ns, True)),
}


def _walked(df: DataFrame, row_id: str, raw: str, map_keys: tuple[str, ...], columns: list[str], entries_only: bool) -> DataFrame:
    keys, maps = gathered_list_keys(df, raw), set(map_keys)
    source = df.select(F.col(row_id).alias("__rec"), F.col(raw).alias("__raw"))
    names = ["fields" if c in ("texts", "typed") else c for c in columns]
    schema = ", ".join([f"__rec {source.schema['__rec'].dataType.simpleString()}", *(f"{n} {_COLUMNS[c][0]}" for n, c in zip(names, columns, strict=True))])
    fields = "fields" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: pa.Array, at: list[int], found: list[Node]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *(_COLUMNS[c][1](found) for c in columns)], ["__rec", *names])

        for batch in batches:
            at, out, size = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                if (record := whole_object(text)) is None:
                    continue
                found = walk(record, keys, maps, not entries_only, fields)
                found = [n for n in found if n.kind in ENTRIES] if entries_only else found
                link(found)
                at += [i] * len(found)
                out += found
                size += sum([len(n.path) for n in found])
                if size > FLUSH:
                    yield made(batch.column(0), at, out)
                    at, out, size = [], [], 0
            yield made(batch.column(0), at, out)

    return source.mapInArrow(run, schema).withColumnRenamed("__rec", row_id)


def nodes(df: DataFrame, row_id: str, raw: str, map_keys: tuple[str, ...] = (), fields: bool = True, links_only: bool = False) -> DataFrame:
    """One row per entry: ``row_id``, node, parent, node_table, pre, post and, if asked for,
    its plain fields as text; with ``links_only`` just ``row_id``, node and parent.

    node is the path, ``[i]`` after the key of a list, ``[key]`` after a key of ``map_keys``;
    null elements hold their position. parent is the nearest entry around it, '' for the
    record. node_table names the table a node belongs to (its path without positions).
    Lines that aren't whole JSON objects, null and blank lines have no nodes; a repeated
    line has its nodes under its own id. Other columns are left out.
    """
    columns = ["node", "parent"] if links_only else ["node", "parent", "node_table", "pre", "post", *(["texts"] if fields else [])]
    return _walked(df, row_id, raw, map_keys, columns, True)


def all_nodes(df: DataFrame, row_id: str, raw: str, map_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per node of whatever kind, nothing left out: ``row_id``, node, parent (nearest
    entry), node_table, kind, key (in its object) or pos (in its list), up (pre of the
    node it stands in, 0 for the record), pre, post, fields (plain values with their type).

    Rows are as for :func:`nodes`; a record without anything in it has its own row. Where a
    key occurs twice in an object, the last one counts, as for any JSON parser.
    """
    return _walked(df, row_id, raw, map_keys, ["node", "parent", "node_table", "kind", "key", "pos", "up", "pre", "post", "typed"], False)


def node_table(all_nodes: DataFrame, name: str) -> DataFrame:
    """The flat table of one type of node."""
    return all_nodes.where(F.col("node_table") == name)


def contained(inner: DataFrame, outer: DataFrame, row_id: str) -> DataFrame:
    """Rows of ``inner`` with the nearest row of ``outer`` around them, found by interval
    containment within a record (an equi-join on the record, then a range test)."""
    o = outer.select(row_id, F.col("node").alias("outer_node"), F.col("pre").alias("__opre"), F.col("post").alias("__opost"))
    near = inner.join(o, row_id).where("__opre < pre and post < __opost")
    keys = [c for c in inner.columns if c != "fields"]
    best = near.groupBy(*keys).agg(F.max_by("outer_node", "__opre").alias("outer_node"))
    return best
