"""Schemas that drift between files: one consistent table and a report of each change.

Each file becomes a schema graph: paths with their types, nested by their keys, with a
sketch of the values. Between a file and the one before it in its stream, match
scores of old and new paths start from names, types and values and are flooded
along the nesting - a pair gains from its parents' and its children's scores - until
they converge. Paths that stay are matched with themselves; of those that go and
those that come, the best pairs above a threshold are renamings. From all renamings
follow groups of paths that mean the same, to which records are cast and united.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.nesting import whole_object
from gaugeworks.operators.ordering import with_previous
from gaugeworks.runtime import bounded_rows

#: Keys below which changes don't count; the table has them all the same.
SKIP = ("timestamp", "scores", "parameters", "calls")
#: Shares of a pair's score that come from its parents and from its children, the
#: least score of a renaming, and that of one into or out of an object that comes or goes.
FROM_PARENT, FROM_CHILDREN, RENAMED, ACROSS = 0.15, 0.4, 0.45, 0.75
#: Distinct paths and renamings that are handled on the driver at most.
PATHS_LIMIT = 200_000

#: Characters of a text that its sketch keeps. A schema carries one sketch per path, and
#: sketches are compared by how they begin.
SKETCH = 24
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass(frozen=True)
class Words:
    """What a caller knows of the words in field names; nothing by default.

    ``same`` are groups of words for one thing, ``both`` words that stand for several, and
    ``empty`` words that say nothing.
    """

    same: tuple[tuple[str, ...], ...] = ()
    both: tuple[tuple[str, tuple[str, ...]], ...] = ()
    empty: frozenset[str] = frozenset()

    @functools.cached_property
    def _maps(self) -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
        return {w: group[0] for group in self.same for w in group}, dict(self.both)

    def of(self, key: str) -> frozenset[str]:
        """What a key says, as a set of words."""
        same, both = self._maps
        found = [same.get(w, w) for x in _WORD.findall(key) for w in both.get(x.lower(), (x.lower(),))]
        told = frozenset(w for w in found if w not in self.empty)
        return told or frozenset(found)


NO_WORDS = Words()


def type_of(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "list"
    return "text" if isinstance(value, str) else "number"


def sketch(value: object) -> str:
    """The look of a value: how a text begins, runs of digits as one, or the magnitude of a
    number; of a list that of its first element."""
    while isinstance(value, list) and value:
        value = value[0]
    if value is None or isinstance(value, (dict, list)):
        return ""
    if isinstance(value, str):
        if re.fullmatch(r"[0-9a-f]{6,}", value):
            return "hex"
        return re.sub(r"\d+", "9", value[: 4 * SKETCH])[:SKETCH]
    try:
        number = abs(float(value))
    except OverflowError:
        number = math.inf
    return f"#{int(math.log10(number)) if number > 0 and math.isfinite(number) else 0}"


def marked_paths(record: dict, skip: frozenset[str], enter: bool) -> Iterator[tuple[str, str, str, bool]]:
    """(path, type, sketch, skipped) of every non-null value at any depth; skipped tells that a
    key of ``skip`` is on its path. Such values are passed over unless ``enter``."""
    stack = [("", False, iter(record.items()))]
    while stack:
        prefix, out, fields = stack[-1]
        for key, value in fields:
            skipped = out or key in skip
            if value is None or skipped and not enter:
                continue
            path = f"{prefix}{key}"
            yield path, type_of(value), sketch(value), skipped
            if isinstance(value, dict):
                stack.append((f"{path}.", skipped, iter(value.items())))
                break
        else:
            stack.pop()


def paths_of(record: dict, skip: frozenset[str]) -> Iterator[tuple[str, str, str]]:
    """(path, type, sketch) of every value that counts."""
    return (p[:3] for p in marked_paths(record, skip, False))


def _alike(a: list[frozenset[str]], b: list[frozenset[str]]) -> np.ndarray:
    """Shared words of all words, for all pairs."""
    at = {w: k for k, w in enumerate(sorted(frozenset().union(*a, *b)))}
    x, y = np.zeros((len(a), len(at))), np.zeros((len(b), len(at)))
    for has, sets in ((x, a), (y, b)):
        for i, words in enumerate(sets):
            has[i, [at[w] for w in words]] = 1
    both = x @ y.T
    return np.divide(both, x.sum(1)[:, None] + y.sum(1)[None, :] - both, out=np.zeros(both.shape), where=both > 0)


def _value_alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a.startswith("#") and b.startswith("#"):
        return max(0.3, 1 - abs(int(a[1:]) - int(b[1:])) / 5)
    head = [re.match(r"[A-Za-z]*", x)[0] for x in (a, b)]
    return 0.8 if head[0] and head[0] == head[1] else 0.5 if "#" in a + b else 0.2


def _values_alike(a: list[str], b: list[str]) -> np.ndarray:
    """Scores of all pairs of sketches; each distinct pair is scored once."""
    (x, of_x), (y, of_y) = (np.unique(np.array(s, dtype=object), return_inverse=True) for s in (a, b))
    return np.array([[_value_alike(p, q) for q in y] for p in x])[of_x][:, of_y]


class Graph:
    """The schema graph of one file."""

    def __init__(self, schema: tuple[tuple[str, str, str], ...], words: Words = NO_WORDS):
        self.paths = ["", *(p for p, _, _ in schema)]
        self.types = ["object", *(t for _, t, _ in schema)]
        self.sketches = ["", *(s for _, _, s in schema)]
        at = {p: i for i, p in enumerate(self.paths)}
        self.parent = np.array([0, *(at.get(p.rpartition(".")[0], 0) for p in self.paths[1:])])
        self.own, self.all = [frozenset()], [frozenset()]
        for p in self.paths[1:]:
            *above, last = [words.of(k) for k in p.split(".")]
            inherited = frozenset().union(*above)
            self.own.append(last - inherited or last)
            self.all.append(last | inherited)
        # nodes in order of their parents, the parents, where each one's children begin, and how many it has
        self.below = np.argsort(self.parent[1:], kind="stable") + 1
        self.inner, self.first, self.fanout = np.unique(self.parent[self.below], return_index=True, return_counts=True)


def flood(a: Graph, b: Graph, still: float = 1e-4) -> np.ndarray:
    """Scores of all pairs of nodes after propagation to convergence.

    Each round moves the scores by at most FROM_PARENT + FROM_CHILDREN = 0.55 of what the
    one before moved them (a parent's score, maxima and means over children change no more
    than what they are taken of), so it always ends, within 17 rounds for scores of 0 to 1.
    """
    n, m = len(a.paths), len(b.paths)
    same_kind = (np.array(a.types) == "object")[:, None] == (np.array(b.types) == "object")[None, :]
    name, path = _alike(a.own, b.own), _alike(a.all, b.all)
    name = np.maximum(name, np.where(path >= 0.6, 0.9 * path, 0.0))
    is_object = (np.array(a.types) == "object")[:, None]
    start = np.where(same_kind, np.where(is_object, name, 0.75 * name + 0.25 * _values_alike(a.sketches, b.sketches)), 0.0)
    at_b = {p: j for j, p in enumerate(b.paths)}
    for i, p in enumerate(a.paths):
        if (j := at_b.get(p)) is not None and same_kind[i, j]:
            start[i, j] = 1.0
    start[0, :], start[:, 0] = 0, 0
    start[0, 0] = 1.0
    inner = np.ix_(a.inner, b.inner)
    below = np.zeros((n, m))
    below[inner] = FROM_CHILDREN
    size = a.fanout[:, None] + b.fanout[None, :]
    score = start
    while True:
        above = score[a.parent][:, b.parent]
        after = (1 - FROM_PARENT - below) * start + FROM_PARENT * above
        # of each node the best score with a child of each parent, summed over the children
        best_of_b = np.maximum.reduceat(score[:, b.below], b.first, axis=1)
        best_of_a = np.maximum.reduceat(score[a.below], a.first, axis=0)
        under = np.add.reduceat(best_of_b[a.below], a.first, axis=0) + np.add.reduceat(best_of_a[:, b.below], b.first, axis=1)
        after[inner] += FROM_CHILDREN * (under / size)
        after[0, :], after[:, 0] = 0, 0
        after[0, 0] = 1
        moved, score = np.abs(after - score).max(), after
        if moved < still:
            return score


def changes(before: tuple[tuple[str, str, str], ...], after: tuple[tuple[str, str, str], ...], words: Words = NO_WORDS) -> list[tuple[str, str, str]]:
    """(change, path_before, path_after) between two schemas of (path, type, sketch)."""
    old, new = {p: t for p, t, _ in before}, {p: t for p, t, _ in after}
    gone, come = {p for p in old if p not in new}, {p for p in new if p not in old}
    out = [("retyped", p, p) for p in old if p in new and old[p] != new[p]]
    if not gone or not come:
        return sorted(out + _rest(gone, come, old, new))
    a, b = Graph(before, words), Graph(after, words)
    score = flood(a, b)
    at_a, at_b = {p: i for i, p in enumerate(a.paths)}, {p: i for i, p in enumerate(b.paths)}
    up = lambda p: p.rpartition(".")[0]
    left_a, left_b = set(gone), set(come)
    below: dict[str, list[str]] = defaultdict(list)  # paths that go, by every object above them
    for p in gone:
        for q in _above(p):
            below[q].append(p)
    renamed: dict[str, str] = {}
    silent: set[str] = set()  # renamed along with an object above

    def candidates(xs: list[str], ys: list[str]) -> list[tuple[float, str, str]]:
        """(-score, x, y) of the pairs that may be renamings as things stand."""
        if not xs or not ys:
            return []
        scores, found = score[np.ix_([at_a[x] for x in xs], [at_b[y] for y in ys])], []
        for i, j in zip(*np.nonzero(scores >= RENAMED), strict=True):
            x, y, s = xs[i], ys[j], float(scores[i, j])
            home = renamed.get(up(x), up(x)) == up(y)
            crosses = not home and (up(x) in gone or up(y) in come)
            if not crosses or s >= ACROSS:
                found.append((-(s + 0.2 * home), x, y))
        return found

    def settle(x: str, y: str) -> None:
        """x became y: what lies below both went along."""
        renamed[x] = y
        left_a.discard(x)
        left_b.discard(y)
        for p in below[x]:
            q = y + p[len(x) :]
            if renamed.get(p) == q:
                silent.add(p)
            elif p in left_a and q in left_b:
                left_a.discard(p)
                left_b.discard(q)
                if old[p] != new[q]:
                    out.append(("retyped", q, q))

    for objects in (True, False):
        xs, ys = ([p for p in left if (types[p] == "object") == objects] for left, types in ((left_a, old), (left_b, new)))
        heap = candidates(xs, ys)
        heapq.heapify(heap)
        best = {(x, y): s for s, x, y in heap}
        while heap:
            s, x, y = heapq.heappop(heap)
            if x not in left_a or y not in left_b or best[x, y] != s:
                continue
            settle(x, y)
            if objects:  # pairs of its children are at home now
                for again in candidates([p for p in below[x] if p in left_a and up(p) == x and old[p] == "object"], [q for q in ys if q in left_b]):
                    best[again[1:]] = again[0]
                    heapq.heappush(heap, again)
    out += [("renamed", x, y) for x, y in renamed.items() if x not in silent]
    return sorted(out + _rest(left_a, left_b, old, new))


def _rest(gone: set[str], come: set[str], old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str]]:
    """What was removed and added, without what lies inside an object that itself was
    removed, added or retyped."""
    inside = lambda p, own, other: any(q in own or q in other and old.get(q) != new.get(q) for q in _above(p))
    kept_a = [p for p in gone if not inside(p, gone, new)]
    kept_b = [p for p in come if not inside(p, come, old)]
    return [("removed", p, "") for p in kept_a] + [("added", "", p) for p in kept_b]


def _above(path: str) -> Iterator[str]:
    while "." in path:
        path = path.rpartition(".")[0]
        yield path


def file_schemas(df: DataFrame, stream: str, seq: str, file: str, raw: str, skip: tuple[str, ...] = SKIP, ordered: bool = True, whole: bool = False) -> DataFrame:
    """(stream, seq, file, schema): the paths of each file with type and sketch.

    Paths are gathered per Arrow batch first, so a file sends a row per path and task, not
    per record. A path of several types has them joined by ``|``.
    Files without stream, seq or file are left out if ``ordered``. With ``whole`` there is
    also a column everything, which holds the paths at and below the keys in ``skip`` too.
    """
    source = df.select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), F.col(file).alias("file"), F.col(raw).alias("raw"))
    if ordered:
        source = source.where("stream is not null and seq is not null and file is not null")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    ignored = frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, str] = {}
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for s, q, f, text in rows:
                if (record := whole_object(text)) is not None:
                    for path, kind, look, skipped in marked_paths(record, ignored, whole):
                        at = (s, q, f, path, kind, skipped)
                        if look < seen.get(at, "\U0010ffff"):
                            seen[at] = look
            columns = list(zip(*seen, strict=True)) if seen else [()] * 6
            types = [batch.schema.field(i).type for i in range(3)] + [pa.string(), pa.string(), pa.bool_()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)] + [pa.array(list(seen.values()), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["stream", "seq", "file", "path", "type", "skipped", "look"])

    rows = source.mapInArrow(run, f"stream {kinds['stream']}, seq {kinds['seq']}, file {kinds['file']}, path string, type string, skipped boolean, look string")
    types = lambda rule: F.array_join(F.array_sort(F.collect_set(F.when(rule, F.col("type")))), "|")
    counts = ~F.col("skipped")
    made = {"type": types(counts), "look": F.min(F.when(counts, F.col("look")))}
    if whole:
        made |= {"any_type": types(F.lit(True)), "any_look": F.min("look")}
    per_path = rows.groupBy("stream", "seq", "file", "path").agg(*[c.alias(n) for n, c in made.items()])
    schema = F.array_sort(F.collect_list(F.when(F.col("type") != "", F.struct("path", "type", "look"))))
    out = [schema.alias("schema")]
    if whole:
        out.append(F.array_sort(F.collect_list(F.struct("path", F.col("any_type").alias("type"), F.col("any_look").alias("look")))).alias("everything"))
    return per_path.groupBy("stream", "seq", "file").agg(*out)


def schema_changes(schemas: DataFrame, words: Words = NO_WORDS) -> DataFrame:
    """(file, change, path_before, path_after) of every file against the one before it in
    its stream; ``schemas`` as from :func:`file_schemas`, ``words`` as known. First files have no changes, and
    neither have files without a whole record, which are passed over."""
    kind = schemas.schema["file"].dataType.simpleString()
    schemas = schemas.where("stream is not null and seq is not null and file is not null and size(schema) > 0").select("stream", "seq", "file", "schema")
    order = with_previous(schemas, "stream", "seq")
    earlier = schemas.select("stream", F.col("seq").alias("prev_seq"), F.col("schema").alias("before"))
    pairs = (
        schemas.join(order.where("prev_seq is not null"), ["stream", "seq"])
        .join(earlier, ["stream", "prev_seq"])
        .where("transform(schema, x -> struct(x.path, x.type)) <> transform(before, x -> struct(x.path, x.type))")
        .select("file", "before", "schema")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for change in changes(*(tuple((e["path"], e["type"], e["look"]) for e in s) for s in (x, y)), words):
                    at.append(i)
                    found.append(change)
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), pa.string()) for c in columns)],
                ["file", "change", "path_before", "path_after"],
            )

    return pairs.mapInArrow(run, f"file {kind}, change string, path_before string, path_after string")


def meanings(schemas: DataFrame, report: DataFrame) -> dict[str, tuple[str, str]]:
    """Path -> (canonical path, canonical type), from all schemas and renamings.

    Renamings join paths to groups; the most frequent path of a group gives its name and
    type. Only distinct paths and renamings reach the driver, checked to be few.
    """
    counted = schemas.select(F.explode("schema").alias("e")).groupBy("e.path", "e.type").count()
    rows = bounded_rows(counted.select("path", "type", "count"), PATHS_LIMIT, "distinct paths")
    pairs = bounded_rows(report.where("change = 'renamed'").select("path_before", "path_after").distinct(), PATHS_LIMIT, "renamings")
    root: dict[str, str] = {}

    def top(p: str) -> str:
        while root.get(p, p) != p:
            p = root[p]
        return p

    ordered = sorted({r[0] for r in rows})
    known = set(ordered)
    for x, y in sorted(tuple(r) for r in pairs):
        inside = ordered[bisect.bisect_left(ordered, f"{x}.") : bisect.bisect_left(ordered, f"{x}/")]  # "/" follows "."
        for p in [x, *inside] if x in known else inside:
            q = y + p[len(x) :]
            if q in known:
                root[top(p)] = top(q)
    seen: dict[str, dict[tuple[str, str], int]] = defaultdict(dict)
    for path, kind, n in rows:
        seen[top(path)][(path, kind)] = n
    best = {t: max(c.items(), key=lambda x: (x[1], x[0]))[0] for t, c in seen.items()}
    # what is an object in most files still needs a column for the lists and texts of the others
    both = {t for t, c in seen.items() if best[t][1] == "object" and any(kind != "object" for _, kind in c)}
    return {path: (best[t][0], "object|text") if (t := top(path)) in both else best[t] for path, _, _ in rows}


# Writings of a number, with a currency sign or groups of thousands; names that end in a version.
_NUMBER = re.compile(r"\s*(?P<sign>[+-]?)\s*[$€£¥]?\s*(?P<n>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)\s*[€£¥]?\s*")
_VERSIONED = re.compile(r"[^\W\d][\w-]*_v(\d+)")


def cast_value(value: object, kind: str) -> object:
    """A value in the canonical type, None if it can't be cast without loss. A list of one is
    its element, a text that is one number, with a currency sign or thousands or without, is
    that number, and ``name_v12`` is 12 where numbers are meant."""
    if isinstance(value, list) and kind != "list":
        if len(value) != 1 and kind == "number":
            return None
        value = value[0] if len(value) == 1 else json.dumps(value)
    if value is None:
        return None
    if kind == "number":
        if isinstance(value, (int, float)):
            try:
                return float(value)
            except OverflowError:
                return None
        if not isinstance(value, str):
            return None
        if m := _NUMBER.fullmatch(value):
            return float(m["sign"] + m["n"].replace(",", ""))
        m = _VERSIONED.fullmatch(value)
        return float(m[1]) if m else None
    return value if isinstance(value, str) else json.dumps(value)


def _column_names(paths: list[str], taken: list[str]) -> dict[str, str]:
    """A column name per path: ``__`` for dots, with a number where it is taken in any case."""
    used = {k.lower() for k in taken}
    out: dict[str, str] = {}
    for p in paths:
        name, k = p.replace(".", "__"), 2
        while name.lower() in used:
            name, k = f"{p.replace('.', '__')}_{k}", k + 1
        used.add(name.lower())
        out[p] = name
    return out


def united(df: DataFrame, keys: list[str], raw: str, meaning: dict[str, tuple[str, str]], skip: tuple[str, ...] = ()) -> DataFrame:
    """One table of all records: ``keys`` and a column per canonical path, cast and united.

    Column names are canonical paths with ``__`` for dots. Only keys in ``skip`` are left
    out, by default none. Where several paths of one record
    mean the same, the canonical one goes first. Broken lines give no row. Objects given as
    text are opened. What has no place in a column is in ``rest``, a JSON list of [path,
    value]: values that can't be cast, second values of one meaning, empty objects, and
    paths that ``meaning`` doesn't have. It is null where nothing is left.
    """
    names = sorted({p for p, t in meaning.values() if t != "object"})
    kinds = {p: t for p, t in meaning.values()}
    ignored = frozenset(skip)
    source = df.select(*keys, F.col(raw).alias("__raw"))
    named = _column_names(names, [*keys, "rest"])
    columns = [f"`{named[n].replace('`', '``')}` {'double' if kinds[n] == 'number' else 'string'}" for n in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), *columns, "rest string"])

    def leaves(record: dict) -> Iterator[tuple[str, object]]:
        stack = [("", iter(record.items()))]
        while stack:
            prefix, fields = stack[-1]
            for key, value in fields:
                if value is None or key in ignored:
                    continue
                if isinstance(value, str) and value[:1] == "{" and (inner := whole_object(value)) is not None:
                    value = inner
                if isinstance(value, dict) and value:
                    stack.append((f"{prefix}{key}.", iter(value.items())))
                    break
                yield f"{prefix}{key}", value
            else:
                stack.pop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, left = [], {n: [] for n in names}, []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                if (record := whole_object(text)) is None:
                    continue
                at.append(i)
                row: dict[str, object] = {}
                origin: dict[str, tuple[str, object]] = {}
                rest: list[tuple[str, object]] = []
                for path, value in leaves(record):
                    canonical, kind = meaning.get(path, (path, ""))
                    cast = cast_value(value, kind) if canonical in out and value != {} else None
                    if cast is None or canonical in row and path != canonical:
                        rest.append((path, value))
                        continue
                    if canonical in row:
                        rest.append(origin[canonical])
                    row[canonical], origin[canonical] = cast, (path, value)
                left.append(json.dumps(rest) if rest else None)
                for n in names:
                    out[n].append(row.get(n))
            rows = pa.array(at, pa.int32())
            arrays = [batch.column(k).take(rows) for k in range(len(keys))]
            arrays += [pa.array(out[n], pa.float64() if kinds[n] == "number" else pa.string()) for n in names]
            arrays.append(pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*keys, *named.values(), "rest"])

    return source.mapInArrow(run, schema)


def leftovers(table: DataFrame) -> DataFrame:
    """(path, n): how many values of each path have no column in a table of :func:`united`,
    because they couldn't be cast or another value of the same meaning was there."""
    pairs = table.where("rest is not null").select(F.explode(F.from_json("rest", "array<array<string>>")).alias("e"))
    return pairs.groupBy(F.col("e")[0].alias("path")).agg(F.count("*").alias("n"))
