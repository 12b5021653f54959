"""Problem 5: deeply nested records as related flat tables.

Method: columnar shredding. A schema names the leaves that matter; every record is taken apart into one column per leaf
of (repetition level, definition level, value). The repetition level says at which repeated ancestor an entry goes on, the
definition level how much of the path exists. One table per repeated ancestor, with the links to its parents,
is then reconstructed from the level sequences alone, by cumulative sums over whole batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    """A field of the schema: its spellings, whether it repeats, what is below it, and the key of a wrapped scalar."""

    names: tuple[str, ...]
    repeated: bool = False
    children: dict[str, "Node"] = field(default_factory=dict)
    unwrap: tuple[str, ...] = ()


@dataclass
class Levels:
    """One leaf: repetition levels, definition levels and values (one per entry, None where not defined)."""

    rep: list[int] = field(default_factory=list)
    dfn: list[int] = field(default_factory=list)
    values: list = field(default_factory=list)


def _get(obj, names: tuple[str, ...]):
    """The first non-null value of the spellings."""
    if isinstance(obj, dict):
        for n in names:
            if obj.get(n) is not None:
                return obj[n]
    return None


def _constant(name):
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*"|-?\d[-+.eE\d]*|true|false|null))')


def _deep_loads(text: str):
    """Strict JSON of any depth, by a stack of open containers."""
    # An open container is [value, state, key]; states: what may come next.
    stack: list[list] = []
    at, done, out, end = 0, False, None, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or done:
            raise ValueError(text[at : at + 20])
        at, sign = m.end(), m[1]
        top = stack[-1] if stack else None
        state = top[1] if top else "value"
        if sign in ("[", "{") and sign and state in ("value", "first"):
            new = [[] if sign == "[" else {}, "first" if sign == "[" else "first key", None]
            if top:
                top[1] = "next"
            stack.append(new)
            continue
        if sign == ":" and state == "colon":
            top[1] = "value"
            continue
        if sign == "," and state == "next":
            top[1] = "value" if isinstance(top[0], list) else "key"
            continue
        if sign and sign in "]}" and top and state in ("next", "first" if sign == "]" else "first key") and isinstance(top[0], list) == (sign == "]"):
            value = stack.pop()[0]
            top = stack[-1] if stack else None
        elif m[2] and state in ("key", "first key") and m[2][0] == '"':
            top[2], top[1] = json.loads(m[2]), "colon"
            continue
        elif m[2] and state in ("value", "first"):
            value = json.loads(m[2])
        else:
            raise ValueError(text[at : at + 20])
        if top is None:
            out, done = value, True
        else:
            if isinstance(top[0], list):
                top[0].append(value)
            else:
                top[0][top[2]] = value
            top[1] = "next"
    if not done:
        raise ValueError("incomplete")
    return out


def _strict(text: str):
    text = text.lstrip("\ufeff")
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        return _deep_loads(text)


def loads(text: str):
    """Strict JSON of any depth; a byte order mark before it and JSON within a JSON string are seen through."""
    value = _strict(text)
    while isinstance(value, str):
        value = _strict(value)
    return value


def _elements(value) -> list:
    """A repeated field's elements: a list, a lone object, or a list written as a string."""
    if isinstance(value, str):
        try:
            value = loads(value)
        except ValueError:
            return []
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


class Shredder:
    """Takes records apart by a schema; ``columns`` maps each leaf's path to its levels."""

    def __init__(self, root: dict[str, Node]):
        self.root = root
        self.columns: dict[str, Levels] = {}
        self._leaves(root, "")
        self.under = {id(n): [p for p in self.columns if p == path or p.startswith(path + ".")] for path, n in self._nodes(root, "")}

    def _nodes(self, children, prefix):
        for name, node in children.items():
            yield prefix + name, node
            yield from self._nodes(node.children, prefix + name + ".")

    def _leaves(self, children, prefix):
        for name, node in children.items():
            if node.children:
                self._leaves(node.children, prefix + name + ".")
            else:
                self.columns[prefix + name] = Levels()

    def add(self, record) -> None:
        """Appends one record; anything not an object counts as an object without fields."""
        for name, node in self.root.items():
            self._field(record, name, node, 0, 0, 0)

    def _missing(self, node, rep, dfn):
        for path in self.under[id(node)]:
            c = self.columns[path]
            c.rep.append(rep)
            c.dfn.append(dfn)
            c.values.append(None)

    def _field(self, parent, path, node, rep, depth, dfn):
        value = _get(parent, node.names)
        if node.repeated:
            items = _elements(value) if value is not None else []
            if not items:
                self._missing(node, rep, dfn)
            for i, item in enumerate(items):
                self._value(item, path, node, rep if i == 0 else depth + 1, depth + 1, dfn + 1)
        else:
            self._value(value, path, node, rep, depth, dfn)

    def _value(self, value, path, node, rep, depth, dfn):
        if isinstance(value, dict) and node.unwrap:
            value = _get(value, node.unwrap)
        if value is None:
            self._missing(node, rep, dfn)
        elif node.children:
            for name, child in node.children.items():
                self._field(value, path + "." + name, child, rep, depth, dfn + 1)
        else:
            c = self.columns[path]
            c.rep.append(rep)
            c.dfn.append(dfn + 1)
            c.values.append(value)


def positions(rep: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(which parent, position in it) of each entry of the repeated ancestor at ``level``.

    An entry belongs to a new element of that ancestor unless its repetition level is deeper; the parent is the element of the
    ancestor one level up (at level 1: the record).
    """
    element = np.cumsum(rep <= level) - 1
    parent = np.cumsum(rep <= level - 1) - 1
    firsts = np.flatnonzero(rep <= level - 1)
    return parent, element - element[firsts][parent] if len(rep) else element


@dataclass
class Table:
    """The elements of one repeated ancestor: the record of each, its positions in its repeated ancestors from the outermost to itself,
    and of each leaf below it (without another repetition between) definition levels, values, and the level of a value that is there."""

    record: np.ndarray
    at: list[np.ndarray]
    leaves: dict[str, tuple[np.ndarray, list, int]]

    def there(self, leaf: str) -> np.ndarray:
        """Where a leaf has a value."""
        levels, _, most = self.leaves[leaf]
        return levels == most


def schema_of(spec: dict) -> dict[str, Node]:
    """A schema of nested dicts: ``{"segments|segment_list[]": {"kind": None}}``; other spellings after ``|``, ``[]`` for what repeats.

    A leaf's value may be the key (or keys, by ``|``) of an object that may wrap it: ``{"point": "latLng|lat_lng"}``.
    """
    out = {}
    for name, below in spec.items():
        names = tuple(name.removesuffix("[]").split("|"))
        wrapped = tuple(below.split("|")) if isinstance(below, str) else ()
        out[names[0]] = Node(names, name.endswith("[]"), schema_of(below) if isinstance(below, dict) else {}, wrapped)
    return out


def _repeated(children: dict[str, Node], prefix: str = "", level: int = 0, dfn: int = 0) -> Iterator[tuple[str, int, int]]:
    """(path, repetition level, definition level of an element) of every repeated field."""
    for name, node in children.items():
        path = prefix + name
        if node.repeated:
            yield path, level + 1, dfn + 1
        yield from _repeated(node.children, path + ".", level + node.repeated, dfn + 1 + node.repeated)


def _leaf_levels(children: dict[str, Node], prefix: str = "", owner: str = "", dfn: int = 0) -> Iterator[tuple[str, str, int]]:
    """(path, nearest repeated ancestor, definition level of a value) of every leaf."""
    for name, node in children.items():
        path = prefix + name
        own, most = (path if node.repeated else owner), dfn + 1 + node.repeated
        if node.children:
            yield from _leaf_levels(node.children, path + ".", own, most)
        else:
            yield path, own, most


def table_of(shredder: Shredder, path: str) -> Table:
    """The table of a repeated ancestor (``""``: the records themselves), from the level sequences alone."""
    level, least = next(((r, d) for p, r, d in _repeated(shredder.root) if p == path), (0, 0))
    leaves = [(p, own, most) for p, own, most in _leaf_levels(shredder.root) if own == path or own.startswith(f"{path}." if path else "")]
    # Any leaf below tells of the elements; one without another repetition has one entry for each.
    guide = shredder.columns[min(leaves, key=lambda x: x[1] != path)[0]]
    rep, dfn = np.array(guide.rep, np.int64), np.array(guide.dfn, np.int64)
    at = np.flatnonzero((rep <= level) & (dfn >= least))
    record = np.cumsum(rep == 0) - 1
    numbers = [positions(rep, k)[1][at] for k in range(1, level + 1)]
    values = {}
    for p, own, most in leaves:
        if own == path:
            c = shredder.columns[p]
            values[p] = (np.array(c.dfn, np.int64)[at], [c.values[k] for k in at.tolist()], most)
    return Table(record[at], numbers, values)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _records(batches: Iterator[pa.RecordBatch], root: dict[str, Node], locate) -> Iterator[tuple[list, Shredder]]:
    """(keys, what the records were taken apart into), a few megabytes at a time."""
    for batch in batches:
        keys, shredder, held = [], Shredder(root), 0
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            try:
                found = locate(loads(text)) if text else None
            except ValueError:
                found = None
            if found is None:
                continue
            keys.append(k)
            shredder.add(found)
            held += len(text)
            if held > 4_000_000:
                yield keys, shredder
                keys, shredder, held = [], Shredder(root), 0
        if keys:
            yield keys, shredder


def _payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(payload).cast("string").alias("payload"))
    return rows.where(F.col("key").isNotNull() & F.col("payload").isNotNull())


def shred(df: DataFrame, key: str, payload: str, spec: dict, locate=None) -> dict[str, DataFrame]:
    """One flat table for each repeated field of a schema (see ``schema_of``), and ``""`` for the records themselves.

    A table has ``record_key``; for each repeated ancestor from the outermost to itself ``<name>_no``, the position in it (from 0, nulls
    counted), which link it to the tables above; and each leaf without another repetition between, as text (objects as JSON), named
    by its path below the table with ``_`` for dots. ``locate`` finds the object that the schema describes in a parsed payload (None: no
    record); without it, it is the payload. Null, empty and damaged payloads and null keys give nothing; equal rows each give
    their rows; an empty table gives empty ones; other columns do not matter, whatever their names. Each table reads
    the payloads when it is read; where several are, write the payloads' common columns first.
    """
    root, locate = schema_of(spec), locate or (lambda value: value)
    rows, out = _payloads(df, key, payload), {}
    paths = {path: level for path, level, _ in _repeated(root)}
    for path in ["", *paths]:
        above = [p for p in paths if path == p or path.startswith(p + ".")]
        leaves = [p for p, own, _ in _leaf_levels(root) if own == path]
        names = {p: (p[len(path) + 1 :] if path else p).replace(".", "_") or "value" for p in leaves}
        columns = ["record_key", *(f"{p.rpartition('.')[2]}_no" for p in above), *names.values()]
        schema = pa.schema([(c, pa.int64()) for c in columns[: 1 + len(above)]] + [(c, pa.string()) for c in columns[1 + len(above) :]])

        def run(batches, path=path, leaves=leaves, schema=schema):
            for keys, shredder in _records(batches, root, locate):
                t = table_of(shredder, path)
                arrays = [np.array(keys, np.int64)[t.record], *t.at, *([_text(v) if d == most else None for d, v in zip(levels.tolist(), values)] for levels, values, most in (t.leaves[p] for p in leaves))]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)

        out[path] = rows.mapInArrow(run, ", ".join(f"`{f.name}` {'bigint' if f.type == pa.int64() else 'string'}" for f in schema))
    return out


# ---- location-history exports ---------------------------------------------------------------------------------------

#: The parts of an export that matter here.
EXPORT = {
    "semanticSegments|semantic_segments[]": {
        "visit": None,
        "activity": {"topCandidate|top_candidate": {"type": None}},
        "timelinePath|timeline_path[]": {"point": "latLng|lat_lng"},
    }
}
_SEGMENTS = ("semanticSegments", "semantic_segments")
_SEGMENT, _PATH = "semanticSegments", "semanticSegments.timelinePath"
_NUMBER = re.compile(r"[-+\u2212]?(?:\d+(?:\.\d*)?|\.\d+)")
_WORDS = re.compile(r"[a-z]+")


def readable_place(text) -> bool:
    """Whether a text holds exactly one latitude and one longitude; the rule of ``functions.coords.with_lat_lng``."""
    if not isinstance(text, str):
        return False
    numbers = _NUMBER.findall(text)
    if len(numbers) != 2:
        return False
    a, b = (float(n.replace("\u2212", "-")) for n in numbers)
    words = _WORDS.findall(text.lower())
    if len(words) == 2 and all(len(w) == 1 and w in "nsew" for w in words):
        if words[0] in "ew" and words[1] in "ns":
            a, b = b, a
        elif words[0] in "ns" and words[1] in "ns" or words[0] in "ew":
            return False
    elif words and words[0] in ("lng", "lon", "long", "longitude") and any(w in ("lat", "latitude") for w in words[1:]):
        a, b = b, a
    return abs(a) <= 90 and abs(b) <= 180 and (a, b) != (0.0, 0.0)


def find_segments(value):
    """The object that holds the list of segments, whatever objects and lists wrap it, at any depth, the first in the order of the
    document; a bare list without such an object in it is the list of segments itself."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if any(k in x for k in _SEGMENTS):
                return x
            stack += [v for v in reversed(x.values()) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            stack += [v for v in reversed(x) if isinstance(v, (dict, list))]
    return {_SEGMENTS[0]: value} if isinstance(value, list) else None


def _assemble(keys: list, shredder: Shredder, schema: pa.Schema) -> pa.RecordBatch:
    """The flat rows of a batch of records."""
    segments, path = table_of(shredder, _SEGMENT), table_of(shredder, _PATH)
    visited = segments.there(f"{_SEGMENT}.visit")
    activity, types, most = segments.leaves[f"{_SEGMENT}.activity.topCandidate.type"]
    # An activity that is there reaches two levels less than a type that is.
    moved = activity >= most - 2
    moves = np.flatnonzero(moved & ~visited)
    modes = [types[i] if isinstance(types[i], str) and types[i] != "UNKNOWN_ACTIVITY_TYPE" else "UNKNOWN" for i in moves]
    # The segment of each path element, by record and position.
    number = np.int64(1) << 32
    key_of = lambda t: t.record * number + t.at[0]
    owner = np.searchsorted(key_of(segments), key_of(path))
    _, points, _ = path.leaves[f"{_PATH}.point"]
    fixes = np.array([i for i in np.flatnonzero(path.there(f"{_PATH}.point") & ~(visited | moved)[owner]) if readable_place(points[i])], np.int64)
    ids = np.array(keys, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[segments.record[moves]], ids[path.record[fixes]]])),
            pa.array(np.concatenate([segments.at[0][moves], path.at[0][fixes]])),
            pa.array(["activity"] * len(moves) + ["path_point"] * len(fixes), pa.string()),
            pa.array(np.concatenate([np.zeros(len(moves), np.int64), path.at[1][fixes]])),
            pa.array([*modes, *[""] * len(fixes)], pa.string()),
        ],
        schema=schema,
    )


def flatten_exports(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``export_id, segment_no, child_kind, child_no, mode_name``: the moves and path points of exported histories.

    ``key`` is an integer column, ``payload`` the JSON text. Keys count in camel and snake case; the segments may be wrapped in
    other objects and lists at any depth, be a bare list, or be JSON within JSON; a path may be a lone object or a list written as text. Null,
    empty, damaged and segment-less payloads and null keys give nothing; equal rows each give their rows; an empty table gives none;
    other columns do not matter, whatever their names. Very long payloads are taken apart a few megabytes at a time.
    """
    schema = pa.schema([("export_id", pa.int64()), ("segment_no", pa.int64()), ("child_kind", pa.string()), ("child_no", pa.int64()), ("mode_name", pa.string())])
    root = schema_of(EXPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, shredder in _records(batches, root, find_segments):
            yield _assemble(keys, shredder, schema)

    return _payloads(df, key, payload).mapInArrow(run, "export_id bigint, segment_no bigint, child_kind string, child_no bigint, mode_name string")
