"""Deeply nested semi-structured records as related flat tables.

Texts that are objects or arrays, in JSON or as Python literals and also when
wrapped in quotes as text once more, are opened at any depth.  The records of an
Arrow batch are merged into one schema, a tree of keys and array elements; it is
walked from the top, so that each of its array nodes explodes all arrays that
stand there into the rows of a child table.  A row carries its parent row and
its position in the array, and a value's path is made from these and the keys.
Texts without brackets never leave the JVM.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?:(?P<mark>[\[\]{}:,])
    |(?P<prefix>[uU]|[rR])?(?P<quote>["'])(?P<text>(?:[^"'\\]|\\.|(?!(?P=quote))["'])*)(?P=quote)
    |(?P<number>[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?))(?![\w.])
    |(?P<word>true|false|null|True|False|None|NaN|nan|Infinity|-Infinity)(?!\w))""",
    re.VERBOSE | re.DOTALL,
)
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[0-7]{1,3}|.)", re.DOTALL)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "\n": ""}
#: Characters of texts that are opened together, and rows that are given on at once.
CHARS_AT_ONCE, ROWS_AT_ONCE = 8_000_000, 20_000


def _escaped(match: re.Match) -> str:
    code = match[1]
    if code[0] in "uUx" and len(code) > 1:
        value = int(code[1:], 16)
        return chr(value) if value < 0x110000 else "�"
    if code[0].isdigit():
        return chr(int(code, 8)) if all(c in "01234567" for c in code) else code
    return _PLAIN_ESCAPES.get(code, code)


class _Malformed(ValueError):
    pass


def _finite(number: str) -> float | str:
    """Numbers that JSON can't write stay texts."""
    value = float(number)
    return value if math.isfinite(value) else number


def parse(text: str) -> Any:
    """The value that ``text`` writes, in JSON, as a Python literal or mixed.

    Raises ``ValueError`` if the text as a whole isn't one well-formed value.
    Works without recursion, so depth is limited by memory only.
    """
    stack: list[list] = []  # [container, pending key or None, state]
    at, end = 0, len(text.rstrip())
    root: list = []
    # state of an array: "first", "value", "next"; of an object also "key", "colon"
    while True:
        if at >= end:
            if root and not stack:
                return root[0]
            raise _Malformed(text)
        token = _TOKEN.match(text, at)
        if not token or (root and not stack):
            raise _Malformed(text)
        at = token.end()
        mark = token["mark"]
        frame = stack[-1] if stack else None
        if mark in (",", ":"):
            if not frame or frame[2] != ("next" if mark == "," else "colon"):
                raise _Malformed(text)
            frame[2] = "value" if mark == ":" or isinstance(frame[0], list) else "key"
            continue
        if mark in ("]", "}"):
            if not frame or frame[2] not in ("first", "next") or isinstance(frame[0], list) != (mark == "]"):
                raise _Malformed(text)
            stack.pop()
            continue
        if mark:
            value: Any = [] if mark == "[" else {}
        elif token["quote"]:
            value = token["text"]
            if "\\" in value and token["prefix"] not in ("r", "R"):
                value = _ESCAPE.sub(_escaped, value).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        elif token["number"]:
            value = token["number"]
            value = _finite(value) if any(c in value for c in ".eE") or len(value) > 300 else int(value)
        else:
            value = _WORDS.get(token["word"], token["word"])
        if frame is None:
            root.append(value)
        elif isinstance(frame[0], list):
            if frame[2] not in ("first", "value"):
                raise _Malformed(text)
            frame[0].append(value)
            frame[2] = "next"
        elif frame[2] in ("first", "key"):
            if not isinstance(value, str) or not token["quote"]:
                raise _Malformed(text)
            frame[1], frame[2] = value, "colon"
            continue
        elif frame[2] == "value":
            frame[0][frame[1]] = value
            frame[2] = "next"
        else:
            raise _Malformed(text)
        if mark:
            stack.append([value, None, "first"])


def opened(text: str) -> Any:
    """The object or array that ``text`` is, also when wrapped; else ``text`` itself."""
    inner: Any = text
    while True:  # each wrapping that is opened leaves a shorter text
        if not ("{" in inner and "}" in inner or "[" in inner and "]" in inner):
            return text
        try:
            inner = json.loads(inner, parse_float=_finite, parse_constant=str)
        except (ValueError, RecursionError):
            try:
                inner = parse(inner)
            except ValueError:
                return text
        if isinstance(inner, (dict, list)):
            return inner
        if not isinstance(inner, str):
            return text


def open_deep(text: str) -> tuple[Any, int]:
    """``opened(text)`` with the texts within opened as well; and its depth, 0 for a leaf."""
    root = [text]
    todo: list[tuple[Any, Any, int]] = [(root, 0, 0)]
    deepest = 0
    while todo:
        holder, key, depth = todo.pop()
        value = holder[key]
        if isinstance(value, str):
            value = holder[key] = opened(value)
        if isinstance(value, (dict, list)):
            deepest = max(deepest, depth + 1)
            todo.extend((value, k, depth + 1) for k in (value if isinstance(value, dict) else range(len(value))))
    return root[0], deepest


@dataclass
class _Node:
    """A node of the merged schema: a key below an object, or the elements of an array."""

    parent: _Node | None
    key: str | None  # null for array elements
    level: int = 0
    keys: dict[str, _Node] = field(default_factory=dict)
    element: _Node | None = None
    rows: list[int] = field(default_factory=list)
    values: list[Any] = field(default_factory=list)

    def steps(self, to_row: bool = False) -> list[str | None]:
        """Keys from the top to here, null for elements; with ``to_row`` those since the row began."""
        found, node = [], self
        while node is not None and not (to_row and node.key is None):
            found.append(node.key)
            node = node.parent
        return found[::-1]

    @property
    def pattern(self) -> str:
        return ".".join("[]" if s is None else s for s in self.steps())


@dataclass
class _Rows:
    """Rows of all tables of a batch; the first ones are the records themselves."""

    node: list[_Node | None]  # the array element that a row is, null for a record's own row
    parent: list[int]
    ordinal: list[int]
    paths: dict[int, str] = field(default_factory=dict)

    def explode(self, element: _Node, row: int, values: list) -> None:
        """The elements of an array in ``row`` as rows of the child table."""
        first = len(self.node)
        self.node += [element] * len(values)
        self.parent += [row] * len(values)
        self.ordinal += range(len(values))
        element.rows += range(first, first + len(values))
        element.values += values

    def record(self, row: int) -> int:
        while self.node[row] is not None:
            row = self.parent[row]
        return row

    def path(self, row: int) -> str:
        """Keys and positions from the top to the row; empty for a record's own."""
        if self.node[row] is None:
            return ""
        if row not in self.paths:
            parts, at = [], row
            while at not in self.paths and self.node[at] is not None:
                parts.append(str(self.ordinal[at]))
                parts += reversed(self.node[at].parent.steps(to_row=True))
                at = self.parent[at]
            if at in self.paths:
                parts.append(self.paths[at])
            self.paths[row] = ".".join(reversed(parts))
        return self.paths[row]


def _merged(texts: list[str], roots: list[str], keys: list[str]) -> Iterator[tuple[_Node, _Rows, str, list[tuple[int, str, Any]]]]:
    """The merged schema of the texts, node by node with the values there (row, kind and, of leaves, value)."""
    rows = _Rows([None] * len(texts), [-1] * len(texts), [-1] * len(texts))
    tops: dict[tuple[str, str], _Node] = {}
    for i, (text, root, key) in enumerate(zip(texts, roots, keys, strict=True)):
        node = tops.setdefault((root, key), _Node(None, key))
        node.rows.append(i)
        node.values.append(text)
    todo = [(root, node) for (root, _), node in tops.items()]
    while todo:
        root, node = todo.pop()
        found = []
        for row, value in zip(node.rows, node.values, strict=True):
            if isinstance(value, str):
                value = opened(value)
            if isinstance(value, dict):
                found.append((row, "object", None))
                for key, inner in value.items():
                    child = node.keys.get(key)
                    if child is None:
                        child = node.keys[key] = _Node(node, key, node.level)
                    child.rows.append(row)
                    child.values.append(inner)
            elif isinstance(value, list):
                found.append((row, "array", None))
                if node.element is None:
                    node.element = _Node(node, None, node.level + 1)
                rows.explode(node.element, row, value)
            else:
                found.append((row, "leaf", value))
        node.rows, node.values = [], []
        yield node, rows, root, found
        todo += [(root, child) for child in node.keys.values()]
        if node.element is not None:
            todo.append((root, node.element))


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return ("false", "true")[value] if isinstance(value, bool) else repr(value)


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # halves of surrogate pairs
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


#: Columns of what ``_opened_rows`` gives, by what is asked for.
_LEAVES = "record_id string, root string, path string"
_NODES = "record_id string, root string, level int, row_path string, parent_path string, ordinal bigint, table string, path string, pattern string, kind string, value string"
_SCHEMA = "root string, level int, pattern string, kind string, n_values bigint"


def _opened_rows(asked: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [c.split() for c in asked.split(", ")]
    arrays = {"string": _strings, "int": lambda v: pa.array(v, pa.int32()), "bigint": lambda v: pa.array(v, pa.int64())}

    def leaves(ids, node, rows, root, found):
        tail, is_row = ".".join(node.steps(to_row=True)), node.key is None
        for row, kind, _ in found:
            if kind == "leaf":
                path = rows.path(row)
                yield ids[rows.record(row)], root, path if is_row else f"{path}.{tail}" if rows.node[row] else tail

    def nodes(ids, node, rows, root, found):
        pattern, tail, is_row = node.pattern, ".".join(node.steps(to_row=True)), node.key is None
        for row, kind, value in found:
            path, of = rows.path(row), rows.node[row]
            link = (path, None, None, None) if of is None else (path, rows.path(rows.parent[row]), rows.ordinal[row], of.pattern)
            yield ids[rows.record(row)], root, node.level, *link, path if is_row else f"{path}.{tail}" if of else tail, pattern, kind, _text(value)

    def schema(ids, node, rows, root, found):
        pattern = node.pattern
        for kind, n in Counter(kind for _, kind, _ in found).items():
            yield root, node.level, pattern, kind, n

    give = {_LEAVES: leaves, _NODES: nodes, _SCHEMA: schema}[asked]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([arrays[t](list(c)) for (_, t), c in zip(types, columns, strict=True)], names=[n for n, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            ids, roots, keys, texts = (batch.column(c).to_pylist() for c in ("record_id", "root", "key", "text"))
            low = size = 0
            for high in range(1, len(texts) + 1):
                size += len(texts[high - 1])
                if high < len(texts) and size < CHARS_AT_ONCE:
                    continue
                for found in _merged(texts[low:high], roots[low:high], keys[low:high]):
                    for row in give(ids[low:high], *found):
                        held.append(row)
                        if len(held) >= ROWS_AT_ONCE:
                            yield batch_of(held)
                            held = []
                low, size = high, 0
        if held:
            yield batch_of(held)

    return run


def _is_open(text: Column) -> Column:
    """Whether a text may be an object or array: it has a pair of brackets."""
    has = lambda mark: F.contains(text, F.lit(mark))
    return F.coalesce(has("{") & has("}") | has("[") & has("]"), F.lit(False))


@dataclass(frozen=True)
class FlatTables:
    """What ``flatten`` returns: related flat tables of ``record_id, root, key, text``.

    Each array of the merged schema has a child table, named by its pattern,
    such as ``menu.[].prices.[]``; a null name is the table of the records.

    * ``nodes``: all values of all tables.  ``level`` is the number of arrays
      around the value, ``table`` the table, ``row_key`` the row it belongs to;
      ``parent_key`` and ``ordinal`` (from 0) tell where in which row of the
      table above this row stands.  ``path`` joins keys and positions,
      ``pattern`` has ``[]`` for positions.  ``kind``: object, array or leaf;
      ``value``: the text of a leaf.
    * ``schema``: the merged schema, one row per pattern and kind with the
      number of values.
    """

    entries: DataFrame

    def _with_opened(self, plain: DataFrame, asked: str) -> DataFrame:
        opened_rows = self.entries.where(_is_open(F.col("text"))).select("record_id", "root", "key", "text").mapInArrow(_opened_rows(asked), asked)
        return plain.unionByName(opened_rows)

    @property
    def _plain(self) -> DataFrame:
        return self.entries.where(~_is_open(F.col("text")))

    @property
    def paths(self) -> DataFrame:
        """``record_id, root, path`` of each leaf, once for each of its entries."""
        return self._with_opened(self._plain.select("record_id", "root", F.col("key").alias("path")), _LEAVES)

    @property
    def nodes(self) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        plain = self._plain.select(
            "record_id", "root", F.lit(0).alias("level"), F.lit("").alias("row_path"), none("string").alias("parent_path"), none("bigint").alias("ordinal"), none("string").alias("table"),
            F.col("key").alias("path"), F.col("key").alias("pattern"), F.lit("leaf").alias("kind"), F.col("text").alias("value"),
        )
        key = lambda path: F.when(F.col(path).isNotNull(), F.md5(F.concat_ws("\x1f", F.coalesce("record_id", F.lit("\x1e")), "root", path)))
        found = self._with_opened(plain, _NODES)
        return found.select("record_id", "root", "level", "table", key("row_path").alias("row_key"), key("parent_path").alias("parent_key"), "ordinal", "path", "pattern", "kind", "value")

    @property
    def schema(self) -> DataFrame:
        plain = self._plain.groupBy("root", F.lit(0).alias("level"), F.col("key").alias("pattern"), F.lit("leaf").alias("kind")).agg(F.count(F.lit(1)).alias("n_values"))
        return self._with_opened(plain, _SCHEMA).groupBy("root", "level", "pattern", "kind").agg(F.sum("n_values").alias("n_values"))

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.where(F.col("kind") == "leaf")

    def table(self, level: int) -> DataFrame:
        """The leaves of all tables of one level, with the link to the level above."""
        rows = self.leaves.where(F.col("level") == level)
        return rows.select("record_id", "root", "table", "row_key", "parent_key", "ordinal", F.col("pattern").alias("column"), "value")

    def child(self, root: str, table: str) -> DataFrame:
        """The table of one array: a row per element, a column per leaf of the merged schema.

        ``record_id, row_key, parent_key, ordinal``, then the columns by name, the
        key below the element; ``value`` is an element that is a leaf itself.
        Elements without a leaf of their own have nulls.  The names of the columns
        go to the driver: as many as the merged schema has below this array.
        """
        below = self.schema.where((F.col("root") == root) & (F.col("kind") == "leaf") & (F.col("level") == table.count("[]")) & F.startswith("pattern", F.lit(table)))
        columns = sorted(r["pattern"] for r in below.select("pattern").distinct().collect())
        rows = self.nodes.where((F.col("root") == root) & (F.col("table") == table))
        cell = lambda c: F.max(F.when((F.col("pattern") == c) & (F.col("kind") == "leaf"), F.col("value"))).alias(c[len(table) + 1 :] or "value")
        return rows.groupBy("record_id", "row_key", "parent_key", "ordinal").agg(*([cell(c) for c in columns] or [F.count(F.lit(1)).alias("n_values")]))


def map_entries(df: DataFrame, record_id: str, roots: list[str]) -> DataFrame:
    """``record_id, root, key, text`` of each entry of the map columns ``roots``; null and empty maps have none."""
    parts = None
    for root in roots:
        part = df.select(F.col(record_id).cast("string").alias("record_id"), F.lit(root).alias("root"), F.explode(root).alias("key", "text"))
        part = part.withColumn("text", F.col("text").cast("string"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def flatten(entries: DataFrame) -> FlatTables:
    """Flat tables of ``record_id, root, key, text``, where texts may hold nested values.

    Entries should be distinct: each gives rows of its own.  Empty objects and
    arrays give nodes but no leaves; null is a leaf.  Keys are kept as written;
    of a key that is repeated in one object the last value counts.  Depth and
    size have no limit but the memory for one text.  No step shuffles; each of
    the tables reads the entries once.
    """
    return FlatTables(entries)
