"""Flat related tables from nested documents by shared inlining."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Distinct (element, member) edges of a schema graph that reach the driver. Where there are more, elements of more than
#: ``MAX_MEMBERS`` members are maps: their members are data, not a schema, and share one element, ``<map>.*``. If there are
#: no such elements, the widest ones are; after ``MAX_PASSES`` passes over the column every element is.
MAX_EDGES = 200_000
MAX_MEMBERS = 1_000
MAX_PASSES = 12

#: Rows, and characters of their paths, that leave Python in one batch.
_ROWS, _CHARACTERS = 50_000, 16_000_000

_EDGE = pa.schema([("parent", pa.string()), ("member", pa.string()), ("kind", pa.string())])
_ROW = pa.schema(
    [
        ("table_name", pa.string()),
        ("path", pa.string()),
        ("parent_path", pa.string()),
        ("parent_table", pa.string()),
        ("member", pa.string()),
        ("ordinal", pa.int64()),
        ("is_object", pa.bool_()),
        ("in_array", pa.bool_()),
        ("object_path", pa.string()),
        ("columns", pa.map_(pa.string(), pa.string())),
    ]
)
ROOT = "$"


def read_document(text: str | None):
    """The value of a document, or None where it is null or unreadable.

    A document wholly wrapped in a JSON string is unwrapped, however often it was
    wrapped. Strings inside a document are not opened. Of repeated members of one object the
    last counts. Documents nested too deeply for the parser are read by
    ``_deep``.
    """
    try:
        value = text
        while isinstance(value, str):
            value = _parse(value)
        return value
    except ValueError:
        return None


def _parse(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


_SCAN = json.JSONDecoder()


def _deep(text: str):
    """Parses containers with an explicit stack; scalars are left to the library."""
    space = " \t\n\r"
    at, n = 0, len(text)
    stack: list[tuple[object, str | None]] = []
    value, have = None, False

    def skip(i: int) -> int:
        while i < n and text[i] in space:
            i += 1
        return i

    def member(i: int) -> tuple[str, int]:
        i = skip(i)
        if i >= n or text[i] != '"':
            raise ValueError("member name expected")
        name, i = _SCAN.raw_decode(text, i)
        i = skip(i)
        if i >= n or text[i] != ":":
            raise ValueError("colon expected")
        return name, i + 1

    while True:
        at = skip(at)
        if at >= n:
            raise ValueError("cut off")
        c = text[at]
        if c in "[{":
            box: object = [] if c == "[" else {}
            at = skip(at + 1)
            if at < n and text[at] == ("]" if c == "[" else "}"):
                at, value, have = at + 1, box, True
            else:
                name = None
                if c == "{":
                    name, at = member(at)
                stack.append((box, name))
                continue
        else:
            value, at = _SCAN.raw_decode(text, at)
            have = True
        while have:
            if not stack:
                if skip(at) != n:
                    raise ValueError("extra data")
                return value
            box, name = stack.pop()
            if isinstance(box, list):
                box.append(value)
            else:
                box[name] = value
            at = skip(at)
            if at >= n:
                raise ValueError("cut off")
            if text[at] == ",":
                at += 1
                if isinstance(box, dict):
                    name, at = member(at)
                stack.append((box, name))
                have = False
            elif text[at] == ("]" if isinstance(box, list) else "}"):
                at, value = at + 1, box
            else:
                raise ValueError("comma expected")


class _Every(frozenset):
    """All elements are maps and share one element."""

    def __contains__(self, name: object) -> bool:
        return True


def _map_part(name: str, maps: frozenset[str]) -> str:
    """The element of a map's members."""
    return f"{ROOT}.*" if isinstance(maps, _Every) else name + ".*"


def _edges(value, maps: frozenset[str] = frozenset(), seen: dict[str, tuple[set[str], ...]] | None = None) -> Iterator[tuple[str, str, str]]:
    """(element, member, kind) edges of one document. An element is named by the member
    that holds it; the parts of an array are elements of the array's name. ``*``
    marks a repeated child, ``1`` a singleton object, ``=`` a scalar. Edges in ``seen`` (members by element and kind) are left
    out, the others are added to it."""
    seen = defaultdict(_kinds) if seen is None else seen
    stack = [(ROOT, value)]
    while stack:
        name, v = stack.pop()
        objects, arrays, scalars, parts = seen[name]
        if isinstance(v, dict):
            part = _map_part(name, maps) if name in maps else None
            for m, x in v.items():
                if part is not None:
                    m = part
                if isinstance(x, dict):
                    stack.append((m, x))
                    if m not in objects:
                        objects.add(m)
                        yield name, m, "1" if part is None else "*"
                elif isinstance(x, list):
                    stack.append((m, x))
                    if m not in arrays:
                        arrays.add(m)
                        yield name, m, "*"
                elif m not in scalars:
                    scalars.add(m)
                    yield name, m, "="
        elif isinstance(v, list):
            for x in v:
                kind = "[" if isinstance(x, list) else "*{" if isinstance(x, dict) else "*="
                if kind != "*=":
                    stack.append((name, x))
                if kind not in parts:
                    parts.add(kind)
                    yield name, name, kind


def _kinds() -> tuple[set[str], set[str], set[str], set[str]]:
    """Members that are objects, arrays and scalars, and kinds of parts."""
    return set(), set(), set(), set()


@dataclass
class Inlining:
    """Which elements have tables of their own; all others are columns of an ancestor's table."""

    tables: frozenset[str]
    reasons: dict[str, str] = field(default_factory=dict)
    maps: frozenset[str] = frozenset()

    @staticmethod
    def of(edges: list[tuple[str, str, str]], maps: frozenset[str] = frozenset()) -> Inlining:
        """Shared inlining over the schema graph.

        An element gets a table if it is the root, repeated (below an array), shared
        (objects of it under more than one element) or recursive (on a cycle).
        """
        parents: dict[str, set[str]] = defaultdict(set)
        children: dict[str, set[str]] = defaultdict(set)
        why: dict[str, str] = {ROOT: "root"}
        for parent, member, kind in edges:
            if kind in ("1", "*"):
                parents[member].add(parent)
                children[parent].add(member)
        repeated = {m for _, m, kind in edges if kind in ("*", "*{", "*=", "[")}
        for m in sorted(repeated):
            why.setdefault(m, "repeated")
        for m in sorted(parents):
            if len(parents[m]) > 1:
                why.setdefault(m, "shared")
        for m in _on_cycles(children):
            why.setdefault(m, "recursive")
        return Inlining(frozenset(why), why, maps)


def _on_cycles(children: dict[str, set[str]]) -> set[str]:
    """Nodes on cycles: strongly connected components of more than one node, and self loops."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, out = set(), [], set()
    for start in sorted(children):
        if start in index:
            continue
        work = [(start, iter(sorted(children.get(start, ()))))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, it = work[-1]
            for c in it:
                if c not in index:
                    index[c] = low[c] = len(index)
                    stack.append(c)
                    on.add(c)
                    work.append((c, iter(sorted(children.get(c, ())))))
                    break
                if c in on:
                    low[node] = min(low[node], index[c])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1 or node in children.get(node, ()):
                        out.update(part)
    return out


def _scalar(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else json.dumps(v)


def shred_document(value, inlining: Inlining) -> Iterator[tuple]:
    """The rows of one document, with the columns of ``_ROW``, in no order.

    ``parent_path`` and ``parent_table`` are the foreign key to the row that the
    element hangs on; the root row has the path ''. ``object_path`` is the path of the
    nearest enclosing object that is a direct part of an array, '' if there is none.
    """
    if value is None:
        return
    tables, maps = inlining.tables, inlining.maps
    # path, parent path, parent table, nearest object in an array, element, member, ordinal, in an array, value
    stack = [("", "", "", "", ROOT, ROOT, 0, False, value)]
    while stack:
        path, ppath, ptable, near, element, member, ordinal, in_array, v = stack.pop()
        columns: dict[str, str | None] = {}
        is_object = isinstance(v, dict)
        below = path if in_array and is_object else near
        arrays: list[tuple[str, str, str, list]] = []
        if is_object:
            todo = [("", path, element, v)]
            while todo:
                prefix, at, of, obj = todo.pop()
                part = _map_part(of, maps) if of in maps else None
                dot = at + "." if at else ""
                for m, x in obj.items():
                    if isinstance(x, str):
                        columns[prefix + m] = x
                    elif isinstance(x, list):
                        if x:
                            arrays.append((dot + m, part or m, prefix + m, x))
                    elif not isinstance(x, dict):
                        columns[prefix + m] = _scalar(x)
                    elif (name := part or m) in tables:
                        stack.append((dot + m, path, element, below, name, prefix + m, 0, False, x))
                    else:
                        todo.append((prefix + m + ".", dot + m, name, x))
        elif isinstance(v, list):
            arrays.append((path, element, "", v))
        else:
            columns["value"] = _scalar(v)
        yield element, path, ppath, ptable, member, ordinal, is_object, in_array, near, columns
        for where, name, m, array in arrays:
            for i, x in enumerate(array):
                if isinstance(x, (dict, list)):
                    stack.append((f"{where}[{i}]", path, element, below, name, m, i, True, x))
                else:
                    yield name, f"{where}[{i}]", path, element, m, i, False, True, below, {"value": _scalar(x)}


def schema_graph(df: DataFrame, column: str, maps: frozenset[str] = frozenset()) -> DataFrame:
    """Distinct (parent, member, kind) edges of all documents of a column."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[set[str], ...]] = defaultdict(_kinds)
        for b in batches:
            new = [e for text in b.column(0).to_pylist() for e in _edges(read_document(text), maps, seen)]
            if sum(map(len, chain.from_iterable(seen.values()))) > MAX_EDGES:
                seen.clear()
            if new:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_sound(y) for y in x], pa.string()) for x in zip(*new)], schema=_EDGE
                )

    return df.select(F.col(f"`{column}`").cast("string")).mapInArrow(edges, "parent string, member string, kind string").distinct()


def analyse(df: DataFrame, column: str) -> Inlining:
    """The inlining of a column's schema graph. At most ``MAX_EDGES`` distinct edges reach the driver. A larger graph is
    gone over again with its widest elements as maps, level by level, and at last with all of them; none is refused."""
    ship(df.sparkSession)
    maps: frozenset[str] = frozenset()
    for left in reversed(range(MAX_PASSES)):
        graph = schema_graph(df, column, maps)
        rows = graph.limit(MAX_EDGES + 1).collect()
        if len(rows) <= MAX_EDGES:
            break
        wide = graph.groupBy("parent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent").limit(1000)
        widths = {r[0]: r[1] for r in wide.collect() if r[0] not in maps}
        widest = max(widths.values(), default=0)
        least = MAX_MEMBERS if widest > MAX_MEMBERS else widest // 2
        maps = maps | {name for name, n in widths.items() if n > least} if widths and left > 1 else _Every()
    return Inlining.of([(r[0], r[1], r[2]) for r in rows], maps)


def _documents(df: DataFrame, key: F.Column | str, column: str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.coalesce(key.cast("string"), F.lit("")).alias("root_key"), F.col(f"`{column}`").cast("string").alias("doc"))


def shred(df: DataFrame, root_table: str, key: F.Column | str, column: str, inlining: Inlining | None = None) -> DataFrame:
    """Flat related rows of the nested documents in ``column``.

    Output, one row per element with a table of its own: ``root_table``, ``root_key``, ``doc_id``,
    ``table_name``, ``path``, ``parent_path``, ``parent_table``, ``member``, ``ordinal``,
    ``is_object``, ``in_array``, ``object_path`` and ``columns`` (name to text of the scalars inlined into the row).
    (``doc_id``, ``path``) is the key, (``doc_id``, ``parent_path``) the foreign key to the parent's
    row, ``root_key`` that to the source row. ``table_of`` cuts one table out.

    Semantics
    - ``doc_id`` is the MD5 of key and document: a key that is delivered with several documents, or no key at all, keeps
      the rows of its documents apart. The same document of the same key counts once.
    - Null and unreadable documents, among them cut-off ones, give no rows; an empty object gives a
      root row without columns; an empty array gives no rows of its own.
    - A member that is null is a column with a null value; an absent member is no
      column. Documents wrapped in a string are unwrapped. A lone surrogate comes out as a replacement character.
    - A null key is the empty string.

    Scale: two passes over the column (the graph, then the rows); the distinct edges and the distinct documents are shuffled,
    both combined map-side. A document's rows are made in one go and leave in batches.
    """
    ship(df.sparkSession)
    inlining = inlining or analyse(df, column)
    plan = Inlining(inlining.tables, maps=inlining.maps)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []
            size = 0
            for i, text in enumerate(b.column(2).to_pylist()):
                for r in shred_document(read_document(text), plan):
                    at.append(i)
                    out.append(r)
                    size += len(r[1])
                    if len(out) >= _ROWS or size >= _CHARACTERS:
                        yield _batch(b, at, out)
                        at, out, size = [], [], 0
            if out:
                yield _batch(b, at, out)

    source = _documents(df, key, column).where("doc is not null").distinct()
    source = source.select("root_key", F.md5(F.concat("root_key", F.lit("\n"), "doc")).alias("doc_id"), "doc")
    made = source.mapInArrow(
        rows,
        "root_key string, doc_id string, table_name string, path string, parent_path string, parent_table string, "
        "member string, ordinal long, is_object boolean, in_array boolean, object_path string, columns map<string,string>",
    )
    return made.select(F.lit(root_table).alias("root_table"), "*")


def _batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """The rows with key and document id of the documents that they came from."""
    *flat, maps = zip(*rows)
    flat += [list(chain.from_iterable(maps)), [x for m in maps for x in m.values()]]
    types = [f.type for f in _ROW][:-1] + [pa.string()] * 2
    try:
        arrays = [pa.array(c, t) for c, t in zip(flat, types)]
    except UnicodeEncodeError:
        arrays = [pa.array(_sound(c), t) for c, t in zip(flat, types)]
    *arrays, names, values = arrays
    columns = pa.MapArray.from_arrays(pa.array([0, *accumulate(map(len, maps))], pa.int32()), names, values)
    take = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *arrays, columns], names=["root_key", "doc_id", *_ROW.names])


def _sound(x):
    """Text with escaped lone surrogates, which no encoding can hold, as replacement characters."""
    if isinstance(x, str):
        return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(x, (list, tuple)):
        return type(x)(_sound(y) for y in x)
    return x


def table_of(shredded: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One of the related tables with its inlined scalars as columns of their own."""
    return shredded.where(F.col("table_name") == name).select(
        "root_key", "doc_id", "path", "parent_path", "parent_table", "ordinal",
        *[F.try_element_at("columns", F.lit(c)).alias(c.replace(".", "_")) for c in columns],
    )


def nested_objects(df: DataFrame, root_table: str, key: F.Column | str, column: str, inlining: Inlining | None = None) -> DataFrame:
    """Every object that is a direct part of an array, with its nearest such ancestor.

    Distinct (``root_table``, ``root_key``, ``path``, ``parent_path``): the rows of the related tables of ``shred``
    that are objects in arrays; what an array holds is repeated, so each has a row in the table of its element.
    ``parent_path`` is the row's ``object_path``, the first such object on the way up its foreign keys, '' where no such object
    encloses it. Rows of the same key count together; repetition ends map-side first. Nulls, unreadable and
    wrapped documents as in ``shred``.
    """
    rows = shred(df, root_table, key, column, inlining).where("is_object and in_array")
    return rows.select("root_table", "root_key", "path", F.col("object_path").alias("parent_path")).distinct()
