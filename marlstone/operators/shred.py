"""Problem 3: nested records shredded into an adjacency table, then pivoted into flat entity tables.

``shred_json`` stores every node of every record as (doc, node, parent, label, ordinal, kind, scalar). ``pivot_objects``
joins object nodes with their scalar children and turns the wanted labels into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "doc bigint, node int, parent int, label string, ordinal int, kind string, scalar string, route string"
_ARROW = pa.schema([("doc", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("route", pa.string())])
_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
_FLUSH = 20_000
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)


def _not_json(name: str) -> float:
    raise ValueError(name)


def read_json(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it is none. Beyond the depth of the standard reader the same text
    is read with an explicit stack."""
    try:
        return json.loads(text, parse_constant=_not_json)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str) -> object:
    stack: list[list | dict] = []
    names: list[str] = []  # of each open object, the label whose value comes next

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    def label(at: int) -> int:
        if text[at : at + 1] != '"':
            raise ValueError(at)
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(at)
        names.append(name)
        return skip(at + 1)

    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("[", "{"):
            value: object = [] if c == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                stack.append(value)
                if c == "{":
                    at = label(at)
                continue
            at = skip(at + 1)
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            at = skip(at)
        elif m := _ATOM.match(text, at):
            value, at = json.loads(m[0]), skip(m.end())
        else:
            raise ValueError(at)
        while True:  # the value is whole, as are the containers that end behind it
            if not stack:
                if at != len(text):
                    raise ValueError(at)
                return value
            here = stack[-1]
            if isinstance(here, list):
                here.append(value)
            else:
                here[names.pop()] = value
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(here, dict):
                    at = label(at)
                break
            if c != ("]" if isinstance(here, list) else "}"):
                raise ValueError(at)
            value, at = stack.pop(), skip(at + 1)


def _walk(text: str, lists: frozenset[str], packed: frozenset[str], wrappers: frozenset[str], routed: frozenset[str] | None, columns: Sequence[list]) -> int:
    """Append the nodes of one record, parents first, in the order of the document, to the columns parent to route of the
    adjacency table, and give their number. A label in ``lists`` holds a list: an object in its place is a list of one. A string
    under a route in ``packed`` is parsed in its turn."""
    parents, labels, ordinals, kinds, scalars, routes = columns

    def load(raw: str) -> object:
        value = read_json(raw.lstrip("\ufeff"))
        while isinstance(value, str) and "" in packed:
            value = read_json(value)
        return value

    top = load(text)
    if wrappers and isinstance(top, dict) and not wrappers & top.keys():
        top = [top]
    node = 0
    frames: list[tuple] = [(enumerate([top]), None, "", False)]  # of each open container: children yet to come, its number, its route, whether an object
    while frames:
        children, parent, up, named = frames[-1]
        for k, value in children:
            label = None
            if named:
                label, value = value
                route = None if up is None or (routed is not None and label not in routed) else f"{up}/{label}"
            else:
                route = None if up is None else f"{up}/{k}" if node else ""
            if route in packed and isinstance(value, str):
                try:
                    value = load(value)
                except ValueError:
                    pass
            kind = _KIND[type(value)]
            if kind == "object" and label in lists:
                value, kind = [value], "array"
            parents.append(parent)
            labels.append(label)
            ordinals.append(k)
            kinds.append(kind)
            scalars.append(value if kind == "string" else json.dumps(value) if kind in ("boolean", "number") else None)
            routes.append(route)
            node += 1
            if kind == "object":
                frames.append((enumerate(value.items()), node - 1, route, True))
                break
            if kind == "array":
                ends = routed is not None and label is None and parent is not None
                frames.append((enumerate(value), node - 1, None if ends else route, False))
                break
        else:
            frames.pop()
    return node


def shred_json(df: DataFrame, key: str, column: str, lists: Sequence[str] = (), packed: Sequence[str] = (), wrappers: Sequence[str] = (), routed: Sequence[str] | None = None) -> DataFrame:
    """The adjacency table of the JSON text in ``column``; ``key`` (BIGINT) names the record.

    node is the number of the node in its record, in document order from 0, parent that of its parent; route holds the labels
    and positions from the top. As routes grow with the depth, ``routed`` may name the labels they follow: routes then end
    (null) at other labels and at lists directly within lists. If ``wrappers`` are given, a top object with none of these
    labels is a list of one. Text that is null, empty, truncated or not JSON gives no rows; nesting of any depth is read;
    repeated rows count once; a label that an object repeats keeps its last value. Memory: one record at a time, rows leave in
    bounded batches.
    """
    as_lists, as_packed, as_wrappers, as_routed = frozenset(lists), frozenset(packed), frozenset(wrappers), None if routed is None else frozenset(routed)

    def batch_of(columns: list[list], start: int, end: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[start:end], f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in _ARROW]
        for batch in batches:
            for doc, text in ((d.as_py(), t.as_py()) for d, t in zip(*batch.columns, strict=True)):
                if text is None or doc is None:
                    continue
                try:
                    n = _walk(text, as_lists, as_packed, as_wrappers, as_routed, columns[2:])
                except ValueError:  # the text, before any node
                    continue
                columns[0] += [doc] * n
                columns[1] += range(n)
                done = len(columns[0]) // _FLUSH * _FLUSH
                for at in range(0, done, _FLUSH):
                    yield batch_of(columns, at, at + _FLUSH)
                if done:
                    columns = [c[done:] for c in columns]
        if columns[0]:
            yield batch_of(columns, 0, len(columns[0]))

    once = df.select(F.col(key).cast("long").alias("doc"), F.col(column).alias("text")).dropDuplicates(["doc"])
    return once.mapInArrow(run, NODES)


def pivot_objects(nodes: DataFrame, wanted: Column, labels: Sequence[str]) -> DataFrame:
    """``doc, node, route`` of the wanted object nodes with one STRING column ``<label>_value`` for each label: the scalar
    child of that name, or null.

    Objects and scalar children are joined by (doc, object): each goes there under the number of the object, in one pass over
    the nodes and one shuffle, and the pivot follows in the same group. Objects without any scalar child stay. ``wanted`` must
    hold for objects only: these have no scalar, so no row stands on both sides.
    """
    child = F.col("label").isin(*labels) & F.col("scalar").isNotNull()
    own = F.col("scalar").isNull()
    sides = nodes.filter(wanted | child).select("doc", F.when(own, F.col("node")).otherwise(F.col("parent")).alias("node"), F.when(own, F.col("route")).alias("route"), "label", "scalar")
    values = (F.max(F.when(F.col("label") == x, F.col("scalar"))).alias(f"{x}_value") for x in labels)
    return sides.groupBy("doc", "node").agg(F.max("route").alias("route"), *values).filter("route is not null")


_ITEM = r"^(?:/abi|/output/abi)?/(\d+)$"
_PARAM = r"^(?:/abi|/output/abi)?/(\d+)/(inputs|outputs)/(\d+(?:/components/\d+)*)$"
_LISTS = ("abi", "inputs", "outputs", "components")
_PACKED = ("", "/abi", "/output/abi")


def abi_nodes(abi_docs: DataFrame) -> DataFrame:
    """The adjacency table of the interface records; the list of items may be the record itself, its ``abi`` or its
    ``output.abi``, plain or packed as JSON text. A lone item object in place of the record is a list of one."""
    return shred_json(abi_docs, "abi_id", "raw_json", _LISTS, _PACKED, ("abi", "output"), (*_LISTS, "output"))


def abi_items(nodes: DataFrame) -> DataFrame:
    """``abi_id, item_no, type, name, state_mutability, anonymous``: one row for each item object."""
    wide = pivot_objects(nodes, (F.col("kind") == "object") & F.coalesce(F.col("route").rlike(_ITEM), F.lit(False)), ["type", "name", "stateMutability", "anonymous"])
    return wide.select(F.col("doc").alias("abi_id"), F.regexp_extract("route", _ITEM, 1).cast("int").alias("item_no"), F.coalesce("type_value", F.lit("function")).alias("type"), F.col("name_value").alias("name"), F.col("stateMutability_value").alias("state_mutability"), F.col("anonymous_value").cast("boolean").alias("anonymous"))


def abi_params(nodes: DataFrame) -> DataFrame:
    """``abi_id, item_no, side, param_path, parent_path, depth, name, type, internal_type, indexed``: one row for each
    parameter object, whatever its depth. parent_path is null for a parameter of the item itself, indexed where it is no
    boolean."""
    wanted = (F.col("kind") == "object") & F.coalesce(F.col("route").rlike(_PARAM), F.lit(False))
    wide = pivot_objects(nodes, wanted, ["name", "type", "internalType", "indexed"])
    # of a route such as /abi/3/inputs/0/components/1, which holds one "puts/": cut at it, not by the expression once more
    path = F.replace(F.substring_index("route", "puts/", -1), F.lit("/components/"), F.lit("."))
    head = F.substring_index(F.substring_index("route", "puts/", 1), "/", -2)
    placed = wide.select(F.col("doc").alias("abi_id"), F.substring_index(head, "/", 1).cast("int").alias("item_no"), F.concat(F.substring_index(head, "/", -1), F.lit("puts")).alias("side"), path.alias("param_path"), *(c for c in wide.columns if c.endswith("_value")))
    depth = F.length("param_path") - F.length(F.replace("param_path", F.lit("."))) + 1
    up = F.nullif(F.call_function("substring_index", F.col("param_path"), F.lit("."), F.col("depth") - 1), F.lit(""))
    own = [F.col("name_value").alias("name"), F.col("type_value").alias("type"), F.col("internalType_value").alias("internal_type"), F.col("indexed_value").try_cast("boolean").alias("indexed")]
    return placed.withColumn("depth", depth).select("abi_id", "item_no", "side", "param_path", up.alias("parent_path"), "depth", *own)
