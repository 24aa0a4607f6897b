"""Columnar shredding of nested records into related flat tables.

A record is striped into one column per leaf path, each entry carrying a repetition level (which
enclosing list the entry continues; 0 starts a record) and a definition level (how much of the path
exists). Lists have three definition steps: the list is there, an element is there, the element is
an object. The flat table of a list is then rebuilt from the level sequences of a leaf below it, with
no look back at the record.

A layout is written as plain Python: ``{"name": None}`` is a leaf, ``{"drug": {...}}`` an optional
object and ``{"drugs": [{...}]}`` a list of objects. Every list must hold at least one leaf.

Defined results: a null record, a payload that is not JSON, and a payload whose top is no object give
no rows; null lists and empty lists give no rows; elements that are no objects give no row but count
in ``pos``; records repeated in the input are shredded each time they occur.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Stripe:
    """Level sequences and values of one leaf path over a batch of records."""

    record: np.ndarray
    rep: np.ndarray
    level: np.ndarray
    values: pa.Array | None


@dataclass(frozen=True)
class ListNode:
    """A list of objects: where it is, its repetition level, and the level at which an element is an object."""

    path: tuple[str, ...]
    depth: int
    object_level: int
    leaves: tuple[str, ...] = field(default=())


def arrow_type(layout: dict) -> pa.StructType:
    def kind(node):
        if node is None:
            return pa.string()
        return pa.list_(arrow_type(node[0])) if isinstance(node, list) else arrow_type(node)

    return pa.struct([(name, kind(node)) for name, node in layout.items()])


def list_nodes(layout: dict) -> list[ListNode]:
    """The lists of a layout, outer before inner."""
    found: list[ListNode] = []

    def walk(node: dict, path: tuple, depth: int, level: int) -> None:
        for name, child in node.items():
            if isinstance(child, list):
                inner = child[0]
                leaves = tuple(k for k, v in inner.items() if v is None)
                if not leaves:
                    raise ValueError(f"list {'.'.join((*path, name))} has no leaf to carry its levels")
                found.append(ListNode((*path, name), depth + 1, level + 3, leaves))
                walk(inner, (*path, name), depth + 1, level + 3)
            elif isinstance(child, dict):
                walk(child, (*path, name), depth, level + 1)

    walk(layout, (), 0, 0)
    return found


# ---------------------------------------------------------------- JSON payloads


class Number:
    """A JSON number as it was written; not a string, so it is never opened as JSON again."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _loads(text: str):
    """Strict JSON with numbers left as written, so none is too long; raises ValueError otherwise."""
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def _unwrap(value):
    """What a JSON string that itself holds JSON says; anything else stays."""
    while isinstance(value, str):
        try:
            value = _loads(value)
        except ValueError:
            return None
    return value


def _leaf(value) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else value.text if isinstance(value, Number) else json.dumps(value, ensure_ascii=False, default=lambda x: x.text)
    return text.encode("utf-8", "replace").decode("utf-8")


def conform(value, layout: dict) -> dict | None:
    """Fit a parsed payload to a layout: the object it describes, or None if it is none."""
    value = _unwrap(value)
    if not isinstance(value, dict):
        return None
    out = {}
    for name, node in layout.items():
        child = value.get(name)
        if node is None:
            out[name] = _leaf(child)
        elif isinstance(node, dict):
            out[name] = conform(child, node)
        else:
            child = _unwrap(child)
            if isinstance(child, dict):
                child = [child]
            out[name] = [conform(x, node[0]) for x in child] if isinstance(child, list) else None
    return out


def parse_payload(text: str | None, layout: dict) -> dict | None:
    if text is None:
        return None
    try:
        return conform(_loads(text), layout)
    except ValueError:
        return None


# ---------------------------------------------------------------- striping


def stripe(records: pa.StructArray, layout: dict) -> dict[tuple[str, ...], Stripe]:
    """Stripe a batch of records, level by level over the whole batch at once."""
    stripes: dict[tuple[str, ...], Stripe] = {}

    def descend(array: pa.StructArray, at: np.ndarray, rep: np.ndarray, level: np.ndarray, record: np.ndarray, node: dict, path: tuple, depth: int, full: int) -> None:
        # at: the row of `array` an entry stands for, -1 once something on its path is missing;
        # full: the definition level of an entry that has everything so far
        for name, child in node.items():
            column = array.field(name)
            valid = np.zeros(len(at), bool)
            here = at >= 0
            valid[here] = column.is_valid().to_numpy(zero_copy_only=False)[at[here]]
            if child is None:
                values = column.take(pa.array(np.where(valid, at, 0), mask=~valid)) if len(column) else pa.nulls(len(at), column.type)
                stripes[(*path, name)] = Stripe(record, rep, np.where(valid, full + 1, level), values)
            elif isinstance(child, dict):
                descend(column, np.where(valid, at, -1), rep, np.where(valid, full + 1, level), record, child, (*path, name), depth, full + 1)
            else:
                starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                if valid.any():
                    offsets = column.offsets.to_numpy()
                    starts[valid] = offsets[at[valid]]
                    sizes[valid] = offsets[at[valid] + 1] - starts[valid]
                entries = np.maximum(sizes, 1)
                source = np.repeat(np.arange(len(at)), entries)
                nth = np.arange(len(source)) - np.repeat(np.cumsum(entries) - entries, entries)
                element = np.where(sizes[source] > 0, starts[source] + nth, -1)
                items = column.values
                is_object = np.zeros(len(source), bool)
                has = element >= 0
                if has.any():
                    is_object[has] = items.is_valid().to_numpy(zero_copy_only=False)[element[has]]
                new_level = np.where(is_object, full + 3, np.where(has, full + 2, np.where(valid[source], full + 1, level[source])))
                descend(items, np.where(is_object, element, -1), np.where(nth > 0, depth + 1, rep[source]), new_level, record[source], child[0], (*path, name), depth + 1, full + 3)

    n = len(records)
    there = records.is_valid().to_numpy(zero_copy_only=False)
    rows = np.arange(n)
    descend(records, np.where(there, rows, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), rows, layout, (), 0, 0)
    return stripes


def positions(rep: np.ndarray, depth: int) -> np.ndarray:
    """For every entry, the place of its element in the list of the given depth, from repetition levels alone."""
    if not len(rep):
        return rep.copy()
    ordinal = np.cumsum(rep <= depth) - 1
    begun = np.maximum.accumulate(np.where(rep < depth, np.arange(len(rep)), 0))
    return ordinal - ordinal[begun]


def rebuild(stripes: dict[tuple[str, ...], Stripe], node: ListNode) -> dict[str, object]:
    """The flat table of one list: record, parent_pos, pos and its leaves, from level sequences."""
    lead = stripes[(*node.path, node.leaves[0])]
    pick = (lead.rep <= node.depth) & (lead.level >= node.object_level)
    parent = positions(lead.rep, node.depth - 1) if node.depth > 1 else np.full(len(lead.rep), -1)
    out: dict[str, object] = {"record": lead.record[pick], "parent_pos": parent[pick], "pos": positions(lead.rep, node.depth)[pick]}
    for leaf in node.leaves:
        out[leaf] = stripes[(*node.path, leaf)].values.filter(pa.array(pick))
    return out


# ---------------------------------------------------------------- Spark operator


def shred(df: DataFrame, key: str, column: str | list[str], layout: dict, with_fields: bool = True) -> DataFrame:
    """Shred nested records into rows (record_key, path, parent_pos, pos[, fields]).

    ``column`` is a JSON string column, or the list of the typed columns that make up the record.
    One pass over the input and no shuffle; ``fields`` maps each leaf of the row's list to its text.
    Rows of one list link to their parent by (record_key, parent path, parent_pos).
    """
    typed = isinstance(column, list)
    names = [c for c in column if c in layout] if typed else []
    picked = {c: layout[c] for c in names} if typed else layout
    nodes, kind = list_nodes(picked), arrow_type(picked)
    schema = "record_key bigint, path string, parent_pos int, pos int" + (", fields map<string,string>" if with_fields else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            if typed:
                records = pa.StructArray.from_arrays([batch.column(1 + i) for i in range(len(names))], names=names)
            else:
                records = pa.array([parse_payload(x, picked) for x in batch.column(1).to_pylist()], type=kind)
            stripes = stripe(records, picked)
            for node in nodes:
                flat = rebuild(stripes, node)
                n = len(flat["pos"])
                if not n:
                    continue
                columns = [keys.take(pa.array(flat["record"])), pa.array([".".join(node.path)] * n), pa.array(flat["parent_pos"], pa.int32()), pa.array(flat["pos"], pa.int32())]
                if with_fields:
                    each = [flat[x].to_pylist() for x in node.leaves]
                    columns.append(pa.array([list(zip(node.leaves, row)) for row in zip(*each)], pa.map_(pa.string(), pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=["record_key", "path", "parent_pos", "pos", *(["fields"] if with_fields else [])])

    inputs = [F.col(key).cast("bigint").alias("record_key")]
    inputs += [F.col(c) for c in names] if typed else [F.col(column).alias("payload")]
    return df.select(*inputs).mapInArrow(run, schema)


def flat_table(shredded: DataFrame, layout: dict, path: str) -> DataFrame:
    """One flat table out of ``shred(..., with_fields=True)``, a column for each leaf."""
    node = next(n for n in list_nodes(layout) if ".".join(n.path) == path)
    fixed = ["record_key", "parent_pos", "pos"]
    leaves = [F.col("fields")[leaf].alias(f"{leaf}_" if leaf in fixed else leaf) for leaf in node.leaves]
    return shredded.where(F.col("path") == path).select(*fixed, *leaves)
