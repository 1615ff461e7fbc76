"""Nested records as flat, linked rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quaymark.operators.structural import OBJECT, PRIMITIVE, STRING, Index


def two_decimals(text: str) -> str | None:
    """A number with two decimals, half away from zero; null if it is none."""
    try:
        return str(Decimal(text.strip()).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP"))
    except InvalidOperation:
        return None


@dataclass(frozen=True)
class Child:
    """A child table: the member it is read from, the member that names an item, and child tables below it."""

    name: str
    item: str | None
    children: tuple[Child, ...] = ()
    spell: Callable[[str], str | None] | None = None


@dataclass(frozen=True)
class Shape:
    """The child tables of one kind of record."""

    children: tuple[Child, ...] = field(default_factory=tuple)

    def names(self) -> list[str]:
        out: list[str] = []

        def walk(cs: Sequence[Child]) -> None:
            for c in cs:
                out.extend(x for x in (c.name, c.item) if x and x not in out)
                walk(c.children)

        walk(self.children)
        return out


#: Bytes of text indexed at once; a longer text is indexed by itself.
BYTES = 4 << 20


def byte_slices(offsets: np.ndarray, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of texts (from, to) of at most so many bytes, or of one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1, a + 1)
        yield a, z
        a = z


SCHEMA = pa.schema([("record_id", pa.string()), ("child_path", pa.string()), ("idx", pa.string()), ("parent_idx", pa.string()), ("item", pa.string())])


def flat_rows(ids: list, buf: np.ndarray, offsets: np.ndarray, shape: Shape) -> pa.RecordBatch:
    """The child rows of a batch of texts."""
    names = shape.names()
    ix = Index(buf, offsets, names)
    code = {n: i + 1 for i, n in enumerate(names)}
    cols: list[list] = [[], [], [], [], []]

    def walk(children: Sequence[Child], at: np.ndarray, idx: list[str] | None, path: str) -> None:
        for c in children:
            stop = tuple(code[x.name] for x in children) + tuple(code[x.name] for x in c.children)
            root = ix.below(code[c.name], tuple(code[x.name] for x in children))[at]
            has = np.flatnonzero(root >= 0)
            if not len(has):
                continue
            item = ix.below(code[c.item], stop) if c.item else np.full(len(ix.doc), -1, np.int64)
            is_item = item >= 0
            for k in c.children:
                is_item |= ix.child(code[k.name]) >= 0
            who, value, place = ix.elements(root[has], is_item)
            real = ix.kind[value] == OBJECT
            who, value, place = has[who[real]], value[real], place[real]
            here = f"{path}.{c.name}" if path else c.name
            places = [str(p) for p in place.tolist()] if idx is None else [f"{idx[w]}.{p}" for w, p in zip(who.tolist(), place.tolist())]
            if c.item:
                for w, v, i in zip(who.tolist(), item[value].tolist(), places):
                    if v >= 0 and ix.kind[v] in (STRING, PRIMITIVE) and (t := ix.text(v)) is not None and (t := c.spell(t) if c.spell else t) is not None:
                        for col, x in zip(cols, (ids[ix.doc[v]], here, i, None if idx is None else idx[w], t)):
                            col.append(x)
            if c.children and len(value):
                walk(c.children, value, places, here)

    tops = np.flatnonzero(ix.parent == -1)
    tops = tops[ix.kind[tops] == OBJECT]
    if len(tops):
        walk(shape.children, tops, None, "")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=SCHEMA)


def flatten(df: DataFrame, record_id: Column, text: Column, shape: Shape) -> DataFrame:
    """Rows (record_id, child_path, idx, parent_idx, item) of the objects nested in a JSON text.

    idx is the object's place in its list, nulls counted, below the place of its parent
    (parent_idx, null under the record itself). An object in place of a list has place 0, wrapper
    objects add no level, JSON within a JSON string is read. Texts that are null, empty or not
    JSON, and objects whose item is null or missing, give nothing. A table whose item is None
    gives no rows of its own, only its children's. Ids may repeat; nothing is merged. Long texts
    are read whole. Other columns of df aren't touched.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            if not len(texts):
                continue
            arr = texts.cast(pa.large_string())
            if arr.null_count:
                arr = arr.fill_null("")
            bufs = arr.buffers()
            offsets = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
            data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
            ids = b.column(0).to_pylist()
            for a, z in byte_slices(offsets):
                yield flat_rows(ids[a:z], data, offsets[a : z + 1], shape)

    return df.select(record_id.cast("string").alias("record_id"), text.cast("string").alias("text")).where("text is not null and record_id is not null").mapInArrow(run, "record_id string, child_path string, idx string, parent_idx string, item string")
