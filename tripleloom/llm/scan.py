"""Running values along a global order, whatever share of the rows one segment holds.

Rows are sorted into ranges. Each range is scanned by itself; what the ranges before it hold of its first segment is added afterwards. Of
a range only its first and last row come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tripleloom.llm.common import fresh, slices, text_bytes, written

#: Rows of a range.
RANGE_ROWS = 500_000


class Sums:
    """Running sums of long columns, the row's own value included; totals: name of the sum -> column."""

    def __init__(self, **totals: str):
        self.names, self.columns = list(totals), list(totals.values())

    def scan(self, values: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
        """first: for each row the place of its segment's first row."""
        return [c - (c[first] - v[first]) for v, c in ((v, np.cumsum(v)) for v in values)]

    def after(self, before: tuple, own: list[np.ndarray]) -> list[np.ndarray]:
        """Values of rows that follow others whose last value is `before`."""
        return [b + x for b, x in zip(before, own, strict=True)]


def _edges(changes: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))


def running(df: DataFrame, segment: str, order: list[str | Column], monoid: Sums, rows: int) -> DataFrame:
    """df with `monoid.names`: running values within each segment (null is one), in the order of its rows.

    The order must be total up to equal rows. `rows`: about how many df has; it sets the number of ranges and nothing else. df is read
    twice, so it should be a written table. No column of df may have one of the new names.
    """
    spark = df.sparkSession
    names = monoid.names
    part, head, edge = (fresh(df, x) for x in ("range", "head", "edge"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)
    columns = df.columns
    runs = [T.StructField(n, T.LongType()) for n in names]
    marks = [T.StructField(part, T.IntegerType()), T.StructField(head, T.BooleanType()), T.StructField(edge, T.IntegerType())]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, begun, last, opened, held = TaskContext.get().partitionId(), False, None, None, None

        def out(batch: pa.RecordBatch, own: list, heads: np.ndarray, first: bool, end: bool) -> pa.RecordBatch:
            at_edge = np.zeros(batch.num_rows, np.int32)
            at_edge[0] += first
            at_edge[-1] += 2 * end
            added = [*map(pa.array, own), pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(heads), pa.array(at_edge)]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, *names, part, head, edge])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(columns.index(segment))
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            changes = np.append(True, codes[1:] != codes[:-1])
            own = monoid.scan([batch.column(columns.index(c)).to_numpy().astype(np.int64) for c in monoid.columns], _edges(changes))
            follows = np.cumsum(changes) == 1
            if begun and keys[0].as_py() == opened:
                joined = monoid.after(last, [x[follows] for x in own])
                for x, y in zip(own, joined, strict=True):
                    x[follows] = y
            else:
                follows = np.zeros(batch.num_rows, bool)
            heads = (np.cumsum(changes) == 1) if not begun else follows & bool(held[2][-1])
            if held:
                yield out(*held, False)
            held = (batch, own, heads, not begun)
            begun, last, opened = True, tuple(int(x[-1]) for x in own), keys[-1].as_py()
        if held:
            yield out(*held, True)

    sorted_rows = df.repartitionByRange(ranges, segment, *order).sortWithinPartitions(segment, *order)
    scanned = written(sorted_rows.mapInArrow(local, T.StructType([*df.schema.fields, *runs, *marks])), "ranges")
    edges: dict[int, list] = {}
    for r in scanned.where(f"{edge} > 0").select(part, edge, segment, head, *names).collect():
        edges.setdefault(r[0], []).append(r)
    before: dict[int, tuple] = {}
    opened = None
    for number in sorted(edges):
        first, end = (next(r for r in edges[number] if r[1] & bit) for bit in (1, 2))
        if opened and opened[0] == first[2]:
            before[number] = opened[1]
        total = tuple(end[4:])
        if end[3] and number in before:
            total = tuple(int(x[0]) for x in monoid.after(before[number], [np.array([v]) for v in total]))
        opened = (end[2], total)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(columns)
        for batch in batches:
            own = [batch.column(width + i).to_numpy(zero_copy_only=False).copy() for i in range(len(names))]
            parts, heads = batch.column(width + len(names)).to_numpy(), batch.column(width + len(names) + 1).to_numpy(zero_copy_only=False)
            for number in np.unique(parts[heads]).tolist():
                if number in before:
                    rows = heads & (parts == number)
                    for x, y in zip(own, monoid.after(before[number], [x[rows] for x in own]), strict=True):
                        x[rows] = y
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, own)], [*columns, *names])

    return scanned.mapInArrow(joined, T.StructType([*df.schema.fields, *runs]))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """For each text the number of runs of characters other than blanks (space, tab to carriage return); null has none."""
    data, offsets = text_bytes(batch, column)
    counts = []
    for _, _, part, at in slices(data, offsets):
        inside = ~_BLANK[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        first = at[:-1][at[:-1] < len(part)]
        starts[first] = inside[first]  # a text's first byte follows nothing
        counts.append(np.diff(np.searchsorted(np.flatnonzero(starts), at)))
    return np.concatenate(counts) if counts else np.zeros(0, np.int64)


def counted(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the number of words of a text column in its place; the texts don't come back from Python."""
    schema = T.StructType([T.StructField(name, T.LongType()) if f.name == text_col else f for f in df.schema])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array(word_counts(batch, text_col).astype(np.int64))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)
