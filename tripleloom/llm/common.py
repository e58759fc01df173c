"""Small helpers of the operators: tables, written intermediate results, text columns as numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import work_dir

#: Bytes of text that one numpy pass works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder: later jobs don't repeat the work before."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(tables: list[DataFrame]) -> list[DataFrame]:
    """Takes away what written() has written for these tables, which nothing reads any more; gives a list for new ones."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return []


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    return name if name.lower() not in {c.lower() for c in df.columns} else f"{name}_{uuid.uuid4().hex[:8]}"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A text column as UTF-8 bytes and row offsets, without copying; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)
    else:
        texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1] or b"\0\0\0\0", np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if texts.null_count:  # a null's slot may span bytes in principle
        texts = texts.fill_null("")
        return text_bytes(pa.RecordBatch.from_arrays([texts], ["t"]), "t")
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their offsets in those bytes), in pieces of about `most` bytes."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def add_columns(df: DataFrame, fields: str, values, *columns: str) -> DataFrame:
    """df with new columns that Python computes from `columns` by Arrow batches: values(batch) gives an array for each.

    fields: their DDL; the names must be new to df.
    """
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added]
    schema = T.StructType(df.schema.fields + added.fields)
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([batch.column(i) for i in places], list(columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, *values(asked)], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by the keys; no more than one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        changes[0] = last is not None and last != [c[0] for c in columns]
        at = 0
        for cut in [*np.flatnonzero(changes).tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
                at = cut
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)
