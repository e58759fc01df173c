"""Near-duplicate classes: candidates that share a key, exact Jaccard similarity of word shingles, connected components.

Texts with the same set of shingles are one node from the start, so copies cost one row. Nodes that share a key are compared
in blocks of bounded size, each pair once: where the first of the keys that it shares is looked at. What leaves a block is
one row a node, its number of links and the least node it hangs together with.

Keys may come in levels, each level's nodes within one group of the next: prefixes of labels, the longest first. Only nodes that
meet another one on the last level have their other keys looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import slices, sorted_groups, text_bytes, written
from tripleloom.llm.components import components
from tripleloom.llm.words import Words, mix

SHINGLE = 5
THRESHOLD = 0.8
#: Nodes of a block, and bytes of their shingles; two blocks are compared at a time.
BLOCK = 1024
BLOCK_BYTES = 1 << 24
#: Shingles and nodes multiplied at a time within a block.
_COLUMNS, _ROWS = 1024, 256

Keys = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for first, last, part, at in slices(data, offsets):
        grams, bounds = Words(part, at).shingles(SHINGLE)
        for i in range(last - first):
            yield np.unique(grams[bounds[i] : bounds[i + 1]])


def set_hash(shingles: np.ndarray) -> int:
    """64 bits of a sorted set."""
    a = int(np.bitwise_xor.reduce(mix(shingles + np.uint64(1)))) if len(shingles) else 0
    b = int(np.add.reduce(mix(shingles ^ np.uint64(0x5DEECE66D)))) if len(shingles) else 0
    both = np.array([a ^ (len(shingles) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(b)
    return int(mix(both).astype(np.int64)[0])


def _sketch(keys: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch, "text")
            table = keys(data, offsets)
            sets = [(set_hash(s), len(s)) for s in shingle_sets(data, offsets)]
            nodes, sizes = (pa.array(list(x), pa.int64()) for x in (zip(*sets, strict=True) if sets else ((), ())))
            steps = pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32())
            own = pa.ListArray.from_arrays(steps, pa.array(table.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("hash")), nodes, sizes, own], ["id", "hash", "node", "size", "keys"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(*text_bytes(batch, "text")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]
        )


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each two sets share."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], np.float64)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    kept = often[column]
    row, column = row[kept], place[column[kept]].astype(np.int32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    # 32 bits count exactly up to 2**24
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64
    out = np.zeros((len(sets), len(sets)), kind)
    for first in range(0, int(often.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), kind)
        part[row[lo:hi], column[lo:hi] - first] = 1
        for r in range(0, len(sets), _ROWS):
            out[r : r + _ROWS] += part[r : r + _ROWS] @ part.T
    return out


def links(sets: list[np.ndarray], keys: np.ndarray, place: int, sides: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """Which nodes of a block pair are linked: similar enough, on unlike sides, and sharing no key before `place`.

    width: keys of a level. What shares a key on an earlier level also does on the one just before.
    """
    size = np.array([len(s) for s in sets], np.float64)
    both = shared(sets)
    out = np.zeros(both.shape, bool)
    for r in range(0, len(sets), _ROWS):
        rows = slice(r, r + _ROWS)
        near = both[rows] >= threshold * (size[rows, None] + size[None, :] - both[rows]) - 1e-9
        near &= (sides[rows, None] != sides[None, :]) | (sides[rows, None] < 0)
        for k in range(max(0, place - place % width - width), place):
            if not near.any():
                break
            near &= keys[rows, k][:, None] != keys[:, k][None, :]
        out[rows] = near
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The least row that each row hangs together with."""
    label = np.arange(len(linked))
    while True:
        near = np.concatenate([np.where(linked[r : r + _ROWS], label[None, :], len(linked)).min(axis=1) for r in range(0, len(linked), _ROWS)])
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "clique", "low", "high"):
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            if len(sets) < 2:
                continue
            nodes = rows["node"].to_numpy()
            keys = np.array(rows["keys"].to_pylist(), np.int64)
            low, high, mine = (rows[c].to_numpy() for c in ("low", "high", "mine"))
            sides = np.full(len(sets), -1) if low[0] == high[0] else (mine == high).astype(int)
            linked = links(sets, keys, rows["place"][0].as_py(), sides, threshold, keys.shape[1] // levels)
            count = linked.sum(axis=1)
            if not count.any():
                continue
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[has]), pa.array(count[has].astype(np.int64)), pa.array(nodes[roots(linked)[has]])],
                ["node", "links", "root"],
            )

    return run


def text_hash(text_col: str = "text") -> Column:
    """Tells texts of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def classes(
    docs: DataFrame, keys: Keys, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK,
    firsts: bool = False, levels: int = 1,
) -> DataFrame:
    """One row for each row of docs: id_col, class_id, n_links, n_copies.

    class_id: the least id among all documents that hang together by links. n_links: the number of other shingle sets at
    `threshold` or more. n_copies: rows with the same shingles, this one included. Texts without words, null
    ones included, are copies of each other. Rows with a null id come back with a null class and no links, and don't
    count as copies. Ids may repeat; every row counts.

    With `firsts`, instead one row for each class: id_col and text_hash() of its first row, the least by both. Unlike texts
    of one id are in classes of their own.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_hash(text_col).alias("hash"))
    kind = docs.schema["id"].dataType.simpleString()
    known = docs.where(F.col("id").isNotNull())
    sketched = written(known.mapInArrow(_sketch(keys), f"id {kind}, hash long, node long, size long, keys array<long>"), "sketches")
    nodes = sketched.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(nodes.select("node", F.col("first.id").alias("least"), F.col("first.hash").alias("hash"), "copies", "size", "keys"), "nodes")
    entries = nodes.select("node", "size", F.posexplode("keys").alias("place", "key"))
    if levels > 1:
        last = F.slice("keys", (F.size("keys") * (levels - 1) / levels + 1).cast("int"), F.size("keys"))
        ends = nodes.select("node", F.posexplode(last).alias("place", "key"))
        shared_ends = ends.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1").select("place", "key")
        met = written(ends.join(shared_ends.hint("merge"), ["place", "key"]).select("node").distinct(), "met")
        entries = entries.join(met, "node")
    # groups of the same nodes are one clique, met first at its first place
    groups = entries.groupBy("place", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")
    )
    cliques = groups.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("place", "key")).alias("at"), F.max("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    cliques = cliques.select("at.place", "at.key", blocks.alias("blocks"))
    members = entries.join(cliques.hint("merge"), ["place", "key"])
    members = written(members.select("node", "place", F.xxhash64("place", "key").alias("clique"), "blocks"), "cliques")
    # the shingles of candidates, from one text of each
    asked = nodes.join(members.select("node").distinct(), "node").select("node", "least", "keys")
    texts = known.join(asked.select(F.col("least").alias("id")).distinct().hint("merge"), "id").select("text").mapInArrow(
        _shingled, "node long, shingles binary"
    )
    payload = texts.dropDuplicates(["node"]).join(asked.select("node", "keys"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tasks = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("node", "clique", "place", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    rows = tasks.join(payload, "node").repartition("clique", "low", "high").sortWithinPartitions("clique", "low", "high", "node")
    found = written(rows.mapInArrow(_compare(threshold, levels), "node long, links long, root long"), "links")
    if firsts:
        component = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        placed = nodes.select("node", "least", "hash").join(component, "node", "left")
        first = placed.groupBy(F.coalesce("component", "node")).agg(F.min(F.struct("least", "hash")).alias("first"))
        return first.select(F.col("first.least").alias(id_col), F.col("first.hash").alias("text_hash"))
    linked = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    component = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("node", "least", "copies").join(component, "node", "left").join(linked, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    placed = placed.join(ids, "component").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    out = sketched.select("id", "node").join(placed, "node").select("id", "class_id", "n_links", "n_copies")
    alone = docs.where(F.col("id").isNull()).select("id", F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)
