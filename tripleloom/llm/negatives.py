"""Hard negatives: rows of another label that score nearly as high with an anchor as one of its positives.

Anchors and candidates meet in cells of bounded size, a block of either side. A cell multiplies its tiles by Strassen's recursion on 64-bit
integers, padded with zeros, so every score is exact. What leaves a cell is a short sorted heap for each anchor, and heaps are
merged a few dozen at a time. Two passes: the positives first, then the window that each positive's score opens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import written

POSITIVES = 5
NEGATIVES = 10
#: Rows of a block on either side of a cell, and of the tiles that are multiplied in it.
ANCHORS, CANDIDATES = 4096, 16_384
TILE = 256, 512
#: Sides up to this are multiplied directly.
LEAF = 16
#: Heaps that one merge takes in.
FAN = 64
#: Components and scores beyond it count as it.
_MOST = 1 << 58


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices by seven products of halves; odd sides get a row or column of zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p = strassen(a11 + a22, b11 + b22)
    q = strassen(a21 + a22, b11)
    r = strassen(a11, b12 - b22)
    s = strassen(a22, b21 - b11)
    t = strassen(a11 + a12, b22)
    u = strassen(a21 - a11, b11 + b12)
    v = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), a.dtype)
    out[:i, :l], out[:i, l:] = p + s - t + v, r + t
    out[i:, :l], out[i:, l:] = q + s, p - q + r + u
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, tile by tile."""
    most = float(abs(a).max(initial=0)) * float(abs(b).max(initial=0)) * a.shape[1]
    if most >= _MOST:  # integers of any length: a score may not fit into 64 bits
        a, b = a.astype(object), b.astype(object)
    out = np.empty((len(a), len(b)), np.int64)
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            tile = strassen(a[i : i + TILE[0]], b[j : j + TILE[1]].T)
            out[i : i + TILE[0], j : j + TILE[1]] = np.clip(tile, -_MOST, _MOST) if tile.dtype == object else tile
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def _usable(batches):
    """Rows with all components, as integers; the others go."""
    for batch in batches:
        ids, vectors, rest = batch.column(0), batch.column(1), batch.columns[2:]
        kept, found = [], []
        flat, ends = vectors.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).fill_null(0).to_numpy())])
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy()
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        whole = np.clip(np.floor(256 * np.where(np.isfinite(values), values, 0)), -_MOST, _MOST).astype("<i8")
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if there[i] and bad[ends[i]] == bad[ends[i + 1]]:
                kept.append(i)
                found.append(whole[ends[i] : ends[i + 1]].tobytes())
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(found, pa.binary()), *[c.take(at) for c in rest]], batch.schema.names)


def _heaps(rows: pa.Array, extra: list[pa.Array], names: list[str], found: list[np.ndarray], score: list[np.ndarray], ids: pa.Array) -> pa.Table:
    """A row with its heap, best first, for each row that has found anything."""
    sizes = np.array([len(x) for x in found], np.int64)
    has = pa.array(np.flatnonzero(sizes))
    at = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
    entries = pa.StructArray.from_arrays([pa.array(-np.concatenate(score) if len(score) else at), ids.take(pa.array(at))], ["down", "id"])
    steps = pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]).astype(np.int32))
    return pa.Table.from_arrays([rows.take(has), *[e.take(has) for e in extra], pa.ListArray.from_arrays(steps, entries)], names)


def _sides(anchors: pa.Table, candidates: pa.Table):
    candidates = candidates.take(pc.sort_indices(candidates, [("id", "ascending")]))
    width = max(pc.max(pc.binary_length(t["vector"])).as_py() or 0 for t in (anchors, candidates)) // 8
    return candidates, _matrix(anchors["vector"], width), _matrix(candidates["vector"], width)


def _positives(most: int) -> Callable:
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = pa.array([], candidates.schema.field("id").type)
        found, score = [], []
        rows = anchors["row"].combine_chunks()
        if anchors.num_rows and candidates.num_rows:
            candidates, a, c = _sides(anchors, candidates)
            ids, number, copies = candidates["id"].combine_chunks(), candidates["row"].to_numpy(), candidates["copies"].to_numpy()
            labels = candidates["label"].to_numpy()
            same = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
            own, label = rows.to_numpy(), anchors["label"].to_numpy()
            for lo in range(0, len(a), TILE[0]):
                product = scores(a[lo : lo + TILE[0]], c)
                for i, line in enumerate(product, lo):
                    at = same.get(label[i], np.zeros(0, np.int64))
                    order = at[np.argsort(-line[at], kind="stable")[: most + 1]]
                    # an anchor isn't its own positive, but its copies are
                    order = np.repeat(order, np.minimum(copies[order] - (number[order] == own[i]), most))[:most]
                    found.append(order)
                    score.append(line[order])
        else:
            rows = rows.slice(0, 0)
        return _heaps(rows, [], ["row", "heap"], found, score, ids)

    return run


def _negatives(most: int, low: tuple[int, int], high: tuple[int, int]) -> Callable:
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = pa.array([], candidates.schema.field("id").type)
        rows, of, found, score = [], [], [], []
        if anchors.num_rows and candidates.num_rows:
            candidates, a, c = _sides(anchors, candidates)
            ids, copies, labels = candidates["id"].combine_chunks(), candidates["copies"].to_numpy(), candidates["label"].to_numpy()
            own, label, asked = anchors["row"].to_pylist(), anchors["label"].to_numpy(), anchors["scores"].to_pylist()
            for lo in range(0, len(a), TILE[0]):
                product = scores(a[lo : lo + TILE[0]], c)
                for i, line in enumerate(product, lo):
                    windows = [(s, -(-low[0] * s // low[1]), high[0] * s // high[1]) for s in asked[i]]
                    at = np.flatnonzero((labels != label[i]) & (line >= min(w[1] for w in windows)) & (line <= max(w[2] for w in windows)))
                    at = at[np.argsort(-line[at], kind="stable")]
                    down = -line[at]
                    for s, least, top in windows:
                        first, last = np.searchsorted(down, -top, "left"), np.searchsorted(down, -least, "right")
                        order = at[first : max(first, min(last, first + most))]
                        order = np.repeat(order, np.minimum(copies[order], most))[:most]
                        rows.append(own[i])
                        of.append(s)
                        found.append(order)
                        score.append(line[order])
        return _heaps(pa.array(rows, pa.int64()), [pa.array(of, pa.int64())], ["row", "score", "heap"], found, score, ids)

    return run


def _merged(heaps: DataFrame, keys: list[str], blocks: int, most: int) -> DataFrame:
    """One heap for each key: those of a few dozen blocks at a time, until there is one block."""
    while True:
        blocks = -(-blocks // FAN)
        best = F.slice(F.sort_array(F.flatten(F.collect_list("heap"))), 1, most).alias("heap")
        heaps = heaps.groupBy(*keys, F.floor(F.col("block") / FAN).cast("int").alias("block")).agg(best)
        if blocks <= 1:
            return heaps.drop("block")


def _by_cell(anchors: DataFrame, candidates: DataFrame, sides: tuple[int, int], work: Callable, fields: str) -> DataFrame:
    """work(anchors, candidates) in every cell; its rows with the number of the candidates' block."""
    few, many = sides
    # columns of their own: both sides come from one table, whose columns cogroup can't tell apart
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    left = anchors.withColumns({"side": F.pmod(F.xxhash64("row"), F.lit(few)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(many - 1)))})
    right = candidates.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(many)).cast("int"), "side": F.explode(F.sequence(F.lit(0), F.lit(few - 1)))})

    def run(key: tuple, a: pa.Table, c: pa.Table) -> pa.Table:
        out = work(a, c)
        return out.append_column("block", pa.array(np.full(out.num_rows, key[0].as_py(), np.int32)))

    return left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInArrow(run, f"{fields}, block int")


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "id", vector_col: str = "vector", label_col: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x). Each anchor's first `positives` other rows of its label, by inner product, then by the lesser id; for each of them the first
    `negatives` rows of other labels with low <= negative score / positive score <= high (as fractions, so none for a negative score).

    Rows with a null id or label, a null vector or a component that is null, not a number or infinite take no part. Vectors of unlike length are filled up
    with zeros; an empty one scores 0. Repeated rows count each: as candidates, as positives and as anchors; rows of one id with unlike vectors are
    rows of their own. Scores are exact up to 2**58; beyond, they and components count as that. Further columns play no part.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    rows = rows.mapInArrow(_usable, f"id {kind}, vector binary, label long, anchor boolean")
    # equal rows are one with a count: however many there are, they are one line of a tile
    rows = rows.groupBy("id", "vector", "label", "anchor").agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    spread = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1024 + 1)
    sides = asked // ANCHORS + 1, max(n // CANDIDATES + 1, spread)
    candidates, anchors = rows.select("row", "id", "vector", "label", "copies"), rows.where("anchor").select("row", "label", "vector")
    heap = f"array<struct<down:long,id:{kind}>>"
    found = _by_cell(anchors, candidates, sides, _positives(positives), f"row long, heap {heap}")
    best = written(_merged(found, ["row"], sides[1], positives), "positives")
    windows = anchors.join(best, "row").withColumn("scores", F.array_distinct(F.transform("heap", lambda x: -x["down"]))).drop("heap")
    found = _by_cell(windows, candidates, sides, _negatives(negatives, low, high), f"row long, score long, heap {heap}")
    near = _merged(found, ["row", "score"], sides[1], negatives)
    pairs = best.select("row", F.explode("heap").alias("p")).select("row", F.col("p.id").alias("positive_id"), (-F.col("p.down")).alias("score"))
    out = pairs.join(near, ["row", "score"]).select("row", "positive_id", "score", F.posexplode("heap").alias("place", "n"))
    named = rows.where("anchor").select("row", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.join(named, "row").select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("n.down")).alias("negative_score")
    )
