"""Document fingerprints: MinHash signatures of word shingles, compared in place or joined by bands."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.llm.common import add_columns, fresh, slices, text_bytes
from tripleloom.llm.words import Words, constants, least_per_row, mix

#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 5
#: Hash permutations. The standard error of a likeness is at most 1 / (2 * sqrt(PERMUTATIONS)).
PERMUTATIONS = 128
#: Rows of a band: two texts of likeness 0.8 miss all 32 bands with a chance below 1e-7.
BAND = 4
#: Bytes hashed at a time, so that the shingles stay in the processor's cache while all permutations pass over them.
_PASS_BYTES = 1 << 18
#: Text bytes of a range of ids, on average, and the most ranges there may be; a range is read in batches, so its size is free.
RANGE_BYTES = 32 << 20
MOST_RANGES = 20_000


def signatures(data: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> np.ndarray:
    """A row of 16-bit values for each text: of each permutation's least shingle hash, 16 mixed bits.

    A permutation is x -> a * x + b modulo 2**64 with a odd, a universal family on mixed shingle hashes. Texts without words
    share one signature.
    """
    factors, shifts = constants(permutations, 31), mix(constants(permutations, 37))
    out = np.empty((len(offsets) - 1, permutations), np.uint16)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    for first, last, part, at in slices(data, offsets, _PASS_BYTES):
        grams, bounds = Words(part, at).shingles(shingle)
        hashed = np.empty_like(grams)
        for k in range(permutations):
            np.multiply(grams, factors[k], out=hashed)
            hashed += shifts[k]
            least = least_per_row(hashed, bounds, empty)
            out[first:last, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places of two signatures, an estimate of the texts' Jaccard similarity."""
    return (a == b).mean(axis=-1)


def _hex(rows: np.ndarray) -> list[str]:
    whole, width = rows.astype(">u2").tobytes().hex(), rows.shape[1] * 4
    return [whole[i * width : (i + 1) * width] for i in range(len(rows))]


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the signature of its text as hexadecimal text, 4 digits a permutation; null is the empty text."""
    new = fresh(docs, "fingerprint_hex")

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_hex(signatures(*text_bytes(batch, batch.schema.names[0]))), pa.string())]

    return add_columns(docs.drop(name), f"{new} string", values, text_col).withColumnRenamed(new, name)


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _at_or_below(bounds: list, x: Column) -> Column:
    """How many of the sorted bounds are not above x: first among every 64th, then among the 64 from there on."""
    count = lambda some: F.size(F.filter(some, lambda b: b <= x))
    if not bounds:
        return F.lit(0)
    whole = F.array(*map(F.lit, bounds))
    if len(bounds) <= 64:
        return count(whole)
    before = F.greatest((count(F.array(*map(F.lit, bounds[::64]))) - 1) * 64, F.lit(0))
    return before + count(F.slice(whole, before + 1, F.lit(64)))


def _ranges(docs: DataFrame, n: int) -> tuple[Column, int]:
    """The range of a row of (id, order), of about n of like numbers of rows, and how many ranges there are.

    Bounds are percentiles of the ids. An id that takes up several has as many ranges of its own, dealt out by `order`, a hash.
    """
    at = F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n) if n > 1 else F.lit(None)
    times = Counter(docs.agg(at.alias("b")).first()[0] or [])
    bounds, rest = sorted(times), [0]
    for b in bounds:
        rest.append(rest[-1] + 1 + (times[b] if times[b] > 1 else 0))
    of_id = F.element_at(F.array(*map(F.lit, rest)), _at_or_below(bounds, F.col("id")) + 1)
    hot = {b: m for b, m in times.items() if m > 1}
    if hot:
        parts = F.element_at(F.create_map(*[x for b, m in hot.items() for x in (F.lit(b).cast(docs.schema["id"].dataType), F.lit(m))]), F.col("id"))
        own = F.shiftright((F.shiftright("order", 33) + (1 << 30)) * parts, 31)
        of_id = of_id - F.coalesce(parts - own, F.lit(0))
    return of_id.cast("int"), rest[-1] + 1


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document's.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is the one
    with the next greater id, after the last one the first; rows of one id follow each other in the order of a hash of
    their text. A null text is empty. A row with a null id has no next document, which counts as an empty one. An empty
    table gives no rows. Texts are dealt out once, by ranges of ids and, for an id of many rows, of their hash; the first row
    of a range also goes to the range before. The number of ranges follows the input; equal rows lie in one range, which a
    task reads in batches.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(total / range_bytes), MOST_RANGES))
    docs = docs.withColumn("order", F.xxhash64("text"))
    range_of, n = _ranges(docs, n)
    first = F.min(F.struct("id", "order")).alias("first")
    heads = {r["range"]: tuple(r["first"]) for r in docs.where("id is not null").groupBy(range_of.alias("range")).agg(first).collect()}
    order = sorted(heads)
    # a null id stands alone in ranges of its own
    range_of = F.when(F.col("id").isNull(), n + F.pmod(F.col("order"), F.lit(n))).otherwise(range_of)
    rows = docs.withColumns({"range": range_of.cast("int"), "tail": F.lit(False)})
    if heads:
        # the first row of each range goes to the range before; of the first range, to the last
        kinds = [docs.schema[c].dataType for c in ("id", "order")]
        key = lambda head: F.struct(*[F.lit(x).cast(t).alias(c) for x, t, c in zip(head, kinds, ("id", "order"), strict=True)])
        goes_to = F.create_map(*[x for i, k in enumerate(order) for x in (key(heads[k]), F.lit(order[i - 1]))])
        tails = docs.where(F.col("id").isin([i for i, _ in heads.values()])).withColumns(
            {"range": F.element_at(goes_to, F.struct("id", "order")).cast("int"), "tail": F.lit(True)}
        )
        rows = rows.unionByName(tails.where("range is not null").dropDuplicates(["id", "order"]))
    rows = rows.repartitionById(n, "range").sortWithinPartitions("range", "tail", "id", "order")
    schema = T.StructType(
        [T.StructField("id", docs.schema["id"].dataType)]
        + T.StructType.fromDDL(
            "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        ).fields
    )
    loose = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its id, text, range, whether it is a tail, signature
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                signs = signatures(*text_bytes(batch, "text"))
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                ranges, tails = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                rows = [(ids[i], texts[i], ranges[i], tails[i], signs[i]) for i in range(len(texts))]
                rows = ([held] if held else []) + rows
                held = rows[-1]
                yield _compared(rows[:-1], rows[1:], loose)
        if held:
            yield _compared([held], [None], loose)

    out = rows.select("id", "text", "range", "tail").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def _compared(rows: list[tuple], following: list[tuple | None], loose: int) -> pa.RecordBatch:
    pairs = [(r, f) for r, f in zip(rows, following, strict=True) if not r[3]]
    none = (None, "", None, None, signatures(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])
    pairs = [(r, f if f and f[2] == r[2] < loose else none) for r, f in pairs]
    changed = [edited(r[1], f[1]) for r, f in pairs]
    new = signatures(*text_bytes(pa.RecordBatch.from_arrays([pa.array(changed, pa.string())], ["t"]), "t"))
    width = new.shape[1]
    own = np.array([r[4] for r, _ in pairs], np.uint16).reshape(-1, width)
    other = np.array([f[4] for _, f in pairs], np.uint16).reshape(-1, width)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0].as_py() for r, _ in pairs], rows[0][0].type if rows else pa.int64()),
            pa.array([len(r[1]) for r, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.string()),
            pa.array(_hex(own), pa.string()),
            pa.array(_hex(new), pa.string()),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, other), pa.float64()),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def band_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each band of each text's signature."""
    rows = signatures(data, offsets).reshape(len(offsets) - 1, -1, BAND).astype(np.uint64)
    bands_of = np.arange(rows.shape[1], dtype=np.uint64)
    return mix((mix(rows + np.uint64(1)) * constants(BAND, 43)).sum(axis=2, dtype=np.uint64) + bands_of)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of documents that share a band, with Jaccard similarity verified; see neighbors.classes()."""
    from tripleloom.llm import neighbors

    return neighbors.classes(docs, band_keys, id_col, text_col)
