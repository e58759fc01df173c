"""Quality: Bradley-Terry ranking. Preference pairs of better and worse documents give a linear score over plain measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import add_columns, fresh, in_fold, slices, text_bytes, written
from tripleloom.llm.words import Words

#: Better documents that each worse one is compared with, on average.
PAIRS = 6
REGULARISATION = 1e-4
#: The score that the threshold gets.
THRESHOLD = 0.3
#: Shares are also given as logarithms, from this one on.
LEAST_SHARE = 1e-3
#: The threshold lies midway between the quantiles this part of the worse share below and above the share itself.
MARGIN = 0.05

_KIND = np.zeros(256, np.int64)  # 0 letters and bytes above 127, then:
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,", b"!?;:'\"()-"), 1):
    _KIND[list(_bytes)] = _kind
_KIND[[b for b in range(128) if _KIND[b] == 0 and not chr(b).isalpha()]] = 7
KINDS = 8


def measures(batch: pa.RecordBatch) -> list[pa.Array]:
    """Plain measures of each text's form: kinds of characters, lengths, repetition; shares also as logarithms."""
    data, offsets = text_bytes(batch, batch.schema.names[0])
    rows = []
    for first, last, part, at in slices(data, offsets):
        n = last - first
        lengths = np.diff(at)
        row = np.repeat(np.arange(n), lengths)
        kinds = np.bincount(row * KINDS + _KIND[part], minlength=n * KINDS).reshape(n, KINDS)
        words = Words(part, at)
        count, of = np.diff(words.bounds), words.texts()
        size = words.end - words.start
        per_word, per_byte = np.maximum(count, 1), np.maximum(lengths, 1)
        share = lambda flags: np.bincount(of[: len(flags)][flags], minlength=n) / per_word
        again = np.zeros(len(of), bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])
        grams, bounds = words.shingles(3)
        gram_row = np.repeat(np.arange(n), np.diff(bounds))
        # the text's number in the upper 24 bits, 40 bits of the gram below
        keyed = np.unique((gram_row.astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24)))
        distinct = np.bincount((keyed >> np.uint64(40)).astype(np.int64), minlength=n)
        shares = np.column_stack(
            [
                kinds / per_byte[:, None],
                share(again),
                share(size > 15),
                share(size < 3),
                1 - distinct / np.maximum(np.diff(bounds), 1),
            ]
        )
        plain = np.column_stack([np.log1p(count), np.bincount(of, weights=size, minlength=n) / per_word / 10])
        rows.append(np.column_stack([plain, shares, np.log(shares + LEAST_SHARE) / 5]))
    table = np.concatenate(rows) if rows else np.zeros((0, 2 + 2 * (KINDS + 4)))
    flat = pa.array(table.ravel())
    steps = pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32())
    return [pa.ListArray.from_arrays(steps, flat)]


def weights(measured: DataFrame, labels: DataFrame, pairs: int = PAIRS) -> list[float] | None:
    """Weights from preference pairs; None without documents of both kinds.

    measured: id, measures. labels: id, better boolean, unique ids. Every worse document meets about `pairs` better
    ones, found by hash. The loss is logistic in the difference of the two documents' measures.
    """
    known = measured.join(labels, "id").select("id", "better", "measures")
    counts = {r["better"]: r["n"] for r in known.groupBy("better").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    slots = counts[True]
    better = known.where("better").select(F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot"), F.col("measures").alias("high"))
    worse = known.where(~F.col("better")).select(
        F.col("measures").alias("low"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(pairs)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(slots)))).alias("slot")
    )
    differences = worse.join(better, "slot").select(F.zip_with("high", "low", lambda a, b: a - b).alias("x"))
    both = differences.withColumn("label", F.explode(F.array(F.lit(1.0), F.lit(0.0)))).select(
        "label", array_to_vector(F.when(F.col("label") == 1, F.col("x")).otherwise(F.transform("x", lambda v: -v))).alias("features")
    )
    both = written(both, "quality-pairs")
    if both.isEmpty():
        return None
    return list(LogisticRegression(fitIntercept=False, regParam=REGULARISATION, maxIter=60).fit(both).coefficients)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    name: str = "score",
) -> DataFrame:
    """docs with a quality score from 0 to 1 as its last column; THRESHOLD separates what is kept from what goes.

    The ranking is learned from all given labels; of several labels of an id the least counts, null ids and labels don't. The
    threshold is the quantile, over all labelled documents' scores, that leaves as many below as are labelled worse. A null
    text is scored as an empty one; repeated rows get equal scores. Without labels of both kinds every score is 0.5.
    """
    docs = docs.drop(name)
    new = fresh(docs, "measures")
    measured = written(add_columns(docs.select(id_col, text_col), f"{new} array<double>", measures, text_col).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(new).alias("measures")
    ), "quality-measures")
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).alias("better"))
    found = weights(measured, marked)
    if found is None:
        return docs.withColumn(name, F.lit(0.5))
    raw = F.aggregate(
        F.zip_with("measures", F.array(*map(F.lit, found)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
    )
    judged = measured.join(marked, "id").select(raw.alias("raw"), "better")
    worse = judged.agg(F.avg((~F.col("better")).cast("double"))).first()[0]
    low, high = judged.agg(
        F.percentile_approx("raw", [worse * (1 - MARGIN), min(1.0, worse * (1 + MARGIN))], 100_000)
    ).first()[0]
    base = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    docs_raw = fresh(docs, "raw")
    broad = [float(x) for x in found]

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        table = measures(batch)[0]
        width = len(broad)
        x = np.asarray(table.flatten()).reshape(-1, width) @ np.array(broad)
        return [pa.array(1 / (1 + np.exp(-np.clip(x - (low + high) / 2 + base, -35, 35))))]

    return add_columns(docs, f"{docs_raw} double", values, text_col).withColumnRenamed(docs_raw, name)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
) -> DataFrame:
    """docs with held_out, score and predicted. Labels of the held-out fold are not looked at."""
    scored = score(docs.drop("held_out", "predicted"), labels.where(~in_fold(id_col, folds, held_fold)), id_col, text_col, label_col)
    return scored.withColumns({"held_out": in_fold(id_col, folds, held_fold), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
