"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import add_columns, fresh, in_fold, slices, text_bytes, written
from tripleloom.llm.words import Words, constants, mix

#: Hashed features: 2**BITS weights at most, which bounds the model and what is broadcast.
BITS = 20
#: Labelled rows learned from at most: those with the least hash of their id. More are not read.
SAMPLE = 12_000
#: Features in fewer learned rows than this get no weight.
LEAST_ROWS = 4
EPOCHS = 10


@dataclass(frozen=True)
class Rates:
    """alpha and beta set each weight's own learning rate; l1 keeps weights at zero until enough speaks for them."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


_PAIR = constants(5, 23)


def features(words: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every word, word pair and pair with one word left out between, repeats included."""
    h, text = words.hashes, words.texts()
    shift = np.uint64(64 - bits)
    yield text, (h >> shift).astype(np.int64)
    for gap in (1, 2):
        same = np.flatnonzero(text[:-gap] == text[gap:])
        yield text[same], (mix(h[same] * _PAIR[gap] + h[same + gap] * _PAIR[gap + 2]) >> shift).astype(np.int64)


def _feature_sets(texts: pa.RecordBatch, bits: int) -> Iterator[bytes]:
    """The distinct features of each text, sorted, as 32-bit bytes."""
    data, offsets = text_bytes(texts, texts.schema.names[0])
    for first, last, part, at in slices(data, offsets):
        words = Words(part, at)
        found = np.unique(np.concatenate([(text << bits) | f for text, f in features(words, bits)]))
        bounds = np.searchsorted(found, np.arange(last - first + 1) << bits)
        low = (found & ((1 << bits) - 1)).astype("<u4")
        for i in range(last - first):
            yield low[bounds[i] : bounds[i + 1]].tobytes()


def ftrl(rows: list[np.ndarray], targets: np.ndarray, size: int, epochs: int = EPOCHS, rates: Rates = Rates()) -> tuple[np.ndarray, float]:
    """Weights and bias after `epochs` passes in the given order; a row is its distinct features, all of value 1."""
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = 0.0, 0.0

    def weights(at) -> np.ndarray:
        over = np.abs(z[at]) - rates.l1
        return np.where(over > 0, -np.sign(z[at]) * over / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2), 0.0)

    for _ in range(epochs):
        for at, target in zip(rows, targets, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - target
            was = n[at]
            n[at] = was + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(was)) / rates.alpha * w
            bias_n += g * g
            bias -= rates.alpha / (rates.beta + bias_n**0.5) * g
    return weights(slice(None)), float(bias)


@dataclass(frozen=True)
class Model:
    """Features with a weight, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    bits: int = BITS,
    epochs: int = EPOCHS,
    rates: Rates = Rates(),
) -> Model:
    """Learn from the labelled rows. Rows with a null id or label don't count; several labels of an id: the largest; several texts: one of them, by hash.

    At most `sample` labels are used, those with the least hash of the id, in that order. Without rows of both kinds the
    model has no weights and gives 0 to every text.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("target"))
    marked = marked.withColumn("rank", F.xxhash64("id")).orderBy("rank", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(marked), "id").select("rank", "target", "text")  # `sample` rows of three numbers
    # one text of each id, so that what is learnt from is bounded however often an id comes
    rows = rows.groupBy("rank", "target").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_feature_sets(batch.select(["text"]), bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["rank", "target", "features"])

    rows = written(rows.mapInArrow(shrink, "rank long, target int, features binary"), "toxicity-sample")

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["rank", "features"], ignore_index=True)
        sets = [np.frombuffer(x, "<u4").astype(np.int64) for x in table["features"]]
        target = table["target"].to_numpy()
        if target.min() == target.max():
            return pd.DataFrame({"index": [-1], "weight": [-35.0]})
        often = np.zeros(1 << bits, np.int64)
        for row in sets:
            often[row] += 1
        sets = [row[often[row] >= LEAST_ROWS] for row in sets]
        weight, bias = ftrl(sets, target, 1 << bits, epochs, rates)
        at = np.flatnonzero(weight)
        return pd.DataFrame({"index": np.append(at, -1), "weight": np.append(weight[at], bias)})

    found = rows.groupBy(F.lit("all")).applyInPandas(fit, "index int, weight double").toPandas()
    bias = found[found["index"] < 0]["weight"]
    found = found[found["index"] >= 0].sort_values("index")
    return Model(found["index"].to_numpy(), found["weight"].to_numpy(), float(bias.iloc[0]) if len(bias) else -35.0, bits)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic as its last column; null texts are scored as empty ones.

    A column of that name is replaced. Every row stays, repeated rows get equal scores.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight))

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        index, weight = shared.value
        dense = np.zeros(1 << model.bits)
        dense[index] = weight
        data, offsets = text_bytes(batch, text_col)
        sums = np.full(batch.num_rows, model.bias)
        for first, last, part, at in slices(data, offsets):
            words = Words(part, at)
            hits = []
            for text, feature in features(words, model.bits):
                kept = np.flatnonzero(dense[feature])
                hits.append((text[kept] << model.bits) | feature[kept])
            hit = np.unique(np.concatenate(hits))
            low = hit & ((1 << model.bits) - 1)
            sums[first:last] += np.bincount(hit >> model.bits, weights=dense[low], minlength=last - first)
        return [pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))]

    new = fresh(docs, "toxicity_score")
    return add_columns(docs, f"{new} double", values, text_col).withColumnRenamed(new, name)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    folds: int = 3,
    held_fold: int = 1,
) -> DataFrame:
    """docs with held_out, score and predicted. Labels of the held-out fold are not looked at.

    Null and empty texts are scored like others, repeated rows alike; a null id is of the fold of the empty text. An empty table gives no rows, one
    without labels scores 0. Columns of docs with one of the new names are replaced.
    """
    model = train(docs, labels.where(~in_fold(id_col, folds, held_fold)), id_col, text_col, label_col)
    docs = docs.drop("held_out", "predicted")
    held: Column = in_fold(id_col, folds, held_fold)
    return score(docs, model, text_col).withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
