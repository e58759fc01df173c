"""Mixing of sources to target weights, by weighted fair queueing.

Each source is a queue of its documents in shuffled order, pass after pass. A copy of a document has a virtual finish time: the words of its queue up to
its end, by the source's target. All copies are sorted by that time across the sources and the stream is cut at the budget.
At the cut every queue has one document under way; the words served by then are taken of it, so a source comes to its
target up to a word, however long its documents are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import written
from tripleloom.llm.scan import Sums, counted, running

WEIGHTS = (1, 2, 3)
#: Times that a source, and so each of its documents, is taken at most.
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, one row a source) with its target: a share of all sizes by weight, at most `most` times the source's size.

    Sources take the weights in turn, by code point, null last. What is above the limit is shared out again by weight among the others until none is above.
    """
    ordered = written(sizes.withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long"), "all": F.lit(0)}), "sources")
    ranked = running(ordered, "all", ["last", "source"], Sums(rank="one"), 0)
    turn = (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")
    ranked = written(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight")), "weights")
    limit = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        above = limit <= F.col("weight") * level
        found = ranked.agg(F.sum("source_size"), F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if found[1] == capped or not found[3]:
            return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))
        level, capped = (found[0] - (found[2] or 0)) / found[3], found[1]


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0,
) -> DataFrame:
    """The mix as references: row, id, source, size, source_size, target, copy, words, finish, position.

    One row for every copy that the mix takes words of, and for the first copy of every row of docs. words: taken of this copy, counted from its start.
    finish: its virtual finish time; position: words of the mix before it. `row` numbers the rows of docs.
    A null text has no words. Null is a source of its own, after the others. Rows without words take part with 0 words.
    Repeated rows are rows like others; which of them gets one copy more is open, how many do isn't. The same rows give the same mix.
    Other columns of docs play no part. No rows, no mix.
    """
    wanted = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.lit(seed), F.struct(id_col), F.struct(text_col)).alias("shuffled"), F.col(text_col).alias("text"))
    sized = written(counted(wanted, "text", "size").withColumn("row", F.monotonically_increasing_id()), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    of = written(targets(sums.drop("rows"), weights, most), "targets")
    rows = sized.count()
    queued = running(sized, "source", ["shuffled", "size", "row"], Sums(end="size"), rows)
    queued = queued.withColumnRenamed("source", "own").join(of, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("start", F.col("copy") * F.col("source_size") + F.col("end") - F.col("size"))
    # whole words; the sum can be off by rounding
    served = F.floor(F.col("target") + 1e-6) - F.col("start")
    copies = copies.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("size", served))).where("copy = 0 or words > 0")
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).otherwise(0.0)
    copies = copies.select("row", "id", "source", "size", "source_size", "target", "shuffled", "copy", "words", finish.alias("finish"), F.lit(0).alias("all"))
    # a copy that is cut ends at the cut; those without words come last
    copies = written(copies.withColumn("ends", F.when(F.col("words") < F.col("size"), F.lit(1.0)).otherwise(F.col("finish"))), "copies")
    mixed = running(copies, "all", [F.col("words") == 0, "ends", "shuffled", "size", "row", "copy"], Sums(position="words"), rows)
    budget = F.lit(sum(r[0] or 0 for r in of.agg(F.sum("source_size")).collect()))
    before = F.col("position") - F.col("words")
    left = F.greatest(F.lit(0).cast("long"), budget - before)
    return mixed.select(
        "row", "id", "source", "size", "source_size", "target", (F.col("copy") + 1).alias("copy"), F.least("words", left).alias("words"), "finish", before.alias("position")
    )


def taken(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target and taken, the words that the mix takes of it, repeats counted; see schedule()."""
    mixed = schedule(docs, **settings)
    return mixed.groupBy("row", "id", "size", "source_size", "target").agg(F.sum("words").alias("taken")).drop("row")
