"""Benchmark decontamination by winnowing, in DataFrame operations alone.

k-gram hashes of five words are taken over benchmark items and documents. Of every six neighbouring hashes the least is
kept, so any ten words that both sides share keep a hash in common. Kept hashes are joined, the words around each
hit are compared one by one, and only windows that match whole count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import ascii_lower, fresh, written

#: Words of a benchmark window; a shorter item is one window.
WINDOW = 10
#: Words of a k-gram; WINDOW - GRAM + 1 neighbouring k-grams lie in a window.
GRAM = 5
#: Kept hashes of the benchmark that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAKS), lambda w: w != "")


def grams(hashes: Column, k: int) -> Column:
    """Every run of k words as one number: 31 bits of the hash of the words' hashes above, its place below (32 bits)."""
    last = F.size(hashes) - (k - 1)
    gram = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    return F.when(
        last > 0,
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: F.shiftleft(gram(i).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def winnowed(grams: Column, w: int) -> Column:
    """Of every w neighbours the least, the first among equal hashes; each one once."""
    if w == 1:
        return grams
    last = F.size(grams) - (w - 1)
    return F.when(
        last > 0,
        F.array_distinct(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))),
    ).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(texts: DataFrame, keep: list[str], k: int, w: int, place: str) -> DataFrame:
    """A row for each kept k-gram of `words`: gram and its place beside the kept columns."""
    # each step a column of its own: what a lambda refers to is then computed once for a text. explode_outer, as explode would
    # have Catalyst test the size of the whole nested expression at the scan
    made = texts.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    made = made.select(*keep, grams(F.col("hashes"), k).alias("grams"))
    made = made.select(*keep, winnowed(F.col("grams"), w).alias("all_kept"))
    kept = made.select(*keep, F.explode_outer("all_kept").alias("kept")).where(F.col("kept").isNotNull())
    low = F.col("kept").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return kept.select(*keep, F.shiftright("kept", 32).alias("gram"), low.alias(place))


def _hits(docs: DataFrame, items: DataFrame, length: int, k: int, broadcast_grams: int) -> DataFrame:
    """Matching windows around shared k-grams: key, item, first and last word of a run of matching words.

    docs: key, text. items: item, words. A run is at least `length` words. Every window has a k-gram that both sides keep, and
    the length - k words to either side of it decide on the window, so a longer run is the union of the runs found.
    """
    spread = length - k
    around = lambda at: F.slice("words", F.greatest(at - spread, F.lit(0)) + 1, F.least(at, F.lit(spread)) + (k + spread))
    targets = _fingerprints(items, ["item", "words"], k, spread + 1, "q").select("item", "gram", "q", around(F.col("q")).alias("b"))
    kept = targets.select("gram").distinct()
    texts = docs.select("key", words(F.col("text")).alias("words"))
    if kept.count() <= broadcast_grams:
        # documents' words stay in place: a place that no item shares is never written out
        places = _fingerprints(texts, ["key", "words"], k, spread + 1, "p").join(F.broadcast(kept), "gram", "left_semi")
    else:
        # too many to broadcast: first the documents that share any, then their places with the words around
        caught = _fingerprints(texts, ["key"], k, spread + 1, "p").join(kept, "gram", "left_semi").select("key").distinct()
        places = _fingerprints(texts.join(caught, "key", "left_semi"), ["key", "words"], k, spread + 1, "p")
    places = places.select("key", "gram", "p", around(F.col("p")).alias("a"))
    # both contexts start equally far before the k-gram
    met = places.join(targets, "gram").withColumn("back", F.least("p", "q", F.lit(spread)))
    met = met.withColumns({c: F.slice(c, F.least(at, F.lit(spread)) - F.col("back") + 1, 2 * length) for c, at in (("a", "p"), ("b", "q"))})
    met = met.withColumn("n", F.least(F.size("a"), F.size("b")))
    # places where the two sides differ; the run around the k-gram lies between two of them
    differ = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("a"), i) != F.get(F.col("b"), i))
    met = met.withColumn("differ", differ)
    before = F.coalesce(F.array_max(F.filter("differ", lambda i: i < F.col("back"))) + 1, F.lit(0))
    after = F.coalesce(F.array_min(F.filter("differ", lambda i: i >= F.col("back"))), F.col("n"))
    met = met.withColumns({"before": before, "after": after}).where(F.col("after") - F.col("before") >= length)
    begin = F.col("p") - F.col("back")
    return met.select("key", "item", (begin + F.col("before")).alias("first"), (begin + F.col("after") - 1).alias("last"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """Benchmark passages in documents, one row per id and distinct text: id_col, text_hash, n_words, spans, items, hit_words.

    spans: the runs of words [first, last] that match an item's window, with the item; items: the items found;
    hit_words: words inside any such window. A null text has no words. Items without words, and null item ids, match
    nothing. Rows with the same id and text are one row here; rows of one id with different texts stay apart
    (text_hash). Empty tables give no hits.
    """
    text_hash = F.xxhash64(F.col("text"))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.struct(F.col("id"), text_hash.alias("text_hash")))
    items = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("words"))
    items = items.where(F.col("item").isNotNull() & (F.size("words") > 0)).distinct()
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]
    found = None
    for length in sorted(lengths, reverse=True):  # `window` lengths at most
        own = items.where(F.least(F.size("words"), F.lit(window)) == length)
        part = _hits(docs, own, length, gram if length == window else length, broadcast_grams)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = "key struct<id:%s,text_hash:bigint>, item %s, first int, last int"
        found = docs.sparkSession.createDataFrame([], empty % (docs.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()))
    found = written(found.distinct(), "contamination-hits")
    hit = found.select("key", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("hit_words"))
    by_key = found.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("first", "last", "item"))).alias("spans"),
        F.collect_set("item").alias("items"),
    )
    out = by_key.join(hit, "key").select(F.col("key.id").alias("id"), "key.text_hash", "spans", "items", "hit_words")
    return out.withColumnRenamed("id", id_col if id_col not in out.columns else fresh(out, id_col))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """docs with n_words, n_hit, items (found ones, sorted as strings; none: empty) and contaminated added to its columns.

    Every input row stays, a repeated one as often as it came; columns of docs with one of these names are replaced. See
    contamination() for the cases.
    """
    added = ("n_words", "n_hit", "items", "contaminated")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    # columns by their place, so that no name of docs clashes with one of the names here
    names, asked = [f"d{i}" for i in range(len(docs.columns))], docs.columns
    the_id, the_text = (names[[c.lower() for c in asked].index(x.lower())] for x in (id_col, text_col))
    docs = docs.toDF(*names)
    found = contamination(docs, items, the_id, the_text, **options)
    found = found.select(
        F.col(the_id).alias("id"),
        F.col("text_hash").alias("hash"),
        F.col("hit_words").alias("hit"),
        F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("found"),
    )
    own = docs.withColumns({"n": F.size(words(F.col(the_text))).cast("long"), "own": F.xxhash64(the_text)})
    # by a shuffle at every size: the result may be too large to broadcast
    joined = own.join(found.hint("merge"), own[the_id].eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), "left")
    out = joined.select(
        *names,
        "n",
        F.coalesce("hit", F.lit(0)).cast("long").alias("hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("found"),
        F.col("hit").isNotNull().alias("contaminated"),
    )
    return out.toDF(*asked, *added)
