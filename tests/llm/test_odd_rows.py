"""Every operator on nulls, empty and long texts, repeated rows, empty tables, and columns whose names clash with its own."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleloom.llm import decontaminate, fingerprints, forest, packing, passages, quality, suffixes, toxicity, urls, warc
from tripleloom.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "Some plain words that stand here for a text of no great length, with a full stop."),
    (2, None),
    (3, ""),
    (None, "Some plain words that stand here for a text of no great length, with a full stop."),
    (None, None),
    (4, LONG),
    (5, LONG),
    (6, "  \n\t "),
    (7, "été 你好 \U0001f600 İstanbul"),
    (7, "été 你好 \U0001f600 İstanbul"),
    (8, "one"),
]
CLASHING = ("id", "key", "words", "bucket", "part", "tail", "range", "node", "keys", "place", "group", "salt", "seed", "source", "measures",
            "score", "predicted", "held_out", "spans", "kept_text", "items", "n_words", "text_hash", "rank", "__found", "host", "path", "tokens",
            "__id", "__hash", "__n", "__own", "pieces", "later", "stretches", "d0", "d1", "n", "own", "hit", "shape", "class")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    return plain.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (4, None, None), (None, 1, 1), (99, 0, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, None), (2, ""), (3, "words that stand here for a text of no great length with"), (3, "one"), (None, "one"), (4, "你好")], "item_id long, text string"
    )


OPERATORS = {
    "packing": lambda d, lab, b: packing.pack(d, tokenizer_path()),
    "forest": lambda d, lab, b: forest.join(d),
    "bands": lambda d, lab, b: fingerprints.near_classes(d),
    "passages": lambda d, lab, b: passages.deduplicate(d),
    "suffixes": lambda d, lab, b: suffixes.deduplicate(d),
    "edited": lambda d, lab, b: fingerprints.compare_edited(d),
    "fingerprint": lambda d, lab, b: fingerprints.fingerprint(d),
    "toxicity": lambda d, lab, b: toxicity.classify(d, lab),
    "quality": lambda d, lab, b: quality.classify(d, lab),
    "decontaminate": lambda d, lab, b: decontaminate.decontaminate(d, b),
    "warc": lambda d, lab, b: warc.derive(warc.responses(d, "doc_id", "text", "text"), keep="page_id" if "page_id" in d.columns else "doc_id"),
    "urls": lambda d, lab, b: urls.judge(d, lab.select("doc_id", (F.col("toxic") == 1).alias("blocked")), "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, benchmark, name):
    rows = OPERATORS[name](docs, labels, benchmark).collect()
    ids = [r["doc_id"] for r in rows]
    expected = sorted((r[0] for r in ROWS), key=str)
    if name == "packing":
        assert sorted({r["doc_id"] for r in rows}, key=str) == sorted(set(expected), key=str)
        assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3, 6)) == 3  # the end id alone
    elif name == "warc":
        assert sorted(ids, key=str) == sorted(expected * 2, key=str)
    else:
        assert sorted(ids, key=str) == expected
    again = [r for r in rows if r["doc_id"] == 7]
    if name != "packing":
        assert len({str(r) for r in again}) == (2 if name == "warc" else 1) or name == "edited"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, benchmark, name):
    none = [x.where(F.lit(False)) for x in (docs, labels, benchmark)]
    assert OPERATORS[name](*none).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontaminate", "urls"])
def test_empty_second_table(docs, labels, benchmark, name):
    rows = OPERATORS[name](docs, labels.where(F.lit(False)), benchmark.where(F.lit(False))).collect()
    assert len(rows) == len(ROWS)
    if name == "quality":
        assert {r["predicted"] for r in rows} == {1}
    if name == "toxicity":
        assert {r["predicted"] for r in rows} == {0}
    if name == "decontaminate":
        assert not any(r["contaminated"] for r in rows)


def test_other_columns_stay(docs, labels, benchmark):
    for name, added in (("passages", {"n_words", "spans", "kept_text"}), ("decontaminate", {"n_words", "items"}), ("quality", {"score", "predicted", "held_out"})):
        row = OPERATORS[name](docs, labels, benchmark).where("doc_id = 8").first().asDict()
        assert all(row[c] == f"own {c}" for c in CLASHING if c not in added)


def test_defined_results(docs, labels, benchmark):
    found = {r["doc_id"]: r for r in OPERATORS["passages"](docs, labels, benchmark).where("doc_id is not null").collect()}
    assert found[5]["kept_text"] == "" and found[4]["kept_text"] == LONG and found[2]["kept_text"] is None
    spans = found[5]["spans"]  # the text repeats itself after 12,961 words, so there are several
    assert {s["source"] for s in spans} == {4} and min(s["first"] for s in spans) == 0 and max(s["end"] for s in spans) == 30_000
    found = {r["doc_id"]: r for r in OPERATORS["suffixes"](docs, labels, benchmark).where("doc_id is not null").collect()}
    assert found[5]["kept"] == b"" and found[4]["kept"] == LONG.encode() and found[2]["n_bytes"] == 0
    classes = {r["doc_id"]: r for r in OPERATORS["forest"](docs, labels, benchmark).where("doc_id is not null").collect()}
    assert classes[5]["class_id"] == 4 and classes[5]["n_links"] == 0 and classes[5]["n_copies"] == 2
    assert {classes[i]["class_id"] for i in (2, 3, 6)} == {2}
    hits = {r["doc_id"]: r for r in OPERATORS["decontaminate"](docs, labels, benchmark).where("doc_id is not null").collect()}
    assert (hits[1]["n_hit"], hits[1]["items"]) == (12, ["3"])
    assert (hits[8]["n_hit"], hits[8]["items"]) == (1, ["3"]) and hits[7]["items"] == ["4"]


# one id, or one row, on a third of all rows


def words_of(i, n=40):
    return " ".join(f"w{(i * 7919 + j * 104729) % 50021}" for j in range(n))


@pytest.fixture(scope="module")
def hot(spark):
    """200 rows of id 50 with texts of their own, 200 equal rows of id 70, 200 rows of one id each."""
    rows = [(50, words_of(i)) for i in range(200)] + [(70, words_of(900))] * 200 + [(i, words_of(1000 + i)) for i in range(100, 300)]
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(6)


def test_hot_ids_are_fingerprinted_in_many_ranges(spark, hot):
    rows = [tuple(r) for r in hot.selectExpr("doc_id", "xxhash64(text) as h", "text").orderBy("doc_id", "h").collect()]
    want = Counter()
    for (i, _, text), following in zip(rows, rows[1:] + rows[:1], strict=True):
        want[i, hashlib.sha256(fingerprints.edited(text, following[2]).encode()).hexdigest()] += 1
    for range_bytes in (1 << 30, 3000):
        found = fingerprints.compare_edited(hot, range_bytes=range_bytes)
        assert Counter((r["doc_id"], r["edited_sha256"]) for r in found.collect()) == want
    one = hot.withColumns({"id": F.col("doc_id"), "order": F.xxhash64("text")})
    ranges, n = fingerprints._ranges(one, 60)
    of_hot = [r["count"] for r in one.where("id = 50").groupBy(ranges.alias("k")).count().collect()]
    assert len(of_hot) > 10 and max(of_hot) < 30 and one.agg(F.max(ranges)).first()[0] < n


def test_hot_rows_are_packed_in_many_groups(hot):
    found = packing.pack(hot, tokenizer_path(), group_bytes=8000).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({50: 200, 70: 200} | {i: 1 for i in range(100, 300)})
    places = [(r["sequence_id"], r["offset"]) for r in found]
    assert len(set(places)) == len(places)
    groups = Counter(r["sequence_id"] >> 32 for r in found if r["doc_id"] == 70)
    assert len(groups) > 12 and max(groups.values()) < 40


def test_hot_ids_lose_no_strings(hot):
    found = suffixes.deduplicate(hot, bucket_bytes=8000, part_bytes=8000)
    texts = hot.collect()
    known, kept = set(), Counter()
    for i in sorted({r["doc_id"] for r in texts}):
        own = [r["text"].encode() for r in texts if r["doc_id"] == i]
        for t in own:
            gone = {k + j for k in range(len(t) - 49) if t[k : k + 50] in known for j in range(50)}
            kept[i, bytes(b for j, b in enumerate(t) if j not in gone)] += 1
        known |= {t[k : k + 50] for t in own for k in range(len(t) - 49)}
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in found.collect()) == kept
