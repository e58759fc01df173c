"""Packing, filters, classifiers, decontamination, fingerprints and WARC records, against plain versions and held-out rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import oracle
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.llm import decontaminate, fingerprints, packing, queries, toxicity, urls, warc
from tripleloom.llm.words import Words

SF = "/root/testdata/sf0.001"


def words_of(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    return Words(np.frombuffer(data, np.uint8), offsets)


@given(st.lists(st.text(alphabet="aB é9-_\n.", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    found = words_of(texts)
    plain = [brute.words(t) for t in texts]
    assert np.diff(found.bounds).tolist() == [len(w) for w in plain]
    flat = [w for ws in plain for w in ws]
    assert all((found.hashes[i] == found.hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    grams, bounds = found.shingles(3)
    sets = [brute.shingles(t, 3) for t in texts]
    assert [len(set(grams[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [len(s) for s in sets]


# packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_op3_pieces_make_up_the_documents(spark, texts):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_path(), group_bytes=100_000).collect()
    plain = tokenizer()
    ids = {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [x for r in parts for x in np.frombuffer(r["ids"], "<u4")] == ids[d]
        assert [r["start"] for r in parts] == list(range(0, len(ids[d]), packing.WINDOW))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
        assert sum(r["length"] for r in parts) <= packing.WINDOW
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.op3_packing(spark, SF).collect()}
    assert crc == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in rows}


def test_little_padding(spark):
    rows = queries.op3_packing(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(2048 - r["n"] for r in rows) < 0.01 * sum(r["n"] for r in rows)


def test_ids_of_odd_texts():
    ids, plain = packing.Ids(queries.tokenizer_path()), tokenizer()
    assert ids.by_chunk
    odd = ["", " ", "don't I'M we'll.", "A,b. ,,. x.,", "ÉTÉ été ẞ ß İ ı", "a\x1cb\x1fc\x85d\xa0e", "你好 мир Σας", "x<|endoftext|>y", "3.14, 1,000", "ªº. ª,", "e\u0301a"]
    random.seed(1)
    odd += ["".join(random.choice("aB'st.,!9é \n\x85<|>") for _ in range(60)) for _ in range(300)]
    for text, found in zip(odd, ids.of(pa.array(odd)), strict=True):
        assert found.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_ids_outlive_full_generations(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    ids, plain = packing.Ids(queries.tokenizer_path()), tokenizer()
    for i in range(40):
        text = " ".join(f"wort{(i * j) % 17}." for j in range(12))
        assert ids.of(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=150, deadline=None)
def test_best_fit_decreasing_by_looking_at_all_windows(lengths):
    sequence, offset, n = packing.best_fit_decreasing(lengths, 64)
    left = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [x for x in left if x >= lengths[i]]
        if fits:
            left.remove(min(fits))
        else:
            fits = [64]
        left.append(min(fits) - lengths[i])
    used = [64 - sum(x for x, s in zip(lengths, sequence, strict=True) if s == k) for k in range(n)]
    assert sorted(used) == sorted(left) and all(0 <= o <= 64 - x for o, x in zip(offset, lengths, strict=True))


# urls


def test_listed_rules(spark):
    rows = [
        ("https://A.Example.NET/en/1?x=/", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
        ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
        ("ftp://b.org/fr/?a://c.net/", "b.org", "/fr/", "org/fr/", "allow"),
        ("x://y://net/", "y:", "//net/", None, "allow"),
        ("http://internet/", "internet", "/", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("a\nb://net/\n?", "net", "/\n", "net/", "block"),
        ("no scheme/net/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, labels).collect()}
    assert found == {i: r[1:] for i, r in enumerate(rows)}


def test_mined_rules(spark):
    """Pages of one host and section are bad; the mined rule says so of others there, and of no others."""
    random.seed(3)
    rows = []
    for i in range(900):
        host, section = random.choice(["a.com", "b.com", "c.com"]), random.choice(["x", "y", "z"])
        rows.append((i, f"http://{host}/{section}/{i}", host == "b.com" and section == "y"))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "page_id long, blocked boolean")
    found = {r["page_id"]: r for r in urls.judge(pages, labels, rules=()).collect()}
    assert {i for i, r in found.items() if r["verdict"] == "block"} == {r[0] for r in rows if r[2]}
    assert {tuple(r["mined"]) for r in found.values() if r["mined"]} == {("host=b.com", "path=y")}


def test_inverted_index_by_trying_all_rules(spark):
    random.seed(5)
    rules = list({tuple(sorted(random.sample("abcdefgh", random.randint(1, 3)))): random.random() for _ in range(20)}.items())
    pages = [(i, random.sample("abcdefghij", random.randint(0, 5))) for i in range(60)]
    index = spark.createDataFrame([(list(a), c) for a, c in rules], "antecedent array<string>, confidence double")
    found = urls.match(spark.createDataFrame(pages, "page_id long, tokens array<string>"), index, "page_id").collect()
    want = {}
    for i, tokens in pages:
        fits = [(c, list(a)) for a, c in rules if set(a) <= set(tokens)]
        if fits:
            want[i] = max(fits)[::-1]
    assert {r["page_id"]: (r["antecedent"], r["confidence"]) for r in found} == {i: tuple(w) for i, w in want.items()}


def test_op1_judges_every_page(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = {r["page_id"]: r for r in queries.op1_url_filters(spark, SF).collect()}
    assert found.keys() == pages.keys()
    for i, url in pages.items():
        rest = url.split("://", 1)[1]
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = [(len(a + b), a + b, v) for a, b, v in urls.RULES if (brute.lower(host) == a or brute.lower(host).endswith("." + a)) and path.startswith(b)]
        rule = max(fits)[1:] if fits else (None, found[i]["verdict"])
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (brute.lower(host), path, *rule)


def test_no_python_in_native_queries(spark):
    for query in (queries.op1_url_filters, queries.op7_decontamination):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


# classifiers


def area(score, target):
    rank = np.argsort(np.argsort(score)) + 1
    ones = target == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("query, label, least", [(queries.op2_toxicity, "toxic", 0.95), (queries.op6_quality, "quality", 0.99)])
def test_held_out_rows(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    scored = query(spark, sf)
    found = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    folds, fold = (3, 1) if label == "toxic" else (5, 0)
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % folds == fold for i in found["doc_id"]]).all()
    assert found["score"].between(0, 1).all()
    assert ((found["score"] >= (0.7 if label == "toxic" else 0.3)) == (found["predicted"] == 1)).all()
    held = found[found["held_out"]]
    assert area(held["score"].to_numpy(), held[label].to_numpy()) > least
    right = (held["predicted"] == held[label])
    assert right.mean() > 0.95 and right[held[label] == (0 if label == "toxic" else 1)].mean() > 0.99


def test_ftrl_finds_the_words_that_count():
    from tripleloom.llm.toxicity import ftrl

    generator = np.random.default_rng(2)
    rows = [np.unique(generator.integers(10, 500, 30)) for _ in range(600)]
    target = generator.integers(0, 2, 600)
    rows = [np.append(r, 3) if t else r for r, t in zip(rows, target, strict=True)]
    weight, _ = ftrl(rows, target, 512)
    assert weight[3] > 2 and np.abs(weight).argmax() == 3 and (weight != 0).sum() < 100


# decontamination


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op7_against_sql(spark, sf):
    assert oracle.differences(queries.op7_decontamination(spark, sf), queries.SQL["op7_decontamination"], sf) == []


@pytest.mark.parametrize("broadcast_grams", [10**6, 0])
def test_contamination(spark, broadcast_grams):
    """Whole and partial windows, items of one word up to a window, repeats, overlaps, items that share windows."""
    random.seed(11)
    pool = [f"w{i}" for i in range(60)]
    items = {1: " ".join(pool[:25]), 2: " ".join(pool[5:14]), 3: "One", 4: " ".join(pool[30:42]), 5: " ".join(pool[30:45]), 6: "...", 7: "a a a a a a a a a a a a", 8: "b b b"}
    docs = {0: None, 1: "", 2: "one", 3: "a " * 30, 4: "b b b b c b b", 5: " ".join(pool)}
    for d in range(6, 60):
        parts = []
        for _ in range(4):
            at = random.randrange(60)
            parts += pool[at : at + random.randint(1, 16)] + random.choices(["x", "y", "z", "a", "b"], k=random.randint(0, 3))
        docs[d] = ", ".join(parts)
    found = decontaminate.decontaminate(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
        broadcast_grams=broadcast_grams,
    ).collect()
    for r in found:
        hit, which = brute.contamination(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(brute.words(docs[r["doc_id"]])), len(hit), sorted(map(str, which))), r


# fingerprints


def test_op9(spark, texts):
    found = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    order = sorted(texts)
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[d])
        changed = texts[d][: n - n // 2] + texts[following][: n // 2]
        r = found[d]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b = brute.shingles(texts[d]), brute.shingles(changed)
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
        assert r["near_next"] == np.mean([r["fingerprint"][i : i + 4] == found[following]["fingerprint"][i : i + 4] for i in range(0, 512, 4)])
    by_text = {}
    for d in order:
        assert by_text.setdefault(texts[d], found[d]["fingerprint"]) == found[d]["fingerprint"]


def test_estimate_of_the_similarity():
    random.seed(4)
    pool = [f"t{i}" for i in range(5000)]
    errors = []
    for _ in range(25):
        a = random.sample(pool, 400)
        cut = random.randint(0, 400)
        b = a[:cut] + random.sample(pool, 400 - cut)
        x, y = brute.shingles(" ".join(a)), brute.shingles(" ".join(b))
        data = [" ".join(a).encode(), " ".join(b).encode()]
        signs = fingerprints.signatures(np.frombuffer(b"".join(data), np.uint8), np.array([0, len(data[0]), len(data[0]) + len(data[1])]))
        errors.append(fingerprints.likeness(signs[0], signs[1]) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.17


def test_fingerprint_of_one_document(spark):
    r = fingerprints.compare_edited(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c d a b c d").hexdigest()


# warc

PAGE = """<!DOCTYPE html><html lang="en"><head><title>One &amp; two</title><style>p{x:1}</style></head><body><!-- no --><p>A<b>b</b> c&lt;d</p>
<script>var t = "</p>";</script><ul><li><a href="/x?a=1&amp;b=2">first</a></li><li><a href='http://o.org/'>second</a></li></ul>x < y<br>end"""


def test_plain_text():
    assert warc.plain_text(PAGE) == "One & two\nAb c<d\nfirst\nsecond\nx < y\nend"
    assert warc.plain_text("") == "" and warc.plain_text("<script>never closed") == ""


def test_derivatives():
    source = warc.response("http://a.com/b/", PAGE, warc.DATE, "1")
    metadata, conversion = warc.derivatives(source)
    assert metadata["refers_to"] == conversion["refers_to"] == source["record_id"]
    assert "outlink: http://a.com/x?a=1&b=2 L a/@href" in metadata["block"] and "outlink: http://o.org/ L a/@href" in metadata["block"]
    assert "html-title: One & two" in metadata["block"] and source["payload_digest"] in metadata["block"]
    assert "http-header: Content-Type: text/html; charset=utf-8" in metadata["block"]


def test_records_written_and_read_again(spark, tmp_path):
    """All columns come back, and what is derived from records read is what is derived from those made."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = warc.responses(pages)
    derived = warc.derive(sources)
    records = sources.drop("page_id").unionByName(derived)
    path = str(tmp_path / "records")
    warc.write_records(records, path, per_file=30)
    read = warc.read_records(spark, path)
    shared = [c for c in warc.RECORD.names if c not in ("source_headers", "payload_digest", "source_digest")]
    again = sorted(read.withColumn("block", F.col("block").cast("string")).select(shared).collect())
    assert again == sorted(records.select(shared).collect()) and len(again) == 3 * pages.count()
    assert all(r["block_digest"] == warc.digest(bytes(r["block"])) for r in read.collect())
    assert sorted(warc.derive(read).collect()) == sorted(derived.collect())


def test_records_of_other_makers(spark, tmp_path):
    """Members of their own, bytes that are no UTF-8, another character set, fields in another order, digests that are missing."""
    import gzip

    body = "<html lang=pl><title>Żółw</title><p>zażółć".encode("iso-8859-2")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-2\r\n\r\n" + body
    first = b"WARC/1.0\r\nContent-Length: %d\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    raw = bytes(range(256)) * 50
    second = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:X\r\nContent-Length: %d\r\n\r\n" % len(raw) + raw + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(second))
    (tmp_path / "b.warc").write_bytes(second + first)
    rows = warc.read_records(spark, str(tmp_path)).orderBy("record_type").collect()
    assert [r["record_type"] for r in rows] == ["resource"] * 2 + ["response"] * 2
    assert bytes(rows[0]["block"]) == raw and rows[0]["block_digest"] == "sha1:X" and bytes(rows[2]["block"]) == block
    assert rows[2]["payload_digest"] == warc.digest(body) and rows[2]["block_digest"] == warc.digest(block)
    made = {r["record_type"]: r["block"] for r in warc.derive(warc.read_records(spark, str(tmp_path))).collect()}
    assert made["conversion"] == "Żółw\nzażółć" and "html-lang: pl" in made["metadata"] and "html-title: Żółw" in made["metadata"]


def spelled(page):
    """The text of a page by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], None

        def handle_starttag(self, tag, attributes):
            if self.hidden is None and tag in ("script", "style", "template", "noscript"):
                self.hidden = tag
                self.parts.append(" ")
            elif tag in warc._BREAKS and self.hidden is None:
                self.parts.append("\n")

        def handle_endtag(self, tag):
            if tag == self.hidden:
                self.hidden = None
            elif tag in warc._BREAKS and self.hidden is None:
                self.parts.append("\n")

        def handle_comment(self, data):
            self.parts.append(" ")

        def handle_data(self, data):
            if self.hidden is None:
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.parts).split()


def test_text_against_another_parser(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert warc.plain_text(r["html"]).split() == spelled(r["html"])
    random.seed(3)
    pieces = ["word ", "&lt;b&gt; ", '<a title="x>y" href="/q?a=1&amp;b">', "</a>", "<p class='a>b'>", "<br/>", "<!-- <p> -->", "<script>if (a<b) '<p>'</script>", "<i>", "</i>", "<style>p>a{}</style>", "\n"]
    for _ in range(300):
        page = "".join(random.choices(pieces, k=random.randint(0, 20)))
        assert warc.plain_text(page).split() == spelled(page), page


def test_quotes_and_open_ends():
    page = warc.Page('<a title="x>y" href="/z">link</a> <a href=/u?a=1>two</a><a HREF=\'v w\'>')
    assert page.text == "link two" and list(page.links) == ["/z", "/u?a=1", "v w"]
    for text, want in (("a <b", "a <b"), ('a <b c="d>e', 'a e'), ("a <!-- b", "a"), ("x<script>y", "x"), ("1 < 2 > 0", "1 < 2 > 0"), ("<", "<"), ("</", "</"), ("<a", "<a"), ("<title>t", "t")):
        assert warc.plain_text(text) == want, text


@pytest.mark.parametrize("piece", ["<script ", "<a ", '<a "', "<a '", "<!--", "<!", "<title>", "<a href=", "<a b='c' ", "</", "<script>", "& ", "&lt"])
def test_a_page_is_read_in_linear_time(piece):
    import time

    start = time.perf_counter()
    warc.Page(piece * (300_000 // len(piece)))
    assert time.perf_counter() - start < 1.5


def test_op5(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op5_warc(spark, SF).collect()
    assert sorted(r["page_id"] for r in found) == sorted([*pages, *pages])
    for r in found:
        source = warc.response(pages[r["page_id"]]["url"], pages[r["page_id"]]["html"], warc.DATE, str(r["page_id"]))
        assert r["refers_to"] == source["record_id"] and r["source_digest"] == source["payload_digest"]
        assert r["n_bytes"] == len(r["block"].encode()) and f"Content-Length: {r['n_bytes']}\r\n" in r["headers"]
        if r["record_type"] == "conversion":
            assert r["block"] == warc.plain_text(pages[r["page_id"]]["html"])


def test_tokens_that_come_together_are_one_item(spark):
    """Labelled urls that share a path of forty segments: one class instead of all combinations of its segments."""
    deep = "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(i, f"http://h{i}.com/{deep}/{'x' if i % 2 else 'y'}") for i in range(40)] + [(100 + i, f"http://k{i}.org/y/z") for i in range(40)]
    rows += [(200, f"http://other.net/{deep}"), (201, "http://other.net/partaa"), (202, "http://other.net/y")]
    labels = [(i, i < 40) for i in range(40)] + [(100 + i, False) for i in range(40)]
    df, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, blocked boolean")
    found = {r["page_id"]: r for r in urls.judge(df, known, rules=(), min_support=0.1, min_rows=2).collect()}
    # any of the segments says what all of them say
    assert {i for i, r in found.items() if r["verdict"] == "block"} == {*range(40), 200, 201}
    assert all(len(found[i]["mined"]) == 1 for i in (0, 200, 201))


def test_one_text_of_each_id_is_learnt_from(spark):
    """An id with a third of all rows counts once."""
    rows = [(i, ("bad words here " if i % 2 else "kind words there ") * 3) for i in range(60)] + [(1, f"kind words there {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labels)
    found = {r["text"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert found[rows[3][1]] > 0.7 > 0.3 > found[rows[2][1]]


# common helpers


def test_sorted_groups():
    from tripleloom.llm.common import sorted_groups

    keys = [1, 1, 2, 2, 2, 3, 5, 5]
    whole = pa.RecordBatch.from_pydict({"k": keys, "v": list(range(8))})
    for cut in range(9):
        parts = [whole.slice(0, cut), whole.slice(cut)]
        assert [t["v"].to_pylist() for t in sorted_groups(iter(parts), "k")] == [[0, 1], [2, 3, 4], [5], [6, 7]]
