"""Validators: what they accept, what they refuse, and that nothing they meet raises."""

import xml.parsers.expat as expat

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.operators import validate
from tripleloom.session import prepare

JSON_GOOD = [
    '{ "key": "value" }', "{}", "[]", "5", '"s"', "null", "true", "[1]", " \n{} \t", '{"a":1,"a":2}', "1e400", '{"a":{"b":[1,{"c":null}]}}',
    '"a,b]"', '{"a":"]"}',
]
JSON_BAD = [
    '{ "key": "value"', "", "  ", '{"a":1} xx', '{"a":1,}', "NaN", "{'a':1}", "1] [2", '1} {"d":1', "01", "1 2", "1,2", "]", "[",
    '"a\nb"', '{"a":1}/*c*/', "{a:1}", "+1", ".5", "1.", "[1,]", '{"a":1}{"b":2}', "<key>value</key>", "tru", None,
]
XML_GOOD = [
    "<key>value</key>", "<a/>", '<?xml version="1.0" encoding="UTF-8" ?><a/>', "<!-- c --><a/><!-- </a> -->", "<a>&lt;&#65;</a>",
    "<a><![CDATA[x<y]]></a>", "<a><![CDATA[</a>]]></a>", "<?pi x?><a/>", "<a ></a >", "<é>é</é>", '<a b="/a>">x</a>', "<a><a/></a>",
    '<a b="x>y"/>', "<a b='/'/>", '<a b="/">/</a>', '<a p:x="1"/>', '<?xml version="1.0"?>\n<a>\n</a>\n',
]
XML_BAD = [
    "<key>value</key", "", "  ", "<a>", "<a></b>", "<a/><b/>", "<a></a><a></a>", "<a/>junk", "junk<a/>", "<a/>&amp;", "<a>&nbsp;</a>",
    "<a>&#0;</a>", '<a x="1" x="2"/>', "<a x=1/>", '<a x="<"/>', "<!-- a -- b --><a/>", "<a>]]></a>", "<a><b></a></b>", "</w><w>",
    "<1a/>", '<a b="</a>">x</a>', "<a>\x01</a>", "<a>x & y</a>", '{"k":1}', "<![CDATA[x]]><a/>", "<a>￾</a>", ' <?xml version="1.0"?><a/>',
    "<!DOCTYPE a><a/>", "<a><?xml x?></a>", None,
]


def check(spark, function, payloads):
    prepare(spark)
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    return {payloads[r.i]: r.v for r in df.select("i", function(F.col("p")).alias("v")).collect()}


@pytest.mark.parametrize(
    "function, good, bad",
    [
        (validate.is_json, JSON_GOOD, JSON_BAD),
        (validate.is_xml, XML_GOOD, XML_BAD),
        (validate.is_csv, ["1,2,3", " "], ["", None]),
        (validate.is_non_empty, ["x"], ["", None]),
        (validate.accept_all, ["", "x"], []),
    ],
)
def test_accepts_and_refuses(spark, function, good, bad):
    found = check(spark, function, [*good, *bad])
    assert {p for p in good if not found[p]} == set()
    assert {p for p in bad if found[p]} == set()


def test_validator_by_format_column(spark):
    prepare(spark)
    rows = [("JSON", "{}", True), ("XML", "{}", False), ("XML", "<a/>", True), ("CSV", "{}", True), ("CSV", "", False), ("N3", "x", False)]
    df = spark.createDataFrame(rows, "f string, p string, want boolean")
    got = df.select("want", validate.is_valid(F.col("p"), F.col("f")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def well_formed(payload):
    """The rule stated once more, with an independent parser; document types are refused."""
    found = []
    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = lambda *a: found.append(a)
    try:
        parser.Parse(payload.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError):
        return False
    return not found


def test_xml_on_pages_against_another_parser(spark):
    """Whole pages, and the same pages without their document type and with their tags cut up."""
    prepare(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.col("html").alias("p"))
    bare = pages.select(F.regexp_replace("p", "^<!DOCTYPE html>", "").alias("p"))
    pieces = bare.select(F.explode(F.regexp_extract_all("p", F.lit("(<([a-z]+)>[^<]*</[a-z]+>)"), F.lit(1))).alias("p")).distinct()
    rows = pages.union(bare).union(pieces).select("p", validate.is_xml(F.col("p")).alias("v")).collect()
    assert len({r.v for r in rows}) == 2
    assert [r.p[:80] for r in rows if r.v != well_formed(r.p)] == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from('<>/ab ="&;!-[]?x\n'), max_size=14), min_size=30, max_size=60, unique=True))
def test_xml_on_random_text(spark, texts):
    """Short random markup: the verdicts agree and nothing raises."""
    prepare(spark)
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    for r in df.select("p", validate.is_xml(F.col("p")).alias("v")).collect():
        assert r.v == well_formed(r.p), r.p


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from('{}[],:"1ae.- nul\n'), max_size=10), min_size=40, max_size=60, unique=True))
def test_json_on_random_text(spark, texts):
    import json

    def strict(text):
        def refuse(name):
            raise ValueError(name)

        try:
            json.loads(text, parse_constant=refuse)
        except (ValueError, RecursionError):
            return False
        return True

    prepare(spark)
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    for r in df.select("p", validate.is_json(F.col("p")).alias("v")).collect():
        assert r.v == strict(r.p), r.p


def test_json_texts_have_no_length_limit(spark):
    """Validator and mapping agree on a text value of 25 million characters."""
    from tripleloom import Mapping, TriplesMap, iri, po, reference
    from tripleloom.operators.mapping import triples

    long = spark.range(1).select(F.concat(F.lit('{"v":"'), F.repeat(F.lit("x"), 25_000_000), F.lit('"}')).alias("payload"))
    both = long.select(F.lit(1).alias("msg_id"), "payload").unionByName(long.select(F.lit(2).alias("msg_id"), F.expr("left(payload, length(payload) - 1)").alias("payload")))
    assert {r.msg_id: r.ok for r in both.select("msg_id", validate.is_json(F.col("payload")).alias("ok")).collect()} == {1: True, 2: False}
    m = Mapping("m", (TriplesMap("t", iri("http://example.com/s"), (po("http://example.com/p", reference("v")),)),))
    assert [(r.msg_id, r.n) for r in triples(both, m).select("msg_id", F.length("o").alias("n")).collect()] == [(1, 25_000_000)]
