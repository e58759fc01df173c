"""Encodings of terms, against their definition in Python."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.operators import terms

UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def is_ucschar(c):
    n = ord(c)
    if 0xA0 <= n <= 0xD7FF or 0xF900 <= n <= 0xFDCF or 0xFDF0 <= n <= 0xFFEF:
        return True
    return n >= 0x10000 and (n & 0xFFFF) <= 0xFFFD and n < 0xF0000 and not 0xE0000 <= n < 0xE1000


def safe(text):
    out = []
    for c in unicodedata.normalize("NFKC", text):
        out.append(c if c in UNRESERVED or is_ucschar(c) else "".join(f"%{b:02x}" for b in c.encode()))
    return "".join(out)


def run(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


ODD = ["", "abc", "a b/c", "sensors/sensor1", "ﬁx é", "xy", "a\nb\tc\rd", "100%", "😀 z", "\x80", "a／b", "\x00\x1f\x7f", "%20", "Ⅳ ½", "￾"]
ODD.append("".join(chr(c) for c in range(0x20, 0x7F)))


def test_iri_safe(spark):
    assert run(spark, terms.iri_safe, ODD) == [safe(v) for v in ODD]
    assert run(spark, terms.iri_safe, [None]) == [None]


def test_iri_safe_inside_arrays(spark):
    got = run(spark, lambda c: F.transform(F.array(c, F.lit("a b")), terms.iri_safe), ODD)
    assert got == [[safe(v), "a%20b"] for v in ODD]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Cn"]), max_size=12), min_size=20, max_size=40))
def test_iri_safe_on_random_text(spark, values):
    assert run(spark, terms.iri_safe, values) == [safe(v) for v in values]


def test_literal_escapes_round_trip(spark):
    values = [*ODD, 'q"q', "b\\n", "\\\\n", "\\", "tab\\t", "\\u0041", "a\x01b\\c"]
    assert run(spark, lambda c: terms.unescape_literal(terms.escape_literal(c)), values) == values
    written = ["\\u00e9\\t\\U0001F600\\\\u0041\\'", "\\b\\f\\r\\n"]
    assert run(spark, terms.unescape_literal, written) == ["é\t😀\\u0041'", "\b\f\r\n"]


def test_json_quote_is_json(spark):
    import json

    values = [v for v in [*ODD, 'q"q', "b\\n", "\x01", None]]
    assert [v if v is None else json.loads(v) for v in run(spark, terms.json_quote, values)] == values


def test_constants_follow_the_same_rules(spark):
    for text in ("http://a/b c", "x:<y>", "x:é"):
        assert [terms.iri_constant(text)] == run(spark, terms.iri_reference, [text])
    for text in ('a"b', "a\\b\nc\r"):
        assert [terms.escape_constant(text)] == run(spark, terms.escape_literal, [text])
