"""Rule documents and N-Triples."""

import pytest
from pyspark.sql import functions as F

from tripleloom import Mapping, MappingError, TriplesMap, po, reference, template
from tripleloom.operators.mapping import triples
from tripleloom.plans import mapping_queries as q
from tripleloom.sources import ntriples, rules

ALL = [q.FLAT, q.CLASSES, q.DATATYPES, q.ORDERS, q.BLANKS, q.PARTS, q.SUPPLIERS, q.CONDITIONAL, q.JOIN_IN_MESSAGE, q.TAGS]


def lines_of(spark, lines):
    return ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "value")


def meaning(mapping):
    """Rules without the names a document gives its nodes, and without any order."""

    def term(t):
        if t.kind == "function":
            return ("call", t.value, t.node_kind, t.datatype, frozenset((n, term(a)) for n, a in t.args))
        value = t.value.removeprefix("urn:map:") if t.kind == "parent" else t.value
        return (t.kind, value, t.node_kind, t.datatype, t.lang, frozenset(t.joins))

    return mapping.input_format, {
        (
            tm.id.removeprefix("urn:map:"),
            tm.iterator,
            term(tm.subject),
            frozenset(tm.classes),
            frozenset((term(p), term(o)) for pom in tm.predicate_objects for p in pom.predicates for o in pom.objects),
        )
        for tm in mapping.triples_maps
    }


@pytest.mark.parametrize("mapping", ALL, ids=lambda m: m.id)
def test_rules_survive_ntriples(spark, mapping):
    loaded = rules.load_mapping(lines_of(spark, rules.to_ntriples(mapping)), mapping.id)
    assert meaning(loaded) == meaning(mapping)


def test_rules_survive_the_rule_table(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules.to_rule_table(spark, *ALL).write.parquet(path)
    table = spark.read.parquet(path)
    for mapping in ALL[:3]:
        assert meaning(rules.from_rule_table(table, mapping.id)) == meaning(mapping)
    with pytest.raises(MappingError):
        rules.from_rule_table(table, "nobody")


HAND_WRITTEN = """# high and low water, as a person would write it down
<urn:m> <http://www.w3.org/ns/r2rml#subjectMap> _:who .
_:who <http://www.w3.org/ns/r2rml#class> <http://example.com/Water> .
_:who <http://www.w3.org/ns/r2rml#template> "http://example.com/water/{port}/{no}" .
<urn:m> <http://semweb.mmlab.be/ns/rml#logicalSource> _:from .
_:from <http://semweb.mmlab.be/ns/rml#referenceFormulation> <http://semweb.mmlab.be/ns/ql#JSONPath> .
_:from <http://semweb.mmlab.be/ns/rml#iterator> "$.table.tides[*]" .
_:from <http://semweb.mmlab.be/ns/rml#source> _:flow .
_:flow <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://carml.taxonic.com/carml/Stream> .

<urn:m> <http://www.w3.org/ns/r2rml#predicateObjectMap> _:high .
_:high <http://www.w3.org/ns/r2rml#predicate> <http://example.com/height> .
_:high <http://www.w3.org/ns/r2rml#objectMap> _:cm .
_:cm <http://semweb.mmlab.be/ns/rml#reference> "cm" .
<urn:m> <http://www.w3.org/ns/r2rml#predicateObjectMap> _:kind .
_:kind <http://www.w3.org/ns/r2rml#predicate> <http://example.com/kind> .
_:kind <http://www.w3.org/ns/r2rml#objectMap> _:word .
_:word <http://www.w3.org/ns/r2rml#constant> "tide" .
"""


def test_hand_written_rules_run(spark, messages, tmp_path):
    path = tmp_path / "rules.nt"
    path.write_text(HAND_WRITTEN)
    mapping = rules.read_mapping(spark, str(path), "water")
    df = messages('{"table":{"tides":[{"port":"Hel","no":1,"cm":"51.50"},{"port":"Ustka","no":2,"cm":"-7e1"},{"port":"Hel","no":3}]}}')
    water = "http://example.com/water/"
    got = triples(df, mapping).collect()
    assert {(r.s, r.o) for r in got if r.p.endswith("height")} == {(water + "Hel/1", "51.50"), (water + "Ustka/2", "-7e1")}
    assert {r.s for r in got if r.p.endswith("kind")} == {water + "Hel/1", water + "Ustka/2", water + "Hel/3"}


@pytest.mark.parametrize(
    "change",
    [
        ("_:from <http://semweb.mmlab.be/ns/rml#source> _:flow .", '_:from <http://semweb.mmlab.be/ns/rml#source> "tides-2031.txt" .'),
        ("<http://semweb.mmlab.be/ns/ql#JSONPath>", "<http://example.com/other>"),
        ('_:cm <http://semweb.mmlab.be/ns/rml#reference> "cm" .', ""),
        ("_:who <http://www.w3.org/ns/r2rml#template>", "_:who <http://example.com/nothing>"),
    ],
    ids=["file source", "formulation", "empty object", "empty subject"],
)
def test_broken_rules_are_refused(spark, change):
    with pytest.raises(MappingError):
        rules.load_mapping(lines_of(spark, HAND_WRITTEN.replace(*change).split("\n")), "m")


def test_ntriples_round_trip(spark, tmp_path):
    rows = [
        ("http://a/s", "http://a/p", "http://a/o", "iri", None, None),
        ("_:b1", "http://a/p", "_:b2", "bnode", None, None),
        ("http://a/s", "http://a/p", 'x "y" \\ \n\r z', "literal", "http://www.w3.org/2001/XMLSchema#string", None),
        ("http://a/s", "http://a/p", "5", "literal", "http://a/int", None),
        ("http://a/s", "http://a/p", "é", "literal", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "pl"),
        ("http://a/s", "http://a/p", "", "literal", "http://www.w3.org/2001/XMLSchema#string", None),
    ]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    path = str(tmp_path / "out")
    ntriples.to_lines(df).write.text(path)
    assert sorted(map(str, ntriples.read_ntriples(spark, path).collect())) == sorted(map(str, df.collect()))


def test_broken_lines_give_nothing(spark):
    bad = ["", "# note", "<a> <b> .", "<a> <b> <c>", '<a> <b> "c .', '"a" <b> <c> .', "<a> _:b <c> .", "\x02<a>\x01b\x01c"]
    assert lines_of(spark, bad).count() == 0
    assert lines_of(spark, ["  <a>\t<b> <c>.  # note", "_:a <b> _:c ."]).count() == 2
    assert lines_of(spark, ['<a> <b> "x"@en-GB .']).select(F.col("o_lang")).first()[0] == "en-GB"


def test_a_value_is_written_only_in_the_ways_that_the_rules_ask_for(spark):
    """A text that is only a literal isn't encoded for an IRI as well, and programs that don't say their ways write the same."""
    import json

    from tripleloom.operators import rulesets
    from tripleloom.operators.mapping import WAYS
    from tripleloom.streaming import channel

    bits = {name: 1 << n for n, name in enumerate(WAYS)}
    said = (po("http://e/text", reference("t")), po("http://e/at", reference("u", term_type="iri")))
    mapping = Mapping("m", (TriplesMap("x", template("http://e/{k}"), said),))
    (program,) = rulesets.as_data(mapping)
    assert [p["ways"] for p in program["paths"]] == [bits["slot-iri"], bits["literal"], bits["iri"]]
    rows = spark.createDataFrame([(1, "m", '{"k":"a b","t":"x \\"y\\" z","u":"http://e/q r"}')], "msg_id long, mapping_id string, payload string")
    (row,) = rulesets.rule_rows({"m": mapping})
    for p in program["paths"]:
        del p["ways"]
    older = spark.createDataFrame([(*row[:-1], json.dumps([program]))], rulesets.RULE_SCHEMA)
    docs = [channel.transform(rows, known).first().doc for known in ({"m": mapping}, older)]
    assert docs[0] == '<http://e/a%20b> <http://e/text> "x \\"y\\" z" .\n<http://e/a%20b> <http://e/at> <http://e/q%20r> .\n'
    assert docs[0] == docs[1]


def test_a_catalog_is_compiled_in_as_many_tasks_as_there_are_parts(spark):
    triples = spark.createDataFrame([("m", "urn:x", "urn:p", "o", "iri")], "mapping_id string, s string, p string, o string, o_kind string")
    plan = rules.load_catalog(triples)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
