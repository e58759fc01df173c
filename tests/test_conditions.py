"""Join conditions given as function calls: split into keys and tests, in every way that a join goes."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tripleloom import MappingError
from tripleloom.functions import registry
from tripleloom.model import Mapping, TriplesMap, call, iri, literal, of_parent, parent, po, reference, template
from tripleloom.operators.conditions import condition
from tripleloom.operators.joins import documents_with_joins, joined_triples
from tripleloom.operators.mapping import documents, triples
from tripleloom.plans import mapping_queries as q
from tripleloom.sources import ntriples, rules

EX = "http://example.com/"


def equal(a, b):
    return call(registry.EQUAL, **{registry.PARAM_VALUE: a, registry.PARAM_VALUE2: b})


def only_if(a, b):
    return call(registry.TRUE_CONDITION, **{registry.PARAM_BOOLEAN: a, registry.PARAM_STRING: b})


def linked(*conditions, child="$.lines[*]", other="$.parts[*]", fmt="TTL"):
    return Mapping(
        "j",
        (
            TriplesMap("line", template(EX + "line/{n}"), (po(EX + "part", parent("part", *conditions)),), iterator=child),
            TriplesMap("part", template(EX + "part/{k}/{c}"), iterator=other),
        ),
        output_format=fmt,
    )


MESSAGE = '{"lines":[{"n":1,"k":"a","c":"x","w":"aa"},{"n":2,"k":"a","c":"y"},{"n":3,"k":"b","c":"y","w":"bbbb"},{"n":4}],"parts":[{"k":"a","c":"x"},{"k":"a","c":"yyy"},{"k":"b","c":"y"},{"c":"q"}]}'
SHORTER = call(q.SHORTER, a=of_parent(reference("c")), b=reference("w"))

CASES = {
    "one function": ((equal(reference("k"), of_parent(reference("k"))),), {(1, "a/x"), (1, "a/yyy"), (2, "a/x"), (2, "a/yyy"), (3, "b/y")}),
    "turned round": ((equal(of_parent(reference("k")), reference("k")),), {(1, "a/x"), (1, "a/yyy"), (2, "a/x"), (2, "a/yyy"), (3, "b/y")}),
    "with a pair": ((("c", "c"), equal(reference("k"), of_parent(reference("k")))), {(1, "a/x"), (3, "b/y")}),
    "nested": ((equal(only_if(equal(reference("c"), literal("y")), reference("k")), of_parent(reference("k"))),), {(2, "a/x"), (2, "a/yyy"), (3, "b/y")}),
    "templates": ((equal(template("{k}-{c}", "literal"), of_parent(template("{k}-{c}", "literal"))),), {(1, "a/x"), (3, "b/y")}),
    "key and test": ((("k", "k"), SHORTER), {(1, "a/x"), (3, "b/y")}),
    "constant of the parent": ((("k", "k"), equal(reference("c"), of_parent(literal("y")))), {(2, "a/x"), (2, "a/yyy"), (3, "b/y")}),
    "constant for the parent": ((("k", "k"), equal(literal("x"), of_parent(reference("c")))), {(1, "a/x"), (2, "a/x")}),
    "a test of both": ((("k", "k"), equal(only_if(equal(reference("c"), of_parent(reference("c"))), reference("n")), literal("1"))), {(1, "a/x")}),
    "a test of the child alone": ((("k", "k"), call(q.SHORTER, a=reference("c"), b=reference("w"))), {(1, "a/x"), (1, "a/yyy"), (3, "b/y")}),
}


def pairs(df):
    return {(int(r.s.rpartition("/")[2]), r.o.removeprefix(EX + "part/")) for r in df.where(F.col("p") == EX + "part").collect()}


@pytest.mark.parametrize("name", CASES)
def test_conditions_inside_a_message(messages, name):
    conditions, want = CASES[name]
    df = messages(MESSAGE, "{", '{"lines":[]}')
    assert pairs(triples(df, linked(*conditions))) == want
    lines = documents(df, linked(*conditions)).orderBy("msg_id").first().doc.strip().split("\n")
    assert sorted(lines) == sorted(f"<{EX}line/{n}> <{EX}part> <{EX}part/{o}> ." for n, o in want)
    # the same links as nodes
    assert documents(df, linked(*conditions, fmt="JSONLD")).orderBy("msg_id").first().doc.count('{"@id":') == 2 * len(want)


@pytest.mark.parametrize("name", CASES)
def test_conditions_with_a_reference_table(messages, name):
    conditions, want = CASES[name]
    mapping = linked(*conditions, other="$")
    parents = messages('{"k":"a","c":"x"}', '{"k":"a","c":"yyy"}', '{"k":"b","c":"y"}', '{"c":"q"}', '{"k":"a","c":"x"}')
    met = joined_triples(messages(MESSAGE), mapping, parents)
    assert pairs(met) == want and met.count() == len(want)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    doc = documents_with_joins(messages(MESSAGE), mapping, "payload", "msg_id", True, parents).first().doc
    assert len(doc.strip().split("\n")) == len(want)


@pytest.mark.parametrize("name", CASES)
def test_conditions_in_the_row(messages, name):
    """One child: looked up in the row, without a shuffle."""
    conditions, want = CASES[name]
    mapping = linked(*conditions, child="$")
    for n, line in enumerate(['"n":1,"k":"a","c":"x","w":"aa"', '"n":2,"k":"a","c":"y"', '"n":3,"k":"b","c":"y","w":"bbbb"'], 1):
        df = messages("{" + line + ',"parts":[{"k":"a","c":"x"},{"k":"a","c":"yyy"},{"k":"b","c":"y"}]}')
        rows = triples(df, mapping)
        assert pairs(rows) == {w for w in want if w[0] == n}
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_the_same_item(messages):
    """Child and parent are the message; the parent's side is a constant, so the condition says when there is a link at all."""
    mapping = linked(equal(reference("location.type"), of_parent(literal("approximate"))), child="$", other="$")
    df = messages('{"n":1,"k":"a","c":"x","location":{"type":"approximate"}}', '{"n":2,"k":"a","c":"x","location":{"type":"2D"}}', '{"n":3,"k":"a","c":"x"}')
    assert pairs(triples(df, mapping)) == {(1, "a/x")}


def test_a_condition_without_an_equal_key_is_refused(messages):
    for conditions in ((SHORTER,), (equal(reference("k"), literal("x")),)):
        if conditions[0] is SHORTER:
            with pytest.raises(MappingError):
                triples(messages(MESSAGE), linked(*conditions))
        with pytest.raises(MappingError):
            joined_triples(messages(MESSAGE), linked(*conditions, other="$"), messages('{"k":"a"}'))
    with pytest.raises(MappingError):
        condition(parent("part", reference("k")))
    with pytest.raises(MappingError):
        triples(messages(MESSAGE), linked(("k", "k"), call("no such function", a=reference("k"))))


def lines_of(spark, lines):
    return ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "value")


@pytest.mark.parametrize("name", CASES)
def test_conditions_survive_a_rule_document(spark, messages, name):
    conditions, want = CASES[name]
    mapping = linked(*conditions)
    loaded = rules.load_mapping(lines_of(spark, rules.to_ntriples(mapping)), "j")
    assert pairs(triples(messages(MESSAGE), loaded)) == want
    table = rules.to_rule_table(spark, mapping)
    assert rules.from_rule_table(table, "j") == mapping


def test_either_name_of_a_condition(spark, messages):
    """rr:joinCondition and rml:joinCondition, each with references and with a function."""
    written = "\n".join(rules.to_ntriples(linked(("c", "c"), equal(reference("k"), of_parent(reference("k"))))))
    a, b = "<http://www.w3.org/ns/r2rml#joinCondition>", "<http://semweb.mmlab.be/ns/rml#joinCondition>"
    assert a in written and b in written
    for text in (written.replace(a, b), written.replace(b, a), written.replace(a, "<x>").replace(b, a).replace("<x>", b)):
        loaded = rules.load_mapping(lines_of(spark, text.split("\n")), "j")
        assert pairs(triples(messages(MESSAGE), loaded)) == CASES["with a pair"][1]


@pytest.mark.parametrize("lost", ["r2rml#child>", "r2rml#parent>", "fnml#functionValue>", "function/ontology#executes>", "valueParameter2>"])
def test_lost_parts_of_a_condition_are_refused(spark, messages, lost):
    """A condition of which something is missing never becomes a link without a condition."""
    lines = rules.to_ntriples(linked(("c", "c"), equal(reference("k"), of_parent(reference("k")))))
    kept = [x for x in lines if lost not in x]
    assert len(kept) < len(lines)
    with pytest.raises(MappingError):
        triples(messages(MESSAGE), rules.load_mapping(lines_of(spark, kept), "j"))


def test_a_condition_that_says_nothing_is_refused(spark):
    lines = [x for x in rules.to_ntriples(linked(("c", "c"))) if "r2rml#child>" not in x and "r2rml#parent>" not in x]
    with pytest.raises(MappingError):
        rules.load_mapping(lines_of(spark, lines), "j")
    assert replace(iri("x:y"), side="parent") == of_parent(iri("x:y"))
