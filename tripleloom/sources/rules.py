"""Mapping rules kept as data: as RDF triples (N-Triples) and as rule tables.

Reading joins the triples of a rule document on their subjects. The result is a handful of rows per
mapping, which the driver turns into a Mapping; message data never takes this way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, replace
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.model import Mapping, MappingError, PredicateObject, TermMap, TriplesMap, of_parent
from tripleloom.operators import rulesets
from tripleloom.sources import ntriples
from tripleloom.vocab import EXECUTES, FNML, QL, RDF_TYPE, RML, RR, STREAM

# --- fixed values: vocabulary of rule documents -------------------------------------------------
TERM_TYPES = {RR + "IRI": "iri", RR + "BlankNode": "bnode", RR + "Literal": "literal"}
FORMULATIONS = {QL + "JSONPath": "JSON", QL + "XPath": "XML", QL + "CSV": "CSV"}
JOIN_CONDITIONS = (RR + "joinCondition", RML + "joinCondition")
# ------------------------------------------------------------------------------------------------

#: The column that tells rule documents apart. Nodes of two documents are never one, whatever their names.
DOC = "mapping_id"


def _objects(triples: DataFrame, predicate: str, name: str, of: str = "s") -> DataFrame:
    return triples.where(F.col("p") == predicate).select(DOC, F.col("s").alias(of), F.col("o").alias(name))


def _said(triples: DataFrame, said: dict[str, str], node: str, *more: Column) -> DataFrame:
    """One row per node: the object of each of these predicates."""
    rows = triples.where(F.col("p").isin(*said)).groupBy(DOC, F.col("s").alias(node))
    return rows.agg(*[F.max(F.when(F.col("p") == p, F.col("o"))).alias(name) for p, name in said.items()], *more)


def term_table(triples: DataFrame) -> DataFrame:
    """One row per term map node: everything said about it."""
    said = {
        RR + "constant": "constant",
        RML + "reference": "reference",
        RR + "template": "template",
        RR + "parentTriplesMap": "parent",
        RR + "termType": "term_type",
        RR + "datatype": "datatype",
        RR + "language": "lang",
        FNML + "functionValue": "function",
        RML + "parentTermMap": "of_parent",
    }
    return _said(triples, said, "node", F.max(F.when(F.col("p") == RR + "constant", F.col("o_kind"))).alias("constant_kind"))


def triples_map_table(triples: DataFrame) -> DataFrame:
    """One row per triples map: id, iterator, format, whether it reads the stream, subject node."""
    asked = (RR + "subjectMap", RR + "subject", RR + "predicateObjectMap")
    ids = triples.where(F.col("p").isin(*asked)).select(DOC, "s").distinct()
    maps = _said(triples, {RML + "logicalSource": "source_node", RR + "subjectMap": "subject_node", RR + "subject": "subject_constant"}, "s")
    sources = _said(triples, {RML + "iterator": "iterator", RML + "referenceFormulation": "formulation", RML + "source": "binding"}, "source_node")
    streams = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == STREAM)).select(
        DOC, F.col("s").alias("binding"), F.lit(True).alias("is_stream")
    ).distinct()
    rows = ids.join(maps, [DOC, "s"], "left").join(sources, [DOC, "source_node"], "left").join(streams, [DOC, "binding"], "left")
    return rows.select(
        DOC, F.col("s").alias("id"), "iterator", "formulation", "binding", F.coalesce("is_stream", F.lit(False)).alias("is_stream"),
        "subject_node", "subject_constant",
    )


def predicate_object_table(triples: DataFrame) -> DataFrame:
    """One row per (triples map, predicate-object map, role, term): nodes and constant shortcuts."""
    of = _objects(triples, RR + "predicateObjectMap", "pom", "map_id")
    roles = [RR + name for name in ("predicateMap", "predicate", "objectMap", "object")]
    said = triples.where(F.col("p").isin(*roles))
    role = F.when(F.col("p").isin(RR + "predicateMap", RR + "predicate"), "predicate").otherwise("object")
    rows = said.select(
        DOC,
        F.col("s").alias("pom"),
        role.alias("role"),
        F.col("p").isin(RR + "predicate", RR + "object").alias("is_constant"),
        F.col("o").alias("term"),
        F.col("o_kind").alias("term_kind"),
    )
    return of.join(rows, [DOC, "pom"])


def join_table(triples: DataFrame) -> DataFrame:
    """One row per condition of a parent: the child's and the parent's reference, or the function called. What isn't said is null."""
    conditions = triples.where(F.col("p").isin(*JOIN_CONDITIONS)).select(DOC, F.col("s").alias("node"), F.col("o").alias("condition"))
    said = {RR + "child": "child", RR + "parent": "parent_path", FNML + "functionValue": "call"}
    return conditions.join(_said(triples, said, "condition"), [DOC, "condition"], "left").select(DOC, "node", "condition", *said.values())


Found = dict[str, list[SimpleNamespace]]


def _gathered(triples: DataFrame) -> DataFrame:
    """One row per rule document, with all rows of its tables: (table, row as JSON)."""
    tables = {
        "terms": term_table(triples),
        "joins": join_table(triples),
        "poms": predicate_object_table(triples),
        "classes": triples.where(F.col("p") == RR + "class").select(DOC, "s", "o"),
        "maps": triples_map_table(triples),
    }
    tagged = None
    for name, table in tables.items():
        row = F.to_json(F.struct(*[c for c in table.columns if c != DOC]), {"ignoreNullFields": "false"})
        part = table.select(DOC, F.struct(F.lit(name).alias("name"), row.alias("row")).alias("said"))
        tagged = part if tagged is None else tagged.unionByName(part)
    # A document is one mapping, so what meets here is bounded by the mapping that it becomes. The number of parts is given: by their
    # bytes they would be joined to a few tasks, and a mapping takes far longer to compile than to read.
    parts = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tagged.repartition(parts, DOC).groupBy(DOC).agg(F.collect_list("said").alias("rows"))


def _found(rows: list) -> Found:
    out: Found = {name: [] for name in ("terms", "joins", "poms", "classes", "maps")}
    for name, row in rows:
        out[name].append(SimpleNamespace(**json.loads(row)))
    return out


def load_mapping(triples: DataFrame, mapping_id: str, output_format: str = "TTL", rml: str | None = None) -> Mapping:
    """Build the mapping a rule document describes.

    The document's tables are put together by Spark; one mapping comes to the driver, as it is a driver's object. For many
    see load_catalog().
    """
    rows = _gathered(triples.withColumn(DOC, F.lit(mapping_id))).select("rows").collect()
    return assembled(_found(rows[0][0] if rows else []), mapping_id, output_format, rml)


def load_catalog(triples: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """A table of rules out of any number of rule documents: triples with a mapping_id.

    A row for each document: what a message looks up by mapping id (see operators.rulesets) and `rules`, its triples maps as JSON, which
    mappings_of() reads back. A document that is no mapping, or one that has to be compiled, is a row that says so. `formats`
    may give an output_format by mapping_id, else Turtle. Rules never pass the driver.
    """
    schema = f"{rulesets.RULE_SCHEMA}, rules string"
    gathered = _gathered(triples)
    if formats is not None:
        gathered = gathered.join(formats.select(DOC, "output_format"), DOC, "left")
    else:
        gathered = gathered.withColumn("output_format", F.lit(None).cast("string"))

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                try:
                    mapping = assembled(_found([(x["name"], x["row"]) for x in r["rows"]]), r[DOC], r["output_format"] or "TTL")
                    made.append((*rulesets.rule_row(r[DOC], mapping), json.dumps([asdict(tm) for tm in mapping.triples_maps])))
                except MappingError as e:
                    made.append((r[DOC], "JSON", r["output_format"] or "TTL", f"MappingError: {e}", False, None, None))
            columns = list(zip(*made, strict=True)) or [()] * len(names)
            kinds = [pa.bool_() if n == "is_data" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return gathered.mapInArrow(compiled, schema)


def mappings_of(catalog: DataFrame, *mapping_ids: str) -> dict[str, Mapping]:
    """The named mappings of a catalog as the driver's objects, for those that have to be compiled."""
    wanted = catalog.where(F.col(DOC).isin(*mapping_ids) & F.col("rules").isNotNull()).select(DOC, "input_format", "output_format", "rules")
    return {r[0]: Mapping(r[0], tuple(_triples_map_from(d) for d in json.loads(r[3])), r[1], r[2]) for r in wanted.collect()}


def assembled(found: Found, mapping_id: str, output_format: str = "TTL", rml: str | None = None) -> Mapping:
    """The mapping that the rows of a document's tables describe."""
    terms = {r.node: r for r in found["terms"]}
    joins: dict[str, list[SimpleNamespace]] = {}
    for r in sorted(found["joins"], key=lambda r: (r.node, r.child or "", r.condition)):
        joins.setdefault(r.node, []).append(r)
    poms: dict[str, dict[str, list]] = {}
    for r in sorted(found["poms"], key=lambda r: (r.map_id, r.pom, r.role, r.term)):
        poms.setdefault(r.map_id, {}).setdefault(r.pom, []).append(r)
    classes: dict[str, list[str]] = {}
    for r in sorted(found["classes"], key=lambda r: r.o):
        classes.setdefault(r.s, []).append(r.o)
    maps = sorted(found["maps"], key=lambda r: r.id)

    def function_call(node: str, term_type: str | None, datatype: str | None) -> TermMap:
        name, args = None, []
        for rows in poms.get(node, {}).values():
            predicate = next((term(r) for r in rows if r.role == "predicate"), None)
            value = next((term(r) for r in rows if r.role == "object"), None)
            if predicate is None or value is None:
                raise MappingError(f"function {node!r} has an incomplete parameter")
            if predicate.value == EXECUTES:
                name = value.value
            else:
                args.append((predicate.value, value))
        if name is None:
            raise MappingError(f"{node!r} executes no function")
        return TermMap("function", name, term_type, datatype, args=tuple(sorted(args, key=lambda a: a[0])))

    def parent_of(node: str, triples_map_id: str) -> TermMap:
        pairs, calls = [], []
        for r in joins.get(node, ()):
            if r.call and not (r.child or r.parent_path):
                calls.append(function_call(r.call, None, None))
            elif r.child and r.parent_path and not r.call:
                pairs.append((r.child, r.parent_path))
            else:
                raise MappingError(f"join condition {r.condition!r} has neither a child and a parent reference nor a function alone")
        return TermMap("parent", triples_map_id, joins=tuple(pairs), where=tuple(calls))

    def of_node(node: str) -> TermMap:
        row = terms.get(node)
        if row is None:
            raise MappingError(f"nothing is said about term map {node!r}")
        term_type = TERM_TYPES[row.term_type] if row.term_type else None
        if row.function:
            return function_call(row.function, term_type, row.datatype)
        if row.parent:
            return parent_of(node, row.parent)
        if row.of_parent:
            return of_parent(of_node(row.of_parent))
        if row.constant is not None:
            kind = term_type or row.constant_kind
            return TermMap("constant", row.constant, kind, row.datatype, row.lang)
        if row.reference is not None:
            return TermMap("reference", row.reference, term_type, row.datatype, row.lang)
        if row.template:
            return TermMap("template", row.template, term_type, row.datatype, row.lang)
        if term_type == "bnode":
            return TermMap("blank", None, "bnode")
        raise MappingError(f"term map {node!r} says neither constant, reference nor template")

    def term(row) -> TermMap:
        return TermMap("constant", row.term, row.term_kind) if row.is_constant else of_node(row.term)

    called = {r.function for r in terms.values() if r.function} | {r.call for r in found["joins"] if r.call}
    formats = {FORMULATIONS.get(r.formulation) for r in maps if r.id not in called}
    if len(formats) != 1 or None in formats:
        raise MappingError(f"mapping {mapping_id!r} needs one known reference formulation")
    triples_maps = []
    for r in maps:
        if r.id in called:
            continue
        if r.subject_constant is not None:
            subject = TermMap("constant", r.subject_constant, "iri")
        elif r.subject_node is not None:
            subject = of_node(r.subject_node)
        else:
            raise MappingError(f"triples map {r.id!r} has no subject")
        triples_maps.append(
            TriplesMap(
                r.id,
                subject,
                tuple(
                    PredicateObject(
                        tuple(term(x) for x in rows if x.role == "predicate"),
                        tuple(term(x) for x in rows if x.role == "object"),
                    )
                    for rows in poms.get(r.id, {}).values()
                ),
                tuple(classes.get(r.subject_node, ())),
                r.iterator or ("$" if formats == {"JSON"} else ""),
                "stream" if r.is_stream else str(r.binding),
            )
        )
    return Mapping(mapping_id, tuple(triples_maps), formats.pop(), output_format, rml=rml)


def read_mapping(spark: SparkSession, path: str, mapping_id: str, output_format: str = "TTL") -> Mapping:
    return load_mapping(ntriples.read_ntriples(spark, path), mapping_id, output_format)


# --- writing ------------------------------------------------------------------------------------


def to_ntriples(mapping: Mapping) -> list[str]:
    """The rules of a mapping as N-Triples lines, in the standard vocabulary."""
    lines: list[str] = []
    counter = iter(range(1 << 30))
    formulation = {v: k for k, v in FORMULATIONS.items()}[mapping.input_format]
    term_type = {v: k for k, v in TERM_TYPES.items()}

    def say(s: str, p: str, o: str) -> None:
        lines.append(f"{s} <{p}> {o} .")

    def text(value: str) -> str:
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{escaped}"'

    def fresh(kind: str) -> str:
        return f"_:{kind}{next(counter):05d}"

    def node_of(map_id: str) -> str:
        return f"<{map_id}>" if ":" in map_id else f"<urn:map:{map_id}>"

    def call_of(t: TermMap) -> str:
        call = fresh("f")
        for name, value in ((EXECUTES, TermMap("constant", t.value, "iri")), *t.args):
            pom = fresh("p")
            say(call, RR + "predicateObjectMap", pom)
            say(pom, RR + "predicate", f"<{name}>")
            say(pom, RR + "objectMap", term(value))
        return call

    def term(t: TermMap) -> str:
        node = fresh("t")
        if t.side == "parent":
            say(node, RML + "parentTermMap", term(replace(t, side="child")))
            return node
        if t.kind == "constant":
            say(node, RR + "constant", f"<{t.value}>" if t.node_kind == "iri" else text(t.value))
        elif t.kind == "reference":
            say(node, RML + "reference", text(t.value))
        elif t.kind == "template":
            say(node, RR + "template", text(t.value))
        elif t.kind == "parent":
            say(node, RR + "parentTriplesMap", node_of(t.value))
            for child, other in t.joins:
                condition = fresh("j")
                say(node, RR + "joinCondition", condition)
                say(condition, RR + "child", text(child))
                say(condition, RR + "parent", text(other))
            for call in t.where:
                condition = fresh("j")
                say(node, RML + "joinCondition", condition)
                say(condition, FNML + "functionValue", call_of(call))
        elif t.kind == "function":
            say(node, FNML + "functionValue", call_of(t))
        if t.term_type:
            say(node, RR + "termType", f"<{term_type[t.term_type]}>")
        if t.datatype:
            say(node, RR + "datatype", f"<{t.datatype}>")
        if t.lang:
            say(node, RR + "language", text(t.lang))
        return node

    for tm in mapping.triples_maps:
        me, source, stream = node_of(tm.id), fresh("s"), fresh("b")
        say(me, RML + "logicalSource", source)
        say(source, RML + "referenceFormulation", f"<{formulation}>")
        if tm.iterator:
            say(source, RML + "iterator", text(tm.iterator))
        if tm.source == "stream":
            say(source, RML + "source", stream)
            say(stream, RDF_TYPE, f"<{STREAM}>")
        else:
            say(source, RML + "source", text(tm.source))
        subject = term(tm.subject)
        say(me, RR + "subjectMap", subject)
        for c in tm.classes:
            say(subject, RR + "class", f"<{c}>")
        for pom in tm.predicate_objects:
            node = fresh("p")
            say(me, RR + "predicateObjectMap", node)
            for p in pom.predicates:
                say(node, RR + "predicateMap", term(p))
            for o in pom.objects:
                say(node, RR + "objectMap", term(o))
    return lines


# --- rule tables --------------------------------------------------------------------------------

RULE_SCHEMA = "mapping_id string, input_format string, output_format string, triples_map_id string, rules string"


def to_rule_table(spark: SparkSession, *mappings: Mapping) -> DataFrame:
    """Mappings as a table, one row per triples map, the rules of each as JSON."""
    rows = [
        (m.id, m.input_format, m.output_format, tm.id, json.dumps(asdict(tm)))
        for m in mappings
        for tm in m.triples_maps
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _term_from(d: dict) -> TermMap:
    return TermMap(
        d["kind"], d["value"], d["term_type"], d["datatype"], d["lang"],
        tuple(tuple(j) for j in d["joins"]), tuple((name, _term_from(a)) for name, a in d["args"]),
        tuple(_term_from(c) for c in d.get("where", ())), d.get("side", "child"),
    )


def _triples_map_from(d: dict) -> TriplesMap:
    poms = tuple(
        PredicateObject(tuple(map(_term_from, p["predicates"])), tuple(map(_term_from, p["objects"]))) for p in d["predicate_objects"]
    )
    return TriplesMap(d["id"], _term_from(d["subject"]), poms, tuple(d["classes"]), d["iterator"], d["source"])


def from_rule_table(table: DataFrame, mapping_id: str) -> Mapping:
    found = all_from_rule_table(table.where(F.col("mapping_id") == mapping_id))
    if not found:
        raise MappingError(f"no mapping with id {mapping_id!r}")
    return found[mapping_id]


def all_from_rule_table(table: DataFrame) -> dict[str, Mapping]:
    """Every mapping of a rule table, by its id, as the driver's objects. Messages of a catalog of any size need load_catalog() instead."""
    by_id: dict[str, list] = {}
    for r in table.orderBy("mapping_id", "triples_map_id").collect():
        by_id.setdefault(r.mapping_id, []).append(r)
    return {mapping_id: _mapping_from(rows) for mapping_id, rows in by_id.items()}


def _mapping_from(rows: list) -> Mapping:
    maps = tuple(_triples_map_from(json.loads(r.rules)) for r in rows)
    return Mapping(rows[0].mapping_id, maps, rows[0].input_format, rows[0].output_format)
