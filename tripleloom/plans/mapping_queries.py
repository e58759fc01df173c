"""Registered queries of the mapping operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import registry
from tripleloom.model import Mapping, PredicateObject, TermMap, TriplesMap, blank, call, iri, literal, of_parent, parent, po, reference, template
from tripleloom.operators import validate
from tripleloom.operators.iterate import explode_items
from tripleloom.operators.joins import joined_triples
from tripleloom.operators.mapping import documents, triples
from tripleloom.operators.terms import RESERVED
from tripleloom.plans import fixtures
from tripleloom.session import prepare
from tripleloom.sources import ntriples, rules
from tripleloom.vocab import RDF_TYPE, XSD

EX = "http://example.com/"

# --- mappings -----------------------------------------------------------------------------------

FLAT = Mapping(
    "flat",
    (
        TriplesMap(
            "event",
            template(EX + "event/{event_id}"),
            (
                po(EX + "user", reference("user_id", XSD + "integer")),
                po(EX + "type", reference("event_type")),
                po(EX + "value", reference("value", XSD + "decimal")),
                po(EX + "at", reference("at", XSD + "dateTime")),
                po(EX + "k", reference("props.k", XSD + "integer")),
                po(EX + "page", template(EX + "user/{user_id}/{event_type}")),
            ),
            classes=(EX + "Event",),
        ),
    ),
)

CLASSES = Mapping(
    "classes",
    (
        TriplesMap(
            "event",
            template(EX + "event/{event_id}"),
            (po(RDF_TYPE, iri(EX + "Thing"), iri(EX + "Event")), po(template(EX + "is/{event_type}"), literal("yes"))),
            classes=(EX + "Event", EX + "Record"),
        ),
    ),
)

DATATYPES = Mapping(
    "datatypes",
    (
        TriplesMap(
            "customer",
            template(EX + "customer/{key}"),
            (
                PredicateObject(
                    (iri(EX + "name"), iri(EX + "label")),
                    (reference("name", XSD + "string"), reference("name", lang="en")),
                ),
                po(EX + "segment", reference("segment", XSD + "dateTime")),  # a label, not a cast
                po(EX + "key", reference("key", XSD + "integer")),
            ),
        ),
    ),
)

DISTINCT = Mapping(
    "distinct",
    (TriplesMap("line", iri(EX + "corpus"), (po(EX + "holds", reference("text")),), iterator="$.lines[*]"),),
    expand_arrays=False,
)

MISSING = Mapping(
    "missing",
    (
        TriplesMap(
            "event",
            template(EX + "event/{event_id}"),
            (
                po(EX + "value", reference("value")),
                po(EX + "never", reference("absent.path")),
                po(EX + "both", template("{event_type}={value}", "literal")),
            ),
        ),
    ),
)

LITERAL_TEMPLATE = Mapping(
    "literal_template",
    (
        TriplesMap(
            "event",
            template(EX + "event/{event_id}"),
            (
                po(
                    EX + "asWKT",
                    template(
                        "Point({user_id} {props.k})", "literal", "http://www.opengis.net/ont/geosparql#wktLiteral"
                    ),
                ),
            ),
        ),
    ),
)

IRI_SAFE = Mapping(
    "iri_safe",
    (TriplesMap("doc", template(EX + "doc/{id}"), (po(EX + "text", template(EX + "text/{lang}/{text}")),)),),
)

TAGS = Mapping(
    "tags",
    (TriplesMap("event", template(EX + "event/{event_id}"), (po(EX + "tag", reference("tag")),)),),
)

ORDERS = Mapping(
    "orders",
    (
        TriplesMap(
            "order",
            template(EX + "order/{key}"),
            (po(EX + "customer", parent("customer")),),
            classes=(EX + "Order",),
        ),
        TriplesMap("customer", template(EX + "customer/{customer.key}"), (po(EX + "key", reference("customer.key")),)),
        TriplesMap(
            "fact",
            template(EX + "fact/{name}"),
            (po(EX + "value", reference("value")), po(EX + "n", reference("n", XSD + "integer"))),
            iterator="$.facts[*]",
        ),
    ),
)

PARENTS = Mapping(
    "parents",
    (
        TriplesMap("order", template(EX + "order/{key}"), (po(EX + "by", parent("customer")), po(EX + "in", parent("site")))),
        TriplesMap("customer", template(EX + "customer/{customer.key}")),
        TriplesMap("site", iri(EX + "site"), classes=(EX + "Site",)),
    ),
)

BLANKS = Mapping(
    "blanks",
    (
        TriplesMap("order", blank("order {key}"), (po(EX + "of", parent("customer")),)),
        TriplesMap("customer", blank("customer {customer.key}"), (po(EX + "key", reference("customer.key")),)),
        TriplesMap("fact", blank(), (po(EX + "value", reference("value")),), iterator="$.facts[*]"),
    ),
)

ROOT_ARRAY = Mapping(
    "root_array",
    (TriplesMap("entry", template(EX + "customer/{key}"), (po(template(EX + "{field}"), reference("value")),), iterator="$[*]"),),
)

PARTS = Mapping(
    "parts",
    (
        TriplesMap("part", template(EX + "part/{@key}"), (po(EX + "has", reference("attr/value")),), iterator="/part", classes=(EX + "Part",)),
        TriplesMap("attr", template(EX + "kind/{@kind}"), (po(EX + "value", reference("value")),), iterator="/part/attr"),
    ),
    input_format="XML",
)

SUPPLIERS = Mapping(
    "suppliers",
    (
        TriplesMap(
            "row",
            template(EX + "supplier/{key}"),
            (po(template(EX + "{field}"), reference("value")), po(EX + "remark", reference("remark"))),
            iterator="",
        ),
    ),
    input_format="CSV",
)

SEVERAL = Mapping(
    "several",
    (
        TriplesMap(
            "event",
            template(EX + "event/{event_id}/{part}"),
            (po(EX + "about", template(EX + "{tag}/{part}/{tag}")), po(EX + "label", template("{part} {event_id}", "literal"))),
        ),
    ),
)

NUMBERS = Mapping(
    "numbers",
    (
        TriplesMap(
            "line",
            template(EX + "line/{line}"),
            (
                po(EX + "price", reference("price", XSD + "decimal")),
                po(EX + "discount", reference("rates[0]", XSD + "decimal")),
                po(EX + "count", reference("count", XSD + "integer")),
                po(EX + "label", template("{count} for {price}", "literal")),
            ),
        ),
    ),
)

JOIN = Mapping(
    "join",
    (
        TriplesMap("order", template(EX + "order/{key}"), (po(EX + "by", parent("customer", ("customer.key", "key"))),)),
        TriplesMap("customer", template(EX + "customer/{key}/{name}")),
    ),
)

JOIN_IN_MESSAGE = Mapping(
    "join_in_message",
    (
        TriplesMap(
            "fact",
            template(EX + "fact/{name}"),
            (po(EX + "unit", parent("unit", ("unit", "code"))), po(EX + "n", reference("n"))),
            iterator="$.facts[*]",
        ),
        TriplesMap("unit", template(EX + "unit/{code}"), (po(EX + "label", reference("label")),), iterator="$.units[*]"),
    ),
)


def _is_error():
    return call(
        registry.EQUAL,
        **{registry.PARAM_VALUE: reference("event_type"), registry.PARAM_VALUE2: literal("error")},
    )


CONDITIONAL = Mapping(
    "conditional",
    (
        TriplesMap(
            "event",
            template(EX + "event/{event_id}"),
            (
                po(EX + "isError", _is_error()),
                po(
                    EX + "status",
                    call(
                        registry.TRUE_CONDITION,
                        "iri",
                        **{registry.PARAM_BOOLEAN: _is_error(), registry.PARAM_STRING: literal(EX + "status/bad")},
                    ),
                ),
            ),
        ),
        TriplesMap(
            "failure",
            call(
                registry.TRUE_CONDITION,
                "bnode",
                **{registry.PARAM_BOOLEAN: _is_error(), registry.PARAM_STRING: template("failure {event_id}")},
            ),
            (po(EX + "k", reference("props.k")),),
        ),
    ),
)

# facts and tags of a section: each fact lies in one section, beside its tags
NESTED_PARENTS = Mapping(
    "nested_parents",
    (
        TriplesMap("fact", template(EX + "fact/{n}"), (po(EX + "in", parent("section")), po(EX + "tagged", parent("tag"))), iterator="$.sections[*].facts[*]"),
        TriplesMap("section", template(EX + "section/{name}"), (po(EX + "has", parent("fact")),), iterator="$.sections[*]"),
        TriplesMap("tag", template(EX + "tag/{t}"), iterator="$.sections[*].tags[*]"),
    ),
)

SHORTER = EX + "function/shorter"
registry.register(SHORTER, ("a", "b"), lambda a, b: (F.length(a) < F.length(b)).cast("string"))


def _equal(a: TermMap, b: TermMap) -> TermMap:
    return call(registry.EQUAL, **{registry.PARAM_VALUE: a, registry.PARAM_VALUE2: b})


# a key that a function of the order's values gives, and a test of values of both
JOIN_FUNCTION = Mapping(
    "join_function",
    (
        TriplesMap(
            "order",
            template(EX + "order/{key}"),
            (
                po(
                    EX + "closedFor",
                    parent(
                        "customer",
                        _equal(
                            of_parent(reference("key")),
                            call(
                                registry.TRUE_CONDITION,
                                **{registry.PARAM_BOOLEAN: _equal(reference("facts[0].value"), literal("F")), registry.PARAM_STRING: reference("customer.key")},
                            ),
                        ),
                        call(SHORTER, a=of_parent(reference("segment")), b=reference("facts[2].value")),
                    ),
                ),
            ),
        ),
        TriplesMap("customer", template(EX + "customer/{key}")),
    ),
)

SENSORS = ("value", "k", "user", "type", "time")


def wide_mapping() -> Mapping:
    """A station-like mapping: per quantity an observation, its result and its property."""
    paths = {"value": "value", "k": "props.k", "user": "user_id", "type": "event_type", "time": "at"}
    maps = [TriplesMap("site", iri(EX + "site"), (po(EX + "label", literal("all events")),), classes=(EX + "Site",))]
    for q in SENSORS:
        maps.append(
            TriplesMap(
                f"obs_{q}",
                template(EX + f"obs/{{event_id}}/{q}/{{at}}"),
                (
                    po(EX + "of", parent("site")),
                    po(EX + "observes", parent(f"prop_{q}")),
                    po(EX + "at", reference("at", XSD + "dateTime")),
                    po(EX + "result", parent(f"res_{q}")),
                ),
                classes=(EX + "Observation",),
            )
        )
        maps.append(
            TriplesMap(
                f"res_{q}",
                template(EX + f"result/{{event_id}}/{q}/{{at}}"),
                (po(EX + "number", reference(paths[q], XSD + "float")),),
                classes=(EX + "Result",),
            )
        )
        maps.append(TriplesMap(f"prop_{q}", iri(EX + f"prop/{q}"), classes=(EX + "Property",)))
    return Mapping("wide", tuple(maps))


WIDE = wide_mapping()

# --- SQL building blocks ------------------------------------------------------------------------

STR = f"'{XSD}string'"
LANGSTRING = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString'"
VALUE = "case when event_type <> 'signup' then printf('%.2f', value) end"
AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
K = "regexp_extract(props, '\"k\": ([0-9]+)', 1)"


def _lit(path: str) -> str:
    return f"'{EX}{path}'"


def _iri(obj: str) -> str:
    return f"{obj} as o, 'iri' as o_kind, cast(null as varchar) as o_datatype, cast(null as varchar) as o_lang"


def _blank(obj: str) -> str:
    return f"{obj} as o, 'bnode' as o_kind, cast(null as varchar) as o_datatype, cast(null as varchar) as o_lang"


def _text(obj: str, datatype: str = STR, lang: str = "cast(null as varchar)") -> str:
    return f"{obj} as o, 'literal' as o_kind, {datatype} as o_datatype, {lang} as o_lang"


def _union(source: str, msg_id: str, rows: list[tuple[str, str, str]], where: str = "") -> str:
    """(subject, predicate, object columns) per statement over one source; null parts drop the row."""
    selects = [
        f"select * from (select {msg_id} as msg_id, {s} as s, {p} as p, {o} from {source} {where}) "
        "where s is not null and p is not null and o is not null"
        for s, p, o in rows
    ]
    return " union all ".join(selects)


def _xsd(name: str) -> str:
    return f"'{XSD}{name}'"


EVENT = f"'{EX}event/' || event_id"
RDF_TYPE_SQL = f"'{RDF_TYPE}'"

FLAT_ROWS = [
    (EVENT, RDF_TYPE_SQL, _iri(_lit("Event"))),
    (EVENT, _lit("user"), _text("user_id::varchar", _xsd("integer"))),
    (EVENT, _lit("type"), _text("event_type")),
    (EVENT, _lit("value"), _text(VALUE, _xsd("decimal"))),
    (EVENT, _lit("at"), _text(AT, _xsd("dateTime"))),
    (EVENT, _lit("k"), _text(K, _xsd("integer"))),
    (EVENT, _lit("page"), _iri(f"'{EX}user/' || user_id || '/' || event_type")),
]
FLAT_SQL = _union("events", "event_id", FLAT_ROWS)


def _encode_sql(expr: str, chars: str = RESERVED) -> str:
    for ch in chars:
        written = "".join(f"%{b:02x}" for b in ch.encode())
        raw = "chr(10)" if ch == "\n" else "'" + ch.replace("'", "''") + "'"
        expr = f"replace({expr}, {raw}, '{written}')"
    return expr


# Whole texts hold line breaks beside the printable reserved characters.
DOC_TEXT_SQL = _encode_sql("text", RESERVED + "\n")
AT_IRI = _encode_sql(AT, ":")


def _wide_sql() -> str:
    number = {"value": VALUE, "k": K, "user": "user_id::varchar", "type": "event_type", "time": AT}
    rows = [
        (_lit("site"), RDF_TYPE_SQL, _iri(_lit("Site"))),
        (_lit("site"), _lit("label"), _text("'all events'")),
    ]
    for q in SENSORS:
        obs = f"'{EX}obs/' || event_id || '/{q}/' || {AT_IRI}"
        res = f"'{EX}result/' || event_id || '/{q}/' || {AT_IRI}"
        rows += [
            (obs, RDF_TYPE_SQL, _iri(_lit("Observation"))),
            (obs, _lit("of"), _iri(_lit("site"))),
            (obs, _lit("observes"), _iri(_lit(f"prop/{q}"))),
            (obs, _lit("at"), _text(AT, _xsd("dateTime"))),
            (obs, _lit("result"), _iri(res)),
            (res, RDF_TYPE_SQL, _iri(_lit("Result"))),
            (res, _lit("number"), _text(number[q], _xsd("float"))),
            (_lit(f"prop/{q}"), RDF_TYPE_SQL, _iri(_lit("Property"))),
        ]
    return _union("events", "event_id", rows)


FACTS_SQL = """(
  select o_orderkey, o_custkey, f.n as n, f.name as name, f.value as value, f.unit as unit from (
    select o_orderkey, o_custkey, unnest([
      {'n': 1, 'name': 'status', 'value': o_orderstatus, 'unit': 'code'},
      {'n': 2, 'name': 'total', 'value': printf('%.2f', o_totalprice), 'unit': 'money'},
      {'n': 3, 'name': 'priority', 'value': o_orderpriority, 'unit': 'code'},
      {'n': 4, 'name': 'date', 'value': strftime(o_orderdate, '%Y-%m-%d'), 'unit': 'none'}]) as f
    from orders))"""

LINES_PRICED_SQL = """(
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as line,
    printf('%.2f', l_extendedprice) as price, printf('%.2f', l_discount) as discount, l_quantity::bigint as n from lineitem)"""

ORDER = f"'{EX}order/' || o_orderkey"
ORDER_CUSTOMER = f"'{EX}customer/' || o_custkey"
ORDERS_SQL = (
    _union(
        "orders",
        "o_orderkey",
        [
            (ORDER, RDF_TYPE_SQL, _iri(_lit("Order"))),
            (ORDER, _lit("customer"), _iri(ORDER_CUSTOMER)),
            (ORDER_CUSTOMER, _lit("key"), _text("o_custkey::varchar")),
        ],
    )
    + " union all "
    + _union(
        FACTS_SQL,
        "o_orderkey",
        [
            (f"'{EX}fact/' || name", _lit("value"), _text("value")),
            (f"'{EX}fact/' || name", _lit("n"), _text("n::varchar", _xsd("integer"))),
        ],
    )
)


def _label(value: str) -> str:
    return f"'_:b' || sha256(o_orderkey || ':' || {value})"


BLANKS_SQL = (
    _union(
        "orders",
        "o_orderkey",
        [
            (_label("'order ' || o_orderkey"), _lit("of"), _blank(_label("'customer ' || o_custkey"))),
            (_label("'customer ' || o_custkey"), _lit("key"), _text("o_custkey::varchar")),
        ],
    )
    + " union all "
    + _union(FACTS_SQL, "o_orderkey", [(_label("'fact:' || (n - 1)"), _lit("value"), _text("value"))])
)

LINES_SQL = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)"

CUSTOMER_FIELDS_SQL = """(
  select c_custkey, f.pos as pos, f.field as field, f.value as value from (
    select c_custkey, unnest([
      {'pos': 0, 'field': 'name', 'value': c_name}, {'pos': 1, 'field': 'segment', 'value': c_mktsegment},
      {'pos': 2, 'field': 'balance', 'value': printf('%.2f', c_acctbal)}]) as f
    from customer))"""

PART_FIELDS_SQL = """(
  select p_partkey, f.pos as pos, f.field as field, f.value as value from (
    select p_partkey, unnest([
      {'pos': 0, 'field': 'name', 'value': p_name || ' & <co>'}, {'pos': 1, 'field': 'brand', 'value': p_brand},
      {'pos': 2, 'field': 'size', 'value': p_size::varchar}]) as f
    from part))"""

SUPPLIER_FIELDS_SQL = """(
  select s_suppkey, f.pos as pos, f.field as field, f.value as value, nullif(f.remark, '') as remark from (
    select s_suppkey, unnest([
      {'pos': 0, 'field': 'name', 'value': s_name || ', "Ltd"', 'remark': ''},
      {'pos': 1, 'field': 'nation', 'value': s_nationkey::varchar, 'remark': 'home'},
      {'pos': 2, 'field': 'balance', 'value': printf('%.2f', s_acctbal), 'remark': ''}]) as f
    from supplier))"""

# Turtle and JSON-LD documents of the flat mapping, in rule order.
TURTLE_SQL = f"""
select event_id as msg_id, concat(
  '<', {EVENT}, '> <{RDF_TYPE}> <{EX}Event> .', chr(10),
  '<', {EVENT}, '> <{EX}user> "', user_id, '"^^<{XSD}integer> .', chr(10),
  '<', {EVENT}, '> <{EX}type> "', event_type, '" .', chr(10),
  coalesce('<' || {EVENT} || '> <{EX}value> "' || {VALUE} || '"^^<{XSD}decimal> .' || chr(10), ''),
  '<', {EVENT}, '> <{EX}at> "', {AT}, '"^^<{XSD}dateTime> .', chr(10),
  '<', {EVENT}, '> <{EX}k> "', {K}, '"^^<{XSD}integer> .', chr(10),
  '<', {EVENT}, '> <{EX}page> <{EX}user/', user_id, '/', event_type, '> .', chr(10)) as doc
from events"""

JSONLD_SQL = f"""
select event_id as msg_id, concat(
  '[{{"@id":"', {EVENT}, '","@type":["{EX}Event"],',
  '"{EX}user":[{{"@value":"', user_id, '","@type":"{XSD}integer"}}],',
  '"{EX}type":[{{"@value":"', event_type, '"}}],',
  coalesce('"{EX}value":[{{"@value":"' || {VALUE} || '","@type":"{XSD}decimal"}}],', ''),
  '"{EX}at":[{{"@value":"', {AT}, '","@type":"{XSD}dateTime"}}],',
  '"{EX}k":[{{"@value":"', {K}, '","@type":"{XSD}integer"}}],',
  '"{EX}page":[{{"@id":"{EX}user/', user_id, '/', event_type, '"}}]}}]') as doc
from events"""

# Whole document texts as literals: every escape is in use.
DOC_LITERAL = Mapping(
    "doc_literal",
    (TriplesMap("doc", template(EX + "doc/{id}"), (po(EX + "text", reference("text")),)),),
    expand_arrays=False,
)
_ESC = "replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')"
DOC_TURTLE_SQL = f"""
select doc_id as msg_id, '<{EX}doc/' || doc_id || '> <{EX}text> "' || {_ESC} || '" .' || chr(10) as doc from documents"""

# --- queries ------------------------------------------------------------------------------------


def _map(source, mapping: Mapping):
    return lambda spark, sf_dir: triples(source(spark, sf_dir), mapping)


def _serialize_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(fixtures.orders(spark, sf_dir), JOIN_IN_MESSAGE).select("msg_id", "doc")


def _join_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_triples(fixtures.orders(spark, sf_dir), JOIN, fixtures.customers(spark, sf_dir))


def _join_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules go through a rule document, so that its form of a condition is read too."""
    lines = spark.createDataFrame([(line,) for line in rules.to_ntriples(JOIN_FUNCTION)], "value string")
    mapping = rules.load_mapping(ntriples.parse_lines(lines, "value"), "join_function")
    return joined_triples(fixtures.orders(spark, sf_dir), mapping, fixtures.customers(spark, sf_dir))


def _documents(source, mapping: Mapping):
    return lambda spark, sf_dir: documents(source(spark, sf_dir), mapping).select("msg_id", "doc")


def _iterate(source, fmt: str, iterator: str, references: dict[str, str]):
    return lambda spark, sf_dir: explode_items(source(spark, sf_dir), fmt, iterator, references)


def _validate(source, fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return source(spark, sf_dir).select("msg_id", validate.is_valid(F.col("payload"), fmt).alias("valid"))

    return run


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page whole, without its document type too, and as the text of one element; of each its navigation and that cut short."""
    prepare(spark)
    whole, nav = F.col("html"), F.regexp_extract("html", "(?s)<nav>.*?</nav>", 0)
    bare = F.regexp_replace(whole, "(?i)^\\s*<!doctype[^>]*>", "")
    escaped = F.replace(F.replace(whole, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    kinds = {"page": whole, "without type": bare, "as text": F.concat(F.lit("<page>"), escaped, F.lit("</page>")), "nav": nav, "nav cut": F.left(nav, F.length(nav) - 1)}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("payload")) for k, c in kinds.items()]))
    rows = fixtures.table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), parts.alias("part")).select("msg_id", "part.*")
    return rows.select("msg_id", "kind", validate.is_xml(F.col("payload")).alias("valid"))


def _validate_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of three formats, some messages under the wrong one."""
    json = fixtures.broken_events(spark, sf_dir).select(F.concat(F.lit("e"), "msg_id").alias("msg_id"), "payload", F.lit("JSON").alias("format"))
    xml = fixtures.broken_parts_xml(spark, sf_dir).select(
        F.concat(F.lit("p"), "msg_id").alias("msg_id"),
        "payload",
        F.when(F.col("msg_id") % 2 == 0, "XML").otherwise("JSON").alias("format"),
    )
    csv = fixtures.suppliers_csv(spark, sf_dir).select(
        F.concat(F.lit("s"), "msg_id").alias("msg_id"), "payload", F.when(F.col("msg_id") % 2 == 0, "CSV").otherwise("XML").alias("format")
    )
    rows = json.unionByName(xml).unionByName(csv)
    return rows.select("msg_id", "format", validate.is_valid(F.col("payload"), F.col("format")).alias("valid"))


def _lines_of_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the flat mapping, cut into lines again."""
    docs = documents(fixtures.events(spark, sf_dir), FLAT).select("msg_id", F.explode_outer(F.split("doc", "\n")).alias("value"))
    return ntriples.parse_lines(docs, "value", "msg_id")


def _doc_lines_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the Turtle writer and the N-Triples reader."""
    docs = documents(fixtures.documents(spark, sf_dir), DOC_LITERAL).select("msg_id", F.col("doc").alias("value"))
    return ntriples.parse_lines(docs, "value", "msg_id").select("msg_id", "s", "o")


def _loaded_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat mapping written as rules in N-Triples, loaded back and run."""
    lines = spark.createDataFrame([(line,) for line in rules.to_ntriples(FLAT)], "value string")
    mapping = rules.load_mapping(ntriples.parse_lines(lines, "value"), "loaded")
    return triples(fixtures.events(spark, sf_dir), mapping)


ROWS_BAD_EVENT = "not (event_id % 11 = 0 or event_id % 7 = 0 or event_id % 13 = 0)"
ROWS_BAD_PART = "not (p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_partkey % 11 = 0)"

QUERIES = {
    "map_events_flat": (_map(fixtures.events, FLAT), FLAT_SQL),
    "map_class": (
        _map(fixtures.events, CLASSES),
        _union(
            "events",
            "event_id",
            [
                (EVENT, RDF_TYPE_SQL, _iri(_lit("Event"))),
                (EVENT, RDF_TYPE_SQL, _iri(_lit("Record"))),
                (EVENT, RDF_TYPE_SQL, _iri(_lit("Thing"))),
                (EVENT, f"'{EX}is/' || event_type", _text("'yes'")),
            ],
        ),
    ),
    "map_datatypes": (
        _map(fixtures.customers, DATATYPES),
        _union(
            "customer",
            "c_custkey",
            [
                (f"'{EX}customer/' || c_custkey", _lit(p), _text("c_name", dt, lang))
                for p in ("name", "label")
                for dt, lang in ((STR, "cast(null as varchar)"), (LANGSTRING, "'en'"))
            ]
            + [
                (f"'{EX}customer/' || c_custkey", _lit("segment"), _text("c_mktsegment", _xsd("dateTime"))),
                (f"'{EX}customer/' || c_custkey", _lit("key"), _text("c_custkey::varchar", _xsd("integer"))),
            ],
        ),
    ),
    "map_distinct": (
        _map(fixtures.documents, DISTINCT),
        f"select distinct doc_id as msg_id, '{EX}corpus' as s, '{EX}holds' as p, {_text('line')} from {LINES_SQL}",
    ),
    "map_missing": (
        _map(fixtures.events, MISSING),
        _union(
            "events",
            "event_id",
            [
                (EVENT, _lit("value"), _text(VALUE)),
                (EVENT, _lit("both"), _text(f"event_type || '=' || {VALUE}")),
            ],
        ),
    ),
    "map_literal_template": (
        _map(fixtures.events, LITERAL_TEMPLATE),
        _union(
            "events",
            "event_id",
            [
                (
                    EVENT,
                    _lit("asWKT"),
                    _text(f"'Point(' || user_id || ' ' || {K} || ')'", "'http://www.opengis.net/ont/geosparql#wktLiteral'"),
                )
            ],
        ),
    ),
    "iri_safe": (
        _map(fixtures.documents, IRI_SAFE),
        _union("documents", "doc_id", [(f"'{EX}doc/' || doc_id", _lit("text"), _iri(f"'{EX}text/' || lang || '/' || {DOC_TEXT_SQL}"))]),
    ),
    "map_multi_valued": (
        _map(fixtures.tagged_events, TAGS),
        f"""select distinct event_id as msg_id, {EVENT} as s, '{EX}tag' as p, {_text("tag")} from (
          select event_id, unnest(case when event_id % 3 = 0 then ['[' || event_type || ']']
            else [event_type, 'u' || (user_id % 10)] end) as tag from events)""",
    ),
    "map_multi_template": (
        _map(fixtures.several_events, SEVERAL),
        "select distinct * from ("
        + _union(
            """(select *, unnest(parts) as other from (select *, unnest(tags) as tag from (select *, unnest(parts) as part from (
              select event_id, [event_type, 'u' || (user_id % 10)] as tags, case when event_id % 3 <> 0 then ['a', 'b' || (user_id % 3)]
                when event_id % 5 <> 0 then ['a'] else [] end as parts from events))))""",
            "event_id",
            [
                (f"{EVENT} || '/' || part", _lit("about"), _iri(f"'{EX}' || tag || '/' || other || '/' || tag")),
                (f"{EVENT} || '/' || part", _lit("label"), _text("other || ' ' || event_id")),
            ],
        )
        + ")",
    ),
    "map_orders_nested": (_map(fixtures.orders, ORDERS), ORDERS_SQL),
    "map_parent_nojoin": (
        _map(fixtures.orders, PARENTS),
        _union(
            "orders",
            "o_orderkey",
            [
                (ORDER, _lit("by"), _iri(ORDER_CUSTOMER)),
                (ORDER, _lit("in"), _iri(_lit("site"))),
                (_lit("site"), RDF_TYPE_SQL, _iri(_lit("Site"))),
            ],
        ),
    ),
    "map_parent_nested": (
        _map(fixtures.sectioned_orders, NESTED_PARENTS),
        "select distinct * from ("
        + _union(
            """(select o_orderkey, unnest(['status', 'priority', 'total']) as n, unnest(['state', 'state', 'money']) as section,
              unnest(['a', 'a', 'c']) as tag, o_orderstatus from orders)""",
            "o_orderkey",
            [
                (f"'{EX}fact/' || n", _lit("in"), _iri(f"'{EX}section/' || section")),
                (f"'{EX}section/' || section", _lit("has"), _iri(f"'{EX}fact/' || n")),
                (f"'{EX}fact/' || n", _lit("tagged"), _iri(f"'{EX}tag/' || tag")),
                (f"'{EX}fact/' || n", _lit("tagged"), _iri(f"case when section = 'state' then '{EX}tag/' || o_orderstatus end")),
            ],
        )
        + ")",
    ),
    "map_blank_nodes": (_map(fixtures.orders, BLANKS), BLANKS_SQL),
    "map_wide": (_map(fixtures.events, WIDE), _wide_sql()),
    "iterate_json": (
        _iterate(fixtures.documents, "JSON", "$.lines[*]", {"n": "n", "text": "text"}),
        """select doc_id as msg_id, n - 1 as pos, n::varchar as n, line as text from (
          select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n
          from documents)""",
    ),
    "iterate_json_root": (
        _iterate(fixtures.customers_root, "JSON", "$[*]", {"key": "key", "field": "field", "value": "value"}),
        f"select c_custkey as msg_id, pos, c_custkey::varchar as key, field, value from {CUSTOMER_FIELDS_SQL}",
    ),
    "map_json_root": (
        _map(fixtures.customers_root, ROOT_ARRAY),
        _union(CUSTOMER_FIELDS_SQL, "c_custkey", [(f"'{EX}customer/' || c_custkey", f"'{EX}' || field", _text("value"))]),
    ),
    "iterate_xml": (
        _iterate(fixtures.parts_xml, "XML", "/part/attr", {"field": "@kind", "value": "value"}),
        f"select p_partkey as msg_id, pos, field, value from {PART_FIELDS_SQL}",
    ),
    "map_xml_parts": (
        _map(fixtures.parts_xml, PARTS),
        _union("part", "p_partkey", [(f"'{EX}part/' || p_partkey", RDF_TYPE_SQL, _iri(_lit("Part")))])
        + " union all "
        + _union(
            PART_FIELDS_SQL,
            "p_partkey",
            [
                (f"'{EX}part/' || p_partkey", _lit("has"), _text("value")),
                (f"'{EX}kind/' || field", _lit("value"), _text("value")),
            ],
        ),
    ),
    "iterate_csv": (
        _iterate(fixtures.suppliers_csv, "CSV", "", {"key": "key", "field": "field", "value": "value", "remark": "remark"}),
        f"select s_suppkey as msg_id, pos, s_suppkey::varchar as key, field, value, remark from {SUPPLIER_FIELDS_SQL}",
    ),
    "map_csv_suppliers": (
        _map(fixtures.suppliers_csv, SUPPLIERS),
        _union(
            SUPPLIER_FIELDS_SQL,
            "s_suppkey",
            [
                (f"'{EX}supplier/' || s_suppkey", f"'{EX}' || field", _text("value")),
                (f"'{EX}supplier/' || s_suppkey", _lit("remark"), _text("remark")),
            ],
        ),
    ),
    "map_join_condition": (
        _join_condition,
        _union(
            "orders join customer on o_custkey = c_custkey",
            "o_orderkey",
            [(ORDER, _lit("by"), _iri(f"'{EX}customer/' || c_custkey || '/' || replace(c_name, '#', '%23')"))],
        ),
    ),
    "map_join_function": (
        _join_function,
        _union(
            "orders join customer on o_custkey = c_custkey and o_orderstatus = 'F' and length(c_mktsegment) < length(o_orderpriority)",
            "o_orderkey",
            [(ORDER, _lit("closedFor"), _iri(f"'{EX}customer/' || c_custkey"))],
        ),
    ),
    "map_numbers": (
        _map(fixtures.priced_lines, NUMBERS),
        _union(
            LINES_PRICED_SQL,
            "line",
            [
                (f"'{EX}line/' || line", _lit("price"), _text("price", _xsd("decimal"))),
                (f"'{EX}line/' || line", _lit("discount"), _text("discount", _xsd("decimal"))),
                (f"'{EX}line/' || line", _lit("count"), _text("n::varchar", _xsd("integer"))),
                (f"'{EX}line/' || line", _lit("label"), _text("n || ' for ' || price")),
            ],
        ),
    ),
    "serialize_joined": (
        _serialize_joined,
        f"""select o_orderkey as msg_id,
          '<{EX}fact/status> <{EX}n> "1" .' || chr(10) || '<{EX}fact/total> <{EX}n> "2" .' || chr(10)
          || '<{EX}fact/priority> <{EX}n> "3" .' || chr(10) || '<{EX}fact/date> <{EX}n> "4" .' || chr(10)
          || '<{EX}unit/code> <{EX}label> "a code" .' || chr(10) || '<{EX}unit/money> <{EX}label> "an amount" .' || chr(10)
          || string_agg('<{EX}fact/' || name || '> <{EX}unit> <{EX}unit/' || unit || '> .' || chr(10), '' order by name) as doc
        from {FACTS_SQL} where unit <> 'none' group by o_orderkey""",
    ),
    "map_join_in_message": (
        _map(fixtures.orders, JOIN_IN_MESSAGE),
        _union(
            FACTS_SQL,
            "o_orderkey",
            [
                (f"'{EX}fact/' || name", _lit("n"), _text("n::varchar")),
                (f"'{EX}fact/' || name", _lit("unit"), _iri(f"case when unit <> 'none' then '{EX}unit/' || unit end")),
            ],
        )
        + " union all "
        + _union(
            "orders",
            "o_orderkey",
            [
                (_lit("unit/code"), _lit("label"), _text("'a code'")),
                (_lit("unit/money"), _lit("label"), _text("'an amount'")),
            ],
        ),
    ),
    "fn_conditional": (
        _map(fixtures.events, CONDITIONAL),
        _union(
            "events",
            "event_id",
            [
                (EVENT, _lit("isError"), _text("(event_type = 'error')::varchar")),
                (EVENT, _lit("status"), _iri(f"case when event_type = 'error' then '{EX}status/bad' end")),
                (
                    "case when event_type = 'error' then '_:b' || sha256(event_id || ':failure ' || event_id) end",
                    _lit("k"),
                    _text(K),
                ),
            ],
        ),
    ),
    "validate_json": (
        _validate(fixtures.broken_events, "JSON"),
        f"select event_id as msg_id, {ROWS_BAD_EVENT} as valid from events",
    ),
    "validate_xml": (
        _validate(fixtures.broken_parts_xml, "XML"),
        f"select p_partkey as msg_id, {ROWS_BAD_PART} as valid from part",
    ),
    "validate_csv": (
        _validate(fixtures.broken_events, "CSV"),
        "select event_id as msg_id, event_id % 11 <> 0 as valid from events",
    ),
    # a page has a document type and elements that are never closed; as the text of an element it is valid if its characters are
    "validate_xml_pages": (
        _pages,
        r"""with p as (select page_id, html, regexp_extract(html, '<nav>(?:.|\n)*?</nav>') as nav,
          regexp_matches(html, '<(meta|br|img)[^>/]*>') as is_open from pages)
        select page_id as msg_id, 'page' as kind, not is_open and not regexp_matches(html, '(?i)^\s*<!doctype') as valid from p
        union all select page_id, 'without type', not is_open from p
        union all select page_id, 'as text', not regexp_matches(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]') from p
        union all select page_id, 'nav', nav <> '' and not contains(nav, '&') from p
        union all select page_id, 'nav cut', false from p""",
    ),
    "validate_mixed": (
        _validate_mixed,
        f"""select 'e' || event_id as msg_id, 'JSON' as format, {ROWS_BAD_EVENT} as valid from events
        union all select 'p' || p_partkey, case when p_partkey % 2 = 0 then 'XML' else 'JSON' end,
          p_partkey % 2 = 0 and {ROWS_BAD_PART} from part
        union all select 's' || s_suppkey, case when s_suppkey % 2 = 0 then 'CSV' else 'XML' end, s_suppkey % 2 = 0 from supplier""",
    ),
    "serialize_turtle": (_documents(fixtures.events, FLAT), TURTLE_SQL),
    "serialize_jsonld": (_documents(fixtures.events, replace(FLAT, output_format="JSONLD")), JSONLD_SQL),
    "serialize_texts": (_documents(fixtures.documents, DOC_LITERAL), DOC_TURTLE_SQL),
    "read_ntriples": (_lines_of_flat, FLAT_SQL),
    "read_ntriples_texts": (_doc_lines_back, f"select doc_id as msg_id, '{EX}doc/' || doc_id as s, text as o from documents"),
    "load_mapping": (_loaded_mapping, FLAT_SQL),
}
