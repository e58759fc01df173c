"""Mappings as data: one plan that writes the documents of any number of mappings.

A mapping of JSON, XML or CSV messages, with any iterators, constants, references, templates and blank nodes, written as Turtle or as
JSON-LD, is a row: for each iterator the paths it reads, and for every statement the pieces it is put together from. Messages look
their row up by mapping id, walk its paths and join the pieces. XML is read once into a variant whatever its elements are, with every
text and attribute marked, so that none is taken for a number and no text for a list of elements. Other mappings (functions,
parents of another item) are compiled into columns of their own; see mapping.py.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.model import Mapping, MappingError
from tripleloom.operators import crossing, iterate, terms
from tripleloom.operators.mapping import JSONLD, TURTLE, WAYS, Atom, Group, Node, Part, _jsonld_value, _of_term, _turtle, groups_of
from tripleloom.session import local_table
from tripleloom.vocab import RDF_TYPE

# How a piece is written: as it stands, one of the ways of WAYS, or one value of an array.
PLAIN, EACH_LITERAL, EACH_IRI = -1, 100, 101
# A step that takes all elements, and one that takes a member by its name.
ALL, MEMBER = -2, -1

_STEPS = "array<struct<name: string, at: int>>"
_PIECES = "array<struct<how: int, at: int, text: string>>"
_STATEMENTS = f"array<struct<pieces: {_PIECES}, at: int>>"
PROGRAM = (
    f"array<struct<iterator: {_STEPS}, paths: array<struct<text: string, steps: {_STEPS}, ways: int>>, "
    f"labels: array<struct<pieces: {_PIECES}, numbered: boolean>>, spread: array<int>, single: {_STATEMENTS}, many: {_STATEMENTS}, "
    f"nodes: array<struct<head: {_PIECES}, sure: boolean, properties: array<struct<name: {_PIECES}, single: {_STATEMENTS}, many: {_STATEMENTS}>>>>, "
    f"crossed: {crossing.STATEMENTS}, label_texts: {crossing.STATEMENTS}>>"
)
RULE_SCHEMA = "mapping_id string, input_format string, output_format string, problem string, is_data boolean, program string"


def _steps(path: str) -> list[dict]:
    def step(x: str | int) -> dict:
        return {"name": None, "at": ALL} if x == "*" else {"name": x, "at": MEMBER} if isinstance(x, str) else {"name": None, "at": x}

    return [step(x) for x in iterate.json_steps(path)]


def _xml_steps(path: str) -> list[dict]:
    return [{"name": f"_{s[1:]}" if s[0] == "@" else s, "at": MEMBER} for s in iterate.xml_steps(path)]


def as_data(mapping: Mapping) -> list[dict] | None:
    """The program of a mapping, a dictionary for each iterator, or None if it has to be compiled."""
    if mapping.has_joins:
        return None
    form = TURTLE if mapping.output_format == "TTL" else JSONLD
    out = []
    for group in groups_of(mapping, form):
        made = _program(group, mapping)
        if made is None:
            return None
        out.append(made)
    return out


def _program(group: Group, mapping: Mapping) -> dict | None:
    group.learn()
    keys = {name: key for key, (name, _) in group.atoms.items()}
    if any(key[0] not in (*WAYS, "many", "bnode") or (key[0] in WAYS and not isinstance(key[1], str)) for key in keys.values()):
        return None  # a function
    own = [a for a, key in keys.items() if key[0] == "bnode"]
    if any(a not in group.labels and len(keys[a]) != 2 for a in own):
        return None  # a label made by a function
    paths = []
    for path in group.paths:
        if mapping.input_format == "CSV":
            paths.append({"text": iterate._json_path([path]), "steps": [{"name": path, "at": MEMBER}]})
            continue
        if mapping.input_format == "XML":
            steps, node = _xml_steps(path), iterate.xml_tree(group.iterator, group.paths)[1]
            for step in iterate.xml_steps(path):
                node = node[step]
            # where more is read below an element than its text, an empty one has no text
            paths.append({"text": "_VALUE" if any(node) else None, "steps": steps})
            continue
        steps = iterate.json_steps(path)
        if "*" in steps:
            raise MappingError("a reference may not hold '*'; arrays are expanded by themselves")
        if not steps:
            return None
        paths.append({"text": iterate._json_path(steps), "steps": _steps(path)})

    used: dict[int, set[int]] = {}

    def piece(part: Part, each: int) -> dict:
        if isinstance(part, str):
            return {"how": PLAIN, "at": -1, "text": part}
        if part.name == "\x00each":
            return {"how": each, "at": -1, "text": None}
        if part.name in group.slots:
            path, how = group.slots[part.name]
            at = group.paths.index(path)
            used.setdefault(at, set()).add(how)
            return {"how": how, "at": at, "text": None}
        return {"how": 0, "at": len(paths) + own.index(part.name), "text": None}

    def pieces(parts: list[Part], each: int = PLAIN) -> list[dict]:
        return [piece(p, each) for p in parts if p != ""]

    def raw(text: list[tuple[bool, str]]) -> list[dict]:
        return [{"how": WAYS.index("raw"), "at": group.paths.index(x), "text": None} if is_slot else {"how": PLAIN, "at": -1, "text": x} for is_slot, x in text]

    def of_object(o: Node, write) -> tuple[dict, dict | None]:
        """One value, and each of several where the object is a plain reference."""
        at = -1 if o.many is None else group.paths.index(keys[o.many.name][1])
        one = {"pieces": pieces(write(o)), "at": at}
        if o.many is None:
            return one, None
        marked = Node(o.kind, (Atom("\x00each"),), o.datatype, o.lang)
        return one, {"pieces": pieces(write(marked), EACH_IRI if o.kind == "iri" else EACH_LITERAL), "at": at}

    said = [group.statements(tm) for tm in group.maps]
    single, many, nodes = [], [], []
    turtle = mapping.output_format == "TTL"
    for tm, statements in zip(group.maps, said, strict=True):
        if turtle:
            for s, p, o in statements:
                one, each = of_object(o, lambda node, s=s, p=p: _turtle(s, p, node))
                single.append(one)
                many += [each] if each else []
            continue
        by_property: dict[tuple, dict] = {}
        sure = False
        for _, p, o in statements:
            as_type = p.parts == (RDF_TYPE,) and o.kind != "literal"
            key = ("@type",) if as_type else p.parts
            found = by_property.setdefault(key, {"name": pieces([',"', *key, '":[']), "single": [], "many": []})
            one, each = of_object(o, lambda node, t=as_type: _jsonld_value(node, t))
            found["single"].append(one)
            found["many"] += [each] if each else []
            sure |= all(isinstance(part, str) for part in (*o.parts, *key))
        head = pieces(['{"@id":"', *group.node(tm.subject, tm).parts, '"'])
        nodes.append({"head": head, "sure": sure, "properties": list(by_property.values())})
    form = TURTLE if turtle else JSONLD
    written = [form.write(*(_of_term(n, x) for n, x in zip(spo, "spo"))) for statements in said for spo in statements]
    raw_way = WAYS.index("raw")
    for at, path in enumerate(paths):  # the ways its value is written in, a bit for each
        path["ways"] = sum(1 << how for how in used.get(at, ()))
    iterators = {"JSON": _steps, "XML": _xml_steps, "CSV": lambda _: [{"name": None, "at": ALL}]}
    return {
        "iterator": iterators[mapping.input_format](group.iterator),
        "paths": paths,
        "labels": [{"pieces": raw(group.labels[a]), "numbered": False} if a in group.labels else {"pieces": raw([(False, f"{keys[a][1]}:")]), "numbered": True} for a in own],
        "spread": [group.paths.index(p) for p in group.spread] if mapping.expand_arrays else [],
        "single": single,
        "many": many,
        "nodes": nodes,
        "crossed": [crossing.described(group.statement(parts)) for parts in written],
        "label_texts": [
            crossing.described([("l", group.paths.index(x), raw_way) if is_slot else x for is_slot, x in group.labels.get(a, [])]) for a in own
        ],
    }


def rule_row(mapping_id: str, mapping: Mapping) -> tuple:
    """A mapping as a row of RULE_SCHEMA. One that cannot be compiled is a row with its problem."""
    try:
        made, problem = as_data(mapping), None
    except MappingError as e:
        made, problem = None, f"MappingError: {e}"
    return (mapping_id, mapping.input_format, mapping.output_format, problem, made is not None, None if made is None else json.dumps(made))


def rule_rows(mappings: dict[str, Mapping]) -> list[tuple]:
    return [rule_row(name, mapping) for name, mapping in mappings.items()]


def rule_table(spark: SparkSession, mappings: dict[str, Mapping]) -> DataFrame:
    """One row per mapping."""
    return local_table(spark, rule_rows(mappings), RULE_SCHEMA)


_OPTIONS = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in iterate.JSON_OPTIONS.items()) + ")"


def _list(text: str) -> str:
    return f"from_json({text}, 'array<string>', {_OPTIONS})"


def _members(text: str) -> str:
    return f"from_json({text}, 'map<string, string>', {_OPTIONS})"


def _named(value: str, name: str, body: str) -> str:
    """body with the value under a name, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _expression() -> str:
    """The written elements of a message, as a SQL function of z: text, message, ttl, csv, xml and the program."""
    bare = f"case when contains(x, '{iterate._MARK}') then regexp_replace(x, '\"?{iterate._MARK}([^\"]*)\"?', '$1') else x end"
    unmarked = lambda value: _named(value, "x", bare)
    literal = f"case when z.ttl then {terms.ESCAPED_SQL} else {terms.JSON_SQL} end"
    label = lambda text: f"concat('_:b', sha2(concat(z.message, ':', {text}), 256))"
    step = lambda t, s: (
        f"case when {s}.at = {MEMBER} then try_element_at({_members(t)}, {s}.name) when {s}.at >= 0 and startswith({t}, '[') then get({_list(t)}, {s}.at) end"
    )
    items = (
        f"aggregate(g.iterator, array(z.text), (ts, st) -> case when st.at = {ALL} "
        f"then flatten(filter(transform(ts, t -> case when startswith(ltrim(t), '[') then {_list('t')} end), l -> l is not null)) "
        f"else transform(ts, t -> {step('t', 'st')}) end)"
    )
    # an array and a text that looks like one are told apart by type
    listed = (
        "case when startswith(o, '[') and not z.csv then coalesce(case when startswith(schema_of_variant(variant_get(try_parse_json(item), p.text, 'variant')), 'ARRAY') "
        f"then array_distinct(transform({_list('o')}, e -> {unmarked('e')})) end, array({unmarked('o')})) end"
    )
    # what no piece asks for stays null; programs kept from before don't say it
    way = lambda text, *hows: f"case when p.ways is null or (p.ways & {sum(1 << how for how in hows)}) <> 0 then {text} end"
    value = lambda many: (
        f"named_struct('one', v, 'slot', {way(terms.SAFE_SQL, 1)}, 'literal', {way(literal, 2, 3)}, 'iri', {way(terms.REFERENCE_SQL, 4)}, 'many', {many})"
    )
    # XML elements of one name are one value or a list; an empty one is null there and an empty text here
    same = _named("try_element_at(m, st.name)", "e", f"case when startswith(e, '[') then transform({_list('e')}, x -> coalesce(x, '')) else array(coalesce(e, '')) end")
    below = _named(_members("t"), "m", f"case when map_contains_key(m, st.name) then {same} else cast(array() as array<string>) end")
    elements = lambda steps, of: f"aggregate({steps}, array({of}), (ts, st) -> flatten(transform(ts, t -> {below})))"
    own_text = _named("try_element_at(" + _members("t") + ", '_VALUE')", "e", f"case when startswith(e, '[') then try_element_at({_list('e')}, -1) else e end")
    leaf = f"case when startswith(t, '{{') then {own_text} else nullif(t, '') end"
    texts = f"transform({elements('p.steps', 'item')}, t -> replace(case when p.text is null then coalesce({leaf}, '') else {leaf} end, '{iterate._MARK}', ''))"
    several = "case when size(l) > 1 then array_distinct(l) end"
    read_xml = f"transform(g.paths, p -> {_named(texts, 'l', _named('get(l, 0)', 'v', value(several)))})"
    first = f"case when get(p.steps, 0).at = {MEMBER} then try_element_at(top, get(p.steps, 0).name) else {step('item', 'get(p.steps, 0)')} end"
    walked = f"aggregate(slice(p.steps, 2, size(p.steps)), {first}, (t, st) -> {step('t', 'st')})"
    read = f"transform(g.paths, p -> {_named(walked, 'o', _named(unmarked('o'), 'v', value(listed)))})"
    read = f"case when z.xml then {read_xml} else {read} end"
    items = f"case when z.xml then {elements('g.iterator', 'z.text')} else {items} end"

    def joined(pieces: str, values: str, each: str | None = None) -> str:
        of_each = f"when {EACH_LITERAL} then {_named(each, 'v', literal)} when {EACH_IRI} then {_named(each, 'v', terms.REFERENCE_SQL)} " if each else ""
        ways = f"when 1 then get({values}, c.at).slot when 2 then get({values}, c.at).literal when 3 then get({values}, c.at).literal when 4 then get({values}, c.at).iri "
        return f"aggregate({pieces}, '', (t, c) -> concat(t, case c.how when {PLAIN} then c.text {ways}{of_each}else get({values}, c.at).one end))"

    labels = (
        f"transform(g.labels, l -> named_struct('one', {label('concat(' + joined('l.pieces', 'r') + ", case when l.numbered then cast(i as string) else '' end)")}, "
        "'slot', cast(null as string), 'literal', cast(null as string), 'iri', cast(null as string), 'many', cast(null as array<string>)))"
    )
    ways = ["v", terms.SAFE_SQL, literal, literal, terms.REFERENCE_SQL, "v"]
    own_lists = "transform(r, x -> coalesce(x.many, case when x.one is not null then array(x.one) end))"
    label_lists = (
        "transform(g.labels, (l, j) -> case when l.numbered then array(get(b, j).one) "
        f"else transform({crossing.crossed_sql('array(get(g.label_texts, j))', 'k', ways)}, t -> {label('t')}) end)"
    )
    combined = _named(own_lists, "k", crossing.crossed_sql("g.crossed", f"concat(k, {label_lists})", ways))

    def statements(of: str) -> str:
        single = f"transform({of}.single, s -> case when s.at < 0 or get(w, s.at).many is null then {joined('s.pieces', 'w')} end)"
        several = f"flatten(transform({of}.many, s -> coalesce(transform(get(w, s.at).many, e -> {joined('s.pieces', 'w', 'e')}), cast(array() as array<string>))))"
        return f"concat({single}, {several})"

    inside = _named(f"filter({statements('y')}, t -> t is not null)", "ts", "case when size(ts) > 0 then concat(" + joined("y.name", "w") + ", array_join(ts, ','), ']') end")
    body = f"array_join(filter(transform(n.properties, y -> {inside}), t -> t is not null), '')"
    node = _named(body, "t", f"case when n.sure or t <> '' then concat({joined('n.head', 'w')}, t, '}}') end")
    written = f"case when z.ttl then {statements('g')} else transform(g.nodes, n -> {node}) end"
    meets = "exists(g.spread, s -> get(r, s).many is not null)"
    of_item = _named(_members("item"), "top", _named(read, "r", _named(labels, "b", _named("concat(r, b)", "w", f"case when {meets} then {combined} else {written} end"))))
    return f"z -> flatten(transform(z.program, g -> flatten(transform({items}, (item, i) -> {of_item}))))"


_ELEMENTS = _expression()
# Behind a start tag in front of a blank text that is all the element has.
_XML_BLANK = r"""(<[^<>/!?\s](?:[^<>"']|"[^"<]*"|'[^'<]*')*+(?<!/)>)(?=\s++</)"""
# In front of a text that isn't blank, of character data, or of an attribute's value.
_XML_TEXT = r"""(>(?=\s*+[^<\s])|<!\[CDATA\[|=\s*["'])"""


def _csv_text(payload: Column) -> Column:
    """The records of a CSV message as a JSON array of objects; of columns with one name the first counts."""
    records = F.filter(F.regexp_extract_all(payload, F.lit(iterate._CSV_RECORD), F.lit(1)), lambda r: F.trim(r) != "")

    def objects(x: Column) -> Column:
        def cell(c: Column, name: Column) -> Column:
            return F.nullif(F.try_element_at(c, F.array_position(x.getField("h"), name).cast("int")), F.lit(""))

        names = F.array_distinct(x.getField("h"))
        rows = F.slice(x.getField("rs"), F.lit(2), F.greatest(F.size(x.getField("rs")) - 1, F.lit(0)))
        return F.transform(
            F.transform(rows, iterate._csv_cells), lambda c: F.map_from_entries(F.transform(names, lambda n: F.struct(n, cell(c, n).alias("value"))))
        )

    headed = F.transform(F.array(records), lambda rs: F.struct(rs.alias("rs"), iterate._csv_cells(F.try_element_at(rs, F.lit(1))).alias("h")))
    return F.to_json(F.flatten(F.transform(headed, objects)))


def _xml_text(payload: Column) -> Column:
    """The elements of an XML message as a JSON object, its root a member like any other, each text behind a mark."""
    body = F.regexp_replace(iterate.xml_body(payload), _XML_BLANK, f"$1{iterate._MARK}")
    marked = F.regexp_replace(body, _XML_TEXT, f"$1{iterate._MARK}")
    return F.to_json(F.from_xml(F.concat(F.lit("<w>"), marked, F.lit("</w>")), "variant", iterate.XML_OPTIONS))


def document(payload: Column, message: Column, active: Column, input_format: str, output_format: str, program: str) -> tuple[dict[str, Column], Column]:
    """Helper columns, to be added in order, and then the document of rows whose mapping is data."""
    csv, xml = F.col(input_format) == "CSV", F.col(input_format) == "XML"
    text = F.when(csv, _csv_text(payload)).when(xml, _xml_text(payload)).otherwise(iterate._marked(payload))
    turtle = F.col(output_format) == "TTL"
    asked = F.struct(F.col("_text").alias("text"), message.alias("message"), turtle.alias("ttl"), csv.alias("csv"), xml.alias("xml"), F.col(program).alias("program"))
    elements = F.element_at(F.call_function("transform", F.array(asked), F.expr(_ELEMENTS)), 1)
    distinct = F.array_except(elements, F.array(F.lit(None).cast("string")))
    helpers = {"_text": F.when(active, text), "_elements": F.when(active, distinct)}
    found = F.col("_elements")
    return helpers, F.when(turtle, F.array_join(found, "")).otherwise(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")))
