"""Mapping rules to Catalyst expressions.

A mapping compiles to one array of strings per message. Each element is one triple, either packed
(six fields, for rows) or written as a Turtle line, or one JSON-LD node. All of it is row-local: no
shuffle, no Python at run time.

A triple is one `concat` whose constant parts are folded while compiling. `concat` of a null is null,
which is the rule for missing values; `array_except` then drops the nulls and repeated triples in one
hash pass over strings.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions import registry
from tripleloom.model import Mapping, MappingError, TermMap, TriplesMap, template_parts
from tripleloom.operators import crossing, iterate, terms, validate
from tripleloom.operators.conditions import CHILD, PARENT, condition
from tripleloom.session import prepare
from tripleloom.vocab import RDF, RDF_TYPE, XSD_STRING

# Separates the fields of a packed triple. It cannot occur in an IRI, a blank node label, a datatype
# or a language tag; the object text, which may hold anything, comes last.
SEP = "\x01"
LANG_STRING = RDF + "langString"


@dataclass(frozen=True)
class Atom:
    """A value computed once per item and used by any number of triples."""

    name: str


Part = str | Atom

#: Ways of writing a value, by the tag of its atom.
WAYS = ["", "slot-iri", "slot-literal", "literal", "iri", "raw"]


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple[Part, ...]
    datatype: str = ""
    lang: str = ""
    many: Atom | None = None  # all values, where the reference met an array


@dataclass
class Scope:
    """What atoms of one group may read: the item, its position, the message and its paths."""

    item: Column
    index: Column
    message: Column
    read: Callable[[Column, str], iterate.Value]
    known: dict[str, iterate.Value] = field(default_factory=dict)

    def value(self, path: str) -> iterate.Value:
        """What the path reads, built once for all that use it."""
        if path not in self.known:
            self.known[path] = self.read(self.item, path)
        return self.known[path]


@dataclass
class Group:
    """Triples maps with one iterator, compiled against the same item."""

    mapping: Mapping
    iterator: str
    maps: list[TriplesMap]
    encode: Callable[[Column], Column]
    encode_constant: Callable[[str], str]
    encode_sql: str = "v"
    atoms: dict[tuple, tuple[str, Callable[[Scope], Column]]] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)
    # by atom: the path it writes and how, or the paths of the template its label is made of
    slots: dict[str, tuple[str, int]] = field(default_factory=dict)
    labels: dict[str, list[tuple[bool, str]]] = field(default_factory=dict)
    # paths inside templates, subjects and predicates, where an array means all combinations
    spread: list[str] = field(default_factory=list)

    def atom(self, key: tuple, build: Callable[[Scope], Column]) -> Atom:
        if key not in self.atoms:
            self.atoms[key] = (f"a{len(self.atoms)}", build)
        return Atom(self.atoms[key][0])

    def path(self, path: str) -> str:
        if path not in self.paths:
            self.paths.append(path)
        return path

    # --- term maps ------------------------------------------------------------------------------

    def text(self, term: TermMap, owner: TriplesMap) -> Callable[[Scope], Column]:
        """The bare text of a term, for blank node labels and function arguments."""
        if term.kind == "constant":
            return lambda s: F.lit(term.value)
        if term.kind == "reference":
            path = self.path(term.value)
            return lambda s: s.value(path).one
        if term.kind == "template":
            pieces = template_parts(term.value)
            for is_slot, piece in pieces:
                if is_slot:
                    self.path(piece)
            return lambda s: F.concat(
                F.lit(""), *[s.value(piece).one if is_slot else F.lit(piece) for is_slot, piece in pieces]
            )
        if term.kind == "function":
            args = {name: self.text(arg, owner) for name, arg in term.args}
            return lambda s: registry.apply(term.value, {name: build(s) for name, build in args.items()})
        raise MappingError(f"{term.kind!r} has no text of its own")

    def node(self, term: TermMap, owner: TriplesMap) -> Node:
        if term.kind == "parent":
            other = self.mapping.triples_map(term.value)
            return self.node(other.subject, other)
        kind = term.node_kind
        if kind == "bnode":
            if term.kind == "blank":
                build = lambda s: F.concat(F.lit(owner.id + ":"), s.index.cast("string"))
                key = ("bnode", owner.id)
            else:
                build, key = self.text(term, owner), ("bnode", term.kind, term.value, term.args)
            label = self.atom(key, lambda s: terms.blank_label(s.message, build(s)))
            if term.kind in ("template", "reference"):
                self.labels[label.name] = template_parts(term.value) if term.kind == "template" else [(True, term.value)]
            return Node("bnode", (label,))
        if kind == "iri":
            encode, constant, tag = terms.iri_reference, terms.iri_constant, "iri"
            datatype = lang = ""
        else:
            encode, constant, tag = self.encode, self.encode_constant, "literal"
            lang = term.lang or ""
            datatype = LANG_STRING if lang else term.datatype or XSD_STRING
        if term.kind == "constant":
            return Node(kind, (constant(term.value),), datatype, lang)
        if term.kind == "template":
            slot = terms.iri_safe if kind == "iri" else encode
            parts = tuple(
                self.slot(piece, slot, "slot-" + tag) if is_slot else constant(piece)
                for is_slot, piece in template_parts(term.value)
            )
            return Node(kind, parts, datatype, lang)
        if term.kind == "reference":
            path = self.path(term.value)
            one = self.slot(path, encode, tag)
            many = self.atom(("many", path), lambda s: _many(s.value(path))) if self.mapping.expand_arrays else None
            return Node(kind, (one,), datatype, lang, many)
        if term.kind == "function":
            build = self.text(term, owner)
            return Node(kind, (self.atom((tag, term), lambda s: encode(build(s))),), datatype, lang)
        raise MappingError(f"unknown term map kind {term.kind!r}")

    def slot(self, path: str, encode: Callable[[Column], Column], tag: str) -> Atom:
        self.path(path)
        made = self.atom((tag, path), lambda s: encode(s.value(path).one))
        self.slots[made.name] = (path, WAYS.index(tag))
        return made

    def key(self, term: TermMap, owner: TriplesMap) -> Node:
        """The bare text of a term as a node, for join keys."""
        if term.kind == "reference":
            return Node("literal", (self.slot(term.value, lambda c: c, "raw"),))
        if term.kind == "template":
            pieces = template_parts(term.value)
            return Node("literal", tuple(self.slot(piece, lambda c: c, "raw") if is_slot else piece for is_slot, piece in pieces))
        build = self.text(term, owner)
        return Node("literal", (self.atom(("key", term), build),))

    # --- triples --------------------------------------------------------------------------------

    def learn(self) -> None:
        """Collect the atoms and paths all statements need, before any expression is built."""
        for tm in self.maps:
            for s, p, o in self.statements(tm):
                self.spread_over(s, p, *([o] if o.many is None else []))

    def spread_over(self, *nodes: Node) -> None:
        """From now on an array in these nodes means all combinations."""
        for part in (part for node in nodes for part in node.parts if isinstance(part, Atom)):
            inside = [self.slots[part.name][0]] if part.name in self.slots else [x for is_slot, x in self.labels.get(part.name, ()) if is_slot]
            self.spread += [x for x in inside if x not in self.spread]

    def meets_array(self, scope: Scope) -> Column | None:
        """Does a path inside a template, a subject or a predicate hold several values? None where none can."""
        found = [scope.value(path) for path in self.spread] if self.mapping.expand_arrays else []
        tests = [F.coalesce(v.is_many, F.lit(False)) for v in found if v.many is not None]
        return functools.reduce(lambda a, b: a | b, tests) if tests else None

    def values(self, scope: Scope, atom: Callable[[str], Column]) -> Column:
        """The lists that statement() refers to: of every path, then of every atom that isn't a path's."""

        def listed(path: str) -> Column:
            v = scope.value(path)
            one = F.when(v.one.isNotNull(), F.array(v.one))
            return one if v.many is None else F.when(v.is_many, F.array_distinct(v.many)).otherwise(one)

        def labelled(pieces: list[tuple[bool, str]]) -> Column:
            def longer(texts: Column, values: Column) -> Column:
                return F.flatten(F.transform(texts, lambda t: F.transform(values, lambda x: F.concat(t, x))))

            texts = F.array(F.lit(""))
            for is_slot, piece in pieces:
                texts = longer(texts, listed(piece) if is_slot else F.array(F.lit(piece)))
            return F.transform(texts, lambda t: terms.blank_label(scope.message, t))

        own = [name for name, _ in self.atoms.values() if name not in self.slots]
        columns = [labelled(self.labels[a]) if a in self.labels else F.array(atom(a).cast("string")) for a in own if not self._is_many(a)]
        return F.array(*[listed(p) for p in self.paths], *columns)

    def _is_many(self, name: str) -> bool:
        return any(key[0] == "many" for key, (n, _) in self.atoms.items() if n == name)

    def statement(self, parts: list[Part]) -> list[crossing.Piece]:
        """A written statement as pieces; atoms are named term:atom."""
        own = [name for name, _ in self.atoms.values() if name not in self.slots and not self._is_many(name)]

        def piece(part: Part) -> crossing.Piece:
            if isinstance(part, str):
                return part
            term, _, name = part.name.partition(":")
            if name in self.slots:
                path, how = self.slots[name]
                return (term, self.paths.index(path), how)
            return (term, len(self.paths) + own.index(name), 0)

        return [piece(p) for p in parts]

    def crossed(self, statements: list[list[Part]], values: Column, around: str = "{}") -> Column:
        ways = ["v", terms.SAFE_SQL, self.encode_sql, self.encode_sql, terms.REFERENCE_SQL, "v"]
        ways = [around.format(way) for way in ways]
        return crossing.crossed(crossing.literal([self.statement(parts) for parts in statements]), values, ways)

    def statements(self, tm: TriplesMap) -> list[tuple[Node, Node, Node]]:
        """(subject, predicate, object) of one triples map; objects found by a join are not here."""
        subject = self.node(tm.subject, tm)
        out = [(subject, Node("iri", (RDF_TYPE,)), Node("iri", (terms.iri_constant(c),))) for c in tm.classes]
        for pom in tm.predicate_objects:
            for p in pom.predicates:
                for o in pom.objects:
                    if not self.mapping.is_linked(tm, o):
                        out.append((subject, self.node(p, tm), self.node(o, tm)))
        return list(dict.fromkeys(out))


def _many(value: iterate.Value) -> Column:
    if value.many is None:
        return F.lit(None).cast("array<string>")
    return F.when(value.is_many, F.array_distinct(value.many))


def _join_parts(parts: list[Part], resolve: Callable[[Atom], Column]) -> Column:
    """One concat, neighbouring constants folded."""
    merged: list[Part] = []
    for part in parts:
        if isinstance(part, str) and merged and isinstance(merged[-1], str):
            merged[-1] += part
        elif part != "":
            merged.append(part)
    columns = [F.lit(p) if isinstance(p, str) else resolve(p) for p in merged]
    return F.concat(*columns) if columns else F.lit("")


# --- the three written forms --------------------------------------------------------------------


def _packed(s: Node, p: Node, o: Node) -> list[Part]:
    return [*s.parts, SEP, *p.parts, SEP, o.kind, SEP, o.datatype, SEP, o.lang, SEP, *o.parts]


def _turtle_term(node: Node) -> list[Part]:
    if node.kind == "iri":
        return ["<", *node.parts, ">"]
    if node.kind == "bnode":
        return list(node.parts)
    tail = f"@{node.lang}" if node.lang else "" if node.datatype == XSD_STRING else f"^^<{node.datatype}>"
    return ['"', *node.parts, '"' + tail]


def _turtle(s: Node, p: Node, o: Node) -> list[Part]:
    return [*_turtle_term(s), " ", *_turtle_term(p), " ", *_turtle_term(o), " .\n"]


def _jsonld_value(o: Node, as_type: bool) -> list[Part]:
    if as_type:
        return ['"', *o.parts, '"']
    if o.kind != "literal":
        return ['{"@id":"', *o.parts, '"}']
    tail = f',"@language":"{o.lang}"' if o.lang else "" if o.datatype == XSD_STRING else f',"@type":"{o.datatype}"'
    return ['{"@value":"', *o.parts, '"' + tail + "}"]


def _one_or_many(parts: Callable[[Node], list[Part]], o: Node, group: Group, resolve) -> tuple[Column, Column | None]:
    """(value for one object, array of values where the reference met an array)."""
    one = _join_parts(parts(o), resolve)
    if o.many is None:
        return one, None
    encode = terms.iri_reference if o.kind == "iri" else group.encode
    mark = Atom("\x00each")

    def each(x: Column) -> Column:
        node = Node(o.kind, (mark,), o.datatype, o.lang)
        return _join_parts(parts(node), lambda a: encode(x) if a == mark else resolve(a))

    return one, F.transform(resolve(o.many), each)


def _triples_of(group: Group, write: Callable[[Node, Node, Node], list[Part]], resolve) -> Column:
    single, arrays = [], []
    for tm in group.maps:
        for s, p, o in group.statements(tm):
            one, many = _one_or_many(lambda node, s=s, p=p: write(s, p, node), o, group, resolve)
            if many is None:
                single.append(one)
            else:
                # the value is missing from the first array exactly when there are many
                single.append(F.when(resolve(o.many).isNull(), one))
                arrays.append(F.coalesce(many, F.array().cast("array<string>")))
    first = F.array(*single) if single else F.array().cast("array<string>")
    return F.concat(first, *arrays) if arrays else first


def _nodes_of(group: Group, resolve) -> Column:
    """One JSON-LD node object per triples map: properties grouped while compiling."""
    nodes = []
    for tm in group.maps:
        statements = group.statements(tm)
        by_property: dict[tuple[Part, ...], list[tuple[Node, bool]]] = {}
        subject = group.node(tm.subject, tm)
        for _, p, o in statements:
            as_type = p.parts == (RDF_TYPE,) and o.kind != "literal"
            key = ("@type",) if as_type else p.parts
            by_property.setdefault(key, []).append((o, as_type))
        properties, sure = [], False
        for key, objects in by_property.items():
            values, arrays = [], []
            for o, as_type in objects:
                one, many = _one_or_many(lambda node, t=as_type: _jsonld_value(node, t), o, group, resolve)
                values.append(one if many is None else F.when(resolve(o.many).isNull(), one))
                if many is not None:
                    arrays.append(F.array_join(many, ","))
                sure |= all(isinstance(part, str) for part in (*o.parts, *key))
            name = _join_parts([',"', *key, '":['], resolve)
            if len(values) == 1:
                inside = F.coalesce(*arrays, *values) if arrays else values[0]
            else:
                joined = F.concat_ws(",", *values, *arrays)
                inside = F.when(joined != "", joined)
            properties.append(F.concat(name, inside, F.lit("]")))
        head = _join_parts(['{"@id":"', *subject.parts, '"'], resolve)
        body = F.concat_ws("", *properties) if properties else F.lit("")
        node = F.concat(head, body, F.lit("}"))
        nodes.append(node if sure else F.when(body != "", node))
    return F.array(*nodes)


@dataclass(frozen=True)
class Form:
    """One way of writing: literal encoding, all elements of a group, one joined statement."""

    encode: Callable[[Column], Column]
    encode_constant: Callable[[str], str]
    elements: Callable[[Group, Callable[[Atom], Column]], Column]
    link: Callable[..., Column]
    write: Callable[[Node, Node, Node], list[Part]]
    encode_sql: str

    def crossed(self, group: Group, values: Column) -> Column:
        """All elements of a group where arrays stand inside templates, subjects or predicates: one for each combination."""
        statements = [self.write(*(_of_term(n, x) for n, x in zip(nodes, "spo"))) for tm in group.maps for nodes in group.statements(tm)]
        return group.crossed(statements, values)


def _json_inside(value: Column) -> Column:
    quoted = terms.json_quote(value)
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _json_constant(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)[1:-1]


# How the fields of a row are kept apart while its combinations are written.
_KEPT = r"replace(replace({}, '\u0002', '\u0002b'), '\u0001', '\u0002a')"


def side_items(group: Group, nodes: dict[str, Node], found: iterate.Items, message: Column, every: list[str]) -> Column:
    """The rows of all items of a side; the plain way, where it is open, meets no arrays."""
    rows = F.flatten(F.transform(found.column, lambda item, i: side_rows(group, nodes, Scope(item, i, message, found.read), every)))
    if found.plain is None:
        return rows
    plain = found.plain
    return F.coalesce(F.transform(plain.column, lambda item, i: _side_row(group, nodes, Scope(item, i, message, plain.read), every)[0]), rows)


def _side_row(group: Group, nodes: dict[str, Node], scope: Scope, every: list[str]) -> tuple[Column, dict[str, Column]]:
    atoms = {a: build(scope) for a, build in group.atoms.values()}
    none = F.lit(None).cast("string")
    texts = {f: _join_parts(list(n.parts), lambda a: atoms[a.name]) for f, n in nodes.items()}
    return F.struct(*[texts.get(f, none).alias(f) for f in every]), atoms


def side_rows(group: Group, nodes: dict[str, Node], scope: Scope, every: list[str]) -> Column:
    """The fields of one side of a join as an array of rows: one, or where arrays are met every combination. Fields not in nodes are null."""
    row_, atoms = _side_row(group, nodes, scope, every)
    one, none = F.array(row_), F.lit(None).cast("string")
    several = group.meets_array(scope)
    if several is None:
        return one
    kept = [replace(n, parts=tuple(x if isinstance(x, Atom) else x.replace("\x02", "\x02b").replace("\x01", "\x02a") for x in n.parts)) for n in nodes.values()]
    parts = [part for f, n in zip(nodes, kept) for part in (*_of_term(n, f).parts, SEP)]

    def row(text: Column) -> Column:
        cut = F.split(text, SEP)
        back = {f: F.replace(F.replace(cut[i], F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02")) for i, f in enumerate(nodes)}
        return F.struct(*[back.get(f, none).alias(f) for f in every])

    written = F.filter(group.crossed([parts], group.values(scope, lambda a: atoms[a]), _KEPT), lambda t: t.isNotNull())
    return F.when(several, F.transform(written, row)).otherwise(one)


def _of_term(node: Node, term: str) -> Node:
    return replace(node, parts=tuple(Atom(f"{term}:{x.name}") if isinstance(x, Atom) else x for x in node.parts))


def _link(write: Callable[[Node, Node, Node], list[Part]]):
    """A statement whose subject and predicate come from one item and whose object from another."""

    def link(s: Node, p: Node, o: Node, child: Callable[[Atom], Column], other: Callable[[Atom], Column]) -> Column:
        renamed = Node(o.kind, tuple(Atom("o:" + x.name) if isinstance(x, Atom) else x for x in o.parts))
        return _join_parts(
            write(s, p, renamed), lambda a: other(Atom(a.name[2:])) if a.name.startswith("o:") else child(a)
        )

    return link


def _jsonld_link(s: Node, p: Node, o: Node) -> list[Part]:
    return ['{"@id":"', *s.parts, '","', *p.parts, '":[', *_jsonld_value(o, False), "]}"]


ROWS = Form(lambda c: c, lambda t: t, lambda g, r: _triples_of(g, _packed, r), _link(_packed), _packed, "v")
TURTLE = Form(terms.escape_literal, terms.escape_constant, lambda g, r: _triples_of(g, _turtle, r), _link(_turtle), _turtle, terms.ESCAPED_SQL)
JSONLD = Form(_json_inside, _json_constant, _nodes_of, _link(_jsonld_link), _jsonld_link, terms.JSON_SQL)


# --- onto a DataFrame ---------------------------------------------------------------------------


def groups_of(mapping: Mapping, form: Form) -> list[Group]:
    by_iterator: dict[str, list[TriplesMap]] = {}
    for tm in mapping.triples_maps:
        by_iterator.setdefault(tm.iterator, []).append(tm)
    return [Group(mapping, it, tms, form.encode, form.encode_constant, form.encode_sql) for it, tms in by_iterator.items()]


def with_elements(
    df: DataFrame,
    mapping: Mapping,
    form: Form,
    name: str,
    payload: Column,
    active: Column,
    message: Column,
    join_here: list | None = None,
) -> DataFrame:
    """Add column `name`: the distinct written triples (or nodes) of each message.

    The join rules in `join_here` are looked up inside the row; others are left out.

    Items and atoms become columns of their own, so that what several triples share (the parsed
    message, an encoded identifier) is computed once; higher-order functions have no common
    subexpression elimination.
    """
    text = f"{name}_t"
    helpers: list[str] = [text]
    arrays: list[Column] = []
    df = df.withColumn(text, iterate.prepared(F.when(active, payload), mapping.input_format))
    for g, group in enumerate(groups_of(mapping, form)):
        group.learn()
        found = iterate.items(F.col(text), mapping.input_format, group.iterator, group.paths, ready=True)
        if not found.is_array:
            item = f"{name}_i{g}"
            scope = Scope(F.col(item), F.lit(0), message, found.read)
            names = {a: f"{name}_a{g}_{a}" for a, _ in group.atoms.values()}
            df = df.withColumn(item, found.column)
            df = df.withColumns({names[a]: build(scope) for a, build in group.atoms.values()})
            helpers += [item, *names.values()]
            elements = form.elements(group, lambda x: F.col(names[x.name]))
            several = group.meets_array(scope)
            if several is not None:
                flag, values = f"{name}_m{g}", f"{name}_v{g}"
                df = df.withColumn(flag, several)
                df = df.withColumn(values, F.when(F.col(flag), group.values(scope, lambda a: F.col(names[a]))))
                helpers += [flag, values]
                elements = F.when(F.col(flag), form.crossed(group, F.col(values))).otherwise(elements)
            arrays.append(elements)
            continue
        if found.plain is None:
            df, elements = _array_elements(df, group, form, found, message, f"{name}_c{g}", helpers)
        else:
            quick, simple = f"{name}_q{g}", f"{name}_s{g}"
            df = df.withColumn(quick, found.plain.column).withColumn(simple, F.col(quick).isNotNull())
            helpers += [quick, simple]
            scalar = Group(replace(mapping, expand_arrays=False), group.iterator, group.maps, form.encode, form.encode_constant, form.encode_sql)
            scalar.learn()
            plain = replace(found.plain, column=F.col(quick))
            df, quick_elements = _array_elements(df, scalar, form, plain, message, f"{name}_p{g}", helpers)
            rest = F.when(~F.col(simple), F.col(text))
            careful = iterate.items(rest, mapping.input_format, group.iterator, group.paths, ready=True)
            df, careful_elements = _array_elements(df, group, form, careful, message, f"{name}_c{g}", helpers)
            elements = F.when(F.col(simple), quick_elements).otherwise(careful_elements)
        arrays.append(elements)
    if join_here:
        df, joined = _local_joins(df, mapping, form, name, F.col(text), message, helpers, join_here)
        arrays += joined
    empty = F.array().cast("array<string>")
    everything = [F.coalesce(a, empty) for a in arrays]
    joined = F.concat(*everything) if len(everything) > 1 else everything[0]
    distinct = F.array_except(joined, F.array(F.lit(None).cast("string")))
    return df.withColumn(name, F.when(active, distinct).otherwise(empty)).drop(*helpers)


def _array_elements(
    df: DataFrame, group: Group, form: Form, found: iterate.Items, message: Column, atoms: str, helpers: list[str]
) -> tuple[DataFrame, Column]:
    """Atoms of every item as a column, and the elements written from them."""

    def atoms_of(item: Column, index: Column) -> Column:
        scope = Scope(item, index, message, found.read)
        several = group.meets_array(scope)
        built = {a: build(scope) for a, build in group.atoms.values()}
        values = [] if several is None else [F.when(several, group.values(scope, lambda a: built[a])).alias("values")]
        return F.struct(F.lit(True).alias("is_item"), *values, *[c.alias(a) for a, c in built.items()])

    def elements_of(a: Column) -> Column:
        single = form.elements(group, lambda x: a.getField(x.name))
        if not spreads:
            return single
        return F.when(a.getField("values").isNotNull(), form.crossed(group, a.getField("values"))).otherwise(single)

    spreads = group.meets_array(Scope(F.lit(None), F.lit(0), message, found.read)) is not None
    df = df.withColumn(atoms, F.transform(found.column, atoms_of))
    helpers.append(atoms)
    return df, F.flatten(F.transform(F.col(atoms), elements_of))


def _local_joins(
    df: DataFrame, mapping: Mapping, form: Form, name: str, payload: Column, message: Column, helpers: list[str], rules: list
) -> tuple[DataFrame, list[Column]]:
    """Join conditions inside one message, by looking each child's keys up among the parents.

    The look-up compares every child with every parent, which is one comparison an item where there is one child or one
    parent. Rules with several on both sides come last, sorted, as documents_with_joins writes them.
    """
    arrays, sorted_last, outers = [], [], {}
    for n, (tm, p, o) in enumerate(rules):
        if shared := nested(mapping, tm, o):
            if shared[0] not in outers:
                outers[shared[0]] = f"{name}_u{n}"
                helpers.append(outers[shared[0]])
                df = df.withColumn(outers[shared[0]], iterate.items(payload, mapping.input_format, shared[0], [], ready=True).column)
            arrays.append(_under_shared_item(mapping, form, F.col(outers[shared[0]]), message, (tm, p, o), shared))
            continue
        other, asked = mapping.triples_map(o.value), condition(o)
        sides = []
        for label, owner, nodes, keys, parts in (
            ("l", tm, {"s": tm.subject, "p": p}, [c for c, _ in asked.keys], asked.parts(CHILD)),
            ("r", other, {"o": other.subject}, [q for _, q in asked.keys], asked.parts(PARENT)),
        ):
            group = Group(mapping, owner.iterator, [owner], form.encode, form.encode_constant, form.encode_sql)
            made = {x: group.node(t, owner) for x, t in nodes.items()}
            fields = made | {f"{x}{i}": group.key(t, owner) for x, of in (("k", keys), ("x", parts)) for i, t in enumerate(of)}
            group.spread_over(*fields.values())
            found = iterate.items(payload, mapping.input_format, owner.iterator, group.paths, ready=True)

            def row(read, item: Column, index: Column) -> Column:
                return side_rows(group, fields, Scope(item, index, message, read), list(fields))

            column = f"{name}_{label}{n}"
            if found.is_array:
                df = df.withColumn(column, side_items(group, fields, found, message, list(fields)))
            else:
                df = df.withColumn(column + "_i", found.column)
                df = df.withColumn(column, row(found.read, F.col(column + "_i"), F.lit(0)))
                helpers.append(column + "_i")
            helpers.append(column)
            # the texts are written on their side
            sides.append((column, [replace(n, parts=(Atom(x),)) for x, n in made.items()]))
        (left, (s_node, p_node)), (right, (o_node,)) = sides

        def of_message(both: Column) -> Column:
            def of_child(c: Column) -> Column:
                def meets(q: Column) -> Column:
                    test = F.lit(True)  # without a condition there is one parent
                    for i in range(len(asked.keys)):
                        test = test & (q.getField(f"k{i}") == c.getField(f"k{i}"))
                    if asked.tests:
                        test = test & asked.holds(lambda i: c.getField(f"x{i}"), lambda i: q.getField(f"x{i}"))
                    return test

                def written(q: Column) -> Column:
                    return form.link(s_node, p_node, o_node, lambda a: c.getField(a.name), lambda a: q.getField(a.name))

                return F.transform(F.filter(both.getField("parents"), meets), written)

            return F.flatten(F.transform(both.getField("children"), of_child))

        # A one-element transform holds both sides. Named inside the children's function as a column,
        # the parents could be put there as an expression and be parsed again for every child.
        sides_of = F.struct(F.col(left).alias("children"), F.col(right).alias("parents"))
        found = F.element_at(F.transform(F.array(sides_of), of_message), 1)
        near = mapping.one_item(tm) or mapping.one_item(other)
        (arrays if near else sorted_last).append(found)
    if sorted_last:
        empty = F.array().cast("array<string>")
        everything = [F.coalesce(a, empty) for a in sorted_last]
        arrays.append(F.sort_array(F.array_distinct(F.concat(*everything) if len(everything) > 1 else everything[0])))
    return df, arrays


def nested(mapping: Mapping, tm: TriplesMap, o: TermMap) -> tuple[str, str, str] | None:
    """For a parent without a condition that has several items in a message: the item it shares with the child, see Mapping.shared_item()."""
    other = mapping.triples_map(o.value)
    return None if o.conditional or mapping.one_item(other) else mapping.shared_item(tm, other)


def _under_shared_item(
    mapping: Mapping, form: Form, outer: Column, message: Column, rule: tuple[TriplesMap, TermMap, TermMap], shared: tuple[str, str, str]
) -> Column:
    """Links of the children and the parents that lie in one item of their common iterator: those whose indexes agree up to there."""
    tm, p, o = rule
    other = mapping.triples_map(o.value)

    def side(text: Column, owner: TriplesMap, rest: str, terms_: dict[str, TermMap]) -> tuple[Column, dict[str, Node]]:
        group = Group(mapping, rest, [owner], form.encode, form.encode_constant, form.encode_sql)
        made = {x: group.node(t, owner) for x, t in terms_.items()}
        group.spread_over(*made.values())
        found = iterate.items(text, mapping.input_format, rest, group.paths, ready=True)

        def row(read, item: Column, index: Column) -> Column:
            return side_rows(group, made, Scope(item, index, message, read), list(made))

        if found.is_array:
            rows = side_items(group, made, found, message, list(made))
        else:  # a one-element transform names the item, so that it is parsed once
            rows = F.element_at(F.transform(F.array(found.column), lambda item: row(found.read, item, F.lit(0))), 1)
        return rows, {x: replace(n, parts=(Atom(x),)) for x, n in made.items()}

    def of_outer(item: Column) -> Column:
        text = item.getField("t")
        children, child_nodes = side(text, tm, shared[1], {"s": tm.subject, "p": p})
        parents, parent_nodes = side(text, other, shared[2], {"o": other.subject})

        def of_pair(both: Column) -> Column:
            def written(c: Column, q: Column) -> Column:
                return form.link(child_nodes["s"], child_nodes["p"], parent_nodes["o"], lambda a: c.getField(a.name), lambda a: q.getField(a.name))

            return F.flatten(F.transform(both.getField("c"), lambda c: F.transform(both.getField("q"), lambda q: written(c, q))))

        return F.element_at(F.transform(F.array(F.struct(children.alias("c"), parents.alias("q"))), of_pair), 1)

    return F.flatten(F.filter(F.transform(outer, of_outer), lambda x: x.isNotNull()))


def join_conditions(mapping: Mapping) -> list[tuple[TriplesMap, TermMap, TermMap]]:
    """(triples map, predicate, parent object) of every rule that links two items: by a join condition, or with a parent of its own iterator."""
    return [
        (tm, p, o)
        for tm in mapping.triples_maps
        for pom in tm.predicate_objects
        for p in pom.predicates
        for o in pom.objects
        if mapping.is_linked(tm, o)
    ]


TRIPLE_COLUMNS = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")


def unpack(df: DataFrame, packed: str, *keep: str) -> DataFrame:
    """One row per packed triple.

    The outer explode keeps Catalyst from adding a size filter that would build the array twice.
    """
    rows = df.select(*keep, F.explode_outer(packed).alias("_t")).where("_t is not null")
    rows = rows.withColumn("_f", F.split("_t", SEP, 6))
    part = [F.col("_f").getItem(i) for i in range(6)]
    return rows.select(
        *keep,
        part[0].alias("s"),
        part[1].alias("p"),
        part[5].alias("o"),
        part[2].alias("o_kind"),
        F.nullif(part[3], F.lit("")).alias("o_datatype"),
        F.nullif(part[4], F.lit("")).alias("o_lang"),
    )


def _active(df: DataFrame, mapping: Mapping, payload: str, check: bool) -> DataFrame:
    prepare(df.sparkSession)
    test = validate.is_valid(F.col(payload), mapping.input_format) if check else F.col(payload).isNotNull()
    return df.withColumn("_ok", test)


def triples(
    df: DataFrame, mapping: Mapping, payload: str = "payload", key: str = "msg_id", check: bool = True
) -> DataFrame:
    """One row per triple: message key, s, p, o, o_kind, o_datatype, o_lang.

    The triples of one message are a set; equal triples of different messages stay apart. Messages
    that are not well-formed give no rows.
    """
    if mapping.has_joins:
        from tripleloom.operators.joins import triples_with_joins

        return triples_with_joins(df, mapping, payload, key, check)
    return unpack(packed(df.select(key, payload), mapping, payload, key, check), "_packed", key)


def packed(
    df: DataFrame, mapping: Mapping, payload: str, key: str, check: bool, join_here: list | None = None
) -> DataFrame:
    """Add `_packed`: the triples of each message as packed strings."""
    base = _active(df, mapping, payload, check)
    message = F.col(key).cast("string")
    return with_elements(base, mapping, ROWS, "_packed", F.col(payload), F.col("_ok"), message, join_here)


def document_column(elements: Column, output_format: str) -> Column:
    if output_format == "TTL":
        return F.array_join(elements, "")
    return F.concat(F.lit("["), F.array_join(elements, ","), F.lit("]"))


def documents(
    df: DataFrame,
    mapping: Mapping,
    payload: str = "payload",
    key: str = "msg_id",
    check: bool = True,
) -> DataFrame:
    """Add `doc` (one document per message, empty when there are no triples) and `error`."""
    if mapping.has_joins:
        from tripleloom.operators.joins import documents_with_joins

        return documents_with_joins(df, mapping, payload, key, check)
    return finished(with_document_elements(df, mapping, payload, key, check), mapping)


def with_document_elements(
    df: DataFrame, mapping: Mapping, payload: str, key: str, check: bool, join_here: list | None = None
) -> DataFrame:
    """Add `_ok` and `_elements`: the lines or nodes of each message's document."""
    form = TURTLE if mapping.output_format == "TTL" else JSONLD
    base = _active(df, mapping, payload, check)
    message = F.col(key).cast("string")
    return with_elements(base, mapping, form, "_elements", F.col(payload), F.col("_ok"), message, join_here)


def finished(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Turn `_ok` and `_elements` into `doc` and `error`."""
    doc = document_column(F.col("_elements"), mapping.output_format)
    return (
        df.withColumn("doc", F.when(F.col("_ok"), doc))
        .withColumn("error", F.when(~F.col("_ok"), validate.error_text(mapping.input_format)))
        .drop("_ok", "_elements")
    )
