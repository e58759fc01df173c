"""Iterators: one message payload becomes one item, or an array of items, read by path.

Each format gives the same two things: a column with the item (or the array of items), and for every
reference path a way to read it from one item. Everything stays inside the message's own row, so
iterating needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.model import MappingError


@dataclass(frozen=True)
class Value:
    """One reference read from one item.

    `one` is the value when there is just one. Where `is_many` holds, `many` has all of them.
    """

    one: Column
    many: Column | None = None
    is_many: Column | None = None


@dataclass(frozen=True)
class Items:
    """The items of a message, and how to read a reference from one.

    `plain` is a second, cheaper way that is right only where its own column is not null: messages
    whose items all have the expected shape and no reference that meets an array.
    """

    column: Column
    is_array: bool
    read: Callable[[Column, str], Value]
    plain: Items | None = None

    def rows(self, build: Callable[[Callable[[Column, str], Value], Column, Column], Column]) -> Column:
        """An array with build(read, item, index) for every item, the plain way where it is open."""
        careful = F.transform(self.column, lambda it, i: build(self.read, it, i))
        if self.plain is None:
            return careful
        plain = self.plain
        return F.coalesce(F.transform(plain.column, lambda it, i: build(plain.read, it, i)), careful)


# --- paths --------------------------------------------------------------------------------------

_STEP = re.compile(r"\.?([^.\[\]'\"*@()?$ ][^.\[\]'\"*()?$]*)|\[['\"]([^'\"]+)['\"]\]|\[(\d+)\]|(\[\*\])")


def json_steps(path: str) -> list[str | int]:
    """Steps of a simple JSONPath: names, indexes and '*'. Anything else is refused."""
    text = path[1:] if path.startswith("$") else path
    steps: list[str | int] = []
    at = 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise MappingError(f"unsupported JSONPath {path!r}")
        name = m.group(1) or m.group(2)
        steps.append(name if name is not None else int(m.group(3)) if m.group(3) else "*")
        at = m.end()
    return steps


def json_path(steps: list[str | int]) -> str:
    """The path of some steps."""
    return "$" + "".join("[*]" if s == "*" else f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _field(name: str):
    return lambda element: element.getField(name)


def _flat(arrays: Column) -> Column:
    """One array of all elements; an array that is missing counts as empty."""
    return F.flatten(F.filter(arrays, lambda a: a.isNotNull()))


def _json_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


# --- JSON ---------------------------------------------------------------------------------------

# Spark's JSON functions give a number with a fraction or an exponent as they would print it. So that its own form
# stays, it is turned into a text with a private-use mark before the message is parsed, and the mark is taken off what is read.
_MARK = "\ue0a3\ue0b5"
_MAYBE_FLOAT = r"[:,\[\s]-?[0-9]+[.eE]"
# From the end of the last match on: whole strings, whole numbers and anything else, then a number that isn't whole.
_FLOAT = (
    r'\G((?:[^"0-9\-]++|"(?:[^"\\]++|\\.)*+"|-?[0-9]++(?![0-9.eE]))*+)'
    r"(-?[0-9]++(?:\.[0-9]++)?(?:[eE][+\-]?[0-9]++)?)"
)


def _marked(payload: Column) -> Column:
    return F.when(payload.rlike(_MAYBE_FLOAT), F.regexp_replace(payload, _FLOAT, f'$1"{_MARK}$2"')).otherwise(payload)


def _unmarked(value: Column) -> Column:
    return (
        F.when(~value.contains(_MARK), value)
        .when(~value.contains('"'), F.replace(value, F.lit(_MARK), F.lit("")))
        .otherwise(F.regexp_replace(value, f'"?{_MARK}([^"]*)"?', "$1"))
    )


# Texts and numbers of any length.
JSON_OPTIONS = {"maxStringLen": "2147483647", "maxNumLen": "2147483647"}


def _json_tree(paths: list[list[str]]) -> dict:
    tree: dict = {}
    for steps in paths:
        node = tree
        for step in steps:
            node = node.setdefault(step, {})
    return tree


def _json_ddl(tree: dict) -> str:
    return ", ".join(f"{_quote(k)} {'struct<' + _json_fields(v) + '>' if v else 'string'}" for k, v in tree.items())


def _json_fields(tree: dict) -> str:
    return ", ".join(f"{_quote(k)}: {'struct<' + _json_fields(v) + '>' if v else 'string'}" for k, v in tree.items())


def _in_one_parse(paths: list[list[str | int]]) -> list[list[str]]:
    """Paths a single typed parse can serve.

    Left out are indexed paths, a path that is also the prefix of another one, and names that differ
    only by case (struct fields are resolved without case). Those are read one by one.
    """
    chosen: list[list[str]] = []
    for steps in paths:
        if any(isinstance(s, int) for s in steps):
            continue
        clash = False
        for other in chosen:
            common = list(zip(steps, other))
            if all(a == b for a, b in common):
                clash = True
            for a, b in common:
                if a != b:
                    clash |= a.lower() == b.lower()
                    break
        if not clash:
            chosen.append(steps)
    return chosen


def json_items(payload: Column, iterator: str, references: list[str], ready: bool = False) -> Items:
    payload = payload if ready else _marked(payload)
    steps = json_steps(iterator)
    paths = []
    for ref in references:
        if json_steps(ref) not in paths:
            paths.append(json_steps(ref))
    if any("*" in p for p in paths):
        raise MappingError("a reference may not hold '*'; arrays are expanded by themselves")
    typed = _in_one_parse(paths)
    needs_text = len(typed) < len(paths)
    ddl = _json_ddl(_json_tree(typed)) or "`_` string"
    struct = "struct<" + (_json_fields(_json_tree(typed)) or "`_`: string") + ">"

    def item_of(text: Column) -> Column:
        # the text itself is kept for the array test and for paths outside the typed parse
        parsed = F.array(F.struct(*([F.from_json(text, ddl, JSON_OPTIONS).alias("f")] if typed else []), text.alias("t")))
        # one-element transforms name the parse and what it gives, so that every reference is read once an item
        raw = F.transform(parsed, lambda x: F.struct(x.getField("t").alias("t"), *[raw_of(x, at).alias(f"r{i}") for i, at in enumerate(paths)]))
        values = F.transform(raw, lambda x: F.struct(x.getField("t").alias("t"), *[_unmarked(x.getField(f"r{i}")).alias(f"v{i}") for i in range(len(paths))]))
        return F.element_at(values, 1)

    def raw_of(item: Column, at: list[str | int]) -> Column:
        if at in typed:
            one = item.getField("f")
            for step in at:
                one = one.getField(step)
            return one
        text = item.getField("t")
        if not isinstance(at[-1], int):
            return F.get_json_object(text, _json_path(at))
        # get_json_object gives a null element as a text
        whole = F.array(text if len(at) == 1 else F.get_json_object(text, _json_path(at[:-1])))
        found = F.transform(whole, lambda w: F.when(w.startswith("["), F.get(F.from_json(w, "array<string>", JSON_OPTIONS), F.lit(at[-1]))))
        return F.element_at(found, 1)

    def read(item: Column, path: str) -> Value:
        at = json_steps(path)
        text, one = item.getField("t"), item.getField(f"v{paths.index(at)}")
        # Only a value that starts with a bracket can be an array; a second, typed parse tells an
        # array from a string with the same text.
        holder = text if len(at) == 1 else F.get_json_object(text, _json_path(at[:-1]))
        if isinstance(at[-1], int):
            kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), _json_path(at), "variant"))
            listed = F.when(kind.startswith("ARRAY"), F.from_json(raw_of(item, at), "array<string>", JSON_OPTIONS))
        else:
            listed = F.from_json(holder, f"{_quote(at[-1])} array<string>", JSON_OPTIONS).getField(at[-1])
        return Value(one, F.coalesce(F.transform(listed, _unmarked), F.array(one)), one.startswith("["))

    if "*" not in steps:
        text = payload if not steps else F.get_json_object(payload, _json_path(steps))
        return Items(item_of(text), False, read)
    plain = None
    if not needs_text and paths and steps[-1] == "*" and all(isinstance(s, str) for s in steps):
        if steps.count("*") == 1:
            plain = _json_plain(payload, steps[:-1], struct, paths)
        elif steps[0] != "*":
            plain = _json_plain_nested(payload, steps, struct, paths)
    return Items(_json_array(payload, steps, item_of), True, read, plain)


def _at(item: Column, steps: list[str]) -> Column:
    for step in steps:
        item = item.getField(step)
    return item


def _plain_items(found: Column, paths: list[list[str]]) -> Items:
    """Of one parsed array, named by a one-element array so that it is parsed once: its items, if no reference meets an array."""

    def has_array(item: Column) -> Column:
        test = F.lit(False)
        for steps in paths:
            test = test | F.coalesce(_at(item, steps).startswith("["), F.lit(False))
        return test

    def values(item: Column) -> Column:
        return F.struct(*[_unmarked(_at(item, steps)).alias(f"v{i}") for i, steps in enumerate(paths)])

    column = F.transform(found, lambda items: F.when(~F.exists(items, has_array), F.transform(items, values)))
    return Items(F.element_at(column, 1), True, lambda item, path: Value(item.getField(f"v{paths.index(json_steps(path))}")))


def _json_plain_nested(payload: Column, steps: list[str], struct: str, paths: list[list[str]]) -> Items:
    """Items below several '[*]' steps by one typed parse; closed where an array or an element on the way is missing or null."""
    levels: list[list[str]] = [[]]
    for step in steps[:-1]:
        if step == "*":
            levels.append([])
        else:
            levels[-1].append(step)
    ddl = struct
    for names in reversed(levels):
        ddl = f"array<{ddl}>"
        for name in reversed(names):
            ddl = f"struct<{_quote(name)}: {ddl}>"
    found = _at(F.from_json(payload, ddl, JSON_OPTIONS), levels[0])
    for names in levels[1:]:
        found = F.element_at(F.transform(F.transform(F.array(found), _below(names)), _opened), 1)
    whole = F.transform(F.array(found), lambda rows: F.when(~F.exists(rows, lambda row: row.isNull()), rows))
    return _plain_items(whole, paths)


def _below(names: list[str]) -> Callable[[Column], Column]:
    return lambda rows: F.transform(rows, lambda row: _at(row, names))


def _opened(rows: Column) -> Column:
    """One array of all elements, or null where an array is missing."""
    return F.when(~F.exists(rows, lambda row: row.isNull()), F.flatten(rows))


def _json_plain(payload: Column, before: list[str], struct: str, paths: list[list[str]]) -> Items:
    """Array items by one typed parse of the message.

    The typed parse gives null as a whole when one element has another shape, and shows an array as
    its text; in both cases this way is closed and the careful one is taken.
    """

    ddl = f"array<{struct}>"
    if before:
        for step in reversed(before[1:]):
            ddl = f"struct<{_quote(step)}: {ddl}>"
        found = _at(F.from_json(payload, f"{_quote(before[0])} {ddl}", JSON_OPTIONS), before)
    else:
        found = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, ddl, JSON_OPTIONS))

    return _plain_items(F.array(found), paths)


def _json_array(payload: Column, steps: list[str | int], item_of) -> Column:
    """Items below one or more '[*]' steps, outer order kept.

    get_json_object of a path with '*' unwraps one-element arrays, so it is never used. Each element
    is first kept as text: a typed array would be lost as a whole over one element of another shape.
    """
    star = steps.index("*")
    before, after = steps[:star], steps[star + 1 :]
    if not before:
        texts = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, "array<string>", JSON_OPTIONS))
    elif all(isinstance(s, str) for s in before):
        ddl = "array<string>"
        for step in reversed(before[1:]):
            ddl = f"struct<{_quote(step)}: {ddl}>"
        texts = F.from_json(payload, f"{_quote(before[0])} {ddl}", JSON_OPTIONS)
        for step in before:
            texts = texts.getField(step)
    else:
        found = F.get_json_object(payload, _json_path(before))
        texts = F.when(found.startswith("["), F.from_json(found, "array<string>", JSON_OPTIONS))
    if not after:
        return F.transform(texts, item_of)
    if "*" in after:
        return _flat(F.transform(texts, lambda t: _json_array(t, after, item_of)))
    return F.transform(texts, lambda t: item_of(F.get_json_object(t, _json_path(after))))


# --- XML ----------------------------------------------------------------------------------------

XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "attributePrefix": "_", "valueTag": "_VALUE"}
XML_PROLOG = r"^<\?xml\s[^>]*\?>"
# A comment, or a section of character data, which may look as if it held one.
_XML_COMMENT = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->"
_XML_NAME = re.compile(r"@?[\w:.-]+$")


def xml_steps(path: str) -> list[str]:
    steps = [s for s in path.strip("/").split("/") if s not in ("", ".", "text()")]
    if path.startswith("//") or any(not _XML_NAME.match(s) for s in steps) or any(s[0] == "@" for s in steps[:-1]):
        raise MappingError(f"unsupported XPath {path!r}")
    return steps


def _xml_type(tree: dict) -> str:
    """Elements are always arrays, so a repeated element keeps every occurrence."""
    fields = []
    for name, sub in tree.items():
        if name.startswith("@"):
            fields.append(f"{_quote('_' + name[1:])}: string")
        elif name:
            fields.append(f"{_quote(name)}: array<{_xml_type(sub) if any(sub) else 'string'}>")
        elif len(tree) > 1:
            fields.append("`_VALUE`: string")
    return "struct<" + (", ".join(fields) or "`_`: string") + ">"


def xml_tree(iterator: str, references: list[str]) -> tuple[dict, dict]:
    """The elements and attributes that a rule reads, and of these the part below the iterator."""
    tree: dict = {}
    node = tree
    for step in xml_steps(iterator):
        node = node.setdefault(step, {})
    for ref in references:
        at = node
        for step in xml_steps(ref):
            at = at.setdefault(step, {})
        at.setdefault("", {})  # a leaf: its own text is wanted
    return tree, node


def xml_body(payload: Column) -> Column:
    """An XML text without its prolog and its comments, which would cut the text around them."""
    body = F.regexp_replace(payload, XML_PROLOG, "")
    return F.when(body.contains("<!--"), F.regexp_replace(body, _XML_COMMENT, "$1")).otherwise(body)


def xml_items(payload: Column, iterator: str, references: list[str]) -> Items:
    """The root element is wrapped, so that its name is a step like any other."""
    steps = xml_steps(iterator)
    tree, node = xml_tree(iterator, references)
    wrapped = F.concat(F.lit("<w>"), xml_body(payload), F.lit("</w>"))
    root = F.from_xml(wrapped, _xml_type(tree)[len("struct<") : -1].replace("`: ", "` "), XML_OPTIONS)
    if not steps:
        return Items(root, False, lambda item, path: _xml_value(item, xml_steps(path), tree))
    column = root.getField(steps[0])
    for step in steps[1:]:
        column = _flat(F.transform(column, _field(step)))
    return Items(column, True, lambda item, path: _xml_value(item, xml_steps(path), node))


def _xml_value(item: Column, steps: list[str], tree: dict) -> Value:
    if not steps:  # the item's own text
        return Value(item.getField("_VALUE") if any(tree) else item)
    if steps[0].startswith("@"):
        return Value(item.getField("_" + steps[0][1:]))
    found, node = None, tree
    for i, step in enumerate(steps):
        if step.startswith("@"):
            found = F.transform(found, _field("_" + step[1:]))
            break
        node = node[step]
        if found is None:
            found = item.getField(step)
        else:
            found = _flat(F.transform(found, _field(step)))
    else:
        if any(node):  # has children or attributes besides its text
            found = F.transform(found, _field("_VALUE"))
    return Value(F.try_element_at(found, F.lit(1)), found, F.size(found) > 1)


# --- CSV ----------------------------------------------------------------------------------------

# One record: quoted cells may hold line breaks. One cell: the comma in front is part of the match,
# so that empty cells are found too.
_CSV_RECORD = r'((?:[^"\r\n]++|"[^"]*+")++)'
_CSV_CELL = r',\s*("(?:[^"]++|"")*+"|[^,]*)'


def _csv_cells(record: Column) -> Column:
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CSV_CELL), F.lit(1))
    return F.transform(
        raw,
        lambda c: F.when(
            c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(F.trim(c)),
    )


def csv_items(payload: Column, iterator: str, references: list[str]) -> Items:
    """One item per data row; the first record names the references. An empty cell is missing."""
    records = F.filter(
        F.regexp_extract_all(payload, F.lit(_CSV_RECORD), F.lit(1)), lambda r: F.trim(r) != ""
    )
    names = list(dict.fromkeys(references))

    def rows(rs: Column, header: Column) -> Column:
        cells = F.transform(F.slice(rs, F.lit(2), F.greatest(F.size(rs) - 1, F.lit(0))), _csv_cells)
        return F.transform(
            cells,
            lambda c: F.struct(
                *[
                    F.nullif(F.try_element_at(c, F.nullif(F.array_position(header, name), F.lit(0)).cast("int")), F.lit(""))
                    .alias(f"c{i}")
                    for i, name in enumerate(names)
                ]
                or [F.lit(None).cast("string").alias("c0")]
            ),
        )

    # a one-element transform names the records and the header once for all rows
    headed = F.transform(F.array(records), lambda rs: F.struct(rs.alias("rs"), _csv_cells(F.try_element_at(rs, F.lit(1))).alias("h")))
    column = F.flatten(F.transform(headed, lambda x: rows(x.getField("rs"), x.getField("h"))))
    return Items(column, True, lambda item, path: Value(item.getField(f"c{names.index(path)}")))


# --- choice by format ---------------------------------------------------------------------------

_BY_FORMAT = {"JSON": json_items, "XML": xml_items, "CSV": csv_items}


def prepared(payload: Column, input_format: str) -> Column:
    """What all iterators of a message read, for items(ready=True)."""
    return _marked(payload) if input_format == "JSON" else payload


def items(payload: Column, input_format: str, iterator: str, references: list[str], ready: bool = False) -> Items:
    """The items of a message; ready: the text is prepared, or a part of one that is."""
    if input_format == "JSON":
        return json_items(payload, iterator, references, ready)
    return _BY_FORMAT[input_format](payload, iterator, references)


def explode_items(
    df: DataFrame, input_format: str, iterator: str, references: dict[str, str], payload: str = "payload", key: str = "msg_id"
) -> DataFrame:
    """One row per item of each message: key, pos, and one text column per named reference."""
    found = items(F.col(payload), input_format, iterator, list(references.values()))

    def columns(read: Callable[[Column, str], Value], item: Column) -> list[Column]:
        return [read(item, path).one.alias(name) for name, path in references.items()]

    if found.is_array:
        rows = found.rows(lambda read, it, i: F.struct(i.alias("pos"), *columns(read, it)))
        return df.select(key, F.explode_outer(rows).alias("_r")).where("_r is not null").select(key, "_r.*")
    return df.select(key, found.column.alias("_i")).select(key, F.lit(0).alias("pos"), *columns(found.read, F.col("_i")))
