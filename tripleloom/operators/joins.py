"""Parent triples maps with a join condition.

Inside a message the mapping's shape decides: where either side has one item per message, the row itself is searched;
where both have several, the items of both sides are exploded and meet in the group of their message and keys.
Against a reference table, parents are reduced to the distinct (subject, keys) they contribute and joined on the keys. The
join type is left to Catalyst: it broadcasts a side only below its size threshold, and the adaptive skew join splits a
hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.model import Mapping, MappingError, TermMap, TriplesMap
from tripleloom.operators import iterate, terms, validate
from tripleloom.operators.conditions import CHILD, PARENT, condition
from tripleloom.operators.mapping import (
    ROWS,
    Group,
    Node,
    Scope,
    finished,
    join_conditions,
    nested,
    packed,
    side_items,
    side_rows,
    unpack,
    with_document_elements,
)
from tripleloom.session import prepare
from tripleloom.vocab import RDF_TYPE


def _side(
    df: DataFrame, mapping: Mapping, tm: TriplesMap, nodes: dict[str, TermMap], keys: dict[str, TermMap], payload: str, key: str, check: bool
) -> DataFrame:
    """key, one text column per node, one column per key: one row per item, incomplete items dropped."""
    prepare(df.sparkSession)
    group = Group(mapping, tm.iterator, [tm], ROWS.encode, ROWS.encode_constant)
    fields: dict[str, Node] = {name: group.node(term, tm) for name, term in nodes.items()}
    fields |= {name: group.key(term, tm) for name, term in keys.items()}
    group.spread_over(*fields.values())
    ok = validate.is_valid(F.col(payload), mapping.input_format) if check else F.col(payload).isNotNull()
    df = df.select(key, payload).withColumn("_ok", ok)
    found = iterate.items(F.when(F.col("_ok"), F.col(payload)), mapping.input_format, tm.iterator, group.paths)
    message = F.col(key).cast("string")

    def rows_of(read, item: Column, index: Column) -> Column:
        return side_rows(group, fields, Scope(item, index, message, read), list(fields))

    if found.is_array:
        items = side_items(group, fields, found, message, list(fields))
    else:
        df = df.withColumn("_i", found.column)
        items = rows_of(found.read, F.col("_i"), F.lit(0))
    # the outer explode keeps Catalyst from adding a size filter that would parse the message twice
    rows = df.select(key, F.explode_outer(items).alias("_a")).select(key, "_a.*")
    # a missing part of a test makes the test fail, not the item
    return rows.dropna(subset=[key, *[f for f in fields if f[0] not in "xy"]])


def joined_triples(
    df: DataFrame,
    mapping: Mapping,
    parent_df: DataFrame | None = None,
    payload: str = "payload",
    key: str = "msg_id",
    check: bool = True,
    rules: list[tuple[TriplesMap, TermMap, TermMap]] | None = None,
) -> DataFrame:
    """Triples whose object is found by a join condition; of all join rules, or of the given ones.

    Without `parent_df` a child meets the parents of its own message. With it, the parents are the
    items of every message in that table (a reference table beside the stream).
    """
    rules = [r for r in join_conditions(mapping) if r[2].conditional] if rules is None else rules
    out = None
    for tm, p, o in rules:
        other = mapping.triples_map(o.value)
        asked = condition(o)
        names = [f"k{i}" for i in range(len(asked.keys))]
        if parent_df is None:
            met = _met_in_message(df, mapping, (tm, p, o), payload, key, check)
        else:
            if not asked.equates:
                raise MappingError(f"no condition of parent {o.value!r} equates a child's value with a parent's")
            columns = [{k: pair[at] for k, pair in zip(names, asked.keys)} | {f"{x}{i}": t for i, t in enumerate(asked.parts(side))}
                       for at, (side, x) in enumerate(((CHILD, "x"), (PARENT, "y")))]
            child = _side(df, mapping, tm, {"s": tm.subject, "p": p}, columns[0], payload, key, check)
            parents = _side(parent_df, mapping, other, {"o": other.subject}, columns[1], payload, key, check)
            # a parent that is there twice must not multiply its children
            met = child.join(parents.drop(key).distinct(), names)
            if asked.tests:
                met = met.where(asked.holds(lambda i: F.col(f"x{i}"), lambda i: F.col(f"y{i}")))
        rows = met.select(
            key,
            "s",
            "p",
            "o",
            F.lit(other.subject.node_kind).alias("o_kind"),
            F.lit(None).cast("string").alias("o_datatype"),
            F.lit(None).cast("string").alias("o_lang"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"mapping {mapping.id!r} has no join condition")
    # one rule whose child is the whole message meets each distinct parent once: nothing repeats
    if len(rules) == 1 and mapping.one_item(rules[0][0]) and not condition(rules[0][2]).tests:
        return out
    return out.distinct()


def _met_in_message(
    df: DataFrame, mapping: Mapping, rule: tuple[TriplesMap, TermMap, TermMap], payload: str, key: str, check: bool
) -> DataFrame:
    """key, s, p, o of children and parents of one message with equal keys.

    Both sides come out of one pass over the messages as rows of one table, and meet in the group of their message and
    keys, which the message bounds. So the input is read once and shuffled once, without its payload.
    """
    tm, p, o = rule
    other = mapping.triples_map(o.value)
    prepare(df.sparkSession)
    ok = validate.is_valid(F.col(payload), mapping.input_format) if check else F.col(payload).isNotNull()
    base = df.select(key, payload).withColumn("_text", F.when(ok, F.col(payload)))
    message = F.col(key).cast("string")
    asked = condition(o)
    names = [f"k{i}" for i in range(len(asked.keys))]
    parts = {x: [f"{x}{i}" for i in range(len(asked.parts(side)))] for x, side in (("x", CHILD), ("y", PARENT))}
    fields = [*names, *parts["x"], *parts["y"]]
    sides = (
        ("_children", tm, {"s": tm.subject, "p": p}, dict(zip(names, [c for c, _ in asked.keys])) | dict(zip(parts["x"], asked.parts(CHILD)))),
        ("_parents", other, {"o": other.subject}, dict(zip(names, [q for _, q in asked.keys])) | dict(zip(parts["y"], asked.parts(PARENT)))),
    )
    for column, owner, nodes, keys in sides:
        group = Group(mapping, owner.iterator, [owner], ROWS.encode, ROWS.encode_constant)
        of_side = {name: group.node(term, owner) for name, term in nodes.items()} | {name: group.key(term, owner) for name, term in keys.items()}
        group.spread_over(*of_side.values())
        found = iterate.items(F.col("_text"), mapping.input_format, owner.iterator, group.paths)

        def row(read, item: Column, index: Column) -> Column:
            return side_rows(group, of_side, Scope(item, index, message, read), ["s", "p", "o", *fields])

        if found.is_array:
            rows = side_items(group, of_side, found, message, ["s", "p", "o", *fields])
            base = base.withColumn(column, F.coalesce(rows, F.array().cast(_side_type(fields))))
        else:
            base = base.withColumn(column + "_i", found.column)
            base = base.withColumn(column, row(found.read, F.col(column + "_i"), F.lit(0)))
    # the outer explode keeps Catalyst from adding a size filter that would parse the message twice
    rows = base.select(key, F.explode_outer(F.concat("_children", "_parents")).alias("_r")).select(key, "_r.*")
    rows = rows.dropna(subset=names).where("o is not null or (s is not null and p is not null)")
    of_parent = F.when(F.col("o").isNotNull(), F.struct("o", *parts["y"])) if asked.tests else F.col("o")
    sets = rows.groupBy(key, *names).agg(
        F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "p", *parts["x"]))).alias("_c"), F.collect_set(of_parent).alias("_q")
    )
    met = sets.select(key, F.explode("_c").alias("_c"), "_q").select(key, "_c", F.explode("_q").alias("o"))
    if asked.tests:
        met = met.where(asked.holds(lambda i: F.col(f"_c.x{i}"), lambda i: F.col(f"o.y{i}"))).withColumn("o", F.col("o.o"))
    return met.select(key, "_c.s", "_c.p", "o")


def _side_type(names: list[str]) -> str:
    return "array<struct<" + ", ".join(f"{c}: string" for c in ("s", "p", "o", *names)) + ">>"


def local_rules(mapping: Mapping) -> list[tuple[TriplesMap, TermMap, TermMap]]:
    """Join rules with one item per message on either side, or whose items lie in a shared one: the row itself is the place to look."""
    return [r for r in join_conditions(mapping) if mapping.one_item(r[0]) or mapping.one_item(mapping.triples_map(r[2].value)) or nested(mapping, r[0], r[2])]


def grouped_rules(mapping: Mapping) -> list[tuple[TriplesMap, TermMap, TermMap]]:
    """Join rules with several items on both sides, which meet by their keys."""
    near = local_rules(mapping)
    return [r for r in join_conditions(mapping) if r not in near]


def triples_with_joins(df: DataFrame, mapping: Mapping, payload: str, key: str, check: bool) -> DataFrame:
    """All triples of a mapping with join conditions inside the message.

    Which way a rule goes is a matter of the mapping's shape alone, so equal messages of any length are treated alike.
    """
    own = unpack(packed(df.select(key, payload), mapping, payload, key, check, local_rules(mapping)), "_packed", key)
    rest = grouped_rules(mapping)
    if not rest:
        return own
    both = own.unionByName(joined_triples(df, mapping, None, payload, key, check, rest))
    # a joined triple may repeat one of the message's own
    return both if own_predicates_differ(mapping) else both.distinct()


def own_predicates_differ(mapping: Mapping) -> bool:
    """Can no triple be made both by a join rule and by another one? Told by constant predicates."""
    joined, own = set(), {RDF_TYPE if tm.classes else None for tm in mapping.triples_maps}
    for tm in mapping.triples_maps:
        for pom in tm.predicate_objects:
            for p in pom.predicates:
                name = p.value if p.kind == "constant" else None
                for o in pom.objects:
                    (joined if mapping.is_linked(tm, o) else own).add(name)
                    if name is None:
                        return False
    return not (joined & own)


def _resource(text: Column) -> Column:
    return F.when(text.startswith("_:"), text).otherwise(F.concat(F.lit("<"), text, F.lit(">")))


def documents_with_joins(
    df: DataFrame, mapping: Mapping, payload: str, key: str, check: bool, parent_df: DataFrame | None = None
) -> DataFrame:
    """Documents of a mapping with joins: first the message's own statements and those joined in its row, in the order of
    the rules, then the other joined ones, sorted.
    """
    conditional = [r for r in join_conditions(mapping) if r[2].conditional]
    rules = grouped_rules(mapping) if parent_df is None else conditional
    own = with_document_elements(df, mapping, payload, key, check, [r for r in local_rules(mapping) if parent_df is None or r not in rules])
    if not rules:
        return finished(own, mapping)
    found = joined_triples(df, mapping, parent_df, payload, key, check, rules)
    if mapping.output_format == "TTL":
        written = F.concat(_resource(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), _resource(F.col("o")), F.lit(" .\n"))
    else:
        written = F.concat(
            F.lit('{"@id":'), terms.json_quote(F.col("s")), F.lit(","), terms.json_quote(F.col("p")),
            F.lit(':[{"@id":'), terms.json_quote(F.col("o")), F.lit("}]}"),
        )
    # one message is one document, so what is gathered here is bounded by the document it becomes
    gathered = found.groupBy(key).agg(F.sort_array(F.collect_set(written)).alias("_joined"))
    elements = F.array_union("_elements", F.coalesce("_joined", F.array().cast("array<string>")))
    return finished(own.join(gathered, key, "left").withColumn("_elements", elements).drop("_joined"), mapping)
