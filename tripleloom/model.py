"""Mapping rules as plain data: what a mapping says, before it becomes Spark expressions."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace

from tripleloom.vocab import INPUT_FORMATS, OUTPUT_FORMATS


class MappingError(ValueError):
    """A mapping that cannot be compiled."""


@dataclass(frozen=True)
class TermMap:
    """How one subject, predicate or object is made.

    kind is one of constant, reference, template, blank, parent, function.
    """

    kind: str
    value: str | None = None
    term_type: str | None = None
    datatype: str | None = None
    lang: str | None = None
    joins: tuple[tuple[str, str], ...] = ()
    args: tuple[tuple[str, "TermMap"], ...] = ()
    # conditions of a parent given as function calls, and the item a term of such a call is read from: child or parent
    where: tuple["TermMap", ...] = ()
    side: str = "child"

    @property
    def conditional(self) -> bool:
        return bool(self.joins or self.where)

    @property
    def node_kind(self) -> str:
        """iri, bnode or literal; the R2RML defaults apply when no term type is given."""
        if self.term_type:
            return self.term_type
        if self.kind == "blank":
            return "bnode"
        if self.kind in ("reference", "function") or self.datatype or self.lang:
            return "literal"
        return "iri"


def iri(value: str) -> TermMap:
    return TermMap("constant", value, "iri")


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> TermMap:
    return TermMap("constant", value, "literal", datatype, lang)


def reference(path: str, datatype: str | None = None, lang: str | None = None, term_type: str | None = None) -> TermMap:
    return TermMap("reference", path, term_type, datatype, lang)


def template(text: str, term_type: str | None = None, datatype: str | None = None, lang: str | None = None) -> TermMap:
    return TermMap("template", text, term_type, datatype, lang)


def blank(text: str | None = None) -> TermMap:
    """Blank node labelled by a filled template, or by map and iteration when there is none."""
    return TermMap("template", text, "bnode") if text else TermMap("blank", None, "bnode")


def parent(triples_map_id: str, *joins: tuple[str, str] | TermMap) -> TermMap:
    """Subject of another triples map; joins are (child reference, parent reference) pairs or calls of functions that say "true"."""
    pairs, calls = (tuple(j for j in joins if isinstance(j, TermMap) == is_call) for is_call in (False, True))
    return TermMap("parent", triples_map_id, joins=pairs, where=calls)


def of_parent(term: TermMap) -> TermMap:
    """A term of a join function that is read from the parent's item."""
    return replace(term, side="parent")


def call(function: str, term_type: str | None = None, datatype: str | None = None, **args: TermMap) -> TermMap:
    return TermMap("function", function, term_type, datatype, args=tuple(args.items()))


@dataclass(frozen=True)
class PredicateObject:
    predicates: tuple[TermMap, ...]
    objects: tuple[TermMap, ...]


def po(predicate: str | TermMap, *objects: TermMap) -> PredicateObject:
    """Predicate shortcut: a text is a constant IRI."""
    p = iri(predicate) if isinstance(predicate, str) else predicate
    return PredicateObject((p,), tuple(objects))


@dataclass(frozen=True)
class TriplesMap:
    id: str
    subject: TermMap
    predicate_objects: tuple[PredicateObject, ...] = ()
    classes: tuple[str, ...] = ()
    iterator: str = "$"
    source: str = "stream"


@dataclass(frozen=True)
class Mapping:
    id: str
    triples_maps: tuple[TriplesMap, ...]
    input_format: str = "JSON"
    output_format: str = "TTL"
    expand_arrays: bool = True
    name: str | None = None
    author: str | None = None
    version: str | None = None
    description: str | None = None
    tags: tuple[str, ...] = ()
    rml: str | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.input_format not in INPUT_FORMATS:
            raise MappingError(f"unknown input format {self.input_format!r}")
        if self.output_format not in OUTPUT_FORMATS:
            raise MappingError(f"unknown output format {self.output_format!r}")
        if not self.triples_maps:
            raise MappingError(f"mapping {self.id!r} has no triples map")
        by_id = {tm.id: tm for tm in self.triples_maps}
        if len(by_id) != len(self.triples_maps):
            raise MappingError(f"mapping {self.id!r} has triples maps with the same id")
        for tm in self.triples_maps:
            if tm.source != "stream":
                raise MappingError(f"triples map {tm.id!r} reads {tm.source!r}, not the message stream")
            if tm.subject.node_kind == "literal":
                raise MappingError(f"triples map {tm.id!r} has a literal subject")
            for term in self._terms(tm):
                if term.kind == "parent" and term.value not in by_id:
                    raise MappingError(f"triples map {tm.id!r} names unknown parent {term.value!r}")
                if term.kind == "parent" and not term.conditional and self.is_linked(tm, term) and not self.one_item(by_id[term.value]):
                    if not self.shared_item(tm, by_id[term.value]):
                        raise MappingError(f"triples map {tm.id!r} has no condition to choose among the items of parent {term.value!r}")
                    if "blank" in (tm.subject.kind, by_id[term.value].subject.kind):
                        raise MappingError(f"triples map {tm.id!r} and its parent {term.value!r} need subjects with a name to meet below a shared item")
                if term.datatype and term.lang:
                    raise MappingError(f"triples map {tm.id!r} gives a term both datatype and language")
                for text in (term.datatype, term.lang):
                    if text and re.search(r"[\x00-\x20<>\"{}|^`\\]", text):
                        raise MappingError(f"triples map {tm.id!r} has a bad datatype or language {text!r}")

    @staticmethod
    def _terms(tm: TriplesMap):
        yield tm.subject
        for pom in tm.predicate_objects:
            yield from pom.predicates
            yield from pom.objects

    def triples_map(self, triples_map_id: str) -> TriplesMap:
        return next(tm for tm in self.triples_maps if tm.id == triples_map_id)

    def one_item(self, tm: TriplesMap) -> bool:
        """Does the iterator give one item per message?"""
        return self.input_format == "JSON" and "*" not in tm.iterator

    def shared_item(self, tm: TriplesMap, other: TriplesMap) -> tuple[str, str, str] | None:
        """The iterator of the innermost item that both iterators go through, and what is left of either; None if there is none."""
        from tripleloom.operators.iterate import json_path, json_steps

        if self.input_format != "JSON":
            return None
        steps, others = json_steps(tm.iterator), json_steps(other.iterator)
        same = next((i for i, (a, b) in enumerate(zip(steps, others)) if a != b), min(len(steps), len(others)))
        if "*" not in steps[:same]:
            return None
        last = same - steps[:same][::-1].index("*")
        return json_path(steps[:last]), json_path(steps[last:]), json_path(others[last:])

    def is_linked(self, tm: TriplesMap, term: TermMap) -> bool:
        """Is the object the subject of another item than the child's own: by a condition, or as the parent iterates otherwise?"""
        return term.kind == "parent" and bool(term.conditional or self.triples_map(term.value).iterator != tm.iterator)

    @property
    def has_joins(self) -> bool:
        return any(self.is_linked(tm, t) for tm in self.triples_maps for t in self._terms(tm))

    @property
    def rml_hash(self) -> str | None:
        return None if self.rml is None else hashlib.sha256(self.rml.encode()).hexdigest().upper()


SLOT = re.compile(r"(?<!\\)\{((?:[^{}\\]|\\.)+)\}")


def template_parts(text: str) -> list[tuple[bool, str]]:
    """Split a template into (is_slot, text) pieces; a backslash escapes a brace."""
    parts: list[tuple[bool, str]] = []
    at = 0
    for m in SLOT.finditer(text):
        if m.start() > at:
            parts.append((False, _unescape(text[at : m.start()])))
        parts.append((True, _unescape(m.group(1))))
        at = m.end()
    if at < len(text):
        parts.append((False, _unescape(text[at:])))
    outside = re.sub(r"\\[{}\\]", "", SLOT.sub("", text))
    if "{" in outside or "}" in outside:
        raise MappingError(f"unbalanced braces in template {text!r}")
    return parts


def _unescape(text: str) -> str:
    return re.sub(r"\\([{}\\])", r"\1", text)
