"""Semantic annotation of message tables and streams, compiled to Catalyst expressions."""

from tripleloom.model import (
    Mapping,
    MappingError,
    PredicateObject,
    TermMap,
    TriplesMap,
    blank,
    call,
    iri,
    literal,
    parent,
    po,
    reference,
    template,
)

__all__ = [
    "Mapping",
    "MappingError",
    "PredicateObject",
    "TermMap",
    "TriplesMap",
    "blank",
    "call",
    "iri",
    "literal",
    "parent",
    "po",
    "reference",
    "template",
]
