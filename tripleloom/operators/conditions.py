"""Join conditions split into equal keys and a test of what is left.

A condition is a pair of references, or a function call over terms of the child's item and of the parent's. `equal` of a child's expression
and a parent's is a key on either side, whatever functions the expressions hold; everything else is a test of the pairs
that the keys bring together. So a join never compares all with all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions import registry
from tripleloom.model import MappingError, TermMap, reference

CHILD, PARENT = frozenset(["child"]), frozenset(["parent"])


def sides(term: TermMap, parent: bool = False) -> frozenset[str]:
    """The items that a term reads; a constant reads none."""
    parent = parent or term.side == "parent"
    if term.kind == "constant":
        return frozenset()
    if term.kind == "function":
        return frozenset().union(*[sides(a, parent) for _, a in term.args])
    if term.kind in ("reference", "template"):
        return PARENT if parent else CHILD
    raise MappingError(f"a join condition can't use a {term.kind!r} term")


@dataclass(frozen=True)
class Condition:
    """keys: (child's expression, parent's), which must be equal; tests: calls that must say "true" of a pair."""

    keys: tuple[tuple[TermMap, TermMap], ...]
    tests: tuple[TermMap, ...]

    @property
    def equates(self) -> bool:
        """Does a key read both items, so that it can bring rows of two tables together?"""
        return any(sides(c) and sides(p, True) for c, p in self.keys)

    def parts(self, side: frozenset[str]) -> list[TermMap]:
        """The largest expressions of the tests that one item alone gives."""
        out: list[TermMap] = []

        def walk(term: TermMap, parent: bool) -> None:
            parent = parent or term.side == "parent"
            read = sides(term, parent)
            if read == side:
                if term not in out:
                    out.append(term)
            elif len(read) > 1:
                for _, a in term.args:
                    walk(a, parent)

        for test in self.tests:
            walk(test, False)
        return out

    def holds(self, child: Callable[[int], Column], parent: Callable[[int], Column]) -> Column:
        """The tests of a pair, from the values of parts(CHILD) and parts(PARENT); a missing value fails."""
        of = {CHILD: (self.parts(CHILD), child), PARENT: (self.parts(PARENT), parent)}

        def value(term: TermMap, is_parent: bool) -> Column:
            is_parent = is_parent or term.side == "parent"
            read = sides(term, is_parent)
            if read in of:
                parts, column = of[read]
                return column(parts.index(term))
            if term.kind == "constant":
                return F.lit(term.value)
            return registry.apply(term.value, {name: value(a, is_parent) for name, a in term.args})

        out = F.lit(True)
        for test in self.tests:
            out = out & F.coalesce(value(test, False) == "true", F.lit(False))
        return out


def condition(parent: TermMap) -> Condition:
    """The condition of a parent term; without any equal key it is refused, as it would compare all with all."""
    keys, tests = [(reference(c), reference(p)) for c, p in parent.joins], []
    for call in parent.where:
        if call.kind != "function":
            raise MappingError(f"the join condition of parent {parent.value!r} is no function call")
        args = [a for _, a in sorted(call.args)] if call.value == registry.EQUAL else []
        read = [sides(a, call.side == "parent") for a in args]
        if len(args) == 2 and max(map(len, read)) <= 1 and read[0] != read[1]:
            first, second = args if read[0] == CHILD or read[1] == PARENT else reversed(args)
            keys.append((first, second))
        else:
            tests.append(call)
    if parent.conditional and not keys:
        raise MappingError(f"no condition of parent {parent.value!r} equates a child's value with a parent's")
    return Condition(tuple(keys), tuple(tests))
