"""Arrays inside templates, subjects and keys: every combination of the values, row by row.

A statement is data: its digits, each a list of values and the way they are written, and its pieces, constant texts and digits. Its
combinations are counted by the product of the lists' lengths and each is read off its number, digit by digit, so there
is no shuffle and the expression has one size whatever the number of statements.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

STATEMENTS = "array<struct<digits: array<struct<at: int, how: int>>, pieces: array<struct<text: string, digit: int>>>>"

#: A piece of a statement: a text, or (term it is in, place of its values, way of writing).
Piece = str | tuple[str, int, int]


def described(statement: list[Piece]) -> dict:
    """A statement as data. A list that occurs twice in one term is one digit; in two terms it is two."""
    digits: list[tuple[str, int, int]] = []
    pieces: list[dict] = []
    for piece in statement:
        if isinstance(piece, str):
            if pieces and pieces[-1]["digit"] < 0:
                pieces[-1]["text"] += piece
            else:
                pieces.append({"text": piece, "digit": -1})
            continue
        if piece not in digits:
            digits.append(piece)
        pieces.append({"text": None, "digit": digits.index(piece)})
    return {"digits": [{"at": at, "how": how} for _, at, how in digits], "pieces": pieces}


def literal(statements: list[list[Piece]]) -> Column:
    """The statements as a constant."""
    return F.from_json(F.lit(json.dumps([described(s) for s in statements])), STATEMENTS, {"maxStringLen": "2147483647"})


# One SQL text, so that building the plan costs the same few calls whatever the number of statements. q: statements s and lists v.
_ALL = """q -> flatten(transform(q.s, s -> element_at(transform(
  array(transform(s.digits, d -> get(q.v, d.at))), lists -> element_at(transform(
  array(transform(lists, x -> case when x is null then 0L else cast(size(x) as bigint) end)), sizes -> element_at(transform(
  array(aggregate(sizes, 1L, (a, n) -> a * n)), total -> case when total > 0 then transform(sequence(0L, total - 1L), i -> aggregate(
    s.pieces, '', (t, p) -> concat(t, case when p.digit < 0 then p.text else element_at(transform(
      array(get(get(lists, p.digit), cast((i div aggregate(slice(sizes, 1, p.digit), 1L, (a, n) -> a * n)) % get(sizes, p.digit) as int))),
      v -> case get(s.digits, p.digit).how {ways} end), 1) end)))
    else cast(array() as array<string>) end), 1)), 1)), 1)))"""


def crossed_sql(statements: str, values: str, ways: list[str]) -> str:
    """All statements with all combinations of `values`, an array of lists, as SQL. A null among the values makes a null.

    ways: the ways of writing a value v, as SQL.
    """
    cases = " ".join(f"when {i} then {way}" for i, way in enumerate(ways))
    return f"element_at(transform(array(named_struct('s', {statements}, 'v', {values})), {_ALL.replace('{ways}', cases)}), 1)"


def crossed(statements: Column, values: Column, ways: list[str]) -> Column:
    """The same over columns."""
    both = F.array(F.struct(statements.alias("s"), values.alias("v")))
    return F.element_at(F.call_function("transform", both, F.expr("x -> " + crossed_sql("x.s", "x.v", ways))), 1)
