"""Text encodings of RDF terms, built from JVM-side functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: RFC 3987 character classes -------------------------------------------------
# Printable ASCII outside "unreserved", percent sign first so that replacing never encodes twice.
RESERVED = "%" + " !\"#$&'()*+,/:;<=>?@[\\]^`{|}"
UNRESERVED_CLASS = r"A-Za-z0-9._~\-"
# "ucschar": the three ranges of the basic plane, then xx0000-xxFFFD of planes 1-13, then plane 14.
UCSCHAR_CLASS = (
    r"\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}"
    + "".join(rf"\x{{{p:X}0000}}-\x{{{p:X}FFFD}}" for p in range(1, 14))
    + r"\x{E1000}-\x{EFFFD}"
)
# Characters N-Triples does not allow inside <...>.
IRI_ILLEGAL = "<>\"{}|^`\\ "
# ----------------------------------------------------------------------------------------------


def _percent(text: str) -> str:
    return "".join(f"%{b:02x}" for b in text.encode())


def _sql_text(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + escaped.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def _replace_each(value: str, chars: str) -> str:
    for ch in chars:
        value = f"replace({value}, {_sql_text(ch)}, {_sql_text(_percent(ch))})"
    return value


def _percent_other(value: str, keep_class: str) -> str:
    """Percent-encode, character by character, whatever is outside the class."""
    return (
        f"array_join(transform(split({value}, ''), c -> case when c rlike {_sql_text(f'^[{keep_class}]$')} then c "
        "else regexp_replace(lower(hex(c)), '(..)', '%$1') end), '')"
    )


def _named(value: Column, function: str) -> Column:
    """Apply a one-argument SQL lambda, which names the value however often the text uses it."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(function)), 1)


# Unicode NFKC through the ICU library Spark ships; its argument must not be null.
_NFKC = "java_method('com.ibm.icu.text.Normalizer', 'compose', v, true)"

# Cheap cases first: identifiers pass through, printable text takes a chain of replaces, and only text
# with control or private-use characters is rebuilt character by character.
_IRI_SAFE = f"""v -> case
  when v is null then null
  when v rlike {_sql_text(f"^[{UNRESERVED_CLASS}]*\\z")} then v
  when v rlike {_sql_text(r"^[\x20-\x7e]*\z")} then {_replace_each("v", RESERVED)}
  when v rlike {_sql_text(rf"^[\t\n\r\x20-\x7e{UCSCHAR_CLASS}]*\z")} then {_replace_each(_NFKC, RESERVED + chr(9) + chr(10) + chr(13))}
  else {_percent_other(_NFKC, UNRESERVED_CLASS + UCSCHAR_CLASS)} end"""

_IRI_ILLEGAL_CLASS = r'\x00-\x20<>"{}|^`\\\x7f'
_IRI_REFERENCE = f"""v -> case
  when v rlike {_sql_text("[" + _IRI_ILLEGAL_CLASS + "]")} then {_percent_other("v", "^" + _IRI_ILLEGAL_CLASS)}
  else v end"""


# The ways of writing a value v, as SQL.
SAFE_SQL, REFERENCE_SQL = _IRI_SAFE.split("->", 1)[1], _IRI_REFERENCE.split("->", 1)[1]
ESCAPED_SQL = (
    r"""case when v rlike '["\\\\\n\r]' then replace(replace(replace(replace(v, '\\', '\\\\'), '"', '\\"'), '\n', '\\n'), '\r', '\\r') else v end"""
)
JSON_SQL = "case when v is not null then substring(to_json(array(v)), 3, length(to_json(array(v))) - 4) end"


def iri_safe(value: Column) -> Column:
    """IRI-safe form of a template slot: NFKC, then lower-case percent encoding."""
    return _named(value, _IRI_SAFE)


def iri_reference(value: Column) -> Column:
    """A reference used as an IRI: kept as it is, except characters no IRI may hold."""
    return _named(value, _IRI_REFERENCE)


def escape_literal(value: Column) -> Column:
    """Escapes of a quoted Turtle or N-Triples string."""
    escaped = value
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))
    return F.when(value.rlike(r'["\\\n\r]'), escaped).otherwise(value)


def unescape_literal(value: Column) -> Column:
    """Reverse of escape_literal, plus tab, backspace, form feed, quote and numeric escapes.

    Splitting at backslash pairs first keeps an escaped backslash from escaping what follows it.
    """
    pieces = F.transform(F.split(value, r"\\\\"), _unescape_piece)
    return F.when(value.contains("\\"), F.array_join(pieces, "\\")).otherwise(value)


def _unescape_piece(piece: Column) -> Column:
    # fixed values: the single-letter escapes of N-Triples
    for written, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        piece = F.replace(piece, F.lit(written), F.lit(raw))
    numeric = F.transform(
        F.split(piece, r"\\(?=u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"),
        lambda part, i: F.when(i == 0, part)
        .when(part.startswith("u"), F.concat(_code_point(part.substr(2, 4)), F.substring(part, 6, 1 << 30)))
        .otherwise(F.concat(_code_point(part.substr(2, 8)), F.substring(part, 10, 1 << 30))),
    )
    return F.when(piece.contains("\\"), F.array_join(numeric, "")).otherwise(piece)


def _code_point(hex_text: Column) -> Column:
    """The character of a hexadecimal code point, by way of its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(hex_text, 8, "0")), "UTF-32")


def json_quote(value: Column) -> Column:
    """The value as a JSON string, quotes included."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def blank_label(scope: Column, value: Column) -> Column:
    """Blank node label; the scope (the message) keeps labels of different messages apart."""
    return F.concat(F.lit("_:b"), F.sha2(F.concat(scope, F.lit(":"), value), 256))


# The same encodings for constants, done once while compiling.


_NOT_IN_IRI = re.compile(f"[{re.escape(IRI_ILLEGAL)}\x00-\x20\x7f]")


def iri_constant(text: str) -> str:
    return text if not _NOT_IN_IRI.search(text) else "".join(_percent(c) if c in IRI_ILLEGAL or ord(c) <= 0x20 or ord(c) == 0x7F else c for c in text)


def escape_constant(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
