"""Well-formedness checks on message text. Bad input gives false, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.operators.iterate import JSON_OPTIONS, XML_PROLOG

# --- fixed values: error texts of rejected messages -----------------------------------------------
EMPTY_INPUT = "java.lang.IllegalArgumentException: Empty input is not allowed!"
NOT_JSON = "MalformedMessage: not a well-formed JSON document"
NOT_XML = "MalformedMessage: not a well-formed XML document"
UNKNOWN_FORMAT = "UnknownFormat: no validator for this input format"
# ----------------------------------------------------------------------------------------------


# nothing that JSON itself doesn't allow
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", **JSON_OPTIONS}


def is_json(payload: Column) -> Column:
    """Exactly one JSON value, nothing after it.

    The parser stops after the first value, so the text is closed in an array behind which a hash of the text
    itself stands: text that breaks out of the array cannot contain its own hash.
    """
    seal = F.xxhash64(payload).cast("string")
    parsed = F.from_json(F.concat(F.lit("["), payload, F.lit(","), seal, F.lit("]")), "array<string>", _STRICT_JSON)
    return F.get(parsed, F.lit(1)).eqNullSafe(seal) & payload.isNotNull()


# Comments, processing instructions and white space may surround the root element.
_XML_MISC = r"(?:\s++|<!--(?s:.*?)-->|<\?(?s:.*?)\?>)*+"
_XML_TAG = r"""<([^\s/><!?"'=&]++)(?:[^<>"'/]++|/(?!>)|"[^"<]*+"|'[^'<]*+')*+"""
_XML_EMPTY_ROOT = rf"^{_XML_MISC}{_XML_TAG}/>{_XML_MISC}$"
_XML_ROOT = rf"(?s)^{_XML_MISC}{_XML_TAG}>(.*)</\1\s*>{_XML_MISC}$"


def _xml_fragment_ok(payload: Column, fragment: Column) -> Column:
    """Well-formed below a wrapper whose name is a hash of the payload, so it cannot be closed early."""
    name = F.concat(F.lit("w"), F.hex(F.xxhash64(payload)))
    wrapped = F.concat(F.lit("<"), name, F.lit(">"), fragment, F.lit("</"), name, F.lit(">"))
    return F.from_xml(wrapped, "_corrupt_record string").getField("_corrupt_record").isNull()


def is_xml(payload: Column) -> Column:
    """A whole XML document: one root element, no text around it, no document type.

    from_xml checks tags, attributes and entities but not that there is one root. So the text
    between the first start tag and the last end tag is checked as well: with two roots it would
    begin by closing an element it never opened.
    """
    body = F.regexp_replace(payload, XML_PROLOG, "")
    inner = F.regexp_extract(body, _XML_ROOT, 2)
    return (
        F.when(payload.isNull() | payload.rlike(r"[\x{FFFE}\x{FFFF}]"), F.lit(False))
        .when(body.rlike(_XML_EMPTY_ROOT), _xml_fragment_ok(payload, body))
        .when(body.rlike(_XML_ROOT), _xml_fragment_ok(payload, body) & _xml_fragment_ok(payload, inner))
        .otherwise(F.lit(False))
    )


def is_non_empty(payload: Column) -> Column:
    return F.coalesce(F.length(payload) > 0, F.lit(False))


def is_csv(payload: Column) -> Column:
    return is_non_empty(payload)


def accept_all(payload: Column) -> Column:
    return F.lit(True)


_VALIDATORS = {"JSON": is_json, "XML": is_xml, "CSV": is_csv}


def is_valid(payload: Column, input_format: str | Column, formats: tuple[str, ...] = tuple(_VALIDATORS)) -> Column:
    """Validator chosen by format; with a format column, one batch may mix the given formats."""
    if isinstance(input_format, str):
        return _VALIDATORS[input_format](payload)
    out = F.lit(False)
    for name in formats:
        out = F.when(input_format == name, _VALIDATORS[name](payload)).otherwise(out)
    return out


def error_text(input_format: str | Column) -> Column:
    """What is wrong with a message its validator refused."""
    fmt = F.lit(input_format) if isinstance(input_format, str) else input_format
    return (
        F.when(fmt == "JSON", F.lit(NOT_JSON))
        .when(fmt == "XML", F.lit(NOT_XML))
        .when(fmt == "CSV", F.lit(EMPTY_INPUT))
        .otherwise(F.lit(UNKNOWN_FORMAT))
    )
