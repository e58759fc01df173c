"""Functions a mapping may call in a term map, by IRI: Column arguments in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.model import MappingError

# --- fixed values: function and parameter names used in mapping documents -----------------------
EQUAL = "http://example.com/idlab/function/equal"
TRUE_CONDITION = "http://example.com/idlab/function/trueCondition"
PARAM_BOOLEAN = "http://example.com/idlab/function/strBoolean"
PARAM_STRING = "http://example.com/idlab/function/str"
PARAM_VALUE = "http://users.ugent.be/~bjdmeest/function/grel.ttl#valueParameter"
PARAM_VALUE2 = "http://users.ugent.be/~bjdmeest/function/grel.ttl#valueParameter2"
# ------------------------------------------------------------------------------------------------

FunctionOfColumns = Callable[..., Column]

_FUNCTIONS: dict[str, tuple[tuple[str, ...], FunctionOfColumns]] = {}


def register(name: str, params: tuple[str, ...], function: FunctionOfColumns) -> None:
    """Make a Column function callable from mappings; params fix the argument order."""
    _FUNCTIONS[name] = (params, function)


def apply(name: str, args: dict[str, Column]) -> Column:
    if name not in _FUNCTIONS:
        raise MappingError(f"unknown function {name!r}")
    params, function = _FUNCTIONS[name]
    unknown, missing = set(args) - set(params), set(params) - set(args)
    if unknown or missing:
        raise MappingError(f"function {name!r} wants {params}, got {tuple(args)}")
    return function(*[args[p] for p in params])


register(EQUAL, (PARAM_VALUE, PARAM_VALUE2), lambda a, b: (a == b).cast("string"))
register(TRUE_CONDITION, (PARAM_BOOLEAN, PARAM_STRING), lambda cond, value: F.when(cond == "true", value))
