"""Native column functions (JVM side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names counted as built-in base types (``...`` is reported as
# ``ellipsis``); anything else with text is ``user_defined``.
BASE_TYPES = [
    "None", "bool", "int", "float", "complex", "str", "bytes", "bytearray",
    "memoryview", "range", "tuple", "list", "set", "frozenset", "dict",
    "ellipsis", "...", "type", "object", "NoneType", "Any", "Union", "Optional",
    "Callable", "TypeVar", "Generic", "ClassVar", "Final", "Literal", "Annotated",
    "TypedDict", "Protocol", "runtime_checkable", "AbstractSet",
]

# Leading text before the first '[', ',' or space.
HEAD_PATTERN = r"^([^\[, ]*)"


def base_type(annotation: Column | str) -> Column:
    """``Optional[Union[str, int]]`` -> ``Optional``; unknown names -> ``user_defined``."""
    c = F.col(annotation) if isinstance(annotation, str) else annotation
    head = F.regexp_extract(c, HEAD_PATTERN, 1)
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(head == "...", F.lit("ellipsis"))
            .when(head.isin(BASE_TYPES), head)
            .otherwise(F.lit("user_defined")))


def truncate(c: Column | str, n: int) -> Column:
    """Keep the first ``n`` characters (code points, like a Python slice)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, 1, n)


def format_created_at(c: Column | str) -> Column:
    """B2: ``2013-10-28T13:19:39Z`` -> ``2013-10-28 13:19:39`` (every T replaced, last char dropped)."""
    c = F.col(c) if isinstance(c, str) else c
    replaced = F.replace(c, F.lit("T"), F.lit(" "))
    return F.when(F.length(c) > 0, replaced.substr(F.lit(1), F.length(c) - 1)).otherwise(F.lit(""))


def creation_year(created_at_formatted: Column | str) -> Column:
    """Integer of the first four characters."""
    c = F.col(created_at_formatted) if isinstance(created_at_formatted, str) else created_at_formatted
    return F.substring(c, 1, 4).try_cast("int")


def split_full_name(full_name: Column | str) -> tuple[Column, Column, Column]:
    """B1: ``user/name`` -> (user, name, valid). Valid only with exactly one ``/``."""
    c = F.col(full_name) if isinstance(full_name, str) else full_name
    parts = F.split(c, "/")
    valid = F.size(parts) == 2
    return F.get(parts, 0), F.get(parts, 1), valid


def basename(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(c, "/"), -1)


def repo_root(path: Column | str, depth: int, sep: str = "/") -> Column:
    """The first ``depth`` components of a path, re-joined."""
    c = F.col(path) if isinstance(path, str) else path
    return F.array_join(F.slice(F.split(c, _regex_quote(sep)), 1, depth), sep)


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def percent_share(n: Column | str, total: Column | str) -> Column:
    """``round(n / total * 100, 2)`` (half-up on the decimal value)."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.col(total) if isinstance(total, str) else total
    return F.round(n / total * 100, 2)


def lookup_default(map_col: Column | str, key: Column | str, default) -> Column:
    """value for ``key`` in a map column, ``default`` when the key is absent."""
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(m, k), F.lit(default))
