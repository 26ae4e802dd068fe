"""Paths into open documents: parsing, and resolution over VARIANT values without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays directly within arrays are unfolded so deep.
NESTING = 4


class PathError(ValueError):
    pass


def parse(path: str) -> list[str | int]:
    """Steps of ``a.b``, ``a[0].b`` and ``"a literal.key"``: names as text, indexes as numbers."""
    steps: list[str | int] = []
    at, wants_name = 0, True
    while at < len(path):
        c = path[at]
        if c == ".":
            if wants_name:
                raise PathError(f"empty step at {at} in {path!r}")
            at, wants_name = at + 1, True
        elif c == "[":
            end = path.find("]", at)
            if wants_name or end < 0 or not path[at + 1 : end].isdigit():
                raise PathError(f"bad index at {at} in {path!r}")
            steps.append(int(path[at + 1 : end]))
            at = end + 1
        elif not wants_name:
            raise PathError(f"a dot is missing at {at} in {path!r}")
        elif c == '"':
            end = path.find('"', at + 1)
            if end < 0:
                raise PathError(f"unclosed quote in {path!r}")
            if end == at + 1:
                raise PathError(f"empty step at {at} in {path!r}")
            steps.append(path[at + 1 : end])
            at, wants_name = end + 1, False
        else:
            end = at
            while end < len(path) and path[end] not in '.["':
                end += 1
            steps.append(path[at:end])
            at, wants_name = end, False
    if wants_name:
        raise PathError(f"empty step at the end of {path!r}")
    return steps


def _quoted(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _unfolded(values: Column) -> Column:
    """Elements of arrays in place of the arrays."""
    for _ in range(NESTING):
        values = F.flatten(F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return values


def resolve(value: Column, path: str) -> Column:
    """The values a path leads to, as an array of VARIANT: a name fans out over an array, a last array gives its elements."""
    found = F.array(value)
    for step in parse(path):
        if isinstance(step, int):
            found = _at(found, step)
        else:
            found = _named(_unfolded(found), step)
        found = F.filter(found, lambda v: v.isNotNull())
    return _unfolded(found)


def _at(values: Column, index: int) -> Column:
    return F.transform(values, lambda v: F.try_variant_get(v, f"$[{index}]", "variant"))


def _named(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: F.try_variant_get(v, _quoted(name), "variant"))


#: The greatest value of each unsigned kind.
UNSIGNED = {"u8": 2**8 - 1, "u16": 2**16 - 1, "u32": 2**32 - 1, "u64": 2**64 - 1}


def leaves(value: Column, path: str, kind: str) -> Column:
    """Distinct values of ``kind`` (``str`` or an unsigned one) at a path; what is of another kind, or too large, is left out."""
    found = resolve(value, path)
    if kind == "str":
        typed = F.transform(F.filter(found, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    elif kind in UNSIGNED:
        whole = F.filter(found, lambda v: F.schema_of_variant(v).isin("BIGINT", "DECIMAL(19,0)", "DECIMAL(20,0)"))
        typed = F.transform(whole, lambda v: F.try_variant_get(v, "$", "decimal(20,0)"))
        typed = F.filter(typed, lambda x: (x >= 0) & (x <= F.lit(UNSIGNED[kind]).cast("decimal(20,0)")))
        if kind != "u64":
            typed = F.transform(typed, lambda x: x.cast("bigint"))
    else:
        raise PathError(f"no path kind {kind!r}")
    return F.array_distinct(typed)
