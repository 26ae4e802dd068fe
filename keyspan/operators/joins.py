"""Compositions of key sets and fetches that amount to joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyset import KeySet


def inner(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each pair of rows that share the key: m x n rows a key."""
    return a.join(b, list(on))


def merge_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """``inner`` by one pass over both sides in key order."""
    return a.hint("merge").join(b, list(on))


def left_outer(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left")


def through(a: DataFrame, pairs: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Rows of both ends of a relation table."""
    return a.join(pairs, a_key).join(b, b_key)


def deref(rows: DataFrame, ref: str, children: DataFrame, child_key: str, prefix: str = "child_") -> DataFrame:
    """Each row with the child its reference names; a dangling reference has nulls."""
    child = children.select(*[F.col(c).alias(prefix + c) for c in children.columns])
    return rows.join(child, rows[ref] == child[prefix + child_key], "left")


def deref_all(rows: DataFrame, key: Sequence[str], refs: str, children: DataFrame, child_key: str, value: str, out: str = "values") -> DataFrame:
    """Each row with the children's values in the order of its references; null where one dangles."""
    items = rows.select(*key, F.posexplode_outer(refs).alias("__pos", "__ref"))
    found = items.join(children.select(F.col(child_key).alias("__ref"), F.struct(F.col(value).alias("v")).alias("__v")), "__ref", "left")
    listed = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", "__v")))).alias("__all"))
    return rows.join(listed.select(*key, F.transform("__all", lambda x: x["__v"]["v"]).alias(out)), list(key))


def chain(first: KeySet, *steps: tuple[str, KeySet]) -> KeySet:
    """``first`` through ("and" | "or" | "minus", set) steps."""
    for verb, other in steps:
        first = {"and": first.intersect, "or": first.union, "minus": first.difference}[verb](other)
    return first
