"""Write verbs over documents: declared rows and an open half of JSON text, each verb a new state of the tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class WriteError(ValueError):
    pass


def merged(old: object, new: object) -> object:
    """``new`` over ``old``: maps merge name by name at every level, all else is replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: merged(old[k], v) if k in old else v for k, v in new.items()}}
    return new


def json_text(value: object) -> str | None:
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def merge_json_texts(texts: Sequence[str | None]) -> str | None:
    out: object = None
    for t in texts:
        if t is not None:
            value = json.loads(t)
            out = value if out is None else merged(out, value)
    return json_text(out)


@F.pandas_udf(StringType())
def merge_cells(cells: pd.Series) -> pd.Series:
    """Merges an array of JSON texts from left to right."""
    return cells.map(lambda c: None if c is None else merge_json_texts(c))


def put(rows: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with ``new`` ones in place of those of the same key."""
    return rows.join(new.select(*key), list(key), "left_anti").unionByName(new)


def _declared(rows: DataFrame, key: Sequence[str], open_column: str) -> list[str]:
    return [c for c in rows.columns if c not in key and c != open_column]


def put_merge(rows: DataFrame, new: DataFrame, key: Sequence[str], open_column: str = "open") -> DataFrame:
    """Declared fields that ``new`` has are overwritten where not null, open names merge, the rest stays. A type that is not
    the declared one is refused before anything is written."""
    for c in new.columns:
        if c in rows.columns and new.schema[c].dataType != rows.schema[c].dataType:
            raise WriteError(f"{c}: {new.schema[c].dataType.simpleString()} is not {rows.schema[c].dataType.simpleString()}")
        if c not in rows.columns:
            raise WriteError(f"{c} is not declared; open names go in {open_column}")
    other = new.select(*key, *[F.col(c).alias("__new_" + c) for c in new.columns if c not in key])
    both = rows.join(other, list(key), "full")
    out: list[Column] = []
    for c in rows.columns:
        if c in key or c not in new.columns:
            out.append(F.col(c))
        elif c == open_column:
            out.append(merge_cells(F.array(c, "__new_" + c)).alias(c))
        else:
            out.append(F.coalesce("__new_" + c, c).alias(c))
    return both.select(*out)


def put_replace(rows: DataFrame, new: DataFrame, key: Sequence[str], defaults: dict | None = None, open_column: str = "open") -> DataFrame:
    """Documents become exactly ``new``: absent fields take their defaults, the open half what is given. A document whose
    every field is null is purged."""
    defaults = defaults or {}
    given = [c for c in new.columns if c not in key]
    empty = F.lit(True)
    for c in given:
        empty = empty & F.col(c).isNull()
    there = new.withColumn("__empty", empty)
    columns = []
    for c in rows.columns:
        kind = rows.schema[c].dataType
        base = F.col(c) if c in new.columns else F.lit(None).cast(kind)
        columns.append((base if c in key or c == open_column or c not in defaults else F.coalesce(base, F.lit(defaults[c]).cast(kind))).alias(c))
    kept = rows.join(new.select(*key), list(key), "left_anti")
    return kept.unionByName(there.where("NOT __empty").select(*columns))


def purge(rows: DataFrame, keys: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without the keys' documents, the keys with whether there was anything to purge)."""
    there = rows.select(*key, F.lit(True).alias("__there"))
    told = keys.select(*key).distinct().join(there, list(key), "left").select(*key, F.coalesce("__there", F.lit(False)).alias("purged"))
    return rows.join(keys.select(*key), list(key), "left_anti"), told


def upsert_with(rows: DataFrame, keys: DataFrame, key: Sequence[str], changes: dict[str, Column]) -> DataFrame:
    """Read, change, write: ``changes`` are expressions over the stored columns, null for a document that is new."""
    asked = keys.select(*key).distinct().withColumn("__asked", F.lit(True))
    both = rows.join(asked, list(key), "full")
    return both.select(*[(F.when(F.col("__asked"), changes[c]).otherwise(F.col(c)) if c in changes else F.col(c)).alias(c) for c in rows.columns])


def put_with_children(parents: DataFrame, children: DataFrame, new: DataFrame, key: Sequence[str], refs: str, child_key: str, embedded: str) -> tuple[DataFrame, DataFrame]:
    """Parents with ``new`` in place of old ones, and their children: ``new`` has an array ``embedded`` of
    struct<child key, value struct or null>. A value is written, a null one only refers; children that an overwritten parent
    no longer names are deleted. The parent keeps the array of child keys in ``refs``."""
    items = new.select(*key, F.explode(embedded).alias("__c"))
    written = items.where(F.col("__c.value").isNotNull()).select(F.col(f"__c.{child_key}").alias(child_key), F.col("__c.value.*"))
    named = items.select(F.col(f"__c.{child_key}").alias(child_key)).distinct()
    old = parents.join(new.select(*key), list(key), "left_semi").select(F.explode(refs).alias(child_key)).distinct()
    released = old.join(named, child_key, "left_anti")
    kept = children.join(released, child_key, "left_anti").join(written.select(child_key), child_key, "left_anti")
    held = new.withColumn(refs, F.transform(embedded, lambda c: c[child_key])).drop(embedded)
    return put(parents, held.select(*parents.columns), key), kept.unionByName(written.select(*children.columns))


# --- whole documents as JSON text


def split(rows: DataFrame, key: Sequence[str], declared: dict[str, str], document: str = "document", open_column: str = "open") -> DataFrame:
    """Documents (key, JSON text of one object) as their two halves: fields of the ``declared`` types, null where absent, and
    the other names as JSON text, null if there are none. A declared field of another type is refused."""
    whole = F.from_json(F.col(document), "map<string,variant>")
    out: list[Column] = [F.col(k) for k in key]
    for name, kind in declared.items():
        value = F.element_at("__map", F.lit(name))
        typed = F.try_variant_get(value, "$", kind)
        wrong = value.isNotNull() & ~F.is_variant_null(value) & typed.isNull()
        out.append(F.when(wrong, F.raise_error(F.lit(f"{name} is not {kind}")).cast(kind)).otherwise(typed).alias(name))
    rest = F.map_filter("__map", lambda k, _: ~k.isin(*declared))
    out.append(F.when(F.size(rest) > 0, F.to_json(rest)).alias(open_column))
    return rows.select(*key, whole.alias("__map")).select(*out)


def compose(rows: DataFrame, key: Sequence[str], document: str = "document", open_column: str = "open") -> DataFrame:
    """The halves as one document again: declared fields that are not null, then the open names, in the order of names."""
    names = _declared(rows, key, open_column)
    own = F.to_json(F.struct(*names)) if names else F.lit("{}")
    return rows.select(*key, merge_cells(F.array(own, open_column)).alias(document))
