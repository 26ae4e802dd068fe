"""Collections and their faces: declared views of rows, scanned by prefix, exactly or by range.

A face is logical: filter, derive, select. Catalyst pushes its predicates and columns into the file scan, so every scan
reads what its parts name and nothing else. Results come in the face's order if ``ordered``, which is a sort of all of them,
and where a page (``take``, ``skip``) or ``reverse`` asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import SchemaError
from .keyset import KeySet

FIELDS, KEY, ROW, INCLUDE = "fields", "key", "row", "include"


@dataclass(frozen=True)
class Face:
    """``fields``: columns, or the name of the derived value. ``func``: a value of each row, or an array of them if
    ``many``. ``path``: (path, kind) into the open half. ``key``: named key columns in place of the whole key."""

    name: str
    fields: tuple[str, ...]
    includes: tuple[str, ...] = ()
    key: tuple[str, ...] | None = None
    where: Callable[[DataFrame], Column] | None = None
    func: Callable[[DataFrame], Column] | None = None
    many: bool = False
    path: tuple[str, str] | None = None
    lead: bool = False
    reverse: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.fields:
            raise SchemaError(f"face {self.name} has no fields")
        if self.func and self.path:
            raise SchemaError(f"face {self.name} is either a function's or a path's")
        if (self.func or self.path) and len(self.fields) != 1:
            raise SchemaError(f"face {self.name}: one name for a derived value")
        if self.lead and (self.includes or self.func or self.where or self.path):
            raise SchemaError(f"face {self.name}: a lead face only permutes the key")
        if self.path:
            paths.parse(self.path[0])

    def check(self, schema) -> None:
        if self.lead and not set(self.fields) <= set(schema.key_names):
            raise SchemaError(f"face {self.name}: a lead face has key fields only")
        if not (self.func or self.path):
            for i, name in enumerate(self.fields):
                kind = schema.field_of(name).kind.split(":")[0]
                if kind in ("str", "bytes") and i + 1 < len(self.fields):
                    raise SchemaError(f"face {self.name}: {name} has no fixed width and must be last")
                if kind in ("f64", "vector", "variant"):
                    raise SchemaError(f"face {self.name}: {name} has no order")
        for name in self.key or ():
            if name not in schema.key_names:
                raise SchemaError(f"face {self.name}: {name} is not in the key")


class Collection:
    def __init__(self, rows: DataFrame, key: Sequence[str], faces: Sequence[Face] = (), open_half: DataFrame | None = None, open_column: str = "open") -> None:
        """``open_half``: key columns and the VARIANT column ``open_column``, for documents that have one."""
        self.rows, self.key, self.open_half, self.open_column = rows, list(key), open_half, open_column
        self.faces = {f.name: f for f in faces}

    # point reads

    def _is(self, key: dict) -> Column:
        if set(key) != set(self.key):
            raise ValueError(f"a point read names the whole key {self.key}")
        return reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in key.items()])

    def get(self, **key) -> DataFrame:
        return self.rows.where(self._is(key))

    def has(self, **key) -> bool:
        return not self.rows.where(self._is(key)).select(*self.key).isEmpty()

    def has_frame(self, **key) -> DataFrame:
        return self.rows.where(self._is(key)).agg((F.count("*") > 0).alias("found"))

    def get_parts(self, **key) -> DataFrame:
        """One row (row, open): the declared half as a struct and the open half, each null where absent."""
        spark = self.rows.sparkSession
        one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in key.items()])
        row = self.get(**key).select(*self.key, F.struct(*[c for c in self.rows.columns if c not in self.key]).alias("row"))
        out = one.join(row, self.key, "left")
        if self.open_half is not None:
            out = out.join(self.open_half.where(self._is(key)).select(*self.key, F.col(self.open_column).alias("open")), self.key, "left")
        else:
            out = out.withColumn("open", F.lit(None).cast("variant"))
        return out.select("row", "open")

    # scans by key

    def scan_keys(self, *prefix, reverse: bool = False, take: int | None = None, skip: int = 0) -> DataFrame:
        found = self.rows
        for k, v in zip(self.key, prefix, strict=False):
            found = found.where(F.col(k) == F.lit(v))
        return _page(found.select(*self.key), self.key, (), reverse, take, skip)

    def all(self) -> DataFrame:
        return self.rows

    def document_keys(self) -> KeySet:
        """Keys of rows and of documents that only have an open half."""
        keys = self.rows.select(*self.key)
        return KeySet(keys if self.open_half is None else keys.union(self.open_half.select(*self.key)))

    def raw_documents(self) -> DataFrame:
        """Every document with its declared half as a struct, null where only the open half exists."""
        row = self.rows.select(*self.key, F.struct(*[c for c in self.rows.columns if c not in self.key]).alias("row"))
        if self.open_half is None:
            return row
        return row.join(self.open_half.select(*self.key, F.col(self.open_column)), self.key, "full")

    # faces

    def face(self, face: str | Face) -> DataFrame:
        """The entries of a face: its fields, the key, and all columns of the row beside them."""
        f = self.faces[face] if isinstance(face, str) else face
        rows = self.rows
        if f.where is not None:
            rows = rows.where(f.where(rows))
        if f.path is not None:
            source = self.open_half if self.open_half is not None else rows
            if self.open_half is not None and f.where is None:
                rows = source
            elif self.open_half is not None:
                rows = rows.join(source, self.key)
            return rows.withColumn(f.fields[0], F.explode(paths.leaves(F.col(self.open_column), *f.path)))
        if f.func is not None:
            value = f.func(rows)
            return rows.withColumn(f.fields[0], F.explode(F.array_distinct(value)) if f.many else value)
        return rows

    def _entries(self, f: Face, rows: DataFrame, parts: Sequence[str], ordered: bool, reverse: bool, take: int | None, skip: int) -> DataFrame:
        tail = list(f.key or self.key)
        named = {FIELDS: list(f.fields), KEY: tail, INCLUDE: list(f.includes), ROW: [] if f.key else list(self.rows.columns)}
        wanted = list(dict.fromkeys(c for p in parts for c in named[p]))
        sort = list(dict.fromkeys([*f.fields, *tail]))
        if f.key:  # entries of one key are one entry
            rows = rows.select(*dict.fromkeys([*sort, *wanted])).distinct()
        if not (ordered or reverse or skip or take is not None):
            return rows.select(*wanted)
        return _page(rows, sort, f.reverse, reverse, take, skip).select(*wanted)

    def _probed(self, f: Face, probe: Sequence, exact: bool) -> DataFrame:
        if len(probe) > len(f.fields) or exact and len(probe) != len(f.fields):
            raise ValueError(f"face {f.name} has the fields {f.fields}; the probe names {len(probe)}")
        rows = self.face(f)
        for i, (name, value) in enumerate(zip(f.fields, probe, strict=False)):
            last_text = isinstance(value, str) and i + 1 == len(f.fields) and not exact
            rows = rows.where(F.col(name).startswith(value) if last_text else F.col(name) == F.lit(value))
        return rows

    def scan(self, face: str | Face, *probe, parts: Sequence[str] = (FIELDS, KEY, ROW), ordered: bool = False, reverse: bool = False, take: int | None = None, skip: int = 0) -> DataFrame:
        """Entries whose leading fields equal the probe; text for the last field is a prefix of it."""
        f = self.faces[face] if isinstance(face, str) else face
        return self._entries(f, self._probed(f, probe, False), parts, ordered, reverse, take, skip)

    def exact(self, face: str | Face, *probe, parts: Sequence[str] = (FIELDS, KEY, ROW), ordered: bool = False) -> DataFrame:
        f = self.faces[face] if isinstance(face, str) else face
        return self._entries(f, self._probed(f, probe, True), parts, ordered, False, None, 0)

    def range(self, face: str | Face, low=None, high=None, parts: Sequence[str] = (FIELDS, KEY, ROW), ordered: bool = False) -> DataFrame:
        """Entries whose first field is in [low, high)."""
        f = self.faces[face] if isinstance(face, str) else face
        rows = self.face(f)
        if low is not None:
            rows = rows.where(F.col(f.fields[0]) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(f.fields[0]) < F.lit(high))
        return self._entries(f, rows, parts, ordered, False, None, 0)

    def count(self, face: str | Face, *probe) -> DataFrame:
        f = self.faces[face] if isinstance(face, str) else face
        return self._probed(f, probe, False).agg(F.count("*").alias("entries"))

    def covered(self, face: str | Face, *probe, ordered: bool = False) -> DataFrame:
        return self.scan(face, *probe, parts=(FIELDS, KEY, INCLUDE), ordered=ordered)

    def entry_keys(self, face: str | Face, *probe) -> KeySet:
        f = self.faces[face] if isinstance(face, str) else face
        return KeySet(self._probed(f, probe, False), list(f.key or self.key))

    def faces_status(self) -> list[dict]:
        """What each face is: (name, kind, fields, includes); faces are views and always current."""
        kind = lambda f: "path" if f.path else "function" if f.func else "lead" if f.lead else "plain"
        return [{"name": f.name, "kind": kind(f), "fields": list(f.fields), "includes": list(f.includes), "partial": f.where is not None} for f in self.faces.values()]

    def materialize(self, face: str, path: str) -> DataFrame:
        """Rebuilds a face as files sorted by its fields, so that scans skip by statistics."""
        f = self.faces[face]
        sort = list(dict.fromkeys([*f.fields, *(f.key or self.key)]))
        entries = self._entries(f, self.face(f), (FIELDS, KEY, INCLUDE), False, False, None, 0)
        entries.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(path)
        return self.rows.sparkSession.read.parquet(path)

    def with_rows(self, rows: DataFrame) -> Collection:
        return Collection(rows, self.key, list(self.faces.values()), self.open_half, self.open_column)

    def with_face(self, face: Face, **changes) -> Collection:
        return Collection(self.rows, self.key, [*self.faces.values(), replace(face, **changes)], self.open_half, self.open_column)


def _page(rows: DataFrame, sort: Sequence[str], descending: Sequence[str], reverse: bool, take: int | None, skip: int) -> DataFrame:
    order = [F.col(c).desc() if (c in descending) != reverse else F.col(c).asc() for c in sort]
    rows = rows.orderBy(*order)
    if skip:
        rows = rows.offset(skip)
    return rows if take is None else rows.limit(take)


def take_while(rows: DataFrame, order: Sequence[str], holds: Column) -> DataFrame:
    """Rows before the first, in order, of which the condition does not hold."""
    cut = rows.where(~F.coalesce(holds, F.lit(False))).agg(F.min(F.struct(*order)).alias("__cut"))
    return rows.join(F.broadcast(cut)).where(F.col("__cut").isNull() | (F.struct(*order) < F.col("__cut"))).drop("__cut")
