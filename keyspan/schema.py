"""Declared schemas: field kinds, keys, defaults, and what a declaration may not say."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A declaration, or data that does not match one."""


#: Spark types of the field kinds; quant and vector take a parameter after a colon.
KINDS: dict[str, Callable[[str], T.DataType]] = {
    "u8": lambda _: T.ShortType(), "u16": lambda _: T.IntegerType(), "u32": lambda _: T.LongType(),
    "u64": lambda _: T.DecimalType(20, 0), "varint": lambda _: T.DecimalType(20, 0),
    "i8": lambda _: T.ByteType(), "i16": lambda _: T.ShortType(), "i32": lambda _: T.IntegerType(), "i64": lambda _: T.LongType(),
    "f64": lambda _: T.DoubleType(), "bool": lambda _: T.BooleanType(), "str": lambda _: T.StringType(), "vocab": lambda _: T.StringType(),
    "bytes": lambda _: T.BinaryType(), "fixed_bytes": lambda _: T.BinaryType(), "secret": lambda _: T.BinaryType(),
    "uuid4": lambda _: T.BinaryType(), "uuid7": lambda _: T.BinaryType(),
    "quant": lambda p: T.DecimalType(18, int(p or 0)), "offset": lambda _: T.LongType(),
    "vector": lambda p: T.ArrayType({"f32": T.FloatType(), "i32": T.IntegerType(), "u32": T.LongType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "str": T.StringType()}[p or "f32"]),
    "variant": lambda _: T.VariantType(),
}
NOT_IN_KEYS = ("str", "bytes", "vocab", "f64", "vector", "variant", "secret")
INTEGERS = ("u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "varint")
#: Greatest values of unsigned kinds and bases of offsets are checked at import.
UNSIGNED = {"u8": 2**8, "u16": 2**16, "u32": 2**32}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    optional: bool = False
    default: object = None
    redact: bool = False
    reverse: bool = False
    base: int = 0
    length: int | None = None

    def __post_init__(self) -> None:
        if self.kind.split(":")[0] not in KINDS:
            raise SchemaError(f"{self.name}: no kind {self.kind!r}")
        if self.reverse and self.kind not in INTEGERS:
            raise SchemaError(f"{self.name}: only integers have a reverse order")

    @property
    def data_type(self) -> T.DataType:
        name, _, parameter = self.kind.partition(":")
        return KINDS[name](parameter)


@dataclass(frozen=True)
class CollectionSchema:
    """A collection: key fields first, then declared fields, and perhaps an open half in one VARIANT column."""

    name: str
    key: tuple[Field, ...]
    fields: tuple[Field, ...] = ()
    open: str | None = None
    partition: str | None = None
    generation: int = 1
    uncaptured: bool = False
    faces: tuple = field(default=())

    def __post_init__(self) -> None:
        if not self.key:
            raise SchemaError(f"{self.name}: a collection needs a key")
        for f in self.key:
            if f.kind.split(":")[0] in NOT_IN_KEYS or f.optional:
                raise SchemaError(f"{self.name}.{f.name}: a key field has a fixed width and is never null")
        names = [f.name for f in (*self.key, *self.fields)] + ([self.open] if self.open else [])
        if len({n.lower() for n in names}) != len(names):
            raise SchemaError(f"{self.name}: two fields share a name")
        if self.partition and self.partition not in {f.name for f in self.key}:
            raise SchemaError(f"{self.name}: only a key field can be the partition")
        for face in self.faces:
            face.check(self)

    @property
    def key_names(self) -> list[str]:
        return [f.name for f in self.key]

    def field_of(self, name: str) -> Field:
        for f in (*self.key, *self.fields):
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name!r}")

    def struct(self) -> T.StructType:
        out = [T.StructField(f.name, f.data_type, False) for f in self.key]
        out += [T.StructField(f.name, f.data_type, True) for f in self.fields]
        return T.StructType(out + ([T.StructField(self.open, T.VariantType(), True)] if self.open else []))

    def to_json(self) -> str:
        """The declaration as data."""

        def one(f: Field) -> dict:
            return {k: v for k, v in vars(f).items() if v not in (None, False, 0) or k in ("name", "kind")} | {"spark": f.data_type.simpleString()}

        return json.dumps({"name": self.name, "generation": self.generation, "key": [one(f) for f in self.key], "fields": [one(f) for f in self.fields], "open": self.open, "partition": self.partition}, indent=1)

    @staticmethod
    def from_json(text: str) -> CollectionSchema:
        d = json.loads(text)
        fields = {k: tuple(Field(**{n: v for n, v in f.items() if n != "spark"}) for f in d[k]) for k in ("key", "fields")}
        return CollectionSchema(d["name"], fields["key"], fields["fields"], d["open"], d["partition"], d["generation"])

    def conform(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """``df`` in this schema: absent fields take their defaults, types must widen without loss, extra columns are refused if ``strict``."""
        have = {c.lower(): c for c in df.columns}
        wanted = [*self.key, *self.fields]
        extra = set(have) - {f.name.lower() for f in wanted} - ({self.open.lower()} if self.open else set())
        if strict and extra:
            raise SchemaError(f"{self.name}: undeclared columns {sorted(extra)}")
        out: list[Column] = []
        for f in wanted:
            if f.name.lower() not in have:
                if f in self.key or (f.default is None and not f.optional):
                    raise SchemaError(f"{self.name}: column {f.name} is missing")
                out.append(F.lit(f.default).cast(f.data_type).alias(f.name))
                continue
            column = df[have[f.name.lower()]]
            own = df.schema[have[f.name.lower()]].dataType
            if not _widens(own, f.data_type):
                raise SchemaError(f"{self.name}.{f.name}: {own.simpleString()} is not {f.data_type.simpleString()}")
            cast = column.cast(f.data_type)
            if f.default is not None:
                cast = F.coalesce(cast, F.lit(f.default).cast(f.data_type))
            bad = F.lit(False)
            if f in self.key:
                bad = bad | cast.isNull()
            if f.kind in UNSIGNED:
                bad = bad | F.coalesce((cast < 0) | (cast >= UNSIGNED[f.kind]), F.lit(False))
            if f.kind == "offset":
                bad = bad | F.coalesce((cast < f.base) | (cast >= f.base + 2**32), F.lit(False))
            if f.length is not None:
                bad = bad | F.coalesce(F.size(cast) != f.length, F.lit(False))
            out.append(F.when(bad, F.raise_error(F.lit(f"{self.name}.{f.name}: a value does not fit {f.kind}")).cast(f.data_type)).otherwise(cast).alias(f.name))
        if self.open:
            out.append((df[have[self.open.lower()]] if self.open.lower() in have else F.lit(None).cast("variant")).alias(self.open))
        return df.select(*out)

    def exported(self, df: DataFrame) -> DataFrame:
        """``df`` with redacted fields null."""
        hidden = {f.name: F.lit(None).cast(f.data_type) for f in self.fields if f.redact or f.kind == "secret"}
        return df.withColumns(hidden) if hidden else df


_WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def _widens(own: T.DataType, to: T.DataType) -> bool:
    if own == to or isinstance(own, T.NullType):
        return True
    if type(own) in _WIDTHS:
        return type(to) in _WIDTHS and _WIDTHS[type(own)] <= _WIDTHS[type(to)] or isinstance(to, T.DecimalType) and to.precision - to.scale >= 19 or isinstance(to, T.DecimalType) and type(own) is not T.LongType and to.precision - to.scale >= 10
    if isinstance(own, T.DecimalType) and isinstance(to, T.DecimalType):
        return own.scale <= to.scale and own.precision - own.scale <= to.precision - to.scale
    if isinstance(own, T.ArrayType) and isinstance(to, T.ArrayType):
        return _widens(own.elementType, to.elementType)
    return isinstance(own, T.FloatType) and isinstance(to, T.DoubleType)
