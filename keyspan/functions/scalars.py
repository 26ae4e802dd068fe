"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def ngrams(text: Column, n: int) -> Column:
    """Windows of ``n`` code points; a shorter text is its own only window, the empty one too."""
    if n < 1:
        raise ValueError("n-grams need n >= 1")
    size = F.char_length(text)
    # shifted arrays of characters, joined place by place: substring would count from the start each time
    characters, count = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), F.greatest(size - n + 1, F.lit(0))
    windows = F.slice(characters, F.lit(1), count)
    for shift in range(1, n):
        windows = F.zip_with(windows, F.slice(characters, F.lit(shift + 1), count), lambda a, b: F.concat(a, b))
    return F.when(size < n, F.array(text)).otherwise(windows)


def bm25(tf: Column, length: Column, mean_length: Column, df: Column, total: Column) -> Column:
    idf = F.log((total - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def dist2(a: Column, b: Column) -> Column:
    """Squared distance: differences in single precision, summed in double; the longer vector is cut."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def bucket_id(v: Column, step: float) -> Column:
    """The grid cell of a vector: each place over ``step``, rounded half away from zero, within 16 bits."""

    def cell(x: Column) -> Column:
        return F.greatest(F.least(F.round((x / F.lit(step).cast("float")).cast("float")), F.lit(32767.0)), F.lit(-32768.0)).cast("short")

    return F.transform(v, cell)


def quantize(x: Column, places: int) -> Column:
    """``x`` in units of ten to minus ``places``; NaN and what leaves 64 bits are errors."""
    scaled = F.round(x.cast("double") * float(10**places))
    # 2**63 itself is the first double beyond the range
    bad = F.isnan(x.cast("double")) | (scaled >= 2.0**63) | (scaled < -(2.0**63))
    return F.when(bad, F.raise_error(F.lit("not a quantity: NaN or out of range")).cast("bigint")).otherwise(scaled.cast("bigint"))


def dequantize(x: Column, places: int) -> Column:
    return x.cast("double") / float(10**places)


def offset_encode(x: Column, base: int) -> Column:
    """``x - base``, which must fit 32 unsigned bits."""
    delta = x.cast("bigint") - base
    return F.when((delta < 0) | (delta >= 2**32), F.raise_error(F.lit(f"out of [{base}, {base} + 2^32)")).cast("bigint")).otherwise(delta)


def offset_decode(delta: Column, base: int) -> Column:
    return delta.cast("bigint") + base


def uuid_bytes(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, "-", ""))


def uuid7_millis(raw: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, 1, 6)), 16, 10).cast("bigint")


def bucket_of(ts: Column, per_second: int, seconds: int) -> Column:
    """The time bucket of a time stamp of ``per_second`` units."""
    return F.floor(F.floor(ts / per_second) / seconds).cast("bigint")


def with_entry(m: Column, name: str, value: Column) -> Column:
    """The map with an entry set; an old one keeps its place."""
    changed = F.transform_values(m, lambda k, v: F.when(k == name, value).otherwise(v))
    return F.when(F.map_contains_key(m, name), changed).otherwise(F.map_concat(m, F.create_map(F.lit(name), value)))


def without_entry(m: Column, name: str) -> Column:
    return F.map_filter(m, lambda k, v: k != name)


def same_entries(a: Column, b: Column) -> Column:
    """Equality of maps whatever their order."""
    return F.sort_array(F.map_entries(a)) == F.sort_array(F.map_entries(b))


def merged_maps(a: Column, b: Column) -> Column:
    """``a`` with the entries of ``b`` over it; one level."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
