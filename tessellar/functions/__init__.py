"""Scalar functions: content identity, exact whole numbers, times, waits, rasters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cameras in their canonical order.
CAMERAS = (1, 2, 3, 4, 5, 6)


def json_string(value: Column) -> Column:
    """A string as RFC 8785 writes it: only quotes, backslashes and control characters are escaped."""
    out = F.regexp_replace(value, r"(\\|\")", r"\\$1")
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    for k in range(32):
        out = F.replace(out, F.lit(chr(k)), F.lit(short.get(chr(k), f"\\u{k:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(kinds: dict[str, T.DataType], **fields: Column) -> Column:
    """The fields as one canonical JSON object (RFC 8785): names in order of
    their UTF-16 units, no white space, strings escaped as little as may be,
    whole numbers plain (within 2^53: an error beyond), null for null.
    kinds: the type of each field: string, whole number or boolean."""
    parts = []
    for k in sorted(fields, key=lambda n: n.encode("utf-16-be")):
        v, kind = fields[k], kinds[k]
        if isinstance(kind, T.StringType):
            text = json_string(v)
        elif isinstance(kind, T.BooleanType):
            text = v.cast("string")
        elif isinstance(kind, T.IntegralType):
            text = F.when(F.abs(v.cast("decimal(20,0)")) <= (1 << 53) - 1, v.cast("string")).otherwise(F.when(v.isNotNull(), F.raise_error(F.lit("a whole number beyond 2^53 has no canonical JSON")).cast("string")))
        else:
            raise TypeError(f"no canonical JSON for {kind.simpleString()}")
        parts.append(F.concat(F.lit(f'"{k}":'), F.coalesce(text, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_digest(kinds: dict[str, T.DataType], **fields: Column) -> Column:
    """SHA-256 of the fields' canonical JSON: the same for the same content."""
    return F.sha2(canonical_json(kinds, **fields), 256)


def recording_identity(namespace: str, content_sha256: Column) -> Column:
    """The identity of a recording: of its namespace and its content's digest alone."""
    ok = F.when(content_sha256.rlike("^[0-9a-f]{64}$"), content_sha256).otherwise(F.raise_error(F.lit("a digest has 64 lowercase hexadecimal characters")).cast("string"))
    return content_digest({"namespace": T.StringType(), "source_content_sha256": T.StringType()}, namespace=F.lit(namespace), source_content_sha256=ok)


def length_prefixed(*parts: Column) -> Column:
    """One key from several strings, none confusable with another."""
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def bucket(n: Column, width: int) -> Column:
    """floor(n / width) of longs, exact: no double comes in between."""
    whole = n.cast("long") - F.pmod(n.cast("long"), F.lit(width).cast("long"))
    return F.call_function("div", whole, F.lit(width).cast("long"))


def ceil_div(n: Column, d: int) -> Column:
    return -bucket(-n.cast("long"), d)


def half_up(n: Column, d: int) -> Column:
    """n / d rounded to a whole number, halves up."""
    return bucket(2 * n.cast("long") + d, 2 * d)


def checked_long(n: Column) -> Column:
    """A wide whole number as a long; beyond its range is an error."""
    wide = n.cast("decimal(38,0)")
    return F.when(wide.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")), wide.cast("long")).otherwise(F.raise_error(F.lit("a time is beyond 64 bits")).cast("long"))


def backoff(attempt: Column, base: int, most: int) -> Column:
    """base * 2^(attempt - 1), at most `most`."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def rfc3339(ns: Column) -> Column:
    """Nanoseconds since 1970 as UTC text with nine decimals."""
    second = bucket(ns, 1_000_000_000)
    day, rest = bucket(second, 86_400), F.pmod(second, F.lit(86_400).cast("long"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    clock = F.concat_ws(":", two(bucket(rest, 3600)), two(bucket(F.pmod(rest, F.lit(3600).cast("long")), 60)), two(F.pmod(rest, F.lit(60).cast("long"))))
    return F.concat(date, F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000).cast("long")).cast("string"), 9, "0"), F.lit("Z"))


def complete_slots(slots: Column) -> Column:
    """Whether a map has exactly the six cameras as its keys."""
    return F.array_sort(F.map_keys(slots)) == F.array(*[F.lit(c) for c in CAMERAS])


def luma(pixels: Column, black: int, white: int) -> Column:
    """mean_milli, black_ppm and over_ppm of an array of brightnesses: whole
    parts of exact sums; null for none."""
    n = F.size(pixels).cast("long")
    total = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    share = lambda test: F.call_function("div", F.size(F.filter(pixels, test)).cast("long") * 1_000_000, n)
    return F.when(n > 0, F.struct(F.call_function("div", total * 1000, n).alias("mean_milli"), share(lambda x: x <= black).alias("black_ppm"), share(lambda x: x >= white).alias("over_ppm")))


def motion_energy(now: Column, before: Column) -> Column:
    """The mean absolute difference of two rasters of one size; null without the one before."""
    total = F.aggregate(F.zip_with(now, before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(before.isNotNull(), total / F.size(now))


def window_fps(covered_ns: Column, window_ns: Column, base: float, raised: float) -> Column:
    """The mean rate of a window of which a part runs at the raised rate."""
    return base + (raised - base) * covered_ns / window_ns
