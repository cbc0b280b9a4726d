"""Scalar genetics and report functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero as zero: comparable across engines."""
    return F.round(x, digits) + F.lit(0.0)


def decode_call(byte: Column, place: Column) -> Column:
    """Dosage of the call at ``place`` (0 to 3) of a packed byte; 01 is missing."""
    code = F.shiftright(byte, 0).bitwiseAND(F.lit(255))
    two = F.floor(code / F.pow(F.lit(4), place)).cast("int").bitwiseAND(F.lit(3))
    return F.when(two == 0, 2).when(two == 2, 1).when(two == 3, 0)


def centred(dosage: Column, p: Column, ploidy: int = 2) -> Column:
    """Dosage less its expectation; a missing call is at the mean, 0."""
    return F.coalesce(dosage - ploidy * p, F.lit(0.0))


def recovered_dosage(z: Column, p: Column, ploidy: int = 2) -> Column:
    return F.round(z + ploidy * p).cast("int")


def recoded_sex(text: Column, unknown: str = "error") -> Column:
    """Male or not; null stays null. A text that says neither is an error, or
    null with ``unknown='null'``."""
    t = F.lower(F.trim(text.cast("string")))
    other = F.lit(None).cast("boolean") if unknown == "null" else F.raise_error(F.concat(F.lit("unknown sex code: "), text.cast("string"))).cast("boolean")
    return F.when(t.isin("m", "male", "1"), True).when(t.isin("f", "female", "2"), False).when(t.isNotNull(), other)


def effective_parents(c: Column) -> Column:
    """Aggregate: 1 / sum of squared contributions."""
    return 1 / F.sum(c * c)


def delta_f_percent(effective: Column) -> Column:
    """Rate of inbreeding of a generation in per cent."""
    return 50 / effective


def half_weight(count_of_sex: Column) -> Column:
    """An equal contribution within a sex that has half of the whole."""
    return 0.5 / count_of_sex


def markers_for(n: Column) -> Column:
    """Markers of a scaling point with n candidates."""
    return F.greatest(F.lit(20000), 2 * n)


def footprint_bytes(n: Column, m: Column) -> dict[str, Column]:
    """Bytes of the genotypes as doubles, as 2-bit calls, and of a dense matrix."""
    return {"dense_z": 8 * n * m, "packed_z": m * F.ceil(n / 4), "dense_g": 8 * n * n}


#: How a growth exponent up to each limit compares with cubic growth: fixed values.
GROWTH = ((2.85, "sub-cubic"), (3.15, "essentially cubic"), (3.6, "marginally super-cubic"), (float("inf"), "super-cubic"))


def cubic_label(exponent: Column) -> Column:
    """How a growth exponent compares with cubic growth; 'undefined' for null."""
    out = F.when(exponent.isNull(), "undefined").when(exponent < GROWTH[0][0], GROWTH[0][1])
    for limit, label in GROWTH[1:-1]:
        out = out.when(exponent <= limit, label)
    return out.otherwise(GROWTH[-1][1])


def real_roots(a: Column, b: Column, c: Column) -> Column:
    """Ascending array of the real roots of a x^2 + b x + c; a leading term
    that is negligible against the others leaves the linear equation."""
    tiny = 1e-14 * F.greatest(F.lit(1.0), F.abs(a) + F.abs(b) + F.abs(c))
    linear = F.when(F.abs(b) > tiny, F.array(-c / b)).otherwise(F.array().cast("array<double>"))
    rest = b * b - 4 * a * c
    both = F.sort_array(F.array((-b - F.sqrt(F.greatest(rest, F.lit(0.0)))) / (2 * a), (-b + F.sqrt(F.greatest(rest, F.lit(0.0)))) / (2 * a)))
    return F.when(F.abs(a) <= tiny, linear).when(rest < 0, F.array().cast("array<double>")).otherwise(both)


def packed_bytes(calls: Column) -> Column:
    """Four 2-bit codes of an array a byte, the first in the low bits, as binary."""
    at = lambda i, k: F.coalesce(F.get(calls, 4 * i + k), F.lit(0)).bitwiseAND(F.lit(3))
    byte = lambda i: at(i, 0) + 4 * at(i, 1) + 16 * at(i, 2) + 64 * at(i, 3)
    starts = F.sequence(F.lit(0), F.ceil(F.size(calls) / 4).cast("int") - 1)
    return F.unhex(F.array_join(F.transform(starts, lambda i: F.lpad(F.hex(byte(i).cast("long")), 2, "0")), ""))
