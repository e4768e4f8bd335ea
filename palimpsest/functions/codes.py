"""Sign-bit codes of vectors, as arrays of 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(vector: Column | str, dim: int) -> Column:
    """One bit per component, set where it is above zero (NaN is not), first
    component first; null if the vector is null or of another length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    if dim % 64:
        raise ValueError("the length must be a multiple of 64")

    def word(k: int) -> Column:
        bits = F.transform(F.slice(v, k * 64 + 1, 64), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(v) == dim, F.array(*(word(k) for k in range(dim // 64))))


def popcount(code: Column) -> Column:
    """Set bits of a code."""
    return F.aggregate(code, F.lit(0), lambda a, w: a + F.bit_count(w)).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Unlike bits of two codes of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n).cast("long")


def hamming_to(code: Column, query: list[int]) -> Column:
    """Unlike bits of a code and a literal one: unrolled, so that it is compiled."""
    total = F.lit(0)
    for k, w in enumerate(query):
        total = total + F.bit_count(code[k].bitwiseXOR(F.lit(w).cast("long")))
    return total.cast("long")


def filled(code: Column) -> Column:
    """Whether a slot holds a code: not null and not all zero."""
    return code.isNotNull() & F.exists(code, lambda w: w != 0)


def spell(code: Column) -> Column:
    """Upper-case hexadecimal digits of a code."""
    return F.array_join(F.transform(code, lambda w: F.lpad(F.hex(w), 16, "0")), "")
