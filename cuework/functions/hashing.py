"""Content keys, gradient hashes and Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(*cols: Column | str) -> Column:
    """SHA-256 of the parts joined by the unit separator."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("None"))
             for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def gradient_hash(values: Column | str, row_len: int, rows: int) -> Column:
    """One bit per neighbouring pair inside each row (1 when the left value is larger).

    First pair in the highest bit; up to 64 bits, held in a BIGINT.
    """
    v = F.col(values) if isinstance(values, str) else values
    out = F.lit(0).cast("long")
    for r in range(rows):
        for c in range(row_len - 1):
            i = r * row_len + c + 1
            bit = F.when(F.element_at(v, i) > F.element_at(v, i + 1), F.lit(1)).otherwise(F.lit(0))
            out = F.shiftleft(out, 1).bitwiseOR(bit.cast("long"))
    return out


def gradient_hash_long(values: Column | str) -> Column:
    """The same over one row of any length up to 65 values, as a fold (no unrolled expression)."""
    v = F.col(values) if isinstance(values, str) else values
    bits = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1),
                      lambda a, b: F.when(a > b, F.lit(1).cast("long")).otherwise(
                          F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"),
                       lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def hash_from_hex(col: Column | str) -> Column:
    """Up to 16 hex digits to BIGINT; the top bit becomes the sign."""
    h = F.lpad(F.col(col) if isinstance(col, str) else col, 16, "0")
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hash_to_hex(col: Column | str) -> Column:
    return F.lower(F.hex(F.col(col) if isinstance(col, str) else col))


def hamming(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.bit_count(a.bitwiseXOR(b))
