"""Content ids, canonical JSON, keyed hash draws and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**64 - 1 as a double: the largest value of 16 hex digits.
_TOP = 1.8446744073709552e19


def _text(value) -> Column:
    """A part of an id as text; null is written as such, since concat_ws would skip it."""
    c = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(c.cast("string"), F.lit("null"))


def joined(*parts) -> Column:
    return F.concat_ws("|", *[_text(p) for p in parts])


def content_id(prefix: str, *parts) -> Column:
    """PREFIX_ and the first 16 upper-case hex digits of SHA-256 over the |-joined parts."""
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(joined(*parts).cast("binary"), 256), 1, 16)))


def canonical_json(names: list[str]) -> Column:
    """Compact JSON of the named columns in the given order; nulls stay."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def hash_uniform(*parts, low: float = 0.0, high: float = 1.0) -> Column:
    """A number from [low, high] that depends on the parts only, whatever the row order."""
    digits = F.conv(F.substring(F.sha2(joined(*parts).cast("binary"), 256), 1, 16), 16, 10)
    return F.lit(low) + (high - low) * (digits.cast("decimal(20,0)").cast("double") / F.lit(_TOP))


def smoothed(successes: Column, attempts: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return (successes + F.lit(alpha)) / (attempts + F.lit(alpha + beta))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clipped(p, edge, 1 - edge)
    return F.log(q / (1 - q))


def half_even(value: Column, digits: int = 6) -> Column:
    return F.bround(value, digits)
