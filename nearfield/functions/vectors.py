"""Vector and scalar expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v / (|v| + 1e-12) in double precision."""
    v = v.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-12)
    return F.transform(v, lambda x: x / length)


def pool_tokens(tokens: Column, skip: int = 1, mean: bool = True) -> Column:
    """First token, followed on request by the mean of the tokens after the first `skip` ones (prefix and register tokens)."""
    first = F.element_at(tokens, 1)
    if not mean:
        return first
    rest = F.slice(tokens, skip + 1, F.size(tokens))
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate(rest, zero, lambda s, t: F.zip_with(s, t.cast("array<double>"), lambda a, b: a + b))
    return F.concat(first.cast("array<double>"), F.transform(total, lambda x: x / F.size(rest)))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def token(c: Column, keep: str = "", default: str = "value") -> Column:
    """Runs of other characters than letters, digits and `keep` become one underscore; none at the ends; never empty."""
    out = F.regexp_replace(strip(c), f"[^A-Za-z0-9{keep}]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def finite(c: Column) -> Column:
    """The value, or null where it isn't a finite number: medians and percentiles skip nulls but rank NaN highest."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) <= 1.7976931348623157e308), c)


def has_tag(tags: Column, domain: str) -> Column:
    """Membership in a semicolon-separated list."""
    return F.array_contains(F.transform(F.split(tags, ";"), lambda x: F.trim(x)), domain)


def status(share: Column) -> Column:
    """Band of a support share."""
    s = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.when(s < 0.25, "critical").when(s < 0.5, "warning").otherwise("good")
