"""Native column expressions used across the operators.

Everything here builds a ``Column`` from built-in functions, so it stays
inside whole-stage codegen and has a DuckDB twin for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text that counts as a number when coercing a text column
# (sign, digits, optional fraction and exponent, or inf / infinity / nan,
# case-insensitive, blanks around allowed).
NUMERIC_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"

# The name characters kept by slugify; every other run becomes "_",
# then "_" and "-" are trimmed from both ends.
SLUG_KEEP = "A-Za-z0-9_-"


def order_key(seed, *keys) -> Column:
    """Reproducible random order: ``md5(seed ':' key)`` as hex text.

    The same text hashes equally in Spark and DuckDB, so any split, fold or
    sample ordered by it has an exact SQL oracle.
    """
    parts = [F.lit(str(seed)), F.lit(":")]
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit(":"))
        parts.append(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"))
    return F.md5(F.concat(*parts))


def unit_noise(seed, *keys) -> Column:
    """Deterministic noise in [-1, 1): first 32 bits of the md5 order key."""
    h = F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double")
    return h / F.lit(2.0 ** 32) * F.lit(2.0) - F.lit(1.0)


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1 as a native expression: shift by 6, then the
    asymptotic series (absolute error below 1e-10 for x >= 1)."""
    z = x + F.lit(6.0)
    shift = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(6)), F.lit(0.0))
    z2 = z * z
    series = (F.log(z) - F.lit(0.5) / z - F.lit(1.0 / 12.0) / z2
              + F.lit(1.0 / 120.0) / (z2 * z2) - F.lit(1.0 / 252.0) / (z2 * z2 * z2)
              + F.lit(1.0 / 240.0) / (z2 * z2 * z2 * z2))
    return series - shift


def clean_double(c: Column) -> Column:
    """NaN counts as missing: map it to NULL."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def coerce_text_number(c: Column) -> Column:
    """Text to double, NULL where the text is not a number (no '12d')."""
    s = c.cast("string")
    return clean_double(F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double")))


def slugify(c: Column) -> Column:
    """Runs of characters outside [A-Za-z0-9_-] become '_'; trim '_' and '-'."""
    s = F.regexp_replace(c, f"[^{SLUG_KEEP}]+", "_")
    return F.regexp_replace(s, r"^[_-]+|[_-]+$", "")


def r6(c: Column) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (for oracle comparison)."""
    return F.round(c, 6) + F.lit(0.0)
