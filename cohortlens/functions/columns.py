"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Exact rounding of integer ratios (engine independent, half up)
# ---------------------------------------------------------------------------
def idiv(a, b) -> Column:
    """Integer division (SQL ``a div b``), exact for BIGINT operands."""
    return F.call_function("div", _c(a).cast("bigint"), _c(b).cast("bigint"))


def ratio_round(num, den, digits: int) -> Column:
    """``round(num / den, digits)`` half-up, computed with integer division.

    ``num`` and ``den`` must be non-negative integer columns and ``den > 0``.
    The result is a DOUBLE equal to ``k / 10**digits`` for the exact integer k,
    so every engine that divides an integer by a power of ten agrees bit for bit.
    """
    scale = 10 ** digits
    n = _c(num).cast("bigint")
    d = _c(den).cast("bigint")
    return idiv(F.lit(2 * scale) * n + d, F.lit(2) * d) / F.lit(float(scale))


def pct_round(part, total, digits: int = 1) -> Column:
    """Percentage ``part / total * 100`` rounded half-up; 0 when total is 0."""
    return F.when(_c(total) == 0, F.lit(0.0)).otherwise(
        ratio_round(_c(part).cast("bigint") * F.lit(100), total, digits)
    )


def int_round(num, den) -> Column:
    """JavaScript ``Math.round(num / den)`` for non-negative integers."""
    return idiv(F.lit(2) * _c(num).cast("bigint") + _c(den).cast("bigint"),
                F.lit(2) * _c(den).cast("bigint"))


# Decimal numbers as a CSV reader takes them, infinities included.
DECIMAL = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


# ---------------------------------------------------------------------------
# Text normalisation
# ---------------------------------------------------------------------------
def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace (tabs, line ends and Unicode blanks included)."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_na_token(c) -> Column:
    """True where a raw text field is missing in the sense of a pandas CSV read."""
    return _c(c).isNull() | _c(c).isin(S.NA_TOKENS)


def normalize_gender(c) -> Column:
    """Text, strip, title case; a missing value turns into the text ``Nan``."""
    return F.when(is_na_token(c), F.lit("Nan")).otherwise(F.initcap(strip_ws(c)))


def to_number(c) -> Column:
    """Numeric coercion; anything unparsable, missing or NaN becomes NULL.

    Only decimal text counts (``12d`` and ``0x1p3``, which a cast would take,
    do not); every missing-value token fails that pattern, so no token list is
    needed.
    """
    return F.when(_c(c).rlike(DECIMAL), _c(c).try_cast("double"))


# ---------------------------------------------------------------------------
# Derived columns
# ---------------------------------------------------------------------------
def gender_enc(gender=S.GENDER) -> Column:
    return (_c(gender) == F.lit("Female")).cast("int")


def r_band(score=S.SCORE) -> Column:
    s = _c(score)
    return (F.when(s >= S.R_HIGH, "High").when(s >= S.R_MODERATE, "Moderate").otherwise("Low"))


def f_band(age=S.AGE) -> Column:
    a = _c(age)
    return (F.when(a <= S.F_HIGH, "High").when(a <= S.F_MODERATE, "Moderate").otherwise("Low"))


def m_band(income=S.INCOME) -> Column:
    i = _c(income)
    return (F.when(i >= S.M_HIGH, "High").when(i >= S.M_MODERATE, "Moderate").otherwise("Low"))


def rule_segment(income=S.INCOME, score=S.SCORE) -> Column:
    """Segment from income and score thresholds, Loyal as the fallback."""
    i, s = _c(income), _c(score)
    return (
        F.when((i >= 70) & (s >= 60), S.VIP)
        .when((i >= 40) & (i < 70), S.LOYAL)
        .when((i < 40) & (s >= 55), S.DISCOUNT)
        .when((i < 40) & (s < 55), S.AT_RISK)
        .when((i >= 70) & (s < 60), S.NEW)
        .otherwise(S.LOYAL)
    )



def behaviour_level(behaviour, letter: str) -> Column:
    """``High X`` in the behaviour text -> High, ``Low X`` -> Low, else Moderate."""
    b = _c(behaviour)
    return (
        F.when(F.instr(b, f"High {letter}") > 0, "High")
        .when(F.instr(b, f"Low {letter}") > 0, "Low")
        .otherwise("Moderate")
    )


def confidence(dist) -> Column:
    """``clamp(round(100 - 2 * dist, 1), 0, 100)``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.lit(100.0) - F.lit(2.0) * _c(dist), 1)))
