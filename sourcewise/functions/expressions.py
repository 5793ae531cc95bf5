"""Column expressions shared by the operators: classes, units, text, flags, probabilities."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Divisor exponents of concentration units (case-sensitive, both micro signs).
UNIT_EXPONENT = {"M": 0, "mM": 3, "uM": 6, "µM": 6, "μM": 6, "nM": 9, "pM": 12}
# Relations seen from the negative logarithm.
FLIPPED = {">": "<", ">=": "<=", "<": ">", "<=": ">=", "=": "=", "~": "~"}


def clean_double(c: Column) -> Column:
    """The finite number in ``c``, else null; text that is no number gives null under ANSI too."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def heading(name: str) -> str:
    """Normal form of a column heading: lower case letters and digits only."""
    return re.sub("[^a-z0-9]+", "", name.strip().lower())


def class_of(value: Column, lower: float, upper: float) -> Column:
    """inactive up to ``lower``, active from ``upper``, medium between; both bounds inclusive."""
    return F.when(value <= lower, "inactive").when(value >= upper, "active").when(value.isNotNull(), "medium")


def unquote_relation(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^'([=<>~]+)'$", "$1")


def truthy(c: Column, kind: str = "string") -> Column:
    """Null is false; numbers are true unless 0; text is true for 1, true, t, yes, y."""
    if kind in ("string",):
        return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y"), F.lit(False))
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def p_value(value: Column, unit: Column) -> Column:
    """-log10 of a concentration in molar; null for values not above 0 and unknown units."""
    exponent = F.lit(None).cast("double")
    for name, e in UNIT_EXPONENT.items():
        exponent = F.when(unit == name, F.lit(float(e))).otherwise(exponent)
    return F.when(value > 0, -F.log10(value) + exponent)


def p_value_reason(value: Column, unit: Column) -> Column:
    """First reason for which ``p_value`` has no number: value, sign, unit."""
    # The names of the reasons.
    return (
        F.when(value.isNull(), "invalid_activity_value")
        .when(value <= 0, "nonpositive_activity_value")
        .when(~F.coalesce(unit.isin(*UNIT_EXPONENT), F.lit(False)), "unrecognized_activity_unit")
    )


def flipped(relation: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in FLIPPED.items():
        out = F.when(relation == a, b).otherwise(out)
    return out


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Sorted names of the conditions that hold; a null condition does not hold."""
    named = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in pairs))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def joined_distinct(c: Column) -> Column:
    """Aggregate: sorted distinct non-blank texts joined by a semicolon."""
    text = F.trim(c.cast("string"))
    return F.array_join(F.array_sort(F.collect_set(F.when(text != "", text))), ";")


def rounded_key(value: Column, decimals: int = 2) -> Column:
    """Half-even rounding of the double, as array libraries round."""
    scale = float(10**decimals)
    return F.rint(value * scale) / scale


def erf(x: Column) -> Column:
    """Error function by a series of positive terms, to about 1e-14; 1 beyond 6."""
    a = F.abs(x)
    zero = F.struct(a.alias("term"), a.alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * (2 * a * a) / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(120)), lambda n: n.cast("double")), zero, step, lambda acc: acc["total"])
    value = F.when(a >= 6, 1.0).otherwise(F.least(F.lit(1.0), total * F.exp(-a * a) * 1.1283791670955126))
    return F.signum(x) * value


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / 1.4142135623730951)) / 2


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    floor = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / floor(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / floor(1 + step * d)
            c = floor(1 + step / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return out


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)) if x.size else np.zeros(x.shape)
    low = inner < (a + 1) / (a + b + 2)
    value = np.where(low, front * _beta_fraction(a, b, inner) / a, 1 - front * _beta_fraction(b, a, 1 - inner) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def student_cdf(t, df) -> np.ndarray:
    """Distribution function of Student's t for any positive degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return np.where(t < 0, tail, 1 - tail)


def _student_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_cdf(t.fillna(0.0), df.fillna(1.0))).where(t.notna() & df.notna())


def t_cdf(t: Column, df: Column) -> Column:
    """Student's t distribution function of a column, in Arrow batches; Spark has no incomplete beta function."""
    return F.pandas_udf(_student_cdf, DoubleType())(t, df)


def class_probabilities(center: Column, scale: Column, lower: float, upper: float, df: Column | None = None) -> tuple[Column, Column, Column]:
    """(inactive, medium, active) under a normal law, or Student's t with ``df``; a point mass where the scale is 0."""
    low, high = class_tails(center, scale, lower, upper, df)
    return low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - low - high)), high


def class_tails(center: Column, scale: Column, lower: float, upper: float, df: Column | None = None) -> tuple[Column, Column]:
    """Probabilities of the inactive and the active class; what they leave is the medium one's."""
    safe = F.when(scale == 0, 1.0).otherwise(scale)
    cdf = normal_cdf if df is None else lambda z: t_cdf(z, df)
    point = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return (
        F.when(scale == 0, point(center <= lower)).otherwise(cdf((lower - center) / safe)),
        F.when(scale == 0, point(center >= upper)).otherwise(cdf((center - upper) / safe)),
    )


def morton(x: Column, y: Column) -> Column:
    """Interleaved 16-bit code of a point of the unit square; quantised half to even."""

    def spread(v: Column) -> Column:
        q = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 65_535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            q = q.bitwiseOR(F.shiftleft(q, shift)).bitwiseAND(mask)
        return q

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def doi_text(c: Column) -> Column:
    """A DOI without its resolver or ``doi:`` prefix, case kept."""
    return F.regexp_replace(F.trim(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def reference_kind(c: Column) -> Column:
    """doi, pmid, url or text of a reference."""
    t = doi_text(c)
    return (
        F.when(t.rlike(r"^10\.\d{4,9}/\S+$"), "doi")
        .when(t.rlike(r"(?i)^(?:pmid:?\s*)?\d{1,9}$"), "pmid")
        .when(t.rlike(r"(?i)^https?://\S+$"), "url")
        .when(t != "", "text")
    )


def auto_id(prefix: str, position: Column) -> Column:
    return F.format_string(prefix + "%05d", position)
