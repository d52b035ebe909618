"""Column helpers: order-independent sums, safe ratios, media metrics, inventory and refund rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import distributions

EPSILON = 1e-9
MONEY = "decimal(38,6)"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dsum(x: str | Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(col(x).cast(MONEY)).cast("double")


def safe_ratio(n: str | Column, d: str | Column, scale: float = 1.0) -> Column:
    """scale * n / d, null where d is next to zero."""
    return F.when(F.abs(col(d)) >= EPSILON, F.lit(float(scale)) * col(n) / col(d))


def ratio_reason(d: str | Column) -> Column:
    return F.when(F.abs(col(d)) < EPSILON, "ZERO_DENOMINATOR")


#: name -> (numerator, denominator, scale); of window totals, never of ratios
METRICS = {
    "ctr": ("clicks", "impressions", 1.0), "cpc": ("spend", "clicks", 1.0), "cpm": ("spend", "impressions", 1000.0), "cvr": ("orders", "clicks", 1.0), "cpa": ("spend", "orders", 1.0),
    "aov": ("revenue", "orders", 1.0), "roas": ("revenue", "spend", 1.0), "poas": ("contribution", "spend", 1.0), "mer": ("net_revenue", "spend", 1.0), "cac": ("spend", "new_customers", 1.0),
    "session_click_ratio": ("sessions", "clicks", 1.0), "over_attribution": ("platform_revenue", "revenue", 1.0), "cm_pct": ("contribution", "net_revenue", 1.0),
}


def metric(name: str, **columns: str) -> Column:
    """A metric of the table; columns may rename its inputs."""
    n, d, scale = METRICS[name]
    return safe_ratio(columns.get(n, n), columns.get(d, d), scale)


def refund(matured: Column, realized: Column, expected: Column) -> Column:
    """Mature lines take what came back; young ones at least what is still expected."""
    return F.when(matured, realized).otherwise(F.greatest(realized, expected))


def expected_refund(rate: Column, cdf: Column, subtotal: Column) -> Column:
    """Of a line without a refund at its age: rate (1 - F) / (1 - rate F) of its value."""
    return rate * (F.lit(1.0) - cdf) / F.greatest(F.lit(1.0) - rate * cdf, F.lit(EPSILON)) * subtotal


def units_from_net_revenue(net_revenue: Column, net_per_unit: Column) -> Column:
    """Units that a revenue stands for; raises where a unit brings nothing."""
    return F.when(net_per_unit <= 0, F.raise_error(F.lit("net revenue of a unit must be positive")).cast("double")).otherwise(net_revenue / net_per_unit)


def projected_shortfall(demand: Column, available: Column) -> Column:
    return F.greatest(demand - available, F.lit(0.0))


def stage_of(name: Column) -> Column:
    """The last word before ' | ' of a campaign's name; null where there is only one word."""
    words = F.split(F.split_part(name, F.lit(" | "), F.lit(1)), " ")
    return F.when(F.size(words) > 1, F.element_at(words, -1))


def canonical_number(x: Column, places: int = 4) -> Column:
    """A number as text for hashing: so many places, half to even, no trailing zeros, -0 as 0; raises for what is not finite."""
    wrong = F.isnan(x) | (F.abs(x) == float("inf"))
    text = F.bround(x, places).cast(f"decimal(38,{places})").cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(wrong, F.raise_error(F.lit("not a finite number")).cast("string")).otherwise(F.when(short == "-0", "0").otherwise(short))


def negative_binomial_cdf(k: Column, r: Column, p: Column) -> Column:
    """P(X <= k) of a negative binomial (r successes of probability p), for any r and k, by the incomplete beta function."""
    return distributions.column(distributions.negative_binomial_cdf, k, r, p)


def unit_contribution(net_per_unit: Column, cogs: Column, shipping: Column, fee: Column) -> Column:
    """Raises for a negative cost or a fee outside 0 to 1."""
    wrong = (cogs < 0) | (shipping < 0) | (fee < 0) | (fee > 1)
    return F.when(wrong, F.raise_error(F.lit("costs must not be negative, and a fee lies in 0..1")).cast("double")).otherwise(net_per_unit * (F.lit(1.0) - fee) - cogs - shipping)


def days_of_cover(available: Column, daily: Column) -> Column:
    """Null (without bound) where nothing is sold."""
    return F.when(daily > 0, available / daily)


def inventory_band(cover: Column) -> Column:
    return F.when(cover.isNull(), "UNBOUNDED").when(cover < 3, "CRITICAL").when(cover < 7, "LOW").when(cover < 21, "HEALTHY").when(cover < 45, "HIGH").otherwise("EXCESS")


def freshness(hours: Column, sla: Column) -> Column:
    """1 up to the agreed age, 0 from three times it, a straight line between."""
    return F.when(hours <= sla, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (hours - sla) / (F.lit(2.0) * sla)))


def health_band(score: Column, failed: Column) -> Column:
    return F.when(failed, "RED").when(score >= 85, "GREEN").when(score >= 60, "YELLOW").otherwise("RED")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    p = k / n
    mid = (p + F.lit(z * z) / (F.lit(2.0) * n)) / (F.lit(1.0) + F.lit(z * z) / n)
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n)) / (F.lit(1.0) + F.lit(z * z) / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def mapped(rules: list[tuple[list[Column | str | None], str]], columns: list[str | Column], default: Column) -> Column:
    """The value of the first rule whose keys equal the columns, null-safely."""
    out = None
    for keys, value in rules:
        holds = F.lit(True)
        for k, c in zip(keys, columns, strict=True):
            holds = holds & col(c).eqNullSafe(F.lit(k))
        out = F.when(holds, F.lit(value)) if out is None else out.when(holds, F.lit(value))
    return default if out is None else out.otherwise(default)
