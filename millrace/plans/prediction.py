"""Prediction: response curves with lingering and saturation, their skill, coverage and stability; rates with priors, their quantiles and predictive gate; demand quantiles.

Spark gathers bounded arrays of a unit's days, or features as columns; fits run in tasks, one unit or one set of histograms at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import distributions, response
from millrace.functions.columns import dsum
from millrace.operators.relational import spine
from millrace.plans import decisions
from millrace.plans.registry import query
from millrace.sources.testdata import LAST_DAY, Staging

#: Days to fit, to hold out and to diagnose; draws of the band and days of a block; the seed that all units share.
TRAIN, HOLDOUT, DIAGNOSE, DRAWS, BLOCK, SEED = 120, 28, 14, 100, 7, 20261001
LEAST_DAYS, LEAST_SPEND = 30, 500.0
#: Above these a curve is unstable.
CONDITION, CV_HALF, BASE_CORRELATION, ELASTICITY = 1e6, 0.5, 0.9, 1.05
CURVES = "campaign_id string, status string, days int, " + ", ".join(f"{n} double" for n in response.NAMES) + ", r2 double, condition double, cv_k double, base_correlation double, elasticity double, skill double, coverage double, marginal double, marginal_low double, marginal_high double"


def unit_days(s: Staging) -> DataFrame:
    """campaign_id, date, spend, revenue and base of the last days: base is what the campaign's products sold without an ad, a mean of seven days."""
    last, n = F.lit(LAST_DAY).cast("date"), TRAIN + HOLDOUT + DIAGNOSE
    ads = s.ad_daily().where(F.col("date") <= last).groupBy("campaign_id", "date").agg(dsum("spend").alias("spend"), dsum("platform_revenue").alias("revenue"))
    spans = ads.groupBy("campaign_id").agg(F.min("date").alias("lo")).select("campaign_id", F.greatest("lo", F.date_sub(last, n + 5)).alias("lo"), last.alias("hi"))
    late = F.col("date") >= F.date_sub(last, n + 5)  # no span begins before
    organic = s.order_lines().where(F.col("utm_campaign").isNull() & late).join(s.products().select("sku", F.col("brand").alias("campaign_id")), "sku").groupBy("campaign_id", "date").agg(dsum("subtotal").alias("organic"))
    days = spine(spans, "lo", "hi").join(ads, ["campaign_id", "date"], "left").join(organic, ["campaign_id", "date"], "left").na.fill(0.0, ["spend", "revenue", "organic"])
    base = F.avg("organic").over(Window.partitionBy("campaign_id").orderBy("date").rowsBetween(-6, 0))
    return days.withColumn("base", base).where(F.col("date") > F.date_sub(last, n))


def _normal(spend: np.ndarray, revenue: np.ndarray, base: np.ndarray) -> tuple[float, float, float]:
    """Median spend and revenue of days with spend, and mean base, of the fit."""
    paid = spend > 0
    return float(np.median(spend[paid])) if paid.any() else 0.0, float(np.median(revenue[paid])) if paid.any() else 0.0, max(float(base.mean()), 1e-9)


def elasticity(p: np.ndarray, base: float = 1.0) -> np.ndarray:
    """Of revenue by spend at the median spend, for rows of parameters."""
    beta, k, s, theta, gamma = np.atleast_2d(p).T
    rate = 1 / (1 + (k * (1 - theta)) ** s)
    made = beta * rate + gamma * base
    return np.where(made > 0, beta * rate * (1 - rate) * s / np.where(made > 0, made, 1), 0.0)


def fitted(name: str, spend: np.ndarray, revenue: np.ndarray, base: np.ndarray, draws: int = DRAWS) -> dict:
    """A unit's curve on the training days, told by its holdout: skill against the mean of the last 28 training days, and the share of days within the 10 to 90 % band of resampled relative errors."""
    told = {"campaign_id": name, "status": "INSUFFICIENT_DATA", "days": len(spend)}
    fit, hold = slice(0, TRAIN), slice(TRAIN, TRAIN + HOLDOUT)
    if len(spend) < TRAIN + HOLDOUT + DIAGNOSE:
        return told
    unit, worth, level = _normal(spend[fit], revenue[fit], base[fit])
    if (spend[fit] > 0).sum() < LEAST_DAYS or unit < LEAST_SPEND or worth <= 0:
        return told
    x, y, b = spend / unit, revenue / worth, base / level
    before = float(x[:7].mean())
    got = response.fit(x[fit], y[fit], b[fit], before)
    at = response.blocks(TRAIN, BLOCK, draws, SEED)
    again = response.refits(x[fit], y[fit], b[fit], before, got, at)
    held = response.adstock(x[fit], got["p"][3], before)[0]
    ahead = response.curve(got["p"], x[hold], b[hold], float(held[-1]))[0]
    naive = y[fit][-28:].mean()
    worse = float(((y[hold] - naive) ** 2).sum())
    errors = (y[fit] - got["fitted"]) / np.maximum(got["fitted"], 1e-9)
    bands = np.quantile(ahead * (1 + errors[at[:, :HOLDOUT]]), [0.1, 0.9], axis=0)
    a = np.maximum(held, 1e-12)
    rate = 1 / (1 + (got["p"][1] / a) ** got["p"][2])
    related = float(np.corrcoef(rate, b[fit])[0, 1]) if rate.std() > 0 and b[fit].std() > 0 else 0.0
    cv = float(again[:, 1].std() / again[:, 1].mean())
    bends = float(np.median(elasticity(again)))
    status = "CONDITION" if got["condition"] > CONDITION else "HALF_POINT" if cv > CV_HALF else "BASE" if abs(related) > BASE_CORRELATION else "INCREASING_RETURNS" if bends > ELASTICITY else "OK"
    steps = np.array([response.marginal(p, 1.0) for p in again]) * worth / unit
    return told | dict(zip(response.NAMES, map(float, got["p"]), strict=True)) | {
        "status": status if got["done"] else "NOT_SETTLED", "r2": float(got["r2"]), "condition": got["condition"], "cv_k": cv, "base_correlation": related, "elasticity": bends, "skill": 1 - float(((y[hold] - ahead) ** 2).sum()) / worse if worse > 0 else None,
        "coverage": float(((y[hold] >= bands[0]) & (y[hold] <= bands[1])).mean()), "marginal": response.marginal(got["p"], 1.0) * worth / unit, "marginal_low": float(np.quantile(steps, 0.05)), "marginal_high": float(np.quantile(steps, 0.95)),
    }


def curves(days: DataFrame, draws: int = DRAWS) -> DataFrame:
    """A fitted curve for each campaign, from its gathered days."""
    held = days.groupBy("campaign_id").agg(F.sort_array(F.collect_list(F.struct("date", "spend", "revenue", "base"))).alias("x")).select("campaign_id", *[F.col(f"x.{c}").alias(c) for c in ("spend", "revenue", "base")])
    names = [c.split()[0] for c in CURVES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fitted(r.campaign_id, np.asarray(r.spend, float), np.asarray(r.revenue, float), np.asarray(r.base, float), draws) for r in batch.itertuples()], columns=names)

    # a unit's fit takes seconds: units go one by one to tasks
    return held.repartition("campaign_id").mapInPandas(run, CURVES)


@query()
def d28_adstock_curves(s: Staging) -> DataFrame:
    """Curves of every campaign, with what speaks for and against each."""
    got = curves(unit_days(s))
    return got.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


# --- rates ------------------------------------------------------------------------------------------------------------------

SPLIT = "2024-01-16"
_CELLS = f"""WITH cells AS (SELECT event_type, user_id, count(*) FILTER (WHERE ts < TIMESTAMP '{SPLIT}') AS c, count(*) FILTER (WHERE ts < TIMESTAMP '{SPLIT}' AND value > 30) AS k, count(*) FILTER (WHERE ts >= TIMESTAMP '{SPLIT}') AS c1, count(*) FILTER (WHERE ts >= TIMESTAMP '{SPLIT}' AND value > 30) AS k1 FROM events GROUP BY ALL
), enough AS (SELECT * FROM cells WHERE c >= 12
), own AS (SELECT event_type, m, {decisions._KAPPA} AS kappa FROM (SELECT event_type, {decisions._MOMENTS} FROM enough GROUP BY event_type) WHERE n >= 5
), pooled AS (SELECT m, {decisions._KAPPA} AS kappa FROM (SELECT {decisions._MOMENTS} FROM enough) WHERE n >= 5
), posterior AS (SELECT e.*, coalesce(o.m * o.kappa, p.m * p.kappa, 1.0::DOUBLE) + k AS a, coalesce((1 - o.m) * o.kappa, (1 - p.m) * p.kappa, 1.0::DOUBLE) + c - k AS b FROM cells e LEFT JOIN own o USING (event_type) LEFT JOIN pooled p ON true)
"""


def posteriors(s: Staging) -> DataFrame:
    """event_type, user_id, c and k before the split, c1 and k1 after it, and a and b of each cell's beta posterior; the prior is the kind's own, or the pooled one, or uniform."""
    early, hit = F.col("ts") < SPLIT, F.col("value") > 30
    n = lambda x: F.count(F.when(x, 1))
    cells = s.events().groupBy("event_type", "user_id").agg(n(early).alias("c"), n(early & hit).alias("k"), n(~early).alias("c1"), n(~early & hit).alias("k1"))
    enough = cells.where("c >= 12").select("event_type", "c", "k")
    own = decisions._prior(enough.groupBy("event_type")).withColumnsRenamed({"m": "own_m", "kappa": "own_kappa"})
    joined = cells.join(own, "event_type", "left").join(F.broadcast(decisions._prior(enough.groupBy())), F.lit(True), "left")  # one row or none
    m, kappa = F.coalesce("own_m", "m", F.lit(0.5)), F.coalesce("own_kappa", "kappa", F.lit(2.0))
    return joined.select("event_type", "user_id", "c", "k", "c1", "k1", (m * kappa + F.col("k")).alias("a"), ((F.lit(1.0) - m) * kappa + F.col("c") - F.col("k")).alias("b"))


def beta_binomial_cdf(k: Column, n: Column, a: Column, b: Column) -> Column:
    """P(X <= k): the terms up to k, in Arrow batches; k is a count of one cell."""

    def cdf(k: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = np.minimum(np.maximum(k, -1), n).astype(int)
        rows = np.repeat(np.arange(len(k)), top + 1)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
        return np.minimum(np.bincount(rows, distributions.beta_binomial_pmf(at, n[rows], a[rows], b[rows]), len(k)), 1.0)

    return distributions.column(cdf, k, n, a, b)


_BB = "exp(lgamma(c1 + 1) - lgamma(j + 1) - lgamma(c1 - j + 1) + lgamma(j + a) + lgamma(c1 - j + b) - lgamma(c1 + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b))"


@query(_CELLS + f""", told AS (SELECT event_type, round(coalesce((SELECT sum({_BB}) FROM range(CAST(k1 + 1 AS BIGINT)) t(j)), 0.0::DOUBLE), 9) AS upto, round(coalesce((SELECT sum({_BB}) FROM range(CAST(k1 AS BIGINT)) t(j)), 0.0::DOUBLE), 9) AS below FROM posterior WHERE c >= 1 AND c1 >= 1)
SELECT event_type, count(*) AS cells, count(*) FILTER (WHERE upto >= 0.1 AND below < 0.9) AS inside, round(1.0::DOUBLE * count(*) FILTER (WHERE upto >= 0.1 AND below < 0.9) / count(*), 6) AS coverage, 1.0::DOUBLE * count(*) FILTER (WHERE upto >= 0.1 AND below < 0.9) / count(*) BETWEEN 0.7 AND 0.9 AS passed FROM told GROUP BY event_type""")  # fmt: skip
def d32_predictive_gate(s: Staging) -> DataFrame:
    """Share of cells whose later hits lie in the 80 % predictive interval of what came before; a prior passes with 0.7 to 0.9."""
    p = posteriors(s).where("c >= 1 and c1 >= 1")
    at = lambda k: F.round(beta_binomial_cdf(k, F.col("c1"), F.col("a"), F.col("b")), 9)
    told = p.select("event_type", at(F.col("k1")).alias("upto"), at(F.col("k1") - 1).alias("below"))
    inside = F.count(F.when((F.col("upto") >= 0.1) & (F.col("below") < 0.9), 1))
    share = F.lit(1.0) * inside / F.count("*")
    return told.groupBy("event_type").agg(F.count("*").alias("cells"), inside.alias("inside"), F.round(share, 6).alias("coverage"), share.between(0.7, 0.9).alias("passed"))


@query()
def d32_rate_quantiles(s: Staging) -> DataFrame:
    """The rate of each cell: mean and 10 % and 90 % points of its beta posterior."""
    p, q = posteriors(s), lambda x: F.round(distributions.column(distributions.beta_quantile, x, F.col("a"), F.col("b")), 8)
    return p.select("event_type", "user_id", F.round(F.col("a") / (F.col("a") + F.col("b")), 8).alias("mean"), q(0.1).alias("p10"), q(0.9).alias("p90"))
