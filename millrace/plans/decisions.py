"""Prediction, allocation and learning as relational work: response curves, demand, priors, budgets under guardrails, outcomes, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import dsum
from millrace.operators import relational as r
from millrace.plans.registry import query
from millrace.sources.testdata import Staging, dsum_sql

D = dsum_sql
#: Candidate half-saturation points, as multiples of the mean spend, for the response curves.
HALVES = (0.25, 0.5, 1.0, 2.0, 4.0)
STEP, STEPS = 500.0, 20

_UNITS = f", weekly AS (SELECT campaign_id, CAST(date_trunc('week', date) AS DATE) AS week, {D('spend')} AS x, {D('platform_revenue')} AS y FROM ad_daily GROUP BY ALL)"
_CURVES = _UNITS + f""", means AS (SELECT campaign_id, CAST(sum(CAST(x AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS mean_x FROM weekly GROUP BY campaign_id
), tried AS (SELECT campaign_id, h * mean_x AS half, x / (x + h * mean_x) AS f, y FROM weekly JOIN means USING (campaign_id), (VALUES {", ".join(f"({h}::DOUBLE)" for h in HALVES)}) g(h) WHERE mean_x > 0
), fits AS (SELECT campaign_id, half, {D("f * y")} AS fy, {D("f * f")} AS ff, {D("y * y")} AS yy, count(*) AS n FROM tried GROUP BY campaign_id, half
), best AS (SELECT campaign_id, half, fy / ff AS top, yy - fy * fy / ff AS sse, n FROM fits WHERE ff > 0 QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY yy - fy * fy / ff, half) = 1)
"""


def response_curves(s: Staging) -> DataFrame:
    """campaign_id, half, top, sse, n: revenue = top * x / (x + half) by least squares, exact in top and over a grid of half points."""
    weekly = s.ad_daily().groupBy("campaign_id", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(dsum("spend").alias("x"), dsum("platform_revenue").alias("y"))
    means = weekly.groupBy("campaign_id").agg((dsum("x") / F.count("*")).alias("mean_x")).where("mean_x > 0")
    tried = weekly.join(means, "campaign_id").withColumn("half", F.explode(F.array(*[F.lit(h) * F.col("mean_x") for h in HALVES]))).withColumn("f", F.col("x") / (F.col("x") + F.col("half")))
    fits = tried.groupBy("campaign_id", "half").agg(dsum(F.col("f") * F.col("y")).alias("fy"), dsum(F.col("f") * F.col("f")).alias("ff"), dsum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n")).where("ff > 0")
    made = fits.select("campaign_id", "half", (F.col("fy") / F.col("ff")).alias("top"), (F.col("yy") - F.col("fy") * F.col("fy") / F.col("ff")).alias("sse"), "n")
    return r.latest_per_key(made, ["campaign_id"], ["sse", "half"])


@query(_CURVES + "SELECT * FROM best", "staging")
def d28_response_curves(s: Staging) -> DataFrame:
    return response_curves(s)


@query(_CURVES + f"SELECT campaign_id, CAST(k AS INTEGER) AS k, CAST(k AS DOUBLE) * {STEP} AS budget, top * (k * {STEP}) / (k * {STEP} + half) AS revenue FROM best, range(1, 22) t(k)", "staging")
def v_curve_points(s: Staging) -> DataFrame:
    """Points of each curve for display."""
    grid = response_curves(s).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(21))))
    budget = F.col("k").cast("double") * STEP
    return grid.select("campaign_id", "k", budget.alias("budget"), (F.col("top") * budget / (budget + F.col("half"))).alias("revenue"))


_ALLOCATE = _CURVES + f""", steps AS (SELECT campaign_id, k, top * (k * {STEP}) / (k * {STEP} + half) - top * ((k - 1) * {STEP}) / ((k - 1) * {STEP} + half) AS gain FROM best, range(1, {STEPS + 1}) t(k)
), ranked AS (SELECT *, row_number() OVER (ORDER BY gain DESC, campaign_id, k) AS n FROM steps)
"""


def allocation(s: Staging, total_steps: int = 150) -> DataFrame:
    """Greedy budget over concave curves: the steps with the greatest gains, which is the optimum. Top-k by TakeOrdered, no window over all rows."""
    grid = response_curves(s).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    at = lambda k: F.col("top") * (k * STEP) / (k * STEP + F.col("half"))
    steps = grid.select("campaign_id", "k", (at(F.col("k")) - at(F.col("k") - 1)).alias("gain"))
    chosen = steps.orderBy(F.desc("gain"), "campaign_id", "k").limit(total_steps)
    return chosen.groupBy("campaign_id").agg((F.count("*") * STEP).alias("budget"), dsum("gain").alias("expected"))


@query(_ALLOCATE + f"SELECT campaign_id, count(*) * {STEP}::DOUBLE AS budget, {D('gain')} AS expected FROM ranked WHERE n <= 150 GROUP BY campaign_id", "staging")
def d39_greedy_allocation(s: Staging) -> DataFrame:
    return allocation(s)


#: Named rules of a proposed budget: columns budget, current, status, total, total_now and share (of the platform).
RULES = {
    "NEGATIVE": "budget < 0", "BELOW_MINIMUM": "budget > 0 and budget < 500", "NOT_A_STEP": "budget % 500 <> 0", "UNIT_CAP": "budget > 8000", "CHANGE_CAP": "current > 0 and abs(budget - current) > 3 * current", "NEW_UNIT": "current = 0 and budget > 2000",
    "PAUSED_UNIT": "status = 'PAUSED' and budget > 0", "CUT_TO_ZERO": "current > 2000 and budget = 0", "TOTAL_CAP": "total * 5 > 6 * total_now", "PLATFORM_SHARE": "share * 5 > 3",
}


@query(_ALLOCATE + f""", a AS (SELECT campaign_id, count(*) * {STEP}::DOUBLE AS budget FROM ranked WHERE n <= 150 GROUP BY campaign_id), now AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS current, arg_max(status, snapshot_date) AS status FROM budget_snapshots GROUP BY campaign_id
), j AS (SELECT campaign_id, platform, status, coalesce(budget, 0.0::DOUBLE) AS budget, coalesce(current, 0.0::DOUBLE) AS current FROM campaigns LEFT JOIN a USING (campaign_id) LEFT JOIN now USING (campaign_id)
), k AS (SELECT *, CAST(sum(CAST(budget AS DECIMAL(38,6))) OVER () AS DOUBLE) AS total, CAST(sum(CAST(current AS DECIMAL(38,6))) OVER () AS DOUBLE) AS total_now, CAST(sum(CAST(budget AS DECIMAL(38,6))) OVER (PARTITION BY platform) AS DOUBLE) AS own FROM j
), r AS (SELECT *, CASE WHEN total > 0 THEN own / total ELSE 0.0::DOUBLE END AS share FROM k)
SELECT campaign_id, budget, current, nullif(concat_ws(',', {", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}), '') AS violations FROM r""", "staging")  # fmt: skip
def d41_policy_validation(s: Staging) -> DataFrame:
    """The named rules that a proposed budget breaks; null if none. The totals are over a row for each campaign."""
    now = r.latest_value(s.budget_snapshots(), ["campaign_id"], "snapshot_date", ["budget", "status"]).withColumnRenamed("budget", "current")
    df = s.campaigns().select("campaign_id", "platform").join(allocation(s).select("campaign_id", "budget"), "campaign_id", "left").join(now, "campaign_id", "left")
    df = df.withColumns({"budget": F.coalesce("budget", F.lit(0.0)), "current": F.coalesce("current", F.lit(0.0))})
    total = df.agg(dsum("budget").alias("total"), dsum("current").alias("total_now"))  # one row
    df = df.join(F.broadcast(total), how="cross").join(df.groupBy("platform").agg(dsum("budget").alias("own")), "platform").withColumn("share", F.when(F.col("total") > 0, F.col("own") / F.col("total")).otherwise(0.0))
    broken = F.concat_ws(",", *[F.when(F.expr(rule), name) for name, rule in RULES.items()])
    return df.select("campaign_id", "budget", "current", F.nullif(broken, F.lit("")).alias("violations"))


_NAIVE = """, f AS (SELECT sku, date, units, lag(units, 7) OVER (PARTITION BY sku ORDER BY date) AS p50 FROM stock_daily
), e AS (SELECT sku, quantile_cont(units - p50, 0.1) AS q10, quantile_cont(units - p50, 0.9) AS q90 FROM f WHERE p50 IS NOT NULL AND date < DATE '2001-05-01' GROUP BY sku)
"""


@query(_NAIVE + "SELECT sku, date, units, greatest(p50 + q10, 0.0::DOUBLE) AS p10, p50, greatest(p50 + q90, 0.0::DOUBLE) AS p90 FROM f JOIN e USING (sku) WHERE date >= DATE '2001-05-01' AND p50 IS NOT NULL", "staging")
def d31_seasonal_naive(s: Staging) -> DataFrame:
    """Demand as a week ago, with a band from the residuals before the holdout: conformal, and its quantiles never cross."""
    w = Window.partitionBy("sku").orderBy("date")
    f = s.stock_daily().select("sku", "date", "units", F.lag("units", 7).over(w).alias("p50")).where("p50 is not null")
    e = f.where(F.col("date") < "2001-05-01").groupBy("sku").agg(F.percentile(F.col("units") - F.col("p50"), F.lit(0.1)).alias("q10"), F.percentile(F.col("units") - F.col("p50"), F.lit(0.9)).alias("q90"))
    return f.where(F.col("date") >= "2001-05-01").join(e, "sku").select("sku", "date", "units", F.greatest(F.col("p50") + F.col("q10"), F.lit(0.0)).alias("p10"), "p50", F.greatest(F.col("p50") + F.col("q90"), F.lit(0.0)).alias("p90"))


@query(_NAIVE + "SELECT count(*) AS n, 1.0::DOUBLE * count(*) FILTER (WHERE units BETWEEN greatest(p50 + q10, 0) AND greatest(p50 + q90, 0)) / count(*) AS coverage FROM f JOIN e USING (sku) WHERE date >= DATE '2001-05-01' AND p50 IS NOT NULL", "staging")
def d30_coverage_gate(s: Staging) -> DataFrame:
    inside = F.col("units").between(F.col("p10"), F.col("p90"))
    return d31_seasonal_naive(s).agg(F.count("*").alias("n"), (F.lit(1.0) * F.count(F.when(inside, 1)) / F.count("*")).alias("coverage"))


_MOMENTS = "count(*) AS n, CAST(sum(k) AS DOUBLE) / sum(c) AS m, (CAST(sum(CAST(CAST(k * k AS DOUBLE) / c AS DECIMAL(38,6))) AS DOUBLE)) / sum(c) - (CAST(sum(k) AS DOUBLE) / sum(c)) * (CAST(sum(k) AS DOUBLE) / sum(c)) AS v"
_KAPPA = "least(1000.0::DOUBLE, greatest(2.0::DOUBLE, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0::DOUBLE END))"


@query(f"""WITH cells AS (SELECT event_type, user_id, count(*) AS c, count(*) FILTER (WHERE value > 30) AS k FROM events GROUP BY ALL HAVING count(*) >= 12
), own AS (SELECT event_type, m, {_KAPPA} AS kappa FROM (SELECT event_type, {_MOMENTS} FROM cells GROUP BY event_type) WHERE n >= 5
), pooled AS (SELECT m, {_KAPPA} AS kappa FROM (SELECT {_MOMENTS} FROM cells) WHERE n >= 5)
SELECT t.event_type, CASE WHEN o.m IS NOT NULL THEN 'own' WHEN p.m IS NOT NULL THEN 'pooled' ELSE 'uniform' END AS source, coalesce(o.m, p.m, 0.5::DOUBLE) AS m, coalesce(o.kappa, p.kappa, 2.0::DOUBLE) AS kappa FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN own o USING (event_type) LEFT JOIN pooled p ON true""")  # fmt: skip
def d32_rate_prior(s: Staging) -> DataFrame:
    """Beta priors by weighted moments over cells of twelve trials or more, kappa between 2 and 1000; a kind with fewer than five cells takes the pooled prior, and without that the uniform one."""
    cells = s.events().groupBy("event_type", "user_id").agg(F.count("*").alias("c"), F.count(F.when(F.col("value") > 30, 1)).alias("k")).where("c >= 12")
    own = _prior(cells.groupBy("event_type")).withColumnsRenamed({"m": "own_m", "kappa": "own_kappa"})
    pooled = _prior(cells.groupBy())  # one row or none
    df = s.events().select("event_type").distinct().join(own, "event_type", "left").join(F.broadcast(pooled), F.lit(True), "left")
    source = F.when(F.col("own_m").isNotNull(), "own").when(F.col("m").isNotNull(), "pooled").otherwise("uniform")
    return df.select("event_type", source.alias("source"), F.coalesce("own_m", "m", F.lit(0.5)).alias("m"), F.coalesce("own_kappa", "kappa", F.lit(2.0)).alias("kappa"))


def _prior(cells) -> DataFrame:
    """m and kappa of groups of cells (c trials, k hits)."""
    df = cells.agg(F.count("*").alias("n"), (F.sum("k").cast("double") / F.sum("c")).alias("m"), (dsum((F.col("k") * F.col("k")).cast("double") / F.col("c")) / F.sum("c")).alias("_q")).where("n >= 5")
    df = df.withColumn("_v", F.col("_q") - F.col("m") * F.col("m"))
    kappa = F.when(F.col("_v") > 0, F.col("m") * (1 - F.col("m")) / F.col("_v") - 1).otherwise(1000.0)
    return df.withColumn("kappa", F.least(F.lit(1000.0), F.greatest(F.lit(2.0), kappa))).drop("n", "_q", "_v")


_DRAWS = "CAST('0x' || substr(md5(d || '-' || campaign_id || '-' || week), 1, 7) AS BIGINT)"


@query(_UNITS + f""", gaps AS (SELECT campaign_id, week, y - x AS gap FROM weekly ), drawn AS (SELECT campaign_id, d, sum(CAST(gap AS DECIMAL(38,6)) * w)::DOUBLE / sum(w) AS mean FROM (SELECT campaign_id, d, gap, CASE WHEN u < 0.3678794 THEN 0 WHEN u < 0.7357589 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.9810118 THEN 3 ELSE 4 END AS w FROM (
  SELECT campaign_id, d, gap, {_DRAWS}::DOUBLE / 268435456.0::DOUBLE AS u FROM gaps, range(100) t(d))) GROUP BY campaign_id, d HAVING sum(w) > 0)
SELECT campaign_id, round(quantile_cont(mean, 0.05), 6) AS low, round(quantile_cont(mean, 0.95), 6) AS high, CASE WHEN quantile_cont(mean, 0.05) > 0 THEN 'WIN' WHEN quantile_cont(mean, 0.95) < 0 THEN 'LOSS' ELSE 'UNDECIDED' END AS verdict FROM drawn GROUP BY campaign_id""", "staging")  # fmt: skip
def d43_bootstrap_effect(s: Staging) -> DataFrame:
    """The band of a campaign's weekly effect over 100 Poisson bootstrap draws, whose weights come from a hash of draw and row: the same in any order and on any cluster."""
    weekly = s.ad_daily().groupBy("campaign_id", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(dsum("spend").alias("x"), dsum("platform_revenue").alias("y"))
    drawn = weekly.select("campaign_id", "week", (F.col("y") - F.col("x")).alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("d"))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("d").cast("string"), "campaign_id", F.col("week").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long").cast("double") / 268435456.0
    w = F.when(u < 0.3678794, 0).when(u < 0.7357589, 1).when(u < 0.9196986, 2).when(u < 0.9810118, 3).otherwise(4)
    mean = drawn.withColumn("w", w).groupBy("campaign_id", "d").agg(F.sum(F.col("gap").cast("decimal(28,6)") * F.col("w")).cast("double").alias("t"), F.sum("w").alias("n")).where("n > 0").withColumn("mean", F.col("t") / F.col("n"))
    df = mean.groupBy("campaign_id").agg(F.percentile("mean", F.lit(0.05)).alias("low"), F.percentile("mean", F.lit(0.95)).alias("high"))
    return df.select("campaign_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.when(F.col("low") > 0, "WIN").when(F.col("high") < 0, "LOSS").otherwise("UNDECIDED").alias("verdict"))


def calibration(events: DataFrame) -> DataFrame:
    """user_id and factor: an ordered fold over a key's outcomes, f <- clip(0.8 f + 0.2 clip(x, 0, 1.2), 0.3, 1). Sorted rows stream through the fold, so a key's outcomes are never gathered; a null outcome counts as 0."""
    rows = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", (F.col("value") / 50).alias("x"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "x")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, f = None, 1.0
        for batch in batches:
            done = []
            for user, x in zip(batch.user_id, batch.x, strict=True):
                if user != key:
                    done += [(key, f)] * (key is not None)
                    key, f = user, 1.0
                f = min(1.0, max(0.3, 0.8 * f + 0.2 * min(1.2, max(0.0, 0.0 if x != x else x))))
            yield pd.DataFrame(done, columns=["user_id", "factor"])
        yield pd.DataFrame([(key, f)] * (key is not None), columns=["user_id", "factor"])

    return rows.mapInPandas(fold, f"user_id {events.schema['user_id'].dataType.simpleString()}, factor double")



@query("""SELECT user_id, list_reduce(list_prepend(1.0::DOUBLE, list(value / 50 ORDER BY ts, event_id)), lambda f, x: least(1.0::DOUBLE, greatest(0.3::DOUBLE, 0.8::DOUBLE * f + 0.2::DOUBLE * least(1.2::DOUBLE, greatest(0.0::DOUBLE, x))))) AS factor FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def d44_calibration_fold(s: Staging) -> DataFrame:
    return calibration(s.events())


@query("""SELECT sku, mean, var, CASE WHEN var > mean THEN mean * mean / (var - mean) ELSE 1e6::DOUBLE END AS r FROM (SELECT sku, CAST(sum(units) AS DOUBLE) / count(*) AS mean, CAST(sum(units * units) * count(*) - sum(units) * sum(units) AS DOUBLE) / (count(*) * (count(*) - 1)) AS var FROM stock_daily GROUP BY sku HAVING count(*) > 1)""", "staging")
def d38_demand_dispersion(s: Staging) -> DataFrame:
    n, t, q = F.count("*"), F.sum("units"), F.sum(F.col("units") * F.col("units"))
    df = s.stock_daily().groupBy("sku").agg(n.alias("n"), (t.cast("double") / n).alias("mean"), F.when(n > 1, (q * n - t * t).cast("double") / (n * (n - 1))).alias("var")).where("n > 1").drop("n")
    return df.withColumn("r", F.when(F.col("var") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("var") - F.col("mean"))).otherwise(1e6))


@query("""SELECT b.campaign_id, b.snapshot_date, b.budget, last_value(CASE WHEN abs(b.budget - b.prev) > 500 THEN b.snapshot_date END IGNORE NULLS) OVER (PARTITION BY b.campaign_id ORDER BY b.snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_large_change FROM (SELECT *, lag(budget) OVER (PARTITION BY campaign_id ORDER BY snapshot_date) AS prev FROM budget_snapshots) b""", "staging")
def d62_guardrail_replay(s: Staging) -> DataFrame:
    """The last change over the limit before or at each snapshot: an ordered fold as a window."""
    w = Window.partitionBy("campaign_id").orderBy("snapshot_date")
    df = s.budget_snapshots().withColumn("prev", F.lag("budget").over(w))
    return df.select("campaign_id", "snapshot_date", "budget", F.last(F.when(F.abs(F.col("budget") - F.col("prev")) > 500, F.col("snapshot_date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_large_change"))


@query(""", old AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS b FROM budget_snapshots WHERE snapshot_date < DATE '2001-06-01' GROUP BY campaign_id), new AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS b FROM budget_snapshots WHERE snapshot_date < DATE '2001-07-01' GROUP BY campaign_id)
SELECT n.campaign_id, o.b AS before, n.b AS after, CASE WHEN o.b = n.b THEN 'FRESH' WHEN o.b > 0 AND abs(n.b - o.b) <= 0.1::DOUBLE * o.b THEN 'TOLERATED' ELSE 'STALE' END AS state FROM new n JOIN old o USING (campaign_id)""", "staging")
def d42_staleness(s: Staging) -> DataFrame:
    """A stored fingerprint against the state now: equal, within a tenth, or stale."""
    at = lambda day: r.latest_value(s.budget_snapshots().where(F.col("snapshot_date") < day), ["campaign_id"], "snapshot_date", ["budget"])
    df = at("2001-06-01").withColumnRenamed("budget", "before").join(at("2001-07-01").withColumnRenamed("budget", "after"), "campaign_id")
    near = (F.col("before") > 0) & (F.abs(F.col("after") - F.col("before")) <= F.lit(0.1) * F.col("before"))
    return df.withColumn("state", F.when(F.col("before") == F.col("after"), "FRESH").when(near, "TOLERATED").otherwise("STALE"))


@query("""SELECT event_type, first_user, count(*) AS marks FROM (SELECT event_type, user_id AS first_user, CAST(ts AS DATE) AS day FROM events GROUP BY ALL) GROUP BY ALL""")
def d64_dirty_marks(s: Staging) -> DataFrame:
    """One pending mark for each entity, reason and day, however many events arrive."""
    marks = s.events().select("event_type", F.col("user_id").alias("first_user"), F.to_date("ts").alias("day")).distinct()
    return marks.groupBy("event_type", "first_user").agg(F.count("*").alias("marks"))
