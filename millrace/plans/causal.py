"""What incidents did, told by controls: eligible panels, convex weights with refitted bands, differences in differences with robust trends, and every gate.

The unit of time is the week. An incident is a campaign whose return on spend over the weeks after START differs by more than CHANGE from the weeks before. Spark finds incidents, controls and their correlations; a
group holds one incident's series and those of its TOP best controls, and is estimated in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import panel
from millrace.functions.columns import dsum
from millrace.plans.registry import query
from millrace.sources.testdata import Staging, dsum_sql

D = dsum_sql
#: Weeks of the fit, of the holdout, after the start, and by which the placebo lies earlier.
FIT, HOLD, POST, OFFSET = 26, 4, 4, 8
START = "2001-05-28"
NEEDED = FIT + HOLD + OFFSET
#: Relative change that makes an incident, and that of a budget which makes an event.
CHANGE, EVENT = 0.15, 0.6
TOP, LEAST_CONTROLS, MOST_SMAPE, LEAST_CONVERSIONS, LEAST_WORTH, SHARE = 10, 3, 0.15, 50, 2000.0, 0.05
#: Share of revenue that is contribution before the cost of media.
MARGIN = 0.3

_WEEKS = f""", weeks AS (SELECT campaign_id, CAST(date_trunc('week', date) AS DATE) AS week, {D('spend')} AS spend, {D('platform_revenue')} AS revenue, CAST(sum(clicks) AS BIGINT) AS clicks FROM ad_daily
  WHERE date >= DATE '{START}' - {7 * NEEDED} AND date < DATE '{START}' + {7 * POST} GROUP BY ALL
), sides AS (SELECT campaign_id, {D("CASE WHEN week >= DATE '" + START + "' THEN revenue ELSE 0.0::DOUBLE END")} AS r1, {D("CASE WHEN week >= DATE '" + START + "' THEN spend ELSE 0.0::DOUBLE END")} AS s1, {D("CASE WHEN week < DATE '" + START + "' AND week >= DATE '" + START + f"' - {7 * POST} THEN revenue ELSE 0.0::DOUBLE END")} AS r0, {D("CASE WHEN week < DATE '" + START + "' AND week >= DATE '" + START + f"' - {7 * POST} THEN spend ELSE 0.0::DOUBLE END")} AS s0 FROM weeks GROUP BY campaign_id
), incidents AS (SELECT campaign_id FROM sides WHERE s0 > 0 AND s1 > 0 AND r0 > 0 AND abs(r1 / s1 / (r0 / s0) - 1) > {CHANGE}
), sets AS (SELECT campaign_id, arg_min(category, (-v, category)) AS lead FROM (SELECT p.brand AS campaign_id, p.category, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem JOIN products p ON l_partkey = p.sku GROUP BY ALL) GROUP BY campaign_id
), moved AS (SELECT DISTINCT campaign_id FROM (SELECT campaign_id, snapshot_date, budget, lag(budget) OVER (PARTITION BY campaign_id ORDER BY snapshot_date) AS before FROM budget_snapshots)
  WHERE snapshot_date >= DATE '{START}' - {7 * POST} AND snapshot_date < DATE '{START}' + {7 * POST} AND before > 0 AND abs(budget / before - 1) > {EVENT}
), whole AS (SELECT campaign_id, count(*) AS n, min(least(spend, revenue)) AS least FROM weeks GROUP BY campaign_id
), states AS (SELECT w.campaign_id, lead, CASE WHEN m.campaign_id IS NOT NULL THEN 'EVENT' WHEN n < {NEEDED + POST} OR least <= 0 THEN 'NOT_POSITIVE' END AS reason FROM whole w JOIN sets USING (campaign_id) LEFT JOIN moved m ON m.campaign_id = w.campaign_id)
"""


def _weeks(s: Staging) -> DataFrame:
    """Spend, revenue and clicks of each campaign and week of the whole interval, numbered from its first week."""
    start = F.lit(START).cast("date")
    days = s.ad_daily().where((F.col("date") >= F.date_sub(start, 7 * NEEDED)) & (F.col("date") < F.date_add(start, 7 * POST)))
    weeks = days.groupBy("campaign_id", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(dsum("spend").alias("spend"), dsum("platform_revenue").alias("revenue"), F.sum("clicks").alias("clicks"))
    return weeks.withColumn("t", (F.datediff("week", start) / 7 + NEEDED).cast("int"))


def incidents(weeks: DataFrame) -> DataFrame:
    side = lambda c, lo, hi: dsum(F.when((F.col("t") >= lo) & (F.col("t") < hi), F.col(c)).otherwise(0.0))
    s = weeks.groupBy("campaign_id").agg(side("revenue", NEEDED, NEEDED + POST).alias("r1"), side("spend", NEEDED, NEEDED + POST).alias("s1"), side("revenue", NEEDED - POST, NEEDED).alias("r0"), side("spend", NEEDED - POST, NEEDED).alias("s0"))
    return s.where((F.col("s0") > 0) & (F.col("s1") > 0) & (F.col("r0") > 0) & (F.abs(F.col("r1") / F.col("s1") / (F.col("r0") / F.col("s0")) - 1) > CHANGE)).select("campaign_id")


def leading_sets(s: Staging) -> DataFrame:
    """The product set of a campaign: the category of which most units were sold, of equals the first by name."""
    sold = s.raw("lineitem").join(s.products().select("sku", "brand", "category"), F.col("l_partkey") == F.col("sku")).groupBy(F.col("brand").alias("campaign_id"), "category").agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return sold.groupBy("campaign_id").agg(F.min_by("category", F.struct(-F.col("v"), "category")).alias("lead"))


def states(s: Staging, weeks: DataFrame) -> DataFrame:
    """campaign_id, lead and reason: why a campaign is no control, if so. EVENT: its budget was moved near the start; NOT_POSITIVE: a week without spend or revenue."""
    start = F.lit(START).cast("date")
    before = F.lag("budget").over(Window.partitionBy("campaign_id").orderBy("snapshot_date"))
    moved = s.budget_snapshots().select("campaign_id", "snapshot_date", "budget", before.alias("before"))
    moved = moved.where((F.col("snapshot_date") >= F.date_sub(start, 7 * POST)) & (F.col("snapshot_date") < F.date_add(start, 7 * POST)) & (F.col("before") > 0) & (F.abs(F.col("budget") / F.col("before") - 1) > EVENT)).select("campaign_id").distinct().withColumn("_moved", F.lit(True))
    whole = weeks.groupBy("campaign_id").agg(F.count("*").alias("n"), F.min(F.least("spend", "revenue")).alias("least"))
    reason = F.when(F.col("_moved"), "EVENT").when((F.col("n") < NEEDED + POST) | (F.col("least") <= 0), "NOT_POSITIVE")
    return whole.join(leading_sets(s), "campaign_id").join(moved, "campaign_id", "left").select("campaign_id", "lead", reason.alias("reason"))


def _log_roas() -> Column:
    return F.when((F.col("revenue") > 0) & (F.col("spend") > 0), F.log(F.col("revenue") / F.col("spend")))


_PANEL = _WEEKS + f""", pairs AS (SELECT i.campaign_id AS incident, c.campaign_id AS control FROM incidents i JOIN states a USING (campaign_id) JOIN states c ON c.lead <> a.lead AND c.campaign_id <> a.campaign_id AND c.reason IS NULL WHERE c.campaign_id NOT IN (SELECT campaign_id FROM incidents)
), logs AS (SELECT campaign_id, week, CASE WHEN revenue > 0 AND spend > 0 THEN ln(revenue / spend) END AS v FROM weeks
), fits AS (SELECT incident, control, round(corr(y.v, x.v), 9) AS r FROM pairs JOIN logs y ON y.campaign_id = incident JOIN logs x ON x.campaign_id = control AND x.week = y.week WHERE y.week < DATE '{START}' - {7 * HOLD} AND y.week >= DATE '{START}' - {7 * (HOLD + FIT)} GROUP BY ALL
), panels AS (SELECT incident, control, r, CAST(row_number() OVER (PARTITION BY incident ORDER BY r DESC NULLS LAST, control) AS INTEGER) AS rank FROM fits QUALIFY rank <= {TOP})
"""


def panels(s: Staging, weeks: DataFrame) -> DataFrame:
    """incident, control, r, rank: of each incident its TOP best controls by correlation over the fit: other product sets, no event, no gap, no incident. Incidents are the stated query set, met with all campaigns."""
    hit, known = incidents(weeks), states(s, weeks)
    asked = hit.join(known, "campaign_id").select(F.col("campaign_id").alias("incident"), F.col("lead").alias("_lead"))
    fit = (F.col("t") >= OFFSET) & (F.col("t") < OFFSET + FIT)
    logs = weeks.where(fit).select("campaign_id", "t", _log_roas().alias("v")).groupBy("campaign_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("v"))  # FIT numbers a campaign
    mine = asked.join(logs.withColumnsRenamed({"campaign_id": "incident", "v": "y"}), "incident")
    others = known.where("reason is null").join(hit, "campaign_id", "left_anti").join(logs, "campaign_id").select(F.col("campaign_id").alias("control"), "lead", F.col("v").alias("x"))
    pairs = mine.join(others, (F.col("lead") != F.col("_lead")) & (F.size("x") == F.size("y")))
    pairs = pairs.select("incident", "control", F.inline(F.arrays_zip("y", "x"))).groupBy("incident", "control").agg(F.round(F.corr("y", "x"), 9).alias("r"))
    order = Window.partitionBy("incident").orderBy(F.desc_nulls_last("r"), "control")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


@query(_PANEL + "SELECT * FROM panels", "staging")
def d24_eligible_panel(s: Staging) -> DataFrame:
    return panels(s, _weeks(s))


@query(_WEEKS + """SELECT lead, coalesce(reason, CASE WHEN i.campaign_id IS NOT NULL THEN 'INCIDENT' ELSE 'ELIGIBLE' END) AS state, count(*) AS campaigns FROM states LEFT JOIN incidents i USING (campaign_id) GROUP BY ALL""", "staging")
def d24_exclusions(s: Staging) -> DataFrame:
    """How many campaigns of each product set may serve as controls, and why the others may not."""
    weeks = _weeks(s)
    known = states(s, weeks).join(incidents(weeks).withColumn("_hit", F.lit(True)), "campaign_id", "left")
    return known.groupBy("lead", F.coalesce("reason", F.when(F.col("_hit"), "INCIDENT").otherwise("ELIGIBLE")).alias("state")).agg(F.count("*").alias("campaigns"))


ESTIMATES = "incident string, method string, controls int, effect double, low double, high double, smape double, slope double, placebo double, placebo_worth double, conversions double, reason string, estimate double, worth double"


def estimated(series: pd.DataFrame) -> list[dict]:
    """Both methods and all gates for one incident: rows of control (null: the incident itself, whose spend, revenue and clicks count), t, spend, revenue and clicks."""
    own = series[series.control.isna()].set_index("t").reindex(range(NEEDED + POST))
    name = str(series.incident.iloc[0])
    told = {"incident": name, "controls": 0} | dict.fromkeys(("effect", "low", "high", "smape", "slope", "placebo", "placebo_worth", "conversions", "estimate", "worth"))
    early = None
    if not (own.spend.notna() & own.revenue.notna()).all():
        early = "HISTORY"
    elif not ((own.spend > 0) & (own.revenue > 0)).all():
        early = "NOT_POSITIVE"
    wide = series[series.control.notna()].assign(v=lambda d: np.log(d.revenue / d.spend)).pivot(index="t", columns="control", values="v").reindex(range(NEEDED + POST)).dropna(axis=1)
    told["controls"] = wide.shape[1]
    if early is None and wide.shape[1] < LEAST_CONTROLS:
        early = "FEW_CONTROLS"
    if early:
        return [told | {"method": m, "reason": early} for m in ("convex", "parallel")]
    y, x, spend = np.log(own.revenue / own.spend).to_numpy(), wide.to_numpy(), own.spend.to_numpy()
    at = lambda first: slice(first, first + FIT + HOLD + POST)
    after = slice(NEEDED, NEEDED + POST)
    worth_of = lambda got, first: got["effect"] * float(spend[first + FIT + HOLD : first + FIT + HOLD + POST] @ np.exp(y[first + FIT + HOLD : first + FIT + HOLD + POST])) / (1 + got["effect"]) * MARGIN
    least = max(LEAST_WORTH, SHARE * float(own.revenue[NEEDED - POST : NEEDED].mean()) * MARGIN)
    out = []
    for method in ("convex", "parallel"):
        rng = lambda k: np.random.default_rng(zlib.crc32(f"{name}|{START}|{method}|{k}".encode()))  # noqa: B023, E731
        run = (lambda first, k: panel.synthetic(y[at(first)], x[at(first)], FIT, HOLD, spend[at(first)][FIT + HOLD :], rng(k))) if method == "convex" else (lambda first, k: panel.parallel(y[at(first)], x[at(first)], FIT, HOLD, rng(k)))  # noqa: B023
        got, before = run(OFFSET, 0), run(0, 1)
        before_worth, conversions = worth_of(before, 0), float(own.clicks[after].sum())
        reason = (
            "POOR_FIT" if got["smape"] > MOST_SMAPE else "PLACEBO" if not before["low"] <= 0 <= before["high"] or abs(before_worth) >= least else "FEW_CONVERSIONS" if conversions < LEAST_CONVERSIONS
            else "TREND" if not got.get("passed", True) else None
        )
        row = told | {"method": method, "effect": got["effect"], "low": got["low"], "high": got["high"], "smape": got["smape"], "slope": got.get("slope"), "placebo": before["effect"], "placebo_worth": before_worth, "conversions": conversions, "reason": reason}
        out.append(row | ({} if reason else {"estimate": got["effect"], "worth": worth_of(got, OFFSET)}))
    return out


def estimates(s: Staging) -> DataFrame:
    """A row for each incident and method: the effect with its band, what each gate saw, the first gate that failed, and the estimate where none did."""
    weeks = _weeks(s)
    mine = weeks.join(incidents(weeks), "campaign_id").select(F.col("campaign_id").alias("incident"), F.lit(None).cast("string").alias("control"), "t", "spend", "revenue", "clicks")
    theirs = panels(s, weeks).join(weeks, F.col("control") == F.col("campaign_id")).select("incident", "control", "t", "spend", "revenue", "clicks")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(estimated(group), columns=[c.split()[0] for c in ESTIMATES.split(", ")])

    return mine.unionByName(theirs).groupBy("incident").applyInPandas(run, ESTIMATES)


@query()
def d25_convex_control(s: Staging) -> DataFrame:
    """Convex, ridged weights of controls, with a band from refitted draws."""
    return estimates(s).where("method = 'convex'").select("incident", "controls", *[F.round(c, 9).alias(c) for c in ("effect", "low", "high", "smape")])


@query()
def d26_parallel_trends(s: Staging) -> DataFrame:
    """Differences in differences with the slope before the start and its robust error as a gate."""
    return estimates(s).where("method = 'parallel'").select("incident", "controls", *[F.round(c, 9).alias(c) for c in ("effect", "low", "high", "smape", "slope")])


@query()
def d27_all_gates(s: Staging) -> DataFrame:
    """History, positivity, three controls, fit, placebo, conversions and trend, in this order; an estimate only where all hold."""
    return estimates(s).select("incident", "method", "controls", "reason", *[F.round(c, 6).alias(c) for c in ("smape", "placebo", "placebo_worth", "conversions", "estimate", "worth")])
