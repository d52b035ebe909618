"""Economics of a proposed allocation: what campaigns take from one another, revenue over draws and days with stock rationed, budgets under constraints, and the cut that keeps stock safe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import response
from millrace.functions.columns import dsum
from millrace.operators import relational as r
from millrace.operators.selection import first_k
from millrace.plans import canonical, causal, decisions, prediction
from millrace.plans.registry import query
from millrace.sources.scratch import stored
from millrace.sources.testdata import Staging, dsum_sql

D = dsum_sql
#: How much units of one category share, of one channel and not, and the most that one unit's shares add up to.
SAME, NEAR, MOST = 0.30, 0.15, 0.5
#: The box of a budget, its step, and the share of revenue that is contribution before media.
BOX, STEP, MARGIN = 0.2, 100.0, 0.3
HORIZON, DRAWS = 7, 40
#: Unmapped weight above which a unit may not grow.
UNSURE = 0.2


def flows(units: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """units: keys, unit, category, channel, change and after (revenue) with raw_steal, realized_steal, shortfall, recapture, stolen_from and booked.

    Units of one category transfer SAME (one channel) or NEAR of a change to each other, all scaled alike so that no unit's shares exceed MOST. What a unit can lose is bounded by its revenue after. Sums over category and channel stand for
    the sums over partners, so no pairs are made.
    """
    members = units.select("unit", "category", "channel").distinct()
    of = lambda df, by, name: df.groupBy(*by).agg(F.count("*").cast("double").alias(name))
    known = members.join(of(members, ["category"], "_nc"), "category").join(of(members, ["category", "channel"], "_ns"), ["category", "channel"])
    known = known.withColumn("_row", F.lit(NEAR) * (F.col("_nc") - F.col("_ns")) + F.lit(SAME) * (F.col("_ns") - 1))
    top = known.agg(F.max("_row").alias("_top"))
    scaled = known.join(top, how="cross").select("unit", "_row", F.when(F.col("_top") > 0, F.least(F.lit(1.0), F.lit(MOST) / F.when(F.col("_top") > 0, F.col("_top")))).otherwise(1.0).alias("_alpha"))  # one row
    df = units.join(scaled, "unit").withColumns({"_p": F.greatest("change", F.lit(0.0)), "_q": F.greatest(-F.col("change"), F.lit(0.0))})

    def toward(df: DataFrame, values: dict[str, str]) -> DataFrame:
        """For each named value, what a unit's partners together send it per unit of theirs."""
        far = df.groupBy(*keys, "category").agg(*[dsum(v).alias(f"_c{k}") for k, v in values.items()])
        near = df.groupBy(*keys, "category", "channel").agg(*[dsum(v).alias(f"_s{k}") for k, v in values.items()])
        made = {k: F.col("_alpha") * (F.lit(NEAR) * (F.col(f"_c{k}") - F.col(f"_s{k}")) + F.lit(SAME) * (F.col(f"_s{k}") - F.col(v))) for k, v in values.items()}
        return df.join(far, [*keys, "category"]).join(near, [*keys, "category", "channel"]).withColumns(made).drop(*[f"_{x}{k}" for k in values for x in "cs"])

    df = toward(df, {"_taken": "_p", "recapture": "_q"})
    cap = F.greatest("after", F.lit(0.0))
    df = toward(df.withColumn("_scale", F.when(F.col("_taken") > cap, cap / F.when(F.col("_taken") > 0, F.col("_taken"))).otherwise(1.0)), {"_open": "_scale"})
    df = df.withColumns({"raw_steal": F.col("_p") * F.col("_alpha") * F.col("_row"), "realized_steal": F.col("_p") * F.col("_open"), "stolen_from": F.col("_taken") * F.col("_scale")})
    df = df.withColumn("shortfall", F.col("raw_steal") - F.col("realized_steal"))
    return df.select(*keys, "unit", "category", "channel", "change", "after", "raw_steal", "realized_steal", "shortfall", "recapture", "stolen_from", (F.col("change") - F.col("shortfall") + F.col("recapture") - F.col("stolen_from")).alias("booked"))


_FLOW = f""", sets AS (SELECT campaign_id, arg_min(category, (-v, category)) AS lead FROM (SELECT p.brand AS campaign_id, p.category, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem JOIN products p ON l_partkey = p.sku GROUP BY ALL) GROUP BY campaign_id
), halves AS (SELECT campaign_id AS unit, {D("CASE WHEN date >= DATE '2001-05-01' AND date < DATE '2001-06-01' THEN platform_revenue ELSE 0.0::DOUBLE END")} AS after, {D("CASE WHEN date >= DATE '2001-04-01' AND date < DATE '2001-05-01' THEN platform_revenue ELSE 0.0::DOUBLE END")} AS before FROM ad_daily GROUP BY ALL
), units AS (SELECT unit, lead AS category, platform AS channel, after - before AS change, after FROM halves JOIN sets ON campaign_id = unit JOIN campaigns c ON c.campaign_id = unit
), k AS (SELECT *, {NEAR}::DOUBLE * (count(*) OVER (PARTITION BY category) - count(*) OVER (PARTITION BY category, channel)) + {SAME}::DOUBLE * (count(*) OVER (PARTITION BY category, channel) - 1) AS row, greatest(change, 0.0::DOUBLE) AS p, greatest(-change, 0.0::DOUBLE) AS q FROM units
), a AS (SELECT *, CASE WHEN max(row) OVER () > 0 THEN least(1.0::DOUBLE, {MOST}::DOUBLE / max(row) OVER ()) ELSE 1.0::DOUBLE END AS alpha FROM k
), t AS (SELECT x.*, alpha * (SELECT coalesce(sum(y.p * CASE WHEN y.channel = x.channel THEN {SAME}::DOUBLE ELSE {NEAR}::DOUBLE END), 0.0::DOUBLE) FROM a y WHERE y.category = x.category AND y.unit <> x.unit) AS taken, alpha * (SELECT coalesce(sum(y.q * CASE WHEN y.channel = x.channel THEN {SAME}::DOUBLE ELSE {NEAR}::DOUBLE END), 0.0::DOUBLE) FROM a y WHERE y.category = x.category AND y.unit <> x.unit) AS recapture FROM a x
), u AS (SELECT *, CASE WHEN taken > greatest(after, 0.0::DOUBLE) THEN greatest(after, 0.0::DOUBLE) / taken ELSE 1.0::DOUBLE END AS scale FROM t
), w AS (SELECT x.*, p * alpha * (SELECT coalesce(sum(y.scale * CASE WHEN y.channel = x.channel THEN {SAME}::DOUBLE ELSE {NEAR}::DOUBLE END), 0.0::DOUBLE) FROM u y WHERE y.category = x.category AND y.unit <> x.unit) AS realized FROM u x)
SELECT unit, category, channel, round(p * alpha * row, 4) AS raw_steal, round(realized, 4) AS realized_steal, round(recapture, 4) AS recapture, round(taken * scale, 4) AS stolen_from, round(change - (p * alpha * row - realized) + recapture - taken * scale, 4) AS booked FROM w"""


@query(_FLOW, "staging")
def d37_symmetric_flows(s: Staging) -> DataFrame:
    """What campaigns that sell one category took from one another between two months, and what each may book of its own change."""
    month = lambda a, b: dsum(F.when((F.col("date") >= a) & (F.col("date") < b), F.col("platform_revenue")).otherwise(0.0))
    halves = s.ad_daily().groupBy("campaign_id").agg(month("2001-05-01", "2001-06-01").alias("after"), month("2001-04-01", "2001-05-01").alias("before"))
    units = halves.join(causal.leading_sets(s), "campaign_id").join(s.campaigns().select("campaign_id", "platform"), "campaign_id").select(F.col("campaign_id").alias("unit"), F.col("lead").alias("category"), F.col("platform").alias("channel"), (F.col("after") - F.col("before")).alias("change"), "after")
    got = flows(units)
    return got.select("unit", "category", "channel", *[F.round(c, 4).alias(c) for c in ("raw_steal", "realized_steal", "recapture", "stolen_from", "booked")])


# --- budgets ----------------------------------------------------------------------------------------------------------------

_BOXED = decisions._CURVES + f""", budget_now AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS current FROM budget_snapshots GROUP BY campaign_id
), weights AS (SELECT campaign_id, max(CASE WHEN sku = '{canonical.UNMAPPED}' THEN weight ELSE 0.0::DOUBLE END) AS unmapped FROM campaign_sku GROUP BY campaign_id
), boxed AS (SELECT campaign_id, top, half, current, coalesce(unmapped, 1.0::DOUBLE) <= {UNSURE} AS may_grow, ceil((1 - {BOX}::DOUBLE) * current / {STEP}) * {STEP} AS lo, CASE WHEN coalesce(unmapped, 1.0::DOUBLE) <= {UNSURE} THEN floor((1 + {BOX}::DOUBLE) * current / {STEP}) * {STEP} ELSE floor(current / {STEP}) * {STEP} END AS hi FROM best JOIN budget_now USING (campaign_id) LEFT JOIN weights USING (campaign_id) WHERE current > 0
), units AS (SELECT *, top * lo / (lo + half) AS at_lo FROM boxed WHERE hi >= lo
), steps AS (SELECT campaign_id, k, round({MARGIN}::DOUBLE * (top * (lo + k * {STEP}) / (lo + k * {STEP} + half) - top * (lo + (k - 1) * {STEP}) / (lo + (k - 1) * {STEP} + half)) - {STEP}, 6) AS gain FROM (SELECT *, unnest(generate_series(1, CAST((hi - lo) / {STEP} AS BIGINT))) AS k FROM units)
), room AS (SELECT CAST(floor((sum(CAST(current AS DECIMAL(38,6)))::DOUBLE - sum(CAST(lo AS DECIMAL(38,6)))::DOUBLE) / {STEP}) AS BIGINT) AS k FROM units
), chosen AS (SELECT campaign_id, count(*) AS steps FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, campaign_id, k) AS n FROM steps WHERE gain > 0) WHERE n <= (SELECT k FROM room) GROUP BY campaign_id)
"""


def boxed(s: Staging) -> DataFrame:
    """campaign_id, top, half, current, may_grow, lo and hi: what a budget may become, in whole steps."""
    now = r.latest_value(s.budget_snapshots(), ["campaign_id"], "snapshot_date", ["budget"]).withColumnRenamed("budget", "current").where("current > 0")
    weights = canonical.campaign_sku(s, canonical.order_items(s)).groupBy("campaign_id").agg(F.max(F.when(F.col("sku") == canonical.UNMAPPED, F.col("weight")).otherwise(0.0)).alias("unmapped"))
    df = decisions.response_curves(s).join(now, "campaign_id").join(weights, "campaign_id", "left").withColumn("may_grow", F.coalesce("unmapped", F.lit(1.0)) <= UNSURE)
    whole = lambda f, x: f(x / STEP) * STEP
    df = df.withColumns({"lo": whole(F.ceil, F.lit(1 - BOX) * F.col("current")), "hi": F.when(F.col("may_grow"), whole(F.floor, F.lit(1 + BOX) * F.col("current"))).otherwise(whole(F.floor, F.col("current")))})
    return stored(df.where("hi >= lo").select("campaign_id", "top", "half", "current", "may_grow", "lo", "hi"), "boxed")


def constrained(units: DataFrame, total: float | None = None) -> DataFrame:
    """units with steps, budget and why: the concave curves' best steps above the floors, as many as the present total (or another) pays for and as bring more than they cost.

    why: GROWS; AT_CAP; NOT_SURE (its SKU mix may not carry growth); LOW_RETURN (its next step costs more than it brings); NO_BUDGET (others' steps bring more).
    """
    at = lambda k: F.col("top") * (F.col("lo") + k * STEP) / (F.col("lo") + k * STEP + F.col("half"))
    steps = units.select("*", F.explode(F.sequence(F.lit(1), ((F.col("hi") - F.col("lo")) / STEP).cast("int"))).alias("k")).where("k > 0 and hi > lo")
    steps = steps.select("campaign_id", "k", F.round(F.lit(MARGIN) * (at(F.col("k")) - at(F.col("k") - 1)) - STEP, 6).alias("gain"))
    steps = stored(steps, "steps")  # looked at more than once
    sums = units.agg(dsum("current"), dsum("lo")).first()
    room = int(((sums[0] if total is None else total) - (sums[1] or 0.0)) // STEP) if sums[0] is not None else 0
    chosen = first_k(steps.where("gain > 0"), "gain", ["campaign_id", "k"], room).groupBy("campaign_id").agg(F.count("*").alias("steps"))
    df = units.join(chosen, "campaign_id", "left").withColumn("steps", F.coalesce("steps", F.lit(0).cast("long"))).withColumn("budget", F.col("lo") + F.col("steps") * STEP)
    following = F.round(F.lit(MARGIN) * (at(F.col("steps") + 1) - at(F.col("steps"))) - STEP, 6)
    why = F.when(F.col("budget") > F.col("current"), "GROWS").when(F.col("budget") >= F.col("hi"), F.when(F.col("may_grow"), "AT_CAP").otherwise("NOT_SURE")).when(following <= 0, "LOW_RETURN").otherwise("NO_BUDGET")
    return df.withColumn("why", why)


@query(_BOXED + f"""SELECT campaign_id, current, lo + coalesce(steps, 0) * {STEP}::DOUBLE AS budget, CASE WHEN lo + coalesce(steps, 0) * {STEP} > current THEN 'GROWS' WHEN lo + coalesce(steps, 0) * {STEP} >= hi THEN CASE WHEN may_grow THEN 'AT_CAP' ELSE 'NOT_SURE' END
  WHEN round({MARGIN}::DOUBLE * (top * (lo + (coalesce(steps, 0) + 1) * {STEP}) / (lo + (coalesce(steps, 0) + 1) * {STEP} + half) - top * (lo + coalesce(steps, 0) * {STEP}) / (lo + coalesce(steps, 0) * {STEP} + half)) - {STEP}, 6) <= 0 THEN 'LOW_RETURN' ELSE 'NO_BUDGET' END AS why FROM units LEFT JOIN chosen USING (campaign_id)""", "canonical")  # fmt: skip
def d39_constrained_budgets(s: Staging) -> DataFrame:
    return constrained(boxed(s)).select("campaign_id", "current", "budget", "why")


# --- draws ------------------------------------------------------------------------------------------------------------------

PARAMETERS = "unit string, draw int, " + ", ".join(f"{n} double" for n in response.NAMES) + ", median_spend double, median_revenue double, lingering double, base double"


def curve_draws(days: DataFrame, draws: int = DRAWS) -> DataFrame:
    """A row for each campaign and draw: parameters refitted to blocks of residuals, the units of spend and revenue, and the spend that lingers."""
    held = days.groupBy("campaign_id").agg(F.sort_array(F.collect_list(F.struct("date", "spend", "revenue", "base"))).alias("x")).select("campaign_id", *[F.col(f"x.{c}").alias(c) for c in ("spend", "revenue", "base")])
    names = [c.split()[0] for c in PARAMETERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                spend, revenue, base = (np.asarray(x, float) for x in (row.spend, row.revenue, row.base))
                unit, worth, level = prediction._normal(spend, revenue, base)
                if len(spend) < prediction.TRAIN or unit <= 0 or worth <= 0:
                    continue
                x, y, b = spend / unit, revenue / worth, base / level
                got = response.fit(x, y, b, float(x[:7].mean()))
                again = response.refits(x, y, b, float(x[:7].mean()), got, response.blocks(len(x), prediction.BLOCK, draws, prediction.SEED))
                out += [(row.campaign_id, k, *p, unit, worth, float(response.adstock(x, p[3], float(x[:7].mean()))[0][-1]), float(b[-14:].mean())) for k, p in enumerate(again.tolist())]
            yield pd.DataFrame(out, columns=names)

    return held.repartition("campaign_id").mapInPandas(run, PARAMETERS)


def revenue(draws: DataFrame, budgets: DataFrame) -> DataFrame:
    """unit, draw, before and after: revenue of HORIZON days at the present and at the proposed daily budget, the lingering spend carried from day to day. budgets: unit, now, then."""

    def day(budget: str, t: Column) -> Column:
        x, theta = F.col(budget) / F.col("median_spend"), F.col("theta")
        kept = F.pow(theta, t)
        a = F.greatest(x * (F.lit(1.0) - kept) / (F.lit(1.0) - theta) + kept * F.col("lingering"), F.lit(1e-12))
        return F.col("median_revenue") * (F.col("beta") / (F.lit(1.0) + F.pow(F.col("k") / a, F.col("s"))) + F.col("gamma") * F.col("base"))

    days = draws.join(budgets, "unit").withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    return days.groupBy("unit", "draw").agg(dsum(day("now", F.col("_t"))).alias("before"), dsum(day("then", F.col("_t"))).alias("after"))


def outlook(s: Staging, budgets: DataFrame, draws: DataFrame) -> DataFrame:
    """draw, d_revenue, d_units, d_contribution, rationed: each draw's revenue paths, booked between the campaigns, dealt to SKUs, and what growing campaigns ask of a SKU cut to what is there and what others release."""
    draws, budgets = stored(draws, "draws"), stored(budgets, "budgets")
    paths = revenue(draws, budgets)
    units = paths.join(causal.leading_sets(s).withColumnRenamed("campaign_id", "unit"), "unit").join(s.campaigns().select(F.col("campaign_id").alias("unit"), "platform"), "unit")
    units = stored(units.select("draw", "unit", F.col("lead").alias("category"), F.col("platform").alias("channel"), (F.col("after") - F.col("before")).alias("change"), "after"), "changes")
    booked = stored(flows(units, ["draw"]).select("draw", "unit", "booked"), "booked")
    products = s.products().select(F.col("sku").cast("string").alias("sku"), "price", (F.lit(0.6) * F.col("price") - F.col("ship_cost")).alias("each"))
    mix = canonical.campaign_sku(s, canonical.order_items(s)).select(F.col("campaign_id").alias("unit"), "sku", "weight").join(products, "sku")
    moved = booked.join(mix, "unit").select("draw", "sku", "each", (F.col("booked") * F.col("weight") / F.col("price")).alias("units"))
    sku = moved.groupBy("draw", "sku").agg(dsum(F.greatest("units", F.lit(0.0))).alias("asked"), dsum(F.greatest(-F.col("units"), F.lit(0.0))).alias("released"), F.first("each").alias("each"))
    stock = s.stock_daily().groupBy(F.col("sku").cast("string").alias("sku")).agg(F.max_by(F.col("on_hand") - F.col("reserved"), "date").cast("double").alias("available"), (F.sum("units").cast("double") / F.count("*") * 0.2).alias("daily"))
    head = F.greatest(F.coalesce(F.col("available") - HORIZON * F.col("daily"), F.lit(0.0)) + F.col("released"), F.lit(0.0))
    given = sku.join(stock, "sku", "left").withColumn("given", F.least(F.col("asked"), head))
    told = given.groupBy("draw").agg(dsum(F.col("given") - F.col("released")).alias("d_units"), dsum((F.col("given") - F.col("released")) * F.col("each")).alias("worth"), dsum(F.col("asked") - F.col("given")).alias("rationed"))
    spent = budgets.join(draws.select("unit").distinct(), "unit").agg((dsum(F.col("then") - F.col("now")) * HORIZON).alias("spent"))
    earned = booked.groupBy("draw").agg(dsum("booked").alias("d_revenue"))
    return earned.join(told, "draw").join(spent, how="cross").select("draw", "d_revenue", "d_units", (F.col("worth") - F.col("spent")).alias("d_contribution"), "rationed")  # one row


def proposal(s: Staging) -> DataFrame:
    """unit, now and then: daily budgets, of the weekly ones that the constrained optimiser moves from and to."""
    return constrained(boxed(s)).select(F.col("campaign_id").alias("unit"), (F.col("current") / 30).alias("now"), (F.col("budget") / 30).alias("then"))


@query()
def d36_draw_outlook(s: Staging) -> DataFrame:
    """Every draw of the proposed budgets."""
    got = outlook(s, proposal(s), curve_draws(prediction.unit_days(s)))
    return got.select("draw", *[F.round(c, 3).alias(c) for c in ("d_revenue", "d_units", "d_contribution", "rationed")])


@query()
def d36_outlook(s: Staging) -> DataFrame:
    """What the proposal is worth: mean, 10, 50 and 90 % points over the draws, and the chance of a loss."""
    c = F.col("d_contribution")
    q = lambda p: F.round(F.percentile(c, F.lit(p)), 3)
    return outlook(s, proposal(s), curve_draws(prediction.unit_days(s))).agg(F.count("*").alias("draws"), F.round(F.avg(c), 3).alias("mean"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), (F.lit(1.0) * F.count(F.when(c < 0, 1)) / F.count("*")).alias("prob_loss"))


_CUTS = 64


def safety_cut(s: Staging, units: DataFrame) -> tuple[int, DataFrame]:
    """The largest share (in 4096ths) of the proposed increases at which no SKU is asked for more than there is and was not before; looks at _CUTS + 1 shares at once, then at as many between the last safe one and the next."""
    products = s.products().select(F.col("sku").cast("string").alias("sku"), "price")
    mix = canonical.campaign_sku(s, canonical.order_items(s)).select("campaign_id", "sku", "weight").join(products, "sku")
    stock = s.stock_daily().groupBy(F.col("sku").cast("string").alias("sku")).agg(F.max_by(F.greatest(F.col("on_hand") - F.col("reserved"), F.lit(0)), "date").cast("double").alias("available"))
    curve = lambda b: F.col("top") * b / (b + F.col("half"))
    grown = stored(units.where("budget > current").select("campaign_id", "top", "half", "current", "budget"), "grown")
    mix = stored(mix.join(grown, "campaign_id", "left_semi"), "mix")

    def unsafe(shares: list[int]) -> set[int]:
        tried = grown.withColumn("f", F.explode(F.array(*map(F.lit, shares))))
        more = curve(F.col("current") + (F.col("budget") - F.col("current")) * F.col("f") / _CUTS**2) - curve(F.col("current"))
        asked = tried.withColumn("more", more).join(mix, "campaign_id").groupBy("f", "sku").agg(dsum(F.col("more") * F.col("weight") / F.col("price")).alias("asked"))
        return {x.f for x in asked.join(stock, "sku", "left").where(F.col("asked") > F.coalesce("available", F.lit(0.0))).select("f").distinct().collect()}  # as many as shares

    low, width = 0, _CUTS
    for _ in range(2):
        shares = [low + k * width for k in range(_CUTS + 1) if low + k * width <= _CUTS**2]
        bad = unsafe(shares)
        low = max([x for x in shares if all(y > x for y in bad)], default=0)
        width = 1
    safe = F.when(F.col("budget") > F.col("current"), F.col("current") + (F.col("budget") - F.col("current")) * low / _CUTS**2).otherwise(F.col("budget"))
    return low, units.withColumn("safe_budget", safe)


@query()
def d40_safety_cut(s: Staging) -> DataFrame:
    """The constrained budgets, with their increases cut back until stock carries them."""
    share, cut = safety_cut(s, stored(constrained(boxed(s)), "constrained"))
    return cut.select("campaign_id", "current", "budget", F.round("safe_budget", 4).alias("safe_budget"), F.lit(share / _CUTS**2).alias("share"))
