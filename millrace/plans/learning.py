"""Evaluation, drivers, economics and the gates of a decision, over small tables that one aggregate each has made."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import dsum, negative_binomial_cdf, safe_ratio
from millrace.operators import relational as r
from millrace.plans import canonical, decisions, diagnosis, marts, operations
from millrace.plans.registry import query
from millrace.sources.testdata import LAST_DAY, Staging, dsum_sql

D = dsum_sql
#: Share of revenue that is contribution, what a change must be worth, and the two z of the detector.
MARGIN, MATERIAL, Z1, Z2 = 0.3, 500.0, 3.5, 2.5
PRE_DAYS, LEAST_DAYS, WINDOWS = 28, 14, (3, 7)


# --- detection --------------------------------------------------------------------------------------------------------------


@query(""", spans AS (SELECT ad_id, min(date) AS lo, max(date) AS hi FROM ad_daily GROUP BY ad_id
), grid AS (SELECT ad_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM spans
), seen AS (SELECT g.ad_id, g.date, a.clicks FROM grid g LEFT JOIN ad_daily a USING (ad_id, date)
), sides AS (SELECT *, max(CASE WHEN clicks IS NOT NULL THEN date END) OVER b AS d0, arg_max(clicks, date) FILTER (WHERE clicks IS NOT NULL) OVER b AS c0, min(CASE WHEN clicks IS NOT NULL THEN date END) OVER f AS d1, arg_min(clicks, date) FILTER (WHERE clicks IS NOT NULL) OVER f AS c1 FROM seen
  WINDOW b AS (PARTITION BY ad_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY ad_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ad_id, date, clicks IS NULL AS filled, CASE WHEN clicks IS NOT NULL THEN CAST(clicks AS DOUBLE) WHEN c0 IS NULL THEN CAST(c1 AS DOUBLE) WHEN c1 IS NULL THEN CAST(c0 AS DOUBLE) ELSE c0 + CAST(c1 - c0 AS DOUBLE) * (date - d0) / (d1 - d0) END AS clicks FROM sides""", "staging")  # fmt: skip
def d02_gap_interpolation(s: Staging) -> DataFrame:
    """Days without a value take the straight line between their neighbours."""
    days = s.ad_daily().select("ad_id", "date", "clicks")
    spans = days.groupBy("ad_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    seen = r.spine(spans, "lo", "hi").join(days, ["ad_id", "date"], "left")
    return interpolated(seen, ["ad_id"], "date", "clicks")


def interpolated(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """df with `filled` and the value as a double; a gap at an edge takes the nearest value."""
    w = Window.partitionBy(*keys).orderBy(day)
    there = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("c")))
    df = df.withColumns({"_b": F.last(there, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_f": F.first(there, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_b.c") + (F.col("_f.c") - F.col("_b.c")).cast("double") * F.datediff(day, "_b.d") / F.datediff("_f.d", "_b.d")
    made = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("_b").isNull(), F.col("_f.c").cast("double")).when(F.col("_f").isNull(), F.col("_b.c").cast("double")).otherwise(line)
    return df.select(*keys, day, F.col(value).isNull().alias("filled"), made.alias(value))


#: metric -> (numerator, denominator): the daily value is their ratio.
METRICS = {"CTR": ("clicks", "impressions"), "CPM": ("1000 * spend", "impressions"), "CPC": ("spend", "clicks"), "VALUE": ("revenue", "clicks"), "ROAS": ("revenue", "spend"), "SPEND": ("spend", "1")}

_DAYS = f", days AS (SELECT campaign_id, date, CAST(sum(impressions) AS DOUBLE) AS impressions, CAST(sum(clicks) AS DOUBLE) AS clicks, {D('spend')} AS spend, {D('platform_revenue')} AS revenue FROM ad_daily WHERE date > DATE '{LAST_DAY}' - {PRE_DAYS + max(WINDOWS)} AND date <= DATE '{LAST_DAY}' GROUP BY ALL)"
_METRIC_ROWS = " UNION ALL ".join(f"SELECT campaign_id, date, '{m}' AS metric, CAST({n} AS DOUBLE) AS num, CAST({d} AS DOUBLE) AS den, impressions, clicks, spend, revenue FROM days WHERE {d} > 0" for m, (n, d) in METRICS.items())
_IMPACT = f"""CASE metric WHEN 'CTR' THEN p_imp * (expected - actual) * value * {MARGIN}::DOUBLE WHEN 'CPM' THEN CASE WHEN expected > 0 AND actual > 0 THEN 1000.0::DOUBLE * p_spend * (1.0::DOUBLE / expected - 1.0::DOUBLE / actual) * ctr * value * {MARGIN}::DOUBLE ELSE 0.0::DOUBLE END
  WHEN 'CPC' THEN CASE WHEN expected > 0 AND actual > 0 THEN p_spend * (1.0::DOUBLE / expected - 1.0::DOUBLE / actual) * value * {MARGIN}::DOUBLE ELSE 0.0::DOUBLE END WHEN 'VALUE' THEN p_clicks * (expected - actual) * {MARGIN}::DOUBLE WHEN 'ROAS' THEN p_spend * (expected - actual) * {MARGIN}::DOUBLE ELSE (expected - actual) * n END"""
_EVALUATED = _DAYS + f""", metric_days AS ({_METRIC_ROWS}
), placed AS (SELECT m.*, num / den AS v, w, date > DATE '{LAST_DAY}' - w AS post FROM metric_days m, (VALUES {", ".join(f"({w})" for w in WINDOWS)}) x(w) WHERE date > DATE '{LAST_DAY}' - {PRE_DAYS} - w
), base AS (SELECT campaign_id, metric, w, count(*) AS n_pre, median(v) AS mid, {D("num")} / {D("den")} AS expected, {D("clicks")} AS c, {D("impressions")} AS i, {D("revenue")} AS rv FROM placed WHERE NOT post GROUP BY ALL
), spread AS (SELECT campaign_id, metric, w, median(abs(v - mid)) AS mad FROM placed JOIN base USING (campaign_id, metric, w) WHERE NOT post GROUP BY ALL
), scored AS (SELECT p.*, CASE WHEN mad > 0 THEN (v - mid) / (1.4826::DOUBLE * mad) END AS z FROM placed p JOIN base USING (campaign_id, metric, w) JOIN spread USING (campaign_id, metric, w) WHERE post
), signed AS (SELECT *, CASE WHEN z >= {Z2} THEN 1 WHEN z <= -{Z2} THEN -1 ELSE 0 END AS side FROM scored
), marked AS (SELECT *, abs(z) >= {Z1} OR (side <> 0 AND lag(side, 1) OVER o = side AND lag(side, 2) OVER o = side) AS hit FROM signed WINDOW o AS (PARTITION BY campaign_id, metric, w ORDER BY date)
), post AS (SELECT campaign_id, metric, w, count(*) AS n, coalesce(bool_or(hit), false) AS stat, {D("num")} / {D("den")} AS actual, {D("impressions")} AS p_imp, {D("clicks")} AS p_clicks, {D("spend")} AS p_spend FROM marked GROUP BY ALL
), joined AS (SELECT *, CASE WHEN i > 0 THEN c / i ELSE 0.0::DOUBLE END AS ctr, CASE WHEN c > 0 THEN rv / c ELSE 0.0::DOUBLE END AS value FROM post JOIN base USING (campaign_id, metric, w)
), evaluated AS (SELECT campaign_id, metric, w AS days, expected, actual, {_IMPACT} AS impact, CASE WHEN actual > expected THEN 'UP' WHEN actual < expected THEN 'DOWN' ELSE 'FLAT' END AS direction, n_pre >= {LEAST_DAYS} AS eligible, stat FROM joined
), flagged AS (SELECT *, eligible AND stat AND abs(impact) >= {MATERIAL} AS flagged FROM evaluated)
"""


def evaluated(s: Staging) -> DataFrame:
    """Of each campaign, metric and window: the value expected from the days before, the actual one, what the difference is worth, and whether it is eligible, significant and material."""
    last = F.lit(LAST_DAY).cast("date")
    days = s.ad_daily().where((F.col("date") > F.date_sub(last, PRE_DAYS + max(WINDOWS))) & (F.col("date") <= last)).groupBy("campaign_id", "date")
    days = days.agg(F.sum("impressions").cast("double").alias("impressions"), F.sum("clicks").cast("double").alias("clicks"), dsum("spend").alias("spend"), dsum("platform_revenue").alias("revenue"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(n).cast("double").alias("num"), F.expr(d).cast("double").alias("den")) for m, (n, d) in METRICS.items()])
    rows = days.select("*", F.inline(each)).where("den > 0").withColumn("w", F.explode(F.array(*map(F.lit, WINDOWS)))).where(F.col("date") > F.date_sub(last, F.col("w") + PRE_DAYS))
    rows = rows.withColumns({"v": F.col("num") / F.col("den"), "post": F.col("date") > F.date_sub(last, F.col("w"))})
    keys = ["campaign_id", "metric", "w"]
    pre = rows.where("not post")
    base = pre.groupBy(*keys).agg(F.count("*").alias("n_pre"), F.median("v").alias("mid"), (dsum("num") / dsum("den")).alias("expected"), dsum("clicks").alias("c"), dsum("impressions").alias("i"), dsum("revenue").alias("rv"))
    spread = pre.join(base.select(*keys, "mid"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("mid"))).alias("mad"))
    z = F.when(F.col("mad") > 0, (F.col("v") - F.col("mid")) / (F.lit(1.4826) * F.col("mad")))
    o = Window.partitionBy(*keys).orderBy("date")
    scored = rows.where("post").join(base.select(*keys, "mid"), keys).join(spread, keys).withColumn("z", z).withColumn("side", F.when(F.col("z") >= Z2, 1).when(F.col("z") <= -Z2, -1).otherwise(0))
    run = (F.col("side") != 0) & (F.lag("side", 1).over(o) == F.col("side")) & (F.lag("side", 2).over(o) == F.col("side"))
    post = scored.withColumn("hit", (F.abs("z") >= Z1) | run).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("stat"), (dsum("num") / dsum("den")).alias("actual"), dsum("impressions").alias("p_imp"), dsum("clicks").alias("p_clicks"), dsum("spend").alias("p_spend"))
    both = post.join(base, keys).withColumns({"ctr": F.when(F.col("i") > 0, F.col("c") / F.col("i")).otherwise(0.0), "value": F.when(F.col("c") > 0, F.col("rv") / F.col("c")).otherwise(0.0)})
    e, a, m = F.col("expected"), F.col("actual"), F.lit(MARGIN)
    inverse = F.when((e > 0) & (a > 0), F.lit(1.0) / F.when(e > 0, e) - F.lit(1.0) / F.when(a > 0, a))
    of = lambda x: F.when(inverse.isNotNull(), x).otherwise(0.0)
    impact = (
        F.when(F.col("metric") == "CTR", F.col("p_imp") * (e - a) * F.col("value") * m).when(F.col("metric") == "CPM", of(F.lit(1000.0) * F.col("p_spend") * inverse * F.col("ctr") * F.col("value") * m))
        .when(F.col("metric") == "CPC", of(F.col("p_spend") * inverse * F.col("value") * m)).when(F.col("metric") == "VALUE", F.col("p_clicks") * (e - a) * m).when(F.col("metric") == "ROAS", F.col("p_spend") * (e - a) * m).otherwise((e - a) * F.col("n"))
    )
    direction = F.when(a > e, "UP").when(a < e, "DOWN").otherwise("FLAT")
    told = both.select("campaign_id", "metric", F.col("w").alias("days"), "expected", "actual", impact.alias("impact"), direction.alias("direction"), (F.col("n_pre") >= LEAST_DAYS).alias("eligible"), "stat")
    return told.withColumn("flagged", F.col("eligible") & F.col("stat") & (F.abs("impact") >= MATERIAL))


@query(_EVALUATED + "SELECT * FROM flagged", "staging")
def d09_evaluate(s: Staging) -> DataFrame:
    return evaluated(s)


@query(_EVALUATED + "SELECT campaign_id, metric, days, direction, impact, flagged FROM flagged QUALIFY row_number() OVER (PARTITION BY campaign_id, metric ORDER BY flagged DESC, CASE WHEN flagged THEN abs(impact) ELSE 0.0 END DESC, days) = 1", "staging")
def o05_best_window(s: Staging) -> DataFrame:
    """One window of each campaign and metric: flagged before unflagged, then the greater impact, then the shorter one."""
    first = F.struct(F.col("flagged"), F.when(F.col("flagged"), F.abs("impact")).otherwise(0.0), -F.col("days"))
    best = evaluated(s).groupBy("campaign_id", "metric").agg(F.max_by(F.struct("days", "direction", "impact", "flagged"), first).alias("x"))
    return best.select("campaign_id", "metric", "x.days", "x.direction", "x.impact", "x.flagged")


@query(_EVALUATED + """, f AS (SELECT campaign_id, max(CASE WHEN metric = 'SPEND' AND flagged THEN direction END) AS spend, max(CASE WHEN metric IN ('CTR', 'CPC') AND flagged THEN direction END) AS traffic, max(CASE WHEN metric IN ('ROAS', 'VALUE') AND flagged THEN direction END) AS value, count(*) FILTER (WHERE flagged) AS flags FROM flagged GROUP BY campaign_id)
SELECT campaign_id, flags, CASE WHEN flags = 0 THEN 'none' WHEN spend IS NOT NULL AND traffic IS NULL AND value IS NULL THEN 'delivery_change' WHEN value IS NOT NULL AND traffic IS NULL THEN 'tracking_issue' ELSE 'efficiency_anomaly' END AS kind FROM f""", "staging")  # fmt: skip
def d10_classify(s: Staging) -> DataFrame:
    """What kind of incident the flags of a campaign make together."""
    of = lambda *names: F.max(F.when(F.col("metric").isin(*names) & F.col("flagged"), F.col("direction")))
    f = evaluated(s).groupBy("campaign_id").agg(of("SPEND").alias("spend"), of("CTR", "CPC").alias("traffic"), of("ROAS", "VALUE").alias("value"), F.count(F.when(F.col("flagged"), 1)).alias("flags"))
    spend, traffic, value = (F.col(c).isNotNull() for c in ("spend", "traffic", "value"))
    kind = F.when(F.col("flags") == 0, "none").when(spend & ~traffic & ~value, "delivery_change").when(value & ~traffic, "tracking_issue").otherwise("efficiency_anomaly")
    return f.select("campaign_id", "flags", kind.alias("kind"))


# --- drivers ----------------------------------------------------------------------------------------------------------------

#: module -> (levers it may claim, score from the changes of the levers)
MODULES = {"auction": (("cpm",), "least(1.0, greatest(0.0, -cpm * 4))"), "fatigue": (("ctr",), "least(1.0, greatest(0.0, -ctr * 4))"), "price": (("value_per_click",), "least(1.0, greatest(0.0, -value_per_click * 2))"), "saturation": (("ctr", "cpm"), "least(1.0, greatest(0.0, -(ctr + cpm) * 2))")}
_LEVERS = ("ctr", "value_per_click", "cpm")
_FUNNEL_SQL = f""", t AS ({diagnosis._windows_sql("ad_daily", "campaign_id", diagnosis._FUNNEL)}), funnel AS (SELECT campaign_id, round(ln((c_post / i_post) / (c_pre / i_pre)), 9) AS ctr, round(ln((v_post / c_post) / (v_pre / c_pre)), 9) AS value_per_click, round(-ln((s_post / i_post) / (s_pre / i_pre)), 9) AS cpm
  FROM t WHERE i_pre > 0 AND i_post > 0 AND c_pre > 0 AND c_post > 0 AND s_pre > 0 AND s_post > 0 AND v_pre > 0 AND v_post > 0
), scored AS ({" UNION ALL ".join(f"SELECT campaign_id, ctr + value_per_click + cpm AS total, '{m}' AS module, CAST({score} AS DOUBLE) AS score, lever, CASE lever {' '.join(f'WHEN {chr(39)}{x}{chr(39)} THEN {x}' for x in _LEVERS)} END AS c FROM funnel, (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in levers)}) l(lever)" for m, (levers, score) in MODULES.items())}
), claimed AS (SELECT *, sum(score) OVER (PARTITION BY campaign_id, lever) AS claims FROM scored
), parts AS (SELECT campaign_id, module, total, score, round(sum(CASE WHEN claims > 0 THEN c * score / claims ELSE 0.0::DOUBLE END), 6) AS contribution FROM claimed GROUP BY ALL
), rest AS (SELECT *, round(total - sum(contribution) OVER (PARTITION BY campaign_id), 6) + 0.0::DOUBLE AS unexplained, contribution <> 0 AND (contribution > 0) <> (total > 0) AS offsetting FROM parts
), shares AS (SELECT *, sum(abs(contribution)) OVER (PARTITION BY campaign_id) + abs(unexplained) AS denom FROM rest)
"""


@query(_FUNNEL_SQL + """SELECT campaign_id, module, contribution, unexplained, CASE WHEN denom > 0 THEN round(abs(contribution) / denom, 4) ELSE 0.0::DOUBLE END AS share, offsetting, CASE WHEN score >= 0.6 THEN 'STRONG_EVIDENCE' WHEN score >= 0.3 THEN 'WEAK_EVIDENCE' ELSE 'NOT_SUPPORTED' END AS level,
  CAST(row_number() OVER (PARTITION BY campaign_id ORDER BY offsetting OR score < 0.3, abs(contribution) DESC, score DESC, module) AS INTEGER) AS rank FROM shares""", "staging")  # fmt: skip
def d23_driver_ranking(s: Staging) -> DataFrame:
    """Modules share the levers that they claim by their evidence; what nobody claims is unexplained; a module that works against the change never leads."""
    f = diagnosis.d13_funnel_decomposition(s).where("reason is null")
    f = f.withColumn("total", F.col("ctr") + F.col("value_per_click") + F.col("cpm"))
    each = F.array(*[F.struct(F.lit(m).alias("module"), F.expr(score).cast("double").alias("score"), F.lit(x).alias("lever"), F.col(x).alias("c")) for m, (levers, score) in MODULES.items() for x in levers])
    claims = F.sum("score").over(Window.partitionBy("campaign_id", "lever"))
    parts = f.select("campaign_id", "total", F.inline(each)).withColumn("claims", claims).groupBy("campaign_id", "module", "total", "score")
    parts = parts.agg(F.round(F.sum(F.when(F.col("claims") > 0, F.col("c") * F.col("score") / F.col("claims")).otherwise(0.0)), 6).alias("contribution"))
    own = Window.partitionBy("campaign_id")
    rest = parts.withColumns({"unexplained": F.round(F.col("total") - F.sum("contribution").over(own), 6) + F.lit(0.0), "offsetting": (F.col("contribution") != 0) & ((F.col("contribution") > 0) != (F.col("total") > 0))})
    rest = rest.withColumn("denom", F.sum(F.abs("contribution")).over(own) + F.abs("unexplained"))
    level = F.when(F.col("score") >= 0.6, "STRONG_EVIDENCE").when(F.col("score") >= 0.3, "WEAK_EVIDENCE").otherwise("NOT_SUPPORTED")
    rank = F.row_number().over(own.orderBy(F.col("offsetting") | (F.col("score") < 0.3), F.abs("contribution").desc(), F.desc("score"), "module"))
    return rest.select("campaign_id", "module", "contribution", "unexplained", F.when(F.col("denom") > 0, F.round(F.abs("contribution") / F.col("denom"), 4)).otherwise(0.0).alias("share"), "offsetting", level.alias("level"), rank.alias("rank"))


_TREATED = ("Brand#1", "Brand#2", "Brand#3")


def _gated_sql(treated: str) -> str:
    held = diagnosis._CONTROLS.replace(diagnosis.WEEKS, "").replace("'Brand#1'", f"'{treated}'")
    for name in ("grid", "corrs", "chosen"):
        held = held.replace(name, f"{name}_{treated[-1]}")
    n = treated[-1]
    return held + f""", ratio_{n} AS (SELECT control, CAST(sum(y) AS DOUBLE) / sum(x) AS ratio FROM grid_{n} WHERE week < DATE '2001-05-28' GROUP BY control
), made_{n} AS (SELECT week, y, CAST(sum(CAST(ratio * x AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS made, count(*) AS k FROM grid_{n} JOIN chosen_{n} USING (control) JOIN ratio_{n} USING (control) GROUP BY week, y
), told_{n} AS (SELECT '{treated}' AS campaign_id, count(*) FILTER (WHERE week < DATE '2001-05-28') AS weeks, min(y) AS least, max(k) AS controls, CAST(sum(CASE WHEN week < DATE '2001-05-28' THEN CAST(abs(y - made) / ((y + made) / 2) AS DECIMAL(38,6)) END) AS DOUBLE) / count(*) FILTER (WHERE week < DATE '2001-05-28') AS smape,
  CAST(sum(CASE WHEN week >= DATE '2001-05-28' THEN CAST(y - made AS DECIMAL(38,6)) END) AS DOUBLE) AS effect, CAST(sum(CASE WHEN week >= DATE '2001-04-02' AND week < DATE '2001-05-28' THEN CAST(y - made AS DECIMAL(38,6)) END) AS DOUBLE) AS placebo FROM made_{n})
"""


_GATE = "CASE WHEN weeks < 26 THEN 'SHORT_HISTORY' WHEN least <= 0 THEN 'NOT_POSITIVE' WHEN controls < 3 THEN 'FEW_CONTROLS' WHEN smape > 0.15 THEN 'POOR_FIT' WHEN abs(placebo) > abs(effect) THEN 'PLACEBO' END"
_ALL_GATED = diagnosis.WEEKS + "".join(_gated_sql(t) for t in _TREATED)
_GATED = " UNION ALL ".join(f"SELECT * FROM told_{t[-1]}" for t in _TREATED)


@query(_ALL_GATED + f"SELECT campaign_id, controls, smape, placebo, {_GATE} AS reason, CASE WHEN {_GATE} IS NULL THEN effect END AS effect FROM ({_GATED})", "staging")
def d27_gated_estimate(s: Staging) -> DataFrame:
    """The effect on a treated campaign, if history, positivity, controls, fit and placebo allow one; else the first reason why not."""
    return functools.reduce(DataFrame.unionByName, [gated(s, t) for t in _TREATED])


def gated(s: Staging, treated: str) -> DataFrame:
    grid, chosen = diagnosis.controls(s, treated)
    ratio = grid.where("week < '2001-05-28'").groupBy("control").agg((F.sum("y").cast("double") / F.sum("x")).alias("ratio"))
    made = grid.join(chosen, "control", "left_semi").join(ratio, "control").groupBy("week", "y").agg((dsum(F.col("ratio") * F.col("x")) / F.count("*")).alias("made"), F.count("*").alias("k"))
    pre = F.col("week") < "2001-05-28"
    gap, late = F.col("y") - F.col("made"), pre & (F.col("week") >= "2001-04-02")
    t = made.agg(F.count(F.when(pre, 1)).alias("weeks"), F.min("y").alias("least"), F.max("k").alias("controls"), (dsum(F.when(pre, F.abs(gap) / ((F.col("y") + F.col("made")) / 2))) / F.count(F.when(pre, 1))).alias("smape"), dsum(F.when(~pre, gap)).alias("effect"), dsum(F.when(late, gap)).alias("placebo"))
    reason = F.when(F.col("weeks") < 26, "SHORT_HISTORY").when(F.col("least") <= 0, "NOT_POSITIVE").when(F.col("controls") < 3, "FEW_CONTROLS").when(F.col("smape") > 0.15, "POOR_FIT").when(F.abs("placebo") > F.abs("effect"), "PLACEBO")
    return t.withColumn("reason", reason).select(F.lit(treated).alias("campaign_id"), "controls", "smape", "placebo", "reason", F.when(F.col("reason").isNull(), F.col("effect")).alias("effect"))


# --- prediction and economics -----------------------------------------------------------------------------------------------

BLOCK, DRAWS = 8, 40


@query(diagnosis.WEEKS + f""", numbered AS (SELECT *, dense_rank() OVER (ORDER BY week) - 1 AS k FROM weeks), size AS (SELECT max(k) + 1 AS n FROM numbered
), starts AS (SELECT d, b, CAST('0x' || substr(md5(d || '-' || b), 1, 7) AS BIGINT) % (n - {BLOCK} + 1) AS start FROM size, range({DRAWS}) x(d), range(CAST(1000 AS BIGINT)) y(b) WHERE b < n // {BLOCK}
), drawn AS (SELECT campaign_id, d, CAST(sum(clicks) AS DOUBLE) / count(*) AS mean FROM starts, range({BLOCK}) z(o) JOIN numbered ON k = start + o GROUP BY campaign_id, d)
SELECT campaign_id, quantile_cont(mean, 0.05) AS low, quantile_cont(mean, 0.95) AS high FROM drawn GROUP BY campaign_id""", "staging")  # fmt: skip
def d29_joint_block_bootstrap(s: Staging) -> DataFrame:
    """Bands of weekly clicks from blocks of weeks; all campaigns take the same blocks, whose starts come from a hash of draw and block. The index is small: draws x blocks."""
    weeks = diagnosis._weeks(s)
    calendar = weeks.select("week").distinct().withColumn("k", F.row_number().over(Window.orderBy("week")) - 1)  # a row a week
    size = calendar.agg(F.count("*").alias("n"))
    index = size.select("n", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("d")).withColumn("b", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n div {BLOCK} as int) - 1"))))
    start = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("d").cast("string"), F.col("b").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") % (F.col("n") - BLOCK + 1)
    index = index.select("d", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("o")).select("d", (F.col("start") + F.col("o")).cast("int").alias("k"))
    drawn = weeks.join(calendar, "week").join(index, "k").groupBy("campaign_id", "d").agg((F.sum("clicks").cast("double") / F.count("*")).alias("mean"))
    return drawn.groupBy("campaign_id").agg(F.percentile("mean", F.lit(0.05)).alias("low"), F.percentile("mean", F.lit(0.95)).alias("high"))


@query(""", ads AS (SELECT ad_id, c.platform, split_part(ad_id, '-', 2) AS slot, CAST(sum(clicks) AS DOUBLE) AS c, CAST(sum(impressions) AS DOUBLE) AS i FROM ad_daily JOIN campaigns c USING (campaign_id) GROUP BY ALL
), groups AS (SELECT platform, slot, round(ln((sum(c) + 0.5) / (sum(i) - sum(c) + 0.5)), 6) AS prior FROM ads GROUP BY ALL)
SELECT ad_id, prior, 1.0::DOUBLE * (rank() OVER (ORDER BY prior) - 1) / greatest(count(*) OVER () - 1, 1) AS percentile FROM ads JOIN groups USING (platform, slot)""", "staging")  # fmt: skip
def d33_creative_prior(s: Staging) -> DataFrame:
    """What an ad's attributes alone promise, and where that stands among all ads. The order is over a row for each value that occurs, not over the ads."""
    ads = s.ad_daily().join(s.campaigns().select("campaign_id", "platform"), "campaign_id").groupBy("ad_id", "platform").agg(F.sum("clicks").cast("double").alias("c"), F.sum("impressions").cast("double").alias("i")).withColumn("slot", F.split_part("ad_id", F.lit("-"), F.lit(2)))
    groups = ads.groupBy("platform", "slot").agg(F.round(F.log((F.sum("c") + 0.5) / (F.sum("i") - F.sum("c") + 0.5)), 6).alias("prior"))
    told = ads.join(groups, ["platform", "slot"]).select("ad_id", "prior")
    values = told.groupBy("prior").agg(F.count("*").alias("n"))
    below, total = F.sum("n").over(Window.orderBy("prior")) - F.col("n"), F.sum("n").over(Window.partitionBy())
    places = values.select("prior", (F.lit(1.0) * below / F.greatest(total - 1, F.lit(1))).alias("percentile"))
    return told.join(places, "prior").select("ad_id", "prior", "percentile")


_LATEST = ", budget_now AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS current FROM budget_snapshots GROUP BY campaign_id)"


def _budget_now(s: Staging) -> DataFrame:
    return r.latest_value(s.budget_snapshots(), ["campaign_id"], "snapshot_date", ["budget"]).withColumnRenamed("budget", "current")


def _revenue(budget: Column) -> Column:
    """What the curve of columns top and half gives for a budget."""
    return F.col("top") * budget / (budget + F.col("half"))


@query(decisions._ALLOCATE + _LATEST + f""", moved AS (SELECT campaign_id, current, coalesce(b, 0.0::DOUBLE) AS proposed, top * coalesce(b, 0.0::DOUBLE) / (coalesce(b, 0.0::DOUBLE) + half) - top * current / (current + half) AS d_revenue FROM best JOIN budget_now USING (campaign_id) LEFT JOIN (SELECT campaign_id, count(*) * {decisions.STEP}::DOUBLE AS b FROM ranked WHERE n <= 150 GROUP BY campaign_id) USING (campaign_id)
), wanted AS (SELECT m.campaign_id, p.sku, d_revenue * w.weight / p.price AS units, 0.6::DOUBLE * p.price - p.ship_cost AS unit FROM moved m JOIN campaign_sku w USING (campaign_id) JOIN products p ON CAST(p.sku AS VARCHAR) = w.sku
), stock AS (SELECT sku, arg_max(greatest(on_hand - reserved, 0), date) AS available FROM stock_daily GROUP BY sku
), filled AS (SELECT sku, CASE WHEN {D("greatest(units, 0.0::DOUBLE)")} > 0 THEN least(1.0::DOUBLE, coalesce(max(available), 0) / {D("greatest(units, 0.0::DOUBLE)")}) ELSE 1.0::DOUBLE END AS fill FROM wanted LEFT JOIN stock USING (sku) GROUP BY sku)
SELECT m.campaign_id, m.current, m.proposed, m.d_revenue, {D("CASE WHEN units > 0 THEN units * fill ELSE units END")} AS d_units, {D("(CASE WHEN units > 0 THEN units * fill ELSE units END) * unit")} - (m.proposed - m.current) AS d_contribution FROM moved m JOIN wanted USING (campaign_id) JOIN filled USING (sku) GROUP BY m.campaign_id, m.current, m.proposed, m.d_revenue""", "canonical")  # fmt: skip
def d36_portfolio_economics(s: Staging) -> DataFrame:
    """What a proposed allocation is worth: revenue by the curves, units by the SKU weights, rationed where campaigns together ask for more than there is, contribution less spend."""
    proposed = decisions.allocation(s).select("campaign_id", F.col("budget").alias("proposed"))
    moved = decisions.response_curves(s).join(_budget_now(s), "campaign_id").join(proposed, "campaign_id", "left").withColumn("proposed", F.coalesce("proposed", F.lit(0.0)))
    moved = moved.select("campaign_id", "current", "proposed", (_revenue(F.col("proposed")) - _revenue(F.col("current"))).alias("d_revenue"))
    products = s.products().select(F.col("sku").cast("string").alias("sku"), "price", (F.lit(0.6) * F.col("price") - F.col("ship_cost")).alias("unit"))
    wanted = moved.select("campaign_id", "d_revenue").join(canonical.campaign_sku(s, canonical.order_items(s)).select("campaign_id", "sku", "weight"), "campaign_id").join(products, "sku").withColumn("units", F.col("d_revenue") * F.col("weight") / F.col("price"))
    stock = s.stock_daily().groupBy(F.col("sku").cast("string").alias("sku")).agg(F.max_by(F.greatest(F.col("on_hand") - F.col("reserved"), F.lit(0)), "date").alias("available"))
    asked = wanted.groupBy("sku").agg(dsum(F.greatest("units", F.lit(0.0))).alias("asked")).join(stock, "sku", "left")
    fill = asked.select("sku", F.when(F.col("asked") > 0, F.least(F.lit(1.0), F.coalesce("available", F.lit(0)) / F.col("asked"))).otherwise(1.0).alias("fill"))
    units = F.when(F.col("units") > 0, F.col("units") * F.col("fill")).otherwise(F.col("units"))
    sold = wanted.join(fill, "sku").groupBy("campaign_id").agg(dsum(units).alias("d_units"), dsum(units * F.col("unit")).alias("c"))
    return moved.join(sold, "campaign_id").select("campaign_id", "current", "proposed", "d_revenue", "d_units", (F.col("c") - (F.col("proposed") - F.col("current"))).alias("d_contribution"))


@query(""", m AS (SELECT sku, count(*) AS n, CAST(sum(units) AS DOUBLE) / count(*) AS mean, CAST(sum(units * units) * count(*) - sum(units) * sum(units) AS DOUBLE) / (count(*) * (count(*) - 1)) AS var, arg_max(on_hand - reserved, date) AS available FROM stock_daily GROUP BY sku HAVING count(*) > 1
), p AS (SELECT sku, mean, least(CASE WHEN var > mean THEN mean * mean / (var - mean) ELSE 1000.0::DOUBLE END, 1000.0::DOUBLE) AS r, greatest(available, 0) AS available FROM m)
SELECT sku, available, round(1.0::DOUBLE - least(1.0::DOUBLE, (SELECT sum(exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + mean)) + k * ln(mean / (r + mean)))) FROM range(CAST(available + 1 AS BIGINT)) t(k))), 6) AS stockout FROM p""", "staging")  # fmt: skip
def d38_stockout_probability(s: Staging) -> DataFrame:
    """P(demand of a day > available) of a negative binomial with the SKU's mean and dispersion."""
    n, t, q = F.count("*"), F.sum("units"), F.sum(F.col("units") * F.col("units"))
    m = s.stock_daily().groupBy("sku").agg(n.alias("n"), (t.cast("double") / n).alias("mean"), F.when(n > 1, (q * n - t * t).cast("double") / (n * (n - 1))).alias("var"), F.greatest(F.max_by(F.col("on_hand") - F.col("reserved"), "date"), F.lit(0)).alias("available")).where("n > 1")
    size = F.least(F.when(F.col("var") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("var") - F.col("mean"))).otherwise(1000.0), F.lit(1000.0))
    m = m.withColumn("r", size)
    return m.select("sku", "available", F.round(F.lit(1.0) - negative_binomial_cdf(F.col("available"), F.col("r"), F.col("r") / (F.col("r") + F.col("mean"))), 6).alias("stockout"))


SCENARIOS = {"cautious": 100, "base": 150, "bold": 200}


@query(decisions._ALLOCATE + " UNION ALL ".join(f"SELECT '{k}' AS scenario, campaign_id, count(*) * {decisions.STEP}::DOUBLE AS budget, {D('gain')} AS expected FROM ranked WHERE n <= {v} GROUP BY campaign_id" for k, v in SCENARIOS.items()), "staging")
def d40_scenarios(s: Staging) -> DataFrame:
    """The same optimiser under three totals."""
    return functools.reduce(DataFrame.unionByName, [decisions.allocation(s, v).select(F.lit(k).alias("scenario"), "campaign_id", "budget", "expected") for k, v in SCENARIOS.items()])


# --- learning and gates -----------------------------------------------------------------------------------------------------

_CONFIDENCE = marts._HEALTH + diagnosis.WEEKS + f""", lagged AS (SELECT campaign_id, clicks, CAST(sum(clicks) OVER w AS DOUBLE) / 4 AS expected, count(*) OVER w AS n FROM weeks WINDOW w AS (PARTITION BY campaign_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
), quality AS (SELECT platform, greatest(0.0::DOUBLE, 1.0::DOUBLE - {D("abs(clicks - expected)")} / sum(clicks)) * 0.5::DOUBLE AS prediction, count(*) AS outcomes, CAST(sum(CAST(abs(clicks - expected) / greatest((clicks + expected) / 2, 1.0::DOUBLE) AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS smape FROM lagged JOIN campaigns USING (campaign_id) WHERE n = 4 GROUP BY platform
), needed AS (SELECT q.platform, min(h.score) / 100.0::DOUBLE AS data FROM quality q JOIN data_health h ON h.source IN (q.platform || '_ads', 'store', 'erp') GROUP BY q.platform
), confidence AS (SELECT platform, data, prediction, (outcomes * (1.0::DOUBLE - smape / 2) + 7.0::DOUBLE) / (outcomes + 10) AS track FROM quality JOIN needed USING (platform))
"""


def confidence(s: Staging) -> DataFrame:
    """platform, data, prediction and track record, each from 0 to 1."""
    e = operations.expected_weeks(s).join(s.campaigns().select("campaign_id", "platform"), "campaign_id")
    off = F.abs(F.col("clicks") - F.col("expected"))
    n = F.count("*")
    quality = e.groupBy("platform").agg((F.greatest(F.lit(0.0), F.lit(1.0) - dsum(off) / F.sum("clicks")) * F.lit(0.5)).alias("prediction"), n.alias("outcomes"), (dsum(off / F.greatest((F.col("clicks") + F.col("expected")) / 2, F.lit(1.0))) / n).alias("smape"))
    health = marts.data_health(s).select("source", "score")
    deps = quality.select("platform", F.explode(F.array(F.concat("platform", F.lit("_ads")), F.lit("store"), F.lit("erp"))).alias("source")).join(health, "source").groupBy("platform").agg((F.min("score") / 100.0).alias("data"))
    track = (F.col("outcomes") * (F.lit(1.0) - F.col("smape") / 2) + F.lit(7.0)) / (F.col("outcomes") + 10)
    return quality.join(deps, "platform").select("platform", "data", "prediction", track.alias("track"))


@query(_CONFIDENCE + "SELECT platform, data, prediction, track, round(cbrt(greatest(data, 0) * greatest(prediction, 0) * greatest(track, 0)), 4) AS overall FROM confidence", "canonical")
def d46_confidence_index(s: Staging) -> DataFrame:
    """The geometric mean of data, prediction and track record: one bad part is not made up for by the others."""
    c = confidence(s)
    return c.withColumn("overall", F.round(F.cbrt(F.greatest("data", F.lit(0)) * F.greatest("prediction", F.lit(0)) * F.greatest("track", F.lit(0))), 4))





@query(_CONFIDENCE + decisions._ALLOCATE + _LATEST + f""", proposal AS (SELECT campaign_id, platform, coalesce(current, 0.0::DOUBLE) AS current, coalesce(b, 0.0::DOUBLE) AS proposed, best.top IS NOT NULL AS modelled FROM campaigns LEFT JOIN budget_now USING (campaign_id) LEFT JOIN best USING (campaign_id) LEFT JOIN (SELECT campaign_id, count(*) * {decisions.STEP}::DOUBLE AS b FROM ranked WHERE n <= 150 GROUP BY campaign_id) USING (campaign_id)
), total AS (SELECT {D("current")} AS total FROM proposal
), gate_facts AS (SELECT p.*, abs(proposed - current) / greatest(total, 1.0::DOUBLE) AS movement, c.prediction, (SELECT bool_and(band = 'GREEN') FROM data_health WHERE source IN (p.platform || '_ads', 'store', 'erp')) AS green FROM proposal p, total JOIN confidence c ON c.platform = p.platform)
SELECT campaign_id, gate, passed FROM (SELECT campaign_id, unnest(['PORTFOLIO_MOVEMENT', 'DATA_DEPENDENCIES_GREEN', 'MODELS_AVAILABLE', 'NOT_PINNED', 'UNIT_CAP']) AS gate, unnest([movement <= 0.1, green, modelled AND prediction > 0, current > 0, proposed <= 8000]) AS passed FROM gate_facts)""", "canonical")  # fmt: skip
def d48_autonomy_gates(s: Staging) -> DataFrame:
    """Whether each gate lets a campaign's proposed budget through without a person."""
    proposed = decisions.allocation(s).select("campaign_id", F.col("budget").alias("proposed"))
    p = s.campaigns().select("campaign_id", "platform").join(_budget_now(s), "campaign_id", "left").join(decisions.response_curves(s).select("campaign_id", F.lit(True).alias("m")), "campaign_id", "left").join(proposed, "campaign_id", "left")
    p = p.select("campaign_id", "platform", F.coalesce("current", F.lit(0.0)).alias("current"), F.coalesce("proposed", F.lit(0.0)).alias("proposed"), F.coalesce("m", F.lit(False)).alias("modelled"))
    total = p.agg(dsum("current").alias("total"))  # one row
    green = platform_health(s).groupBy("platform").agg(F.bool_and(F.col("band") == "GREEN").alias("green"))
    f = p.join(F.broadcast(total), how="cross").join(confidence(s).select("platform", "prediction"), "platform").join(green, "platform", "left")
    tests = {"PORTFOLIO_MOVEMENT": F.abs(F.col("proposed") - F.col("current")) / F.greatest("total", F.lit(1.0)) <= 0.1, "DATA_DEPENDENCIES_GREEN": F.col("green"), "MODELS_AVAILABLE": F.col("modelled") & (F.col("prediction") > 0), "NOT_PINNED": F.col("current") > 0, "UNIT_CAP": F.col("proposed") <= 8000}
    return f.select("campaign_id", F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in tests.items()])))


def platform_health(s: Staging) -> DataFrame:
    """platform, source and band of the sources that each platform's decisions need."""
    deps = s.campaigns().select("platform").distinct().select("platform", F.explode(F.array(F.concat("platform", F.lit("_ads")), F.lit("store"), F.lit("erp"))).alias("source"))
    return deps.join(marts.data_health(s).select("source", "band"), "source")


@query(decisions._CURVES + _LATEST + f""", moved AS (SELECT campaign_id, current, {MARGIN}::DOUBLE * (top * (current + 1000) / (current + 1000 + half) - top * current / (current + half)) - 1000.0::DOUBLE AS e, {MARGIN}::DOUBLE * sqrt(greatest(sse, 0.0::DOUBLE) / n) * 0.1::DOUBLE AS sd FROM best JOIN budget_now USING (campaign_id))
SELECT campaign_id, current, round(e, 6) AS expected, round(e - 0.5::DOUBLE * (1.2815515655446004::DOUBLE * sd), 6) AS score, CASE WHEN current + 1000 > 8000 THEN 'BLOCKED' ELSE 'FEASIBLE' END AS status FROM moved""", "staging")  # fmt: skip
def d50_opportunity_score(s: Staging) -> DataFrame:
    """What 1,000 more for one campaign promises, less half of the way down to its tenth percentile."""
    m = decisions.response_curves(s).join(_budget_now(s), "campaign_id")
    now = F.col("current")
    e = F.lit(MARGIN) * (_revenue(now + 1000) - _revenue(now)) - F.lit(1000.0)
    sd = F.lit(MARGIN) * F.sqrt(F.greatest("sse", F.lit(0.0)) / F.col("n")) * F.lit(0.1)
    return m.select("campaign_id", "current", F.round(e, 6).alias("expected"), F.round(e - F.lit(0.5) * (F.lit(1.2815515655446004) * sd), 6).alias("score"), F.when(now + 1000 > 8000, "BLOCKED").otherwise("FEASIBLE").alias("status"))


_UNIFORM = "CAST('0x' || substr(md5(d || '-' || seed), 1, 7) AS BIGINT)::DOUBLE / 268435456.0::DOUBLE"


@query(diagnosis.WEEKS + f""", lagged AS (SELECT campaign_id AS seed, abs(clicks - lag(clicks) OVER w) AS naive, abs(clicks - CAST(sum(clicks) OVER (PARTITION BY campaign_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS DOUBLE) / 4) AS mean4, count(*) OVER (PARTITION BY campaign_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n FROM weeks WINDOW w AS (PARTITION BY campaign_id ORDER BY week)
), paired AS (SELECT seed, ({D("naive")} - {D("mean4")}) / count(*) AS gain FROM lagged WHERE n = 4 GROUP BY seed
), drawn AS (SELECT d, CAST(sum(CAST(gain AS DECIMAL(28,6)) * k) AS DOUBLE) / sum(k) AS mean FROM (SELECT d, gain, CASE WHEN u < 0.3678794 THEN 0 WHEN u < 0.7357589 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.9810118 THEN 3 ELSE 4 END AS k FROM (SELECT d, gain, {_UNIFORM} AS u FROM paired, range(200) t(d))) GROUP BY d HAVING sum(k) > 0)
SELECT 'mean of four weeks over last week' AS comparison, (SELECT count(*) FROM paired) AS seeds, (SELECT count(*) FROM paired WHERE gain > 0) AS wins, (SELECT {D("gain")} / count(*) FROM paired) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM drawn""", "staging")  # fmt: skip
def d52_paired_report(s: Staging) -> DataFrame:
    """Two strategies on the same seeds (campaigns): mean of the paired gains, its bootstrap band, and how often the first wins."""
    w = Window.partitionBy("campaign_id").orderBy("week")
    n = F.count(F.lit(1)).over(w.rowsBetween(-4, -1))
    rows = diagnosis._weeks(s).select(F.col("campaign_id").alias("seed"), F.abs(F.col("clicks") - F.lag("clicks").over(w)).alias("naive"), F.abs(F.col("clicks") - F.sum("clicks").over(w.rowsBetween(-4, -1)).cast("double") / 4).alias("mean4"), n.alias("n")).where("n = 4")
    paired = rows.groupBy("seed").agg(((dsum("naive") - dsum("mean4")) / F.count("*")).alias("gain"))
    drawn = paired.select("seed", "gain", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("d"))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("d").cast("string"), "seed").cast("binary")), 1, 7), 16, 10).cast("long").cast("double") / 268435456.0
    k = F.when(u < 0.3678794, 0).when(u < 0.7357589, 1).when(u < 0.9196986, 2).when(u < 0.9810118, 3).otherwise(4)
    means = drawn.withColumn("k", k).groupBy("d").agg(F.sum(F.col("gain").cast("decimal(28,6)") * F.col("k")).cast("double").alias("t"), F.sum("k").alias("n")).where("n > 0").withColumn("mean", F.col("t") / F.col("n"))
    band = means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    told = paired.agg(F.count("*").alias("seeds"), F.count(F.when(F.col("gain") > 0, 1)).alias("wins"), (dsum("gain") / F.count("*")).alias("mean"))
    return told.join(band, how="cross").select(F.lit("mean of four weeks over last week").alias("comparison"), "seeds", "wins", "mean", "low", "high")  # two tables of one row


@query(decisions._CURVES + _LATEST + """, asked AS (SELECT campaign_id, current, floor(current * 1.1 / 500) * 500 AS proposed, top * current / (current + half) AS expected_before, top * (floor(current * 1.1 / 500) * 500) / (floor(current * 1.1 / 500) * 500 + half) AS expected_after FROM best JOIN budget_now USING (campaign_id))
SELECT campaign_id, current, proposed, expected_before, expected_after, sha256(campaign_id || '|' || CAST(CAST(current AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(proposed AS BIGINT) AS VARCHAR)) AS proposal_hash FROM asked""", "staging")  # fmt: skip
def d69_manual_proposal(s: Staging) -> DataFrame:
    """A person's allocation, valued by the same curves, under a hash that a replay must meet."""
    now = F.col("current")
    proposed = F.floor(now * 1.1 / 500).cast("double") * 500
    m = decisions.response_curves(s).join(_budget_now(s), "campaign_id").withColumn("proposed", proposed)
    text = F.concat_ws("|", "campaign_id", now.cast("long").cast("string"), F.col("proposed").cast("long").cast("string"))
    return m.select("campaign_id", "current", "proposed", _revenue(now).alias("expected_before"), _revenue(F.col("proposed")).alias("expected_after"), F.sha2(text, 256).alias("proposal_hash"))


@query(operations._LAGGED + """, pool AS (SELECT campaign_id, CAST(floor(clicks - expected) AS BIGINT) AS e, row_number() OVER (PARTITION BY campaign_id ORDER BY week DESC) AS k FROM b WHERE n = 4)
SELECT campaign_id, count(*) AS n, '[' || string_agg(CAST(e AS VARCHAR), ',' ORDER BY k) || ']' AS basis FROM pool WHERE k <= 26 GROUP BY campaign_id""", "staging")
def d70_measurement_basis(s: Staging) -> DataFrame:
    """The residuals of the last 26 weeks, newest first, frozen as JSON beside a decision."""
    k = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("week")))
    pool = operations.expected_weeks(s).withColumns({"k": k, "e": F.floor(F.col("clicks") - F.col("expected")).cast("long")}).where("k <= 26")
    rows = F.array_sort(F.collect_list(F.struct("k", "e")))  # at most 26
    return pool.groupBy("campaign_id").agg(F.count("*").alias("n"), F.to_json(F.transform(rows, lambda x: x["e"])).alias("basis"))


@query(marts._HEALTH + """, latest AS (SELECT campaign_id, arg_max(status, snapshot_date) AS status FROM budget_snapshots GROUP BY campaign_id
), lost AS (SELECT platform, CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(ga_sessions) AS DOUBLE) AS sessions FROM ad_daily JOIN campaigns USING (campaign_id) LEFT JOIN ga_daily USING (campaign_id, date) GROUP BY platform)
SELECT c.campaign_id, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM data_health h WHERE h.source IN (c.platform || '_ads', 'store', 'erp') AND band <> 'GREEN') THEN 'DATA_DEPENDENCY' END, CASE WHEN l.status = 'PAUSED' THEN 'EXECUTION_FREEZE' END, CASE WHEN coalesce(t.sessions, 0) < 0.0001 * t.clicks THEN 'TRACKING_FREEZE' END) AS flags
FROM campaigns c LEFT JOIN latest l USING (campaign_id) LEFT JOIN lost t ON t.platform = c.platform""", "canonical")  # fmt: skip
def d71_policy_flags(s: Staging) -> DataFrame:
    """Why a campaign's budget must not be touched: data it depends on, a freeze, sessions that no longer arrive."""
    bad = platform_health(s).groupBy("platform").agg(F.bool_or(F.col("band") != "GREEN").alias("bad"))
    latest = r.latest_value(s.budget_snapshots(), ["campaign_id"], "snapshot_date", ["status"])
    c = s.campaigns().select("campaign_id", "platform")
    lost = s.ad_daily().join(c, "campaign_id").join(s.ga_daily(), ["campaign_id", "date"], "left").groupBy("platform").agg(F.sum("clicks").cast("double").alias("clicks"), F.sum("ga_sessions").cast("double").alias("sessions"))
    df = c.join(bad, "platform", "left").join(latest, "campaign_id", "left").join(lost, "platform", "left")
    flags = F.concat_ws(",", F.when(F.col("bad"), "DATA_DEPENDENCY"), F.when(F.col("status") == "PAUSED", "EXECUTION_FREEZE"), F.when(F.coalesce("sessions", F.lit(0.0)) < 0.0001 * F.col("clicks"), "TRACKING_FREEZE"))
    return df.select("campaign_id", flags.alias("flags"))
