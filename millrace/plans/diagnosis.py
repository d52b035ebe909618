"""Detection and diagnosis by grouped aggregates and windows: robust scores, change points, decompositions, evidence and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import dsum, safe_ratio
from millrace.operators import relational as r
from millrace.plans.registry import query
from millrace.sources.testdata import Staging, dsum_sql

D = dsum_sql
#: The two windows that are compared.
PRE, POST = ("2001-05-01", "2001-05-28"), ("2001-05-29", "2001-06-25")
Z1, FACTOR, PENALTY, LEAST = 3.5, 1.4826, 8.0, 3


def _weeks(s: Staging) -> DataFrame:
    """Clicks and spend of each campaign and week (from Monday)."""
    return s.ad_daily().groupBy("campaign_id", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.sum("clicks").alias("clicks"), dsum("spend").alias("spend"))


WEEKS = f", weeks AS (SELECT campaign_id, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(clicks) AS BIGINT) AS clicks, {D('spend')} AS spend FROM ad_daily GROUP BY ALL)"


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(value - median) / (1.4826 MAD) of each key; null where the MAD is zero (no variance). Exact medians by two aggregates, joined back by key."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("median"))
    away = df.join(mid, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return away.join(away.groupBy(*keys).agg(F.median("_d").alias("mad")), keys).withColumn("z", F.when(F.col("mad") > 0, (F.col(value) - F.col("median")) / (F.lit(FACTOR) * F.col("mad")))).drop("_d")


@query(WEEKS + f""", m AS (SELECT campaign_id, median(clicks) AS median FROM weeks GROUP BY campaign_id), d AS (SELECT campaign_id, median(abs(clicks - median)) AS mad FROM weeks JOIN m USING (campaign_id) GROUP BY campaign_id)
SELECT campaign_id, week, clicks, median, mad, CASE WHEN mad > 0 THEN (clicks - median) / ({FACTOR}::DOUBLE * mad) END AS z, coalesce(abs(CASE WHEN mad > 0 THEN (clicks - median) / ({FACTOR}::DOUBLE * mad) END) >= {Z1}, false) AS fires FROM weeks JOIN m USING (campaign_id) JOIN d USING (campaign_id)""", "staging")  # fmt: skip
def d05_robust_z(s: Staging) -> DataFrame:
    df = robust_z(_weeks(s).select("campaign_id", "week", "clicks"), ["campaign_id"], "clicks")
    return df.withColumn("fires", F.coalesce(F.abs("z") >= Z1, F.lit(False)))


def transformed(n: Column, d: Column, kind: str) -> Column:
    """Numerators on the scale of their model: logit and log with pseudo counts, log1p."""
    return {"logit": F.log((n + 0.5) / (d - n + 0.5)), "log": F.log((n + 0.5) / (d + 1.0)), "log1p": F.log1p(n)}[kind]


@query("SELECT campaign_id, date, round(ln((c + 0.5::DOUBLE) / (i - c + 0.5::DOUBLE)), 9) AS logit, round(ln((c + 0.5::DOUBLE) / (i + 1.0::DOUBLE)), 9) AS log, round(ln(1 + c), 9) AS log1p FROM (SELECT campaign_id, date, CAST(sum(clicks) AS DOUBLE) AS c, CAST(sum(impressions) AS DOUBLE) AS i FROM ad_daily GROUP BY ALL)", "staging")
def d01_transforms(s: Staging) -> DataFrame:
    df = s.ad_daily().groupBy("campaign_id", "date").agg(F.sum("clicks").cast("double").alias("c"), F.sum("impressions").cast("double").alias("i"))
    return df.select("campaign_id", "date", *[F.round(transformed(F.col("c"), F.col("i"), k), 9).alias(k) for k in ("logit", "log", "log1p")])


def best_split(df: DataFrame, keys: list[str], order: str, value: str, least: int = LEAST, penalty: float = PENALTY) -> DataFrame:
    """Of each key, the split with the least squared error, if it gains more than the penalty times the mean squared error: keys, at (first row of the new level), gain, before, after.

    Sums of whole numbers on both sides of every row, so each split's cost is one expression.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    left = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(left), "_s": F.sum(value).over(left), "_all_n": F.count(F.lit(1)).over(every), "_all_s": F.sum(value).over(every), "_all_q": F.sum(F.col(value) * F.col(value)).over(every)})
    m = F.col("_all_n") - F.col("_n")
    gain = (F.col("_s") * F.col("_s")).cast("double") / F.col("_n") + ((F.col("_all_s") - F.col("_s")) * (F.col("_all_s") - F.col("_s"))).cast("double") / m - (F.col("_all_s") * F.col("_all_s")).cast("double") / F.col("_all_n")
    scale = (F.col("_all_q").cast("double") - (F.col("_all_s") * F.col("_all_s")).cast("double") / F.col("_all_n")) / F.col("_all_n")
    inner = df.where((F.col("_n") >= least) & (m >= least)).select(*keys, F.col(order).alias("at"), gain.alias("gain"), (F.col("_s").cast("double") / F.col("_n")).alias("before"), ((F.col("_all_s") - F.col("_s")).cast("double") / m).alias("after"), scale.alias("_scale"))
    best = r.latest_per_key(inner, keys, [F.desc("gain"), "at"])
    return best.where(F.col("gain") > penalty * F.col("_scale")).drop("_scale")


@query(WEEKS + f""", sums AS (SELECT campaign_id, week, count(*) OVER l AS n, sum(clicks) OVER l AS s, count(*) OVER e AS nn, sum(clicks) OVER e AS ss, sum(clicks * clicks) OVER e AS q FROM weeks WINDOW l AS (PARTITION BY campaign_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY campaign_id)
), splits AS (SELECT campaign_id, week AS at_week, CAST(s * s AS DOUBLE) / n + CAST((ss - s) * (ss - s) AS DOUBLE) / (nn - n) - CAST(ss * ss AS DOUBLE) / nn AS gain, CAST(s AS DOUBLE) / n AS before, CAST(ss - s AS DOUBLE) / (nn - n) AS after, (CAST(q AS DOUBLE) - CAST(ss * ss AS DOUBLE) / nn) / nn AS scale FROM sums WHERE n >= {LEAST} AND nn - n >= {LEAST})
SELECT campaign_id, at_week AS "at", gain, before, after FROM splits WHERE true QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY gain DESC, at_week) = 1 AND gain > 2.0 * scale""", "staging")  # fmt: skip
def d07_change_point(s: Staging) -> DataFrame:
    return best_split(_weeks(s), ["campaign_id"], "week", "clicks", penalty=2.0)


def _windows(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """keys with both windows' totals of each sum, in one pass: name_pre and name_post."""
    inside = {"pre": F.col("date").between(*PRE), "post": F.col("date").between(*POST)}
    return df.where(F.col("date").between(PRE[0], POST[1])).groupBy(*keys).agg(*[dsum(F.when(i, c).otherwise(0.0)).alias(f"{n}_{w}") for n, c in sums.items() for w, i in inside.items()])


def _windows_sql(table: str, keys: str, sums: dict[str, str]) -> str:
    inside = {"pre": f"date BETWEEN DATE '{PRE[0]}' AND DATE '{PRE[1]}'", "post": f"date BETWEEN DATE '{POST[0]}' AND DATE '{POST[1]}'"}
    parts = ", ".join(f"{D(f'CASE WHEN {i} THEN {c} ELSE 0.0::DOUBLE END')} AS {n}_{w}" for n, c in sums.items() for w, i in inside.items())
    return f"SELECT {keys}, {parts} FROM {table} WHERE date BETWEEN DATE '{PRE[0]}' AND DATE '{POST[1]}' GROUP BY {keys}"


_FUNNEL = {"i": "impressions", "c": "clicks", "s": "spend", "v": "platform_revenue"}


@query(f""", t AS ({_windows_sql("ad_daily", "campaign_id", _FUNNEL)}), ok AS (SELECT *, i_pre > 0 AND i_post > 0 AND c_pre > 0 AND c_post > 0 AND s_pre > 0 AND s_post > 0 AND v_pre > 0 AND v_post > 0 AS whole FROM t)
SELECT campaign_id, CASE WHEN whole THEN round(ln((c_post / i_post) / (c_pre / i_pre)), 9) END AS ctr, CASE WHEN whole THEN round(ln((v_post / c_post) / (v_pre / c_pre)), 9) END AS value_per_click, CASE WHEN whole THEN round(-ln((s_post / i_post) / (s_pre / i_pre)), 9) END AS cpm,
  CASE WHEN whole THEN round(ln((v_post / s_post) / (v_pre / s_pre)), 9) END AS roas, CASE WHEN NOT whole THEN 'COLLAPSE' END AS reason FROM ok""", "staging")  # fmt: skip
def d13_funnel_decomposition(s: Staging) -> DataFrame:
    """The change of log ROAS as the sum of its factors' changes; COLLAPSE where a factor is not positive."""
    t = _windows(s.ad_daily(), ["campaign_id"], {k: F.col(c) for k, c in _FUNNEL.items()})
    whole = F.lit(True)
    for c in t.columns[1:]:
        whole = whole & (F.col(c) > 0)
    t = t.withColumn("whole", whole)
    change = lambda n, d: F.log((F.col(f"{n}_post") / F.col(f"{d}_post")) / (F.col(f"{n}_pre") / F.col(f"{d}_pre")))
    held = lambda c: F.when(F.col("whole"), F.round(c, 9))
    return t.select("campaign_id", held(change("c", "i")).alias("ctr"), held(change("v", "c")).alias("value_per_click"), held(-change("s", "i")).alias("cpm"), held(change("v", "s")).alias("roas"), F.when(~F.col("whole"), "COLLAPSE").alias("reason"))


_MIX = {"n": "platform_revenue", "d": "spend"}
_RATE_MIX = f""", seg AS ({_windows_sql("ad_daily", "campaign_id", _MIX)}), tot AS (SELECT {D("d_pre")} AS t_pre, {D("d_post")} AS t_post FROM seg
), rates AS (SELECT campaign_id, CASE WHEN abs(d_pre) >= 1e-9 THEN 1.0::DOUBLE * n_pre / d_pre END AS r_pre, CASE WHEN abs(d_post) >= 1e-9 THEN 1.0::DOUBLE * n_post / d_post END AS r_post, d_pre / t_pre AS w_pre, d_post / t_post AS w_post FROM seg, tot
), effects AS (SELECT campaign_id, ((w_pre + w_post) / 2) * (coalesce(r_post, r_pre, 0.0::DOUBLE) - coalesce(r_pre, r_post, 0.0::DOUBLE)) AS rate_effect, ((coalesce(r_pre, r_post, 0.0::DOUBLE) + coalesce(r_post, r_pre, 0.0::DOUBLE)) / 2) * (w_post - w_pre) AS mix_effect FROM rates)
"""


def rate_mix(s: Staging) -> DataFrame:
    """campaign_id, rate_effect and mix_effect: midpoints, which sum to the change of the total rate."""
    seg = _windows(s.ad_daily(), ["campaign_id"], {k: F.col(c) for k, c in _MIX.items()})
    # one row of totals
    seg = seg.join(F.broadcast(seg.agg(dsum("d_pre").alias("t_pre"), dsum("d_post").alias("t_post"))), how="cross")
    seg = seg.withColumns({"r_pre": safe_ratio("n_pre", "d_pre"), "r_post": safe_ratio("n_post", "d_post"), "w_pre": F.col("d_pre") / F.col("t_pre"), "w_post": F.col("d_post") / F.col("t_post")})
    before, after = F.coalesce("r_pre", "r_post", F.lit(0.0)), F.coalesce("r_post", "r_pre", F.lit(0.0))
    return seg.select("campaign_id", (((F.col("w_pre") + F.col("w_post")) / 2) * (after - before)).alias("rate_effect"), (((before + after) / 2) * (F.col("w_post") - F.col("w_pre"))).alias("mix_effect"))


@query(_RATE_MIX + "SELECT * FROM effects", "staging")
def d14_rate_mix(s: Staging) -> DataFrame:
    return rate_mix(s)


@query(_RATE_MIX + """SELECT campaign_id, effect, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER w AS rank, coalesce(sum(abs(effect)) OVER (ORDER BY abs(effect) DESC, campaign_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before, sum(abs(effect)) OVER () AS total
  FROM (SELECT campaign_id, CAST(CAST(rate_effect + mix_effect AS DECIMAL(38,6)) AS DOUBLE) AS effect FROM effects) WINDOW w AS (ORDER BY abs(effect) DESC, campaign_id)) WHERE before < 0.8::DOUBLE * total AND rank <= 5""", "staging")  # fmt: skip
def d15_drilldown(s: Staging) -> DataFrame:
    """The fewest campaigns that explain four fifths of the change."""
    effects = rate_mix(s).select(F.lit("campaign").alias("dimension"), "campaign_id", (F.col("rate_effect") + F.col("mix_effect")).cast("decimal(38,6)").cast("double").alias("effect"))
    return r.smallest_prefix(effects, ["dimension"], "campaign_id", "effect").drop("dimension")


_CPM = {"s": "spend", "i": "impressions"}


@query(f""", t AS ({_windows_sql("ad_daily", "campaign_id", _CPM)}), e AS (SELECT count(*) AS campaigns, count(*) FILTER (WHERE i_pre > 0 AND i_post > 0 AND (s_post / i_post) / (s_pre / i_pre) > 1.15::DOUBLE) AS risen FROM t WHERE s_pre > 0)
SELECT campaigns, risen, CASE WHEN abs(campaigns) >= 1e-9 THEN 1.0::DOUBLE * risen / campaigns END AS share, coalesce(1.0::DOUBLE * risen / campaigns >= 0.6, false) AS supported FROM e""", "staging")  # fmt: skip
def d16_auction_evidence(s: Staging) -> DataFrame:
    """The share of campaigns whose CPM rose by more than 15%."""
    t = _windows(s.ad_daily(), ["campaign_id"], {k: F.col(c) for k, c in _CPM.items()}).where("s_pre > 0")
    risen = (F.col("i_pre") > 0) & (F.col("i_post") > 0) & (F.try_divide(F.try_divide("s_post", "i_post"), F.try_divide("s_pre", "i_pre")) > 1.15)
    df = t.agg(F.count("*").alias("campaigns"), F.count(F.when(risen, 1)).alias("risen")).withColumn("share", safe_ratio("risen", "campaigns"))
    return df.withColumn("supported", F.coalesce(F.col("share") >= 0.6, F.lit(False)))


@query("""SELECT ad_id, count(*) AS days, CASE WHEN sw * sxx - sx * sx <> 0 THEN (sw * sxy - sx * sy) / (sw * sxx - sx * sx) END AS slope FROM (
  SELECT ad_id, CAST(sum(impressions) OVER a AS DOUBLE) AS sw, CAST(sum(impressions * k) OVER a AS DOUBLE) AS sx, CAST(sum(impressions * k * k) OVER a AS DOUBLE) AS sxx, CAST(sum(clicks) OVER a AS DOUBLE) AS sy, CAST(sum(clicks * k) OVER a AS DOUBLE) AS sxy FROM (
    SELECT ad_id, impressions, clicks, row_number() OVER (PARTITION BY ad_id ORDER BY date) AS k FROM ad_daily) WINDOW a AS (PARTITION BY ad_id)) GROUP BY ad_id, sw, sx, sxx, sy, sxy""", "staging")  # fmt: skip
def d17_fatigue_slope(s: Staging) -> DataFrame:
    """The impression-weighted slope of an ad's CTR over its days of delivery, in closed form."""
    df = s.ad_daily().withColumn("k", F.row_number().over(Window.partitionBy("ad_id").orderBy("date")).cast("long"))
    total = lambda c: F.sum(c).cast("double")
    i, c, k = F.col("impressions"), F.col("clicks"), F.col("k")
    t = df.groupBy("ad_id").agg(F.count("*").alias("days"), total(i).alias("sw"), total(i * k).alias("sx"), total(i * k * k).alias("sxx"), total(c).alias("sy"), total(c * k).alias("sxy"))
    below = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    return t.select("ad_id", "days", F.when(below != 0, (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).alias("slope"))


@query(""", prices AS (SELECT sku, effective_from, price, lag(price) OVER (PARTITION BY sku ORDER BY effective_from) AS previous FROM price_history)
SELECT sku, effective_from, previous, price, price / previous - 1 AS change FROM prices WHERE previous IS NOT NULL AND abs(price / previous - 1) >= 0.5 AND effective_from BETWEEN DATE '2001-05-26' AND DATE '2001-06-25'""", "staging")
def d19_price_evidence(s: Staging) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy("sku").orderBy("effective_from"))
    df = s.price_history().withColumn("previous", before).where("previous is not null").withColumn("change", F.col("price") / F.col("previous") - 1)
    return df.where((F.abs("change") >= 0.5) & F.col("effective_from").between("2001-05-26", POST[1])).select("sku", "effective_from", "previous", "price", "change")


_CONTROLS = WEEKS + """, grid AS (SELECT a.week, a.clicks AS y, b.campaign_id AS control, b.clicks AS x FROM weeks a JOIN weeks b ON a.week = b.week AND b.campaign_id <> a.campaign_id WHERE a.campaign_id = 'Brand#1'
), corrs AS (SELECT control, count(*) AS n, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) / (sqrt(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE)) * sqrt(CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE))) AS corr FROM grid WHERE week < DATE '2001-05-28' GROUP BY control
), chosen AS (SELECT control, corr FROM corrs ORDER BY corr DESC, control LIMIT 5)
"""


def controls(s: Staging, treated: str = "Brand#1", start: str = "2001-05-28", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The treated series beside those of all others (week, y, control, x), and the k controls that correlate best before the start."""
    weeks = _weeks(s).select("campaign_id", "week", "clicks")
    own = weeks.where(F.col("campaign_id") == treated).select("week", F.col("clicks").alias("y"))
    grid = weeks.where(F.col("campaign_id") != treated).join(own, "week").select("week", "y", F.col("campaign_id").alias("control"), F.col("clicks").alias("x"))
    n, x, y = F.count("*"), F.col("x"), F.col("y")
    spread = lambda a: F.sqrt((n * F.sum(a * a) - F.sum(a) * F.sum(a)).cast("double"))
    corr = (n * F.sum(x * y) - F.sum(x) * F.sum(y)).cast("double") / (spread(x) * spread(y))
    return grid, grid.where(F.col("week") < start).groupBy("control").agg(corr.alias("corr")).orderBy(F.desc("corr"), "control").limit(k)


@query(_CONTROLS + "SELECT control, corr FROM chosen", "staging")
def o07_top_controls(s: Staging) -> DataFrame:
    return controls(s)[1]


@query(_CONTROLS + """, m AS (SELECT week >= DATE '2001-05-28' AS post, CAST(sum(y - x) AS DOUBLE) / count(*) AS gap, count(DISTINCT week) AS weeks FROM grid JOIN chosen USING (control) GROUP BY 1)
, pre AS (SELECT row_number() OVER (ORDER BY week) AS t, CAST(sum(y - x) AS BIGINT) AS g FROM grid JOIN chosen USING (control) WHERE week < DATE '2001-05-28' GROUP BY week
), line AS (SELECT CAST(count(*) * sum(t * g) - sum(t) * sum(g) AS DOUBLE) / CAST(count(*) * sum(t * t) - sum(t) * sum(t) AS DOUBLE) / 5 AS slope FROM pre)
SELECT a.gap - b.gap AS effect, a.weeks AS post_weeks, b.weeks AS pre_weeks, slope AS pre_slope, abs(slope) * a.weeks <= abs(a.gap - b.gap) AS trusted FROM m a, m b, line WHERE a.post AND NOT b.post""", "staging")
def d26_difference_in_differences(s: Staging) -> DataFrame:
    """Equal weights on the chosen controls: the mean gap after the start less the mean gap before. Trusted where the trend of the gap before the start would not make the effect by itself."""
    grid, chosen = controls(s)
    own = grid.join(chosen, "control", "left_semi")
    post = F.col("week") >= "2001-05-28"
    gap = F.col("y") - F.col("x")
    half = lambda p: F.sum(F.when(p, gap)).cast("double") / F.count(F.when(p, 1))
    told = own.agg((half(post) - half(~post)).alias("effect"), F.countDistinct(F.when(post, F.col("week"))).alias("post_weeks"), F.countDistinct(F.when(~post, F.col("week"))).alias("pre_weeks"))
    # a row for each week; the slope in closed form, of whole numbers
    pre = own.where(~post).groupBy("week").agg(F.sum(gap).alias("g")).withColumn("t", F.row_number().over(Window.orderBy("week")).cast("long"))
    n, t, g = F.count("*"), F.col("t"), F.col("g")
    line = pre.agg(((n * F.sum(t * g) - F.sum(t) * F.sum(g)).cast("double") / (n * F.sum(t * t) - F.sum(t) * F.sum(t)).cast("double") / 5).alias("pre_slope"))
    return told.join(line, how="cross").withColumn("trusted", F.abs("pre_slope") * F.col("post_weeks") <= F.abs("effect"))  # two tables of one row


@query(_CONTROLS + """, scaled AS (SELECT c.control, c.corr / t.total AS weight, g.ratio FROM chosen c, (SELECT sum(CAST(corr AS DECIMAL(38,12)))::DOUBLE AS total FROM chosen) t JOIN (SELECT control, CAST(sum(y) AS DOUBLE) / sum(x) AS ratio FROM grid WHERE week < DATE '2001-05-28' GROUP BY control) g ON g.control = c.control)
SELECT week, y, CAST(sum(CAST(weight * ratio * x AS DECIMAL(38,6))) AS DOUBLE) AS synthetic, y - CAST(sum(CAST(weight * ratio * x AS DECIMAL(38,6))) AS DOUBLE) AS effect FROM grid JOIN scaled USING (control) WHERE week >= DATE '2001-05-28' GROUP BY week, y""", "staging")  # fmt: skip
def d25_synthetic_control(s: Staging) -> DataFrame:
    """Controls scaled to the treated level before the start and weighted by their correlation (weights sum to one)."""
    grid, chosen = controls(s)
    ratio = grid.where(F.col("week") < "2001-05-28").groupBy("control").agg((F.sum("y").cast("double") / F.sum("x")).alias("ratio"))
    total = F.sum(F.col("corr").cast("decimal(38,12)")).over(Window.partitionBy()).cast("double")  # of the k chosen rows
    scaled = chosen.withColumn("weight", F.col("corr") / total).join(ratio, "control")
    made = grid.where(F.col("week") >= "2001-05-28").join(scaled, "control").groupBy("week", "y").agg(dsum(F.col("weight") * F.col("ratio") * F.col("x")).alias("synthetic"))
    return made.withColumn("effect", F.col("y") - F.col("synthetic"))


@query(WEEKS + """, f AS (SELECT campaign_id, week, 'clicks' AS metric, CAST(clicks AS DOUBLE) AS v FROM weeks UNION ALL SELECT campaign_id, week, 'spend', spend FROM weeks
), g AS (SELECT *, lag(v) OVER (PARTITION BY campaign_id, metric ORDER BY week) AS prev FROM f
), e AS (SELECT platform, metric, week, count(*) FILTER (WHERE prev > 0) AS eligible, count(*) FILTER (WHERE prev > 0 AND v < prev * 0.8::DOUBLE) AS down, count(*) FILTER (WHERE prev > 0 AND v > prev * 1.2::DOUBLE) AS up FROM g JOIN campaigns USING (campaign_id) GROUP BY ALL
), d AS (SELECT platform, metric, week, eligible, 'DOWN' AS direction, down AS moved FROM e UNION ALL SELECT platform, metric, week, eligible, 'UP', up FROM e)
SELECT platform, metric, week, direction, eligible, moved FROM d WHERE moved >= 2 AND 1.0::DOUBLE * moved / eligible >= 0.7""", "staging")  # fmt: skip
def d11_platform_incidents(s: Staging) -> DataFrame:
    """A metric that moves by a fifth, the same way, for at least two and seven in ten of a platform's campaigns: one incident instead of many."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in ("clicks", "spend")])
    before = F.lag("v").over(Window.partitionBy("campaign_id", "metric").orderBy("week"))
    df = _weeks(s).select("campaign_id", "week", F.inline(each)).withColumn("prev", before).where("prev > 0").join(s.campaigns().select("campaign_id", "platform"), "campaign_id")
    moved = lambda x: F.count(F.when(x, 1))
    e = df.groupBy("platform", "metric", "week").agg(F.count("*").alias("eligible"), moved(F.col("v") < F.col("prev") * 0.8).alias("down"), moved(F.col("v") > F.col("prev") * 1.2).alias("up"))
    d = e.select("platform", "metric", "week", "eligible", F.inline(F.array(*[F.struct(F.lit(n.upper()).alias("direction"), F.col(n).alias("moved")) for n in ("down", "up")])))
    return d.where((F.col("moved") >= 2) & (safe_ratio("moved", "eligible") >= 0.7)).select("platform", "metric", "week", "direction", "eligible", "moved")


@query(""", hits AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type = 'error'), marked AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 7 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM hits)
SELECT user_id, CAST(n AS BIGINT) AS incident, min(ts) AS opened, max(ts) AS last_seen, count(*) AS hits FROM marked GROUP BY user_id, n""", "staging")
def d12_incident_reopening(s: Staging) -> DataFrame:
    """Hits within seven days of the last one reopen the same incident."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hits = s.events().where("event_type = 'error'").withColumn("prev", F.lag("ts").over(w))
    fresh = F.when(F.col("prev").isNull() | (F.col("ts") > F.col("prev") + F.expr("interval 7 days")), 1).otherwise(0)
    return hits.withColumn("incident", F.sum(fresh).over(w)).groupBy("user_id", "incident").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_seen"), F.count("*").alias("hits"))
