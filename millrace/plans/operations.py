"""Evidence, monitoring, forecasts and bookkeeping of the daily cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import dsum, safe_ratio
from millrace.operators import relational as r
from millrace.plans import canonical, diagnosis
from millrace.plans.registry import query
from millrace.sources import ingest
from millrace.sources.testdata import LAST_DAY, PLATFORMS, Staging, dsum_sql

D = dsum_sql
WEEKS = diagnosis.WEEKS


@query("SELECT date, ad_id, impressions, clicks, floor(spend) * 83.0::DOUBLE AS spend, CASE WHEN clicks > 20 THEN CAST(clicks AS DOUBLE) ELSE 0.0::DOUBLE END AS purchases FROM ad_daily", "staging")
def s10_normalise_ads(s: Staging) -> DataFrame:
    """Ad days written as native payloads and normalised again."""
    action = F.struct(F.lit("purchase").alias("action_type"), F.col("clicks").cast("string").alias("value"))
    other = F.struct(F.lit("view").alias("action_type"), F.lit("1").alias("value"))
    text = lambda c: F.col(c).cast("string").alias(c)
    payload = F.to_json(F.struct(text("date"), "ad_id", text("impressions"), text("clicks"), F.floor("spend").cast("string").alias("spend"), F.when(F.col("clicks") > 20, F.array(other, action)).otherwise(F.array(other)).alias("actions")))
    return ingest.normalise_ads(s.ad_daily().select(payload.alias("payload")))


@query("SELECT CAST(ts AS DATE) AS date, event_type, CAST(event_id AS VARCHAR) AS id FROM events")
def s15_normalise_report(s: Staging) -> DataFrame:
    raw = s.events().select(F.array(F.date_format("ts", "yyyyMMdd"), "event_type", F.col("event_id").cast("string")).alias("values"))
    return ingest.normalise_report(raw, ["date", "event_type", "id"])


@query("SELECT l_partkey AS sku, CAST(sum(l_linenumber) AS BIGINT) AS inbound, min(CAST(l_shipdate AS DATE)) AS next_arrival FROM lineitem GROUP BY l_partkey")
def s16_inbound_arrays(s: Staging) -> DataFrame:
    """Sums and minima over the nested array of a payload: an order's lines. What belongs to one SKU is never gathered."""
    one = F.struct(F.col("l_partkey").alias("sku"), F.col("l_linenumber").cast("long").alias("q"), F.to_date("l_shipdate").alias("d"))
    payloads = s.raw("lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("lines"))
    return payloads.select(F.inline("lines")).groupBy("sku").agg(F.sum("q").alias("inbound"), F.min("d").alias("next_arrival"))


@query("SELECT ad_id, date, 'r1' AS run_id, 'api' AS provenance, CAST(date + INTERVAL 1 DAY + INTERVAL 6 HOUR AS TIMESTAMP) AS available_at FROM ad_daily", "staging")
def s19_stamp(s: Staging) -> DataFrame:
    return ingest.stamp(s.ad_daily().select("ad_id", "date"), "r1", "2026-01-01 00:00:00", 6).drop("ingested_at")


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def s33_insert_missing(s: Staging) -> DataFrame:
    return r.insert_missing(s.raw("customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")), s.raw("supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")), ["id"])


@query("SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def a16_row_census(s: Staging) -> DataFrame:
    parts = [s.raw(n).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in ("orders", "part", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT source, arg_max(doc_id, (n_chars, doc_id)) AS longest_doc, max(n_chars) AS n_chars FROM documents GROUP BY source")
def a14_argmax_row(s: Staging) -> DataFrame:
    return s.raw("documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest_doc"), F.max("n_chars").alias("n_chars"))


@query("""SELECT c_mktsegment AS segment, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, 1.0::DOUBLE * max(n) / sum(n) AS dominance, max(n) > 0.5 * sum(n) AS dominated FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS k FROM customer GROUP BY ALL) GROUP BY c_mktsegment""")
def a24_pooled_rates(s: Staging) -> DataFrame:
    cells = s.raw("customer").groupBy(F.col("c_mktsegment").alias("segment"), "c_nationkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("k"))
    most, total = F.max("n"), F.sum("n")
    return cells.groupBy("segment").agg(total.alias("total"), F.sum("k").alias("k"), (F.lit(1.0) * most / total).alias("dominance"), (most > 0.5 * total).alias("dominated")).withColumnRenamed("total", "n")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w11_latest_event(s: Staging) -> DataFrame:
    return s.events().groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT day, quantile_cont(path, 0.1) AS p10, quantile_cont(path, 0.5) AS p50 FROM (SELECT user_id, day, CAST(sum(CAST(v AS DECIMAL(38,6))) OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS path FROM (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS v FROM events GROUP BY ALL)) GROUP BY day")
def w14_path_quantiles(s: Staging) -> DataFrame:
    """Lower and middle path of running totals over users, by day."""
    days = s.events().groupBy("user_id", F.to_date("ts").alias("day")).agg(dsum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    path = days.withColumn("path", F.sum(F.col("v").cast("decimal(38,6)")).over(w).cast("double"))
    return path.groupBy("day").agg(F.percentile("path", F.lit(0.1)).alias("p10"), F.percentile("path", F.lit(0.5)).alias("p50"))


_LAGGED = WEEKS + ", b AS (SELECT campaign_id, week, clicks, CAST(sum(clicks) OVER w AS DOUBLE) / 4 AS expected, count(*) OVER w AS n FROM weeks WINDOW w AS (PARTITION BY campaign_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"


def expected_weeks(s: Staging) -> DataFrame:
    """Weeks with the mean of the four weeks before; rows without four are left out."""
    w = Window.partitionBy("campaign_id").orderBy("week").rowsBetween(-4, -1)
    return diagnosis._weeks(s).select("campaign_id", "week", "clicks", F.when(F.count(F.lit(1)).over(w) == 4, F.sum("clicks").over(w).cast("double") / 4).alias("expected")).where("expected is not null")


@query(_LAGGED + " SELECT campaign_id, week, clicks - expected AS residual FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY week DESC) AS k FROM b WHERE n = 4) WHERE k <= 6", "staging")
def d04_rolling_backtest(s: Staging) -> DataFrame:
    """Residuals of the last six weekly origins."""
    k = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("week")))
    return expected_weeks(s).withColumn("k", k).where("k <= 6").select("campaign_id", "week", (F.col("clicks") - F.col("expected")).alias("residual"))


@query(_LAGGED + """, g AS (SELECT *, CASE WHEN clicks < 0.8::DOUBLE * expected THEN -1 WHEN clicks > 1.2::DOUBLE * expected THEN 1 ELSE 0 END AS side, abs(clicks - expected) > 0.5::DOUBLE * expected AS strong FROM b WHERE n = 4)
SELECT campaign_id, week, strong OR (side <> 0 AND coalesce(lag(side, 1) OVER w = side AND lag(side, 2) OVER w = side, false)) AS fires FROM g WINDOW w AS (PARTITION BY campaign_id ORDER BY week)""", "staging")
def d06_stat_rule(s: Staging) -> DataFrame:
    """Once strongly off, or three weeks in a row on one side."""
    e, x = F.col("expected"), F.col("clicks")
    df = expected_weeks(s).withColumns({"side": F.when(x < 0.8 * e, -1).when(x > 1.2 * e, 1).otherwise(0), "strong": F.abs(x - e) > 0.5 * e})
    w = Window.partitionBy("campaign_id").orderBy("week")
    same = F.coalesce((F.lag("side", 1).over(w) == F.col("side")) & (F.lag("side", 2).over(w) == F.col("side")), F.lit(False))
    return df.select("campaign_id", "week", (F.col("strong") | ((F.col("side") != 0) & same)).alias("fires"))


@query(_LAGGED + f""", v AS (SELECT campaign_id, {D('platform_revenue')} / sum(clicks) AS per_click FROM ad_daily GROUP BY campaign_id)
SELECT campaign_id, week, (clicks - expected) * per_click * 0.3::DOUBLE AS impact, CASE WHEN abs((clicks - expected) * per_click * 0.3::DOUBLE) < 1000 THEN 'immaterial' WHEN clicks < expected THEN 'efficiency_anomaly' ELSE 'delivery_change' END AS kind FROM b JOIN v USING (campaign_id) WHERE n = 4""", "staging")
def d08_impact_and_class(s: Staging) -> DataFrame:
    """What a change of clicks is worth, and what kind of incident it makes."""
    value = s.ad_daily().groupBy("campaign_id").agg((dsum("platform_revenue") / F.sum("clicks")).alias("per_click"))
    impact = (F.col("clicks") - F.col("expected")) * F.col("per_click") * 0.3
    kind = F.when(F.abs("impact") < 1000, "immaterial").when(F.col("clicks") < F.col("expected"), "efficiency_anomaly").otherwise("delivery_change")
    return expected_weeks(s).join(value, "campaign_id").withColumn("impact", impact).select("campaign_id", "week", "impact", kind.alias("kind"))


@query(""", low AS (SELECT sku, date FROM inventory_daily WHERE available < 0.25::DOUBLE * reorder_point), sold AS (SELECT o.campaign_id, o.net_revenue, l.sku IS NOT NULL AS exposed FROM order_items o LEFT JOIN low l ON o.sku = l.sku AND o.date = l.date WHERE o.campaign_id IS NOT NULL)
SELECT campaign_id, count(*) AS lines, count(*) FILTER (WHERE exposed) AS exposed_lines, CAST(sum(CASE WHEN exposed THEN CAST(net_revenue AS DECIMAL(38,6)) ELSE 0 END) AS DOUBLE) AS exposed_revenue FROM sold GROUP BY campaign_id""", "canonical")
def d18_inventory_evidence(s: Staging) -> DataFrame:
    """How much of a campaign's revenue came from SKUs that were about to run out."""
    low = canonical.inventory_daily(s).where(F.col("available") < 0.25 * F.col("reorder_point")).select("sku", "date", F.lit(True).alias("exposed"))
    sold = canonical.order_items(s).where("campaign_id is not null").join(low, ["sku", "date"], "left")
    return sold.groupBy("campaign_id").agg(F.count("*").alias("lines"), F.count("exposed").alias("exposed_lines"), dsum(F.when(F.col("exposed"), F.col("net_revenue")).otherwise(0.0)).alias("exposed_revenue"))


@query("""SELECT day, views, clicks, CASE WHEN views > 0 THEN 1.0::DOUBLE * clicks / views END AS ratio, coalesce(1.0::DOUBLE * clicks / nullif(views, 0) < 0.7::DOUBLE * lag(1.0::DOUBLE * clicks / nullif(views, 0)) OVER (ORDER BY day), false) AS suspect FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1)""")
def d20_tracking_evidence(s: Staging) -> DataFrame:
    """Days on which clicks no longer arrive though pages are viewed. Over a row for each calendar day."""
    of = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    days = s.events().groupBy(F.to_date("ts").alias("day")).agg(of("view").alias("views"), of("click").alias("clicks"))
    days = days.withColumn("ratio", F.when(F.col("views") > 0, F.lit(1.0) * F.col("clicks") / F.col("views")))
    return days.withColumn("suspect", F.coalesce(F.col("ratio") < 0.7 * F.lag("ratio").over(Window.orderBy("day")), F.lit(False)))


@query(WEEKS + """, t AS (SELECT campaign_id, week, clicks, spend, lag(clicks) OVER w AS c0, lag(spend) OVER w AS s0 FROM weeks WINDOW w AS (PARTITION BY campaign_id ORDER BY week))
SELECT campaign_id, count(*) AS weeks, count(*) FILTER (WHERE spend > 1.3::DOUBLE * s0 AND clicks < 1.1::DOUBLE * c0) AS saturated FROM t WHERE c0 > 0 AND s0 > 0 GROUP BY campaign_id""", "staging")
def d21_saturation_evidence(s: Staging) -> DataFrame:
    """Weeks in which much more was spent for hardly more clicks."""
    w = Window.partitionBy("campaign_id").orderBy("week")
    df = diagnosis._weeks(s).withColumns({"c0": F.lag("clicks").over(w), "s0": F.lag("spend").over(w)}).where("c0 > 0 and s0 > 0")
    return df.groupBy("campaign_id").agg(F.count("*").alias("weeks"), F.count(F.when((F.col("spend") > 1.3 * F.col("s0")) & (F.col("clicks") < 1.1 * F.col("c0")), 1)).alias("saturated"))


@query(f"""SELECT date, orders, expected, coalesce(abs(ln(orders / expected)) >= ln(1.15::DOUBLE), false) AS shifted FROM (SELECT date, CAST(orders AS DOUBLE) AS orders, CAST(lag(orders, 7) OVER w + lag(orders, 14) OVER w AS DOUBLE) / 2 AS expected FROM (SELECT date, count(DISTINCT order_id) AS orders FROM order_items WHERE channel NOT IN ('meta', 'google', 'tiktok', 'amazon') GROUP BY date) WINDOW w AS (ORDER BY date)) WHERE date > DATE '{LAST_DAY}' - 60""", "canonical")
def d22_demand_evidence(s: Staging) -> DataFrame:
    """Unpaid orders against the same weekday before: did demand itself move? Over a row for each calendar day."""
    w = Window.orderBy("date")
    days = canonical.order_items(s).where(~F.col("channel").isin(*PLATFORMS)).groupBy("date").agg(F.countDistinct("order_id").alias("n"))
    df = days.select("date", F.col("n").cast("double").alias("orders"), ((F.lag("n", 7).over(w) + F.lag("n", 14).over(w)).cast("double") / 2).alias("expected"))
    return df.withColumn("shifted", F.coalesce(F.abs(F.log(F.col("orders") / F.col("expected"))) >= F.log(F.lit(1.15)), F.lit(False))).where(F.col("date") > F.date_sub(F.lit(LAST_DAY).cast("date"), 60))


@query(_LAGGED + """, p AS (SELECT campaign_id, clicks - expected AS e, row_number() OVER (PARTITION BY campaign_id ORDER BY week DESC) AS k FROM b WHERE n = 4)
SELECT campaign_id, count(*) AS n, quantile_cont(e, 0.1) AS p10, quantile_cont(e, 0.9) AS p90 FROM p WHERE k <= 52 GROUP BY campaign_id HAVING count(*) >= 28""", "staging")
def d34_residual_pool(s: Staging) -> DataFrame:
    """The band of the last 52 residuals, where there are 28 at least."""
    k = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("week")))
    pool = expected_weeks(s).withColumns({"k": k, "e": F.col("clicks") - F.col("expected")}).where("k <= 52")
    return pool.groupBy("campaign_id").agg(F.count("*").alias("n"), F.percentile("e", F.lit(0.1)).alias("p10"), F.percentile("e", F.lit(0.9)).alias("p90")).where("n >= 28")


@query(f""", spent AS (SELECT campaign_id, {D('spend')} AS spend FROM ad_daily WHERE date > DATE '{LAST_DAY}' - 28 AND date <= DATE '{LAST_DAY}' GROUP BY campaign_id), budget AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS budget FROM budget_snapshots WHERE snapshot_date <= DATE '{LAST_DAY}' GROUP BY campaign_id
), sold AS (SELECT campaign_id, {D('net_revenue')} / sum(qty) AS nrpu, {D('cba')} / sum(qty) AS unit_cba FROM order_items WHERE campaign_id IS NOT NULL GROUP BY campaign_id)
SELECT c.campaign_id, c.platform, b.budget, coalesce(s.spend, 0.0::DOUBLE) AS spend, CASE WHEN abs(b.budget) >= 1e-9 THEN least(1.2::DOUBLE, greatest(0.3::DOUBLE, coalesce(s.spend, 0.0::DOUBLE) / b.budget)) END AS pacing, o.nrpu, o.unit_cba FROM campaigns c LEFT JOIN spent s USING (campaign_id) LEFT JOIN budget b USING (campaign_id) LEFT JOIN sold o USING (campaign_id)""", "canonical")  # fmt: skip
def d35_portfolio_state(s: Staging) -> DataFrame:
    """What a decision starts from, by one aggregate for each quantity and no query for each unit."""
    last = F.lit(LAST_DAY).cast("date")
    spent = s.ad_daily().where((F.col("date") > F.date_sub(last, 28)) & (F.col("date") <= last)).groupBy("campaign_id").agg(dsum("spend").alias("spend"))
    budget = r.latest_value(s.budget_snapshots().where(F.col("snapshot_date") <= last), ["campaign_id"], "snapshot_date", ["budget"])
    sold = canonical.order_items(s).where("campaign_id is not null").groupBy("campaign_id").agg((dsum("net_revenue") / F.sum("qty")).alias("nrpu"), (dsum("cba") / F.sum("qty")).alias("unit_cba"))
    df = s.campaigns().select("campaign_id", "platform").join(spent, "campaign_id", "left").join(budget, "campaign_id", "left").join(sold, "campaign_id", "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))
    return df.withColumn("pacing", F.least(F.lit(1.2), F.greatest(F.lit(0.3), safe_ratio("spend", "budget"))).cast("double")).withColumn("pacing", F.when(F.abs("budget") >= 1e-9, F.col("pacing"))).select("campaign_id", "platform", "budget", "spend", "pacing", "nrpu", "unit_cba")


@query(f""", v AS (SELECT campaign_id, product_set, {D('platform_revenue')} AS y FROM ad_daily JOIN campaigns USING (campaign_id) GROUP BY ALL)
SELECT a.campaign_id AS gains, b.campaign_id AS loses, 0.1::DOUBLE * least(a.y, b.y) AS stolen FROM v a JOIN v b ON a.product_set = b.product_set AND a.campaign_id < b.campaign_id""", "staging")
def d37_cannibalisation(s: Staging) -> DataFrame:
    """What campaigns of one product set take from one another. Pairs of campaigns within a set, which are few by nature."""
    v = s.ad_daily().join(s.campaigns(), "campaign_id").groupBy("campaign_id", "product_set").agg(dsum("platform_revenue").alias("y"))
    b = v.select(F.col("campaign_id").alias("loses"), "product_set", F.col("y").alias("z"))
    return v.join(b, "product_set").where("campaign_id < loses").select(F.col("campaign_id").alias("gains"), "loses", (F.lit(0.1) * F.least("y", "z")).alias("stolen"))


@query(_LAGGED + """, e AS (SELECT campaign_id, abs(clicks - expected) AS candidate, abs(clicks - lag(clicks) OVER (PARTITION BY campaign_id ORDER BY week)) AS champion FROM b WHERE n = 4)
SELECT campaign_id, CAST(sum(CAST(candidate AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS candidate_mae, CAST(sum(champion) AS DOUBLE) / count(*) AS champion_mae, CAST(sum(CAST(candidate AS DECIMAL(38,6))) AS DOUBLE) <= 1.02::DOUBLE * CAST(sum(champion) AS DOUBLE) AS noninferior FROM e WHERE champion IS NOT NULL GROUP BY campaign_id""", "staging")
def d45_champion_challenger(s: Staging) -> DataFrame:
    """A candidate forecast must not be more than 2% worse than the champion (last week again)."""
    w = Window.partitionBy("campaign_id").orderBy("week")
    df = expected_weeks(s).select("campaign_id", F.abs(F.col("clicks") - F.col("expected")).alias("candidate"), F.abs(F.col("clicks") - F.lag("clicks").over(w)).alias("champion")).where("champion is not null")
    n = F.count("*")
    return df.groupBy("campaign_id").agg((dsum("candidate") / n).alias("candidate_mae"), (F.sum("champion").cast("double") / n).alias("champion_mae"), (dsum("candidate") <= 1.02 * F.sum("champion").cast("double")).alias("noninferior"))


@query(WEEKS + """, f AS (SELECT campaign_id, week, CASE WHEN clicks > 0 THEN spend / clicks END AS cpc FROM weeks), g AS (SELECT *, cpc > 1.25::DOUBLE * lag(cpc) OVER w AS hot FROM f WINDOW w AS (PARTITION BY campaign_id ORDER BY week))
SELECT campaign_id, week, coalesce(hot AND lag(hot) OVER (PARTITION BY campaign_id ORDER BY week), false) AS triggered FROM g""", "staging")
def d49_safety_monitor(s: Staging) -> DataFrame:
    """A cost that rises by more than a quarter twice running."""
    w = Window.partitionBy("campaign_id").orderBy("week")
    cost = diagnosis._weeks(s).withColumn("cpc", F.when(F.col("clicks") > 0, F.col("spend") / F.col("clicks")))
    hot = cost.withColumn("hot", F.col("cpc") > 1.25 * F.lag("cpc").over(w))
    return hot.select("campaign_id", "week", F.coalesce(F.col("hot") & F.lag("hot").over(w), F.lit(False)).alias("triggered"))


@query(f"SELECT (SELECT {D('cba')} FROM order_items) - (SELECT {D('spend')} FROM ad_daily WHERE date <= DATE '{LAST_DAY}') AS contribution_after_ads, (SELECT count(DISTINCT (sku, date)) FROM inventory_daily WHERE available < reorder_point) AS stock_risk_sku_days", "canonical")
def d60_realised(s: Staging) -> DataFrame:
    sold = canonical.order_items(s).agg(dsum("cba").alias("cba"))
    spent = s.ad_daily().where(F.col("date") <= LAST_DAY).agg(dsum("spend").alias("spend"))
    risk = canonical.inventory_daily(s).where("available < reorder_point").agg(F.count("*").alias("stock_risk_sku_days"))  # a row for each SKU and date
    # three tables of one row
    return sold.join(spent, how="cross").join(risk, how="cross").select((F.col("cba") - F.col("spend")).alias("contribution_after_ads"), "stock_risk_sku_days")


@query("SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL EXCEPT ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE), count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def d61_exogenous_signature(s: Staging) -> DataFrame:
    """Where two runs' unpaid demand differs: rows of one signature that the other lacks."""
    sign = lambda df: df.where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    orders = s.raw("orders")
    return sign(orders).exceptAll(sign(orders.where("o_orderstatus <> 'P'")))


@query(""", last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY user_id) SELECT status, count(*) AS n, CAST(sum(changes) AS BIGINT) AS changes FROM last GROUP BY status""".replace(", last", "WITH last", 1))
def d73_status_log(s: Staging) -> DataFrame:
    """The current status of each entity from its append-only log, counted."""
    now = s.events().groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))
    return now.groupBy("status").agg(F.count("*").alias("n"), F.sum("changes").alias("changes"))
