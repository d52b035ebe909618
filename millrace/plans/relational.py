"""Joins, windows, aggregates, sorts and set operations of the daily work, as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import METRICS, canonical_number, days_of_cover, dsum, inventory_band, metric, projected_shortfall, safe_ratio, stage_of, unit_contribution, units_from_net_revenue, wilson
from millrace.operators import relational as r
from millrace.plans import canonical
from millrace.plans.registry import query
from millrace.sources.testdata import AS_OF, LAST_DAY, Staging, dsum_sql

D = dsum_sql
LAST = LAST_DAY


# --- filters and predicates -------------------------------------------------------------------------------------------------


@query(f"SELECT order_id, line_item_id, date, subtotal FROM order_lines WHERE available_at <= TIMESTAMP '{AS_OF}'", "staging")
def p01_as_of_filter(s: Staging) -> DataFrame:
    return r.as_of(s.order_lines(), AS_OF).select("order_id", "line_item_id", "date", "subtotal")


@query("SELECT campaign_id, CASE WHEN platform = 'meta' THEN 'paid_social' WHEN platform = 'google' THEN 'paid_search' ELSE platform || '_other' END AS channel_id, nullif(trim(split_part(name, ' | ', 2)), '') AS product_set FROM campaigns", "staging")
def p02_channel_and_product_set(s: Staging) -> DataFrame:
    p = F.col("platform")
    return s.campaigns().select("campaign_id", F.when(p == "meta", "paid_social").when(p == "google", "paid_search").otherwise(F.concat(p, F.lit("_other"))).alias("channel_id"), F.nullif(F.trim(F.split_part("name", F.lit(" | "), F.lit(2))), F.lit("")).alias("product_set"))


@query("""SELECT order_id, line_item_id, CASE WHEN utm_source IS NOT DISTINCT FROM 'google' AND utm_medium IS NOT DISTINCT FROM 'cpc' THEN 'google' WHEN utm_source IS NOT DISTINCT FROM 'facebook' AND utm_medium IS NOT DISTINCT FROM 'paid' THEN 'meta'
  WHEN utm_source IS NOT DISTINCT FROM 'newsletter' AND utm_medium IS NOT DISTINCT FROM 'email' THEN 'email' WHEN utm_source IS NOT DISTINCT FROM 'google' AND utm_medium IS NOT DISTINCT FROM 'organic' THEN 'organic' ELSE 'direct' END AS channel FROM order_lines""", "staging")  # fmt: skip
def p03_generated_case(s: Staging) -> DataFrame:
    return s.order_lines().select("order_id", "line_item_id", canonical.channel().alias("channel"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def p06_json_path(s: Staging) -> DataFrame:
    return s.events().select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")


@query("SELECT DISTINCT p.sku FROM price_history p WHERE EXISTS (SELECT 1 FROM price_history q WHERE q.sku = p.sku AND q.effective_from < p.effective_from AND q.price > p.price * 1.5::DOUBLE)", "staging")
def p07_semi_theta(s: Staging) -> DataFrame:
    """SKUs that were once half as dear again as later: a semi join with a residual, by the running maximum instead of pairs."""
    w = Window.partitionBy("sku").orderBy("effective_from").rowsBetween(Window.unboundedPreceding, -1)
    return s.price_history().withColumn("m", F.max("price").over(w)).where("m > price * 1.5d").select("sku").distinct()


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def p08_anti(s: Staging) -> DataFrame:
    return s.raw("orders").select("o_orderkey").join(s.raw("lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 7, 13) AND p_type NOT IN (SELECT min(p_type) FROM part) AND p_brand LIKE 'Brand#1%'")
def p09_membership(s: Staging) -> DataFrame:
    part = s.raw("part")
    least = part.agg(F.min("p_type").alias("p_type"))
    return part.where(F.col("p_size").isin(1, 7, 13) & F.col("p_brand").startswith("Brand#1")).join(least, "p_type", "left_anti").select("p_partkey", "p_brand")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT user_id FROM events WHERE event_type = 'purchase')")
def p10_in_union(s: Staging) -> DataFrame:
    ids = s.raw("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).union(s.events().where("event_type = 'purchase'").select("user_id")).distinct()
    return s.raw("customer").select("c_custkey").join(ids, "c_custkey", "left_semi")


@query(f"SELECT campaign_id, {D('spend')} AS spend FROM ad_daily WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-06-28' GROUP BY campaign_id HAVING sum(impressions) > 0", "staging")
def p11_window_having(s: Staging) -> DataFrame:
    return s.ad_daily().where(F.col("date").between("2001-06-01", "2001-06-28")).groupBy("campaign_id").agg(dsum("spend").alias("spend"), F.sum("impressions").alias("n")).where("n > 0").drop("n")


def _sql_ratio(n: str, d: str, scale: float = 1.0) -> str:
    return f"CASE WHEN abs({d}) >= 1e-9 THEN {scale}::DOUBLE * {n} / {d} END"


_TOTALS = f"SELECT campaign_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, {D('spend')} AS spend, {D('platform_revenue')} AS revenue, {D('platform_revenue * 0.3::DOUBLE')} AS contribution, count(*) AS orders, {D('platform_revenue * 0.9::DOUBLE')} AS net_revenue, {D('platform_revenue')} AS platform_revenue, count(DISTINCT ad_id) AS new_customers, CAST(sum(clicks) AS BIGINT) AS sessions FROM ad_daily GROUP BY campaign_id"


@query(f"SELECT campaign_id, {', '.join(f'{_sql_ratio(n, d, k)} AS {m}' for m, (n, d, k) in METRICS.items())} FROM ({_TOTALS})", "staging")
def p13_metrics_library(s: Staging) -> DataFrame:
    """Every metric of the library over window totals."""
    t = s.ad_daily().groupBy("campaign_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), dsum("spend").alias("spend"), dsum("platform_revenue").alias("revenue"), dsum(F.col("platform_revenue") * 0.3).alias("contribution"), F.count("*").alias("orders"),
        dsum(F.col("platform_revenue") * 0.9).alias("net_revenue"), dsum("platform_revenue").alias("platform_revenue"), F.countDistinct("ad_id").alias("new_customers"), F.sum("clicks").alias("sessions"),
    )
    return t.select("campaign_id", *[metric(m).alias(m) for m in METRICS])


# --- joins ------------------------------------------------------------------------------------------------------------------


@query("""SELECT a.date, a.campaign_id, a.spend, b.budget FROM (SELECT date, campaign_id, CAST(sum(CAST(spend AS DECIMAL(38,6))) AS DOUBLE) AS spend FROM ad_daily GROUP BY ALL) a
  LEFT JOIN budget_history b ON a.campaign_id = b.campaign_id AND b.effective_from <= a.date AND (b.effective_to IS NULL OR a.date < b.effective_to)""", "canonical")  # fmt: skip
def j17_budget_in_effect(s: Staging) -> DataFrame:
    days = s.ad_daily().groupBy("date", "campaign_id").agg(dsum("spend").alias("spend"))
    # histories have no gaps, so the last change before a day is the one in effect: one sort of both sides, no pairs
    return r.asof_join(days, canonical.budget_history(s), ["campaign_id"], "date", "effective_from", ["budget"]).select("date", "campaign_id", "spend", "budget")


@query("""SELECT o.order_id, o.line_item_id, o.date, p.price FROM order_lines o LEFT JOIN price_history p ON p.sku = o.sku AND p.effective_from <= o.date AND (p.effective_to IS NULL OR o.date < p.effective_to)""", "staging")
def j18_price_on_day(s: Staging) -> DataFrame:
    """As-of join by one sort of both sides together: no pairs of a line with all prices of its SKU."""
    lines = s.order_lines().select("order_id", "line_item_id", "date", "sku")
    return r.asof_join(lines, s.price_history(), ["sku"], "date", "effective_from", ["price"]).select("order_id", "line_item_id", "date", "price")


@query("SELECT sku, effective_from, price, lag(price) OVER (PARTITION BY sku ORDER BY effective_from) AS previous_price FROM price_history", "staging")
def j19_previous_price(s: Staging) -> DataFrame:
    return s.price_history().select("sku", "effective_from", "price", F.lag("price").over(Window.partitionBy("sku").orderBy("effective_from")).alias("previous_price"))


@query(f", spent AS (SELECT campaign_id, {D('spend')} AS spend FROM ad_daily WHERE date <= DATE '{LAST_DAY}' GROUP BY campaign_id) SELECT sku, {D('spend * weight')} AS spend FROM campaign_sku JOIN spent USING (campaign_id) GROUP BY sku", "canonical")
def j20_weighted_spend(s: Staging) -> DataFrame:
    spent = s.ad_daily().where(F.col("date") <= LAST).groupBy("campaign_id").agg(dsum("spend").alias("spend"))
    return canonical.campaign_sku(s, canonical.order_items(s)).join(spent, "campaign_id").groupBy("sku").agg(dsum(F.col("spend") * F.col("weight")).alias("spend"))


@query(f"SELECT a.ad_id, CAST(sum(a.clicks) AS BIGINT) AS clicks, CAST(sum(a.impressions) AS BIGINT) AS impressions FROM ad_daily a JOIN (SELECT ad_id, min(date) AS d0 FROM ad_daily GROUP BY ad_id) f USING (ad_id) WHERE a.date < f.d0 + 30 GROUP BY a.ad_id", "staging")
def j22_early_window(s: Staging) -> DataFrame:
    """An ad's first 30 days, by a window instead of a self-join."""
    df = s.ad_daily().withColumn("d0", F.min("date").over(Window.partitionBy("ad_id")))
    return df.where(F.col("date") < F.date_add("d0", 30)).groupBy("ad_id").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


@query("""SELECT p.category, CAST(sum(CASE WHEN demand > 0 THEN least(on_hand / demand, 365.0::DOUBLE) ELSE 365.0::DOUBLE END * price) AS DOUBLE) / sum(price) AS cover FROM (
  SELECT sku, arg_max(on_hand, date) AS on_hand, CAST(sum(units) AS DOUBLE) / 28 AS demand FROM stock_daily GROUP BY sku) JOIN products p USING (sku) GROUP BY p.category""".replace("CAST(sum(CASE", "sum(CAST(CASE").replace("* price) AS DOUBLE) / sum(price)", "* price AS DECIMAL(38,6)))::DOUBLE / sum(CAST(price AS DECIMAL(38,6)))::DOUBLE"), "staging")  # fmt: skip
def j26_weighted_cover(s: Staging) -> DataFrame:
    now = s.stock_daily().groupBy("sku").agg(F.max_by("on_hand", "date").alias("on_hand"), (F.sum("units").cast("double") / 28).alias("demand")).join(s.products().select("sku", "category", "price"), "sku")
    cover = F.least(days_of_cover(F.col("on_hand"), F.col("demand")), F.lit(365.0))
    return now.groupBy("category").agg((dsum(cover * F.col("price")) / dsum("price")).alias("cover"))


@query("SELECT c.c_custkey, n.n_name, r.r_name, count(o.o_orderkey) AS orders FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def j27_star(s: Staging) -> DataFrame:
    per = s.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    df = s.raw("customer").join(s.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(s.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(per, "c_custkey", "left")
    return df.select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT p.category, count(*) AS lines, count(*) FILTER (WHERE o.order_id IS NULL) AS unsold FROM products p LEFT JOIN (SELECT sku, min(order_id) AS order_id FROM order_lines WHERE qty >= 49 GROUP BY sku) o USING (sku) GROUP BY p.category", "staging")
def j11_anti_by_left_join(s: Staging) -> DataFrame:
    big = s.order_lines().where("qty >= 49").groupBy("sku").agg(F.min("order_id").alias("order_id"))
    return s.products().join(big, "sku", "left").groupBy("category").agg(F.count("*").alias("lines"), F.count(F.when(F.col("order_id").isNull(), 1)).alias("unsold"))


# --- aggregates -------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS kinds, bool_or(event_type = 'purchase') AS purchased, count(*) FILTER (WHERE event_type = 'view') AS views, arg_min(event_type, event_id) AS entry FROM events GROUP BY user_id")
def a08_sessions(s: Staging) -> DataFrame:
    return s.events().groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("kinds"), F.bool_or(F.col("event_type") == "purchase").alias("purchased"), F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), F.min_by("event_type", "event_id").alias("entry"))


@query(f"SELECT p.category, {D('subtotal')} AS gmv, {D('CASE WHEN returned THEN subtotal ELSE 0.0::DOUBLE END')} AS returned_value, count(DISTINCT order_id) FILTER (WHERE returned) AS returned_orders, count(DISTINCT (date, sku)) AS sku_days FROM order_lines JOIN products p USING (sku) GROUP BY p.category", "staging")
def a03_filtered_aggregates(s: Staging) -> DataFrame:
    df = s.order_lines().join(s.products().select("sku", "category"), "sku")
    return df.groupBy("category").agg(dsum("subtotal").alias("gmv"), dsum(F.when(F.col("returned"), F.col("subtotal")).otherwise(0.0)).alias("returned_value"), F.countDistinct(F.when(F.col("returned"), F.col("order_id"))).alias("returned_orders"), F.countDistinct(F.struct("date", "sku")).alias("sku_days"))


@query("SELECT CAST(n AS DOUBLE) / 7 AS mean_orders FROM (SELECT count(*) AS n FROM (SELECT DISTINCT date, order_id FROM order_lines WHERE date > DATE '2001-06-22' AND date <= DATE '2001-06-29'))", "staging")
def a13_mean_of_daily_counts(s: Staging) -> DataFrame:
    week = s.order_lines().where((F.col("date") > "2001-06-22") & (F.col("date") <= "2001-06-29"))
    daily = week.groupBy("date").agg(F.countDistinct("order_id").alias("n"))
    return daily.agg((F.coalesce(F.sum("n"), F.lit(0)).cast("double") / 7).alias("mean_orders"))


@query("""SELECT category, least(1e6::DOUBLE, sum(m * m) / greatest(sum(v - m), 1e-6::DOUBLE)) AS r FROM (
  SELECT category, CAST(CAST(m AS DECIMAL(38,6)) AS DOUBLE) AS m, CAST(CAST(v AS DECIMAL(38,6)) AS DOUBLE) AS v FROM (
    SELECT sku, CAST(sum(units) AS DOUBLE) / count(*) AS m, CAST(sum(units * units) * count(*) - sum(units) * sum(units) AS DOUBLE) / (count(*) * (count(*) - 1)) AS v FROM stock_daily GROUP BY sku HAVING count(*) > 1) JOIN products USING (sku)) GROUP BY category""".replace("sum(m * m)", "CAST(sum(CAST(m * m AS DECIMAL(38,6))) AS DOUBLE)").replace("sum(v - m)", "CAST(sum(CAST(v - m AS DECIMAL(38,6))) AS DOUBLE)"), "staging")  # fmt: skip
def a18_negative_binomial_r(s: Staging) -> DataFrame:
    """Dispersion by the method of moments, within SKUs, for each category."""
    n, t, q = F.count("*"), F.sum("units"), F.sum(F.col("units") * F.col("units"))
    per = s.stock_daily().groupBy("sku").agg(n.alias("n"), (t.cast("double") / n).alias("m"), F.when(n > 1, (q * n - t * t).cast("double") / (n * (n - 1))).alias("v")).where("n > 1")
    per = per.select("sku", *[F.col(c).cast("decimal(38,6)").cast("double").alias(c) for c in ("m", "v")]).join(s.products().select("sku", "category"), "sku")
    return per.groupBy("category").agg(F.least(F.lit(1e6), dsum(F.col("m") * F.col("m")) / F.greatest(dsum(F.col("v") - F.col("m")), F.lit(1e-6))).alias("r"))


@query("SELECT p_type, median(p_retailprice) AS median_price, quantile_cont(p_retailprice, 0.1) AS p10, quantile_cont(p_retailprice, 0.9) AS p90 FROM part GROUP BY p_type")
def a20_exact_quantiles(s: Staging) -> DataFrame:
    return s.raw("part").groupBy("p_type").agg(F.median("p_retailprice").alias("median_price"), F.percentile("p_retailprice", F.lit(0.1)).alias("p10"), F.percentile("p_retailprice", F.lit(0.9)).alias("p90"))


@query("""SELECT campaign_id, CASE WHEN count(*) * sum(a * a) - sum(a) * sum(a) > 0 AND count(*) * sum(b * b) - sum(b) * sum(b) > 0 THEN CAST(count(*) * sum(a * b) - sum(a) * sum(b) AS DOUBLE) / (sqrt(CAST(count(*) * sum(a * a) - sum(a) * sum(a) AS DOUBLE)) * sqrt(CAST(count(*) * sum(b * b) - sum(b) * sum(b) AS DOUBLE))) END AS rho FROM (
  SELECT campaign_id, 2 * rank() OVER x + count(*) OVER (PARTITION BY campaign_id, clicks) - 1 AS a, 2 * rank() OVER y + count(*) OVER (PARTITION BY campaign_id, days) - 1 AS b FROM (SELECT campaign_id, ad_id, CAST(sum(clicks) AS BIGINT) // 100 AS clicks, count(*) AS days FROM ad_daily GROUP BY ALL)
  WINDOW x AS (PARTITION BY campaign_id ORDER BY clicks), y AS (PARTITION BY campaign_id ORDER BY days)) GROUP BY campaign_id""", "staging")  # fmt: skip
def a21_rank_correlation(s: Staging) -> DataFrame:
    """Spearman's rho with average ranks for ties; ranks are doubled, so all sums are of whole numbers."""
    ads = s.ad_daily().groupBy("campaign_id", "ad_id").agg(F.expr("sum(clicks) div 100").alias("clicks"), F.count("*").alias("days"))
    twice = lambda c: 2 * F.rank().over(Window.partitionBy("campaign_id").orderBy(c)).cast("long") + F.count(F.lit(1)).over(Window.partitionBy("campaign_id", c)) - 1
    df = ads.select("campaign_id", twice("clicks").alias("a"), twice("days").alias("b"))
    n, a, b = F.count("*"), F.col("a"), F.col("b")
    spread = lambda x: n * F.sum(x * x) - F.sum(x) * F.sum(x)
    rho = (n * F.sum(a * b) - F.sum(a) * F.sum(b)).cast("double") / (F.sqrt(spread(a).cast("double")) * F.sqrt(spread(b).cast("double")))
    return df.groupBy("campaign_id").agg(spread(a).alias("_a"), spread(b).alias("_b"), F.when((spread(a) > 0) & (spread(b) > 0), rho).alias("rho")).drop("_a", "_b")


_Z = "1.959963984540054::DOUBLE"
_WILSON = f"((k / n) + ({_Z} * {_Z}) / (2.0::DOUBLE * n)) / (1.0::DOUBLE + ({_Z} * {_Z}) / n) {{sign}} {_Z} * sqrt((k / n) * (1.0::DOUBLE - (k / n)) / n + ({_Z} * {_Z}) / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + ({_Z} * {_Z}) / n)"


@query(f"SELECT event_type, n, k, {_WILSON.format(sign='-')} AS low, {_WILSON.format(sign='+')} AS high FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY event_type)")
def a23_wilson(s: Staging) -> DataFrame:
    df = s.events().groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return df.select("event_type", "n", "k", low.alias("low"), high.alias("high"))


# --- windows, sorts, sets ---------------------------------------------------------------------------------------------------


@query("SELECT sku, arg_max(price, effective_from) AS price, max(effective_from) AS effective_from FROM price_history GROUP BY sku", "staging")
def w01_latest_row(s: Staging) -> DataFrame:
    return r.latest_value(s.price_history(), ["sku"], "effective_from", ["price", "effective_from"])


@query("SELECT p_partkey, p_type, CAST(ntile(4) OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS INTEGER) AS band FROM part")
def w05_price_bands(s: Staging) -> DataFrame:
    return s.raw("part").select("p_partkey", "p_type", F.ntile(4).over(Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")).alias("band"))


@query("SELECT sku, price, CAST(sum(CAST(price AS DECIMAL(38,6))) OVER (PARTITION BY category) AS DOUBLE) AS category_price, count(*) OVER (PARTITION BY category) AS category_skus FROM products", "staging")
def w06_partition_aggregates(s: Staging) -> DataFrame:
    w = Window.partitionBy("category")
    return s.products().select("sku", "price", F.sum(F.col("price").cast("decimal(38,6)")).over(w).cast("double").alias("category_price"), F.count("*").over(w).alias("category_skus"))


@query(f"SELECT category, gmv, row_number() OVER (ORDER BY gmv DESC, category) AS rank FROM (SELECT category, {D('subtotal')} AS gmv FROM order_lines JOIN products USING (sku) GROUP BY category ORDER BY gmv DESC, category LIMIT 3)", "staging")
def w07_top_categories(s: Staging) -> DataFrame:
    top = s.order_lines().join(s.products().select("sku", "category"), "sku").groupBy("category").agg(dsum("subtotal").alias("gmv")).orderBy(F.desc("gmv"), "category").limit(3)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gmv"), "category")).cast("long"))


_DEMAND = "WINDOW w AS (PARTITION BY sku ORDER BY date), w7 AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w28 AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"


@query(f""", priced AS (SELECT s.sku, s.date, s.units, h.price FROM stock_daily s LEFT JOIN price_history h ON h.sku = s.sku AND h.effective_from = s.date
), filled AS (SELECT sku, date, units, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY sku ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(price IGNORE NULLS) OVER (PARTITION BY sku ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM priced)
SELECT sku, date, units, lag(units, 1) OVER w AS lag1, lag(units, 7) OVER w AS lag7, lag(units, 14) OVER w AS lag14, CASE WHEN count(*) OVER w7 = 7 THEN CAST(sum(units) OVER w7 AS DOUBLE) / 7 END AS mean7, CASE WHEN count(*) OVER w28 = 28 THEN CAST(sum(units) OVER w28 AS DOUBLE) / 28 END AS mean28,
  price, CASE WHEN count(price) OVER w28 > 0 THEN CAST(sum(CAST(price AS DECIMAL(38,6))) OVER w28 AS DOUBLE) / count(price) OVER w28 END AS price28, CAST(isodow(date) - 1 AS INTEGER) AS weekday FROM filled {_DEMAND}""", "staging")  # fmt: skip
def w08_demand_features(s: Staging) -> DataFrame:
    """Lags and means of the rows before; prices filled forward, then backward at the start, and their mean over up to 28 rows before."""
    w = Window.partitionBy("sku").orderBy("date")
    mean = lambda k: F.when(F.count(F.lit(1)).over(w.rowsBetween(-k, -1)) == k, F.sum("units").over(w.rowsBetween(-k, -1)).cast("double") / k)
    prices = s.price_history().select("sku", F.col("effective_from").alias("date"), F.col("price").alias("_p"))
    df = s.stock_daily().select("sku", "date", "units").join(prices, ["sku", "date"], "left")
    df = df.withColumn("price", F.coalesce(F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    before = w.rowsBetween(-28, -1)
    price28 = F.when(F.count("price").over(before) > 0, F.sum(F.col("price").cast("decimal(38,6)")).over(before).cast("double") / F.count("price").over(before))
    return df.select("sku", "date", "units", *[F.lag("units", k).over(w).alias(f"lag{k}") for k in (1, 7, 14)], mean(7).alias("mean7"), mean(28).alias("mean28"), "price", price28.alias("price28"), F.weekday("date").alias("weekday"))


@query(f"SELECT date, spend, CASE WHEN count(*) OVER w >= 7 THEN CAST(sum(CAST(spend AS DECIMAL(38,6))) OVER w AS DOUBLE) / count(*) OVER w END AS trend FROM (SELECT date, {D('spend')} AS spend FROM ad_daily GROUP BY date) WINDOW w AS (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)", "staging")
def w09_centered_mean(s: Staging) -> DataFrame:
    """Over days of the whole brand: at most a row for each calendar day."""
    w = Window.orderBy("date").rowsBetween(-14, 13)
    days = s.ad_daily().groupBy("date").agg(dsum("spend").alias("spend"))
    n = F.count(F.lit(1)).over(w)
    return days.select("date", "spend", F.when(n >= 7, F.sum(F.col("spend").cast("decimal(38,6)")).over(w).cast("double") / n).alias("trend"))


@query("SELECT campaign_id, date, clicks, CAST(lag(clicks, 7) OVER w + lag(clicks, 14) OVER w + lag(clicks, 21) OVER w + lag(clicks, 28) OVER w AS DOUBLE) / 4 AS baseline FROM (SELECT campaign_id, date, CAST(sum(clicks) AS BIGINT) AS clicks FROM ad_daily GROUP BY ALL) WINDOW w AS (PARTITION BY campaign_id ORDER BY date)", "staging")
def w10_same_weekday(s: Staging) -> DataFrame:
    w = Window.partitionBy("campaign_id").orderBy("date")
    df = s.ad_daily().groupBy("campaign_id", "date").agg(F.sum("clicks").alias("clicks"))
    return df.select("campaign_id", "date", "clicks", (sum((F.lag("clicks", k).over(w) for k in (14, 21, 28)), F.lag("clicks", 7).over(w)).cast("double") / 4).alias("baseline"))


@query("SELECT user_id, event_id, min(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER w = 1 AND count(*) OVER w = 3 AS fired FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def w12_consecutive_fired(s: Staging) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return s.events().select("user_id", "event_id", ((F.min((F.col("value") > 20).cast("int")).over(w) == 1) & (F.count(F.lit(1)).over(w) == 3)).alias("fired"))


@query("""SELECT user_id, up, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, up ORDER BY event_id) AS i FROM (SELECT user_id, event_id, value > 50 AS up FROM events)) GROUP BY user_id, up, i""")  # fmt: skip
def w13_runs(s: Staging) -> DataFrame:
    return r.runs(s.events().select("user_id", "event_id", (F.col("value") > 50).alias("up")), ["user_id"], "event_id", "up")


@query(f"""SELECT category, brand, effect, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER w AS rank, coalesce(sum(abs(effect)) OVER (PARTITION BY category ORDER BY abs(effect) DESC, brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before, sum(abs(effect)) OVER (PARTITION BY category) AS total
  FROM (SELECT category, brand, floor({D("subtotal")}) AS effect FROM order_lines JOIN products USING (sku) GROUP BY ALL) WINDOW w AS (PARTITION BY category ORDER BY abs(effect) DESC, brand)) WHERE before < 0.8::DOUBLE * total AND rank <= 5""", "staging")  # fmt: skip
def o06_smallest_prefix(s: Staging) -> DataFrame:
    sold = s.order_lines().join(s.products().select("sku", "category", "brand"), "sku").groupBy("category", "brand").agg(F.floor(dsum("subtotal")).cast("double").alias("effect"))
    return r.smallest_prefix(sold, ["category"], "brand", "effect")


@query("SELECT order_id, line_item_id, sku, row_number() OVER (PARTITION BY sku ORDER BY date, order_id, line_item_id) <= 10 AS filled FROM order_lines", "staging")
def o09_rationing(s: Staging) -> DataFrame:
    df = s.order_lines().select("order_id", "line_item_id", "sku", "date").withColumn("supply", F.lit(10))
    return r.first_available(df, ["sku"], ["date", "order_id", "line_item_id"], "supply").select("order_id", "line_item_id", "sku", "filled")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1200) DESC NULLS LAST, p_partkey LIMIT 25")
def o02_top_by_distance(s: Staging) -> DataFrame:
    return s.raw("part").orderBy(F.abs(F.col("p_retailprice") - 1200).desc_nulls_last(), "p_partkey").limit(25).select("p_partkey", "p_retailprice")


@query("""SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS moment FROM orders UNION ALL SELECT 'event', event_id, ts FROM events UNION ALL SELECT 'return', l_orderkey, CAST(l_shipdate AS TIMESTAMP) FROM lineitem WHERE l_returnflag = 'R') ORDER BY moment DESC, kind, id LIMIT 100""")
def o10_event_feed(s: Staging) -> DataFrame:
    parts = [s.raw("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment")), s.events().select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment")), s.raw("lineitem").where("l_returnflag = 'R'").select(F.lit("return").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("moment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("moment"), "kind", "id").limit(100)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) INTERSECT SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier EXCEPT SELECT n_nationkey FROM nation")
def u03_set_operations(s: Staging) -> DataFrame:
    buyers = s.raw("customer").select(F.col("c_custkey").alias("id")).join(s.raw("orders").select(F.col("o_custkey").alias("id")), "id", "left_semi")
    both = buyers.intersect(s.events().select(F.col("user_id").alias("id")))
    return both.union(s.raw("supplier").select("s_suppkey")).distinct().subtract(s.raw("nation").select(F.col("n_nationkey").cast("long")))


@query("SELECT coalesce(a.sku, b.sku) AS sku, a.price AS before, b.price AS after, CASE WHEN a.sku IS NULL THEN 'added' WHEN b.sku IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT sku, arg_max(price, effective_from) AS price FROM price_history WHERE effective_from <= DATE '1998-01-01' GROUP BY sku) a FULL JOIN (SELECT sku, arg_max(price, effective_from) AS price FROM price_history GROUP BY sku) b ON a.sku = b.sku WHERE a.price IS DISTINCT FROM b.price OR a.sku IS NULL OR b.sku IS NULL", "staging")
def u04_difference(s: Staging) -> DataFrame:
    prices = s.price_history()
    old = r.latest_value(prices.where(F.col("effective_from") <= "1998-01-01"), ["sku"], "effective_from", ["price"])
    return r.null_safe_diff(old, r.latest_value(prices, ["sku"], "effective_from", ["price"]), ["sku"], "price")


@query(f"SELECT sku, available, mean_units, CASE WHEN mean_units > 0 THEN available / mean_units END AS cover, CASE WHEN NOT mean_units > 0 OR mean_units IS NULL THEN 'UNBOUNDED' WHEN available / mean_units < 3 THEN 'CRITICAL' WHEN available / mean_units < 7 THEN 'LOW' WHEN available / mean_units < 21 THEN 'HEALTHY' WHEN available / mean_units < 45 THEN 'HIGH' ELSE 'EXCESS' END AS band FROM inventory_daily WHERE date <= DATE '{LAST_DAY}' QUALIFY row_number() OVER (PARTITION BY sku ORDER BY date DESC) = 1", "canonical")
def f_inventory_band(s: Staging) -> DataFrame:
    now = canonical.inventory_now(s)
    cover = days_of_cover(F.col("available"), F.col("mean_units"))
    return now.select("sku", "available", "mean_units", cover.alias("cover"), inventory_band(cover).alias("band"))


@query(f"SELECT c.campaign_id, {_sql_ratio('sum(clicks)', 'sum(impressions)')} AS ctr, upper(left(c.platform, 1)) || substr(c.platform, 2) AS platform, regexp_replace(c.product_set, '[^A-Za-z]+', '-', 'g') AS slug FROM ad_daily a JOIN campaigns c USING (campaign_id) GROUP BY ALL", "staging")
def f_strings(s: Staging) -> DataFrame:
    df = s.ad_daily().groupBy("campaign_id").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i")).join(s.campaigns(), "campaign_id")
    return df.select("campaign_id", safe_ratio("c", "i").alias("ctr"), F.concat(F.upper(F.left("platform", F.lit(1))), F.expr("substr(platform, 2)")).alias("platform"), F.regexp_replace("product_set", "[^A-Za-z]+", "-").alias("slug"))


@query("SELECT c_mktsegment, n_nationkey, any_value(n_name) AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def a05_any_value(s: Staging) -> DataFrame:
    """Any value of what the key fixes."""
    df = s.raw("customer").join(s.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("c_mktsegment", "n_nationkey").agg(F.any_value("n_name", True).alias("nation"), F.count("*").alias("n"))


_LEVEL = "SELECT '{0}' AS level, {1} AS id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM ad_daily JOIN adsets USING (ad_id) GROUP BY 2 HAVING sum(impressions) > 0"


@query(" SELECT * FROM (" + " UNION ALL ".join(_LEVEL.format(k, c) for k, c in (("campaign", "campaign_id"), ("adset", "adset_id"), ("ad", "ad_id"))) + ")", "staging")
def s30_level_rollups(s: Staging) -> DataFrame:
    """One report at three levels, by one expansion of each row instead of three scans."""
    rows = s.ad_daily().join(s.adsets(), "ad_id")
    each = F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("id")) for k, c in (("campaign", "campaign_id"), ("adset", "adset_id"), ("ad", "ad_id"))])
    return rows.select(F.inline(each), "impressions", "clicks").groupBy("level", "id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")).where("impressions > 0")


@query(f""", now AS (SELECT sku, available, mean_units, reorder_point FROM inventory_daily WHERE date <= DATE '{LAST_DAY}' QUALIFY row_number() OVER (PARTITION BY sku ORDER BY date DESC) = 1
), spent AS (SELECT campaign_id, {D('spend')} AS spend FROM ad_daily WHERE date > DATE '{LAST_DAY}' - 28 AND date <= DATE '{LAST_DAY}' GROUP BY campaign_id), by_sku AS (SELECT sku, {D('spend * weight')} AS spend FROM campaign_sku JOIN spent USING (campaign_id) GROUP BY sku)
SELECT n.sku, p.title, p.category, n.available, n.reorder_point, coalesce(b.spend, 0.0::DOUBLE) AS spend, greatest(14.0::DOUBLE * n.mean_units - n.available, 0.0::DOUBLE) AS shortfall, CASE WHEN n.available <= 0 THEN 'OUT' WHEN n.available < n.reorder_point THEN 'BELOW_REORDER_POINT' ELSE 'OK' END AS status
FROM now n JOIN products p USING (sku) LEFT JOIN by_sku b ON b.sku = CAST(n.sku AS VARCHAR)""", "canonical")  # fmt: skip
def j25_inventory_page(s: Staging) -> DataFrame:
    """The latest stock of each SKU beside what campaigns spend on it."""
    last = F.lit(LAST).cast("date")
    now = canonical.inventory_now(s)
    spent = s.ad_daily().where((F.col("date") > F.date_sub(last, 28)) & (F.col("date") <= last)).groupBy("campaign_id").agg(dsum("spend").alias("spend"))
    by_sku = canonical.campaign_sku(s, canonical.order_items(s)).join(spent, "campaign_id").groupBy(F.col("sku").try_cast("long").alias("sku")).agg(dsum(F.col("spend") * F.col("weight")).alias("spend"))
    df = now.join(s.products().select("sku", "title", "category"), "sku").join(by_sku, "sku", "left")
    a, p = F.col("available"), F.col("reorder_point")
    return df.select("sku", "title", "category", "available", "reorder_point", F.coalesce("spend", F.lit(0.0)).alias("spend"), projected_shortfall(F.lit(14.0) * F.col("mean_units"), a).alias("shortfall"), F.when(a <= 0, "OUT").when(a < p, "BELOW_REORDER_POINT").otherwise("OK").alias("status"))


@query("SELECT campaign_id, name, CASE WHEN contains(split_part(name, ' | ', 1), ' ') THEN list_last(string_split(split_part(name, ' | ', 1), ' ')) END AS stage, CASE WHEN contains(lower(name), 'econ') THEN 'value' WHEN regexp_matches(name, '\\bSMALL\\b') THEN 'size' ELSE 'other' END AS theme, list_last(string_split(replace(name, ' | ', '|'), '|')) AS tail FROM (SELECT campaign_id, 'META ' || name AS name FROM campaigns)", "staging")
def f_names(s: Staging) -> DataFrame:
    """Stage, theme and product set out of a campaign's name: last word, keywords, whole words, parts."""
    df = s.campaigns().select("campaign_id", F.concat(F.lit("META "), "name").alias("name"))
    theme = F.when(F.lower("name").contains("econ"), "value").when(F.col("name").rlike(r"\bSMALL\b"), "size").otherwise("other")
    return df.select("campaign_id", "name", stage_of(F.col("name")).alias("stage"), theme.alias("theme"), F.element_at(F.split("name", r"\s*\|\s*"), -1).alias("tail"))


@query(f", sold AS (SELECT sku, {D('net_revenue')} AS net_revenue, CAST(sum(qty) AS BIGINT) AS units FROM order_items GROUP BY sku) SELECT sku, net_revenue / units AS nrpu, net_revenue / units * (1.0::DOUBLE - fee_pct) - cogs - ship_cost AS unit_contribution, CASE WHEN net_revenue > 0 THEN 10000.0::DOUBLE / (net_revenue / units) END AS units_for_10000 FROM sold JOIN products USING (sku)", "canonical")
def f_unit_economics(s: Staging) -> DataFrame:
    sold = canonical.order_items(s).groupBy("sku").agg(dsum("net_revenue").alias("net_revenue"), F.sum("qty").alias("units")).join(s.products(), "sku")
    n = F.col("net_revenue") / F.col("units")
    return sold.select("sku", n.alias("nrpu"), unit_contribution(n, F.col("cogs"), F.col("ship_cost"), F.col("fee_pct")).alias("unit_contribution"), F.when(F.col("net_revenue") > 0, units_from_net_revenue(F.lit(10000.0), n)).alias("units_for_10000"))


@query("SELECT n_nationkey, CASE WHEN x = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(CAST(x AS DECIMAL(20,4)) AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') END AS amount, sha256('amount=' || CASE WHEN x = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(CAST(x AS DECIMAL(20,4)) AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') END) AS hash FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) * 12.5::DOUBLE AS x FROM nation)")
def f_canonical_hash(s: Staging) -> DataFrame:
    """Numbers as text that hashes alike wherever it is made: four places, no trailing zeros."""
    text = canonical_number(F.col("n_nationkey").cast("double") * 12.5)
    return s.raw("nation").select("n_nationkey", text.alias("amount"), F.sha2(F.concat(F.lit("amount="), text), 256).alias("hash"))
