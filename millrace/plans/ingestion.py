"""Sources as queries: native payloads written from the test tables and normalised again, sync windows, uploads, and the joins of what was ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import dsum
from millrace.operators import relational as r
from millrace.plans import canonical, marts
from millrace.plans.registry import query
from millrace.sources import ingest
from millrace.sources.scratch import scratch_path
from millrace.sources.testdata import AS_OF, LAST_DAY, Staging, dsum_sql

D = dsum_sql


def _text(c: str, name: str | None = None):
    return F.col(c).cast("string").alias(name or c)


@query("SELECT date, campaign_id, ad_id, impressions, clicks, CAST(floor(spend * 1e6) AS BIGINT)::DOUBLE / 1e6::DOUBLE AS cost, CASE WHEN clicks > 20 THEN CAST(clicks AS DOUBLE) ELSE 0.0::DOUBLE END AS conversions FROM ad_daily", "staging")
def s11_normalise_google_ads(s: Staging) -> DataFrame:
    metrics = F.struct(_text("impressions"), _text("clicks"), F.floor(F.col("spend") * 1e6).cast("string").alias("cost_micros"), F.when(F.col("clicks") > 20, F.col("clicks").cast("double")).alias("conversions"))
    payload = F.struct(_text("date"), F.struct(F.lit("1").alias("id")).alias("customer"), F.struct(F.col("campaign_id").alias("id")).alias("campaign"), F.struct(F.col("ad_id").alias("id")).alias("ad"), metrics.alias("metrics"))
    return ingest.normalise_google_ads(s.ad_daily().select(F.to_json(payload).alias("payload")))


@query("SELECT order_id, line_item_id, refund_date AS date, 1 + line_item_id % 2 AS qty, floor(amount) AS amount FROM refund_lines", "staging")
def s14_normalise_refunds(s: Staging) -> DataFrame:
    """A payload for each refund of an order on a day, with its lines in an array."""
    line = F.struct(F.col("line_item_id").cast("long").alias("line_item_id"), (1 + F.col("line_item_id") % 2).cast("int").alias("quantity"), F.floor("amount").cast("string").alias("subtotal"))
    each = s.refund_lines().groupBy("order_id", "refund_date").agg(F.collect_list(line).alias("refund_line_items"))
    payload = F.struct("order_id", F.concat(F.date_format("refund_date", "yyyy-MM-dd"), F.lit("T00:00:00+05:30")).alias("created_at"), "refund_line_items")
    return ingest.normalise_refunds(each.select(F.to_json(payload).alias("payload")))


@query("SELECT date, ad_id, impressions, clicks, floor(spend) * 83.0::DOUBLE AS spend, 'USD' AS currency FROM ad_daily JOIN campaigns USING (campaign_id) WHERE platform = 'tiktok'", "staging")
def s17_normalise_tiktok(s: Staging) -> DataFrame:
    ads = s.ad_daily().join(s.campaigns().where("platform = 'tiktok'").select("campaign_id"), "campaign_id")
    metrics = F.struct(F.floor("spend").cast("string").alias("spend"), _text("impressions"), _text("clicks"), F.lit("0").alias("conversion"))
    payload = F.struct(F.struct(F.concat("date", F.lit(" 00:00:00")).alias("stat_time_day"), "ad_id").alias("dimensions"), metrics.alias("metrics"), F.lit("USD").alias("currency"))
    return ingest.normalise_tiktok(ads.select(F.to_json(payload).alias("payload")))


@query("SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS date, 'S' || l_partkey AS sku, CAST(l_quantity AS INTEGER) AS qty, floor(l_extendedprice) AS amount, floor(l_extendedprice) / CAST(l_quantity AS INTEGER) AS unit_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW'")
def s17_normalise_marketplace(s: Staging) -> DataFrame:
    o = s.raw("orders").where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_orderdate")
    item = F.struct(F.concat(F.lit("S"), "l_partkey").alias("SellerSKU"), F.col("l_quantity").cast("int").alias("QuantityOrdered"), F.struct(F.floor("l_extendedprice").cast("string").alias("Amount")).alias("ItemPrice"))
    each = s.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.collect_list(item).alias("OrderItems"))  # the lines of one order
    payload = F.struct(F.concat(F.lit("A-1-"), "o_orderkey").alias("AmazonOrderId"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("PurchaseDate"), "OrderItems")
    return ingest.normalise_marketplace(each.select(F.to_json(payload).alias("payload")))


@query("SELECT a.date, a.ad_id, s.adset_id FROM ad_daily a LEFT JOIN (SELECT * FROM adsets WHERE ad_id NOT LIKE '%-7') s USING (ad_id)", "staging")
def s18_ingest_lookup(s: Staging) -> DataFrame:
    return ingest.looked_up(s.ad_daily().select("date", "ad_id"), s.adsets().where("ad_id not like '%-7'"), "ad_id", "adset_id").select("date", "ad_id", "adset_id")


@query(f"SELECT campaign_id AS source, coalesce(last_synced - 2, DATE '{LAST_DAY}' - 365) AS since, DATE '{LAST_DAY}' - 1 AS until FROM (SELECT campaign_id, CASE WHEN campaign_id <> 'Brand#1' THEN max(date) END AS last_synced FROM ad_daily WHERE date < DATE '{LAST_DAY}' GROUP BY campaign_id)", "staging")
def s21_sync_window(s: Staging) -> DataFrame:
    """A source that was never pulled takes a year; others the days that may still change."""
    seen = s.ad_daily().where(F.col("date") < LAST_DAY).groupBy(F.col("campaign_id").alias("source")).agg(F.max("date").alias("d"))
    return ingest.due_window(seen.select("source", F.when(F.col("source") != "Brand#1", F.col("d")).alias("last_synced")), LAST_DAY)


_HALVES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {k}, 12) AS BIGINT)) AS VARCHAR)" for k in (1, 13))


@query(f"SELECT concat_ws('-', {_HALVES}, CAST(count(*) AS VARCHAR)) AS upload_id, count(*) AS n_rows FROM (SELECT md5('=' || o_custkey || '|=' || o_orderkey || '|=' || o_orderstatus) AS h FROM orders)")
def s06_content_hash(s: Staging) -> DataFrame:
    """The id of an upload: the same rows in any order have the same one."""
    return ingest.upload_id(s.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query("SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM customer) > 20 AS truncated FROM customer ORDER BY c_custkey LIMIT 20")
def s25_preview(s: Staging) -> DataFrame:
    return ingest.preview(s.raw("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), 20, ["c_acctbal"], "c_custkey")


@query(marts.BRAND_SQL + f"SELECT count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders, {D('net_revenue')} AS net_revenue FROM brand_daily WHERE date >= DATE '2000-01-01'", "canonical")
def s31_marts_export(s: Staging) -> DataFrame:
    """A mart is published under a run, and ad-hoc SQL reads the published files alone."""
    from millrace.plans.serving import guarded_sql

    root = scratch_path(s.spark, "books")
    ingest.publish({"brand_daily": marts.brand_daily(s)}, root, "run-1")
    text = "SELECT count(*) AS days, sum(orders) AS orders, CAST(sum(CAST(net_revenue AS DECIMAL(38,6))) AS DOUBLE) AS net_revenue FROM brand_daily WHERE date >= '2000-01-01'"
    return guarded_sql(s.spark, text, {"brand_daily": ingest.published(s.spark, root, "brand_daily")})[0]


@query("SELECT c_custkey, CASE WHEN k IS NOT NULL THEN 'LEFT' ELSE c_mktsegment END AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) x ON c.c_custkey = x.k WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s33_update_and_delete(s: Staging) -> DataFrame:
    """A keyed update of one column, then a delete by key."""
    c = s.raw("customer").select("c_custkey", "c_mktsegment")
    left = s.raw("customer").where("c_acctbal < 0").select("c_custkey", F.lit("LEFT").alias("c_mktsegment"))
    return r.delete_keyed(r.update_keyed(c, left, ["c_custkey"]), s.raw("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# --- joins of what was ingested ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_type, CASE WHEN p_retailprice > 1500 THEN 0 WHEN p_size > 25 THEN 1 ELSE 2 END AS action_rank FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') ORDER BY action_rank, p_retailprice DESC, p_partkey LIMIT 40")
def p14_filter_search_sort(s: Staging) -> DataFrame:
    """A page of the SKUs whose text holds a word, most urgent and dearest first."""
    rank = F.when(F.col("p_retailprice") > 1500, 0).when(F.col("p_size") > 25, 1).otherwise(2)
    found = s.raw("part").where(F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("ring")).withColumn("action_rank", rank)
    return found.orderBy("action_rank", F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "p_name", "p_type", "action_rank")


@query(f""", refunds AS (SELECT order_id, line_item_id, refund_date AS d FROM refund_lines UNION ALL SELECT order_id, line_item_id, ship_date + 7 FROM order_lines WHERE utm_source IS NULL AND qty > 40 AND NOT returned)
SELECT r.d - l.date AS lag_days, count(*) AS n FROM order_lines l JOIN refunds r USING (order_id, line_item_id) WHERE r.d <= DATE '{LAST_DAY}' GROUP BY 1""", "staging")  # fmt: skip
def j04_refund_lags(s: Staging) -> DataFrame:
    """Lags of the shop's and the marketplace's refunds together."""
    lines = s.order_lines()
    shop = s.refund_lines().select("order_id", "line_item_id", F.col("refund_date").alias("d"))
    market = lines.where("utm_source is null and qty > 40 and not returned").select("order_id", "line_item_id", F.date_add("ship_date", 7).alias("d"))
    both = lines.select("order_id", "line_item_id", "date").join(shop.unionByName(market), ["order_id", "line_item_id"]).where(F.col("d") <= LAST_DAY)
    return both.groupBy(F.datediff("d", "date").cast("long").alias("lag_days")).agg(F.count("*").alias("n"))


@query(f""", receipts AS (SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS receipts, max(CAST(l_shipdate AS DATE)) + INTERVAL 36 HOUR AS available_at FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL
), sold AS (SELECT sku, date, CAST(sum(qty) AS BIGINT) AS sold FROM order_lines WHERE available_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL)
SELECT i.sku, i.date, i.on_hand, coalesce(r.receipts, 0) AS receipts, coalesce(o.sold, 0) AS sold FROM stock_daily i LEFT JOIN receipts r ON r.sku = i.sku AND r.date = i.date AND r.available_at <= TIMESTAMP '{AS_OF}' LEFT JOIN sold o ON o.sku = i.sku AND o.date = i.date""", "staging")  # fmt: skip
def j09_stock_receipts_sales(s: Staging) -> DataFrame:
    """Receipts count only where they were known at the moment: the right side is filtered before the join."""
    day = F.to_date("l_shipdate")
    receipts = s.raw("lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("sku"), day.alias("date")).agg(F.sum(F.col("l_quantity").cast("long")).alias("receipts")).withColumn("available_at", F.col("date").cast("timestamp_ntz") + F.expr("interval 36 hours"))
    sold = r.as_of(s.order_lines(), AS_OF).groupBy("sku", "date").agg(F.sum("qty").alias("sold"))
    df = s.stock_daily().join(r.as_of(receipts, AS_OF).drop("available_at"), ["sku", "date"], "left").join(sold, ["sku", "date"], "left")
    return df.select("sku", "date", "on_hand", F.coalesce("receipts", F.lit(0)).alias("receipts"), F.coalesce("sold", F.lit(0)).alias("sold"))


@query("SELECT c.campaign_id, count(*) AS skus, min(k.sku) AS first_sku FROM campaigns c JOIN products k ON k.category = c.product_set AND k.promoted GROUP BY c.campaign_id", "staging")
def j10_campaign_skus(s: Staging) -> DataFrame:
    """Campaigns meet the promoted SKUs of their category; SKUs of a category count once for each of its campaigns, so they are counted before the join."""
    k = s.products().where("promoted").groupBy(F.col("category").alias("product_set")).agg(F.count("*").alias("skus"), F.min("sku").alias("first_sku"))
    return s.campaigns().select("campaign_id", "product_set").join(k, "product_set").select("campaign_id", "skus", "first_sku")


@query("""SELECT c.c_mktsegment AS channel, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(coalesce(purchases, 0)) AS BIGINT) AS purchases, count(*) AS cells FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL)
  LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY ALL) USING (user_id, day) JOIN customer c ON c_custkey = user_id GROUP BY c.c_mktsegment""")  # fmt: skip
def j21_click_purchase_cells(s: Staging) -> DataFrame:
    of = lambda kind, name: s.events().where(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias(name))
    cells = of("click", "clicks").join(of("purchase", "purchases"), ["user_id", "day"], "left").join(s.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("channel")), "user_id")
    return cells.groupBy("channel").agg(F.sum("clicks").alias("clicks"), F.sum(F.coalesce("purchases", F.lit(0))).alias("purchases"), F.count("*").alias("cells"))


@query(marts.BRAND_SQL + f", forecast AS (SELECT date + 7 AS date, orders AS expected FROM brand_daily) SELECT date, orders, expected, abs(orders - expected) AS error FROM brand_daily JOIN forecast USING (date) WHERE date > DATE '{LAST_DAY}' - 28", "canonical")
def j23_forecast_and_actual(s: Staging) -> DataFrame:
    days = marts.brand_daily(s).select("date", "orders")
    forecast = days.select(F.date_add("date", 7).alias("date"), F.col("orders").alias("expected"))
    return days.where(F.col("date") > F.date_sub(F.lit(LAST_DAY).cast("date"), 28)).join(forecast, "date").select("date", "orders", "expected", F.abs(F.col("orders") - F.col("expected")).alias("error"))


_DECISIONS = f""", months AS (SELECT campaign_id, CAST(date_trunc('month', date) AS DATE) AS month, {D('spend')} AS spend, {D('platform_revenue')} AS revenue FROM ad_daily GROUP BY ALL
), decisions AS (SELECT campaign_id || '@' || CAST(snapshot_date AS VARCHAR) AS decision_id, campaign_id, snapshot_date, budget, lag(budget) OVER (PARTITION BY campaign_id ORDER BY snapshot_date) AS before FROM budget_snapshots
), outcomes AS (SELECT campaign_id || '@' || CAST(CAST(month - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS decision_id, spend, revenue FROM months)
"""


def decisions(s: Staging) -> DataFrame:
    """decision_id, campaign_id, snapshot_date, budget and before of each monthly budget."""
    from pyspark.sql import Window

    before = F.lag("budget").over(Window.partitionBy("campaign_id").orderBy("snapshot_date"))
    return s.budget_snapshots().select(F.concat_ws("@", "campaign_id", F.col("snapshot_date").cast("string")).alias("decision_id"), "campaign_id", "snapshot_date", "budget", before.alias("before"))


def outcomes(s: Staging) -> DataFrame:
    """decision_id, spend and revenue of the month after each decision."""
    months = s.ad_daily().groupBy("campaign_id", F.trunc("date", "month").alias("month")).agg(dsum("spend").alias("spend"), dsum("platform_revenue").alias("revenue"))
    return months.select(F.concat_ws("@", "campaign_id", F.add_months("month", -1).cast("string")).alias("decision_id"), "spend", "revenue")


@query(_DECISIONS + "SELECT decision_id, campaign_id, budget, before, spend, revenue FROM outcomes JOIN decisions USING (decision_id)", "staging")
def j24_outcomes_of_decisions(s: Staging) -> DataFrame:
    return outcomes(s).join(decisions(s), "decision_id").select("decision_id", "campaign_id", "budget", "before", "spend", "revenue")


@query(""", lost AS (SELECT sku, date, qty FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date, order_id, line_item_id) AS n FROM order_lines) WHERE n > 10)
SELECT k.category, l.date, CAST(sum(l.qty) AS BIGINT) AS lost FROM lost l JOIN (SELECT DISTINCT sku, category FROM products) k USING (sku) GROUP BY ALL""", "staging")
def j29_lost_demand(s: Staging) -> DataFrame:
    """Units of the orders that a SKU's supply did not reach, by category and day."""
    tried = r.first_available(s.order_lines().select("order_id", "line_item_id", "sku", "date", "qty").withColumn("supply", F.lit(10)), ["sku"], ["date", "order_id", "line_item_id"], "supply")
    return tried.where("not filled").join(s.products().select("sku", "category").distinct(), "sku").groupBy("category", "date").agg(F.sum("qty").alias("lost"))


@query("SELECT campaign_id, sku, weight, allocation_weight, revenue, sum(weight) OVER (PARTITION BY campaign_id) BETWEEN 0.999999 AND 1.000001 AS whole FROM campaign_sku", "canonical")
def a11_smoothed_shares(s: Staging) -> DataFrame:
    from pyspark.sql import Window

    return canonical.campaign_sku(s, canonical.order_items(s)).withColumn("whole", F.sum("weight").over(Window.partitionBy("campaign_id")).between(0.999999, 1.000001))
