"""Queries behind pages, source reports and the guarded SQL entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import dsum, safe_ratio
from millrace.operators import relational as r
from millrace.plans import canonical, marts
from millrace.plans.guard import guarded_sql
from millrace.plans.registry import query
from millrace.sources import ingest
from millrace.sources.testdata import LAST_DAY, Staging, dsum_sql

D = dsum_sql


@query(f"SELECT c.platform, {D('platform_revenue')} AS claimed, {D('spend')} AS spend, CASE WHEN abs({D('spend')}) >= 1e-9 THEN 1.0::DOUBLE * {D('platform_revenue')} / {D('spend')} END AS platform_roas FROM ad_daily JOIN campaigns c USING (campaign_id) WHERE date > DATE '{LAST_DAY}' - 28 AND date <= DATE '{LAST_DAY}' GROUP BY c.platform", "staging")
def v_reconciliation_28d(s: Staging) -> DataFrame:
    last = F.lit(LAST_DAY).cast("date")
    df = s.ad_daily().where((F.col("date") > F.date_sub(last, 28)) & (F.col("date") <= last)).join(s.campaigns().select("campaign_id", "platform"), "campaign_id")
    return df.groupBy("platform").agg(dsum("platform_revenue").alias("claimed"), dsum("spend").alias("spend")).withColumn("platform_roas", safe_ratio("claimed", "spend"))


@query(f""", now AS (SELECT sku, available, mean_units, reorder_point FROM inventory_daily WHERE date <= DATE '{LAST_DAY}' QUALIFY row_number() OVER (PARTITION BY sku ORDER BY date DESC) = 1), w AS (SELECT TRY_CAST(sku AS BIGINT) AS sku, sum(weight) AS weight FROM campaign_sku GROUP BY 1)
SELECT n.sku, p.title, p.category, n.available, CASE WHEN n.available < 0.5::DOUBLE * n.reorder_point THEN 'RESTOCK' WHEN n.available < n.reorder_point AND w.weight > 0.01 THEN 'HOLD_SPEND' WHEN n.available < n.reorder_point THEN 'EXPEDITE' WHEN n.mean_units > 0 AND n.available / n.mean_units > 45 THEN 'CLEAR_EXCESS' WHEN w.weight > 0.02 THEN 'SCALE_DEMAND' ELSE 'CONTINUE' END AS action
FROM now n JOIN products p USING (sku) LEFT JOIN w USING (sku)""", "canonical")  # fmt: skip
def v_inventory_actions(s: Staging) -> DataFrame:
    """The first rule that fits names the action of a SKU."""
    now = canonical.inventory_now(s)
    w = canonical.campaign_sku(s, canonical.order_items(s)).groupBy(F.col("sku").try_cast("long").alias("sku")).agg(F.sum("weight").alias("weight"))
    df = now.join(s.products().select("sku", "title", "category"), "sku").join(w, "sku", "left")
    a, p = F.col("available"), F.col("reorder_point")
    action = F.when(a < 0.5 * p, "RESTOCK").when((a < p) & (F.col("weight") > 0.01), "HOLD_SPEND").when(a < p, "EXPEDITE").when((F.col("mean_units") > 0) & (a / F.when(F.col("mean_units") > 0, F.col("mean_units")) > 45), "CLEAR_EXCESS").when(F.col("weight") > 0.02, "SCALE_DEMAND").otherwise("CONTINUE")
    return df.select("sku", "title", "category", "available", action.alias("action"))


@query(f", t AS (SELECT campaign_id, count(*) - 1 AS skus, {D('revenue')} AS total, {D(f"CASE WHEN sku = '{canonical.UNMAPPED}' THEN revenue ELSE 0.0::DOUBLE END")} AS unmapped, max(CASE WHEN sku = '{canonical.UNMAPPED}' THEN weight END) AS unmapped_weight FROM campaign_sku GROUP BY campaign_id) SELECT campaign_id, skus, CASE WHEN abs(total) >= 1e-9 THEN 1.0::DOUBLE - unmapped / total END AS coverage, unmapped_weight, unmapped_weight > 0.2 AS flagged FROM t", "canonical")
def v_mapping_coverage(s: Staging) -> DataFrame:
    """How much of each campaign's revenue falls on its own SKUs; flagged where a fifth of the weight does not."""
    outside = F.col("sku") == canonical.UNMAPPED
    t = canonical.campaign_sku(s, canonical.order_items(s)).groupBy("campaign_id").agg((F.count("*") - 1).alias("skus"), dsum("revenue").alias("total"), dsum(F.when(outside, F.col("revenue")).otherwise(0.0)).alias("unmapped"), F.max(F.when(outside, F.col("weight"))).alias("unmapped_weight"))
    return t.select("campaign_id", "skus", F.when(F.abs("total") >= 1e-9, F.lit(1.0) - F.col("unmapped") / F.col("total")).alias("coverage"), "unmapped_weight", (F.col("unmapped_weight") > 0.2).alias("flagged"))


@query(marts.BRAND_SQL + f"SELECT date, net_revenue, (lag(net_revenue, 7) OVER w + lag(net_revenue, 14) OVER w + lag(net_revenue, 21) OVER w + lag(net_revenue, 28) OVER w) / 4 AS baseline FROM brand_daily WINDOW w AS (ORDER BY date) QUALIFY date > DATE '{LAST_DAY}' - 28", "canonical")
def v_evidence_chart(s: Staging) -> DataFrame:
    """28 days beside their same-weekday baseline. Over a row for each calendar day."""
    from pyspark.sql import Window

    last = F.lit(LAST_DAY).cast("date")
    w = Window.orderBy("date")
    near = marts.brand_daily(s).select("date", "net_revenue")
    baseline = sum((F.lag("net_revenue", k).over(w) for k in (14, 21, 28)), F.lag("net_revenue", 7).over(w)) / 4
    return near.withColumn("baseline", baseline).where(F.col("date") > F.date_sub(last, 28))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL HAVING count(*) > 0 ORDER BY day, event_type LIMIT 50 OFFSET 20")
def s29_dynamic_report(s: Staging) -> DataFrame:
    return report(s.events().withColumn("day", F.to_date("ts")), ["event_type", "day"], {"n": "count(*)", "users": "count(distinct user_id)"}, ["day", "event_type"], 50, 20)


def report(df: DataFrame, dimensions: list[str], measures: dict[str, str], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a report with chosen dimensions and measures, in a total order."""
    return df.groupBy(*dimensions).agg(*[F.expr(e).alias(n) for n, e in measures.items()]).orderBy(*order).offset(offset).limit(limit)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100")
def s30_keyset_page(s: Staging) -> DataFrame:
    return s.raw("orders").where("o_orderkey > 5000").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n_rows, 1.0::DOUBLE * count(*) FILTER (WHERE o.o_orderkey IS NULL) / count(*) AS orphan_rate, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last, CAST(max(CAST(l_shipdate AS DATE)) - min(CAST(l_shipdate AS DATE)) AS INTEGER) AS days, 1.0::DOUBLE * count(*) FILTER (WHERE l_linenumber > 1) / count(*) AS link_rate FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o.o_orderkey")
def s27_profiling_gate(s: Staging) -> DataFrame:
    return ingest.profile(s.raw("lineitem"), "l_orderkey", s.raw("orders").where("o_orderstatus <> 'P'"), "o_orderkey", "l_shipdate", "l_linenumber > 1")


@query("""SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey)) AS l_partkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL""")
def s20_upsert(s: Staging) -> DataFrame:
    """Later versions of a key replace earlier ones."""
    rows = s.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").withColumn("version", F.struct("l_shipdate", "l_partkey"))
    old, new = rows.where("l_shipdate < '1998-01-01'"), rows.where("l_shipdate >= '1998-01-01'")
    return r.upsert(old, new, ["l_orderkey", "l_linenumber"], "version").drop("version")


@query("""SELECT o_orderkey AS order_id, CAST(l.k AS BIGINT) AS line_item_id, CAST(o_orderdate AS DATE) AS date, 'S' || l.k AS sku, CAST(2 AS INTEGER) AS qty, floor(o_totalprice) * 2 - 1.5::DOUBLE AS subtotal, CASE WHEN o_orderstatus = 'O' THEN 'google ads' END AS utm_source FROM orders, (VALUES (1), (2)) l(k)""")
def s12_normalise_orders(s: Staging) -> DataFrame:
    """Orders written as native payloads and normalised again."""
    o = s.raw("orders")
    line = lambda k: F.struct(F.lit(k).cast("long").alias("id"), F.lit(f"S{k}").alias("sku"), F.lit(2).alias("quantity"), F.floor("o_totalprice").cast("string").alias("price"), F.lit("1.5").alias("total_discount"))
    site = F.when(F.col("o_orderstatus") == "O", "/shop?utm_source=google%20ads&x=1").otherwise("/shop")
    payload = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("created_at"), site.alias("landing_site"), F.lit(False).alias("taxes_included"), F.array(line(1), line(2)).alias("line_items")))
    return ingest.normalise_orders(o.select(payload.alias("payload"))).select("order_id", "line_item_id", "date", "sku", "qty", "subtotal", "utm_source")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS budget_id, CASE WHEN l_linenumber > 6 THEN 'clicks: more than impressions' ELSE '' END || CASE WHEN n > 1 THEN CASE WHEN l_linenumber > 6 THEN ';' ELSE '' END || 'duplicate key' ELSE '' END AS errors FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, CAST(l_shipdate AS DATE)) AS n FROM lineitem)""")
def s24_data_contract(s: Staging) -> DataFrame:
    up = s.raw("lineitem").select(F.to_date("l_shipdate").cast("string").alias("date"), F.col("l_orderkey").cast("string").alias("budget_id"), F.lit("meta").alias("platform"), F.col("l_extendedprice").cast("string").alias("spend"), F.lit("6").alias("impressions"), F.col("l_linenumber").cast("string").alias("clicks"))
    return ingest.contract_errors(up, "ads").select("budget_id", F.array_join("errors", ";").alias("errors"))


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus")
def v_guarded_sql(s: Staging) -> DataFrame:
    return guarded_sql(s.spark, "/* by status */ SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus -- end", {"orders": s.raw("orders")})[0]
