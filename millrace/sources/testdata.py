"""Staging tables of the engine, made from the star-schema test tables. Every adapter has a twin in STAGING, the SQL prelude of the oracle texts.

Tables that several queries read are held: computed once for a session and folder, written to the shared folder, and read back, so filters and columns reach their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import dsum
from millrace.operators.relational import history, latest_per_key
from millrace.sources.scratch import is_whole, listed, scratch_path

#: Priority -> (source, medium).
UTM = {"1-URGENT": ("google", "cpc"), "2-HIGH": ("facebook", "paid"), "3-MEDIUM": ("newsletter", "email"), "4-NOT SPECIFIED": ("google", "organic")}
AS_OF = "2001-06-30 00:00:00"
LAST_DAY = "2001-06-29"
#: Rows of a SKU over which its demand is told.
STOCK_ROWS = 28
PLATFORMS = ("meta", "google", "tiktok", "amazon")

#: Where held tables lie: (application, folder of the inputs, name) -> path.
_AT: dict[tuple[str, str, str], str] = {}
#: What the folder of the inputs looked like when they were made.
_SEEN: dict[tuple[str, str, str], tuple] = {}


class Staging:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def held(self, name: str, build: Callable[[], DataFrame], *order: str) -> DataFrame:
        """build(), written once for the inputs as they are; with an order, in ranges of it, so that a filter on it skips files."""
        key, df = (self.spark.sparkContext.applicationId, self.sf_dir, name), build()
        seen = listed(self.spark, self.sf_dir)
        if key not in _AT or _SEEN[key] != seen or not is_whole(self.spark, _AT[key]):
            path = scratch_path(self.spark, name)
            (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.parquet(path)
            _AT[key], _SEEN[key] = path, seen
        return self.spark.read.schema(df.schema).parquet(_AT[key])

    def order_lines(self) -> DataFrame:
        return self.held("order-lines", self._order_lines)

    def ad_daily(self) -> DataFrame:
        return self.held("ad-daily", self._ad_daily)

    def stock_daily(self) -> DataFrame:
        return self.stock_moments().select("sku", "date", "on_hand", "reserved", "units")

    def stock_moments(self) -> DataFrame:
        """stock_daily with sums over the last STOCK_ROWS rows of the SKU (_s of units, _q of their squares, _n rows) and the date of its next row."""
        return self.held("stock-daily", self._stock_daily)

    def _order_lines(self) -> DataFrame:
        """One row for each (order_id, line_item_id); of several versions the last shipped.

        Lines are laid out by order once and sorted once: the choice of versions and the join with orders both stand on that.
        """
        items = self.raw("lineitem").where("l_orderkey is not null").join(self.raw("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        items = items.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", (F.col("l_returnflag") == "R").alias("returned"), "p_brand")
        one = latest_per_key(items.repartition("l_orderkey"), ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"])
        orders = self.raw("orders").where("o_orderkey is not null").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        one = one.join(latest_per_key(orders, ["o_orderkey"], ["o_custkey", "o_orderdate", "o_orderpriority"]), F.col("l_orderkey") == F.col("o_orderkey"))
        priority = F.col("o_orderpriority")
        utm = F.create_map(*[F.lit(x) for k, (s, _) in UTM.items() for x in (k, s)]), F.create_map(*[F.lit(x) for k, (_, m) in UTM.items() for x in (k, m)])
        return one.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_item_id"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("customer_id"),
            F.when(priority != "5-LOW", priority == "1-URGENT").alias("is_new_customer"), F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("int").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("subtotal"),
            utm[0][priority].alias("utm_source"), utm[1][priority].alias("utm_medium"), F.when(priority.isin("1-URGENT", "2-HIGH"), F.col("p_brand")).alias("utm_campaign"),
            "returned", F.to_date("l_shipdate").alias("ship_date"), (F.to_date("o_orderdate").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("available_at"),
        )

    def refund_lines(self) -> DataFrame:
        """Refunds of returned lines, dated by shipping."""
        return self.order_lines().where("returned").select("order_id", "line_item_id", "sku", F.col("ship_date").alias("refund_date"), F.col("subtotal").alias("amount"), F.datediff("ship_date", "date").alias("lag_days"))

    def products(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * 0.4).alias("cogs"), (F.col("p_size") * 0.5).alias("ship_cost"), F.lit(0.02).alias("fee_pct"), (F.col("p_size") <= 40).alias("promoted"))

    def campaigns(self) -> DataFrame:
        brands = self.raw("part").groupBy(F.col("p_brand").alias("campaign_id")).agg(F.min("p_type").alias("product_set"))
        return brands.select("campaign_id", self.platform_of("campaign_id").alias("platform"), F.concat(F.lit("Prospecting | "), "product_set").alias("name"), "product_set")

    @staticmethod
    def platform_of(campaign_id: str) -> Column:
        """A campaign's platform stands in its id, so rows that bear the id need no join for it."""
        return F.get(F.array(*map(F.lit, PLATFORMS)), F.right(campaign_id, F.lit(1)).cast("int") % 4)

    def _ad_daily(self) -> DataFrame:
        items = self.raw("lineitem").join(self.raw("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        day = items.groupBy(F.to_date("l_shipdate").alias("date"), F.concat_ws("-", "p_brand", F.col("l_linenumber").cast("string")).alias("ad_id"), F.col("p_brand").alias("campaign_id"))
        qty = F.sum(F.col("l_quantity").cast("long"))
        return day.agg((qty * 40).alias("impressions"), qty.alias("clicks"), dsum(F.col("l_tax") * F.col("l_extendedprice") * 0.1).alias("spend"), dsum("l_extendedprice").alias("platform_revenue"))

    def _stock_daily(self) -> DataFrame:
        """Lines are laid out by SKU once; sums of days, the sums over rows and the next row all stand on that, and all are whole numbers."""
        items = self.raw("lineitem").select(F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("q")).repartition("sku")
        days = items.groupBy("sku", "date").agg((F.sum("q") * 5).alias("on_hand"), F.min("q").alias("reserved"), F.sum("q").alias("units"))
        w = Window.partitionBy("sku").orderBy("date")
        over = {k: F.sum(x).over(w.rowsBetween(1 - STOCK_ROWS, 0)) for k, x in (("_s", F.col("units")), ("_q", F.col("units") * F.col("units")), ("_n", F.lit(1)))}
        return days.withColumns({**over, "next_date": F.lead("date").over(w)})

    def price_history(self) -> DataFrame:
        """sku, price, effective_from, effective_to."""
        days = self.raw("lineitem").groupBy(F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("date")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
        return history(days, ["sku"], "date", "price", 0.005)

    def budget_snapshots(self) -> DataFrame:
        months = self.ad_daily().groupBy("campaign_id", F.trunc("date", "month").alias("snapshot_date")).agg(dsum("spend").alias("spend"))
        budget = (F.floor(F.col("spend") / 100) * 100).cast("double")
        return months.select("campaign_id", "snapshot_date", budget.alias("budget"), F.when(budget > 0, "ACTIVE").otherwise("PAUSED").alias("status"))

    def events(self) -> DataFrame:
        return self.raw("events")

    def adsets(self) -> DataFrame:
        """ad_id and adset_id: ads of even and of odd numbers."""
        return self.ad_daily().select("ad_id", "campaign_id").distinct().select("ad_id", self.adset_of("ad_id", "campaign_id").alias("adset_id"))

    @staticmethod
    def adset_of(ad_id: str, campaign_id: str) -> Column:
        """The set of an ad, as in adsets(): it stands in the ids, so rows that bear them need no join for it."""
        return F.concat_ws("/", campaign_id, (F.element_at(F.split(ad_id, "-"), -1).cast("int") % 2).cast("string"))

    def reach_daily(self) -> DataFrame:
        return self.held("reach-daily", self._reach_daily)

    def ga_daily(self) -> DataFrame:
        return self.held("ga-daily", self._ga_daily)

    def _reach_daily(self) -> DataFrame:
        """People reached by campaigns of the platforms that tell."""
        items = self.raw("lineitem").join(self.raw("part").select("p_partkey", F.col("p_brand").alias("campaign_id")), F.col("l_partkey") == F.col("p_partkey"))
        told = items.join(self.campaigns().where("platform in ('meta', 'tiktok')").select("campaign_id"), "campaign_id")
        return told.groupBy(F.to_date("l_shipdate").alias("date"), "campaign_id").agg(F.countDistinct("l_orderkey").alias("reach"))

    def _ga_daily(self) -> DataFrame:
        """Web sessions of campaigns: an event's user came by one of the 25, 23 years before the event."""
        e = self.events().select(F.date_sub(F.to_date("ts"), 8400).alias("date"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("campaign_id"), "user_id", "event_type", "value")
        bought = F.col("event_type") == "purchase"
        return e.groupBy("date", "campaign_id").agg(F.countDistinct("user_id").alias("ga_sessions"), F.count(F.when(bought, 1)).alias("ga_purchases"), dsum(F.when(bought, F.col("value")).otherwise(0.0)).alias("ga_revenue"))


#: The same tables in DuckDB's SQL.
STAGING = """
WITH order_lines AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT l_orderkey AS order_id, l_linenumber AS line_item_id, CAST(o_orderdate AS DATE) AS date, o_custkey AS customer_id,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority = '1-URGENT' END AS is_new_customer, l_partkey AS sku, CAST(l_quantity AS INTEGER) AS qty,
      l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS subtotal,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'google' WHEN '2-HIGH' THEN 'facebook' WHEN '3-MEDIUM' THEN 'newsletter' WHEN '4-NOT SPECIFIED' THEN 'google' END AS utm_source,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'cpc' WHEN '2-HIGH' THEN 'paid' WHEN '3-MEDIUM' THEN 'email' WHEN '4-NOT SPECIFIED' THEN 'organic' END AS utm_medium,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN p_brand END AS utm_campaign, l_returnflag = 'R' AS returned, CAST(l_shipdate AS DATE) AS ship_date,
      CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS available_at,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WHERE n = 1
), refund_lines AS (
  SELECT order_id, line_item_id, sku, ship_date AS refund_date, subtotal AS amount, CAST(ship_date - date AS INTEGER) AS lag_days FROM order_lines WHERE returned
), products AS (
  SELECT p_partkey AS sku, p_name AS title, p_type AS category, p_brand AS brand, p_retailprice AS price, p_retailprice * 0.4::DOUBLE AS cogs, p_size * 0.5::DOUBLE AS ship_cost, 0.02::DOUBLE AS fee_pct, p_size <= 40 AS promoted FROM part
), campaigns AS (
  SELECT p_brand AS campaign_id, ['meta', 'google', 'tiktok', 'amazon'][1 + CAST(right(p_brand, 1) AS INTEGER) % 4] AS platform, 'Prospecting | ' || min(p_type) AS name, min(p_type) AS product_set FROM part GROUP BY p_brand
), ad_daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand || '-' || l_linenumber AS ad_id, p_brand AS campaign_id, CAST(sum(CAST(l_quantity AS BIGINT)) * 40 AS BIGINT) AS impressions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks,
    CAST(sum(CAST(l_tax * l_extendedprice * 0.1::DOUBLE AS DECIMAL(38,6))) AS DOUBLE) AS spend, CAST(sum(CAST(l_extendedprice AS DECIMAL(38,6))) AS DOUBLE) AS platform_revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), stock_daily AS (
  SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) * 5 AS BIGINT) AS on_hand, min(CAST(l_quantity AS BIGINT)) AS reserved, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY ALL
), price_days AS (
  SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY ALL
), price_history AS (
  SELECT sku, price, date AS effective_from, lead(date) OVER (PARTITION BY sku ORDER BY date) AS effective_to FROM (
    SELECT *, lag(price) OVER (PARTITION BY sku ORDER BY date) AS prev FROM price_days) WHERE prev IS NULL OR abs(price - prev) > 0.005
), budget_snapshots AS (
  SELECT campaign_id, snapshot_date, CAST(floor(spend / 100) * 100 AS DOUBLE) AS budget, CASE WHEN CAST(floor(spend / 100) * 100 AS DOUBLE) > 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS status FROM (
    SELECT campaign_id, CAST(date_trunc('month', date) AS DATE) AS snapshot_date, CAST(sum(CAST(spend AS DECIMAL(38,6))) AS DOUBLE) AS spend FROM ad_daily GROUP BY ALL)
), adsets AS (
  SELECT DISTINCT ad_id, campaign_id || '/' || (CAST(split_part(ad_id, '-', 2) AS INTEGER) % 2) AS adset_id FROM ad_daily
), reach_daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS campaign_id, count(DISTINCT l_orderkey) AS reach FROM lineitem JOIN part ON l_partkey = p_partkey JOIN campaigns c ON c.campaign_id = p_brand WHERE c.platform IN ('meta', 'tiktok') GROUP BY ALL
), ga_daily AS (
  SELECT CAST(ts AS DATE) - 8400 AS date, 'Brand#' || (user_id % 25 + 1) AS campaign_id, count(DISTINCT user_id) AS ga_sessions, count(*) FILTER (WHERE event_type = 'purchase') AS ga_purchases,
    CAST(sum(CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END AS DECIMAL(38,6))) AS DOUBLE) AS ga_revenue FROM events GROUP BY ALL
)
"""


def dsum_sql(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(38,6))) AS DOUBLE)"
