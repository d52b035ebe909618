"""Sources and sinks: declared CSV and JSON reads, normalisers of native payloads, the data contract of uploads, profiling, and safe publication."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import upsert
from millrace.sources.scratch import remove_stored, stored

#: Upload kind -> column -> (type, header synonyms).
CONTRACTS = {
    "ads": {"date": ("date", ["day"]), "budget_id": ("string", ["campaign id", "campaign"]), "platform": ("string", ["network"]), "spend": ("double", ["cost", "amount spent"]), "impressions": ("long", ["impr."]), "clicks": ("long", [])},
    "inventory": {"sku": ("string", ["variant sku"]), "on_hand": ("long", ["available"]), "reserved": ("long", ["committed"]), "safety_stock": ("long", [])},
    "margins": {"sku": ("string", ["variant sku"]), "price": ("double", []), "unit_cost": ("double", ["cost per item"])},
}
KEYS = {"ads": ["date", "budget_id"], "inventory": ["sku"], "margins": ["sku"]}
PLATFORMS = ["meta", "google", "tiktok", "amazon"]


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV with a header; without a schema every column is text, never inferred. Broken rows fail. multi_line: fields may hold line breaks; each file is then read by one task."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def write_ordered(df: DataFrame, path: str, *order: str) -> None:
    """Parquet, range-partitioned and sorted by the order: a total order over the files without one task that holds all rows."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _tokens(header: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", header.lower()))


def map_headers(headers: list[str], kind: str) -> dict[str, str]:
    """Contract column -> header: exact name, then synonym, then shared words (of both together four fifths at least), the best pairs first. Each header serves once."""
    out: dict[str, str] = {}
    plain = {h: h.strip().lower() for h in headers}

    def shared(column: str, header: str) -> float:
        a, b = _tokens(column), _tokens(header)
        return 2 * len(a & b) / max(1, len(a) + len(b))

    tests = [lambda c, h: float(plain[h] == c), lambda c, h: float(plain[h] in CONTRACTS[kind][c][1]), shared]
    for test in tests:
        pairs = [(-score, k, n, c, h) for k, c in enumerate(CONTRACTS[kind]) for n, h in enumerate(headers) if (score := test(c, h)) >= 0.8]
        for _, _, _, column, header in sorted(pairs):
            if column not in out and header not in out.values():
                out[column] = header
    return out


def contract_errors(df: DataFrame, kind: str) -> DataFrame:
    """The rows of an all-text upload with typed columns (null where they do not parse) and errors, an array that is empty for good rows."""
    from pyspark.sql import Window

    made, errors = {}, []
    for name, (type_, _) in CONTRACTS[kind].items():
        value = F.col(name).try_cast(type_)
        made[name] = value
        errors.append(F.when(F.col(name).isNull() | (F.trim(name) == ""), F.lit(f"{name}: missing")).when(value.isNull(), F.lit(f"{name}: not a {type_}")))
        if type_ in ("double", "long"):
            errors.append(F.when((value < 0) | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf")), F.lit(f"{name}: must be finite and not negative")))
    if kind == "ads":
        errors += [F.when(~F.lower("platform").isin(PLATFORMS), F.lit("platform: unknown")), F.when(made["clicks"] > made["impressions"], F.lit("clicks: more than impressions"))]
    if kind == "inventory":
        errors.append(F.when(made["reserved"] > made["on_hand"], F.lit("reserved: more than on_hand")))
    errors.append(F.when(F.count(F.lit(1)).over(Window.partitionBy(*KEYS[kind])) > 1, F.lit("duplicate key")))
    typed = df.withColumn("errors", F.array_compact(F.array(*errors)))
    return typed.select(*[made[c].alias(c) for c in CONTRACTS[kind]], "errors")


def utm(url: Column, key: str) -> Column:
    """A parameter of a landing url or path, decoded; null without it."""
    return F.try_url_decode(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)) if key else F.lit(None)


ORDER = "id long, created_at string, landing_site string, taxes_included boolean, line_items array<struct<id: long, sku: string, quantity: int, price: string, total_discount: string>>"


def normalise_orders(raw: DataFrame) -> DataFrame:
    """raw: payload (JSON of an order). One row for each line; tax-inclusive orders and times of another zone are refused."""
    o = F.from_json("payload", ORDER)
    df = raw.select(o.alias("o")).select("o.*")
    wrong = F.when(F.coalesce("taxes_included", F.lit(False)), F.raise_error(F.lit("tax-inclusive prices"))).when(~F.col("created_at").endswith("+05:30"), F.raise_error(F.lit("not local time")))
    df = df.withColumn("created_at", F.coalesce(wrong.cast("string"), F.regexp_replace("created_at", r"\+05:30$", "")).cast("timestamp_ntz"))
    line = F.col("line")
    df = df.select(F.col("id").alias("order_id"), "created_at", F.to_date("created_at").alias("date"), "landing_site", F.explode("line_items").alias("line"))
    return df.select("order_id", line["id"].alias("line_item_id"), "created_at", "date", line["sku"].alias("sku"), line["quantity"].alias("qty"), (line["price"].cast("double") * line["quantity"] - line["total_discount"].cast("double")).alias("subtotal"), F.nullif(utm(F.col("landing_site"), "utm_source"), F.lit("")).alias("utm_source"), F.nullif(utm(F.col("landing_site"), "utm_campaign"), F.lit("")).alias("utm_campaign"))


AD = "date string, ad_id string, impressions string, clicks string, spend string, actions array<struct<action_type: string, value: string>>"


def normalise_ads(raw: DataFrame, fx: float = 83.0) -> DataFrame:
    """raw: payload (JSON of an ad's day). Numbers come as text, spend in dollars; purchases are one kind of action, 0 without it."""
    a = raw.select(F.from_json("payload", AD).alias("a")).select("a.*")
    bought = F.filter("actions", lambda x: x["action_type"] == "purchase")
    return a.select(F.to_date("date").alias("date"), "ad_id", F.col("impressions").cast("long").alias("impressions"), F.col("clicks").cast("long").alias("clicks"), (F.col("spend").cast("double") * fx).alias("spend"), F.coalesce(F.get(bought, F.lit(0))["value"].cast("double"), F.lit(0.0)).alias("purchases"))


def normalise_report(raw: DataFrame, headers: list[str]) -> DataFrame:
    """raw: values (array of text) beside shared headers; a date column as yyyyMMdd."""
    named = F.map_from_arrays(F.array(*map(F.lit, headers)), F.col("values"))
    return raw.select(*[(F.to_date(named[h], "yyyyMMdd") if h == "date" else named[h]).alias(h) for h in headers])


def stamp(df: DataFrame, run_id: str, ingested_at: str, lag_hours: int, provenance: str = "api") -> DataFrame:
    """Adds run_id, ingested_at, provenance and available_at: the day after the business date, plus the source's lag."""
    return df.withColumns({"run_id": F.lit(run_id), "ingested_at": F.lit(ingested_at).cast("timestamp_ntz"), "provenance": F.lit(provenance), "available_at": F.date_add("date", 1).cast("timestamp_ntz") + F.expr(f"interval {lag_hours} hours")})


GOOGLE = "date string, customer struct<id: string>, campaign struct<id: string, name: string>, ad struct<id: string>, metrics struct<impressions: string, clicks: string, cost_micros: string, conversions: double>"


def normalise_google_ads(raw: DataFrame) -> DataFrame:
    """raw: payload (JSON of an ad's day, nested). Cost comes in millionths of the currency."""
    g = raw.select(F.from_json("payload", GOOGLE).alias("g")).select("g.*")
    number = lambda c: F.col(f"metrics.{c}").cast("long").alias(c)
    return g.select(F.to_date("date").alias("date"), F.col("campaign.id").alias("campaign_id"), F.col("ad.id").alias("ad_id"), number("impressions"), number("clicks"), (F.col("metrics.cost_micros").cast("double") / 1e6).alias("cost"), F.coalesce("metrics.conversions", F.lit(0.0)).alias("conversions"))


REFUND = "order_id long, created_at string, refund_line_items array<struct<line_item_id: long, quantity: int, subtotal: string>>"


def normalise_refunds(raw: DataFrame) -> DataFrame:
    """raw: payload (JSON of a refund). One row for each refunded line."""
    r = raw.select(F.from_json("payload", REFUND).alias("r")).select("r.order_id", F.to_date(F.substring("r.created_at", 1, 10)).alias("date"), F.explode("r.refund_line_items").alias("line"))
    return r.select("order_id", F.col("line.line_item_id").alias("line_item_id"), "date", F.col("line.quantity").alias("qty"), F.col("line.subtotal").cast("double").alias("amount"))


TIKTOK = "dimensions struct<stat_time_day: string, ad_id: string>, metrics struct<spend: string, impressions: string, clicks: string, conversion: string>, currency string"


def normalise_tiktok(raw: DataFrame, fx: float = 83.0) -> DataFrame:
    """raw: payload (JSON of an ad's day in dollars)."""
    t = raw.select(F.from_json("payload", TIKTOK).alias("t")).select("t.*")
    number = lambda c: F.col(f"metrics.{c}").cast("long").alias(c)
    return t.select(F.to_date(F.substring("dimensions.stat_time_day", 1, 10)).alias("date"), F.col("dimensions.ad_id").alias("ad_id"), number("impressions"), number("clicks"), (F.col("metrics.spend").cast("double") * fx).alias("spend"), "currency")


MARKET = "AmazonOrderId string, PurchaseDate string, OrderItems array<struct<SellerSKU: string, QuantityOrdered: int, ItemPrice: struct<Amount: string>>>"


def normalise_marketplace(raw: DataFrame) -> DataFrame:
    """raw: payload (JSON of a marketplace order). The order's number is the last part of its id; a unit's price is the line's by its quantity."""
    o = raw.select(F.from_json("payload", MARKET).alias("o")).select("o.*").select(F.element_at(F.split("AmazonOrderId", "-"), -1).cast("long").alias("order_id"), F.to_date(F.substring("PurchaseDate", 1, 10)).alias("date"), F.explode("OrderItems").alias("i"))
    amount, qty = F.col("i.ItemPrice.Amount").cast("double"), F.col("i.QuantityOrdered")
    return o.select("order_id", "date", F.col("i.SellerSKU").alias("sku"), qty.alias("qty"), amount.alias("amount"), F.when(qty > 0, amount / qty).alias("unit_price"))


def looked_up(facts: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """facts with the value that names (one row a key) has for their key; null where it has none."""
    return facts.join(names.select(key, value), key, "left")


def due_window(synced: DataFrame, today: str, first_days: int = 365, late_days: int = 3) -> DataFrame:
    """source, last_synced -> source, since and until of the next pull: a year at first, later from the days that may still be corrected on."""
    day = F.lit(today).cast("date")
    since = F.coalesce(F.date_sub("last_synced", late_days - 1), F.date_sub(day, first_days))
    return synced.select("source", since.alias("since"), F.date_sub(day, 1).alias("until"))


def upload_id(df: DataFrame) -> DataFrame:
    """upload_id and n_rows: the same rows in any order have the same id. Row hashes are summed, so no task holds them all."""
    columns = sorted(df.columns)
    half = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]).cast("binary")), k, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.concat_ws("-", *[F.coalesce(F.sum(half(k)), F.lit(0)).cast("string") for k in (1, 13)], F.count("*").cast("string")).alias("upload_id"), F.count("*").alias("n_rows"))


def preview(df: DataFrame, limit: int, hidden: list[str], *order: str) -> DataFrame:
    """The first rows without hidden columns, and whether there are more: one row beyond the limit is asked for."""
    from pyspark.sql import Window

    some = df.drop(*hidden).orderBy(*order).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))  # of limit + 1 rows
    return some.withColumns({"_n": n, "truncated": F.count(F.lit(1)).over(Window.partitionBy()) > limit}).where(F.col("_n") <= limit).drop("_n")


def found_columns(headers: list[str], required: dict[str, list[str]]) -> tuple[dict[str, str], list[str]]:
    """Required column -> header (itself or a synonym, in any case of letters), and the required columns that are missing."""
    plain = {h.strip().lower(): h for h in headers}
    found = {}
    for column, synonyms in required.items():
        hit = next((plain[n.lower()] for n in (column, *synonyms) if n.lower() in plain), None)
        if hit is not None:
            found[column] = hit
    return found, [c for c in required if c not in found]


def profile(fact: DataFrame, key: str, dimension: DataFrame, dimension_key: str, day: str, linked: str | None = None) -> DataFrame:
    """n_rows, orphan_rate, first, last and days of history: the gate before a dataset is taken. linked: a condition whose share must be high (link_rate)."""
    known = dimension.select(F.col(dimension_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    joined = fact.join(known, F.col(key) == F.col("_k"), "left")
    share = lambda c: F.lit(1.0) * F.count(F.when(c, 1)) / F.count("*")
    more = [share(F.expr(linked)).alias("link_rate")] if linked else []
    return joined.agg(F.count("*").alias("n_rows"), share(F.col("_hit").isNull()).alias("orphan_rate"), F.min(F.to_date(day)).alias("first"), F.max(F.to_date(day)).alias("last"), F.datediff(F.max(F.to_date(day)), F.min(F.to_date(day))).alias("days"), *more)


def publish(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Writes all tables under the run and only then adds a pointer to it. A pointer is one small file that appears by a rename, and none is ever changed, so readers see
    all of the run before or all of this one. A run that is written again replaces its own files only."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/run={run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(run).alias("run"), F.lit(time.time_ns()).alias("at")).coalesce(1).write.mode("append").json(f"{root}/pointers")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    run = spark.read.schema("run string, at long").json(f"{root}/pointers").agg(F.max_by("run", "at")).first()[0]
    return spark.read.parquet(f"{root}/run={run}/{name}")


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], version: str, partition: str) -> None:
    """Upsert by key into Parquet partitions: only the partitions of the incoming rows, and those that held their keys before, are read and written again. Partitions that
    lose all their rows are deleted last, so that a reader meets a moved key twice rather than never."""
    held = spark.read.parquet(path)
    at = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1)
    before = held.select(*keys, F.col(partition).alias("_p"), at.alias("_at")).join(incoming.select(*keys).distinct(), keys, "left_semi").select("_p", "_at").distinct()
    touched = stored(before.select(F.col("_p").alias(partition)).union(incoming.select(partition)).distinct(), "touched")
    merged = stored(upsert(held.join(touched, partition, "left_semi"), incoming, keys, version), "merged")
    emptied = [r["_at"] for r in before.join(merged.select(F.col(partition).alias("_p")).distinct(), "_p", "left_anti").select("_at").distinct().collect()]  # folders of partitions
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for folder in emptied:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    remove_stored(touched, merged)
