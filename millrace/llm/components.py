"""Connected components by alternating large and small stars (Kiveris and others 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remove_stored, stored

#: A vertex with more neighbours than one in so many edges, and than LEAST, is a hub: there are at most twice so many hubs, each a row of two numbers.
HUBS, LEAST = 50_000, 64


def _with_least(both: DataFrame, edges: int) -> DataFrame:
    """both (u, v) with m, the least of u and its neighbours. The edges of hubs meet their m by a broadcast where they lie, those of other vertices by a shuffle."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hub = F.col("n") > max(LEAST, edges // HUBS)
    told = both.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    plain = told.where("hub_m is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
    return told.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(plain)


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    if large:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return _with_least(both, count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    joined = _with_least(down, count)
    return joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges: u and v (long, no nulls). Returns u and root, the least vertex of its component, for every u that is not its root."""
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen, n = None, edges.count()
    while True:
        new = stored(_star(_star(edges, True, n), False, n).where("u <> v").distinct(), "stars")
        remove_stored(edges)
        edges, now = new, new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("root"))
        seen, n = now, max(n, now[0])
