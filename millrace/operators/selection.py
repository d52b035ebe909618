"""The first k rows of an order without a global sort or one task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a look at the values, and rows that may be ordered in one task.
BUCKETS, FEW = 1024, 10_000


def first_k(df: DataFrame, value: str, order: list[str], k: int) -> DataFrame:
    """The k rows of greatest value, ties by the ascending columns of order (which tell all rows apart); for any k. Looks from coarse to fine: counts in BUCKETS of the values' range, then in the bucket that k ends in, until what is
    left is few or of one value. Rows with a null value are never among them. k <= 0 gives none."""
    df = df.where(F.col(value).isNotNull())
    if k <= 0:
        return df.where(F.lit(False))
    low, high = (float("-inf") if x is None else float(x) for x in df.agg(F.min(value), F.max(value)).first())
    taken, rest, left = None, df, k  # taken: a condition for rows that are in for sure
    while True:
        n = rest.count()
        if n <= left:
            break
        if n <= FEW or low >= high:
            if n > FEW:  # ties of one value, by their order
                return _tied(df, taken, rest, order, left)
            rest = rest.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(value), *order))).where(F.col("_n") <= left).drop("_n")
            break
        width = (high - low) / BUCKETS
        at = F.least(F.lit(BUCKETS - 1), F.floor((F.lit(high) - F.col(value)) / width).cast("int")) if width > 0 else F.lit(0)
        counts = rest.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("b").collect()  # BUCKETS rows at most
        before = 0
        for c in counts:
            if before + c.n >= left:
                break
            before += c.n
        upper = F.col(value) > c.high
        if before:
            taken = upper if taken is None else taken | upper
        left -= before
        rest = rest.where((F.col(value) >= c.low) & (F.col(value) <= c.high))
        low, high = float(c.low), float(c.high)
    return rest if taken is None else df.where(taken).unionByName(rest)


def _tied(df: DataFrame, taken, rest: DataFrame, order: list[str], left: int) -> DataFrame:
    """Of rows of one value, the first by their order: ranges of the order, numbered by the rows of the ranges before."""
    laid = rest.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_s"))
    ahead = sizes.withColumn("_ahead", F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_ahead"])  # a row for each range
    own = laid.join(F.broadcast(ahead), "_p").withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_ahead")).where(F.col("_n") <= left).select(*rest.columns)
    return own if taken is None else df.where(taken).unionByName(own)
