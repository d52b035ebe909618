"""Relational helpers that Spark SQL has no word for: latest row of a key, as-of joins, histories, spines, upserts, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = list[Column | str]


def as_of(df: DataFrame, moment: str) -> DataFrame:
    """Rows that were known at the moment."""
    return df.where(F.col("available_at") <= F.lit(moment).cast("timestamp_ntz"))


def latest_per_key(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The first row of each key by the order (like QUALIFY row_number() = 1)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_value(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """The values at the greatest `by` of each key, by a partial aggregate instead of a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(by, *values)).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both by name; the newest version of a key wins, the incoming one on a tie."""
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, [F.col(version).desc_nulls_last(), F.col("_in").desc()]).drop("_in")


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and one incoming row (the least) of each key that it lacks. Null equals null in a key."""
    on = F.lit(True)
    for k in keys:
        on = on & incoming[k].eqNullSafe(F.col(f"_k_{k}"))
    known = existing.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    return existing.unionByName(latest_per_key(incoming.join(known, on, "left_anti"), keys, list(incoming.columns)))


def update_keyed(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the other columns of changes (one row a key) where a key has any; rows without one stay."""
    values = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    both = existing.join(renamed, keys, "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in existing.columns])


def delete_keyed(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def history(snapshots: DataFrame, keys: list[str], date: str, value: str, tolerance: float | None = None) -> DataFrame:
    """keys, value, effective_from and effective_to of each change; rows without a change go before the ends are set."""
    w = Window.partitionBy(*keys).orderBy(date)
    before = F.lag(value).over(w)
    changed = before.isNull() | ((F.abs(F.col(value) - before) > tolerance) if tolerance is not None else (F.col(value) != before))
    kept = snapshots.withColumn("_c", changed).where("_c").drop("_c")
    return kept.select(*keys, value, F.col(date).alias("effective_from"), F.lead(date).over(w).alias("effective_to"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], moment: str, start: str = "effective_from", end: str = "effective_to", how: str = "left") -> DataFrame:
    """Each left row with the right row of its key whose half-open interval holds its moment. Equal on the keys, so it shuffles by them; the interval is a residual."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, on & (F.col(start) <= F.col(moment)) & (F.col(end).isNull() | (F.col(moment) < F.col(end))), how).drop(*[f"_r_{k}" for k in keys])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time: one sort of both sides together, no range join."""
    l = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def spine(entities: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    """A row for every entity and day between its two dates."""
    return entities.withColumn(date, F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day")))).drop(first, last)


def smallest_prefix(df: DataFrame, keys: list[str], segment: str, effect: str, share: float = 0.8, most: int = 5) -> DataFrame:
    """Of each key, the fewest segments by size of effect that explain the share of its total absolute effect: keys, segment, effect, rank."""
    w = Window.partitionBy(*keys).orderBy(F.abs(effect).desc(), segment)
    before = F.coalesce(F.sum(F.abs(effect)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(F.abs(effect)).over(Window.partitionBy(*keys))
    ranked = df.withColumns({"rank": F.row_number().over(w), "_before": before, "_total": total})
    return ranked.where((F.col("_before") < F.lit(share) * F.col("_total")) & (F.col("rank") <= most)).select(*keys, segment, effect, "rank")


def runs(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Gaps and islands: keys, state, first, last and length of each run of one state."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, state).orderBy(order))
    return df.withColumn("_i", island).groupBy(*keys, state, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_i")


def first_available(df: DataFrame, keys: list[str], order: Order, supply: str) -> DataFrame:
    """Rationing: the first `supply` rows of each key are filled."""
    return df.withColumn("filled", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= F.col(supply))


def histogram_cdf(values: DataFrame, value: str, top: int) -> DataFrame:
    """age 0..top and cdf: the share of values at most the age, negative ones too (0 without values). A histogram and a running sum over at most top + 1 rows."""
    counts = values.where(F.col(value) <= top).groupBy(F.greatest(F.col(value).cast("int"), F.lit(0)).alias("age")).agg(F.count("*").alias("n"))
    total = values.agg(F.count(value).alias("total"))
    ages = values.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("age"))
    grid = ages.join(F.broadcast(counts), "age", "left").join(F.broadcast(total), how="cross")
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("age", F.when(F.col("total") > 0, run / F.col("total")).otherwise(0.0).alias("cdf"))


def null_safe_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: keys, before, after and change (added, removed, changed) where the two differ."""
    both = left.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_l")).join(right.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_r")), keys, "full")
    kind = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", kind).where("change is not null").drop("_l", "_r")
