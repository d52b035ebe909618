"""Detections matched with incidents that truly were: edges where their entities meet, as many pairs as can be, and the scores of it.

The events table stands for both. Incident: a cohort of users in a week with an error, whose entities are its users, whose metrics are the kinds of events with the direction of their mean value. Detection: a cohort of users, a day and a kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import matched
from millrace.plans.registry import query
from millrace.sources.testdata import Staging

KINDS, COHORTS, FOUND, HIGH, SLACK = ("click", "view", "purchase"), 30, 60, 25.0, 3
_K = ", ".join(f"'{k}'" for k in KINDS)


def _direction(value: Column) -> Column:
    return F.when(F.round(value, 6) >= HIGH, "UP").otherwise("DOWN")


def incidents(events: DataFrame) -> DataFrame:
    """incident, entities, directions (kind -> direction), start, end, onset, driver (the kind with the most value, of equals the first by name)."""
    week, day = F.to_date(F.date_trunc("week", "ts")), F.to_date("ts")
    e = events.select((F.col("user_id") % COHORTS).alias("c"), week.alias("week"), day.alias("day"), "user_id", "event_type", "value")
    kinds = e.where(F.col("event_type").isin(*KINDS)).groupBy("c", "week", "event_type").agg(F.collect_set("user_id").alias("users"), (F.sum(F.col("value").cast("decimal(38,6)")).cast("double") / F.count("*")).alias("mean"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("total"))
    each = kinds.groupBy("c", "week").agg(F.flatten(F.collect_list("users")).alias("users"), F.map_from_entries(F.collect_list(F.struct("event_type", _direction(F.col("mean"))))).alias("directions"), F.min_by("event_type", F.struct(-F.col("total"), "event_type")).alias("driver"))
    hit = e.where("event_type = 'error'").groupBy("c", "week").agg(F.min("day").alias("onset"))
    name = F.concat_ws("-", F.lpad(F.col("c").cast("string"), 3, "0"), F.col("week").cast("string"))
    return each.join(hit, ["c", "week"]).select(name.alias("incident"), F.array_distinct("users").alias("entities"), "directions", F.col("week").alias("start"), F.date_add("week", 6).alias("end"), "onset", "driver")


def detections(events: DataFrame) -> DataFrame:
    """detection (its name begins with the day), entities, kind, direction, day, drivers (kinds of that cohort and day, most frequent first)."""
    e = events.where(F.col("event_type").isin(*KINDS)).select((F.col("user_id") % FOUND).alias("c"), F.to_date("ts").alias("day"), "user_id", "event_type", "value")
    each = e.groupBy("c", "day", "event_type").agg(F.collect_set("user_id").alias("entities"), (F.sum(F.col("value").cast("decimal(38,6)")).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    ranked = each.groupBy("c", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))), lambda x: x["event_type"]).alias("drivers"))
    name = F.concat_ws("-", F.col("day").cast("string"), F.lpad(F.col("c").cast("string"), 3, "0"), "event_type")
    return each.join(ranked, ["c", "day"]).select(name.alias("detection"), "entities", F.col("event_type").alias("kind"), _direction(F.col("mean")).alias("direction"), "day", "drivers")


def edges(found: DataFrame, truths: DataFrame) -> DataFrame:
    """detection, incident: a shared entity, a metric of the incident in its direction, and a day within its span and SLACK days after. Keys are exploded, so only rows that share one meet."""
    left = found.select("detection", "kind", "direction", "day", F.explode("entities").alias("entity"))
    right = truths.select("incident", "start", F.date_add("end", SLACK).alias("until"), F.explode("directions").alias("kind", "direction"), "entities").select("incident", "start", "until", "kind", "direction", F.explode("entities").alias("entity"))
    met = left.join(right, ["entity", "kind", "direction"]).where((F.col("day") >= F.col("start")) & (F.col("day") <= F.col("until")))
    return met.select("detection", "incident").distinct()


_EDGES = f"""WITH kinds AS (SELECT user_id % {COHORTS} AS c, CAST(date_trunc('week', ts) AS DATE) AS week, event_type, list(DISTINCT user_id) AS users, CASE WHEN round(CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(*), 6) >= {HIGH} THEN 'UP' ELSE 'DOWN' END AS direction FROM events WHERE event_type IN ({_K}) GROUP BY ALL
), hit AS (SELECT DISTINCT user_id % {COHORTS} AS c, CAST(date_trunc('week', ts) AS DATE) AS week FROM events WHERE event_type = 'error'
), everyone AS (SELECT c, week, list(DISTINCT u) AS users FROM (SELECT c, week, unnest(users) AS u FROM kinds) GROUP BY ALL
), truths AS (SELECT lpad(CAST(k.c AS VARCHAR), 3, '0') || '-' || k.week AS incident, k.week AS start, event_type AS kind, direction, e.users FROM kinds k JOIN hit USING (c, week) JOIN everyone e USING (c, week)
), found AS (SELECT CAST(ts AS DATE) || '-' || lpad(CAST(user_id % {FOUND} AS VARCHAR), 3, '0') || '-' || event_type AS detection, event_type AS kind, CAST(ts AS DATE) AS day, list(DISTINCT user_id) AS users, CASE WHEN round(CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(*), 6) >= {HIGH} THEN 'UP' ELSE 'DOWN' END AS direction FROM events WHERE event_type IN ({_K}) GROUP BY ALL)
"""


@query(_EDGES + f"SELECT detection, incident FROM found f JOIN truths t ON f.kind = t.kind AND f.direction = t.direction AND f.day BETWEEN t.start AND t.start + {6 + SLACK} AND list_has_any(f.users, t.users)")
def j28_incident_edges(s: Staging) -> DataFrame:
    return edges(detections(s.events()), incidents(s.events()))


@query()
def d51_maximum_matching(s: Staging) -> DataFrame:
    """The pairs: as many as can be, earlier detections first, each with the first incident that leaves room for all."""
    return matched(edges(detections(s.events()), incidents(s.events())), "detection", "incident")


@query()
def d51_detection_scores(s: Staging) -> DataFrame:
    """Precision, recall, F1, days from onset to detection, early warnings, and how often the true driver is ranked first or among three."""
    found, truths = detections(s.events()), incidents(s.events())
    pairs = matched(edges(found, truths), "detection", "incident").join(found, "detection").join(truths.select("incident", "onset", "driver"), "incident")
    late = F.datediff("day", "onset")
    hit = lambda x: F.lit(1.0) * F.count(F.when(x, 1)) / F.count("*")
    told = pairs.agg(F.count("*").alias("matched"), F.median(F.when(late >= 0, late)).alias("latency"), F.count(F.when(late < 0, 1)).alias("early"), hit(F.get("drivers", F.lit(0)) == F.col("driver")).alias("top1"), hit(F.array_contains(F.slice("drivers", 1, 3), F.col("driver"))).alias("top3"))
    counts = found.agg(F.count("*").alias("found")).join(truths.agg(F.count("*").alias("truths")), how="cross")  # rows of one
    t = told.join(counts, how="cross")
    p, q = F.lit(1.0) * F.col("matched") / F.col("found"), F.lit(1.0) * F.col("matched") / F.col("truths")
    ratio = lambda n, d: F.when(d > 0, n / F.when(d > 0, d))
    return t.select("matched", (F.col("found") - F.col("matched")).alias("wrong"), (F.col("truths") - F.col("matched")).alias("missed"), ratio(F.lit(1.0) * F.col("matched"), F.col("found")).alias("precision"), ratio(F.lit(1.0) * F.col("matched"), F.col("truths")).alias("recall"), ratio(2 * p * q, p + q).alias("f1"), "latency", "early", "top1", "top3")
