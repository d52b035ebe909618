"""Read queries of the pages on causes, learning, the timeline, what-if, number grounding, and marts in a chosen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import dsum
from millrace.operators import relational as r
from millrace.plans import decisions, diagnosis, ingestion, learning, operations
from millrace.plans.registry import query
from millrace.sources.testdata import Staging, dsum_sql

D = dsum_sql


@query(learning._ALL_GATED + f"SELECT campaign_id, CASE WHEN {learning._GATE} IS NULL THEN 'ESTIMATED' ELSE {learning._GATE} END AS status, round(effect, 2) AS effect FROM ({learning._GATED})", "staging")
def v_causal(s: Staging) -> DataFrame:
    """The estimate of each treated campaign, or why there is none; the raw gap is shown either way."""
    gaps = [learning.gated(s, t) for t in learning._TREATED]
    raw = [_raw_gap(s, t) for t in learning._TREATED]
    df = gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).select("campaign_id", F.coalesce("reason", F.lit("ESTIMATED")).alias("status"))
    return df.join(raw[0].unionByName(raw[1]).unionByName(raw[2]), "campaign_id")


def _raw_gap(s: Staging, treated: str) -> DataFrame:
    grid, chosen = diagnosis.controls(s, treated)
    ratio = grid.where("week < '2001-05-28'").groupBy("control").agg((F.sum("y").cast("double") / F.sum("x")).alias("ratio"))
    made = grid.join(chosen, "control", "left_semi").join(ratio, "control").groupBy("week", "y").agg((dsum(F.col("ratio") * F.col("x")) / F.count("*")).alias("made"))
    return made.where("week >= '2001-05-28'").agg(F.lit(treated).alias("campaign_id"), F.round(dsum(F.col("y") - F.col("made")), 2).alias("effect"))


@query(ingestion._DECISIONS + f", o AS (SELECT CASE WHEN abs(spend - budget) <= 0.1::DOUBLE * budget THEN 'SUCCESS' WHEN abs(spend - budget) <= 0.3::DOUBLE * budget THEN 'NEUTRAL' WHEN budget > 0 THEN 'FAILED' ELSE 'INCONCLUSIVE' END AS verdict, abs(spend - budget) AS error FROM outcomes JOIN decisions USING (decision_id)) SELECT verdict, count(*) AS samples, {D('error')} / count(*) AS mae FROM o GROUP BY verdict", "staging")
def v_learning_accuracy(s: Staging) -> DataFrame:
    """How far outcomes were from what was decided, by verdict."""
    off = F.abs(F.col("spend") - F.col("budget"))
    verdict = F.when(off <= 0.1 * F.col("budget"), "SUCCESS").when(off <= 0.3 * F.col("budget"), "NEUTRAL").when(F.col("budget") > 0, "FAILED").otherwise("INCONCLUSIVE")
    o = ingestion.outcomes(s).join(ingestion.decisions(s), "decision_id")
    return o.select(verdict.alias("verdict"), off.alias("error")).groupBy("verdict").agg(F.count("*").alias("samples"), (dsum("error") / F.count("*")).alias("mae"))


@query(ingestion._DECISIONS + """SELECT * FROM (
  SELECT 'budget' AS kind, campaign_id AS entity, CAST(snapshot_date AS TIMESTAMP) AS moment, CAST(CAST(budget AS BIGINT) AS VARCHAR) AS detail FROM decisions WHERE before IS NULL OR before <> budget
  UNION ALL SELECT 'outcome', decision_id, CAST(last_day(CAST(split_part(decision_id, '@', 2) AS DATE)) AS TIMESTAMP), CAST(CAST(spend AS BIGINT) AS VARCHAR) FROM (SELECT decision_id, floor(spend) AS spend FROM outcomes)
  UNION ALL SELECT 'price', 'SKU ' || sku, CAST(effective_from AS TIMESTAMP), CAST(CAST(floor(price) AS BIGINT) AS VARCHAR) FROM price_history) ORDER BY moment DESC, kind, entity LIMIT 100""", "staging")  # fmt: skip
def v_timeline(s: Staging) -> DataFrame:
    """Changes of budgets, outcomes and prices, newest first: the top of a union, no sort of it all."""
    whole = lambda c: F.floor(c).cast("long").cast("string")
    d = ingestion.decisions(s).where("before is null or before <> budget").select(F.lit("budget").alias("kind"), F.col("campaign_id").alias("entity"), F.col("snapshot_date").cast("timestamp_ntz").alias("moment"), whole("budget").alias("detail"))
    o = ingestion.outcomes(s).select(F.lit("outcome").alias("kind"), F.col("decision_id").alias("entity"), F.last_day(F.split_part("decision_id", F.lit("@"), F.lit(2)).cast("date")).cast("timestamp_ntz").alias("moment"), whole("spend").alias("detail"))
    p = s.price_history().select(F.lit("price").alias("kind"), F.concat(F.lit("SKU "), "sku").alias("entity"), F.col("effective_from").cast("timestamp_ntz").alias("moment"), whole("price").alias("detail"))
    return d.unionByName(o).unionByName(p).orderBy(F.desc("moment"), "kind", "entity").limit(100)


@query(decisions._CURVES + learning._LATEST + f"SELECT campaign_id, CAST(k AS INTEGER) AS k, current * (0.5::DOUBLE + k * 0.05::DOUBLE) AS budget, top * (current * (0.5::DOUBLE + k * 0.05::DOUBLE)) / (current * (0.5::DOUBLE + k * 0.05::DOUBLE) + half) - top * current / (current + half) AS d_revenue, {learning.MARGIN}::DOUBLE * (top * (current * (0.5::DOUBLE + k * 0.05::DOUBLE)) / (current * (0.5::DOUBLE + k * 0.05::DOUBLE) + half) - top * current / (current + half)) - (current * (0.5::DOUBLE + k * 0.05::DOUBLE) - current) AS d_contribution FROM best JOIN budget_now USING (campaign_id), range(21) t(k)", "staging")
def v_what_if(s: Staging) -> DataFrame:
    """Each campaign's budget from half to half as much again, in 21 points: revenue and contribution against now."""
    m = decisions.response_curves(s).join(learning._budget_now(s), "campaign_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    budget = F.col("current") * (F.lit(0.5) + F.col("k") * F.lit(0.05))
    m = m.withColumn("budget", budget).withColumn("d_revenue", learning._revenue(F.col("budget")) - learning._revenue(F.col("current")))
    return m.select("campaign_id", "k", "budget", "d_revenue", (F.lit(learning.MARGIN) * F.col("d_revenue") - (F.col("budget") - F.col("current"))).alias("d_contribution"))


@query("SELECT user_id, count(*) AS n, max(event_type) AS top FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 50")
def o01_total_order(s: Staging) -> DataFrame:
    """A built table in the order of its key, cut for a page."""
    return s.events().groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_type").alias("top")).orderBy(F.desc("n"), "user_id").limit(50)


@query(learning._FUNNEL_SQL + "SELECT campaign_id, module, contribution FROM shares QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY offsetting OR score < 0.3, abs(contribution) DESC, score DESC, module) = 1", "staging")
def o08_leading_driver(s: Staging) -> DataFrame:
    return learning.d23_driver_ranking(s).where("rank = 1").select("campaign_id", "module", "contribution")


#: A unit after an amount and what it multiplies by.
UNITS = {"lakh": 1e5, "crore": 1e7, "thousand": 1e3, "million": 1e6}
_NUMBER = r"(?:INR |Rs\.? ?)?[0-9][0-9,]*(?:\.[0-9]+)?(?: ?(?:lakh|crore|thousand|million|%|x\b))?"


def quantities(text: Column) -> Column:
    """The amounts in a text: value and unit (inr, percent, multiple or plain). Dates (yyyy-mm-dd) are no amounts; digits may be grouped by commas."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", " "), F.lit(f"({_NUMBER})"), F.lit(1))

    def told(x: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
        times = F.lit(1.0)
        for word, by in UNITS.items():
            times = F.when(x.endswith(word), F.lit(by)).otherwise(times)
        unit = F.when(x.startswith("INR") | x.startswith("Rs"), "inr").when(x.endswith("%"), "percent").when(x.endswith("x"), "multiple").otherwise("plain")
        return F.struct((number * times).alias("value"), unit.alias("unit"))

    return F.transform(found, told)


def dates(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1)), lambda x: x.try_cast("date"))


def _sentences(s: Staging) -> DataFrame:
    """A sentence on each customer, as a narrative would put it."""
    c = s.raw("customer")
    lakh = (F.floor(F.abs("c_acctbal")) % 90 + 1).cast("string")
    return c.select("c_custkey", "c_acctbal", F.concat(F.lit("On 2001-06-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" account "), F.format_number("c_custkey", 0), F.lit(" spent INR "), lakh, F.lit(" lakh, up "), (F.col("c_custkey") % 50).cast("string"), F.lit(".5% or 1.2x")).alias("text"))


_SENTENCES = """WITH t AS (SELECT c_custkey, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 90 + 1 AS DOUBLE) AS lakh FROM customer)
"""


@query(_SENTENCES + "SELECT c_custkey, CAST(4 AS INTEGER) AS n, CAST(c_custkey AS DOUBLE) AS account, lakh * 100000.0::DOUBLE AS inr, CAST(c_custkey % 50 AS DOUBLE) + 0.5::DOUBLE AS percent, 1.2::DOUBLE AS multiple, DATE '2001-06-01' + CAST(c_custkey % 28 AS INTEGER) AS day FROM t")
def d65_number_extraction(s: Staging) -> DataFrame:
    """Amounts with units, and dates, out of a narrative."""
    df = _sentences(s).withColumns({"q": quantities(F.col("text")), "d": dates(F.col("text"))})
    of = lambda unit: F.get(F.filter("q", lambda x: x["unit"] == unit), F.lit(0))["value"]
    return df.select("c_custkey", F.size("q").alias("n"), of("plain").alias("account"), of("inr").alias("inr"), of("percent").alias("percent"), of("multiple").alias("multiple"), F.get("d", F.lit(0)).alias("day"))


@query(_SENTENCES + "SELECT c_custkey, CAST(count(*) AS BIGINT) AS numbers, CAST(count(*) FILTER (WHERE abs(v - k) <= 0.005::DOUBLE * abs(k) OR abs(v - m) <= 0.005::DOUBLE * abs(m)) AS BIGINT) AS grounded FROM (SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS k, lakh * 100000.0::DOUBLE AS m, unnest([CAST(c_custkey AS DOUBLE), lakh * 100000.0::DOUBLE, CAST(c_custkey % 50 AS DOUBLE) + 0.5::DOUBLE, 1.2::DOUBLE]) AS v FROM t) GROUP BY c_custkey")
def v_number_grounding(s: Staging) -> DataFrame:
    """How many numbers of a narrative are within half a percent of a fact that it may cite."""
    facts = F.array(F.col("c_custkey").cast("double"), (F.floor(F.abs("c_acctbal")) % 90 + 1).cast("double") * 100000.0)
    near = lambda v: F.exists("facts", lambda k: F.abs(v - k) <= F.lit(0.005) * F.abs(k))
    df = _sentences(s).withColumns({"q": quantities(F.col("text")), "facts": facts})
    return df.select("c_custkey", F.size("q").cast("long").alias("numbers"), F.size(F.filter("q", lambda x: near(x["value"]))).cast("long").alias("grounded"))


def maximum_matches(found: Column, truth: Column, slack: int) -> Column:
    """How many of two sorted arrays of days can be paired within the slack, each day once: taking both in order pairs as many as any way can."""
    steps = F.sequence(F.lit(1), F.size(found) + F.size(truth))

    def step(a: Column, _: Column) -> Column:
        gap = F.datediff(F.get(found, a["i"]), F.get(truth, a["j"]))
        hit, early, late = F.coalesce(F.abs(gap) <= slack, F.lit(False)), F.coalesce(gap < -slack, F.lit(False)), F.coalesce(gap > slack, F.lit(False))
        return F.struct((a["i"] + (hit | early).cast("int")).alias("i"), (a["j"] + (hit | late).cast("int")).alias("j"), (a["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n")), step, lambda a: a["n"])


@query(f"""WITH RECURSIVE days AS (SELECT user_id, list_sort(list(DISTINCT CAST(ts AS DATE)) FILTER (WHERE event_type = 'error')) AS f, list_sort(list(DISTINCT CAST(ts AS DATE)) FILTER (WHERE event_type = 'signup')) AS t FROM events GROUP BY user_id
), walk AS (SELECT user_id, f, t, 1 AS i, 1 AS j, 0 AS n FROM days WHERE f IS NOT NULL AND t IS NOT NULL
  UNION ALL SELECT user_id, f, t, i + CASE WHEN f[i] - t[j] <= 3 THEN 1 ELSE 0 END, j + CASE WHEN f[i] - t[j] >= -3 THEN 1 ELSE 0 END, n + CASE WHEN abs(f[i] - t[j]) <= 3 THEN 1 ELSE 0 END FROM walk WHERE i <= len(f) AND j <= len(t)
), best AS (SELECT user_id, max(n) AS n FROM walk GROUP BY user_id)
SELECT CAST((SELECT sum(n) FROM best) AS BIGINT) AS matched, (SELECT CAST(sum(coalesce(len(f), 0)) AS BIGINT) FROM days) AS found, (SELECT CAST(sum(coalesce(len(t), 0)) AS BIGINT) FROM days) AS truths""")  # fmt: skip
def d51_incident_matching(s: Staging) -> DataFrame:
    """Detections and incidents of a user paired within three days, as many as can be. A user's days are as few as the calendar's."""
    day = F.to_date("ts")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("event_type") == kind, day)))
    days = s.events().groupBy("user_id").agg(of("error").alias("f"), of("signup").alias("t"))
    told = days.select(F.when((F.size("f") > 0) & (F.size("t") > 0), maximum_matches(F.col("f"), F.col("t"), 3)).otherwise(0).alias("n"), F.size("f").alias("a"), F.size("t").alias("b"))
    return told.agg(F.sum("n").alias("matched"), F.sum("a").alias("found"), F.sum("b").alias("truths"))


@query(operations._LAGGED + """, gates AS (SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE abs(clicks - expected) <= 0.3::DOUBLE * expected) AS k FROM b WHERE n = 4 GROUP BY campaign_id)
SELECT campaign_id, n, k, round(((1.0::DOUBLE * k / n) + (1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE) / (2.0::DOUBLE * n)) / (1.0::DOUBLE + (1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE) / n) - 1.959963984540054::DOUBLE * sqrt((1.0::DOUBLE * k / n) * (1.0::DOUBLE - (1.0::DOUBLE * k / n)) / n + (1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE) / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + (1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE) / n), 9) >= 0.6 AS qualified FROM gates WHERE n >= 15""", "staging")  # fmt: skip
def d47_qualification(s: Staging) -> DataFrame:
    """A campaign's forecasts qualify where the lower Wilson bound of their hits reaches six in ten over fifteen weeks or more."""
    from millrace.functions.columns import wilson

    hit = F.abs(F.col("clicks") - F.col("expected")) <= 0.3 * F.col("expected")
    g = operations.expected_weeks(s).groupBy("campaign_id").agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("k")).where("n >= 15")
    return g.withColumn("qualified", F.round(wilson(F.col("k"), F.col("n"))[0], 9) >= 0.6)


@query(f""", u AS (SELECT campaign_id, {D('spend')} AS spend, CASE WHEN abs({D('spend')}) >= 1e-9 THEN 1.0::DOUBLE * {D('platform_revenue')} / {D('spend')} END AS roas FROM ad_daily GROUP BY campaign_id
), ranked AS (SELECT *, row_number() OVER (ORDER BY roas DESC NULLS LAST, campaign_id) AS best, row_number() OVER (ORDER BY roas NULLS FIRST, campaign_id DESC) AS worst FROM u
), now AS (SELECT campaign_id, arg_max(budget, snapshot_date) AS budget FROM budget_snapshots GROUP BY campaign_id)
SELECT a.best AS pair, b.campaign_id AS gives, a.campaign_id AS gets, least(0.2::DOUBLE * n.budget, 1000.0::DOUBLE) AS moved FROM ranked a JOIN ranked b ON a.best = b.worst JOIN now n ON n.campaign_id = b.campaign_id WHERE a.best <= 5 AND a.roas > b.roas""", "staging")  # fmt: skip
def d53_rank_strategy(s: Staging) -> DataFrame:
    """Pair moves: the best by ROAS takes from the worst, the second from the second worst, up to five pairs. Two top-k, no window over all."""
    u = s.ad_daily().groupBy("campaign_id").agg(dsum("spend").alias("spend"), dsum("platform_revenue").alias("v")).withColumn("roas", F.when(F.abs("spend") >= 1e-9, F.lit(1.0) * F.col("v") / F.col("spend")))
    best, worst = [F.desc_nulls_last("roas"), F.col("campaign_id")], [F.asc_nulls_first("roas"), F.desc("campaign_id")]
    top = u.orderBy(*best).limit(5).select(F.row_number().over(Window.orderBy(*best)).cast("long").alias("pair"), F.col("campaign_id").alias("gets"), F.col("roas").alias("high"))
    low = u.orderBy(*worst).limit(5).select(F.row_number().over(Window.orderBy(*worst)).cast("long").alias("pair"), F.col("campaign_id").alias("gives"), F.col("roas").alias("low"))
    now = r.latest_value(s.budget_snapshots(), ["campaign_id"], "snapshot_date", ["budget"]).withColumnRenamed("campaign_id", "gives")
    return top.join(low, "pair").where("high > low").join(now, "gives").select("pair", "gives", "gets", F.least(F.lit(0.2) * F.col("budget"), F.lit(1000.0)).alias("moved"))
