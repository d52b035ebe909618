"""One SELECT by somebody else over given tables: Spark parses it, an allow-list judges the parsed plan, and the text runs as it stands in a session that holds those tables as its only views.

What is not listed is refused: nodes of the plan (so commands, scripts, generators, table functions, hints, time travel and other dialects' extensions), functions (so reflection, files, random
numbers, and all that blow up a row), and relations that are neither a given table nor a WITH name in scope there. Comments and quoted names are Spark's to read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Nodes of a parsed plan that read and reckon.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedHaving UnresolvedWith WithWindowDefinition "
    "OneRowRelation LocalRelation Pivot Unpivot UnresolvedInlineTable AsOfJoin".split()
)
#: Classes that the parser leaves in a place of an expression until names are known.
OPEN = frozenset("UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedFunction UnresolvedExtractValue UnresolvedOrdinal UnresolvedNamedLambdaVariable UnresolvedWindowExpression UnresolvedInlineTable".split())
#: Functions.
FUNCTIONS = frozenset(
    "abs acos add_months between div || & | ^ ~ + - * / % = == < > <= >= <> != <=> aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_size array_sort ascii asin atan atan2 avg bigint bit_length bool_and bool_or "
    "boolean bround cardinality cbrt ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date date date_add date_diff "
    "date_format date_from_unix_date date_part date_sub date_trunc datediff datepart day dayofmonth dayofweek dayofyear decimal degrees dense_rank double element_at endswith equal_null every exists exp extract filter find_in_set "
    "first first_value flatten float floor forall from_unixtime get greatest histogram_numeric hour if ifnull ilike initcap instr int isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left len length "
    "like ln locate log log10 log1p log2 lower ltrim make_date map map_keys map_values max max_by mean median min min_by minute mod mode month months_between named_struct nanvl negative next_day not now nth_value ntile nullif nvl "
    "nvl2 octet_length percent_rank percentile percentile_approx percentile_cont percentile_disc pmod position positive pow power quarter radians rank regexp_count regexp_extract regexp_like regexp_replace regexp_substr "
    "regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope replace reverse right rlike round row_number rtrim second sign signum sin size skewness slice smallint some sort_array split split_part sqrt startswith std "
    "stddev stddev_pop stddev_samp string struct substr substring substring_index sum tan tanh timestamp tinyint to_date to_timestamp transform translate trim trunc try_add try_avg try_cast try_divide try_multiply try_subtract "
    "try_sum ucase unix_date unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket year zip_with".split()
)


def _items(seq) -> Iterator:
    return (seq.apply(k) for k in range(seq.size()))


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _reasons(plan, tables: frozenset[str], scope: frozenset[str]) -> Iterator[str]:
    """Why a parsed plan is refused; scope: names that WITH gives where it stands."""
    kind = _name(plan)
    if kind not in NODES:
        yield f"{kind} is not allowed"
        return
    if kind == "UnresolvedRelation":
        name = [str(x) for x in _items(plan.multipartIdentifier())]
        if plan.isStreaming() or len(name) != 1 or name[0].lower() not in tables | scope:
            yield f"unknown table {'.'.join(name)}"
        return
    if kind == "UnresolvedWith":
        if plan.allowRecursion():
            yield "recursion is not allowed"
        for pair in _items(plan.cteRelations()):
            yield from _reasons(pair._2(), tables, scope)
            scope = scope | {str(pair._1()).lower()}
        yield from _reasons(plan.child(), tables, scope)
        return
    for e in _items(plan.expressions()):
        yield from _faults(e, tables, scope)
    for child in _items(plan.children()):
        yield from _reasons(child, tables, scope)


def _faults(e, tables: frozenset[str], scope: frozenset[str]) -> Iterator[str]:
    """Why an expression is refused, subqueries included."""
    kind, package = _name(e), e.getClass().getPackage().getName()
    if package != "org.apache.spark.sql.catalyst.expressions" and not package.startswith("org.apache.spark.sql.catalyst.expressions.") and kind not in OPEN:
        yield f"{kind} is not allowed"
        return
    if kind == "UnresolvedFunction":
        name = ".".join(str(x) for x in _items(e.nameParts()))
        if name.lower() not in FUNCTIONS:
            yield f"function {name} is not allowed"
    if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        yield from _reasons(e.plan(), tables, scope)
    if kind == "InSubquery":
        yield from _reasons(e.query().plan(), tables, scope)
    for child in _items(e.children()):
        yield from _faults(child, tables, scope)


def judged(spark: SparkSession, text: str, tables: list[str]) -> list[str]:
    """Why a text is refused; nothing for one that may run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # Spark's own account of what does not parse
        return [f"not one query: {str(e).strip().splitlines()[0]}"]
    return list(dict.fromkeys(_reasons(plan, frozenset(t.lower() for t in tables), frozenset())))


def guarded_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int = 500) -> tuple[DataFrame, list[str]]:
    """The rows of one SELECT over the given tables, at most limit + 1 (one more tells the caller that some are missing); or an empty frame and why it was refused."""
    text = text.strip().rstrip(";")
    refused = lambda why: (spark.createDataFrame([], "refused string"), why)
    if why := judged(spark, text, list(tables)):
        return refused(why)
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for name, df in tables.items():
        spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical()).createOrReplaceTempView(name)
    try:
        found = own.sql(text)
        names = [c.lower() for c in found.columns]
        return found.toDF(*[c if names.count(c.lower()) == 1 else f"{c}_{names[: k + 1].count(c.lower())}" for k, c in enumerate(found.columns)]).limit(limit + 1), []
    except (AnalysisException, ParseException) as e:
        return refused([str(e).splitlines()[0]])
