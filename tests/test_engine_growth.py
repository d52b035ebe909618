"""What the engine's shared steps may cost as lines grow, and their results on odd inputs."""

import duckdb
import pytest

import __spark_entry__
from millrace.plans import canonical, detection, marts, prediction
from millrace.sources.testdata import Staging

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events".split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joined(spark):
    """Plans as over tables too large for a broadcast by size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines with later versions, of which some lead to no part or no order; orders without lines."""
    at = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t}_0 AS SELECT * FROM '{SF}/{t}.parquet'")
    lines = """SELECT * FROM lineitem_0 UNION ALL SELECT * REPLACE (l_shipdate + INTERVAL 3 DAY AS l_shipdate, l_quantity + 1 AS l_quantity, l_partkey + CASE WHEN l_orderkey % 2 = 0 THEN 10000000 ELSE 0 END AS l_partkey) FROM lineitem_0 WHERE l_orderkey % 3 = 0
      UNION ALL SELECT * REPLACE (l_orderkey + 10000000 AS l_orderkey) FROM lineitem_0 WHERE l_orderkey % 5 = 0 UNION ALL SELECT * REPLACE (NULL AS l_orderkey) FROM lineitem_0 WHERE l_orderkey % 7 = 0"""
    for t in TABLES:
        con.execute(f"COPY ({lines if t == 'lineitem' else f'SELECT * FROM {t}_0'}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return con, str(at)


def equal(spark, odd, name):
    con, at = odd
    got, found = __spark_entry__.queries()[name](spark, at), con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    flat = lambda rows: sorted(tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x).replace(" 00:00:00", "") for x in r) for r in rows)
    assert flat(map(tuple, got.select(*columns).collect())) == flat(found.fetchall())


def test_order_lines_are_sorted_once_by_order(joined):
    """A second sort of the same lines doubles what a task holds."""
    p = plan(Staging(joined, SF)._order_lines())
    assert p.count("Sort [l_orderkey") == 1 and p.count("Exchange hashpartitioning(l_orderkey") == 1


@pytest.mark.parametrize("name", ["p01_as_of_filter", "p03_generated_case", "j11_anti_by_left_join", "w07_top_categories"])
def test_order_lines_of_odd_versions(spark, odd, name):
    equal(spark, odd, name)


def test_order_items_are_laid_out_once(joined):
    """Lines meet refunds, SKUs, rates and platforms in one layout, and are not laid out again to be written."""
    p = plan(canonical._order_items(Staging(joined, SF)))
    assert p.count("Exchange hashpartitioning(order_id") == 0 and p.count("Exchange hashpartitioning(utm_campaign") == 0
    held = []
    s = Staging(joined, SF)
    s.held = lambda name, build, *order: held.append((name, order)) or build()
    canonical.order_items(s)
    assert ("order-items", ()) in held


@pytest.mark.parametrize("name", ["order_items", "f_unit_economics", "sku_return_rates", "campaign_sku"])
def test_order_items_of_odd_versions(spark, odd, name):
    equal(spark, odd, name)


@pytest.fixture
def built(spark):
    """Staging whose held tables are only planned, and the names of those that were asked for."""
    s, names = Staging(spark, SF), []
    s.held = lambda name, build, *order: names.append(name) or build()
    return s, names


def test_days_of_the_brand_are_held_and_expand_no_lines(built):
    s, names = built
    assert "Expand" not in plan(marts.brand_daily(s)) and "brand-daily" in names


def test_ad_sets_need_no_join_of_lines(joined, built):
    p = plan(marts.adset_daily(built[0]))
    assert "Exchange hashpartitioning(ad_id" not in p and "Expand" not in p


def test_stock_of_today_is_found_without_a_sort(spark):
    p = plan(canonical.inventory_now(Staging(spark, SF)))
    assert "Sort" not in p and "Exchange" not in p


def test_stock_is_laid_out_once(joined):
    assert plan(Staging(joined, SF)._stock_daily()).count("Exchange") == 1


def test_health_counts_lines_before_they_meet_campaigns(joined, built):
    s, names = built
    s.order_lines, s.ad_daily = Staging(joined, SF).order_lines, Staging(joined, SF).ad_daily
    p = plan(marts.data_health(s))
    assert "data-health" in names and "Exchange hashpartitioning(date" in p and "Exchange hashpartitioning(utm_campaign#" in p
    assert p.index("Exchange hashpartitioning(utm_campaign#") < p.index("Exchange hashpartitioning(date", p.index("Exchange hashpartitioning(utm_campaign#"))  # the plan's lower part stands below


def test_calendars_of_skus_are_not_joined(built):
    assert "Generate explode" not in plan(detection.sku_series(built[0]))


def test_organic_sales_are_read_from_the_first_day_of_a_span_on(spark):
    p = plan(prediction.unit_days(Staging(spark, SF)))
    assert "GreaterThanOrEqual(date" in p


@pytest.mark.parametrize("name", ["adset_daily", "brand_daily", "channel_daily", "v_inventory_actions", "j25_inventory_page", "d60_realised", "inventory_daily", "data_health", "j23_forecast_and_actual"])
def test_marts_and_stock_of_odd_versions(spark, odd, name):
    equal(spark, odd, name)
