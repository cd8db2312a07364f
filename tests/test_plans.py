"""The shape of physical plans, as they are for tables too large to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA, queries
from millrace.operators.hot_groups import ROWS_PER_TASK_SETTING
from millrace.operators.ranking import top_per_group
from millrace.session import using_settings
from millrace.sources.tables import in_years, read_table, write_by_year

FOLDER = str(TESTDATA / "sf0.01")
BATCH = sorted(name for name in queries() if not name.startswith("stream_"))


def plan(spark, name):
    with using_settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = queries()[name](spark, FOLDER)
        return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange (hash|range|single)", text, re.I))


@pytest.mark.parametrize("name", BATCH)
def test_no_query_pairs_everything_or_gathers_rows_in_one_task(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "NestedLoop", "SinglePartition", "Python", "ArrowEval"):
        assert operator not in text


@pytest.mark.parametrize("name", BATCH)
def test_scans_read_only_columns_that_are_used(spark, name):
    text = plan(spark, name)
    widths = {"lineitem": 11, "orders": 6, "events": 6, "customer": 5}
    for columns, table in re.findall(r"FileScan parquet \[([^\]]*)\].*?/(\w+)\.parquet", text):
        if table in widths:
            assert len(columns.split(",")) < widths[table]


@pytest.mark.parametrize(
    "name, most",
    [
        ("returned_lines", 0),
        ("revenue_by_region_year", 9),
        ("orders_by_line_count", 3),
        ("orders_with_returns", 3),
        ("orders_without_lines", 2),
        ("revenue_rollup", 2),
        ("top_orders_per_customer", 1),
        ("buyers_either_year", 1),
        ("buyers_both_years", 1),
        ("buyers_first_year_only", 1),
        ("dropped_buying", 2),
        ("users_per_day", 2),
        ("users_approximately", 3),
        ("running_value", 1),
        ("moving_value_by_rows", 1),
        ("moving_value_by_time", 1),
        ("totals_by_property", 1),
        ("purchases_near_clicks", 2),
        ("purchases_around_clicks", 1),
        ("last_click_before_purchase", 1),
        ("events_by_hour", 1),
        ("events_by_sliding_hour", 2),
        ("user_sessions", 2),
    ],
)
def test_shuffles_are_few(spark, name, most):
    assert shuffles(plan(spark, name)) <= most


def test_filters_reach_the_scan(spark):
    for name in ("returned_lines", "revenue_by_region_year", "orders_with_returns"):
        assert "EqualTo(l_returnflag,R)" in plan(spark, name)
    assert "EqualTo(event_type,purchase)" in plan(spark, "last_click_before_purchase")


def test_top_rows_are_cut_before_the_shuffle(spark):
    text = plan(spark, "top_orders_per_customer")
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")
    assert "Partial" in text[text.index("Exchange"):]


@pytest.mark.parametrize(
    "name", ["orders_by_line_count", "revenue_by_part_sets", "revenue_by_region_year"]
)
def test_lines_are_added_up_before_they_travel(spark, name):
    text = plan(spark, name)
    scan = text.index("lineitem.parquet")
    assert text.rindex("partial_", 0, scan) > text.rindex("Exchange", 0, scan)


def test_more_top_rows_than_spark_pushes_are_cut_in_parts(spark):
    df = spark.range(10_000).select((F.col("id") % 1).alias("key"), "id")
    cut = top_per_group(df, ["key"], [F.col("id")], 1001)
    assert [r.id for r in cut.orderBy("rank").collect()] == list(range(1001))
    text = cut._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in text and "part_of_group" in text


def test_split_plans_pair_nothing_and_use_no_python(spark):
    names = ["running_value", "moving_value_by_rows", "moving_value_by_time", "purchases_near_clicks"]
    with using_settings(spark, {ROWS_PER_TASK_SETTING: "20"}):
        for name in [*names, "purchases_around_clicks", "last_click_before_purchase"]:
            text = plan(spark, name)
            for operator in ("CartesianProduct", "NestedLoop", "SinglePartition", "Python", "BroadcastExchange"):
                assert operator not in text, (name, operator)


def test_sixth_event_type_is_counted(spark, tmp_path):
    folder = str(tmp_path)
    events = read_table(spark, FOLDER, "events")
    changed = events.withColumn(
        "event_type", F.when(F.col("event_id") % 10 == 0, "refund").when(F.col("event_id") % 10 == 1, None)
        .otherwise(F.col("event_type"))
    )
    changed.write.parquet(f"{folder}/events.parquet")
    row = queries()["events_by_day_pivoted"](spark, folder).agg(F.sum("other")).first()
    assert row[0] == changed.where("event_type = 'refund' or event_type is null").count() > 0


def test_years_not_asked_for_are_not_read(spark, tmp_path, rows):
    """Tables in folders by year give the same rows, from the folders of these years alone."""
    for table, time in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        write_by_year(read_table(spark, FOLDER, table), time, f"{tmp_path}/{table}.parquet")
    for name, years in (("returned_lines", {1997, 1998, 1999}), ("buyers_either_year", {1996, 1997})):
        found = queries()[name](spark, str(tmp_path))
        assert rows(found) == rows(queries()[name](spark, FOLDER))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(" in plan and "_year#" in plan
    lines = in_years(read_table(spark, str(tmp_path), "lineitem"), "l_shipdate", 1997, 2000)
    files = {r[0].split("l_shipdate_year=")[1][:4] for r in lines.select(F.input_file_name()).collect()}
    assert files == {"1997", "1998", "1999"}
