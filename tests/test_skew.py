"""Every registered query on tables in which one key holds a third of the rows.

The limit on rows per task is set so low that all large groups are split, and
the result must still equal the SQL on the same tables.
"""

import duckdb
import pytest

from conftest import TESTDATA, oracle_sql, queries
from millrace.operators.hot_groups import ROWS_PER_TASK_SETTING
from millrace.session import using_settings

# The events table again, with a third of the rows given to one user, most of
# them inside one hour, another third to no user at all, and whole seconds as
# times, so that many rows tie.
EVENTS = """
    SELECT event_id,
           date_trunc('second', CASE WHEN event_id % 3 = 0 AND event_id % 5 > 0
                THEN TIMESTAMP '2024-01-10 08:00:00' + to_seconds(event_id % 3600)
                ELSE ts END) AS ts,
           CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN user_id ELSE NULL END AS user_id,
           event_type, value, props
    FROM '{source}/events.parquet'
"""
ORDERS = """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 7 ELSE o_custkey END AS o_custkey,
           o_orderstatus, o_totalprice, o_orderdate,
           CASE o_orderkey % 3 WHEN 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
    FROM '{source}/orders.parquet'
"""
LINEITEM = """
    SELECT * REPLACE (CASE l_partkey % 3 WHEN 0 THEN 0 ELSE l_orderkey END AS l_orderkey,
                      CASE l_linenumber % 3 WHEN 0 THEN 1 ELSE l_partkey END AS l_partkey)
    FROM '{source}/lineitem.parquet'
"""
# A third of the pages are on one host, and another third have no address.
PAGES = """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://hot.example/dir/' || page_id WHEN 1 THEN url END AS url,
           html || '<a href="//hot.example/up/../x?' || page_id % 2 || '">x</a>' AS html
    FROM '{source}/pages.parquet'
"""


@pytest.fixture(scope="session")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    source = TESTDATA / "sf0.001"
    changed = {"events": EVENTS, "orders": ORDERS, "lineitem": LINEITEM, "pages": PAGES}
    for table in ("region", "nation", "customer", "supplier", "part", *changed):
        sql = changed.get(table, "SELECT * FROM '{source}/" + table + ".parquet'")
        duckdb.sql(f"COPY ({sql.format(source=source)}) TO '{folder}/{table}.parquet'")
    return folder


# The pairs of the stream with the no-user rows are checked in test_streaming.
NAMES = sorted(oracle_sql())


@pytest.mark.parametrize("limit", [20, 150])
@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream_")])
def test_split_groups_change_nothing(spark, duck, rows, skewed, name, limit):
    with using_settings(spark, {ROWS_PER_TASK_SETTING: str(limit)}):
        result = rows(queries()[name](spark, str(skewed)))
    expected = duck(oracle_sql()[name], skewed)
    assert len(result[1]) == len(expected[1])
    assert result == expected


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith("stream_")])
def test_skewed_stream(spark, duck, rows, skewed, name):
    assert rows(queries()[name](spark, str(skewed))) == duck(oracle_sql()[name], skewed)


def test_a_customer_with_a_third_of_the_orders_is_split(spark, skewed):
    """The join on customers is split at run time; its partitions are sized by
    bytes, so the sizes are set to suit these small tables."""
    sizes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    with using_settings(spark, sizes):
        df = queries()["revenue_by_region_year"](spark, str(skewed))
        df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true) [o_custkey" in plan
