"""Operators on small made-up rows, against brute force, and across time zones."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import TESTDATA, oracle_sql, queries
from millrace.functions.exact import scaled, sum_parts, total
from millrace.functions.time import zone_free
from millrace.operators.asof import asof_join
from millrace.operators.hot_groups import ROWS_PER_TASK_SETTING, hot_groups
from millrace.operators.intervals import interval_pairs, interval_totals
from millrace.operators.moving import moving_totals_by_rows, moving_totals_by_time
from millrace.operators.running import running_totals
from millrace.operators.sets import bag_except, bag_intersect, set_except, set_intersect
from millrace.operators.time_windows import session_totals, sliding_totals
from millrace.session import using_settings

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MINUTES = st.one_of(st.integers(0, 90), st.integers(0, 90), st.none())
KEYS = st.sampled_from(["a", "a", "b", None])
SIDES = st.lists(st.tuples(KEYS, MINUTES), max_size=25)
LIMITS = st.sampled_from(["1", "4", "1000"])
few = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def table(spark, side, prefix):
    data = [
        (k, i, None if m is None else START + timedelta(minutes=m), i + 1)
        for i, (k, m) in enumerate(side)
    ]
    schema = f"key string, {prefix}_id bigint, {prefix}_at timestamp, {prefix}_n bigint"
    return spark.createDataFrame(data, schema)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def matches(left, right, before, after):
    """Index pairs of rows with equal keys and times within the interval."""
    return [
        (i, j)
        for i, (lk, lm) in enumerate(left)
        for j, (rk, rm) in enumerate(right)
        if lk is not None and lk == rk and None not in (lm, rm)
        and lm - before <= rm <= lm + after
    ]


@few
@given(left=SIDES, right=SIDES, limit=LIMITS, before=st.integers(0, 20), after=st.integers(0, 20))
def test_interval_joins(spark, left, right, limit, before, after):
    with using_settings(spark, {ROWS_PER_TASK_SETTING: limit}):
        sides = [table(spark, left, "l"), table(spark, right, "r")]
        names = [["key"], "l_at", "r_at", "l_id", "r_id", before * 60, after * 60]
        pairs = collected(interval_pairs(*sides, *names), "l_id", "r_id")
        totals = interval_totals(*sides, *names, {"n": F.lit(1), "sum": F.col("r_n")})
        found = collected(totals, "l_id", "n", "sum")
    expected = matches(left, right, before, after)
    assert pairs == sorted(expected, key=repr)
    per_left = [[j for i, j in expected if i == row] for row in range(len(left))]
    assert found == sorted(
        ((i, len(js), sum(j + 1 for j in js)) for i, js in enumerate(per_left)), key=repr
    )


@few
@given(left=SIDES, right=SIDES, limit=LIMITS)
def test_asof_join(spark, left, right, limit):
    with using_settings(spark, {ROWS_PER_TASK_SETTING: limit}):
        joined = asof_join(
            table(spark, left, "l"), table(spark, right, "r"), ["key"],
            "l_at", "r_at", "l_id", "r_id",
        )
        found = collected(joined, "l_id", "r_id")
    expected = []
    for i, (key, minute) in enumerate(left):
        earlier = [
            (m, j)
            for j, (k, m) in enumerate(right)
            if key and k == key and None not in (m, minute) and m <= minute
        ]
        expected.append((i, max(earlier)[1] if earlier else None))
    assert found == sorted(expected, key=repr)


@few
@given(side=SIDES, limit=LIMITS, rows=st.integers(1, 6), minutes=st.integers(0, 30), gap=st.integers(0, 3))
def test_running_and_moving_totals(spark, side, limit, rows, minutes, gap):
    """Rows whose number leaves `gap` when divided by three have no value; 3 is none of them."""

    def added(numbers):
        values = [n for n in numbers if n % 3 != gap]
        return sum(values) if values else None

    with using_settings(spark, {ROWS_PER_TASK_SETTING: limit}):
        df = table(spark, side, "l")
        measures = {"sum": F.when(F.col("l_n") % 3 != gap, F.col("l_n"))}
        order = ["l_at", "l_id"]
        running = collected(running_totals(df, ["key"], order, measures), "l_id", "sum")
        by_rows = collected(
            moving_totals_by_rows(df, ["key"], order, measures, rows), "l_id", "sum"
        )
        by_time = collected(
            moving_totals_by_time(df, ["key"], "l_at", "l_id", measures, minutes * 60),
            "l_id", "sum",
        )
    expected = {"running": [], "rows": [], "time": []}
    # Spark sorts nulls first.
    times = [(k, -1 if m is None else m) for k, m in side]
    for i, (key, minute) in enumerate(times):
        group = sorted((m, j) for j, (k, m) in enumerate(times) if k == key)
        to_here = [j + 1 for m, j in group if (m, j) <= (minute, i)]
        expected["running"].append((i, added(to_here)))
        expected["rows"].append((i, added(to_here[-rows:])))
        first = minute if minute < 0 else max(minute - minutes, 0)
        recent = [j + 1 for m, j in group if first <= m <= minute]
        expected["time"].append((i, added(recent)))
    assert running == sorted(expected["running"], key=repr)
    assert by_rows == sorted(expected["rows"], key=repr)
    assert by_time == sorted(expected["time"], key=repr)


BAG = st.lists(st.sampled_from([1, 1, 1, 2, 3, None]), max_size=20)


@few
@given(left=BAG, right=BAG)
def test_bags_and_sets(spark, left, right):
    sides = [spark.createDataFrame([(v,) for v in side], "v int") for side in (left, right)]

    def values(df):
        return sorted((r.v for r in df.collect()), key=repr)

    def copies(count):
        return sorted((v for v in {*left, *right} for _ in range(count(v))), key=repr)

    assert values(set_intersect(*sides)) == sorted({*left} & {*right}, key=repr)
    assert values(set_except(*sides)) == sorted({*left} - {*right}, key=repr)
    assert values(bag_intersect(*sides, copies_per_piece=2)) == copies(
        lambda v: min(left.count(v), right.count(v))
    )
    assert values(bag_except(*sides, copies_per_piece=2)) == copies(
        lambda v: max(left.count(v) - right.count(v), 0)
    )


@pytest.mark.parametrize("gap_minutes, sessions", [(9, 4), (10, 2), (30, 1)])
def test_sessions_end_after_more_than_the_gap(spark, gap_minutes, sessions):
    df = table(spark, [("a", 0), ("a", 10), ("a", 25), ("a", 35)], "l")
    found = session_totals(df, ["key"], "l_at", gap_minutes * 60, {"n": F.lit(1)})
    assert found.count() == sessions
    native = df.groupBy("key", F.session_window("l_at", f"{gap_minutes} minutes").alias("s")).agg(
        F.count(F.lit(1)).alias("n")
    )
    assert collected(found, "session_start", "session_end", "n") == collected(
        native, "s.start", "s.end", "n"
    )


def test_sums_beyond_64_bits_are_exact(spark):
    cents = 9_000_000_000_000_000_123
    df = spark.createDataFrame([(cents,)] * 5 + [(-7,)], "cents bigint")
    parts = df.agg(*sum_parts(F.col("cents"), "sum"))
    assert parts.select(total("sum", 0).alias("sum")).first()[0] == float(5 * cents - 7)


def test_scaling_gives_the_nearest_whole_number(spark):
    amounts = [random.Random(1).randrange(-10**9, 10**9) for _ in range(2000)]
    df = spark.createDataFrame([(a, a / 100) for a in amounts], "cents bigint, amount double")
    assert df.where(scaled("amount") != F.col("cents")).count() == 0


def test_hot_groups_lists_large_groups_only(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [(None,)] * 4, "key string")
    with using_settings(spark, {ROWS_PER_TASK_SETTING: "3"}):
        hot = hot_groups(df, ["key"])
    assert {r.key for r in hot.keys.collect()} == {"a", None}
    assert hot.rows == 9
    assert hot_groups(df, ["key"]) is None


def test_large_tables_are_estimated_from_a_sample(spark):
    key = F.when(F.col("id") < 100_000, 0).otherwise(F.col("id") % 50_000)
    df = spark.range(300_000).select(key.alias("key"))
    hot = hot_groups(df, ["key"], most=20_000)
    assert [r.key for r in hot.keys.collect()] == [0]
    assert abs(hot.rows - 100_000) < 10_000


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_session_zone(spark, duck, rows, zone):
    names = [
        "users_per_day", "events_by_day_pivoted", "events_by_sliding_hour", "user_sessions",
        "last_click_before_purchase", "moving_value_by_time", "stream_events_by_hour",
        "revenue_rollup", "returned_lines",
    ]
    folder = TESTDATA / "sf0.001"
    with using_settings(spark, {"spark.sql.session.timeZone": zone}):
        for name in names:
            assert rows(queries()[name](spark, str(folder))) == duck(oracle_sql()[name], folder), name


def test_zone_free_keeps_times_a_zone_skips(spark):
    with using_settings(spark, {"spark.sql.session.timeZone": "America/New_York"}):
        skipped = spark.sql("SELECT timestamp '2024-03-10 02:30:00Z' AS at")
        text = skipped.select(zone_free("at").cast("string")).first()[0]
    assert text == "2024-03-10 02:30:00"


@pytest.mark.parametrize("limit", ["1", "4", "1000"])
def test_repeated_ids_do_not_add_up(spark, limit):
    side = [("a", m) for m in (0, 5, 5, 30)]
    left = table(spark, side, "l").withColumn("l_id", F.lit(7).cast("bigint"))
    right = table(spark, side, "r").withColumn("r_id", F.lit(7).cast("bigint"))
    with using_settings(spark, {ROWS_PER_TASK_SETTING: limit}):
        totals = interval_totals(
            left, right, ["key"], "l_at", "r_at", "l_id", "r_id", 0, 600, {"n": F.lit(1)}
        )
        assert collected(totals, "l_n", "n") == [(1, 3), (2, 2), (3, 2), (4, 1)]
        moving = moving_totals_by_time(left, ["key"], "l_at", "l_id", {"n": F.lit(1)}, 600)
        assert collected(moving, "l_n", "n") == [(1, 1), (2, 3), (3, 3), (4, 1)]


def test_sliding_windows_need_whole_panes(spark):
    df = table(spark, [("a", m) for m in range(60)], "l")
    with pytest.raises(ValueError):
        sliding_totals(df, "l_at", "60 minutes", "25 minutes", ["key"], {"n": F.lit(1)})
    found = sliding_totals(df, "l_at", "1 hour", "15 minutes", ["key"], {"n": F.lit(1)})
    native = df.groupBy(F.window("l_at", "1 hour", "15 minutes").alias("w"), "key").count()
    assert collected(found, "window_start", "n") == collected(native, "w.start", "count")


@pytest.mark.parametrize("limit", ["2", "1000"])
def test_asof_join_of_wide_rows(spark, limit):
    left = table(spark, [("a", m) for m in range(0, 40, 4)], "l")
    right = table(spark, [("a", m) for m in range(0, 40, 8)], "r").withColumn("wide", F.repeat(F.lit("x"), 10_000))
    with using_settings(spark, {ROWS_PER_TASK_SETTING: limit, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        joined = asof_join(left, right, ["key"], "l_at", "r_at", "l_id", "r_id")
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert collected(joined.withColumn("w", F.length("wide")), "l_id", "r_id", "w") == [
            (i, i // 2, 10_000) for i in range(10)
        ]
