"""Queries over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exact import scaled
from ..functions.time import utc_day, zone_free
from ..operators.asof import asof_join
from ..operators.frequent import frequent_keys
from ..operators.intervals import interval_pairs, interval_totals
from ..operators.json_shapes import kinds_by_path
from ..operators.moving import moving_totals_by_rows, moving_totals_by_time
from ..operators.running import running_totals
from ..operators.time_windows import session_totals, sliding_totals, tumbling_totals
from ..sources.tables import read_table

# The event types that have a column of their own.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

HALF_HOUR = 30 * 60
HOUR = 60 * 60
DAY = 24 * HOUR


def with_zone_free(df: DataFrame, *columns: str) -> DataFrame:
    """Give event times back in the form they are stored in."""
    return df.withColumns({c: zone_free(c) for c in columns})


def _day() -> Column:
    return utc_day("ts").alias("day")


def _count_and_cents() -> dict[str, Column]:
    return {"n_events": F.lit(1), "cents": scaled("value")}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def users_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by day and event type, counted exactly."""
    result = (
        _events(spark, sf_dir)
        .groupBy(_day(), "event_type")
        .agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_events"))
    )
    return with_zone_free(result, "day")


def users_approximately(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by event type, estimated from daily sketches of 2^14 registers.

    A day's sketch can be kept and merged with those of any other days, which no
    count can. Up to about 1,500 users an estimate is exact to within rounding; beyond
    that its standard error is below 1 %.
    """
    daily = _events(spark, sf_dir).groupBy("event_type", _day()).agg(
        F.hll_sketch_agg("user_id", 14).alias("sketch")
    )
    return daily.groupBy("event_type").agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n_users")
    )


def frequent_kinds_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event type and properties that two in a thousand events or more have."""
    return frequent_keys(_events(spark, sf_dir), ["event_type", "props"], 0.002, "n_events")


def running_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's number of events and value so far."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    result = running_totals(events, ["user_id"], ["ts", "event_id"], _count_and_cents()).drop("value")
    return with_zone_free(result, "ts")


def moving_value_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value of its user's last ten events."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    result = moving_totals_by_rows(
        events, ["user_id"], ["ts", "event_id"], _count_and_cents(), rows=10
    ).drop("value")
    return with_zone_free(result, "ts")


def moving_value_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value of its user's events of the last 24 hours."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    result = moving_totals_by_time(
        events, ["user_id"], "ts", "event_id", _count_and_cents(), seconds=DAY
    ).drop("value")
    return with_zone_free(result, "ts")


def events_by_day_pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day: a column for each listed type, and one for all other types and none."""
    listed = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise("other")
    result = (
        _events(spark, sf_dir)
        .withColumn("event_type", listed)
        .groupBy(_day())
        .pivot("event_type", [*EVENT_TYPES, "other"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
    return with_zone_free(result, "day")


def totals_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by type and the number held in the JSON properties."""
    events = _events(spark, sf_dir)
    return (
        events.groupBy("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(scaled("value")).alias("cents"))
    )


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == "click")
        .select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_at"))
    )


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == "purchase")
        .select(
            "user_id",
            F.col("event_id").alias("purchase_id"),
            F.col("ts").alias("purchased_at"),
            scaled("value").alias("purchase_cents"),
        )
    )


def kinds_of_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and kinds of all properties, found without knowing them."""
    return kinds_by_path(_events(spark, sf_dir), "props")


def purchases_near_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a click and a purchase by the same user within the hour after it."""
    result = interval_pairs(
        _clicks(spark, sf_dir), _purchases(spark, sf_dir), ["user_id"],
        "click_at", "purchased_at", "click_id", "purchase_id", before=0, after=HOUR,
    )
    return with_zone_free(result, "click_at", "purchased_at")


def purchases_around_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the purchases of its user from an hour before to a day after."""
    result = interval_totals(
        _clicks(spark, sf_dir), _purchases(spark, sf_dir), ["user_id"],
        "click_at", "purchased_at", "click_id", "purchase_id", before=HOUR, after=DAY,
        measures={"n_purchases": F.lit(1), "cents": F.col("purchase_cents")},
    )
    return with_zone_free(result, "click_at")


def last_click_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest click up to then."""
    result = asof_join(
        _purchases(spark, sf_dir), _clicks(spark, sf_dir), ["user_id"],
        "purchased_at", "click_at", "purchase_id", "click_id",
    )
    return with_zone_free(result, "purchased_at", "click_at")


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by hour and type."""
    result = tumbling_totals(
        _events(spark, sf_dir), "ts", "1 hour", ["event_type"], _count_and_cents()
    )
    return with_zone_free(result, "window_start", "window_end")


def events_by_sliding_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by type in hours that start every 15 minutes."""
    result = sliding_totals(
        _events(spark, sf_dir), "ts", "1 hour", "15 minutes", ["event_type"], _count_and_cents()
    )
    return with_zone_free(result, "window_start", "window_end")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which end after half an hour without events."""
    result = session_totals(_events(spark, sf_dir), ["user_id"], "ts", HALF_HOUR, _count_and_cents())
    return with_zone_free(result, "session_start", "session_end")
