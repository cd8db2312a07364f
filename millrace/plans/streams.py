"""Queries over events read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exact import scaled
from ..sources.tables import stream_table
from ..streaming.funnel import funnel
from ..streaming.interval_join import interval_pairs
from ..streaming.repeats import without_repeats
from ..streaming.runner import LAST_PANDAS_INSTANT, closable, drained
from ..streaming.sessions import session_totals
from ..streaming.windows import tumbling_totals
from .events import DAY, HOUR, with_zone_free

DELAY = "10 minutes"
# Bounds a micro-batch, so that watermarks move and state is let go as a stream is
# read. Files must arrive in the order of their times, to within the delay.
FILES_PER_BATCH = 8


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_table(spark, sf_dir, "events", FILES_PER_BATCH)


def stream_events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by hour and type."""
    events, closing = closable(_stream(spark, sf_dir), "ts")
    totals = tumbling_totals(
        events, "ts", DELAY, "1 hour", ["event_type"],
        {"n_events": F.lit(1), "cents": scaled("value")},
    )
    hours = drained(totals, "events-by-hour", closing=closing)
    return with_zone_free(hours, "window_start", "window_end")


def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are all delivered twice, once each."""
    events = _stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    once = without_repeats(events.unionByName(events), ["event_id"], "ts", DELAY)
    return with_zone_free(drained(once, "without-repeats"), "ts")


def stream_purchases_near_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a click and a purchase by the same user within the hour after it."""
    clicks = (
        _stream(spark, sf_dir)
        .where(F.col("event_type") == "click")
        .select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_at"))
    )
    purchases = (
        _stream(spark, sf_dir)
        .where(F.col("event_type") == "purchase")
        .select(
            "user_id",
            F.col("event_id").alias("purchase_id"),
            F.col("ts").alias("purchased_at"),
            scaled("value").alias("purchase_cents"),
        )
    )
    pairs = interval_pairs(
        clicks, purchases, ["user_id"], "click_at", "purchased_at", "click_id",
        before=0, after=HOUR, left_delay=DELAY, right_delay=DELAY, salts=4,
    )
    return with_zone_free(drained(pairs, "purchases-near-clicks"), "click_at", "purchased_at")


def stream_user_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user got before half an hour of silence: `converted` when a
    purchase followed a click, `clicked`, or `idle`."""
    events, closing = closable(_stream(spark, sf_dir), "ts")
    clicked_at = F.min(F.when(F.col("event_type") == "click", F.col("ts")))
    bought_at = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    sessions = session_totals(
        events, "ts", DELAY, "30 minutes", ["user_id"],
        {
            "n_events": F.count(F.lit(1)),
            "cents": F.sum(scaled("value")),
            "clicked_at": clicked_at,
            "bought_at": bought_at,
        },
    )
    progress = (
        F.when(F.col("clicked_at") < F.col("bought_at"), "converted")
        .when(F.col("clicked_at").isNotNull(), "clicked")
        .otherwise("idle")
    )
    reached = sessions.select(
        "user_id", "session_start", "session_end", "n_events", "cents", progress.alias("progress")
    )
    sessions = drained(reached, "user-progress", closing=closing)
    return with_zone_free(sessions, "session_start", "session_end")


def stream_purchase_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each user to go from a view over a click to a purchase within two days."""
    events, closing = closable(_stream(spark, sf_dir), "ts", LAST_PANDAS_INSTANT)
    attempts = funnel(
        events, "user_id", "ts", "event_id", "event_type", ["view", "click", "purchase"], 2 * DAY, DELAY
    )
    at = lambda i: F.get("reached_at", F.lit(i))
    found = attempts.select(
        "user_id",
        at(0).alias("viewed_at"),
        at(1).alias("clicked_at"),
        at(2).alias("bought_at"),
        F.size("reached_at").alias("steps"),
        "n_events",
    )
    found = drained(found, "purchase-funnel", closing=closing)
    return with_zone_free(found, "viewed_at", "clicked_at", "bought_at")
