"""The registered queries by name. Each takes a session and a table folder."""

from __future__ import annotations

from . import events, star, streams, web

QUERIES = {
    query.__name__: query
    for query in (
        star.returned_lines,
        star.revenue_by_region_year,
        star.orders_by_line_count,
        star.orders_with_returns,
        star.orders_without_lines,
        star.revenue_rollup,
        star.revenue_cube,
        star.revenue_by_part_sets,
        star.top_orders_per_customer,
        star.buyers_either_year,
        star.buyers_both_years,
        star.buyers_first_year_only,
        star.repeated_buying,
        star.dropped_buying,
        star.order_price_quantiles,
        events.users_per_day,
        events.users_approximately,
        events.frequent_kinds_of_events,
        events.running_value,
        events.moving_value_by_rows,
        events.moving_value_by_time,
        events.events_by_day_pivoted,
        events.totals_by_property,
        events.kinds_of_properties,
        events.purchases_near_clicks,
        events.purchases_around_clicks,
        events.last_click_before_purchase,
        events.events_by_hour,
        events.events_by_sliding_hour,
        events.user_sessions,
        web.links_of_pages,
        web.links_between_hosts,
        streams.stream_events_by_hour,
        streams.stream_without_repeats,
        streams.stream_purchases_near_clicks,
        streams.stream_user_progress,
        streams.stream_purchase_funnel,
    )
}
