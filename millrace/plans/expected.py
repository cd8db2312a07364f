"""DuckDB SQL that states the expected result of each registered query."""

from __future__ import annotations

from ..operators.hyperlinks import ADDRESS, ATTRIBUTE, NAMED, NO_MARKUP, PARTS, TAG

_NET = (
    "(CAST(round(l_extendedprice * 100) AS BIGINT)"
    " * (100 - CAST(round(l_discount * 100) AS BIGINT)))"
)
_REVENUE = f"CAST(sum({_NET}) AS DOUBLE) / 10000"
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_EVENT_SUMS = f"count(*) AS n_events, CAST(sum({_CENTS}) AS BIGINT) AS cents"
_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"
_ORDERED = "PARTITION BY user_id ORDER BY ts, event_id"

_LINE_SUMS = f"""
    count(*) AS n_lines,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS mean_quantity,
    {_REVENUE} AS revenue
"""


def _running(frame: str) -> str:
    window = f"({_ORDERED} {frame})"
    return f"""
        SELECT event_id, user_id, ts,
               count(*) OVER {window} AS n_events,
               CAST(sum({_CENTS}) OVER {window} AS BIGINT) AS cents
        FROM events
    """


def _buyers(year: int) -> str:
    return f"""
        SELECT o_custkey, o_orderpriority FROM orders
        WHERE o_orderdate >= TIMESTAMP '{year}-01-01' AND o_orderdate < TIMESTAMP '{year + 1}-01-01'
    """


_CLICKS = """
    SELECT user_id, event_id AS click_id, ts AS click_at FROM events WHERE event_type = 'click'
"""
_PURCHASES = f"""
    SELECT user_id, event_id AS purchase_id, ts AS purchased_at, {_CENTS} AS purchase_cents
    FROM events WHERE event_type = 'purchase'
"""
_PAIRS = f"""
    SELECT c.user_id, click_id, click_at, purchase_id, purchased_at, purchase_cents
    FROM ({_CLICKS}) c JOIN ({_PURCHASES}) p
      ON c.user_id = p.user_id
     AND purchased_at >= click_at AND purchased_at <= click_at + INTERVAL 1 HOUR
"""
_BY_HOUR = f"""
    SELECT date_trunc('hour', ts) AS window_start,
           date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
           event_type, {_EVENT_SUMS}
    FROM events GROUP BY ALL
"""

_SESSION_ROWS = """
    SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no
    FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens
        FROM events
    )
"""
_SESSION_SPAN = "min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end"

# Each view is looked at as if an attempt began there; then from the first view of a
# user the next is the first one after the end of the one before.
_FUNNEL = """
    WITH RECURSIVE e AS (
        SELECT user_id, ts, event_type AS kind, {'t': ts, 'i': event_id} AS pos
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
    ), clicked AS (
        SELECT v.user_id, v.pos, v.ts + INTERVAL 2 DAY AS due, min(c.pos) AS click
        FROM e v LEFT JOIN e c ON c.user_id = v.user_id AND c.kind = 'click' AND c.pos > v.pos
            AND c.ts < v.ts + INTERVAL 2 DAY
        WHERE v.kind = 'view' GROUP BY ALL
    ), bought AS (
        SELECT v.user_id, v.pos, due, click, min(b.pos) AS buy
        FROM clicked v LEFT JOIN e b ON b.user_id = v.user_id AND b.kind = 'purchase' AND b.pos > click
            AND b.ts < due
        GROUP BY ALL
    ), attempts AS (
        SELECT v.user_id, v.pos, click, buy,
               count(*) FILTER (e.pos >= v.pos AND e.ts < due AND (buy IS NULL OR e.pos <= buy)) AS n_events,
               min(e.pos) FILTER (e.kind = 'view' AND CASE WHEN buy IS NULL THEN e.ts >= due ELSE e.pos > buy END) AS next
        FROM bought v JOIN e USING (user_id) GROUP BY ALL
    ), taken AS (
        SELECT user_id, min(pos) AS pos FROM attempts GROUP BY user_id
        UNION ALL
        SELECT user_id, next FROM taken JOIN attempts USING (user_id, pos) WHERE next IS NOT NULL
    )
    SELECT user_id, pos.t AS viewed_at, click.t AS clicked_at, buy.t AS bought_at,
           CASE WHEN buy IS NOT NULL THEN 3 WHEN click IS NOT NULL THEN 2 ELSE 1 END AS steps, n_events
    FROM taken JOIN attempts USING (user_id, pos)
"""

def _quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


_DECODED = "value"
for _name, _sign in NAMED:
    _DECODED = f"replace({_DECODED}, {_quoted(_name)}, {_quoted(_sign)})"


def _parts(address: str) -> str:
    of = [f"regexp_extract({address}, {_quoted(PARTS)}, {i})" for i in (1, 2, 3, 4)]
    return f"lower({of[0]}) AS scheme, lower({of[1]}) AS authority, {of[2]} AS path, {of[3]} AS query"


def _no_dots(path: str) -> str:
    segments = f"string_split({path}, '/')[2:]"
    done = (
        f"list_reduce({segments}, lambda done, s: CASE s WHEN '.' THEN done"
        " WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END, '')"
    )
    return f"{done} || CASE WHEN {segments}[-1] IN ('.', '..') THEN '/' ELSE '' END"


def _host(authority: str) -> str:
    return f"regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', '')"


def _resolved(columns: str, source: str) -> str:
    """Addresses seen from b_scheme, b_authority, b_path and b_query; those that lead to a web host."""
    return f"""
        SELECT {columns}, r_scheme AS scheme, r_authority AS authority, CASE
                   WHEN here AND path = '' THEN CASE WHEN b_path = '' THEN '/' ELSE b_path END
                   WHEN path = '' THEN '/' ELSE {_no_dots("whole")} END AS path,
               CASE WHEN here AND path = '' AND query = '' THEN b_query ELSE query END AS query
        FROM (
            SELECT *, scheme = '' AND authority = '' AS here,
                   CASE WHEN scheme = '' THEN b_scheme ELSE scheme END AS r_scheme,
                   CASE WHEN scheme = '' AND authority = '' THEN b_authority ELSE authority END AS r_authority,
                   CASE WHEN path[1] = '/' THEN path
                        ELSE coalesce(nullif(regexp_replace(b_path, '[^/]*$', ''), ''), '/') || path END AS whole
            FROM (SELECT *, {_parts("address")} FROM {source})
        ) WHERE r_scheme IN ('http', 'https') AND r_authority <> ''
    """


# Addresses are taken apart step by step, one table for each; RE2 reads the patterns.
_LINKS = f"""
    WITH tags AS (
        SELECT row_number() OVER () AS row_id, page_id, trim(coalesce(url, '')) AS url,
               regexp_extract_all(regexp_replace(coalesce(html, ''), {_quoted(NO_MARKUP)}, '', 'g'),
                                  {_quoted(TAG)}) AS tags
        FROM pages
    ), found AS (
        SELECT row_id, page_id, url, place, lower(tag[2:5]) = 'base' AS is_base,
               list_filter(regexp_extract_all(tag, {_quoted(ATTRIBUTE)}),
                           lambda a: regexp_matches(a, {_quoted(ADDRESS)}))[1] AS own
        FROM (SELECT row_id, page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM tags)
    ), addresses AS (
        SELECT row_id, page_id, url, place, is_base, trim(translate({_DECODED}, chr(9) || chr(10) || chr(13) || chr(12), '')) AS address
        FROM (SELECT *, regexp_extract(own, {_quoted(ADDRESS)}, 1) || regexp_extract(own, {_quoted(ADDRESS)}, 2)
                        || regexp_extract(own, {_quoted(ADDRESS)}, 3) AS value
              FROM found WHERE own IS NOT NULL)
    ), homes AS (
        SELECT row_id, {_parts("url")}, scheme IN ('http', 'https') AND authority <> '' AS web FROM tags
    ), own AS (
        SELECT row_id, CASE WHEN web THEN scheme ELSE '' END AS b_scheme, CASE WHEN web THEN authority ELSE '' END AS b_authority,
               CASE WHEN NOT web THEN '' WHEN path = '' THEN '/' ELSE {_no_dots("path")} END AS b_path,
               CASE WHEN web THEN query ELSE '' END AS b_query
        FROM homes
    ), first_base AS (
        SELECT row_id, arg_min(address, place) AS address FROM addresses WHERE is_base GROUP BY row_id
    ), moved AS (
        {_resolved("row_id", "first_base JOIN own USING (row_id)")}
    ), bases AS (
        SELECT row_id, coalesce(scheme, b_scheme) AS b_scheme, coalesce(authority, b_authority) AS b_authority,
               coalesce(path, b_path) AS b_path, CASE WHEN scheme IS NULL THEN b_query ELSE query END AS b_query
        FROM own LEFT JOIN moved USING (row_id)
    ), links AS (
        {_resolved("row_id, page_id, place", "addresses JOIN bases USING (row_id) WHERE NOT is_base")}
    )
    SELECT row_id, page_id, place AS tag_place,
           scheme || '://' || authority || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS target,
           {_host("authority")} AS to_host, nullif({_host("b_authority")}, '') AS from_host
    FROM links JOIN (SELECT row_id, b_authority FROM own) USING (row_id)
"""

EXPECTED = {
    "returned_lines": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
               CAST({_NET} AS DOUBLE) / 10000 AS net_price
        FROM lineitem
        WHERE l_returnflag = 'R' AND l_quantity > 25
          AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'
    """,
    "revenue_by_region_year": f"""
        SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS order_year,
               count(*) AS n_lines, {_REVENUE} AS revenue
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        WHERE l_returnflag = 'R'
        GROUP BY ALL
    """,
    "orders_by_line_count": """
        SELECT o_orderpriority, n_lines, count(*) AS n_orders
        FROM (
            SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n_lines
            FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
            GROUP BY ALL
        )
        GROUP BY ALL
    """,
    "orders_with_returns": """
        SELECT o_orderpriority, count(*) AS n_orders,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_price
        FROM orders
        WHERE EXISTS (
            SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'
        )
        GROUP BY ALL
    """,
    "orders_without_lines": """
        SELECT o_orderkey, o_custkey, o_orderdate FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
    "revenue_rollup": f"""
        SELECT ship_year, l_returnflag, l_linestatus,
               CAST(grouping(ship_year, l_returnflag, l_linestatus) AS BIGINT) AS level,
               {_LINE_SUMS}
        FROM (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS ship_year FROM lineitem)
        GROUP BY ROLLUP (ship_year, l_returnflag, l_linestatus)
    """,
    "revenue_cube": f"""
        SELECT l_returnflag, l_linestatus, l_linenumber,
               CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS level,
               {_LINE_SUMS}
        FROM lineitem
        GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)
    """,
    "revenue_by_part_sets": f"""
        SELECT p_brand, p_type, p_size,
               CAST(grouping(p_brand, p_type, p_size) AS BIGINT) AS level,
               {_LINE_SUMS}
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY GROUPING SETS ((p_brand), (p_type, p_size), ())
    """,
    "top_orders_per_customer": """
        SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate,
               row_number() OVER (
                   PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders QUALIFY rank <= 3
    """,
    "buyers_either_year": f"{_buyers(1996)} UNION {_buyers(1997)}",
    "buyers_both_years": f"{_buyers(1996)} INTERSECT {_buyers(1997)}",
    "buyers_first_year_only": f"{_buyers(1996)} EXCEPT {_buyers(1997)}",
    "repeated_buying": f"{_buyers(1996)} INTERSECT ALL {_buyers(1997)}",
    "dropped_buying": f"{_buyers(1996)} EXCEPT ALL {_buyers(1997)}",
    "users_per_day": f"""
        SELECT {_DAY} AS day, event_type,
               count(DISTINCT user_id) AS n_users, count(*) AS n_events
        FROM events GROUP BY ALL
    """,
    "users_approximately": """
        SELECT event_type, count(DISTINCT user_id) AS n_users
        FROM events GROUP BY ALL
    """,
    "running_value": _running("ROWS UNBOUNDED PRECEDING"),
    "moving_value_by_rows": _running("ROWS 9 PRECEDING"),
    "moving_value_by_time": f"""
        SELECT event_id, user_id, ts,
               count(*) OVER last_day AS n_events,
               CAST(sum({_CENTS}) OVER last_day AS BIGINT) AS cents
        FROM events
        WINDOW last_day AS (PARTITION BY user_id ORDER BY ts
                            RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)
    """,
    "events_by_day_pivoted": f"""
        SELECT {_DAY} AS day,
               count(*) FILTER (event_type = 'click') AS click,
               count(*) FILTER (event_type = 'error') AS error,
               count(*) FILTER (event_type = 'purchase') AS purchase,
               count(*) FILTER (event_type = 'signup') AS signup,
               count(*) FILTER (event_type = 'view') AS view,
               count(*) FILTER (event_type IS NULL OR event_type NOT IN
                   ('click', 'error', 'purchase', 'signup', 'view')) AS other
        FROM events GROUP BY ALL
    """,
    "totals_by_property": f"""
        SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {_EVENT_SUMS}
        FROM events GROUP BY ALL
    """,
    "purchases_near_clicks": _PAIRS,
    "purchases_around_clicks": f"""
        SELECT c.user_id, click_id, click_at, count(purchase_id) AS n_purchases,
               CAST(coalesce(sum(purchase_cents), 0) AS BIGINT) AS cents
        FROM ({_CLICKS}) c LEFT JOIN ({_PURCHASES}) p
          ON c.user_id = p.user_id
         AND purchased_at >= click_at - INTERVAL 1 HOUR
         AND purchased_at <= click_at + INTERVAL 24 HOUR
        GROUP BY ALL
    """,
    "last_click_before_purchase": f"""
        SELECT p.user_id, purchase_id, purchased_at, purchase_cents, click_id, click_at
        FROM ({_PURCHASES}) p LEFT JOIN ({_CLICKS}) c
          ON p.user_id = c.user_id AND click_at <= purchased_at
        QUALIFY row_number() OVER (
            PARTITION BY purchase_id ORDER BY click_at DESC NULLS LAST, click_id DESC) = 1
    """,
    "events_by_hour": _BY_HOUR,
    "events_by_sliding_hour": f"""
        SELECT time_bucket(INTERVAL 15 MINUTE, ts) - s * INTERVAL 15 MINUTE AS window_start,
               time_bucket(INTERVAL 15 MINUTE, ts) - s * INTERVAL 15 MINUTE + INTERVAL 1 HOUR
                   AS window_end,
               event_type, {_EVENT_SUMS}
        FROM events, range(4) AS slides(s)
        GROUP BY ALL
    """,
    "user_sessions": f"""
        SELECT user_id, {_SESSION_SPAN}, {_EVENT_SUMS}
        FROM ({_SESSION_ROWS}) GROUP BY user_id, session_no
    """,
    "stream_events_by_hour": _BY_HOUR,
    "stream_without_repeats": "SELECT event_id, user_id, event_type, ts FROM events",
    "stream_purchases_near_clicks": _PAIRS,
    "stream_user_progress": f"""
        SELECT user_id, {_SESSION_SPAN}, {_EVENT_SUMS},
               CASE WHEN min(ts) FILTER (event_type = 'click')
                         < max(ts) FILTER (event_type = 'purchase') THEN 'converted'
                    WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'clicked'
                    ELSE 'idle' END AS progress
        FROM ({_SESSION_ROWS}) GROUP BY user_id, session_no
    """,
    "stream_purchase_funnel": _FUNNEL,
    "links_of_pages": f"""
        SELECT page_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY tag_place) AS INT) AS place,
               target, to_host FROM ({_LINKS})
    """,
    "links_between_hosts": f"""
        SELECT from_host, to_host, count(*) AS n_links, count(DISTINCT row_id) AS n_pages
        FROM ({_LINKS}) GROUP BY ALL
    """,
    "frequent_kinds_of_events": """
        SELECT event_type, props, count(*) AS n_events FROM events GROUP BY ALL
        HAVING count(*) * 1000 >= 2 * (SELECT count(*) FROM events)
    """,
    "order_price_quantiles": """
        WITH ranked AS (
            SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
                   count(*) OVER (PARTITION BY o_orderpriority) AS n_rows,
                   row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS place
            FROM orders WHERE o_totalprice IS NOT NULL
        )
        SELECT o_orderpriority, CAST(k AS INT) AS thousandth, n_rows, cents
        FROM ranked, unnest([0, 10, 250, 500, 750, 990, 1000]) AS t(k)
        WHERE place = greatest(1, (n_rows * k + 999) // 1000)
    """,
    "kinds_of_properties": """
        WITH found AS (
            SELECT '$' AS path, json_type(props) AS kind FROM events WHERE json_valid(props)
            UNION ALL
            SELECT '$.' || name, json_type(props, '$."' || name || '"')
            FROM events, unnest(json_keys(props)) AS t(name) WHERE json_valid(props)
            UNION ALL
            SELECT '$', 'malformed' FROM events WHERE NOT json_valid(props)
        )
        SELECT path, CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number'
                          WHEN kind = 'VARCHAR' THEN 'string' ELSE lower(kind) END AS kind,
               count(*) AS n_rows
        FROM found GROUP BY ALL
    """,
}
