"""Calendar queries: sessions, offsets, reaction days and date rules over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.operators import calendar as cal
from ledgertide.operators import seasonality as season
from ledgertide.plans import proxies as px
from ledgertide.plans.registry import query

FIRST, LAST = 1995, 2001


def exchange_sql(first: int, last: int, name: str = "xs") -> str:
    """The exchange calendar as day predicates (month, day, weekday), independent of the Spark rules."""
    closures = ", ".join(f"DATE '{day}'" for day in cal.SPECIAL_CLOSURES)
    return f"""
{name}_days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{first}-01-01', TIMESTAMP '{last}-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
{name}_e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(generate_series({first}, {last})) AS y)),
{name}_e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM {name}_e1),
{name}_e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM {name}_e2),
{name}_gf AS (SELECT make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31,
    (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) - 2 AS d FROM {name}_e3),
{name}_open AS (SELECT d, year(d) AS y, month(d) AS m, day(d) AS dd, isodow(d) AS w FROM {name}_days WHERE isodow(d) < 6
    AND d NOT IN (SELECT d FROM {name}_gf) AND d NOT IN ({closures})),
{name} AS (SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS no,
    CASE WHEN (m = 11 AND w = 5 AND dd BETWEEN 23 AND 29) OR (m = 12 AND dd = 24 AND y >= 1993 AND w < 5)
      OR (m = 7 AND dd = 3 AND w IN (1, 2, 4)) OR (m = 7 AND dd = 3 AND w = 3 AND y >= 2013)
      OR (m = 7 AND dd = 5 AND w = 5 AND y BETWEEN 1995 AND 2012) THEN 13 ELSE 16 END AS close_hour
  FROM {name}_open WHERE NOT (
    (m = 1 AND dd = 1) OR (m = 1 AND dd = 2 AND w = 1) OR (m = 1 AND w = 1 AND dd BETWEEN 15 AND 21 AND y >= 1998)
    OR (m = 2 AND w = 1 AND dd BETWEEN 15 AND 21) OR (m = 5 AND w = 1 AND dd >= 25)
    OR (y >= 2022 AND m = 6 AND (dd = 19 OR (dd = 18 AND w = 5) OR (dd = 20 AND w = 1)))
    OR (m = 7 AND (dd = 4 OR (dd = 3 AND w = 5) OR (dd = 5 AND w = 1))) OR (m = 9 AND w = 1 AND dd <= 7)
    OR (m = 11 AND w = 4 AND dd BETWEEN 22 AND 28) OR (m = 12 AND (dd = 25 OR (dd = 24 AND w = 5) OR (dd = 26 AND w = 1)))))
"""


def utc_of(local: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', {local}))"


def local_of(utc: str) -> str:
    return f"timezone('America/New_York', timezone('UTC', {utc}))"


@query("sessions", px.with_ctes(exchange_sql(FIRST, LAST)) + """
SELECT strftime(xs.d, '%Y-%m-%d') AS session_date, CAST(no AS BIGINT) AS session_no, count(l_orderkey) AS shipped_rows
FROM xs LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) = xs.d GROUP BY xs.d, no""")
def sessions(spark, sf):
    days = px.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("session_date")).agg(
        F.count("*").alias("shipped_rows"))
    dim = cal.exchange_sessions(spark, FIRST, LAST).select("session_date", "session_no")
    return px.present(dim.join(days, "session_date", "left").fillna(0, ["shipped_rows"]))


@query("session_bounds", px.with_ctes(exchange_sql(2023, 2024)) + f""",
b AS (SELECT d, {utc_of("d + INTERVAL '9 hours 30 minutes'")} AS o, {utc_of("d + to_hours(close_hour)")} AS c FROM xs)
SELECT strftime(d, '%Y-%m-%d') AS session_date, strftime(o, '%Y-%m-%d %H:%M:%S') AS open_ts, strftime(c, '%Y-%m-%d %H:%M:%S') AS close_ts,
  count(*) AS events_in_day, count(*) FILTER (WHERE ts >= o AND ts < c) AS events_in_session
FROM b JOIN events ON CAST({local_of("ts")} AS DATE) = d GROUP BY d, o, c""")
def session_bounds(spark, sf):
    dim = cal.exchange_sessions(spark, 2023, 2024)
    events = px.table(spark, sf, "events").withColumn(
        "session_date", F.to_date(F.from_utc_timestamp("ts", cal.NEW_YORK)))
    rows = events.join(F.broadcast(dim), "session_date")
    return px.present(rows.groupBy("session_date", "open_ts", "close_ts").agg(
        F.count("*").alias("events_in_day"),
        F.count_if((F.col("ts") >= F.col("open_ts")) & (F.col("ts") < F.col("close_ts"))).alias("events_in_session")))


@query("next_session", px.with_ctes(px.PX) + """
SELECT strftime(o.d, '%Y-%m-%d') AS order_day, n AS orders, strftime(a.d, '%Y-%m-%d') AS on_or_after, strftime(b.d, '%Y-%m-%d') AS strictly_after
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) o JOIN spine s ON s.d = o.d
LEFT JOIN ses a ON a.no = s.next_incl LEFT JOIN ses b ON b.no = s.next_excl""")
def next_session(spark, sf):
    dim = px.sessions(spark, sf)
    spine = cal.date_spine(dim)
    days = px.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("order_day")).agg(F.count("*").alias("orders"))
    days = cal.next_session(days, "order_day", spine, dim, True, "on_or_after")
    return px.present(cal.next_session(days, "order_day", spine, dim, False, "strictly_after"))


@query("previous_session", px.with_ctes(px.PX) + """
SELECT strftime(o.d, '%Y-%m-%d') AS order_day, n AS orders, strftime(a.d, '%Y-%m-%d') AS on_or_before, strftime(b.d, '%Y-%m-%d') AS strictly_before
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) o JOIN spine s ON s.d = o.d
LEFT JOIN ses a ON a.no = s.prev_incl LEFT JOIN ses b ON b.no = s.prev_excl""")
def previous_session(spark, sf):
    dim = px.sessions(spark, sf)
    spine = cal.date_spine(dim)
    days = px.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("order_day")).agg(F.count("*").alias("orders"))
    days = cal.previous_session(days, "order_day", spine, dim, True, "on_or_before")
    return px.present(cal.previous_session(days, "order_day", spine, dim, False, "strictly_before"))


@query("session_window", px.with_ctes(px.PX) + """
SELECT strftime(o.d, '%Y-%m-%d') AS order_day, CAST(k AS BIGINT) AS "offset", strftime(w.d, '%Y-%m-%d') AS window_date
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) o JOIN spine s ON s.d = o.d
CROSS JOIN (SELECT unnest([-3, -2, -1, 0, 1, 2]) AS k) LEFT JOIN ses w ON w.no = s.next_incl + k""")
def session_window(spark, sf):
    dim = px.sessions(spark, sf)
    days = px.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("order_day")).distinct()
    placed = cal.with_spine(days, "order_day", cal.date_spine(dim))
    return px.present(cal.session_window(placed, "next_incl", 3, 2, dim).select("order_day", "offset", "window_date"))


@query("last_completed_session", px.with_ctes(exchange_sql(2023, 2024)) + f""",
b AS (SELECT d, {utc_of("d + to_hours(close_hour)")} AS c FROM xs)
SELECT strftime(completed, '%Y-%m-%d') AS completed, count(*) AS events FROM (
  SELECT event_id, max(d) AS completed FROM events JOIN b ON c <= ts AND d > CAST(ts AS DATE) - 15 GROUP BY event_id) GROUP BY 1""")
def last_completed_session(spark, sf):
    dim = cal.exchange_sessions(spark, 2023, 2024)
    events = px.table(spark, sf, "events").select("event_id", "ts")
    rows = cal.last_completed_session(events, "ts", dim, cal.date_spine(dim))
    return px.present(rows.groupBy("completed").agg(F.count("*").alias("events")))


ANNOUNCED = f"""
ann AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN CAST({local_of("ts")} AS DATE) + 1 WHEN event_id % 2 = 0
    THEN CAST({local_of("ts")} AS DATE) END AS stated, CAST({local_of("ts")} AS DATE) AS ed,
    CASE event_type WHEN 'view' THEN 'exact' WHEN 'click' THEN 'before_open' WHEN 'error' THEN 'after_close' WHEN 'signup' THEN 'intraday'
      ELSE 'date_only' END AS precision
  FROM events),
b AS (SELECT d, no, {utc_of("d + INTERVAL '9 hours 30 minutes'")} AS o, {utc_of("d + to_hours(close_hour)")} AS c FROM xs),
pl AS (SELECT ann.*, b.no IS NOT NULL AS on_session, b.o, b.c,
    (SELECT min(no) FROM b n WHERE n.d >= ed) AS incl, (SELECT min(no) FROM b n WHERE n.d > ed) AS excl
  FROM ann LEFT JOIN b ON b.d = ed),
fl AS (SELECT *, (stated IS NOT NULL AND stated <> ed) OR coalesce((precision = 'before_open' AND ts >= o) OR (precision = 'after_close' AND ts < c), FALSE) AS bad,
    precision = 'exact' AND on_session AND ts >= c AS late, precision = 'exact' AND on_session AND ts >= o AND ts < c AS during FROM pl),
rx AS (SELECT *, CASE WHEN (precision = 'after_close' AND on_session) OR late THEN excl ELSE incl END AS rno,
    (precision IN ('before_open', 'after_close') OR (precision = 'exact' AND NOT coalesce(during, FALSE))) AND NOT bad AS precise,
    precision = 'intraday' OR coalesce(during, FALSE) AS intraday FROM fl)
"""


def announcements(spark, sf):
    local = F.to_date(F.from_utc_timestamp("ts", cal.NEW_YORK))
    kind = (F.when(F.col("event_type") == "view", "exact").when(F.col("event_type") == "click", "before_open")
            .when(F.col("event_type") == "error", "after_close").when(F.col("event_type") == "signup", "intraday").otherwise("date_only"))
    stated = F.when(F.col("event_id") % 11 == 0, F.date_add(local, 1)).when(F.col("event_id") % 2 == 0, local)
    return px.table(spark, sf, "events").select("event_id", "ts", stated.alias("stated"), kind.alias("precision"))


@query("reaction_session", px.with_ctes(exchange_sql(2023, 2024), ANNOUNCED) + """
SELECT precision, strftime(r.d, '%Y-%m-%d') AS reaction_date, strftime(p.d, '%Y-%m-%d') AS baseline_date, precise AS opening_attribution,
  CASE WHEN bad THEN 'conflicting_event_time' WHEN intraday THEN 'intraday_observation' WHEN precise THEN 'available'
    ELSE 'unconfirmed_event_time' END AS reaction_status, count(*) AS announcements
FROM rx LEFT JOIN b r ON r.no = rno LEFT JOIN b p ON p.no = rno - 1 GROUP BY ALL""")
def reaction_session(spark, sf):
    dim = cal.exchange_sessions(spark, 2023, 2024)
    rows = cal.reaction_session(announcements(spark, sf), "ts", "stated", "precision", dim, cal.date_spine(dim))
    return px.present(rows.groupBy("precision", "reaction_date", "baseline_date", "opening_attribution", "reaction_status").agg(
        F.count("*").alias("announcements")))


@query("reaction_day", px.with_ctes(px.PX, px.EVENTS) + """
SELECT ev.session, strftime(r.d, '%Y-%m-%d') AS reaction_date, count(*) AS events FROM ev JOIN spine s ON s.d = ev.ed
LEFT JOIN ses r ON r.no = CASE ev.session WHEN 'after_close' THEN next_excl ELSE next_incl END GROUP BY 1, 2""")
def reaction_day(spark, sf):
    dim = px.sessions(spark, sf)
    rows = cal.with_spine(px.study_events(spark, sf), "event_date", cal.date_spine(dim))
    rows = rows.withColumn("r", cal.reaction_day_number(F.col("session"), F.col("next_incl"), F.col("next_excl")))
    counted = rows.groupBy("session", "r").agg(F.count("*").alias("events"))
    return px.present(cal.session_date_of(counted, "r", dim, "reaction_date").drop("r"))


@query("next_open_after", px.with_ctes(exchange_sql(2023, 2024)) + f""",
b AS (SELECT d, {utc_of("d + INTERVAL '9 hours 30 minutes'")} AS o FROM xs)
SELECT strftime(next_open, '%Y-%m-%d') AS next_open, count(*) AS events FROM (
  SELECT event_id, min(d) AS next_open FROM events JOIN b ON o > ts AND d < CAST(ts AS DATE) + 15 GROUP BY event_id) GROUP BY 1""")
def next_open_after(spark, sf):
    dim = cal.exchange_sessions(spark, 2023, 2024)
    rows = cal.next_open_after(px.table(spark, sf, "events").select("event_id", "ts"), "ts", dim, cal.date_spine(dim))
    return px.present(rows.groupBy("next_open").agg(F.count("*").alias("events")))


@query("published_basis", px.with_ctes(px.PX, px.REPORTS) + """
SELECT rep.source, strftime(b.d, '%Y-%m-%d') AS published_basis, count(*) AS reports FROM rep
LEFT JOIN spine s ON s.d = coalesce(report_date, filed_date) LEFT JOIN ses b ON b.no = s.next_incl - 1 GROUP BY 1, 2""")
def published_basis(spark, sf):
    dim = cal.add_bounds(px.sessions(spark, sf))
    reports = px.disclosure_reports(spark, sf).select(
        "source", F.coalesce("report_date", "filed_date").alias("published"), F.lit(None).cast("timestamp").alias("stamp"),
        F.lit("exact").alias("precision"))
    rows = cal.reaction_session(reports, "stamp", "published", "precision", dim, cal.date_spine(dim))
    return px.present(rows.groupBy("source", F.col("baseline_date").alias("published_basis")).agg(F.count("*").alias("reports")))


@query("period_anchor", px.with_ctes(px.PX) + """
, e AS (SELECT DISTINCT d FROM px WHERE isodow(d) < 6),
a AS (SELECT d, unnest([{'p': '1w', 'a': d - 7}, {'p': '1m', 'a': CAST(d - INTERVAL 1 MONTH AS DATE)},
    {'p': '3m', 'a': CAST(d - INTERVAL 3 MONTH AS DATE)}, {'p': 'ytd', 'a': make_date(year(d) - 1, 12, 31)}]) AS x FROM e)
SELECT strftime(a.d, '%Y-%m-%d') AS end_date, x.p AS period, strftime(x.a, '%Y-%m-%d') AS anchor, strftime(ses.d, '%Y-%m-%d') AS start_date
FROM a LEFT JOIN spine s ON s.d = x.a LEFT JOIN ses ON ses.no = s.prev_incl""")
def period_anchor(spark, sf):
    dim = px.sessions(spark, sf)
    ends = dim.select(F.col("session_date").alias("end_date"))
    rows = ends.select("end_date", F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), cal.period_anchor(F.col("end_date"), p).alias("anchor"))
        for p in ("1w", "1m", "3m", "ytd")])).alias("x")).select("end_date", "x.*")
    return px.present(cal.previous_session(rows, "anchor", cal.date_spine(dim), dim, True, "start_date"))


@query("interval_rules", """
WITH y AS (SELECT unnest(generate_series(1994, 2001)) AS y),
r AS (SELECT y, make_date(y, 12, 15) AS a, CASE WHEN (y + 1) % 4 = 0 THEN make_date(y + 1, 2, 29) ELSE make_date(y + 1, 2, 28) END AS b FROM y)
SELECT CAST(y AS BIGINT) AS year, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, y = 2001 AS is_current, count(o_orderkey) AS orders
FROM r LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY y, a, b""")
def interval_rules(spark, sf):
    study = season.periods("interval", "2002-01-15", 7, "12-15", "02-29")
    spans = spark.range(1).select(F.explode(study).alias("p")).select("p.year", "p.is_current", "p.first_day", "p.last_day")
    days = spans.select("year", F.explode(F.sequence("first_day", "last_day")).alias("order_day"))
    per_day = px.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("order_day")).agg(F.count("*").alias("n"))
    counted = per_day.join(F.broadcast(days), "order_day").groupBy("year").agg(F.sum("n").alias("orders"))
    return px.present(spans.join(counted, "year", "left").fillna(0, ["orders"]))


@query("market_phase", px.with_ctes(exchange_sql(2023, 2024)) + f""",
e AS (SELECT ts, {local_of("ts")} AS lt FROM events)
SELECT phase, count(*) AS events FROM (SELECT CASE
    WHEN xs.d IS NULL THEN 'closed' WHEN lt >= xs.d + INTERVAL '9 hours 30 minutes' AND lt < xs.d + to_hours(close_hour) THEN 'regular'
    WHEN lt >= xs.d + INTERVAL '4 hours' AND lt < xs.d + INTERVAL '9 hours 30 minutes' THEN 'pre'
    WHEN lt >= xs.d + to_hours(close_hour) AND lt < xs.d + INTERVAL '20 hours' THEN 'post' ELSE 'closed' END AS phase
  FROM e LEFT JOIN xs ON xs.d = CAST(lt AS DATE)) GROUP BY 1""")
def market_phase(spark, sf):
    rows = cal.market_phase(px.table(spark, sf, "events").select("ts"), "ts", cal.exchange_sessions(spark, 2023, 2024))
    return px.present(rows.groupBy(F.col("market_phase").alias("phase")).agg(F.count("*").alias("events")))


@query("eastern_instant", f"""
WITH t AS (SELECT l_shipdate + to_minutes(CAST(l_orderkey % 1440 AS BIGINT)) AS lt FROM lineitem),
u AS (SELECT lt, {utc_of("lt")} AS u FROM t),
v AS (SELECT lt, CASE WHEN {local_of("u")} = lt AND {local_of("u + INTERVAL 1 HOUR")} <> lt AND {local_of("u - INTERVAL 1 HOUR")} <> lt THEN u END AS u FROM u)
SELECT strftime(CAST(lt AS DATE), '%Y-%m-%d') AS local_day, count(*) AS stamps, count(*) - count(u) AS unclear,
  strftime(min(u), '%Y-%m-%d %H:%M:%S') AS first_utc FROM v GROUP BY 1""")
def eastern_instant(spark, sf):
    wall = F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 1440 * 60)
    rows = px.table(spark, sf, "lineitem").select(F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("raw"))
    rows = rows.select(F.substring("raw", 1, 10).alias("local_day"), cal.eastern_instant(F.col("raw")).alias("utc"))
    return px.present(rows.groupBy("local_day").agg(
        F.count("*").alias("stamps"), F.count_if(F.col("utc").isNull()).alias("unclear"), F.min("utc").alias("first_utc")))


@query("quarter_ranges", """
WITH c AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1),
q AS (SELECT o_custkey, a, b, CAST(unnest(generate_series(date_trunc('quarter', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS q FROM c)
SELECT o_custkey AS customer, datediff('quarter', q, b) + 1 AS quarter_pos, strftime(greatest(a, q), '%Y-%m-%d') AS range_start,
  strftime(least(b, CAST(q + INTERVAL 3 MONTH AS DATE) - 1), '%Y-%m-%d') AS range_end FROM q""")
def quarter_ranges(spark, sf):
    spans = px.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return px.present(cal.quarter_ranges(spans, "a", "b").drop("a", "b"))


@query("business_days", """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
x AS (SELECT *, year(d) AS y, month(d) AS m, day(d) AS dd, isodow(d) AS w FROM o)
SELECT strftime(d, '%Y-%m-%d') AS business_day, n AS orders FROM x WHERE w < 6 AND NOT (
  (m = 1 AND (dd = 1 OR (dd = 2 AND w = 1))) OR (m = 12 AND dd = 31 AND w = 5) OR (m = 1 AND w = 1 AND dd BETWEEN 15 AND 21)
  OR (m = 2 AND w = 1 AND dd BETWEEN 15 AND 21) OR (m = 5 AND w = 1 AND dd >= 25)
  OR (m = 7 AND (dd = 4 OR (dd = 3 AND w = 5) OR (dd = 5 AND w = 1))) OR (m = 9 AND w = 1 AND dd <= 7)
  OR (m = 10 AND w = 1 AND dd BETWEEN 8 AND 14) OR (m = 11 AND (dd = 11 OR (dd = 10 AND w = 5) OR (dd = 12 AND w = 1)))
  OR (m = 11 AND w = 4 AND dd BETWEEN 22 AND 28) OR (m = 12 AND (dd = 25 OR (dd = 24 AND w = 5) OR (dd = 26 AND w = 1))))""")
def business_days(spark, sf):
    days = px.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("business_day")).agg(F.count("*").alias("orders"))
    holidays = cal.federal_holidays(cal._years(spark, FIRST, LAST + 1))
    return px.present(cal.business_days(days, "business_day", holidays))


@query("full_years", px.with_ctes(px.PX) + """
, f AS (SELECT symbol, min(d) AS first_day FROM px GROUP BY 1), o AS (SELECT min(d) AS d FROM ses WHERE year(d) BETWEEN 1991 AND 2000 GROUP BY year(d))
SELECT symbol, strftime(first_day, '%Y-%m-%d') AS first_day, count(o.d) AS full_years FROM f LEFT JOIN o ON first_day <= o.d GROUP BY 1, 2""")
def full_years(spark, sf):
    from ledgertide.operators.bars import first_trading_day

    firsts = first_trading_day(px.bars(spark, sf))
    return px.present(cal.full_years(firsts, "first_day", px.sessions(spark, sf), px.CUTOFF, 10))
