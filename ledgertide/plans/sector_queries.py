"""Sector queries: regions stand for sectors (one ETF each) and nations for industry groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.operators import sectors as sec
from ledgertide.plans import proxies as px
from ledgertide.plans.market_queries import YEARS
from ledgertide.plans.registry import query
from ledgertide.session import checkpoint


def sector_members(spark, sf):
    key = F.col("r_regionkey")
    return px.table(spark, sf, "region").select(
        F.col("r_name").alias("id"), F.concat(F.lit("S"), key.cast("string")).alias("symbol"), key.cast("long").alias("position"))


def industry_groups(spark, sf):
    nation, region = px.table(spark, sf, "nation"), px.table(spark, sf, "region")
    key = F.col("n_nationkey")
    symbol = lambda c: F.concat(F.lit("S"), c.cast("string"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("id"), F.col("r_name").alias("sector"), F.when(key % 6 != 5, symbol(key % 8)).alias("primary"),
        F.when(key % 4 == 0, F.array(symbol((key + 3) % 8))).otherwise(F.array().cast("array<string>")).alias("alternates"),
        F.when(key % 6 == 5, "pending").otherwise("partial").alias("coverage"), key.cast("long").alias("position"))


CLOSING = px.with_ctes(px.PX) + f"""
, en AS (SELECT symbol, min(d) AS f, max(d) FILTER (WHERE d <= DATE '{px.CUTOFF}') AS e FROM px GROUP BY 1),
an AS (SELECT symbol, f, e, u.p, u.a FROM en, LATERAL (SELECT unnest([{{'p': '1w', 'a': e - 7}}, {{'p': '1m', 'a': CAST(e - INTERVAL 1 MONTH AS DATE)}},
    {{'p': '3m', 'a': CAST(e - INTERVAL 3 MONTH AS DATE)}}, {{'p': 'ytd', 'a': make_date(year(e) - 1, 12, 31)}}], recursive := true)) u),
cp AS (SELECT an.symbol, p AS period, ses.d AS s, e, CASE WHEN ses.d < f THEN 'missing' WHEN a.c IS NULL OR b.c IS NULL THEN 'missing' ELSE 'available' END AS status,
    CASE WHEN NOT ses.d < f THEN round_even(b.c / a.c - 1, 6) END AS value
  FROM an LEFT JOIN spine ON spine.d = an.a LEFT JOIN ses ON ses.no = spine.prev_incl LEFT JOIN px a ON a.symbol = an.symbol AND a.d = ses.d LEFT JOIN px b ON b.symbol = an.symbol AND b.d = e)
"""


def closing(spark, sf):
    m = px.market(spark, sf)
    return checkpoint(sec.closing_periods(m.bars, m.sessions, m.spine, px.CUTOFF))


@query("sector_periods", CLOSING + """
SELECT symbol, period, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date, status, round(value, 6) AS value FROM cp""")
def sector_periods(spark, sf):
    return px.present(closing(spark, sf))


@query("join_asof_session", px.with_ctes(px.PX) + """
, o AS (SELECT 'S' || CAST(o_custkey % 8 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o.symbol, strftime(o.d, '%Y-%m-%d') AS order_day, n AS orders, strftime(ses.d, '%Y-%m-%d') AS price_day, px.c AS close
FROM o LEFT JOIN spine s ON s.d = o.d LEFT JOIN ses ON ses.no = s.prev_incl LEFT JOIN px ON px.symbol = o.symbol AND px.d = ses.d""")
def join_asof_session(spark, sf):
    from ledgertide.operators import calendar as cal

    m = px.market(spark, sf)
    days = px.table(spark, sf, "orders").groupBy(
        F.concat(F.lit("S"), (F.col("o_custkey") % 8).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("order_day")).agg(
        F.count("*").alias("orders"))
    rows = cal.previous_session(days, "order_day", m.spine, m.sessions, True, "price_day")
    closes = m.bars.select("symbol", F.col("session_date").alias("price_day"), "close")
    return px.present(rows.join(closes, ["symbol", "price_day"], "left"), exact=("close",))


HEAT = """
, mb AS (SELECT r_name AS id, 'S' || r_regionkey AS symbol, r_regionkey AS pos FROM region),
fl AS (SELECT * FROM (VALUES ('1w', 0.02), ('1m', 0.04), ('3m', 0.08), ('ytd', 0.08)) t(period, floor)),
hw AS (SELECT id, cp.symbol, period, status, value, 0.2 + 0.8 * (value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, CAST(floor AS DOUBLE)) AS weight,
    CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY period, value IS NULL ORDER BY value DESC, pos) END AS rank
  FROM cp JOIN mb USING (symbol) JOIN fl USING (period) WINDOW w AS (PARTITION BY period))
"""


@query("heatmap_weight", CLOSING + HEAT + "SELECT id, period, round(weight, 6) AS weight FROM hw")
def heatmap_weight(spark, sf):
    rows = closing(spark, sf).join(F.broadcast(sector_members(spark, sf)), "symbol")
    return px.present(sec.heatmap_weight(rows).select("id", "period", "weight"))


@query("rank_ordinal", CLOSING + HEAT + "SELECT id, period, rank FROM hw")
def rank_ordinal(spark, sf):
    rows = closing(spark, sf).join(F.broadcast(sector_members(spark, sf)), "symbol")
    return px.present(sec.rank_ordinal(rows, "period", "value", "position").select("id", "period", "rank"))


@query("sector_performance", CLOSING + HEAT + """
SELECT id, symbol, period, status, round(value, 6) AS value, round(weight, 6) AS weight, rank FROM hw""")
def sector_performance(spark, sf):
    rows = sec.performance(sector_members(spark, sf), closing(spark, sf))
    return px.present(rows.select("id", "symbol", "period", "status", "value", "weight", "rank"))


@query("group_performance", CLOSING + """
, gp AS (SELECT n_name AS id, r_name AS sector, n_nationkey AS pos, CASE WHEN n_nationkey % 6 <> 5 THEN 'S' || n_nationkey % 8 END AS prim,
    CASE WHEN n_nationkey % 4 = 0 THEN 'S' || (n_nationkey + 3) % 8 END AS alt FROM nation JOIN region ON n_regionkey = r_regionkey),
pr AS (SELECT id, sector, period, cp.symbol, value, row_number() OVER (PARTITION BY period, value IS NULL ORDER BY value DESC, pos) AS rank FROM gp JOIN cp ON cp.symbol = prim)
SELECT id, sector, 'primary' AS role, symbol, period, round(value, 6) AS value, CASE WHEN value IS NOT NULL THEN rank END AS rank FROM pr
UNION ALL SELECT id, sector, 'reference', symbol, period, round(value, 6), NULL FROM gp JOIN cp ON cp.symbol = alt
UNION ALL SELECT id, sector, 'pending', NULL, NULL, NULL, NULL FROM gp WHERE prim IS NULL""")
def group_performance(spark, sf):
    rows = sec.group_performance(industry_groups(spark, sf), closing(spark, sf))
    return px.present(rows.select("id", "sector", "role", "symbol", "period", "value", "rank"))


@query("sector_candles", px.with_ctes(px.PX) + f"""
SELECT r_name AS id, strftime(min(d), '%Y-%m-%d') AS start_date, strftime(max(d), '%Y-%m-%d') AS end_date, first(o ORDER BY d) AS open, max(h) AS high, min(l) AS low, last(c ORDER BY d) AS close,
  count(*) AS sessions FROM px JOIN region ON symbol = 'S' || r_regionkey
WHERE d <= DATE '{px.CUTOFF}' AND d >= CAST(date_trunc('week', CAST(DATE '{px.CUTOFF}' - INTERVAL 12 MONTH AS DATE) + 1) AS DATE) GROUP BY r_name, date_trunc('week', d)""")
def sector_candles(spark, sf):
    rows = sec.sector_candles(sector_members(spark, sf), px.bars(spark, sf), px.CUTOFF, "1y", "week")
    return px.present(rows.select("id", "start_date", "end_date", "open", "high", "low", "close", "sessions"), exact=("open", "high", "low", "close"))


def saved_quotes(bars):
    """A closing quote per symbol: the last close, stamped on that day after the bell."""
    rows = bars.where(F.col("session_date") <= px.CUTOFF)
    last = rows.groupBy("symbol").agg(F.max_by("close", "session_date").alias("close"), F.max("session_date").alias("day"))
    stamp = F.to_timestamp(F.concat(F.col("day").cast("string"), F.lit(" 20:00:00")))
    return last.select("symbol", (F.col("close") * 1.01).alias("regular_value"), stamp.alias("regular_time"), stamp.alias("fetched_at"),
                       (F.col("close") * 0.99).alias("previous_close"), F.lit("LIVE").alias("quote_status"), F.lit(True).alias("close_confirmed"))


@query("today_change", px.with_ctes(px.PX) + f"""
, cd AS (SELECT max(no) AS k FROM ses WHERE d <= DATE '{px.CUTOFF}'), dd AS (SELECT a.d AS c, b.d AS p FROM cd JOIN ses a ON a.no = k JOIN ses b ON b.no = k - 1),
q AS (SELECT symbol, last(c ORDER BY d) AS lc, max(d) AS day, min(d) AS f FROM px WHERE d <= DATE '{px.CUTOFF}' GROUP BY 1)
SELECT q.symbol, round_even(CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN a.c / b.c - 1 WHEN day = DATE '{px.CUTOFF}' THEN lc * 1.01 / coalesce(b.c, lc * 0.99) - 1 END, 6) AS value,
  CASE WHEN (a.c IS NOT NULL AND b.c IS NOT NULL) OR day = DATE '{px.CUTOFF}' THEN 'available' WHEN dd.p < f THEN 'before_listing' ELSE 'missing' END AS status,
  'close' AS mode, FALSE AS delayed
FROM q CROSS JOIN dd LEFT JOIN px a ON a.symbol = q.symbol AND a.d = DATE '{px.CUTOFF}' LEFT JOIN px b ON b.symbol = q.symbol AND b.d = dd.p""")
def today_change(spark, sf):
    bars = px.market(spark, sf).bars
    rows = sec.today_change(bars.select("symbol").distinct(), bars, saved_quotes(bars), f"{px.CUTOFF} 23:00:00", px.CUTOFF, "2001-06-28", "post")
    return px.present(rows)


# --- rotation ---------------------------------------------------------------------


def rotated(spark, sf, rank_by="absolute"):
    m = px.market(spark, sf)
    return sec.rotation(sector_members(spark, sf), m.bars, m.sessions, m.benchmark, "monthly", px.CUTOFF, YEARS, rank_by)


def rotation_sql():
    from ledgertide.plans.market_queries import MONTHS, candle_sql

    return candle_sql(MONTHS) + """
, mb AS (SELECT r_name AS id, 'S' || r_regionkey AS symbol, r_regionkey AS pos FROM region),
yr AS (SELECT id, pos, cd.symbol, period, y, cur, status, CASE WHEN status IN ('complete', 'in_progress') THEN change END AS v FROM cd JOIN mb USING (symbol)),
rk AS (SELECT *, rank() OVER (PARTITION BY period, y ORDER BY v DESC) AS rt, rank() OVER (PARTITION BY period, y ORDER BY v) AS rb FROM yr WHERE v IS NOT NULL)
"""


@query("rank_min_both", rotation_sql() + "SELECT id, period, CAST(y AS BIGINT) AS year, rt AS rank_top, rb AS rank_bottom FROM rk")
def rank_min_both(spark, sf):
    yearly = rotated(spark, sf)[1].where("value IS NOT NULL")
    return px.present(yearly.select("id", "period", "year", "rank_top", "rank_bottom"))


@query("rotation", rotation_sql() + """
, md AS (SELECT id, period, quantile_cont(v, 0.5) AS median FROM yr WHERE NOT cur AND status = 'complete' GROUP BY 1, 2),
ct AS (SELECT id, period, count(*) AS n, count(*) FILTER (WHERE rt <= 3) AS t, count(*) FILTER (WHERE rb <= 3) AS b FROM rk WHERE NOT cur AND status = 'complete' GROUP BY 1, 2)
SELECT p.id, p.period, CASE WHEN median IS NOT NULL THEN rank() OVER (PARTITION BY p.period, median IS NULL ORDER BY median DESC) END AS rank, round(median, 6) AS median,
  coalesce(n, 0) AS counted_years, coalesce(t, 0) AS top_count, coalesce(b, 0) AS bottom_count
FROM (SELECT DISTINCT id, period FROM yr) p LEFT JOIN md USING (id, period) LEFT JOIN ct USING (id, period)""")
def rotation(spark, sf):
    overall = rotated(spark, sf)[0]
    return px.present(overall.select("id", "period", "rank", "median", "counted_years", "top_count", "bottom_count"))


@query("rotation_leaders", rotation_sql() + """
SELECT period, CAST(y AS BIGINT) AS year, count(*) AS participants, first(id ORDER BY rt, pos) AS first_id, CASE WHEN count(*) > 1 THEN last(id ORDER BY rt, pos) END AS last_id FROM rk GROUP BY 1, 2""")
def rotation_leaders(spark, sf):
    return px.present(rotated(spark, sf)[2])
