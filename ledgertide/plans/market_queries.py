"""Bars and seasonality queries over the proxy bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.functions import stats
from ledgertide.operators import bars as bar
from ledgertide.operators import calendar as cal
from ledgertide.operators import seasonality as season
from ledgertide.plans import proxies as px
from ledgertide.plans.registry import query
from ledgertide.session import checkpoint

YEARS = 6


def two(spark, sf):
    dim = checkpoint(px.sessions(spark, sf))
    return dim, checkpoint(cal.date_spine(dim))


def raw_bars(spark, sf):
    """Provider-like records with defects: gaps, bad highs, negative volumes, splits."""
    n = F.datediff("session_date", F.lit("1995-01-01"))
    return (px.bars(spark, sf, with_index=False)
            .withColumn("open", F.when(n % 31 != 0, F.col("open")))
            .withColumn("high", F.when(n % 37 == 0, F.col("low") / 2).otherwise(F.col("high")))
            .withColumn("low", F.when(n % 41 == 0, F.lit(0.0)).otherwise(F.col("low")))
            .withColumn("volume", F.when(n % 43 == 0, F.lit(-1.0)).otherwise(F.col("volume")))
            .withColumn("dividends", F.when(n % 47 == 0, F.lit(-1.0)))
            .withColumn("splits", F.when(n % 5 == 0, F.lit(2.0)).when(n % 5 == 1, F.lit(1.0)))
            .withColumn("instrument", F.lit("EQUITY")))


RAW = """
, n AS (SELECT *, datediff('day', DATE '1995-01-01', d) AS n FROM px WHERE symbol <> '^ALL'),
raw AS (SELECT symbol, d, CASE WHEN n % 31 <> 0 THEN o END AS o, CASE WHEN n % 37 = 0 THEN CASE WHEN n % 41 = 0 THEN l ELSE l END / 2 ELSE h END AS h,
    CASE WHEN n % 41 = 0 THEN 0 ELSE l END AS l, c, CASE WHEN n % 43 = 0 THEN -1 ELSE v END AS v,
    CASE WHEN n % 47 = 0 THEN -1 END AS dividends, CASE n % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS splits FROM n),
val AS (SELECT *, CASE WHEN d > DATE '2001-06-29' THEN 'UNCONFIRMED' WHEN o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL THEN 'MISSING_FIELDS'
    WHEN least(o, h, l, c) <= 0 THEN 'INVALID' WHEN h < greatest(o, l, c) OR l > least(o, h, c) OR v < 0 THEN 'INVALID' ELSE 'VALID' END AS status FROM raw)
"""


@query("validate_bars", px.with_ctes(px.PX) + RAW + """
SELECT symbol, strftime(d, '%Y-%m-%d') AS session_date, status,
  CASE status WHEN 'UNCONFIRMED' THEN 'unconfirmed' WHEN 'MISSING_FIELDS' THEN 'missing_fields'
    WHEN 'INVALID' THEN CASE WHEN least(o, h, l, c) <= 0 THEN 'not_positive' ELSE 'inconsistent' END END AS reason FROM val""")
def validate_bars(spark, sf):
    checked = bar.validate_bars(raw_bars(spark, sf), px.CUTOFF)
    return px.present(checked.select("symbol", "session_date", "status", "reason"))


@query("review_bar_jumps", px.with_ctes(px.PX) + RAW + """
, st AS (SELECT val.*, no, CASE WHEN dividends < 0 OR splits < 0 THEN 'NEEDS_REVIEW' WHEN no IS NULL AND val.d <= DATE '2001-06-29' THEN 'INVALID'
    ELSE status END AS s1, CASE WHEN dividends < 0 OR splits < 0 THEN 'bad_action' WHEN no IS NULL AND val.d <= DATE '2001-06-29' THEN 'not_session' END AS r1
  FROM val LEFT JOIN ses ON ses.d = val.d),
jp AS (SELECT a.*, coalesce(a.s1 = 'VALID' AND NOT coalesce(a.splits NOT IN (0, 1), FALSE) AND b.c > 0 AND abs(a.c / b.c - 1) >= 0.5, FALSE) AS jump
  FROM st a LEFT JOIN st b ON b.symbol = a.symbol AND b.no = a.no - 1 AND b.s1 = 'VALID'),
br AS (SELECT *, max(CASE WHEN NOT jump THEN no END) OVER (PARTITION BY symbol ORDER BY no) AS last_calm_row,
    CASE WHEN jump THEN no - row_number() OVER (PARTITION BY symbol, jump ORDER BY no) END AS island FROM jp),
fl AS (SELECT *, jump AND (no - min(no) OVER (PARTITION BY symbol, island)) % 2 = 0 AS flagged FROM br)
SELECT symbol, strftime(d, '%Y-%m-%d') AS session_date, CASE WHEN flagged THEN 'NEEDS_REVIEW' ELSE s1 END AS status,
  CASE WHEN flagged THEN 'jump' ELSE r1 END AS reason FROM fl""")
def review_bar_jumps(spark, sf):
    checked = bar.validate_bars(raw_bars(spark, sf), px.CUTOFF).withColumn("reason", F.lit(None).cast("string"))
    rows = bar.review_bar_jumps(checkpoint(checked), px.sessions(spark, sf), px.CUTOFF)
    return px.present(rows.select("symbol", "session_date", "status", "reason"))


@query("reject_duplicate_sessions", """
SELECT 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS session_date, count(*) AS copies
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def reject_duplicate_sessions(spark, sf):
    rows = px.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("session_date"))
    return px.present(bar.reject_duplicate_sessions(rows))


@query("prior_session_close", px.with_ctes(px.PX) + """
SELECT a.symbol, strftime(a.d, '%Y-%m-%d') AS session_date, a.c AS close, b.c AS prior_close
FROM px a JOIN ses s ON s.d = a.d LEFT JOIN ses p ON p.no = s.no - 1 LEFT JOIN px b ON b.symbol = a.symbol AND b.d = p.d""")
def prior_session_close(spark, sf):
    m = px.market(spark, sf)
    rows = bar.prior_session_close(m.bars, m.sessions)
    return px.present(rows.select("symbol", "session_date", "close", "prior_close"), exact=("close", "prior_close"))


def responses(spark, sf):
    key = F.col("s_suppkey")
    exchange = F.element_at(F.array(*[F.lit(x) for x in ("NMS", "NYQ", "LSE", "BATS")]), (key % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("EQUITY", "ETF", "INDEX")]), (key % 3 + 1).cast("int"))
    symbol = F.when(key % 25 == 7, "^GSPC").otherwise(F.format_string("T%d", key))
    return px.table(spark, sf, "supplier").select(
        key.alias("security_id"), symbol.alias("symbol"), symbol.alias("reported_symbol"), kind.alias("quote_type"),
        exchange.alias("exchange"), F.when(key % 5 == 0, "EUR").otherwise("USD").alias("currency"))


RESPONSES = """
WITH r AS (SELECT s_suppkey AS security_id, CASE WHEN s_suppkey % 25 = 7 THEN '^GSPC' ELSE 'T' || s_suppkey END AS symbol,
    ['EQUITY', 'ETF', 'INDEX'][s_suppkey % 3 + 1] AS quote_type, ['NMS', 'NYQ', 'LSE', 'BATS'][s_suppkey % 4 + 1] AS exchange,
    CASE WHEN s_suppkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM supplier)
"""


@query("resolve_identity", RESPONSES + """
, x AS (SELECT *, symbol = '^GSPC' AND quote_type = 'INDEX' AND currency = 'USD' AS idx FROM r)
SELECT security_id, symbol, CASE WHEN idx OR (quote_type IN ('EQUITY', 'ETF') AND exchange <> 'LSE') THEN 'XNYS' END AS calendar,
  CASE WHEN idx THEN 'VERIFIED' WHEN symbol IN ('T4', '^GSPC') THEN 'VERIFIED_MARKET'
    WHEN quote_type IN ('EQUITY', 'ETF') AND exchange <> 'LSE' AND currency = 'USD' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status FROM x""")
def resolve_identity(spark, sf):
    rows = bar.resolve_identity(responses(spark, sf), markets=("T4", "^GSPC"))
    return px.present(rows.select("security_id", "symbol", "calendar", "status"))


@query("identity_conflicts", """
WITH r AS (SELECT s_suppkey AS id, 'T' || s_suppkey AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 't' || s_suppkey || ' ' WHEN s_suppkey % 4 = 1
    THEN 'T' || s_suppkey || '.B' ELSE 'Q' || s_suppkey END AS rs, CASE WHEN s_suppkey % 6 = 0 THEN 'GBp' WHEN s_suppkey % 6 <> 1 THEN 'USD' END AS rc,
    CASE WHEN s_suppkey % 7 = 0 THEN 'ETF' WHEN s_suppkey % 7 = 1 THEN 'UNKNOWN' ELSE 'EQUITY' END AS ri FROM supplier)
SELECT id AS security_id, 'symbol' AS field, upper(trim(rs)) AS actual, symbol AS expected FROM r
  WHERE upper(trim(rs)) <> symbol AND NOT (id % 4 = 1 AND id % 8 = 1)
UNION ALL SELECT id, 'currency', rc, 'USD' FROM r WHERE rc <> 'USD'
UNION ALL SELECT id, 'instrument', ri, 'EQUITY' FROM r WHERE ri NOT IN ('EQUITY', 'UNKNOWN')""")
def identity_conflicts(spark, sf):
    key = F.col("s_suppkey")
    stated = (F.when(key % 4 == 0, F.format_string("t%d ", key)).when(key % 4 == 1, F.format_string("T%d.B", key))
              .otherwise(F.format_string("Q%d", key)))
    rows = px.table(spark, sf, "supplier").select(
        key.alias("security_id"), F.format_string("T%d", key).alias("symbol"), F.lit("USD").alias("currency"),
        F.lit("EQUITY").alias("instrument"), stated.alias("response_symbol"), F.lit(None).cast("string").alias("metadata_symbol"),
        F.when(key % 6 == 0, "GBp").when(key % 6 != 1, "USD").alias("response_currency"),
        F.when(key % 7 == 0, "ETF").when(key % 7 == 1, "UNKNOWN").otherwise("EQUITY").alias("response_instrument"),
        F.lit(None).cast("string").alias("quote_type"))
    aliases = px.table(spark, sf, "supplier").where(key % 4 == 1).select(
        key.alias("security_id"), F.format_string("T%d.B", key).alias("symbol"), F.lit("1990-01-01").cast("date").alias("valid_from"),
        F.when(key % 8 == 5, F.lit("1999-01-01").cast("date")).alias("valid_to"))
    return px.present(bar.identity_conflicts(rows, aliases, px.AT))


def wanted_ranges(spark, sf):
    """One wanted price range per symbol and region: first to last order day of the customers mapped to it."""
    return px.table(spark, sf, "orders").groupBy(
        F.concat(F.lit("S"), (F.col("o_custkey") % 11).cast("string")).alias("symbol")).agg(
        F.min(F.to_date("o_orderdate")).alias("start_date"), F.max(F.to_date("o_orderdate")).alias("end_date"))


RANGES = """
, rg AS (SELECT 'S' || CAST(o_custkey % 11 AS VARCHAR) AS symbol, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)
"""


@query("coverage", px.with_ctes(px.PX) + RANGES + """
, e AS (SELECT rg.symbol, a, b, ses.d, px.d IS NOT NULL AS have FROM rg JOIN ses ON ses.d BETWEEN a AND b LEFT JOIN px ON px.symbol = rg.symbol AND px.d = ses.d)
SELECT symbol, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date, count(*) AS expected, count(*) FILTER (WHERE have) AS valid,
  count(*) FILTER (WHERE NOT have) AS missing, count(*) FILTER (WHERE NOT have AND d <= DATE '2001-06-29') AS gaps,
  CASE WHEN count(*) FILTER (WHERE have) = 0 THEN 'NOT_FETCHED' WHEN count(*) FILTER (WHERE NOT have AND d <= DATE '2001-06-29') = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage
FROM e GROUP BY symbol, a, b""")
def coverage(spark, sf):
    m = px.market(spark, sf)
    return px.present(bar.coverage(wanted_ranges(spark, sf), m.bars, m.sessions, m.spine, px.CUTOFF))


@query("coverage_of_many_ranges", px.with_ctes(px.PX) + """
, r AS (SELECT DISTINCT 'S' || CAST(o_custkey % 8 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 20 + CAST(o_orderkey % 3 AS INTEGER) AS b FROM orders WHERE o_orderdate < DATE '1998-06-01'),
e AS (SELECT r.symbol, a, b, ses.d, px.d IS NOT NULL AS have FROM r JOIN ses ON ses.d BETWEEN a AND b LEFT JOIN px ON px.symbol = r.symbol AND px.d = ses.d)
SELECT symbol, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date, count(*) AS expected, count(*) FILTER (WHERE have) AS valid,
  count(*) FILTER (WHERE NOT have) AS missing, count(*) FILTER (WHERE NOT have AND d <= DATE '1995-06-30') AS gaps,
  CASE WHEN count(*) FILTER (WHERE have) = 0 THEN 'NOT_FETCHED' WHEN count(*) FILTER (WHERE NOT have AND d <= DATE '1995-06-30') = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage
FROM e GROUP BY symbol, a, b""")
def coverage_of_many_ranges(spark, sf):
    m = px.market(spark, sf)
    first = F.to_date("o_orderdate")
    ranges = px.table(spark, sf, "orders").where("o_orderdate < DATE '1998-06-01'").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 8).cast("string")).alias("symbol"), first.alias("start_date"), F.date_add(first, 20 + (F.col("o_orderkey") % 3).cast("int")).alias("end_date")).distinct()
    return px.present(bar.coverage(ranges, m.bars, m.sessions, m.spine, "1995-06-30"))


@query("anti_missing_sessions", px.with_ctes(px.PX) + RANGES + """
SELECT rg.symbol, strftime(ses.d, '%Y-%m-%d') AS session_date, CAST(ses.no AS BIGINT) AS session_no FROM rg JOIN ses ON ses.d BETWEEN a AND b
WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.symbol = rg.symbol AND px.d = ses.d)""")
def anti_missing_sessions(spark, sf):
    m = px.market(spark, sf)
    return px.present(bar.missing_sessions(wanted_ranges(spark, sf), m.bars, m.sessions, m.spine))


@query("merge_ranges", """
WITH r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, max(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER)) AS b FROM orders GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a) AS island FROM f)
SELECT k AS customer, strftime(min(a), '%Y-%m-%d') AS first_day, strftime(max(b), '%Y-%m-%d') AS last_day FROM i GROUP BY k, island""")
def merge_ranges(spark, sf):
    rows = px.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("first_day"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int")).alias("last_day"))
    return px.present(bar.merge_ranges(rows, ["customer"], "first_day", "last_day"))


@query("scan_bars_ranges", px.with_ctes(px.PX) + """
, r AS (SELECT DISTINCT 'S' || CAST(o_custkey % 8 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 2 AS b FROM orders)
SELECT symbol, strftime(d, '%Y-%m-%d') AS session_date, c AS close FROM px
WHERE EXISTS (SELECT 1 FROM r WHERE r.symbol = px.symbol AND px.d BETWEEN a AND b)""")
def scan_bars_ranges(spark, sf):
    ranges = px.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 8).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("start_date"),
        F.date_add(F.to_date("o_orderdate"), 2).alias("end_date"))
    return px.present(bar.scan_bars_ranges(px.bars(spark, sf), ranges).select("symbol", "session_date", "close"), exact=("close",))


@query("scan_source_priority", px.with_ctes(px.PX) + """
, u AS (SELECT 0 AS r, symbol, d, c FROM px WHERE symbol IN ('S0', 'S1', 'S2') UNION ALL SELECT 1, symbol, d, c FROM px WHERE symbol IN ('S2', 'S3', 'S4')
  UNION ALL SELECT 2, symbol, d, c FROM px)
SELECT symbol, CAST(r AS BIGINT) AS source_rank, strftime(d, '%Y-%m-%d') AS session_date, c AS close FROM u
QUALIFY r = min(r) OVER (PARTITION BY symbol)""")
def scan_source_priority(spark, sf):
    bars = px.market(spark, sf).bars.select("symbol", "session_date", "close")
    long_store, fetched = bars.where("symbol IN ('S0', 'S1', 'S2')"), bars.where("symbol IN ('S2', 'S3', 'S4')")
    return px.present(bar.scan_source_priority(long_store, fetched, bars), exact=("close",))


@query("resample_ohlc", px.with_ctes(px.PX) + """
, k AS (SELECT 'day' AS i, symbol, d AS p, d, o, h, l, c FROM px UNION ALL SELECT 'week', symbol, CAST(date_trunc('week', d) AS DATE), d, o, h, l, c FROM px
  UNION ALL SELECT 'month', symbol, CAST(date_trunc('month', d) AS DATE), d, o, h, l, c FROM px)
SELECT i AS "interval", symbol, strftime(min(d), '%Y-%m-%d') AS start_date, strftime(max(d), '%Y-%m-%d') AS end_date, first(o ORDER BY d) AS open,
  max(h) AS high, min(l) AS low, last(c ORDER BY d) AS close, count(*) AS sessions FROM k GROUP BY i, symbol, p""")
def resample_ohlc(spark, sf):
    bars = px.market(spark, sf).bars
    frames = [bar.resample_ohlc(bars, i).withColumn("interval", F.lit(i)).drop("period_start") for i in ("day", "week", "month")]
    return px.present(frames[0].unionByName(frames[1]).unionByName(frames[2]), exact=bar.PRICES)


@query("first_trading_day", px.with_ctes(px.PX) + """
SELECT symbol, strftime(min(d), '%Y-%m-%d') AS first_day FROM px GROUP BY 1""")
def first_trading_day(spark, sf):
    return px.present(bar.first_trading_day(px.bars(spark, sf)))


@query("bar_inventory", px.with_ctes(px.PX) + """
, sr AS (SELECT DISTINCT 'S' || CAST(s_suppkey % 9 AS VARCHAR) AS symbol, s_suppkey % 9 <> 4 AS active FROM supplier),
h AS (SELECT symbol, count(*) AS n, min(d) AS a, max(d) AS b FROM px GROUP BY 1),
g AS (SELECT h.symbol, count(*) FILTER (WHERE px.d IS NULL) AS gaps FROM h JOIN ses ON ses.d BETWEEN h.a AND DATE '2001-06-29' LEFT JOIN px ON px.symbol = h.symbol AND px.d = ses.d GROUP BY 1)
SELECT sr.symbol, active, coalesce(n, 0) AS bars, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS last_date, coalesce(gaps, 0) AS gap_days,
  active AND coalesce(n, 0) > 0 AND coalesce(gaps, 0) = 0 AS ready FROM sr LEFT JOIN h USING (symbol) LEFT JOIN g USING (symbol)""")
def bar_inventory(spark, sf):
    m = px.market(spark, sf)
    number = F.col("s_suppkey") % 9
    series = px.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), number.cast("string")).alias("symbol"), (number != 4).alias("active")).distinct()
    return px.present(bar.bar_inventory(series, m.bars, m.sessions, m.spine, px.CUTOFF))


# Two full refetches (S1 halved, S6 as it was) and partial ones: S5 halved, S2 within tolerance, S3 with a gap, S4 with a price gone.
@query("correct_bars", px.with_ctes(px.PX) + """
, st AS (SELECT symbol, d, o, h, l, c FROM px WHERE d < DATE '2001-06-01'),
fe AS (SELECT symbol, d, o * f AS o, h * f AS h, l * f AS l, CASE WHEN symbol = 'S4' AND day(d) = 7 THEN NULL ELSE c * f END AS c
  FROM (SELECT *, CASE WHEN symbol IN ('S1', 'S5') THEN 0.5 WHEN symbol = 'S2' THEN 1.000001 ELSE 1 END AS f FROM px WHERE (d >= DATE '2001-01-01' OR symbol IN ('S1', 'S6')) AND NOT (symbol = 'S3' AND day(d) = 15))),
r AS (SELECT symbol, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT symbol, min(d) AS lo, max(d) AS hi FROM st GROUP BY 1) a JOIN (SELECT symbol, min(d) AS lo, max(d) AS hi FROM fe GROUP BY 1) b USING (symbol)),
k AS (SELECT st.symbol FROM st JOIN fe USING (symbol, d) WHERE (st.c IS NULL) <> (fe.c IS NULL) OR abs(st.c - fe.c) > greatest(1e-4, abs(st.c) * 1e-5) OR abs(st.o - fe.o) > greatest(1e-4, abs(st.o) * 1e-5)
  OR abs(st.h - fe.h) > greatest(1e-4, abs(st.h) * 1e-5) OR abs(st.l - fe.l) > greatest(1e-4, abs(st.l) * 1e-5)
  UNION SELECT symbol FROM (SELECT symbol, d FROM st UNION ALL SELECT symbol, d FROM fe) u JOIN r USING (symbol) WHERE d BETWEEN lo AND hi GROUP BY symbol, d HAVING count(*) = 1),
al AS (SELECT *, FALSE AS replaced, symbol IN (FROM k) AS needs_full FROM st WHERE symbol NOT IN (FROM k) OR symbol NOT IN ('S1', 'S6')
  UNION ALL SELECT *, TRUE, FALSE FROM fe WHERE symbol IN (FROM k) AND symbol IN ('S1', 'S6')
  UNION ALL SELECT fe.*, FALSE, FALSE FROM fe ANTI JOIN st USING (symbol, d) WHERE symbol NOT IN (FROM k))
SELECT symbol, strftime(d, '%Y-%m-%d') AS session_date, o AS open, h AS high, l AS low, c AS close, replaced, needs_full FROM al""")
def correct_bars(spark, sf):
    bars = px.market(spark, sf).bars.select("symbol", "session_date", *bar.PRICES)
    factor = F.when(F.col("symbol").isin("S1", "S5"), 0.5).when(F.col("symbol") == "S2", 1.000001).otherwise(1.0)
    full, day = F.col("symbol").isin("S1", "S6"), F.dayofmonth("session_date")
    fetched = bars.where((F.col("session_date") >= "2001-01-01") | full).where(~((F.col("symbol") == "S3") & (day == 15))).select(
        "symbol", "session_date", full.alias("is_full"), *[(F.col(c) * factor).alias(c) for c in bar.PRICES])
    fetched = fetched.withColumn("close", F.when(~((F.col("symbol") == "S4") & (day == 7)), F.col("close")))
    return px.present(bar.correct_bars(bars.where("session_date < '2001-06-01'"), fetched), exact=bar.PRICES)


@query("retain_bars", px.with_ctes(px.PX) + """
SELECT symbol, count(*) AS bars, strftime(min(d), '%Y-%m-%d') AS first_kept FROM px WHERE d >= DATE '1998-01-01' GROUP BY 1""")
def retain_bars(spark, sf):
    kept = bar.retain_bars(px.bars(spark, sf), px.AT, years=3)
    return px.present(kept.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("session_date").alias("first_kept")))


@query("sync_membership", """
WITH de AS (SELECT DISTINCT 'T' || s_suppkey AS symbol FROM supplier WHERE s_suppkey % 3 <> 0),
sr AS (SELECT 'T' || s_suppkey AS symbol, s_suppkey % 5 <> 0 AS active, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2000-01-03' END AS removed_on FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(de.symbol, sr.symbol) AS symbol, CASE WHEN sr.symbol IS NULL THEN 'new' WHEN de.symbol IS NOT NULL AND NOT active THEN 'returned'
    WHEN de.symbol IS NOT NULL THEN 'kept' WHEN active THEN 'removed' ELSE 'unchanged' END AS change, de.symbol IS NOT NULL AS active,
  CASE WHEN de.symbol IS NULL AND active THEN '2001-11-04' WHEN de.symbol IS NULL THEN strftime(removed_on, '%Y-%m-%d') END AS removed_on
FROM de FULL JOIN sr USING (symbol)""")
def sync_membership(spark, sf):
    supplier = px.table(spark, sf, "supplier")
    symbol = F.format_string("T%d", "s_suppkey").alias("symbol")
    desired = supplier.where("s_suppkey % 3 <> 0").select(symbol)
    series = supplier.where("s_suppkey % 2 = 0").select(
        symbol, (F.col("s_suppkey") % 5 != 0).alias("active"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("2000-01-03").cast("date")).alias("removed_on"))
    return px.present(bar.sync_membership(desired, series, True, px.AT))


# --- statistics -------------------------------------------------------------------

BOX = """count(x) AS n, min(x) AS mn, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, avg(x) AS mean,
  quantile_cont(x, 0.75) AS q75, max(x) AS mx, count(*) FILTER (WHERE x > 0) AS up, count(*) FILTER (WHERE x = 0) AS flat"""
DAILY = """
, ch AS (SELECT a.symbol, a.d, a.c / b.c - 1 AS x FROM px a JOIN ses s ON s.d = a.d JOIN ses p ON p.no = s.no - 1 JOIN px b ON b.symbol = a.symbol AND b.d = p.d)
"""


def daily_changes(spark, sf):
    m = px.market(spark, sf)
    rows = bar.prior_session_close(m.bars, m.sessions).where("prior_close IS NOT NULL")
    return rows.select("symbol", "session_date", (F.col("close") / F.col("prior_close") - 1).alias("x"))


@query("distribution", px.with_ctes(px.PX) + DAILY + f"""
, b AS (SELECT symbol, {BOX} FROM ch GROUP BY symbol),
w AS (SELECT ch.symbol, min(x) FILTER (WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS lo,
    max(x) FILTER (WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS hi FROM ch JOIN b USING (symbol) GROUP BY 1),
o AS (SELECT ch.symbol, count(*) AS outliers FROM ch JOIN w USING (symbol) WHERE x < lo OR x > hi GROUP BY 1)
SELECT b.symbol, n, round(mn, 6) AS min, round(q25, 6) AS q25, round(median, 6) AS median, round(mean, 6) AS mean, round(q75, 6) AS q75, round(mx, 6) AS max,
  up, flat, round(up / n, 6) AS up_ratio, round(lo, 6) AS whisker_low, round(hi, 6) AS whisker_high, coalesce(outliers, 0) AS outliers
FROM b JOIN w USING (symbol) LEFT JOIN o USING (symbol)""")
def distribution(spark, sf):
    changes = daily_changes(spark, sf)
    boxes = stats.distribution(changes, ["symbol"], "x")
    beyond = stats.outliers(changes, ["symbol"], "x", boxes).groupBy("symbol").agg(F.count("*").alias("outliers"))
    return px.present(boxes.join(beyond, "symbol", "left").fillna(0, ["outliers"]))


@query("wilson", px.with_ctes(px.PX) + DAILY + """
, n AS (SELECT symbol, year(d) AS y, count(*) AS n, count(*) FILTER (WHERE x > 0) AS u FROM ch GROUP BY 1, 2),
k AS (SELECT *, 1.959963984540054 AS z, u / n AS p FROM n),
i AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS half FROM k)
SELECT symbol, y AS year, n, u AS up, CASE WHEN u = 0 THEN 0 ELSE round(greatest(0, mid - half), 6) END AS up_low,
  CASE WHEN u = n THEN 1 ELSE round(least(1, mid + half), 6) END AS up_high FROM i""")
def wilson(spark, sf):
    grouped = daily_changes(spark, sf).groupBy("symbol", F.year("session_date").alias("year")).agg(
        F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("up"))
    low, high = stats.wilson(F.col("up"), F.col("n"))
    return px.present(grouped.withColumns({"up_low": low, "up_high": high}))


@query("comparison", px.with_ctes(px.PX) + DAILY + """
SELECT strftime(d, '%Y-%m-%d') AS session_date, count(*) AS n, count(*) FILTER (WHERE x > 0) AS positive, round(max(x), 6) AS high,
  first(symbol ORDER BY x DESC, symbol) AS high_ticker, round(min(x), 6) AS low, first(symbol ORDER BY x, symbol DESC) AS low_ticker FROM ch GROUP BY d""")
def comparison(spark, sf):
    return px.present(stats.comparison(daily_changes(spark, sf), "symbol", "x", ["session_date"]))


@query("endpoint_change", px.with_ctes(px.PX) + """
SELECT symbol, year(d) AS year, round(last(c ORDER BY d) / first(c ORDER BY d) - 1, 6) AS change FROM px GROUP BY 1, 2""")
def endpoint_change(spark, sf):
    rows = px.bars(spark, sf).groupBy("symbol", F.year("session_date").alias("year")).agg(
        F.min_by("close", "session_date").alias("first"), F.max_by("close", "session_date").alias("last"))
    return px.present(rows.select("symbol", "year", stats.endpoint_change(F.col("first"), F.col("last")).alias("change")))


@query("max_drawdown", px.with_ctes(px.PX) + """
, g AS (SELECT ticker AS symbol, ses.d, c FROM (SELECT DISTINCT symbol AS ticker FROM px) JOIN ses ON TRUE LEFT JOIN px ON px.symbol = ticker AND px.d = ses.d),
p AS (SELECT symbol, year(d) AS y, c, max(c) OVER (PARTITION BY symbol, year(d) ORDER BY d) AS peak FROM g)
SELECT symbol, y AS year, CASE WHEN NOT bool_or(c IS NULL) THEN round(max(1 - c / peak), 6) END AS max_drawdown FROM p GROUP BY 1, 2""")
def max_drawdown(spark, sf):
    bars, dim = px.market(spark, sf)[:2]
    spans = bars.select("symbol").distinct()
    # Every session of every series, so that a gap shows as a missing price.
    days = dim.agg(F.sort_array(F.collect_list("session_date"))).scalar()
    grid = spans.select("symbol", F.explode(days).alias("session_date"))
    rows = grid.join(bars.select("symbol", "session_date", "close"), ["symbol", "session_date"], "left").withColumn("year", F.year("session_date"))
    return px.present(stats.max_drawdown(rows, ["symbol", "year"], "session_date", "close"))


@query("running_peak", px.with_ctes(px.PX) + """
SELECT symbol, strftime(d, '%Y-%m-%d') AS session_date, max(c) OVER (PARTITION BY symbol ORDER BY d) AS peak FROM px""")
def running_peak(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    return px.present(px.bars(spark, sf).select("symbol", "session_date", F.max("close").over(w).alias("peak")), exact=("peak",))


# --- seasonality ------------------------------------------------------------------


def candle_sql(spans: str) -> str:
    """Candles for ``spans`` = a CTE body giving (period, y, cur, a, b)."""
    return px.with_ctes(px.PX) + f"""
, sp AS ({spans}),
fx AS (SELECT period, y, cur, a, b, count(ses.d) AS expected, max(ses.d) AS last_expected, min(ses.d) FILTER (WHERE ses.d <= DATE '{px.CUTOFF}') AS fd,
    max(ses.d) FILTER (WHERE ses.d <= DATE '{px.CUTOFF}') AS ld FROM sp LEFT JOIN ses ON ses.d BETWEEN a AND b GROUP BY ALL),
g AS (SELECT symbol, fx.* FROM (SELECT DISTINCT symbol FROM px) CROSS JOIN fx),
mk AS (SELECT g.symbol, period, y, px.d, o, h, l, c FROM g JOIN px ON px.symbol = g.symbol AND px.d BETWEEN a AND b JOIN ses ON ses.d = px.d WHERE px.d <= DATE '{px.CUTOFF}'),
ag AS (SELECT symbol, period, y, count(*) AS n, max(d) AS lcd, max(h) AS h, min(l) AS l FROM mk GROUP BY ALL),
e1 AS (SELECT g.*, n, h, l, coalesce(ld < last_expected, FALSE) AS running, CASE WHEN coalesce(ld < last_expected, FALSE) THEN coalesce(lcd, ld) ELSE ld END AS ed
  FROM g LEFT JOIN ag USING (symbol, period, y)),
e2 AS (SELECT e1.*, f.o AS o, t.c AS c, bf.o AS bo, bt.c AS bc, sf.o AS so, st.c AS sc FROM e1 LEFT JOIN px f ON f.symbol = e1.symbol AND f.d = fd LEFT JOIN px t ON t.symbol = e1.symbol AND t.d = ed
  LEFT JOIN px bf ON bf.symbol = '^ALL' AND bf.d = fd LEFT JOIN px bt ON bt.symbol = '^ALL' AND bt.d = ed
  LEFT JOIN px sf ON sf.symbol = 'S0' AND sf.d = fd LEFT JOIN px st ON st.symbol = 'S0' AND st.d = ed),
cd AS (SELECT symbol, period, y, cur, expected, fd, CASE WHEN n > 0 THEN ed END AS ed, n, h, l, o, c,
    CASE WHEN expected = 0 THEN 'no_data' WHEN ld IS NULL THEN 'not_started' WHEN n IS NULL THEN 'no_data' WHEN o IS NULL OR c IS NULL THEN 'incomplete'
      WHEN running THEN 'in_progress' ELSE 'complete' END AS status,
    CASE WHEN n > 0 THEN c / o - 1 END AS change, bc / bo - 1 AS bch, sc / so - 1 AS sch FROM e2)
"""


MONTHS = f"""SELECT CAST(m AS VARCHAR) AS period, y, y = 2001 AS cur, make_date(y, m, 1) AS a, CAST(make_date(y, m, 1) + INTERVAL 1 MONTH AS DATE) - 1 AS b
  FROM (SELECT unnest(generate_series({2001 - YEARS}, 2001)) AS y) CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)"""
INTERVAL = f"""SELECT 'interval' AS period, y, y = 2000 AS cur, make_date(y, 11, 20) AS a, make_date(y + 1, 7, 15) AS b
  FROM (SELECT unnest(generate_series({2000 - YEARS}, 2000)) AS y)"""
CANDLE_COLUMNS = """
SELECT symbol, period, CAST(y AS BIGINT) AS year, status, strftime(fd, '%Y-%m-%d') AS start_date, strftime(ed, '%Y-%m-%d') AS end_date, n AS sessions,
  CASE WHEN status IN ('complete', 'in_progress') THEN round(change, 6) END AS change, CASE WHEN status IN ('complete', 'in_progress') THEN round(h / o - 1, 6) END AS high_change,
  CASE WHEN status IN ('complete', 'in_progress') THEN round(l / o - 1, 6) END AS low_change, CASE WHEN status IN ('complete', 'in_progress') THEN round(change - bch, 6) END AS excess
FROM cd"""
STATS = """
, sm AS (SELECT * FROM cd WHERE NOT cur AND status = 'complete'),
b AS (SELECT symbol, period, count(*) AS n, count(*) FILTER (WHERE change > 0) AS up, quantile_cont(change, 0.5) AS median, avg(change) AS mean, quantile_cont(change, 0.25) AS q25,
    quantile_cont(change, 0.75) AS q75, max(change) AS best, min(change) AS worst, last(y ORDER BY change, y) AS best_year, first(y ORDER BY change, y) AS worst_year,
    count(*) FILTER (WHERE bch IS NOT NULL) AS paired_n, count(*) FILTER (WHERE change - bch > 0) AS beat, quantile_cont(change - bch, 0.5) AS median_excess,
    quantile_cont(bch, 0.5) AS benchmark_median, count(*) FILTER (WHERE change - sch > 0) AS sector_beat, quantile_cont(change - sch, 0.5) AS sector_median_excess
  FROM sm GROUP BY 1, 2),
w AS (SELECT sm.symbol, sm.period, min(change) FILTER (WHERE change BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS lo,
    max(change) FILTER (WHERE change BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS hi FROM sm JOIN b USING (symbol, period) GROUP BY 1, 2),
z AS (SELECT b.*, lo, hi, up / n AS p, 1.959963984540054 AS z FROM b JOIN w USING (symbol, period)),
al AS (SELECT DISTINCT symbol, period FROM cd)
SELECT al.symbol, al.period, coalesce(n, 0) AS n, coalesce(up, 0) AS up, round(median, 6) AS median, round(mean, 6) AS mean, round(q25, 6) AS q25, round(q75, 6) AS q75,
  round(best, 6) AS best, round(worst, 6) AS worst, CAST(best_year AS BIGINT) AS best_year, CAST(worst_year AS BIGINT) AS worst_year, round(lo, 6) AS whisker_low, round(hi, 6) AS whisker_high,
  CASE WHEN n IS NULL THEN NULL WHEN up = 0 THEN 0 ELSE round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) END AS up_low,
  coalesce(paired_n, 0) AS paired_n, coalesce(beat, 0) AS beat, round(median_excess, 6) AS median_excess, round(benchmark_median, 6) AS benchmark_median,
  coalesce(sector_beat, 0) AS sector_beat, round(sector_median_excess, 6) AS sector_median_excess
FROM al LEFT JOIN z ON z.symbol = al.symbol AND z.period = al.period"""
STAT_COLUMNS = ("symbol", "period", "n", "up", "median", "mean", "q25", "q75", "best", "worst", "best_year", "worst_year", "whisker_low",
                "whisker_high", "up_low", "paired_n", "beat", "median_excess", "benchmark_median", "sector_beat", "sector_median_excess")


def references(bars):
    return bars.where(F.col("symbol") == px.BENCHMARK), bars.where(F.col("symbol") == "S0")


@query("period_candle", candle_sql(MONTHS) + CANDLE_COLUMNS)
def period_candle(spark, sf):
    m = px.market(spark, sf)
    study = season.periods("monthly", px.CUTOFF, YEARS)
    rows = season.period_candles(m.bars, m.sessions, study, px.CUTOFF, m.benchmark)
    return px.present(rows.select("symbol", "period", "year", "status", "start_date", "end_date", "sessions", "change", "high_change", "low_change", "excess"))


@query("join_benchmark", candle_sql(INTERVAL) + """
SELECT symbol, CAST(y AS BIGINT) AS year, CASE WHEN change IS NOT NULL THEN round(bch, 6) END AS benchmark_change, round(change - bch, 6) AS excess,
  CASE WHEN change IS NOT NULL THEN round(sch, 6) END AS sector_change, round(change - sch, 6) AS sector_excess FROM cd""")
def join_benchmark(spark, sf):
    m = px.market(spark, sf)
    study = season.periods("interval", px.CUTOFF, YEARS, "11-20", "07-15")
    rows = season.period_candles(m.bars, m.sessions, study, px.CUTOFF, *references(m.bars))
    return px.present(rows.select("symbol", "year", "benchmark_change", "excess", "sector_change", "sector_excess"))


@query("seasonality_monthly", candle_sql(MONTHS) + STATS)
def seasonality_monthly(spark, sf):
    m = px.market(spark, sf)
    market, sector = references(m.bars)
    rows = season.seasonality(m.bars, m.sessions, "monthly", px.CUTOFF, YEARS, benchmark=market, sector=sector)
    return px.present(rows.select(*STAT_COLUMNS))


@query("seasonality_interval", candle_sql(INTERVAL) + STATS)
def seasonality_interval(spark, sf):
    m = px.market(spark, sf)
    market, sector = references(m.bars)
    rows = season.seasonality(m.bars, m.sessions, "interval", px.CUTOFF, YEARS, "11-20", "07-15", benchmark=market, sector=sector)
    return px.present(rows.select(*STAT_COLUMNS))


@query("period_stats", candle_sql(MONTHS) + """
, sm AS (SELECT * FROM cd WHERE NOT cur AND status = 'complete')
SELECT symbol, period, count(*) AS n, count(*) FILTER (WHERE change > 0) AS up, count(*) FILTER (WHERE change = 0) AS flat, round(count(*) FILTER (WHERE change > 0) / count(*), 6) AS up_ratio,
  round(count(*) FILTER (WHERE change - bch > 0) / nullif(count(bch), 0), 6) AS beat_ratio, round(avg(change - bch), 6) AS mean_excess
FROM sm GROUP BY 1, 2""")
def period_stats(spark, sf):
    m = px.market(spark, sf)
    study = season.periods("monthly", px.CUTOFF, YEARS)
    candles = season.period_candles(m.bars, m.sessions, study, px.CUTOFF, m.benchmark)
    rows = season.period_stats(candles, YEARS).where("n > 0")
    return px.present(rows.select("symbol", "period", "n", "up", "flat", "up_ratio", "beat_ratio", "mean_excess"))
