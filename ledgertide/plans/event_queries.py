"""Event-study queries: windows, paths, groups, ranks and context over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.functions import stats
from ledgertide.operators import calendar as cal
from ledgertide.operators import events as evt
from ledgertide.plans import proxies as px
from ledgertide.plans.market_queries import two
from ledgertide.plans.registry import query

N = 5

WINDOWED = px.with_ctes(px.PX, px.EVENTS) + f"""
, cut AS (SELECT prev_incl AS k FROM spine WHERE d = DATE '{px.CUTOFF}'),
er AS (SELECT ev.*, CASE session WHEN 'after_close' THEN next_excl ELSE next_incl END AS r, prev_incl = next_incl AS open_day FROM ev JOIN spine s ON s.d = ev.ed),
bn AS (SELECT symbol, no, px.d, o, h, l, c FROM px JOIN ses ON ses.d = px.d WHERE px.d <= DATE '{px.CUTOFF}'),
wd AS (SELECT * FROM (VALUES ('before', -{N + 1}, -1, 'c'), ('reaction', -1, 0, 'c'), ('gap', -1, 0, 'o'), ('after', 0, {N}, 'c')) t(wname, s, e, f)),
ew AS (SELECT er.*, wname, r + e > k AS pending, CASE WHEN r + e <= k THEN CASE f WHEN 'o' THEN b.o ELSE b.c END / a.c - 1 END AS value,
    CASE WHEN r + e <= k THEN CASE f WHEN 'o' THEN mb.o ELSE mb.c END / ma.c - 1 END AS bench, CASE WHEN r + e <= k THEN CASE f WHEN 'o' THEN sb.o ELSE sb.c END / sa.c - 1 END AS sect
  FROM er CROSS JOIN wd CROSS JOIN cut LEFT JOIN bn a ON a.symbol = ticker AND a.no = r + s LEFT JOIN bn b ON b.symbol = ticker AND b.no = r + e
  LEFT JOIN bn ma ON ma.symbol = '^ALL' AND ma.no = r + s LEFT JOIN bn mb ON mb.symbol = '^ALL' AND mb.no = r + e
  LEFT JOIN bn sa ON sa.symbol = sector_symbol AND sa.no = r + s LEFT JOIN bn sb ON sb.symbol = sector_symbol AND sb.no = r + e),
xp AS (SELECT *, (eps_actual - eps_estimate) / abs(nullif(eps_estimate, 0)) AS eps, (revenue_actual - revenue_estimate) / abs(nullif(revenue_estimate, 0)) AS rev FROM er),
xg AS (SELECT *, CASE WHEN eps IS NULL THEN 'no_data' WHEN abs(eps) < 0.01 THEN 'inline' WHEN eps > 0 THEN 'beat' ELSE 'miss' END AS sg, coalesce(guidance, 'no_data') AS gg FROM xp),
mc AS (SELECT er.event_pos, ctx_major AND ctx_category IN ('macro', 'policy', 'geopolitical') AND ctx_date BETWEEN lo.d AND hi.d AS macro
  FROM er LEFT JOIN ses lo ON lo.no = r - 2 LEFT JOIN ses hi ON hi.no = r + 2)
"""


def studied(spark, sf, events=None):
    m = px.market(spark, sf)
    rows = evt.analyze_events(px.study_events(spark, sf) if events is None else events, m.bars, m.sessions, m.spine, N, px.CUTOFF, m.benchmark, "sector_symbol")
    return rows, m.bars, m.sessions, m.spine


@query("event_windows", WINDOWED + """
SELECT event_pos, wname AS "window", round(value, 6) AS value, CASE WHEN pending THEN 'pending' WHEN value IS NULL THEN 'missing_price' ELSE 'ok' END AS status,
  round(bench, 6) AS benchmark, round(value - bench, 6) AS excess, round(sect, 6) AS sector, round(value - sect, 6) AS sector_excess FROM ew""")
def event_windows(spark, sf):
    rows = studied(spark, sf)[0]
    return px.present(evt.explode_windows(rows, "event_pos"))


@query("event_notes", WINDOWED + """
SELECT event_pos, strftime(a.d, '%Y-%m-%d') AS reaction_date, strftime(b.d, '%Y-%m-%d') AS baseline_date,
  concat_ws(',', CASE WHEN session = 'unknown' THEN 'session_unknown' END, CASE WHEN session <> 'after_close' AND NOT open_day THEN 'market_closed_on_date' END) AS notes
FROM er LEFT JOIN ses a ON a.no = r LEFT JOIN ses b ON b.no = r - 1""")
def event_notes(spark, sf):
    rows, _, dim, _ = studied(spark, sf)
    rows = cal.session_date_of(cal.session_date_of(rows, "reaction_no", dim, "reaction_date"), "baseline_no", dim, "baseline_date")
    return px.present(rows.select("event_pos", "reaction_date", "baseline_date", "notes"))


@query("event_path", WINDOWED + """
, pt AS (SELECT event_pos, CAST(k2 AS BIGINT) AS "offset", p.c / b.c - 1 AS value, mp.c / mb.c - 1 AS bench FROM er CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS k2)
  LEFT JOIN bn b ON b.symbol = ticker AND b.no = r - 1 LEFT JOIN bn p ON p.symbol = ticker AND p.no = r + k2
  LEFT JOIN bn mb ON mb.symbol = '^ALL' AND mb.no = r - 1 LEFT JOIN bn mp ON mp.symbol = '^ALL' AND mp.no = r + k2)
SELECT event_pos, "offset", round(value, 6) AS value, round(bench, 6) AS benchmark FROM pt""")
def event_path(spark, sf):
    return px.present(evt.explode_path(studied(spark, sf)[0], "event_pos").select("event_pos", "offset", "value", "benchmark"))


@query("reaction_candle", WINDOWED + """
SELECT event_pos, round(a.o / b.c - 1, 6) AS open, round(a.h / b.c - 1, 6) AS high, round(a.l / b.c - 1, 6) AS low, round(a.c / b.c - 1, 6) AS close
FROM er JOIN bn b ON b.symbol = ticker AND b.no = r - 1 JOIN bn a ON a.symbol = ticker AND a.no = r""")
def reaction_candle(spark, sf):
    rows = studied(spark, sf)[0].where("reaction_candle IS NOT NULL")
    return px.present(rows.select("event_pos", "reaction_candle.*"))


@query("context_candles", WINDOWED + """
, sp AS (SELECT event_pos, ticker, r, least(r - 6, s.next_incl) AS lo, greatest(r + 5, s.prev_incl) AS hi FROM er JOIN spine s ON s.d = ctx_date)
SELECT event_pos, count(*) AS candles, count(c) AS with_close, CAST(min(ses.no - r) AS BIGINT) AS first_offset, CAST(max(ses.no - r) AS BIGINT) AS last_offset
FROM sp JOIN ses ON ses.no BETWEEN lo AND hi LEFT JOIN bn ON bn.symbol = ticker AND bn.no = ses.no GROUP BY 1""")
def context_candles(spark, sf):
    rows, bars, dim, spine = studied(spark, sf)
    candles = evt.context_candles(rows, bars, dim, spine, N, px.CUTOFF)
    return px.present(candles.groupBy("event_pos").agg(
        F.count("*").alias("candles"), F.count("close").alias("with_close"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")))


STAT_SQL = """count(value) AS n, count(*) FILTER (WHERE value > 0) AS up, count(*) FILTER (WHERE value = 0) AS flat, round(quantile_cont(value, 0.5), 6) AS median,
  round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(abs(value), 0.5), 6) AS abs_median,
  count(value - bench) AS paired_n, count(*) FILTER (WHERE value - bench > 0) AS beat, round(quantile_cont(value - bench, 0.5), 6) AS median_excess,
  round(quantile_cont(bench, 0.5) FILTER (WHERE value - bench IS NOT NULL), 6) AS benchmark_median, count(*) FILTER (WHERE value - sect > 0) AS sector_beat,
  round(quantile_cont(value - sect, 0.5), 6) AS sector_median_excess"""
STAT_COLUMNS = ("n", "up", "flat", "median", "mean", "q25", "q75", "abs_median", "paired_n", "beat", "median_excess", "benchmark_median", "sector_beat", "sector_median_excess")


@query("window_stats", WINDOWED + f"""
SELECT ticker, wname AS "window", {STAT_SQL} FROM ew WHERE value IS NOT NULL GROUP BY 1, 2""")
def window_stats(spark, sf):
    rows = studied(spark, sf, evt.alike(px.study_events(spark, sf)))[0]
    return px.present(evt.window_stats(evt.explode_windows(rows, "ticker", "events"), ["ticker"], "events").select("ticker", "window", *STAT_COLUMNS))


@query("path_stats", WINDOWED + """
, pt AS (SELECT ticker, CAST(k2 AS BIGINT) AS "offset", p.c / b.c - 1 AS value, mp.c / mb.c - 1 AS bench FROM er CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS k2)
  LEFT JOIN bn b ON b.symbol = ticker AND b.no = r - 1 LEFT JOIN bn p ON p.symbol = ticker AND p.no = r + k2
  LEFT JOIN bn mb ON mb.symbol = '^ALL' AND mb.no = r - 1 LEFT JOIN bn mp ON mp.symbol = '^ALL' AND mp.no = r + k2)
SELECT ticker, "offset", count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
  round(quantile_cont(bench, 0.5), 6) AS benchmark_median FROM pt GROUP BY 1, 2""")
def path_stats(spark, sf):
    rows = evt.path_stats(evt.explode_path(studied(spark, sf, evt.alike(px.study_events(spark, sf)))[0], "ticker", "events"), ["ticker"], "events")
    return px.present(rows.select("ticker", "offset", "n", "median", "q25", "q75", "benchmark_median"))


@query("surprise", WINDOWED + """
SELECT event_pos, eps AS eps_surprise, rev AS revenue_surprise, sg AS surprise_group, gg AS guidance_group FROM xg""")
def surprise(spark, sf):
    rows = evt.expectations(px.study_events(spark, sf))
    return px.present(rows.select("event_pos", "eps_surprise", "revenue_surprise", "surprise_group", "guidance_group"), exact=("eps_surprise", "revenue_surprise"))


@query("event_groups", WINDOWED + f"""
, gr AS (SELECT ew.*, u.gk, u.gv FROM ew JOIN xg USING (event_pos), LATERAL (SELECT unnest([{{'gk': 'all', 'gv': 'all'}}, {{'gk': 'quarter', 'gv': 'Q' || xg.fiscal_quarter}},
    {{'gk': 'surprise', 'gv': sg}}, {{'gk': 'guidance', 'gv': gg}}], recursive := true)) u)
SELECT ticker, gk AS group_kind, gv AS group_key, wname AS "window", {STAT_SQL} FROM gr WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4""")
def event_groups(spark, sf):
    events = evt.alike(evt.expectations(px.study_events(spark, sf)), "fiscal_quarter", "surprise_group", "guidance_group")
    rows = evt.event_groups(studied(spark, sf, events)[0])
    keys = ["ticker", "group_kind", "group_key"]
    return px.present(evt.window_stats(evt.explode_windows(rows, *keys, "events"), keys, "events").select(*keys, "window", *STAT_COLUMNS))


@query("join_context_window", WINDOWED + """
SELECT event_pos, CAST(coalesce(macro, FALSE) AS BIGINT) AS macro_items FROM mc""")
def join_context_window(spark, sf):
    rows, _, dim, spine = studied(spark, sf)
    return px.present(evt.macro_events(rows, spine, dim).select("event_pos", F.size("macro_items").cast("long").alias("macro_items")))


@query("exclude_macro", WINDOWED + f"""
SELECT ticker, wname AS "window", {STAT_SQL}, (SELECT count(*) FROM mc JOIN er e2 USING (event_pos) WHERE macro AND e2.ticker = ew.ticker) AS macro_excluded
FROM ew JOIN mc USING (event_pos) WHERE value IS NOT NULL AND NOT coalesce(macro, FALSE) GROUP BY 1, 2""")
def exclude_macro(spark, sf):
    rows, _, dim, spine = studied(spark, sf)
    kept, excluded = evt.exclude_macro(evt.macro_events(rows, spine, dim))
    result = evt.window_stats(evt.explode_windows(kept, "ticker"), ["ticker"]).join(excluded, "ticker", "left")
    return px.present(result.select("ticker", "window", *STAT_COLUMNS, "macro_excluded"))


@query("filter_event_rows", WINDOWED + """
SELECT event_pos, round(value, 6) AS reaction FROM ew WHERE wname = 'reaction' AND value > 0 AND fiscal_quarter = 2 AND year(ed) >= 1999 AND session = 'after_close'""")
def filter_event_rows(spark, sf):
    rows = evt.filter_event_rows(studied(spark, sf)[0], px.CUTOFF, quarter=2, recent_years=3, session="after_close", direction="up")
    return px.present(rows.select("event_pos", F.filter("windows", lambda w: w["window"] == "reaction")[0]["value"].alias("reaction")))


@query("event_ranks", WINDOWED + """
SELECT event_pos, ticker, wname AS "window", row_number() OVER (PARTITION BY ticker, wname ORDER BY value, event_pos) AS rank_asc,
  row_number() OVER (PARTITION BY ticker, wname ORDER BY value DESC, event_pos) AS rank_desc FROM ew WHERE value IS NOT NULL""")
def event_ranks(spark, sf):
    events, by = px.study_events(spark, sf), ("ticker", "event_date", "session", "sector_symbol")
    values = evt.explode_windows(studied(spark, sf, evt.alike(events))[0], *by).where("value IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in by], "window", "value")
    same = [events[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    rows = evt.event_ranks(events.select("event_pos", *by).join(values, same).select("event_pos", "ticker", "window", "value"))
    return px.present(rows.select("event_pos", "ticker", "window", "rank_asc", "rank_desc"))


@query("quarter_ranks", WINDOWED + """
, q AS (SELECT ticker, fiscal_quarter, wname, quantile_cont(value, 0.5) AS median, count(*) FILTER (WHERE value > 0) / count(value) AS up_ratio,
    quantile_cont(value - bench, 0.5) AS median_excess, quantile_cont(value - sect, 0.5) AS sector_median_excess FROM ew WHERE value IS NOT NULL GROUP BY 1, 2, 3),
u AS (UNPIVOT q ON median, up_ratio, median_excess, sector_median_excess INTO NAME metric VALUE v)
SELECT ticker, fiscal_quarter, wname AS "window", metric, row_number() OVER (PARTITION BY ticker, wname, metric ORDER BY v, fiscal_quarter) AS rank_asc,
  row_number() OVER (PARTITION BY ticker, wname, metric ORDER BY v DESC, fiscal_quarter) AS rank_desc FROM u""")
def quarter_ranks(spark, sf):
    long = evt.explode_windows(studied(spark, sf, evt.alike(px.study_events(spark, sf), "fiscal_quarter"))[0], "ticker", "fiscal_quarter", "events")
    ranked = evt.quarter_ranks(evt.window_stats(long, ["ticker", "fiscal_quarter"], "events"))
    return px.present(ranked.select("ticker", "fiscal_quarter", "window", "metric", "rank_asc", "rank_desc"))


@query("needed_range", WINDOWED + f"""
, g AS (SELECT ticker, min(r) - 6 AS lo, max(r) + 5 AS hi, min(ctx_date) AS c0, max(ctx_date) AS c1 FROM er GROUP BY 1)
SELECT ticker, strftime(least(a.d, c0), '%Y-%m-%d') AS start_date, strftime(greatest(least(a.d, c0), least(DATE '{px.AT}', greatest(coalesce(b.d, DATE '{px.AT}'), c1))), '%Y-%m-%d') AS end_date
FROM g LEFT JOIN ses a ON a.no = lo LEFT JOIN ses b ON b.no = hi""")
def needed_range(spark, sf):
    dim, spine = two(spark, sf)
    return px.present(evt.needed_range(px.study_events(spark, sf), dim, spine, N, px.AT))


@query("distribution_any_size", WINDOWED + """
SELECT wname AS "window", round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
  round(quantile_cont(value, 0.99), 6) AS q99 FROM ew WHERE value IS NOT NULL GROUP BY 1""")
def distribution_any_size(spark, sf):
    long = evt.explode_windows(studied(spark, sf, evt.alike(px.study_events(spark, sf)))[0], "events")
    return px.present(stats.distributed_quantiles(long, ["window"], "value", (0.25, 0.5, 0.75, 0.99), "events"))
