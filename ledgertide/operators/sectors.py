"""Sector and industry-group periods, heat weights, ranks, candles and yearly rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import stats
from ledgertide.operators import calendar as cal
from ledgertide.operators.bars import resample_ohlc, usable
from ledgertide.operators.seasonality import period_candles, period_stats, periods

PERIODS = ("today", "1w", "1m", "3m", "ytd")
# Fixed values of the heat map: smallest tile weight and spread floor per period (as ratios).
MIN_WEIGHT = 0.2
SPREAD_FLOOR = {"today": 0.01, "1w": 0.02, "1m": 0.04, "3m": 0.08, "ytd": 0.08}
TOP = 3
CHART_MONTHS = {"3m": 3, "6m": 6, "1y": 12}


def change6(first: Column, last: Column) -> Column:
    """Change at six places, half-even."""
    return F.bround(stats.endpoint_change(first, last), 6)


def closing_periods(bars: DataFrame, sessions: DataFrame, spine: DataFrame, completed: str,
                    fetched: DataFrame | None = None) -> DataFrame:
    """1w, 1m, 3m and ytd of every symbol, ending at its latest close on or before ``completed``.

    ``fetched`` gives (symbol, fetched_from): only a fetch that asked for earlier dates shows that a
    symbol had not started trading.
    """
    closes = usable(bars).where("close IS NOT NULL")
    ends = closes.groupBy("symbol").agg(
        F.min("session_date").alias("first_day"),
        F.max(F.when(F.col("session_date") <= F.lit(completed).cast("date"), F.col("session_date"))).alias("end_date"))
    if fetched is not None:
        ends = ends.join(fetched.select("symbol", "fetched_from"), "symbol", "left")
    else:
        ends = ends.withColumn("fetched_from", F.lit(None).cast("date"))
    wanted = ends.select("*", F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), cal.period_anchor(F.col("end_date"), p).alias("anchor")) for p in PERIODS[1:]])).alias("_p"))
    wanted = wanted.select(*ends.columns, "_p.*")
    wanted = cal.previous_session(wanted, "anchor", spine, sessions, True, "start_date")
    at = lambda name: closes.select("symbol", F.col("session_date").alias(f"{name}_date"), F.col("close").alias(f"_{name}"))
    rows = wanted.join(at("start"), ["symbol", "start_date"], "left").join(at("end"), ["symbol", "end_date"], "left")
    early = F.col("start_date") < F.col("first_day")
    status = (F.when(F.col("end_date").isNull(), "no_prices")
              .when(early & F.coalesce(F.col("fetched_from") <= F.col("start_date"), F.lit(False)), "before_listing")
              .when(early | F.col("_start").isNull() | F.col("_end").isNull(), "missing").otherwise("available"))
    rows = rows.withColumn("status", status)
    return rows.select("symbol", "period", "start_date", "end_date", "status",
                       F.when(F.col("status") == "available", change6(F.col("_start"), F.col("_end"))).alias("value"))


def today_change(symbols: DataFrame, bars: DataFrame, quotes: DataFrame, at: str, completed: str, prior: str,
                 phase: str) -> DataFrame:
    """Intraday change in the regular session, else the last two closes, else the saved closing quote.

    ``quotes``: symbol, regular_value, regular_time, fetched_at, previous_close, status, close_confirmed
    (the quote is from the close of the completed session).
    """
    closes = usable(bars).where("close IS NOT NULL")
    firsts = closes.groupBy("symbol").agg(F.min("session_date").alias("_first"))
    one = lambda day, name: closes.where(F.col("session_date") == F.lit(day).cast("date")).select("symbol", F.col("close").alias(name))
    rows = (symbols.select("symbol").join(firsts, "symbol", "left").join(one(completed, "_completed"), "symbol", "left")
            .join(one(prior, "_prior"), "symbol", "left").join(quotes, "symbol", "left"))
    local = lambda c: F.to_date(F.from_utc_timestamp(c, cal.NEW_YORK))
    today = F.to_date(F.from_utc_timestamp(F.lit(at).cast("timestamp"), cal.NEW_YORK))
    done = F.lit(completed).cast("date")
    price = F.when(F.col("regular_value") > 0, F.col("regular_value"))
    live = F.lit(phase == "regular") & price.isNotNull() & F.coalesce(local("regular_time") == today, F.lit(False))
    same_day = F.coalesce(local("fetched_at") == today, F.lit(False))
    live_base = F.coalesce(F.col("_completed"), F.when(same_day & (F.col("previous_close") > 0), F.col("previous_close")))
    both = F.col("_completed").isNotNull() & F.col("_prior").isNotNull()
    saved = (price.isNotNull() & F.coalesce(local("regular_time") == done, F.lit(False))
             & F.coalesce(local("fetched_at") == done, F.lit(False)) & F.coalesce(F.col("close_confirmed"), F.lit(False)))
    saved_base = F.coalesce(F.col("_prior"), F.when(F.col("previous_close") > 0, F.col("previous_close")))
    value = (F.when(live, change6(live_base, price)).when(both, change6(F.col("_prior"), F.col("_completed")))
             .when(saved, change6(saved_base, price)))
    status = (F.when(value.isNotNull(), "available").when(live, "missing")
              .when(F.lit(prior).cast("date") < F.col("_first"), "before_listing").otherwise("missing"))
    return rows.select("symbol", value.alias("value"), status.alias("status"),
                       F.when(live, "intraday").otherwise("close").alias("mode"),
                       (live & F.coalesce(F.col("quote_status") == "STALE", F.lit(False))).alias("delayed"))


def heatmap_weight(rows: DataFrame, by: str = "period", value: str = "value") -> DataFrame:
    """0.2 + 0.8 x (r - min) / max(max - min, floor) per period; the rows are one per sector or group."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in SPREAD_FLOOR.items() for x in pair]), F.col(by))
    weight = MIN_WEIGHT + (1 - MIN_WEIGHT) * (F.col(value) - low) / F.greatest(high - low, floor)
    return rows.withColumn("weight", F.round(weight, 6))


def rank_ordinal(rows: DataFrame, by: str, value: str, position: str, name: str = "rank") -> DataFrame:
    """1..k by value descending, ties in the order of ``position``; rows without a value have no rank."""
    w = Window.partitionBy(by, F.col(value).isNull()).orderBy(F.desc(value), position)
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), F.row_number().over(w)))


def rank_min_both(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rank from the top and from the bottom; equal values share a rank, NULLs have none."""
    known = Window.partitionBy(*by, F.col(value).isNull())
    return (rows.withColumn("rank_top", F.when(F.col(value).isNotNull(), F.rank().over(known.orderBy(F.desc(value)))))
            .withColumn("rank_bottom", F.when(F.col(value).isNotNull(), F.rank().over(known.orderBy(F.asc(value))))))


def performance(members: DataFrame, period_rows: DataFrame, position: str = "position") -> DataFrame:
    """Periods of the member ETFs with weights and ranks. ``members``: id, symbol, position (config dims)."""
    rows = period_rows.join(F.broadcast(members), "symbol")
    return rank_ordinal(heatmap_weight(rows), "period", "value", position)


def group_performance(groups: DataFrame, period_rows: DataFrame) -> DataFrame:
    """Industry groups ranked by their primary ETF only.

    ``groups``: id, sector, primary, alternates (array), coverage, position — the group config, a few
    dozen rows. Alternates follow as reference rows without rank; pending groups come without an ETF.
    """
    primary = groups.where("primary IS NOT NULL").select("id", "sector", "coverage", "position", F.col("primary").alias("symbol"))
    ranked = performance(primary, period_rows).withColumn("role", F.lit("primary"))
    alternates = groups.select("id", "sector", "coverage", "position", F.explode("alternates").alias("symbol"))
    reference = (period_rows.join(F.broadcast(alternates), "symbol").withColumn("weight", F.lit(None).cast("double"))
                 .withColumn("rank", F.lit(None).cast("int")).withColumn("role", F.lit("reference")))
    pending = groups.where("primary IS NULL").select("id", "sector", "coverage", "position").withColumn("role", F.lit("pending"))
    return ranked.unionByName(reference).unionByName(pending, allowMissingColumns=True)


def chart_start(end: str, chart_range: str, interval: str) -> Column:
    """First day of the shared chart range, moved back so that its first week or month is whole."""
    last = F.lit(end).cast("date")
    start = F.trunc(last, "year") if chart_range == "ytd" else F.date_add(cal.months_back(last, CHART_MONTHS[chart_range]), 1)
    return start if interval == "day" else F.trunc(start, interval)


def sector_candles(members: DataFrame, bars: DataFrame, completed: str, chart_range: str, interval: str) -> DataFrame:
    # an inner join: a semi join would be pushed below a union of bars, onto a branch with one symbol, and become a nested loop there
    shown = bars.join(F.broadcast(members.select("symbol").distinct()), "symbol").where(
        (F.col("session_date") >= chart_start(completed, chart_range, interval)) & (F.col("session_date") <= F.lit(completed).cast("date")))
    return resample_ohlc(shown, interval).join(F.broadcast(members), "symbol")


def rotation(members: DataFrame, bars: DataFrame, sessions: DataFrame, benchmark: DataFrame, kind: str, cutoff: str,
             years: int, rank_by: str = "absolute", start_mmdd: str | None = None,
             end_mmdd: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overall ranks per period, every year's ranks, first and last of each year).

    ``members``: id, symbol, position. Overall rank is by median (or median excess); top and bottom
    counts use complete past years only.
    """
    if rank_by not in ("absolute", "relative"):
        raise ValueError(rank_by)
    shown = bars.join(F.broadcast(members.select("symbol")), "symbol", "left_semi")
    study = periods(kind, cutoff, years, start_mmdd, end_mmdd)
    candles = period_candles(shown, sessions, study, cutoff, benchmark)
    value = F.col("change" if rank_by == "absolute" else "excess")
    valued = candles.withColumn("value", F.when(F.col("status").isin("complete", "in_progress"), value))
    valued = valued.join(F.broadcast(members), "symbol")
    yearly = rank_min_both(valued, ["period", "year"], "value")
    metric = "median" if rank_by == "absolute" else "median_excess"
    summary = period_stats(candles, years).join(F.broadcast(members), "symbol")
    overall = rank_min_both(summary.withColumn("_m", F.when(F.col("n") > 0, F.col(metric))), ["period"], "_m")
    counted = (~F.col("is_current")) & (F.col("status") == "complete") & F.col("rank_top").isNotNull()
    counts = yearly.groupBy("symbol", "period").agg(
        F.count_if(counted).alias("counted_years"), F.count_if(counted & (F.col("rank_top") <= TOP)).alias("top_count"),
        F.count_if(counted & (F.col("rank_bottom") <= TOP)).alias("bottom_count"))
    overall = overall.join(counts, ["symbol", "period"], "left").withColumnRenamed("rank_top", "rank").drop("rank_bottom", "_m")
    placed = yearly.where("value IS NOT NULL")
    leaders = placed.groupBy("period", "year").agg(
        F.count("*").alias("participants"), F.min_by("id", F.struct("rank_top", "position")).alias("first_id"),
        F.max_by("id", F.struct("rank_top", F.col("position"))).alias("last_id"))
    # Equal values keep config order, so the last one is the later of the tied members.
    leaders = leaders.withColumn("last_id", F.when(F.col("participants") > 1, F.col("last_id")))
    return overall, yearly, leaders
