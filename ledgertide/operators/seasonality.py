"""Period candles of every symbol and year, and their statistics over complete past years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import stats
from ledgertide.operators import calendar as cal
from ledgertide.operators.bars import usable

MAX_YEARS = 10


def interval_rules(start_mmdd: str, end_mmdd: str, today: str) -> dict:
    """Start, end, whether the range crosses the year end, and the latest year already begun."""
    start, end = cal.parse_mmdd(start_mmdd), cal.parse_mmdd(end_mmdd)
    year, month, day = (int(part) for part in today.split("-"))
    cross = end < start
    return {"start": start, "end": end, "cross": cross, "current": year - int(cross and (month, day) <= end)}


def periods(kind: str, today: str, years: int, start_mmdd: str | None = None, end_mmdd: str | None = None,
            current_year: int | None = None) -> Column:
    """Array of (period, year, is_current, first_day, last_day): 12 periods a year, or one range a year."""
    if not 1 <= years <= MAX_YEARS:
        raise ValueError(f"years must be between 1 and {MAX_YEARS}")
    if kind == "monthly":
        current = current_year or int(today[:4])
        return F.expr(f"""flatten(transform(sequence({current - years}, {current}), y -> transform(sequence(1, 12), m ->
            named_struct('period', cast(m AS string), 'year', y, 'is_current', y = {current},
                         'first_day', make_date(y, m, 1), 'last_day', last_day(make_date(y, m, 1))))))""")
    if kind != "interval" or not start_mmdd or not end_mmdd:
        raise ValueError(f"unsupported study: {kind}")
    rules = interval_rules(start_mmdd, end_mmdd, today)
    current = current_year or rules["current"]
    first = cal.mapped_day("y", *rules["start"])
    last = cal.mapped_day(f"(y + {int(rules['cross'])})", *rules["end"])
    return F.expr(f"""transform(sequence({current - years}, {current}), y -> named_struct('period', 'interval',
        'year', y, 'is_current', y = {current}, 'first_day', {first}, 'last_day', {last}))""")


def plan_scope(study: Column, today: str, df: DataFrame) -> DataFrame:
    """The inclusive price bounds a study needs, never in the future: one row per input row."""
    return df.withColumn("scope_start", F.array_min(F.transform(study, lambda p: p["first_day"]))).withColumn(
        "scope_end", F.least(F.lit(today).cast("date"), F.array_max(F.transform(study, lambda p: p["last_day"]))))


def period_sessions(sessions: DataFrame, study: Column, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(period facts, session days of each period); both bounded by the calendar."""
    spark = sessions.sparkSession
    rows = spark.range(1).select(F.explode(study).alias("p")).select("p.*")
    days = rows.select("period", "year", F.explode(F.sequence("first_day", "last_day")).alias("session_date")).join(
        F.broadcast(sessions.select("session_date")), "session_date")
    done = F.col("session_date") <= F.lit(cutoff).cast("date")
    facts = days.groupBy("period", "year").agg(
        F.count("*").alias("expected"), F.max("session_date").alias("last_expected"),
        F.min(F.when(done, F.col("session_date"))).alias("first_done"),
        F.max(F.when(done, F.col("session_date"))).alias("last_done"),
        F.sort_array(F.collect_list(F.when(done, F.col("session_date")))).alias("done_days"))
    full = rows.join(facts, ["period", "year"], "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return full, days.where(done)


def period_candles(bars: DataFrame, sessions: DataFrame, study: Column, cutoff: str,
                   benchmark: DataFrame | None = None, sector: DataFrame | None = None) -> DataFrame:
    """One candle per symbol, period and year.

    Open is the first session's open and close the last session's close; a running period ends at its
    latest close. ``benchmark`` and ``sector`` are bars of one series each, paired over the candle's
    own two dates. No (symbol x day) grid is built: bars are aggregated where they exist and the
    calendar supplies what should have been there.
    """
    facts, days = period_sessions(sessions, study, cutoff)
    prices = usable(bars)
    marks = prices.join(F.broadcast(days), "session_date")
    bounds = F.broadcast(facts.select("period", "year", "first_done", "last_done"))
    marks = marks.join(bounds, ["period", "year"])
    day, both = F.col("session_date"), F.col("open").isNotNull() & F.col("close").isNotNull()
    grouped = marks.groupBy("symbol", "period", "year").agg(
        F.count_if(both).alias("sessions"),
        F.max(F.when(F.col("close").isNotNull(), day)).alias("_last_close_day"),
        F.max(F.when(day == F.col("first_done"), F.col("open"))).alias("_open"),
        F.max(F.when(day == F.col("last_done"), F.col("close"))).alias("_last_close"),
        F.max_by("close", F.when(F.col("close").isNotNull(), day)).alias("_running_close"),
        F.max(F.when(both, F.col("high"))).alias("high"), F.min(F.when(both, F.col("low"))).alias("low"),
        F.collect_set(F.when(both, day)).alias("_present"))
    symbols = prices.select("symbol").distinct()
    grid = symbols.withColumn("p", F.explode(study)).select("symbol", "p.*")
    rows = grid.join(F.broadcast(facts.drop("is_current", "first_day", "last_day")), ["period", "year"]).join(
        grouped, ["symbol", "period", "year"], "left")
    running = F.coalesce(F.col("last_done") < F.col("last_expected"), F.lit(False))
    end = F.when(running, F.coalesce("_last_close_day", "last_done")).otherwise(F.col("last_done"))
    rows = rows.withColumn("_running", running).withColumn("end_date", end).withColumn(
        "_close", F.when(F.col("_running"), F.col("_running_close")).otherwise(F.col("_last_close")))
    present = F.coalesce(F.col("sessions"), F.lit(0)) > 0
    status = (F.when(F.col("expected") == 0, "no_data").when(F.col("last_done").isNull(), "not_started")
              .when(~present, "no_data").when(F.col("_open").isNull() | F.col("_close").isNull(), "incomplete")
              .when(F.col("_running"), "in_progress").otherwise("complete"))
    rows = rows.withColumn("status", status).withColumn("missing_dates", F.when(present, F.array_except(
        F.filter("done_days", lambda d: d <= F.col("end_date")), "_present")))
    priced = F.col("status").isin("complete", "in_progress")
    change = lambda c: F.when(priced, stats.endpoint_change(F.col("_open"), c))
    rows = rows.select(
        "symbol", "period", "year", "is_current", "first_day", "last_day", "expected", "status",
        F.when(F.col("expected") > 0, F.col("first_done")).alias("start_date"),
        F.when(present, F.col("end_date")).alias("end_date"), F.when(present, F.col("sessions")).alias("sessions"),
        "missing_dates", F.when(present, F.col("_open")).alias("open"), F.when(present, F.col("_close")).alias("close"),
        "high", "low", change(F.col("_close")).alias("change"), change(F.col("high")).alias("high_change"),
        change(F.col("low")).alias("low_change"))
    for name, other in (("benchmark", benchmark), ("sector", sector)):
        excess = "excess" if name == "benchmark" else "sector_excess"
        if other is None:
            continue
        prices_of = usable(other)
        opens = F.broadcast(prices_of.select(F.col("session_date").alias("start_date"), F.col("open").alias("_bo")))
        closes = F.broadcast(prices_of.select(F.col("session_date").alias("end_date"), F.col("close").alias("_bc")))
        rows = rows.join(opens, "start_date", "left").join(closes, "end_date", "left")
        rows = (rows.withColumn(f"{name}_change", F.when(F.col("change").isNotNull(), stats.endpoint_change(F.col("_bo"), F.col("_bc"))))
                .withColumn(excess, F.col("change") - F.col(f"{name}_change")).drop("_bo", "_bc"))
    return rows


def period_stats(candles: DataFrame, target_n: int) -> DataFrame:
    """Statistics of the complete past years of each symbol and period.

    A group holds one value a year, so the arrays are bounded by the studied years.
    """
    sample = candles.where(~F.col("is_current") & (F.col("status") == "complete"))
    paired = {"benchmark": "excess", "sector": "sector_excess"}
    present = {name: column for name, column in paired.items() if column in candles.columns}
    aggregates = [stats.sorted_values(F.col("change")).alias("_change"),
                  F.min_by("year", F.struct("change", "year")).alias("worst_year"),
                  F.max_by("year", F.struct("change", "year")).alias("best_year")]
    for name, column in present.items():
        aggregates += [stats.sorted_values(F.col(column)).alias(f"_{column}"),
                       stats.sorted_values(F.when(F.col(column).isNotNull(), F.col(f"{name}_change"))).alias(f"_{name}")]
    grouped = candles.select("symbol", "period").distinct().join(
        sample.groupBy("symbol", "period").agg(*aggregates), ["symbol", "period"], "left")
    for column in grouped.columns:
        if column.startswith("_"):
            grouped = grouped.withColumn(column, F.coalesce(column, F.array().cast("array<double>")))
    box = stats.box_columns(F.col("_change"))
    low, high = stats.wilson(box["up"], box["n"])
    columns = [F.lit(target_n).cast("long").alias("target_n"),
               *[box[k].alias(k) for k in ("n", "up", "flat", "median", "mean", "q25", "q75", "up_ratio",
                                           "whisker_low", "whisker_high", "outliers")],
               box["max"].alias("best"), box["min"].alias("worst"), "best_year", "worst_year",
               low.alias("up_low"), high.alias("up_high"), ((low <= 0.5) & (high >= 0.5)).alias("coin_flip")]
    for name, column in present.items():
        prefix = "" if name == "benchmark" else "sector_"
        excess = stats.box_columns(F.col(f"_{column}"))
        columns += [excess["n"].alias(f"{prefix}paired_n"), excess["up"].alias(f"{prefix}beat"),
                    stats.ratio(excess["up"], excess["n"]).alias(f"{prefix}beat_ratio"),
                    excess["median"].alias(f"{prefix}median_excess"), excess["mean"].alias(f"{prefix}mean_excess"),
                    stats.quantile_of(F.col(f"_{name}"), 0.5).alias(f"{name}_median")]
    return grouped.select("symbol", "period", *columns)


def seasonality(bars: DataFrame, sessions: DataFrame, kind: str, cutoff: str, years: int,
                start_mmdd: str | None = None, end_mmdd: str | None = None,
                benchmark: DataFrame | None = None, sector: DataFrame | None = None) -> DataFrame:
    """Monthly or date-range seasonality of every symbol at once."""
    study = periods(kind, cutoff, years, start_mmdd, end_mmdd)
    return period_stats(period_candles(bars, sessions, study, cutoff, benchmark, sector), years)
