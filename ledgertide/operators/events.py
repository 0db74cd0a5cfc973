"""Price reactions around dated events, for all tickers at once.

With C = close, O = open, R = the reaction session and n sessions:
before = C(R-1)/C(R-1-n) - 1, reaction = C(R)/C(R-1) - 1, gap = O(R)/C(R-1) - 1, after = C(R+n)/C(R) - 1.

The bars are turned once into one row per (symbol, reaction session) that holds every price the
windows need. Events then meet prices in a single equi-join, whatever n is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import stats
from ledgertide.operators import calendar as cal
from ledgertide.operators.bars import numbered, usable

WINDOWS = ("before", "reaction", "gap", "after")
SURPRISE_GROUPS = ("beat", "inline", "miss", "no_data")
GUIDANCE_GROUPS = ("raised", "maintained", "lowered", "none", "no_data")
# An EPS surprise below the threshold is in line; major items of these categories
# within this many sessions of R can exclude an event.
INLINE_THRESHOLD = 0.01
MACRO_SESSIONS = 2
MACRO_CATEGORIES = ("macro", "policy", "geopolitical")


# window -> (price it starts from, price it ends at, session offset of its end)
WINDOW_PRICES = {"before": ("start_close", "base_close", -1), "reaction": ("base_close", "close", 0),
                 "gap": ("base_close", "open", 0), "after": ("close", "end_close", "n")}


def session_prices(bars: DataFrame, sessions: DataFrame, n: int, cutoff: str, prefix: str = "") -> DataFrame:
    """Per (symbol, reaction_no): the prices the windows need and the closes from R-n to R+n by offset.

    Columns start_close (R-1-n), base_close (R-1), open/high/low/close (R), end_close (R+n) and closes,
    a map of at most 2n+1 entries. Columns a query does not use are pruned before the aggregation.
    """
    rows = numbered(usable(bars), sessions).where(F.col("session_date") <= F.lit(cutoff).cast("date"))
    spread = rows.withColumn("_o", F.explode(F.sequence(F.lit(-1 - n), F.lit(n))))
    at = lambda offset, field: F.max(F.when(F.col("_o") == offset, F.col(field)))
    return spread.groupBy("symbol", (F.col("session_no") - F.col("_o")).alias("reaction_no")).agg(
        at(-1 - n, "close").alias(f"{prefix}start_close"), at(-1, "close").alias(f"{prefix}base_close"),
        *[at(0, field).alias(f"{prefix}{field}") for field in ("open", "high", "low", "close")],
        at(n, "close").alias(f"{prefix}end_close"),
        F.map_from_entries(F.collect_list(F.struct("_o", "close"))).alias(f"{prefix}closes"))


def with_cutoff_number(df: DataFrame, cutoff: str, spine: DataFrame, name: str = "cutoff_no") -> DataFrame:
    """Attach the number of the last session on or before the cutoff."""
    number = spine.where(F.col("day") == F.lit(cutoff).cast("date")).select("prev_incl").scalar()
    return df.withColumn(name, number)


def analyze_events(events: DataFrame, bars: DataFrame, sessions: DataFrame, spine: DataFrame, n: int, cutoff: str,
                   benchmark: DataFrame | None = None, sector_symbol: str | None = None) -> DataFrame:
    """One row per event with its windows, reaction candle, path and notes.

    ``benchmark`` holds the bars of one series; ``sector_symbol`` names the events column with the
    reference series of each event, read from ``bars``.
    """
    if not 1 <= n <= 60:
        raise ValueError("n must be between 1 and 60")
    rows = cal.with_spine(events, "event_date", spine, prefix="_s_")
    rows = rows.withColumn("reaction_no", cal.reaction_day_number(F.col("session"), F.col("_s_next_incl"), F.col("_s_next_excl")))
    on_day = F.col("_s_prev_incl") == F.col("_s_next_incl")
    rows = with_cutoff_number(rows.withColumn("_open_day", on_day), cutoff, spine)
    prices = session_prices(bars, sessions, n, cutoff, "_p_")
    rows = rows.join(prices.withColumnRenamed("symbol", "ticker"), ["ticker", "reaction_no"], "left")
    paired = {"": "_p_"}
    if benchmark is not None:
        rows = rows.join(session_prices(benchmark, sessions, n, cutoff, "_m_").drop("symbol"), "reaction_no", "left")
        paired["benchmark"] = "_m_"
    if sector_symbol is not None:
        sector = session_prices(bars, sessions, n, cutoff, "_x_").withColumnRenamed("symbol", sector_symbol)
        rows = rows.join(sector, [sector_symbol, "reaction_no"], "left")
        paired["sector"] = "_x_"

    missing = F.lit(None).cast("double")
    windows = []
    for window, (start, end, end_offset) in WINDOW_PRICES.items():
        pending = F.coalesce(F.col("reaction_no") + (n if end_offset == "n" else end_offset) > F.col("cutoff_no"), F.lit(True))
        value = {kind: F.when(~pending, stats.endpoint_change(F.col(prefix + start), F.col(prefix + end))) for kind, prefix in paired.items()}
        own = value[""]
        windows.append(F.struct(
            F.lit(window).alias("window"), own.alias("value"),
            F.when(pending, "pending").when(own.isNull(), "missing_price").otherwise("ok").alias("status"),
            value.get("benchmark", missing).alias("benchmark"), (own - value.get("benchmark", missing)).alias("excess"),
            value.get("sector", missing).alias("sector"), (own - value.get("sector", missing)).alias("sector_excess")))

    def moved(prefix: str | None, offset: Column) -> Column:
        if prefix is None:
            return missing
        return stats.endpoint_change(F.col(f"{prefix}base_close"), F.element_at(F.col(f"{prefix}closes"), offset))

    path = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda o: F.struct(
        o.alias("offset"), moved("_p_", o).alias("value"), moved(paired.get("benchmark"), o).alias("benchmark"),
        moved(paired.get("sector"), o).alias("sector"), F.element_at(F.col("_p_closes"), o).alias("close")))
    base = F.col("_p_base_close")
    candle = F.when(base.isNotNull() & F.col("_p_close").isNotNull(), F.struct(*[
        stats.endpoint_change(base, F.col(f"_p_{field}")).alias(field) for field in ("open", "high", "low", "close")]))
    notes = F.array_compact(F.array(
        F.when(F.col("session") == "unknown", "session_unknown"),
        F.when((F.col("session") != "after_close") & ~F.coalesce(F.col("_open_day"), F.lit(False)), "market_closed_on_date")))
    return rows.select(*events.columns, "reaction_no", (F.col("reaction_no") - 1).alias("baseline_no"), "cutoff_no",
                       F.array(*windows).alias("windows"), candle.alias("reaction_candle"), path.alias("path"), notes.alias("notes"))


def alike(events: DataFrame, *by: str) -> DataFrame:
    """Events that agree in ticker, day, session, series of their sector and ``by`` as one row, with their number as ``events``.

    They share every price, so statistics over events need one of them: as many rows as the calendar allows, however many events there are.
    """
    shared = [c for c in ("ticker", "event_date", "session", "sector_symbol") if c in events.columns]
    return events.groupBy(*dict.fromkeys([*shared, *by])).agg(F.count("*").alias("events"))


def explode_windows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per event and window: window, value, status, benchmark, excess, sector, sector_excess."""
    return rows.select(*keep, F.explode("windows").alias("w")).select(*keep, "w.*")


def explode_path(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per event and offset: offset, value, benchmark, sector, close."""
    return rows.select(*keep, F.explode("path").alias("p")).select(*keep, "p.*")


def expectations(rows: DataFrame) -> DataFrame:
    """EPS and revenue surprise with the groups they fall in."""
    def surprise(actual: str, estimate: str) -> Column:
        base = F.nullif(F.col(estimate), F.lit(0.0))
        return (F.col(actual) - base) / F.abs(base)

    rows = rows.withColumn("eps_surprise", surprise("eps_actual", "eps_estimate")).withColumn(
        "revenue_surprise", surprise("revenue_actual", "revenue_estimate"))
    group = (F.when(F.col("eps_surprise").isNull(), "no_data").when(F.abs("eps_surprise") < INLINE_THRESHOLD, "inline")
             .when(F.col("eps_surprise") > 0, "beat").otherwise("miss"))
    return rows.withColumn("surprise_group", group).withColumn("guidance_group", F.coalesce("guidance", F.lit("no_data")))


def macro_events(rows: DataFrame, spine: DataFrame, sessions: DataFrame, within: int = MACRO_SESSIONS) -> DataFrame:
    """Attach ``macro_items``: the major macro context dated within the sessions around R."""
    first = cal.session_date_of(rows.withColumn("_lo", F.col("reaction_no") - within), "_lo", sessions, "_from")
    both = cal.session_date_of(first.withColumn("_hi", F.col("reaction_no") + within), "_hi", sessions, "_to")
    items = F.filter("context", lambda c: c["major"] & c["category"].isin(*MACRO_CATEGORIES)
                     & (c["date"] >= F.col("_from")) & (c["date"] <= F.col("_to")))
    return both.withColumn("macro_items", F.coalesce(items, F.filter("context", lambda c: F.lit(False)))).drop("_lo", "_hi", "_from", "_to")


def exclude_macro(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events without macro items, how many each ticker lost)."""
    hit = F.size("macro_items") > 0
    return rows.where(~hit), rows.groupBy("ticker").agg(F.count_if(hit).alias("macro_excluded"))


def filter_event_rows(rows: DataFrame, cutoff: str, quarter: int | None = None, recent_years: int | None = None,
                      session: str | None = None, direction: str | None = None) -> DataFrame:
    """Frozen rows by quarter, recent calendar years, session and direction of the reaction."""
    kept = rows
    if quarter is not None:
        kept = kept.where(F.col("fiscal_quarter") == quarter)
    if recent_years is not None:
        kept = kept.where(F.year("event_date") >= int(cutoff[:4]) - recent_years + 1)
    if session is not None:
        kept = kept.where(F.col("session") == session)
    if direction is not None:
        reaction = F.filter("windows", lambda w: w["window"] == "reaction")[0]["value"]
        kept = kept.where(reaction > 0 if direction == "up" else reaction < 0)
    return kept


def event_groups(rows: DataFrame) -> DataFrame:
    """Every event once per group it belongs to: all, its quarter, surprise group and guidance group."""
    keys = {"all": F.lit("all"), "quarter": F.concat(F.lit("Q"), F.col("fiscal_quarter").cast("string")),
            "surprise": F.col("surprise_group"), "guidance": F.col("guidance_group")}
    groups = F.array(*[F.struct(F.lit(kind).alias("group_kind"), key.alias("group_key")) for kind, key in keys.items()])
    return rows.withColumn("_g", F.explode(groups)).select(*rows.columns, "_g.group_kind", "_g.group_key")


def _stack(measures: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(m).alias("m"), c.cast("double").alias("x")) for m, c in measures.items()]))


def window_stats(long: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Statistics per group and window. A row counts as often as its ``weight`` says.

    All measures are stacked and described by one distributed pass, so a ticker that holds most of
    the events is still split over tasks. Equal rows are one before they are stacked.
    """
    keys = [*keys, "window"]
    times = F.count("*") if weight is None else F.sum(weight)
    single = long.groupBy(*keys, "value", "excess", "benchmark", "sector_excess", "sector").agg(times.alias("_times"))
    stacked = single.select(*keys, "_times", _stack({
        "value": F.col("value"), "absolute": F.abs("value"), "excess": F.col("excess"),
        "benchmark": F.when(F.col("excess").isNotNull(), F.col("benchmark")), "sector_excess": F.col("sector_excess"),
        "sector": F.when(F.col("sector_excess").isNotNull(), F.col("sector"))}).alias("s")).select(*keys, "_times", "s.m", "s.x")
    described = stats.describe(stacked, [*keys, "m"], "x", weight="_times")
    pick = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    wide = described.groupBy(*keys).agg(
        *[F.coalesce(pick("value", c), F.lit(0)).alias(c) for c in ("n", "up", "flat")],
        *[pick("value", c).alias(c if c != "q50" else "median") for c in ("q50", "mean", "q25", "q75", "min", "max")],
        pick("absolute", "q50").alias("abs_median"), F.coalesce(pick("excess", "n"), F.lit(0)).alias("paired_n"),
        F.coalesce(pick("excess", "up"), F.lit(0)).alias("beat"), pick("excess", "q50").alias("median_excess"),
        pick("excess", "mean").alias("mean_excess"), pick("benchmark", "q50").alias("benchmark_median"),
        F.coalesce(pick("sector_excess", "n"), F.lit(0)).alias("sector_paired_n"),
        F.coalesce(pick("sector_excess", "up"), F.lit(0)).alias("sector_beat"),
        pick("sector_excess", "q50").alias("sector_median_excess"), pick("sector_excess", "mean").alias("sector_mean_excess"),
        pick("sector", "q50").alias("sector_median"))
    low, high = stats.wilson(F.col("up"), F.col("n"))
    return wide.withColumns({"up_ratio": stats.ratio(F.col("up"), F.col("n")), "up_low": low, "up_high": high,
                             "coin_flip": (low <= 0.5) & (high >= 0.5),
                             "beat_ratio": stats.ratio(F.col("beat"), F.col("paired_n")),
                             "sector_beat_ratio": stats.ratio(F.col("sector_beat"), F.col("sector_paired_n"))})


def path_stats(points: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """n, median and quartiles of the path per offset, with the reference medians. A row counts as often as its ``weight`` says."""
    keys = [*keys, "offset"]
    times = F.count("*") if weight is None else F.sum(weight)
    single = points.groupBy(*keys, "value", "benchmark", "sector").agg(times.alias("_times"))
    stacked = single.select(*keys, "_times", _stack({c: F.col(c) for c in ("value", "benchmark", "sector")}).alias("s")).select(*keys, "_times", "s.m", "s.x")
    described = stats.describe(stacked, [*keys, "m"], "x", weight="_times")
    pick = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    return described.groupBy(*keys).agg(
        F.coalesce(pick("value", "n"), F.lit(0)).alias("n"), pick("value", "q50").alias("median"), pick("value", "q25").alias("q25"),
        pick("value", "q75").alias("q75"), pick("benchmark", "q50").alias("benchmark_median"), pick("sector", "q50").alias("sector_median"))


def event_ranks(long: DataFrame, position: str = "event_pos") -> DataFrame:
    """Ordinal ranks per ticker and window in both directions; equal values keep event order."""
    return stats.distributed_ranks(long, ["ticker", "window"], "value", position)


QUARTER_METRICS = ("median", "up_ratio", "median_excess", "sector_median_excess")


def quarter_ranks(quarter_stats: DataFrame) -> DataFrame:
    """Ranks of a ticker's (at most four) quarters by each metric, both directions."""
    from pyspark.sql import Window

    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in QUARTER_METRICS]))
    rows = quarter_stats.select("ticker", "fiscal_quarter", "window", metrics.alias("m")).select(
        "ticker", "fiscal_quarter", "window", "m.metric", "m.v").where("v IS NOT NULL")
    group = Window.partitionBy("ticker", "window", "metric")
    return rows.withColumn("rank_asc", F.row_number().over(group.orderBy("v", "fiscal_quarter"))).withColumn(
        "rank_desc", F.row_number().over(group.orderBy(F.desc("v"), "fiscal_quarter")))


def context_candles(rows: DataFrame, bars: DataFrame, sessions: DataFrame, spine: DataFrame, n: int, cutoff: str,
                    key: str = "event_pos") -> DataFrame:
    """Daily candles over the union of R-1-n..R+n and the context dates, with the offset from R."""
    spans = rows.where(F.size("context") > 0).select(
        key, "ticker", "reaction_no", F.array_min(F.transform("context", lambda c: c["date"])).alias("_first"),
        F.array_max(F.transform("context", lambda c: c["date"])).alias("_last"))
    spans = cal.with_spine(cal.with_spine(spans, "_first", spine, prefix="_a_"), "_last", spine, prefix="_b_")
    low = F.least(F.col("reaction_no") - 1 - n, F.col("_a_next_incl"))
    high = F.greatest(F.col("reaction_no") + n, F.col("_b_prev_incl"))
    days = spans.select(key, "ticker", "reaction_no", F.explode(F.sequence(low, high)).alias("session_no"))
    prices = numbered(usable(bars), sessions).where(F.col("session_date") <= F.lit(cutoff).cast("date")).select(
        F.col("symbol").alias("ticker"), "session_no", "open", "high", "low", "close")
    dated = days.join(F.broadcast(sessions.select("session_no", "session_date")), "session_no")
    return dated.join(prices, ["ticker", "session_no"], "left").withColumn("offset", F.col("session_no") - F.col("reaction_no"))


def needed_range(events: DataFrame, sessions: DataFrame, spine: DataFrame, n: int, today: str) -> DataFrame:
    """The price range each ticker needs: R-1-n of its earliest to R+n of its latest event, widened to
    its context dates and never after today."""
    rows = cal.with_spine(events, "event_date", spine, prefix="_s_").withColumn(
        "_r", cal.reaction_day_number(F.col("session"), F.col("_s_next_incl"), F.col("_s_next_excl")))
    context = F.transform("context", lambda c: c["date"])
    spans = rows.groupBy("ticker").agg(
        (F.min("_r") - 1 - n).alias("_lo"), (F.max("_r") + n).alias("_hi"),
        F.min(F.array_min(context)).alias("_c0"), F.max(F.array_max(context)).alias("_c1"))
    spans = cal.session_date_of(spans, "_lo", sessions, "_d0")
    spans = cal.session_date_of(spans, "_hi", sessions, "_d1")
    bound = F.lit(today).cast("date")
    start = F.least("_d0", "_c0")
    end = F.greatest(start, F.least(bound, F.greatest(F.coalesce("_d1", bound), F.col("_c1"))))
    return spans.select("ticker", start.alias("start_date"), end.alias("end_date"))
