"""Daily bars: validation, coverage, resampling, corrections and the session-numbered view.

A bar series has at most one row per session after ``reject_duplicate_sessions``, so a window
partitioned by symbol is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def positive(value: Column) -> Column:
    """The value when it is finite and above zero."""
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & (value > 0), value)


def usable(bars: DataFrame) -> DataFrame:
    """Prices of VALID bars as double; any other bar keeps its row with NULL prices."""
    valid = F.col("status") == "VALID"
    return bars.select("symbol", "session_date",
                       *[F.when(valid, positive(F.col(c).cast("double"))).alias(c) for c in PRICES])


def numbered(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars that fall on a session, with its number; offsets are then equi-joins on the number."""
    return bars.join(F.broadcast(sessions.select("session_date", "session_no")), "session_date")


def validate_bars(bars: DataFrame, completed: str, instrument: str = "instrument") -> DataFrame:
    """UNCONFIRMED after the last completed session, MISSING_FIELDS, INVALID, else VALID."""
    o, h, l, c = (F.col(name) for name in PRICES)
    any_missing = o.isNull() | h.isNull() | l.isNull() | c.isNull()
    traded = F.col(instrument).isin("EQUITY", "ETF")
    inconsistent = (h < F.greatest(o, l, c)) | (l > F.least(o, h, c)) | F.coalesce(F.col("volume") < 0, F.lit(False))
    status = (F.when(F.col("session_date") > F.lit(completed).cast("date"), "UNCONFIRMED")
              .when(any_missing, "MISSING_FIELDS")
              .when(traded & (F.least(o, h, l, c) <= 0), "INVALID")
              .when(inconsistent, "INVALID").otherwise("VALID"))
    reason = (F.when(F.col("status") == "UNCONFIRMED", "unconfirmed")
              .when(F.col("status") == "MISSING_FIELDS", "missing_fields")
              .when((F.col("status") == "INVALID") & traded & (F.least(o, h, l, c) <= 0), "not_positive")
              .when(F.col("status") == "INVALID", "inconsistent"))
    return bars.withColumn("status", status).withColumn("reason", reason)


def review_bar_jumps(bars: DataFrame, sessions: DataFrame, completed: str, limit: float = 0.5) -> DataFrame:
    """Flag non-session days, bad actions and unexplained jumps of validated bars.

    A bar is compared with the close of the previous *session* only when that bar ended VALID, so a
    flagged bar leaves its successor without a comparison. Within a run of consecutive sessions that
    each jump against their predecessor the outcome therefore alternates: the odd positions of a run
    are flagged. That makes the recursion a gaps-and-islands problem.
    """
    days = sessions.select("session_date", "session_no")
    rows = bars.join(F.broadcast(days), "session_date", "left")
    off_session = F.col("session_no").isNull() & (F.col("session_date") <= F.lit(completed).cast("date"))
    bad_action = F.coalesce(F.col("dividends") < 0, F.lit(False)) | F.coalesce(F.col("splits") < 0, F.lit(False))
    rows = (rows.withColumn("status", F.when(bad_action, "NEEDS_REVIEW").when(off_session, "INVALID").otherwise(F.col("status")))
            .withColumn("reason", F.when(bad_action, "bad_action").when(off_session, "not_session").otherwise(F.col("reason"))))
    prior = rows.where((F.col("status") == "VALID") & F.col("session_no").isNotNull()).select(
        F.col("symbol").alias("_s"), (F.col("session_no") + 1).alias("_no"), F.col("close").alias("prior_close"))
    rows = rows.join(prior, (F.col("symbol") == F.col("_s")) & (F.col("session_no") == F.col("_no")), "left").drop("_s", "_no")
    split = F.coalesce(~F.col("splits").isin(0, 1), F.lit(False))
    jump = ((F.col("status") == "VALID") & F.col("instrument").isin("EQUITY", "ETF") & ~split
            & (F.col("prior_close") > 0) & (F.abs(F.col("close") / F.col("prior_close") - 1) >= limit))
    rows = rows.withColumn("_jump", F.coalesce(jump, F.lit(False)))
    by_symbol = Window.partitionBy("symbol", "_jump").orderBy("session_no")
    rows = rows.withColumn("_island", F.col("session_no") - F.row_number().over(by_symbol))
    in_run = Window.partitionBy("symbol", "_jump", "_island").orderBy("session_no")
    flagged = F.col("_jump") & (F.row_number().over(in_run) % 2 == 1)
    return (rows.withColumn("_flag", flagged)
            .withColumn("status", F.when(F.col("_flag"), "NEEDS_REVIEW").otherwise(F.col("status")))
            .withColumn("reason", F.when(F.col("_flag"), "jump").otherwise(F.col("reason")))
            .drop("_jump", "_island", "_flag"))


def reject_duplicate_sessions(bars: DataFrame, keys: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """Sessions that a series states more than once: an error to report, never a choice to make."""
    return bars.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def prior_session_close(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Close of the previous session (not of the previous row)."""
    rows = numbered(usable(bars), sessions)
    prior = rows.select("symbol", (F.col("session_no") + 1).alias("session_no"), F.col("close").alias("prior_close"))
    return rows.join(prior, ["symbol", "session_no"], "left")


# --- identity ---------------------------------------------------------------------

# Provider exchange code -> calendar, and the indexes that keep the stock calendar.
STOCK_EXCHANGES = ("NMS", "NGM", "NCM", "NYQ", "ASE", "PCX", "BTS", "BATS")
STOCK_CALENDAR_INDEXES = ("^GSPC", "^IXIC", "^NDX")


def resolve_identity(responses: DataFrame, markets: Sequence[str] = ()) -> DataFrame:
    """Calendar and status of each security from its provider metadata.

    Expects symbol, quote_type, exchange, currency and reported_symbol; ``markets`` are the strip's
    own symbols, which are verified as markets.
    """
    traded = F.col("quote_type").isin("EQUITY", "ETF")
    known = F.col("exchange").isin(*STOCK_EXCHANGES)
    index = (F.col("symbol").isin(*STOCK_CALENDAR_INDEXES) & (F.col("reported_symbol") == F.col("symbol"))
             & (F.col("quote_type") == "INDEX") & (F.col("currency") == "USD"))
    calendar = F.when(index | (traded & known), F.lit("XNYS"))
    status = (F.when(index, "VERIFIED").when(F.col("symbol").isin(*markets), "VERIFIED_MARKET")
              .when(calendar.isNotNull() & (F.col("currency") == "USD"), "VERIFIED").otherwise("NEEDS_REVIEW"))
    return responses.withColumn("calendar", calendar).withColumn("status", status)


def identity_conflicts(responses: DataFrame, identifiers: DataFrame, today: str) -> DataFrame:
    """One row per (security, field) whose stated value contradicts the stored one; absent is unknown.

    ``responses``: security_id, symbol, currency, instrument and the stated response_symbol,
    metadata_symbol, response_currency, response_instrument, quote_type. ``identifiers``:
    security_id, symbol, valid_from, valid_to.
    """
    norm = lambda c: F.upper(F.trim(c))
    day = F.lit(today).cast("date")
    live = identifiers.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    claims = responses.select("security_id", "symbol", "currency", "instrument", F.explode(F.array(
        F.struct(F.lit("symbol").alias("field"), norm(F.col("response_symbol")).alias("actual")),
        F.struct(F.lit("symbol").alias("field"), norm(F.col("metadata_symbol")).alias("actual")),
        F.struct(F.lit("currency").alias("field"), F.trim("response_currency").alias("actual")),
        F.struct(F.lit("instrument").alias("field"), norm(F.col("response_instrument")).alias("actual")),
        F.struct(F.lit("instrument").alias("field"), norm(F.col("quote_type")).alias("actual")),
    )).alias("_c")).select("security_id", "symbol", "currency", "instrument", "_c.field", "_c.actual")
    expected = (F.when(F.col("field") == "symbol", norm(F.col("symbol")))
                .when(F.col("field") == "currency", F.trim("currency")).otherwise(norm(F.col("instrument"))))
    stated = claims.withColumn("expected", expected).where(
        (F.coalesce("actual", F.lit("")) != "") & (F.coalesce("expected", F.lit("")) != "")
        & (F.col("actual") != F.col("expected"))
        & ~((F.col("field") == "instrument") & (F.col("actual").isin("UNKNOWN") | F.col("expected").isin("UNKNOWN"))))
    aliases = live.select(F.col("security_id"), F.lit("symbol").alias("field"), norm(F.col("symbol")).alias("actual"))
    return stated.join(aliases, ["security_id", "field", "actual"], "left_anti").select(
        "security_id", "field", "actual", "expected").distinct()


# --- coverage and ranges ----------------------------------------------------------


def expected_sessions(ranges: DataFrame, spine: DataFrame) -> DataFrame:
    """First and last session number of each [start_date, end_date] and how many it spans."""
    days = spine.select("day", "next_incl", "prev_incl")
    low = days.select(F.col("day").alias("start_date"), F.col("next_incl").alias("first_no"))
    high = days.select(F.col("day").alias("end_date"), F.col("prev_incl").alias("last_no"))
    return (ranges.join(F.broadcast(low), "start_date", "left").join(F.broadcast(high), "end_date", "left")
            .withColumn("expected", F.greatest(F.lit(0), F.col("last_no") - F.col("first_no") + 1)))


def missing_sessions(ranges: DataFrame, bars: DataFrame, sessions: DataFrame, spine: DataFrame) -> DataFrame:
    """Expected sessions of each symbol's range without a VALID bar."""
    wanted = expected_sessions(ranges, spine).where("expected > 0").select(
        "symbol", F.explode(F.sequence("first_no", "last_no")).alias("session_no"))
    dated = wanted.join(F.broadcast(sessions.select("session_no", "session_date")), "session_no")
    return dated.join(bars.where("status = 'VALID'").select("symbol", "session_date"),
                      ["symbol", "session_date"], "left_anti").select("symbol", "session_date", "session_no")


def prefix_counts(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(symbol, session_no) -> bars and valid bars of the symbol up to that session, from its first bar to the last session.

    At most one row per symbol and session, as bars have; any range is then counted by two equi-joined lookups.
    """
    days = F.broadcast(sessions.select("session_date", "session_no"))
    daily = bars.join(days, "session_date").groupBy("symbol", "session_no").agg(F.count("*").alias("fetched"), F.count_if(F.col("status") == "VALID").alias("valid"))
    w = Window.partitionBy("symbol").orderBy("session_no")
    final = sessions.select(F.max("session_no")).scalar()
    running = daily.select("symbol", "session_no", F.coalesce(F.lead("session_no").over(w) - 1, F.greatest("session_no", final)).alias("until"),
                           F.sum("fetched").over(w).alias("fetched"), F.sum("valid").over(w).alias("valid"))
    return running.select("symbol", F.explode(F.sequence("session_no", "until")).alias("session_no"), "fetched", "valid")


def coverage(ranges: DataFrame, bars: DataFrame, sessions: DataFrame, spine: DataFrame, completed: str) -> DataFrame:
    """COMPLETE / PARTIAL / NOT_FETCHED per range, with missing sessions and those already closed (gaps).

    Counts are differences of prefix counts, so a range costs three lookups however long it is and however many ranges a symbol has.
    """
    rows = expected_sessions(ranges, spine)
    rows = rows.withColumn("_cut_no", spine.where(F.col("day") == F.lit(completed).cast("date")).select("prev_incl").scalar())
    done = F.greatest(F.lit(0), F.least(F.col("last_no"), F.col("_cut_no")) - F.col("first_no") + 1)
    rows = rows.withColumn("_done", done)
    key = ["symbol", "first_no", "last_no", "_cut_no"]
    # the counts before the range, at its last session, and at its last closed session
    ends = F.array(*[F.struct(F.lit(end).alias("end"), no.cast("int").alias("session_no")) for end, no in (
        ("before", F.col("first_no") - 1), ("last", F.col("last_no")), ("closed", F.greatest(F.col("first_no") - 1, F.least("last_no", "_cut_no"))))])
    asked = rows.select(*key).distinct().select(*key, F.explode(ends).alias("e")).select(*key, "e.*")
    at = lambda end, name: F.coalesce(F.max(F.when(F.col("end") == end, F.col(name))), F.lit(0))
    found = asked.join(prefix_counts(bars, sessions), ["symbol", "session_no"], "left").groupBy(*key).agg(
        (at("last", "fetched") - at("before", "fetched")).alias("fetched"), (at("last", "valid") - at("before", "valid")).alias("valid"),
        (at("closed", "valid") - at("before", "valid")).alias("valid_done"))
    # a range without sessions has nothing to look up
    rows = rows.join(found, key, "left").withColumns({c: F.when(F.col("last_no") >= F.col("first_no"), F.coalesce(c, F.lit(0))).otherwise(0) for c in ("fetched", "valid", "valid_done")})
    missing, gaps = F.col("expected") - F.col("valid"), F.col("_done") - F.col("valid_done")
    return rows.select(
        "symbol", "start_date", "end_date", F.col("expected").cast("long").alias("expected"), "valid",
        missing.cast("long").alias("missing"), gaps.cast("long").alias("gaps"),
        F.when(F.col("fetched") == 0, "NOT_FETCHED").when(gaps == 0, "COMPLETE").otherwise("PARTIAL").alias("coverage"))


def merge_ranges(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping ranges of a key merged into the fewest ranges.

    Equal starts are collapsed first, so the ordered window sees at most one row per key and day.
    """
    starts = ranges.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(*keys).orderBy(start)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = starts.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int")).withColumn(
        "_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


#: Days of a bucket in which bars and ranges of a symbol meet.
RANGE_BUCKET = 64


def scan_bars_ranges(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bars of each symbol inside its wanted ranges; ranges are merged so a bar is read once.

    Bars and ranges meet by symbol and bucket of days, never by the symbol alone: a bucket holds at most ``RANGE_BUCKET`` bars and half as many merged ranges.
    """
    merged = merge_ranges(ranges, ["symbol"], "start_date", "end_date")
    bucket = lambda day: F.floor(F.unix_date(day) / RANGE_BUCKET)
    pieces = merged.select("symbol", "start_date", "end_date", F.explode(F.sequence(bucket("start_date"), bucket("end_date"))).alias("_bucket"))
    return bars.withColumn("_bucket", bucket("session_date")).join(pieces, ["symbol", "_bucket"]).where(
        F.col("session_date").between(F.col("start_date"), F.col("end_date"))).select(*bars.columns)


def scan_source_priority(*sources: DataFrame) -> DataFrame:
    """All bars of each symbol's best source; the earlier argument wins."""
    tagged = [df.withColumn("source_rank", F.lit(rank)) for rank, df in enumerate(sources)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    best = rows.groupBy("symbol").agg(F.min("source_rank").alias("source_rank"))
    return rows.join(best, ["symbol", "source_rank"])


# --- shapes -----------------------------------------------------------------------


def resample_ohlc(bars: DataFrame, interval: str) -> DataFrame:
    """Day, ISO-week or month candles; one missing any of its four prices is left out."""
    if interval not in ("day", "week", "month"):
        raise ValueError(interval)
    rows = usable(bars)
    period = F.col("session_date") if interval == "day" else F.trunc("session_date", interval)
    candles = rows.groupBy("symbol", period.alias("period_start")).agg(
        F.min("session_date").alias("start_date"), F.max("session_date").alias("end_date"),
        F.min_by("open", "session_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "session_date").alias("close"), F.count("*").alias("sessions"))
    return candles.dropna(subset=list(PRICES))


def first_trading_day(bars: DataFrame) -> DataFrame:
    return bars.where("status = 'VALID'").groupBy("symbol").agg(F.min("session_date").alias("first_day"))


def bar_inventory(series: DataFrame, bars: DataFrame, sessions: DataFrame, spine: DataFrame, completed: str) -> DataFrame:
    """Bars, first and last day and gaps between a series' first bar and the last completed session."""
    held = bars.where("status = 'VALID'").groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("session_date").alias("start_date"), F.max("session_date").alias("last_date"),
        F.max(F.lit(completed).cast("date")).alias("end_date"))
    # a plain literal would turn the join with the spine into a nested loop
    ranges, held = held.select("symbol", "start_date", "end_date"), held.drop("end_date")
    covered = coverage(ranges, bars, sessions, spine, completed).select("symbol", F.col("gaps").alias("gap_days"))
    return (series.join(held, "symbol", "left").join(covered, "symbol", "left").fillna(0, ["bars", "gap_days"])
            .withColumn("ready", F.col("active") & (F.col("bars") > 0) & (F.col("gap_days") == 0)))


# --- corrections ------------------------------------------------------------------

ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 1e-4, 1e-5


def correct_bars(stored: DataFrame, fetched: DataFrame, absolute: float = ABSOLUTE_TOLERANCE,
                 relative: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Stored bars after a refetch; series are replaced whole, never stitched, and never by a part of themselves.

    A series differs when a price of a common session does (beyond tolerance, or one is NULL), or when a session
    inside both ranges is on one side only (a gap closed or opened). ``fetched`` has a column ``is_full``: a differing series takes the
    bars of a full fetch (``replaced``); after a partial one it stays as it is and is marked ``needs_full``.
    A series that does not differ gets the fetched bars it lacks.
    """
    new = fetched.select("symbol", "session_date", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in PRICES])
    both = stored.select("symbol", "session_date", *PRICES, F.lit(True).alias("_old")).join(new, ["symbol", "session_date"], "full")
    differs = F.lit(False)
    for c in PRICES:
        allowed = F.greatest(F.lit(absolute), F.abs(F.col(c)) * relative)
        differs = differs | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) > allowed, F.col(c).isNull() != F.col(f"_{c}").isNull())
    old, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    day = F.col("session_date")
    seen = both.groupBy("symbol").agg(
        F.bool_or(F.when(old & fresh, differs).otherwise(False)).alias("_changed"),
        F.greatest(F.min(F.when(old, day)), F.min(F.when(fresh, day))).alias("_from"), F.least(F.max(F.when(old, day)), F.max(F.when(fresh, day))).alias("_to"),
        F.count_if(old).alias("_olds"), F.count_if(fresh).alias("_news")).where("_olds > 0 and _news > 0")
    gaps = both.where(~(old & fresh)).join(seen, "symbol").where(day.between(F.col("_from"), F.col("_to"))).select("symbol").distinct()
    corrected = seen.where("_changed").select("symbol").union(gaps).distinct()
    full = fetched.where("is_full").select("symbol").distinct()
    swapped, waiting = corrected.join(full, "symbol", "left_semi"), corrected.join(full, "symbol", "left_anti")
    bars = fetched.drop("is_full")
    flags = lambda df, replaced, needs: df.withColumns({"replaced": F.lit(replaced), "needs_full": F.lit(needs)})
    kept = flags(stored.join(corrected, "symbol", "left_anti"), False, False)
    held = flags(stored.join(waiting, "symbol", "left_semi"), False, True)
    replaced = flags(bars.join(swapped, "symbol", "left_semi"), True, False)
    added = flags(bars.join(corrected, "symbol", "left_anti").join(stored.select("symbol", "session_date"), ["symbol", "session_date"], "left_anti"), False, False)
    return kept.unionByName(held).unionByName(replaced).unionByName(added)


def retain_bars(bars: DataFrame, at: str, years: int = 10) -> DataFrame:
    """Bars from January 1 of the first kept complete past year."""
    return bars.where(F.col("session_date") >= F.make_date(F.year(F.lit(at)) - years, F.lit(1), F.lit(1)))


def sync_membership(desired: DataFrame, series: DataFrame, lists_complete: bool, today: str) -> DataFrame:
    """new / returned / kept / removed per symbol; removal needs every list to be complete."""
    rows = (desired.select("symbol").distinct().withColumn("_wanted", F.lit(True))
            .join(series.select("symbol", "active", "removed_on"), "symbol", "full"))
    wanted, known = F.col("_wanted").isNotNull(), F.col("active").isNotNull()
    gone = known & ~wanted & F.col("active") & F.lit(lists_complete)
    change = (F.when(wanted & ~known, "new").when(wanted & ~F.col("active"), "returned").when(wanted, "kept")
              .when(gone, "removed").otherwise("unchanged"))
    return rows.select("symbol", change.alias("change"), F.coalesce(wanted | (F.col("active") & ~gone), F.lit(False)).alias("active"),
                       F.when(gone, F.lit(today).cast("date")).when(~wanted, F.col("removed_on")).alias("removed_on"))
