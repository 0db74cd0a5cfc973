"""Exchange sessions as a dimension: offsets, as-of lookups and reaction days are equi-joins on it.

A calendar has about 252 sessions a year, so a century is under 26,000 rows. That bound is what
allows the broadcasts and the single ordered window (per calendar) in this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"

# Full-day exchange closures outside the holiday rules, since 1990.
SPECIAL_CLOSURES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11",
    "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


# --- holiday rules ----------------------------------------------------------------


def _nth(month: int, weekday: int, n: int) -> str:
    """SQL date of the n-th weekday (0 = Monday) of a month of ``year``."""
    first = f"make_date(year, {month}, 1)"
    return f"date_add({first}, (({weekday} - weekday({first}) + 7) % 7) + {7 * (n - 1)})"


def _last_monday_of_may() -> str:
    return "date_sub(make_date(year, 5, 31), weekday(make_date(year, 5, 31)))"


def _observed(day: str, saturday_moves: bool = True) -> str:
    back = f"date_sub({day}, 1)" if saturday_moves else "NULL"
    return (f"CASE weekday({day}) WHEN 5 THEN {back} WHEN 6 THEN date_add({day}, 1) ELSE {day} END")


# Gregorian Easter (anonymous computus), as nested SQL over a column ``year``.
_EASTER_STEPS = (
    "year % 19 AS a, year div 100 AS b, year % 100 AS c",
    "(19 * a + b - b div 4 - (b - (b + 8) div 25 + 1) div 3 + 15) % 30 AS h",
    "(32 + 2 * (b % 4) + 2 * (c div 4) - h - c % 4) % 7 AS l",
    "h + l - 7 * ((a + 11 * h + 22 * l) div 451) + 114 AS e",
)


def _with_easter(years: DataFrame) -> DataFrame:
    for step in _EASTER_STEPS:
        years = years.selectExpr("*", *_split_aliases(step))
    return years.selectExpr("year", "make_date(year, int(e div 31), int(e % 31) + 1) AS easter")


def _split_aliases(step: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for position, char in enumerate(step):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append(step[start:position])
            start = position + 1
    return [*parts, step[start:]]


def _years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def exchange_holidays(years: DataFrame) -> DataFrame:
    """Full-day US stock exchange holidays of a ``year`` column, as (day)."""
    rules = [
        _observed("make_date(year, 1, 1)", saturday_moves=False),
        f"CASE WHEN year >= 1998 THEN {_nth(1, 0, 3)} END",
        _nth(2, 0, 3),
        "date_sub(easter, 2)",
        _last_monday_of_may(),
        f"CASE WHEN year >= 2022 THEN {_observed('make_date(year, 6, 19)')} END",
        _observed("make_date(year, 7, 4)"),
        _nth(9, 0, 1),
        _nth(11, 3, 4),
        _observed("make_date(year, 12, 25)"),
    ]
    closures = ", ".join(f"date'{day}'" for day in SPECIAL_CLOSURES)
    ruled = _with_easter(years).selectExpr(f"explode(array({', '.join(rules)})) AS day")
    special = years.selectExpr("year", f"explode(array({closures})) AS day").where("year(day) = year").select("day")
    return ruled.where("day IS NOT NULL").unionByName(special).distinct()


def federal_holidays(years: DataFrame) -> DataFrame:
    """US federal holidays with the nearest-workday rule, as (day); not the exchange's list."""
    rules = [
        _observed("make_date(year, 1, 1)"),
        f"CASE WHEN year >= 1986 THEN {_nth(1, 0, 3)} END",
        _nth(2, 0, 3),
        _last_monday_of_may(),
        f"CASE WHEN year >= 2021 THEN {_observed('make_date(year, 6, 19)')} END",
        _observed("make_date(year, 7, 4)"),
        _nth(9, 0, 1),
        _nth(10, 0, 2),
        _observed("make_date(year, 11, 11)"),
        _nth(11, 3, 4),
        _observed("make_date(year, 12, 25)"),
    ]
    return years.selectExpr(f"explode(array({', '.join(rules)})) AS day").where("day IS NOT NULL").distinct()


def _early_close() -> str:
    return f"""
        (month(session_date) = 11 AND weekday(session_date) = 4
            AND session_date = date_add({_nth(11, 3, 4)}, 1))
        OR (month(session_date) = 12 AND day(session_date) = 24 AND year >= 1993 AND weekday(session_date) < 4)
        OR (month(session_date) = 7 AND day(session_date) = 3 AND year >= 1995 AND weekday(session_date) IN (0, 1, 3))
        OR (month(session_date) = 7 AND day(session_date) = 3 AND year >= 2013 AND weekday(session_date) = 2)
        OR (month(session_date) = 7 AND day(session_date) = 5 AND year BETWEEN 1995 AND 2012 AND weekday(session_date) = 4)
    """


# --- the session dimension --------------------------------------------------------


def number_sessions(days: DataFrame, calendar: str = "XNYS") -> DataFrame:
    """(calendar, session_date, session_no) with consecutive numbers from 1."""
    w = Window.partitionBy("calendar").orderBy("session_date")
    return days.select(F.lit(calendar).alias("calendar"), "session_date").withColumn(
        "session_no", F.row_number().over(w))


def add_bounds(sessions: DataFrame) -> DataFrame:
    """Add open_ts and close_ts (UTC instants): 09:30–16:00 Eastern, 13:00 on early closes."""
    timed = sessions.withColumn("year", F.year("session_date")).withColumn("early_close", F.expr(_early_close()))
    local = lambda hhmm: F.to_utc_timestamp(
        F.to_timestamp(F.concat(F.col("session_date").cast("string"), F.lit(f" {hhmm}:00"))), NEW_YORK)
    return timed.select(
        "calendar", "session_date", "session_no", local("09:30").alias("open_ts"),
        F.when(F.col("early_close"), local("13:00")).otherwise(local("16:00")).alias("close_ts"), "early_close")


def exchange_sessions(spark: SparkSession, first_year: int, last_year: int, calendar: str = "XNYS") -> DataFrame:
    """Every US stock exchange session of the given years with its bounds."""
    years = _years(spark, first_year, last_year)
    days = years.select(F.explode(F.expr(
        "sequence(make_date(year, 1, 1), make_date(year, 12, 31))")).alias("session_date")).where(
        F.weekday("session_date") < 5)
    holidays = exchange_holidays(years).withColumnRenamed("day", "session_date")
    return add_bounds(number_sessions(days.join(F.broadcast(holidays), "session_date", "left_anti"), calendar))


def observed_sessions(days: DataFrame, day: str = "session_date", calendar: str = "OBSERVED") -> DataFrame:
    """A calendar from data: the distinct weekdays that have a row."""
    seen = days.select(F.col(day).alias("session_date")).where(F.weekday(day) < 5).distinct()
    return number_sessions(seen, calendar)


def sessions_between(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive range; empty when start is after end."""
    return sessions.where(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def date_spine(sessions: DataFrame, margin: int = 40) -> DataFrame:
    """One row per calendar day with the session number before, on or after it.

    prev_excl < prev_incl <= day and next_incl >= day, next_excl > day, as session numbers. A number
    outside the calendar simply finds no session in the joins that use it.
    """
    bounds = sessions.groupBy("calendar").agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    days = bounds.select("calendar", F.explode(F.sequence(
        F.date_sub("lo", margin), F.date_add("hi", margin))).alias("day"))
    marked = days.join(F.broadcast(sessions.select(
        "calendar", F.col("session_date").alias("day"), "session_no")), ["calendar", "day"], "left")
    w = Window.partitionBy("calendar").orderBy("day")
    before = F.count("session_no").over(w).cast("int")
    spine = marked.withColumn("prev_incl", before).withColumn(
        "prev_excl", F.col("prev_incl") - F.col("session_no").isNotNull().cast("int"))
    return spine.select("calendar", "day", "prev_excl", "prev_incl", (F.col("prev_excl") + 1).alias("next_incl"),
                        (F.col("prev_incl") + 1).alias("next_excl"))


# --- lookups ----------------------------------------------------------------------


def with_spine(df: DataFrame, day: str, spine: DataFrame, calendar: str | None = None, prefix: str = "") -> DataFrame:
    """Attach the four session numbers of ``day``."""
    columns = [F.col("day").alias("_day"), *[F.col(c).alias(prefix + c) for c in
                                             ("prev_excl", "prev_incl", "next_incl", "next_excl")]]
    return df.join(F.broadcast(spine.select(*columns)), df[day] == F.col("_day"), "left").drop("_day")


def session_date_of(df: DataFrame, number: str, sessions: DataFrame, name: str) -> DataFrame:
    """Attach the date of a session number as ``name``."""
    dim = sessions.select(F.col("session_no").alias("_no"), F.col("session_date").alias(name))
    return df.join(F.broadcast(dim), df[number] == F.col("_no"), "left").drop("_no")


def next_session(df: DataFrame, day: str, spine: DataFrame, sessions: DataFrame, inclusive: bool = True,
                 name: str = "next_session") -> DataFrame:
    column = "next_incl" if inclusive else "next_excl"
    found = with_spine(df, day, spine, prefix="_s_")
    return session_date_of(found, f"_s_{column}", sessions, name).drop(*[c for c in found.columns if c[:3] == "_s_"])


def previous_session(df: DataFrame, day: str, spine: DataFrame, sessions: DataFrame, inclusive: bool = False,
                     name: str = "previous_session") -> DataFrame:
    column = "prev_incl" if inclusive else "prev_excl"
    found = with_spine(df, day, spine, prefix="_s_")
    return session_date_of(found, f"_s_{column}", sessions, name).drop(*[c for c in found.columns if c[:3] == "_s_"])


def session_window(df: DataFrame, anchor_no: str, before: int, after: int, sessions: DataFrame) -> DataFrame:
    """before + 1 + after rows per input row: (offset, window_date) around a session number."""
    if before < 0 or after < 0:
        raise ValueError("session counts must not be negative")
    rows = df.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    rows = rows.withColumn("_w_no", F.col(anchor_no) + F.col("offset"))
    return session_date_of(rows, "_w_no", sessions, "window_date").drop("_w_no")


def last_completed_session(asof: DataFrame, stamp: str, sessions: DataFrame, spine: DataFrame,
                           name: str = "completed") -> DataFrame:
    """The latest session whose close is at or before each instant (early closes included)."""
    local = asof.withColumn("_local", F.to_date(F.from_utc_timestamp(stamp, NEW_YORK)))
    placed = with_spine(local, "_local", spine, prefix="_s_")
    closes = sessions.select(F.col("session_no").alias("_no"), F.col("close_ts").alias("_close"))
    placed = placed.join(F.broadcast(closes), F.col("_s_prev_incl") == F.col("_no"), "left").drop("_no")
    number = F.when(F.col("_close") <= F.col(stamp), F.col("_s_prev_incl")).otherwise(F.col("_s_prev_incl") - 1)
    return session_date_of(placed.withColumn("_c", number), "_c", sessions, name).select(*asof.columns, name)


def reaction_day_number(session: Column, next_incl: Column, next_excl: Column) -> Column:
    """Session number of the reaction day: the next session for after_close, else the same day or next."""
    return F.when(session == "after_close", next_excl).otherwise(next_incl)


def reaction_session(df: DataFrame, stamp: str, day: str, precision: str, sessions: DataFrame,
                     spine: DataFrame) -> DataFrame:
    """Reaction and baseline session of an announcement with a time, a date, or both.

    ``stamp`` is a UTC instant (or NULL), ``day`` a date (or NULL), ``precision`` one of exact,
    before_open, after_close, intraday, date_only, conflict.
    """
    local_day = F.to_date(F.from_utc_timestamp(stamp, NEW_YORK))
    rows = df.withColumn("event_date", F.coalesce(local_day, F.col(day))).withColumn(
        "_date_conflict", F.col(stamp).isNotNull() & F.col(day).isNotNull() & (local_day != F.col(day)))
    rows = with_spine(rows, "event_date", spine, prefix="_s_")
    bounds = sessions.select(F.col("session_date").alias("_sd"), F.col("open_ts").alias("_open"),
                             F.col("close_ts").alias("_close"))
    rows = rows.join(F.broadcast(bounds), F.col("event_date") == F.col("_sd"), "left")
    p, t = F.col(precision), F.col(stamp)
    on_session, timed = F.col("_sd").isNotNull(), t.isNotNull()
    after_bell = timed & on_session & (t >= F.col("_close"))
    during = timed & on_session & (t >= F.col("_open")) & (t < F.col("_close"))
    category_conflict = timed & on_session & (((p == "before_open") & (t >= F.col("_open")))
                                              | ((p == "after_close") & (t < F.col("_close"))))
    conflict = F.col("_date_conflict") | F.coalesce(category_conflict, F.lit(False))
    later = ((p == "after_close") & on_session) | ((p == "exact") & after_bell)
    number = F.when(later, F.col("_s_next_excl")).otherwise(F.col("_s_next_incl"))
    intraday = (p == "intraday") | ((p == "exact") & during)
    precise = (p.isin("before_open", "after_close") | ((p == "exact") & timed & ~F.coalesce(during, F.lit(False)))) & ~conflict
    status = (F.when(F.col("event_date").isNull(), "missing_event_date")
              .when(conflict, "conflicting_event_time").when(intraday, "intraday_observation")
              .when(precise, "available").otherwise("unconfirmed_event_time"))
    rows = rows.withColumn("reaction_no", number).withColumn("baseline_no", number - 1)
    rows = session_date_of(session_date_of(rows, "reaction_no", sessions, "reaction_date"),
                           "baseline_no", sessions, "baseline_date")
    return rows.select(*df.columns, "reaction_no", "baseline_no", "reaction_date", "baseline_date",
                       F.coalesce(precise, F.lit(False)).alias("opening_attribution"), status.alias("reaction_status"))


def next_open_after(df: DataFrame, stamp: str, sessions: DataFrame, spine: DataFrame,
                    name: str = "next_open") -> DataFrame:
    """The first session whose open is strictly after the instant."""
    rows = df.withColumn("_local", F.to_date(F.from_utc_timestamp(stamp, NEW_YORK)))
    rows = with_spine(rows, "_local", spine, prefix="_s_")
    opens = sessions.select(F.col("session_no").alias("_no"), F.col("open_ts").alias("_open"))
    rows = rows.join(F.broadcast(opens), F.col("_s_next_incl") == F.col("_no"), "left").drop("_no")
    number = F.when(F.col("_open") <= F.col(stamp), F.col("_s_next_incl") + 1).otherwise(F.col("_s_next_incl"))
    rows = rows.withColumn(f"{name}_no", number)
    return session_date_of(rows, f"{name}_no", sessions, name).select(*df.columns, f"{name}_no", name)


def market_phase(df: DataFrame, stamp: str, sessions: DataFrame) -> DataFrame:
    """regular / pre (from 04:00) / post (to 20:00) / closed, Eastern, with the next boundary."""
    local = F.from_utc_timestamp(stamp, NEW_YORK)
    rows = df.withColumn("_local", F.to_date(local))
    bounds = sessions.select(F.col("session_date").alias("_sd"), F.col("open_ts").alias("_open"),
                             F.col("close_ts").alias("_close"))
    rows = rows.join(F.broadcast(bounds), F.col("_local") == F.col("_sd"), "left")
    at = lambda hhmm: F.to_utc_timestamp(
        F.to_timestamp(F.concat(F.col("_local").cast("string"), F.lit(f" {hhmm}:00"))), NEW_YORK)
    t = F.col(stamp)
    phase = (F.when((t >= F.col("_open")) & (t < F.col("_close")), "regular")
             .when((t >= at("04:00")) & (t < F.col("_open")), "pre")
             .when((t >= F.col("_close")) & (t < at("20:00")), "post").otherwise("closed"))
    boundary = (F.when(phase == "regular", F.col("_close")).when(phase == "pre", F.col("_open"))
                .when(phase == "post", at("20:00")))
    return rows.select(*df.columns, phase.alias("market_phase"), boundary.alias("phase_ends"))


# --- date arithmetic --------------------------------------------------------------


def months_back(day: Column, months: int) -> Column:
    """The same calendar day earlier, or that month's last day."""
    return F.add_months(day, -months)


def period_anchor(end: Column, period: str) -> Column:
    if period == "1w":
        return F.date_sub(end, 7)
    if period in ("1m", "3m"):
        return months_back(end, int(period[0]))
    if period == "ytd":
        return F.make_date(F.year(end) - 1, F.lit(12), F.lit(31))
    raise ValueError(period)


def parse_mmdd(text: str) -> tuple[int, int]:
    month, day = (int(part) for part in text.split("-"))
    if not (1 <= month <= 12 and 1 <= day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)):
        raise ValueError(f"invalid month-day: {text}")
    return month, day


def mapped_day(year: str, month: int, day: int) -> str:
    """SQL date of a month-day in ``year``; Feb 29 falls back to Feb 28."""
    return f"make_date({year}, {month}, least({day}, day(last_day(make_date({year}, {month}, 1)))))"


def eastern_instant(text: Column) -> Column:
    """UTC instant of naive Eastern text; NULL when the wall time does not exist or happens twice."""
    ts = F.try_to_timestamp(text)
    utc = F.to_utc_timestamp(ts, NEW_YORK)
    exists = F.from_utc_timestamp(utc, NEW_YORK) == ts
    repeated = (F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), NEW_YORK) == ts) | (
        F.from_utc_timestamp(utc - F.expr("INTERVAL 1 HOUR"), NEW_YORK) == ts)
    return F.when(exists & ~repeated, utc)


def quarter_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar quarter of each inclusive range, newest first by quarter_pos."""
    quarter = F.explode(F.sequence(F.trunc(start, "quarter"), F.trunc(end, "quarter"), F.expr("INTERVAL 3 MONTHS")))
    rows = df.where(F.col(start) <= F.col(end)).withColumn("_q", quarter)
    last = F.date_sub(F.add_months("_q", 3), 1)
    position = F.months_between(F.trunc(end, "quarter"), F.col("_q")) / 3 + 1
    return rows.select(*df.columns, position.cast("int").alias("quarter_pos"),
                       F.greatest(F.col(start), F.col("_q")).alias("range_start"),
                       F.least(F.col(end), last).alias("range_end"))


def business_days(days: DataFrame, day: str, holidays: DataFrame) -> DataFrame:
    """Weekdays of ``days`` that are not federal holidays."""
    return days.where(F.weekday(day) < 5).join(
        F.broadcast(holidays.withColumnRenamed("day", day)), day, "left_anti")


def full_years(first_days: DataFrame, first: str, sessions: DataFrame, today: str, years: int) -> DataFrame:
    """Complete past years of each series traded from their first session."""
    openings = (sessions.groupBy(F.year("session_date").alias("_y")).agg(F.min("session_date").alias("_opening"))
                .where(F.col("_y").between(F.year(F.lit(today)) - years, F.year(F.lit(today)) - 1)))
    spread = first_days.withColumn("_y", F.explode(F.expr(
        f"sequence(year(date'{today}') - {years}, year(date'{today}') - 1)")))
    matched = spread.join(F.broadcast(openings), "_y", "left")
    return matched.groupBy(*first_days.columns).agg(
        F.count_if(F.col(first) <= F.col("_opening")).alias("full_years"))
