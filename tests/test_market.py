import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgertide.operators import bars as bar
from ledgertide.operators import calendar as cal
from ledgertide.operators import events as evt
from ledgertide.operators import seasonality as season
from ledgertide.operators import sectors as sec

BARS = "symbol string, session_date date, open double, high double, low double, close double, status string"


def day(text):
    return date.fromisoformat(text)


def bars_of(spark, rows):
    return spark.createDataFrame([(s, day(d), o, max(o, c), min(o, c), c, "VALID") for s, d, o, c in rows], BARS)


@pytest.fixture(scope="module")
def calendar(spark):
    dim = cal.exchange_sessions(spark, 2023, 2026).cache()
    return dim, cal.date_spine(dim).cache()


def test_exchange_calendar_knows_closures_and_early_closes(spark, calendar):
    rows = {r["session_date"]: r for r in calendar[0].collect()}
    for closed in ("2025-01-01", "2025-01-09", "2025-04-18", "2025-06-19", "2025-07-04", "2025-11-27", "2025-12-25", "2023-01-02"):
        assert day(closed) not in rows
    assert rows[day("2025-11-28")]["early_close"] and rows[day("2025-07-03")]["early_close"] and rows[day("2024-12-24")]["early_close"]
    assert sum(d.year == 2025 for d in rows) == 250
    assert rows[day("2025-11-28")]["close_ts"].hour == 18


def test_eastern_times_that_do_not_exist_or_repeat_are_unknown(spark):
    raw = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-07-01 12:00:00",)], "t string")
    got = [r[0] for r in raw.select(F.date_format(cal.eastern_instant(F.col("t")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == [None, None, "2024-07-01 16:00"]


def test_october_change_against_market_and_sector(spark, calendar):
    bars = bars_of(spark, [("NVDA", "2025-10-01", 185.240005493164, 186.0), ("NVDA", "2025-10-31", 200.0, 202.490005493164),
                           ("^GSPC", "2025-10-01", 6664.919921875, 6700.0), ("^GSPC", "2025-10-31", 6800.0, 6840.2001953125),
                           ("XLK", "2025-10-01", 140.210006713867, 141.0), ("XLK", "2025-10-31", 150.0, 150.339996337891)])
    study = season.periods("monthly", "2026-01-30", 1)
    one = lambda s: bars.where(F.col("symbol") == s)
    candles = season.period_candles(one("NVDA"), calendar[0], study, "2026-01-30", one("^GSPC"), one("XLK"))
    row = candles.where("period = '10' AND year = 2025").first()
    assert row["status"] == "complete" and len(row["missing_dates"]) == row["expected"] - 2
    for column, percent in {"change": 9.312243, "benchmark_change": 2.629893, "sector_change": 7.224869, "excess": 6.682350, "sector_excess": 2.087374}.items():
        assert row[column] * 100 == pytest.approx(percent, abs=5e-7)
    stats = season.period_stats(candles, 1).where("period = '10'").first()
    assert (stats["n"], stats["sector_beat"], stats["sector_paired_n"], stats["best_year"]) == (1, 1, 1, 2025)


def test_after_close_reaction_by_hand(spark, calendar):
    dim, spine = calendar
    bars = bars_of(spark, [("AAPL", "2025-10-23", 259.0, 259.579986572266), ("AAPL", "2025-10-30", 270.0, 271.399993896484),
                           ("AAPL", "2025-10-31", 276.989990234375, 270.369995117188), ("AAPL", "2025-11-07", 269.0, 268.470001220703),
                           ("^GSPC", "2025-10-30", 6800.0, 6822.34), ("^GSPC", "2025-10-31", 6879.17, 6840.20)])
    events = spark.createDataFrame([(1, "AAPL", day("2025-10-30"), "after_close"), (2, "AAPL", day("2025-11-08"), "unknown")],
                                   "event_pos int, ticker string, event_date date, session string")
    rows = evt.analyze_events(events, bars, dim, spine, 5, "2025-11-10", bars.where("symbol = '^GSPC'"))
    w = {(r["event_pos"], r["window"]): r for r in evt.explode_windows(rows, "event_pos").collect()}
    for window, percent in {"before": 4.5535, "reaction": -0.3795, "gap": 2.0597, "after": -0.7027}.items():
        assert w[1, window]["value"] * 100 == pytest.approx(percent, abs=5e-5)
    assert w[1, "reaction"]["excess"] * 100 == pytest.approx(-0.6413, abs=5e-5)
    assert w[2, "after"]["status"] == "pending" and w[2, "reaction"]["status"] == "missing_price"
    notes = {r["event_pos"]: r["notes"] for r in rows.select("event_pos", "notes").collect()}
    assert notes == {1: [], 2: ["session_unknown", "market_closed_on_date"]}


def test_jump_review_equals_the_recursive_rule(spark, calendar):
    rng = random.Random(3)
    days = [r["session_date"] for r in calendar[0].where("session_date < '2024-06-01'").orderBy("session_date").collect()]
    rows, price = [], 100.0
    for d in days:
        if rng.random() < 0.1:
            continue
        price = price * rng.choice([1.0, 1.01, 0.4, 2.2]) if 1 < price < 1e6 else 100.0
        rows.append(("A", d, price, price, price, price, "VALID", rng.choice([None, None, 2.0])))
    df = spark.createDataFrame(rows, BARS + ", splits double").withColumns({
        "dividends": F.lit(None).cast("double"), "instrument": F.lit("EQUITY"), "reason": F.lit(None).cast("string")})
    got = {r["session_date"]: r["status"] for r in bar.review_bar_jumps(df, calendar[0], "2026-01-01").collect()}
    closes, index = {}, {d: i for i, d in enumerate(days)}
    for _, d, *_, close, _, split in rows:
        prior = closes.get(index[d] - 1)
        jump = prior and split in (None, 0, 1) and abs(close / prior - 1) >= 0.5
        assert got[d] == ("NEEDS_REVIEW" if jump else "VALID")
        if not jump:
            closes[index[d]] = close


def test_interval_rules_and_heat_weights(spark):
    assert season.interval_rules("12-15", "02-29", "2026-01-10")["current"] == 2025
    study = spark.range(1).select(F.explode(season.periods("interval", "2026-03-10", 1, "12-15", "02-29")).alias("p")).select("p.*").collect()
    assert [(r["year"], r["last_day"]) for r in study] == [(2025, date(2026, 2, 28)), (2026, date(2027, 2, 28))]
    rows = spark.createDataFrame([("a", "1w", 0.01), ("b", "1w", 0.03), ("c", "1w", None)], "id string, period string, value double")
    got = {r["id"]: r["weight"] for r in sec.heatmap_weight(rows).collect()}
    assert got == {"a": 0.2, "b": 1.0, "c": None}


def test_merge_ranges(spark):
    d = lambda n: date(2024, 1, 1) + timedelta(n)
    df = spark.createDataFrame([("a", d(0), d(5)), ("a", d(3), d(8)), ("a", d(20), d(19)), ("a", d(10), d(11)), ("a", d(11), d(12))], "k string, s date, e date")
    assert sorted((r["s"], r["e"]) for r in bar.merge_ranges(df, ["k"], "s", "e").collect()) == [(d(0), d(8)), (d(10), d(12))]


def test_many_ranges_of_one_symbol_are_counted_and_read_by_index(spark):
    rnd = random.Random(5)
    sessions = cal.exchange_sessions(spark, 2019, 2021)
    spine = cal.date_spine(sessions)
    days = sorted(r["session_date"] for r in sessions.select("session_date").collect())
    rows = [(s, d, 1.0, 2.0, 0.5, 1.5, 10, rnd.choice(["VALID", "VALID", "SUSPECT"])) for s in ("A", "B") for d in days if rnd.random() < 0.8 and (s == "B" or d.month != 5)]
    frame = spark.createDataFrame(rows, "symbol string, session_date date, open double, high double, low double, close double, volume long, status string")
    starts = [date(2019, 1, 1) + timedelta(days=rnd.randrange(1000)) for _ in range(150)]
    wanted = list({("A", d, d + timedelta(days=rnd.choice([0, 1, 5, 40, 400]))) for d in starts} | {("C", starts[0], starts[0] + timedelta(days=30)), ("A", date(2019, 5, 2), date(2019, 5, 20))})
    wanted = [w for w in wanted if w[2] <= date(2021, 12, 31)]
    ranges = spark.createDataFrame(wanted, "symbol string, start_date date, end_date date")
    closed = date(2020, 6, 30)
    have = {(r[0], r[1]): r[7] for r in rows}
    want = set()
    for s, a, b in wanted:
        inside = [d for d in days if a <= d <= b]
        valid = [d for d in inside if have.get((s, d)) == "VALID"]
        gaps = sum(d <= closed for d in inside) - sum(d <= closed for d in valid)
        want.add((s, a, b, len(inside), len(valid), len(inside) - len(valid), gaps, "NOT_FETCHED" if not any((s, d) in have for d in inside) else "COMPLETE" if gaps == 0 else "PARTIAL"))
    found = bar.coverage(ranges, frame, sessions, spine, closed.isoformat())
    assert {tuple(r) for r in found.collect()} == want and len({w[-1] for w in want}) == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner, (symbol" in line and "AND" not in line]
    read = bar.scan_bars_ranges(frame, ranges).collect()
    assert sorted((r["symbol"], r["session_date"]) for r in read) == sorted((s, d) for s, d in have if any(s == x and a <= d <= b for x, a, b in wanted))
