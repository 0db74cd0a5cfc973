"""Alerts as streams with keyed state, and tables in hash buckets: restarts, pages landed late or again, and what a batch reads and writes."""

from datetime import date, datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgertide.streaming import alerts, jobs
from ledgertide.streaming.tables import BucketLog, BucketSnapshot

T0 = datetime(2024, 3, 1, 12)


def hours(n):
    return T0 + timedelta(hours=n)


class Pages:
    """Lands pages of rows and starts the same stream anew after each; returns what the page added."""

    def __init__(self, spark, tmp_path, schema, stream, out):
        self.spark, self.path, self.schema, self.stream, self.out, self.seen = spark, tmp_path, schema, stream, out, []

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(f"{self.path}/in")
        jobs.append(self.stream(jobs.landed(self.spark, f"{self.path}/in", self.schema)), f"{self.path}/out", f"{self.path}/state").awaitTermination()
        now = [r.asDict() for r in self.spark.read.schema(self.out).parquet(f"{self.path}/out").collect()]
        new = [r for r in now if r not in self.seen]
        assert len(now) == len(self.seen) + len(new)
        self.seen = now
        return new


def trade(name, owners, accepted, code="P", amount=10, plan=False, **other):
    return {"id": name, "code": code, "table_no": "I", "status": "CURRENT", "visible": True, "accepted_at": accepted, "transaction_date": accepted.date() - timedelta(days=2),
            "amount": None if amount is None else Decimal(amount), "is_plan": plan, "owner_ids": owners, **other}


@pytest.fixture
def filings(spark, tmp_path):
    followed = spark.createDataFrame([("p", T0), ("q", T0 - timedelta(days=400)), ("late", hours(50))], "person_id string, followed_at timestamp")
    stream = lambda landed: alerts.trade_alert_stream(landed, followed, "2024-02-28 00:00:00", lookback=30, remember_days=60, buckets=2)
    return Pages(spark, tmp_path, alerts.FILING_SCHEMA, stream, alerts.TRADE_ALERT_SCHEMA)


def test_a_filing_is_told_of_once_over_restarts_and_late_pages(filings):
    # T0 is after the start, q is followed from the start on, so q speaks for a joint filing
    one = ("F1", "i", hours(2), [trade("a", ["p", "q"], hours(1)), trade("b", ["p", "q"], hours(1), "S", 5, True), trade("c", ["p"], hours(1), "S", None, False), trade("d", ["p"], hours(1), "M")])
    [found] = filings.land([one, ("F2", "i", hours(2), [trade("e", ["x"], hours(1))])])
    assert (found["dedupe_key"], found["person_id"], found["rows"], found["buys"], found["sells"], float(found["amount"]), found["plan"]) == ("trade:sec:F1", "q", 3, 1, 2, 15.0, "partly")
    # landed again, and with one more trade: nothing
    assert filings.land([(*one[:2], hours(5), one[3] + [trade("f", ["p"], hours(4))])]) == []
    # accepted earlier than all before, landed later
    [late] = filings.land([("F0", "j", hours(6), [trade("g", ["p"], hours(0))])])
    assert late["dedupe_key"] == "trade:sec:F0"
    # before the start, before the person was followed, beyond the lookback: nothing; a person followed later: from then on
    old = datetime(2024, 2, 27)
    assert filings.land([("F3", "j", hours(7), [trade("h", ["q"], old)]), ("F4", "j", hours(7), [trade("i", ["late"], hours(6))]), ("F5", "j", hours(24 * 31 + 2), [trade("k", ["p"], hours(1))])]) == []
    assert [r["dedupe_key"] for r in filings.land([("F6", "j", hours(24 * 31 + 3), [trade("l", ["late"], hours(24 * 31 + 2))])])] == ["trade:sec:F6"]


def test_a_filing_that_qualifies_later_and_the_end_of_its_state(filings):
    assert filings.land([("F1", "i", hours(2), [trade("a", ["p"], hours(1), status="NEEDS_REVIEW")])]) == []
    [found] = filings.land([("F1", "i", hours(3), [trade("a", ["p"], hours(1)), trade("b", ["p"], hours(1), "S", 1, None)])])
    assert found["plan"] == "unknown"
    # the state ends sixty days after the last landing: then the filing would be new
    filings.land([("F9", "i", hours(24 * 90), [trade("z", ["p"], hours(24 * 90))])])
    filings.land([("F8", "i", hours(24 * 93), [trade("y", ["p"], hours(24 * 93))])])
    [again] = filings.land([("F1", "i", hours(24 * 94), [trade("a", ["p"], hours(24 * 93))])])
    assert again["dedupe_key"] == "trade:sec:F1"


PURCHASE = ("id string, accession string, issuer_id string, owner_ids array<string>, code string, form string, is_ceo boolean, is_cfo boolean, counted decimal(38,12), "
            "transaction_date date, accepted_at timestamp, received_at timestamp")


def purchase(name, accession, received, counted=None, owners=("p",), issuer="i", code="P", form="4", ceo=True, day=None, accepted=None):
    accepted = accepted or received
    return (name, accession, issuer, list(owners), code, form, ceo, False, counted, day or accepted.date() - timedelta(days=1), accepted, received)


def test_pages_of_one_filing_give_one_executive_alert(spark, tmp_path):
    D = Decimal
    stream = lambda landed: alerts.executive_stream(landed, 100, "2024-01-01 00:00:00", buckets=2)
    pages = Pages(spark, tmp_path, PURCHASE, stream, alerts.EXECUTIVE_SCHEMA)
    assert pages.land([purchase("a", "F1", hours(0), D("60.005")), purchase("b", "F2", hours(0), D("99.99")), purchase("c", "F3", hours(0), D("500"), form="4/A"), purchase("d", "F4", hours(0), D("500"), ceo=False)]) == []
    # the same page again does not count twice; a mismatched price counts as a row without an amount
    assert pages.land([purchase("a", "F1", hours(0), D("60.005")), purchase("e", "F1", hours(1))]) == []
    [found] = pages.land([purchase("f", "F1", hours(2), D("40"), day=date(2024, 1, 5))])
    assert (found["dedupe_key"], found["rows"], found["amount"], found["traded_from"], found["person_id"]) == ("rule_executive:F1", 3, D("100.01"), date(2024, 1, 5), "p")
    assert pages.land([purchase("g", "F1", hours(3), D("900"))]) == []
    [found] = pages.land([purchase("h", "F2", hours(4), D("0.01"))])
    assert (found["dedupe_key"], found["amount"]) == ("rule_executive:F2", D("100"))


def test_cluster_state_takes_late_trades_and_stays_quiet(spark, tmp_path):
    D = Decimal
    pages = Pages(spark, tmp_path, PURCHASE, lambda landed: alerts.cluster_stream(landed, 7, 2, delay="200 days"), alerts.CLUSTER_SCHEMA)
    day = lambda n: datetime(2024, 3, 1) + timedelta(days=n)
    buy = lambda name, owner, traded, accepted, **o: purchase(name, f"F{name}", day(accepted), D(7), [owner], day=day(traded).date(), **o)
    assert pages.land([buy("a", "p", 0, 1), buy("b", "p", 2, 3), buy("s", "q", 2, 3, code="S")]) == []
    [found] = pages.land([buy("c", "q", 6, 7)])
    assert (found["dedupe_key"], found["rows"], found["people"], float(found["amount"]), found["traded_to"]) == ("rule_cluster:i:2024-03-01", 3, 2, 21.0, date(2024, 3, 7))
    # quiet for seven days, whatever comes; then again, as the newest window has another first day
    assert pages.land([buy("d", "r", 8, 9), buy("c", "q", 6, 9)]) == []
    [found] = pages.land([buy("e", "t", 12, 15)])
    assert (found["dedupe_key"], found["rows"]) == ("rule_cluster:i:2024-03-07", 3)
    # an amendment does not fire but counts in the window of a fresh trade; a late trade reaches back to an issuer's older day
    assert pages.land([buy("f", "u", 40, 41, issuer="j"), buy("g", "v", 44, 45, issuer="j", form="4/A")]) == []
    [found] = pages.land([buy("h", "w", 38, 60, issuer="j")])
    assert (found["dedupe_key"], found["rows"], found["people"]) == ("rule_cluster:j:2024-04-08", 3, 3)
    # trades reported later than 90 days after them are no part of it
    assert pages.land([buy("k", "p", 61, 62, issuer="k"), buy("l", "q", 61, 160, issuer="k"), buy("m", "q", 159, 160, issuer="k")]) == []


def test_cluster_alerts_do_not_depend_on_the_batches(spark, tmp_path):
    import random

    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for n in range(160):
        traded = start + timedelta(days=rnd.randrange(150))
        accepted = traded + timedelta(days=rnd.randrange(1, 100), hours=rnd.randrange(3))
        rows.append((f"{n}", f"F{n}", rnd.choice("ij"), rnd.sample("pqrst", rnd.choice([1, 1, 2])), "P", rnd.choice(["4", "4", "4/A"]), False, False, None, traded.date(), accepted, accepted))
    rows.sort(key=lambda r: r[10])
    found = []
    for name, cuts in (("one", [0, 160]), ("many", [0, 30, 31, 90, 140, 160])):
        pages = Pages(spark, tmp_path / name, PURCHASE, lambda landed: alerts.cluster_stream(landed, 5, 3), alerts.CLUSTER_SCHEMA)
        for low, high in zip(cuts, cuts[1:]):
            while high < 160 and high > low and rows[high][10] == rows[high - 1][10]:
                high += 1
            pages.land(rows[low:high]) if name == "one" or low < high else None
        found.append(sorted((r["dedupe_key"], r["rows"], r["people"], r["at"]) for r in pages.seen))
    assert found[0] == found[1] and len(found[0]) > 3
    by_issuer = {}
    for key, _, _, at in sorted(found[0], key=lambda f: f[3]):
        issuer = key.split(":")[1]
        assert issuer not in by_issuer or at - by_issuer[issuer] > timedelta(days=5)
        by_issuer[issuer] = at


def test_digests_close_by_watermark_and_late_alerts_are_told_of(spark, tmp_path):
    pages = Pages(spark, tmp_path, "at timestamp, received_at timestamp, beat boolean", alerts.minute_digests, "minute timestamp, alerts long, message string")
    at = lambda m, s=0: datetime(2024, 1, 1, 9, m, s)
    assert pages.land([(at(0, s), at(0, s), False) for s in range(5)] + [(at(5), at(5), False)]) == []
    # inside the delay: joins its minute, which becomes a digest
    assert pages.land([(at(0, 30), at(9), False)]) == []
    pages.land([(at(20), at(20), True)])
    pages.land([(at(21), at(21), True)])
    assert sorted((r["minute"], r["alerts"], r["message"]) for r in pages.seen) == [(at(0), 6, "digest"), (at(5), 1, "single")]
    # beyond it: told of as late, and the closed minute does not come again
    new = pages.land([(at(0, 59), at(22), False), (at(0, 58), at(22), False), (at(21, 30), at(22), False)])
    assert [(r["minute"], r["alerts"], r["message"]) for r in new][:1] == [(at(0), 1, "late")]
    late = spark.read.parquet(f"{tmp_path}/out").where("message = 'late'").count()
    assert late == 2


FILING = "accession string, form string, issuer_id string, role string, accepted_at timestamp"


def test_log_keeps_each_key_once_and_reads_touched_buckets_only(spark, tmp_path):
    log = BucketLog(spark, str(tmp_path / "log"), FILING, "accession", 8, 3)
    page = lambda names, h=0, role="a": spark.createDataFrame([(n, "4", "i", role, hours(h)) for n in names], FILING)
    log.insert(0, page([f"A{n}" for n in range(40)]), ["accepted_at"])
    log.insert(1, page(["A3", "B1"], 1), ["accepted_at"])
    log.insert(1, page(["A3", "B1"], 1), ["accepted_at"])  # a retry
    assert log.read().count() == 41 and log.read().where("accession = 'A3'").first()["accepted_at"] == hours(0)
    touched = log.touched(page(["B1"]))
    assert len(touched) == 1
    files = log.read(2, touched).select("accession")
    scanned = files._jdf.queryExecution().executedPlan().toString()
    assert f"bucket" in scanned.split("PartitionFilters: [")[1].split("]")[0]
    log.insert(2, page(["C1", "A0"], -50), ["accepted_at"])  # older than all: a gap that is caught up
    log.insert(3, page(["C1", "D1"], 4), ["accepted_at"])  # compacts 0 to 2
    assert {p for p in log.parts()} == {(0, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "b")} and log.read().count() == 43
    for b in (4, 5, 6):
        log.insert(b, page([f"E{b}", "D1"], b), ["accepted_at"])
    assert log.parts() == [(2, "c"), (3, "b"), (4, "b"), (5, "b"), (5, "c"), (6, "b")] and log.read().count() == 46
    log.insert(6, page(["E6", "D1"], 6), ["accepted_at"])
    assert log.read().groupBy("accession").count().where("count > 1").isEmpty() and log.read().count() == 46


def test_a_batch_that_failed_half_way_is_invisible(spark, tmp_path):
    log = BucketLog(spark, str(tmp_path / "log"), FILING, "accession", 4)
    rows = spark.createDataFrame([("A", "4", "i", "a", hours(0))], FILING)
    log.insert(0, rows, ["accepted_at"])
    log.put(rows.withColumn("accession", F.lit("B")), 1)
    (Path(log.folder(1)) / "_SUCCESS").unlink()
    assert [r["accession"] for r in log.read().collect()] == ["A"]
    log.insert(1, rows.withColumn("accession", F.lit("C")), ["accepted_at"])
    assert sorted(r["accession"] for r in log.read().collect()) == ["A", "C"]


def test_filings_stream_with_an_interrupted_scan(spark, tmp_path):
    log = BucketLog(spark, str(tmp_path / "log"), jobs.FILING_SCHEMA, "accession", 4, 2)
    schema = f"{jobs.FILING_SCHEMA}, received_at timestamp"

    def land(*rows):
        spark.createDataFrame([(n, "4", "i", role, hours(a), hours(r)) for n, role, a, r in rows], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        jobs.filing_log(jobs.landed(spark, f"{tmp_path}/in", schema), log, f"{tmp_path}/state").awaitTermination()

    land(("A9", "b", 9, 10), ("A9", "a", 9, 10), ("A8", "a", 8, 10))
    land(("A9", "a", 9, 11), ("A10", "a", 10, 11))
    gaps = jobs.arrival_gaps(log.read(), 4).collect()
    assert gaps == []
    land(("A30", "a", 30, 31))
    [gap] = jobs.arrival_gaps(log.read(), 4).collect()
    assert gap["gap_after"] == hours(10)
    land(*[(f"A{n}", "a", n, 40) for n in range(-2000, 30, 3)])  # pages far older than the memory of the state
    assert jobs.arrival_gaps(log.read().where(F.col("accepted_at") > hours(0)), 4).collect() == []
    rows = log.read().collect()
    assert len(rows) == len({r["accession"] for r in rows}) and next(r for r in rows if r["accession"] == "A9")["role"] == "a"


QUOTES = "symbol string, value double, source_time timestamp, as_of date, fetched_at timestamp, quote_status string"


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    from ledgertide.sources.market import merge_quotes

    table = BucketSnapshot(spark, str(tmp_path / "quotes"), QUOTES, "symbol", 16)
    quote = lambda rows: spark.createDataFrame([(s, v, hours(h), hours(h).date(), hours(h), "LIVE") for s, v, h in rows], QUOTES)
    table.update(0, quote([(f"S{n}", float(n), 0) for n in range(200)]), merge_quotes)
    assert table.read().count() == 200
    whole = sum(p.stat().st_size for p in Path(table.folder(0)).rglob("*.parquet"))
    table.update(1, quote([("S7", 70.0, 2), ("NEW", 1.0, 2)]), merge_quotes)
    written = sum(p.stat().st_size for p in Path(table.folder(1)).rglob("*.parquet"))
    assert written < whole / 4
    table.update(1, quote([("S7", 70.0, 2), ("NEW", 1.0, 2)]), merge_quotes)  # a retry
    now = {r["symbol"]: r["value"] for r in table.read().collect()}
    assert len(now) == 201 and now["S7"] == 70.0 and now["S8"] == 8.0
    table.update(2, quote([("S7", 60.0, 1)]), merge_quotes)  # older
    table.update(3, quote([("S7", 80.0, 3)]), merge_quotes)
    now = {r["symbol"]: r["value"] for r in table.read().collect()}
    assert len(now) == 201 and now["S7"] == 80.0
    [bucket] = table.touched(quote([("S7", 0.0, 0)]))
    assert table.versions()[bucket] == [3, 2] and all(len(v) <= 2 for v in table.versions().values())
