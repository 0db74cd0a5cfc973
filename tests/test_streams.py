from datetime import date, datetime

from pyspark.sql import functions as F

from ledgertide.streaming import jobs
from ledgertide.streaming.tables import BatchLog, Snapshot

TRADE = "id string, accession string, issuer_id string, owner_ids array<string>, transaction_date date, accepted_at timestamp, code string"


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADE).withColumns({
        "status": F.lit("CURRENT"), "table_no": F.lit("I"), "visible": F.lit(True), "amount": F.lit(10).cast("decimal(38,12)"), "counted": F.lit(7).cast("decimal(38,12)"), "is_plan": F.lit(False), "form": F.lit("4")})


def test_alerts_fire_once_even_when_a_batch_is_retried(spark, tmp_path):
    followed = spark.createDataFrame([("p", datetime(2024, 1, 1))], "person_id string, followed_at timestamp")
    log = BatchLog(spark, str(tmp_path / "alerts"), jobs.ALERT_SCHEMA)
    each = jobs.alert_writer(log, followed, "2024-01-01 00:00:00")
    one = trades(spark, [("a", "F1", "i", ["p", "q"], date(2024, 1, 2), datetime(2024, 1, 3), "P"), ("b", "F0", "i", ["p"], date(2023, 1, 2), datetime(2023, 12, 3), "P")])
    each(one, 0)
    each(one, 0)
    each(one, 1)
    assert [r["dedupe_key"] for r in log.all().collect()] == ["trade:sec:F1"]


def test_cluster_rule_meets_late_filings_and_stays_quiet_for_the_window(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "alerts"), jobs.ALERT_SCHEMA)
    schema = trades(spark, []).schema
    history = BatchLog(spark, str(tmp_path / "history"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), jobs.TRADE_MONTH)
    each = jobs.cluster_writer(log, history, 7, 2)
    each(trades(spark, [("a", "F1", "i", ["p"], date(2024, 1, 2), datetime(2024, 1, 3), "P")]), 0)
    assert log.all().count() == 0
    each(trades(spark, [("b", "F2", "i", ["q"], date(2024, 1, 4), datetime(2024, 1, 5), "P")]), 1)
    each(trades(spark, [("c", "F3", "i", ["r"], date(2024, 1, 5), datetime(2024, 1, 6), "P")]), 2)
    assert [(r["issuer_id"], r["rows"], float(r["amount"])) for r in log.all().collect()] == [("i", 2, 14.0)]
    each(trades(spark, [("d", "F4", "j", ["r"], date(2021, 1, 5), datetime(2024, 1, 7), "P")]), 3)
    assert {r["month"] for r in history.all().collect()} == {"2021-01", "2024-01"}


def test_an_older_quote_never_replaces_a_newer_one(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "quotes"), jobs.QUOTE_SCHEMA)
    each = jobs.quote_writer(table)
    quote = lambda v, h: spark.createDataFrame([("A", v, datetime(2024, 1, 2, h), date(2024, 1, 2), datetime(2024, 1, 2, h), "LIVE")], jobs.QUOTE_SCHEMA)
    each(quote(2.0, 12), 0)
    each(quote(1.0, 10), 1)
    assert table.current().first()["value"] == 2.0
    each(quote(None, 13), 2)
    row = table.current().first()
    assert (row["value"], row["quote_status"]) == (2.0, "STALE")


def test_minute_digest_on_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 9, 0, s),) for s in range(6)] + [(datetime(2024, 1, 1, 9, 5, 0),), (datetime(2024, 1, 1, 12, 0, 0),)]
    spark.createDataFrame(rows, "at timestamp").coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.minute_counts(jobs.landed(spark, str(tmp_path / "in"), "at timestamp"), "at", "10 minutes")
    query = stream.writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["minute"]: (r["alerts"], r["message"]) for r in spark.table("minutes").collect()}
    assert got[datetime(2024, 1, 1, 9, 0)] == (6, "digest") and got[datetime(2024, 1, 1, 9, 5)] == (1, "single")
