"""Streaming jobs: filing discovery, latest quotes, alerts, cluster rule and minute digests.

Each job is a DataFrame function that also works on a bounded table, and a runner that applies it to
micro-batches through ``foreachBatch``. Checkpoints replace leases and poll watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgertide.functions import text as T
from ledgertide.operators import overview as ovw
from ledgertide.operators import trades as trd
from ledgertide.operators.timeline import active_reports
from ledgertide.operators.versions import insert_once, latest_per_key
from ledgertide.sources.market import merge_quotes
from ledgertide.streaming.tables import BatchLog, BucketLog, BucketSnapshot, Snapshot

# Fixed values of the alert rules.
LOOKBACK_DAYS, RULE_TRADE_DAYS, REPORT_SLACK_DAYS, DIGEST_OVER = 30, 90, 7, 5
FILING_SCHEMA = "accession string, form string, issuer_id string, role string, accepted_at timestamp"


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True, most: int | None = None) -> StreamingQuery:
    """Write a stream to Parquet files, each row exactly once.

    With ``most``, a new stream gets so many partitions at most, where the session has more. Each partition of a state is a store of its own, which takes megabytes
    of disk however little it holds.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    if most is None or int(before := conf.get(name)) <= most:
        return writer.start()
    conf.set(name, str(most))
    try:
        return writer.start()  # a started stream has settings of its own
    finally:
        conf.set(name, before)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# --- discovery --------------------------------------------------------------------


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000, form: str = "json") -> DataFrame:
    """A stream over files that pollers land in a folder, as JSON or in another format Spark reads."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def filing_writer(log: BatchLog) -> Callable[[DataFrame, int], None]:
    """Each accession once, however late it arrives.

    A catch-up of an interrupted scan lands older pages after newer ones; a watermark would drop them,
    so the stored log decides what is new.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        log.write(batch_id, insert_once(log.before(batch_id), batch, "accession", ["accepted_at", "role"]))
    return each


def new_filings(entries: DataFrame, delay: str = "30 days") -> DataFrame:
    """Feed entries without those that polls landed again within ``delay``: most of every poll, kept from the log by bounded state.

    The clock is ``received_at``, when a poll landed the entry, so pages of old filings that fill a gap are not late.
    """
    return entries.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["accession", "role"])


def filing_log(entries: DataFrame, log: BucketLog, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Each accession once, however late it arrives: recent repeats end in state, older ones in the touched buckets of the log."""
    def each(batch: DataFrame, batch_id: int) -> None:
        log.insert(batch_id, batch, ["accepted_at", "role"])
    return run(new_filings(entries, delay), each, checkpoint)


def arrival_gaps(entries: DataFrame, hours: int) -> DataFrame:
    """Quiet spans longer than ``hours`` in the received hours: the polls to catch up on.

    Works on distinct hours, so it is bounded by time and not by the number of filings.
    """
    from pyspark.sql import Window

    seen = entries.select(F.date_trunc("hour", "accepted_at").alias("hour")).distinct().withColumn("feed", F.lit("filings"))
    w = Window.partitionBy("feed").orderBy("hour")
    spans = seen.withColumn("next_hour", F.lead("hour").over(w))
    quiet = (F.unix_timestamp("next_hour") - F.unix_timestamp("hour")) / 3600
    return spans.where(quiet > hours).select(F.col("hour").alias("gap_after"), F.col("next_hour").alias("gap_before"))


# --- quotes -----------------------------------------------------------------------

QUOTE_SCHEMA = "symbol string, value double, source_time timestamp, as_of date, fetched_at timestamp, quote_status string"


def quote_writer(table: Snapshot) -> Callable[[DataFrame, int], None]:
    """Keeps the newest observation per symbol; answers of one batch are reduced map-side first."""
    def each(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(batch, ["symbol"], ["source_time", "fetched_at"])
        table.write(batch_id, merge_quotes(table.current(batch_id), newest))
    return each


def quote_table(stream: DataFrame, table: BucketSnapshot, checkpoint: str) -> StreamingQuery:
    """Latest quotes; a batch reads and rewrites the buckets of its own symbols."""
    def each(batch: DataFrame, batch_id: int) -> None:
        table.update(batch_id, latest_per_key(batch, ["symbol"], ["source_time", "fetched_at"]), merge_quotes)
    return run(stream, each, checkpoint)


# --- alerts -----------------------------------------------------------------------

ALERT_SCHEMA = "dedupe_key string, kind string, person_id string, issuer_id string, rows bigint, amount decimal(38,2), traded_from date, traded_to date, at timestamp"


def trade_alerts(trades: DataFrame, followed: DataFrame, start: str, at: str | None = None, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """One alert per filing of a followed person: accepted after alerts began and after the person was followed.

    The filer followed longest speaks for a joint filing.
    """
    floor = F.lit(start).cast("timestamp")
    if at is not None:
        floor = F.greatest(floor, F.lit(at).cast("timestamp") - F.make_dt_interval(days=F.lit(lookback)))
    rows = trades.where((F.col("status") == "CURRENT") & F.col("code").isin("P", "S") & (F.col("table_no") == "I") & F.col("visible") & (F.col("accepted_at") >= floor))
    since = followed.select(F.col("person_id").alias("owner_id"), F.greatest(F.col("followed_at"), F.lit(start).cast("timestamp")).alias("_since"))
    owners = rows.select("accession", "accepted_at", F.explode("owner_ids").alias("owner_id")).distinct().join(since, "owner_id").where("accepted_at >= _since")
    chosen = owners.groupBy("accession").agg(F.min_by("owner_id", F.struct("_since", "owner_id")).alias("person_id"))
    sale = F.col("code") == "S"
    facts = rows.groupBy("accession").agg(
        F.count("*").alias("rows"), F.count_if(~sale).alias("buys"), F.count_if(sale).alias("sells"), F.sum("amount").cast("decimal(38,2)").alias("amount"),
        F.bool_and(F.when(sale, F.col("is_plan"))).alias("_all"), F.bool_or(F.when(sale, F.col("is_plan"))).alias("_any"),
        F.min("transaction_date").alias("traded_from"), F.max("transaction_date").alias("traded_to"), F.min("issuer_id").alias("issuer_id"), F.max("accepted_at").alias("at"))
    plan = F.when(F.col("sells") > 0, F.when(F.col("_all"), "yes").when(F.col("_any"), "partly").otherwise("no"))
    return facts.join(chosen, "accession").select(
        F.concat(F.lit("trade:sec:"), "accession").alias("dedupe_key"), F.lit("trade").alias("kind"), "person_id", "issuer_id", "rows", "buys", "sells", "amount",
        plan.alias("plan"), "traded_from", "traded_to", "at")


def report_alerts(rows: DataFrame, reports: DataFrame, followed: DataFrame, start: str) -> DataFrame:
    """One alert per fully read, active report of a followed official that holds trades.

    Its publication day may lie at most a week before alerts began.
    """
    began = F.lit(start).cast("timestamp")
    slack = F.date_sub(F.to_date(began), REPORT_SLACK_DAYS)
    ready = active_reports(reports).where(
        F.col("report_status").isin("parsed", "review") & (F.col("page_count") > 0) & (F.col("pages_done") >= F.col("page_count"))
        & (F.col("discovered_at") >= began) & (F.coalesce("report_date", "filed_date") >= slack))
    ready = ready.join(followed, "person_id").where("discovered_at >= followed_at")
    buy, sell = F.col("transaction_type") == "purchase", F.col("transaction_type").isin("sale", "partial_sale")
    facts = rows.where(buy | sell).groupBy("report_id").agg(
        F.count("*").alias("rows"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.sum("amount_low").cast("decimal(38,2)").alias("amount"),
        F.min("transaction_date").alias("traded_from"), F.max("transaction_date").alias("traded_to"))
    return ready.join(facts, "report_id").select(
        F.concat(F.lit("trade:report:"), "report_id").alias("dedupe_key"), F.lit("trade").alias("kind"), "person_id", F.lit(None).cast("string").alias("issuer_id"),
        "rows", "buys", "sells", "amount", F.lit(None).cast("string").alias("plan"), "traded_from", "traded_to", F.col("discovered_at").alias("at"))


def in_scope(rows: DataFrame, members: DataFrame | None, codes: DataFrame | None) -> DataFrame:
    """Rows of index members (by CIK or any stated code) or of watched codes; everything without a scope."""
    if members is None:
        return rows
    ciks = members.where("cik IS NOT NULL").select(F.col("cik").alias("issuer_id")).distinct()
    wanted = members.select(T.ticker_key(F.col("ticker")).alias("ticker_code"))
    if codes is not None:
        wanted = wanted.unionByName(codes.select("ticker_code"))
    first = rows.join(ciks, "issuer_id", "left_semi")
    rest = rows.join(ciks, "issuer_id", "left_anti")
    named = trd.join_ticker_classes(rest.select("id", "issuer_ticker", "filing_ticker"), wanted, "issuer_ticker", "filing_ticker").select("id").distinct()
    return first.unionByName(rest.join(named, "id", "left_semi"))


def executive_alerts(priced: DataFrame, fresh: Column, minimum: float) -> DataFrame:
    """Filings where a CEO or CFO bought at least the threshold (mismatched prices do not count)."""
    rows = priced.where(fresh & (F.col("code") == "P") & ~F.col("form").endswith("/A") & (F.col("is_ceo") | F.col("is_cfo")))
    sums = rows.groupBy("accession").agg(
        F.sum("counted").alias("amount"), F.count("*").alias("rows"), F.min("issuer_id").alias("issuer_id"), F.min("transaction_date").alias("traded_from"),
        F.max("transaction_date").alias("traded_to"), F.max("accepted_at").alias("at"), F.min(F.element_at("owner_ids", 1)).alias("person_id"))
    return sums.where(F.col("amount") >= minimum).select(
        F.concat(F.lit("rule_executive:"), "accession").alias("dedupe_key"), F.lit("rule_executive").alias("kind"), "person_id", "issuer_id", "rows", F.col("amount").cast("decimal(38,2)").alias("amount"),
        "traded_from", "traded_to", "at")


def cluster_alerts(rows: DataFrame, fresh: Column, days: int, people: int) -> DataFrame:
    """Issuers whose newest window with enough buyers holds a fresh, unamended purchase.

    ``rows`` carry ``counted``: the amount is that of the counted trades (mismatched prices left out, estimates in), and
    ``people`` are the distinct owners of the window.
    """
    buys = rows.where(F.col("code") == "P")
    clustered = ovw.cluster_trades(buys, days, people)
    is_fresh = fresh & ~F.col("form").endswith("/A")
    facts = clustered.groupBy("issuer_id").agg(
        F.count("*").alias("rows"), F.bool_or(is_fresh).alias("_fresh"), F.sum("counted").cast("decimal(38,2)").alias("amount"), F.min("transaction_date").alias("traded_from"),
        F.max("transaction_date").alias("traded_to"), F.max(F.when(is_fresh, F.col("accepted_at"))).alias("at")).where("_fresh")
    owners = clustered.select("issuer_id", F.explode("owner_ids").alias("owner_id")).distinct().groupBy("issuer_id").agg(F.count("*").alias("people"))
    return facts.join(owners, "issuer_id").select(F.concat_ws(":", F.lit("rule_cluster"), "issuer_id", F.col("traded_from").cast("string")).alias("dedupe_key"), F.lit("rule_cluster").alias("kind"),
                        F.lit(None).cast("string").alias("person_id"), "issuer_id", "rows", "people", "amount", "traded_from", "traded_to", "at")


def suppress_repeats(alerts: DataFrame, sent: DataFrame, days: int) -> DataFrame:
    """Cluster alerts of issuers without one in the last ``days`` days."""
    recent = sent.where("kind = 'rule_cluster'").groupBy("issuer_id").agg(F.max("at").alias("_last"))
    kept = alerts.join(recent, "issuer_id", "left")
    return kept.where(F.col("_last").isNull() | (F.col("_last") < F.col("at") - F.make_dt_interval(days=F.lit(days)))).select(*alerts.columns)


def alert_writer(log: BatchLog, followed: DataFrame, start: str) -> Callable[[DataFrame, int], None]:
    """Stream-static join of landed trades with the followed people, each filing alerted once."""
    def each(batch: DataFrame, batch_id: int) -> None:
        found = trade_alerts(batch, followed, start)
        log.write(batch_id, insert_once(log.before(batch_id), found.select("dedupe_key", "kind", "person_id", "issuer_id", "rows", "amount", "traded_from", "traded_to", "at"), "dedupe_key", ["at"]))
    return each


TRADE_MONTH = ("month", "date_format(transaction_date, 'yyyy-MM')")


def cluster_writer(log: BatchLog, history: BatchLog, days: int, people: int) -> Callable[[DataFrame, int], None]:
    """Cluster rule over the last 90 trade days: late filings meet the trades kept in ``history``.

    A history log with a ``month`` of the trade date (``BatchLog(..., by=TRADE_MONTH)``) reads the last months only.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        history.write(batch_id, batch)
        known = history.all().where(F.col("batch") <= batch_id)
        newest = batch.agg(F.max(F.to_date("accepted_at"))).scalar()
        first = F.date_sub(newest, RULE_TRADE_DAYS)
        window = known.where(F.col("transaction_date") >= first)
        if "month" in known.columns:
            window = window.where(F.col("month") >= F.date_format(first, "yyyy-MM"))
        alerts = suppress_repeats(cluster_alerts(window, F.col("batch") == batch_id, days, people), log.before(batch_id), days)
        log.write(batch_id, insert_once(log.before(batch_id), alerts, "dedupe_key", ["at"]))
    return each


# --- digests ----------------------------------------------------------------------


def minute_counts(alerts: DataFrame, stamp: str = "at", delay: str | None = None) -> DataFrame:
    """Alerts per minute with what to send: each on its own, or one digest above the limit."""
    rows = alerts if delay is None else alerts.withWatermark(stamp, delay)
    counted = rows.groupBy(F.window(stamp, "1 minute").alias("w")).agg(F.count("*").alias("alerts"))
    return counted.select(F.col("w.start").alias("minute"), "alerts", F.when(F.col("alerts") > DIGEST_OVER, "digest").otherwise("single").alias("message"))
