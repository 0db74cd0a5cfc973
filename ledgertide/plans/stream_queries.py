"""Streaming queries: real streams over files landed from the tables page by page, and batch twins of the alert rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgertide.plans import proxies as px
from ledgertide.plans.insider_queries import OVERVIEW, money, priced, shown
from ledgertide.plans.registry import query
from ledgertide.plans.source_queries import shared_folder
from ledgertide.session import checkpoint, release
from ledgertide.streaming import alerts, jobs
from ledgertide.streaming.tables import BucketLog, BucketSnapshot, move

START = "1997-01-01 00:00:00"
LANDED_TRADE = ("id string, accession string, issuer_id string, owner_ids array<string>, code string, form string, is_ceo boolean, is_cfo boolean, counted decimal(38,12), "
                "transaction_date date, accepted_at timestamp, received_at timestamp")
#: Parts in which rows are made and written that would shuffle much at once.
SLICES = 4


def play(spark, rows, clock, schema, job, pages=3, beats=None, slices=None):
    """Land ``rows`` page by page in the order of ``clock`` (or by the pages it names) and start ``job(stream, checkpoint)`` anew after each: every page is a restart.

    ``beats`` are rows landed last, which only move the clock. With a column in ``slices``, the pages are written in parts by its hash, one after the other,
    so that the shuffles of a part are on disk and not those of all rows.
    """
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    page = F.col("_page")
    if "_page" not in rows.columns:
        cuts = rows.agg(F.percentile_approx(F.unix_micros(clock), [k / pages for k in range(1, pages)])).first()[0] or []
        release(spark)
        page = sum((F.when(F.unix_micros(clock) > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(schema).fields]
    # each row is written once; a page then lands by moving its files
    for part in [F.pmod(F.xxhash64(slices), F.lit(SLICES)) == k for k in range(SLICES)] if slices else [F.lit(True)]:
        rows.where(part).select(*typed, page.alias("_page")).write.mode("append").partitionBy("_page").option("compression", "zstd").parquet(f"{path}/pages")
        release(spark)
    for k in range(pages if beats is None else pages + 1):
        if k == pages:
            beats.select(*typed).write.mode("append").parquet(f"{path}/in")
        elif not move(spark, f"{path}/pages/_page={k}", f"{path}/in", f"part-{k}-"):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/in")
        job(jobs.landed(spark, f"{path}/in", schema, 100_000, "parquet"), f"{path}/state").awaitTermination()
        release(spark)
    return path


def played(spark, rows, clock, schema, stream, out, most=None, **options):
    """The rows that ``stream(landed)``, in ``most`` partitions at most, appends to its files while the pages are played."""
    target = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    play(spark, rows, clock, schema, lambda landed, state: jobs.append(stream(landed), target, state, most=most), **options)
    return spark.read.schema(out).parquet(target)


def landed_trades(rows):
    """The columns of LANDED_TRADE and the page, if the rows name one."""
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in DataType.fromDDL(LANDED_TRADE).fields], *[c for c in ("_page",) if c in rows.columns])


@query("stream_filings", "SELECT 'A' || lpad(CAST(event_id // 3 AS VARCHAR), 10, '0') AS accession FROM events GROUP BY 1")
def stream_filings(spark, sf):
    ev = px.table(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    rows = ev.select(F.concat(F.lit("A"), px.pad(F.floor(F.col("event_id") / 3))).alias("accession"), F.lit("4").alias("form"), px.pad(F.col("user_id")).alias("issuer_id"),
                     F.col("event_type").alias("role"), at.alias("accepted_at"), at.alias("received_at"))
    # the poll after the last one lands the first day again, whose scan was broken off
    first = rows.agg(F.min("accepted_at").alias("first"), F.max("accepted_at").alias("last"))
    again = rows.join(F.broadcast(first)).where("accepted_at < first + INTERVAL 1 DAY").withColumn("received_at", F.expr("last + INTERVAL 1 HOUR")).drop("first", "last")
    log = BucketLog(spark, f"{shared_folder(spark)}/filings-{uuid.uuid4().hex}", jobs.FILING_SCHEMA, "accession", 16, 2)
    play(spark, rows, "received_at", f"{jobs.FILING_SCHEMA}, received_at timestamp", lambda landed, state: jobs.filing_log(landed, log, state), beats=again)
    return px.present(log.read().select("accession"))


@query("stream_quotes_latest", """
WITH q AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, last(value ORDER BY ts, event_id) AS value, max(date_trunc('second', ts)) AS source_time FROM events GROUP BY 1)
SELECT symbol, round(value, 6) AS value, strftime(source_time, '%Y-%m-%d %H:%M:%S') AS source_time, 'LIVE' AS quote_status FROM q""")
def stream_quotes_latest(spark, sf):
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    best = F.struct("ts", "event_id")
    # One answer per symbol and second, as a provider gives it.
    rows = px.table(spark, sf, "events").groupBy(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), at.alias("source_time")).agg(
        F.max_by("value", best).alias("value")).select("symbol", "value", "source_time", F.to_date("source_time").alias("as_of"), F.col("source_time").alias("fetched_at"), F.lit("LIVE").alias("quote_status"))
    table = BucketSnapshot(spark, f"{shared_folder(spark)}/quotes-{uuid.uuid4().hex}", jobs.QUOTE_SCHEMA, "symbol", 16)
    play(spark, rows, "fetched_at", jobs.QUOTE_SCHEMA, lambda landed, state: jobs.quote_table(landed, table, state))
    return px.present(table.read().select("symbol", "value", "source_time", "quote_status"))


ALERTS = px.with_ctes(px.TRADES, px.FOLLOWED) + f"""
, r AS (SELECT * FROM tr WHERE status = 'CURRENT' AND code IN ('P', 'S') AND table_no = 'I' AND visible AND accepted_at >= TIMESTAMP '{START}'),
o AS (SELECT accession, o, greatest(followed_at, TIMESTAMP '{START}') AS since FROM (SELECT accession, accepted_at, unnest(owner_ids) AS o FROM r) JOIN fol ON o = person_id WHERE accepted_at >= greatest(followed_at, TIMESTAMP '{START}')),
c AS (SELECT accession, first(o ORDER BY since, o) AS person_id FROM o GROUP BY 1)
"""


@query("stream_trade_alerts", ALERTS + f"""
SELECT 'trade:sec:' || accession AS dedupe_key, person_id, count(*) AS rows, count(*) FILTER (WHERE code = 'P') AS buys, count(*) FILTER (WHERE code = 'S') AS sells, {money('sum(price * shares)')} AS amount,
  CASE WHEN count(*) FILTER (WHERE code = 'S') > 0 THEN CASE WHEN bool_and(is_plan) FILTER (WHERE code = 'S') THEN 'yes' WHEN bool_or(is_plan) FILTER (WHERE code = 'S') THEN 'partly' ELSE 'no' END END AS plan,
  strftime(min(td), '%Y-%m-%d') AS traded_from FROM r JOIN c USING (accession) GROUP BY accession, person_id""")
def stream_trade_alerts(spark, sf):
    trade = F.struct("id", "code", "table_no", "status", "visible", "accepted_at", "transaction_date", F.col("amount").cast("decimal(38,12)").alias("amount"), "is_plan", "owner_ids")
    filings = px.trades(spark, sf, by_filing=True).groupBy("accession").agg(F.min("issuer_id").alias("issuer_id"), F.max("accepted_at").alias("received_at"), F.collect_list(trade).alias("trades"))
    followed = checkpoint(px.followed(spark, sf))
    rows = played(spark, filings, "received_at", alerts.FILING_SCHEMA, lambda landed: alerts.trade_alert_stream(landed, followed, START, lookback=None), alerts.TRADE_ALERT_SCHEMA,
                  most=alerts.BUCKETS, slices="accession")
    return shown(rows.select("dedupe_key", "person_id", "rows", "buys", "sells", "amount", "plan", "traded_from"), "amount")


@query("stream_report_alerts", px.with_ctes(px.DISCLOSED, px.REPORTS, px.FOLLOWED) + f"""
SELECT 'trade:report:' || report_id AS dedupe_key, person_id, count(*) AS rows, count(*) FILTER (WHERE transaction_type = 'purchase') AS buys, {money('sum(amount_low)')} AS amount
FROM rep JOIN fol USING (person_id) JOIN dt USING (report_id) WHERE report_status IN ('parsed', 'review') AND amendment_status <> 'unresolved' AND pages_done >= page_count AND discovered_at >= TIMESTAMP '{START}' AND discovered_at >= followed_at
  AND coalesce(report_date, filed_date) >= DATE '1996-12-25' AND transaction_type IN ('purchase', 'sale', 'partial_sale') GROUP BY report_id, person_id""")
def stream_report_alerts(spark, sf):
    rows = jobs.report_alerts(px.disclosure_trades(spark, sf), px.disclosure_reports(spark, sf), px.followed(spark, sf), START)
    return shown(rows.select("dedupe_key", "person_id", "rows", "buys", "amount"), "amount")


EXECUTIVE = OVERVIEW + "," + px.CONSTITUENTS.strip() + f"""
, sc AS (SELECT * FROM pr WHERE issuer_id IN (SELECT cik FROM con WHERE index_name = 'sp500' AND cik IS NOT NULL) OR EXISTS (SELECT 1 FROM con WHERE index_name = 'sp500'
    AND list_contains(list_transform(string_split_regex(issuer_ticker || coalesce(' ' || filing_ticker, ''), '[,;\\s]+'), lambda x: replace(upper(x), '.', '-')), ticker)))
"""


@query("rule_executive", EXECUTIVE + f"""
SELECT 'rule_executive:' || accession AS dedupe_key, count(*) AS rows, {money('sum(counted)')} AS amount, strftime(min(td), '%Y-%m-%d') AS traded_from FROM sc WHERE code = 'P' AND form <> '4/A' AND (is_ceo OR is_cfo) AND accepted_at >= TIMESTAMP '1998-01-01'
GROUP BY accession HAVING sum(counted) >= 20000""")
def rule_executive(spark, sf):
    members = px.constituents(spark, sf).where("index_name = 'sp500'")
    rows = jobs.in_scope(checkpoint(priced(spark, sf)), members, None)
    found = jobs.executive_alerts(rows, F.col("accepted_at") >= F.lit("1998-01-01 00:00:00").cast("timestamp"), 20000)
    return shown(found.select("dedupe_key", "rows", "amount", "traded_from"), "amount")


@query("stream_rule_executive", EXECUTIVE + f"""
, pg AS (SELECT accession, CASE WHEN l_linenumber <= 2 THEN 0 ELSE 1 END AS page, sum(counted) AS s, count(*) AS n, min(td) AS d FROM sc
  WHERE code = 'P' AND form <> '4/A' AND (is_ceo OR is_cfo) AND accepted_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2),
su AS (SELECT accession, page, sum(s) OVER w AS s, sum(n) OVER w AS n, min(d) OVER w AS d FROM pg WINDOW w AS (PARTITION BY accession ORDER BY page)),
al AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY page) AS k FROM su WHERE s >= 20000)
SELECT 'rule_executive:' || accession AS dedupe_key, CAST(n AS BIGINT) AS rows, {money('s')} AS amount, strftime(d, '%Y-%m-%d') AS traded_from FROM al WHERE k = 1""")
def stream_rule_executive(spark, sf):
    """Filings land in two pages, the first two lines of each an hour before the rest."""
    members = px.constituents(spark, sf).where("index_name = 'sp500'")
    page = F.when(F.split("id", "-")[1].cast("int") <= 2, 0).otherwise(1)
    rows = jobs.in_scope(checkpoint(priced(spark, sf)), members, None).withColumn("_page", page).withColumn("received_at", F.lit("2002-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=page))
    found = played(spark, landed_trades(rows), "received_at", LANDED_TRADE, lambda landed: alerts.executive_stream(landed, 20000, "1998-01-01 00:00:00"), alerts.EXECUTIVE_SCHEMA, pages=2)
    return shown(found.select("dedupe_key", "rows", "amount", "traded_from"), "amount")


@query("rule_cluster", OVERVIEW + f"""
, b AS (SELECT * FROM pr WHERE code = 'P'), so AS (SELECT issuer_id, td, unnest(owner_ids) AS o FROM b), en AS (SELECT DISTINCT issuer_id, td AS e FROM b),
q AS (SELECT en.issuer_id, e, count(DISTINCT o) AS n FROM en JOIN so ON so.issuer_id = en.issuer_id AND so.td BETWEEN e - 9 AND e GROUP BY 1, 2), wi AS (SELECT issuer_id, max(e) AS e FROM q WHERE n >= 3 GROUP BY 1),
cl AS (SELECT b.*, accepted_at >= TIMESTAMP '2000-01-01' AND form <> '4/A' AS fresh FROM b JOIN wi USING (issuer_id) WHERE td BETWEEN e - 9 AND e)
SELECT 'rule_cluster:' || issuer_id || ':' || strftime(min(td), '%Y-%m-%d') AS dedupe_key, count(*) AS rows, (SELECT count(DISTINCT o) FROM (SELECT unnest(owner_ids) AS o FROM cl c2 WHERE c2.issuer_id = cl.issuer_id)) AS people, {money('sum(counted)')} AS amount,
  strftime(max(accepted_at) FILTER (WHERE fresh), '%Y-%m-%d %H:%M:%S') AS at FROM cl GROUP BY issuer_id HAVING bool_or(fresh)""")
def rule_cluster(spark, sf):
    rows = checkpoint(priced(spark, sf).where("code = 'P'"))
    found = jobs.cluster_alerts(rows, F.col("accepted_at") >= F.lit("2000-01-01 00:00:00").cast("timestamp"), 10, 3)
    return shown(found.select("dedupe_key", "rows", "people", "amount", "at"), "amount")


@query("stream_rule_cluster", OVERVIEW.replace("WITH", "WITH RECURSIVE", 1) + f"""
, b AS (SELECT issuer_id, td, owner_ids, counted, accepted_at, form <> '4/A' AS fresh FROM pr WHERE code = 'P'),
ev AS (SELECT DISTINCT issuer_id, accepted_at AS a FROM b WHERE fresh),
kn AS (SELECT b.*, a FROM ev JOIN b USING (issuer_id) WHERE accepted_at <= a AND td >= CAST(a AS DATE) - 90),
ow AS (SELECT DISTINCT issuer_id, a, td, unnest(owner_ids) AS o FROM kn), en AS (SELECT DISTINCT issuer_id, a, td AS e FROM kn),
q AS (SELECT en.issuer_id, en.a, e FROM en JOIN ow ON ow.issuer_id = en.issuer_id AND ow.a = en.a AND ow.td BETWEEN e - 9 AND e GROUP BY 1, 2, 3 HAVING count(DISTINCT o) >= 2),
wi AS (SELECT issuer_id, a, max(e) AS e FROM q GROUP BY 1, 2),
ca AS (SELECT kn.issuer_id, kn.a, min(td) AS first, count(*) AS rows, sum(counted) AS amount FROM kn JOIN wi USING (issuer_id, a) WHERE td BETWEEN e - 9 AND e GROUP BY 1, 2 HAVING bool_or(fresh AND accepted_at = a)),
pe AS (SELECT ow.issuer_id, ow.a, count(DISTINCT o) AS people FROM ow JOIN wi USING (issuer_id, a) WHERE td BETWEEN e - 9 AND e GROUP BY 1, 2),
nu AS (SELECT *, 'rule_cluster:' || issuer_id || ':' || strftime(first, '%Y-%m-%d') AS dedupe_key FROM ca JOIN pe USING (issuer_id, a)),
al AS (SELECT * EXCLUDE k FROM (SELECT *, [dedupe_key] AS sent, row_number() OVER (PARTITION BY issuer_id ORDER BY a) AS k FROM nu) WHERE k = 1
  UNION ALL SELECT * EXCLUDE k FROM (SELECT nu.*, list_append(al.sent, nu.dedupe_key) AS sent, row_number() OVER (PARTITION BY nu.issuer_id ORDER BY nu.a) AS k
    FROM al JOIN nu ON nu.issuer_id = al.issuer_id AND nu.a > al.a + INTERVAL 10 DAY AND NOT list_contains(al.sent, nu.dedupe_key)) WHERE k = 1)
SELECT dedupe_key, rows, people, {money('amount')} AS amount, strftime(a, '%Y-%m-%d %H:%M:%S') AS at FROM al""")
def stream_rule_cluster(spark, sf):
    rows = priced(spark, sf).where("code = 'P'").withColumn("received_at", F.col("accepted_at"))
    found = played(spark, landed_trades(rows), "received_at", LANDED_TRADE, lambda landed: alerts.cluster_stream(landed, 10, 2), alerts.CLUSTER_SCHEMA)
    return shown(found.select("dedupe_key", "rows", "people", "amount", "at"), "amount")


@query("digest_minutes", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS alerts, CASE WHEN count(*) > 5 THEN 'digest' ELSE 'single' END AS message FROM events GROUP BY date_trunc('minute', ts)""")
def digest_minutes(spark, sf):
    at = F.col("ts").cast("timestamp")
    rows = px.table(spark, sf, "events").select(at.alias("at"), at.alias("received_at"), F.lit(False).alias("beat"))
    beat = rows.agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at")).select("at", F.col("at").alias("received_at"), F.lit(True).alias("beat"))
    found = played(spark, rows, "received_at", "at timestamp, received_at timestamp, beat boolean", alerts.minute_digests, "minute timestamp, alerts long, message string", beats=beat)
    return px.present(found)


@query("arrival_gaps", px.with_ctes(px.TRADES) + """
, h AS (SELECT DISTINCT date_trunc('hour', accepted_at) AS h FROM tr), n AS (SELECT h, lead(h) OVER (ORDER BY h) AS nh FROM h)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS gap_after, strftime(nh, '%Y-%m-%d %H:%M:%S') AS gap_before FROM n WHERE epoch(nh) - epoch(h) > 4 * 3600""")
def arrival_gaps(spark, sf):
    return px.present(jobs.arrival_gaps(px.trades(spark, sf), 4))
