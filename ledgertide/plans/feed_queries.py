"""Feed, version, amendment, entity and keyed-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.operators import versions as ver
from ledgertide.plans import proxies as px
from ledgertide.plans.calendar_queries import local_of
from ledgertide.plans.insider_queries import money, shown
from ledgertide.plans.registry import query
from ledgertide.session import checkpoint

SPLIT = "1999-01-01 00:00:00"


def corrected(spark, sf):
    """Trades where every second amendment form replaced a filing accepted ten days earlier."""
    trades = px.trades(spark, sf)
    key = F.split_part("id", F.lit("-"), F.lit(1)).cast("long")
    fixed = (F.col("form") == "4/A") & (key % 2 == 0)
    return trades.withColumn("original_accepted_at", F.when(fixed, F.col("accepted_at") - F.expr("INTERVAL 10 DAYS"))).withColumn(
        "original_accession", F.when(fixed, F.concat(F.lit("A"), px.pad(key - 1))))


FEED = px.with_ctes(px.TRADES) + f"""
, co AS (SELECT *, CASE WHEN form = '4/A' AND o_orderkey % 2 = 0 THEN accepted_at - INTERVAL 10 DAY END AS oa, CASE WHEN form = '4/A' AND o_orderkey % 2 = 0 THEN 'A' || lpad(CAST(o_orderkey - 1 AS VARCHAR), 10, '0') END AS oacc
  FROM tr WHERE status IN ('CURRENT', 'NEEDS_REVIEW') AND visible),
f0 AS (SELECT *, coalesce(oa, accepted_at) AS ga, CAST({local_of("coalesce(oa, accepted_at)")} AS DATE) AS gd, coalesce(oacc, accession) AS gacc, FALSE AS upd FROM co
  UNION ALL SELECT *, accepted_at, CAST({local_of("accepted_at")} AS DATE), accession, TRUE FROM co WHERE status = 'CURRENT' AND oa IS NOT NULL AND CAST({local_of("oa")} AS DATE) < ad),
fr AS (SELECT *, left(sha256(issuer_id || ':' || CAST(gd AS VARCHAR)), 32) AS gk, CASE WHEN td <= ad THEN td END AS sd FROM f0)
"""
KINDS_SQL = """concat_ws(',', 'all', CASE WHEN bool_or(table_no = 'I' AND code IN ('P', 'S')) THEN 'focus' END, CASE WHEN bool_or(table_no = 'I' AND code = 'P') THEN 'buy' END,
  CASE WHEN bool_or(table_no = 'I' AND code = 'S') THEN 'sell' END, CASE WHEN bool_or(table_no = 'II') THEN 'derivative' END, CASE WHEN bool_or(table_no <> 'II' AND code NOT IN ('P', 'S')) THEN 'other' END)"""


@query("feed_groups", FEED + f"""
, g AS (SELECT gk, issuer_id, strftime(max(ga), '%Y-%m-%d %H:%M:%S') AS accepted_at, strftime(min(sd) FILTER (WHERE NOT upd), '%Y-%m-%d') AS first_date, strftime(max(sd) FILTER (WHERE NOT upd), '%Y-%m-%d') AS last_date,
    count(*) FILTER (WHERE NOT upd) AS total_transactions, count(*) FILTER (WHERE upd) AS amendment_updates, {money("sum(price * shares) FILTER (WHERE NOT upd AND status = 'CURRENT')")} AS known_amount,
    {KINDS_SQL} AS match_kinds, strftime(max(sd) FILTER (WHERE table_no = 'I' AND code = 'P'), '%Y-%m-%d') AS sort_buy, count(DISTINCT gacc) FILTER (WHERE NOT upd) AS filings FROM fr GROUP BY 1, 2),
o AS (SELECT gk, count(DISTINCT o) AS owners FROM (SELECT gk, unnest(owner_ids) AS o FROM fr) GROUP BY 1)
SELECT gk AS group_key, issuer_id, accepted_at, first_date, last_date, total_transactions, amendment_updates, known_amount, match_kinds, sort_buy, filings, owners FROM g JOIN o USING (gk)""")
def feed_groups(spark, sf):
    groups = ver.feed_groups(ver.feed_rows(corrected(spark, sf)))
    rows = groups.withColumn("sort_buy", F.element_at("sort_dates", "buy"))
    return shown(rows.select("group_key", "issuer_id", "accepted_at", "first_date", "last_date", "total_transactions", "amendment_updates", "known_amount",
                             "match_kinds", "sort_buy", "filings", "owners"), "known_amount")


@query("late_amendments", FEED + """
SELECT strftime(gd, '%Y-%m-%d') AS group_day, count(*) AS updates, count(DISTINCT gk) AS groups FROM fr WHERE upd GROUP BY 1""")
def late_amendments(spark, sf):
    rows = ver.feed_rows(corrected(spark, sf)).where("is_update")
    per_group = rows.groupBy("group_day", "group_key").agg(F.count("*").alias("n"))
    return px.present(per_group.groupBy("group_day").agg(F.sum("n").alias("updates"), F.count("*").alias("groups")))


def revision_log(spark, sf):
    """Two commits: filings accepted before SPLIT, then everything, with one issuer in seven withdrawn and another's titles changed."""
    trades = corrected(spark, sf)
    first = ver.feed_contents(ver.feed_rows(trades.where(F.col("accepted_at") < SPLIT)))
    number = F.col("issuer_id").cast("long") % 7
    kept = trades.where(number != 3).withColumn("security_title", F.when(number == 2, F.concat("security_title", F.lit(" (new)"))).otherwise(F.col("security_title")))
    return ver.revised_log(first.withColumn("seq", F.lit(1)), ver.feed_contents(ver.feed_rows(kept)), 2)


REVISIONS = FEED + f"""
, h AS (SELECT gk, ga, id, upd, table_no, code, accepted_at < TIMESTAMP '{SPLIT}' AS early, CAST(issuer_id AS BIGINT) % 7 <> 3 AS kept, CAST(issuer_id AS BIGINT) % 7 = 2 AS titled FROM fr),
g1 AS (SELECT gk, max(ga) AS ga, count(*) AS n, bool_or(table_no = 'I' AND code = 'P') AS buy FROM h WHERE early GROUP BY 1), g2 AS (SELECT gk, max(ga) AS ga, count(*) AS n, bool_or(table_no = 'I' AND code = 'P') AS buy, bool_or(titled) AS titled FROM h WHERE kept GROUP BY 1),
rv AS (SELECT gk, ga, n, buy, 1 AS seq FROM g1 UNION ALL SELECT g2.gk, g2.ga, g2.n, g2.buy, 2 FROM g2 LEFT JOIN g1 ON g1.gk = g2.gk WHERE g1.gk IS NULL OR g1.n <> g2.n OR titled
  UNION ALL SELECT g1.gk, g1.ga, 0, FALSE, 2 FROM g1 ANTI JOIN g2 USING (gk))
"""


@query("feed_revisions", REVISIONS + "SELECT gk AS group_key, CAST(seq AS BIGINT) AS seq, CAST(n AS BIGINT) AS row_count FROM rv")
def feed_revisions(spark, sf):
    return px.present(revision_log(spark, sf).select("group_key", "seq", "row_count"))


@query("snapshot_asof", REVISIONS + """
SELECT gk AS group_key, CAST(seq AS BIGINT) AS seq, CAST(n AS BIGINT) AS row_count FROM rv QUALIFY row_number() OVER (PARTITION BY gk ORDER BY seq DESC) = 1""")
def snapshot_asof(spark, sf):
    return px.present(ver.snapshot_asof(revision_log(spark, sf), 2).select("group_key", "seq", "row_count"))


DIFF = REVISIONS + """
, s2 AS (SELECT * FROM rv QUALIFY row_number() OVER (PARTITION BY gk ORDER BY seq DESC) = 1),
a AS (SELECT gk, seq FROM rv WHERE seq = 1 AND buy), b AS (SELECT gk, seq FROM s2 WHERE buy AND n > 0),
df AS (SELECT coalesce(a.gk, b.gk) AS gk, CASE WHEN b.gk IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.gk = b.gk WHERE a.seq IS DISTINCT FROM b.seq)
"""


@query("diff_listing", DIFF + "SELECT gk AS group_key, change FROM df")
def diff_listing(spark, sf):
    return px.present(ver.diff_listing(revision_log(spark, sf), 1, 2, "buy").select("group_key", "change"))


@query("feed_delta", DIFF + "SELECT change, count(*) AS groups FROM df GROUP BY 1")
def feed_delta(spark, sf):
    return px.present(ver.feed_delta(revision_log(spark, sf), 1, 2, "buy"))


# --- keyed tables -----------------------------------------------------------------


@query("latest_per_key", "SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1")
def latest_per_key(spark, sf):
    rows = px.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return px.present(ver.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value"), exact=("value",))


@query("upsert_latest", """
WITH o AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY 1), n AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'view' AND user_id % 3 <> 0 GROUP BY 1)
SELECT user_id, max(event_id) AS event_id FROM (FROM o UNION ALL FROM n) GROUP BY 1""")
def upsert_latest(spark, sf):
    rows = px.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    stored = ver.latest_per_key(rows.where("event_type IN ('view', 'click')"), ["user_id"], ["ts", "event_id"])
    fresh = ver.latest_per_key(rows.where("event_type <> 'view' AND user_id % 3 <> 0"), ["user_id"], ["ts", "event_id"])
    return px.present(ver.upsert_latest(stored, fresh, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id"))


@query("insert_once", """
SELECT 'u' || user_id || '-' || CAST(ts AS DATE) AS dedupe_key, min(event_id) AS event_id FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 2 = 0) = 0""")
def insert_once(spark, sf):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    rows = px.table(spark, sf, "events").select(key.alias("dedupe_key"), "event_id", "event_type")
    stored = rows.where("event_type = 'purchase' AND event_id % 2 = 0").select("dedupe_key").distinct()
    return px.present(ver.insert_once(stored, rows.select("dedupe_key", "event_id"), "dedupe_key", ["event_id"]))


@query("replace_page_rows", px.with_ctes(px.DISCLOSED) + """
SELECT report_id, page, count(*) AS rows, count(*) FILTER (WHERE page = 3) AS reparsed FROM dt WHERE page <> 3 OR (page = 3 AND confidence = 'parsed') GROUP BY 1, 2""")
def replace_page_rows(spark, sf):
    rows = px.disclosure_trades(spark, sf).select("id", "report_id", "page", "confidence")
    stored = rows.withColumn("generation", F.lit(1))
    reparsed = rows.where("page = 3 AND confidence = 'parsed'").withColumn("generation", F.lit(2))
    touched = rows.where("page = 3").select("report_id", "page")
    merged = ver.replace_rows(stored, reparsed, ["report_id", "page"], touched)
    return px.present(merged.groupBy("report_id", "page").agg(F.count("*").alias("rows"), F.count_if(F.col("generation") == 2).alias("reparsed")))


@query("replace_members", px.with_ctes(px.CONSTITUENTS) + """
, kn AS (SELECT ticker, min(cik) AS cik FROM (SELECT 'T' || s_suppkey AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1)
SELECT index_name, c.ticker, coalesce(c.cik, kn.cik) AS cik FROM con c LEFT JOIN kn USING (ticker) WHERE index_name = 'sp500'
UNION ALL SELECT index_name, ticker, cik FROM con WHERE index_name = 'nasdaq100'""")
def replace_members(spark, sf):
    members = px.constituents(spark, sf).select("index_name", "ticker", "cik", "name")
    stored = members.withColumn("name", F.lit("old"))
    # The nasdaq100 download repeats a ticker, so the stored list is kept.
    broken = members.where("index_name = 'nasdaq100'")
    incoming = members.where("index_name = 'sp500'").unionByName(broken).unionByName(broken)
    known = px.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.format_string("T%d", "s_suppkey").alias("ticker"), px.pad(F.col("s_suppkey")).alias("cik"))
    return px.present(ver.replace_members(stored, incoming, known).select("index_name", "ticker", "cik"))


@query("reuse_result", """
SELECT n_name AS study, CAST(n_regionkey AS BIGINT) AS region, n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AS reused FROM nation""")
def reuse_result(spark, sf):
    nation = px.table(spark, sf, "nation").select(F.col("n_name").alias("study"), F.col("n_regionkey").alias("region"), "n_nationkey")
    keyed = ver.reuse_result(nation, nation.limit(0).select(F.lit("").alias("input_key"), F.lit(False).alias("expired")), ["study", "region"])
    saved = keyed.where("n_nationkey % 3 = 0").select("input_key", (F.col("n_nationkey") % 2 == 1).alias("expired"))
    return px.present(ver.reuse_result(nation, saved, ["study", "region"]).select("study", "region", "reused"))


@query("result_freshness", """
SELECT o_custkey AS result, strftime(min(CAST(o_orderdate AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS fetched_at, min(CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 900 AS INTEGER))) <= TIMESTAMP '2000-01-01' AS expired, count(*) AS inputs
FROM orders GROUP BY 1""")
def result_freshness(spark, sf):
    stamp = F.to_timestamp("o_orderdate")
    rows = px.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("result"), stamp.alias("fetched_at"), (stamp + F.make_dt_interval(days=(F.col("o_orderkey") % 900).cast("int"))).alias("expires_at"))
    return px.present(ver.result_freshness(rows, "result", "2000-01-01 00:00:00").select("result", "fetched_at", "expired", "inputs"))


@query("expire_ttl", """
SELECT user_id, count(*) AS alive FROM events WHERE CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 3 DAY ELSE ts + INTERVAL 24 HOUR END > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""")
def expire_ttl(spark, sf):
    rows = px.table(spark, sf, "events").withColumn("expires_at", F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 3 DAYS")))
    alive = ver.expire_ttl(rows, "2024-01-15 12:00:00", fetched="ts", expires="expires_at")
    return px.present(alive.groupBy("user_id").agg(F.count("*").alias("alive")))


@query("keyset_page", px.with_ctes(px.TRADES) + """
SELECT id, strftime(td, '%Y-%m-%d') AS transaction_date, issuer_id FROM tr WHERE (td, issuer_id, id) < (DATE '1999-06-15', '0000000050', '5') ORDER BY td DESC, tr.issuer_id DESC, id DESC LIMIT 26""")
def keyset_page(spark, sf):
    rows = px.trades(spark, sf).select("id", "transaction_date", "issuer_id")
    after = [F.lit("1999-06-15").cast("date"), F.lit("0000000050"), F.lit("5")]
    return px.present(ver.keyset_page(rows, ["transaction_date", "issuer_id", "id"], 25, after))


# --- versions ---------------------------------------------------------------------


def reparsed(spark, sf):
    """A second parse: row 2 of a filing got other shares, row 6 vanished, rows above 3 moved down one place."""
    old = px.trades(spark, sf)
    place = F.split_part("row_key", F.lit(":"), F.lit(3))
    number = F.split_part(place, F.lit("-"), F.lit(1)).cast("int")
    new = old.where(number != 6).withColumns({
        "shares": F.when(number == 2, F.col("shares") + 1).otherwise(F.col("shares")),
        "row_key": F.concat(F.col("table_no"), F.lit(":transaction:"), F.when(number > 3, F.concat(F.lit("moved-"), place)).otherwise(place)),
        "id": F.concat(F.lit("n"), F.col("id"))})
    return old, new


VERSIONS = px.with_ctes(px.TRADES) + """
, rn AS (SELECT *, md5(concat_ws('|', table_no, security_title, td, code, direction, coalesce(currency, '-'), shares, coalesce(CAST(price AS VARCHAR), '-'), coalesce(CAST(shares_after AS VARCHAR), '-'), array_to_string(owner_ids, ','))) AS fp,
    table_no || ':transaction:' || l_linenumber AS rk FROM tr),
nw AS (SELECT * REPLACE (CASE WHEN l_linenumber = 2 THEN md5(fp || 'x') ELSE fp END AS fp), CASE WHEN l_linenumber > 3 THEN table_no || ':transaction:' || (l_linenumber + 10) ELSE rk END AS nk FROM rn WHERE l_linenumber <> 6)
"""


@query("match_filing_versions", VERSIONS + """
, oc AS (SELECT accession, fp, accepted_at, issuer_id, count(*) AS n FROM rn GROUP BY ALL), nc AS (SELECT accession, fp, accepted_at, issuer_id, count(*) AS n FROM nw GROUP BY ALL),
k AS (SELECT sum(least(oc.n, nc.n)) AS kept FROM oc JOIN nc USING (accession, fp, accepted_at, issuer_id))
SELECT 'kept' AS outcome, CAST(kept AS BIGINT) AS rows FROM k UNION ALL SELECT 'changed', CAST((SELECT count(*) FROM nw) - kept AS BIGINT) FROM k
UNION ALL SELECT 'superseded', CAST((SELECT count(*) FROM rn) - kept AS BIGINT) FROM k""")
def match_filing_versions(spark, sf):
    old, new = reparsed(spark, sf)
    outcome = F.when(F.col("outcome").isin("replaces", "new"), "changed").otherwise(F.col("outcome"))
    counted = ver.matched_rows(old, new).where("is_new OR outcome = 'superseded'").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rows"))
    return px.present(counted)


DECISIONS = px.with_ctes(px.TRADES) + """
, am AS (SELECT accession, min(id) AS amended_id, max(id) AS original_id, any_value(o_orderkey) AS ok FROM tr WHERE form = '4/A' GROUP BY 1 HAVING count(*) > 1),
de AS (SELECT am.*, ['add', 'replace', 'no_change', 'withdraw', 'bogus'][ok % 5 + 1] AS action, ok % 11 <> 0 AS noted, a.issuer_id = b.issuer_id AS same FROM am JOIN tr a ON a.id = amended_id JOIN tr b ON b.id = original_id),
ok AS (SELECT *, CASE WHEN action = 'bogus' THEN 'action_invalid' WHEN NOT noted THEN 'evidence_missing' WHEN NOT same THEN 'original_invalid' END AS problem FROM de)
"""


def decided(spark, sf):
    trades = corrected(spark, sf).withColumn("original_accepted_at", F.lit(None).cast("timestamp")).withColumn("original_accession", F.lit(None).cast("string"))
    amended = trades.where("form = '4/A'").groupBy("accession").agg(F.min("id").alias("amended_id"), F.max("id").alias("original_id"), F.count("*").alias("n")).where("n > 1")
    key = F.substring("accession", 2, 10).cast("long")
    action = F.element_at(F.array(*[F.lit(a) for a in ("add", "replace", "no_change", "withdraw", "bogus")]), (key % 5 + 1).cast("int"))
    decisions = amended.select(key.alias("decision_no"), "amended_id", "original_id", action.alias("action"), F.when(key % 11 != 0, "checked").alias("note"))
    return ver.resolve_amendments(trades, decisions)


@query("resolve_amendments", DECISIONS + """
, st AS (SELECT tr.id, tr.status, action, problem, CASE WHEN tr.id = amended_id THEN 'a' WHEN tr.id = original_id THEN 'o' END AS side FROM tr LEFT JOIN ok ON ok.accession = tr.accession AND tr.id IN (amended_id, original_id))
SELECT id, CASE WHEN side IS NULL OR problem IS NOT NULL THEN status WHEN action = 'add' THEN 'CURRENT' WHEN action = 'withdraw' THEN 'WITHDRAWN' WHEN action = 'replace' THEN CASE side WHEN 'a' THEN 'CURRENT' ELSE 'SUPERSEDED' END
  ELSE CASE side WHEN 'a' THEN 'DUPLICATE_CONFIRMED' ELSE 'CURRENT' END END AS status FROM st""")
def resolve_amendments(spark, sf):
    return px.present(decided(spark, sf)[0].select("id", "status"))


@query("rejected_amendments", DECISIONS + "SELECT amended_id, problem FROM ok WHERE problem IS NOT NULL")
def rejected_amendments(spark, sf):
    return px.present(decided(spark, sf)[1].select("amended_id", "problem"))


def refiled(spark, sf):
    """The trades plus a copy of every ninth filing under another accession."""
    trades = px.trades(spark, sf)
    copies = trades.where("form = '4/A'").withColumn("id", F.concat(F.lit("c"), F.col("id"))).withColumn("accession", F.concat(F.lit("C"), F.col("accession")))
    return trades.unionByName(copies)


@query("self_join_duplicates", px.with_ctes(px.TRADES) + """
, al AS (SELECT id, accession, accepted_at, issuer_id, owner_ids, concat_ws('|', table_no, security_title, td, code, direction, shares, coalesce(CAST(price AS VARCHAR), '-'), coalesce(CAST(shares_after AS VARCHAR), '-')) AS ec, form FROM tr),
u AS (SELECT * FROM al UNION ALL SELECT 'c' || id, 'C' || accession, accepted_at, issuer_id, owner_ids, ec, form FROM al WHERE form = '4/A'),
x AS (SELECT *, unnest(owner_ids) AS o FROM u), g AS (SELECT issuer_id, ec, o, first(id ORDER BY accepted_at, id) AS fid FROM x GROUP BY 1, 2, 3 HAVING count(DISTINCT accession) > 1)
SELECT id, min(fid) AS first_id FROM x JOIN g USING (issuer_id, ec, o) GROUP BY 1""")
def self_join_duplicates(spark, sf):
    return px.present(ver.duplicates_across_filings(refiled(spark, sf)))


@query("join_amend_candidates", px.with_ctes(px.TRADES) + """
, x AS (SELECT *, unnest(owner_ids) AS o FROM tr)
SELECT a.id, a.o AS owner_id, count(b.id) AS candidates, min(c.accession) AS first_accession, max(c.accession) AS last_accession FROM x a
JOIN (SELECT DISTINCT issuer_id, td, table_no, security_title, o, accession FROM x) c ON c.issuer_id = a.issuer_id AND c.td = a.td AND c.table_no = a.table_no AND c.security_title = a.security_title AND c.o = a.o
LEFT JOIN x b ON b.issuer_id = a.issuer_id AND b.td = a.td AND b.table_no = a.table_no AND b.security_title = a.security_title AND b.o = a.o AND b.accession <> a.accession AND b.accession = c.accession
WHERE a.form = '4/A' GROUP BY 1, 2""")
def join_amend_candidates(spark, sf):
    return px.present(ver.amend_candidates(px.trades(spark, sf)))


def filings(spark, sf):
    trades = px.trades(spark, sf)
    return trades.groupBy("accession").agg(
        F.min("issuer_id").alias("issuer_id"), F.max("accepted_at").alias("accepted_at"), F.max(F.to_date("accepted_at")).alias("filing_date"),
        F.first("visible").alias("visible"), F.first("form").alias("form"), F.max("filing_ticker").alias("ticker"))


FILINGS = px.with_ctes(px.TRADES) + """
, fi AS (SELECT accession, min(issuer_id) AS issuer_id, max(accepted_at) AS accepted_at, max(CAST(accepted_at AS DATE)) AS filing_date, any_value(visible) AS visible, any_value(form) AS form, max(filing_ticker) AS ticker FROM tr GROUP BY 1)
"""


@query("anti_withdrawn", FILINGS + """
SELECT accession, 'SOURCE_WITHDRAWN' AS status FROM fi WHERE visible AND filing_date BETWEEN DATE '1996-02-01' AND DATE '2001-06-30' AND quarter(filing_date) <> 3 AND form <> '4'""")
def anti_withdrawn(spark, sf):
    rows = checkpoint(filings(spark, sf))
    entries = rows.where("form = '4'").select("accession")
    # Third quarters were read in part only.
    complete = rows.select(F.trunc("filing_date", "quarter").alias("quarter_start")).where("quarter(quarter_start) <> 3").distinct()
    return px.present(ver.withdrawn_filings(rows, entries, complete, "1996-02-01", "2001-06-30").select("accession", "status"))


@query("issuer_ticker_current", FILINGS + "SELECT issuer_id, last(ticker ORDER BY accepted_at, accession) AS ticker FROM fi WHERE visible GROUP BY 1")
def issuer_ticker_current(spark, sf):
    return px.present(ver.issuer_ticker_current(filings(spark, sf)))


@query("mapping_history", """
WITH m AS (SELECT o_custkey AS trade_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderkey % 8 AS security_id FROM orders)
SELECT trade_id, version, security_id, lag(security_id) OVER (PARTITION BY trade_id ORDER BY version) AS replaced_security, version = max(version) OVER (PARTITION BY trade_id) AS is_current FROM m WHERE version <= 3""")
def mapping_history(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = px.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("trade_id"), F.row_number().over(w).alias("version"), (F.col("o_orderkey") % 8).alias("security_id"))
    return px.present(ver.mapping_history(checkpoint(rows), as_of_version=3))


@query("join_valid_identifier", px.with_ctes(px.TRADES) + """
, ids AS (SELECT 'S' || CAST(s_suppkey % 8 AS VARCHAR) AS symbol, min(s_suppkey) AS security_id, CASE WHEN min(s_suppkey) % 2 = 0 THEN DATE '1995-01-01' ELSE DATE '1998-01-01' END AS a, CASE WHEN min(s_suppkey) % 4 = 0 THEN DATE '1999-12-31' END AS b FROM supplier GROUP BY 1)
SELECT security_id, count(*) AS trades FROM tr JOIN ids USING (symbol) WHERE a <= td AND (b IS NULL OR b >= td) GROUP BY 1""")
def join_valid_identifier(spark, sf):
    first = px.table(spark, sf, "supplier").groupBy(F.concat(F.lit("S"), (F.col("s_suppkey") % 8).cast("string")).alias("symbol")).agg(F.min("s_suppkey").alias("security_id"))
    identifiers = first.withColumn("valid_from", F.when(F.col("security_id") % 2 == 0, "1995-01-01").otherwise("1998-01-01").cast("date")).withColumn(
        "valid_to", F.when(F.col("security_id") % 4 == 0, F.lit("1999-12-31").cast("date")))
    rows = ver.join_valid_identifier(px.trades(spark, sf).select("id", "symbol", "transaction_date"), identifiers, "transaction_date")
    return px.present(rows.groupBy("security_id").agg(F.count("*").alias("trades")))


# --- discovery --------------------------------------------------------------------


@query("merge_entries", """
WITH e AS (SELECT 'A' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accession, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 1 THEN '5' ELSE '4' END AS form, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS issuer_id,
    CASE WHEN l_linenumber <> 2 THEN TIMESTAMP '2001-01-01' + to_hours(CASE WHEN l_linenumber > 4 THEN 5 ELSE 3 END) END AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'Issuer' ELSE 'Reporting' END AS role FROM lineitem)
SELECT accession, min(form) AS form, min(issuer_id) AS issuer_id, count(*) AS entries, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, CASE WHEN min(t) = max(t) THEN strftime(min(t), '%Y-%m-%d %H:%M:%S') END AS accepted_at,
  CASE WHEN min(t) <> max(t) THEN 'acceptance_time_conflict' WHEN min(t) IS NULL THEN 'acceptance_time_missing_or_invalid' END AS warning FROM e GROUP BY 1 HAVING count(DISTINCT form) = 1""")
def merge_entries(spark, sf):
    number = F.col("l_linenumber")
    rows = px.table(spark, sf, "lineitem").select(
        F.concat(F.lit("A"), px.pad(F.col("l_orderkey"))).alias("accession"), F.when((F.col("l_orderkey") % 13 == 0) & (number == 1), "5").otherwise("4").alias("form"),
        px.pad(F.col("l_suppkey")).alias("issuer_id"), F.when(number != 2, F.when(number > 4, "2001-01-01 05:00:00").otherwise("2001-01-01 03:00:00").cast("timestamp")).alias("accepted_at"),
        F.when(number % 2 == 0, "Issuer").otherwise("Reporting").alias("role"))
    return px.present(ver.merge_entries(rows)[0])


@query("index_completeness", """
WITH r AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), l AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT strftime(r.d, '%Y-%m-%d') AS index_day, CASE WHEN l.d IS NULL THEN 'missing' WHEN n % 3 = 0 THEN 'stale' ELSE 'complete' END AS state FROM r LEFT JOIN l ON l.d = r.d""")
def index_completeness(spark, sf):
    required = px.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("index_day")).distinct().withColumn("required_through", F.col("index_day"))
    landed = px.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("index_day")).agg(F.count("*").alias("n"))
    landed = landed.select("index_day", F.when(F.col("n") % 3 == 0, F.date_sub("index_day", 1)).otherwise(F.col("index_day")).alias("as_of"))
    return px.present(ver.index_completeness(required, landed).select("index_day", "state"))


ATTEMPTS = """
WITH f AS (SELECT 'A' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession FROM orders WHERE o_orderkey % 40 <> 0 AND o_orderstatus = 'O'),
a AS (SELECT 'A' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accession, ['QUEUED', 'RUNNING', 'FAILED', 'SUCCEEDED', 'PAUSED'][l_partkey % 5 + 1] AS st, l_shipdate AS c, l_partkey * 100000 + l_suppkey AS aid, l_shipdate + INTERVAL 30 DAY AS lu FROM lineitem),
n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY accession ORDER BY c DESC, aid DESC) = 1)
"""


def attempts(spark, sf):
    names = F.array(*[F.lit(s) for s in ("QUEUED", "RUNNING", "FAILED", "SUCCEEDED", "PAUSED")])
    made = F.to_timestamp("l_shipdate")
    rows = px.table(spark, sf, "lineitem").select(
        F.concat(F.lit("A"), px.pad(F.col("l_orderkey"))).alias("accession"), F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int")).alias("attempt_status"),
        made.alias("created_at"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("attempt_id"), (made + F.expr("INTERVAL 30 DAYS")).alias("lease_until"))
    pending = px.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(
        F.concat(F.lit("A"), px.pad(F.col("o_orderkey"))).alias("accession"), (F.col("o_orderkey") % 40 != 0).alias("visible"), F.lit(None).cast("string").alias("current_version"))
    return pending, rows


@query("join_latest_per_group", ATTEMPTS + "SELECT f.accession, st AS attempt_status, strftime(c, '%Y-%m-%d') AS attempt_day FROM f LEFT JOIN n USING (accession)")
def join_latest_per_group(spark, sf):
    pending, rows = attempts(spark, sf)
    return px.present(ver.latest_attempts(pending.where("visible").select("accession"), rows).select("accession", "attempt_status", F.to_date("created_at").alias("attempt_day")))


@query("pending_stages", ATTEMPTS + """
SELECT CASE st WHEN 'QUEUED' THEN 'waiting_download' WHEN 'RUNNING' THEN CASE WHEN lu > TIMESTAMP '2000-01-01' THEN 'fetching_parsing' ELSE 'waiting_recovery' END WHEN 'FAILED' THEN 'failed' WHEN 'SUCCEEDED' THEN 'needs_review'
  WHEN 'PAUSED' THEN 'paused' ELSE 'discovered' END AS stage, count(*) AS filings FROM f LEFT JOIN n USING (accession) GROUP BY 1""")
def pending_stages(spark, sf):
    return px.present(ver.pending_stages(*attempts(spark, sf), "2000-01-01 00:00:00"))


@query("quality_failures", """
SELECT event_type AS kind, CASE WHEN value < 10 THEN 'low' ELSE 'other' END AS reason, count(*) AS rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events WHERE ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""")
def quality_failures(spark, sf):
    rejects = px.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(F.col("value") < 10, "low").otherwise("other").alias("reason"), F.col("ts").alias("rejected_at"))
    return px.present(ver.quality_failures(rejects, "2024-01-20 12:00:00"))


# --- entities ---------------------------------------------------------------------

ENTITY = px.with_ctes(px.TRADES) + """
, vi AS (SELECT *, CASE WHEN td <= ad THEN td END AS sd FROM tr WHERE visible), pe AS (SELECT *, unnest(owner_ids) AS e FROM vi)
"""


@query("entity_history", ENTITY + f"""
, h AS (SELECT 'company' AS kind, issuer_id AS e, CASE code WHEN 'P' THEN 'buy' ELSE 'sell' END AS side, count(*) AS rows, sum(shares) AS sh, sum(price * shares) AS am, count(*) FILTER (WHERE price IS NULL) AS mp, count(DISTINCT currency) AS cu FROM vi
    WHERE status = 'CURRENT' AND table_no = 'I' AND code IN ('P', 'S') GROUP BY ALL
  UNION ALL SELECT 'person', e, CASE code WHEN 'P' THEN 'buy' ELSE 'sell' END, count(*), sum(shares), sum(price * shares), count(*) FILTER (WHERE price IS NULL), count(DISTINCT currency) FROM pe WHERE status = 'CURRENT' AND table_no = 'I' AND code IN ('P', 'S') GROUP BY ALL),
o AS (SELECT issuer_id AS e, CASE code WHEN 'P' THEN 'buy' ELSE 'sell' END AS side, count(DISTINCT e) AS ow FROM pe WHERE status = 'CURRENT' AND table_no = 'I' AND code IN ('P', 'S') GROUP BY ALL)
SELECT kind, h.e AS entity_id, h.side, rows, {money('sh')} AS shares, {money('am')} AS known_amount, mp AS missing_price_rows, cu AS currencies, CASE kind WHEN 'person' THEN 1 ELSE ow END AS owners FROM h LEFT JOIN o ON o.e = h.e AND o.side = h.side AND kind = 'company'""")
def entity_history(spark, sf):
    trades = px.trades(spark, sf)
    parts = [ver.entity_headline(ver.entity_rows(trades, kind), kind).withColumn("kind", F.lit(kind)) for kind in ("company", "person")]
    return shown(parts[0].unionByName(parts[1]).drop("currency"), "shares", "known_amount")


@query("entity_span", ENTITY + """
SELECT e AS entity_id, count(*) AS total, count(DISTINCT accession) AS filings, strftime(min(sd), '%Y-%m-%d') AS transaction_start, strftime(max(sd), '%Y-%m-%d') AS transaction_end, count(DISTINCT issuer_id) AS companies FROM pe GROUP BY 1""")
def entity_span(spark, sf):
    return px.present(ver.entity_span(ver.entity_rows(px.trades(spark, sf), "person")))


@query("recent_k", ENTITY + """
SELECT issuer_id AS entity_id, row_number() OVER (PARTITION BY issuer_id ORDER BY sd DESC NULLS LAST, id DESC) AS position, id FROM vi WHERE table_no = 'II' OR code IN ('P', 'S') QUALIFY position <= 5""")
def recent_k(spark, sf):
    rows = ver.entity_rows(px.trades(spark, sf), "company", action="focus")
    return px.present(ver.recent_k(rows, 5).select("entity_id", "position", "id"))


@query("rows_order", px.with_ctes(px.TRADES) + """
SELECT id, strftime(CASE WHEN td <= ad THEN td END, '%Y-%m-%d') AS sort_date FROM tr ORDER BY CASE WHEN td <= ad THEN td END DESC NULLS LAST, accepted_at DESC, id DESC LIMIT 200""")
def rows_order(spark, sf):
    from ledgertide.operators.trades import sort_date

    rows = ver.rows_order(px.trades(spark, sf), "transaction", 200)
    return px.present(rows.select("id", sort_date().alias("sort_date")))
