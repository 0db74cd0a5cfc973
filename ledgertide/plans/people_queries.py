"""People, disclosure, search and name-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.functions import disclosure as D
from ledgertide.functions import text as T
from ledgertide.operators import calendar as cal
from ledgertide.operators import search as sea
from ledgertide.operators import timeline as tml
from ledgertide.operators import trades as trd
from ledgertide.plans import proxies as px
from ledgertide.plans.insider_queries import money, shown
from ledgertide.plans.registry import query
from ledgertide.session import checkpoint

TIMELINE = px.with_ctes(px.TRADES, px.DISCLOSED, px.REPORTS, px.FOLLOWED) + """
, tl AS (SELECT 'sec' AS source, ad AS published, 2 AS rank, strftime(accepted_at, '%Y%m%d%H%M%S') || ':' || id AS tie, id AS ref, accession AS gid, CASE code WHEN 'P' THEN 'buy' ELSE 'sell' END AS side, 'stock' AS kind, td,
    symbol, CAST(price * shares AS DECIMAL(38,2)) AS amount, CAST(NULL AS DECIMAL(20,2)) AS amount_low, owner_ids[1] AS person_id FROM tr
  WHERE status = 'CURRENT' AND code IN ('P', 'S') AND table_no = 'I' AND visible AND EXISTS (SELECT 1 FROM fol WHERE list_contains(owner_ids, fol.person_id))
  UNION ALL SELECT source, coalesce(report_date, filed_date, DATE '1900-01-01'), CASE source WHEN 'house' THEN 1 ELSE 0 END, report_id || ':' || lpad(CAST(99999 - page AS VARCHAR), 5, '0') || ':' || lpad(CAST(99999 - row_number AS VARCHAR), 5, '0'),
    dt.id, report_id, CASE transaction_type WHEN 'purchase' THEN 'buy' WHEN 'sale' THEN 'sell' WHEN 'partial_sale' THEN 'sell' WHEN 'exchange' THEN 'exchange' ELSE 'unknown' END,
    CASE WHEN asset_type LIKE '%bond%' THEN 'bond' WHEN asset_type IN ('stock', 'option', 'fund') THEN asset_type ELSE 'other' END, td, ticker, NULL, amount_low, person_id
  FROM dt JOIN rep USING (report_id) JOIN fol USING (person_id) WHERE report_status <> 'superseded' AND amendment_status <> 'unresolved')
"""


def timeline(spark, sf, **options):
    people = px.followed(spark, sf)
    return tml.people_timeline(px.trades(spark, sf, people), px.disclosure_trades(spark, sf), px.disclosure_reports(spark, sf), people, owned=True, **options)


@query("people_timeline", TIMELINE + f"SELECT source, strftime(published, '%Y-%m-%d') AS published, CAST(rank AS BIGINT) AS rank, tie, ref, gid AS group_id, side, kind AS asset_kind, {money('coalesce(amount, amount_low)')} AS amount FROM tl")
def people_timeline(spark, sf):
    rows = timeline(spark, sf).withColumn("amount", F.coalesce("amount", "amount_low"))
    return shown(rows.select("source", "published", "rank", "tie", "ref", "group_id", "side", "asset_kind", "amount"), "amount")


@query("timeline_page", TIMELINE + "SELECT ref, side FROM tl WHERE side = 'buy' AND published BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' ORDER BY published DESC, rank DESC, tie DESC LIMIT 50")
def timeline_page(spark, sf):
    rows = timeline(spark, sf, side="buy", published_from="1997-01-01", published_to="2000-12-31")
    return px.present(tml.timeline_page(rows, 50).select("ref", "side"))


@query("distinct_groups", TIMELINE + "SELECT DISTINCT source, strftime(published, '%Y-%m-%d') AS published, CAST(rank AS BIGINT) AS rank, gid AS group_id FROM tl")
def distinct_groups(spark, sf):
    return px.present(tml.distinct_groups(timeline(spark, sf)))


@query("disclosure_reports", TIMELINE + """
SELECT source, strftime(published, '%Y-%m-%d') AS published, gid AS group_id, count(*) AS rows, count(*) FILTER (WHERE kind = 'stock') AS stock, count(*) FILTER (WHERE kind = 'option') AS option, count(*) FILTER (WHERE kind = 'bond') AS bond,
  count(*) FILTER (WHERE kind = 'fund') AS fund, count(*) FILTER (WHERE kind = 'other') AS other, count(*) FILTER (WHERE kind IN ('stock', 'option')) AS equities, count(*) FILTER (WHERE kind IN ('stock', 'option') AND side = 'buy') AS buys,
  count(*) FILTER (WHERE kind IN ('stock', 'option') AND side = 'sell') AS sells FROM tl GROUP BY 1, 2, 3""")
def disclosure_reports(spark, sf):
    return px.present(tml.disclosure_reports(timeline(spark, sf)).drop("rank"))


@query("amount_preview", TIMELINE + """
SELECT gid AS group_id, ref, row_number() OVER (PARTITION BY gid ORDER BY kind IN ('stock', 'option') DESC, CAST(coalesce(amount, amount_low) AS DECIMAL(38,2)) DESC NULLS LAST, tie DESC) AS position FROM tl QUALIFY position <= 3""")
def amount_preview(spark, sf):
    return px.present(tml.amount_preview(timeline(spark, sf)).select("group_id", "ref", "position"))


@query("active_reports", px.with_ctes(px.REPORTS) + "SELECT report_id, source FROM rep WHERE report_status <> 'superseded' AND amendment_status <> 'unresolved'")
def active_reports(spark, sf):
    return px.present(tml.active_reports(px.disclosure_reports(spark, sf)).select("report_id", "source"))


@query("disclosure_rows", px.with_ctes(px.DISCLOSED, px.REPORTS, px.PEOPLE) + """
SELECT dt.id, name, rep.source FROM dt JOIN rep USING (report_id) JOIN ppl USING (person_id) WHERE report_status <> 'superseded' AND amendment_status <> 'unresolved' AND lower(name) LIKE '%00001%' AND rep.source = 'house'
  AND transaction_type IN ('sale', 'partial_sale') AND td BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND coalesce(report_date, filed_date) BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'""")
def disclosure_rows(spark, sf):
    rows = tml.disclosure_rows(px.disclosure_trades(spark, sf), px.disclosure_reports(spark, sf), px.people(spark, sf), name="00001", source="house", direction="sell",
                               traded=("1996-01-01", "2000-12-31"), reported=("1996-01-01", "2001-12-31"))
    return px.present(rows.select("id", "name", "source"))


@query("review_reasons", px.with_ctes(px.DISCLOSED, px.REPORTS) + """
, b AS (SELECT dt.*, coalesce(report_date, filed_date) AS pub, CASE WHEN row_number % 7 = 0 THEN amount_low + 1 ELSE amount_low END AS al FROM dt JOIN rep USING (report_id))
SELECT id, concat_ws(',', CASE WHEN warned THEN 'direction_unknown' END, CASE WHEN ticker_origin = 'inferred' THEN 'ticker_inferred' END, CASE WHEN td > pub THEN 'date_after_report' END, CASE WHEN pub - td > 365 THEN 'date_unlikely' END,
  CASE WHEN row_number % 7 = 0 OR (amount_high IS NULL) THEN 'amount_unusual' END) AS review FROM b""")
def review_reasons(spark, sf):
    rows = px.disclosure_trades(spark, sf).withColumn("amount_low", F.when(F.col("row_number") % 7 == 0, F.col("amount_low") + 1).otherwise(F.col("amount_low")))
    return px.present(tml.with_review_reasons(rows, px.disclosure_reports(spark, sf)).select("id", "review"))


@query("trade_detail", px.with_ctes(px.TRADES, px.DISCLOSED, px.REPORTS) + """
, se AS (SELECT 'S' || CAST(s_suppkey % 8 AS VARCHAR) AS symbol, min(s_suppkey) AS security_id FROM supplier WHERE s_suppkey % 8 <> 3 GROUP BY 1),
u AS (SELECT source, dt.id, report_id AS document, ticker, td, coalesce(report_date, filed_date) AS pub, report_status = 'superseded' AS superseded, amendment_status IN ('linked', 'unresolved') AS amendment FROM dt JOIN rep USING (report_id)
  UNION ALL SELECT 'sec', id, accession, symbol, td, ad, FALSE, form = '4/A' FROM tr)
SELECT source, id, document, ticker, security_id, superseded, amendment, pub - td AS lag_days FROM u LEFT JOIN se ON se.symbol = ticker""")
def trade_detail(spark, sf):
    securities = px.table(spark, sf, "supplier").where("s_suppkey % 8 <> 3").groupBy(F.concat(F.lit("S"), (F.col("s_suppkey") % 8).cast("string")).alias("symbol")).agg(F.min("s_suppkey").alias("security_id"))
    rows = tml.trade_detail(px.disclosure_trades(spark, sf), px.disclosure_reports(spark, sf), px.trades(spark, sf), securities)
    return px.present(rows.select("source", "id", "document", "ticker", "security_id", "superseded", "amendment", "lag_days"))


@query("disclosure_people", px.with_ctes(px.REPORTS, px.PEOPLE) + """
SELECT ppl.person_id, name, coalesce(n, 0) AS report_count, strftime(d, '%Y-%m-%d') AS latest_report_date FROM ppl LEFT JOIN (SELECT person_id, count(*) AS n, max(coalesce(report_date, filed_date)) AS d FROM rep
  WHERE report_status <> 'superseded' AND amendment_status <> 'unresolved' GROUP BY 1) USING (person_id)""")
def disclosure_people(spark, sf):
    rows = tml.disclosure_people(px.people(spark, sf), px.disclosure_reports(spark, sf))
    return px.present(rows.select("person_id", "name", "report_count", "latest_report_date"))


@query("disclosure_source_stats", px.with_ctes(px.REPORTS, px.DISCLOSED) + """
, r AS (SELECT source, count(*) AS report_count, count(*) FILTER (WHERE report_status <> 'superseded' AND amendment_status <> 'unresolved') AS active_report_count, CAST(sum(page_count) AS BIGINT) AS page_count, CAST(sum(pages_done) AS BIGINT) AS pages_done,
    CAST(sum(ocr_pages) AS BIGINT) AS ocr_pages, count(*) FILTER (WHERE source_hash IS NULL OR pages_done < page_count OR report_status = 'review') AS pending_reports FROM rep GROUP BY 1),
t AS (SELECT source, count(*) FILTER (WHERE report_status <> 'superseded' AND amendment_status <> 'unresolved') AS transaction_count, count(*) FILTER (WHERE report_status <> 'superseded' AND confidence = 'review') AS review_count FROM dt JOIN rep USING (report_id) GROUP BY 1)
SELECT * FROM r LEFT JOIN t USING (source)""")
def disclosure_source_stats(spark, sf):
    return px.present(tml.disclosure_source_stats(px.disclosure_reports(spark, sf), px.disclosure_trades(spark, sf)))


SUMMARY = TIMELINE.replace("WITH", "WITH " + px.PX.strip() + ",", 1) + f"""
, cut AS (SELECT prev_incl AS k FROM spine WHERE d = DATE '{px.CUTOFF}'), mx AS (SELECT max(no) AS m FROM ses),
it AS (SELECT person_id, side, ref, tl.symbol, td AS d, 'after' AS anchor FROM tl WHERE side IN ('buy', 'sell') AND kind IN ('stock', 'option') AND td IS NOT NULL AND tl.symbol IS NOT NULL
  UNION ALL SELECT person_id, side, ref, tl.symbol, b.d, 'published' FROM tl LEFT JOIN spine s ON s.d = published LEFT JOIN ses b ON b.no = s.next_incl - 1 WHERE side IN ('buy', 'sell') AND kind IN ('stock', 'option') AND td IS NOT NULL AND tl.symbol IS NOT NULL),
w AS (SELECT it.*, s.next_incl AS t, k, m, n.c / b.c - 1 AS v FROM it CROSS JOIN cut CROSS JOIN mx LEFT JOIN spine s ON s.d = it.d LEFT JOIN ses sb ON sb.no = s.next_incl LEFT JOIN ses sn ON sn.no = s.next_incl + 5
    LEFT JOIN px b ON b.symbol = it.symbol AND b.d = sb.d AND sb.no <= k LEFT JOIN px n ON n.symbol = it.symbol AND n.d = sn.d AND sn.no <= k),
st AS (SELECT *, CASE WHEN t IS NULL OR t > m OR t + 5 > m OR t < 1 THEN 'missing' WHEN t + 5 > k THEN 'pending' WHEN v IS NULL THEN 'missing' ELSE 'available' END AS status FROM w)
SELECT person_id, side, anchor, count(*) FILTER (WHERE status = 'available') AS count, count(*) FILTER (WHERE status = 'available' AND v > 0) AS up,
  CASE WHEN count(*) FILTER (WHERE status = 'available') >= 5 THEN round(quantile_cont(v, 0.5) FILTER (WHERE status = 'available'), 6) END AS median,
  count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'missing') AS missing FROM st GROUP BY 1, 2, 3
"""


@query("person_summary", SUMMARY)
def person_summary(spark, sf):
    m = px.market(spark, sf)
    rows = checkpoint(timeline(spark, sf).where("side IN ('buy', 'sell') AND asset_kind IN ('stock', 'option') AND transaction_date IS NOT NULL AND symbol IS NOT NULL").select(
        "person_id", "side", "symbol", "transaction_date", "published"))
    placed = cal.with_spine(rows, "published", m.spine, prefix="_b_").withColumn("_base", F.col("_b_next_incl") - 1)
    based = cal.session_date_of(placed, "_base", m.sessions, "basis")
    items = rows.select("person_id", "side", "symbol", F.col("transaction_date").alias("day"), F.lit("after").alias("anchor")).unionByName(
        based.select("person_id", "side", "symbol", F.col("basis").alias("day"), F.lit("published").alias("anchor")))
    windows = trd.trade_windows(items, m.bars, m.sessions, m.spine, 5, px.CUTOFF, day="day")
    summary = tml.person_summary(windows.select("person_id", "side", "anchor", F.col("after_status").alias("status"), F.col("after").alias("value")))
    return px.present(summary.drop("values"))


@query("person_profile", px.with_ctes(px.TRADES, px.PEOPLE) + """
, f AS (SELECT o AS person_id, accession, max(accepted_at) AS t, max(concat_ws(',', CASE WHEN is_ceo THEN 'ceo' END, CASE WHEN is_cfo THEN 'cfo' END, CASE WHEN is_director THEN 'director' END, CASE WHEN is_ten_percent THEN 'ten_percent' END)) AS r
  FROM (SELECT *, unnest(owner_ids) AS o FROM tr) GROUP BY 1, 2)
SELECT person_id, name, 'sec:' || person_id AS key, count(*) AS filings, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS latest_at, last(r ORDER BY t, accession) AS roles FROM f JOIN ppl USING (person_id) WHERE person_id <> '0000000000' GROUP BY 1, 2
UNION ALL SELECT person_id, name, NULL, count(*), strftime(max(t), '%Y-%m-%d %H:%M:%S'), last(r ORDER BY t, accession) FROM f JOIN ppl USING (person_id) WHERE person_id = '0000000000' GROUP BY 1, 2""")
def person_profile(spark, sf):
    return px.present(tml.person_profile(px.trades(spark, sf), px.people(spark, sf)))


# --- report versions --------------------------------------------------------------


def versioned_reports(spark, sf):
    key = F.substring("report_id", 2, 10).cast("long")
    external = lambda k: F.concat_ws("-", "person_id", (k % 4).cast("string"))
    return px.disclosure_reports(spark, sf).withColumn("external_id", external(key)).withColumn(
        "amends_external_id", F.when(F.col("amendment_status") != "original", external(key + 1)))


LINKS = px.with_ctes(px.REPORTS) + """
, r AS (SELECT *, person_id || '-' || (o_orderkey % 4) AS ext, CASE WHEN amendment_status <> 'original' THEN person_id || '-' || ((o_orderkey + 1) % 4) END AS am FROM rep),
l AS (SELECT a.report_id, min(o.report_id) AS orig FROM r a JOIN r o ON o.source = a.source AND o.person_id = a.person_id AND o.ext = a.am AND o.report_id <> a.report_id GROUP BY 1)
"""


@query("link_disclosure_amendments", LINKS + "SELECT report_id, orig AS amendment_of_id FROM l")
def link_disclosure_amendments(spark, sf):
    rows = tml.link_amendments(versioned_reports(spark, sf)).where("amendment_of_id IS NOT NULL")
    return px.present(rows.select("report_id", "amendment_of_id"))


@query("disclosure_amendments", LINKS + """
SELECT report_id, CASE WHEN l.orig IS NOT NULL THEN 'linked' ELSE amendment_status END AS amendment_status, CASE WHEN report_id IN (SELECT orig FROM l) THEN 'superseded' ELSE report_status END AS report_status FROM r LEFT JOIN l USING (report_id)""")
def disclosure_amendments(spark, sf):
    return px.present(tml.link_amendments(versioned_reports(spark, sf)).select("report_id", "amendment_status", "report_status"))


@query("dup_disclosures", px.with_ctes(px.REPORTS) + """
SELECT report_id, first_value(report_id) OVER w AS duplicate_of_id FROM (SELECT *, 'h' || (o_orderkey % 2) AS hh FROM rep WHERE source_hash IS NOT NULL) WINDOW w AS (PARTITION BY source, person_id, hh ORDER BY discovered_at, report_id)
QUALIFY first_value(report_id) OVER w <> report_id""")
def dup_disclosures(spark, sf):
    key = F.substring("report_id", 2, 10).cast("long")
    rows = px.disclosure_reports(spark, sf).withColumn("source_hash", F.when(F.col("source_hash").isNotNull(), F.concat(F.lit("h"), (key % 2).cast("string"))))
    return px.present(tml.duplicate_disclosures(rows))


def discovered(spark, sf):
    people = px.people(spark, sf)
    reports = px.disclosure_reports(spark, sf).drop("source")
    entries = reports.join(people, "person_id").select(
        "source", F.col("report_id").alias("external_id"), "name", "district", "position", "filed_date", F.col("report_date").alias("document_date"),
        F.when(F.col("ocr_pages") == 0, "official_index_label").otherwise("other").alias("date_source"))
    known = people.where("person_id LIKE '%7'").select("source", F.concat_ws("|", "name", F.coalesce("district", F.lit("")), F.coalesce("position", F.lit(""))).alias("identity"))
    stored = px.disclosure_reports(spark, sf).where("report_id LIKE '%3'").select("source", F.col("report_id").alias("external_id"))
    return tml.discover_reports(entries, known, stored)


@query("discover_reports", px.with_ctes(px.REPORTS, px.PEOPLE) + """
SELECT rep.source, report_id AS external_id, strftime(coalesce(filed_date, CASE WHEN ocr_pages = 0 THEN report_date END), '%Y-%m-%d') AS report_date,
  CASE WHEN filed_date IS NOT NULL THEN 'received_date' WHEN ocr_pages = 0 THEN 'official_index_label' END AS report_date_source FROM rep JOIN ppl USING (person_id) WHERE report_id NOT LIKE '%3'""")
def discover_reports(spark, sf):
    return px.present(discovered(spark, sf)[1].select("source", "external_id", "report_date", "report_date_source"))


@query("discover_people", px.with_ctes(px.REPORTS, px.PEOPLE) + """
SELECT DISTINCT ppl.source, name || '|' || coalesce(district, '') || '|' || coalesce(position, '') AS identity FROM rep JOIN ppl USING (person_id) WHERE person_id NOT LIKE '%7'""")
def discover_people(spark, sf):
    return px.present(discovered(spark, sf)[0].select("source", "identity"))


READINGS = px.with_ctes(px.DISCLOSED) + """
, a AS (SELECT report_id, page, row_number() OVER (PARTITION BY report_id, page ORDER BY id) AS rn, transaction_type AS t, row_number AS k FROM dt),
b AS (SELECT report_id, page, rn, CASE WHEN k % 6 = 0 THEN 'purchase' ELSE t END AS t, k FROM a WHERE NOT (page = 2 AND k % 9 = 0)),
n AS (SELECT b.report_id, b.page, (SELECT count(*) FROM a WHERE a.report_id = b.report_id AND a.page = b.page) = count(*) AS same FROM b GROUP BY 1, 2)
"""


@query("reconcile_readings", READINGS + """
SELECT a.report_id, a.page, a.rn AS row_number, CASE WHEN a.t <> b.t THEN 'unknown' ELSE a.t END AS transaction_type, CASE WHEN a.t <> b.t THEN 'direction_conflict' ELSE '' END AS warnings FROM a JOIN n USING (report_id, page) JOIN b USING (report_id, page, rn) WHERE same
UNION ALL SELECT b.report_id, b.page, b.rn, b.t, 'text_layer_unusable' FROM b JOIN n USING (report_id, page) WHERE NOT same""")
def reconcile_readings(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("report_id", "page").orderBy("id")
    rows = px.disclosure_trades(spark, sf).select("report_id", "page", F.row_number().over(w).alias("rn"), "transaction_type", F.col("row_number").alias("k"))
    layer = checkpoint(rows.withColumnRenamed("rn", "row_number").withColumn("warnings", F.array().cast("array<string>")))
    checked = layer.where("NOT (page = 2 AND k % 9 = 0)").withColumn("transaction_type", F.when(F.col("k") % 6 == 0, "purchase").otherwise(F.col("transaction_type")))
    return px.present(tml.reconcile_readings(layer.drop("k"), checked.drop("k")).select("report_id", "page", "row_number", "transaction_type", "warnings"))


@query("directory", px.with_ctes(px.PEOPLE) + """
, p AS (SELECT CASE WHEN source = 'senate' THEN 'sec:' || person_id ELSE source || ':' || name || '|' || coalesce(district, position) END AS key, name, source, c_acctbal, c_mktsegment FROM ppl)
SELECT key, name, CASE WHEN c_acctbal > 5000 THEN 'followed' WHEN c_mktsegment = 'BUILDING' THEN 'default' ELSE 'local' END AS origin FROM p WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING' OR source <> 'senate'""")
def directory(spark, sf):
    people = px.people(spark, sf)
    key = T.person_key(F.when(F.col("source") == "senate", "sec").otherwise(F.col("source")), F.col("person_id"), F.col("name"), F.col("district"), F.col("position"))
    facts = px.table(spark, sf, "customer").select(px.pad(F.col("c_custkey")).alias("person_id"), "c_acctbal", "c_mktsegment")
    rows = people.withColumn("key", key).join(facts, "person_id")
    return px.present(tml.directory(rows.where("c_acctbal > 5000"), rows.where("c_mktsegment = 'BUILDING'"), rows.where("source <> 'senate'")))


# --- search -----------------------------------------------------------------------


def terms(spark, sf):
    """Search terms from the data: region-like numbers, supplier numbers and tickers."""
    nation = px.table(spark, sf, "nation").select(F.concat(F.lit("supplier "), F.lpad((F.col("n_nationkey") * 3).cast("string"), 3, "0")).alias("term"))
    tickers = px.table(spark, sf, "supplier").select(F.format_string("t%d", "s_suppkey").alias("term"))
    numbers = px.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("term"))
    return nation.unionByName(tickers).unionByName(numbers).distinct()


TERMS = """
tm AS (SELECT 'supplier ' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 3, '0') AS term FROM nation UNION SELECT 't' || s_suppkey FROM supplier UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier),
en AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS entity_id, s_name AS name, 'T' || s_suppkey AS ticker, max(CAST(l_shipdate AS DATE)) AS last_trade FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
"""


@query("search_entities", "WITH " + TERMS.strip() + """
, m AS (SELECT term, en.*, upper(ticker) = upper(term) AS exact FROM tm JOIN en ON upper(ticker) = upper(term) OR (regexp_matches(term, '^[0-9]{1,10}$') AND entity_id = lpad(term, 10, '0'))
    OR len(list_filter(string_split(lower(term), ' '), lambda w: NOT contains(lower(name), w))) = 0)
SELECT term, row_number() OVER (PARTITION BY term ORDER BY exact DESC, name, entity_id) AS position, entity_id, strftime(last_trade, '%Y-%m-%d') AS last_trade FROM m QUALIFY position <= 20""")
def search_entities(spark, sf):
    last = px.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max(F.to_date("l_shipdate")).alias("last_trade"))
    supplier = px.table(spark, sf, "supplier")
    entities = supplier.join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        px.pad(F.col("s_suppkey")).alias("entity_id"), F.col("s_name").alias("name"), F.format_string("T%d", "s_suppkey").alias("ticker"), "last_trade")
    return px.present(sea.search_entities(terms(spark, sf), entities).select("term", "position", "entity_id", "last_trade"))


@query("search_all", "WITH " + TERMS.strip() + """
, al AS (SELECT r_name AS alias, 'T' || r_regionkey AS key FROM region), t2 AS (SELECT lower(r_name) AS term FROM region UNION SELECT term FROM tm),
u AS (SELECT term, key, alias AS label, 0 AS r FROM t2 JOIN al ON lower(alias) = term UNION ALL SELECT term, ticker, ticker, 1 FROM t2 JOIN en ON upper(ticker) = upper(term) UNION ALL SELECT term, ticker, name, 2 FROM t2 JOIN en
  ON len(list_filter(string_split(term, ' '), lambda w: NOT contains(lower(name), w))) = 0)
SELECT term, key, ['alias', 'security', 'company'][r + 1] AS source, label FROM u QUALIFY row_number() OVER (PARTITION BY term, key ORDER BY r) = 1""")
def search_all(spark, sf):
    region, supplier = px.table(spark, sf, "region"), px.table(spark, sf, "supplier")
    wanted = terms(spark, sf).unionByName(region.select(F.lower("r_name").alias("term"))).distinct()
    aliases = region.select(F.col("r_name").alias("alias"), F.array(F.concat(F.lit("T"), F.col("r_regionkey").cast("string"))).alias("codes"), F.col("r_regionkey").alias("alias_pos"))
    alias_hits = sea.alias_matches(wanted, aliases).select("term", F.col("code").alias("key"), F.col("alias").alias("label"), (F.col("match_rank") * 1000 + F.col("alias_pos")).cast("long").alias("score"))
    entities = supplier.select(F.format_string("T%d", "s_suppkey").alias("key"), F.col("s_name").alias("label"))
    securities = wanted.withColumn("key", F.upper("term")).join(entities.select("key"), "key").select("term", "key", F.col("key").alias("label"), F.lit(0).cast("long").alias("score"))
    companies = sea.name_matches(wanted, entities, "key", "label").join(entities, "key").select("term", "key", "label", F.lit(0).cast("long").alias("score"))
    return px.present(sea.search_all([("alias", alias_hits), ("security", securities), ("company", companies)]))


@query("search_all_people", px.with_ctes(px.PEOPLE) + """
, t AS (SELECT lower(name) AS term FROM ppl WHERE CAST(person_id AS INTEGER) % 50 = 0 UNION SELECT person_id FROM ppl WHERE CAST(person_id AS INTEGER) % 70 = 0 UNION SELECT lower(substr(name, 1, 16)) FROM ppl WHERE CAST(person_id AS INTEGER) % 300 = 0),
u AS (SELECT term, person_id AS key, 'Co ' || name AS label, 0 AS r FROM t JOIN ppl ON person_id = term UNION ALL SELECT term, 'sec:' || person_id, name, 1 FROM t JOIN ppl ON contains(lower(name), term) OR person_id = term
  UNION ALL SELECT term, source || ':' || name || '|' || coalesce(district, position), name, 2 FROM t JOIN ppl ON contains(lower(name), term) WHERE source IN ('house', 'oge'))
SELECT term, key, ['company', 'person', 'official'][r + 1] AS source, label FROM u QUALIFY row_number() OVER (PARTITION BY term, key ORDER BY r) = 1""")
def search_all_people(spark, sf):
    customer = px.table(spark, sf, "customer")
    owners = customer.select(px.pad(F.col("c_custkey")).alias("owner_id"), F.col("c_name").alias("name"))
    key = F.col("c_custkey")
    people = customer.select(
        F.element_at(F.array(F.lit("oge"), F.lit("house"), F.lit("senate")), (key % 3 + 1).cast("int")).alias("source"), F.col("c_name").alias("name"),
        F.when(key % 3 == 1, F.concat(F.lit("CA"), F.lpad((key % 50).cast("string"), 2, "0"))).alias("district"),
        F.when(key % 3 == 0, F.when(key % 2 == 0, "Secretary (Commerce)").otherwise("President")).alias("position"))
    wanted = (customer.where("c_custkey % 50 = 0").select(F.lower("c_name").alias("term")).unionByName(owners.where("cast(owner_id as int) % 70 = 0").select(F.col("owner_id").alias("term")))
              .unionByName(customer.where("c_custkey % 300 = 0").select(F.lower(F.substring("c_name", 1, 16)).alias("term"))).distinct())
    companies = wanted.join(owners.select(F.col("owner_id").alias("term"), F.concat(F.lit("Co "), "name").alias("label")), "term").select("term", F.col("term").alias("key"), "label", F.lit(0).cast("long").alias("score"))
    return px.present(sea.search_all([("company", companies), ("person", sea.person_hits(wanted, owners)), ("official", sea.official_hits(wanted, people))]))


@query("alias_matches", """
WITH t AS (SELECT DISTINCT lower(left(n_name, 6)) || '_' || n_nationkey AS term FROM nation UNION SELECT 'nation_1' UNION SELECT 'n'), a AS (SELECT n_name AS alias, n_nationkey AS pos, 'T' || (n_nationkey % 6) AS code FROM nation)
SELECT term, code, CAST(r AS BIGINT) AS match_rank, alias FROM (SELECT term, code, CASE WHEN lower(alias) = term THEN 0 ELSE 1 END AS r, alias, pos FROM t JOIN a ON lower(alias) = term OR (length(term) >= 2 AND contains(lower(alias), term)))
QUALIFY row_number() OVER (PARTITION BY term, code ORDER BY r, pos) = 1""")
def alias_matches(spark, sf):
    nation = px.table(spark, sf, "nation")
    wanted = nation.select(F.concat(F.lower(F.substring("n_name", 1, 6)), F.lit("_"), F.col("n_nationkey").cast("string")).alias("term")).unionByName(
        nation.where("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, "nation_1").otherwise("n").alias("term"))).distinct()
    aliases = nation.select(F.col("n_name").alias("alias"), F.array(F.concat(F.lit("T"), (F.col("n_nationkey") % 6).cast("string"))).alias("codes"), F.col("n_nationkey").alias("alias_pos"))
    return px.present(sea.alias_matches(wanted, aliases).select("term", "code", "match_rank", "alias"))


@query("resolve_names", px.with_ctes(px.CONSTITUENTS) + """
, w AS (SELECT DISTINCT 'T' || l_suppkey AS k FROM lineitem), a AS (SELECT ticker AS k, name, cik FROM con WHERE index_name = 'sp500'), b AS (SELECT 'T' || s_suppkey AS k, 'Sec ' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 = 0),
c AS (SELECT 'T' || s_suppkey AS k, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT k AS ticker_code, coalesce(a.name, b.name, c.name) AS name, coalesce(a.cik, c.cik) AS issuer_id FROM w LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)""")
def resolve_names(spark, sf):
    supp = F.col("s_suppkey")
    code = F.format_string("T%d", supp).alias("ticker_code")
    supplier = px.table(spark, sf, "supplier")
    listed = px.constituents(spark, sf).where("index_name = 'sp500'").select(F.col("ticker").alias("ticker_code"), "name", F.col("cik").alias("issuer_id"))
    securities = supplier.where("s_suppkey % 3 = 0").select(code, F.concat(F.lit("Sec "), supp.cast("string")).alias("name"), F.lit(None).cast("string").alias("issuer_id"))
    issuers = supplier.where("s_suppkey % 5 <> 0").select(code, F.col("s_name").alias("name"), px.pad(supp).alias("issuer_id"))
    wanted = px.table(spark, sf, "lineitem").select(F.format_string("T%d", "l_suppkey").alias("ticker_code"))
    return px.present(sea.resolve_names(wanted, [listed, securities, issuers]))


def part_names(spark, sf):
    """Dictionary: distinct part descriptions with a ticker each; assets: the same names as filed, some misspelled."""
    part = px.table(spark, sf, "part")
    full = F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", " "))
    dictionary = sea.name_dictionary(part.select(full.alias("name"), F.concat(F.lit("P"), F.regexp_replace("p_brand", "[^0-9]", "")).alias("ticker")))
    line = px.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    number = F.col("l_linenumber")
    filed = (F.when(number == 1, F.concat(full, F.lit(" Inc."))).when(number == 2, F.regexp_replace(full, "e", "")).when(number == 3, F.concat(full, F.lit("s Common Stock")))
             .when(number == 4, F.regexp_replace(full, "^(.)(.)", "$2$1")).otherwise(full))
    return line.select(filed.alias("asset_name")), dictionary


@query("match_names_exact", """
WITH d AS (SELECT upper(concat_ws(' ', p_name, p_type, replace(p_brand, '#', ' '))) AS k, min('P' || regexp_replace(p_brand, '[^0-9]', '', 'g')) AS a, max('P' || regexp_replace(p_brand, '[^0-9]', '', 'g')) AS b FROM part GROUP BY 1),
n AS (SELECT DISTINCT concat_ws(' ', p_name, p_type, replace(p_brand, '#', ' ')) AS asset_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT asset_name, a AS ticker FROM n JOIN d ON d.k = upper(asset_name) WHERE a = b""")
def match_names_exact(spark, sf):
    part = px.table(spark, sf, "part")
    _, dictionary = part_names(spark, sf)
    full = F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", " "))
    names = px.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(full.alias("asset_name"))
    return px.present(sea.match_names(names, dictionary).where("origin = 'local_exact'").select("asset_name", "ticker"))


def _longest_block(al: str, ah: str, bl: str, bh: str) -> str:
    """The longest run that a[al, ah) and b[bl, bh) have in common, as (-length, place in a, place in b): the first such one."""
    room = f"least({ah} - i, {bh} - j)"
    run = f"coalesce(list_min(list_filter(range(0, {room}), lambda k: substr(a, i + k, 1) <> substr(b, j + k, 1))), {room})"
    return f"list_min(flatten(list_transform(range({al}, {ah}), lambda i: list_transform(range({bl}, {bh}), lambda j: {{'n': -{run}, 'i': i, 'j': j}}))))"


# Names as filed and their comparable forms; the ratio of matching blocks by recursion: the longest block, then what lies left and right of it.
MATCHED = f"""
WITH RECURSIVE p AS (SELECT concat_ws(' ', p_name, p_type, replace(p_brand, '#', ' ')) AS name, concat_ws(' ', p_name, p_type, regexp_replace(p_brand, '#.*', '')) AS head, regexp_replace(p_brand, '[^0-9]', '', 'g') AS num, p_partkey FROM part),
d AS (SELECT upper(name) AS k, min('P' || num) AS lo, max('P' || num) AS hi FROM p GROUP BY 1),
f AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN name || ' Inc.' WHEN 2 THEN replace(name, 'e', '') WHEN 3 THEN name || 's Common Stock' WHEN 4 THEN substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3) ELSE name END AS asset_name,
  upper(CASE l_linenumber WHEN 2 THEN replace(name, 'e', '') WHEN 3 THEN head || ' ' || translate(num, '50', 'SO') || 'S' WHEN 4 THEN substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3) ELSE name END) AS key
  FROM lineitem JOIN p ON l_partkey = p_partkey),
ex AS (SELECT DISTINCT key, CASE WHEN lo = hi THEN lo END AS ticker, 'local_exact' AS origin FROM f JOIN d ON d.k = key),
re AS (SELECT DISTINCT key FROM f WHERE key NOT IN (SELECT k FROM d) AND length(key) >= 6),
pa AS (SELECT key AS a, k AS b FROM re JOIN d ON 2.0 * least(length(key), length(k)) > 0.94 * (length(key) + length(k)) AND levenshtein(key, k) < 0.06 * (length(key) + length(k))),
seg AS (SELECT a, b, 1 AS al, length(a) + 1 AS ah, 1 AS bl, length(b) + 1 AS bh, {_longest_block("1", "length(a) + 1", "1", "length(b) + 1")} AS m FROM pa
  UNION ALL SELECT a, b, al, ah, bl, bh, {_longest_block("al", "ah", "bl", "bh")} FROM (
    SELECT a, b, unnest([al, m.i - m.n]) AS al, unnest([m.i, ah]) AS ah, unnest([bl, m.j - m.n]) AS bl, unnest([m.j, bh]) AS bh FROM seg WHERE m.n < 0) WHERE al < ah AND bl < bh),
sc AS (SELECT a, b, 2.0 * sum(-m.n) / (length(a) + length(b)) AS ratio FROM seg GROUP BY a, b),
inf AS (SELECT a AS key, min(lo) AS ticker, 'inferred' AS origin FROM sc JOIN d ON k = b WHERE ratio > 0.94 GROUP BY a HAVING min(lo) = max(hi)),
fo AS (SELECT * FROM ex WHERE ticker IS NOT NULL UNION ALL SELECT * FROM inf)
"""


@query("match_names", MATCHED + "SELECT asset_name, key AS name_key, ticker, origin FROM f LEFT JOIN fo USING (key)")
def match_names(spark, sf):
    return px.present(sea.match_names(*part_names(spark, sf)))


@query("match_assets", MATCHED + """
, r AS (SELECT DISTINCT asset_name, key, length(asset_name) % 5 AS v FROM f),
t AS (SELECT asset_name, v, ticker, origin, ['stock', 'bond', 'unknown', 'fund', 'stock'][v + 1] AS kind FROM r LEFT JOIN fo USING (key)),
u AS (SELECT asset_name || CASE WHEN kind = 'bond' THEN ' 4.5% Notes due 2030' ELSE '' END AS asset_name, v, kind, CASE WHEN v = 4 THEN 'OWN' END AS own, ticker AS tk, origin AS og, CASE WHEN kind = 'bond' THEN 'issuer' WHEN v IN (0, 2) THEN 'name' ELSE 'none' END AS lookup FROM t)
SELECT asset_name, lookup, CASE WHEN lookup = 'name' THEN tk ELSE own END AS ticker, CASE WHEN lookup = 'name' AND tk IS NOT NULL THEN 'stock' ELSE kind END AS asset_type, CASE WHEN lookup = 'issuer' THEN tk END AS issuer_ticker,
  CASE WHEN lookup = 'issuer' THEN og END AS issuer_ticker_origin, CASE WHEN lookup = 'name' THEN og END AS ticker_origin, CASE WHEN kind <> 'unknown' THEN '' WHEN tk IS NULL THEN 'unknown_asset_type' ELSE '' END AS warnings,
  CASE WHEN kind <> 'unknown' THEN 'parsed' WHEN tk IS NULL THEN 'review' ELSE 'parsed' END AS confidence FROM u""")
def match_assets(spark, sf):
    names, dictionary = part_names(spark, sf)
    v = F.length("asset_name") % 5
    kind = F.element_at(F.array(*[F.lit(k) for k in ("stock", "bond", "unknown", "fund", "stock")]), v + 1)
    unknown = kind == "unknown"
    # read twice below; what is decided about a name would be pushed through the distinct to every line
    rows = checkpoint(names.distinct()).select(
        F.concat("asset_name", F.when(kind == "bond", " 4.5% Notes due 2030").otherwise("")).alias("asset_name"), kind.alias("asset_type"), F.when(v == 4, "OWN").alias("ticker"),
        F.when(unknown, F.array(F.lit("unknown_asset_type"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(unknown, "review").otherwise("parsed").alias("confidence"))
    return px.present(sea.match_assets(rows, dictionary).select("asset_name", "lookup", "ticker", "asset_type", "issuer_ticker", "issuer_ticker_origin", "ticker_origin", "warnings", "confidence"))


# --- scalar functions -------------------------------------------------------------


@query("normalize_name", """
SELECT p_partkey AS part, trim(regexp_replace(upper(replace(p_name, 'o', '')) || ' WIDGETS', ' +', ' ', 'g')) AS name_key FROM part""")
def normalize_name(spark, sf):
    name = F.concat(F.regexp_replace("p_name", "o", ""), F.lit(" Widget5, Inc. Common Stock [ST]"))
    return px.present(px.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), T.normalize_name(name).alias("name_key")))


@query("identifiers", """
SELECT s_suppkey AS supplier, CASE WHEN s_suppkey > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || '-01-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS accession,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS parsed_cik FROM supplier""")
def identifiers(spark, sf):
    supp = F.col("s_suppkey").cast("string")
    compact = F.concat(F.lpad(supp, 10, "0"), F.lit("01"), F.lpad(supp, 6, "0"))
    dashed = F.concat(F.lpad(supp, 10, "0"), F.lit("-01-"), F.lpad(supp, 6, "0"))
    key = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("sec:"), T.cik(supp))).otherwise(F.concat(F.lit("house:|"), supp))
    return px.present(px.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier"), T.cik(supp).alias("cik"), T.accession(F.concat(F.lit("edgar/"), compact, F.lit("/"), dashed, F.lit(".txt"))).alias("accession"),
        T.parse_person_key(key)["cik"].alias("parsed_cik")))


@query("disclosure_scalars", """
WITH b AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_partkey % 8 AS k, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT id, ['purchase', 'sale', 'partial_sale', 'exchange', 'purchase', 'sale', 'unknown', 'unknown'][k + 1] AS direction, ['purchase', 'sale', 'partial_sale', 'exchange', 'purchase', 'sale', 'purchase', 'unknown'][k + 1] AS ocr_direction,
  CASE WHEN d >= DATE '2000-01-01' THEN strftime(d, '%Y-%m-%d') END AS day, CAST(CAST(CASE q % 3 WHEN 0 THEN q * 1000 + 1 WHEN 1 THEN q * 1000 + 1 ELSE q END AS DECIMAL(38,2)) AS VARCHAR) AS low,
  CAST(CAST(CASE q % 3 WHEN 0 THEN q * 2000 WHEN 2 THEN q END AS DECIMAL(38,2)) AS VARCHAR) AS high FROM b""")
def disclosure_scalars(spark, sf):
    k, q = F.col("l_partkey") % 8, F.col("l_quantity").cast("long")
    words = F.element_at(F.array(*[F.lit(w) for w in ("P", "Sale (Full)", "S (partial)", "Exchange", "Bought", "sold", "Purchose", "zzz")]), (k + 1).cast("int"))
    amount = (F.when(q % 3 == 0, F.concat(F.lit("$"), F.format_number(q * 1000 + 1, 0), F.lit(" - $"), F.format_number(q * 2000, 0)))
              .when(q % 3 == 1, F.concat(F.lit("Over $"), F.format_number(q * 1000, 0))).otherwise(F.concat(F.lit("$"), q.cast("string"))))
    low, high = D.money(amount)
    return shown(px.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), D.direction(words).alias("direction"), D.ocr_direction(words).alias("ocr_direction"),
        D.date(F.concat(F.lit("Filed "), F.date_format("l_shipdate", "M/d/yyyy"), F.lit("."))).alias("day"), low.alias("low"), high.alias("high")), "low", "high")


@query("display_rounding", """
SELECT o_orderkey AS "order", CAST(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS VARCHAR) AS money, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey // 2 AS VARCHAR) ELSE CAST(o_orderkey // 2 AS VARCHAR) || '.5' END AS shares, round((o_orderkey % 100) / 1000.0 * 100, 4) AS basis_points,
  datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS lag_days FROM orders""")
def display_rounding(spark, sf):
    key = F.col("o_orderkey")
    return px.present(px.table(spark, sf, "orders").select(
        key.alias("order"), T.money_text(F.col("o_totalprice").cast("decimal(18,4)")).alias("money"), T.shares_text((key.cast("decimal(18,6)") / 2).cast("decimal(18,6)")).alias("shares"),
        T.basis_points((key % 100) / 1000).alias("basis_points"), F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("lag_days")))


@query("roles", """
SELECT c_custkey AS customer, ['president', 'vice_president', 'attorney_general', 'secretary.commerce', 'administrator.epa', 'official'][c_custkey % 6 + 1] AS executive_role,
  ['ceo', 'cfo', 'officer,director', 'ten_percent', 'ceo,other', ''][c_custkey % 6 + 1] AS filer_roles, ['yes', 'no', 'unknown'][c_custkey % 3 + 1] AS plan FROM customer""")
def roles(spark, sf):
    key = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    position = pick(("President", "Vice President Smith", "Attorney General", "Secretary (Commerce)", "Administrator (Environmental Protection Agency)", "Chief of Staff"))
    title, officer = pick(("Chief Executive Officer", "CFO", "Treasurer", "", "co-CEO", "")), pick(("1", "true", "1", "0", "1", "0"))
    people = px.table(spark, sf, "customer").select(
        key.alias("customer"), T.executive_role(position).alias("executive_role"),
        T.filer_roles(officer, title, pick(("0", "0", "1", "0", "0", "0")), pick(("0", "0", "0", "1", "0", "0")), pick(("0", "0", "0", "0", "1", "0"))).alias("filer_roles"),
        pick((True, False, None)).alias("_flag"))
    flags = people.groupBy("customer", "executive_role", "filer_roles").agg(T.plan_answer(F.col("_flag")).alias("plan"))
    return px.present(flags)


@query("detect_amendment", """
SELECT doc_id, doc_id % 4 IN (1, 2) AS amended, CASE WHEN doc_id % 4 = 2 THEN lpad(CAST(doc_id AS VARCHAR), 8, '2') END AS original_id FROM documents""")
def detect_amendment(spark, sf):
    key = F.col("doc_id")
    header = (F.when(key % 4 == 1, "Filing Status: Amended ").when(key % 4 == 2, F.concat(F.lit("This is an amendment to  filing ID #"), F.lpad(key.cast("string"), 8, "2"), F.lit(" ")))
              .when(key % 4 == 3, "[ ] Amendment ").otherwise(""))
    amended, original = D.amendment_of(F.concat(header, F.lit("\n"), "text"))
    return px.present(px.table(spark, sf, "documents").select("doc_id", amended.alias("amended"), original.alias("original_id")))
