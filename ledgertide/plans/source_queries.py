"""Source and sink queries: documents are built from the tables by Spark, then read by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ledgertide.operators import calendar as cal
from ledgertide.plans import proxies as px
from ledgertide.plans.calendar_queries import exchange_sql, local_of
from ledgertide.plans.event_queries import WINDOWED, studied
from ledgertide.plans.insider_queries import contexts, shown
from ledgertide.plans.market_queries import MONTHS, YEARS, candle_sql
from ledgertide.plans.registry import ORACLES, QUERIES, query
from ledgertide.sources import disclosures as dis
from ledgertide.sources import event_lists as evl
from ledgertide.sources import exports as exp
from ledgertide.sources import filings as fil
from ledgertide.sources import market as mkt


def accession(key, year="01"):
    return F.concat(px.pad(key), F.lit(f"-{year}-"), F.lpad((key % 1000000).cast("string"), 6, "0"))


ACC = "lpad(CAST({k} AS VARCHAR), 10, '0') || '-01-' || lpad(CAST({k} % 1000000 AS VARCHAR), 6, '0')"


def pick(values, c):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def index_lines(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey") + 1
    day = F.when(key % 53 == 0, "2001-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = F.concat(F.lit("edgar/data/"), cust.cast("string"), F.lit("/"), accession(key), F.lit(".txt"))
    line = F.concat_ws("|", cust.cast("string"), F.concat(F.lit("Customer "), cust.cast("string")), pick(("4", "4/A", "10-K", "3", "4A"), key), day, path)
    return px.spread(px.table(spark, sf, "orders")).select(F.when(key % 59 == 0, F.concat(line, F.lit("|x"))).otherwise(line).alias("value"))


@query("read_master_index", f"""
WITH o AS (SELECT *, ['4', '4/A', NULL, '3', '4/A'][o_orderkey % 5 + 1] AS form FROM orders WHERE o_orderkey % 53 <> 0 AND o_orderkey % 59 <> 0)
SELECT {ACC.format(k='o_orderkey')} AS accession, form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, lpad(CAST(o_custkey + 1 AS VARCHAR), 10, '0') AS entity_cik FROM o WHERE form IS NOT NULL""")
def read_master_index(spark, sf):
    return px.present(fil.read_master_index(index_lines(spark, sf))[0].select("accession", "form", "filing_date", "entity_cik"))


@query("rejected_index_lines", """
SELECT CASE WHEN o_orderkey % 59 = 0 THEN 'malformed_master_index_row' ELSE 'invalid_master_index_date_or_path' END AS reason, count(*) AS lines FROM orders WHERE o_orderkey % 59 = 0 OR (o_orderkey % 53 = 0 AND o_orderkey % 5 <> 2) GROUP BY 1""")
def rejected_index_lines(spark, sf):
    return px.present(fil.read_master_index(index_lines(spark, sf))[1].groupBy("reason").agg(F.count("*").alias("lines")))


@query("read_latest_feed", f"""
SELECT {ACC.format(k='event_id')} AS accession, ['4', '4/A', NULL][event_id % 3 + 1] AS form, lpad(CAST(user_id + 1 AS VARCHAR), 10, '0') AS entity_cik, CASE event_id % 2 WHEN 0 THEN 'Issuer' ELSE 'Reporting' END AS role,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS accepted_at, strftime(ts, '%Y-%m-%d') AS filing_date FROM events WHERE event_id % 3 < 2""")
def read_latest_feed(spark, sf):
    key, who = F.col("event_id"), (F.col("user_id") + 1).cast("string")
    form = pick(("4", "4/A", "8-K"), key)
    xml = F.concat(F.lit("<feed><entry><title>"), form, F.lit(" - User "), who, F.lit(" ("), px.pad(who), F.lit(") ("), pick(("Issuer", "Reporting"), key), F.lit(")</title><id>urn:tag:sec.gov,2008:accession-number="),
                   accession(key), F.lit('</id><updated>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z</updated><category term="'), form, F.lit('"/><link rel="alternate" href="https://www.sec.gov/Archives/edgar/data/'), who,
                   F.lit("/"), accession(key), F.lit('-index.htm"/><summary type="html">&lt;b&gt;Filed:&lt;/b&gt; '), F.date_format("ts", "yyyy-MM-dd"), F.lit("</summary></entry></feed>"))
    rows = fil.read_latest_feed(px.table(spark, sf, "events").select(xml.alias("value")))
    return px.present(rows.select("accession", "form", "entity_cik", "role", "accepted_at", "filing_date"))


@query("read_submissions", f"""
SELECT lpad(CAST(o_custkey + 1 AS VARCHAR), 10, '0') AS entity_cik, {ACC.format(k='o_orderkey')} AS accession, CASE n % 2 WHEN 0 THEN '4' ELSE '5/A' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, strftime(o_orderdate + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M:%S') AS accepted_at
FROM (SELECT *, unnest([0, 1, 2]) AS n FROM orders) WHERE n < 2 AND o_orderkey % 10 <> 0""")
def read_submissions(spark, sf):
    key = F.col("o_orderkey")
    listed = lambda *v: F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), x, F.lit('"')) for x in v]), F.lit("]"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    dates = F.when(key % 10 == 0, listed(day, day)).otherwise(listed(day, day, day))
    stamp = F.concat(day, F.lit("T15:00:00.000Z"))
    payload = F.concat(F.lit('{"cik":"'), (F.col("o_custkey") + 1).cast("string"), F.lit('","filings":{"recent":{"accessionNumber":'), listed(accession(key), accession(key), accession(key)),
                       F.lit(',"form":'), listed(F.lit("4"), F.lit("5/A"), F.lit("10-Q")), F.lit(',"filingDate":'), dates, F.lit(',"acceptanceDateTime":'), listed(stamp, stamp, stamp),
                       F.lit(',"primaryDocument":'), listed(F.lit("a.xml"), F.lit("b.xml"), F.lit("c.htm")), F.lit("}}}"))
    return px.present(fil.read_submissions(px.spread(px.table(spark, sf, "orders")).select(payload.alias("value")))[0].drop("document"))


@query("read_company_tickers", """
SELECT lpad(CAST(s_suppkey + 1 AS VARCHAR), 10, '0') AS cik, s_name AS name, 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'NYSE' END AS exchange FROM supplier""")
def read_company_tickers(spark, sf):
    key = F.col("s_suppkey")
    number, ticker = (key + 1).cast("string"), F.format_string("T%d", key)
    tabular = F.concat(F.lit('{"fields":["cik","name","ticker","exchange"],"data":[["'), number, F.lit('","'), F.col("s_name"), F.lit('","'), ticker, F.lit('","NYSE"]]}'))
    mapped = F.concat(F.lit('{"0":{"cik_str":'), number, F.lit(',"ticker":"'), ticker, F.lit('","title":"'), F.col("s_name"), F.lit('"}}'))
    return px.present(fil.read_company_tickers(px.table(spark, sf, "supplier").select(F.when(key % 2 == 0, tabular).otherwise(mapped).alias("value"))))


@query("read_entity_search", """
SELECT 1 AS position, lpad(CAST(c_custkey + 1 AS VARCHAR), 10, '0') AS cik, c_name AS name, 'A' || c_custkey || ',B' || c_custkey AS tickers FROM customer UNION ALL SELECT 2, lpad(CAST(c_custkey + 2 AS VARCHAR), 10, '0'), 'Other', '' FROM customer""")
def read_entity_search(spark, sf):
    key = F.col("c_custkey")
    hit = lambda k, name, tickers: F.concat(F.lit('{"_id":"'), (key + k).cast("string"), F.lit('","_source":{"entity":"'), name, F.lit('","tickers":"'), tickers, F.lit('"}}'))
    both = F.concat(F.lit("A"), key.cast("string"), F.lit(", B"), key.cast("string"))
    payload = F.concat(F.lit('{"hits":{"hits":['), hit(1, F.col("c_name"), both), F.lit(","), hit(2, F.lit("Other "), F.lit("")), F.lit(","), hit(3, F.lit("Third"), F.lit("")), F.lit("]}}"))
    return px.present(fil.read_entity_search(px.table(spark, sf, "customer").select(payload.alias("value")), 2))


def submission_text(spark, sf):
    """Full submissions: a header, an exhibit and an ownership document per order."""
    key = F.col("o_orderkey")
    wall = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((key % 24).cast("string"), 2, "0"), F.lit("3000"))
    xml = ownership_xml()
    body = F.concat(F.lit("<SEC-DOCUMENT>\n<SEC-HEADER>\nACCESSION NUMBER:\t"), accession(key), F.lit("\nCONFORMED SUBMISSION TYPE:\t4\nFILED AS OF DATE:\t"), F.date_format("o_orderdate", "yyyyMMdd"),
                    F.lit("\n<ACCEPTANCE-DATETIME>"), wall, F.lit("\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>EX-24\n<TEXT>power of attorney</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>4\n<FILENAME>a.xml\n<TEXT>\n<XML>\n"), xml, F.lit("\n</XML>\n</TEXT>\n</DOCUMENT>"))
    twice = F.concat(body, F.lit("<DOCUMENT><TYPE>4\n<TEXT>"), xml, F.lit("</TEXT></DOCUMENT>"))
    return px.spread(px.table(spark, sf, "orders")).select(F.when(key % 20 == 0, twice).otherwise(body).alias("value"))


def ownership_xml():
    """An ownership document: a transaction, a holding and a derivative row, two owners, a footnote.

    One in ten documents each: no direction, unreadable shares, a derivative row in the wrong table, no issuer number, a footnote id
    twice, an unreadable date.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    value = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c, F.lit(f"</value></{tag}>"))
    amounts = lambda shares, price, way: F.concat(F.lit("<transactionAmounts>"), value("transactionShares", shares), price, way, F.lit("</transactionAmounts>"))
    direction = lambda c: value("transactionAcquiredDisposedCode", F.lit(c))
    only = lambda n, c, other="": F.when(key % 10 == n, c).otherwise(other)
    code = pick(("P", "S", "M"), key)
    owner = lambda c: F.concat(F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>"), c, F.lit("</rptOwnerCik><rptOwnerName>N</rptOwnerName></reportingOwnerId></reportingOwner>"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.concat(F.lit("<transactionPricePerShare><value>"), (cust % 90 + 10).cast("string"), F.lit(".25</value></transactionPricePerShare>"))
    return F.concat(
        F.lit('<?xml version="1.0"?><ownershipDocument><documentType>4</documentType><periodOfReport>'), day, F.lit("</periodOfReport><aff10b5One>0</aff10b5One><issuer>"),
        F.when(key % 10 != 3, F.concat(F.lit("<issuerCik>"), (cust + 1).cast("string"), F.lit("</issuerCik>"))).otherwise(""), F.lit("<issuerName>I</issuerName><issuerTradingSymbol>DEMO</issuerTradingSymbol></issuer>"),
        owner((cust + 2).cast("string")), owner((cust + 3).cast("string")),
        F.lit("<nonDerivativeTable><nonDerivativeHolding>"), value("securityTitle", F.lit("Class B")), F.lit("<ownershipNature>"), value("directOrIndirectOwnership", F.lit("I")), value("natureOfOwnership", F.lit("By Trust")),
        F.lit("</ownershipNature></nonDerivativeHolding>"), only(2, "<derivativeTransaction><securityTitle><value>Odd</value></securityTitle></derivativeTransaction>"),
        F.lit("<nonDerivativeTransaction>"), value("securityTitle", F.lit("Common Stock")), value("transactionDate", day), F.when(key % 2 == 0, value("deemedExecutionDate", day)).otherwise(""),
        F.lit("<transactionCoding><transactionFormType>4</transactionFormType><transactionCode>"), code, F.lit("</transactionCode></transactionCoding>"),
        amounts(only(1, "x12", (key % 1000).cast("string")), price, only(0, "", direction("A"))), F.lit("</nonDerivativeTransaction></nonDerivativeTable><derivativeTable><derivativeTransaction>"), value("securityTitle", F.lit("Option")),
        F.lit("<transactionCoding><transactionCode>M</transactionCode></transactionCoding>"), amounts(F.lit("5"), F.lit("<transactionPricePerShare><footnoteId id='F1'/></transactionPricePerShare>"), direction("D")),
        value("exerciseDate", day), value("expirationDate", only(5, "soon", day)), F.lit("<underlyingSecurity>"), value("underlyingSecurityTitle", F.lit("Common Stock")), value("underlyingSecurityShares", F.lit("7")), F.lit("</underlyingSecurity>"),
        F.lit('</derivativeTransaction></derivativeTable><footnotes><footnote id="F1">note</footnote>'), only(4, '<footnote id="F1">again</footnote>'), F.lit("</footnotes></ownershipDocument>"))


@query("read_submission_text", f"""
WITH o AS (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + INTERVAL 30 MINUTE AS w FROM orders), u AS (SELECT *, timezone('UTC', timezone('America/New_York', w)) AS u FROM o)
SELECT {ACC.format(k='o_orderkey')} AS accession, '4' AS form, CASE WHEN {local_of("u")} = w AND {local_of("u + INTERVAL 1 HOUR")} <> w AND {local_of("u - INTERVAL 1 HOUR")} <> w THEN strftime(u, '%Y-%m-%d %H:%M:%S') END AS accepted_at,
  strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CASE WHEN o_orderkey % 20 = 0 THEN 'ownership_document_missing_or_ambiguous' END AS reason, o_orderkey % 20 <> 0 AS has_document FROM u""")
def read_submission_text(spark, sf):
    rows = fil.read_submission_text(submission_text(spark, sf))
    return px.present(rows.select("accession", "form", "accepted_at", "filing_date", "reason", F.col("xml").isNotNull().alias("has_document")))


@query("parse_ownership", """
WITH o AS (SELECT o_orderkey AS k, *, ['P', 'S', 'M'][o_orderkey % 3 + 1] AS c, o_orderkey % 10 AS v, strftime(o_orderdate, '%Y-%m-%d') AS day,
  lpad(CAST(o_custkey + 2 AS VARCHAR), 10, '0') || ',' || lpad(CAST(o_custkey + 3 AS VARCHAR), 10, '0') AS owners FROM orders)
SELECT k AS filing, 'I' AS table_no, CAST(CASE WHEN i = 2 AND v = 2 THEN 3 ELSE i END AS BIGINT) AS source_row_index, CASE i WHEN 1 THEN 'holding' ELSE 'transaction' END AS row_kind,
  CASE WHEN i = 1 THEN 'holding' WHEN v = 0 OR c = 'S' THEN 'needs_review' WHEN c = 'P' THEN 'purchase_market_or_private' ELSE 'exercise_or_conversion' END AS action_category, CASE i WHEN 1 THEN 'Class B' ELSE 'Common Stock' END AS security_title,
  CASE i WHEN 2 THEN day END AS transaction_date, CASE WHEN i = 2 AND k % 2 = 0 THEN day END AS deemed_execution_date, CASE i WHEN 2 THEN '4' END AS transaction_form_type,
  CASE WHEN i = 2 AND v <> 1 THEN CAST(k % 1000 AS DOUBLE) END AS shares, CASE i WHEN 2 THEN CAST(o_custkey % 90 AS DOUBLE) + 10.25 END AS price,
  NULL AS exercise_date, NULL AS expiration_date, NULL AS underlying_title, CASE i WHEN 1 THEN 'By Trust' END AS nature_of_ownership, owners AS owner_ids,
  CASE WHEN i = 1 THEN '' ELSE concat_ws(',', CASE WHEN v = 0 THEN 'incomplete_transaction_coding' END, CASE WHEN c = 'S' OR (c = 'P' AND v = 0) THEN 'code_direction_conflict' END, CASE WHEN v = 1 THEN 'invalid_number:shares' END) END AS warnings,
  '' AS footnote_ids FROM (SELECT *, unnest([1, 2]) AS i FROM o)
UNION ALL SELECT k, 'II', 1, 'transaction', 'exercise_or_conversion', 'Option', NULL, NULL, NULL, 5, NULL, day, CASE WHEN v <> 5 THEN day END, 'Common Stock', NULL, owners, CASE WHEN v = 5 THEN 'invalid_date:expiration_date' ELSE '' END, 'F1' FROM o""")
def parse_ownership(spark, sf):
    docs = px.spread(px.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("filing"), ownership_xml().alias("xml"))
    rows = fil.parse_ownership(docs, "xml", "filing")
    return px.present(rows.select("filing", "table_no", "source_row_index", "row_kind", "action_category", "security_title", "transaction_date", "deemed_execution_date", "transaction_form_type", "shares", "price",
                                  "exercise_date", "expiration_date", "underlying_title", "nature_of_ownership", "owner_ids", "warnings", "footnote_ids"))


@query("ownership_warnings", """
SELECT o_orderkey AS filing, CASE o_orderkey % 10 WHEN 2 THEN 'unrecognized_table_child:I:2' WHEN 3 THEN 'missing_or_invalid_issuer_cik' ELSE 'duplicate_or_missing_footnote_id' END AS warning FROM orders WHERE o_orderkey % 10 IN (2, 3, 4)""")
def ownership_warnings(spark, sf):
    docs = px.spread(px.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("filing"), ownership_xml().alias("xml"))
    return px.present(fil.ownership_warnings(docs, "xml", "filing"))


@query("read_filing_index", """
SELECT s_suppkey AS page, '2024-03-01 18:05:00' AS accepted_at, '2024-03-01' AS filing_date, '/a/' || s_suppkey || '/form4.xml' AS document_urls FROM supplier""")
def read_filing_index(spark, sf):
    key = F.col("s_suppkey").cast("string")
    html = F.concat(F.lit("<html><div>Filing Date</div><div>2024-03-01</div><div>Accepted</div><div>2024-03-01 13:05:00</div><table><tr><td>1</td><td>doc</td><td><a href='/a/"), key,
                    F.lit("/xslF345X05/form4.xml'>form4.html</a></td><td>4</td></tr><tr><td>2</td><td>graphic</td><td><a href='/a/"), key, F.lit("/x.xml'>x</a></td><td>GRAPHIC</td></tr></table></html>"))
    rows = fil.read_filing_index(px.table(spark, sf, "supplier").select(key.alias("page"), html.alias("html")), "page", "html")
    return px.present(rows.select(F.col("accession").cast("long").alias("page"), "accepted_at", "filing_date", "document_urls"))


@query("read_constituents_csv", """
SELECT 'T' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '-B' ELSE '' END AS ticker, s_name AS name, 'Energy' AS industry, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_suppkey % 6 <> 0""")
def read_constituents_csv(spark, sf):
    key = F.col("s_suppkey")
    rows = px.table(spark, sf, "supplier").select(
        F.when(key % 4 == 0, F.format_string("t%d.b", key)).otherwise(F.format_string("T%d", key)).alias("Symbol"), F.col("s_name").alias("Security"), F.lit(" Energy ").alias("GICS Sector"),
        F.when(key % 6 == 0, "").otherwise(key.cast("string")).alias("CIK"))
    return px.present(mkt.read_constituents_csv(rows)[0].select("ticker", "name", "industry", "cik"))


@query("read_html_table", """
SELECT s_suppkey AS page, replace('T' || s_suppkey || '.B', '.', '-') AS ticker, s_name AS name, 'Sector ' || (s_nationkey % 5) AS industry FROM supplier UNION ALL SELECT s_suppkey, 'Z1', 'Second & Co', 'Other' FROM supplier""")
def read_html_table(spark, sf):
    key = F.col("s_suppkey").cast("string")
    html = F.concat(F.lit("<table><tr><th>Year</th><th>Note</th></tr><tr><td>1</td><td>x</td></tr></table><table><thead><tr><th>#</th><th>Company</th><th>Ticker<sup>[1]</sup></th><th>ICB Industry</th></tr></thead><tr><td>1</td><td>"),
                    F.col("s_name"), F.lit("</td><td>T"), key, F.lit(".B</td><td>Sector "), (F.col("s_nationkey") % 5).cast("string"), F.lit("</td></tr><tr><td>2</td><td>Second &amp; Co</td><td>z1</td><td>Other</td></tr></table>"))
    rows = mkt.read_component_table(px.table(spark, sf, "supplier").select(key.alias("page"), html.alias("html")), "page", "html")
    return px.present(rows.select(F.col("page_key").cast("long").alias("page"), "ticker", "name", "industry"))


@query("html_links", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*"')) AS t FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT t) AS targets FROM a GROUP BY 1""")
def html_links(spark, sf):
    links = fil.html_links(px.table(spark, sf, "pages"), "page_id", "html")
    return px.present(links.groupBy(F.col("page_key").cast("long").alias("page_id")).agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets")))


@query("read_disclosure_index", """
SELECT CAST(10000000 + c_custkey AS VARCHAR) AS external_id, c_name || ' Smith' || CASE WHEN c_custkey % 4 = 0 THEN ' Jr' ELSE '' END AS name, 'CA' || lpad(CAST(c_custkey % 50 AS VARCHAR), 2, '0') AS district, strftime(DATE '2025-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS filed_date
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 17 <> 0""")
def read_disclosure_index(spark, sf):
    key = F.col("c_custkey")
    rows = px.table(spark, sf, "customer").select(
        F.lit("Hon.").alias("Prefix"), F.lit(" Smith ").alias("Last"), F.col("c_name").alias("First"), F.when(key % 4 == 0, "Jr").alias("Suffix"), F.when(key % 3 == 0, "C").otherwise("P").alias("FilingType"),
        F.concat(F.lit("CA"), F.lpad((key % 50).cast("string"), 2, "0")).alias("StateDst"), F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (key % 300).cast("int")), "M/d/yyyy").alias("FilingDate"),
        F.when(key % 17 == 0, "x1").otherwise((key + 10000000).cast("string")).alias("DocID"))
    return px.present(dis.read_disclosure_index(rows, 2025)[0].select("external_id", "name", "district", "filed_date"))


@query("read_disclosure_links", """
SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'vice_president' ELSE 'president' END AS position, 'Jane Q Doe' AS name, strftime(DATE '2025-02-01' + CAST(page_id % 200 AS INTEGER), '%Y-%m-%d') AS document_date,
  CASE WHEN page_id % 3 = 0 THEN 'unresolved' ELSE 'original' END AS amendment_status, 2 AS document_part FROM pages""")
def read_disclosure_links(spark, sf):
    key = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2025-02-01").cast("date"), (key % 200).cast("int")), "MM.dd.yyyy")
    anchor = F.concat(F.lit("<a href='/reports/"), key.cast("string"), F.lit(".pdf'>"), F.when(key % 2 == 0, "Vice President").otherwise("President"), F.lit(" Doe, Jane Q. - Periodic Transaction Report "), day,
                      F.lit(" (2)"), F.when(key % 3 == 0, " Amended").otherwise(""), F.lit("</a>"))
    pages = px.table(spark, sf, "pages").select("page_id", F.concat("html", anchor).alias("html"))
    rows = dis.read_disclosure_links(pages, "page_id", "html")
    return px.present(rows.select(F.col("page_key").cast("long").alias("page_id"), "position", "name", "document_date", "amendment_status", "document_part"))


def report_pages(spark, sf):
    """Report text: the whole document text around two trade lines, one with a wrapped asset."""
    key = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int")), "MM/dd/yyyy")
    # Prose is broken after every digit-free run, so only the two stated lines hold dates or amounts.
    prose = F.regexp_replace(F.regexp_replace("text", r"[\d$()\[\]]", ""), r"(?i)\b(?:DESCRIPTION|COMMENT)", "")
    body = F.concat(F.lit("Periodic Transaction Report\n"), prose, F.lit("\nSP Acme Holdings Common Stock (ACM) [ST]\nP "), day, F.lit(" "), day, F.lit(" $1,001 - $15,000\n2. JT Beta Corp Call (BTA) [OP] S (partial) "), day, F.lit(" "), day, F.lit(" Over $1,000,000\nPage 1 of 2"))
    return px.spread(px.table(spark, sf, "documents")).select("doc_id", body.alias("body"))


@query("parse_disclosure_rows", """
WITH d AS (SELECT doc_id, strftime(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER), '%Y-%m-%d') AS day FROM documents)
SELECT doc_id, 1 AS row_number, 'unknown' AS owner, 'SP Acme Holdings Common Stock (ACM) [ST]' AS asset_name, 'ACM' AS ticker, 'stock' AS asset_type, 'purchase' AS transaction_type, day AS transaction_date, '1001.00' AS amount_low, '15000.00' AS amount_high, 'unknown_owner' AS warnings FROM d
UNION ALL SELECT doc_id, 2, 'joint', 'Beta Corp Call (BTA) [OP]', 'BTA', 'option', 'partial_sale', day, '1000001.00', NULL, 'incomplete_option' FROM d""")
def parse_disclosure_rows(spark, sf):
    rows = dis.parse_disclosure_rows(report_pages(spark, sf), ["doc_id"], "body")
    return shown(rows.select("doc_id", "row_number", "owner", "asset_name", "ticker", "asset_type", "transaction_type", "transaction_date", "amount_low", "amount_high", "warnings"), "amount_low", "amount_high")


@query("read_report_tables", """
SELECT s_suppkey AS page, 'joint' AS owner, 'S' || s_suppkey AS ticker, s_name AS asset_name, 'stock' AS asset_type, 'sale' AS transaction_type, '2025-05-01' AS transaction_date, '15001.00' AS amount_low, '' AS warnings FROM supplier
UNION ALL SELECT s_suppkey, 'spouse', NULL, 'Unidentified holding', 'unknown', 'exchange', NULL, '1001.00', 'missing_transaction_date,unknown_asset_type' FROM supplier""")
def read_report_tables(spark, sf):
    key = F.col("s_suppkey").cast("string")
    html = F.concat(F.lit("<table><tr><td>Not a transaction table</td></tr></table><table><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Transaction Type</th><th>Amount</th></tr>"
                          "<tr><td>1</td><td>05/01/2025</td><td>Joint</td><td>S"), key, F.lit("</td><td>"), F.col("s_name"), F.lit("</td><td>Stock</td><td>Sale (Full)</td><td>$15,001 - $50,000</td></tr>"
                          "<tr><td>2</td><td>unreadable</td><td>Spouse</td><td>--</td><td>Unidentified holding</td><td>Other</td><td>Exchange</td><td>$1,001 - $15,000</td></tr></table>"))
    rows = dis.read_report_tables(px.table(spark, sf, "supplier").select(key.alias("page"), html.alias("html")), "page", "html")
    return shown(rows.select(F.col("page_key").cast("long").alias("page"), "owner", "ticker", "asset_name", "asset_type", "transaction_type", "transaction_date", "amount_low", "warnings"), "amount_low")


@query("read_price_records", px.with_ctes(px.PX) + """
SELECT symbol, strftime(d, '%Y-%m-%d') AS session_date, CAST(CAST(floor(c * 100) / 100 AS DECIMAL(18,2)) AS VARCHAR) AS close, CASE WHEN day(d) % 5 <> 0 THEN CAST(CAST(2 AS DECIMAL(18,2)) AS VARCHAR) END AS splits FROM px WHERE symbol <> '^ALL'""")
def read_price_records(spark, sf):
    rows = px.bars(spark, sf, with_index=False)
    text = lambda c: F.concat(F.lit('"'), (F.floor(F.col(c) * 100) / 100).cast("decimal(18,2)").cast("string"), F.lit('"'))
    payload = F.concat(F.lit('{"symbol":"'), F.col("symbol"), F.lit('","provider":"p","records":[{"date":"'), F.col("session_date").cast("string"), F.lit('","open":'), text("open"), F.lit(',"close":'), text("close"),
                       F.lit(',"splits":'), F.when(F.day("session_date") % 5 == 0, F.lit('"nan"')).otherwise(F.lit('"2"')), F.lit("}]}"))
    bars = mkt.read_price_records(rows.select(payload.alias("value")))
    return shown(bars.select("symbol", "session_date", "close", "splits"), "close", "splits")


@query("read_quotes", px.with_ctes(exchange_sql(2023, 2024)) + f""",
e AS (SELECT event_id, value, date_trunc('second', ts) AS f, {local_of("ts")} AS lt FROM events),
p AS (SELECT e.*, CASE WHEN xs.d IS NULL THEN 'closed' WHEN lt >= xs.d + INTERVAL '9 hours 30 minutes' AND lt < xs.d + to_hours(close_hour) THEN 'regular' WHEN lt >= xs.d + INTERVAL '4 hours' AND lt < xs.d + INTERVAL '9 hours 30 minutes' THEN 'pre'
    WHEN lt >= xs.d + to_hours(close_hour) AND lt < xs.d + INTERVAL '20 hours' THEN 'post' ELSE 'closed' END AS ph FROM (SELECT event_id, value, f, date_trunc('second', lt) AS lt FROM e) e LEFT JOIN xs ON xs.d = CAST(lt AS DATE))
SELECT event_id AS symbol, CASE WHEN ph = 'post' THEN value + 1 ELSE value END AS value, ph AS market_phase, CASE WHEN ph = 'post' THEN 'post' ELSE 'regular' END AS price_session,
  CASE WHEN ph = 'closed' THEN 'CLOSED' WHEN ph = 'post' THEN 'LIVE' WHEN event_id % 2 = 0 THEN 'STALE' ELSE 'LIVE' END AS quote_status FROM p WHERE event_id % 7 <> 0
UNION ALL SELECT event_id, NULL, ph, 'regular', 'NOT_FETCHED' FROM p WHERE event_id % 7 = 0""")
def read_quotes(spark, sf):
    key, at = F.col("event_id"), F.unix_timestamp(F.col("ts").cast("timestamp"))
    number = lambda c: c.cast("string")
    payload = F.concat(F.lit('{"symbol":"'), number(key), F.lit('","regularMarketPrice":'), F.when(key % 7 == 0, "-1").otherwise(number(F.col("value"))), F.lit(',"regularMarketTime":'), number(at - F.when(key % 2 == 0, 1800).otherwise(60)),
                       F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(',"postMarketPrice":'), number(F.col("value") + 1), F.lit(',"postMarketTime":'), number(at - 30))),
                       F.lit(',"fetched_at":"'), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd HH:mm:ss"), F.lit('"}'))
    quotes = mkt.read_quotes(px.table(spark, sf, "events").select(payload.alias("value")), cal.exchange_sessions(spark, 2023, 2024))
    return px.present(quotes.select(F.col("symbol").cast("long").alias("symbol"), "value", "market_phase", "price_session", "quote_status"), exact=("value",))


@query("quote_freshness", """
WITH q AS (SELECT event_id, ts, ts + INTERVAL 1 HOUR * (event_id % 5 - 2) AS rt, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'delayed' WHEN k = 5 THEN 'delayed' WHEN rt >= ts - INTERVAL 90 MINUTE AND rt < ts + INTERVAL 90 MINUTE THEN
  CASE WHEN k = 2 THEN 'delayed' WHEN epoch(rt) - epoch(ts) > 600 THEN 'delayed' ELSE 'live' END WHEN rt >= ts + INTERVAL 90 MINUTE THEN 'delayed' ELSE 'closed' END AS freshness FROM q""")
def quote_freshness(spark, sf):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    at = ts + F.make_dt_interval(hours=(F.col("event_id") % 5 - 2).cast("int"))
    timed = k != 5
    rows = px.table(spark, sf, "events").select(
        "event_id", ts.alias("ts"), F.when(k != 0, F.col("value")).alias("value"), ts.alias("fetched_at"), F.when(k == 2, "STALE").when(k == 5, "DAILY").otherwise("LIVE").alias("quote_status"),
        (ts + F.expr("INTERVAL 5 MINUTES")).alias("next_refresh_at"), F.when(timed, ts - F.expr("INTERVAL 90 MINUTES")).alias("session_start"), F.when(timed, ts + F.expr("INTERVAL 90 MINUTES")).alias("session_end"),
        F.when(k == 1, ts + F.expr("INTERVAL 1 MINUTE")).alias("failed_at"), at.alias("at"))
    return px.present(mkt.quote_freshness(rows, F.col("at")).select("event_id", "freshness"))


@query("quote_display", "SELECT event_id, round((value - 200) * 100, 4) AS change_bp FROM events")
def quote_display(spark, sf):
    from ledgertide.functions.text import basis_points

    return px.present(px.table(spark, sf, "events").select("event_id", basis_points(F.col("value") - 200).alias("change_bp")))


@query("read_event_list", """
WITH c AS (SELECT o_orderkey AS list, o_orderkey % 10 AS k FROM orders)
SELECT list, 1 AS item, CASE k WHEN 0 THEN 'ticker' WHEN 1 THEN 'date' WHEN 2 THEN 'session' WHEN 3 THEN 'fiscal_quarter' WHEN 4 THEN 'earnings' WHEN 5 THEN 'uncertain' END AS field, CASE k WHEN 5 THEN 'warning' ELSE 'error' END AS level,
  CASE k WHEN 0 THEN 'ticker_invalid' WHEN 1 THEN 'date_invalid' WHEN 2 THEN 'session_invalid' WHEN 3 THEN 'fiscal_quarter_invalid' WHEN 4 THEN 'revenue_negative' WHEN 5 THEN 'uncertain' END AS code FROM c WHERE k < 6
UNION ALL SELECT list, 2, 'item', 'error', 'duplicate_event' FROM c WHERE k = 6 UNION ALL SELECT list, 2, 'fiscal_quarter', 'error', 'duplicate_quarter' FROM c WHERE k IN (6, 7)
UNION ALL SELECT list, 1, 'context', 'warning', 'source_missing' FROM c WHERE k = 8 UNION ALL SELECT list, 1, 'context', 'warning', 'url_missing' FROM c WHERE k = 8 UNION ALL SELECT list, 1, 'context', 'warning', 'context_outside' FROM c WHERE k = 8""")
def read_event_list(spark, sf):
    return px.present(evl.check_events(event_items(spark, sf), "list", "earnings", (30, 14))[1])


@query("checked_events", """
SELECT o_orderkey AS list, CAST(i AS BIGINT) AS item, 'ABC' AS ticker, strftime(o_orderdate, '%Y-%m-%d') AS event_date, CAST(i AS BIGINT) AS fiscal_quarter FROM (SELECT *, unnest([1, 2]) AS i FROM orders) WHERE o_orderkey % 10 IN (5, 8, 9)""")
def checked_events(spark, sf):
    events = evl.check_events(event_items(spark, sf), "list", "earnings", (30, 14))[0]
    return px.present(events.select("list", "item", "ticker", "event_date", "fiscal_quarter"))


def event_items(spark, sf):
    """Two-item event lists, one per order, each with one kind of defect or none."""
    key = F.col("o_orderkey")
    k, day = key % 10, F.date_format("o_orderdate", "yyyy-MM-dd")
    context = F.when(k == 8, F.lit(',"context":[{"date":"2030-01-01","category":"macro","title":"t"}]')).otherwise("")
    first = F.concat(F.lit('{"ticker":"'), F.when(k == 0, "a b").otherwise("abc"), F.lit('","date":"'), F.when(k == 1, "2001-02-30").otherwise(day), F.lit('","session":"'), F.when(k == 2, "noon").otherwise("during"),
                     F.lit('","name":"First","fiscal_year":2000,"fiscal_quarter":'), F.when(k == 3, "5").otherwise("1"), F.lit(',"earnings":{"revenue_actual":'), F.when(k == 4, "-1").otherwise("1"), F.lit("}"),
                     F.when(k == 5, ',"uncertain":true').otherwise(""), context, F.lit("}"))
    second = F.concat(F.lit('{"ticker":"ABC","date":"'), day, F.lit('","session":"unknown","name":"'), F.when(k == 6, "FIRST").otherwise("Second"), F.lit('","fiscal_year":2000,"fiscal_quarter":'), F.when(k.isin(6, 7), "1").otherwise("2"), F.lit("}"))
    body = F.concat(F.lit('{"events":['), first, F.lit(","), second, F.lit("]}"))
    return evl.read_event_list(px.spread(px.table(spark, sf, "orders")).select(key.alias("list"), body.alias("value")), "list")


@query("read_config_dims", """
WITH n AS (SELECT n_name AS id, r_name AS sector, 'S' || r_regionkey AS sector_etf, CASE WHEN n_nationkey % 6 <> 5 THEN 'P' || (n_nationkey % 23) END AS prim, CASE WHEN n_nationkey % 6 = 5 AND n_nationkey % 4 <> 3 THEN 'pending' WHEN n_nationkey % 9 = 0 THEN 'weak' ELSE 'partial' END AS cov FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT DISTINCT sector_etf AS etf, sector FROM n UNION ALL SELECT prim, id FROM n WHERE prim IS NOT NULL)
SELECT 'etf_repeated' AS problem, etf AS item FROM e GROUP BY etf HAVING count(*) > 1 UNION ALL SELECT 'coverage_unknown', id FROM n WHERE cov = 'weak' UNION ALL SELECT 'primary_and_pending', id FROM n WHERE (cov = 'pending') <> (prim IS NULL)""")
def read_config_dims(spark, sf):
    key = F.col("n_nationkey")
    dims = px.table(spark, sf, "nation").join(px.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("sector"), F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("sector_etf"), F.col("n_name").alias("id"),
        F.when(key % 6 != 5, F.concat(F.lit("P"), (key % 23).cast("string"))).alias("primary"), F.array().cast("array<string>").alias("alternates"),
        F.when((key % 6 == 5) & (key % 4 != 3), "pending").when(key % 9 == 0, "weak").otherwise("partial").alias("coverage"))
    return px.present(mkt.check_sector_dims(dims))


@query("config_sub_industries", """
WITH g AS (SELECT n_name AS id FROM nation), s AS (SELECT DISTINCT CASE WHEN p_partkey % 29 < 22 THEN n_name ELSE 'X' || (p_partkey % 29) END AS industry_group, p_brand || ' ' || (p_partkey % 9) AS sub_industry
  FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 29)
SELECT DISTINCT 'group_unknown' AS problem, industry_group AS item FROM s WHERE industry_group NOT IN (SELECT id FROM g) UNION ALL SELECT 'group_empty', id FROM g WHERE id NOT IN (SELECT industry_group FROM s)
UNION ALL SELECT 'sub_industry_repeated', sub_industry FROM s GROUP BY 2 HAVING count(*) > 1""")
def config_sub_industries(spark, sf):
    groups = px.table(spark, sf, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("k"))
    part = px.table(spark, sf, "part").withColumn("k", F.col("p_partkey") % 29)
    subs = part.join(groups, "k", "left").select(F.when(F.col("k") < 22, F.col("id")).otherwise(F.concat(F.lit("X"), F.col("k").cast("string"))).alias("industry_group"),
                                                 F.concat("p_brand", F.lit(" "), (F.col("p_partkey") % 9).cast("string")).alias("sub_industry")).distinct()
    return px.present(mkt.check_sub_industries(groups.select("id"), subs))


@query("config_aliases", """
WITH a AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN ' ' ELSE 'Name ' || (s_suppkey % 60) END AS alias, CASE s_suppkey % 7 WHEN 0 THEN [] WHEN 1 THEN ['T' || s_suppkey, 'T' || s_suppkey] WHEN 2 THEN ['bad code'] WHEN 3 THEN ['Z' || s_suppkey] ELSE ['T' || s_suppkey] END AS codes FROM supplier),
f AS (SELECT *, lower(trim(alias)) AS fo FROM a), c AS (SELECT alias, unnest(codes) AS code FROM a), b AS (SELECT code FROM c WHERE NOT regexp_matches(code, '^[A-Z0-9]{1,6}(-[A-Z0-9]{1,2})?$'))
SELECT DISTINCT 'alias_blank' AS problem, alias AS item FROM f WHERE fo = '' UNION ALL SELECT 'alias_repeated', fo FROM f GROUP BY fo HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'codes_missing', alias FROM f WHERE len(codes) = 0
UNION ALL SELECT DISTINCT 'code_repeated', alias FROM f WHERE len(codes) <> len(list_distinct(codes)) UNION ALL SELECT DISTINCT 'code_malformed', code FROM b
UNION ALL SELECT DISTINCT 'code_unknown', code FROM c WHERE code NOT IN (SELECT 'T' || s_suppkey FROM supplier) AND code NOT IN (SELECT code FROM b)""")
def config_aliases(spark, sf):
    key = F.col("s_suppkey")
    code = lambda letter: F.concat(F.lit(letter), key.cast("string"))
    codes = (F.when(key % 7 == 0, F.array().cast("array<string>")).when(key % 7 == 1, F.array(code("T"), code("T"))).when(key % 7 == 2, F.array(F.lit("bad code")))
             .when(key % 7 == 3, F.array(code("Z"))).otherwise(F.array(code("T"))))
    aliases = px.table(spark, sf, "supplier").select(F.when(key % 13 == 0, " ").otherwise(F.concat(F.lit("Name "), (key % 60).cast("string"))).alias("alias"), codes.alias("codes"))
    return px.present(mkt.check_aliases(aliases, px.table(spark, sf, "supplier").select(code("T").alias("ticker"))))


@query("config_people", """
WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'sec' WHEN 1 THEN 'house' WHEN 2 THEN 'oge' ELSE 'blog' END AS source, CASE WHEN c_custkey % 11 = 0 THEN 'x1' ELSE CAST(c_custkey + 1 AS VARCHAR) END AS cik,
  CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'Person ' || (c_custkey % 400) END AS name, CASE WHEN c_custkey % 19 = 0 THEN 'CA' ELSE 'CA11' END AS district, CASE WHEN c_custkey % 23 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN 'Head|Deputy' ELSE 'Secretary' END AS position FROM customer),
q AS (SELECT *, CASE WHEN source = 'blog' THEN 'source_unknown' WHEN source = 'sec' AND cik = 'x1' THEN 'cik_invalid' WHEN source <> 'sec' AND trim(name) = '' THEN 'name_missing' WHEN source = 'oge' AND position = '' THEN 'detail_missing'
  WHEN source = 'oge' AND contains(position, '|') THEN 'separator_in_text' END AS broken FROM p),
r AS (SELECT *, CASE source WHEN 'sec' THEN 'sec:' || lpad(cik, 10, '0') WHEN 'house' THEN 'house:' || name || '|' || district ELSE 'oge:' || name || '|' || position END AS key FROM q WHERE broken IS NULL)
SELECT broken AS problem, name AS item FROM q WHERE broken IS NOT NULL UNION ALL SELECT 'district_malformed', name FROM r WHERE source = 'house' AND district = 'CA' UNION ALL SELECT 'name_missing', name FROM r WHERE source = 'sec' AND trim(name) = ''
UNION ALL SELECT 'category_unknown', name FROM r WHERE k % 29 = 0 UNION ALL SELECT 'note_missing', name FROM r WHERE k % 31 = 0 UNION ALL SELECT 'listed_twice', key FROM r GROUP BY key HAVING count(*) > 1""")
def config_people(spark, sf):
    key = F.col("c_custkey")
    people = px.table(spark, sf, "customer").select(
        F.element_at(F.array(*[F.lit(x) for x in ("sec", "house", "oge", "blog")]), (key % 4 + 1).cast("int")).alias("source"), F.when(key % 11 == 0, "x1").otherwise((key + 1).cast("string")).alias("cik"),
        F.when(key % 17 == 0, " ").otherwise(F.concat(F.lit("Person "), (key % 400).cast("string"))).alias("name"), F.when(key % 19 == 0, "CA").otherwise("CA11").alias("district"),
        F.when(key % 23 == 0, "").when(key % 6 == 0, "Head|Deputy").otherwise("Secretary").alias("position"),
        F.when(key % 29 == 0, "other").otherwise("cabinet").alias("category"), F.lit("note").alias("note_en"), F.when(key % 31 == 0, " ").otherwise("note").alias("note_zh"), "c_custkey")
    return px.present(mkt.check_people(people))


# --- sinks: written by the tasks, then read back ----------------------------------


def folder() -> str:
    return tempfile.mkdtemp(prefix="ledgertide-export-")


def shared_folder(spark) -> str:
    """A new folder next to the checkpoints the cluster shares, or a temporary one in local runs."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base}/export-{uuid.uuid4().hex}" if base else folder()


@query("export_study_csv", candle_sql(MONTHS) + """
SELECT symbol, period, year AS year, status FROM (SELECT symbol, CAST(period AS BIGINT) AS period, CAST(y AS BIGINT) AS year, status FROM cd)""")
def export_study_csv(spark, sf):
    from ledgertide.operators import seasonality as season

    m = px.market(spark, sf)
    candles = season.period_candles(m.bars, m.sessions, season.periods("monthly", px.CUTOFF, YEARS), px.CUTOFF, m.benchmark)
    path = shared_folder(spark)
    exp.write_csv(exp.study_table(candles, candles, "detail"), path)
    back = spark.read.csv(path, header=True)
    return px.present(back.select("symbol", F.col("period").cast("long").alias("period"), F.col("year").cast("long").alias("year"), "status"))


@query("export_events_csv", WINDOWED + """
SELECT event_pos, ticker, round(max(value) FILTER (WHERE wname = 'reaction'), 6) AS reaction, round(max(value - bench) FILTER (WHERE wname = 'after'), 6) AS after_excess FROM ew GROUP BY 1, 2""")
def export_events_csv(spark, sf):
    path = shared_folder(spark)
    exp.write_csv(exp.event_table(studied(spark, sf)[0], None, "detail"), path)
    back = spark.read.csv(path, header=True)
    return px.present(back.select(F.col("event_pos").cast("long").alias("event_pos"), "ticker", F.col("reaction").cast("double").alias("reaction"), F.col("after_excess").cast("double").alias("after_excess")))


@query("export_trade_context", """
SELECT basis, measure, count(*) AS points FROM lineitem CROSS JOIN (SELECT unnest(['transaction', 'disclosure']) AS basis) CROSS JOIN (SELECT unnest(['before_n', 'after_n', 'pre_5', 'day_1', 'day_5']) AS measure) GROUP BY 1, 2""")
def export_trade_context(spark, sf):
    path = shared_folder(spark)
    exp.write_json(exp.context_points(contexts(spark, sf)[0]), path)
    back = spark.read.schema("id string, basis string, measure string, value double").json(path)
    return px.present(back.groupBy("basis", "measure").agg(F.count("*").alias("points")))


def written_and_read(rows, path, table):
    """The rows of a statistics table after they were written as CSV and read back in the types they had."""
    exp.write_csv(table(rows), path)
    return rows.sparkSession.read.schema(rows.schema).csv(path, header=True)


@query("export_study_stats", ORACLES["seasonality_monthly"])
def export_study_stats(spark, sf):
    return written_and_read(QUERIES["seasonality_monthly"](spark, sf), shared_folder(spark), lambda rows: exp.study_table(rows, rows, "stats"))


@query("export_events_stats", ORACLES["window_stats"])
def export_events_stats(spark, sf):
    return written_and_read(QUERIES["window_stats"](spark, sf), shared_folder(spark), lambda rows: exp.event_table(rows, rows, "stats"))


@query("export_context_csv", f"""
WITH x AS ({ORACLES["trade_context"]}), v AS (SELECT id, 'disclosure' AS basis, 'after_n' AS measure, disclosure_after_n AS value FROM x UNION ALL SELECT id, 'transaction', 'day_1', transaction_day_1 FROM x)
SELECT id, basis, measure, value FROM v""")
def export_context_csv(spark, sf):
    """Trade contexts as CSV, with their values: those of the two measures that the SQL of a trade's context states."""
    path = shared_folder(spark)
    exp.write_csv(exp.context_points(contexts(spark, sf)[0]), path)
    back = spark.read.schema("id string, basis string, measure string, value double").csv(path, header=True)
    return px.present(back.where("(basis = 'disclosure' AND measure = 'after_n') OR (basis = 'transaction' AND measure = 'day_1')"))
