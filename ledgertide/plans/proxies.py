"""The domain tables derived from the shared TPC-H-like tables, in Spark and as SQL fragments.

Every query works on whole tables: symbols, issuers, owners, filings, disclosures and events are
expressions over lineitem, orders, supplier, customer, part and events.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators import calendar as cal
from ledgertide.operators import trades as trd
from ledgertide.session import checkpoint

CUTOFF = "2001-06-29"
AT = "2001-11-04"
WINDOW_DAYS = 3000
BENCHMARK = "^ALL"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Short rows dealt out evenly before texts are made of them and parsed, where the scan has fewer splits than the session's shuffle partitions (a small file is one split)."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


# --- presentation -----------------------------------------------------------------


def present(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Plain result types: dates and timestamps as text, numbers as long or rounded double, arrays joined.

    ``exact`` columns are doubles both engines compute identically, so they are not rounded.
    """
    columns = []
    for field in df.schema.fields:
        kind, c = field.dataType.simpleString(), F.col(field.name)
        if field.name in exact:
            pass
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal") or kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "array<date>" or kind == "array<string>":
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        elif kind in ("array<double>", "array<float>"):
            c = F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)), ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def pad(c: Column, width: int = 10) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def unit_price() -> Column:
    """Price of a line item at four places; floor is the same double operation in every engine."""
    return F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000) / 10000


# --- bars and calendar ------------------------------------------------------------


def bars(spark: SparkSession, sf: str, with_index: bool = True) -> DataFrame:
    """(symbol, session_date, open, high, low, close, volume, status); the index is built from the symbol bars."""
    line = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("session_date"), unit_price().alias("p"),
        "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "p")
    daily = line.groupBy("symbol", "session_date").agg(
        F.min(order).alias("_first"), F.max(order).alias("_last"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.sum("l_quantity").alias("volume"))
    if with_index:
        daily = checkpoint(daily)  # read twice from here on
        index = daily.groupBy("session_date").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.sum("volume").alias("volume")).withColumn("symbol", F.lit(BENCHMARK))
        daily = daily.unionByName(index)
    return daily.select("symbol", "session_date", F.col("_first.p").alias("open"), "high", "low",
                        F.col("_last.p").alias("close"), "volume", F.lit("VALID").alias("status"))


class Market(NamedTuple):
    bars: DataFrame
    sessions: DataFrame
    spine: DataFrame
    benchmark: DataFrame


def market(spark: SparkSession, sf: str) -> Market:
    """Bars, sessions and spine for queries that read them more than once.

    They are small next to the line items (one row per symbol and day), so they are checkpointed
    once per query instead of being aggregated again in every branch of its plan.
    """
    rows = checkpoint(bars(spark, sf))
    days = checkpoint(cal.observed_sessions(rows))
    return Market(rows, days, checkpoint(cal.date_spine(days)), rows.where(F.col("symbol") == BENCHMARK))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The observed calendar: weekdays with at least one row."""
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("session_date"))
    return cal.observed_sessions(days)


PX = """
base AS (SELECT 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d, l_orderkey AS k1,
    l_linenumber AS k2, l_partkey AS k3, floor(l_extendedprice / l_quantity * 10000) / 10000 AS p, l_quantity AS q FROM lineitem),
px AS (
  SELECT symbol, d, first(p ORDER BY k1, k2, k3, p) AS o, max(p) AS h, min(p) AS l, last(p ORDER BY k1, k2, k3, p) AS c,
    sum(q) AS v FROM base GROUP BY symbol, d
  UNION ALL
  SELECT '^ALL', d, first(p ORDER BY k1, k2, k3, p), max(p), min(p), last(p ORDER BY k1, k2, k3, p), sum(q)
  FROM base GROUP BY d),
ses AS (SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS no
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) WHERE isodow(d) < 6),
spine AS (SELECT g.d AS d, CAST(count(s.d) OVER (ORDER BY g.d) AS INTEGER) AS prev_incl,
    CAST(count(s.d) OVER (ORDER BY g.d) AS INTEGER) - (s.d IS NOT NULL)::INTEGER AS prev_excl,
    CAST(count(s.d) OVER (ORDER BY g.d) AS INTEGER) - (s.d IS NOT NULL)::INTEGER + 1 AS next_incl,
    CAST(count(s.d) OVER (ORDER BY g.d) AS INTEGER) + 1 AS next_excl
  FROM (SELECT CAST(unnest(generate_series((SELECT min(d) - 40 FROM ses)::TIMESTAMP, (SELECT max(d) + 40 FROM ses)::TIMESTAMP,
        INTERVAL 1 DAY)) AS DATE) AS d) g LEFT JOIN ses s ON s.d = g.d)
"""


# --- insider side -----------------------------------------------------------------


def trades(spark: SparkSession, sf: str, people: DataFrame | None = None, by_filing: bool = False) -> DataFrame:
    """Insider trades: one row per line item of an order; see TRADES for the same definition in SQL.

    With ``people`` (person_id), those of filings that name any of them, which is decided on the orders, by the key that the line items meet them with.
    With ``by_filing``, line items and orders meet by accession, so that the trades of a filing lie together and are grouped without another shuffle.
    """
    owner, second = pad(F.col("o_custkey")), pad(F.col("o_custkey") + 1)
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").withColumn("owner_ids", F.when(F.col("o_orderkey") % 5 == 0, F.array(owner, second)).otherwise(F.array(owner)))
    if people is not None:
        orders = trd.join_owner_array(orders, people.select(F.col("person_id").alias("owner_id")), key="o_orderkey")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey)
    if by_filing:
        named = [t.withColumn(f"_{k}", F.concat(F.lit("A"), pad(F.col(k)))) for t, k in ((line, "l_orderkey"), (orders, "o_orderkey"))]
        # keys may share an accession, so both are compared; a difference is no key to the planner, which lays out rows by the accession alone
        rows = named[0].join(named[1], F.expr("_l_orderkey = _o_orderkey AND l_orderkey - o_orderkey = 0"))
    key, supp, part = F.col("o_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    price = unit_price() * F.when(part % 29 == 0, 12).otherwise(1)
    accepted = F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + (key * 37) % 1440 * 60)
    priority = F.col("o_orderpriority")
    number = F.col("l_linenumber")
    rows = rows.select(
        F.concat_ws("-", key, number, part, supp).alias("id"), pad(supp).alias("issuer_id"),
        F.col("_o_orderkey").alias("accession") if by_filing else F.concat(F.lit("A"), pad(key)).alias("accession"),
        F.concat(F.lit("A"), pad(key), F.lit(":v1")).alias("version_id"),
        F.concat(F.when(number == 7, "II").otherwise("I"), F.lit(":transaction:"), F.concat_ws("-", number, part, supp)).alias("row_key"),
        F.to_date("o_orderdate").alias("transaction_date"), accepted.alias("accepted_at"),
        F.when(F.round(F.col("l_tax"), 2) == 0.08, "NEEDS_REVIEW").otherwise("CURRENT").alias("status"),
        F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M").alias("code"),
        F.when(F.col("l_returnflag") == "A", "A").otherwise("D").alias("direction"),
        F.when(number == 7, "II").otherwise("I").alias("table_no"),
        F.when(part % 11 == 0, "Common Shares (2330.TW)").otherwise("Common Stock").alias("security_title"),
        F.when(number == 5, "CAD").when(number != 6, "USD").alias("currency"),
        F.col("l_quantity").cast("decimal(18,6)").alias("shares"),
        F.when(F.round(F.col("l_discount"), 2) != 0.10, price.cast("decimal(18,6)")).alias("price"),
        F.when(number != 4, (F.col("l_quantity") * (1 + number)).cast("decimal(18,6)")).alias("shares_after"),
        (F.col("l_linestatus") == "F").alias("is_plan"), (priority == "1-URGENT").alias("is_ceo"),
        (priority == "2-HIGH").alias("is_cfo"), (priority == "3-MEDIUM").alias("is_president"),
        ((priority == "4-NOT SPECIFIED") & (key % 2 == 0)).alias("is_chair"),
        (priority == "4-NOT SPECIFIED").alias("is_director"), (priority == "5-LOW").alias("is_ten_percent"),
        "owner_ids",
        F.when(key % 3 == 0, F.concat(F.lit("T"), supp.cast("string"), F.lit(".A"))).alias("filing_ticker"),
        F.concat(F.lit("S"), (supp % 8).cast("string")).alias("symbol"),
        F.lit(None).cast("decimal(18,6)").alias("range_low"), F.lit(None).cast("decimal(18,6)").alias("range_high"),
        (key % 40 != 0).alias("visible"), F.when(key % 9 == 0, "4/A").otherwise("4").alias("form"))
    return rows.withColumn("amount", F.col("price") * F.col("shares"))


TRADES = """
tr AS (SELECT concat_ws('-', o_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS issuer_id, 'A' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession,
    CAST(o_orderdate AS DATE) AS td, l_shipdate + to_minutes(CAST((o_orderkey * 37) % 1440 AS BIGINT)) AS accepted_at,
    CAST(timezone('America/New_York', timezone('UTC', l_shipdate + to_minutes(CAST((o_orderkey * 37) % 1440 AS BIGINT)))) AS DATE) AS ad,
    CASE WHEN round(l_tax, 2) = 0.08 THEN 'NEEDS_REVIEW' ELSE 'CURRENT' END AS status,
    CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code,
    CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'D' END AS direction,
    CASE WHEN l_linenumber = 7 THEN 'II' ELSE 'I' END AS table_no,
    CASE WHEN l_partkey % 11 = 0 THEN 'Common Shares (2330.TW)' ELSE 'Common Stock' END AS security_title,
    CASE WHEN l_linenumber = 5 THEN 'CAD' WHEN l_linenumber <> 6 THEN 'USD' END AS currency,
    CAST(l_quantity AS DECIMAL(19,6)) AS shares,
    CASE WHEN round(l_discount, 2) <> 0.10 THEN CAST(floor(l_extendedprice / l_quantity * 10000) / 10000 * CASE WHEN l_partkey % 29 = 0 THEN 12 ELSE 1 END
        AS DECIMAL(19,6)) END AS price,
    CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity * (1 + l_linenumber) AS DECIMAL(19,6)) END AS shares_after,
    l_linestatus = 'F' AS is_plan, o_orderpriority = '1-URGENT' AS is_ceo, o_orderpriority = '2-HIGH' AS is_cfo,
    o_orderpriority = '3-MEDIUM' AS is_president, o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0 AS is_chair,
    o_orderpriority = '4-NOT SPECIFIED' AS is_director, o_orderpriority = '5-LOW' AS is_ten_percent,
    CASE WHEN o_orderkey % 5 = 0 THEN [lpad(CAST(o_custkey AS VARCHAR), 10, '0'), lpad(CAST(o_custkey + 1 AS VARCHAR), 10, '0')]
        ELSE [lpad(CAST(o_custkey AS VARCHAR), 10, '0')] END AS owner_ids,
    CASE WHEN o_orderkey % 3 = 0 THEN 'T' || CAST(l_suppkey AS VARCHAR) || '.A' END AS filing_ticker,
    'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol, o_orderkey % 40 <> 0 AS visible,
    CASE WHEN o_orderkey % 9 = 0 THEN '4/A' ELSE '4' END AS form, l_linenumber, o_orderkey, l_suppkey, l_partkey, o_custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def issuers(spark: SparkSession, sf: str) -> DataFrame:
    supp = F.col("s_suppkey")
    ticker = F.when(supp % 10 == 0, F.format_string("T%d, T%d.B", supp, supp)).otherwise(F.format_string("T%d", supp))
    return table(spark, sf, "supplier").select(
        pad(supp).alias("issuer_id"), F.col("s_name").alias("name"), ticker.alias("issuer_ticker"), "s_nationkey", "s_suppkey")


ISSUERS = """
iss AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS issuer_id, s_name AS name, s_suppkey, s_nationkey,
    CASE WHEN s_suppkey % 10 = 0 THEN 'T' || s_suppkey || ', T' || s_suppkey || '.B' ELSE 'T' || s_suppkey END AS issuer_ticker
  FROM supplier)
"""


def constituents(spark: SparkSession, sf: str) -> DataFrame:
    """Index lists: even suppliers are sp500 members (every third without a CIK), the rest nasdaq100."""
    supplier, nation, region = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    supp = F.col("s_suppkey")
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.when(supp % 2 == 0, "sp500").otherwise("nasdaq100").alias("index_name"),
                    F.format_string("T%d", supp).alias("ticker"), F.when(supp % 3 != 0, pad(supp)).alias("cik"),
                    F.col("s_name").alias("name"), F.col("r_name").alias("industry"), F.col("n_name").alias("sub_industry")))


CONSTITUENTS = """
con AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'sp500' ELSE 'nasdaq100' END AS index_name, 'T' || s_suppkey AS ticker,
    CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik, s_name AS name,
    r_name AS industry, n_name AS sub_industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def owners(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(pad(F.col("c_custkey")).alias("owner_id"), F.col("c_name").alias("owner_name"))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The newest observation of each symbol from the event stream."""
    ev = table(spark, sf, "events")
    order = F.struct("ts", "event_id")
    return ev.groupBy(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol")).agg(
        F.max_by("value", order).alias("quote_value"), F.max("ts").alias("source_time"))


QUOTES = """
quo AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, last(value ORDER BY ts, event_id) AS quote_value, max(ts) AS source_time
  FROM events GROUP BY 1)
"""

# --- events -----------------------------------------------------------------------


def study_events(spark: SparkSession, sf: str) -> DataFrame:
    """Dated events: one per order, with figures, guidance and one context item each."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    session = (F.when(key % 4 == 0, "before_open").when(key % 4 == 1, "during").when(key % 4 == 2, "after_close").otherwise("unknown"))
    category = F.element_at(F.array(*[F.lit(c) for c in ("macro", "policy", "company", "geopolitical", "market")]),
                            (cust % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        key.alias("event_pos"), F.concat(F.lit("S"), (cust % 8).cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("event_date"), session.alias("session"),
        F.concat(F.lit("E"), key.cast("string")).alias("name"), F.year("o_orderdate").alias("fiscal_year"),
        F.quarter("o_orderdate").alias("fiscal_quarter"), (key % 100 / 10).cast("double").alias("eps_actual"),
        (cust % 50 / 10).cast("double").alias("eps_estimate"), F.col("o_totalprice").alias("revenue_actual"),
        F.when(key % 7 != 0, F.lit(200000.0)).alias("revenue_estimate"),
        F.when(F.col("o_orderstatus") == "F", "raised").when(F.col("o_orderstatus") == "O", "maintained").alias("guidance"),
        F.concat(F.lit("S"), (cust % 2).cast("string")).alias("sector_symbol"),
        F.array(F.struct(F.date_add(F.to_date("o_orderdate"), (key % 9 - 4).cast("int")).alias("date"),
                         category.alias("category"), (key % 3 == 0).alias("major"))).alias("context"))


EVENTS = """
ev AS (SELECT o_orderkey AS event_pos, 'S' || CAST(o_custkey % 8 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS ed,
    CASE o_orderkey % 4 WHEN 0 THEN 'before_open' WHEN 1 THEN 'during' WHEN 2 THEN 'after_close' ELSE 'unknown' END AS session,
    year(o_orderdate) AS fiscal_year, quarter(o_orderdate) AS fiscal_quarter,
    CAST(o_orderkey % 100 AS DOUBLE) / 10 AS eps_actual, CAST(o_custkey % 50 AS DOUBLE) / 10 AS eps_estimate,
    o_totalprice AS revenue_actual, CASE WHEN o_orderkey % 7 <> 0 THEN 200000.0 END AS revenue_estimate,
    CASE o_orderstatus WHEN 'F' THEN 'raised' WHEN 'O' THEN 'maintained' END AS guidance,
    'S' || CAST(o_custkey % 2 AS VARCHAR) AS sector_symbol,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INTEGER) AS ctx_date,
    ['macro', 'policy', 'company', 'geopolitical', 'market'][o_custkey % 5 + 1] AS ctx_category, o_orderkey % 3 = 0 AS ctx_major
  FROM orders)
"""

# --- disclosures ------------------------------------------------------------------


def disclosure_reports(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("R"), pad(key)).alias("report_id"), pad(cust).alias("person_id"),
        F.when(cust % 3 == 0, "oge").when(cust % 3 == 1, "house").otherwise("senate").alias("source"),
        F.when(key % 17 != 0, F.to_date("o_orderdate")).alias("report_date"),
        F.when(key % 19 != 0, F.date_add(F.to_date("o_orderdate"), 1)).alias("filed_date"),
        F.when(key % 23 == 0, "superseded").when(key % 5 == 0, "review").otherwise("parsed").alias("report_status"),
        F.when(key % 29 == 0, "unresolved").when(key % 11 == 0, "linked").otherwise("original").alias("amendment_status"),
        (key % 4 + 1).alias("page_count"), F.least(key % 4 + 1, key % 6 + 1).alias("pages_done"),
        (key % 2).alias("ocr_pages"), F.when(key % 31 != 0, F.concat(F.lit("h"), (key % 1000).cast("string"))).alias("source_hash"),
        F.to_timestamp("o_orderdate").alias("discovered_at"))


REPORTS = """
rep AS (SELECT 'R' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS report_id, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS person_id,
    CASE o_custkey % 3 WHEN 0 THEN 'oge' WHEN 1 THEN 'house' ELSE 'senate' END AS source,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS report_date,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) + 1 END AS filed_date,
    CASE WHEN o_orderkey % 23 = 0 THEN 'superseded' WHEN o_orderkey % 5 = 0 THEN 'review' ELSE 'parsed' END AS report_status,
    CASE WHEN o_orderkey % 29 = 0 THEN 'unresolved' WHEN o_orderkey % 11 = 0 THEN 'linked' ELSE 'original' END AS amendment_status,
    o_orderkey % 4 + 1 AS page_count, least(o_orderkey % 4 + 1, o_orderkey % 6 + 1) AS pages_done, o_orderkey % 2 AS ocr_pages,
    CASE WHEN o_orderkey % 31 <> 0 THEN 'h' || (o_orderkey % 1000) END AS source_hash,
    CAST(o_orderdate AS TIMESTAMP) AS discovered_at, o_orderkey
  FROM orders)
"""

RANGE_EDGES = ((1001, 15000), (15001, 50000), (50001, 100000), (100001, 250000))


def disclosure_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Disclosed trades: one row per line item, with an official amount range from its price."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    pk, price, number = F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_linenumber")
    low = (F.when(price <= 15000, 1001).when(price <= 50000, 15001).when(price <= 100000, 50001).otherwise(100001))
    high = (F.when(price <= 15000, 15000).when(price <= 50000, 50000).when(price <= 100000, 100000).otherwise(250000))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("stock", "option", "corporate bond", "fund", "unknown")]), (pk % 5 + 1).cast("int"))
    side = F.element_at(F.array(*[F.lit(k) for k in ("purchase", "sale", "partial_sale", "exchange", "unknown")]), (pk % 5 + 1).cast("int"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("R"), pad(F.col("l_orderkey"))).alias("report_id"), F.col("p_name").alias("asset_name"),
        F.when(pk % 7 != 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string"))).alias("ticker"),
        kind.alias("asset_type"), F.when((pk + number) % 5 == (pk % 5), side).otherwise(
            F.when(number % 2 == 0, "sale").otherwise("purchase")).alias("transaction_type"),
        F.when(pk % 37 != 0, F.to_date("l_shipdate")).alias("transaction_date"),
        low.cast("decimal(20,2)").alias("amount_low"),
        F.when(pk % 41 == 0, F.lit(None)).otherwise(high).cast("decimal(20,2)").alias("amount_high"),
        number.alias("page"), pk.alias("row_number"),
        F.when(pk % 13 == 0, F.array(F.lit("ocr"), F.lit("unknown_transaction_type"))).otherwise(
            F.array().cast("array<string>")).alias("warnings"),
        F.when(pk % 13 == 0, "review").otherwise("parsed").alias("confidence"),
        F.when(pk % 6 == 0, "inferred").otherwise("reported").alias("ticker_origin"))


DISCLOSED = """
dt AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    'R' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS report_id, p_name AS asset_name,
    CASE WHEN l_partkey % 7 <> 0 THEN 'S' || CAST(l_suppkey % 8 AS VARCHAR) END AS ticker,
    ['stock', 'option', 'corporate bond', 'fund', 'unknown'][l_partkey % 5 + 1] AS asset_type,
    CASE WHEN (l_partkey + l_linenumber) % 5 = l_partkey % 5 THEN ['purchase', 'sale', 'partial_sale', 'exchange', 'unknown'][l_partkey % 5 + 1]
      WHEN l_linenumber % 2 = 0 THEN 'sale' ELSE 'purchase' END AS transaction_type,
    CASE WHEN l_partkey % 37 <> 0 THEN CAST(l_shipdate AS DATE) END AS td,
    CAST(CASE WHEN l_extendedprice <= 15000 THEN 1001 WHEN l_extendedprice <= 50000 THEN 15001
      WHEN l_extendedprice <= 100000 THEN 50001 ELSE 100001 END AS DECIMAL(20,2)) AS amount_low,
    CAST(CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_extendedprice <= 15000 THEN 15000 WHEN l_extendedprice <= 50000 THEN 50000
      WHEN l_extendedprice <= 100000 THEN 100000 ELSE 250000 END AS DECIMAL(20,2)) AS amount_high,
    l_linenumber AS page, l_partkey AS row_number, l_partkey % 13 = 0 AS warned,
    CASE WHEN l_partkey % 13 = 0 THEN 'review' ELSE 'parsed' END AS confidence,
    CASE WHEN l_partkey % 6 = 0 THEN 'inferred' ELSE 'reported' END AS ticker_origin
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    cust = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        pad(cust).alias("person_id"), F.col("c_name").alias("name"),
        F.when(cust % 3 == 0, "oge").when(cust % 3 == 1, "house").otherwise("senate").alias("source"),
        F.when(cust % 3 == 1, F.concat(F.lit("CA"), F.lpad((cust % 50).cast("string"), 2, "0"))).alias("district"),
        F.when(cust % 3 == 0, F.when(cust % 2 == 0, "Secretary (Commerce)").otherwise("President")).alias("position"))


PEOPLE = """
ppl AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS person_id, c_name AS name,
    CASE c_custkey % 3 WHEN 0 THEN 'oge' WHEN 1 THEN 'house' ELSE 'senate' END AS source,
    CASE WHEN c_custkey % 3 = 1 THEN 'CA' || lpad(CAST(c_custkey % 50 AS VARCHAR), 2, '0') END AS district,
    CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Secretary (Commerce)' ELSE 'President' END END AS position,
    c_acctbal, c_mktsegment
  FROM customer)
"""


def followed(spark: SparkSession, sf: str) -> DataFrame:
    """Followed people: every customer with a positive balance, since a date by segment."""
    since = F.when(F.col("c_mktsegment") == "BUILDING", "1995-06-01 00:00:00").otherwise("1996-01-01 00:00:00")
    return table(spark, sf, "customer").where("c_acctbal > 0").select(
        pad(F.col("c_custkey")).alias("person_id"), since.cast("timestamp").alias("followed_at"))


FOLLOWED = """
fol AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS person_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN TIMESTAMP '1995-06-01' ELSE TIMESTAMP '1996-01-01' END AS followed_at
  FROM customer WHERE c_acctbal > 0)
"""


def with_ctes(*fragments: str) -> str:
    return "WITH " + ",".join(fragment.strip() for fragment in fragments)
