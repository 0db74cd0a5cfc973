"""Market sources: price records, quote snapshots, constituent lists and configuration dims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions import text as T
from ledgertide.operators import calendar as cal
from ledgertide.sources.filings import html_rows, tables_by_header

PRICE_RECORDS = ("symbol STRING, provider STRING, library_version STRING, fetched_at STRING, records ARRAY<STRUCT<date: STRING, open: STRING, high: STRING, low: STRING, "
                 "close: STRING, adj_close: STRING, volume: STRING, dividends: STRING, splits: STRING>>")


def read_price_records(payloads: DataFrame, document: str = "value") -> DataFrame:
    """Bars of provider answers; numbers arrive as text and stay NULL when they are not finite."""
    p = payloads.select(F.from_json(F.col(document), PRICE_RECORDS).alias("p")).select("p.symbol", "p.provider", F.explode("p.records").alias("r"))
    number = lambda c: T.decimal_value(F.col(f"r.{c}")).alias(c)
    return p.select("symbol", "provider", F.try_to_date("r.date", "yyyy-MM-dd").alias("session_date"), *[
        number(c) for c in ("open", "high", "low", "close", "adj_close", "volume", "dividends", "splits")])


QUOTE = ("symbol STRING, regularMarketPrice DOUBLE, regularMarketTime BIGINT, regularMarketPreviousClose DOUBLE, preMarketPrice DOUBLE, preMarketTime BIGINT, "
         "postMarketPrice DOUBLE, postMarketTime BIGINT, currency STRING, fetched_at STRING")


def read_quotes(payloads: DataFrame, sessions: DataFrame, document: str = "value") -> DataFrame:
    """Typed quotes: the extended-hours price when it is newer, else the regular one, with session and staleness.

    LIVE, STALE (older than 20 minutes while the market is open), CLOSED, or NOT_FETCHED without a usable price.
    """
    q = payloads.select(F.from_json(F.col(document), QUOTE).alias("q")).select("q.*").withColumn("fetched_at", F.try_to_timestamp("fetched_at"))
    q = cal.market_phase(q, "fetched_at", sessions)
    at = lambda c: F.timestamp_seconds(F.col(c))
    phase, regular_time = F.col("market_phase"), at("regularMarketTime")
    extra = {side: F.coalesce((phase == side) & F.col(f"{side}MarketPrice").isNotNull() & (at(f"{side}MarketTime") > regular_time), F.lit(False)) for side in ("pre", "post")}
    pick = lambda regular, field: F.when(extra["pre"], field("pre")).when(extra["post"], field("post")).otherwise(regular)
    price = pick(F.col("regularMarketPrice"), lambda s: F.col(f"{s}MarketPrice"))
    quoted = pick(regular_time, lambda s: at(f"{s}MarketTime"))
    rows = q.withColumns({"price_session": F.when(extra["pre"], "pre").when(extra["post"], "post").otherwise("regular"), "_p": price, "_t": quoted})
    valid = F.coalesce((F.col("_p") > 0) & (F.col("_t") <= F.col("fetched_at") + F.expr("INTERVAL 5 MINUTES")), F.lit(False))
    stale = (phase != "closed") & (F.col("fetched_at") > F.col("_t") + F.expr("INTERVAL 20 MINUTES"))
    status = F.when(~valid, "NOT_FETCHED").when(phase == "closed", "CLOSED").when(stale, "STALE").otherwise("LIVE")
    return rows.select("symbol", F.when(valid, F.col("_p")).alias("value"), F.when(valid, F.col("_t")).alias("source_time"), "fetched_at", "price_session", "market_phase",
                       F.col("regularMarketPrice").alias("regular_value"), regular_time.alias("regular_time"),
                       F.when(F.col("regularMarketPreviousClose") > 0, F.col("regularMarketPreviousClose")).alias("previous_close"), status.alias("quote_status"),
                       F.coalesce("currency", F.lit("USD")).alias("currency"))


def quote_freshness(quotes: DataFrame, at: Column) -> DataFrame:
    """live / delayed / closed / missing of saved quotes at a read time.

    ``quotes``: value, fetched_at, quote_status, next_refresh_at, session_start, session_end, failed_at.
    """
    start, end, fetched = F.col("session_start"), F.col("session_end"), F.col("fetched_at")
    interval = F.unix_timestamp("next_refresh_at") - F.unix_timestamp(fetched)
    overdue = F.greatest(F.lit(180), F.when(interval > 0, interval * 2).otherwise(F.lit(180)))
    inside = (start <= at) & (at < end)
    state = (F.when(F.col("value").isNull(), "missing").when(F.col("failed_at") > fetched, "delayed")
             .when(inside & (F.col("quote_status") == "STALE"), "delayed")
             .when(inside & (F.unix_timestamp(at) - F.unix_timestamp(fetched) > overdue), "delayed").when(inside, "live")
             .when((at >= end) & (fetched < end), "delayed").when(start.isNotNull() & end.isNotNull(), "closed")
             .when(F.col("quote_status") == "DAILY", "delayed").otherwise("live"))
    return quotes.withColumn("freshness", state)


def merge_quotes(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored quotes after a response: an older observation never replaces a newer one, and an answer without a
    price keeps the old price as STALE. Both: symbol, value, source_time, as_of, fetched_at, quote_status."""
    old = previous.select(*[F.col(c).alias(f"o_{c}") if c != "symbol" else F.col(c) for c in previous.columns])
    both = incoming.withColumn("_new", F.lit(True)).join(old, "symbol", "full")
    missing = F.col("_new").isNull()
    older = F.coalesce(F.col("source_time") < F.col("o_source_time"), F.lit(False))
    untimed = F.col("source_time").isNull() & F.col("value").isNotNull() & F.coalesce(F.col("as_of") <= F.col("o_as_of"), F.lit(False)) & (
        F.col("o_source_time").isNotNull() | F.coalesce(F.col("as_of") < F.col("o_as_of"), F.lit(False)))
    blank = F.col("value").isNull() & F.col("o_value").isNotNull()
    keep = missing | older | untimed | blank
    columns = [F.when(keep, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "source_time", "as_of", "fetched_at")]
    status = F.when(~missing & blank & ~older & ~untimed, "STALE").when(keep, F.col("o_quote_status")).otherwise(F.col("quote_status"))
    return both.select("symbol", *columns, status.alias("quote_status"))


# --- constituent lists ------------------------------------------------------------


def read_constituents_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, rejected rows) of an S&P 500 CSV with Symbol, Security, GICS Sector, CIK and optionally GICS Sub-Industry."""
    missing = {"Symbol", "Security", "GICS Sector", "CIK"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    sub = F.col("`GICS Sub-Industry`") if "GICS Sub-Industry" in rows.columns else F.lit(None).cast("string")
    parsed = rows.select(
        F.lit("sp500").alias("index_name"), T.ticker_key(F.col("Symbol")).alias("ticker"), F.trim("Security").alias("name"), F.trim("`GICS Sector`").alias("industry"),
        F.trim(sub).alias("sub_industry"), T.cik(F.col("CIK")).alias("cik"))
    valid = F.coalesce((F.col("ticker") != "") & (F.col("name") != "") & (F.col("industry") != "") & F.col("cik").isNotNull(), F.lit(False))
    return parsed.where(valid), parsed.where(~valid)


COMPONENT_COLUMNS = {"ticker": ("ticker", "symbol"), "name": ("company", "security"), "industry": ("icb industry", "gics sector", "gics industry", "industry")}


def read_component_table(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Members of the component table of an index page, found by its column names."""
    rows = tables_by_header(html_rows(pages, key, html), COMPONENT_COLUMNS)
    return rows.select("page_key", T.ticker_key(F.col("ticker")).alias("ticker"), "name", "industry").where("ticker <> ''")


# --- configuration dims -----------------------------------------------------------

# The sectors with their ETF and, per industry group, primary ETF, alternates and coverage.
SECTORS = (
    ("information_technology", "XLK", (("software_services", "IGV", (), "reference"), ("technology_hardware", None, (), "pending"),
                                       ("semiconductors", "SOXX", ("SMH",), "partial"))),
    ("health_care", "XLV", (("health_care_equipment_services", "IHI", ("IHF",), "partial"), ("pharma_biotech_life_sciences", "IHE", ("IBB", "XBI"), "partial"))),
    ("financials", "XLF", (("banks", "KBE", ("KRE",), "reference"), ("financial_services", "KCE", (), "partial"), ("insurance", "KIE", (), "complete"))),
    ("consumer_discretionary", "XLY", (("automobiles_components", None, (), "pending"), ("consumer_durables_apparel", "XHB", (), "reference"),
                                       ("consumer_services", "PEJ", (), "partial"), ("consumer_discretionary_retail", "XRT", (), "reference"))),
    ("consumer_staples", "XLP", (("consumer_staples_retail", None, (), "pending"), ("food_beverage_tobacco", "PBJ", (), "reference"),
                                 ("household_personal_products", None, (), "pending"))),
    ("communication_services", "XLC", (("telecommunication_services", "IYZ", (), "partial"), ("media_entertainment", None, ("FDN",), "pending"))),
    ("industrials", "XLI", (("capital_goods", "ITA", ("XAR",), "partial"), ("commercial_professional_services", None, (), "pending"), ("transportation", "XTN", ("IYT",), "complete"))),
    ("energy", "XLE", (("energy", "XLE", ("XOP", "XES"), "complete"),)),
    ("materials", "XLB", (("materials", "XLB", ("XME",), "complete"),)),
    ("utilities", "XLU", (("utilities", "XLU", (), "complete"),)),
    ("real_estate", "XLRE", (("equity_reits", "SCHH", (), "complete"), ("real_estate_management_development", None, (), "pending"))),
)
PROVIDER_SECTORS = {"Technology": "information_technology", "Healthcare": "health_care", "Financial Services": "financials", "Consumer Cyclical": "consumer_discretionary",
                    "Consumer Defensive": "consumer_staples", "Communication Services": "communication_services", "Industrials": "industrials", "Energy": "energy",
                    "Basic Materials": "materials", "Utilities": "utilities", "Real Estate": "real_estate"}
GROUP_SCHEMA = "sector string, sector_etf string, id string, primary string, alternates array<string>, coverage string, sector_position int, position int"
COVERAGE = ("complete", "partial", "reference", "pending")


def sector_dims(spark: SparkSession, sectors=SECTORS) -> DataFrame:
    """The sector map as a small dim (one row per industry group)."""
    rows, position = [], 0
    for sector_position, (sector, etf, groups) in enumerate(sectors):
        for group, primary, alternates, coverage in groups:
            rows.append((sector, etf, group, primary, list(alternates), coverage, sector_position, position))
            position += 1
    return spark.createDataFrame(rows, GROUP_SCHEMA)


def check_sector_dims(dims: DataFrame) -> DataFrame:
    """(problem, item) rows; empty when no ETF would be ranked wrongly or shown twice."""
    groups_of = dims.groupBy("sector").agg(F.count("*").alias("_n"))
    g = dims.join(groups_of, "sector")
    same = (F.col("_n") == 1) & F.coalesce(F.col("primary") == F.col("sector_etf"), F.lit(False))
    etfs = (g.select("sector", F.col("sector_etf").alias("etf")).distinct().select("etf")
            .unionByName(g.where(~same & F.col("primary").isNotNull()).select(F.col("primary").alias("etf")))
            .unionByName(g.select(F.explode("alternates").alias("etf"))))
    problem = lambda df, text, item: df.select(F.lit(text).alias("problem"), F.col(item).cast("string").alias("item"))
    repeated = etfs.groupBy("etf").agg(F.count("*").alias("n")).where("n > 1")
    groups = dims.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    unknown = dims.where(~F.col("coverage").isin(*COVERAGE))
    pending = dims.where((F.col("coverage") == "pending") != F.col("primary").isNull())
    return (problem(repeated, "etf_repeated", "etf").unionByName(problem(groups, "group_repeated", "id"))
            .unionByName(problem(unknown, "coverage_unknown", "id")).unionByName(problem(pending, "primary_and_pending", "id")))


def check_sub_industries(groups: DataFrame, sub_industries: DataFrame) -> DataFrame:
    """Problems of a sub-industry table (industry_group, sub_industry) against the group dim: unknown groups, groups
    without any, and sub-industries listed twice."""
    unknown = sub_industries.join(groups.select(F.col("id").alias("industry_group")), "industry_group", "left_anti")
    empty = groups.join(sub_industries.select(F.col("industry_group").alias("id")), "id", "left_anti")
    twice = sub_industries.groupBy("sub_industry").agg(F.count("*").alias("n")).where("n > 1")
    row = lambda df, text, item: df.select(F.lit(text).alias("problem"), F.col(item).alias("item")).distinct()
    return row(unknown, "group_unknown", "industry_group").unionByName(row(empty, "group_empty", "id")).unionByName(row(twice, "sub_industry_repeated", "sub_industry"))


def check_aliases(aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Problems of an alias table (alias, codes): blank, repeated, without codes, malformed or unknown codes."""
    rows = aliases.withColumn("_f", T.fold(F.col("alias")))
    row = lambda df, text, item: df.select(F.lit(text).alias("problem"), F.col(item).alias("item")).distinct()
    codes = rows.select("alias", F.explode("codes").alias("code"))
    bad = codes.where(~F.col("code").rlike(r"^[A-Z0-9]{1,6}(-[A-Z0-9]{1,2})?$"))
    unknown = codes.join(known.select(T.ticker_key(F.col("ticker")).alias("code")), "code", "left_anti").join(bad.select("code"), "code", "left_anti")
    return (row(rows.where("_f = ''"), "alias_blank", "alias").unionByName(row(rows.groupBy("_f").agg(F.count("*").alias("n")).where("n > 1"), "alias_repeated", "_f"))
            .unionByName(row(rows.where(F.size("codes") == 0), "codes_missing", "alias")).unionByName(row(rows.where(F.size("codes") != F.size(F.array_distinct("codes"))), "code_repeated", "alias"))
            .unionByName(row(bad, "code_malformed", "code")).unionByName(row(unknown, "code_unknown", "code")))


# What a person of the default list can be.
PEOPLE_CATEGORIES = ("investor", "investment_firm", "founder_ceo", "house", "president", "cabinet")


def check_people(people: DataFrame, categories: tuple[str, ...] = PEOPLE_CATEGORIES) -> DataFrame:
    """Problems of a default people list, one row each: source, cik, name, detail, district form, separators, repeated keys, and, where the list
    states them, category (one of ``categories``) and notes in both languages (note_en, note_zh).

    An entry whose identity is broken is told of once and is no further looked at; any other may have several problems.
    """
    source, name = F.col("source"), F.col("name")
    detail = F.when(source == "house", F.col("district")).otherwise(F.col("position"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    filer = source == "sec"
    broken = (F.when(~F.coalesce(source.isin("sec", "house", "oge"), F.lit(False)), "source_unknown").when(filer & T.cik(F.col("cik")).isNull(), "cik_invalid").when(~filer & blank(name), "name_missing")
              .when(~filer & blank(detail), "detail_missing").when(~filer & F.concat_ws("", name, detail).contains("|"), "separator_in_text"))
    malformed = F.when((source == "house") & ~F.col("district").rlike("^[A-Z]{2}[0-9]{2}$"), "district_malformed")
    others = [malformed, F.when(filer & blank(name), "name_missing")]
    if "category" in people.columns:
        others.append(F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category_unknown"))
    if {"note_en", "note_zh"} <= set(people.columns):
        others.append(F.when(blank(F.col("note_en")) | blank(F.col("note_zh")), "note_missing"))
    stop = F.col("_broken")
    found = F.when(stop.isNull(), F.array_compact(F.array(*others))).otherwise(
        F.array_compact(F.array(stop, F.when((stop == "separator_in_text"), malformed))))
    key = F.when(stop.isNull(), T.person_key(source, F.col("cik"), name, F.col("district"), F.col("position")))
    rows = people.withColumn("_broken", broken).withColumns({"_problems": found, "_key": key})
    repeated = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("listed_twice").alias("problem"), F.col("_key").alias("item"))
    return rows.select(F.explode("_problems").alias("problem"), F.coalesce("name", "cik").alias("item")).unionByName(repeated)

