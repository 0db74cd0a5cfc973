"""Insider overview, activity per code and sector, and the clusters both use.

Sizes: rows may be skewed to one issuer, so people are counted after a distinct per (issuer, owner),
clusters after a distinct per (issuer, day, owner), and per-key tops use row_number() <= k, which
Spark limits before the shuffle. Nothing is collected per issuer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import stats
from ledgertide.functions import text as T
from ledgertide.operators import trades as trd
from ledgertide.session import checkpoint

# Rows per list.
SECTION_ROWS = {"cluster_buys": 20, "cluster_sales": 20, "large_buys": 10, "large_sales": 10, "executive_buys": 20,
                "holding_increases": 20, "companies": 50}
COMPANY_SORTS = ("net_buy", "net_sell", "buy", "sell", "people")


def overview_rows(trades: DataFrame, issuers: DataFrame, at: str, days: int, index: str = "all", members: DataFrame | None = None,
                  codes: DataFrame | None = None, role: str = "all", exclude_plans: bool = False) -> DataFrame:
    """Open-market rows of the last ``days`` calendar days ending at ``at``, never anomalous ones."""
    end = F.lit(at).cast("date")
    rows = trades.where(
        (F.col("status") == "CURRENT") & F.col("code").isin("P", "S") & (F.col("table_no") == "I")
        & (F.col("currency").isNull() | (F.col("currency") == "USD")) & F.col("visible")
        & F.col("transaction_date").between(F.date_sub(end, days - 1), end) & ~trd.is_anomalous())
    if exclude_plans:
        rows = rows.where(~F.col("is_plan"))
    flags = {"executive": ("is_ceo", "is_cfo", "is_president"), "director": ("is_director",), "ten_percent": ("is_ten_percent",)}
    if role != "all":
        wanted = F.lit(False)
        for flag in flags[role]:
            wanted = wanted | F.col(flag)
        rows = rows.where(wanted)
    rows = trd.join_trade_filing_issuer(rows, issuers)
    if index != "all":
        rows = trd.semi_index_members(rows, members, index, F.coalesce("filing_ticker", "issuer_ticker"))
    if codes is not None:
        matched = trd.join_ticker_classes(rows.select("id", "issuer_ticker", "filing_ticker"), codes, "issuer_ticker", "filing_ticker")
        rows = rows.join(matched.select("id").distinct(), "id", "left_semi")
    return rows


def people_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct owners per key, in all and per side; a joint filing counts each owner once."""
    pairs = rows.select(*keys, "code", F.explode("owner_ids").alias("owner_id")).groupBy(*keys, "owner_id").agg(
        F.bool_or(F.col("code") == "P").alias("_buys"), F.bool_or(F.col("code") == "S").alias("_sells"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("people"), F.count_if("_buys").alias("buy_people"), F.count_if("_sells").alias("sell_people"))


def company_totals(rows: DataFrame, keys: Sequence[str] = ("issuer_id",)) -> DataFrame:
    """Buys, sells, net and people per key over priced rows.

    An absent side is 0; an observed side without any counted amount is unknown and makes net NULL.
    """
    buy, sell = F.col("code") == "P", F.col("code") == "S"
    shares_known = F.col("counted").isNotNull() & (F.col("shares") > 0)
    check = lambda side: trd.combined_check(F.when(side & shares_known, F.col("price_check")), F.col("check_ratio"))[0]
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(F.when(buy, F.col("counted"))).alias("buy"), F.sum(F.when(sell, F.col("counted"))).alias("sell"),
        F.count_if(buy).alias("_buys"), F.count_if(sell).alias("_sells"),
        F.sum(F.when(buy & shares_known, F.col("counted"))).alias("_ba"), F.sum(F.when(buy & shares_known, F.col("shares"))).alias("_bs"),
        F.sum(F.when(sell & shares_known, F.col("counted"))).alias("_sa"), F.sum(F.when(sell & shares_known, F.col("shares"))).alias("_ss"),
        check(buy).alias("buy_price_check"), check(sell).alias("sell_price_check"),
        F.bool_or("estimated").alias("amount_estimated"), F.count_if(F.col("trade_amount").isNull()).alias("missing_price_rows"),
        F.count_if("mismatch").alias("price_mismatch_rows"), F.min("transaction_date").alias("start_date"), F.max("transaction_date").alias("end_date"))
    known = ((F.col("_buys") == 0) | F.col("buy").isNotNull()) & ((F.col("_sells") == 0) | F.col("sell").isNotNull())
    zero = F.lit(0).cast("decimal(38,12)")
    totals = totals.withColumns({
        "net": F.when(known, F.coalesce("buy", zero) - F.coalesce("sell", zero)),
        "buy_price": stats.ratio(F.col("_ba"), F.col("_bs")), "sell_price": stats.ratio(F.col("_sa"), F.col("_ss"))})
    return totals.drop("_ba", "_bs", "_sa", "_ss").withColumnsRenamed({"_buys": "buy_trades", "_sells": "sell_trades"}).join(
        people_counts(rows, keys), list(keys))


def company_order(sort: str) -> list[Column]:
    """Unknown amounts last, issuer id as the tie-break."""
    gross = F.coalesce("buy", F.lit(0)) + F.coalesce("sell", F.lit(0))
    orders = {"net_buy": [F.desc_nulls_last("net")], "net_sell": [F.asc_nulls_last("net")], "buy": [F.desc_nulls_last("buy")],
              "sell": [F.desc_nulls_last("sell")], "people": [F.desc("people"), gross.desc()]}
    return [*orders[sort], F.asc("issuer_id")]


def cluster_order(side: str) -> list[Column]:
    """Newest window end, then more insiders, then the larger amount."""
    people, amount = ("sell_people", "sell") if side == "S" else ("buy_people", "buy")
    return [F.desc("end_date"), F.desc(people), F.desc_nulls_last(amount), F.asc("issuer_id")]


def cluster_windows(rows: DataFrame, days: int = 7, people: int = 2) -> DataFrame:
    """Newest window (d-days+1 .. d) per issuer and side with at least ``people`` distinct owners.

    Each trade votes for the window ends its day lies in, once per owner; an end counts if the issuer traded on
    that day. Owners are counted per end with a two-step distinct.
    """
    seen = rows.select("issuer_id", "code", "transaction_date", F.explode("owner_ids").alias("owner_id"))
    votes = seen.select("*", F.explode(F.sequence(F.col("transaction_date"), F.date_add("transaction_date", days - 1))).alias("end_date"))
    owners = votes.groupBy("issuer_id", "code", "end_date", "owner_id").agg(F.bool_or(F.col("transaction_date") == F.col("end_date")).alias("traded"))
    ends = owners.groupBy("issuer_id", "code", "end_date").agg(F.count("*").alias("owners"), F.bool_or("traded").alias("traded")).where(F.col("traded") & (F.col("owners") >= people))
    return ends.groupBy("issuer_id", "code").agg(F.max("end_date").alias("window_end"))


def cluster_trades(rows: DataFrame, days: int = 7, people: int = 2, exclude_plans: bool = False) -> DataFrame:
    """The rows of each issuer's newest qualifying window per side."""
    used = rows.where(~F.col("is_plan")) if exclude_plans else rows
    windows = cluster_windows(used, days, people)
    return used.join(windows, ["issuer_id", "code"]).where(
        F.col("transaction_date").between(F.date_sub("window_end", days - 1), F.col("window_end")))


def top_with_total(rows: DataFrame, section: str, order: list[Column], k: int) -> DataFrame:
    """First k rows in order with their position, the full count and the mismatches left out.

    orderBy + limit is a distributed top-k; only the k rows are numbered.
    """
    top = rows.orderBy(*order).limit(k).withColumn("section", F.lit(section))
    numbered = top.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(*order)))
    return numbered.withColumn("total", rows.agg(F.count("*")).scalar())


def holding_increase(rows: DataFrame) -> DataFrame:
    """Percent of the shares held before, for rows that state the holding after."""
    before = F.col("shares_after") - F.col("shares")
    return rows.withColumn("holding_change", F.when(before > 0, stats.ratio(F.col("shares"), before) * 100))


def overview_lists(priced: DataFrame, min_amount: float = 0, cluster_days: int = 7, cluster_people: int = 2, exclude_cluster_plans: bool = True,
                   company_sort: str = "net_buy", sizes: dict[str, int] | None = None) -> DataFrame:
    """All seven lists in one frame: section, position, total, key, and the trade or the company that the key names.

    Every trade is tagged with the lists it belongs to. Companies of all three company lists are one aggregation by (list, issuer); one
    count by list gives the totals, and one ranking by list, which Spark limits before the shuffle, gives the positions.
    ``priced`` is read a few times; pass a checkpointed one.
    """
    k = {**SECTION_ROWS, **(sizes or {})}
    rows = priced.where(F.col("counted") >= min_amount) if min_amount > 0 else priced
    buy, sale = F.col("code") == "P", F.col("code") == "S"
    executive = F.col("is_ceo") | F.col("is_cfo") | F.col("is_president") | F.col("is_chair")
    nothing, none = F.lit(0).cast("decimal(38,12)"), F.lit(None)

    # orders of the lists on common columns: day, people, amount (unknown last), ratio, then ascending issuer or descending trade
    def tag(name: str, when: Column, day: Column = F.lit(0), amount: Column = nothing, ratio: Column = F.lit(0.0)) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("section"), day.alias("day"), F.lit(0).cast("long").alias("people"), amount.cast("decimal(38,12)").alias("amount"), ratio.alias("ratio")))

    raised = holding_increase(rows)
    lists = F.array_compact(F.array(
        tag("large_buys", buy & F.col("counted").isNotNull(), amount=F.col("counted")), tag("large_sales", sale & F.col("counted").isNotNull(), amount=F.col("counted")),
        tag("executive_buys", buy & executive, day=F.unix_date("transaction_date")), tag("holding_increases", buy & (F.col("holding_change") >= 20), ratio=F.col("holding_change"))))
    trades = raised.select(F.explode(lists).alias("t"), F.struct(*raised.columns).alias("trade")).select("t.*", none.cast("string").alias("issuer_id"), F.col("trade.id").alias("id"), "trade")

    used = rows.where(~(sale & F.col("is_plan"))) if exclude_cluster_plans else rows
    windows = cluster_windows(used, cluster_days, cluster_people)
    inside = F.coalesce(F.col("transaction_date").between(F.date_sub("window_end", cluster_days - 1), F.col("window_end")), F.lit(False))
    planned = sale & F.col("is_plan") if exclude_cluster_plans else F.lit(False)
    member = F.array_compact(F.array(F.lit("companies"), F.when(inside & buy, "cluster_buys"), F.when(inside & sale & ~planned, "cluster_sales")))
    # counted and ranked below: a row per list and company is stored, so that the trades are not summed up twice
    totals = checkpoint(company_totals(rows.join(windows, ["issuer_id", "code"], "left").withColumn("section", F.explode(member)), ["section", "issuer_id"]))
    in_cluster, sells = F.col("section") != "companies", F.col("section") == "cluster_sales"
    gross = F.coalesce("buy", F.lit(0)) + F.coalesce("sell", F.lit(0))
    chosen = {"net_buy": F.col("net"), "net_sell": -F.col("net"), "buy": F.col("buy"), "sell": F.col("sell"), "people": gross}[company_sort]
    company_people = F.col("people") if company_sort == "people" else F.lit(0)
    companies = totals.select(
        "section", F.when(in_cluster, F.unix_date("end_date")).otherwise(0).alias("day"),
        F.when(sells, F.col("sell_people")).when(in_cluster, F.col("buy_people")).otherwise(company_people).cast("long").alias("people"),
        F.when(sells, F.col("sell")).when(in_cluster, F.col("buy")).otherwise(chosen).cast("decimal(38,12)").alias("amount"), F.lit(0.0).alias("ratio"),
        "issuer_id", none.cast("string").alias("id"), F.struct(*[c for c in totals.columns if c != "section"]).alias("company"))

    tagged = trades.unionByName(companies, allowMissingColumns=True)
    order = Window.partitionBy("section").orderBy(F.desc("day"), F.desc("people"), F.desc_nulls_last("amount"), F.desc("ratio"), F.asc("issuer_id"), F.desc("id"))
    limit = F.create_map(*[F.lit(x) for name, size in k.items() for x in (name, size)])
    most = max(k.values())
    first = tagged.withColumn("position", F.row_number().over(order)).where((F.col("position") <= most)).where(F.col("position") <= limit[F.col("section")])
    counts = tagged.groupBy("section").agg(F.count("*").alias("total"))
    return first.join(F.broadcast(counts), "section").select("section", "position", "total", F.coalesce("id", "issuer_id").alias("key"), "trade", "company")


def overview_sections(priced: DataFrame, **options) -> dict[str, DataFrame]:
    """The seven lists by name, with the columns of their trades or companies; see ``overview_lists``."""
    lists = checkpoint(overview_lists(priced, **options))  # as many rows as the lists are long
    companies = ("cluster_buys", "cluster_sales", "companies")
    return {name: lists.where(F.col("section") == name).select("company.*" if name in companies else "trade.*", "section", "position", "total") for name in SECTION_ROWS}


# --- activity ---------------------------------------------------------------------


def top_owners(rows: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """Owner-side pairs by amount (unknown last), newest, owner, side: the first k and how many there are."""
    pairs = rows.withColumn("owner_id", F.explode("owner_ids")).groupBy(*keys, "owner_id", "code").agg(
        F.sum("counted").alias("amount"), F.count("*").alias("trades"), F.max("transaction_date").alias("last_date"))
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("trader_count"))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("amount"), F.desc("last_date"), F.asc("owner_id"), F.asc("code"))
    return pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).join(counts, list(keys))


def ticker_activity(priced: DataFrame, codes: DataFrame) -> DataFrame:
    """Buys, sells, net and plan trades per requested code; a trade belongs to every code it states."""
    rows = trd.join_ticker_classes(priced, codes, "issuer_ticker", "filing_ticker")
    totals = company_totals(rows, ["ticker_code"])
    extra = rows.groupBy("ticker_code").agg(
        F.count_if("is_plan").alias("plan_trades"), F.max_by("issuer_id", F.struct("transaction_date", "id")).alias("issuer_id"),
        F.bool_or(F.col("estimated") & F.col("counted").isNotNull()).alias("counted_estimated"))
    return totals.join(extra, "ticker_code")


def sector_activity(priced: DataFrame, classes: DataFrame) -> DataFrame:
    """Totals per sector, per industry group and for unclassified companies.

    ``classes``: issuer_id, sector, industry_group. Companies are counted from per-issuer subtotals.
    """
    rows = priced.join(classes, "issuer_id", "left")
    level = F.array_compact(F.array(
        F.when(F.col("sector").isNull(), F.struct(F.lit("unclassified").alias("level"), F.lit("").alias("key"))),
        F.when(F.col("sector").isNotNull(), F.struct(F.lit("sector").alias("level"), F.col("sector").alias("key"))),
        F.when(F.col("sector").isNotNull() & F.col("industry_group").isNotNull(), F.struct(F.lit("group").alias("level"), F.col("industry_group").alias("key")))))
    spread = rows.withColumn("_l", F.explode(level)).select("*", "_l.level", "_l.key")
    issuer = spread.groupBy("level", "key", "issuer_id").agg(
        F.sum(F.when(F.col("code") == "P", F.col("counted"))).alias("buy"), F.sum(F.when(F.col("code") == "S", F.col("counted"))).alias("sell"),
        F.count_if(F.col("code") == "P").alias("_b"), F.count_if(F.col("code") == "S").alias("_s"),
        F.count_if(F.col("trade_amount").isNull()).alias("missing_price_rows"), F.count_if("mismatch").alias("price_mismatch_rows"),
        F.max(F.col("industry_group").isNull()).alias("_ungrouped"))
    totals = issuer.groupBy("level", "key").agg(
        F.count("*").alias("companies"), F.count_if(F.col("_b") > 0).alias("buy_companies"), F.count_if(F.col("_s") > 0).alias("sell_companies"),
        F.sum("buy").alias("buy"), F.sum("sell").alias("sell"), F.sum("_b").alias("_b"), F.sum("_s").alias("_s"),
        F.sum("missing_price_rows").alias("missing_price_rows"), F.sum("price_mismatch_rows").alias("price_mismatch_rows"),
        F.count_if("_ungrouped").alias("ungrouped"))
    known = ((F.col("_b") == 0) | F.col("buy").isNotNull()) & ((F.col("_s") == 0) | F.col("sell").isNotNull())
    zero = F.lit(0).cast("decimal(38,12)")
    return totals.withColumn("net", F.when(known, F.coalesce("buy", zero) - F.coalesce("sell", zero))).drop("_b", "_s")


def issuer_tickers(rows: DataFrame) -> DataFrame:
    """The code of each issuer's latest row that states one."""
    shown = rows.withColumn("ticker", T.display_ticker(F.col("issuer_ticker"), F.col("filing_ticker"))).where("ticker IS NOT NULL")
    return shown.groupBy("issuer_id").agg(F.max_by("ticker", F.struct("transaction_date", "id")).alias("ticker"))


def classify_sector(companies: DataFrame, members: DataFrame, sectors: DataFrame, groups: DataFrame,
                    securities: DataFrame, provider_sectors: DataFrame) -> DataFrame:
    """Sector and industry group per company: the S&P list by CIK, else by ticker, else the provider's sector.

    ``sectors``: industry -> sector; ``groups``: sub_industry -> industry_group; ``securities``: symbol,
    provider_sector; ``provider_sectors``: provider_sector -> sector. A provider sector has no group.
    """
    listed = (members.where("index_name = 'sp500'").join(sectors, "industry").join(groups, "sub_industry", "left")
              .select("cik", F.replace(F.upper("ticker"), F.lit("."), F.lit("-")).alias("_key"), "sector", "industry_group"))
    by_cik = listed.where("cik IS NOT NULL").groupBy(F.col("cik").alias("issuer_id")).agg(
        F.min(F.struct("sector", "industry_group")).alias("_cik"))
    by_ticker = listed.groupBy("_key").agg(F.min(F.struct("sector", "industry_group")).alias("_ticker"))
    by_symbol = securities.join(provider_sectors, "provider_sector").groupBy(F.col("symbol").alias("_key")).agg(F.min("sector").alias("_provider"))
    rows = companies.withColumn("_key", T.ticker_key(F.col("ticker"))).join(by_cik, "issuer_id", "left").join(by_ticker, "_key", "left").join(by_symbol, "_key", "left")
    listed_class = F.coalesce("_cik", "_ticker")
    source = F.when(listed_class.isNotNull(), "sp500_gics").when(F.col("_provider").isNotNull(), "provider").otherwise("none")
    return rows.select(*companies.columns, F.coalesce(listed_class["sector"], "_provider").alias("sector"),
                       listed_class["industry_group"].alias("industry_group"), source.alias("classification"))


def choose_reference(stocks: DataFrame, groups: DataFrame, sector_etfs: DataFrame, references: DataFrame) -> DataFrame:
    """The sector reference of each stock: its own choice, else its group's primary ETF, else the sector ETF.

    ``stocks``: symbol, calendar, currency, sector, industry_group, explicit_symbol; ``groups``:
    industry_group, group_etf; ``sector_etfs``: sector, sector_etf; ``references``: symbol, instrument,
    ref_status, ref_calendar, ref_currency. A reference must be a verified ETF or index that shares
    calendar and currency.
    """
    rows = stocks.join(groups, "industry_group", "left").join(sector_etfs, "sector", "left")
    chosen = F.coalesce("explicit_symbol", "group_etf", "sector_etf")
    mode = (F.when(F.col("explicit_symbol").isNotNull(), "explicit").when(F.col("group_etf").isNotNull(), "group")
            .when(F.col("sector_etf").isNotNull(), "sector"))
    rows = rows.withColumns({"reference": chosen, "mode": mode, "fallback": F.col("industry_group").isNotNull() & F.col("group_etf").isNull() & (mode == "sector")})
    refs = references.withColumnRenamed("symbol", "reference")
    rows = rows.join(refs, "reference", "left")
    status = (F.when(F.col("sector").isNull() & F.col("explicit_symbol").isNull(), "unclassified").when(F.col("reference").isNull(), "no_reference")
              .when(F.col("reference") == F.col("symbol"), "same_security").when(F.col("instrument").isNull(), "not_fetched")
              .when(~F.col("instrument").isin("ETF", "INDEX") | (F.col("ref_status") != "VERIFIED"), "not_verified")
              .when((F.col("ref_calendar") != F.col("calendar")) | (F.col("ref_currency") != F.col("currency")), "incompatible").otherwise("available"))
    return rows.select("symbol", "sector", "industry_group", "reference", "mode", F.coalesce("fallback", F.lit(False)).alias("fallback"), status.alias("reference_status"))


# --- watched codes ----------------------------------------------------------------


def watch_news(trades: DataFrame, issuers: DataFrame, since: DataFrame, at: str) -> DataFrame:
    """Trades of watched codes first accepted after each code's start and not after ``at``.

    ``since``: ticker_code, since. ``trades`` carries original_accepted_at for corrections, which
    therefore are never news twice.
    """
    stamp = F.lit(at).cast("timestamp")
    rows = trades.where(
        (F.col("status") == "CURRENT") & F.col("code").isin("P", "S") & (F.col("table_no") == "I")
        & (F.col("currency").isNull() | (F.col("currency") == "USD")) & F.col("visible") & ~trd.is_anomalous() & (F.col("accepted_at") <= stamp))
    rows = trd.join_trade_filing_issuer(rows, issuers).withColumn("first_accepted_at", F.coalesce("original_accepted_at", "accepted_at"))
    exploded = rows.withColumn("ticker_code", F.explode(T.ticker_tokens(F.col("issuer_ticker"), F.col("filing_ticker"))))
    return exploded.join(since, "ticker_code").where((F.col("first_accepted_at") > F.col("since")) & (F.col("first_accepted_at") <= stamp))


def news_lines(news: DataFrame) -> DataFrame:
    """One line per code, filing owners and side: trades, dates and the newest trade's id."""
    return news.groupBy("ticker_code", F.array_join("owner_ids", ",").alias("owners"), "code").agg(
        F.count("*").alias("trades"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"),
        F.max_by("id", F.struct("transaction_date", "first_accepted_at", "id")).alias("newest_id"), F.max("first_accepted_at").alias("latest_at"))
