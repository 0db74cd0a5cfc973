"""Trades of people: the merged timeline, disclosure reports, summaries, profiles and amendments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import disclosure as D
from ledgertide.functions import text as T
from ledgertide.operators import trades as trd

# Order of sources on one day, and the date of rows without any.
SOURCE_RANK = {"sec": 2, "house": 1, "oge": 0}
NO_DATE = "1900-01-01"
SMALL = 5
SIDES = {"purchase": "buy", "sale": "sell", "partial_sale": "sell", "exchange": "exchange"}


def active_reports(reports: DataFrame) -> DataFrame:
    return reports.where((F.col("report_status") != "superseded") & (F.col("amendment_status") != "unresolved"))


def side_of(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SIDES.items() for x in pair]), kind), F.lit("unknown"))


def sec_side(trades: DataFrame, ciks: DataFrame | None) -> DataFrame:
    """Timeline rows of followed filers: CURRENT Table I purchases and sales of visible filings. Without ``ciks``, all trades are those of followed filers."""
    rows = trades.where((F.col("status") == "CURRENT") & F.col("code").isin("P", "S") & (F.col("table_no") == "I") & F.col("visible"))
    if ciks is not None:
        rows = trd.join_owner_array(rows, ciks.select(F.col("person_id").alias("owner_id")))
    return rows.select(
        F.lit("sec").alias("source"), trd.eastern_day("accepted_at").alias("published"), F.lit(SOURCE_RANK["sec"]).alias("rank"),
        F.concat(F.date_format("accepted_at", "yyyyMMddHHmmss"), F.lit(":"), "id").alias("tie"), F.col("id").alias("ref"),
        F.col("accession").alias("group_id"), F.when(F.col("code") == "P", "buy").otherwise("sell").alias("side"), F.lit("stock").alias("asset_kind"),
        "transaction_date", "symbol", F.col("amount").cast("decimal(38,2)").alias("amount"), F.lit(None).cast("decimal(20,2)").alias("amount_low"),
        F.element_at("owner_ids", 1).alias("person_id"))


def disclosure_side(rows: DataFrame, reports: DataFrame, people: DataFrame, assets: str = "all") -> DataFrame:
    """Timeline rows of followed officials from active reports."""
    used = rows if assets == "all" else rows.where(F.col("asset_type").isin("stock", "option"))
    # reports meet the people before the many rows meet the reports
    joined = used.join(active_reports(reports).join(people.select("person_id"), "person_id", "left_semi"), "report_id")
    place = lambda c: F.lpad((F.lit(99999) - F.col(c)).cast("string"), 5, "0")
    rank = F.when(F.col("source") == "house", SOURCE_RANK["house"]).otherwise(SOURCE_RANK["oge"])
    return joined.select(
        "source", F.coalesce("report_date", "filed_date", F.lit(NO_DATE).cast("date")).alias("published"), rank.alias("rank"),
        F.concat_ws(":", "report_id", place("page"), place("row_number")).alias("tie"), F.col("id").alias("ref"), F.col("report_id").alias("group_id"),
        side_of(F.col("transaction_type")).alias("side"), T.asset_kind(F.col("asset_type")).alias("asset_kind"), "transaction_date",
        F.col("ticker").alias("symbol"), F.lit(None).cast("decimal(38,2)").alias("amount"), "amount_low", "person_id")


def people_timeline(trades: DataFrame, rows: DataFrame, reports: DataFrame, people: DataFrame, side: str | None = None,
                    published_from: str | None = None, published_to: str | None = None, source: str | None = None,
                    assets: str = "all", owned: bool = False) -> DataFrame:
    """SEC and disclosed trades of the same people as one table; Catalyst pushes the filters to both sides.

    ``owned``: ``trades`` are only those whose filings name any of ``people``.
    """
    union = sec_side(trades, None if owned else people).unionByName(disclosure_side(rows, reports, people, assets))
    if side is not None:
        union = union.where(F.col("side") == side)
    if source is not None:
        union = union.where(F.col("source") == source)
    if published_from is not None:
        union = union.where(F.col("published") >= F.lit(published_from).cast("date"))
    if published_to is not None:
        union = union.where(F.col("published") <= F.lit(published_to).cast("date"))
    return union


def timeline_page(union: DataFrame, k: int) -> DataFrame:
    """First k rows: newest publication, source rank, tie, all descending."""
    return union.orderBy(F.desc("published"), F.desc("rank"), F.desc("tie")).limit(k)


def amount_preview(union: DataFrame, k: int = 3) -> DataFrame:
    """The k largest rows of each report, equities first, unknown amounts last, then source order."""
    known = F.coalesce(F.col("amount"), F.col("amount_low"))
    equity = F.col("asset_kind").isin("stock", "option")
    order = Window.partitionBy("group_id").orderBy(F.desc(equity), F.desc_nulls_last(known.cast("decimal(38,2)")), F.desc("tie"))
    return union.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def disclosure_reports(union: DataFrame) -> DataFrame:
    """The timeline per report: rows by asset kind and equity rows by side."""
    equity = F.col("asset_kind").isin("stock", "option")
    return union.groupBy("source", "published", "rank", "group_id").agg(
        F.count("*").alias("rows"), *[F.count_if(F.col("asset_kind") == kind).alias(kind) for kind in ("stock", "option", "bond", "fund", "other")],
        F.count_if(equity).alias("equities"), F.count_if(equity & (F.col("side") == "buy")).alias("buys"), F.count_if(equity & (F.col("side") == "sell")).alias("sells"))


def distinct_groups(union: DataFrame) -> DataFrame:
    return union.select("source", "published", "rank", "group_id").distinct()


def disclosure_rows(rows: DataFrame, reports: DataFrame, people: DataFrame, name: str | None = None, ticker: str | None = None,
                    source: str | None = None, direction: str | None = None, traded: tuple[str, str] | None = None,
                    reported: tuple[str, str] | None = None) -> DataFrame:
    """Disclosed rows of active reports with person and report; every filter is optional."""
    joined = rows.join(active_reports(reports), "report_id").join(people.select("person_id", "name"), "person_id")
    joined = joined.withColumn("published", F.coalesce("report_date", "filed_date"))
    if name is not None:
        joined = joined.where(F.lower("name").contains(name.lower()))
    if ticker is not None:
        joined = joined.where(F.col("ticker") == ticker.strip().upper())
    if source is not None:
        joined = joined.where(F.col("source") == source)
    if direction is not None:
        wanted = {"buy": ("purchase",), "sell": ("sale", "partial_sale"), "exchange": ("exchange",)}[direction]
        joined = joined.where(F.col("transaction_type").isin(*wanted))
    for column, span in (("transaction_date", traded), ("published", reported)):
        if span is not None:
            joined = joined.where(F.col(column).between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")))
    return joined


def with_review_reasons(rows: DataFrame, reports: DataFrame) -> DataFrame:
    joined = rows.join(reports.select("report_id", "report_date", "filed_date"), "report_id")
    return joined.withColumn("review", D.review_reasons(
        F.col("warnings"), F.col("ticker_origin"), F.col("transaction_date"), F.coalesce("report_date", "filed_date"), F.col("amount_low"),
        F.col("amount_high"), F.col("asset_name")))


def trade_detail(rows: DataFrame, reports: DataFrame, trades: DataFrame, securities: DataFrame) -> DataFrame:
    """Every disclosed row and SEC trade with its report, amendment state and security."""
    disclosed = rows.join(reports, "report_id").select(
        F.col("source"), F.col("id"), F.col("report_id").alias("document"), F.col("ticker"), "transaction_date",
        F.coalesce("report_date", "filed_date").alias("published"), (F.col("report_status") == "superseded").alias("superseded"),
        F.col("amendment_status").isin("linked", "unresolved").alias("amendment"))
    filed = trades.select(
        F.lit("sec").alias("source"), "id", F.col("accession").alias("document"), F.col("symbol").alias("ticker"), "transaction_date",
        trd.eastern_day("accepted_at").alias("published"), (F.col("status") == "SUPERSEDED").alias("superseded"), F.col("form").endswith("/A").alias("amendment"))
    both = disclosed.unionByName(filed)
    return both.join(securities.select(F.col("symbol").alias("ticker"), "security_id"), "ticker", "left").withColumn(
        "lag_days", F.datediff("published", "transaction_date"))


def disclosure_people(people: DataFrame, reports: DataFrame) -> DataFrame:
    counts = active_reports(reports).groupBy("person_id").agg(
        F.count("*").alias("report_count"), F.max(F.coalesce("report_date", "filed_date")).alias("latest_report_date"))
    return people.join(counts, "person_id", "left").fillna(0, ["report_count"])


def disclosure_source_stats(reports: DataFrame, rows: DataFrame) -> DataFrame:
    active = (F.col("report_status") != "superseded") & (F.col("amendment_status") != "unresolved")
    pending = (F.col("source_hash").isNull() | (F.col("pages_done") < F.col("page_count")) | F.col("report_status").isin("discovered", "parsing", "review"))
    per_report = reports.groupBy("source").agg(
        F.count("*").alias("report_count"), F.count_if(active).alias("active_report_count"), F.sum("page_count").alias("page_count"),
        F.sum("pages_done").alias("pages_done"), F.sum("ocr_pages").alias("ocr_pages"), F.count_if(pending).alias("pending_reports"))
    joined = rows.select("report_id", "confidence").join(reports.select("report_id", "source", "report_status", "amendment_status"), "report_id")
    per_row = joined.groupBy("source").agg(
        F.count_if(active).alias("transaction_count"),
        F.count_if((F.col("report_status") != "superseded") & (F.col("confidence") == "review")).alias("review_count"))
    return per_report.join(per_row, "source", "left").fillna(0)


# --- summaries --------------------------------------------------------------------


def person_summary(items: DataFrame, keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """Per person, side and anchor: n, up, median (values listed below five), pending and missing.

    ``items``: keys, side, anchor, status, value — one row per trade and anchor from ``trade_windows``.
    """
    by = [*keys, "side", "anchor"]
    pending, available = F.col("status").isin("pending", "intraday"), F.col("status") == "available"
    value = F.when(available, F.col("value"))
    # one pass: the ends and the places between them are all values of a group below five, whichever its size
    rows = items.groupBy(*by).agg(
        F.count_if(available).alias("count"), F.coalesce(F.count_if(value > 0), F.lit(0)).alias("up"), F.percentile(value, [0.0, 1 / 3, 0.5, 2 / 3, 1.0]).alias("_q"),
        F.count_if(pending).alias("pending"), F.count_if(~pending & ~available).alias("missing"))
    at = lambda *places: F.array(*[F.get("_q", p) for p in places])
    n = F.col("count")
    values = F.when(n == 1, at(0)).when(n == 2, at(0, 4)).when(n == 3, at(0, 2, 4)).when(n == SMALL - 1, at(0, 1, 3, 4))
    return rows.select(*by, "count", "up", F.when(n >= SMALL, F.get("_q", 2)).alias("median"), values.alias("values"), "pending", "missing")


def person_profile(trades: DataFrame, people: DataFrame) -> DataFrame:
    """Roles of the newest filing, filing count and latest filing of every person that filed."""
    rows = trades.withColumn("person_id", F.explode("owner_ids"))
    roles = F.array_join(F.array_compact(F.array(
        F.when(F.col("is_ceo"), "ceo"), F.when(F.col("is_cfo"), "cfo"), F.when(F.col("is_director"), "director"), F.when(F.col("is_ten_percent"), "ten_percent"))), ",")
    per_filing = rows.groupBy("person_id", "accession").agg(F.max("accepted_at").alias("accepted_at"), F.max(roles).alias("roles"))
    profile = per_filing.groupBy("person_id").agg(
        F.count("*").alias("filings"), F.max("accepted_at").alias("latest_at"), F.max_by("roles", F.struct("accepted_at", "accession")).alias("roles"))
    named = people.select("person_id", "name", T.person_key(F.lit("sec"), F.col("person_id"), F.col("name"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("key"))
    return named.join(profile, "person_id")


# --- report versions --------------------------------------------------------------


def link_amendments(reports: DataFrame) -> DataFrame:
    """Amendments with their original by external id and person; the original becomes superseded.

    ``reports``: report_id, source, external_id, person_id, amendment_status, report_status, amends_external_id.
    """
    originals = reports.select("source", "person_id", F.col("external_id").alias("amends_external_id"), F.col("report_id").alias("_original"))
    amended = reports.where(F.col("amendment_status").isin("unresolved", "linked") & F.col("amends_external_id").isNotNull())
    links = amended.join(originals, ["source", "person_id", "amends_external_id"]).where("_original <> report_id").select("report_id", "_original")
    first = links.groupBy("report_id").agg(F.min("_original").alias("amendment_of_id"))
    replaced = first.select(F.col("amendment_of_id").alias("report_id")).distinct().withColumn("_replaced", F.lit(True))
    return (reports.join(first, "report_id", "left").join(replaced, "report_id", "left")
            .withColumn("amendment_status", F.when(F.col("amendment_of_id").isNotNull(), "linked").otherwise(F.col("amendment_status")))
            .withColumn("report_status", F.when(F.col("_replaced"), "superseded").otherwise(F.col("report_status"))).drop("_replaced"))


def duplicate_disclosures(reports: DataFrame) -> DataFrame:
    """Reports whose content an earlier report of the same person already has, with that report."""
    key = ["source", "person_id", "source_hash"]
    hashed = reports.where("source_hash IS NOT NULL")
    firsts = hashed.groupBy(*key).agg(F.min(F.struct("discovered_at", "report_id")).alias("_f"))
    return hashed.join(firsts, key).where(F.col("_f.report_id") != F.col("report_id")).select("report_id", F.col("_f.report_id").alias("duplicate_of_id"))


def discover_reports(entries: DataFrame, known_people: DataFrame, known_reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new people, new reports) of index entries; known identities and report ids are skipped.

    ``entries``: source, external_id, name, district, position, filed_date, document_date, date_source.
    """
    identity = F.concat_ws("|", "name", F.coalesce("district", F.lit("")), F.coalesce("position", F.lit("")))
    rows = entries.withColumn("identity", identity)
    people = rows.select("source", "identity", "name", "district", "position").dropDuplicates(["source", "identity"]).join(
        known_people.select("source", "identity"), ["source", "identity"], "left_anti")
    labelled = F.col("date_source") == "official_index_label"
    dated = rows.withColumn("report_date", F.coalesce("filed_date", F.when(labelled, F.col("document_date")))).withColumn(
        "report_date_source", F.when(F.col("filed_date").isNotNull(), "received_date").when(labelled, "official_index_label"))
    columns = ["identity", "report_date", "report_date_source", "filed_date"]
    firsts = dated.groupBy("source", "external_id").agg(F.min(F.struct(*columns)).alias("_r"))
    reports = firsts.select("source", "external_id", *[F.col("_r")[c].alias(c) for c in columns]).join(
        known_reports.select("source", "external_id"), ["source", "external_id"], "left_anti")
    return people, reports


def reconcile_readings(layer: DataFrame, checked: DataFrame) -> DataFrame:
    """Two readings of a page: unequal row counts keep the second, flagged; equal counts keep the first and a
    differing direction becomes unknown. Both: report_id, page, row_number, transaction_type, warnings."""
    key = ["report_id", "page"]
    size = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    pages = size(checked, "_n2").join(size(layer, "_n1"), key, "left").withColumn("_same", F.coalesce(F.col("_n1") == F.col("_n2"), F.lit(False))).select(*key, "_same")
    kept = layer.join(pages.where("_same").select(*key), key, "left_semi").join(
        checked.select(*key, "row_number", F.col("transaction_type").alias("_other")), [*key, "row_number"], "left")
    differs = F.col("transaction_type") != F.col("_other")
    first = kept.select(*key, "row_number", F.when(differs, "unknown").otherwise(F.col("transaction_type")).alias("transaction_type"),
                        F.when(differs, F.array_append("warnings", F.lit("direction_conflict"))).otherwise(F.col("warnings")).alias("warnings"))
    second = checked.join(pages.where("NOT _same").select(*key), key, "left_semi").select(
        *key, "row_number", "transaction_type", F.array_append("warnings", F.lit("text_layer_unusable")).alias("warnings"))
    rows = first.unionByName(second)
    return rows.withColumn("confidence", F.when(F.size("warnings") > 0, "review").otherwise("parsed"))


def directory(followed: DataFrame, defaults: DataFrame, officials: DataFrame) -> DataFrame:
    """Everyone the "all" view covers, without repeats: followed, then defaults, then local officials."""
    tagged = [df.select("key", "name").withColumn("origin_rank", F.lit(i)).withColumn("origin", F.lit(origin))
              for i, (df, origin) in enumerate(((followed, "followed"), (defaults, "default"), (officials, "local")))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    best = rows.groupBy("key").agg(F.min(F.struct("origin_rank", "name", "origin")).alias("_r"))
    return best.select("key", F.col("_r.name").alias("name"), F.col("_r.origin").alias("origin"))
