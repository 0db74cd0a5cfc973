"""Disclosure sources: yearly indexes, link pages, report text and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import disclosure as D
from ledgertide.functions.text import clean
from ledgertide.sources.filings import html_links, html_rows


def read_disclosure_index(rows: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(periodic reports, rejected rows) of a yearly index with Last, First, Suffix, FilingType, StateDst, FilingDate, DocID."""
    p = rows.where(F.trim("FilingType") == "P")
    parts = F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in ("First", "Last", "Suffix")]), lambda x: x != "")
    parsed = p.select(
        F.trim("DocID").alias("external_id"), F.array_join(parts, " ").alias("name"), F.nullif(F.trim("StateDst"), F.lit("")).alias("district"),
        F.lit("representative").alias("position"), F.try_to_date(F.trim("FilingDate"), "M/d/yyyy").alias("filed_date"), F.lit(year).alias("index_year"))
    valid = F.col("external_id").rlike(r"^\d{7,8}$") & F.col("filed_date").isNotNull()
    return parsed.where(valid).dropDuplicates(["external_id"]), parsed.where(~valid)


def read_disclosure_links(pages: DataFrame, key: str, html: str, since: str | None = None) -> DataFrame:
    """Periodic transaction reports of the two top executives among the links of a page, from the day ``since`` on if one is given."""
    links = html_links(pages, key, html)
    file = F.url_decode(F.regexp_replace(F.substring_index(F.substring_index("href", "?", 1), "/", -1), "[+]", "%2B"))
    context = F.concat_ws(" ", "label", file)
    marker = r"(?i)periodic.?transaction|278[\s_-]*t"
    dates = F.transform(F.regexp_extract_all(context, F.lit(r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"), 1), lambda d: D.date(F.translate(d, ".", "/")))
    prefix = F.trim(F.regexp_replace(F.get(F.split("label", marker), 0), r"[\s–—_-]+$", ""))
    position = F.when(F.lower(prefix).contains("vice president"), "vice_president").when(F.lower(prefix).contains("president"), "president")
    name = F.regexp_replace(prefix, r"(?i)^(?:vice )?president\s+", "")
    ordered = F.when(name.contains(","), F.concat_ws(" ", F.trim(F.substring_index(name, ",", -1)), F.trim(F.substring_index(name, ",", 1)))).otherwise(name)
    rows = links.where(context.rlike(marker)).select(
        "page_key", F.sha2("href", 256).alias("external_id"), F.trim(F.regexp_replace(F.replace(ordered, F.lit("."), F.lit("")), r"\s+", " ")).alias("name"),
        position.alias("position"), F.get(F.array_compact(dates), 0).alias("document_date"), F.when(context.rlike("(?i)amend"), "unresolved").otherwise("original").alias("amendment_status"),
        F.regexp_extract(context, r"\((\d+)\)", 1).try_cast("int").alias("document_part"), F.col("href").alias("url"))
    found = rows.where("position IS NOT NULL AND name <> '' AND document_date IS NOT NULL")
    return found.where(F.col("document_date") >= F.lit(since).cast("date")) if since else found


# Header words of a report table -> field, first match wins.
HEADERS = (("notification", "notification"), ("owner", "owner"), ("ticker", "ticker"), ("symbol", "ticker"), ("asset type", "asset_type"),
           ("asset", "asset"), ("description", "asset"), ("name of", "asset"), ("amount", "amount"))


def header_field(cell):
    """Field a header cell names, or NULL."""
    value = F.lower(clean(cell))
    field = F.when(value.contains("type") & (value.contains("transaction") | (value == "type")), "direction").when(
        value.contains("date") & ~value.contains("fil") & ~value.contains("report"), "date")
    for words, name in reversed(HEADERS):
        field = F.when(value.contains(words), name).otherwise(field)
    return field


def read_report_tables(pages: DataFrame, key: str, html: str, ocr: bool = False) -> DataFrame:
    """Trade rows of report tables; the header row is the one that names an asset and an amount column."""
    rows = html_rows(pages, key, html).withColumn("_f", F.transform("cells", header_field))
    heading = F.coalesce(F.array_contains("_f", "asset") & F.array_contains("_f", "amount"), F.lit(False))
    heads = rows.where(heading).groupBy("page_key", "table_no").agg(F.min("row_no").alias("_head"), F.min_by("_f", "row_no").alias("_fields"))
    data = rows.where(~heading).join(heads, ["page_key", "table_no"]).where(F.col("row_no") > F.col("_head"))
    cell = lambda name: F.coalesce(F.get("cells", (F.array_position("_fields", name) - 1).cast("int")), F.lit(""))
    named = data.select("page_key", "table_no", "row_no", F.array_join("cells", " | ").alias("raw_row"), *[
        cell(n).alias(f"_{n}") for n in ("asset", "asset_type", "ticker", "owner", "direction", "date", "notification", "amount")])
    kept = named.where((clean(F.col("_asset")) != "") & ~D.furniture(F.col("_asset"), asset=True)
                       & ((F.col("_date") != "") | (F.col("_direction") != "") | (F.col("_amount") != "")))
    fields = D.trade_row(*[F.col(f"_{n}") for n in ("asset", "asset_type", "ticker", "owner", "direction", "date", "notification", "amount")], F.lit(""), ocr=ocr)
    return kept.select("page_key", "table_no", "row_no", "raw_row", *[c.alias(n) for n, c in fields.items()])


def parse_disclosure_rows(pages: DataFrame, keys: list[str], text: str, source: str = "house", ocr: bool = False) -> DataFrame:
    """Trade rows of report text: one per line that has a direction and a date or amount.

    Lines before it that carry an asset code belong to its asset (wrapped descriptions); a running count
    of trade lines per page gives them their row. A page is bounded by its own text. Lines that hold neither are left out before
    they are cleaned and matched, since most of a page is such text.
    """
    lines = pages.select(*keys, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "raw")).where(
        F.col("raw").rlike(D.EVIDENCE)).withColumn("line", clean(F.col("raw"))).where(
        (F.col("line") != "") & ~D.furniture(F.col("line")))
    dates = F.regexp_extract_all("line", F.lit("(" + D.DATE + ")"), 1)
    has_amount = F.col("line").rlike(D.AMOUNT)
    trade = F.col("line").rlike(D.DIRECTION) & ((F.size(dates) > 0) | has_amount | F.col("line").rlike(D.OPEN_AMOUNT))
    wrapped = ~trade & F.col("line").rlike(r"\([A-Z][A-Z0-9.\-]+\)|\[ST\]|\[OP\]") & ~(
        (F.size(dates) == 0) & ~has_amount & F.col("line").rlike(r"\b(?:DESCRIPTION|COMMENT)"))
    marked = lines.withColumns({"_dates": dates, "_trade": trade, "_wrapped": wrapped}).where("_trade OR _wrapped")
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = marked.withColumn("row_number", F.sum(F.col("_trade").cast("int")).over(w) + F.when(F.col("_trade"), 0).otherwise(1))
    grouped = marked.groupBy(*keys, "row_number").agg(
        F.max(F.when(F.col("_trade"), F.col("line"))).alias("line"), F.max(F.when(F.col("_trade"), F.col("_dates"))).alias("dates"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_wrapped"), F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("above")).where("line IS NOT NULL")
    # The asset ends at the last direction word before the first date or amount.
    cut = F.when(F.size("dates") > 0, F.expr("substring_index(line, dates[0], 1)")).otherwise(F.regexp_extract("line", r"^(.*?)\$", 1))
    head = F.when(cut.rlike(D.DIRECTION), cut).otherwise(F.col("line"))
    words = F.regexp_extract_all(head, F.lit(D.DIRECTION), 1)
    word = F.get(words, F.size(words) - 1)
    rows = grouped.withColumns({"_head": head, "_word": word})
    rows = rows.withColumn("_asset", F.trim(F.expr("substring(_head, 1, length(_head) - locate(reverse(_word), reverse(_head)) - length(_word) + 1)")))
    if source == "oge":
        rows = rows.withColumn("_asset", F.trim(F.regexp_replace("_asset", D.DATE, "")))
    rows = rows.withColumn("_asset", F.regexp_replace("_asset", r"^\d+[.)]?\s+", ""))
    owner = r"(?i)^(SP|JT|DC|Self|Spouse|Joint|Dependent Child)\b\s*"
    rows = rows.withColumns({"_owner": F.regexp_extract("_asset", owner, 1), "_asset": F.regexp_replace("_asset", owner, "")})
    full = F.trim(F.concat_ws(" ", F.nullif("above", F.lit("")), "_asset"))
    amounts = F.regexp_extract_all("line", F.lit("(" + D.AMOUNT + ")"), 1)
    notification = F.when(F.lit(source == "house"), F.get("dates", 1)).otherwise(F.lit(""))
    fields = D.trade_row(full, F.lit(""), F.lit(""), F.col("_owner"), F.col("_word"), F.get("dates", 0), notification,
                         F.coalesce(F.get(amounts, F.size(amounts) - 1), F.col("line")), F.lit(""), ocr=ocr)
    return rows.select(*keys, "row_number", F.col("line").alias("raw_row"), *[c.alias(n) for n, c in fields.items()])
