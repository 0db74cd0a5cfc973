"""Filing sources: indexes, feeds, submissions and ownership documents as DataFrames.

Every reader takes a DataFrame with one text column (a line or a whole document) so that batch files,
streams and tables are read the same way; ``lines`` and ``documents`` load files.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions import text as T
from ledgertide.operators import calendar as cal
from ledgertide.operators.trades import action_category

# Fixed values.
FORMS = ("3", "3/A", "4", "4/A", "5", "5/A")
INDEX_PATH = r"^edgar/data/\d{1,10}/(?:\d{18}/)?\d{10}-\d{2}-\d{6}\.txt$"
ARCHIVES = "https://www.sec.gov/Archives/"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def form_of(raw: Column) -> Column:
    """Canonical ownership form (4A reads as 4/A); NULL for any other form."""
    value = F.regexp_replace(F.upper(F.trim(raw)), "^([345])A$", "$1/A")
    return F.when(value.isin(*FORMS), value)


def filing_date(raw: Column) -> Column:
    return F.coalesce(F.try_to_date(raw, "yyyy-MM-dd"), F.try_to_date(raw, "yyyyMMdd"))


def utc_instant(raw: Column) -> Column:
    """Instant of a text that states its offset; NULL otherwise."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(raw))


def read_master_index(rows: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines) of pipe-delimited index lines; only ownership forms are entries.

    Lines that are not data (header, rule, prose) have no numeric first field and are skipped.
    """
    parts = F.transform(F.split(F.col(line), r"\|"), lambda x: F.trim(x))
    data = rows.withColumn("_p", parts).where(F.size("_p") >= 4).where(F.col("_p")[0].rlike("^[0-9]+$"))
    parsed = data.select(
        F.col(line).alias("line"), F.size("_p").alias("_n"), T.cik(F.get("_p", 0)).alias("entity_cik"), F.get("_p", 1).alias("name"),
        form_of(F.get("_p", 2)).alias("form"), filing_date(F.get("_p", 3)).alias("filing_date"), F.get("_p", 4).alias("path"))
    parsed = parsed.withColumn("accession", T.accession(F.col("path")))
    path_cik = T.cik(F.regexp_extract("path", r"^edgar/data/(\d{1,10})/", 1))
    problem = (F.when(F.col("_n") != 5, "malformed_master_index_row").when(F.col("entity_cik").isNull(), "invalid_cik")
               .when(F.col("filing_date").isNull() | ~F.col("path").rlike(INDEX_PATH), "invalid_master_index_date_or_path")
               .when(F.col("accession").isNull(), "missing_or_conflicting_accession").when(path_cik != F.col("entity_cik"), "master_index_cik_path_conflict"))
    parsed = parsed.withColumn("reason", problem)
    wanted = F.col("form").isNotNull()
    entries = parsed.where(wanted & F.col("reason").isNull()).select("accession", "form", "filing_date", "entity_cik", "name", F.concat(F.lit(ARCHIVES), "path").alias("submission_url"))
    rejects = parsed.where((F.col("_n") != 5) | (wanted & F.col("reason").isNotNull())).select("line", "reason")
    return entries, rejects


def index_as_of(header: Column) -> Column:
    """The day an index states it was last received through."""
    raw = F.trim(F.regexp_extract(header, r"(?i)Last Data Received:\s*([^\r\n]+)", 1))
    return F.coalesce(F.try_to_date(raw, "MMMM d, yyyy"), F.try_to_date(raw, "MMM d, yyyy"), F.try_to_date(raw, "yyyy-MM-dd"))


ATOM_ENTRY = ("title STRING, id STRING, updated STRING, summary STRING, category ARRAY<STRUCT<_term: STRING>>, "
              "link ARRAY<STRUCT<_href: STRING, _rel: STRING>>")


def read_latest_feed(feeds: DataFrame, document: str = "value") -> DataFrame:
    """Entries of Atom documents: accession, form, entity and role, acceptance and filing date."""
    entries = feeds.select(F.explode(F.regexp_extract_all(F.col(document), F.lit(r"(?s)(<entry>.*?</entry>)"), 1)).alias("xml"))
    e = entries.select(F.from_xml("xml", ATOM_ENTRY).alias("e")).select("e.*")
    # An entity that is not escaped twice arrives decoded, so the summary is matched with tags stripped.
    plain = F.regexp_replace(F.coalesce("summary", F.lit("")), r"<[^>]+>|&lt;[^&]*&gt;", " ")
    stated = F.array_distinct(F.array_compact(F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda c: form_of(c["_term"]))))
    title_form = form_of(F.substring_index("title", " - ", 1))
    conflict = (F.size(stated) > 1) | F.coalesce((F.size(stated) == 1) & (F.get(stated, 0) != title_form), F.lit(False))
    url = F.get(F.filter(F.transform("link", lambda x: x["_href"]), lambda h: h.rlike(r"-index\.html?(?:$|\?)")), 0)
    pattern = r"\((\d{1,10})\)\s*\(([^)]+)\)\s*$"
    accepted = utc_instant(F.col("updated"))
    rows = e.select(
        T.accession(F.concat_ws(" ", "id", url)).alias("accession"), F.coalesce(F.get(stated, 0), title_form).alias("form"),
        T.cik(F.regexp_extract("title", pattern, 1)).alias("entity_cik"), F.nullif(F.regexp_extract("title", pattern, 2), F.lit("")).alias("role"),
        accepted.alias("accepted_at"), filing_date(F.regexp_extract(plain, r"(?i)Filed:\s*(\d{4}-\d{2}-\d{2})", 1)).alias("filing_date"), url.alias("index_url"),
        F.when(conflict, "feed_form_conflict").when(url.isNull(), "ownership_entry_missing_index_url").when(accepted.isNull(), "acceptance_time_missing_or_invalid").alias("warning"))
    return rows.where("form IS NOT NULL")


SUBMISSIONS = ("cik STRING, filings STRUCT<recent: STRUCT<accessionNumber: ARRAY<STRING>, form: ARRAY<STRING>, filingDate: ARRAY<STRING>, "
               "acceptanceDateTime: ARRAY<STRING>, primaryDocument: ARRAY<STRING>>>")
HISTORY_FILES = "cik STRING, filings STRUCT<files: ARRAY<STRUCT<name: STRING, filingCount: INT, filingFrom: STRING, filingTo: STRING>>>"


def read_submissions(payloads: DataFrame, document: str = "value") -> tuple[DataFrame, DataFrame]:
    """(filing rows, rejected payloads) of columnar submission documents; misaligned columns reject the payload."""
    s = payloads.select(F.col(document).alias("payload"), F.from_json(F.col(document), SUBMISSIONS).alias("s"))
    recent = F.col("s.filings.recent")
    n = F.size(recent["accessionNumber"])
    optional = lambda c: recent[c].isNull() | (F.size(recent[c]) == n)
    aligned = (F.size(recent["form"]) == n) & (F.size(recent["filingDate"]) == n) & optional("acceptanceDateTime") & optional("primaryDocument")
    problem = F.when(recent["accessionNumber"].isNull(), "missing_submissions_accession_column").when(
        recent["form"].isNull() | recent["filingDate"].isNull(), "missing_submissions_required_columns").when(~aligned, "misaligned_submissions_columns")
    checked = s.withColumn("reason", problem)
    rows = checked.where("reason IS NULL").select(T.cik(F.col("s.cik")).alias("entity_cik"), F.explode(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.get(recent["accessionNumber"], i).alias("accession"), F.get(recent["form"], i).alias("form"), F.get(recent["filingDate"], i).alias("filed"),
            F.get(recent["acceptanceDateTime"], i).alias("accepted"), F.get(recent["primaryDocument"], i).alias("document")))).alias("r"))
    entries = rows.select("entity_cik", T.accession(F.col("r.accession")).alias("accession"), form_of(F.col("r.form")).alias("form"),
                          filing_date(F.col("r.filed")).alias("filing_date"), utc_instant(F.col("r.accepted")).alias("accepted_at"), F.col("r.document").alias("document"))
    return entries.where("form IS NOT NULL"), checked.where("reason IS NOT NULL").select("payload", "reason")


def read_history_files(payloads: DataFrame, document: str = "value") -> DataFrame:
    """Pointers to older submission files; only names of the entity's own history are accepted."""
    s = payloads.select(F.from_json(F.col(document), HISTORY_FILES).alias("s")).select(T.cik(F.col("s.cik")).alias("entity_cik"), F.explode("s.filings.files").alias("f"))
    safe = F.col("f.name").rlike(r"^CIK\d{10}-submissions-\d+\.json$") & (F.substring("f.name", 4, 10) == F.col("entity_cik"))
    return s.where(safe).select("entity_cik", F.col("f.name").alias("name"), filing_date(F.col("f.filingFrom")).alias("filing_from"), filing_date(F.col("f.filingTo")).alias("filing_to"),
                                F.col("f.filingCount").alias("filing_count"))


def read_company_tickers(payloads: DataFrame, document: str = "value") -> DataFrame:
    """Identity candidates of both layouts: an object of records, or fields plus data rows."""
    raw = F.col(document)
    records = payloads.where(~raw.rlike(r'^\s*\{\s*"fields"')).select(F.explode(F.map_values(F.from_json(
        raw, "map<string, struct<cik_str: string, cik: string, name: string, title: string, ticker: string, exchange: string>>"))).alias("r")).select(
        T.cik(F.coalesce("r.cik", "r.cik_str")).alias("cik"), F.coalesce("r.name", "r.title").alias("name"), F.col("r.ticker").alias("ticker"), F.col("r.exchange").alias("exchange"))
    table = payloads.where(raw.rlike(r'^\s*\{\s*"fields"')).select(F.from_json(raw, "fields array<string>, data array<array<string>>").alias("t"))
    rows = table.select("t.fields", F.explode("t.data").alias("d"))
    at = lambda name: F.get("d", (F.array_position("fields", name) - 1).cast("int"))
    tabular = rows.select(T.cik(at("cik")).alias("cik"), at("name").alias("name"), at("ticker").alias("ticker"), at("exchange").alias("exchange"))
    return records.unionByName(tabular).where(F.col("ticker").rlike(r"^[A-Za-z0-9][A-Za-z0-9.\-^=]{0,29}$"))


def read_entity_search(payloads: DataFrame, limit: int = 10, document: str = "value") -> DataFrame:
    """The first ``limit`` hits of each search answer, best first, with all of their tickers."""
    schema = "hits struct<hits: array<struct<_id: string, _source: struct<entity: string, tickers: string>>>>"
    hits = payloads.select(F.posexplode(F.slice(F.from_json(F.col(document), schema)["hits"]["hits"], 1, limit)).alias("pos", "h"))
    return hits.select((F.col("pos") + 1).alias("position"), T.cik(F.col("h._id")).alias("cik"), F.trim("h._source.entity").alias("name"),
                       T.tokens(F.col("h._source.tickers")).alias("tickers"))


# --- documents --------------------------------------------------------------------


def read_submission_text(rows: DataFrame, document: str = "value") -> DataFrame:
    """The one ownership document of a full submission with its header facts, or the reason there is none."""
    # Every step reads columns of the step before, so that each pattern runs once a document and not once a mention.
    whole = r"(?is)((?:<\?xml\s[^?]*\?>\s*)?<ownershipDocument.*</ownershipDocument>)"
    typed = F.transform(F.regexp_extract_all(F.col(document), F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1), lambda d: F.struct(
        form_of(F.regexp_extract(d, r"(?i)<TYPE>\s*([^\r\n<]+)", 1)).alias("form"), F.regexp_extract(d, whole, 1).alias("xml")))
    parts = rows.select(F.regexp_extract(F.col(document), r"(?is)<SEC-HEADER>(.*?)(?:</SEC-HEADER>|<DOCUMENT>)", 1).alias("header"), typed.alias("typed"))
    stamp = F.regexp_extract("header", r"(?i)<ACCEPTANCE-DATETIME>\s*(\d{14})(?!\d)", 1)
    facts = parts.select(
        (F.col("header") == "").alias("bare"), F.filter("typed", lambda d: d["form"].isNotNull() & (d["xml"] != "")).alias("docs"),
        F.nullif(F.regexp_extract("header", r"ACCESSION NUMBER:\s*(\d{10}-\d{2}-\d{6})", 1), F.lit("")).alias("accession"),
        form_of(F.regexp_extract("header", r"CONFORMED SUBMISSION TYPE:\s*([^\r\n<]+)", 1)).alias("form"),
        F.nullif(F.regexp_replace(stamp, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"), F.lit("")).alias("wall"),
        F.regexp_extract("header", r"FILED AS OF DATE:\s*(\d{8})(?!\d)", 1).alias("filed"))
    problem = (F.when(F.col("bare"), "sec_submission_header_missing").when(F.col("form").isNull(), "unsupported_submission_form")
               .when(F.size("docs") != 1, "ownership_document_missing_or_ambiguous").when(F.get("docs", 0)["form"] != F.col("form"), "submission_document_form_conflict"))
    return facts.withColumn("reason", problem).select(
        "accession", "form", cal.eastern_instant(F.col("wall")).alias("accepted_at"), filing_date(F.col("filed")).alias("filing_date"),
        F.when(F.col("reason").isNull(), F.get("docs", 0)["xml"]).alias("xml"), "reason")


#: Documents of a batch whose trees are held at once.
PARSED_AT_ONCE = 256

# The table elements of an ownership document with the prefix of their rows, and where a row's facts lie.
OWNERSHIP_TABLES = (("I", "nonDerivative"), ("II", "derivative"))
OWNERSHIP_FACTS = {
    "security_title": "securityTitle/value", "transaction_date": "transactionDate/value", "deemed_execution_date": "deemedExecutionDate/value",
    "transaction_form_type": "transactionCoding/transactionFormType", "code": "transactionCoding/transactionCode", "shares": "transactionAmounts/transactionShares/value",
    "price": "transactionAmounts/transactionPricePerShare/value", "direction": "transactionAmounts/transactionAcquiredDisposedCode/value",
    "exercise_price": "conversionOrExercisePrice/value", "exercise_date": "exerciseDate/value", "expiration_date": "expirationDate/value",
    "underlying_title": "underlyingSecurity/underlyingSecurityTitle/value", "underlying_shares": "underlyingSecurity/underlyingSecurityShares/value",
    "ownership_type": "ownershipNature/directOrIndirectOwnership/value", "nature_of_ownership": "ownershipNature/natureOfOwnership/value",
    "shares_after": "postTransactionAmounts/sharesOwnedFollowingTransaction/value",
}
OWNERSHIP_HEAD = {"document_type": "documentType", "period_of_report": "periodOfReport", "raw_plan_flag": "aff10b5One", "issuer_cik": "issuer/issuerCik", "issuer_name": "issuer/issuerName",
                  "issuer_ticker": "issuer/issuerTradingSymbol"}


def _texts_at(elements: list[ET.Element | None], path: str) -> list[str | None]:
    """The text at the path below each element; only the first child of a name counts, and one without children gives its text at once."""
    tags, found = path.split("/"), []
    for element in elements:
        for tag in tags:
            if element is None:
                break
            element = element.find(tag)
        found.append(None if element is None else "".join(element.itertext()).strip() if len(element) else (element.text or "").strip())
    return found


def _ownership_document(xml: str | None) -> tuple[ET.Element | None, list[tuple[str, int, ET.Element]]]:
    """The root and the elements of both tables in order, numbered in their table from 1; no root where the text is no XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None, []
    if root.tag.startswith("{"):
        for element in root.iter():
            element.tag = element.tag.rpartition("}")[2] if isinstance(element.tag, str) else element.tag
    rows = []
    for table_no, prefix in OWNERSHIP_TABLES:
        own = [child for table in root.findall(f"{prefix}Table") for child in table if isinstance(child.tag, str)]
        rows += [(table_no, number + 1, child) for number, child in enumerate(own)]
    return root, rows


def ownership_documents(rows: DataFrame, xml: str = "xml", *keep: str, facts: dict[str, str] = OWNERSHIP_FACTS) -> DataFrame:
    """Each document parsed once: its head, owners, footnotes, and every element of the two tables with its position and facts as texts.

    Python parses the XML, batch by batch and a bounded number of trees at a time; what the texts mean is left to columns. ``facts`` are those a caller reads.
    """
    kinds = {f"{prefix}{kind}": (no, kind.lower()) for no, prefix in OWNERSHIP_TABLES for kind in ("Transaction", "Holding")}
    text = pa.string()

    def lists(counts: list[int], columns: dict[str, pa.Array]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PARSED_AT_ONCE):
                yield read(batch.slice(start, PARSED_AT_ONCE))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [_ownership_document(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        roots = [root for root, _ in parsed]
        head = [pa.array(_texts_at(roots, path), text) for path in OWNERSHIP_HEAD.values()]
        owners = [[] if root is None else root.findall("reportingOwner") for root in roots]
        notes = [[] if root is None else root.findall("footnotes/footnote") for root in roots]
        elements = [row for _, own in parsed for row in own]
        rows = [element for _, _, element in elements]
        refs = [list(dict.fromkeys(n.get("id") for n in element.iter("footnoteId") if n.get("id"))) for element in rows]
        known = [kinds.get(element.tag) for element in rows]
        of_owners = [o for own in owners for o in own]
        return pa.RecordBatch.from_arrays([
            *batch.columns[:-1], *head,
            lists([len(o) for o in owners], {"cik": pa.array(_texts_at(of_owners, "reportingOwnerId/rptOwnerCik"), text), "name": pa.array(_texts_at(of_owners, "reportingOwnerId/rptOwnerName"), text)}),
            lists([len(n) for n in notes], {"id": pa.array([n.get("id") for own in notes for n in own], text), "note": pa.array(["".join(n.itertext()).strip() for own in notes for n in own], text)}),
            lists([len(own) for _, own in parsed], {
                "table_no": pa.array([no for no, _, _ in elements], text), "source_row_index": pa.array([number for _, number, _ in elements], pa.int32()),
                "row_kind": pa.array([k[1] if k and k[0] == no else None for k, (no, _, _) in zip(known, elements, strict=True)], text),
                **{name: pa.array(_texts_at(rows, path), text) for name, path in facts.items()},
                "footnote_ids": pa.array(refs, pa.list_(text))})], names)

    names = [*keep, *OWNERSHIP_HEAD, "owners", "footnotes", "elements"]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)
    element = ", ".join(["table_no: string", "source_row_index: int", "row_kind: string", *[f"{name}: string" for name in facts], "footnote_ids: array<string>"])
    schema = (kept + "".join(f"{name} string, " for name in OWNERSHIP_HEAD) + "owners array<struct<cik: string, name: string>>, footnotes array<struct<id: string, note: string>>, "
              f"elements array<struct<{element}>>")
    return rows.select(*keep, F.col(xml).cast("string")).mapInArrow(parse, schema)


def read_ownership_filings(rows: DataFrame, xml: str = "xml", *keep: str, facts: dict[str, str] = OWNERSHIP_FACTS) -> DataFrame:
    """Issuer, owners, footnotes, table elements and warnings of ownership documents; unsupported document types drop out."""
    f = ownership_documents(rows, xml, *keep, facts=facts)
    form = form_of(F.replace(F.col("document_type"), F.lit(" "), F.lit("")))
    ids = F.filter(F.transform("footnotes", lambda n: n["id"]), lambda i: i.isNotNull() & (i != ""))
    period = F.try_to_date("period_of_report", "yyyy-MM-dd")
    warnings = F.concat(
        F.when(F.size(F.array_distinct(ids)) != F.size("footnotes"), F.array(F.lit("duplicate_or_missing_footnote_id"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("owners", lambda o: T.cik(o["cik"]).isNull()), lambda o: F.lit("missing_or_invalid_owner_cik")),
        F.array_compact(F.array(
            F.when(F.size("owners") == 0, "no_reporting_owners"), F.when(T.cik(F.col("issuer_cik")).isNull(), "missing_or_invalid_issuer_cik"),
            F.when(F.col("period_of_report").isNotNull() & period.isNull(), "invalid_date:period_of_report"))))
    return f.select(*keep, form.alias("form"), period.alias("period"), "raw_plan_flag", T.cik(F.col("issuer_cik")).alias("issuer_id"), "issuer_name", "issuer_ticker",
                    "owners", "footnotes", "elements", warnings.alias("filing_warnings")).where("form IS NOT NULL")


def ownership_warnings(rows: DataFrame, xml: str = "xml", *keep: str) -> DataFrame:
    """Warnings about whole documents, one row each: issuer, owners, footnote ids, and table elements that are no row. The facts of rows are not read for it."""
    filings = read_ownership_filings(rows, xml, *keep, facts={})
    odd = F.transform(F.filter("elements", lambda e: e["row_kind"].isNull()), lambda e: F.concat_ws(":", F.lit("unrecognized_table_child"), e["table_no"], e["source_row_index"].cast("string")))
    return filings.select(*keep, F.explode(F.concat("filing_warnings", odd)).alias("warning"))


def parse_ownership(rows: DataFrame, xml: str = "xml", *keep: str) -> DataFrame:
    """One row per transaction or holding in document order, never replicated per owner.

    source_row_index numbers all elements of a table, so an unknown one takes a number. A text that is no date or no number of zero or more gives NULL and a warning.
    """
    filings = read_ownership_filings(rows, xml, *keep)
    owner_ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("owners", lambda o: T.cik(o["cik"])))))
    parsed = filings.withColumn("owner_ids", owner_ids).withColumn("r", F.explode(F.filter("elements", lambda e: e["row_kind"].isNotNull()))).drop("elements")
    warnings = []

    def number(name: str):
        text = F.col(f"r.{name}")
        good = text.rlike(r"^[+]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)$")
        warnings.append(F.when((text != "") & ~good, f"invalid_number:{name}"))
        return F.when(good, text.try_cast("decimal(30,6)")).alias(name)

    def day(name: str):
        text = F.col(f"r.{name}")
        value = F.try_to_date(text, "yyyy-MM-dd")
        warnings.append(F.when((text != "") & value.isNull(), f"invalid_date:{name}"))
        return value.alias(name)

    plain = lambda name: F.col(f"r.{name}")
    code, way, refs = plain("code"), plain("direction"), plain("footnote_ids")
    known = F.transform("footnotes", lambda n: n["id"])
    transaction, form3 = plain("row_kind") == "transaction", F.col("form").isin("3", "3/A")
    fields = [
        plain("security_title"), day("transaction_date"), day("deemed_execution_date"), code, way, plain("transaction_form_type"), number("shares"), number("price"), number("exercise_price"),
        day("exercise_date"), day("expiration_date"), plain("underlying_title"), number("underlying_shares"), plain("ownership_type"), plain("nature_of_ownership"), number("shares_after")]
    found = F.concat(
        F.transform(F.array_except(refs, known), lambda x: F.concat(F.lit("missing_footnote:"), x)),
        F.array_compact(F.array(
            F.when(transaction & form3, "form3_transaction_requires_review"),
            F.when(transaction & (code.isNull() | ~F.coalesce(way.isin("A", "D"), F.lit(False))), "incomplete_transaction_coding"),
            F.when((code.eqNullSafe("P") & ~way.eqNullSafe("A")) | (code.eqNullSafe("S") & ~way.eqNullSafe("D")), "code_direction_conflict"), *warnings)))
    return parsed.select(
        *keep, "form", "issuer_id", "issuer_ticker", "raw_plan_flag", "owner_ids", "r.table_no", "r.source_row_index", "r.row_kind",
        (transaction & ~form3).alias("is_trade"), action_category(plain("row_kind"), F.col("form"), code, way).alias("action_category"), *fields,
        refs.alias("footnote_ids"), F.transform(F.filter("footnotes", lambda n: F.array_contains(refs, n["id"])), lambda n: n["note"]).alias("notes"),
        found.alias("warnings"))


# --- html -------------------------------------------------------------------------


class _Cells(HTMLParser):
    """Rows of every table (cell texts and links), anchors, and text tokens of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.anchors, self.tokens = [], [], []
        self._table, self._row, self._cell, self._anchor, self._mute = -1, None, None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._table += 1
        elif tag == "tr":
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = ["", []]
        elif tag == "sup":
            self._mute += 1
        elif tag == "br" and self._cell is not None:
            self._cell[0] += " "
        elif tag == "a" and dict(attrs).get("href"):
            self._anchor = [dict(attrs)["href"], ""]
            if self._cell is not None:
                self._cell[1].append(self._anchor[0])

    def handle_data(self, data):
        if data.strip():
            self.tokens.append(data.strip())
        if self._mute == 0 and self._cell is not None:
            self._cell[0] += data
        if self._anchor is not None:
            self._anchor[1] += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self._row.append((" ".join(self._cell[0].split()), self._cell[1]))
            self._cell = None
        elif tag == "tr" and self._row is not None:
            if self._row:
                self.rows.append((max(self._table, 0), self._row))
            self._row = None
        elif tag == "sup":
            self._mute = max(self._mute - 1, 0)
        elif tag == "a" and self._anchor is not None:
            self.anchors.append((self._anchor[0], " ".join(self._anchor[1].split())))
            self._anchor = None


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_key, table_no, row_no, cells, links): table rows of each page, streamed in Arrow batches."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch["page_key"], batch["html"], strict=True):
                parser = _Cells()
                parser.feed(text or "")
                out += [(page, table, number, [c[0] for c in row], [link for c in row for link in c[1]]) for number, (table, row) in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=["page_key", "table_no", "row_no", "cells", "links"])

    selected = pages.select(F.col(key).cast("string").alias("page_key"), F.col(html).alias("html"))
    return selected.mapInPandas(parse, "page_key string, table_no int, row_no int, cells array<string>, links array<string>")


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_key, link_no, href, label): every anchor of each page."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch["page_key"], batch["html"], strict=True):
                parser = _Cells()
                parser.feed(text or "")
                out += [(page, number, href, label) for number, (href, label) in enumerate(parser.anchors)]
            yield pd.DataFrame(out, columns=["page_key", "link_no", "href", "label"])

    selected = pages.select(F.col(key).cast("string").alias("page_key"), F.col(html).alias("html"))
    return selected.mapInPandas(parse, "page_key string, link_no int, href string, label string")


def html_tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_key, tokens): the visible text pieces of each page."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch["page_key"], batch["html"], strict=True):
                parser = _Cells()
                parser.feed(text or "")
                out.append((page, parser.tokens))
            yield pd.DataFrame(out, columns=["page_key", "tokens"])

    selected = pages.select(F.col(key).cast("string").alias("page_key"), F.col(html).alias("html"))
    return selected.mapInPandas(parse, "page_key string, tokens array<string>")


def read_filing_index(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Document links, acceptance time and filing date of filing index pages; the key is the accession."""
    rows = html_rows(pages, key, html)
    listed = rows.where(F.exists("cells", lambda c: form_of(c).isNotNull()))
    xml = listed.select("page_key", F.explode("links").alias("url")).where(F.lower(F.substring_index("url", "?", 1)).endswith(".xml"))
    # Styled links serve a browser transform; the document itself lies one level up.
    links = xml.select("page_key", F.regexp_replace("url", r"/xsl[A-Za-z0-9_-]+/", "/").alias("url")).groupBy("page_key").agg(F.sort_array(F.collect_set("url")).alias("document_urls"))
    after = lambda label: F.get("tokens", F.array_position("tokens", label).cast("int"))
    facts = html_tokens(pages, key, html).select("page_key", cal.eastern_instant(after("Accepted")).alias("accepted_at"), filing_date(after("Filing Date")).alias("filing_date"))
    return facts.join(links, "page_key", "left").withColumnRenamed("page_key", "accession")


def tables_by_header(rows: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """Data rows of the tables whose header names every required column, found by name and not position.

    ``required``: output column -> accepted header texts (lower case).
    """
    lowered = F.transform("cells", F.lower)
    position = {name: F.array_min(F.array_compact(F.array(*[F.when(F.array_position(lowered, h) > 0, F.array_position(lowered, h)) for h in accepted])))
                for name, accepted in required.items()}
    marked = rows.select("*", F.struct(*[p.cast("int").alias(n) for n, p in position.items()]).alias("_p"))
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(f"_p.{name}").isNotNull()
    headers = marked.where(complete).groupBy("page_key", "table_no").agg(F.min("row_no").alias("_head"), F.min_by("_p", "row_no").alias("_h"))
    data = rows.join(headers, ["page_key", "table_no"]).where(F.col("row_no") > F.col("_head"))
    return data.select("page_key", "table_no", "row_no", *[F.get("cells", F.col(f"_h.{n}") - 1).alias(n) for n in required])
