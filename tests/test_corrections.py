"""Corrections that must not lose data, revisions that must see every field, and search blocks on whole terms."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgertide.operators import bars as bar, search as sea, versions as ver
from ledgertide.sources import filings as fil

BAR = "symbol string, session_date date, open double, high double, low double, close double"


def series(spark, symbol, days, close=10.0, **odd):
    return spark.createDataFrame([(symbol, date(2024, 1, d), 10.0, 11.0, 9.0, odd.get(f"d{d}", close)) for d in days], BAR)


@pytest.mark.parametrize("days,odd,full,want", [
    ((3,), {}, False, ({1, 2, 3}, False, False)), ((3,), {"d3": 20.0}, False, ({1, 2, 3}, False, True)), ((1, 2, 3, 4), {"d3": 20.0}, True, ({1, 2, 3, 4}, True, False)),
    ((3, 4), {}, False, ({1, 2, 3, 4}, False, False)), ((3,), {"d3": None}, False, ({1, 2, 3}, False, True)), ((1, 3), {}, False, ({1, 2, 3}, False, True)),
    ((1, 3, 4), {}, True, ({1, 3, 4}, True, False))])
def test_a_partial_refetch_never_replaces_a_series(spark, days, odd, full, want):
    stored = series(spark, "A", (1, 2, 3)).union(series(spark, "B", (1,)))
    rows = bar.correct_bars(stored, series(spark, "A", days, **odd).withColumn("is_full", F.lit(full))).where("symbol = 'A'").collect()
    assert ({r["session_date"].day for r in rows}, any(r["replaced"] for r in rows), any(r["needs_full"] for r in rows)) == want


def feed(spark, **change):
    row = {"id": "t1", "issuer_id": "0000000001", "accession": "A1", "original_accession": None, "accepted_at": datetime(2024, 1, 3, 15), "original_accepted_at": None, "transaction_date": date(2024, 1, 2),
           "status": "CURRENT", "code": "P", "direction": "A", "table_no": "I", "security_title": "Common", "currency": None, "shares": Decimal(5), "price": None, "amount": None, "shares_after": Decimal(7),
           "is_plan": None, "is_ceo": True, "owner_ids": ["o"], "filing_ticker": "T", "visible": True}
    schema = ("id string, issuer_id string, accession string, original_accession string, accepted_at timestamp, original_accepted_at timestamp, transaction_date date, status string, code string, direction string, "
              "table_no string, security_title string, currency string, shares decimal(18,6), price decimal(18,6), amount decimal(18,6), shares_after decimal(18,6), is_plan boolean, is_ceo boolean, owner_ids array<string>, "
              "filing_ticker string, visible boolean")
    return ver.feed_groups(ver.feed_rows(spark.createDataFrame([tuple({**row, **change}.values())], schema)))


CHANGES = [{"transaction_date": date(2024, 1, 1)}, {"security_title": "Preferred"}, {"currency": "USD"}, {"shares": None, "price": Decimal(5)}, {"shares_after": None}, {"is_plan": False}, {"is_ceo": False},
           {"owner_ids": ["p"]}, {"direction": "D"}, {"filing_ticker": None}, {"original_accession": "A0"}]


def test_every_shown_field_makes_a_revision(spark):
    stored = feed(spark).withColumn("seq", F.lit(1)).cache()
    assert ver.feed_revisions(stored, feed(spark), 2).count() == 0
    contents = {stored.first()["content"]}
    for change in CHANGES:
        contents.add(feed(spark, **change).first()["content"])
    assert len(contents) == len(CHANGES) + 1


def test_search_checks_all_words_and_blocks_on_the_rarest_piece(spark):
    names = [(i, f"supplier {i:03d} of one two three four five six seven {'eight' if i == 5 else 'nine'}") for i in range(40)]
    entities = spark.createDataFrame(names, "key long, name string")
    terms = spark.createDataFrame([("one two three four five six seven eight",), ("supplier 007",), ("x",), ("zz supplier",), ("e",)], "term string")
    got = sorted(tuple(r) for r in sea.name_matches(terms, entities, "key", "name").collect())
    assert got == sorted((t, i) for (t,) in [r for r in terms.collect()] for i, n in names if all(w in n for w in t.split()))
    grams = entities.select("key", F.lower("name").alias("_n")).withColumn("_block", F.explode(sea._grams(F.col("_n"))))
    blocks = {r["term"]: r["_block"] for r in sea.with_block(terms.where("term = 'supplier 007'"), F.array(F.lit("sup"), F.lit("007")), grams).collect()}
    assert blocks == {"supplier 007": "007"}


def test_ownership_warnings_and_quotes(spark):
    xml = """<ownershipDocument><documentType>4</documentType><periodOfReport>soon</periodOfReport><issuer><issuerCik>x</issuerCik></issuer>
    <nonDerivativeTable attr="1"><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares><value>-3</value></transactionShares></transactionAmounts><securityTitle><footnoteId id='F9'/></securityTitle></nonDerivativeTransaction><derivativeHolding/></nonDerivativeTable>
    <footnotes><footnote>no id</footnote></footnotes></ownershipDocument>"""
    frame = spark.createDataFrame([(xml,)], "xml string")
    rows = fil.parse_ownership(frame).collect()
    assert len(rows) == 1 and rows[0]["shares"] is None and rows[0]["source_row_index"] == 1
    assert rows[0]["warnings"] == ["missing_footnote:F9", "incomplete_transaction_coding", "code_direction_conflict", "invalid_number:shares"]
    assert sorted(r["warning"] for r in fil.ownership_warnings(frame).collect()) == [
        "duplicate_or_missing_footnote_id", "invalid_date:period_of_report", "missing_or_invalid_issuer_cik", "no_reporting_owners", "unrecognized_table_child:I:2"]
