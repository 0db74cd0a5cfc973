import random
from datetime import date, datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgertide.functions import disclosure as D
from ledgertide.functions import text as T
from ledgertide.operators import overview as ovw
from ledgertide.operators import search as sea
from ledgertide.operators import versions as ver
from ledgertide.sources import disclosures as dis
from ledgertide.sources import filings as fil

D0 = date(2024, 1, 1)


def test_clusters_equal_the_window_scan(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"i{i % 7}", rng.choice("PS"), D0 + timedelta(rng.randrange(60)), [f"o{rng.randrange(9)}" for _ in range(rng.choice([1, 2]))], rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, issuer_id string, code string, transaction_date date, owner_ids array<string>, is_plan boolean")
    got = {r["id"] for r in ovw.cluster_trades(df, 7, 3, True).collect()}
    expected = set()
    for issuer in {r[1] for r in rows}:
        for code in "PS":
            mine = [r for r in rows if r[1] == issuer and r[2] == code and not r[5]]
            for end in sorted({r[3] for r in mine}, reverse=True):
                window = [r for r in mine if end - timedelta(6) <= r[3] <= end]
                if len({o for r in window for o in r[4]}) >= 3:
                    expected |= {r[0] for r in window}
                    break
    assert got == expected and expected


def test_fuzzy_names_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["ALPHA BRAVO ENERGY", "ALPHA BRAVO ENERGYS", "NORTHERN PACIFIC RAILWAY", "QUANTUM COMPUTING GROUP", "SMALL", "GENERAL MOTORS ACCEPTANCE"]
    names = []
    for name in base * 6:
        chars = list(name)
        for _ in range(rng.choice([0, 1, 2])):
            i = rng.randrange(len(chars))
            rng.choice([lambda: chars.pop(i), lambda: chars.insert(i, rng.choice("ABCXYZ")), lambda: chars.__setitem__(i, rng.choice("ABCXYZ"))])()
        names.append("".join(chars))
    candidates = spark.createDataFrame([(n, f"T{i}") for i, n in enumerate(base)], "name string, ticker string")
    dictionary = sea.name_dictionary(candidates)
    got = {r["asset_name"]: (r["ticker"], r["origin"]) for r in sea.match_names(spark.createDataFrame([(n,) for n in names], "asset_name string"), dictionary).collect()}
    keys = {r["asset_name"]: r["k"] for r in spark.createDataFrame([(n,) for n in set(names)], "asset_name string").select("asset_name", T.normalize_name(F.col("asset_name")).alias("k")).collect()}
    for name in set(names):
        key = keys[name]
        if key in base:
            assert got[name] == (f"T{base.index(key)}", "local_exact")
            continue
        hits = {f"T{i}" for i, b in enumerate(base) if len(key) >= 6 and SequenceMatcher(None, key, b, autojunk=False).ratio() > 0.94}
        assert got[name][0] == (next(iter(hits)) if len(hits) == 1 else None)


def test_normalized_names_and_tickers(spark):
    df = spark.createDataFrame([("M1CR050FT Corp. Common Stock [ST]", "NONE", "len, LEN.B"), ("Route 66 Inc", "BRK.B", None)], "n string, a string, b string")
    rows = df.select(T.normalize_name(F.col("n")).alias("n"), T.display_ticker(F.col("a"), F.col("b")).alias("t"), T.ticker_tokens(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r["n"] for r in rows] == ["M1CROSOFT", "ROUTE 66"]
    assert [r["t"] for r in rows] == ["LEN", "BRK.B"] and rows[0]["k"] == ["NONE", "LEN", "LEN-B"]


def test_plan_notes_and_price_ranges(spark):
    notes = [("0", ["Sold under a Rule 10b5-1 plan."]), ("0", ["Not made under a 10b5-1 plan."]), ("1", []), ("0", ["Weighted average price; prices ranged from $10.10 to $1,012.50."])]
    low, high = T.weighted_price_range(F.col("notes"))
    rows = spark.createDataFrame(notes, "flag string, notes array<string>").select(T.plan_flag(F.col("flag"), F.col("notes")).alias("p"), low.alias("l"), high.alias("h")).collect()
    assert [r["p"] for r in rows] == [True, False, True, False]
    assert (float(rows[3]["l"]), float(rows[3]["h"])) == (10.10, 1012.50)


def version_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, accession string, row_key string, n int").select("id", "accession", "row_key", F.col("n").cast("decimal(18,6)").alias("shares")).withColumns({
        "issuer_id": F.lit("i"), "accepted_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "table_no": F.lit("I"), "security_title": F.lit("Common"), "transaction_date": F.lit("2024-01-01").cast("date"),
        "code": F.lit("P"), "direction": F.lit("A"), "currency": F.lit("USD"), "price": F.lit(1).cast("decimal(18,6)"), "shares_after": F.lit(1).cast("decimal(18,6)"), "owner_ids": F.array(F.lit("o"))})


def test_versions_keep_equal_rows_and_supersede_changed_ones(spark):
    old = version_rows(spark, [("a1", "A", "k1", 5), ("a2", "A", "k2", 6), ("a3", "A", "k3", 6), ("a4", "A", "k4", 9)])
    # A row inserted above: k1 is new, the former k1 moved to k2; one of two equal rows stays; k4 was corrected.
    new = version_rows(spark, [("b1", "A", "k1", 7), ("b2", "A", "k2", 5), ("b3", "A", "k3", 6), ("b4", "A", "k4", 8)])
    rows, status = ver.match_filing_versions(old, new)
    got = {r["new_id"]: (r["outcome"], r["kept_id"], r["replaces_id"]) for r in rows.collect()}
    assert got == {"b1": ("new", None, None), "b2": ("kept", "a1", None), "b3": ("kept", "a3", None), "b4": ("replaces", None, "a4")}
    assert {r["old_id"]: r["status"] for r in status.collect()} == {"a1": "kept", "a2": "superseded", "a3": "kept", "a4": "superseded"}


OWNERSHIP = """<?xml version="1.0"?><ownershipDocument><documentType>4A</documentType><periodOfReport>2026-08-31</periodOfReport><aff10b5One>0</aff10b5One>
<issuer><issuerCik>123</issuerCik><issuerName>Example</issuerName><issuerTradingSymbol>DEMO</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>456</rptOwnerCik><rptOwnerName>A</rptOwnerName></reportingOwnerId></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerCik>789</rptOwnerCik><rptOwnerName>B</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeHolding><securityTitle><value>Class B</value></securityTitle></nonDerivativeHolding>
<nonDerivativeTransaction><securityTitle><value>Common Stock</value></securityTitle><transactionDate><value>2026-08-31</value></transactionDate>
<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100000</value><footnoteId id="F1"/></transactionShares>
<transactionPricePerShare><value>25.25</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>
<footnotes><footnote id="F1">joint filing</footnote></footnotes></ownershipDocument>"""


def test_ownership_rows_in_document_order(spark):
    rows = fil.parse_ownership(spark.createDataFrame([(OWNERSHIP,)], "xml string")).orderBy("source_row_index").collect()
    assert [(r["source_row_index"], r["row_kind"], r["action_category"]) for r in rows] == [(1, "holding", "holding"), (2, "transaction", "purchase_market_or_private")]
    assert rows[1]["owner_ids"] == ["0000000456", "0000000789"] and rows[1]["form"] == "4/A" and float(rows[1]["shares"]) == 100000
    assert rows[1]["footnote_ids"] == ["F1"] and rows[1]["notes"] == ["joint filing"] and rows[1]["warnings"] == []


def test_disclosure_cells_and_text_rows(spark):
    cells = spark.createDataFrame([("Purchose", "$1,001 - $15,000"), ("S (partial)", "Over $1,000,000"), ("zzz", "$250.50")], "d string, a string")
    low, high = D.money(F.col("a"))
    rows = cells.select(D.ocr_direction(F.col("d")).alias("d"), low.alias("l"), high.alias("h")).collect()
    assert [r["d"] for r in rows] == ["purchase", "partial_sale", "unknown"]
    assert [(float(r["l"]), r["h"] and float(r["h"])) for r in rows] == [(1001, 15000), (1000001, None), (250.5, 250.5)]
    text = "Owner\nSP Beta Fund [MF] P 01/02/2025 01/03/2025 $1,001 - $15,000\nPage 1 of 2"
    parsed = dis.parse_disclosure_rows(spark.createDataFrame([(1, text)], "page int, body string"), ["page"], "body").first()
    assert (parsed["owner"], parsed["asset_type"], parsed["transaction_type"], parsed["transaction_date"], parsed["notification_date"]) == (
        "spouse", "fund", "purchase", date(2025, 1, 2), date(2025, 1, 3))


def test_accepted_corrections_move_to_the_original_group(spark):
    at = lambda d: datetime(2024, 1, d, 15)
    rows = [("x", "A1", at(2), "CURRENT", None, None), ("y", "A2", at(9), "CURRENT", at(2), "A1")]
    trades = spark.createDataFrame(rows, "id string, accession string, accepted_at timestamp, status string, original_accepted_at timestamp, original_accession string").withColumns({
        "issuer_id": F.lit("i"), "visible": F.lit(True), "transaction_date": F.lit("2024-01-01").cast("date"), "code": F.lit("P"), "table_no": F.lit("I"), "amount": F.lit(5).cast("decimal(38,12)"),
        "shares": F.lit(1).cast("decimal(18,6)"), "price": F.lit(5).cast("decimal(18,6)"), "owner_ids": F.array(F.lit("o"))})
    groups = {r["group_day"]: r for r in ver.feed_groups(ver.feed_rows(trades)).collect()}
    first, update = groups[date(2024, 1, 2)], groups[date(2024, 1, 9)]
    assert (first["total_transactions"], first["filings"], first["amendment_updates"]) == (2, 1, 0)
    assert (update["total_transactions"], update["amendment_updates"], update["known_amount"]) == (0, 1, None)


def test_asset_class_decides_what_is_looked_up(spark):
    dictionary = sea.name_dictionary(spark.createDataFrame([("Netflix Inc", "NFLX"), ("Acme Fund", "FUND"), ("Meta Platforms Inc", "META"), ("Two Corp", "AAA"), ("Two Inc", "BBB")], "name string, ticker string"))
    rows = [("NETFLIX INC 4.875% 2028", "bond", None, ["ocr"], "review"), ("Netflix Notes Due 2030", "bond", None, [], "parsed"), ("Acme Fund", "fund", None, [], "parsed"), ("Acme Fund", "option", None, [], "parsed"),
            ("META PLATFORMS INC", "unknown", None, ["ocr", "unknown_asset_type"], "review"), ("Meta Platform Inc", "unknown", None, ["unknown_asset_type"], "review"), ("META PLATFORMS INC", "stock", "OWN", None, "parsed"),
            ("Two", "unknown", None, ["unknown_asset_type"], "review"), ("Nobody", "stock", None, None, "parsed"), ("META PLATFORMS INC", "crypto", None, [], "parsed"), (None, "stock", None, [], "parsed"), ("5% Notes", "bond", None, [], "parsed")]
    frame = spark.createDataFrame(rows, "asset_name string, asset_type string, ticker string, warnings array<string>, confidence string")
    got = {(r["asset_name"], before[1]): r for before in rows for r in sea.match_assets(frame, dictionary).collect() if r["asset_name"] == before[0] and (r["asset_type"] == before[1] or before[1] == "unknown" and r["lookup"] == "name" and r["ticker_origin"])}
    netflix = got["NETFLIX INC 4.875% 2028", "bond"]
    assert (netflix["ticker"], netflix["issuer_ticker"], netflix["issuer_ticker_origin"], netflix["warnings"]) == (None, "NFLX", "local_exact", ["ocr"])
    assert got["Netflix Notes Due 2030", "bond"]["issuer_ticker"] == "NFLX" and got["5% Notes", "bond"]["issuer_ticker"] is None
    assert got["Acme Fund", "fund"]["ticker"] is None and got["Acme Fund", "option"]["lookup"] == "none" and got["META PLATFORMS INC", "crypto"]["ticker"] is None
    meta = got["META PLATFORMS INC", "unknown"]
    assert (meta["ticker"], meta["asset_type"], meta["warnings"], meta["confidence"], meta["ticker_origin"]) == ("META", "stock", ["ocr"], "review", "local_exact")
    near = got["Meta Platform Inc", "unknown"]
    assert (near["ticker"], near["ticker_origin"], near["warnings"], near["confidence"]) == ("META", "inferred", [], "parsed")
    two = got["Two", "unknown"]
    assert (two["ticker"], two["asset_type"], two["warnings"]) == (None, "unknown", ["unknown_asset_type"])


def test_scanned_directions_follow_the_plain_rule(spark):
    import re

    from ledgertide.functions import disclosure as D

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(9)
    cells = ["", "P", "s ", "E", "pe", "sale (full)", "S (partial)", "5ale", "sa1e", "purch", "zzz", "p.", "S.", "1", "saleul", "salepartal", "exch4nge", "excange", "ale"]
    for label, *_ in D.OCR_LABELS * 12:
        chars = list(label)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rng.choice([lambda: chars.pop(rng.randrange(len(chars))), lambda: chars.insert(rng.randrange(len(chars) + 1), rng.choice("aelo0 1-")), lambda: chars.__setitem__(rng.randrange(len(chars)), rng.choice("aelox"))])()
        cells.append("".join(chars))
    for r in spark.createDataFrame([(c,) for c in cells], "c string").select("c", D.ocr_direction(F.col("c")).alias("d"), D.direction(F.col("c")).alias("plain")).collect():
        cell = r["c"].lower()
        if r["plain"] != "unknown" and (len(re.sub("[^a-z]", "", cell)) >= 3 or cell.strip() in ("p", "s", "e")):
            want = r["plain"]
        else:
            word = re.sub("[^a-z0-9]", "", cell).translate(str.maketrans("10", "lo"))
            near = min(edits(word, label) for label, _, _ in D.OCR_LABELS)
            best = [(m, a, label) for label, m, a in D.OCR_LABELS if edits(word, label) == near]
            meaning, allowed, label = best[0]
            want = meaning if len({m for m, _, _ in best}) == 1 and near <= allowed and len(word) >= len(label) - allowed else "unknown"
        assert r["d"] == want, r["c"]
