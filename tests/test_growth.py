"""Steps whose disk, memory or time grew faster than their input."""

from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from ledgertide.functions import disclosure as D, stats
from ledgertide.functions.text import clean
from ledgertide.operators import events as evt, search as sea, timeline as tml, trades as trd, versions as ver
from ledgertide.plans import proxies as px
from ledgertide.plans.people_queries import timeline
from ledgertide.plans import stream_queries as stq
from ledgertide.plans.stream_queries import play
from ledgertide.sources import disclosures as dis, event_lists as evl, exports as exp, filings as fil
from ledgertide.streaming import alerts, jobs
from tests.test_stream_state import PURCHASE, Pages, purchase, trade


def test_exported_text_is_compressed_and_reads_back(spark, tmp_path):
    rows = spark.range(20000, numPartitions=2).select(F.format_string("T%d", "id").alias("id"), F.lit("transaction").alias("basis"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("value"))
    for write, read in ((exp.write_json, lambda p: spark.read.schema(rows.schema).json(p)), (exp.write_csv, lambda p: spark.read.schema(rows.schema).csv(p, header=True))):
        path = str(tmp_path / write.__name__)
        write(rows, path)
        parts = list(Path(path).glob("part-*"))
        assert parts and all(p.suffix == ".gz" for p in parts)
        assert sum(p.stat().st_size for p in parts) < 20000 * 15  # a third of the text
        assert read(path).exceptAll(rows).count() == 0 and rows.exceptAll(read(path)).count() == 0


def test_pieces_of_names_are_never_broadcast(spark):
    """The planner takes exploded pieces for as large as their names, so it would broadcast them."""
    names = spark.range(2000).select("id", F.format_string("customer #%06d", "id").alias("name"))
    terms = names.where("id % 500 = 0").select(F.col("name").alias("term"))
    found = sea.name_matches(terms, names, "id", "name")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joined = plan[:plan.index("explode(array_distinct(concat(")]
    assert "SortMergeJoin" in joined and "BroadcastHashJoin" not in joined
    assert sorted(r["id"] for r in found.collect()) == [0, 500, 1000, 1500]


def test_totals_of_shared_windows_equal_those_of_their_bars(spark):
    bars = spark.range(40).selectExpr("'S' AS symbol", "date_add(DATE '2024-01-01', int(id)) AS session_date", "id * 1.25D AS open", "id * 2.0D AS high", "id * 1.0D AS low",
                                      "IF(id = 9, NULL, id * 1.5D) AS close", "1L AS volume", "IF(id IN (4, 11), 'INVALID', 'VALID') AS status")
    sessions = bars.selectExpr("session_date", "int(datediff(session_date, DATE '2023-12-31')) AS session_no")
    contexts = spark.range(300).selectExpr("id", "IF(id % 50 = 7, 'none', 'S') AS symbol", "IF(id % 40 = 3, NULL, int(id % 6 + 4)) AS transaction_no", "IF(id % 20 = 3, NULL, int(id % 9 + 5)) AS baseline_no").unionAll(
        spark.sql("SELECT 900L, 'S', 500, 510"))
    whole = trd.window_bars(contexts, bars, sessions, 3).groupBy("id").agg(
        F.count("*").alias("bars"), F.sum("close").alias("close_sum"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))
    totals = trd.window_totals(contexts, bars, sessions, 3)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, whole.collect())) and totals.count() > 250
    # the days that are laid out do not grow with the trades
    many = trd.window_totals(contexts.crossJoin(spark.range(20).toDF("copy")).withColumn("id", F.col("id") * 20 + F.col("copy")).drop("copy"), bars, sessions, 3)
    assert many.count() == 20 * totals.count()


def filed(spark, n, title="Common"):
    """Feed trades: four a group, some updates, owners alone, in pairs and missing."""
    return spark.range(n).selectExpr(
        "concat('t', id) AS id", "lpad(string(id % 3), 10, '0') AS issuer_id", "concat('A', id div 2) AS accession", "TIMESTAMP '2024-01-03 15:00:00' + make_dt_interval(int(id div 12)) AS accepted_at",
        "IF(id % 5 = 0, TIMESTAMP '2024-01-02 15:00:00', NULL) AS original_accepted_at", "IF(id % 5 = 0, 'A0', NULL) AS original_accession", "DATE '2024-01-01' AS transaction_date", "'CURRENT' AS status",
        "IF(id % 2 = 0, 'P', 'M') AS code", "IF(id % 7 = 0, 'II', 'I') AS table_no", f"'{title}' AS security_title", "decimal(id) AS amount", "true AS visible",
        "IF(id % 11 = 0, array(), array(string(id % 4), 'o')) AS owner_ids")


def exchanges(frame):
    return frame._jdf.queryExecution().sparkPlan().toString(), frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_feed_groups_shuffle_their_rows_once(spark):
    rows = ver.feed_rows(filed(spark, 60))
    groups = ver.feed_groups(rows)
    assert exchanges(groups)[1] == 1
    want = {}
    for r in rows.collect():
        g = want.setdefault(r["group_key"], [0, 0, 0, set(), set()])
        g[0 if not r["is_update"] else 1] += 1
        g[2] += 0 if r["is_update"] else r["amount"]
        g[3].update(r["owner_ids"])
        g[4].update(() if r["is_update"] else (r["group_accession"],))
    got = {r["group_key"]: (r["total_transactions"], r["amendment_updates"], r["known_amount"] or 0, r["owners"], r["filings"]) for r in groups.collect()}
    assert got == {k: (a, b, c, len(o), len(f)) for k, (a, b, c, o, f) in want.items()}
    assert sorted(map(tuple, ver.feed_contents(rows).collect())) == sorted(map(tuple, groups.select(*ver.REVISION).collect()))


def test_a_revised_log_reads_its_inputs_once(spark):
    stored = ver.feed_contents(ver.feed_rows(filed(spark, 40))).withColumn("seq", F.lit(1))
    changed = filed(spark, 60).where("issuer_id <> '0000000001'").withColumn("security_title", F.when(F.col("issuer_id") == "0000000002", "New").otherwise(F.col("security_title")))
    second = ver.feed_contents(ver.feed_rows(changed))
    log = ver.revised_log(stored, second, 2)
    assert exchanges(log)[1] <= 3  # the two inputs and their meeting
    added = ver.feed_revisions(stored, second, 2)
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, stored.unionByName(added).collect()))
    old, new = {r["group_key"]: r for r in stored.collect()}, {r["group_key"]: r for r in second.collect()}
    want = {k: r["row_count"] for k, r in new.items() if k not in old or old[k]["content"] != r["content"]} | {k: 0 for k in old if k not in new}
    assert {r["group_key"]: r["row_count"] for r in added.collect()} == want and 0 in want.values() and len(want) > 4
    third = ver.feed_revisions(log, second.limit(0), 3)  # tombstones once, and none for groups already gone
    assert {r["group_key"] for r in third.collect()} == set(new)
    listed = lambda rows: {k for k, r in rows.items() if "buy" in r["match_kinds"]}
    diff = {r["group_key"]: r["change"] for r in ver.diff_listing(log, 1, 2, "buy").collect()}
    assert diff == {k: "removed" for k in listed(old) - listed(new)} | {k: "changed" for k in listed(new) if k not in listed(old) or k in want}
    assert exchanges(ver.diff_listing(log, 1, 2, "buy"))[1] <= exchanges(log)[1] + 1


def test_two_parses_of_filings_are_shuffled_once(spark):
    def parse(rows):
        return spark.createDataFrame(rows, "id string, accession string, row_key string, n int").select("id", "accession", "row_key", F.col("n").cast("decimal(18,6)").alias("shares")).withColumns({
            "issuer_id": F.lit("i"), "accepted_at": F.lit("2024-01-01").cast("timestamp"), "table_no": F.lit("I"), "security_title": F.lit("C"), "transaction_date": F.lit("2024-01-01").cast("date"), "code": F.lit("P"),
            "direction": F.lit("A"), "currency": F.lit("USD"), "price": F.lit(None).cast("decimal(18,6)"), "shares_after": F.lit(1).cast("decimal(18,6)"), "owner_ids": F.array(F.lit("o"))})

    old = [(f"a{f}{i}", f"F{f}", f"k{i}", i // 2) for f in range(3) for i in range(6)] + [("ax", None, "k0", 0)]
    new = [(f"b{f}{i}", f"F{f}", f"k{i + f}", i // 2 if i < 5 else 50) for f in range(3) for i in range(6)] + [("bx", None, "k0", 0)]
    rows = ver.matched_rows(parse(old), parse(new))
    assert exchanges(rows)[1] == 1
    got = {r["id"]: r for r in rows.collect()}
    assert len(got) == len(old) + len(new)
    kept = {k: r["partner"] for k, r in got.items() if r["outcome"] == "kept"}
    assert len(kept) == 3 * 2 * 5 and all(kept[kept[k]] == k for k in kept)  # pairs, five a filing
    numbers = {r[0]: (r[1], r[3]) for r in old + new}
    assert all(numbers[k] == numbers[p] for k, p in kept.items())
    assert all(kept[f"b0{i}"] == f"a0{i}" for i in range(5)) and (got["b05"]["outcome"], got["b05"]["replaces_id"]) == ("new", None)  # a05 equals b04, so it is no correction
    assert got["ax"]["outcome"] == "superseded" and got["bx"]["outcome"] == "new"


def test_duplicates_are_found_with_one_shuffle_of_all_rows(spark):
    trades = filed(spark, 40).withColumns({"transaction_date": F.lit("2024-01-01").cast("date"), "direction": F.lit("A"), "shares": F.col("amount").cast("int") % 6, "price": F.lit(None).cast("decimal(18,6)"),
                                           "shares_after": F.lit(1).cast("decimal(18,6)")}).withColumn("issuer_id", F.when(F.col("shares") > 0, F.col("issuer_id")))
    found = ver.duplicates_across_filings(trades)
    assert exchanges(found)[1] == 2  # the rows, then the ids of marked ones
    rows, groups = trades.collect(), {}
    same = lambda r: (r["issuer_id"], r["table_no"], r["code"], r["shares"])
    for r in rows:
        for o in r["owner_ids"]:
            groups.setdefault((*same(r), o), []).append(r)
    want = {}
    for (issuer, *_), members in groups.items():
        if issuer is not None and len({m["accession"] for m in members}) > 1:
            first = min(members, key=lambda m: (m["accepted_at"], m["id"]))["id"]
            for m in members:
                want[m["id"]] = min(first, want.get(m["id"], first))
    assert {r["id"]: r["first_id"] for r in found.collect()} == want and len(want) > 10


def test_patterns_of_a_submission_run_once_a_document(spark):
    head = "<SEC-HEADER>\nACCESSION NUMBER:\t0000000001-01-000001\nCONFORMED SUBMISSION TYPE:\t4\nFILED AS OF DATE:\t20240102\n<ACCEPTANCE-DATETIME>20240102033000\n</SEC-HEADER>"
    own = lambda form: f"<DOCUMENT>\n<TYPE>{form}\n<XML><?xml version='1.0'?><ownershipDocument>x</ownershipDocument></XML></DOCUMENT>"
    other = "<DOCUMENT>\n<TYPE>EX-24\n<TEXT>power</TEXT></DOCUMENT>"
    texts = [head + other + own("4"), head + own("4") + own("4"), head + own("3"), own("4"), head.replace("TYPE:\t4", "TYPE:\t8-K") + own("4"), head + other, None]
    rows = fil.read_submission_text(spark.createDataFrame([(t,) for t in texts], "value string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?is)<SEC-HEADER>") == 1 and plan.count("(?is)<DOCUMENT>") == 1
    got = rows.collect()
    assert [r["reason"] for r in got] == [None, "ownership_document_missing_or_ambiguous", "submission_document_form_conflict", "sec_submission_header_missing", "unsupported_submission_form",
                                          "ownership_document_missing_or_ambiguous", "unsupported_submission_form"]
    assert got[0]["xml"] == "<?xml version='1.0'?><ownershipDocument>x</ownershipDocument>" and got[1]["xml"] is None
    assert (got[0]["accession"], got[0]["form"], str(got[0]["accepted_at"]), str(got[0]["filing_date"])) == ("0000000001-01-000001", "4", "2024-01-02 08:30:00", "2024-01-02")


def test_trees_held_at_once_do_not_grow_with_the_batch(spark, monkeypatch):
    xml = "concat('<ownershipDocument><documentType>4</documentType><nonDerivativeTable><nonDerivativeHolding><securityTitle><value> T', id, ' </value><value>2</value></securityTitle></nonDerivativeHolding></nonDerivativeTable></ownershipDocument>')"
    docs = spark.range(1000, numPartitions=1).selectExpr("id", f"IF(id = 700, 'no xml', {xml}) AS xml")
    assert {r["id"]: [e["security_title"] for e in r["elements"]] for r in fil.ownership_documents(docs, "xml", "id").collect()} == {i: [] if i == 700 else [f"T{i}"] for i in range(1000)}
    # the function Spark runs over the batches, called here on one batch of 1,000 documents
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: caught.append(function))
    fil.ownership_documents(docs, "xml", "id")
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "xml": [r["xml"] for r in docs.orderBy("id").collect()]})
    sizes = [b.num_rows for b in caught[0](iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= fil.PARSED_AT_ONCE


def test_warnings_read_no_facts_of_rows(spark):
    docs = spark.createDataFrame([(1, "<ownershipDocument><documentType>4</documentType><nonDerivativeTable><odd/></nonDerivativeTable></ownershipDocument>")], "id int, xml string")
    warned = fil.ownership_warnings(docs, "xml", "id")
    plan = warned._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "security_title" not in warned._jdf.queryExecution().analyzed().toJSON()
    assert sorted(r["warning"] for r in warned.collect()) == ["missing_or_invalid_issuer_cik", "no_reporting_owners", "unrecognized_table_child:I:1"]


def test_issuers_share_calls_and_states_by_bucket(spark, tmp_path):
    """One call of Python a bucket and batch, whatever the number of issuers."""
    trades = spark.readStream.schema("id string, accession string, issuer_id string, owner_ids array<string>, code string, form string, counted decimal(38,12), transaction_date date, accepted_at timestamp, "
                                     "received_at timestamp").parquet(str(tmp_path))
    plan = alerts.cluster_stream(trades, 7, 2)._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(issuer_id" in plan and f"cast({alerts.BUCKETS} as bigint)" in plan


def test_a_filing_in_several_frames_is_told_of_with_all_its_rows(spark, tmp_path):
    """Spark hands a bucket over in frames of so many rows; where one ends says nothing about a filing."""
    at, pages = datetime(2024, 3, 1), lambda landed: alerts.executive_stream(landed, 100, "2024-01-01 00:00:00", buckets=1)
    rows = [purchase(f"{n}", f"F{n % 2}", at, Decimal(100)) for n in range(6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = Pages(spark, tmp_path, PURCHASE, pages, alerts.EXECUTIVE_SCHEMA).land(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["dedupe_key"], r["rows"], r["amount"]) for r in found) == [(f"rule_executive:F{n}", 3, Decimal(300)) for n in range(2)]


def test_pages_of_the_tables_land_in_columns(spark, tmp_path):
    rows = spark.range(30).selectExpr("id", "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, int(id)) AS at", "array(struct(decimal(id / 8) AS amount)) AS parts")
    schema = "id long, at timestamp, parts array<struct<amount: decimal(38,12)>>"
    path = play(spark, rows, "at", schema, lambda landed, state: jobs.append(landed, str(tmp_path / "out"), state))
    parts = [p for p in Path(f"{path}/in").iterdir() if p.name.startswith("part-")]
    assert len(parts) >= 3 and all(p.suffix == ".parquet" for p in parts)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30 == spark.read.parquet(f"{path}/in").distinct().count()


def test_names_are_normalized_once_and_their_candidates_dealt_out(spark):
    """Filters on normalized names stay above the distinct names, so that no row is normalized that is no distinct name."""
    rows = spark.range(600, numPartitions=2).select(F.concat(F.lit("Northern Widgets "), F.element_at(F.array(F.lit("Alpha"), F.lit("Beta"), F.lit("Gamma")), (F.col("id") % 3 + 1).cast("int"))).alias("asset_name"))
    dictionary = sea.name_dictionary(rows.where("asset_name LIKE '%a'").select(F.col("asset_name").alias("name"), F.lit("NW").alias("ticker")))
    found = sea.match_names(rows.withColumn("asset_name", F.concat("asset_name", F.lit("s"))), dictionary)
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString() and "Range" not in dictionary._jdf.queryExecution().optimizedPlan().toString()
    assert "REPARTITION_BY_NUM" in sea.fuzzy_candidates(dictionary.select(F.col("name_key").alias("key")), dictionary)._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["asset_name"], r["ticker"], r["origin"]) for r in found.collect()) == [(f"Northern Widgets {n}s", "NW", "inferred") for n in ("Alpha", "Beta", "Gamma")]


def test_event_lists_are_shuffled_once_and_never_broadcast(spark):
    item = lambda name, quarter, ticker="abc": f'{{"ticker":"{ticker}","date":"2001-02-03","session":"during","name":"{name}","fiscal_year":2001,"fiscal_quarter":{quarter}}}'
    lists = {"a": [item("One", 1), item("ONE ", 2), item("Two", 2)], "b": [item("One", 1), item("Two", 2)], "c": [item("One", 1, "a b"), item("One", 1)], None: [item("One", 1, "a b"), item("One", 1), item("One", 1)]}
    rows = spark.createDataFrame([(k, "[" + ",".join(v) + "]") for k, v in lists.items()], "list string, value string")
    events, issues = evl.check_events(evl.read_event_list(rows, "list"), "list", "earnings")
    for frame in (events, issues):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1]
        assert initial.count("Exchange") == 1 and "Join" not in initial
    assert sorted((str(r["list"]), r["item"]) for r in events.collect()) == [("None", 2), ("None", 3), ("b", 1), ("b", 2)]
    assert sorted((str(r["list"]), r["item"], r["code"]) for r in issues.collect()) == [
        ("None", 1, "ticker_invalid"), ("a", 2, "duplicate_event"), ("a", 3, "duplicate_quarter"), ("c", 1, "ticker_invalid")]


def test_alike_events_are_counted_before_their_windows_are_laid_out(spark):
    events = spark.range(600).select(F.lit("T").alias("ticker"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("event_date"), F.lit("during").alias("session"), (F.col("id") % 2).alias("quarter"))
    shared = evt.alike(events, "quarter").collect()
    assert len(shared) == 6 and {r["events"] for r in shared} == {100}
    values = spark.createDataFrame([("T", "after", x, x, 0.0, x, 0.0, w) for x, w in ((-0.1, 3), (0.2, 1), (0.5, 1))],
                                   "ticker string, window string, value double, excess double, benchmark double, sector_excess double, sector double, events long")
    by_weight = evt.window_stats(values, ["ticker"], "events").first()
    row_by_row = evt.window_stats(values.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("events")))), ["ticker"]).first()
    assert by_weight == row_by_row and (by_weight["n"], by_weight["up"], by_weight["median"]) == (5, 2, -0.1)


def test_ranks_among_equals_are_counted_in_few_buckets(spark):
    rows = spark.range(4096, 8192).select(F.lit("k").alias("k"), F.lit(1.0).alias("x"), F.col("id").alias("pos"))
    ranks = stats.distributed_ranks(rows, ["k"], "x", "pos")
    assert f"/ cast({stats.BUCKETS // stats.TIE_BUCKETS} as double)" in ranks._jdf.queryExecution().analyzed().toString()
    assert sorted((r["pos"] - 4095, r["rank_asc"], r["rank_desc"]) for r in ranks.collect()) == [(n, n, n) for n in range(1, 4097)]


def test_people_are_summed_up_in_one_pass(spark):
    values = {"a": [0.3], "b": [0.2, -0.1], "c": [0.3, 0.1, 0.2], "d": [4.0, 1.0, 3.0, 1.0], "e": [0.1, 0.2, 0.4, -0.5, 0.0, 0.3]}
    rows = [(k, "buy", "after", "available", v) for k, vs in values.items() for v in vs] + [("a", "buy", "after", s, None) for s in ("pending", "intraday", "missing")] + [("f", "buy", "after", "missing", None)]
    got = tml.person_summary(spark.createDataFrame(rows, "person_id string, side string, anchor string, status string, value double"))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    found = {r["person_id"]: r for r in got.collect()}
    assert all(found[k]["values"] == sorted(values[k]) and found[k]["median"] is None for k in "abcd")
    assert found["e"]["values"] is None and abs(found["e"]["median"] - 0.15) < 1e-12 and (found["e"]["count"], found["e"]["up"]) == (6, 4)
    assert (found["a"]["pending"], found["a"]["missing"]) == (2, 1) and (found["f"]["count"], found["f"]["up"], found["f"]["values"], found["f"]["missing"]) == (0, 0, None, 1)


def test_trades_meet_their_owners_once(spark):
    trades = spark.createDataFrame([("1", "v", ["x", "y", "x"]), ("2", "v", ["z"]), ("3", "w", []), ("4", None, ["x"])], "id string, version_id string, owner_ids array<string>").withColumns({
        "accession": F.lit("A"), "accepted_at": F.lit("2024-01-02").cast("timestamp"), "transaction_date": F.lit("2024-01-01").cast("date"), "direction": F.lit("A"), "status": F.lit("CURRENT"), "filing_ticker": F.lit("T"),
        **{c: F.lit(1).cast("decimal(18,6)") for c in ("shares", "shares_after", "amount")}})
    owners = spark.createDataFrame([("v", "x", "Ex", "1", "CEO"), ("v", "y", None, None, None), ("w", "x", "No", None, None)], "version_id string, owner_id string, owner_name string, is_officer string, officer_title string").withColumns(
        {c: F.lit(None).cast("string") for c in ("is_director_flag", "is_ten_percent_owner", "is_other")})
    rows = trd.trade_view(trades, owners)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "explode" not in plan
    got = {r["id"]: r["owners"] and [(o["pos"], o["owner_name"], o["roles"]) for o in r["owners"]] for r in rows.collect()}
    assert got == {"1": [(0, "Ex", ["ceo"]), (1, "y", []), (2, "Ex", ["ceo"])], "2": [(0, "z", [])], "3": None, "4": [(0, "x", [])]}


def test_both_sides_of_decisions_meet_the_trades_in_one_join(spark):
    trades = spark.createDataFrame([(i, "I" if i != "x" else "J", "CURRENT", ["o"], "A" + i) for i in "abcdefx"], "id string, issuer_id string, status string, owner_ids array<string>, accession string").withColumns(
        {"accepted_at": F.lit("2024-01-02").cast("timestamp"), "original_accepted_at": F.lit(None).cast("timestamp"), "original_accession": F.lit(None).cast("string")})
    decisions = spark.createDataFrame([(1, "a", "b", "replace", "n"), (2, "c", None, "add", "n"), (3, "d", None, "replace", "n"), (4, "e", "x", "replace", "n"), (5, "gone", "f", "withdraw", "n"), (6, "f", "f", "withdraw", None)],
                                      "decision_no long, amended_id string, original_id string, action string, note string")
    applied, rejected = ver.resolve_amendments(trades, decisions)
    assert rejected._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r["decision_no"]: r["problem"] for r in rejected.collect()} == {3: "original_required", 4: "original_invalid", 5: "amended_missing", 6: "evidence_missing"}
    got = {r["id"]: (r["status"], r["replaces_id"], r["original_accession"]) for r in applied.collect()}
    assert got == {**{i: ("CURRENT", None, None) for i in "cdefx"}, "a": ("CURRENT", "b", "Ab"), "b": ("SUPERSEDED", None, None)}


def test_lines_without_evidence_are_never_matched(spark):
    """The cheap look at a raw line lets through every line that the patterns find something in once it is cleaned."""
    lines = ["P 1\x00/02/2024 $1,001 - $15,000", "Acme (AC\x00M) P 01\x00-02-2024 over  $\x00 5", "Beta Sale 5,000 \x00 – 7,000", "Wrapped \x00[ST]", "prose, with words - and no figure", "plain words only", "Purchase ,\t— , x"]
    df = spark.createDataFrame([(line,) for line in lines], "raw string").withColumn("line", clean(F.col("raw")))
    found = F.col("line").rlike(D.DATE) | F.col("line").rlike(D.AMOUNT) | F.col("line").rlike(D.OPEN_AMOUNT) | F.col("line").rlike(r"\([A-Z][A-Z0-9.\-]+\)|\[ST\]|\[OP\]")
    got = df.select(found.alias("found"), F.col("raw").rlike(D.EVIDENCE).alias("kept")).collect()
    assert [r["found"] for r in got] == [True, True, True, True, False, False, True] and all(r["kept"] or not r["found"] for r in got) and not got[5]["kept"]
    pages = spark.createDataFrame([("p", "\n".join(["plain words only"] * 50 + ["SP Acme (ACM) [ST]", "P 01/02/2024 $1,001 - $15,000"]))], "page string, body string")
    rows = dis.parse_disclosure_rows(pages, ["page"], "body")
    assert "RLIKE(raw" in rows._jdf.queryExecution().analyzed().toString()
    assert [(r["row_number"], r["ticker"], str(r["amount_low"])) for r in rows.collect()] == [(1, "ACM", "1001.00")]


def test_companies_of_the_overview_are_summed_up_once(spark):
    """The lists are counted and ranked from stored company rows; neither goes back to the owners of the trades."""
    from ledgertide.plans.insider_queries import overview_sections

    lists = overview_sections(spark, "/root/testdata/sf0.001")
    assert "explode(owner_ids" not in lists._jdf.queryExecution().optimizedPlan().toString()
    assert {r["section"] for r in lists.collect()} >= {"companies", "large_buys"}


def test_the_timeline_reads_line_items_once_a_side_and_meets_people_before_them(spark):
    sf = "/root/testdata/sf0.001"
    people, disclosed, reports = px.followed(spark, sf), px.disclosure_trades(spark, sf), px.disclosure_reports(spark, sf)
    found = timeline(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2
    # people meet orders and reports only: no join on a person lies above one that reads line items
    for join in [line for line in plan.splitlines() if "Join LeftSemi, (owner_id#" in line or "Join LeftSemi, (person_id#" in line]:
        below = plan.splitlines()[plan.splitlines().index(join) + 1:]
        depth = join.index("Join")
        inside = [line for k, line in enumerate(below) if all(len(x) - len(x.lstrip(" :+-")) > depth for x in below[:k + 1])]
        assert inside and not any("l_orderkey" in line for line in inside)
    whole = tml.people_timeline(px.trades(spark, sf), disclosed, reports, people)
    assert found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty() and found.count() > 1000


def test_trades_of_people_keep_joint_filings_once(spark, tmp_path):
    """Orders 5 and 10 are joint ones of customers 1 and 2, and of 7 and 8; nobody follows a customer without a key."""
    spark.sql("SELECT * FROM VALUES (5L, 1L), (10L, 7L), (11L, 2L), (12L, 9L), (13L, NULL) AS t(o_orderkey, o_custkey)").selectExpr(
        "*", "DATE '1996-01-02' AS o_orderdate", "'5-LOW' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(14).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "3L AS l_partkey", "4L AS l_suppkey", "100.0D AS l_extendedprice", "2.0D AS l_quantity", "0.01D AS l_tax", "0.02D AS l_discount",
                               "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP '1996-02-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    people = spark.sql("SELECT * FROM VALUES ('0000000001'), ('0000000002'), ('0000000008'), (NULL) AS t(person_id)")
    every = px.trades(spark, str(tmp_path))
    some = px.trades(spark, str(tmp_path), people)
    assert every.count() == 5 and sorted(r["accession"] for r in some.collect()) == ["A0000000005", "A0000000010", "A0000000011"]
    same = trd.join_owner_array(every, people.withColumnRenamed("person_id", "owner_id"))
    assert same.exceptAll(some).isEmpty() and some.exceptAll(same).isEmpty()


def test_pages_are_written_once(spark, tmp_path, monkeypatch):
    """No checkpoint holds the rows beside their pages, whatever is null, and empty pages land too."""
    monkeypatch.setattr(stq, "checkpoint", lambda df: (_ for _ in ()).throw(AssertionError("rows were stored besides their pages")))
    rows = spark.range(40).selectExpr("IF(id = 7, NULL, id div 2) AS id", "IF(id % 9 = 4, NULL, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, int(id))) AS at")
    schema = "id long, at timestamp"
    beat = spark.sql("SELECT 99L AS id, TIMESTAMP '2024-02-01 00:00:00' AS at")
    for name, table, options in (("all", rows, {}), ("parts", rows, {"slices": "id"}), ("none", rows.limit(0), {"slices": "id"}), ("named", rows.withColumn("_page", F.when(F.col("id") > 5, 2).otherwise(0)), {}), ("beat", rows, {"beats": beat})):
        starts = []

        def job(landed, state, out=str(tmp_path / name)):
            starts.append(landed)
            return jobs.append(landed, out, state)

        path = play(spark, table, "at", schema, job, **options)
        want = table.select("id", "at").unionAll(beat) if "beats" in options else table.select("id", "at")
        told = spark.read.schema(schema).parquet(str(tmp_path / name))
        assert told.exceptAll(want).isEmpty() and want.exceptAll(told).isEmpty() and len(starts) == (4 if "beats" in options else 3)
        assert spark.read.parquet(f"{path}/in").count() == want.count()
        assert [p for p in Path(f"{path}/pages").rglob("*.parquet")] == []


def test_filings_are_put_together_where_their_trades_met(spark, tmp_path, monkeypatch):
    """One shuffle a side; two keys of more than ten digits share an accession, and a key without an order or none at all gives no trade."""
    keys = "(1L), (1L), (2L), (12345678901L), (12345678902L), (12345678902L), (3L), (NULL)"
    spark.sql("SELECT * FROM VALUES (1L, 1L), (2L, NULL), (12345678901L, 3L), (12345678902L, 4L), (NULL, 5L) AS t(o_orderkey, o_custkey)").selectExpr(
        "*", "DATE '1998-01-02' AS o_orderdate", "'5-LOW' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(f"SELECT * FROM VALUES {keys} AS t(l_orderkey)").selectExpr(
        "l_orderkey", "1 AS l_linenumber", "3L AS l_partkey", "4L AS l_suppkey", "100.0D AS l_extendedprice", "2.0D AS l_quantity", "0.01D AS l_tax", "0.02D AS l_discount",
        "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP '1998-02-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(9).selectExpr("id AS c_custkey", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    monkeypatch.setattr(stq, "played", lambda spark, rows, *a, **o: seen.append(rows) or spark.createDataFrame([], alerts.TRADE_ALERT_SCHEMA))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stq.stream_trade_alerts(spark, str(tmp_path))
        assert exchanges(seen[0])[1] == 2
        assert sorted((r["accession"], len(r["trades"])) for r in seen[0].collect()) == [("A0000000001", 2), ("A0000000002", 1), ("A1234567890", 3)]
        every = px.trades(spark, str(tmp_path))
        met = px.trades(spark, str(tmp_path), by_filing=True)
        assert every.count() == 6 and every.exceptAll(met).isEmpty() and met.exceptAll(every).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_owner_meets_the_followed_people_once_a_filing(spark):
    at = lambda h: datetime(2024, 3, 1, h)
    own = lambda name, owners, hour, *o: trade(name, owners, at(hour), *o)
    filings = spark.createDataFrame([
        ("F1", "i", at(9), [own("a", ["p", "q"], 1), own("b", ["p"], 5), own("c", ["q", None], 2), own("d", ["p"], 5, "S")]),
        ("F2", "i", at(9), [own("e", ["p"], 2), own("f", [], 8), own("g", ["x"], 8, "M")]), ("F3", "i", at(9), [own("h", ["p"], 6), own("k", None, 6)]), ("F4", "i", at(9), [])], alerts.FILING_SCHEMA)
    followed = spark.createDataFrame([("p", at(4)), ("q", at(0)), ("x", at(0)), (None, at(0))], "person_id string, followed_at timestamp")
    found = alerts.filing_candidates(filings, followed, "2024-02-01 00:00:00")
    # p's first trade of F1 was accepted before p was followed, the others after; F2 is from before; owners of a trade of F3 are not known
    assert sorted((r["accession"], r["owner_id"], r["rows"]) for r in found.collect()) == [("F1", "p", 4), ("F1", "q", 4)]


def test_a_state_in_buckets_has_no_more_stores_than_buckets(spark, tmp_path, monkeypatch):
    """Each store takes megabytes, and a stream keeps its number when it starts anew."""
    monkeypatch.setattr(alerts, "BUCKETS", 3)
    followed = spark.createDataFrame([("p", datetime(2024, 1, 1))], "person_id string, followed_at timestamp")
    at = lambda n: datetime(2024, 3, 1 + n)
    rows = spark.createDataFrame([(f"F{n}", "i", at(n), [trade(f"t{n}", ["p"], at(n))]) for n in range(20)], alerts.FILING_SCHEMA)
    monkeypatch.setattr(stq, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(stq.px, "trades", lambda spark, sf, **o: rows.selectExpr("accession", "issuer_id", "inline(trades)"))
    monkeypatch.setattr(stq.px, "followed", lambda spark, sf: followed)
    monkeypatch.setattr(stq, "START", "2024-02-01 00:00:00")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert stq.stream_trade_alerts(spark, "").count() == 20
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    [state] = tmp_path.glob("landed-*/state/state/0")
    assert sorted(p.name for p in state.iterdir() if p.name.isdigit()) == ["0", "1", "2"]
