"""Versions, amendments, revisions and the set operations on them, all as joins on keys and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.operators.trades import KINDS, VISIBLE, eastern_day, matches_kind, sort_date

# --- keyed tables -----------------------------------------------------------------


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; max_by combines map-side, so a hot key never lands in one sort."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*rows.columns)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or replace by key, newer only; on equal order the incoming row wins."""
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(tagged, keys, [*order, "_new"]).drop("_new")


def insert_once(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first one per key."""
    others = [c for c in incoming.columns if c != key]
    firsts = incoming.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    firsts = firsts.select(key, *[F.col("_row")[c].alias(c) for c in others]).select(*incoming.columns)
    return firsts.join(existing.select(key), key, "left_anti")


def replace_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """Re-parsed groups (a report page, an index list) replace their rows as a whole.

    ``touched`` lists the groups that were re-parsed even when they produced no row.
    """
    scope = (touched if touched is not None else incoming).select(*keys).distinct()
    return existing.join(scope, list(keys), "left_anti").unionByName(incoming)


def replace_members(stored: DataFrame, incoming: DataFrame, known: DataFrame) -> DataFrame:
    """A valid list (non-empty, unique tickers) replaces the stored one; a failed load keeps it.

    A missing CIK is taken from ``known`` (ticker, cik).
    """
    checks = incoming.groupBy("index_name", "ticker").agg(F.count("*").alias("_n")).groupBy("index_name").agg(
        F.max("_n").alias("_copies")).where("_copies = 1").select("index_name")
    filled = (incoming.join(checks, "index_name", "left_semi")
              .join(known.groupBy("ticker").agg(F.min("cik").alias("_cik")), "ticker", "left")
              .withColumn("cik", F.coalesce("cik", "_cik")).drop("_cik"))
    return replace_rows(stored, filled.select(*stored.columns), ["index_name"])


def reuse_result(wanted: DataFrame, results: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Wanted computations with their input key; rows whose key has no live result must be computed."""
    keyed = wanted.withColumn("input_key", F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256))
    live = results.where("NOT expired").select("input_key").distinct().withColumn("_hit", F.lit(True))
    return keyed.join(live, "input_key", "left").withColumn("reused", F.coalesce("_hit", F.lit(False))).drop("_hit")


def result_freshness(inputs: DataFrame, key: str, at: str) -> DataFrame:
    """Earliest fetch and expiry over a result's inputs; expired when any of them lapsed."""
    stamp = F.lit(at).cast("timestamp")
    return inputs.groupBy(key).agg(
        F.min("fetched_at").alias("fetched_at"), F.min("expires_at").alias("expires_at"),
        F.bool_or(F.col("expires_at") <= stamp).alias("expired"), F.count("*").alias("inputs"))


def expire_ttl(rows: DataFrame, at: str, fetched: str = "fetched_at", hours: int = 24, expires: str | None = None) -> DataFrame:
    """Rows still alive: not past their explicit expiry, else not older than ``hours``."""
    limit = F.col(fetched) + F.make_dt_interval(hours=F.lit(hours))
    if expires is not None:
        limit = F.coalesce(F.col(expires), limit)
    return rows.where(limit > F.lit(at).cast("timestamp"))


def keyset_page(rows: DataFrame, order: Sequence[str], k: int, after: Sequence[Column] | None = None) -> DataFrame:
    """The next k rows strictly after a key tuple, all columns descending; one extra row tells of more."""
    key = F.struct(*[F.col(c) for c in order])
    page = rows if after is None else rows.where(key < F.struct(*[v.alias(c) for v, c in zip(after, order, strict=True)]))
    return page.orderBy(*[F.desc(c) for c in order]).limit(k + 1)


def encode_cursor(order: Sequence[str]) -> Column:
    return F.base64(F.encode(F.to_json(F.array(*[F.col(c).cast("string") for c in order])), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    return F.from_json(F.decode(F.unbase64(cursor), "UTF-8"), "array<string>")


# --- the feed ---------------------------------------------------------------------


def group_key() -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.col("issuer_id"), F.col("group_day").cast("string")), 256), 1, 32)


def feed_rows(trades: DataFrame) -> DataFrame:
    """Every feed row with its group (issuer, Eastern acceptance day).

    ``trades`` carries original_accepted_at / original_accession for accepted corrections: those count in
    the original's group and appear once more, without value, as an update on their own day.
    """
    shown = trades.where(F.col("status").isin(*VISIBLE) & F.col("visible"))
    time = F.coalesce("original_accepted_at", "accepted_at")
    rows = shown.withColumns({
        "group_accepted_at": time, "group_day": eastern_day(time), "group_accession": F.coalesce("original_accession", "accession"),
        "is_update": F.lit(False)}).where("group_day IS NOT NULL")
    late = shown.where((F.col("status") == "CURRENT") & F.col("original_accepted_at").isNotNull()
                       & (eastern_day("original_accepted_at") < eastern_day("accepted_at")))
    updates = late.withColumns({
        "group_accepted_at": F.col("accepted_at"), "group_day": eastern_day("accepted_at"), "group_accession": F.col("accession"),
        "is_update": F.lit(True)})
    both = rows.unionByName(updates)
    return both.withColumn("group_key", group_key())


#: What a feed entry shows of a row, and so what makes a revision when it changes.
CONTENT = ("id", "is_update", "issuer_id", "accession", "original_accession", "accepted_at", "original_accepted_at", "transaction_date", "status", "code", "direction",
           "table_no", "security_title", "currency", "shares", "price", "amount", "shares_after", "range_low", "range_high", "is_plan", "is_ceo", "is_cfo", "is_president",
           "is_chair", "is_director", "is_ten_percent", "owner_ids", "filing_ticker", "summary", "form")


def _kinds_of(mask: Column) -> list[Column]:
    """Whether each facet's bit is set."""
    return [mask.bitwiseAND(F.lit(1 << bit)) != 0 for bit in range(len(KINDS))]


def _narrow(rows: DataFrame, *others: str) -> DataFrame:
    """What the aggregates of feed rows read: the facets in one number, the shown fields in two hashes."""
    shown = F.sha2(F.to_json(F.struct(*[c for c in CONTENT if c in rows.columns]), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(shown, at, 15), 16, 10).cast("long")
    mask = sum((F.when(matches_kind(kind), 1 << bit).otherwise(0) for bit, kind in enumerate(KINDS)), F.lit(0))
    return rows.select("group_key", "issuer_id", "group_day", "group_accepted_at", *others, mask.alias("_mask"), half(1).alias("_first"), half(17).alias("_second"))


def _content(n: Column) -> Column:
    """Order-free hash of the ``n`` rows of a group."""
    half = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return F.concat_ws(":", n, half("_first"), half("_second"))


def _facets(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has, F.lit(kind)) for kind, has in zip(KINDS, _kinds_of(mask), strict=True)]))


def feed_groups(rows: DataFrame) -> DataFrame:
    """One row per group: dates, owners, filings, row counts, facets, sort dates and a content hash.

    Transactions stay rows keyed by group_key instead of a collected list, and the content hash is
    order-free: sums of the two halves of each row's SHA-256 over all shown fields, NULLs included. Narrow rows are
    shuffled once, by issuer and day; every aggregate and distinct count of a group then runs where its rows are.
    """
    amount = F.when(~F.col("is_update") & (F.col("status") == "CURRENT"), F.col("amount"))
    narrow = _narrow(rows.withColumns({"_ordered": sort_date(), "_amount": amount}), "group_accession", "owner_ids", "is_update", "_ordered", "_amount")
    dealt = narrow.drop("group_key").repartition("issuer_id", "group_day")
    # A row stands for itself (0), for each owner (1) and for its filing (2); equal marks of a group become one.
    mark = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value"))
    own, ordered = ~F.col("is_update"), F.col("_ordered")
    marks = F.concat(F.array(mark(0, F.lit(None)), mark(2, F.when(own, F.col("group_accession")))), F.transform(F.coalesce("owner_ids", F.array().cast("array<string>")), lambda o: mark(1, o)))
    each = dealt.select(*[c for c in dealt.columns if c != "owner_ids"], F.explode(marks).alias("_m"))
    key = ["issuer_id", "group_day"]
    once = each.groupBy(*key, F.col("_m.tag").alias("_tag"), F.col("_m.value").alias("_value")).agg(
        F.max("group_accepted_at").alias("accepted_at"), F.min(F.when(own, ordered)).alias("first_date"), F.max(F.when(own, ordered)).alias("last_date"),
        F.count_if(own).alias("total_transactions"), F.count_if("is_update").alias("amendment_updates"), F.count("*").alias("row_count"),
        F.sum("_amount").alias("known_amount"), F.bit_or("_mask").alias("_kinds"),
        *[F.max(F.when(has, ordered)).alias(f"_sort_{kind}") for kind, has in zip(KINDS, _kinds_of(F.col("_mask")), strict=True)],
        _content(F.count("*")).alias("content"))
    counted = lambda tag: F.count(F.when(F.col("_tag") == tag, F.col("_value")))
    groups = once.groupBy(*key).agg(
        *[F.max(F.when(F.col("_tag") == 0, F.col(c))).alias(c) for c in once.columns if c not in (*key, "_tag", "_value")], counted(1).alias("owners"), counted(2).alias("filings"))
    dates = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.col(f"_sort_{k}") for k in KINDS]))
    return groups.select(
        group_key().alias("group_key"), "issuer_id", "group_day", "accepted_at", "first_date", "last_date", "total_transactions", "amendment_updates", "row_count", "known_amount",
        _facets(F.col("_kinds")).alias("match_kinds"), "content", dates.alias("sort_dates"), "owners", "filings")


#: What a revision keeps of a group.
REVISION = ("group_key", "issuer_id", "accepted_at", "match_kinds", "row_count", "content")


def feed_contents(rows: DataFrame) -> DataFrame:
    """The columns of ``feed_groups`` that make a revision, combined before the one shuffle they need, by group_key."""
    groups = _narrow(rows).groupBy("group_key").agg(
        F.max("issuer_id").alias("issuer_id"), F.max("group_accepted_at").alias("accepted_at"), F.bit_or("_mask").alias("_kinds"),
        F.count("*").alias("row_count"), _content(F.count("*")).alias("content"))
    return groups.withColumn("match_kinds", _facets(F.col("_kinds"))).select(*REVISION)


def _compared(stored: DataFrame, groups: DataFrame, seq: int, whole: bool) -> DataFrame:
    """Stored revisions and the groups of a commit side by side, in one pass over each group's few revisions."""
    both = stored.select(*REVISION, "seq", F.lit(False).alias("_new")).unionByName(groups.select(*REVISION, F.lit(seq).alias("seq"), F.lit(True).alias("_new")))
    w = Window.partitionBy("group_key").orderBy("_new", "seq")
    marked = both.withColumns({"_before": F.lag("content").over(w), "_last": F.lead(F.lit(True)).over(w).isNull()})
    new, columns = F.col("_new"), [*REVISION, "seq"]
    changed = new & ~F.col("_before").eqNullSafe(F.col("content"))
    empty = {"match_kinds": F.array().cast("array<string>"), "row_count": F.lit(0).cast("long"), "content": F.lit("0"), "seq": F.lit(seq)}
    tombstone = F.struct(*[empty.get(c, F.col(c)).alias(c) for c in columns])
    out = F.array_compact(F.array(F.when((~new if whole else F.lit(False)) | changed, F.struct(*columns)), F.when(~new & F.col("_last") & (F.col("row_count") > 0), tombstone)))
    return marked.select(F.explode(out).alias("r")).select("r.*")


def feed_revisions(stored: DataFrame, groups: DataFrame, seq: int) -> DataFrame:
    """Revisions to append: groups that are new or whose content changed, and tombstones of vanished ones.

    Both tables: group_key, issuer_id, accepted_at, match_kinds, row_count, content (+ seq when stored).
    """
    return _compared(stored, groups, seq, False)


def revised_log(stored: DataFrame, groups: DataFrame, seq: int) -> DataFrame:
    """The stored revisions followed by those of ``feed_revisions``, each input read once."""
    return _compared(stored, groups, seq, True)


def snapshot_asof(revisions: DataFrame, seq: int) -> DataFrame:
    """The newest revision of each group at or before a sequence number; tombstones drop out."""
    return latest_per_key(revisions.where(F.col("seq") <= seq), ["group_key"], ["seq"])


def listing(snapshot: DataFrame, kind: str) -> DataFrame:
    return snapshot.where((F.col("row_count") > 0) & F.array_contains("match_kinds", kind))


def diff_listing(revisions: DataFrame, base: int, target: int, kind: str) -> DataFrame:
    """Groups changed or removed between two sequence numbers for one facet; both snapshots come from one pass."""
    seq, listed = F.col("seq"), F.coalesce((F.col("row_count") > 0) & F.array_contains("match_kinds", kind), F.lit(False))
    upto = lambda number: F.when(seq <= number, seq)
    both = revisions.where(seq <= max(base, target)).select("group_key", "seq", "accepted_at", listed.alias("_listed")).groupBy("group_key").agg(
        F.max(upto(base)).alias("_old"), F.max_by("_listed", upto(base)).alias("_was"), F.max(upto(target)).alias("_new"), F.max_by("_listed", upto(target)).alias("_is"),
        F.max_by("accepted_at", upto(target)).alias("_accepted"))
    was, now = F.coalesce("_was", F.lit(False)), F.coalesce("_is", F.lit(False))
    change = F.when(was & ~now, "removed").when(now & (~was | (F.col("_old") != F.col("_new"))), "changed")
    return both.select("group_key", change.alias("change"), F.when(now, F.col("_accepted")).alias("accepted_at")).where("change IS NOT NULL")


def feed_delta(revisions: DataFrame, base: int, target: int, kind: str) -> DataFrame:
    """How many groups changed and were removed since a session's watermark."""
    return diff_listing(revisions, base, target, kind).groupBy("change").agg(F.count("*").alias("groups"))


# --- filing versions --------------------------------------------------------------

FINGERPRINT = ("table_no", "security_title", "transaction_date", "code", "direction", "currency", "shares", "price", "shares_after")
ECONOMIC = ("table_no", "security_title", "transaction_date", "code", "direction", "shares", "price", "shares_after")


def fingerprint(fields: Sequence[str] = FINGERPRINT, owners: bool = True) -> Column:
    parts = [F.col(c) for c in fields]
    if owners:
        parts.append(F.sort_array("owner_ids").alias("owners"))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def matched_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two parses side by side: (is_new, id, accession, partner, replaces_id, outcome), outcome kept / replaces / new / superseded.

    Both parses are shuffled once, by accession, and everything else is a window inside a filing. Which of several equal rows meet is
    decided by row key and id.
    """
    side = lambda rows, is_new: rows.select(
        "accession", "id", F.col("row_key").alias("_key"), "accepted_at", "issuer_id", F.unhex(fingerprint()).alias("_fp"), F.lit(is_new).alias("is_new"))
    rows = side(old, False).unionByName(side(new, True)).repartition("accession")
    is_new, same = F.col("is_new"), ["accession", "_fp", "accepted_at", "issuer_id"]

    def meet(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        """``name``: the row of the other side that has the same keys and the same place among them. NULLs meet nothing."""
        numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "is_new").orderBy(*order)))
        w = Window.partitionBy(*keys, "_k")
        other = F.when(is_new, F.max(F.when(~is_new, F.col("id"))).over(w)).otherwise(F.max(F.when(is_new, F.col("id"))).over(w))
        known = F.lit(True)
        for key in keys:
            known = known & F.col(key).isNotNull()
        return numbered.withColumn(name, F.when(known, other)).drop("_k")

    rows = meet(rows, [*same, "_key"], ["id"], "_exact").withColumn("_rest", F.col("_exact").isNull())
    rows = meet(rows, [*same, "_rest"], ["_key", "id"], "_paired")
    rows = rows.withColumn("partner", F.when(F.col("_rest"), F.col("_paired")).otherwise(F.col("_exact")))
    # a leftover old row may be replaced at its key unless its fingerprint is among the incoming ones
    free = ~is_new & F.col("partner").isNull() & ~F.bool_or("is_new").over(Window.partitionBy("accession", "_fp"))
    rows = rows.withColumn("_free", free).withColumn("replaces_id", F.when(
        is_new & F.col("partner").isNull() & F.col("_key").isNotNull() & F.col("accession").isNotNull(), F.min(F.when(F.col("_free"), F.col("id"))).over(Window.partitionBy("accession", "_key"))))
    outcome = (F.when(F.col("partner").isNotNull(), "kept").when(~is_new, "superseded").when(F.col("replaces_id").isNotNull(), "replaces").otherwise("new"))
    return rows.select("is_new", "id", "accession", "partner", "replaces_id", outcome.alias("outcome"))


def match_filing_versions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows with outcome kept / replaces / new, old rows with status kept / superseded).

    Equal fingerprints pair off once each, the same row key first; then a leftover new row replaces the
    leftover old row at its key, unless that old row's fingerprint is among the incoming ones (a row
    inserted above is not a correction). Every other leftover old row is superseded.
    """
    rows = matched_rows(old, new)
    return (rows.where("is_new").select(F.col("id").alias("new_id"), "accession", F.col("partner").alias("kept_id"), "replaces_id", "outcome"),
            rows.where("NOT is_new").select(F.col("id").alias("old_id"), "accession", F.col("outcome").alias("status")))


def duplicates_across_filings(trades: DataFrame) -> DataFrame:
    """Rows with equal economic fields and a shared owner in another accession of the same issuer.

    No pairs are emitted: a (issuer, economic hash, owner) group with two accessions marks its rows, each
    with the group's first row as the possible original. Rows are shuffled once, before their owners are laid out; only marked ones meet again by id.
    """
    dealt = trades.where(F.col("status").isin(*VISIBLE)).select(
        "id", "issuer_id", "accession", "accepted_at", "owner_ids", F.unhex(fingerprint(ECONOMIC, owners=False)).alias("economic")).repartition("issuer_id", "economic")
    group = Window.partitionBy("issuer_id", "economic", "owner_id")
    rows = dealt.withColumn("owner_id", F.explode("owner_ids")).where("issuer_id IS NOT NULL AND owner_id IS NOT NULL")
    marked = rows.select("id", F.min("accession").over(group).alias("_a"), F.max("accession").over(group).alias("_b"),
                         F.min_by("id", F.struct("accepted_at", "id")).over(group).alias("first_id")).where("_a <> _b")
    return marked.groupBy("id").agg(F.min("first_id").alias("first_id"))


def amend_candidates(trades: DataFrame) -> DataFrame:
    """Amended rows with how many plausible originals each owner has and which are first and last.

    Originals share issuer, day, table, title and an owner but not the accession. Counts come from group
    totals minus the row's own accession, so no pair is built.
    """
    key = ["issuer_id", "transaction_date", "table_no", "security_title", "owner_id"]
    rows = trades.where(F.col("status").isin(*VISIBLE)).withColumn("owner_id", F.explode("owner_ids"))
    per_filing = rows.groupBy(*key, "accession").agg(F.count("*").alias("n"))
    totals = per_filing.groupBy(*key).agg(F.sum("n").alias("_all"), F.min("accession").alias("first_accession"), F.max("accession").alias("last_accession"))
    amended = rows.where(F.col("form").endswith("/A")).select("id", *key, "accession")
    joined = amended.join(totals, key).join(per_filing.withColumnRenamed("n", "_own"), [*key, "accession"])
    return joined.select("id", "owner_id", (F.col("_all") - F.col("_own")).alias("candidates"), "first_accession", "last_accession")


# Accepted spellings of a decision.
ACTIONS = {"additional": "ADD", "new": "ADD", "add": "ADD", "replace": "REPLACE", "unchanged": "UNCHANGED", "no_change": "UNCHANGED",
           "withdraw": "REMOVE", "remove": "REMOVE"}


def resolve_amendments(trades: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades with the decisions applied, rejected decisions with their reason).

    ``decisions``: decision_no, amended_id, original_id, action, note. ADD keeps both, REPLACE counts the
    amended row in the original's group, UNCHANGED confirms a duplicate, REMOVE withdraws both.
    """
    named = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    chosen = F.coalesce(F.element_at(named, F.lower("action")), F.upper("action"))
    facts = trades.select("id", "issuer_id", "status", "owner_ids", "accepted_at", "accession", "original_accepted_at", "original_accession")
    # both sides of all decisions meet the trades at once, and come together again by decision
    sides, told = ("amended", "original"), ("decision_no", "amended_id", "original_id", "chosen", "note")
    asked = decisions.withColumn("chosen", chosen).select(*told, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id")) for s in sides])).alias("w")).select(*told, "w.*")
    met = asked.join(facts, "id", "left").groupBy(*told).agg(*[F.max(F.when(F.col("side") == s, F.struct(*facts.columns))).alias(s) for s in sides])
    rows = met.select(*told, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in sides for c in facts.columns if c != "id"])
    overlap = F.arrays_overlap("original_owner_ids", "amended_owner_ids")
    invalid = F.col("original_id").isNotNull() & F.col("original_issuer_id").isNotNull() & (
        (F.col("original_id") == F.col("amended_id")) | (F.col("original_issuer_id") != F.col("amended_issuer_id"))
        | ~F.col("original_status").isin(*VISIBLE) | ~overlap)
    problem = (F.when(~F.col("chosen").isin("ADD", "REPLACE", "UNCHANGED", "REMOVE"), "action_invalid")
               .when(F.coalesce(F.trim("note"), F.lit("")) == "", "evidence_missing").when(F.col("amended_issuer_id").isNull(), "amended_missing")
               .when((F.col("chosen") != "ADD") & F.col("original_issuer_id").isNull(), "original_required").when(invalid, "original_invalid"))
    checked = rows.withColumn("problem", problem)
    valid = checked.where("problem IS NULL")
    a = valid.select("decision_no", F.col("amended_id").alias("id"),
                     F.element_at(F.create_map(*[F.lit(x) for x in ("ADD", "CURRENT", "REPLACE", "CURRENT", "UNCHANGED", "DUPLICATE_CONFIRMED", "REMOVE", "WITHDRAWN")]), F.col("chosen")).alias("new_status"),
                     F.when(F.col("chosen") == "REPLACE", F.col("original_id")).alias("new_replaces_id"),
                     F.when(F.col("chosen") == "REPLACE", F.coalesce("original_original_accepted_at", "original_accepted_at")).alias("new_accepted"),
                     F.when(F.col("chosen") == "REPLACE", F.coalesce("original_original_accession", "original_accession")).alias("new_accession"))
    b = valid.where("original_issuer_id IS NOT NULL").select(
        "decision_no", F.col("original_id").alias("id"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("ADD", "CURRENT", "REPLACE", "SUPERSEDED", "UNCHANGED", "CURRENT", "REMOVE", "WITHDRAWN")]), F.col("chosen")).alias("new_status"),
        F.lit(None).cast("string").alias("new_replaces_id"), F.lit(None).cast("timestamp").alias("new_accepted"), F.lit(None).cast("string").alias("new_accession"))
    changes = latest_per_key(a.unionByName(b), ["id"], ["decision_no"]).drop("decision_no")
    applied = trades.join(changes, "id", "left").withColumns({
        "status": F.coalesce("new_status", "status"), "replaces_id": F.coalesce("new_replaces_id", F.lit(None).cast("string")),
        "original_accepted_at": F.coalesce("new_accepted", "original_accepted_at"), "original_accession": F.coalesce("new_accession", "original_accession"),
    }).drop("new_status", "new_replaces_id", "new_accepted", "new_accession")
    return applied, checked.where("problem IS NOT NULL").select("decision_no", "amended_id", "original_id", "problem")


def withdrawn_filings(filings: DataFrame, index_entries: DataFrame, complete: DataFrame, start: str, end: str) -> DataFrame:
    """Visible filings of the range that the index no longer lists, quarter by quarter.

    ``complete``: quarter_start of every quarter whose index was read whole; filings of other quarters are left alone.
    """
    inside = filings.where(F.col("visible") & F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    sure = inside.withColumn("quarter_start", F.trunc("filing_date", "quarter")).join(complete.select("quarter_start").distinct(), "quarter_start", "left_semi").drop("quarter_start")
    return sure.join(index_entries.select("accession"), "accession", "left_anti").withColumn("status", F.lit("SOURCE_WITHDRAWN")).withColumn("visible", F.lit(False))


def issuer_ticker_current(filings: DataFrame) -> DataFrame:
    """Ticker of each issuer's newest visible filing; an older backfill never reverts it."""
    return filings.where(F.col("visible") & F.col("accepted_at").isNotNull()).groupBy("issuer_id").agg(
        F.max_by("ticker", F.struct("accepted_at", "accession")).alias("ticker"))


def mapping_history(mappings: DataFrame, as_of_version: int | None = None) -> DataFrame:
    """Trade to security mappings with the version each replaced; the newest is current.

    ``mappings``: trade_id, version, security_id. A version refers to the one before it.
    """
    prior = mappings.select("trade_id", (F.col("version") + 1).alias("version"), F.col("security_id").alias("replaced_security"))
    rows = mappings.join(prior, ["trade_id", "version"], "left")
    if as_of_version is not None:
        rows = rows.where(F.col("version") <= as_of_version)
    newest = rows.groupBy("trade_id").agg(F.max("version").alias("_v"))
    return rows.join(newest, "trade_id").withColumn("is_current", F.col("version") == F.col("_v")).drop("_v")


def join_valid_identifier(rows: DataFrame, identifiers: DataFrame, day: str) -> DataFrame:
    """Identifier valid on the row's day (open end allowed)."""
    joined = rows.join(identifiers, "symbol")
    return joined.where((F.col("valid_from") <= F.col(day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col(day))))


# --- discovery --------------------------------------------------------------------


def merge_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per accession, accessions that state several forms).

    Differing acceptance times become NULL with a warning; a form conflict is an error.
    """
    merged = entries.groupBy("accession").agg(
        F.min("form").alias("form"), F.max("form").alias("_form2"), F.min("issuer_id").alias("issuer_id"), F.count("*").alias("entries"),
        F.min("accepted_at").alias("_t0"), F.max("accepted_at").alias("_t1"), F.sort_array(F.collect_set("role")).alias("roles"))
    bad = merged.where("form <> _form2").select("accession")
    conflict = F.col("_t0") != F.col("_t1")
    good = merged.where("form = _form2").select(
        "accession", "form", "issuer_id", "entries", "roles", F.when(~conflict, F.col("_t0")).alias("accepted_at"),
        F.when(conflict, "acceptance_time_conflict").when(F.col("_t0").isNull(), "acceptance_time_missing_or_invalid").alias("warning"))
    return good, bad


def index_completeness(required: DataFrame, landed: DataFrame) -> DataFrame:
    """complete / missing / stale per required index day; a landed index must be as of the day it covers."""
    rows = required.join(landed, "index_day", "left")
    state = F.when(F.col("as_of").isNull(), "missing").when(F.col("as_of") < F.col("required_through"), "stale").otherwise("complete")
    return rows.withColumn("state", state)


# Job status -> stage of a filing that is not parsed yet.
STAGES = {"QUEUED": "waiting_download", "PAUSE_REQUESTED": "pause_requested", "CANCEL_REQUESTED": "cancel_requested", "RETRY_WAIT": "retry_wait",
          "PAUSED": "paused", "FAILED": "failed", "CANCELLED": "cancelled", "SUCCEEDED": "needs_review", "PARTIAL": "needs_review"}


def latest_attempts(filings: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each pending filing with its newest attempt, if any (top one per group by max_by)."""
    newest = latest_per_key(attempts, ["accession"], ["created_at", "attempt_id"])
    return filings.join(newest, "accession", "left")


def pending_stages(filings: DataFrame, attempts: DataFrame, at: str) -> DataFrame:
    """Discovered but unparsed filings by stage."""
    rows = latest_attempts(filings.where(F.col("visible") & F.col("current_version").isNull()).select("accession"), attempts)
    running = F.when(F.col("lease_until") > F.lit(at).cast("timestamp"), "fetching_parsing").otherwise("waiting_recovery")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), F.col("attempt_status"))
    stage = F.when(F.col("attempt_status") == "RUNNING", running).otherwise(F.coalesce(named, F.lit("discovered")))
    return rows.groupBy(stage.alias("stage")).agg(F.count("*").alias("filings"))


def quality_failures(rejects: DataFrame, at: str) -> DataFrame:
    """Rejected rows of the last day by kind and reason."""
    stamp = F.lit(at).cast("timestamp")
    recent = rejects.where((F.col("rejected_at") > stamp - F.expr("INTERVAL 1 DAY")) & (F.col("rejected_at") <= stamp))
    return recent.groupBy("kind", "reason").agg(F.count("*").alias("rows"), F.max("rejected_at").alias("last_at"))


# --- entity history ---------------------------------------------------------------


def entity_rows(trades: DataFrame, kind: str, action: str = "all", start: str | None = None, end: str | None = None,
                basis: str = "transaction_date") -> DataFrame:
    """Visible rows keyed by entity_id: the issuer, or each owner of a joint row."""
    from ledgertide.operators.trades import entity_action

    rows = trades.where(F.col("status").isin(*VISIBLE) & F.col("visible") & entity_action(action))
    rows = rows.withColumn("entity_id", F.col("issuer_id") if kind == "company" else F.explode("owner_ids"))
    rows = rows.withColumn("sort_date", sort_date() if basis == "transaction_date" else eastern_day("accepted_at"))
    if start is not None:
        rows = rows.where(F.col("sort_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("sort_date") <= F.lit(end).cast("date"))
    return rows


def entity_headline(rows: DataFrame, kind: str) -> DataFrame:
    """Per entity and side (Table I purchases and sales): rows, shares, amount, currencies and owners.

    A person's page counts that person only; a company's page counts every owner.
    """
    side = F.when(matches_kind("buy"), "buy").when(matches_kind("sell"), "sell")
    used = rows.where(F.col("status") == "CURRENT").withColumn("side", side).where("side IS NOT NULL")
    totals = used.groupBy("entity_id", "side").agg(
        F.count("*").alias("rows"), F.sum("shares").alias("shares"), F.sum("amount").alias("known_amount"),
        F.count_if(F.col("amount").isNull()).alias("missing_price_rows"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("currency"))
    if kind != "company":
        return totals.withColumn("owners", F.lit(1).cast("long"))
    owners = used.select("entity_id", "side", F.explode("owner_ids").alias("o")).distinct().groupBy("entity_id", "side").agg(F.count("*").alias("owners"))
    return totals.join(owners, ["entity_id", "side"])


def entity_span(rows: DataFrame) -> DataFrame:
    """Rows, filings, companies and the date span of every entity."""
    per_filing = rows.groupBy("entity_id", "accession", "issuer_id").agg(
        F.count("*").alias("_n"), F.min(sort_date()).alias("_d0"), F.max(sort_date()).alias("_d1"))
    companies = per_filing.select("entity_id", "issuer_id").distinct().groupBy("entity_id").agg(F.count("*").alias("companies"))
    spans = per_filing.groupBy("entity_id", "accession").agg(F.sum("_n").alias("_n"), F.min("_d0").alias("_d0"), F.max("_d1").alias("_d1")).groupBy("entity_id").agg(
        F.sum("_n").alias("total"), F.count("*").alias("filings"), F.min("_d0").alias("transaction_start"), F.max("_d1").alias("transaction_end"))
    return spans.join(companies, "entity_id")


def recent_k(rows: DataFrame, k: int) -> DataFrame:
    """Newest k rows of each entity, undated last; Spark keeps k per task before the shuffle."""
    order = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("sort_date"), F.desc("id"))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def rows_order(rows: DataFrame, basis: str, k: int) -> DataFrame:
    """First k rows by transaction date (anomalous last) or acceptance, then id."""
    first = sort_date() if basis == "transaction" else F.col("accepted_at")
    return rows.withColumn("_o", first).orderBy(F.desc_nulls_last("_o"), F.desc("accepted_at"), F.desc("id")).limit(k).drop("_o")


