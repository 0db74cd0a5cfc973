"""Alerts as streams with keyed state.

The clock of every stream here is ``received_at``, when a poller landed the row: it only moves forward, so a filing that is itself
old is never late. The watermark on it ends state; rows are dropped only if they are landed later than ``delay`` behind the newest.
Each job is a streaming DataFrame in append mode: any sink takes it, and its checkpoint holds what was sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgertide.streaming.jobs import DIGEST_OVER, LOOKBACK_DAYS, RULE_TRADE_DAYS

#: A landed filing with all of its trades.
FILING_SCHEMA = ("accession string, issuer_id string, received_at timestamp, trades array<struct<id: string, code: string, table_no: string, status: string, visible: boolean, "
                 "accepted_at: timestamp, transaction_date: date, amount: decimal(38,12), is_plan: boolean, owner_ids: array<string>>>")
TRADE_ALERT_SCHEMA = ("dedupe_key string, kind string, person_id string, issuer_id string, rows long, buys long, sells long, amount decimal(38,2), "
                      "plan string, traded_from date, traded_to date, at timestamp")
DAY_MS = 24 * 3600 * 1000


def millis(stamp: pd.Timestamp) -> int:
    return int(stamp.value // 1_000_000)


def cents(amount: Decimal) -> Decimal:
    return amount.quantize(Decimal("0.01"), ROUND_HALF_UP)


#: Filings share a state by a hash of their accession, so that a batch calls Python once a bucket and not once a filing. A bucket holds the filings
#: of the remembered days divided by the number of buckets; it is fixed when a stream starts.
BUCKETS = 64


def in_buckets(rows: DataFrame, buckets: int, key: str = "accession"):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")


def keep_until(state: GroupState, entries: dict, packed: Callable[[dict], tuple], end: Callable) -> None:
    """Keep the entries whose end lies after the watermark, and wake up when the last has ended."""
    now = state.getCurrentWatermarkMs()
    kept = {name: x for name, x in entries.items() if end(x) > now}
    if not kept:
        state.remove()
        return
    state.update(packed(kept))
    state.setTimeoutTimestamp(max(map(end, kept.values())))


# --- trades of followed people ----------------------------------------------------


def plan_answer(sells: Column) -> Column:
    """Whether sales were under a plan: yes, no, partly or unknown (a flag that is neither and no sale under a plan); null without sales."""
    answers = F.transform(sells, lambda t: t["is_plan"])
    return F.when(F.size(sells) == 0, F.lit(None)).when(F.forall(answers, lambda x: F.coalesce(x, F.lit(False))), "yes").when(
        F.exists(answers, lambda x: F.coalesce(x, F.lit(False))), "partly").when(F.forall(answers, lambda x: x.isNotNull()), "no").otherwise("unknown")


def total(amounts: Column) -> Column:
    """Exact sum of the amounts that are known; null if none is."""
    known = F.filter(amounts, lambda x: x.isNotNull())
    zero = F.lit(0).cast("decimal(38,12)")
    return F.when(F.size(known) > 0, F.aggregate(known, zero, lambda a, x: (a + x).cast("decimal(38,12)")))


def filing_candidates(filings: DataFrame, followed: DataFrame, start: str, lookback: int | None = LOOKBACK_DAYS) -> DataFrame:
    """One row per filing and followed owner who may speak for it, with the facts of the whole filing (no state, no shuffle but the join's)."""
    began = F.lit(start).cast("timestamp")
    floor = began if lookback is None else F.greatest(began, F.col("received_at") - F.make_dt_interval(days=F.lit(lookback)))
    counted = F.filter("trades", lambda t: (t["status"] == "CURRENT") & t["code"].isin("P", "S") & (t["table_no"] == "I") & t["visible"] & (t["accepted_at"] >= floor))
    rows = filings.select("accession", "issuer_id", "received_at", counted.alias("t"))
    buys, sells = F.filter("t", lambda t: t["code"] == "P"), F.filter("t", lambda t: t["code"] == "S")
    days = F.transform("t", lambda t: t["transaction_date"])
    named = F.flatten(F.transform("t", lambda t: F.transform(t["owner_ids"], lambda o: F.struct(o.alias("owner_id"), t["accepted_at"].alias("accepted_at")))))
    # the newest acceptance of each owner: it decides whether any was after the owner was followed
    rows = rows.where(F.size("t") > 0).withColumn("named", F.sort_array(F.array_distinct(named)))
    owners = F.filter("named", lambda x, i: ~x["owner_id"].eqNullSafe(F.get("named", i + 1)["owner_id"]))
    facts = rows.select(
        "accession", "issuer_id", "received_at", F.size("t").cast("long").alias("rows"), F.size(buys).cast("long").alias("buys"), F.size(sells).cast("long").alias("sells"),
        total(F.transform("t", lambda t: t["amount"])).cast("decimal(38,2)").alias("amount"), plan_answer(sells).alias("plan"), F.array_min(days).alias("traded_from"),
        F.array_max(days).alias("traded_to"), F.array_max(F.transform("t", lambda t: t["accepted_at"])).alias("at"), F.explode(owners).alias("o"))
    since = followed.select(F.col("person_id").alias("owner_id"), F.greatest("followed_at", began).alias("since"))
    return facts.select("*", "o.owner_id", "o.accepted_at").drop("o").join(since, "owner_id").where("accepted_at >= since")


def trade_alert_stream(filings: DataFrame, followed: DataFrame, start: str, lookback: int | None = LOOKBACK_DAYS, delay: str = "1 day", remember_days: int = 2 * LOOKBACK_DAYS,
                       buckets: int = BUCKETS) -> DataFrame:
    """One alert per filing of a followed person, by the filer followed longest, when the filing first qualifies.

    State are the filings that were told of, each until ``remember_days`` after it was last landed.
    """
    columns = ["person_id", "issuer_id", "rows", "buys", "sells", "amount", "plan", "traded_from", "traded_to", "at"]
    candidates = filing_candidates(filings.withWatermark("received_at", delay), followed, start, lookback).withColumnRenamed("owner_id", "person_id")

    def first_time(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = {name: end for name, end in zip(*state.get) if end > state.getCurrentWatermarkMs()} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["accession", "since", "person_id"], kind="stable")
            best = rows.drop_duplicates("accession")
            new = best[~best["accession"].isin(sent.keys())]
            if len(new):
                yield new.assign(dedupe_key="trade:sec:" + new["accession"], kind="trade")[["dedupe_key", "kind", *columns]]
            ends = rows.groupby("accession")["received_at"].max()
            sent.update({name: millis(stamp) + remember_days * DAY_MS for name, stamp in ends.items()})
        keep_until(state, sent, lambda kept: (list(kept), list(kept.values())), lambda end: end)

    return in_buckets(candidates.select("accession", "since", "received_at", *columns), buckets).applyInPandasWithState(
        first_time, TRADE_ALERT_SCHEMA, "accessions array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# --- rules ------------------------------------------------------------------------

EXECUTIVE_SCHEMA = "dedupe_key string, kind string, person_id string, issuer_id string, rows long, amount decimal(38,2), traded_from date, traded_to date, at timestamp"


def executive_stream(trades: DataFrame, minimum: float, since: str, delay: str = "1 day", remember_days: int = 2 * LOOKBACK_DAYS, buckets: int = BUCKETS) -> DataFrame:
    """An alert when the purchases of a CEO or CFO in one filing reach the threshold, with the filing's trades landed up to then.

    ``trades``: id, accession, issuer_id, owner_ids, code, form, is_ceo, is_cfo, counted, transaction_date, accepted_at, received_at. The pages of a filing may
    come in any batches; its sum is state, a trade landed again counts once, and the filing is told of once.
    """
    least = Decimal(str(minimum))
    wanted = trades.withWatermark("received_at", delay).where(
        (F.col("accepted_at") >= F.lit(since).cast("timestamp")) & (F.col("code") == "P") & ~F.upper(F.coalesce("form", F.lit(""))).endswith("/A") & (F.col("is_ceo") | F.col("is_cfo")))
    rows = wanted.select("accession", "id", "issuer_id", F.element_at("owner_ids", 1).alias("person_id"), F.col("counted").cast("decimal(38,12)").alias("counted"),
                         "transaction_date", "accepted_at", "received_at")

    def summed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # per filing: sent, ids, amount (text, exact), first and last day, newest acceptance, end of the state
        filings = {f[0]: list(f[1:]) for f in state.get[0] if f[-1] > state.getCurrentWatermarkMs()} if state.exists else {}
        found = []
        if not state.hasTimedOut:
            # all of a batch together: a filing's rows may lie in several frames, and it is told of with all of them
            rows = pd.concat(list(frames), ignore_index=True).dropna(subset=["accession"]).sort_values("accession", kind="stable")
            columns = (rows[c] for c in ("accession", "id", "issuer_id", "person_id", "counted", "transaction_date", "accepted_at", "received_at"))
            for accession, own in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
                group = list(own)
                sent, ids, amount, first, last, at, until = filings.get(accession, (False, [], None, None, None, None, 0))
                known = set(ids)
                for _, name, _, _, counted, traded_on, accepted, received in group:
                    until = max(until, millis(received) + remember_days * DAY_MS)
                    if name in known:
                        continue
                    known.add(name)
                    if counted is not None:
                        amount = str(Decimal(amount or 0) + counted)
                    day, stamp = traded_on.toordinal(), accepted.value // 1000
                    first, last, at = min(first or day, day), max(last or day, day), max(at or stamp, stamp)
                reached = not sent and amount is not None and Decimal(amount) >= least
                filings[accession] = [sent or reached, sorted(known), amount, first, last, at, until]
                if reached:
                    people = [r[3] for r in group if r[3] is not None]
                    found.append((f"rule_executive:{accession}", "rule_executive", min(people, default=None), group[0][2], len(known), cents(Decimal(amount)),
                                  date.fromordinal(first), date.fromordinal(last), pd.Timestamp(at, unit="us")))
        if found:
            yield pd.DataFrame(found, columns=["dedupe_key", "kind", "person_id", "issuer_id", "rows", "amount", "traded_from", "traded_to", "at"])
        keep_until(state, filings, lambda kept: ([(name, *x) for name, x in kept.items()],), lambda x: x[-1])

    return in_buckets(rows, buckets).applyInPandasWithState(
        summed, EXECUTIVE_SCHEMA, "filings array<struct<accession: string, sent: boolean, ids: array<string>, amount: string, first: int, last: int, at: bigint, until: bigint>>",
        "append", GroupStateTimeout.EventTimeTimeout)


CLUSTER_SCHEMA = "dedupe_key string, kind string, issuer_id string, rows long, people long, amount decimal(38,2), traded_from date, traded_to date, at timestamp"
CLUSTER_STATE = ("issuers array<struct<issuer_id: string, ids: array<string>, days: array<int>, owners: array<array<string>>, amounts: array<string>, last: bigint, sent: array<string>, "
                 "until: bigint>>")


def newest_window(days: list[int], owners: list[list[str]], span: int, people: int) -> list[int] | None:
    """Positions of the trades in the newest window of ``span`` days that ends on a trade day and holds enough people."""
    order = sorted(range(len(days)), key=days.__getitem__)
    count: dict[str, int] = {}
    low, best = 0, None
    for k, i in enumerate(order):
        for o in owners[i]:
            count[o] = count.get(o, 0) + 1
        while days[order[low]] <= days[i] - span:
            for o in owners[order[low]]:
                count[o] -= 1
                if not count[o]:
                    del count[o]
            low += 1
        if (k + 1 == len(order) or days[order[k + 1]] > days[i]) and len(count) >= people:
            best = order[low:k + 1]
    return best


def cluster_stream(trades: DataFrame, days: int = 7, people: int = 2, since: str | None = None, delay: str = "1 day", keep_days: int = RULE_TRADE_DAYS,
                   buckets: int = BUCKETS) -> DataFrame:
    """An alert when enough people bought the same company within ``days`` days, at most one per issuer in as many days.

    ``trades`` are those of ``executive_stream``. An issuer's state is its purchases of the last ``keep_days`` days before the newest acceptance, so a trade reported late still changes
    the window its day lies in; no log is read. Trades are taken in the order of their acceptance, whatever the batches: after each
    acceptance the newest window with enough people counts if it holds an unamended purchase just accepted. A trade landed again changes nothing. Issuers share a
    state by a hash, as filings do; an issuer's part of it ends on its own.
    """
    floor = F.lit(since).cast("timestamp") if since else F.lit(None).cast("timestamp")
    fresh = ~F.upper(F.coalesce("form", F.lit(""))).endswith("/A") & F.coalesce(F.col("accepted_at") >= floor, F.lit(since is None))
    rows = trades.withWatermark("received_at", delay).where("code = 'P'").select(
        "issuer_id", "id", "owner_ids", F.col("counted").cast("decimal(38,12)").alias("counted"), "transaction_date", "accepted_at", "received_at", fresh.alias("fresh"))
    quiet = days * DAY_MS * 1000

    def purchases_of(issuer: str, known: list, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The alerts of one issuer's new rows, in the order of their acceptance; ``known`` is its state and is brought up to date."""
        ids, traded, owners, amounts, last, sent, until = known
        seen = set(ids)
        for accepted, group in groupby(rows, key=lambda r: r[1]):
            at_once = list(group)
            until = max(until, *(millis(r[6]) + (keep_days + days) * DAY_MS for r in at_once))
            if pd.isna(accepted):
                continue
            oldest = accepted.date().toordinal() - keep_days
            new = set()
            for _, _, name, people_of, counted, traded_on, _, is_fresh in at_once:
                day = traded_on.toordinal()
                if name not in seen and day >= oldest:
                    seen.add(name)
                    ids.append(name), traded.append(day), owners.append([str(o) for o in people_of]), amounts.append(None if counted is None else str(counted))
                    if is_fresh:
                        new.add(name)
            if traded and min(traded) < oldest:
                kept = [i for i, day in enumerate(traded) if day >= oldest]
                ids, traded, owners, amounts = ([x[i] for i in kept] for x in (ids, traded, owners, amounts))
                seen = set(ids)
            window = newest_window(traded, owners, days, people) if new else None
            stamp = accepted.value // 1000
            if window is None or not new.intersection(ids[i] for i in window) or (last is not None and last + quiet >= stamp):
                continue
            first, final = date.fromordinal(min(traded[i] for i in window)), date.fromordinal(max(traded[i] for i in window))
            name = f"rule_cluster:{issuer}:{first.isoformat()}"
            if name in sent:
                continue
            sums = [Decimal(amounts[i]) for i in window if amounts[i] is not None]
            yield name, "rule_cluster", issuer, len(window), len({o for i in window for o in owners[i]}), cents(sum(sums, Decimal(0))) if sums else None, first, final, accepted
            last, sent = stamp, [s for s in sent if date.fromisoformat(s[-10:]).toordinal() >= oldest - days] + [name]
        known[:] = [ids, traded, owners, amounts, last, sent, until]

    def watched(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        issuers = {x[0]: [list(v) if isinstance(v, (list, tuple)) else v for v in x[1:]] for x in state.get[0]} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["issuer_id", "accepted_at", "id"], kind="stable")
            columns = (rows[c] for c in ("issuer_id", "accepted_at", "id", "owner_ids", "counted", "transaction_date", "received_at", "fresh"))
            found = [alert for issuer, own in groupby(zip(*columns, strict=True), key=lambda r: r[0])
                     for alert in purchases_of(issuer, issuers.setdefault(issuer, [[], [], [], [], None, [], 0]), own)]
            if found:
                yield pd.DataFrame(found, columns=["dedupe_key", "kind", "issuer_id", "rows", "people", "amount", "traded_from", "traded_to", "at"])
        keep_until(state, issuers, lambda kept: ([(name, *x) for name, x in kept.items()],), lambda x: x[-1])

    return in_buckets(rows, buckets, "issuer_id").applyInPandasWithState(watched, CLUSTER_SCHEMA, CLUSTER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- digests ----------------------------------------------------------------------


def minute_digests(alerts: DataFrame, stamp: str = "at", delay_minutes: int = 10) -> DataFrame:
    """Closed minutes with what to send (each alert on its own, or one digest above the limit), and each alert that came too late for its minute.

    ``alerts``: the stamp, ``received_at`` and ``beat`` (a poller's sign of life, which moves the clock and is not an alert). A minute closes ``delay_minutes``
    after its end; an alert's time is not after its landing. Whether an alert came later than that is plain from its own two times, so late ones are told of as ``late`` messages and none is dropped.
    """
    delay = F.make_dt_interval(mins=F.lit(delay_minutes))
    minute = F.date_trunc("minute", F.col(stamp))
    late = ~F.col("beat") & (F.col("received_at") >= minute + F.make_dt_interval(mins=F.lit(1)) + delay)
    counted = alerts.where(~late).withWatermark(stamp, f"{delay_minutes} minutes").groupBy(F.window(stamp, "1 minute").alias("w")).agg(F.count_if(~F.col("beat")).alias("alerts")).where("alerts > 0")
    closed = counted.select(F.col("w.start").alias("minute"), "alerts", F.when(F.col("alerts") > DIGEST_OVER, "digest").otherwise("single").alias("message"))
    return closed.unionByName(alerts.where(late).select(minute.alias("minute"), F.lit(1).cast("long").alias("alerts"), F.lit("late").alias("message")))

