"""Name search and name matching as block joins; no term meets an entity without a shared block."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgertide.functions import text as T
from ledgertide.session import checkpoint

SIMILARITY = 0.94
#: Names below this length are never matched by similarity.
LEAST_FUZZY = 6


# --- substring search -------------------------------------------------------------


def words(term: Column) -> Column:
    """All words of a search term, folded."""
    return F.filter(F.split(F.lower(F.trim(term)), r"[\s,]+"), lambda w: w != "")


def _grams(text: Column) -> Column:
    """Distinct pieces of one to three characters; a contained text has all of its pieces among them."""
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.concat(piece(1), piece(2), piece(3)))


def _own_pieces(text: Column) -> Column:
    """Pieces of three characters of a text, or a shorter text itself."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, 3))


def with_block(terms: DataFrame, pieces: Column, grams: DataFrame) -> DataFrame:
    """Each term with its rarest piece as ``_block``; a term with a piece that no name has matches nothing and leaves.

    ``grams``: the pieces of the names (_block), one row per name and piece.
    """
    counts = grams.groupBy("_block").agg(F.count("*").alias("_n"))
    own = terms.withColumn("_block", F.explode(F.array_distinct(pieces))).join(counts, "_block", "left").fillna(0, ["_n"])
    rarest = own.groupBy("term").agg(F.min(F.struct("_n", "_block")).alias("_r")).where("_r._n > 0").select("term", F.col("_r._block").alias("_block"))
    return terms.join(rarest, "term")


def name_matches(terms: DataFrame, entities: DataFrame, key: str, name: str) -> DataFrame:
    """(term, key) where every word of the term is part of the name.

    Blocks on the piece of the term's words that the fewest names have, then checks every word. The exploded pieces are many times
    the names that the planner estimates them by, so they are merged with the terms and never broadcast.
    """
    parsed = terms.select("term").distinct().withColumn("_words", words(F.col("term"))).where(F.size("_words") > 0)
    names = entities.select(key, F.lower(name).alias("_name")).withColumn("_block", F.explode(_grams(F.col("_name"))))
    pairs = names.hint("merge").join(with_block(parsed, F.flatten(F.transform("_words", _own_pieces)), names), "_block")
    return pairs.where(F.forall("_words", lambda w: F.col("_name").contains(w))).select("term", key)


def search_entities(terms: DataFrame, entities: DataFrame, k: int = 20) -> DataFrame:
    """Companies of each term: exact ticker, every word in the name, or the CIK; the exact ticker leads.

    ``entities``: entity_id, name, ticker, last_trade.
    """
    by_name = name_matches(terms, entities, "entity_id", "name")
    upper = terms.withColumn("_t", F.upper(F.trim("term")))
    exact = upper.join(entities.select("entity_id", F.upper("ticker").alias("_t")), "_t").select("term", "entity_id")
    numbers = upper.where(F.col("_t").rlike("^[0-9]{1,10}$")).withColumn("entity_id", F.lpad("_t", 10, "0")).join(
        entities.select("entity_id"), "entity_id").select("term", "entity_id")
    found = by_name.unionByName(exact).unionByName(numbers).distinct()
    exact_flag = exact.distinct().withColumn("_exact", F.lit(1))
    rows = found.join(exact_flag, ["term", "entity_id"], "left").join(entities, "entity_id")
    order = Window.partitionBy("term").orderBy(F.coalesce("_exact", F.lit(0)).desc(), "name", "entity_id")
    ranked = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return ranked.select("term", "position", "entity_id", "name", "ticker", "last_trade")


def alias_matches(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Codes of each term's aliases: exact aliases first, then aliases that contain a term of two or more characters.

    ``aliases``: alias, codes (array), alias_pos.
    """
    folded = terms.withColumn("_f", T.fold(F.col("term"))).where("_f <> ''")
    table = aliases.withColumn("_a", T.fold(F.col("alias")))
    exact = folded.join(table, F.col("_f") == F.col("_a")).withColumn("match_rank", F.lit(0))
    grams = table.withColumn("_block", F.explode(_grams(F.col("_a"))))
    partial = (with_block(folded.where(F.length("_f") >= 2), _own_pieces(F.col("_f")), grams).join(grams.hint("merge"), "_block")
               .where(F.col("_a").contains(F.col("_f")) & (F.col("_a") != F.col("_f"))).drop("_block").withColumn("match_rank", F.lit(1)))
    rows = exact.unionByName(partial).select("term", "match_rank", "alias_pos", "alias", F.posexplode("codes").alias("code_pos", "code"))
    best = rows.groupBy("term", "code").agg(F.min(F.struct("match_rank", "alias_pos", "code_pos", "alias")).alias("_r"))
    return best.select("term", "code", F.col("_r.match_rank").alias("match_rank"), F.col("_r.alias_pos").alias("alias_pos"), F.col("_r.alias").alias("alias"))


def search_all(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Ranked sources (term, key, label, score) merged without repeats: the earlier source keeps a key."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("term", "key", "label", "score").withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("term", "key").agg(F.min(F.struct("source_rank", "score", "label", "source")).alias("_r"))
    return best.select("term", "key", F.col("_r.source").alias("source"), F.col("_r.label").alias("label"))


def person_hits(terms: DataFrame, owners: DataFrame) -> DataFrame:
    """Filers of each term, as a source of ``search_all``: every word in the name, or the number. ``owners``: owner_id, name."""
    by_name = name_matches(terms, owners, "owner_id", "name")
    by_number = terms.select("term", F.trim("term").alias("owner_id")).join(owners.select("owner_id"), "owner_id", "left_semi").select("term", "owner_id")
    found = by_name.unionByName(by_number).distinct().join(owners.hint("merge"), "owner_id")
    return found.select("term", F.concat(F.lit("sec:"), "owner_id").alias("key"), F.col("name").alias("label"), F.lit(0).cast("long").alias("score"))


def official_hits(terms: DataFrame, people: DataFrame) -> DataFrame:
    """House members and executive officials whose name holds the term's words. ``people``: source, name, district, position."""
    known = people.where(F.col("source").isin("house", "oge")).withColumn("key", T.person_key(F.col("source"), F.lit(None), F.col("name"), F.col("district"), F.col("position")))
    first = known.where("key IS NOT NULL").groupBy("key").agg(F.min("name").alias("name"))
    return name_matches(terms, first, "key", "name").distinct().join(first.hint("merge"), "key").select("term", "key", F.col("name").alias("label"), F.lit(0).cast("long").alias("score"))


def resolve_names(wanted: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Name and issuer of each code from ranked sources (ticker_code, name, issuer_id), the first that knows it."""
    rows = None
    for rank, df in enumerate(sources):
        part = df.select("ticker_code", "name", "issuer_id").withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct("_rank", "issuer_id", "name"))
    known = rows.groupBy("ticker_code").agg(F.min_by("name", order("name")).alias("name"), F.min_by("issuer_id", order("issuer_id")).alias("issuer_id"))
    return wanted.select("ticker_code").distinct().join(known, "ticker_code", "left")


# --- name matching ----------------------------------------------------------------


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two names by matching blocks; runs only on block candidates."""
    matcher, values = SequenceMatcher(autojunk=False), []
    for a, b in zip(left, right, strict=True):
        matcher.set_seqs(a, b)
        values.append(matcher.ratio())
    return pd.Series(values, dtype="float64")


def name_dictionary(candidates: DataFrame) -> DataFrame:
    """(name_key, tickers) of local names; a multi-class ticker never picks a class.

    Equal names are one row before any is normalized: the checkpoint keeps the filter on the normalized name above it.
    """
    stated = checkpoint(candidates.select(F.coalesce("name", F.lit("")).alias("name"), F.upper("ticker").alias("_t")).distinct())
    rows = stated.select(T.normalize_name(F.col("name")).alias("name_key"), "_t").where(
        (F.col("name_key") != "") & F.col("_t").rlike(r"^[A-Z][A-Z0-9.\-]{0,14}$"))
    return checkpoint(rows.groupBy("name_key").agg(F.min(T.ticker_key(F.col("_t"))).alias("ticker_low"), F.max(T.ticker_key(F.col("_t"))).alias("ticker_high")))


# Two names above the threshold differ by fewer than 6% of their joint characters, at most this share
# of either name's length. Cut into one piece more than that, a name has a piece found unchanged in the
# other one, shifted by no more than the difference: the block that no match can miss.
_REACH = (2 - SIMILARITY) / SIMILARITY
_DIFFER = (1 - SIMILARITY) * (1 + _REACH)


def _most_differences(length: Column) -> Column:
    return F.greatest(F.ceil(length * F.lit(_DIFFER)) - 1, F.lit(0)).cast("int")


def _piece(length: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """(start, size) of piece i of a name cut evenly."""
    start = F.floor(length * i / pieces).cast("int")
    return start, (F.floor(length * (i + 1) / pieces).cast("int") - start)


def fuzzy_candidates(keys: DataFrame, dictionary: DataFrame, least_length: int = LEAST_FUZZY) -> DataFrame:
    """(key, name_key) pairs that share an unchanged piece; complete for ratios above the threshold.

    Names shorter than ``least_length`` are matched exactly only: one letter of them is too much of a difference. Few bytes make much
    work here, so rows are dealt to a fixed number of tasks: partitions merged by their bytes would leave one.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = dictionary.select("name_key", F.length("name_key").alias("lb")).where("lb >= 1")
    d = d.withColumn("p", _most_differences(F.col("lb")) + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    start, size = _piece(F.col("lb"), F.col("p"), F.col("i"))
    pieces = d.select("name_key", "lb", "i", F.col("name_key").substr(start + 1, size).alias("piece"))
    la = F.length("key")
    q = keys.where(F.length("key") >= least_length).withColumn("lb", F.explode(F.sequence(
        F.ceil(la / F.lit(_REACH)).cast("int"), F.floor(la * F.lit(_REACH)).cast("int"))))
    q = q.withColumn("most", _most_differences(F.col("lb"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    start, size = _piece(F.col("lb"), F.col("most") + 1, F.col("i"))
    q = q.withColumn("_start", start).withColumn("_size", size).withColumn("_at", F.explode(F.sequence(
        F.greatest(F.col("_start") - F.col("most"), F.lit(0)), F.col("_start") + F.col("most"))))
    spots = q.where(F.col("_at") + F.col("_size") <= la).select("key", "lb", "i", F.col("key").substr(F.col("_at") + 1, F.col("_size")).alias("piece")).repartition(tasks, "lb", "i", "piece").distinct()
    pairs = spots.join(pieces, ["lb", "i", "piece"]).select("key", "name_key").repartition(tasks, "key", "name_key").distinct()
    # An edit distance never exceeds the number of unmatched characters, so this drops no match.
    unmatched = F.ceil((F.length("key") + F.length("name_key")) * F.lit(1 - SIMILARITY)) - 1
    return pairs.where(F.levenshtein("key", "name_key") <= unmatched)


def match_names(names: DataFrame, dictionary: DataFrame, threshold: float = SIMILARITY, least_length: int = LEAST_FUZZY) -> DataFrame:
    """Ticker of each asset name: the exact normalized name when unique, else every similar name must agree.

    Distinct names are normalized and matched once: they are read four times below, and filters on the normalized name would be
    pushed through the distinct to every row without the checkpoint. The similarity runs as a pandas UDF over the block candidates only.
    """
    keyed = checkpoint(names.select(F.col("asset_name")).distinct().withColumn("key", T.normalize_name(F.col("asset_name"))))
    keys = keyed.select("key").where("key <> ''").distinct()
    exact = keys.join(dictionary.withColumnRenamed("name_key", "key"), "key").withColumn(
        "ticker", F.when(F.col("ticker_low") == F.col("ticker_high"), F.col("ticker_low"))).select("key", "ticker", F.lit("local_exact").alias("origin"))
    rest = keys.join(exact.select("key"), "key", "left_anti")
    scored = fuzzy_candidates(rest, dictionary, least_length).withColumn("ratio", sequence_ratio("key", "name_key")).where(F.col("ratio") > threshold)
    agreed = scored.join(dictionary, "name_key").groupBy("key").agg(F.min("ticker_low").alias("_a"), F.max("ticker_high").alias("_b"))
    inferred = agreed.where("_a = _b").select("key", F.col("_a").alias("ticker"), F.lit("inferred").alias("origin"))
    found = exact.where("ticker IS NOT NULL").unionByName(inferred)
    return keyed.join(found, "key", "left").select("asset_name", F.col("key").alias("name_key"), "ticker", "origin")


# Fixed value: where the description of a debt begins in the name of a bond.
DEBT = r"(?i)\d+(?:\.\d+)?\s*%|\b(?:NOTE|NOTES|BOND|BONDS|DEBENTURE|DUE)\b"


def match_assets(rows: DataFrame, dictionary: DataFrame, threshold: float = SIMILARITY, least_length: int = LEAST_FUZZY) -> DataFrame:
    """Disclosed rows with the security, or for a bond the issuer, that their name tells.

    ``rows``: asset_name, asset_type, ticker, warnings, confidence and any others. What is looked up is decided before any matching: nothing
    for a row that states a ticker, a fund, an option or another class; the issuer alone for a bond, whose debt description is cut
    off, and which never gets a ticker; the name for stocks and rows of unknown class. A match makes an unknown row a stock, takes that warning
    away, and the row counts as read once no warning is left. Names are never changed.
    """
    kind, name = F.col("asset_type"), F.col("asset_name")
    lookup = F.when(F.coalesce("ticker", F.lit("")) != "", "none").when(kind == "bond", "issuer").when(kind.isin("stock", "unknown"), "name").otherwise("none")
    asked = rows.withColumn("lookup", lookup).withColumn("_asked", F.when(F.col("lookup") == "issuer", F.split(name, DEBT, 2)[0]).when(F.col("lookup") == "name", name))
    found = checkpoint(match_names(asked.where("_asked IS NOT NULL").select(F.col("_asked").alias("asset_name")), dictionary, threshold, least_length).where("ticker IS NOT NULL"))
    joined = asked.join(found.select(F.col("asset_name").alias("_asked"), F.col("ticker").alias("_ticker"), "origin"), "_asked", "left")
    named = (F.col("lookup") == "name") & F.col("_ticker").isNotNull()
    left = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w != "unknown_asset_type")
    issuer = F.col("lookup") == "issuer"
    changed = {
        "ticker": F.when(named, F.col("_ticker")).otherwise(F.col("ticker")), "asset_type": F.when(named, "stock").otherwise(kind), "warnings": F.when(named, left).otherwise(F.col("warnings")),
        "confidence": F.when(named, F.when(F.size(left) > 0, "review").otherwise("parsed")).otherwise(F.col("confidence"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns], "lookup", F.when(named, F.col("origin")).alias("ticker_origin"),
                         F.when(issuer, F.col("_ticker")).alias("issuer_ticker"), F.when(issuer, F.col("origin")).alias("issuer_ticker_origin"))
