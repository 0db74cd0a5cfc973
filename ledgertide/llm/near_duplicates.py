"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles (fewer words: the whole sequence is one shingle; no words: an
empty set, linked with nothing). The sketch has ``BINS`` coordinates. In each of the first ``BINS`` rounds every shingle
is thrown into one hashed bin; round i of the second half throws all shingles into bin i. A coordinate keeps its least
(round, hash) value, and a document stops as soon as all bins are full, so every coordinate is filled and agreeing
coordinates estimate the Jaccard similarity with concentration bounds.

Documents with equal sets are one class and only that goes on. The bands of the sketches make buckets. Links
are confirmed on full sets, first between each bucket's members and its leader, so that a group of thousands of copies costs
few comparisons a member; then all pairs of a bucket that still lie in different components are compared in bounded
tiles, whatever their number. A component's label is its smallest id.

Null ids make rows of their own (component null, kept); rows with one id and several texts have each the component of their
own set. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common, graph

SHINGLE = 5
#: Bands of rows: a pair at similarity 0.75 shares no band with probability (1 - 0.75**6)**54 < 3e-5, at 0.8 < 1e-7.
BANDS, ROWS = 54, 6
BINS = BANDS * ROWS
THRESHOLD = 0.75
#: Members of one tile of a bucket.
TILE = 256
SPACE_WORD = ~common.SPACE


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    raw, offsets = common.buffers(text)
    data = common.LOWER[raw]
    starts, ends, rows = common.words(data, offsets, SPACE_WORD)
    hashes = common.span_hash(common.prefix_hash(data), starts, ends)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled[:max(n - size + 1, 0)] = common.mix(rolled[:max(n - size + 1, 0)] + hashes[k:n - size + 1 + k if n >= size else 0])
    out = []
    for first, last in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if last - first >= size:
            own = np.sort(rolled[first:last - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif last > first:
            whole = np.zeros(1, np.uint64)
            for k in range(first, last):
                whole = common.mix(whole + hashes[k])
            out.append(common.mix(whole + np.uint64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """A 128-bit hash of every set, in two halves."""
    s1 = np.array([common.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    s2 = np.array([np.bitwise_xor.reduce(common.mix(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64)
    return pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, one row of ``bins`` values a set; the row of an empty set stays at the largest value."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full((len(sets), bins), full, np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, np.uint64)
    owner = np.repeat(live, sizes[live])
    flat = table.reshape(-1)
    for turn in range(2 * bins):
        if not len(live):
            break
        hashed = common.mix(values + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bin_of = ((hashed & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if turn < bins else turn - bins
        # the high bits are the round, so that an earlier round always wins; the rest is independent of the bin
        value = (np.uint64(turn) << np.uint64(52)) | (common.mix(hashed) >> np.uint64(12))
        np.minimum.at(flat, owner * bins + bin_of, value)
        open_rows = (table[live] == full).any(axis=1)
        if not open_rows.all():
            still = np.zeros(len(sets), bool)
            live = live[open_rows]
            still[live] = True
            keep = still[owner]
            values, owner = values[keep], owner[keep]
    return table


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit hash of the set (s1, s2) and the band hashes."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets = shingle_sets(batch.column(1))
            table = sketches(sets).reshape(len(sets), BANDS, ROWS)
            bands = np.full((len(sets), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = common.mix(bands + table[:, :, r])
            sizes = np.array([len(s) for s in sets], np.int64)
            filled = np.where(sizes > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *set_hashes(sets),
                 common.lists(bands[sizes > 0].reshape(-1).view(np.int64), np.r_[0, np.cumsum(filled)], pa.int64())],
                ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, s1, s2, items): the full shingle sets and their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets = shingle_sets(batch.column(1))
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *set_hashes(sets), common.lists(values.view(np.int64), offsets, pa.int64())], ["doc_id", "s1", "s2", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s1 long, s2 long, items array<long>")


#: Bits of the table by which texts are sifted before they are shuffled: 4 MB, whatever the corpus.
SIFT_BITS = 1 << 25


def sifted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``texts`` (doc_id, text) whose id may be among ``wanted``, without a shuffle of texts: a bitmap of hashed ids, of a fixed size, goes to all tasks.

    None of the wanted is lost; of the others the share of set bits is left, and the join that follows drops them.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(SIFT_BITS)) + 1
    parts = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    table = np.zeros((SIFT_BITS // 2**15, 2**15 // 8), np.uint8)
    for part, bits in parts:  # at most 1,024 rows of 4 KB
        table[part - 1] = np.frombuffer(bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy() - 1
            held = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(held.astype(bool)))

    return texts.select("doc_id", "text", at.alias("at")).mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string")


def largest_sets(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The full sets of ``members`` (doc_id), the largest one of an id."""
    return full_sets(texts.join(members, "doc_id", "left_semi")).groupBy("doc_id").agg(F.max_by("items", F.size("items")).alias("items"))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold; whole numbers only, so ties are exact."""
    percent = round(100 * threshold)
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))


def may_reach(least, most, threshold: float):
    """Whether sets of these sizes can reach the threshold at all: they share no more than the smaller holds, and are together no less than the larger."""
    return 100 * least >= round(100 * threshold) * most


def mixed_buckets(labelled: DataFrame) -> DataFrame:
    """(band, doc_id, label) -> band, n: the buckets which hold several components, one of those with equal members (equal numbers and 128-bit hashes)."""
    members = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    return labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), *members).where("low <> high").groupBy(
        "n", "h1", "h2").agg(F.min("band").alias("band")).select("band", "n")


def in_tiles(labelled: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of components that a link joins, after comparing all pairs within every bucket which holds several components.

    Alike documents meet in several bands; buckets of equal members are one, so their sets are sent once.

    A bucket's members are dealt to tiles of about ``TILE``; every pair of tiles is one bounded group, in which a product of
    membership matrices counts all intersections of full sets at once. Pairs never become rows; a group gives
    what connects its components, not all the links it sees.
    """
    percent = round(100 * threshold)
    mixed = mixed_buckets(labelled)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rest = labelled.join(common.stored(mixed.select("band", tiles.alias("tiles"))), "band").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    spread = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "label")
    kind = sets.schema["doc_id"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        names, labels = np.unique(table["label"].to_numpy(), return_inverse=True)
        items = table["items"].combine_chunks()
        sizes = np.diff(items.offsets.to_numpy())
        _, token = np.unique(items.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        often = np.bincount(token) > 1
        token, owner = (np.cumsum(often) - 1)[token[often[token]]], owner[often[token]]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        both = np.zeros((len(sizes), len(sizes)), np.float32)
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            part = slice(*np.searchsorted(token, [low, low + 4096]))
            member = np.zeros((len(sizes), 4096), np.float32)
            member[owner[part], token[part] - low] = 1
            both += member @ member.T
        shared = both.astype(np.int64)
        alike = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (labels[:, None] < labels[None, :])
        root = list(range(int(labels.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        kept = []
        for x, y in np.argwhere(alike).tolist():
            u, v = find(int(labels[x])), find(int(labels[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append((int(labels[x]), int(labels[y])))
        at = np.array(kept, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(names[at[:, 0]], table["label"].type), "b": pa.array(names[at[:, 1]], table["label"].type)})

    return spread.join(sets, "doc_id").groupBy("band", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, spent: Callable[[], None] = lambda: None) -> DataFrame:
    """(doc_id, size, band) -> node, label: the components of the links among documents that share a bucket; ``sets_of`` gives the sets (doc_id, items) of those.

    ``spent`` is called when ``buckets`` are read no more."""
    # aggregates that are joined to many rows are stored first, so that Spark can split the rows of a frequent key
    sizes = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    # two sets of unlike sizes need not be compared
    shared = common.stored(sizes.where((F.col("n") > 2) | ((F.col("n") == 2) & may_reach(F.col("least"), F.col("most"), threshold))).select("band"))
    open_buckets = common.stored(buckets.join(shared, "band"))
    spent()
    members = open_buckets.select("doc_id").distinct()
    sets = common.stored(sets_of(members))

    order = F.struct(F.xxhash64("doc_id").alias("o"), F.col("doc_id").alias("lead"), F.col("size").alias("lead_size"))
    leaders = common.stored(open_buckets.groupBy("band").agg(F.min(order).alias("at")).select("band", "at.lead", "at.lead_size"))
    met = open_buckets.join(leaders, "band").where((F.col("doc_id") != F.col("lead")) & may_reach(F.least("size", "lead_size"), F.greatest("size", "lead_size"), threshold)).select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()
    stars = common.stored(graph.components(confirmed(met, sets, threshold)))
    labelled = common.stored(open_buckets.join(stars, open_buckets["doc_id"] == stars["node"], "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    common.release(buckets.sparkSession)  # what was shuffled for the leaders is done with before the tiles' sets are
    joined = common.stored(graph.components(in_tiles(labelled, sets, threshold)).select(F.col("node").alias("label"), F.col("label").alias("least")))
    return labelled.select("doc_id", "label").distinct().join(joined, "label", "left").select(F.col("doc_id").alias("node"), F.coalesce("least", "label").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and kept, one row per row of ``docs``.

    With ``sets`` also s1, s2 (the hash of the row's set) and component, which tells apart the components that one id lies in."""
    return common.finished(docs.sparkSession, lambda: _grouped(docs, id_col, text_col, threshold, sets))


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, with_sets: bool, marks_of=signatures, extra: tuple[str, ...] = (), sift: bool = False) -> DataFrame:
    """``marks_of`` gives the columns of ``signatures``, and those named in ``extra``, which stay; with ``sift`` only texts that may be wanted leave their tasks."""
    key = ["n_shingles", "s1", "s2"]
    banded = common.stored(marks_of(docs, id_col, text_col))
    # a class of equal sets is a node; its smallest id only says where to find its text
    nodes = common.stored(banded.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("head"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    # the bands are most of both tables, and are gone before sets are fetched
    marks, classes = common.stored(banded.drop("bands")), common.stored(nodes.drop("bands"))
    common.discard(banded)
    known = marks.where("doc_id is not null")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sets_of(members: DataFrame) -> DataFrame:
        wanted = classes.join(members, classes["node"] == members["doc_id"], "left_semi").select(F.col("head").alias("doc_id"), "s1", "s2", "node")
        found = full_sets(sifted(texts, wanted) if sift else texts.join(wanted, "doc_id", "left_semi")).groupBy("doc_id", "s1", "s2").agg(F.first("items").alias("items"))
        return found.join(wanted, ["doc_id", "s1", "s2"]).select(F.col("node").alias("doc_id"), "items")

    buckets = nodes.select(F.col("node").alias("doc_id"), F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    groups = linked(buckets, sets_of, threshold, spent=lambda: common.discard(nodes))
    placed = common.stored(classes.select(*key, "head", "node").join(groups, "node", "left").select(*key, "head", F.coalesce("label", "node").alias("component")))
    least = common.stored(placed.groupBy("component").agg(F.min("head").alias("component_id")))
    named = common.stored(placed.join(least, "component").select(*key, "component", "component_id"))
    own = known.select("doc_id", *extra, *key).join(named, key, "left").select(
        "doc_id", *extra, *key, "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = marks.where("doc_id is null").select("doc_id", *extra, *key, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    rows = own.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows if with_sets else rows.drop("s1", "s2", "component")
