"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each of the 64 bits of the XXH64 (seed 42) of its three-word shingles, repeats included: it is 1 if
the bit is set in over half of them. Texts of fewer words have one shingle of all their words; null, empty and blank texts have
fingerprint zero and are linked like any other.

Equal fingerprints are one class, and only that is compared. Classes are laid out in tiles, and numpy compares tile with tile by
exclusive-or and bit counts. Two tests skip tile pairs without losing a link: fingerprints within the radius agree in one of
radius + 1 blocks of bits, so only tiles of a common block value meet; and their population counts differ by at most the
radius, so tiles further apart in population count never meet. A block value that many classes share is cut into tiles of about
``TILE`` by population count, so no task holds more than two tiles at a time, whatever the number of classes.

A tile pair gives a forest that connects what it found to be linked, not all of its links. A component's id is the
smallest document id that links reach. Null ids count for links; their rows carry the component's smallest known id, or null.
Repeated rows stay rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.llm import common, graph

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of one tile.
TILE = 2048
#: Words whose shingles are hashed at once.
CHUNK = 50_000
#: Groups up to this size are compared together, larger ones by blocks of a matrix.
SMALL = 24


def fingerprints(text: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of every row."""
    raw, offsets = common.buffers(text)
    data = common.LOWER[raw]
    starts, ends, rows = common.words(data, offsets, ~common.SPACE)
    counts = np.diff(rows)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    ones = np.zeros((len(counts), 64), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    view = memoryview(data)
    for low in range(0, len(starts), CHUNK):
        # a shingle starts at every word that has enough words after it, and at the first word of a short text
        at = np.arange(low, min(low + CHUNK, len(starts)))
        at = at[at - rows[row[at]] < shingles[row[at]]]
        if not len(at):
            continue
        last = np.minimum(at + SHINGLE, rows[row[at] + 1]) - 1
        begin, stop = int(at[0]), int(last.max()) + 1
        joined = b" ".join([view[s:e] for s, e in zip(starts[begin:stop].tolist(), ends[begin:stop].tolist(), strict=True)])
        to = np.cumsum(ends[begin:stop] - starts[begin:stop] + 1) - 1
        since = to - (ends[begin:stop] - starts[begin:stop])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(since[at - begin].tolist(), to[last - begin].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, row[at][1:] != row[at][:-1]])
        ones[row[at][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["doc_id", "fingerprint"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def in_blocks(classes: DataFrame, radius: int) -> DataFrame:
    """(fingerprint) -> fingerprint, ones, bucket: one row for each of the radius + 1 blocks of its bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    bits = F.col("fingerprint")
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft(bits, 64 - high), 64 - high + low).alias("value")) for k, (low, high) in enumerate(zip(edges, edges[1:]))]
    return classes.select("fingerprint", F.bit_count("fingerprint").alias("ones"), F.explode(F.array(*blocks)).alias("bucket")).select("fingerprint", "ones", "bucket.block", "bucket.value")


def tiled(classes: DataFrame, radius: int, tile: int) -> DataFrame:
    """Every class once for each pair of tiles (i <= j) of a bucket in which it is compared; ``side`` is its own tile.

    Tiles are numbered in the order of population counts, so those a class must meet are a run of numbers.
    """
    placed = in_blocks(classes, radius)
    bucket = ["block", "value"]
    own = Window.partitionBy(*bucket)
    by_ones = own.orderBy("ones")
    # at most 65 rows a bucket
    counted = placed.groupBy(*bucket, "ones").agg(F.count("*").alias("n")).withColumn("size", F.sum("n").over(own)).where("size > 1")
    cut = counted.withColumn("tiles", F.when(F.col("size") <= tile, 0).otherwise(F.ceil(F.col("n") / tile)).cast("int"))
    cut = cut.withColumn("first", F.coalesce(F.sum("tiles").over(by_ones.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    near = by_ones.rangeBetween(-radius, radius)
    layout = common.stored(cut.select(*bucket, "ones", "tiles", "first", F.min("first").over(near).alias("low"), F.max(F.col("first") + F.greatest("tiles", F.lit(1)) - 1).over(near).alias("high")))
    # of a bucket that is one tile, all rows have number 0 and meet in the pair (0, 0)
    mine = F.when(F.col("tiles") == 0, 0).otherwise(F.col("first") + F.pmod(F.xxhash64("fingerprint"), F.greatest("tiles", F.lit(1)))).cast("int")
    met = F.when(F.col("tiles") == 0, F.array(F.lit(0))).otherwise(F.sequence("low", "high"))
    return placed.join(layout, [*bucket, "ones"]).select("fingerprint", "ones", *bucket, mine.alias("side"), F.explode(met).alias("other")).select(
        *bucket, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "ones", "fingerprint")


def united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (the least member of each position's tree) after the links x-y."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]


def linked_in(group: np.ndarray, side: np.ndarray, ones: np.ndarray, prints: np.ndarray, cross: np.ndarray, radius: int) -> np.ndarray:
    """Root position of every row, for rows sorted by (group, side, ones). A group of two tiles (``cross``) is compared across its sides only."""
    root = np.arange(len(prints))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(prints)])
    left = np.repeat(first + size, size) - np.arange(len(prints))  # rows of the group from here on
    at = np.flatnonzero(np.repeat(size <= SMALL, size))
    for step in range(1, SMALL):
        at = at[left[at] > step]
        if not len(at):
            break
        alike = (np.bitwise_count(prints[at] ^ prints[at + step]) <= radius) & (~cross[at] | (side[at] != side[at + step]))
        root = united(root, at[alike], at[alike] + step)
    for start, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        stop = start + n
        middle = start + int(np.searchsorted(side[start:stop], side[start], side="right")) if cross[start] else start
        other = slice(middle, stop)
        for low in range(start, middle if cross[start] else stop, 256):
            high = min(low + 256, middle if cross[start] else stop)
            # population counts beyond the radius are skipped
            span = np.searchsorted(ones[other], [ones[low] - radius, ones[high - 1] + radius + 1])
            begin, end = middle + int(span[0]), middle + int(span[1])
            x, y = np.nonzero(np.bitwise_count(prints[low:high, None] ^ prints[None, begin:end]) <= radius)
            root = united(root, x + low, y + begin)
    return root


def compared(tiles: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect what each pair of tiles holds within the radius."""
    keys = ["block", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "side", "ones", "fingerprint"]
        held: list[np.ndarray] | None = None  # the last group, which may go on in the next batch

        def forest(columns: list[np.ndarray]) -> pa.RecordBatch:
            *key, side, ones, prints = columns
            change = np.zeros(len(side), np.int64)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            root = linked_in(np.cumsum(change), side, ones, prints.view(np.uint64), key[2] != key[3], radius)
            some = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(prints[some]), pa.array(prints[root[some]])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate([old, new]) for old, new in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            same = np.ones(len(columns[0]), bool)
            for k in columns[:4]:
                same &= k == k[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield forest([c[:cut] for c in columns])
        if held is not None and len(held[0]):
            yield forest(held)

    return tiles.repartition(*keys).sortWithinPartitions(*keys, "side", "ones").mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (a long) and component_id, one row per row of ``docs``."""
    def build() -> DataFrame:
        marks = common.stored(fingerprinted(docs, id_col, text_col))
        classes = common.stored(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("head")))
        groups = common.stored(graph.components(compared(tiled(classes, radius, tile), radius)))
        placed = common.stored(classes.join(groups, classes["fingerprint"] == groups["node"], "left").select("fingerprint", "head", F.coalesce("label", "fingerprint").alias("label")))
        # what is joined to many rows is a stored table, so that Spark can split the rows of a frequent key
        least = common.stored(placed.groupBy("label").agg(F.min("head").alias("component_id")))
        named = common.stored(placed.join(least, "label").select("fingerprint", "component_id"))
        return marks.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")

    return common.finished(docs.sparkSession, build)
