"""Product codes for vectors, their entries searched by a geometric near-neighbour access tree (GNAT).

Vectors are scaled to integers (``floor(256 * x)``) and cut into ``PARTS`` equal parts; every part position has a codebook of at most
``ENTRIES`` entries, trained by rounds of assignment and integer means. All distances are squared Euclidean in 64-bit integers.

The entries of a codebook are held in a GNAT: a node has a few split points far from each other; every other entry belongs to the nearest one,
and for each pair of a split point and a child the node keeps the range of distances from the one to the entries of the other. A query measures
its distance to the split points; a child all of whose entries must lie strictly further away than the best found so far is passed over whole. The
ranges, the query's distances and the best are roots of integers with a slack above their rounding error, always to the side that keeps a child, so
an entry at the best distance is never lost; the winner and its ties (the lower index) are settled on the integers. Whole batches of
queries walk the tree together in numpy.

Only the codebooks (``PARTS`` x ``ENTRIES`` entries, whatever the rows) pass the driver; sums are added up in tasks and then by Spark.

A row whose vector is null or holds null or non-finite components is dropped. The width is that of the smallest vec_id (nulls last, then by components)
whose vector has a positive multiple of ``PARTS`` components; rows of another width stay, with a null code and error, and take no part in
training. Fewer than ``ENTRIES`` rows give shorter codebooks; an empty table gives no rows; repeated rows are rows of their own. Components
beyond ``LARGEST`` after scaling raise an error, as their distances need more than 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a node, and the largest leaf.
DEGREE, LEAF = 5, 5
#: Largest absolute scaled component.
LARGEST = 2**24
#: Relative slack of distances, far above the rounding error of a root and a difference of doubles.
SLACK = 1e-9


@dataclass
class Node:
    """Split points of a subset of a codebook, a child for each, and ranges[i, j]: distances from split i to the entries below child j."""

    splits: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    children: list[Node | None] = field(default_factory=list)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every entry."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        gap = points[:, k, None] - entries[None, :, k]
        out += gap * gap
    return out


def tree(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The GNAT over ``members`` (indexes) of a codebook."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    gaps = squared(entries[members], entries[members])
    splits = [0]
    while len(splits) < DEGREE:  # each next split point is the entry furthest from those there are
        nearest = gaps[:, splits].min(axis=1)
        nearest[splits] = -1
        splits.append(int(nearest.argmax()))
    rest = np.setdiff1d(np.arange(len(members)), splits)
    owner = gaps[rest][:, splits].argmin(axis=1)
    below = [rest[owner == j] for j in range(DEGREE)]
    roots = np.sqrt(gaps[splits].astype(np.float64))
    low = np.array([[roots[i, b].min() * (1 - SLACK) if len(b) else np.inf for b in below] for i in range(DEGREE)])
    high = np.array([[roots[i, b].max() * (1 + SLACK) if len(b) else -np.inf for b in below] for i in range(DEGREE)])
    return Node(members[splits], low, high, [tree(entries, members[b]) if len(b) else None for b in below])


def nearest(root: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower index) and its squared distance for every point."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    chosen = np.full(len(points), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        gaps = squared(points[rows], entries[node.splits])
        at = np.lexsort((np.broadcast_to(node.splits, gaps.shape), gaps), axis=1)[:, 0] if len(node.splits) > 1 else np.zeros(len(rows), np.int64)
        own, index = gaps[np.arange(len(rows)), at], node.splits[at]
        better = (own < best[rows]) | ((own == best[rows]) & (index < chosen[rows]))
        best[rows[better]], chosen[rows[better]] = own[better], index[better]
        if not node.children:
            return
        away = np.sqrt(gaps.astype(np.float64))
        closest = gaps.argmin(axis=1)
        # first the child of the closest split point, which most often holds the nearest entry, then what is still possible
        for first in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                mine = np.flatnonzero((closest == j) == first)
                reach = np.sqrt(best[rows[mine]].astype(np.float64)) * (1 + SLACK)
                near = away[mine]
                beyond = (near * (1 - SLACK) - node.high[None, :, j] > reach[:, None]) | (node.low[None, :, j] - near * (1 + SLACK) > reach[:, None])
                mine = mine[~beyond.any(axis=1)]
                if len(mine):
                    visit(child, rows[mine])

    if len(points):
        visit(root, np.arange(len(points)))
    return chosen, best


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled components of the rows of ``width`` components, and which rows these are."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(sizes == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
    scaled = np.floor(SCALE * values)
    if (np.abs(scaled) > LARGEST).any():
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return scaled.astype(np.int64), rows


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """vec_id, vector (doubles) and label of the rows that are kept."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), label.alias("label"))
    return plain.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def starters(kept: DataFrame) -> np.ndarray:
    """The first codebooks' vectors: the first ``ENTRIES`` rows, as integers; no row for a table without any."""
    def first(rows: DataFrame) -> list:
        return [r["vector"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()]

    wide = kept.where((F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    found = first(wide)
    if any(len(v) != len(found[0]) for v in found):
        found = first(wide.where(F.size("vector") == len(found[0])))
    return integers(pa.array(found, pa.list_(pa.float64())), len(found[0]))[0] if found else np.zeros((0, 0), np.int64)


def codebooks(kept: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Entries (part, entry, position) after ``rounds`` of assigning all rows and taking integer means."""
    width = start.shape[1]
    step = width // PARTS
    books = np.stack([start[:, p * step:(p + 1) * step] for p in range(PARTS)])

    def trained(books: np.ndarray) -> np.ndarray:
        trees = [tree(book) for book in books]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # per part and entry the number of parts and the sums of their components
            sums = np.zeros((PARTS, books.shape[1], step + 1), np.int64)
            for batch in batches:
                points, _ = integers(batch.column(0), width)
                for p in range(PARTS):
                    part = points[:, p * step:(p + 1) * step]
                    code, _ = nearest(trees[p], books[p], part)
                    np.add.at(sums[p], code, np.c_[np.ones(len(part), np.int64), part])
            part, entry = np.nonzero(sums[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "sums"])

        partial = kept.select("vector").mapInArrow(run, "part int, entry int, sums array<long>")
        added = partial.select("part", "entry", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x"))
        total = np.zeros((PARTS, books.shape[1], step + 1), np.int64)
        for part, entry, place, x in added.collect():  # one number a component of the codebooks
            total[part, entry, place] = x
        count = total[:, :, :1]
        return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)

    for _ in range(rounds):
        books = trained(books)
    return books


def assigned(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over the parts)."""
    step = books.shape[2]
    trees = [tree(book) for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, rows = integers(batch.column(2), PARTS * step)
            codes, error = np.zeros((len(points), PARTS), np.uint8), np.zeros(len(points), np.int64)
            for p in range(PARTS):
                code, gap = nearest(trees[p], books[p], points[:, p * step:(p + 1) * step])
                codes[:, p] = code
                error += gap
            text, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            text[rows], errors[rows] = [row.tobytes().hex() for row in codes], error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of a label's rows, nulls together) and codebooks_sha256."""
    def build() -> DataFrame:
        kept = usable(vectors, id_col, vector_col, label_col)
        start = starters(kept)
        books = codebooks(kept, start) if len(start) else np.zeros((PARTS, 0, 0), np.int64)
        coded = assigned(kept, books) if len(start) else kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = common.stored(coded)
        # the sums are a stored table, so that Spark can split the rows of a frequent label
        sums = common.stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
        return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

    return common.finished(vectors.sparkSession, build)
