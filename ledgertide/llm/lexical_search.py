"""Ranked lexical search through hashed max-sketches.

Terms are the maximal runs of letters, digits and non-ASCII characters of the whole text, A-Z lower-cased. A document's impact of a term
held tf times is ``(10**9 * tf) div (1000 * tf + 8 * m)``, with ``m = 10 + (90 * n * N) div L`` for a document of n of the L terms of all N documents
that have any. The score of an item (a query text) is the sum over its distinct terms of weight times impact, in integers; the weight is
``floor(1000 * ln((2N + 2) / (2df + 1)))``.

``index`` reads every text once and folds its impacts into a sketch: each term is hashed to one of ``WIDTH`` coordinates, which keeps the largest count of
the terms that meet there (within one document impacts grow with counts, so the largest count stands for the largest impact, whatever N and L are). The
impact of a coordinate is never below that of any term hashed to it, so the sum over an item's terms is an upper bound of the score.

``search`` takes the items in blocks of about ``BLOCK_BYTES`` of text. Bounds come from batched lookups: one matrix of impacts a batch of sketches,
one row combination an item. The documents of the highest bounds are scored exactly, which gives every item a threshold that its last result
must reach; then all documents, in descending order of bounds, are scored exactly until the bound falls below the threshold (the given one, or
that of the results the task already has). A document of a bound equal to the threshold is still scored, as ties go by id.

Terms are compared by 128-bit hashes. Documents without terms (null, empty or blank texts) are never results; equal scores go by ascending id, nulls last, and
repeated rows are results of their own. Rows of one item id (nulls are one) are one item with the terms of all of them; items without terms and
empty tables give no rows. Counts above 254 are one sketch value, which stands for the limit of the impact. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm import common

TOP = 10
#: Coordinates of a sketch.
WIDTH = 4096
#: Largest count a sketch tells apart; one more stands for all above.
MOST = 254
#: Text of the items of one block.
BLOCK_BYTES = 4_000_000
#: Cells of a matrix of impacts; documents scored for an item in one step.
CELLS, STEP = 2_000_000, 16

TERM = np.ones(256, bool)
TERM[:128] = False
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all terms in two halves, and n + 1 term offsets of the rows."""
    raw, offsets = common.buffers(text)
    data = common.LOWER[raw]
    starts, ends, rows = common.words(data, offsets, TERM)
    return common.span_hash(common.prefix_hash(data, 0), starts, ends, 0), common.span_hash(common.prefix_hash(data, 1), starts, ends, 1), rows


def folded(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, coordinate and largest count of every coordinate that a row's terms use, in order of both."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])][:len(keys)])
    count = np.diff(np.r_[first, len(keys)])
    cell = row[first] * WIDTH + (keys[first] >> np.uint64(32)).astype(np.int64) % WIDTH
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][:len(cell)])
    peak = np.maximum.reduceat(count, first) if len(first) else count
    return cell[first] // WIDTH, cell[first] % WIDTH, np.minimum(peak, MOST + 1)


def impact(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, id, text, n (terms with repeats) and the sketch: the coordinates in use (16 bits each) and their largest counts (8 bits)."""
    plain = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            own, _, offsets = terms(batch.column(2))
            row, place, peak = folded(own, common.row_of(offsets))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            place, peak = place.astype("<u2"), peak.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(offsets)), *[pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (place, peak)]],
                ["key", "id", "text", "n", "places", "peaks"])

    return plain.mapInArrow(run, f"key long, id {plain.schema['id'].dataType.simpleString()}, text string, n long, places binary, peaks binary")


@dataclass
class Block:
    """A block of items: its vocabulary (sorted hashes), and per item the vocabulary numbers of its terms."""

    ids: list
    first: np.ndarray
    second: np.ndarray
    items: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> Block | None:
        """From (id, text) rows; None without any term."""
        one, two, offsets = terms(pa.array([text for _, text in rows], pa.large_string()))
        vocabulary, number = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)
        own: dict = {}
        for (name, _), low, high in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own.setdefault(name, []).append(number.reshape(-1)[low:high])
        found = {name: np.unique(np.concatenate(parts)) for name, parts in own.items() if sum(map(len, parts))}
        return Block(list(found), vocabulary[:, 0].copy(), vocabulary[:, 1].copy(), list(found.values())) if found else None

    def numbers(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, vocabulary number and count of every distinct term of the rows that is in the vocabulary."""
        one, two, offsets = terms(text)
        row = common.row_of(offsets)
        at = np.minimum(np.searchsorted(self.first, one), len(self.first) - 1)
        # hashes that agree in their first half follow each other
        known = np.zeros(len(one), bool)
        for _ in range(1 + int((self.first[1:] == self.first[:-1]).sum() > 0)):
            known |= (self.first[at] == one) & (self.second[at] == two)
            at = np.where(known, at, np.minimum(at + 1, len(self.first) - 1))
        cell, count = np.unique(row[known] * len(self.first) + at[known], return_counts=True)
        return cell // len(self.first), cell % len(self.first), count


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(id, text) rows in blocks of about ``size`` bytes of text, all rows of an id in one block; a block at a time is on the driver."""
    plain = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.text_blocks(plain, size, "id")


class Scorer:
    """What tasks need to bound and score documents for a block of items."""

    def __init__(self, block: Block, weights: np.ndarray, documents: int, length: int) -> None:
        self.block, self.weights, self.documents, self.length = block, weights, documents, length
        place = (block.first >> np.uint64(32)).astype(np.int64) % WIDTH
        used, self.column = np.unique(place, return_inverse=True)
        self.column_of = np.full(WIDTH, -1, np.int64)
        self.column_of[used] = np.arange(len(used))
        self.used = len(used)
        self.rows = max(16, min(512, CELLS // max(len(block.first), 1)))

    def m(self, n: np.ndarray) -> np.ndarray:
        return np.array([10 + 90 * x * self.documents // self.length for x in n.tolist()], np.int64)

    def bounds(self, places: pa.Array, peaks: pa.Array, n: np.ndarray) -> np.ndarray:
        """Upper bounds, a row an item and a column a document."""
        raw, offsets = common.buffers(peaks)
        place = np.frombuffer(common.buffers(places)[0].tobytes(), "<u2")
        column = self.column_of[place]
        mine = column >= 0
        row, peak = common.row_of(offsets)[mine], raw[mine].astype(np.int64)
        most = np.where(peak > MOST, 1_000_000, impact(peak, self.m(n)[row]))
        table = np.zeros((self.used, len(n)))
        table[column[mine], row] = most
        # sums of whole numbers; the factor covers rounding beyond 2**53
        return np.stack([self.weights[own].astype(np.float64) @ table[self.column[own]] for own in self.block.items]) * (1 + 1e-9)

    def impacts(self, text: pa.Array, n: np.ndarray) -> np.ndarray:
        """Exact impacts, a row a document and a column a term of the vocabulary."""
        row, number, count = self.block.numbers(text)
        table = np.zeros((len(n), len(self.block.first)), np.int64)
        table[row, number] = impact(count, self.m(n)[row])
        return table

    def score(self, item: int, impacts: np.ndarray) -> np.ndarray:
        own = self.block.items[item]
        return impacts[:, own] @ self.weights[own]


def document_counts(indexed: DataFrame, block: Block) -> np.ndarray:
    """Documents that hold each term of a block's vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(block.first), np.int64)
        for batch in common.slices(batches, "text"):
            held += np.bincount(block.numbers(batch.column(0))[1], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "documents"])

    out = np.zeros(len(block.first), np.int64)
    for term, documents in indexed.select("text").mapInArrow(run, "term long, documents long").groupBy("term").agg(F.sum("documents")).collect():
        out[term] = documents
    return out


def in_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def thresholds(indexed: DataFrame, scorer: Scorer, top: int) -> np.ndarray:
    """A score every item's last result must reach: the exact scores of the documents with its ``top`` highest bounds; 1 where there are fewer."""
    count = len(scorer.block.items)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, keys = np.zeros((count, 0)), np.zeros((count, 0), np.int64)
        for batch in in_runs(batches, scorer.rows):
            n = batch.column(1).to_numpy()
            best = np.concatenate([best, scorer.bounds(batch.column(2), batch.column(3), n)], axis=1)
            keys = np.concatenate([keys, np.broadcast_to(batch.column(0).to_numpy(), (count, batch.num_rows))], axis=1)
            if best.shape[1] > top:
                at = np.argpartition(-best, top - 1, axis=1)[:, :top]
                best, keys = np.take_along_axis(best, at, axis=1), np.take_along_axis(keys, at, axis=1)
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(keys[item, at]), pa.array(best[item, at])], ["item", "key", "bound"])

    found = indexed.select("key", "n", "places", "peaks").mapInArrow(highest, "item long, key long, bound double")
    chosen = common.stored(found.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))).where(F.col("place") <= top).select("item", "key"))
    items_of = chosen.groupBy("key").agg(F.collect_list("item").alias("items"))  # at most ``top`` rows an item

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(in_runs(batches, scorer.rows), "text"):
            impacts = scorer.impacts(batch.column(0), batch.column(1).to_numpy())
            pairs = [(item, int(scorer.score(item, impacts[k:k + 1])[0])) for k, items in enumerate(batch.column(2).to_pylist()) for item in items]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["item", "score"])

    scores: dict[int, list[int]] = {}
    for item, score in indexed.join(F.broadcast(items_of), "key").select("text", "n", "items").mapInArrow(exact, "item long, score long").collect():
        scores.setdefault(item, []).append(score)
    return np.array([max(1, sorted(scores.get(i, []))[0]) if len(scores.get(i, [])) >= top else 1 for i in range(count)], np.int64)


def rescored(indexed: DataFrame, scorer: Scorer, floor: np.ndarray, top: int) -> DataFrame:
    """item, id, key, score: what each task finds to be among an item's ``top``, by exact scores in descending order of bounds."""
    kind = indexed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor.copy()
        results: list[list[tuple]] = [[] for _ in least]
        ids_type = None
        for batch in common.slices(in_runs(batches, scorer.rows), "text"):
            ids_type = batch.column(1).type
            n = batch.column(3).to_numpy()
            bounds = scorer.bounds(batch.column(4), batch.column(5), n)
            open_items = np.flatnonzero((bounds >= least[:, None]).any(axis=1))
            queues = {}
            for item in open_items.tolist():
                mine = np.flatnonzero(bounds[item] >= least[item])
                queues[item] = mine[np.argsort(-bounds[item, mine], kind="stable")]
            impacts = np.zeros((0, len(scorer.weights)), np.int64)
            where = np.full(batch.num_rows, -1, np.int64)
            keys, ids = batch.column(0).to_numpy(), batch.column(1)
            while queues:
                heads = {item: queue[:STEP][bounds[item, queue[:STEP]] >= least[item]] for item, queue in queues.items()}
                wanted = np.unique(np.concatenate([h for h in heads.values()]))
                wanted = wanted[where[wanted] < 0]
                if len(wanted):
                    where[wanted] = len(impacts) + np.arange(len(wanted))
                    impacts = np.concatenate([impacts, scorer.impacts(batch.column(2).take(pa.array(wanted)), n[wanted])])
                for item, head in heads.items():
                    scores = scorer.score(item, impacts[where[head]])
                    new = [(-int(s), not ids[k].is_valid, ids[k].as_py() if ids[k].is_valid else 0, int(keys[k])) for s, k in zip(scores.tolist(), head.tolist(), strict=True) if s >= least[item]]
                    if new:
                        results[item] = heapq.nsmallest(top, results[item] + new)
                        if len(results[item]) == top:
                            least[item] = max(least[item], -results[item][-1][0])
                queues = {item: queue[STEP:] for item, queue in queues.items() if len(heads[item]) == STEP and len(queue) > STEP and bounds[item, queue[STEP]] >= least[item]}
        rows = [(item, None if missing else name, key, -score) for item, found in enumerate(results) for score, missing, name, key in found]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], ids_type), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                ["item", "id", "key", "score"])

    return indexed.select("key", "id", "text", "n", "places", "peaks").mapInArrow(run, f"item long, id {kind}, key long, score long")


def search(indexed: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents of an ``index`` (a stored one, as it is read several times)."""
    spark = indexed.sparkSession
    documents, length = indexed.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    item_kind, doc_kind = items.schema[id_col].dataType.simpleString(), indexed.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    for rows in blocks(items, id_col, text_col, block_bytes) if documents else ():
        block = Block.of(rows)
        if block is None:
            continue
        held = document_counts(indexed, block)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        scorer = Scorer(block, weights, documents, length)
        found = rescored(indexed, scorer, thresholds(indexed, scorer, top), top)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {item_kind}")
        out = out.union(common.stored(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")))
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``search`` over an index of ``docs`` (doc_id, text) for ``items`` (item_id, text)."""
    return common.finished(docs.sparkSession, lambda: search(common.stored(index(docs)), items, top=top))
