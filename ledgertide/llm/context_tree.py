"""Language-model scoring by context-tree weighting over bytes.

Text is a stream of bytes: lower-cased words joined by single blanks, then one line end. A byte is eight binary decisions
(a walk through a tree of 255 nodes), each of them with a context tree over the preceding ``DEPTH`` bytes. Every context node keeps
a Krichevsky-Trofimov estimate; a node's weighted probability is the even mixture of its own estimate and the product of
its children's, and so the prediction mixes the estimates of all depths from 0 to ``DEPTH``. Minus the log of what a
text's bytes get is its code length. The model is learned from the training documents, then frozen.

How it runs in Spark. Documents are packed into blocks (a written table). Each block asks for the distinct (context, byte)
strings it holds and reports their counts in its training documents, dealt to buckets by the hash of the three most
recent context bytes, and likewise for words. A bucket adds up the counts, which makes its part of the model, works out
the nodes of depth 3 and more, and answers every block with one number per string. Nodes of depth 2 and less are fewer than 256 * 256 * 256
whatever the corpus, so they are broadcast. All steps stream: a task holds one bucket of the model and one block's strings.

A null text is empty: one token, the end. Null ids are kept; repeated rows each count. Without training documents every
decision has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

DEPTH = 5
#: Bytes of text of one block, and the places that are sorted at once.
BLOCK_BYTES = 12_000_000
SORTED_AT_ONCE = 2_000_000
START, END, GAP = b"\n" * DEPTH, b"\n", b" "
#: Node numbers of a byte's eight decisions and their outcomes.
_bytes = np.arange(256)
NODES = np.stack([(1 << j) | (_bytes >> (8 - j)) for j in range(8)], axis=1).astype(np.uint64)
BITS = np.stack([(_bytes >> (7 - j)) & 1 for j in range(8)], axis=1).astype(bool)


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, by byte planes; sorted values should come as differences."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1) if len(values) else b""


def unpacked(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def stream(text: str | None) -> bytes:
    """The bytes that are scored, with DEPTH line ends before them as their first context."""
    return START + GAP.join((text or "").encode("utf-8").lower().split()) + END


def strings(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """48-bit keys of the places begin … end - 1: the preceding bytes, the most recent one highest, then the byte itself."""
    key = data[begin:end].astype(np.uint64)
    for back in range(1, DEPTH + 1):
        key |= data[begin - back:end - back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    return key


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (common.mix(keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Block:
    """Documents' streams in one array, with the distinct strings and words in them."""

    def __init__(self, data: bytes, offsets: np.ndarray, held: np.ndarray):
        self.data = np.frombuffer(data, np.uint8)
        self.offsets, self.held = offsets, held
        self.size = len(self.data)

    def scored(self) -> np.ndarray:
        """Whether a place is scored; the START bytes are not."""
        out = np.ones(self.size, bool)
        for i in range(DEPTH):
            out[self.offsets[:-1] + i] = False
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct strings, and how often each stands in a training document."""
        places = self.scored()
        held = np.zeros(self.size, bool)
        for a, b in zip(self.offsets[:-1][self.held].tolist(), self.offsets[1:][self.held].tolist(), strict=True):
            held[a:b] = True
        keys, counts = [], []
        for begin in range(DEPTH, self.size, SORTED_AT_ONCE):
            end = min(begin + SORTED_AT_ONCE, self.size)
            key = (strings(self.data, begin, end) << np.uint64(1)) | held[begin:end].astype(np.uint64)
            key, count = np.unique(key[places[begin:end]], return_counts=True)
            keys.append(key >> np.uint64(1))
            counts.append(np.where(key & np.uint64(1), 0, count))
        return added(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and word offsets of the documents."""
        hashes, sizes = [], [np.zeros(1, np.int64)]
        docs = len(self.offsets) - 1
        first = 0
        while first < docs:  # some documents at a time
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + SORTED_AT_ONCE, side="right")) - 1)
            part = self.data[self.offsets[first]:self.offsets[last]]
            starts, ends, rows = common.words(part, self.offsets[first:last + 1] - self.offsets[first], ~common.SPACE)
            hashes.append(common.span_hash(common.prefix_hash(part), starts, ends))
            sizes.append(np.diff(rows))
            first = last
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(np.concatenate(sizes))

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, offsets = self.words()
        held = np.repeat(self.held, np.diff(offsets))
        distinct = np.unique(hashes)
        known, count = np.unique(hashes[~held], return_counts=True)
        counts = np.zeros(len(distinct), np.int64)
        counts[np.searchsorted(distinct, known)] = count
        return distinct, counts

    def scores(self, distinct: np.ndarray, log10: np.ndarray) -> np.ndarray:
        """Sum of the numbers of its places' strings for each document."""
        each = np.zeros(self.size, np.float32)
        places = self.scored()
        step = 1 << 16
        for begin in range(DEPTH, self.size, step):
            end = min(begin + step, self.size)
            key = np.sort((strings(self.data, begin, end) << np.uint64(16)) | np.arange(end - begin, dtype=np.uint64))
            place, key = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            at = np.minimum(np.searchsorted(distinct, key[first]), max(len(distinct) - 1, 0))
            each[begin + place] = np.repeat(log10[at], np.diff(np.r_[first, len(key)]))
        each[~places] = 0
        return np.add.reduceat(each, self.offsets[:-1], dtype=np.float64)


class Model:
    """The nodes of depth 3 to DEPTH of one bucket, and its strings' log10 probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: dict | None = None):
        self.top = top
        some = counts > 0
        self.keys, byte = keys[some], (keys[some] & np.uint64(255)).astype(np.int64)
        node = (((self.keys >> np.uint64(8))[:, None] << np.uint64(8)) | NODES[byte]).reshape(-1)
        bit = BITS[byte].reshape(-1)
        times = np.repeat(counts[some], 8)
        self.levels = {}
        order = np.argsort(node, kind="stable")
        node, ones, zeros, below = node[order], np.where(bit, times, 0)[order], np.where(bit, 0, times)[order], np.zeros(len(order))
        for depth in range(DEPTH, 2, -1):
            node, zeros, ones, below = summed(node, zeros, ones, below)
            own, whole, share = weighted(zeros, ones, below, depth == DEPTH)
            self.levels[depth] = node, share, own
            node, below = ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)), whole
        self.rest = summed(node, zeros, ones, below)  # depth 2, to be added up over the buckets
        self.log10 = self.predict(self.keys) if top is not None else None

    def predict(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string, after the others."""
        byte = (keys & np.uint64(255)).astype(np.int64)
        bits = BITS[byte]
        total = np.zeros(len(keys))
        for j in range(8):
            chance = np.full(len(keys), 0.5)
            for depth in range(DEPTH, -1, -1):
                node = ((keys >> np.uint64(8 * (DEPTH - depth + 1))) << np.uint64(8)) | NODES[byte, j]
                table, share, one = self.levels[depth] if depth > 2 else self.top[depth]
                at = np.minimum(np.searchsorted(table, node), max(len(table) - 1, 0))
                found = table[at] == node if len(table) else np.zeros(len(node), bool)
                # a context never seen has the estimate 1/2 at all depths below and leaves the mixture even
                weight, own = (np.where(found, share[at], 0.5), np.where(found, one[at], 0.5)) if len(table) else (0.5, 0.5)
                chance = weight * own + (1 - weight) * chance
            total += np.log10(np.where(bits[:, j], chance, 1 - chance))
        return total

    def answer(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty(len(keys), np.float32)
        out[known] = self.log10[at[known]] if len(self.keys) else 0
        out[~known] = self.predict(keys[~known])
        return out


def summed(node: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values of equal nodes; nodes come in order, or nearly so."""
    if not len(node):
        return node, *values
    order = np.argsort(node, kind="stable")
    node = node[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    return node[first], *[np.add.reduceat(v[order], first) for v in values]


_log_factorials = np.zeros(1)


def _log_half_gamma(n: np.ndarray) -> np.ndarray:
    """log of gamma(n + 1/2) / gamma(1/2), by the table for small n and Stirling's series beyond."""
    global _log_factorials
    if len(_log_factorials) == 1:
        _log_factorials = np.r_[0.0, np.cumsum(np.log(np.arange(4096) + 0.5))]
    x = n + 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        series = (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3) + 0.5 * np.log(2 * np.pi) - 0.5 * np.log(np.pi)
    return np.where(n <= 4096, _log_factorials[np.minimum(n, 4096)], series)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    small = np.r_[0.0, np.cumsum(np.log(np.arange(1, 4096)))]
    series = (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3) + 0.5 * np.log(2 * np.pi)
    return np.where(n < 4096, small[np.minimum(n, 4095)], series)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate of a one, log of the weighted probability, and the share of the node's own estimate in it."""
    own = (ones + 0.5) / (zeros + ones + 1.0)
    log = _log_half_gamma(zeros) + _log_half_gamma(ones) - _log_factorial(zeros + ones)
    if leaf:
        return own, log, np.ones(len(own))
    whole = np.logaddexp(log, below) - np.log(2)
    return own, whole, np.exp(log - whole - np.log(2))


def blocks(docs: DataFrame) -> DataFrame:
    """(id, text, held) -> block, ids, held, offsets, data: written once, about ``BLOCK_BYTES`` of text each."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, streams, size, id_type = [], [], [], 0, None

        def made() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(s) for s in streams])].astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(streams), 3)], pa.binary())], ["block", "ids", "held", "offsets", "data"])

        for batch in common.slices(batches, "text"):
            id_type = batch.column(0).type
            for key, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(key)
                held.append(bool(out))
                streams.append(stream(text))
                size += len(streams[-1])
                if size >= BLOCK_BYTES:
                    yield made()
                    ids, held, streams, size, number = [], [], [], 0, number + 1
        if ids:
            yield made()

    return docs.select("id", "text", "held").mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, offsets array<long>, data binary")


def _block(data: bytes, offsets, held) -> Block:
    return Block(zstandard.decompress(data), np.array(offsets, np.int64), np.array(held, bool))


ASKED = "bucket int, kind int, block long, strings binary, counts binary, words binary, word_counts binary"


def requests(packs: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: the distinct strings and words of the block with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _block(batch.column(4)[row].as_py(), batch.column(3)[row].as_py(), batch.column(2)[row].as_py())
                found = [block.distinct(), block.word_counts()]
                cut = []
                for keys, counts in ((found[0][0], found[0][1]), (found[1][0], found[1][1])):
                    own = bucket_of(keys, buckets) if keys is found[0][0] else (keys % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(own, kind="stable")
                    cut.append((keys[order], counts[order], np.searchsorted(own[order], np.arange(buckets + 1))))
                rows = []
                for b in range(buckets):
                    sides = [(k[e[b]:e[b + 1]], c[e[b]:e[b + 1]].astype(np.uint32)) for k, c, e in cut]
                    if len(sides[0][0]) or len(sides[1][0]):
                        rows.append((b, 1, batch.column(0)[row].as_py(), packed_sorted(sides[0][0]), packed(sides[0][1]), packed_sorted(sides[1][0]), packed(sides[1][1])))
                yield _rows(rows, [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4], ASKED)

    return packs.mapInArrow(run, ASKED)


def _rows(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def model_buckets(asked: DataFrame, parts: int) -> DataFrame:
    """One row per bucket: strings and words with their counts over all blocks (kind 0), and the sums over words."""
    schema = ASKED + ", n_words long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, weight, whole = None, [], 0, []

        def fold() -> None:
            nonlocal waiting, weight, whole
            for side in range(2):
                keys = [w[side][0] for w in waiting] + ([whole[side][0]] if whole else [])
                counts = [w[side][1].astype(np.int64) for w in waiting] + ([whole[side][1]] if whole else [])
                sums = added(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                keep = sums[1] > 0
                (new := [] if side == 0 else new).append((sums[0][keep], sums[1][keep]))
            whole, waiting, weight = new, [], 0

        def finished() -> pa.RecordBatch:
            fold()
            (k, c), (w, n) = whole
            return _rows([(now, 0, -1, packed_sorted(k), packed(c), packed_sorted(w), packed(n), len(w), int(n.sum()))],
                         [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()], schema)

        for batch in batches:
            for row in range(batch.num_rows):
                bucket, (k, c, w, n) = batch.column(0)[row].as_py(), (batch.column(i)[row].as_py() for i in range(3, 7))
                if now is not None and bucket != now:
                    yield finished()
                    whole = []
                now = bucket
                waiting.append(((unpacked_sorted(k), unpacked(c, np.uint32)), (unpacked_sorted(w), unpacked(n, np.uint32))))
                weight += len(waiting[-1][0][0]) + len(waiting[-1][1][0])
                if weight > 4 * SORTED_AT_ONCE:
                    fold()
        if now is not None:
            yield finished()

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def top_nodes(models: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of depth 0, 1 and 2: at most 256 * 256 * 255 of depth 2, whatever the corpus."""
    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rest = Model(unpacked_sorted(batch.column(0)[row].as_py()), unpacked(batch.column(1)[row].as_py(), np.int64)).rest
                yield pa.RecordBatch.from_arrays([pa.array(rest[0].astype(np.int64)), pa.array(rest[1].astype(np.int64)), pa.array(rest[2].astype(np.int64)), pa.array(rest[3].astype(float))], ["node", "zeros", "ones", "below"])

    found = models.select("strings", "counts").mapInArrow(contributions, "node long, zeros long, ones long, below double").groupBy("node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    node, zeros, ones, below = (found.column(i).to_numpy() for i in range(4))
    node = node.astype(np.uint64)
    top = {}
    for depth in (2, 1, 0):
        node, zeros, ones, below = summed(node, zeros, ones, below)
        own, whole, share = weighted(zeros, ones, below, False)
        top[depth] = node, share, own
        node, below = ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)), whole
    return top


def replies(asked: DataFrame, models: DataFrame, top, parts: int) -> DataFrame:
    """Per block and bucket: the log10 probability of each string asked for and the count of each word, in the order asked."""
    both = models.select(*[x.split()[0] for x in ASKED.split(", ")]).union(asked.withColumns({"counts": F.lit(b""), "word_counts": F.lit(b"")}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words = counts = None
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                bucket, kind, block, k, c, w, n = (batch.column(i)[row].as_py() for i in range(7))
                if kind == 0:
                    model = Model(unpacked_sorted(k), unpacked(c, np.int64), top.value)
                    words, counts = unpacked_sorted(w), unpacked(n, np.int64)
                    continue
                log10 = model.answer(unpacked_sorted(k))
                wanted = unpacked_sorted(w)
                at = np.minimum(np.searchsorted(words, wanted), max(len(words) - 1, 0))
                known = np.where(words[at] == wanted, counts[at], 0) if len(words) else np.zeros(len(wanted), np.int64)
                out.append((block, bucket, packed(log10), packed(known)))
            yield _rows(out, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], "block long, bucket int, log10 binary, known binary")

    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "block long, bucket int, log10 binary, known binary")


def scored(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (log10 probability) and bits_per_byte.

    ``held`` is a column expression; documents where it is true are scored but not learned from.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * parts
    kind = docs.schema[id_col].dataType.simpleString()
    packs = common.stored(blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))), "uncompressed")
    asked = common.stored(requests(packs, buckets), "uncompressed")
    models = common.stored(model_buckets(asked, parts), "uncompressed")
    sums = models.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    ends = packs.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    distinct, tokens = (sums[0] or 0) + (ends > 0), (sums[1] or 0) + ends
    top = spark.sparkContext.broadcast(top_nodes(models))
    answers = replies(asked, models, top, parts).select("block", "bucket", "log10", "known")
    holder = packs.select("block", F.lit(-1).alias("bucket"), F.col("data").alias("log10"), F.lit(b"").alias("known"), "ids", "held", "offsets")
    both = holder.unionByName(answers, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def finished() -> pa.RecordBatch:
            block, ids = state["block"], state["ids"]
            score = block.scores(state["keys"], state["log10"])
            hashes, offsets = block.words()
            times = state["known"][np.searchsorted(state["words"], hashes)] if len(hashes) else np.zeros(0, np.int64)
            floor = tokens + 0.1 * (distinct + 1)
            logs = np.r_[0.0, np.cumsum(np.log10((times + 0.1) / floor))]
            base = np.log10((ends + 0.1) / floor) + logs[offsets[1:]] - logs[offsets[:-1]]
            seen = np.r_[0, np.cumsum(times > 0)]
            n = np.diff(offsets) + 1
            size = np.diff(block.offsets) - DEPTH
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(block.held), pa.array(n), pa.array(seen[offsets[1:]] - seen[offsets[:-1]] + (ends > 0)), pa.array(np.full(len(n), tokens, np.int64)),
                 pa.array(base), pa.array(score), pa.array(-score * np.log2(10) / size)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for row in range(batch.num_rows):
                _, bucket, data, known = (batch.column(i)[row].as_py() for i in range(4))
                if bucket < 0:
                    if state:
                        yield finished()
                    block = _block(data, batch.column(6)[row].as_py(), batch.column(5)[row].as_py())
                    keys, words = block.distinct()[0], np.unique(block.words()[0])
                    own, word_own = bucket_of(keys, buckets), (words % np.uint64(buckets)).astype(np.int64)
                    state = {"block": block, "ids": batch.column(4).slice(row, 1).flatten(), "keys": keys, "words": words, "log10": np.zeros(len(keys), np.float32), "known": np.zeros(len(words), np.int64),
                             "places": (np.argsort(own, kind="stable"), np.argsort(word_own, kind="stable")),
                             "edges": (np.searchsorted(np.sort(own), np.arange(buckets + 1)), np.searchsorted(np.sort(word_own), np.arange(buckets + 1)))}
                    continue
                for name, side, values in (("log10", 0, unpacked(data, np.float32)), ("known", 1, unpacked(known, np.int64))):
                    edges = state["edges"][side]
                    state[name][state["places"][side][edges[bucket]:edges[bucket + 1]]] = values
        if state:
            yield finished()

    return both.mapInArrow(run, schema)
