"""Document fingerprints by MinHash.

``PERMUTATIONS`` strongly universal hash functions (multiply, add, take the high half; 32-bit keys) run over the five-word
shingles of a text; the least value under each is a coordinate of the signature. The fingerprint is the signature's low 16 bits
in hex, the likeness of two fingerprints the share of equal coordinates, an estimate of the Jaccard similarity of the
shingle sets. Signature bands are joined in Spark and candidates verified on full sets (``near_groups``).

A text without words has the fingerprint of all ones: alike to itself only. Null texts are empty. Ids may be of any type that Spark orders. For the comparison with
the next document, documents stand in the order of (id, text hash), null ids first; the one after the last is the first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common, near_duplicates

SHINGLE = 5
PERMUTATIONS = 128
#: Bands of the signature for ``near_groups``: a pair at similarity 0.75 shares none with probability (1 - 0.75**4)**32 < 6e-6.
BANDS, ROWS = 32, 4
_rng = np.random.default_rng(61)
FACTORS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)


def signatures(text: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 32-bit minima a text."""
    raw, offsets = common.buffers(text)
    data = common.LOWER[raw]
    starts, ends, rows = common.words(data, offsets, ~common.SPACE)
    hashes = common.span_hash(common.prefix_hash(data), starts, ends)
    counts = np.diff(rows)
    # a text of fewer words than a shingle has one, of all its words
    length = np.minimum(counts, size)
    shingles = np.where(counts > 0, counts - length + 1, 0)
    first = np.repeat(rows[:-1], shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    span = np.repeat(length, shingles)
    rolled = span.astype(np.uint64)
    for k in range(size):
        inside = span > k
        rolled = np.where(inside, common.mix(rolled + hashes[np.minimum(first + k, max(len(hashes) - 1, 0))]), rolled) if len(hashes) else rolled
    keys = rolled >> np.uint64(32)
    out = np.full((len(counts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(shingles)
    if len(some):
        begin = (np.cumsum(shingles) - shingles)[some]
        for i in range(PERMUTATIONS):
            out[some, i] = np.minimum.reduceat((keys * FACTORS[i] + TERMS[i]) >> np.uint64(32), begin)
    return out


def fingerprint(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in (signature & np.uint32(0xFFFF)).astype(">u2")]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of two stacks of signatures, as their fingerprints show them."""
    empty = (left == 0xFFFFFFFF).all(axis=1) != (right == 0xFFFFFFFF).all(axis=1)
    return np.where(empty, 0.0, ((left & 0xFFFF) == (right & 0xFFFF)).mean(axis=1))


def banded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, tag (a hash of the text), n_shingles, a 128-bit hash of the shingle set (s1, s2) and the hashes of the signature's bands."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets = near_duplicates.shingle_sets(batch.column(1))
            marks = signatures(batch.column(1))
            table = marks.astype(np.uint64).reshape(len(marks), BANDS, ROWS)
            bands = np.zeros((len(marks), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = common.mix(bands + table[:, :, r])
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), *near_duplicates.set_hashes(sets),
                 common.lists(bands[sizes > 0].reshape(-1).view(np.int64), np.r_[0, np.cumsum(np.where(sizes > 0, BANDS, 0))], pa.int64())],
                ["doc_id", "tag", "n_shingles", "s1", "s2", "bands"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, tag long, n_shingles long, s1 long, s2 long, bands array<long>")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """doc_id, tag (a hash of the text) and class_id, the smallest id that links reach, one row per row of ``docs``.

    Signature bands are joined in Spark and links verified by the Jaccard similarity of full sets. Rows of equal sets are one class before that, so
    copies cost nothing, and rows that share an id have each the class of their own text. Null ids have no class.
    """
    found = common.finished(docs.sparkSession, lambda: near_duplicates._grouped(docs, id_col, text_col, threshold, False, banded, ("tag",), sift=True))
    return found.select("doc_id", "tag", F.col("component_id").alias("class_id"))


def packed(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each text compressed, and its bytes before."""
    codec, raw = pa.Codec("zstd", 3), text.cast(pa.binary()).to_pylist()
    return pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``packed`` and ``size`` -> the same with ``text`` in their place, a slice at a time."""
    codec = pa.Codec("zstd")
    for batch in common.slices(batches, "packed"):
        texts = [codec.decompress(x, n, asbytes=True) if n else b"" for x, n in zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist(), strict=True)]
        text = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("tail"), batch.column("id"), text, batch.column("tag")], ["bucket", "tail", "id", "text", "tag"])


def in_order(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, packed, size, tag, bucket, tail: sorted runs of documents, each followed by the first document of the next run.

    Spark cuts the order of (id, tag) into ranges of about equal numbers, whatever the type of the ids and however many rows share one; the driver sees the first
    place of each range. Every text is shuffled once, compressed as a whole.
    """
    spark = docs.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["id"].dataType.simpleString()
    tagged = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    ranged = tagged.select("id", "tag").repartitionByRange(runs, "id", "tag").withColumn("range", F.spark_partition_id())
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tag")).alias("at")).collect()
    heads = sorted((r["at"]["known"], r["at"]["id"] if r["at"]["known"] else 0, r["at"]["tag"]) for r in firsts)

    # numbers whose hash puts each run into a partition of its own
    wanted = spark.range(40 * runs).select("id", F.pmod(F.hash("id"), F.lit(runs)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    route = {r["p"]: r["id"] for r in wanted}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            places = [(i is not None, 0 if i is None else i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            bucket = [bisect_right(heads, place) - 1 for place in places]
            copies = [k for k, (place, b) in enumerate(zip(places, bucket, strict=True)) if place == heads[b]]
            to = bucket + [(bucket[k] - 1) % len(heads) for k in copies]
            rows = np.r_[np.arange(batch.num_rows), np.array(copies, np.int64)].astype(np.int64)
            tail = np.r_[np.zeros(batch.num_rows, bool), np.ones(len(copies), bool)]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([route.get(b, b) for b in to], pa.int64()), pa.array(to, pa.int64()), pa.array(tail), taken.column(0), *packed(taken.column(1)), taken.column(2)],
                ["route", "bucket", "tail", "id", "packed", "size", "tag"])

    spread = tagged.mapInArrow(dealt, f"route long, bucket long, tail boolean, id {kind}, packed binary, size long, tag long")
    return spread.repartition(runs, "route").sortWithinPartitions("bucket", "tail", "id", "tag").select("bucket", "tail", "id", "packed", "size", "tag")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the second half replaced by the next document's start), the likenesses, and tag (a hash of its text)."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the slice before, which waits for its successor
        for batch in common.slices(unpacked(batches), "text"):
            marks = signatures(batch.column(3))
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), marks, batch.column(4).to_pylist(), strict=True))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            some = [i for i in range(len(rows) - 1) if not rows[i][0]]
            if not some:
                continue
            sizes = [len(rows[i][2]) for i in some]
            edits = [rows[i][2][:n - n // 2] + rows[i + 1][2][:n // 2] for i, n in zip(some, sizes, strict=True)]
            edited = signatures(pa.array(edits, pa.string()))
            own, after = np.stack([rows[i][3] for i in some]), np.stack([rows[i + 1][3] for i in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in some], batch.column(2).type), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edits]),
                 pa.array(fingerprint(own)), pa.array(fingerprint(edited)), pa.array(likeness(own, edited)), pa.array(likeness(own, after)), pa.array([rows[i][4] for i in some], pa.int64())], names)

    return in_order(plain).mapInArrow(run, f"doc_id {plain.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, tag long")


def with_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_edits`` and each row's class_id of ``near_groups``."""
    classes = common.stored(near_groups(docs, id_col, text_col).where("doc_id is not null and class_id <> doc_id").distinct().withColumnsRenamed({"doc_id": "_id", "tag": "_tag"}))
    common.release(docs.sparkSession)  # the groups' shuffles are done with before all texts are shuffled
    found = with_edits(docs, id_col, text_col)
    joined = found.join(classes, (found["doc_id"] == classes["_id"]) & (found["tag"] == classes["_tag"]), "left")
    return joined.select(*[c for c in found.columns if c != "tag"], F.coalesce("class_id", "doc_id").alias("class_id"))
