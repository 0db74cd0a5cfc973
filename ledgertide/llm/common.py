"""What the text operators share: tables, the shared work folder, and words and hashes of whole Arrow columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A slice of rows is worked on at once in numpy; it holds about so many bytes of text. A longer text is a slice of its own.
SLICE_BYTES = 500_000

_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value for each byte and hash.
BYTE_VALUES = (_rng.integers(0, 2**63, (2, 256), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Odd bases of the polynomial hashes, and their inverses modulo 2**64.
BASES = tuple(int(x) | 3 for x in (_rng.integers(0, 2**62, 2, dtype=np.uint64) << np.uint64(2)))
INVERSES = tuple(pow(base, -1, 2**64) for base in BASES)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names; a temporary one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        directory = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = directory.get() if directory.isDefined() else tempfile.mkdtemp(prefix="llm-work-")
        if not directory.isDefined():
            spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: cuts the lineage and survives lost executors."""
    folder = work_folder(df.sparkSession)
    if _scratch:
        _scratch[-1].append(folder)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Folders that ``stored`` made since each open ``finished`` began.
_scratch: list[list[str]] = []


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``build``; the tables that were stored on the way to it are deleted."""
    _scratch.append([])
    try:
        result = build()
        folder = work_folder(spark)
        result.write.option("compression", "zstd").parquet(folder)
    finally:
        for old in _scratch.pop():
            _delete(spark, old)
    return spark.read.schema(result.schema).parquet(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, when nothing reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Hash buckets by which rows of a query set are dealt to one block.
BUCKETS = 64


def text_blocks(rows: DataFrame, size: int, *together: str) -> Iterator[list[tuple]]:
    """(id, text) rows in blocks of about ``size`` bytes of text, a block at a time on the driver; rows with equal ``together`` columns are in one block.

    Rows fall into many small hash buckets, which fill the blocks in turn, so a block is over its size by one bucket at most, or holds one key only.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*together), F.lit(BUCKETS * (total // size) + 1)))
    sizes = dealt.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("bucket").collect()
    low, held = 0, 0
    for k, r in enumerate(sizes):
        held += r["bytes"]
        if k + 1 == len(sizes) or held + sizes[k + 1]["bytes"] > size:
            yield [(x["id"], x["text"]) for x in dealt.where(F.col("bucket").between(low, r["bucket"])).collect()]
            low, held = r["bucket"] + 1, 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their n + 1 offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**0 … base**(n - 1) modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), (INVERSES if inverse else BASES)[which], dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 23:  # a very long text does not stay in memory
            _powers[which, inverse] = have
    return have[:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """n + 1 prefix sums, of which ``span_hash`` makes the hash of any substring."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[which][data] * powers(len(data), which), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), which, True)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across rows, and n + 1 word offsets of the rows."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element, given n + 1 offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def remainder(id_column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary")) % modulus


def empty_text(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")
