"""Tables that micro-batches write: append-only logs and latest-row snapshots in a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchLog:
    """An append-only table with one folder per micro-batch.

    A retried batch overwrites its own folder, so each batch counts exactly once even when the driver
    or an executor was lost after the write. ``by`` (name, SQL expression) partitions each batch further, so that
    readers who filter on the name skip the rest.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, str] | None = None) -> None:
        self.spark, self.path, self.schema, self.by = spark, path, schema, by
        start = spark.createDataFrame([], schema)
        if by:
            start = start.withColumn(by[0], F.expr(by[1]))
        (start.write.mode("ignore").partitionBy(by[0]) if by else start.write.mode("ignore")).parquet(f"{path}/batch=-1")

    def all(self) -> DataFrame:
        extra = f", {self.by[0]} string" if self.by else ""
        return self.spark.read.schema(f"{self.schema}, batch bigint{extra}").option("basePath", self.path).parquet(self.path)

    def before(self, batch_id: int) -> DataFrame:
        return self.all().where(F.col("batch") < batch_id)

    def write(self, batch_id: int, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        kept = rows.select(*columns)
        if self.by:
            kept = kept.withColumn(self.by[0], F.expr(self.by[1]))
        writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(self.by[0]) if self.by else writer).parquet(f"{self.path}/batch={batch_id}")


class Snapshot(BatchLog):
    """A table of latest rows: every batch writes a whole new version computed from the one before it."""

    def current(self, before: int | None = None) -> DataFrame:
        rows = self.all() if before is None else self.before(before)
        # The newest version's number; only its folder is then read.
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


# --- tables in hash buckets -------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path itself: the store may be one that only Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``."""
    files, at = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def move(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Move the data files of folder ``source`` into ``target``, under names with ``prefix``; how many there were (none without the folder)."""
    files, at = _files(spark, source)
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isFile()] if files.exists(at) else []
    names = [n for n in names if not n.startswith(("_", "."))]
    files.mkdirs(_files(spark, target)[1])
    for name in names:
        if not files.rename(_files(spark, f"{source}/{name}")[1], _files(spark, f"{target}/{prefix}{name}")[1]):
            raise OSError(f"{source}/{name} was not moved to {target}")
    return len(names)


class BucketTable:
    """Rows in folders ``part=…/bucket=…``: a part is what one batch (or one compaction) wrote, a bucket a hash of the key.

    A part counts once Spark has marked it as complete, so a batch that failed half-way is invisible and its retry writes the same part anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold a key of ``rows``: at most as many numbers as there are buckets."""
        return sorted(r["bucket"] for r in self.bucketed(rows.select(self.key)).select("bucket").distinct().collect())

    def parts(self) -> list[tuple[int, str]]:
        """(batch number, kind) of the complete parts; kind b is a batch, c a compaction of all batches up to it."""
        files, _ = _files(self.spark, self.path)
        complete = [n for n in folders(self.spark, self.path) if n.startswith("part=") and files.exists(_files(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted((int(n[6:]), n[5]) for n in complete)

    def folder(self, batch_id: int, kind: str = "b") -> str:
        return f"{self.path}/part={kind}{batch_id}"

    def load(self, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, part string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def put(self, rows: DataFrame, batch_id: int, kind: str = "b") -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        # one file a bucket
        self.bucketed(rows.select(*columns)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.folder(batch_id, kind))


class BucketLog(BucketTable):
    """An append-only log that keeps each key once. A batch reads the buckets that its own keys fall into, and no others.

    After ``every`` batches with rows the parts so far become one; what the compaction before had replaced is then removed, so that readers
    who listed the log before a compaction still find their files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, every: int = 20) -> None:
        super().__init__(spark, path, schema, key, buckets)
        self.every = every

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of the batches before a number; with ``buckets`` only files of these are read."""
        parts = [p for p in self.parts() if before is None or p[0] < before]
        base = max([n for n, kind in parts if kind == "c"], default=-1)
        rows = self.load([self.folder(n, kind) for n, kind in parts if n > base or (n, kind) == (base, "c")])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def insert(self, batch_id: int, rows: DataFrame, order: list[str]) -> None:
        """Add the keys that are new, the first row of each. A retry of the batch gives the same part."""
        from ledgertide.operators.versions import insert_once

        touched = self.touched(rows)
        if touched:
            self.put(insert_once(self.read(batch_id, touched), rows, self.key, order), batch_id)
        done = [p for p in self.parts() if p[0] < batch_id]
        if len([n for n, kind in done if kind == "b" and n > max([m for m, k in done if k == "c"], default=-1)]) >= self.every:
            self.compact(batch_id - 1)

    def compact(self, through: int) -> None:
        """One part in place of all up to batch ``through``, which must be done."""
        parts = [p for p in self.parts() if p[0] <= through]
        if not [p for p in parts if p[1] == "b"]:
            return
        replaced = max([n for n, kind in parts if kind == "c"], default=-1)
        self.put(self.read(through + 1), through, "c")
        for n, kind in parts:
            if n < replaced or (n == replaced and kind == "b"):
                remove(self.spark, self.folder(n, kind))


class BucketSnapshot(BucketTable):
    """The latest row of every key. A batch rewrites the buckets it touches and leaves the files of all others alone.

    A bucket's current version is that of the newest complete part which holds it; the version before it stays for a retry of the batch, older ones go.
    """

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """Batches that wrote each bucket, newest first."""
        out: dict[int, list[int]] = {}
        for n, _ in reversed(self.parts()):
            if before is None or n < before:
                for name in folders(self.spark, self.folder(n)):
                    if name.startswith("bucket="):
                        out.setdefault(int(name[7:]), []).append(n)
        return out

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        current = {b: v[0] for b, v in self.versions(before).items() if buckets is None or b in buckets}
        return self.load([f"{self.folder(n)}/bucket={b}" for b, n in sorted(current.items())])

    def update(self, batch_id: int, rows: DataFrame, merge) -> None:
        """``merge(stored, rows)`` gives the new rows of the touched buckets; it must keep every stored key."""
        touched = self.touched(rows)
        if not touched:
            return
        self.put(merge(self.read(batch_id, touched).drop("part", "bucket"), rows), batch_id)
        for bucket, versions in self.versions(batch_id).items():
            for old in versions[1:]:
                remove(self.spark, f"{self.folder(old)}/bucket={bucket}")
        held = {n for versions in self.versions().values() for n in versions}
        for n, kind in self.parts():
            if n < batch_id and n not in held:
                remove(self.spark, self.folder(n, kind))
