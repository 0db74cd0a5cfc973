"""Exports: results flattened to plain columns and written by the tasks that computed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.operators.events import WINDOWS


def flatten(df: DataFrame) -> DataFrame:
    """Structs to prefixed columns, arrays of plain values to text, so that any row fits CSV."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "struct":
            columns += [F.col(f"`{field.name}`.`{child.name}`").alias(f"{field.name}_{child.name}") for child in field.dataType.fields]
        elif kind == "array" and field.dataType.elementType.typeName() not in ("struct", "array", "map"):
            columns.append(F.array_join(F.transform(F.col(field.name), lambda x: x.cast("string")), " ").alias(field.name))
        elif kind in ("array", "map"):
            columns.append(F.to_json(F.col(field.name)).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def study_table(stats: DataFrame, candles: DataFrame, table: str) -> DataFrame:
    """Per-period statistics, or every year's candle."""
    if table not in ("stats", "detail"):
        raise ValueError(table)
    return flatten(stats if table == "stats" else candles)


def _window(name: str) -> Column:
    return F.filter("windows", lambda w: w["window"] == name)[0]


def event_table(rows: DataFrame, stats: DataFrame, table: str) -> DataFrame:
    """Statistics per ticker, group and window, or one row per event with its windows side by side."""
    if table == "stats":
        return flatten(stats)
    wide = rows
    for window in WINDOWS:
        one = _window(window)
        wide = wide.withColumns({window: one["value"], f"{window}_status": one["status"], f"{window}_benchmark": one["benchmark"], f"{window}_excess": one["excess"],
                                 f"{window}_sector": one["sector"], f"{window}_sector_excess": one["sector_excess"]})
    return flatten(wide.drop("windows", "path", "context", "cutoff_no"))


def context_points(contexts: DataFrame) -> DataFrame:
    """Trade contexts in long form: one row per trade, basis and measure."""
    measures = ("before_n", "after_n", "pre_5", "day_1", "day_5")
    pieces = F.array(*[F.struct(F.lit(basis).alias("basis"), F.lit(m).alias("measure"), F.col(f"{basis}_{m}").alias("value")) for basis in ("transaction", "disclosure") for m in measures])
    return contexts.select("id", F.explode(pieces).alias("p")).select("id", "p.*")


#: Text repeats its column names and keys in every row, so files are compressed where they are written; readers know it by the name.
COMPRESSION = "gzip"


def write_csv(df: DataFrame, path: str, compression: str = COMPRESSION) -> None:
    flatten(df).write.mode("overwrite").csv(path, header=True, compression=compression)


def write_json(df: DataFrame, path: str, compression: str = COMPRESSION) -> None:
    df.write.mode("overwrite").json(path, compression=compression)


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions that ``df`` holds (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
