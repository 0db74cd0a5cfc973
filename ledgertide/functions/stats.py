"""Distribution statistics: bounded groups as arrays, groups of any size as distributed ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.session import checkpoint

# Two-sided 95% normal quantile (fixed value).
Z95 = 1.959963984540054


def wilson(up: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a share; NULL for n = 0, exact 0 and 1 at the ends."""
    up, count = up.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = up / count
    denominator = 1 + z * z / count
    center = (p + z * z / (2 * count)) / denominator
    half = z * F.sqrt(p * (1 - p) / count + z * z / (4 * count * count)) / denominator
    low = F.when(up == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), center - half))
    high = F.when(up == count, F.lit(1.0)).otherwise(F.least(F.lit(1.0), center + half))
    present = count.isNotNull()
    return F.when(present, low), F.when(present, high)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL when whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def sorted_values(value: Column) -> Column:
    """Aggregate: the non-null values of a bounded group in ascending order."""
    return F.sort_array(F.collect_list(value))


def quantile_of(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array; NULL for an empty one."""
    n = F.size(values)
    position = (n - 1) * F.lit(q)
    low = F.floor(position).cast("int")
    left = F.get(values, low)
    right = F.get(values, F.least(low + 1, n - 1))
    return F.when(n > 0, left + (position - low) * (right - left))


def box_columns(values: Column) -> dict[str, Column]:
    """All distribution figures of one sorted array of a bounded group."""
    n = F.size(values)
    q25, q75 = quantile_of(values, 0.25), quantile_of(values, 0.75)
    reach = 1.5 * (q75 - q25)
    low = F.array_min(F.filter(values, lambda v: (v >= q25 - reach) & (v <= q75 + reach)))
    high = F.array_max(F.filter(values, lambda v: (v >= q25 - reach) & (v <= q75 + reach)))
    up = F.size(F.filter(values, lambda v: v > 0))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return {
        "n": n.cast("long"), "min": F.array_min(values), "q25": q25, "median": quantile_of(values, 0.5),
        "mean": ratio(total, n), "q75": q75, "max": F.array_max(values), "up": up.cast("long"),
        "flat": F.size(F.filter(values, lambda v: v == 0)).cast("long"), "up_ratio": ratio(up, n),
        "whisker_low": low, "whisker_high": high,
        "outliers": F.filter(values, lambda v: (v < low) | (v > high)),
    }


def bounded_distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distribution per group when a group is bounded by the calendar (years, sessions)."""
    grouped = df.groupBy(*keys).agg(sorted_values(F.col(value).cast("double")).alias("_v"))
    return grouped.select(*keys, *[c.alias(name) for name, c in box_columns(F.col("_v")).items()])


# --- groups of any size -----------------------------------------------------------

#: Buckets of a doubling of the value: a bucket is 0.02 % of its value wide.
BUCKETS = 4096
#: More doublings than a double has.
_DOUBLINGS = 1100
#: Buckets of a doubling of a tie: wide enough that counting them leaves few rows, narrow enough that a hot value is spread.
TIE_BUCKETS = 64
#: Copies of a group's one row where rows meet it by the group alone.
SALTS = 16


def bucket_of(value: Column) -> Column:
    """A bucket number that grows with the value, the same for every group, so that rows need no facts of their group to find it.

    The logarithm of a double never falls where the value rises, nor does anything made of it here.
    """
    size = F.least(F.abs(value), F.lit(1.7976931348623157e308))
    level = (F.floor(F.log2(size) * BUCKETS) + _DOUBLINGS * BUCKETS).cast("int")
    return F.when(F.isnan(value), 2 * _DOUBLINGS * BUCKETS).when(value > 0, level).when(value < 0, -level).otherwise(0)


def _counted(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, _v, _k): equal values of a group counted once, checkpointed. A row counts as often as its ``weight`` says.

    Everything below reads this one table several times. The checkpoint makes sure that the input is
    evaluated once, keeps the plans small and survives lost executors. A hot group is spread over
    tasks by its values. Keys must not be NULL.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_w"))
    return checkpoint(rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_k")))


def _summary(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: exact n, mean, extremes, up and flat."""
    v, k = F.col("_v"), F.col("_k")
    return counted.groupBy(*keys).agg(
        F.sum(k).alias("n"), (F.sum(v * k) / F.sum(k)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.sum(F.when(v > 0, k)), F.lit(0)).alias("up"), F.coalesce(F.sum(F.when(v == 0, k)), F.lit(0)).alias("flat"))


def describe(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (0.25, 0.5, 0.75), weight: str | None = None) -> DataFrame:
    """n, mean, min, max, up, flat and exact interpolated quantiles (q25, q50, ...) of groups of any size.

    Quantiles need no gathered group: values are counted in buckets, running counts over a group's buckets give those that
    hold the wanted ranks, and only the values of these are ordered. Rows meet on (group, bucket), so a group with most of the rows is spread.
    """
    keys = list(keys)
    return _describe_counted(_counted(df, keys, value, weight), keys, probs)


def _describe_counted(counted: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    placed = counted.withColumn("_b", bucket_of(F.col("_v")))
    across = Window.partitionBy(*keys)
    histogram = placed.groupBy(*keys, "_b").agg(F.sum("_k").alias("_bk")).select(
        *keys, "_b", "_bk", F.sum("_bk").over(across.orderBy("_b")).alias("_end"), F.sum("_bk").over(across).alias("n")).withColumn("_start", F.col("_end") - F.col("_bk"))
    last = F.col("n") - 1
    ranks = F.array_distinct(F.array(*[rank for q in probs for rank in (
        F.floor(last * F.lit(q)), F.least(F.floor(last * F.lit(q)) + 1, last))]))
    targets = histogram.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_end")))).where(
        F.size("_ranks") > 0).select(*keys, "_b", "_start", "_ranks")
    v = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = placed.join(targets, [*keys, "_b"]).withColumn("_hi", F.col("_start") + F.sum("_k").over(v)).withColumn(
        "_lo", F.col("_hi") - F.col("_k"))
    hits = ranked.select(*keys, "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))).alias("_r"))
    # At most two ranks per wanted quantile reach this aggregate.
    found = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))
    result = _summary(counted, keys).join(found, keys)
    columns = []
    for q in probs:
        position = last * F.lit(q)
        low = F.floor(position)
        left, right = F.element_at("_m", low), F.element_at("_m", F.least(low + 1, last))
        columns.append((left + (position - low) * (right - left)).alias(f"q{round(q * 100):02d}"))
    return result.select(*keys, "n", "mean", "min", "max", "up", "flat", *columns)


def distributed_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                          probs: Sequence[float] = (0.25, 0.5, 0.75), weight: str | None = None) -> DataFrame:
    return describe(df, keys, value, probs, weight).drop("n", "mean", "min", "max", "up", "flat")


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, q25, median, q75, mean, max, up, flat, up_ratio and whiskers for groups of any size."""
    keys = list(keys)
    counted = _counted(df, keys, value)
    full = checkpoint(_describe_counted(counted, keys, (0.25, 0.5, 0.75))).withColumnRenamed("q50", "median").withColumn("up_ratio", ratio(F.col("up"), F.col("n")))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    fences = full.select(*keys, (F.col("q25") - reach).alias("_f_lo"), (F.col("q75") + reach).alias("_f_hi"))
    # whole buckets within the fences give their extremes; only the buckets that a fence cuts are looked into
    placed = counted.withColumn("_b", bucket_of(F.col("_v")))
    buckets = placed.groupBy(*keys, "_b").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")).join(fences, keys)
    lowest, highest = F.col("_low") >= F.col("_f_lo"), F.col("_high") <= F.col("_f_hi")
    whole = buckets.where(lowest & highest).select(*keys, "_low", "_high")
    cut = buckets.where(~(lowest & highest) & (F.col("_high") >= F.col("_f_lo")) & (F.col("_low") <= F.col("_f_hi"))).select(*keys, "_b", "_f_lo", "_f_hi")
    inner = placed.join(cut, [*keys, "_b"]).where(F.col("_v").between(F.col("_f_lo"), F.col("_f_hi"))).select(*keys, F.col("_v").alias("_low"), F.col("_v").alias("_high"))
    whiskers = whole.unionByName(inner).groupBy(*keys).agg(F.min("_low").alias("whisker_low"), F.max("_high").alias("whisker_high"))
    return full.join(whiskers, keys, "left")


def outliers(df: DataFrame, keys: Sequence[str], value: str, boxes: DataFrame) -> DataFrame:
    """The rows of ``df`` beyond the whiskers of their group, one row each (never a list).

    Rows meet their group's fences in one of ``SALTS`` copies, by a hash of the value.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    fences = boxes.select(*keys, F.col("whisker_low").alias("_lo"), F.col("whisker_high").alias("_hi"), copies)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    return salted.join(fences, [*keys, "_salt"]).where((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).drop("_lo", "_hi", "_salt")


def comparison(df: DataFrame, symbol: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, positives, and the best and worst symbol; the first in symbol order leads a tie."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("positive"),
        F.max(value).alias("high"), F.min_by(symbol, F.struct(-F.col(value), F.col(symbol))).alias("high_ticker"),
        F.min(value).alias("low"), F.max_by(symbol, F.struct(-F.col(value), F.col(symbol))).alias("low_ticker"))


def endpoint_change(first: Column, last: Column) -> Column:
    """last / first − 1; NULL when either end is missing or the start is 0."""
    return last / F.nullif(first, F.lit(0).cast("double")) - 1


def max_drawdown(df: DataFrame, keys: Sequence[str], order: str, price: str) -> DataFrame:
    """Largest peak-to-later-trough fall per series; NULL when any price of the series is missing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peaked = df.select(*keys, order, price, F.max(price).over(w).alias("running_peak"))
    return peaked.groupBy(*keys).agg(
        F.when(F.bool_or(F.col(price).isNull()), F.lit(None).cast("double"))
        .otherwise(F.max(1 - F.col(price) / F.col("running_peak"))).alias("max_drawdown"))


def distributed_ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Ordinal ranks by (value, tie) in both directions, without ordering a group of any size in one task.

    rank_asc = rows with a smaller value + rank among equals, rank_desc = rows with a larger value +
    rank among equals (equal values keep ``tie`` order both ways). The counts come from value buckets,
    the rank among equals from buckets of the numeric ``tie``. Returns keys, value, tie and the ranks;
    (keys, tie) identifies a row.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(tie).cast("long").alias("_t"))
    rows = checkpoint(rows)
    counted = checkpoint(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_k"), F.min("_t").alias("_t")).withColumn("_b", bucket_of(F.col("_v"))))
    group = Window.partitionBy(*keys)
    totals = counted.groupBy(*keys, "_b").agg(F.sum("_k").alias("_bk")).select(
        *keys, "_b", (F.sum("_bk").over(group.orderBy("_b")) - F.col("_bk")).alias("_before"), F.sum("_bk").over(group).alias("n"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    offsets = counted.join(totals, [*keys, "_b"]).select(*keys, "_v", "_k", "_t", "n", (F.col("_before") + F.sum("_k").over(inside) - F.col("_k")).alias("_smaller"))
    # A value that occurs once needs no ordering among equals; the rows of a repeated one meet by (group, value, bucket of the tie).
    repeated = rows.withColumn("_tb", F.floor(bucket_of(F.col("_t").cast("double")) / (BUCKETS // TIE_BUCKETS)).cast("int"))
    counts = repeated.groupBy(*keys, "_v", "_tb").agg(F.count("*").alias("_tk")).select(
        *keys, "_v", "_tb", (F.sum("_tk").over(Window.partitionBy(*keys, "_v").orderBy("_tb")) - F.col("_tk")).alias("_tbefore"))
    counts = counts.join(offsets.where("_k > 1").drop("_t"), [*keys, "_v"])
    within = Window.partitionBy(*keys, "_v", "_tb").orderBy("_t")
    equal = repeated.join(counts, [*keys, "_v", "_tb"]).withColumn("_e", F.col("_tbefore") + F.row_number().over(within))
    single = offsets.where("_k = 1").withColumn("_e", F.lit(1).cast("long"))
    names = [*keys, "_v", "_t", "_k", "n", "_smaller", "_e"]
    ranked = single.select(*names).unionByName(equal.select(*names))
    return ranked.select(*keys, F.col("_v").alias(value), F.col("_t").alias(tie),
                         (F.col("_smaller") + F.col("_e")).cast("long").alias("rank_asc"),
                         (F.col("n") - F.col("_smaller") - F.col("_k") + F.col("_e")).cast("long").alias("rank_desc"))
