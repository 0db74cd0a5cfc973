"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on labelled documents; each path from a root to a node becomes a rule, a conjunction of
comparisons. A logistic regression with a lasso penalty weighs the rules and sets most weights to zero. What remains is compiled
into one Spark column expression over the statistics, which scores every document.

Statistics come from the text alone (never from ids, language, source or labels). Empty and null texts have statistics of
zero and get a score like any other text. Repeated labels of one id each count; labels without a matching
document or without a value are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

#: Labelled rows that the fit may use; the ones with the smallest hash of their id are taken.
FIT_ROWS = 20_000
TREES, DEPTH = 12, 3
LASSO = 0.001
STATISTICS = ("log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "punctuation", "spaces", "beyond_ascii", "lines_per_word",
              "distinct_words", "same_as_last", "same_pairs", "top_word", "symbol_words", "upper_words", "single_words", "same_lines", "comma_words", "stop_words")

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~!"]] = True
_punctuation = np.zeros(256, bool)
_punctuation[[ord(c) for c in ".,;:?'\"()-"]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_beyond = np.zeros(256, bool)
_beyond[128:] = True
_line = np.ones(256, bool)
_line[10] = False


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _repeats(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its most common one stands there."""
    rows = common.row_of(offsets)
    # 40 bits of the hash below the row's number: one plain sort groups equal values of a row
    key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(key)])
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    n = len(offsets) - 1
    most = np.zeros(n)
    np.maximum.at(most, owner, counts)
    return np.bincount(owner, minlength=n).astype(float), most


def text_statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of every row of an Arrow column."""
    data, offsets = common.buffers(text)
    size = np.diff(offsets).astype(float)
    starts, ends, rows = common.words(data, offsets, ~common.SPACE)
    n = np.diff(rows).astype(float)
    some, chars = np.maximum(n, 1), np.maximum(size, 1)
    length = (ends - starts).astype(float)
    hashes = common.span_hash(common.prefix_hash(common.LOWER[data]), starts, ends)
    distinct, most = _repeats(hashes, rows)
    last = np.zeros(len(hashes), bool)
    last[1:] = hashes[1:] == hashes[:-1]
    last[rows[:-1][np.diff(rows) > 0]] = False
    pairs = hashes.copy()
    pairs[1:] = common.mix(hashes[1:] + common.mix(hashes[:-1]))
    pair_kinds, _ = _repeats(pairs, rows)
    sums = {}
    for name, flags in (("symbol", _symbol), ("upper", _upper)):
        total = np.r_[0, np.cumsum(flags[data])]
        sums[name] = total[ends] - total[starts]
    line_starts, line_ends, line_rows = common.words(data, offsets, _line)
    line_hashes = common.span_hash(common.prefix_hash(data), line_starts, line_ends)
    lines = np.maximum(np.diff(line_rows), 1)
    line_kinds, _ = _repeats(line_hashes, line_rows)
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    return {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "mean_word": _weighted(length, rows) / some, "long_words": _per_row(length > 20, rows) / some,
        "upper": _per_row(_upper[data], offsets) / chars, "digits": _per_row(_digit[data], offsets) / chars, "symbols": _per_row(_symbol[data], offsets) / chars,
        "punctuation": _per_row(_punctuation[data], offsets) / chars, "spaces": _per_row(common.SPACE[data], offsets) / chars, "beyond_ascii": _per_row(_beyond[data], offsets) / chars,
        "lines_per_word": np.diff(line_rows) / some, "distinct_words": distinct / some, "same_as_last": _per_row(last, rows) / some, "same_pairs": pair_kinds / some,
        "top_word": most / some, "symbol_words": _per_row(sums["symbol"] > 0, rows) / some, "upper_words": _per_row(sums["upper"] * 2 > length, rows) / some,
        "single_words": _per_row(length == 1, rows) / some, "same_lines": line_kinds / lines, "comma_words": _per_row(tail == 44, rows) / some,
        "stop_words": _per_row(tail == 46, rows) / some,
    }


def _weighted(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(values)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs``, without the text unless ``keep_text``, and a struct ``stats`` of all statistics."""
    rest = [c for c in docs.columns if c != text_col]
    names = [*rest, text_col] if keep_text else rest
    plain = docs.select(*[F.col(c) for c in rest], F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text"):
            found = text_statistics(batch.column(len(rest)))
            stats = pa.StructArray.from_arrays([pa.array(found[s], pa.float64()) for s in STATISTICS], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], stats], [*names, "stats"])

    kinds = "".join(f"`{name}` {f.dataType.simpleString()}, " for name, f in zip(names, plain.schema.fields, strict=False))
    return plain.mapInArrow(run, kinds + "stats struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">")


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, is_above, cut), their weights, and the weight that all documents get."""
    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: str = "stats") -> Column:
        """Probability of label 1 as one expression."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(condition(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule: tuple[tuple[str, bool, float], ...], stats: str) -> Column:
    whole = F.lit(True)
    for name, above, cut in rule:
        value = F.col(f"{stats}.{name}")
        whole = whole & ((value > cut) if above else (value <= cut))
    return whole


def tree_paths(node, path: tuple = ()) -> Iterator[tuple]:
    """Every path from the root to a node below it, given a Spark tree's root."""
    if path:
        yield path
    if node.numDescendants():
        split = node.split()
        name, cut = STATISTICS[split.featureIndex()], float(split.threshold())
        yield from tree_paths(node.leftChild(), (*path, (name, False, cut)))
        yield from tree_paths(node.rightChild(), (*path, (name, True, cut)))


def fit(labelled: DataFrame, label: str = "label", rows: int = FIT_ROWS) -> Rules:
    """Fit on ``labelled`` (id, stats, label 0 or 1), of which at most ``rows`` are used; without both labels the score is constant."""
    sample = common.stored(labelled.where(F.col(label).isin(0, 1)).select("stats.*", F.col(label).cast("double").alias("label"), F.xxhash64("id").alias("_order")).orderBy("_order", *STATISTICS).limit(rows).repartition(4).drop("_order"))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = counts.get(1.0, 0) / max(sum(counts.values()), 1) if counts else 0.5
        return Rules((), (), float(np.log((share + 0.01) / (1.01 - share))))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample).select("features", "label")
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64, minInstancesPerNode=5, cacheNodeIds=False).fit(vectors)
    rules = sorted({tuple(sorted(path)) for tree in boosted.trees for path in tree_paths(tree._call_java("rootNode"))})
    flags = sample.select("label", F.struct(*STATISTICS).alias("stats")).select("label", *[condition(r, "stats").cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    design = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(design)
    weights = lasso.coefficients.toArray()
    used = [i for i in range(len(rules)) if weights[i] != 0]
    return Rules(tuple(rules[i] for i in used), tuple(float(weights[i]) for i in used), float(lasso.intercept))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", rows: int = FIT_ROWS) -> Rules:
    """Fit on the labelled documents whose crc32 remainder modulo 5 is not 0."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(common.remainder(id_col, 5) != 0)
    # only the labels that the fit uses meet the texts, and they are few by the stated bound
    chosen = known.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return fit(with_statistics(texts), "label", rows)


def scored(docs: DataFrame, rules: Rules, text_col: str = "text", threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with score and predicted, without its text unless ``keep_text``."""
    score = rules.score()
    return with_statistics(docs, text_col, keep_text).withColumn("score", score).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).drop("stats")
