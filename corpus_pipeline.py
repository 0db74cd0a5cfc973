"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, repeated passages, decontamination, segmentation.

Each stage works on all that the one before kept and returns the columns of its input, but for the last, which returns the
sampled segmentations of every document that is left. Empty inputs go through; rows without id or text are kept unless a stage's own rule
(quality, contamination) rejects their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm import common, decontamination, near_duplicates, quality, repeats, segmentations


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and one struct of all other columns, so that no column of the input meets one of an operator."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("here"), *[F.col(f"`{c}`") for c in others]).alias("rest"))


def unwrapped(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the rule ensemble does not reject; it learns from the labelled rows that are not held out."""
    rules = quality.learn(docs, common.table(spark, sf_dir, "labels"))
    return unwrapped(quality.scored(wrapped(docs), rules, keep_text=True).where("predicted = 1"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near-duplicates. Of rows with one id, one of each group stays."""
    found = near_duplicates.near_duplicates(docs, sets=True)
    again = common.stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    gone = found.where("not kept").join(again, "doc_id", "left_anti").select("doc_id")
    single = docs.join(again, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)

    # rows that share an id find their group by text, and the least text hash of a group stays
    tag = F.sha2(F.coalesce("text", F.lit("")), 256)
    shared = docs.join(again, "doc_id", "left_semi")
    marks = near_duplicates.signatures(shared.select(tag.alias("tag"), "text").dropDuplicates(["tag"]), "tag", "text").select(F.col("doc_id").alias("tag"), "n_shingles", "s1", "s2")
    groups = found.where("kept").join(again, "doc_id", "left_semi").select("doc_id", "n_shingles", "s1", "s2", F.coalesce("component", F.lit(-1)).alias("component")).distinct()
    placed = shared.select("doc_id", tag.alias("tag")).join(marks, "tag").join(groups, ["doc_id", "n_shingles", "s1", "s2"])
    chosen = placed.groupBy("doc_id", "component").agg(F.min("tag").alias("tag")).select(F.col("doc_id").alias("id"), F.col("tag").alias("kept_tag"))
    whole = shared.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), tag.alias("kept_tag")).dropDuplicates(["id", "kept_tag"])
    return single.unionByName(whole.join(chosen, ["id", "kept_tag"], "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


#: Bytes of a repeated passage that this stage removes: fifty words are at least as long, of four bytes each with the blank.
LEAST = 200


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of at least ``LEAST`` bytes that occur more than once out of all texts; the rows stay."""
    done = unwrapped(repeats.without_repeats(wrapped(docs), least=LEAST, whole_characters=True).withColumn("text", F.decode("kept", "utf-8")), docs)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with fewer than one word in twenty inside a benchmark window."""
    found = decontamination.contamination(wrapped(docs), common.table(spark, sf_dir, "benchmark"), keep=("text", "rest"))
    return unwrapped(found.where(~decontamination.is_contaminated(F.col("n_words"), F.col("n_hit"))), docs)


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return segmentations.encoded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("segmentations", segmentation_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's fit and the sampled segmentations have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
