"""The corpus pipeline on planted cases: each stage's decision, by the plain rule, on what the stage before kept."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest

import corpus_pipeline
from ledgertide.llm import near_duplicates, segmentations
from tests.llm.test_documents import LOWER, covered, junk, prose, shingles

PASSAGE = prose(1001, 140)
#: An item for each document that holds one: a passage in several documents would go with the repeats.
ITEMS = [prose(1002 + i, 40) for i in range(3)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, junk(i) if i % 6 == 1 else prose(i, 120 + i)) for i in range(240)]
    copies = [(500 + i, rows[6 * i][1]) for i in range(8)] + [(520 + i, rows[6 * i + 2][1] + " one more") for i in range(8)]
    passages = [(600 + i, prose(2000 + i, 150) + " " + PASSAGE + " " + prose(3000 + i, 120)) for i in range(4)]
    dirty = [(700 + i, prose(4000 + i, 60) + " " + ITEMS[i].translate({v: chr(k) for k, v in LOWER.items()}) + " " + prose(5000 + i, 60)) for i in range(3)]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows + copies + passages + dirty] + [(900, None, "en", None, None), (901, rows[3][1], None, "s", 1), (901, rows[3][1], None, "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 1), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*enumerate(ITEMS), (9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = str(tmp_path / name)
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, tables).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = (before, {r["doc_id"]: r for r in rows}, rows)

    before, after, rows = kept["quality"]
    junk_ids = {i for i in range(240) if i % 6 == 1}
    assert len(junk_ids & set(after)) <= 2 and len(set(before) - junk_ids - set(after) - {900}) <= 3 and all(after[i]["text"] == before[i]["text"] for i in after)

    before, after, rows = kept["near_duplicates"]
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    for i in before:
        alike = [j for j in before if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        assert (i in after) == (not alike), i
    assert len(rows) == len(after)

    before, after, _ = kept["repeats"]
    assert set(before) == set(after)
    gone = covered({i: (r["text"] or "").encode() for i, r in before.items()}, corpus_pipeline.LEAST)
    for i, r in after.items():
        text = (before[i]["text"] or "").encode()
        plain = bytes(b for b, out in zip(text, gone[i], strict=True) if not out)
        assert r["text"].encode() == plain or abs(len(r["text"].encode()) - len(plain)) <= 6
        assert r["n_chars"] == len(r["text"]) and PASSAGE[50:-50] not in r["text"]

    before, after, _ = kept["decontamination"]
    assert not {700, 701, 702} & set(after) and set(before) - {700, 701, 702} == set(after)
    windows = [" ".join(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.translate(LOWER))[:13]) for item in ITEMS]
    texts = [" ".join(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].translate(LOWER))) for r in after.values()]
    assert not any(window in text for window in windows for text in texts)

    if Path(segmentations.MODEL).exists():
        last = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
        assert {r["doc_id"] for r in last} == set(after) and all(r["round_trip"] for r in last)
        whole = corpus_pipeline.run(spark, tables).collect()
        assert sorted((r["doc_id"], r["sample"], r["n_pieces"]) for r in whole) == sorted((r["doc_id"], r["sample"], r["n_pieces"]) for r in last)


def test_stages_on_empty_tables_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", "1 as kept", "2 as score", "'x' as items", "3 as parts", "array(1) as spans", "4 as n_hit", "5 as component_id", "6 as stats", "7 as rest")
    some = docs.where("doc_id < 12")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), tables).collect() == [], name
        done = stage(spark, some, tables)
        assert done.columns == docs.columns and done.count() > 5, name


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, prose(i, 80) if i % 3 else prose(0, 80)) for i in range(30)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()}
    assert kept == {i for i in range(30) if i % 3 or not i}


def test_rows_that_share_an_id_stay_for_each_distinct_text(spark):
    """Different texts of one id both stay; equal, near and empty ones are one; links reach the second text of an id too."""
    a, b, c = prose(71, 80), prose(72, 90), prose(73, 100)
    rows = [(5, a), (5, b), (5, a), (5, a + " one more"), (7, b + " one more"), (8, c), (8, b), (9, None), (9, ""), (10, ""), (None, a)]
    frame = spark.createDataFrame([(*r, 1, r[0], {"m": 1}) for r in rows], "doc_id long, text string, tag int, id long, component map<string,int>").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, frame, "")
    assert got.columns == frame.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
    one = next(t for i, t in kept if i == "5" and t != b)
    assert one in (a, a + " one more") and kept == sorted([("5", one), ("5", b), ("8", c), ("9", ""), ("10", ""), ("None", a)])
    found = near_duplicates.near_duplicates(frame).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in found) == sorted(str(x) for x in [
        (5, 5, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (8, 5, False), (9, 9, True), (9, 9, True), (10, 10, True), (None, None, True)])
