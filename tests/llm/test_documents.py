"""Operators on documents against brute force, with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgertide.llm import common, context_tree, decontamination, fingerprints, near_duplicates, quality, queries, repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgäé") for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) rows."""
    base, other = prose(1, 300), prose(2, 220)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base + " extra words at the end"), (5, " ".join(base.split()[:-40])), (6, other), (7, other.replace("a", "b")),
            (8, None), (9, ""), (10, "  \n\t "), (11, "one two"), (12, "One TWO"), (13, "one two three four five"), (14, prose(3, 30_000)), (15, "x" * 3000), (16, "x" * 1200 + "y"),
            (17, "ab" * 700), (18, "Ünï " * 400), (19, prose(4, 90) + other[:700] + prose(5, 80)), (20, other[200:1500] + "é" + prose(6, 50))]
    for i in range(40):  # a group of near copies, each with words of its own
        words = base.split()
        rnd = random.Random(i)
        for _ in range(rnd.randint(1, 12)):
            words[rnd.randrange(len(words))] = f"own{i}"
        rows.append((100 + i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "x", 1.5, [i]) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double, bands array<long>").repartition(3)


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(docs, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert len(got) == len(corpus)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i), i


def test_fingerprint_bands_give_the_same_groups(docs):
    want = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    got = fingerprints.near_groups(docs).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["class_id"] for r in got} == want
    assert fingerprints.near_groups(docs.where("false")).collect() == []


def test_fingerprint_query_tells_the_near_groups(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_minhash_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
    want = {r["doc_id"]: r["class_id"] for r in fingerprints.near_groups(docs).collect()}
    assert all(r["class_id"] == want.get(r["doc_id"]) for r in got) and len(set(want.values())) < len(want)


def test_tiles_find_what_leaders_miss(spark, monkeypatch):
    """A chain in one bucket, whose ends are unlike: all links lie between neighbours, over several tiles."""
    monkeypatch.setattr(near_duplicates, "TILE", 4)
    sets = [(i, list(range(i * 3, i * 3 + 40))) for i in range(30)] + [(99, list(range(500, 540)))]
    frame = spark.createDataFrame(sets, "doc_id long, items array<long>")
    labelled = frame.select(F.lit(5).cast("long").alias("band"), "doc_id", F.col("doc_id").alias("label"))
    links = [tuple(r) for r in near_duplicates.in_tiles(labelled, frame, 0.75).collect()]
    known = {i: set(s) for i, s in sets}
    assert all(100 * len(known[a] & known[b]) >= 75 * len(known[a] | known[b]) for a, b in links)
    root = {i: i for i in known}
    for _ in known:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {root[i] for i in range(30)} == {0} and root[99] == 99


def test_sketch_coordinates_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[250:1250])
    table = near_duplicates.sketches([a, b, pool[:1], np.zeros(0, np.uint64)])
    assert abs((table[0] == table[1]).mean() - 750 / 1250) < 0.1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (table[:3] != full).all() and (table[3] == full).all()


def test_near_duplicates_of_nothing_and_of_rows_without_id(spark):
    schema = "doc_id long, text string"
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = near_duplicates.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (2, 2, True), (3, 2, False), (3, 2, False)]


def covered(texts, least):
    counts = Counter(t[i:i + least] for t in texts.values() for i in range(len(t) - least + 1))
    out = {}
    for key, t in texts.items():
        flags = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if counts[t[i:i + least]] > 1:
                flags[i:i + least] = b"\1" * least
        out[key] = flags
    return out


@pytest.mark.parametrize("least,spread", [(400, None), (100, None), (60, 30)])
def test_repeats_equal_brute_force(docs, corpus, least, spread):
    texts = {i: (t or "").encode() for i, t in corpus if i != 14}
    want = covered(texts, least)
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs.where("doc_id <> 14").select("doc_id", "text", F.lit(0).alias("tag")), least=least, spread=spread).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        kept = bytes(b for b, gone in zip(t, want[i], strict=True) if not gone)
        assert bytes(got[i]["kept"]) == kept and got[i]["n_removed"] == sum(want[i]) and got[i]["n_bytes"] == len(t), i
        assert sum(s["end"] - s["begin"] for s in got[i]["spans"]) == sum(want[i])


def test_repeats_of_repeated_rows_and_whole_characters(spark):
    text = "é" * 300
    frame = spark.createDataFrame([(1, text), (1, text), (None, "z" + text), (None, None)], "doc_id long, text string")
    rows = repeats.without_repeats(frame, whole_characters=True).collect()
    assert sorted(bytes(r["kept"]).decode() for r in rows) == ["", "", "", "z"]
    assert repeats.without_repeats(frame.where("false")).collect() == []


def test_decontamination_equals_brute_force(spark, docs, corpus):
    base, other = words(corpus[0][1]), corpus[5][1]
    items = [(1, other[300:800]), (10, other[300:800]), (2, "one two"), (3, prose(99, 40)), (4, None), (5, "?!"), (None, other), (7, " ".join(base[40:60]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for i, t in items:
        w = re.findall(pattern, (t or "").translate(LOWER))
        if i is not None and w:
            n = min(13, len(w))
            windows += [(i, w[k:k + n]) for k in range(len(w) - n + 1)]
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark, keep=("kept",)).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        w = re.findall(pattern, (t or "").translate(LOWER))
        hit, found = set(), set()
        places = {}
        for p, word in enumerate(w):
            places.setdefault(word, []).append(p)
        for item, window in windows:
            for p in places.get(window[0], ()):
                if w[p:p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found)), i
        assert {p for s in r["hit_spans"] for p in range(s["first"], s["end"])} == hit and r["kept"] == "x"


def test_decontamination_in_blocks(spark, docs, corpus, monkeypatch):
    benchmark = spark.createDataFrame([(i, t[:400]) for i, t in corpus[:7]], "item_id long, text string")
    whole = sorted(map(str, decontamination.contamination(docs, benchmark).collect()))
    made = []
    plain = decontamination.searchers
    monkeypatch.setattr(decontamination, "searchers", lambda rows, window: made.append(sum(len(t) for _, t in rows)) or plain(rows, window))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert sorted(map(str, decontamination.contamination(docs, benchmark).collect())) == whole
    assert len(made) > 3 and max(made) <= 500 + 400  # a block at a time, however many there are
    many = benchmark.union(spark.createDataFrame([(7, t[:400]) for _, t in corpus[:7] if t], "item_id long, text string"))  # one id with most of the text
    made.clear()
    again = {r["doc_id"]: r for r in decontamination.contamination(docs, many).collect()}
    assert max(made) <= 500 + 400 and "7" in again[1]["items"]
    assert all(r["n_hit"] == 0 for r in decontamination.contamination(docs, benchmark.where("false")).collect())


def test_fingerprints_and_edits(docs, corpus):
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == len(corpus)
    order = sorted(corpus)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        one, two = shingles(t), shingles(edited)
        if one and two:
            assert abs(got[i]["near_edited"] - len(one & two) / len(one | two)) < 0.2, i
        assert 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[10]["near_next"] == 0


def test_fingerprints_of_nulls_repeats_and_nothing(spark):
    frame = spark.createDataFrame([(None, "a b c d e f g"), (5, "q r s t u v w x"), (5, "q r s t u v w x")], "doc_id long, text string")
    rows = fingerprints.with_edits(frame).collect()
    assert len(rows) == 3 and len({r["fingerprint"] for r in rows}) == 2
    assert fingerprints.with_edits(frame.where("false")).collect() == []


def weighted_tree(training, depth):
    """Plain context-tree weighting: counts by (context, node), the weighted probability by recursion."""
    counts = {}
    for s in training:
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                context = s[p - d:p]
                for j in range(8):
                    node = (1 << j) | (s[p] >> (8 - j))
                    counts.setdefault((d, context, node), [0, 0])[(s[p] >> (7 - j)) & 1] += 1
    children = {}
    for d, context, node in counts:
        if d:
            children.setdefault((d - 1, context[1:], node), []).append((d, context, node))

    def estimate(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n[0] + n[1] + 1)

    memo = {}

    def whole(key):
        if key not in memo:
            own = estimate(counts[key])
            memo[key] = own if key[0] == depth else np.logaddexp(own, sum(whole(c) for c in children[key])) - math.log(2)
        return memo[key]

    def chance(s, p):
        total = 0.0
        for j in range(8):
            node, bit = (1 << j) | (s[p] >> (8 - j)), (s[p] >> (7 - j)) & 1
            one = 0.5
            for d in range(depth, -1, -1):
                key = (d, s[p - d:p], node)
                n = counts.get(key, [0, 0])
                share = 1.0 if d == depth and key in counts else (math.exp(estimate(n) - whole(key) - math.log(2)) if key in counts else 0.5)
                one = share * (n[1] + 0.5) / (sum(n) + 1) + (1 - share) * one
            total += math.log10(one if bit else 1 - one)
        return total

    return chance


def test_context_tree_equals_plain_recursion(spark):
    texts = [(i, prose(i % 7, 30 + i, 40)) for i in range(24)] + [(50, None), (51, ""), (52, " A b\tC "), (None, "x y"), (53, "a b"), (53, "a b")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, block int").repartition(3)
    held = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    streams = [(i, context_tree.stream(t), i is not None and i % 4 == 0) for i, t in texts]
    chance = weighted_tree([s for _, s, out in streams if not out], context_tree.DEPTH)
    tokens = [(i, (t or "").translate(LOWER).split() + ["<end>"], i is not None and i % 4 == 0) for i, t in texts]
    counts = Counter(w for _, ws, out in tokens if not out for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = context_tree.scored(frame, held).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for (i, s, out), (_, ws, _) in zip(streams, tokens, strict=True):
        r = by[i]
        assert r["score"] == pytest.approx(sum(chance(s, p) for p in range(context_tree.DEPTH, len(s))), rel=1e-5)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), total, out)


def test_context_tree_without_training(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.scored(frame, F.lit(True)).collect()}
    assert got[1]["score"] == pytest.approx(-24 * math.log10(2)) and got[2]["n_known"] == 0
    assert context_tree.scored(frame.where("false"), F.lit(True)).collect() == []


def junk(seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(w + rnd.choice(["%%%", "###", "***"]) for w in prose(seed, 80).split()) if seed % 2 else " ".join([prose(seed, 3).split()[0]] * 90)


def test_quality_rules_on_held_out_rows(spark):
    rows = [(i, junk(i) if i % 5 == 2 else prose(i, 60 + i % 50), "junk" if i % 5 == 2 else "fine") for i in range(500)]
    docs = spark.createDataFrame([*rows, (900, None, ""), (901, "", ""), (902, prose(7, 20_000), "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(k == "fine"), 0) for i, _, k in rows] + [(1, None, 0), (None, 1, 0), (5000, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rules = quality.learn(docs, labels, rows=400)
    assert 0 < len(rules.rules) < 400 and all(name in quality.STATISTICS for rule in rules.rules for name, _, _ in rule)
    got = {r["doc_id"]: r for r in quality.scored(docs.select("doc_id", "text"), rules).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (k == "fine") for i, k in held) >= 0.95 * len(held)


def test_quality_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)]):
        rules = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["predicted"] for r in quality.scored(docs, rules).collect()} == {1}
    assert quality.scored(docs.where("false"), rules).collect() == []


def test_statistics_are_per_row():
    rows = ["A b b. ", None, "", "x\nx\ny,", "é %%"]
    whole = quality.text_statistics(pa.array(rows))
    for i, text in enumerate(rows):
        alone = quality.text_statistics(pa.array([text], pa.string()))
        assert all(alone[s][0] == pytest.approx(whole[s][i]) for s in quality.STATISTICS), text


def test_hash_of_a_span_does_not_depend_on_its_place():
    data = np.frombuffer(b"abcXXabcYabc", np.uint8)
    sums = common.prefix_hash(data)
    keys = common.span_hash(sums, np.array([0, 5, 9, 1]), np.array([3, 8, 12, 4]))
    assert keys[0] == keys[1] == keys[2] != keys[3]


def test_fingerprints_of_ids_of_any_type_and_of_shared_ids(spark):
    a, b = prose(81, 60), prose(82, 60)
    rows = [(1, a), (1, b), (2, b + " one"), (3, None), (4, ""), (None, a), (None, b), (5, a), (5, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["n_chars"], r["class_id"]) for r in fingerprints.with_classes(frame).collect()), key=str)
    marks = {t: fingerprints.fingerprint(fingerprints.signatures(pa.array([t])))[0] for t in (a, b, b + " one", "")}
    classes = {(1, a): 1, (1, b): 1, (2, b + " one"): 1, (3, None): 3, (4, ""): 4, (None, a): None, (None, b): None, (5, a): 1}
    assert got == sorted(((i, marks[t or ""], len(t or ""), classes[i, t]) for i, t in rows), key=str)
    named = frame.selectExpr("concat('d', doc_id) as doc_id", "text")
    texts = sorted(((r["doc_id"], r["fingerprint"], r["n_chars"], r["class_id"]) for r in fingerprints.with_classes(named).collect()), key=str)
    assert texts == sorted(((i and f"d{i}", marks[t or ""], len(t or ""), classes[i, t] and f"d{classes[i, t]}") for i, t in rows), key=str)
    order = [r["edited_sha256"] for r in fingerprints.with_edits(frame).collect()]
    assert sorted(order) == sorted(r["edited_sha256"] for r in fingerprints.with_edits(named).collect()) and len(order) == len(rows)
    days = frame.selectExpr("date_add(date'2024-01-01', cast(doc_id as int)) as doc_id", "text")
    assert sorted(order) == sorted(r["edited_sha256"] for r in fingerprints.with_edits(days).collect())
    assert fingerprints.with_classes(named.where("false")).collect() == []


def test_sifting_keeps_all_that_is_wanted(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(20_000)] + [(None, "n")], "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(0, 20_000, 7)] + [(10**12,)], "doc_id long")
    left = {r["doc_id"] for r in near_duplicates.sifted(texts, wanted).collect()}
    assert set(range(0, 20_000, 7)) <= left and len(left) < 20_000 / 7 + 100
    assert near_duplicates.sifted(texts, wanted.where("false")).collect() == []


def test_buckets_of_equal_members_are_compared_once(spark):
    rows = [(b, d, d) for b in range(30) for d in (1, 2, 3)] + [(b, d, 7) for b in range(30, 40) for d in (4, 5)] + [(40, 1, 1), (40, 2, 2), (41, 1, 1), (41, 3, 3)]
    found = near_duplicates.mixed_buckets(spark.createDataFrame(rows, "band long, doc_id long, label long")).collect()
    assert sorted((r["band"], r["n"]) for r in found) == [(0, 3), (40, 2), (41, 2)]


def test_sets_of_unlike_sizes_are_not_fetched(spark):
    """A pair whose sizes cannot reach the threshold is no candidate; in larger buckets others may, and at the threshold itself a link stays."""
    items = {1: range(3), 2: range(4), 3: range(100), 4: range(5), 5: range(200, 203), 6: range(200, 204), 7: range(200, 300)}
    bands = {10: (1, 2), 11: (2, 3), 12: (3, 4), 13: (5, 6, 7)}
    buckets = spark.createDataFrame([(d, len(items[d]), b) for b, ds in bands.items() for d in ds], "doc_id long, size long, band long")
    asked = []

    def sets_of(members):
        asked.extend(r["doc_id"] for r in members.collect())
        return spark.createDataFrame([(d, list(x)) for d, x in items.items()], "doc_id long, items array<long>").join(members, "doc_id", "left_semi")

    found = {r["node"]: r["label"] for r in near_duplicates.linked(buckets, sets_of, 0.75).collect()}
    assert sorted(asked) == [1, 2, 5, 6, 7]
    assert found == {1: 1, 2: 1, 5: 5, 6: 5, 7: 7}


def test_bands_are_deleted_before_sets_are_fetched(spark, docs, monkeypatch):
    seen, plain = [], near_duplicates.linked

    def watched(buckets, sets_of, *rest, **named):
        def asked(members):
            seen.extend(Path(file.removeprefix("file:")).exists() for file in buckets.inputFiles())
            return sets_of(members)
        return plain(buckets, asked, *rest, **named)

    monkeypatch.setattr(near_duplicates, "linked", watched)
    assert fingerprints.near_groups(docs).count() == docs.count()
    assert seen and not any(seen)


def test_texts_are_shuffled_compressed(spark):
    texts = [prose(3, 900), "", "a", "ünï ☃\x00", prose(4, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = fingerprints.in_order(docs).where("not tail").orderBy("id")
    table = rows.toArrow()
    assert sum(len(x) for x in table["packed"].to_pylist()) < 0.75 * sum(len(x.encode()) for x in texts)
    back = pa.Table.from_batches(fingerprints.unpacked(iter(table.to_batches())))
    assert back["text"].to_pylist() == texts and back["id"].to_pylist() == list(range(5))
