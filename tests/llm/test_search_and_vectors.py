"""Lexical search, vector codes and SimHash groups against brute force, with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgertide.llm import lexical_search, queries, simhash, vector_codes
from tests.llm.test_documents import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts():
    rows = [(i, prose(i, 20 + 7 * i, 150)) for i in range(60)]
    base = rows[5][1]
    rows += [(100 + i, base) for i in range(25)]  # ties
    rows += [(200, None), (201, ""), (202, " \n"), (203, "?!"), (204, "gée " * 900), (205, prose(9, 40_000, 150)), (206, "Ab2 ab2 AB2"), (None, base), (7, base + " more"), (7, base + " more")]
    rows += [(300 + i, " ".join(base.split()[:-1] + [f"w{i}"])) for i in range(20)]  # near copies
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, [i], "x", 2.0) for i, t in texts], "doc_id long, text string, n int, places array<long>, key string, score double").repartition(3)


def bm(texts, items, top):
    found = [(k, i, Counter(TERM.findall((t or "").translate(LOWER)))) for k, (i, t) in enumerate(texts)]
    found = [(k, i, c, sum(c.values())) for k, i, c in found if c]
    n, length = len(found), sum(x[3] for x in found)
    df = Counter(t for x in found for t in x[2])
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, own in wanted.items():
        scores = []
        for _, i, c, size in found:
            m = 10 + 90 * size * n // length
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t]), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(item, rank + 1, i, s) for rank, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, docs, texts):
    items = [(1, texts[5][1][:300]), (2, texts[5][1][300:500]), (2, "AB2, gée"), (3, None), (4, ""), (5, "nowhere"), (6, texts[40][1]), (None, "ab2"), (7, " ".join(t for _, t in texts[:3]))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, doc_id string, rank int")
    want = bm(texts, items, 10)
    assert {w[0] for w in want} == {1, 2, 6, 7, None}
    assert sorted(map(tuple, lexical_search.ranked(docs, frame).collect()), key=str) == want
    stored = lexical_search.common.stored(lexical_search.index(docs))
    few = sorted(map(tuple, lexical_search.search(stored, frame, top=3, block_bytes=200).collect()), key=str)  # many blocks of items
    assert few == bm(texts, items, 3)
    assert lexical_search.ranked(docs.where("false"), frame).collect() == [] and lexical_search.ranked(docs, frame.where("false")).collect() == []
    named = docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("doc_id"), "text")
    as_text = [(a, b, c if c is None else f"d{c:05d}", d) for a, b, c, d in want]
    assert sorted(map(tuple, lexical_search.ranked(named, frame).collect()), key=str) == sorted(as_text, key=str)


def test_bounds_are_never_below_scores(texts):
    """A narrow sketch, where many terms meet in a coordinate, and counts above the largest that it tells apart."""
    column = pa.array([t or "" for _, t in texts])
    block = lexical_search.Block.of([(k, texts[k][1]) for k in (3, 5, 30)] + [(99, "gée ab2")])
    found = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in texts]
    n = np.array([sum(c.values()) for c in found])
    scorer = lexical_search.Scorer(block, np.arange(len(block.first)) + 5, int((n > 0).sum()), int(n.sum()))
    own, _, offsets = lexical_search.terms(column)
    row, place, peak = lexical_search.folded(own, lexical_search.common.row_of(offsets))
    cuts = np.searchsorted(row, np.arange(len(n) + 1))
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (place.astype("<u2"), peak.astype(np.uint8))]
    bounds, impacts = scorer.bounds(*packed, n), scorer.impacts(column, n)
    for item in range(len(block.items)):
        exact = scorer.score(item, impacts)
        assert (bounds[item] >= exact).all() and exact.max() > 0
    assert peak.max() == lexical_search.MOST + 1


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) by comparing every part with every entry."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    width = len(wide[0][1])
    whole = np.array([[math.floor(256 * x) for x in r[1]] for r in wide if len(r[1]) == width])
    step = width // parts
    books = [whole[:entries, p * step:(p + 1) * step].copy() for p in range(parts)]

    def gaps(values, p):
        return ((values[:, None, p * step:(p + 1) * step] - books[p][None]) ** 2).sum(axis=2)

    for _ in range(rounds):
        for p in range(parts):
            code = gaps(whole, p).argmin(axis=1)
            for e in range(len(books[p])):
                if (code == e).any():
                    books[p][e] = whole[code == e, p * step:(p + 1) * step].sum(axis=0) // (code == e).sum()
    out, sums = [], Counter()
    for i, v, label in kept:
        code = error = None
        if len(v) == width:
            one = np.array([[math.floor(256 * x) for x in v]])
            found = [gaps(one, p)[0] for p in range(parts)]
            code, error = "".join(f"{int(g.argmin()):02x}" for g in found), int(sum(g.min() for g in found))
            sums[label] += error
        out.append((i, code, error, label))
    seen = {label for _, c, _, label in out if c}
    return sorted([(i, c, e, sums[label] if label in seen else None) for i, c, e, label in out], key=str), hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def test_vector_codes_equal_brute_force(spark):
    rnd = random.Random(4)
    near = [[rnd.gauss(0, 0.3) for _ in range(32)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.02) for x in near[i % 6]] if i % 3 else [rnd.gauss(0, 1) for _ in range(32)], i % 4) for i in range(400)]
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, 1), (504, [0.1] * 31, 2), (505, [], 9), (None, [0.3] * 32, None), (506, [0.5] * 16, 9)]
    rows += [(7, rows[7][1], 3), (7, rows[8][1], None), (-1, [0.0] * 32, 3), (-2, [0.0] * 32, 3)]
    frame = spark.createDataFrame([(*r, "c", 5, 1.0) for r in rows], "vec_id long, embedding array<double>, label int, code string, of int, error double").repartition(3)
    want, books = plain_codes(rows)
    got = vector_codes.compressed(frame).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == want and {r["codebooks_sha256"] for r in got} == {books}
    few = frame.where("vec_id between 3 and 12")
    want, books = plain_codes([r for r in rows if r[0] and 3 <= r[0] <= 12])  # fewer rows than entries
    got = vector_codes.compressed(few).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == want and got[0]["codebooks_sha256"] == books
    assert vector_codes.compressed(frame.where("false")).collect() == []
    odd = vector_codes.compressed(frame.where("vec_id in (504, 505)")).collect()
    assert sorted(tuple(r)[:4] for r in odd) == [(504, None, None, None), (505, None, None, None)]
    with pytest.raises(Exception, match="after scaling"):
        vector_codes.compressed(frame.select("vec_id", F.transform("embedding", lambda x: x * 1e9).alias("embedding"), "label")).collect()


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_nearest_entry_and_skips_others(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (64, 3)) * [1, 40, 900][seed % 3]  # many ties and equal entries
    points = np.concatenate([rng.integers(-4, 5, (300, 3)) * [1, 40, 900][seed % 3], entries])
    measured = []
    plain = vector_codes.squared
    root = vector_codes.tree(entries)
    monkeypatch.setattr(vector_codes, "squared", lambda a, b: measured.append(len(a) * len(b)) or plain(a, b))
    chosen, best = vector_codes.nearest(root, entries, points)
    gaps = plain(points, entries)
    assert (chosen == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
    assert sum(measured) < 0.8 * len(points) * len(entries)


def simprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(prints, radius=2):
    """Root number of every element by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return [find(x) for x in range(len(prints))]


def test_simhash_groups_equal_brute_force(spark, docs, texts, tmp_path):
    prints = [simprint(t) for _, t in texts]
    roots = closed(prints)
    least = {}
    for (i, _), r in zip(texts, roots):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(texts, prints, roots)), key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_simhash_groups"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == want and len(set(least.values())) < len(want) - 25
    assert simhash.near_groups(docs.where("false")).collect() == []


@pytest.mark.parametrize("tile", [4, 30, 2048])
def test_tiles_lose_no_link(spark, tile):
    """Many fingerprints that share blocks of bits: chains of single flipped bits around a few centres, over many tiles of a bucket."""
    rnd = random.Random(tile)
    prints = {0, 2**64 - 1}
    for _ in range(4):
        at = rnd.getrandbits(64)
        for _ in range(60):
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3])):
                at ^= 1 << b
            prints.add(at)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.compared(simhash.tiled(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 2, tile), 2).collect()
    place = {p: k for k, p in enumerate(signed)}
    root = list(range(len(prints)))
    for _ in prints:
        for a, b in links:
            low = min(root[place[a]], root[place[b]])
            root[place[a]] = root[place[b]] = low
    want = closed(prints)
    assert len({(r, w) for r, w in zip(root, want)}) == len(set(want)) == len(set(root)) and 4 < len(set(want)) < len(prints)


def test_fingerprints_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)  # runs of words that end inside texts
    texts = ["", None, "One", "one  two", "a b c", "A\tB\nc  d", prose(3, 500), " x " * 40, "ünï Ünï"]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [simprint(t) for t in texts]
