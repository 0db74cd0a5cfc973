"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (a shorter item is one window). Patterns of one
length share a searcher. Its shift table tells, for a hashed block of two words, how far the search may jump because no
pattern can end earlier; where the shift is 0, the hash bucket of the block names the patterns to test, and a direct
comparison of the bytes confirms each. All documents of a slice advance together, one jump per step.

Empty and null texts have no words, no hits and an empty item list. Items without id are left out; repeated items count
once. Rows with equal ids are searched each for itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

WINDOW = 13
#: Bytes of benchmark text that one broadcast block holds (its tables take about a hundred times as much on the driver); a larger benchmark is searched block after block.
BLOCK_BYTES = 2_000_000
TABLE_BITS = 18
#: Word bytes: digits, lower-case letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

SCHEMA = "n_words long, n_hit long, hit_spans array<struct<first:long,end:long>>, items array<string>"


def _blocks_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each place."""
    if size == 1:
        return common.mix(words)
    out = common.mix(words)
    out[1:] = common.mix(words[1:] + common.mix(words[:-1]) * np.uint64(3))
    return out


def _sequence(words: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that end at each of ``ends``."""
    out = np.zeros(len(ends), np.uint64)
    for back in range(length):
        out = common.mix(out + words[ends - back])
    return out


class Searcher:
    """Tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        texts = list(patterns)
        data = np.frombuffer(b"".join(b" ".join(t) + b"\n" for t in texts), dtype=np.uint8)
        sizes = np.fromiter((sum(map(len, t)) + length for t in texts), np.int64, len(texts))
        starts, ends, _ = common.words(data, np.r_[0, np.cumsum(sizes)], WORD)
        hashes = common.span_hash(common.prefix_hash(data), starts, ends)
        blocks = _blocks_of(hashes, self.block)
        most = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, most, np.uint16)
        rows = np.arange(len(texts)) * length
        for place in range(self.block - 1, length):
            at = (blocks[rows + place] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            np.minimum.at(self.shift, at, np.uint16(length - 1 - place))
        last = rows + length - 1
        key = _sequence(hashes, last, length)
        order = np.lexsort((key, blocks[last]))
        self.bucket, self.key = blocks[last][order], key[order]
        self.texts = [b" ".join(texts[i]) for i in order]
        self.items = [patterns[texts[i]] for i in order]

    def find(self, hashes: np.ndarray, offsets: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern number of every occurrence."""
        blocks = _blocks_of(hashes, self.block)
        at, stop = offsets[:-1] + self.length - 1, offsets[1:]
        at, stop = at[at < stop], stop[at < stop]
        tested = []
        while len(at):
            jump = self.shift[(blocks[at] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            tested.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        at = np.concatenate(tested) if tested else np.zeros(0, np.int64)
        low, high = np.searchsorted(self.bucket, blocks[at]), np.searchsorted(self.bucket, blocks[at], side="right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        key = _sequence(hashes, at, self.length)
        ends, numbers = [], []
        for end, k, a, b in zip(at.tolist(), key, low.tolist(), high.tolist(), strict=True):
            i = a + int(np.searchsorted(self.key[a:b], k))
            while i < b and self.key[i] == k:
                if text_of(end - self.length + 1, end) == self.texts[i]:
                    ends.append(end)
                    numbers.append(i)
                i += 1
        return np.array(ends, np.int64), np.array(numbers, np.int64)


def searchers(rows: list[tuple[str, str]], window: int) -> tuple[list[Searcher], list[str]]:
    """Searchers for the items (id, text) of one block, and the items' ids."""
    ids: list[str] = []
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, text in rows:
        data, (starts, ends) = _lowered(text), (None, None)
        starts, ends, _ = common.words(data, np.array([0, len(data)]), WORD)
        if not len(starts):
            continue
        raw = data.tobytes()
        tokens = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        length = min(window, len(tokens))
        for i in range(len(tokens) - length + 1):
            by_length[length][tuple(tokens[i:i + length])].append(len(ids))
        ids.append(item)
    return [Searcher(n, found) for n, found in sorted(by_length.items())], ids


def _lowered(text: str) -> np.ndarray:
    return common.LOWER[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: its words, the words inside an occurrence of any window, the hit spans (word places) and the items found.

    ``keep`` names further columns of ``docs`` that go through unchanged. The benchmark is a stated query set: it is
    read in blocks of about ``BLOCK_BYTES`` of text. Only one block's tables are on the driver and the workers at a time: the documents pass by it with
    what earlier blocks found, and what they found goes on to the next pass as a stored table.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    names = [id_col, *keep]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema.fields)
    rows = docs.select(*[F.col(c) for c in names], F.col(text_col).cast("string").alias("_text"))
    blocks = common.text_blocks(items, BLOCK_BYTES, "id", "text")
    block, again = next(blocks, []), False
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(searchers(block, window))
        found = rows.mapInArrow(_search(shared, names, again, following is not None), f"{kinds}{SCHEMA}" + (", _text string" if following is not None else ""))
        if following is None:
            return found
        rows, block, again = common.stored(found.select(*names, "_text", "hit_spans", "items")), following, True
        shared.destroy()


def _search(shared, names: list[str], again: bool, on: bool):
    """One pass of documents by a block; ``again`` if they come with the spans and items of blocks before, ``on`` if their texts go on to another."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text", 1_000_000):
            raw, offsets = common.buffers(batch.column(batch.schema.get_field_index("_text")))
            data = common.LOWER[raw]
            starts, ends, rows = common.words(data, offsets, WORD)
            hashes = common.span_hash(common.prefix_hash(data), starts, ends)

            def text_of(first: int, last: int) -> bytes:
                return b" ".join(data[a:b].tobytes() for a, b in zip(starts[first:last + 1].tolist(), ends[first:last + 1].tolist(), strict=True))

            edges = np.zeros(len(starts) + 1, np.int64)
            found: list[set[str]] = [set() for _ in range(batch.num_rows)]
            if again:
                spans, known = (batch.column(batch.schema.get_field_index(c)) for c in ("hit_spans", "items"))
                held = np.repeat(rows[:-1], np.diff(spans.offsets.to_numpy()))
                np.add.at(edges, held + spans.flatten().field("first").to_numpy(), 1)
                np.add.at(edges, held + spans.flatten().field("end").to_numpy(), -1)
                found = [set(x) for x in known.to_pylist()]
            engines, ids = shared.value
            for engine in engines:
                last, numbers = engine.find(hashes, rows, text_of)
                np.add.at(edges, last - engine.length + 1, 1)
                np.add.at(edges, last + 1, -1)
                for row, number in zip((np.searchsorted(rows, last, side="right") - 1).tolist(), numbers.tolist(), strict=True):
                    found[row].update(ids[i] for i in engine.items[number])
            hit = np.cumsum(edges)[:-1] > 0
            total_hit = np.r_[0, np.cumsum(hit)]
            first = np.zeros(len(hit) + 1, bool)
            first[rows] = True
            begin = np.flatnonzero(hit & (np.r_[False, ~hit[:-1]] | np.r_[True, np.zeros(max(len(hit) - 1, 0), bool)] | first[:-1])) if len(hit) else np.zeros(0, np.int64)
            finish = np.flatnonzero(hit & (np.r_[~hit[1:], True] | first[1:])) + 1 if len(hit) else np.zeros(0, np.int64)
            at = np.searchsorted(begin, rows)
            base = rows[np.searchsorted(rows, begin, side="right") - 1] if len(begin) else begin
            spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(finish - base, pa.int64())], ["first", "end"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(np.diff(rows), pa.int64()), pa.array(total_hit[rows[1:]] - total_hit[rows[:-1]], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), pa.array([sorted(x) for x in found], pa.list_(pa.string())), *([batch.column(batch.schema.get_field_index("_text"))] if on else [])],
                [*names, "n_words", "n_hit", "hit_spans", "items", *(["_text"] if on else [])])

    return search


def is_contaminated(n_words, n_hit):
    """At least one word in twenty lies inside a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
