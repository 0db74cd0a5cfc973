"""Removal of long repeated passages, by prefix-free parsing of the corpus bytes.

A rolling hash of 16 bytes at every place makes triggers: the trigger of a place is the least hash among the next ``SPREAD``
places (the last one of equal hashes). Triggers depend on the content alone, so equal strings of ``least`` bytes have their triggers
at equal places, and the text falls into phrases of places with one trigger. Cut this way, no phrase's string is a
proper prefix of another's, and the corpus order of two places is that of their phrases' strings, then of what follows.

Only the top of that order matters: two places are equal down to ``least`` bytes, or not. So instead of ordering all
suffixes, the dictionary gives every phrase string (with all it needs to the right: the depth-``least`` prefix of each
of its suffixes) an equality class, by a 128-bit fingerprint, and the parse lists each occurrence once:

1. Phrases whose context (the ``least - spread + 1`` bytes from the trigger, a part of every suffix of theirs) occurs once
   cannot repeat and leave.
2. A phrase string that occurs again repeats as a whole: all its places repeat. This settles all but the edges of repeats.
3. The other phrases with a shared context are the edges. Their distinct strings are fetched once, as dictionary entries; each is cut
   into runs of ``RUN`` places, which are settled in the same two ways.
4. What is left, the runs in which a match begins or ends, gives its suffixes one by one; those found twice repeat.

Everything is an aggregate with counts combined before the shuffle or a join that Spark may split; a string that occurs in
a third of all documents is one dictionary entry.

Empty and null texts have no places. Repeated rows repeat each other (all their covered bytes go). Rows without id, or with one
id, are told apart by a hash of their text; where that is equal too, they are copies and share one decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

LEAST = 400
GRAM = 16
#: Places among which a trigger is the least; the more, the fewer phrases and the longer the edges.
SPREAD = 320
#: Places of a dictionary entry that are settled together.
RUN = 16
#: Bits of a trigger key that hold the place, for texts up to 256 MB; the rest is hash.
PLACE_BITS = 28


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i + width] for every i with a full window: block-wise running minima from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def phrases(data: np.ndarray, sums: tuple[np.ndarray, np.ndarray], begin: int, end: int, least: int, spread: int) -> tuple[np.ndarray, ...]:
    """First place, number of places, places before the trigger, context hash and string hash of every phrase of data[begin:end] (places count from begin)."""
    n = end - begin - least + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = np.arange(begin, begin + n + spread - 1)
    key = common.span_hash(sums[1], grams, grams + GRAM, 1)
    low = np.uint64(2**PLACE_BITS - 1)
    place = (grams - begin).astype(np.uint64) & low
    trigger = low - (sliding_least((key & ~low) | (low - place), spread) & low)
    first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    count = np.diff(np.r_[first, n])
    # the trigger's place, of which PLACE_BITS bits are known, lies at or after the phrase's first place
    at = first + ((trigger[first].astype(np.int64) - first) & int(low)) + begin
    context = common.span_hash(sums[0], at, at + least - spread + 1, 0)
    whole = common.span_hash(sums[1], first + begin, first + begin + count - 1 + least, 1)
    # how the places lie around the trigger is a part of the phrase
    lead = at - begin - first
    whole = common.mix(whole + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first, count, lead, context.view(np.int64), whole.view(np.int64)


def row_key(id_col: str):
    """Tells rows apart, also where ids are null or repeated; rows with equal keys are copies of each other."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64("_text").alias("tag"))


def parsed(docs: DataFrame, least: int, spread: int) -> DataFrame:
    """(key, text) -> one row per phrase: key, first, count, lead, context, whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.buffers(batch.column(1))
            sums = common.prefix_hash(data, 0), common.prefix_hash(data, 1)
            found = [phrases(data, sums, a, b, least, spread) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = [len(f[0]) for f in found]
            columns = [pa.array(np.concatenate([f[i] for f in found]).astype(t)) for i, t in enumerate((np.int32, np.int32, np.int32, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *columns], ["key", "first", "count", "lead", "context", "whole"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, first int, count int, lead int, context long, whole long")


ENTRY = "context long, whole long, times int, first int, count int, lead int"


def _flat(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of a list-of-structs column."""
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    return rows, [flat.field(flat.type.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def entry_strings(texts: DataFrame, least: int) -> DataFrame:
    """(key, text, parts) -> the dictionary: one row per part with its string, the bytes of all its suffixes down to ``least``."""
    names = tuple(x.split()[0] for x in ENTRY.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.buffers(batch.column(1))
            rows, fields = _flat(batch.column(2), names)
            begin = offsets[rows] + fields[3]
            end = begin + fields[4] - 1 + least
            strings = [data[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            columns = [pa.array(f.astype(np.int64 if i < 2 else np.int32)) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns, pa.array(strings, pa.binary())], ["key", *names, "data"])

    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, {ENTRY}, data binary")


def runs(entries: DataFrame, least: int) -> DataFrame:
    """Dictionary entries cut into runs of ``RUN`` places, on a grid that hangs on the trigger: key, entry, times, run, first, count, c2, w2.

    ``c2`` is the part that all suffixes of a full run share, ``w2`` the run's whole string.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "data"):
            data, offsets = common.buffers(batch.column(7))
            sums = common.prefix_hash(data, 0), common.prefix_hash(data, 1)
            context, whole, times, first, count, lead = (batch.column(i).to_numpy().astype(np.int64) for i in range(1, 7))
            # places by their distance before the trigger: lead … lead - count + 1, all of them 0 or more
            high, low = lead // RUN, (lead - count + 1) // RUN
            n = high - low + 1
            row = np.repeat(np.arange(batch.num_rows), n)
            number = high[row] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            near, far = number * RUN, number * RUN + RUN - 1
            start = np.maximum(lead[row] - far, 0)
            stop = np.minimum(lead[row] - near, count[row] - 1)
            base = offsets[row]
            salt = common.mix(context[row].view(np.uint64) + number.astype(np.uint64))
            # the grid's run may reach over the entry's places; what all its suffixes share lies inside in any case
            c2 = common.mix(salt + common.span_hash(sums[0], base + lead[row] - near, base + lead[row] - far + least, 0))
            w2 = common.mix(salt + common.span_hash(sums[1], base + start, base + stop + least, 1) + (stop - start).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(context[row]), pa.array(whole[row]), pa.array(times[row].astype(np.int32)), pa.array(start.astype(np.int32)),
                 pa.array((first[row] + start).astype(np.int32)), pa.array((stop - start + 1).astype(np.int32)), pa.array(c2.view(np.int64)), pa.array(w2.view(np.int64))],
                ["key", "context", "whole", "times", "start", "first", "count", "c2", "w2"])

    return entries.mapInArrow(cut, f"key {entries.schema['key'].dataType.simpleString()}, context long, whole long, times int, start int, first int, count int, c2 long, w2 long")


def suffixes(entries: DataFrame, least: int) -> DataFrame:
    """(key, first, data, parts) -> single places: key, place, h1, h2, times, for the parts' runs (start, count, times) of an entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "data"):
            data, offsets = common.buffers(batch.column(2))
            sums = common.prefix_hash(data, 0), common.prefix_hash(data, 1)
            rows, (start, count, times) = _flat(batch.column(3), ("start", "count", "times"))
            each = np.repeat(np.arange(len(start)), count)
            place = start[each] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = rows[each]
            at = offsets[row] + place
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array((batch.column(1).to_numpy()[row] + place).astype(np.int32)), pa.array(common.span_hash(sums[0], at, at + least, 0).view(np.int64)),
                 pa.array(common.span_hash(sums[1], at, at + least, 1).view(np.int64)), pa.array(times[each].astype(np.int32))],
                ["key", "place", "h1", "h2", "times"])

    return entries.select("key", "first", "data", "parts").mapInArrow(run, f"key {entries.schema['key'].dataType.simpleString()}, place int, h1 long, h2 long, times int")


def merged(first: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by the strings that start at ``count`` places from ``first`` on."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(first[order] + count[order] - 1 + least) if len(first) else first
    new = np.r_[True, begin[1:] > end[:-1]] if len(begin) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return begin[at], end[np.r_[at[1:] - 1, len(begin) - 1]] if len(at) else end


def on_characters(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without the parts of characters at their ends, so that what is left is valid UTF-8."""
    def later(byte: int) -> bool:
        return byte & 0xC0 == 0x80

    begin, end = begin.copy(), end.copy()
    for i in range(len(begin)):
        while begin[i] < end[i] and later(int(text[begin[i]])):
            begin[i] += 1
        while end[i] > begin[i] and end[i] < len(text) and later(int(text[end[i]])):
            end[i] -= 1
    some = end > begin
    return begin[some], end[some]


def repeated_parts(docs: DataFrame, least: int = LEAST, spread: int = SPREAD) -> DataFrame:
    """(key, text) -> key and ``parts``, the runs of places (first, count) whose ``least`` bytes occur elsewhere too."""
    return common.finished(docs.sparkSession, lambda: _parts(docs, least, spread))


def _parts(docs: DataFrame, least: int, spread: int) -> DataFrame:
    places = common.stored(parsed(docs, least, spread))
    one, several, entries = shared_only(places, "context", "whole", F.lit(1), ("key", "first", "count", "lead"))
    settled = settled_of(one, several, entries, "context", "whole")

    edges = entries.select("at.*", F.least("times", F.lit(2)).cast("int").alias("times"), "context", "whole").groupBy("key").agg(
        F.collect_list(F.struct(*[x.split()[0] for x in ENTRY.split(", ")])).alias("parts"))
    dictionary = common.stored(entry_strings(docs.join(edges, "key").select("key", "text", "parts"), least))
    pieces = common.stored(runs(dictionary, least))
    one2, several2, entries2 = shared_only(pieces, "c2", "w2", F.col("times"), ("context", "whole", "start", "count"))
    # an entry that occurs more than once is settled; another one's string has its only place at the entry's
    settled2 = settled_of(one2.where("times = 1"), several2.where("times = 1"), entries2, "c2", "w2")

    wanted = entries2.select("at.*", F.least("times", F.lit(2)).cast("int").alias("times")).groupBy("context", "whole").agg(F.collect_list(F.struct("start", "count", "times")).alias("parts"))
    single = common.stored(suffixes(dictionary.drop("times", "count").join(wanted, ["context", "whole"]), least))
    again = common.stored(single.groupBy("h1", "h2").agg(F.sum("times").alias("n")).where("n > 1").select("h1", "h2"))
    settled3 = single.where("times = 1").join(again, ["h1", "h2"], "left_semi").select("key", F.col("place").alias("first"), F.lit(1).alias("count"))
    return settled.union(settled2).union(settled3).groupBy("key").agg(F.collect_list(F.struct("first", "count")).alias("parts"))


def shared_only(rows: DataFrame, context: str, whole: str, times, at: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose context occurs more than once, those of contexts with one string and those of contexts with several, and the distinct strings of the latter.

    The contexts are stored key tables, so that Spark can split the rows of a frequent one.
    """
    shared = common.stored(rows.groupBy(context).agg(F.sum(times).alias("n"), (F.min(whole) == F.max(whole)).alias("one")).where("n > 1").select(context, "one"))
    one, several = (rows.join(shared.where(which).select(context), context, "left_semi") for which in ("one", "not one"))
    several = common.stored(several)
    entries = common.stored(several.groupBy(context, whole).agg(F.sum(times).alias("times"), F.min(F.struct(*at)).alias("at")))
    return one, several, entries


def settled_of(one: DataFrame, several: DataFrame, entries: DataFrame, context: str, whole: str) -> DataFrame:
    """Runs of places whose whole string occurs again."""
    again = several.join(entries.where("times > 1").select(context, whole), [context, whole], "left_semi")
    return one.select("key", "first", "count").union(again.select("key", "first", "count"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, spread: int | None = None, whole_characters: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and ``kept`` (the remaining bytes), n_bytes, n_removed and spans (begin, end).

    With ``whole_characters``, a character that a run covers in part only stays.
    """
    spread = spread or min(SPREAD, max(1, (least - GRAM) * 5 // 6))
    if least < GRAM + spread:
        raise ValueError("least must be at least GRAM + spread bytes")
    names = [c for c in docs.columns if c != text_col]
    plain = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    plain = plain.select(*[F.col(c) for c in names], F.col("_text"), row_key(id_col).alias("_key"))
    parts = repeated_parts(plain.select(F.col("_key").alias("key"), F.col("_text").alias("text")), least, spread)
    joined = plain.join(parts.withColumnRenamed("key", "_key"), "_key", "left").select(*names, "_text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text"):
            data, offsets = common.buffers(batch.column(len(names)))
            parts = batch.column(len(names) + 1)
            bounds = np.r_[0, np.cumsum(np.diff(parts.offsets.to_numpy()))]
            flat = parts.flatten()
            first, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            kept, spans, removed = [], [], []
            for row in range(batch.num_rows):
                text = data[offsets[row]:offsets[row + 1]]
                begin, end = merged(first[bounds[row]:bounds[row + 1]], count[bounds[row]:bounds[row + 1]], least)
                if whole_characters:
                    begin, end = on_characters(text, begin, end)
                pieces, last = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    pieces.append(text[last:a])
                    last = b
                pieces.append(text[last:])
                kept.append(b"".join(p.tobytes() for p in pieces))
                spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                removed.append(int((end - begin).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                [*names, "kept", "n_bytes", "n_removed", "spans"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema.fields)
    return joined.mapInArrow(run, kinds + "kept binary, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>")
