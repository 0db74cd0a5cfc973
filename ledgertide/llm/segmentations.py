"""SentencePiece encoding and decoding: k distinct sampled segmentations of each text.

A text's lattice has a node at every character and an edge for every vocabulary piece that matches there; a path is a
segmentation, and its probability the product of its pieces' (Zipf's law over the vocabulary's ranks, with inverse temperature
``alpha``), scaled to sum to one over all paths. Gumbel top-k: give each path its log probability plus Gumbel noise and
the k largest are k paths sampled without replacement. They are found by a perturbed A* search: the best of a region of the
lattice is known before its paths are (a truncated Gumbel around the log of the region's mass), so the search takes the best path from
the top, splits what is left along it, one region at each node for all other edges, and goes on with the region of the largest value. Noise
is a hash of row key, seed, path and place: results do not depend on how rows are dealt to tasks.

``log_prob`` is the log probability, ``perturbed`` its noisy value, and ``log_inclusion`` the log of the chance to be
among the first k given the (k+1)-th value, by which a sample's weight is log_prob - log_inclusion.

Pieces never go on over a blank after other characters, and characters that are no piece become their bytes, so texts fall
into short chunks; the lattices of a slice's distinct chunks are built at once in numpy. The dummy blank in front and exact
decoding of every text are SentencePiece's. A blank piece in the text itself (U+2581) goes as bytes and so comes back.

Empty and null texts have one segmentation, without pieces. A text with fewer than k segmentations gets all it has. Rows with a
null id share the seed of the null; repeated rows get equal samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 1.0
BLANK = "▁"
#: Edge ids from here on stand for a character that goes as bytes.
AS_BYTES = 1 << 24
SLICE = 400_000
SCALE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a SentencePiece model as plain lists: what driver and executors share."""
    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    weights: tuple[float, ...]
    byte_ids: tuple[int, ...]
    byte_weight: float


def vocabulary(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Read a model file. Ranks are by descending score; special pieces are never emitted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    usable = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    usable.sort(key=lambda i: (-model.get_score(i), i))
    norm = float(np.log(np.sum(1 / np.arange(1, len(usable) + 1))))
    weights = [-alpha * (float(np.log(rank)) + norm) for rank in range(1, len(usable) + 1)]
    byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return Vocabulary(tuple(model.id_to_piece(i).replace(BLANK, " ") for i in usable), tuple(usable), tuple(weights), byte_ids, weights[-1])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(common.mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * common.powers(len(codes), 0), out=out[1:])
    return out


def _keys(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` characters from each start: equal for equal strings, wherever they stand."""
    return (sums[starts + size] - sums[starts]) * common.powers(len(sums), 0, True)[starts] * SCALE


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).view(np.int64)


class Pieces:
    """Lookup tables of a vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        # pieces of all lengths in one table by the top bits of a hash: twice (number + 1) of the first piece there, and one more where a longer piece begins with such a string
        self.table = np.zeros(1 << 20, np.int32)
        self.covered = np.zeros(0x110000, bool)
        lengths = np.array([len(p) for p in vocab.pieces])
        self.longest = int(lengths.max())
        keys, rows, begins = [], [], np.zeros(1 << 20, bool)
        for length in sorted(set(lengths.tolist())):
            rows.append(np.flatnonzero(lengths == length))
            codes = _codes("".join(vocab.pieces[r] for r in rows[-1]))
            starts = np.arange(len(rows[-1])) * length
            keys.append(_keys(_sums(codes), starts, length))
            for part in range(1, length):
                begins[_slot(_keys(_sums(codes), starts, part))] = True
            if length == 1:
                self.covered[codes] = True
        self.keys, self.rows = np.concatenate(keys), np.concatenate(rows)
        # the next piece of the same slot, or -1
        self.next = np.full(len(self.keys), -1, np.int64)
        for number, slot in enumerate(_slot(self.keys).tolist()):
            self.next[number] = (self.table[slot] >> 1) - 1
            self.table[slot] = 2 * (number + 1)
        self.table += begins
        self.weights = np.array(vocab.weights)
        self.ids = np.array(vocab.ids, np.int32)
        self.byte_ids = np.array(vocab.byte_ids, np.int32)


class Lattice:
    """Lattices of many chunks. Chunk c has nodes first[c] … last[c]; edges are in the order of their nodes."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, pieces: Pieces):
        n, lengths = len(codes), np.diff(offsets)
        self.first, self.last = offsets[:-1] + np.arange(len(lengths)), offsets[1:] + np.arange(len(lengths))
        nodes = n + len(lengths)
        node = np.arange(n) + common.row_of(offsets)
        sums = _sums(codes)
        found = []
        # strings of a length at all places that a piece of this length or more may begin at
        where, left = np.arange(n), np.repeat(offsets[1:], lengths) - np.arange(n)
        distance, base, scale = left, sums[:-1], common.powers(n + 1, 0, True)[:n] * SCALE
        for size in range(1, pieces.longest + 1):
            if not len(where):
                break
            key = (sums[where + size] - base) * scale
            entry = pieces.table[_slot(key)]
            some = np.flatnonzero(entry > 1)
            number, own = (entry[some] >> 1) - 1, key[some]
            good = pieces.keys[number] == own
            rest = np.flatnonzero(~good)
            while len(rest):
                number[rest] = pieces.next[number[rest]]
                rest = rest[number[rest] >= 0]
                good[rest] = pieces.keys[number[rest]] == own[rest]
                rest = rest[~good[rest]]
            hit = np.flatnonzero(good)
            found.append((node[where[some[hit]]], size, pieces.rows[number[hit]]))
            on = np.flatnonzero((entry & 1).astype(bool) & (left > size))
            where, left, base, scale = where[on], left[on], base[on], scale[on]
        other = np.flatnonzero(~pieces.covered[codes])
        found.append((node[other], 1, AS_BYTES + codes[other].astype(np.int64)))
        counts = np.zeros(nodes, np.int64)
        for source, _, _ in found:
            counts[source] += 1
        self.edge = np.r_[0, np.cumsum(counts)]
        free = self.edge[:-1].copy()
        self.target, self.piece = np.empty(self.edge[-1], np.int64), np.empty(self.edge[-1], np.int64)
        for source, size, piece in found:
            place = free[source]
            free[source] += 1
            self.target[place] = source + size
            self.piece[place] = piece
        coded = self.piece >= AS_BYTES
        self.bare = bool(coded.any())
        known = np.where(coded, 0, self.piece) if self.bare else self.piece
        # ids of the pieces; a character that goes as bytes has none
        weight, self.ids = pieces.weights[known], pieces.ids[known]
        if self.bare:
            weight[coded], self.ids[coded] = pieces.vocab.byte_weight, -1
        # mass of all ways from a node to its chunk's end, from the end backwards
        self.ahead = np.zeros(nodes)
        back = (np.sort((distance.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).view(np.int64)
        s = node[back]
        many = counts[s]
        upto = np.r_[0, np.cumsum(many)]
        edges = np.arange(upto[-1]) + np.repeat(self.edge[s] - upto[:-1], many)
        w, t = weight[edges], self.target[edges]
        log = np.empty(len(w))
        steps = np.r_[0, np.cumsum(np.bincount(distance)[1:])] if n else np.zeros(1, np.int64)
        for x, y in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            if x == y:
                continue
            a, b, size = upto[x], upto[y], many[x:y]
            value = w[a:b] + self.ahead[t[a:b]]
            start = upto[x:y] - a
            top = np.maximum.reduceat(value, start)
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), start))
            self.ahead[s[x:y]] = total
            np.subtract(value, np.repeat(total, size), out=log[a:b])
        self.log = np.empty(len(w))
        self.log[edges] = np.minimum(log, 0.0, out=log)
        self.chance = np.exp(self.log)
        running = np.r_[0.0, np.cumsum(self.chance)]
        self.upto = running[1:] - np.repeat(running[self.edge[:-1]], counts)
        # a node's only way leaves no others
        self.alone = np.zeros(len(w), bool)
        self.alone[self.edge[:-1][counts == 1]] = True

    def others(self, edges: np.ndarray) -> np.ndarray:
        """Log of the chance to leave a node by any but the given edge."""
        return np.where(self.alone[edges], -np.inf, np.log1p(-np.minimum(self.chance[edges], 1 - 1e-15)))

    def walk(self, nodes: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled path from each node to its end: all edges, and n + 1 offsets."""
        found, counts = [], np.zeros(len(nodes), np.int64)
        live = np.flatnonzero(nodes < ends)
        at, stop, key = nodes[live], ends[live], keys[live]
        step = 0
        while len(live):
            u = uniform(key, step)
            # from the last edge, mostly the longest and likeliest, down to the first that reaches u
            least, edge = self.edge[at], self.edge[at + 1] - 1
            on = np.flatnonzero((edge > least) & (u < self.upto[edge - 1]))
            while len(on):
                lower = edge[on] - 1
                edge[on] = lower
                on = on[(lower > least[on]) & (u[on] < self.upto[lower - 1])]
            found.append((live, edge))
            counts[live] += 1
            at = self.target[edge]
            more = np.flatnonzero(at < stop)
            live, at, stop, key = live[more], at[more], stop[more], key[more]
            step += 1
        offsets = np.r_[0, np.cumsum(counts)]
        out = np.empty(offsets[-1], np.int64)
        for step, (live, edge) in enumerate(found):
            out[offsets[live] + step] = edge
        return out, offsets


def uniform(keys: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and salt only; keys are well-mixed already."""
    mixed = common.mix(keys + np.asarray(salt).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def below(mu, bound, u):
    """A Gumbel value around ``mu`` under the condition that it is below ``bound``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.isneginf(mu), -np.inf, np.minimum(mu - np.log(np.exp(np.minimum(mu - bound, 700.0)) - np.log(u)), bound))


@dataclass
class Path:
    """A found segmentation, and the best value of what was split off at each of its nodes."""
    edges: np.ndarray
    chunks: np.ndarray
    before: np.ndarray
    value: float
    split: np.ndarray
    taken: dict[int, list[int]]

    @property
    def log(self) -> float:
        return float(self.before[-1])


def _path(edges: np.ndarray, chunks: np.ndarray, logs: np.ndarray, others: np.ndarray, value: float, key: np.uint64, start: int, k: int) -> Path:
    """``logs`` and ``others`` of the edges, the latter from ``start`` on."""
    before = np.zeros(len(edges) + 1)
    np.cumsum(logs, out=before[1:])
    split = np.full(len(edges), -np.inf)
    if start < len(edges):
        mu = before[start:-1] + others
        # uniform() has 53 bits, so noise lies between -3.7 and 36.8: what is 42 below the (k + 1)-th is never among the first k + 1
        least = np.partition(mu, -k - 1)[-k - 1] - 42 if len(mu) > k else -np.inf
        some = np.flatnonzero(mu >= least)
        split[start + some] = below(mu[some], value, uniform(key, start + some))
    return Path(edges, chunks, before, value, split, {})


def sampled(texts: list[str | None], seeds: np.ndarray, pieces: Pieces, k: int) -> list[tuple[Lattice, list[Path], float]]:
    """For each text its lattice, up to k paths in falling order, and the value of the next."""
    marked = [" " + t if t else "" for t in texts]
    codes = _codes("".join(marked))
    offsets = np.r_[0, np.cumsum([len(t) for t in marked])].astype(np.int64)
    inside = np.zeros(len(codes) + 1, bool)
    inside[offsets] = True
    start = inside[:-1].copy()
    blank, bare = codes == 32, ~pieces.covered[codes]
    start[1:] |= (blank[1:] & ~blank[:-1]) | bare[1:] | bare[:-1]
    begin = np.flatnonzero(start)
    end = np.r_[begin[1:], len(codes)].astype(np.int64)
    keys = common.span_hash(_sums(codes), begin, end)
    _, example, kind = np.unique(keys, return_index=True, return_inverse=True)
    sizes = (end - begin)[example]
    spans = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    place = np.repeat(begin[example], sizes) + np.arange(spans[-1]) - np.repeat(spans[:-1], sizes)
    lattice = Lattice(codes[place], spans, pieces)
    chunks = np.searchsorted(begin, offsets)
    row = common.row_of(chunks)
    seeds = common.mix(seeds)
    own = common.mix(seeds[row] + np.arange(len(begin), dtype=np.uint64) - chunks[:-1][row].astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)
    heads, tails = lattice.first[kind], lattice.last[kind]

    edges, ends = lattice.walk(heads, tails, own)
    chunk_of = common.row_of(ends)
    gumbel = -np.log(-np.log(uniform(seeds, 0)))
    noise = common.mix(seeds + np.uint64(1))
    logs, others = lattice.log[edges], lattice.others(edges)
    paths: list[list[Path]] = []
    for i in range(len(texts)):
        a, b = ends[chunks[i]], ends[chunks[i + 1]]
        paths.append([_path(edges[a:b], chunk_of[a:b], logs[a:b], others[a:b], float(gumbel[i]), noise[i], 0, k)])

    for turn in range(1, k):
        jobs, nodes, stops, salts = [], [], [], []
        salt = common.mix(seeds + np.uint64(1000 + turn))
        first, second, noise = uniform(salt, 0), uniform(salt, 1), common.mix(salt + np.uint64(2))
        fresh = common.mix(own + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        for i, known in enumerate(paths):
            if len(known) < turn:
                continue
            peaks = [int(np.argmax(p.split)) if len(p.split) else -1 for p in known]
            best = max(range(len(known)), key=lambda m: known[m].split[peaks[m]] if peaks[m] >= 0 else -np.inf)
            at, path = peaks[best], known[best]
            if at < 0 or np.isneginf(path.split[at]):
                continue
            edge, value = path.edges[at], float(path.split[at])
            # the other edges of this node, without those that paths have gone already
            node = int(lattice.target[path.edges[at - 1]]) if at and path.chunks[at - 1] == path.chunks[at] else int(heads[path.chunks[at]])
            gone = path.taken.setdefault(at, [int(edge)])
            free = [e for e in range(int(lattice.edge[node]), int(lattice.edge[node + 1])) if e not in gone]
            weights = np.cumsum(lattice.chance[free])
            pick = free[min(int(np.searchsorted(weights, float(first[i]) * weights[-1], side="right")), len(free) - 1)]
            gone.append(pick)
            left = float(weights[-1] - lattice.chance[pick]) if len(free) > 1 else 0.0
            path.split[at] = below(path.before[at] + np.log(left), value, float(second[i])) if left > 0 else -np.inf
            chunk, after = int(path.chunks[at]), int(chunks[i + 1])
            jobs.append((i, path, at, pick, value))
            nodes += [lattice.target[pick:pick + 1], heads[chunk + 1:after]]
            stops.append(tails[chunk:after])
            salts.append(fresh[chunk:after])
        if not jobs:
            break
        edges, ends = lattice.walk(np.concatenate(nodes), np.concatenate(stops), np.concatenate(salts))
        logs, others, part_of = lattice.log[edges], lattice.others(edges), common.row_of(ends)
        base = 0
        for (i, path, at, pick, value), part in zip(jobs, stops, strict=True):
            a, b = ends[base], ends[base + len(part)]
            chunk = path.chunks[at:at + 1]
            paths[i].append(_path(
                np.concatenate([path.edges[:at], [pick], edges[a:b]]), np.concatenate([path.chunks[:at], chunk, part_of[a:b] + (chunk - base)]),
                np.concatenate([lattice.log[path.edges[:at]], lattice.log[pick:pick + 1], logs[a:b]]), others[a:b], value, noise[i], at + 1, k))
            base += len(part)
    return [(lattice, known, max((float(p.split.max()) for p in known if len(p.split)), default=-np.inf) if len(known) == k else -np.inf) for known in paths]


def piece_ids(lattice: Lattice, edges: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Ids of a path's pieces; a character that is no piece gives its bytes."""
    out = lattice.ids[edges]
    bare = np.flatnonzero(out < 0) if lattice.bare else ()
    if not len(bare):
        return out
    chosen = lattice.piece[edges]
    coded = [chr(int(c) - AS_BYTES).encode("utf-8") for c in chosen[bare]]
    sizes = np.ones(len(chosen), np.int64)
    sizes[bare] = [len(c) for c in coded]
    out = np.repeat(out, sizes)
    out[np.repeat(chosen >= AS_BYTES, sizes)] = pieces.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
    return out


def log_inclusion(log: float, next_value: float) -> float:
    """Log of the chance that a path of log probability ``log`` comes out above ``next_value``."""
    if np.isneginf(next_value):
        return 0.0
    gap = log - next_value
    return float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else float(gap)


class Decoder:
    """Text of piece ids: pieces joined, bytes put together, the dummy blank taken away. Ids that stand for nothing give nothing."""

    def __init__(self, vocab: Vocabulary):
        strings = {i: p.encode("utf-8") for i, p in zip(vocab.ids, vocab.pieces, strict=True)} | {i: bytes([b]) for b, i in enumerate(vocab.byte_ids)}
        every = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.flat = np.frombuffer(b"".join(every), np.uint8)
        self.sizes = np.array([len(x) for x in every], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def text(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        place = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.flat[place].tobytes().decode("utf-8", "replace")[1:]


_loaded: dict[int, tuple[Pieces, Decoder]] = {}


def _tables(shared) -> tuple[Pieces, Decoder]:
    """The tables of a broadcast vocabulary, made once in a worker."""
    if shared.value.pieces and id(shared.value) not in _loaded:
        _loaded.clear()
        _loaded[id(shared.value)] = Pieces(shared.value), Decoder(shared.value)
    return _loaded[id(shared.value)]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = 0, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """Up to k rows per document: doc_id, sample (from 1), n_pieces, ids, log_prob, perturbed, log_inclusion, and whether decoding gives the text back."""
    vocab = vocabulary(model, alpha)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("seed"))
    names = ["doc_id", "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, decoder = _tables(shared)
        for batch in common.slices(batches, "text", SLICE):
            texts = batch.column(1).to_pylist()
            rows, samples, ids, logs, values, chances, same = [], [], [], [], [], [], []
            for i, (lattice, paths, after) in enumerate(sampled(texts, batch.column(2).to_numpy().view(np.uint64), pieces, k)):
                for rank, path in enumerate(paths):
                    rows.append(i)
                    samples.append(rank + 1)
                    ids.append(piece_ids(lattice, path.edges, pieces))
                    logs.append(path.log)
                    values.append(path.value + 0.0)
                    chances.append(log_inclusion(path.log, after))
                    same.append(decoder.text(ids[-1]) == (texts[i] or ""))
            sizes = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(samples, pa.int32()), pa.array(sizes), common.lists(np.concatenate(ids), np.r_[0, np.cumsum(sizes)], pa.int32()),
                 pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(chances, pa.float64()), pa.array(same)], names)

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, sample int, n_pieces long, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean")


def decoded(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of the ids; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(model))
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tables(shared)
        for batch in batches:
            texts = [None if x is None else decoder.text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", decoded string")
