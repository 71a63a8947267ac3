"""SentencePiece encoding by sampling, and decoding (operator 6).

Forward-filtering backward-sampling over the piece lattice.  Forward, every end of
every piece in a unit (a word with its space, a line break, a character the
vocabulary lacks) gets the total weight of all segmentations up to it; backward, from
the end of the unit, the last piece is drawn in proportion to the weight of
what it completes, then the one before it, and so on.  The result is one draw
from P(segmentation) in proportion to the product of its pieces' weights.

Pieces never reach over a space, so units are independent.  The forward weights of a
slice's units are computed together, a character a step; those of a unit seen in
an earlier slice, too, are kept for later ones (in a store of bounded size), those of
units seen once are dropped with the slice.  The backward draws of all units of a slice
run as one array operation per step.  Draws depend on the row key, the unit's place in
the text and the step only (a hash of the three on a grid of 2**24), so any run, order
or partitioning gives the same segmentation.

The vocabulary file ranks its pieces without probabilities; a piece weighs
``1 / (rank + 10) ** TEMPERATURE`` (Zipf).  Characters without a piece become byte
pieces.  Decoding joins the pieces' bytes and takes off the one space put in front,
so it gives back every text exactly.

Defined results: a null text is an empty one (no piece); a null row key counts as
the empty string; repeated rows get the same pieces; an empty table gives an empty
result.  Only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LlmQuery, table

TEMPERATURE = 0.7
SPACE = "▁"
GRID = 24
MAX_NODES = 3_000_000
MAX_SEEN = 1_000_000
_UNIT = re.compile(r" ?[^ \n]+|\n| ")
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 20
_CHUNK = 200_000
_LEARN_CHARS = 150_000
_SEVERAL = -1


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Vocabulary, the store of forward weights, encoding and decoding."""

    def __init__(self, path: str, temperature: float = TEMPERATURE) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes_of = [b""] * n
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.vocabulary = {}
        for rank, i in enumerate(plain):
            piece = sp.id_to_piece(i)
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
            self.vocabulary[piece] = (i, (rank + 10.0) ** -temperature)
        self.longest = max(map(len, self.vocabulary))
        # A blank may stand in front of a unit; SPACE itself is no character of a text.
        self.known = {c for c in self.vocabulary if len(c) == 1} - {SPACE} | {" "}
        self._index()
        self._clear()

    def _index(self) -> None:
        """A table from hash slots to all endings of pieces, for lookups of whole arrays;
        a string that is no piece's ending is no longer piece's ending either."""
        powers = [pow(_BASE, n, 1 << 64) for n in range(self.longest)]
        endings: dict[int, tuple[int, float]] = {}
        for piece, known in self.vocabulary.items():
            h = 0
            for n, c in enumerate(reversed(piece)):
                h = (h + (ord(c) + 1) * powers[n]) % (1 << 64)
                endings.setdefault(h, (-1, 0.0))
            endings[h] = known
        self._ids = np.array([i for i, _ in endings.values()], dtype=np.int32)
        self._weights = np.array([w for _, w in endings.values()])
        self._hash = _mixed(np.array(list(endings), dtype=np.uint64))
        slot = (self._hash >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self._first, self._next = np.full(1 << _SLOTS, -1, dtype=np.int32), np.full(len(slot), -1, dtype=np.int32)
        for k, at in enumerate(slot.tolist()):
            self._next[k], self._first[at] = self._first[at], k

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Table entries of hashed strings, -1 where there is none."""
        hashes = _mixed(hashes)
        at = self._first[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        wrong = np.flatnonzero((at >= 0) & (self._hash[at] != hashes))
        while len(wrong):
            at[wrong] = self._next[at[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self._hash[at[wrong]] != hashes[wrong])]
        return at

    def _clear(self) -> None:
        self.units: dict[str, int] = {}  # text -> end node, _SEVERAL for a unit in parts
        self.parts: dict[str, list[int]] = {}  # such a unit's parts' end nodes
        self.seen: set[str] = set()  # units of earlier slices that are not kept
        self.nodes = self.edges = 0
        # Edges in the order of their end nodes: cumulative share on the grid, piece, length.
        self.cumulative, self.piece, self.length = (np.empty(1 << 16, np.int32) for _ in range(3))
        # A node's first edge (a start has none) and its part's start.
        self.first_edge, self.start_of = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _store(self, sizes: np.ndarray, counts: np.ndarray, cumulative: np.ndarray, piece: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Adds lattices of parts of ``sizes`` characters with ``counts`` edges each node
        (0 at starts); their end nodes."""
        e, n = self.edges + len(piece), self.nodes + len(counts)
        while e > len(self.piece):
            self.cumulative, self.piece, self.length = (np.concatenate([a, np.empty_like(a)]) for a in (self.cumulative, self.piece, self.length))
        while n > len(self.start_of):
            self.first_edge, self.start_of = (np.concatenate([a, np.empty_like(a)]) for a in (self.first_edge, self.start_of))
        self.cumulative[self.edges : e], self.piece[self.edges : e], self.length[self.edges : e] = cumulative, piece, length
        self.first_edge[self.nodes : n] = self.edges + np.cumsum(counts) - counts
        ends = self.nodes + np.cumsum(sizes + 1) - 1
        self.start_of[self.nodes : n] = np.repeat(ends - sizes, sizes + 1)
        self.nodes, self.edges = n, e
        return ends

    def _forward(self, parts: list[str]) -> np.ndarray:
        """Stores the lattices of parts (longest first) that are all made of known
        characters; their end nodes.  All of them move on together, one character a step;
        those still under way stand in front."""
        code = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(code)) - np.repeat(first, sizes)
        part = np.repeat(np.arange(len(parts)), sizes)
        # Edges: a piece of n characters that ends at a character.
        here, h, power, found = np.arange(len(code)), np.zeros(len(code), dtype=np.uint64), 1, []
        for n in range(1, self.longest + 1):
            fits = place[here] >= n - 1
            here, h = here[fits], h[fits]
            h = h + code[here - n + 1] * np.uint64(power)
            entry = self._lookup(h)
            here, h, entry = here[entry >= 0], h[entry >= 0], entry[entry >= 0]
            hit = self._ids[entry] >= 0
            found.append((here[hit], np.full(int(hit.sum()), n), entry[hit]))
            power = power * _BASE % (1 << 64)
            if not len(here):
                break
        end, length, entry = (np.concatenate(x) for x in zip(*found, strict=True))
        by_step = np.lexsort((length, end, place[end]))
        end, length, entry = end[by_step], length[by_step], entry[by_step]
        base = first + np.arange(len(parts))
        node = end + part[end]  # place 0's node is the start
        weight, begin = self._weights[entry], node + 1 - length
        total = np.ones(len(code) + len(parts))
        share = np.empty(len(end))
        steps = np.searchsorted(place[end], np.arange(int(sizes[0]) + 1))
        edges = np.bincount(end, minlength=len(code))
        longest = min(self.longest, int(sizes[0]))
        for j in range(1, int(sizes[0]) + 1):
            on = int(np.searchsorted(-sizes, -j, side="right"))
            a, b = steps[j - 1], steps[j]
            part_share = weight[a:b] * total[begin[a:b]]
            count = edges[first[:on] + j - 1]
            at = np.cumsum(count) - count
            # Sums inside each node one by one, so they do not depend on the other parts.
            whole, more, k = part_share[at], np.flatnonzero(count > 1), 1
            while len(more):
                whole[more] += part_share[at[more] + k]
                part_share[at[more] + k] = whole[more]
                k += 1
                more = more[count[more] > k]
            total[base[:on] + j] = whole
            share[a:b] = part_share / np.repeat(whole, count)
            for k in np.flatnonzero(whole < 1e-150):  # only proportions matter
                total[base[k] + max(0, j - longest) : base[k] + j + 1] *= 1e150
        by_node = np.argsort(end, kind="stable")
        counts = np.zeros(len(total), dtype=np.int64)
        counts[np.arange(len(code)) + part + 1] = edges
        grid = np.rint(share[by_node] * (1 << GRID)).astype(np.int32)
        return self._store(sizes, counts, grid, self._ids[entry[by_node]], length[by_node])

    def _bytes(self, characters: list[bytes]) -> np.ndarray:
        """Stores characters without a piece, a byte piece a byte; their end nodes."""
        sizes = np.array([len(c) for c in characters], dtype=np.int64)
        ids = np.array([self.byte[b] for c in characters for b in c])
        counts = np.ones(int(sizes.sum()) + len(sizes), dtype=np.int64)
        counts[np.cumsum(sizes + 1) - sizes - 1] = 0
        return self._store(sizes, counts, np.full(len(ids), 1 << GRID), ids, np.ones(len(ids), dtype=np.int64))

    def _learn(self, units: set[str]) -> None:
        """Stores units."""
        plain = sorted(filter(self.known.issuperset, units), key=len, reverse=True)
        parts_of: dict[str, list[str | bytes]] = {}
        for unit in units.difference(plain):
            text = SPACE + unit[1:] if unit[0] == " " else unit
            parts, run = [], text[0] if unit[0] == " " else ""
            for c in text[len(run) :]:
                if c in self.known:
                    run += c
                else:
                    parts += [run, c.encode()] if run else [c.encode()]
                    run = ""
            parts_of[unit] = [*parts, run] if run else parts
        self.units.update(self._ends(plain))
        pieces_ = {p for parts in parts_of.values() for p in parts}
        ends = self._ends(sorted((p for p in pieces_ if isinstance(p, str)), key=len, reverse=True))
        if apart := [p for p in pieces_ if isinstance(p, bytes)]:
            ends.update(zip(apart, self._bytes(apart).tolist(), strict=True))
        for unit, parts in parts_of.items():
            self.units[unit] = _SEVERAL
            self.parts[unit] = [ends[p] for p in parts]

    def _ends(self, texts: list[str]) -> dict[str, int]:
        """Stores parts of known characters (longest first), a blank standing for ``SPACE``; their end nodes."""
        ends, at = {}, 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < _LEARN_CHARS:
                size += len(texts[stop])
                stop += 1
            some = texts[at:stop]
            ends.update(zip(some, self._forward([t.replace(" ", SPACE) for t in some]).tolist(), strict=True))
            at = stop
        return ends

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Piece ids of each text, drawn by its key."""
        if self.nodes > MAX_NODES or len(self.seen) > MAX_SEEN:
            self._clear()
        units = [_UNIT.findall(" " + text) if text else [] for text in texts]
        new = set().union(*units) - self.units.keys()
        again = new & self.seen
        self._learn(again)
        self.seen -= again
        kept = self.nodes, self.edges
        once = new - again
        self._learn(once)
        ids = self._draw(units, keys)
        # What this slice has seen first goes with it.
        self.seen |= once
        for unit in once:
            del self.units[unit]
            self.parts.pop(unit, None)
        self.nodes, self.edges = kept
        return ids

    def _draw(self, units: list[list[str]], keys: list[str]) -> list[np.ndarray]:
        ends, sizes, get = [], [], self.units.__getitem__
        for own in units:
            found = list(map(get, own))
            if _SEVERAL in found:
                found = [e for unit, end in zip(own, found) for e in (self.parts[unit] if end == _SEVERAL else (end,))]
            ends += found
            sizes.append(len(found))
        seeds = np.array([xxhash.xxh64_intdigest(k, 0) for k in keys], dtype=np.uint64)
        place = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = np.repeat(seeds, sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.array(ends, dtype=np.int64)
        open_, start = np.arange(len(at)), self.start_of[at]
        drawn, step = [], 0
        while len(open_):
            u = (_mixed(seed[open_] ^ _mixed(np.array([step + 1], dtype=np.uint64))) >> np.uint64(64 - GRID)).astype(np.int32)
            # A node has few edges: pass by those whose cumulative share is not above the draw.
            e = self.first_edge[at[open_]]
            past = np.flatnonzero(self.cumulative[e] <= u)
            while len(past):
                e[past] += 1
                past = past[self.cumulative[e[past]] <= u[past]]
            drawn.append((open_, self.piece[e]))
            at[open_] -= self.length[e]
            open_ = open_[at[open_] > start[open_]]
            step += 1
        counts = np.zeros(len(at), dtype=np.int64)
        for who, _ in drawn:
            counts[who] += 1
        last = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for k, (who, piece) in enumerate(drawn):
            out[last[who] - k] = piece
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode()[1:]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def pieces(path: str, temperature: float = TEMPERATURE) -> Pieces:
    """One per worker process, kept over tasks."""
    return Pieces(path, temperature)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str], list[str]]]:
    first, texts, size = 0, [], 0
    rows = batch.column(1).to_pylist()
    for i, text in enumerate(rows):
        texts.append(text or "")
        size += len(texts[-1]) // 6
        if size >= _CHUNK or i == len(rows) - 1:
            some = batch.slice(first, len(texts))
            yield some, texts, ["" if k is None else str(k) for k in some.column(0).to_pylist()]
            first, texts, size = i + 1, [], 0


def encode(rows: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``key`` and the sampled ``ids`` (array of int) of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path or model_path(), temperature)
        for batch in batches:
            for some, texts, keys in _slices(batch):
                ids = own.encode(texts, keys)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and the ``text`` of every row's ids (null: no piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path or model_path())
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32`` (little-endian 32-bit ids) and whether
    decoding the pieces gave the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path or model_path(), temperature)
        for batch in batches:
            for some, texts, keys in _slices(batch):
                ids = own.encode(texts, keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "lossless"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_pieces long, ids_crc32 long, lossless boolean"
    )


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERY = LlmQuery(_run)
