"""Language-model scoring with a probabilistic suffix tree (operator 10).

Tokens are words and one end per text.  Learned from all training texts:

* unigram counts of every token, exact, as a distributed table;
* the tree: contexts of up to ``MAX_DEPTH`` preceding words, whatever their share
  of the corpus.  A context is retained if the next words seen at least
  ``LEAST_COUNT`` times after it diverge from what its longest retained suffix
  says by more than chance explains; it is lengthened unless it was seen once or
  a single word ever followed it.  So contexts, next words and depth follow the
  data, and what the tree gathers grows with the corpus.

A context's distribution is smoothed by absolute discounting: what discounts and
next words without a row of their own leave over is dealt out as the suffix
context deals.  A token is scored in the longest retained suffix of what stands before it.

The root gives words whose share of all tokens is at least ``LEAST_FREQUENT`` (at most
1 / LEAST_FREQUENT of them) their add-0.1 share.  The rest is dealt to rarer
words by their counts rounded down to powers of two, which a table of ``CELLS``
hashed cells tells every task (the largest of a cell's words counts); an empty
cell counts ``ADD``.  Known words and an unseen one of an empty cell add up to 1
(but for rare words that share 40 bits of their hash with a frequent one).

The tree is never in one place.  Every occurrence (preceding words, next word,
text) goes once, as a packed array per slice of texts, to the bucket of its last
preceding word.  All contexts that end in that word, their counts, their tests
and the probabilities of their occurrences are then that bucket's alone, and so
is the word's own count for the base score: a bucket sends back sums per text.  Words that would overfill a bucket or
make up more than ``SPREAD_SHARE`` of all tokens are spread
over several by the word before them; what follows them is counted
beforehand and added to each of their buckets.  Only one and the same pair of
words is never split, and occurrences equal within a slice's text are sent as one.

A bucket tells the words it counts for the base score by 64 bits of their hash,
next words and earlier words of its contexts by 40: two of them are taken for one
only if they agree there after the same word.

Defined results: a null text is an empty one (only the end is scored); a null
``doc_id`` counts as empty text for the fold; repeated rows count and are scored
each; an empty table gives an empty result; without training texts all counts are
0 and each token's probability is 1, as the base formula says.  Only ``doc_id``
and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LlmQuery, id_remainder, table, written

FOLDS = 10
ADD = 0.1
MAX_DEPTH = 2
LEAST_FREQUENT = 2e-6
LEAST_COUNT = 2
LEAST_DIVERGENCE = 0.01
DISCOUNT = 0.5
#: Occurrences a bucket should hold, about; a task's memory is about 150 bytes each.
BUCKET_MASS = 1_300_000
#: Words of a larger share of all tokens are spread over buckets, too, if they occur more than so often.
SPREAD_SHARE, SPREAD_LEAST = 1 / 150, 100_000
#: Cells of the table of rare words' counts, a byte each.
CELLS = 1 << 22
#: The end token; no word is empty.
END = b""
_SEED = 42  # that of Spark's xxhash64
_FLUSH = 400_000
_CHUNK = 800_000
_ROW_BITS = 21  # a slice has fewer than 2^21 texts, a task fewer than 2^21 slices
_UNIT = 2.0**32  # sums of logs travel as whole numbers of this part, so their order doesn't matter
_STRIPE = 1 << 16
_DOC, _CELLS, _HOT, _SIZE = range(4)


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words and the end; ``bytes`` methods know ASCII only."""
    return [*text.encode().lower().split(), END]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens_of(text or ""))
            if len(counts) > _FLUSH:
                yield out(counts)
                counts.clear()
    if counts:
        yield out(counts)


# --- packed arrays -------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays as bytes, each in the narrowest type that holds it, compressed."""
    small = [a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8) for a in arrays]
    head = np.array([x for a in small for x in (a.itemsize, len(a))], np.uint32)
    data = b"".join([np.uint32(len(small)).tobytes(), head.tobytes(), *[a.tobytes() for a in small]])
    return np.uint32(len(data)).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    data = pa.decompress(memoryview(packed)[4:], int(np.frombuffer(packed, np.uint32, 1)[0]), "zstd", asbytes=True)
    count = int(np.frombuffer(data, np.uint32, 1)[0])
    head, at, out = np.frombuffer(data, np.uint32, 2 * count, 4).tolist(), 4 + 8 * count, []
    for width, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(data, f"u{width}", size, at))
        at += width * size
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    """Sorted ``values`` by their differences; ``np.cumsum`` of 64 bits gives them back."""
    return np.diff(values, prepend=np.zeros(1, values.dtype))


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in words), np.uint64, len(words))


def _key(hashes: np.ndarray) -> np.ndarray:
    """40 bits of word hashes, never 0."""
    return np.maximum(hashes & np.uint64((1 << 40) - 1), np.uint64(1))


# --- what every task knows -----------------------------------------------------------------------


@dataclass
class Root:
    """The root distribution: totals, the frequent words by hash, the buckets."""

    total: int
    distinct: int
    hashes: np.ndarray  # of the frequent words, sorted
    counts: np.ndarray
    logs: np.ndarray  # log10 of their add-0.1 shares
    end: int  # count of the end token
    buckets: int
    heavy: float  # counts above this are spread over buckets
    max_depth: int
    classes: np.ndarray  # per cell 0, or 1 + log2 of the largest rare count, rounded down
    unit: float  # what a count of one is dealt at the root

    @property
    def scale(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` among the frequent words, -1 for rare ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def share(self, keys: np.ndarray) -> np.ndarray:
        """Root probabilities by 40-bit keys."""
        own = _key(self.hashes)
        order = np.argsort(own)
        own, logs = own[order], self.logs[order]
        classes = self.classes[(keys % np.uint64(len(self.classes))).astype(np.int64)].astype(int)
        out = self.unit * np.where(classes > 0, 2.0 ** (classes - 1), ADD)
        if len(own):
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            out = np.where(own[at] == keys, 10.0 ** logs[at], out)
        return out

    def spread(self, hashes: np.ndarray) -> np.ndarray:
        """Over how many buckets each word goes."""
        at = self.places(hashes)
        n = np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)
        return np.where(n > self.heavy, np.ceil(n / self.heavy), 1).astype(np.uint64)

    def bucket(self, hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
        x = hashes + salts * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.buckets)).astype(np.int64)


def fit_root(
    docs: DataFrame, max_depth: int = MAX_DEPTH, folds: int = FOLDS, bucket_mass: int = BUCKET_MASS, least_frequent: float = LEAST_FREQUENT
) -> Root:
    """The root, from the exact counts of all training tokens."""
    train = docs.where(id_remainder("doc_id", folds) != 0)
    counts = train.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "unigrams")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    frequent = counts.where(F.col("n") >= least_frequent * total).toArrow()  # at most 1 / least_frequent rows
    hashes, n = _hash(frequent.column("word").to_pylist()), frequent.column("n").to_numpy().astype(float)
    order = np.argsort(hashes)
    logs = np.log10((n + ADD) / (total + ADD * (distinct + 1)))
    buckets = 1 + size // (6 * bucket_mass)  # about six bytes a token
    # By share, too: what is sent ahead of spread words then grows with the corpus, not by leaps.
    heavy = min(bucket_mass / 2, max(SPREAD_SHARE * total, SPREAD_LEAST))
    classes, asked = _classes(counts.where(F.col("n") < least_frequent * total))
    unit = (1 - float((10.0**logs).sum())) / (asked + ADD)
    return Root(total, distinct, hashes[order], n[order], logs[order], end, buckets, heavy, max_depth, classes, unit)


def _classes(rare: DataFrame) -> tuple[np.ndarray, float]:
    """The cells' classes, put together per stripe of cells (``CELLS`` bytes, whatever
    the corpus), and what all rare words ask for by them."""

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, np.ndarray] = defaultdict(lambda: np.zeros(_STRIPE, np.uint8))
        for batch in batches:
            stripe, cell, n = (c.to_numpy() for c in batch.columns)
            for one in np.unique(stripe):
                at = stripe == one
                np.maximum.at(held[int(one)], cell[at] % _STRIPE, (1 + np.log2(n[at])).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([x.tobytes() for x in held.values()])], names=["stripe", "cells"])

    key = F.greatest(F.xxhash64("word").bitwiseAND(F.lit((1 << 40) - 1)), F.lit(1))
    cells = rare.select((key % CELLS).alias("cell"), "n").groupBy("cell").agg(F.max("n").alias("n"), F.count("*").alias("words"))
    cells = written(cells, "word-cells")
    asked = cells.agg(F.sum(F.col("words") * F.pow(F.lit(2.0), F.floor(F.log2("n"))))).first()[0] or 0.0
    cells = cells.select(F.floor(F.col("cell") / _STRIPE).cast("int").alias("stripe"), F.col("cell").cast("int").alias("cell"), "n")
    out = np.zeros(CELLS, np.uint8)
    for stripe, data in cells.repartition("stripe").mapInArrow(stripes, "stripe int, cells binary").toArrow().to_pandas().itertuples(index=False):
        out[stripe * _STRIPE : (stripe + 1) * _STRIPE] = np.frombuffer(data, np.uint8)
    return out, asked


# --- texts to occurrences ------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """A task's rows in slices of about ``_CHUNK`` tokens, whatever the batches' size."""
    rows, texts, size = [], [], 0
    for batch in batches:
        first = 0
        others = batch.drop_columns([batch.schema.names[column]])
        for i, text in enumerate(batch.column(column).to_pylist()):
            texts.append(tokens_of(text or ""))
            size += len(texts[-1])
            if size >= _CHUNK:
                yield pa.Table.from_batches([*rows, others.slice(first, i + 1 - first)]), texts
                first, rows, texts, size = i + 1, [], [], 0
        if first < batch.num_rows:
            rows.append(others.slice(first))
    if texts:
        yield pa.Table.from_batches(rows), texts


@dataclass
class _Slice:
    """The tokens of some texts as numbers into ``words`` (from 1; 0: none)."""

    words: list[bytes]
    hashes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    texts: np.ndarray  # each token's text
    places: np.ndarray

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> _Slice:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = lambda: len(numbers) + 1
        sizes = np.array([len(t) for t in texts])
        ids = np.fromiter((numbers[w] for t in texts for w in t), np.int32, int(sizes.sum()))
        words = list(numbers)
        starts = np.cumsum(sizes) - sizes
        return cls(
            words,
            np.concatenate([np.zeros(1, np.uint64), _hash(words)]),
            ids,
            starts,
            np.repeat(np.arange(len(texts), dtype=np.int32), sizes),
            np.arange(len(ids), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes),
        )

    def before(self, distance: int, at: np.ndarray) -> np.ndarray:
        """The word ``distance`` tokens before each place of ``at``, 0 where there is none."""
        return np.where(self.places[at] >= distance, self.ids[at - distance], 0)


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sort order by ``columns`` and where equal entries begin in it."""
    keys, room = [], 0
    for c in columns:
        bits = int(c.max()).bit_length() if len(c) else 0
        if keys and room + bits <= 63:
            keys[-1], room = (keys[-1] << bits) | c, room + bits
        else:
            keys.append(c.astype(np.int64))
            room = bits
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _cells(part: _Slice, held: np.ndarray, root: Root) -> Iterator[tuple[int, bytes]]:
    """Per bucket: last preceding words (hashes), other words (keys, 0 first), texts
    (number in the slice, twice, plus one if held out) and occurrences (text,
    times, last preceding word, next word, earlier words)."""
    at = np.flatnonzero(part.places > 0)
    if not len(at):
        return
    last, second = part.before(1, at), part.before(2, at)
    bucket = root.bucket(part.hashes[last], part.hashes[second] % root.spread(part.hashes)[last])
    columns = [bucket, last, *([second] if root.max_depth > 1 else []), *[part.before(d, at) for d in range(3, root.max_depth + 1)], part.ids[at], part.texts[at]]
    order, first = _order(columns)
    times = np.diff(np.append(first, len(order)))
    bucket, *heads, following, text = [c[order[first]] for c in columns]
    last, *earlier = heads
    keys = np.concatenate([np.zeros(1, np.uint64), _key(part.hashes[1:])])
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows, row = np.unique(text[a:b], return_inverse=True)
        lasts, number = np.unique(part.hashes[last[a:b]], return_inverse=True)
        others, numbers = np.unique(keys[np.concatenate([[0], *[c[a:b] for c in (following, *earlier)]])], return_inverse=True)
        each = np.split(numbers[1:], 1 + len(earlier))
        yield int(bucket[a]), _pack(_gaps(lasts), _gaps(others), 2 * rows + held[rows], row, times[a:b], number, *each)


def _hot_pairs(train: DataFrame, root: Root) -> DataFrame:
    """What follows the words that are spread: ``bucket, cells`` with all pairs
    counted at least ``LEAST_COUNT`` times, for each of the words' buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches, 0):
            part = _Slice.of(texts)
            at = np.flatnonzero(part.places > 0)
            at = at[(root.spread(part.hashes) > 1)[part.before(1, at)]]
            order, first = _order(columns := [part.before(1, at), part.ids[at]])
            hashes = [part.hashes[c[order[first]]].view(np.int64) for c in columns]
            times = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(times.astype(np.int64))], names=["last", "following", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, following, n = (c.to_numpy() for c in batch.columns)
            last, following, spread = last.view(np.uint64), following.view(np.uint64), root.spread(last.view(np.uint64))
            at = np.repeat(np.arange(len(last)), spread.astype(np.int64))
            salt = np.arange(len(at)) - np.repeat(np.cumsum(spread.astype(np.int64)) - spread.astype(np.int64), spread.astype(np.int64))
            bucket = root.bucket(last[at], salt.astype(np.uint64))
            order, first = _order([bucket, at])  # two salts of a word may share a bucket
            bucket, at = bucket[order[first]], at[order[first]]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = [(int(bucket[a]), _pack(last[at[a:b]], _key(following[at[a:b]]), n[at[a:b]])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "cells"]
            )

    pairs = train.select("text").mapInArrow(count, "last long, following long, n long")
    pairs = pairs.groupBy("last", "following").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return pairs.mapInArrow(send, "bucket int, cells binary")


# --- a bucket's contexts -------------------------------------------------------------------------


def _bucket_scores(cells: list[bytes], hot: list[bytes], root: Root) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[int, int]]]:
    """Grows the contexts of a bucket and scores its occurrences in them.

    Returns each message's texts with three sums (minus log10 probabilities of next
    words and base logs of rare last words, times ``_UNIT``; known rare last words), and the
    candidates and retained contexts of each depth.
    """
    messages, pairs = [_unpack(m) for m in cells], [_unpack(m) for m in hot]
    lasts = [np.cumsum(m[0], dtype=np.uint64) for m in messages]
    others = [np.cumsum(m[1], dtype=np.uint64) for m in messages]
    words, word_of = np.unique(np.concatenate([*lasts, *[p[0] for p in pairs]]).astype(np.uint64), return_inverse=True)
    keys_, key_of = np.unique(np.concatenate([*others, *[p[1] for p in pairs]]).astype(np.uint64), return_inverse=True)
    last_base, other_base, row_base = (np.cumsum([0, *[len(m[i]) for m in messages]]) for i in range(3))

    def joined(i: int, base: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        places = np.concatenate([m[i].astype(np.int32) + np.int32(s) for m, s in zip(messages, base, strict=False)])
        return places if of is None else of[places].astype(np.int32)

    rows, sent = [m[2].astype(np.int64) for m in messages], len(messages)
    train = np.concatenate(rows) % 2 == 0
    row, times = joined(3, row_base), np.concatenate([m[4] for m in messages])
    last, following = joined(5, last_base, word_of), joined(6, other_base, key_of)
    heads = [last, *[joined(5 + d, other_base, key_of) for d in range(2, root.max_depth + 1)]]
    more = (word_of[last_base[-1] :], key_of[other_base[-1] :])
    del messages, lasts, others, word_of, key_of

    size, spread_words, p_root = len(keys_), root.spread(words) > 1, root.share(keys_)
    a, b = np.zeros(len(row)), np.ones(len(row))
    context, open_ = np.zeros(len(row), np.int32), np.ones(len(row), bool)
    sums = np.zeros((3, len(train)))
    sizes = []
    for depth, head in enumerate(heads, 1):
        at = np.flatnonzero(open_ if depth == 1 else open_ & (keys_[head] != 0))
        if not len(at):
            break
        key, word = context[at].astype(np.int64) * size + head[at], following[at]
        n, lower = np.where(train[row[at]], times[at], 0.0), a[at] + b[at] * p_root[word]
        if depth == 1 and pairs:
            # Spread words: all that follows them, instead of what follows them here.
            n = np.concatenate([np.where(spread_words[key], 0.0, n), *[p[2].astype(float) for p in pairs]])
            key, word, lower = np.concatenate([key, more[0]]), np.concatenate([word, more[1]]), np.concatenate([lower, p_root[more[1]]])
        keys, candidate = np.unique(key, return_inverse=True)
        seen = np.bincount(candidate, n)
        if depth == 1:
            place, spread = root.places(words[keys]), spread_words[keys]
            seen = np.where(spread, root.counts[place] if len(root.counts) else 0.0, seen)
            base, found = np.where(place < 0, np.log10((seen + ADD) / root.scale), 0.0), (place < 0) & (seen > 0)
            for i, x in ((1, base), (2, found)):
                sums[i] = np.bincount(row, times * x[candidate[: len(at)]], len(train))
        candidate = candidate.astype(np.int32)
        key = candidate.astype(np.int64) * size + word
        pair, one, entry = np.unique(key, return_index=True, return_inverse=True)
        del key, word
        n, lower, of = np.bincount(entry, n), lower[one], pair // size
        row_of = n >= LEAST_COUNT
        kept, p, c = np.where(row_of, n, 0.0), np.where(row_of, lower, 0.0), np.maximum(seen, 1)
        freedom = np.bincount(of, row_of, len(keys))
        total, total_p = np.bincount(of, kept, len(keys)), np.bincount(of, p, len(keys))
        rest, rest_p = seen - total, np.clip(1 - total_p, 1e-12, 1)
        gain = 2 * np.bincount(of, kept * np.log(np.where(row_of, n / (c[of] * lower), 1.0)), len(keys))
        gain += 2 * np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / (c * rest_p)), 0)
        retained = (freedom > 0) & (gain - freedom > 3 * np.sqrt(2 * freedom)) & ((gain - freedom) / (2 * c) >= LEAST_DIVERGENCE)
        over = (rest + DISCOUNT * freedom) / c
        sizes.append((int((seen >= LEAST_COUNT).sum()), int(retained.sum())))
        mine, own = candidate[: len(at)], entry[: len(at)]
        use = retained[mine]
        rows_a = np.where(row_of, (n - DISCOUNT) / c[of], 0.0)[own]
        a[at] = np.where(use, rows_a + over[mine] * a[at], a[at])
        b[at] = np.where(use, over[mine] * b[at], b[at])
        context[at] = mine
        several = np.bincount(of, n > 0, len(keys)) > 1
        if depth == 1:  # of next words seen once, only their number is known of spread words
            several = np.where(spread, freedom + rest > 1, several)
        open_[:] = False
        open_[at] = ((seen >= LEAST_COUNT) & several)[mine]

    sums[0] = np.bincount(row, times * np.log10(a + b * p_root[following]), len(train))
    sums[:2] = np.rint(np.maximum(-sums[:2], 0) * _UNIT)
    sums = sums.astype(np.int64)
    return [(rows[i] // 2, sums[:, row_base[i] : row_base[i + 1]]) for i in range(sent)], sizes


# --- scoring -------------------------------------------------------------------------------------

_SENT = (
    "bucket int, kind int, slice long, cells binary, row long, doc_id {id}, held_out boolean, n_tokens long, known long, base double, first double"
)
_GROWN = _SENT + ", depth int, candidates long, retained long"


def grow(docs: DataFrame, root: Root, folds: int = FOLDS) -> DataFrame:
    """The tree's growth and every text's scores in it, written once: texts (own
    columns), sums of texts per message, sizes per bucket and depth."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", (id_remainder("doc_id", folds) == 0).alias("held_out"), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = TaskContext.get().partitionId() << _ROW_BITS
        for batch, tokens in _chunks(batches, 2):
            part = _Slice.of(tokens)
            at = root.places(part.hashes)[part.ids]
            logs = np.where(at >= 0, root.logs[at] if len(root.logs) else 0.0, 0.0)
            # The end is no context's last word: its count is known here.
            end = part.starts + np.diff(np.append(part.starts, len(logs))) - 1
            logs[end], known = math.log10((root.end + ADD) / root.scale), at >= 0
            known[end] = root.end > 0
            n = len(tokens)
            docs_ = {
                "bucket": pa.array(np.full(n, slice_ % root.buckets, np.int32)),
                "kind": pa.array(np.full(n, _DOC, np.int32)),
                "row": pa.array((slice_ << _ROW_BITS) + np.arange(n)),
                "doc_id": batch["doc_id"].combine_chunks(),
                "held_out": batch["held_out"].combine_chunks(),
                "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                "known": pa.array(np.add.reduceat(known.astype(np.int64), part.starts)),
                "base": pa.array(np.add.reduceat(logs, part.starts)),
                "first": pa.array(np.log10(root.share(_key(part.hashes[part.ids[part.starts]])))),
            }
            yield _batch(docs_, n, batch.schema.field("doc_id").type)
            held = batch["held_out"].to_numpy().astype(np.int64)
            for bucket, cells in _cells(part, held, root):
                one = {"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([_CELLS], pa.int32()), "slice": pa.array([slice_]), "cells": pa.array([cells])}
                yield _batch(one, 1, batch.schema.field("doc_id").type)
            slice_ += 1

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, slices, hot, type_ = [], [], [], None
        for batch in batches:
            kinds, type_ = batch.column(1).to_numpy(), batch.schema.field("doc_id").type
            own = batch.filter(pa.array(kinds == _DOC))
            if own.num_rows:
                yield _batch(dict(zip(own.schema.names, own.columns, strict=True)), own.num_rows, type_, True)
            for name, bin_ in ((_CELLS, cells), (_HOT, hot)):
                chosen = batch.filter(pa.array(kinds == name))
                bin_ += chosen.column(3).to_pylist()
                if name == _CELLS:
                    slices += chosen.column(2).to_pylist()
        if not cells:
            return
        # In one order, whatever order the messages came in.
        order = sorted(range(len(slices)), key=slices.__getitem__)
        slices, cells = [slices[i] for i in order], [cells[i] for i in order]
        answers, sizes = _bucket_scores(cells, hot, root)
        back = {
            "kind": pa.array(np.full(len(slices), _CELLS, np.int32)),
            "slice": pa.array(slices, pa.int64()),
            "cells": pa.array([_pack(r, *x) for r, x in answers], pa.binary()),
        }
        yield _batch(back, len(slices), type_, True)
        n = len(sizes)
        counted = {
            "kind": pa.array(np.full(n, _SIZE, np.int32)),
            "depth": pa.array(np.arange(1, n + 1, dtype=np.int32)),
            "candidates": pa.array([c for c, _ in sizes], pa.int64()),
            "retained": pa.array([r for _, r in sizes], pa.int64()),
        }
        yield _batch(counted, n, type_, True)

    sent = texts.mapInArrow(emit, _SENT.format(id=kind))
    if (root.counts > root.heavy).any():
        train = docs.where(id_remainder("doc_id", folds) != 0)
        pairs = _hot_pairs(train, root).withColumn("kind", F.lit(_HOT))
        sent = sent.unionByName(pairs, allowMissingColumns=True)
    return written(sent.repartitionById(root.buckets, "bucket").mapInArrow(reduce, _GROWN.format(id=kind)), "suffix-tree")


def _batch(columns: dict[str, pa.Array], rows: int, id_type: pa.DataType, grown: bool = False) -> pa.RecordBatch:
    """A batch of all columns of ``_SENT`` (``_GROWN``), null where none are given."""
    types = {
        "bucket": pa.int32(), "kind": pa.int32(), "slice": pa.int64(), "cells": pa.binary(), "row": pa.int64(), "doc_id": id_type,
        "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "first": pa.float64(),
    }
    if grown:
        types |= {"depth": pa.int32(), "candidates": pa.int64(), "retained": pa.int64()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in types.items()], names=list(types))


def tree_size(grown: DataFrame) -> DataFrame:
    """``depth, candidates, retained``: contexts seen at least ``LEAST_COUNT``
    times, and those retained (a spread word counts in each of its buckets)."""
    sizes = grown.where(F.col("kind") == _SIZE)
    return sizes.groupBy("depth").agg(F.sum("candidates").alias("candidates"), F.sum("retained").alias("retained"))


def _text_sums(grown: DataFrame) -> DataFrame:
    """``row, log, rare_log, rare_known``: the sums of a slice's texts over all buckets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slice_, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, *sums = (x.astype(np.int64) for x in _unpack(cells))
                have = held.get(slice_, np.zeros((3, 0), np.int64))
                if have.shape[1] <= rows[-1]:
                    have = held[slice_] = np.pad(have, ((0, 0), (0, rows[-1] + 1 - have.shape[1])))
                have[:, rows] += np.stack(sums)
        for slice_, sums in held.items():
            columns = [(slice_ << _ROW_BITS) + np.arange(sums.shape[1]), *(-sums[:2] / _UNIT), sums[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "log", "rare_log", "rare_known"])

    answers = grown.where(F.col("kind") == _CELLS).select("slice", "cells")
    return answers.repartition("slice").mapInArrow(add, "row long, log double, rare_log double, rare_known long")


def score_in(grown: DataFrame, root: Root) -> DataFrame:
    """The contract's columns from what ``grow`` wrote."""
    of = lambda c: F.coalesce(c, F.lit(0.0))
    return grown.where(F.col("kind") == _DOC).join(_text_sums(grown), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(root.total).cast("long").alias("train_tokens"),
        (F.col("base") + of("rare_log")).alias("base_score"),
        (F.col("first") + of("log")).alias("score"),
    )


def score(docs: DataFrame, folds: int = FOLDS, **options: float) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every
    document; ``options`` are those of ``fit_root``."""
    root = fit_root(docs, folds=folds, **options)
    return score_in(grow(docs, root, folds), root)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERY = LlmQuery(_run)
