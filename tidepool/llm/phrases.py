"""Phrase collocations by Misra-Gries summaries (operator 13).

Phrases are runs of 1 to ``LONGEST`` words inside a piece (text between sentence
marks and line ends), counted per language.

First pass, two rounds (1 and 2 words; then the longer ones, only where every pair of
neighbouring words survived the first round).  Every phrase occurrence is a 64-bit hash of
its language and words; a stretch of texts sends each hash partition its distinct
hashes with their counts, and the number of occurrences (mass) behind them.  A
partition sums the masses first, then folds the stretches into one Misra-Gries summary
with ``mass / threshold + 1`` counters: sums are added, and where there are too many
counters the greatest one beyond the capacity is taken off all.  What is taken off
stays below the threshold, so every phrase that occurs ``threshold`` times or more
is still there with at least ``threshold`` less what was taken off.  Summaries are
mergeable, so the order and the size of the stretches do not matter, and a phrase with
a third of all occurrences is one row a stretch.

The survivors become a bitmap of ``2**FILTER_BITS`` bits by the hash's leading bits (a
partition owns a range of hashes and sends its own piece): 16 MB whatever the data,
the only thing that is collected and broadcast.  A bit that is set for another phrase's
sake lets a phrase through, and never holds one back.

Second pass: phrases whose bit is set are counted exactly, by their words and not
their hashes; those below the threshold go.  Scores are whole numbers of 128 bits or more
(``decimal(38)`` products, long division), so nothing is rounded.

Defined results: a null text is empty, a null language is ``und``; repeated rows count
again; ties go to the smaller cut, then to the phrase; an empty table, or one without
frequent phrases, gives an empty result.  Texts longer than a slice are cut between
pieces; one piece is held whole.  Only the named columns are read.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LlmQuery, table, written

THRESHOLD = 100
LONGEST = 5
TOP = 2000
#: A candidate goes where a longer one that holds it has this many percent of its count.
COVER_PERCENT = 100
UNKNOWN = "und"
FILTER_BITS = 27
#: Occurrences a hash partition is made for (partitions: a power of two).
PARTITION_MASS = 16_000_000
MAX_PARTITIONS = 1 << 14
_SLICE_CHARS = 4_000_000
_FOLD_ROWS = 250_000
#: The second pass holds phrases as text, so it has more (smaller) partitions than the first.
_COUNT_SPLIT = 8
_SALTS = 64
_BREAK = b"\xff"
_MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, marks and line ends as a byte that no UTF-8 text holds.
_BYTES = bytes(0xFF if b in _MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of a stretch of texts: ``vocabulary``, each word's ``code`` (-1: a
    break between pieces) and its language's number."""

    langs: list[str]
    vocabulary: list[bytes]
    code: np.ndarray
    lang: np.ndarray

    def whole(self, n: int) -> np.ndarray:
        """Places where ``n`` words of one piece begin."""
        is_word = self.code >= 0
        ok = is_word[: max(0, len(is_word) - n + 1)].copy()
        for k in range(1, n):
            ok &= is_word[k : len(is_word) - n + 1 + k]
        return np.flatnonzero(ok)

    def hashes(self) -> np.ndarray:
        """A hash of every word (0 at breaks)."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary] + [0], dtype=np.uint64)
        return own[self.code]


def read_words(rows: list[tuple[str, str]]) -> Words:
    """Words of ``(lang, text)`` rows."""
    by_lang: dict[str, list[str]] = {}
    for lang, text in rows:
        by_lang.setdefault(lang, []).append(text)
    words, sizes = [], []
    for texts in by_lang.values():
        own = ("\n".join(texts) + "\n").encode().translate(_BYTES).replace(_BREAK, b" \xff ").split()
        words += own
        sizes.append(len(own))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    vocabulary, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if _BREAK in vocabulary:
        at = vocabulary.index(_BREAK)
        code[code == at] = -1
    return Words(list(by_lang), vocabulary, code, np.repeat(np.arange(len(sizes)), sizes))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
    """Rows of about ``_SLICE_CHARS`` characters; longer texts in parts, cut at marks."""
    rows, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = 0
            while len(text) - at > _SLICE_CHARS:
                cut = max(text.rfind(chr(m), at, at + _SLICE_CHARS) for m in _MARKS)
                if cut < 0:
                    cut = min((p for m in _MARKS if (p := text.find(chr(m), at + _SLICE_CHARS)) >= 0), default=len(text))
                yield [(lang, text[at:cut])]
                at = cut + 1
            rows.append((lang, text[at:]))
            size += max(0, len(text) - at)
            if size >= _SLICE_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _windows(words: Words, sizes: tuple[int, ...], seen: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``sizes`` (ascending): size, places and hashes of the phrases, of more
    than two words only those whose pairs of neighbours are all ``seen``."""
    word = words.hashes()
    seeds = np.array([xxhash.xxh64_intdigest(x, 1) for x in words.langs], dtype=np.uint64)
    lang = seeds[words.lang]
    paired = None
    if max(sizes) > 2 and seen is not None:
        pair = words.whole(2)
        paired = np.zeros(len(word), dtype=bool)
        paired[pair] = _has(seen, _hash(word, lang, pair, 2))
    for n in sizes:
        at = words.whole(n)
        if n > 2 and paired is not None:
            for k in range(n - 1):
                at = at[paired[at + k]]
        yield n, at, _hash(word, lang, at, n)


def _hash(word: np.ndarray, lang: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = lang[at] + np.uint64(n)
    for k in range(n):
        h = (h ^ word[at + k]) * _FACTOR
        h ^= h >> np.uint64(29)
    return _mixed(h)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class Summary:
    """A Misra-Gries summary over hashes, fed by sums over stretches."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._wait: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self._wait.append((hashes, counts))
        self._waiting += len(hashes)
        if self._waiting > max(self.capacity, 1 << 16):
            self.fold()

    def fold(self) -> None:
        if not self._wait:
            return
        h = np.concatenate([self.hashes, *(x for x, _ in self._wait)])
        c = np.concatenate([self.counts, *(x for _, x in self._wait)])
        self._wait, self._waiting = [], 0
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[first], np.add.reduceat(c, first)
        if len(h) > self.capacity:
            off = int(np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1])
            self.taken += off
            stay = c > off
            h, c = h[stay], c[stay] - off
        self.hashes, self.counts = h, c

    def survivors(self, threshold: int) -> np.ndarray:
        """Hashes that may have ``threshold`` occurrences."""
        self.fold()
        return self.hashes[self.counts + self.taken >= threshold]


def frequent_bits(docs: DataFrame, sizes: tuple[int, ...], threshold: int, partitions: int, seen: Column | None = None) -> np.ndarray:
    """The bitmap of phrases of ``sizes`` words that occur ``threshold`` times or more (and maybe of others)."""
    spark = docs.sparkSession
    shift = np.uint64(64 - (partitions.bit_length() - 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if seen is None else np.frombuffer(seen.value, dtype=np.uint8)
        for rows in _slices(batches):
            every = [h for _, _, h in _windows(read_words(rows), sizes, known)]
            hashes, counts = np.unique(np.concatenate(every), return_counts=True)
            if not len(hashes):
                continue
            part = (hashes >> shift).astype(np.int64) if partitions > 1 else np.zeros(len(hashes), np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            mass = np.add.reduceat(counts, np.concatenate([[0], cuts]))
            own = part[np.concatenate([[0], cuts])]
            some = [(p, h.tobytes(), c.astype("<u4").tobytes()) for p, h, c in zip(own.tolist(), np.split(hashes, cuts), np.split(counts, cuts), strict=True)]
            # The mass goes ahead of the counts: a partition reads all masses first.
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(mass, pa.int64()), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.nulls(len(own), pa.int64()), pa.array([x[1] for x in some], pa.binary()), pa.array([x[2] for x in some], pa.binary())], names=names
            )

    names = ["part", "mass", "hashes", "counts"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass: dict[int, int] = {}
        found: dict[int, Summary] = {}
        for batch in batches:
            for part, m, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m is not None:
                    mass[part] = mass.get(part, 0) + m
                    continue
                if part not in found:
                    found[part] = Summary(mass[part] // threshold + 1)
                found[part].add(np.frombuffer(hashes, np.uint64), np.frombuffer(counts, "<u4").astype(np.int64))
        for part, summary in found.items():
            slot = summary.survivors(threshold) >> np.uint64(64 - FILTER_BITS)
            width = (1 << FILTER_BITS) // partitions
            bits = np.zeros(width, dtype=np.uint8)
            bits[slot.astype(np.int64) - part * width] = 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    sent = _given(docs).mapInArrow(emit, "part int, mass long, hashes binary, counts binary")
    dealt = sent.repartitionById(partitions, "part").sortWithinPartitions("part", F.col("mass").isNull())
    pieces = written(dealt.mapInArrow(summarise, "part int, bits binary"), "phrase-bits")
    width = (1 << FILTER_BITS) // partitions // 8
    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in pieces.collect():  # pieces of one bitmap of fixed size
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def exact_counts(docs: DataFrame, threshold: int, longest: int, partitions: int, short: Column, long: Column) -> DataFrame:
    """``lang, size, phrase, n`` of phrases with at least ``threshold`` occurrences;
    size 0 stands for all words of a language.

    A stretch sends each hash partition one row, its phrases as lists (in runs of one
    language and size); a partition has all counts of its phrases."""
    shift = np.uint64(64 - (partitions.bit_length() - 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(short.value, np.uint8)
        longer = np.frombuffer(long.value, np.uint8)
        for rows in _slices(batches):
            words = read_words(rows)
            text, width = words.vocabulary, np.int64(len(words.vocabulary) + 1)
            per_lang = np.bincount(words.lang[words.code >= 0], minlength=len(words.langs))
            runs = [(xxhash.xxh32_intdigest(x) % partitions, x, 0, [""], [n]) for x, n in zip(words.langs, per_lang.tolist()) if n]
            for n, at, h in _windows(words, tuple(range(1, longest + 1)), pairs):
                hit = _has(pairs if n <= 2 else longer, h)
                at, h = at[hit], h[hit]
                # Exact numbers of the phrases: word by word, renumbered where they would grow too long.
                key = words.lang[at]
                for k in range(n):
                    key = np.unique(key * width + words.code[at + k], return_inverse=True)[1]
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                lang = words.lang[at[first]]
                part = (h[first] >> shift).astype(np.int64) if partitions > 1 else np.zeros(len(first), np.int64)
                by = np.lexsort((lang, part))
                phrase = words.code[at[first][by][:, None] + np.arange(n)].tolist()
                phrases = [b" ".join([text[c] for c in row]).decode() for row in phrase]
                part, lang, count = part[by], lang[by], count[by].tolist()
                cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(lang) != 0)) + 1).tolist(), len(by)]
                runs += [(int(part[i]), words.langs[lang[i]], n, phrases[i:j], count[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j]
            by_part: dict[int, list] = {}
            for run in runs:
                by_part.setdefault(run[0], []).append(run)
            columns = [
                list(by_part), [[r[1] for r in own] for own in by_part.values()], [[r[2] for r in own] for own in by_part.values()],
                [[len(r[3]) for r in own] for own in by_part.values()], [[p for r in own for p in r[3]] for own in by_part.values()],
                [[c for r in own for c in r[4]] for own in by_part.values()],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["part", "langs", "sizes", "lengths", "phrases", "counts"]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]

    def flat(batch: pa.RecordBatch) -> pa.Table:
        langs, sizes, lengths, phrases, counts = (batch.column(k).flatten() for k in range(1, 6))
        run = pa.array(np.repeat(np.arange(len(lengths)), lengths.to_numpy()))
        return pa.table({"lang": langs.take(run), "size": sizes.take(run), "phrase": phrases, "n": counts})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = kept = 0
        keys = ["lang", "size", "phrase"]

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                held.append(flat(batch.slice(i, 100)))
                size += held[-1].num_rows
                if size - kept > max(kept, _FOLD_ROWS):
                    held = [summed()]
                    size = kept = held[0].num_rows
        if held:
            found = summed()
            yield from found.filter(pc.or_(pc.equal(found["size"], 0), pc.greater_equal(found["n"], threshold))).to_batches(max_chunksize=50_000)

    sent = _given(docs).mapInArrow(emit, "part int, langs array<string>, sizes array<int>, lengths array<int>, phrases array<string>, counts array<bigint>")
    return sent.repartitionById(partitions, "part").mapInArrow(count, "lang string, size int, phrase string, n long")


def _part(first: Column, count: Column) -> Column:
    """``count`` words of a phrase from word ``first`` (0 on)."""
    return F.array_join(F.slice(F.split("phrase", " ", -1), first + 1, count), " ")


def rank_phrases(counts: DataFrame, top: int, cover_percent: int) -> DataFrame:
    """The contract's columns from exact counts of all frequent phrases."""
    several = counts.where(F.col("size") >= 2)
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": _part(F.lit(0), F.col("cut")), "right": _part(F.col("cut"), F.col("size") - F.col("cut"))})
    single = counts.where(F.col("size") > 0).select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(single.select("lang", F.col("part").alias(side), F.col("part_n").alias(name)), ["lang", side])
    # A language's total goes to its phrases in some parts, so that a language is not one task's.
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    totals = counts.where(F.col("size") == 0).select("lang", F.col("n").alias("all_n"), salts)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("n") * F.lit(1000).cast("decimal(4,0)") * F.col("all_n").cast("decimal(15,0)"), wide("l") * wide("r"))
    cuts = cuts.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(_SALTS))).join(totals, ["lang", "salt"]).withColumn("score", score.cast("bigint"))
    lowest = cuts.groupBy("lang", "phrase").agg(
        F.first("n").alias("a"), F.first("all_n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("low")
    )
    # What lies inside a longer candidate of (nearly) the same count.
    inside = several.where(F.col("size") > 2).withColumn("inner", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inside = inside.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("inner"))))
    inside = inside.groupBy("lang", _part(F.col("start"), F.col("inner")).alias("phrase")).agg(F.max("n").alias("outer_n"))
    kept = lowest.join(inside, ["lang", "phrase"], "left")
    hundred, percent = F.lit(100).cast("decimal(3,0)"), F.lit(cover_percent).cast("decimal(10,0)")
    kept = kept.where(F.col("outer_n").isNull() | (hundred * wide("outer_n") < percent * wide("a")))
    flat = kept.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = flat.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # About six bytes a word, two or three phrase sizes a round: a power of two partitions.
    partitions = min(MAX_PARTITIONS, 1 << max(1, int(size // 3 // PARTITION_MASS).bit_length()))
    share: Callable = spark.sparkContext.broadcast
    short = share(frequent_bits(docs, (1, 2), threshold, partitions).tobytes())
    long = share(frequent_bits(docs, tuple(range(3, longest + 1)), threshold, partitions, short).tobytes()) if longest > 2 else short
    counts = written(exact_counts(docs, threshold, longest, partitions * _COUNT_SPLIT, short, long), "phrase-counts")
    return rank_phrases(counts, top, cover_percent)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = "\nUNION ALL\n".join(
        f"SELECT lang, {n} AS size, array_to_string(words[i:i + {n - 1}], ' ') AS phrase FROM "
        f"(SELECT lang, words, unnest(range(1, len(words) - {n - 2})) AS i FROM pieces WHERE len(words) >= {n})"
        for n in range(1, LONGEST + 1)
    )
    return f"""
WITH docs AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs)
), grams AS ({grams}
), total AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM pieces GROUP BY lang
), counts AS (
  SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {THRESHOLD}
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS w
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
  FROM cuts JOIN total USING (lang)
  JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM (
    SELECT lang, f, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (
      SELECT lang, f, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS m FROM counts WHERE size > 2)) GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE f IS NULL OR 100 * f < {COVER_PERCENT} * a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""


QUERY = LlmQuery(_run, _sql())
