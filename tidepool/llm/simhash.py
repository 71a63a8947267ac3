"""SimHash near-duplicates by vantage-point trees (operator 4).

Fingerprint: 64 bits, each the majority of that bit over the XXH64 of all word
shingles of the whole text.  Equal fingerprints meet first (one row per
fingerprint), so copies cost nothing further.

Pairs within ``max_bits`` come from a forest of vantage-point trees.  Tree ``b``
measures Hamming distance on its own block of the 64 bits, a metric in which
a pair is no farther apart than in all bits.  A tree deals the fingerprints out
by their distances to its vantage points, level by level; a shard is one
combination of distances.  Triangle bound: two fingerprints ``e`` bits apart in
the block differ by at most ``e`` (and as evenly or oddly as ``e``) in the
distance to every vantage point, so all other shards are pruned, and a
fingerprint visits only the shards its ball reaches beyond its own.  Some block
holds at most ``max_bits // trees`` differing bits, which is every tree's radius;
with one tree more than bits (the default) it is 0 and no ball crosses a boundary, so
each fingerprint is in ``trees`` shards and no more, at any corpus size.  In its
shard it is held against all others on all 64 bits.

A shard beyond ``SHARD_ROWS`` is cut into chunks and every pair of chunks becomes
its own group, so a dense cluster is spread over tasks, too.  Groups link
their fingerprints as stars rather than pairs; ``components`` joins those.

Defined results: a null or wordless text has fingerprint zero, linked like any
other; a null ``doc_id`` gets its row and its component, whose id is the smallest
id that is not null (null if there is none); repeated rows give a row each; an
empty table gives an empty result.  ``deduplicate`` keeps all columns and one
row per component (smallest id, nulls last); helper columns take free names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LlmQuery, fresh_names, table, written
from .components import components

SHINGLE, SEED, MAX_BITS, BITS = 3, 42, 3, 64
SHARD_ROWS = 20_000
SMALL_GROUP = 200


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number.  ``bytes.lower`` and
    ``bytes.split`` know ASCII letters and white space only, as is asked."""
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in parts], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprinted(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with their fingerprints as the last column."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(x or "", shingle) for x in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    from pyspark.sql.types import LongType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, LongType()))


def _vantage(tree: int, level: int) -> int:
    return xxhash.xxh64_intdigest(f"vantage {tree} {level}", SEED)


def _shards(max_bits: int, trees: int, levels: int) -> Column:
    """All (tree, shard) a fingerprint ``fp`` belongs to or visits."""
    radius, out = max_bits // trees, []
    for tree in range(trees):
        low, high = BITS * tree // trees, BITS * (tree + 1) // trees
        block = ((1 << high) - 1) ^ ((1 << low) - 1)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        home = F.lit(0).cast("long")
        for level in range(levels):
            apart = F.col("fp").bitwiseXOR(F.lit(signed(_vantage(tree, level))).cast("long")).bitwiseAND(F.lit(signed(block)).cast("long"))
            home = home * 128 + F.bit_count(apart)
        steps = {0}
        for e in range(1, radius + 1):
            for offset in product(range(-e, e + 1, 2), repeat=levels):
                step = 0
                for x in offset:
                    step = step * 128 + x
                steps.add(abs(step))  # of a pair, the one with the smaller number visits
        out += [F.struct(F.lit(tree).alias("tree"), (home + s).alias("shard")) for s in sorted(steps)]
    return F.array(*out)


def _stars_of_small(x: np.ndarray, ends: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of groups given as ``ends`` (for each row the end of its group)."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = i = parent.get(p, p)
        return i

    at, step = np.arange(len(x)), 1
    while len(at := at[at + step < ends[at]]):
        near = np.bitwise_count(x[at] ^ x[at + step]) <= max_bits
        for i in at[near]:
            a, b = root(int(i)), root(int(i) + step)
            parent[max(a, b)] = min(a, b)
        step += 1
    return [(i, root(i)) for i in list(parent)]


def _stars_of_large(x: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of one group, found outward from one fingerprint at a time: those
    already reached are never compared with each other again."""
    out, rest = [], np.arange(len(x))
    while len(rest):
        first, rest, wave = int(rest[0]), rest[1:], [int(rest[0])]
        while wave and len(rest):
            now, wave = wave[:16], wave[16:]
            near = np.zeros(len(rest), dtype=bool)
            for i in now:
                near |= np.bitwise_count(x[rest] ^ x[i]) <= max_bits
            found, rest = rest[near], rest[~near]
            wave += found.tolist()
            out += [(int(i), first) for i in found]
    return out


def _linker(max_bits: int):  # noqa: ANN202
    """Batches of (group, fp), sorted by group, to star links (a, b)."""

    def links(group: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(x)))
        pairs = []
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        ends = np.repeat(starts + sizes, sizes)
        rows = np.flatnonzero(small)
        # Rows of small groups close ranks; their groups' ends move along.
        shift = np.cumsum(small)
        pairs += [(rows[a], rows[b]) for a, b in _stars_of_small(x[rows], shift[ends[rows] - 1], max_bits)]
        for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
            pairs += [(s + a, s + b) for a, b in _stars_of_large(x[s : s + n], max_bits)]
        pairs = [(a, b) for a, b in pairs if a != b]
        if pairs:
            a, b = np.array(pairs, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            group = np.concatenate([group, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(group):
                continue
            done = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if done:
                yield from links(group[:done], fp[:done])
                group, fp = group[done:], fp[done:]
        if len(group):
            yield from links(group, fp)

    return run


def near_links(fingerprints: DataFrame, max_bits: int = MAX_BITS, trees: int | None = None, levels: int | None = None) -> DataFrame:
    """Star links ``a, b`` that connect just what pairs of at most ``max_bits``
    differing bits among the distinct ``fp`` of ``fingerprints`` connect."""
    trees = max_bits + 1 if trees is None else trees
    # Without visits levels are free: so many that a shard is about one block value.
    levels = (9 if max_bits < trees else 3) if levels is None else levels
    rows = fingerprints.select("fp", F.explode(_shards(max_bits, trees, levels)).alias("at")).select("fp", "at.*")
    crowded = rows.groupBy("tree", "shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS)
    crowded = crowded.select("tree", "shard", F.ceil(2 * F.col("n") / SHARD_ROWS).alias("chunks"))
    rows = rows.join(written(crowded, "crowded"), ["tree", "shard"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    rows = rows.withColumn("own", own).withColumn(
        "cell",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")))),
    )
    # Equal hashes of different cells would only lead to comparisons that are not needed.
    rows = rows.select(F.xxhash64("tree", "shard", "cell.i", "cell.j").alias("cell"), "fp")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linker(max_bits), "a long, b long")


def _classes(rows: DataFrame, max_bits: int, trees: int | None) -> DataFrame:
    """``fp, root`` of all fingerprints of ``rows`` (columns ``fp`` and ``id``) that
    are shared or linked."""
    distinct = written(rows.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    found = components(near_links(distinct, max_bits, trees))
    roots = found.select(F.col("root").alias("fp")).distinct().withColumn("root", F.col("fp"))
    found = found.select(F.col("node").alias("fp"), "root").unionByName(roots)
    shared = distinct.where("n > 1").select("fp").join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return written(found.unionByName(shared).distinct(), "classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, trees: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    rows = written(fingerprinted(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "fingerprinted")
    classes = _classes(rows, max_bits, trees)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = classes.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(classes.join(ids, "root").select("fp", "component_id", F.lit(True).alias("known")), "components")
    return rows.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, trees: int | None = None) -> DataFrame:
    """One whole row of ``docs`` per component."""
    row, fp = fresh_names(docs.columns, "__s_row", "__s_fp")
    found = fingerprinted(docs.withColumn(row, F.monotonically_increasing_id()), fp, shingle)
    found = written(found, "fingerprinted")  # row numbers are fixed from here on
    rows = found.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.col(fp).alias("fp"))
    members = written(rows.join(_classes(rows, max_bits, trees), "fp").select("row", "id", "root"), "members")
    stays = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("first.row")
    leaves = written(members.select("row").join(stays, "row", "left_anti"), "leaving")
    return found.join(leaves.withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERY = LlmQuery(_run)
