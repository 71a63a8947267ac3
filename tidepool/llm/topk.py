"""Exact top-k search on a bit-sliced index (operator 5).

Vectors are quantised to integers and dealt out in blocks of rows.  A block's index
holds, per dimension, the ``SLICES`` highest bits of each row's offset from the block's
least value, a bitmap over the rows per bit, and the exact vectors.

A set of queries meets a block at once.  Bitmaps of a dimension (complemented
where the query's weight is negative) are added, shifted by each set bit of the weight,
with carry-save adders; the result is a bit-sliced sum per query.  Going down from
its most significant slice gives the k-th highest sum; what the dropped low bits
could add is known exactly, so all rows that may still be among the k best follow
from one bit-sliced comparison, and their integer inner products decide.

All queries meet all blocks as cells of a grid (query blocks times row blocks,
both of bounded size), not as pairs of rows, and each cell returns at most k
rows a query.

Defined results: a vector that is null, empty, or holds a null or a component that is
not finite takes no part, neither does a null id; candidates of another dimension
than the query are not its candidates; ties go to the smaller id; repeated rows
are candidates (and queries) of their own, a row is never its own candidate; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LlmQuery, table, written

K, EVERY, SCALE = 5, 50, 256
SLICES = 6
BLOCK_ROWS, QUERY_ROWS = 1024, 512
_BLOCK = "block int, dim int, rows binary, ids binary, vectors binary, least binary, low_bits int, slices binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, vector`` (whole numbers) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~bad)
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def index_block(x: np.ndarray, slices: int = SLICES) -> tuple[np.ndarray, int, np.ndarray]:
    """Least values, dropped low bits, and bitmaps [dimension][bit] over the rows."""
    least = x.min(0)
    offset = x - least
    bits = max(1, int(offset.max()).bit_length())
    low = max(0, bits - slices)
    n = bits - low
    words = -(-len(x) // 64)
    maps = np.zeros((x.shape[1], n, words), dtype=np.uint64)
    for b in range(n):
        on = np.zeros((x.shape[1], words * 64), dtype=np.uint8)
        on[:, : len(x)] = ((offset >> (low + b)) & 1).T
        maps[:, b] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)
    return least, low, maps


def sliced_sums(queries: np.ndarray, maps: np.ndarray) -> list[np.ndarray]:
    """Bit slices (least significant first) of, for every query and row, the sum over
    dimensions of |weight| times the row's sliced offset, or its complement
    where the weight is negative."""
    weight, negative = np.abs(queries), np.where(queries < 0, ~np.uint64(0), np.uint64(0))
    pending: dict[int, list[np.ndarray]] = {}

    def add(place: int, bitmap: np.ndarray) -> None:
        while True:
            at = pending.setdefault(place, [])
            at.append(bitmap)
            if len(at) < 3:
                return
            a, b, c = at
            half = a ^ b
            pending[place] = [half ^ c]
            place, bitmap = place + 1, (a & b) | (half & c)

    for d in range(queries.shape[1]):
        top = int(weight[:, d].max()).bit_length()
        masks = [np.where((weight[:, d] >> t) & 1, ~np.uint64(0), np.uint64(0))[:, None] for t in range(top)]
        for b in range(maps.shape[1]):
            base = maps[d, b][None, :] ^ negative[:, d][:, None]
            for t, mask in enumerate(masks):
                add(b + t, base & mask)
    out, carry, place = [], None, 0
    zero = np.zeros((len(queries), maps.shape[2]), dtype=np.uint64)
    while place <= max(pending, default=-1) or carry is not None:
        parts = pending.get(place, []) + ([carry] if carry is not None else [])
        a, b, c = [*parts, zero, zero, zero][:3]
        half = a ^ b
        out.append(half ^ c)
        carry = (a & b) | (half & c) if len(parts) > 1 else None
        place += 1
    return out or [zero]


def candidates(sums: list[np.ndarray], valid: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is at least the k-th highest less ``slack``."""
    count = lambda m: np.bitwise_count(m).sum(1, dtype=np.int64)
    above, equal = np.zeros_like(valid), valid.copy()
    kth = np.zeros(len(valid), dtype=np.int64)
    for p in range(len(sums) - 1, -1, -1):
        on = equal & sums[p]
        enough = count(above | on) >= k
        kth |= enough.astype(np.int64) << p
        above = np.where(enough[:, None], above, above | on)
        equal = np.where(enough[:, None], on, equal & ~sums[p])
    least = np.maximum(kth - slack, 0)
    more, equal = np.zeros_like(valid), valid.copy()
    for p in range(len(sums) - 1, -1, -1):
        set_ = ((least >> p) & 1).astype(bool)[:, None]
        more = np.where(set_, more, more | (equal & sums[p]))
        equal = np.where(set_, equal & sums[p], equal & ~sums[p])
    return more | equal


def search_block(
    queries: np.ndarray, query_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, index: tuple, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, candidate ids, scores), best first, at most k a query."""
    least, low, maps = index
    valid = np.zeros((len(queries), maps.shape[2]), dtype=np.uint64)
    full = np.zeros(maps.shape[2] * 64, dtype=np.uint8)
    full[: len(x)] = 1
    valid[:] = np.packbits(full, bitorder="little").view(np.uint64)
    place = {int(r): i for i, r in enumerate(rows)}
    for q, r in enumerate(query_rows):
        if (i := place.get(int(r))) is not None:
            valid[q, i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
    # The dropped bits add at most this much, in units of the sliced sums.
    slack = (np.abs(queries).sum(1) * ((1 << low) - 1)) >> low
    found = candidates(sliced_sums(queries, maps), valid, k, slack)
    for q in range(len(queries)):
        at = np.flatnonzero(np.unpackbits(found[q].view(np.uint8), bitorder="little"))
        if len(at):
            scores = x[at] @ queries[q]
            best = np.lexsort((ids[at], -scores))[:k]
            yield q, ids[at[best]], scores[best]


def _build(slices: int):  # noqa: ANN202
    def build(t: pa.Table) -> pa.Table:
        x = np.array(t.column("vector").to_pylist(), dtype=np.int64)
        least, low, maps = index_block(x, slices)
        row = {
            "block": t.column("block")[0].as_py(),
            "dim": x.shape[1],
            "rows": t.column("row").to_numpy().astype(np.int64).tobytes(),
            "ids": t.column("vec_id").to_numpy().astype(np.int64).tobytes(),
            "vectors": x.tobytes(),
            "least": least.tobytes(),
            "low_bits": low,
            "slices": maps.tobytes(),
        }
        kinds = [("block", pa.int32()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("least", pa.binary()), ("low_bits", pa.int32()), ("slices", pa.binary())]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    return build


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS, slices: int = SLICES) -> tuple[DataFrame, int]:
    """The index of all ``rows`` (a row per block and dimension) and its number of blocks."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vector"))
    return written(dealt.groupBy("block", "dim").applyInArrow(_build(slices), _BLOCK), "slices"), blocks


def _search(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                dim = cell["dim"]
                numbers = lambda name, kind=np.int64, c=cell: np.frombuffer(c[name], dtype=kind)
                queries, x = numbers("q_vectors").reshape(-1, dim), numbers("vectors").reshape(-1, dim)
                q_rows, q_ids = numbers("q_rows"), numbers("q_ids")
                words = -(-len(x) // 64)
                index = numbers("least"), cell["low_bits"], numbers("slices", np.uint64).reshape(dim, -1, words)
                out: list[list] = [[], [], [], []]
                for q, ids, scores in search_block(queries, q_rows, x, numbers("rows"), numbers("ids"), index, k):
                    for column, values in zip(out, ([q_rows[q]] * len(ids), [q_ids[q]] * len(ids), ids, scores), strict=True):
                        column += list(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["q_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of
    every row for which ``queries`` holds, among all other rows."""
    rows = written(quantised(vectors, scale), "quantised")
    index, blocks = build_index(rows, block_rows)
    asked = rows.where(queries)
    sets = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("set", F.pmod(F.xxhash64("row"), F.lit(sets)).cast("int")).withColumn("dim", F.size("vector"))

    def gather(t: pa.Table) -> pa.Table:
        x = np.array(t.column("vector").to_pylist(), dtype=np.int64)
        row = {"set": t.column("set")[0].as_py(), "dim": x.shape[1], "q_vectors": x.tobytes()}
        row |= {"q_rows": t.column("row").to_numpy().astype(np.int64).tobytes(), "q_ids": t.column("vec_id").to_numpy().astype(np.int64).tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("set", pa.int32()), ("dim", pa.int32()), ("q_vectors", pa.binary()), ("q_rows", pa.binary()), ("q_ids", pa.binary())]))

    asked = asked.groupBy("set", "dim").applyInArrow(gather, "set int, dim int, q_vectors binary, q_rows binary, q_ids binary")
    # The queries (a small part of the rows) go to the blocks: the index is dealt once, and each
    # block meets the query sets one after another.
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = index.join(right.hint("shuffle_merge"), ["block", "dim"])
    found = cells.mapInArrow(_search(k), "q_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: floor({SCALE}.0 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % {EVERY} = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERY = LlmQuery(_run, SQL)
