"""A bounded sample of labelled documents, for the operators that fit a classifier.

Only label rows whose crc32(doc_id as text) modulo 5 is not 0 take part (the
others are held out).  ``max_rows`` of them, in the order of a hash of the id,
are joined to their texts; of near copies with one label the smallest id stays, so
that a large group of copies cannot pass its words off as evidence.  Near copies
agree in ``LEAST_AGREEMENT`` of the minimum hashes of their word shingles, which
estimates the share of shingles they have in common; so does a copy of a near copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, written

FOLDS = 5
MAX_LABELLED_ROWS = 20_000
SHINGLE = 3
MINIMA = 128
BAND = 4
LEAST_AGREEMENT = 0.8
_CHUNK = 2048
_RANDOM = np.random.default_rng(7)
_TIMES = _RANDOM.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def held_out(column: str = "doc_id"):  # noqa: ANN201
    return id_remainder(column, FOLDS) == 0


def minima(text: str) -> np.ndarray:
    """The least of ``MINIMA`` hashes over the text's word shingles (a shorter text is one)."""
    words = text.encode().split()
    shingles = {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
    out = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), _CHUNK):
        mixed = (hashes[i : i + _CHUNK, None] * _TIMES + _PLUS) >> np.uint64(32)
        out = np.minimum(out, mixed.min(0).astype(np.uint32))
    return out


def copies(marks: np.ndarray) -> np.ndarray:
    """Which rows of ``marks`` are near copies of an earlier one, directly or by others."""
    parent = np.arange(len(marks))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Texts alike in 0.8 of their shingles share one of the bands all but surely.
    for k in range(0, MINIMA, BAND):
        _, band = np.unique(marks[:, k : k + BAND], axis=0, return_inverse=True)
        order = np.argsort(band.ravel(), kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(band.ravel()[order])) + 1):
            while len(rows) > 1:
                alike = (marks[rows] == marks[rows[0]]).mean(1) >= LEAST_AGREEMENT
                for i in rows[alike]:
                    a, b = root(int(rows[0])), root(int(i))
                    parent[max(a, b)] = min(a, b)
                rows = rows[~alike]
    return parent != np.arange(len(marks))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [minima(x).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.binary())], names=["doc_id", "label", "marks"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_LABELLED_ROWS) -> DataFrame:
    """``doc_id, text, label`` of at most ``max_rows`` training documents.

    Null ids and labels other than 0 and 1 are left out; several labels of one id
    count as their largest, several texts of one id as the smallest."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most max_rows ids and numbers: small enough to broadcast whatever the table holds.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    texts = written(texts, "labelled")
    # At most max_rows ids with MINIMA numbers each.
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(_marked, f"doc_id {kind}, label int, marks binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return texts
    marks = np.frombuffer(b"".join(found.column("marks").to_pylist()), np.uint32).reshape(-1, MINIMA)
    labelled = found.column("label").to_numpy()
    gone = np.zeros(len(marks), bool)
    for value in (0, 1):
        gone[labelled == value] = copies(marks[labelled == value])
    if not gone.any():
        return texts
    left = found.select(["doc_id"]).filter(pa.array(~gone))
    return texts.join(F.broadcast(texts.sparkSession.createDataFrame(left)), "doc_id").select("doc_id", "text", "label")
