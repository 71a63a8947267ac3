"""Packing by concatenate and cut (operator 1).

All documents' token streams, in partition order, form one stream that is cut
into windows of ``length`` ids; only the very last sequence may be short.

Two passes.  The first tokenises every text once and writes, per document, its
ids, the task's partition number and the ids before it in that partition.  The
partition totals (a row per input partition) give every partition's global
offset by a prefix sum.  The second pass cuts: a document becomes one record per
window it touches, in place, with no shuffle.  The table between the passes is
committed once, so a lost executor cannot change an offset.

Defined results: a null text is an empty one and is still one piece (the end
id); a null ``doc_id`` stays null; repeated rows are packed once each; an empty
table gives no piece.  A document of any length is cut wherever windows end.
Columns beyond the two named ones are ignored, so none can clash.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LlmQuery, table, written

LENGTH = 2048
END_ID = 1
#: Unbroken runs beyond this many characters go to the slower encoder, whose
#: merging does not grow with the square of the run.
LONG_RUN = 5_000
_STAGED = "doc_id {id}, part int, before long, doc_tokens long, ids binary"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: a
    printable byte stands for itself, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids of the byte-level vocabulary in ``path``.  The same ids as the
    ``tokenizers`` library gives, from tiktoken's faster merging (see tests)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {x["content"] for x in spec.get("added_tokens", ())}
    ranks = {bytes(letters[x] for x in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        # an added token's text is that token, as the library takes it by default
        if any(x in text for x in special):
            return slow.encode(text, add_special_tokens=False).ids
        if len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _tokenise(path: str | None, end_id: int, id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path())
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [np.array([*encode(x or ""), end_id], dtype="<u4") for x in some.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).cast(id_type),
                        pa.array(np.full(len(n), part, dtype=np.int32)),
                        pa.array(starts),
                        pa.array(n),
                        pa.array([x.tobytes() for x in ids], type=pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"],
                )

    return run


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    end_id: int = END_ID,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset``
    and the piece's ``ids`` (little-endian unsigned 32-bit numbers)."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    run = _tokenise(path, end_id, to_arrow_type(kind))
    tokens = written(source.mapInArrow(run, _STAGED.format(id=kind.simpleString())), "packing")

    # A row per input partition: its offset in the whole stream.
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))

    first = F.col("shift") + F.col("before")
    spans = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", "doc_tokens", "ids", first.alias("first"), (first + F.col("doc_tokens")).alias("end")
    )

    def piece(window):  # noqa: ANN001, ANN202
        begin = F.greatest(F.col("first"), window * length)
        size = F.least(F.col("end"), (window + 1) * length) - begin
        start = begin - F.col("first")
        return F.struct(
            start.alias("start"),
            size.alias("length"),
            window.alias("sequence_id"),
            (begin - window * length).alias("offset"),
            F.substr(F.col("ids"), (4 * start + 1).cast("int"), (4 * size).cast("int")).alias("ids"),
        )

    windows = F.sequence(F.floor(F.col("first") / length), F.floor((F.col("end") - 1) / length))
    return spans.select("doc_id", "doc_tokens", F.inline(F.transform(windows, piece))).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


QUERY = LlmQuery(_run)
