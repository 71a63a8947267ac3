"""Secret scans (operator 8).

Three base patterns (assignment, access key, long hexadecimal run) and, beside
them, runs of key characters whose sliding windows have a high Shannon entropy
for their character class.  The entropy of the next window follows from counts
of one character that leaves and one that enters.  The parts of a run between
separators are judged by their own class besides the whole.  An allow-list takes out
the windows that meet what is random but no secret (UUIDs, placeholders).

Every text is scanned whole, in one pass over its runs of key characters: hex
and access matches of the least length lie inside such a run of 20 characters,
and assignments need a colon or an equals sign.

Defined results: a null text is an empty one (no span); every row of the input
gives one row, repeated ids too; an empty table gives an empty result.  ``redact``
keeps all columns, whatever their names, and changes ``text`` (and ``n_chars``
where there is one) only in rows with a span.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LlmQuery, table

KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"
WINDOW = 20
# Least entropy in bits a character of a window, by class of the run; a random
# window of 20 has about 3.4 (16 characters), 4.1 (62) and 4.1 (64).
LEAST_BITS = {"hex": 3.1, "alnum": 3.75, "base64": 3.85}

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ALLOW = re.compile(
    r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])"  # UUID
    r"|example|placeholder|lorem|x{4,}|0123456|abcdef"
)
# A slash or plus may belong to a base64 key: it parts only hexadecimal digits.
_PART, _HEX_PART = re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]+(?![A-Za-z0-9])")
_HEX_RUN, _ALNUM_RUN = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[A-Za-z0-9]+")
_BITS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def char_class(run: str) -> str:
    return "hex" if _HEX_RUN.fullmatch(run) else "alnum" if _ALNUM_RUN.fullmatch(run) else "base64"


def _high_windows(run: str, window: int, least: float) -> list[int]:
    """Starts of the windows of ``run`` with at least ``least`` bits, a letter and two digits."""
    counts: dict[str, int] = {}
    sums, digits, letters = 0.0, 0, 0
    out: list[int] = []
    bits = _BITS if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    for i, x in enumerate(run):
        if i >= window:
            y = run[i - window]
            c = counts[y]
            sums += bits[c - 1] - bits[c]
            counts[y] = c - 1
            digits -= y.isdigit()
            letters -= y.isalpha()
        c = counts.get(x, 0)
        sums += bits[c + 1] - bits[c]
        counts[x] = c + 1
        digits += x.isdigit()
        letters += x.isalpha()
        begin = i - window + 1
        if begin >= 0 and digits >= 2 and letters >= 1 and math.log2(window) - sums / window >= least:
            out.append(begin)
    return out


def entropy_spans(run: str, window: int = WINDOW, least_bits: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Unions of the windows of ``run`` with at least the entropy of the class of the
    run or of their part of it, a letter and two digits, that meet nothing on the allow-list."""
    if len(run) < window:
        return []
    limits = least_bits or LEAST_BITS
    parts = {(0, len(run))} | {m.span() for p in (_PART, _HEX_PART) for m in p.finditer(run) if m.end() - m.start() >= window}
    starts = {a + i for a, b in parts for i in _high_windows(run[a:b], window, limits[char_class(run[a:b])])}
    allowed = [m.span() for m in _ALLOW.finditer(run)] if starts else []
    out: list[tuple[int, int]] = []
    for begin in sorted(starts - {i for a, b in allowed for i in range(a - window + 1, b)}):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], begin + window)
        else:
            out.append((begin, begin + window))
    return out


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans of a text, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    added = []
    for run in _RUN.finditer(text):
        at, key = run.start(), run[0]
        found += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(key)]
        found += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(key)]
        added += [(at + a, 3, at + b) for a, b in entropy_spans(key)]
    # An added span goes where one base span holds it: of those that start before, the one that ends last.
    found.sort()
    starts, ends = [s for s, _, _ in found], list(accumulate((e for _, _, e in found), max))
    for a, k, b in added:
        i = bisect_right(starts, a)
        if not i or ends[i - 1] < b:
            found.append((a, k, b))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


_COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [find_spans(x or "") for x in batch.column(1).to_pylist()]
        base = [[x for x in r if x[1] != "entropy"] for r in rows]
        count = [pa.array([sum(x[1] == k for x in r) for r in base], pa.int64()) for k in KINDS[:3]]
        sha = [hashlib.sha256(_listed(r).encode()).hexdigest() for r in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *count, pa.array(sha, pa.string()), pa.array(map(_listed, rows), pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {_COLUMNS}")


def masked(text: str, spans: list[tuple[int, str, int]], mask: str = MASK) -> str:
    """``text`` with every union of overlapping spans replaced."""
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], mask]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mask``."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [masked(x, spans, mask) if x and (spans := find_spans(x)) else x for x in texts]
            columns = batch.columns
            if new != texts:
                columns[at] = pa.array(new, columns[at].type)
                if size >= 0:
                    changed = pa.array([a != b for a, b in zip(new, texts, strict=True)])
                    length = pa.array([len(x or "") for x in new]).cast(columns[size].type)
                    columns[size] = pc.if_else(changed, length, columns[size])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERY = LlmQuery(_run)
