"""Quality classifier: a generalised additive model with pairwise interactions (operator 3).

Every whole text becomes ``len(FEATURES)`` numbers.  On a bounded sample of
labelled training documents, boosting goes round the features in a cycle, each
time fitting a shallow tree (up to three leaves over one feature's ordered bins)
to the gradient and adding it to that feature's lookup table.  Pairs of
features that still explain the rest best then get two-dimensional tables in
the same way.  The score of a text is the logistic of a sum of table entries,
looked up for whole batches at once.

Defined results: a null text is an empty one and is scored; repeated rows and
ids give a row each; an empty table gives an empty result; without labels of
both classes every score is the share of label 1 (1 without any label).  Only
``doc_id`` and ``text`` are read, so other columns can neither clash nor leak.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LlmQuery, table
from .labelled import held_out, labelled_sample

THRESHOLD = 0.3
MAX_BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE, RIDGE = 0.15, 2.0

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "mark", "exclaim", "bar", "beyond_ascii",
    "space", "newline", "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "words_a_line", "long_words",
)


def _kind_of_bytes() -> np.ndarray:
    out = np.zeros((256, 9))
    groups = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>^~=@", ".,;:?\"'()-", "!", "|")
    for k, chars in enumerate(groups):
        out[[ord(c) for c in chars], k] = 1
    out[192:, 6] = 1  # first bytes of longer characters
    out[[32, 9], 7] = 1
    out[10, 8] = 1
    return out


_BYTES = _kind_of_bytes()


def features(text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    kinds = np.bincount(raw, minlength=256) @ _BYTES
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / m,
        *(kinds / n),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        pairs / max(len(words) - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        m / max(len(lines), 1),
        sum(c for w, c in counts.items() if len(w) > 20) / m,
    ]


# The order of ``kinds`` above.
assert len(FEATURES) == 3 + _BYTES.shape[1] + 6


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins with gradients ``g`` and weights ``h``."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree of up to three leaves."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = max(((*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:], strict=False)), default=(0.0, 0, 0))
        if best[0] <= 0:
            break
        cuts = sorted({*cuts, best[1] + best[2]})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the better of two trees: cut one feature, then
    each side by the other."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(gg.sum(1), hh.sum(1))
        out, gain = np.zeros(gg.shape), -(gg.sum() ** 2) / (hh.sum() + RIDGE)
        for side in (slice(0, at), slice(at, None)):
            sg, sh = gg[side].sum(0), hh[side].sum(0)
            _, cut = _best_cut(sg, sh)
            for part in (slice(0, cut), slice(cut, None)):
                gain += sg[part].sum() ** 2 / (sh[part].sum() + RIDGE)
                out[side, part] = sg[part].sum() / (sh[part].sum() + RIDGE)
        if gain > best[0]:
            best = (float(gain), out.T if turned else out)
    return best


@dataclass
class AdditiveModel:
    bias: float = 50.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.edges and len(x):
            b = self.bins(x)
            for k, t in enumerate(self.tables):
                z += t[b[:, k]]
            for i, j, t in self.pairs:
                z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.bias = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        points = np.linspace(0, 1, MAX_BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], points)) for k in range(x.shape[1])]
        b = self.bins(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(s) for s in sizes]
        z = np.full(len(y), self.bias)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k, size in enumerate(sizes):
                g, h = gradient()
                step = RATE * _tree(np.bincount(b[:, k], g, size), np.bincount(b[:, k], h, size))
                self.tables[k] += step
                z += step[b[:, k]]

        def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = b[:, i] * sizes[j] + b[:, j]
            g, h = gradient()
            shape = (sizes[i], sizes[j])
            return at, np.bincount(at, g, sizes[i] * sizes[j]).reshape(shape), np.bincount(at, h, sizes[i] * sizes[j]).reshape(shape)

        gains = sorted(((_pair_tree(*cells(i, j)[1:])[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in gains[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                at, g, h = cells(i, j)
                step = RATE * _pair_tree(g, h)[1]
                t += step
                z += step.ravel()[at]
        return self


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(x or "") for x in texts]).reshape(-1, len(FEATURES))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    sample = labelled_sample(docs, labels, "quality")
    rows = sample.select("text", "label").mapInArrow(_examples, "label int, x array<double>").collect()  # a bounded sample
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array([r["label"] for r in rows], dtype=float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERY = LlmQuery(_run)
