"""Toxicity by weak supervision (operator 7).

1. *Lexicon*: word stems (whole words, prefixes of 4 to 8 letters) whose document
   counts in a bounded sample of training labels speak for a toxic text.
2. *Voters*: the stems, dealt out over lexicon voters, and pattern voters (hit
   density, shouting, exclamation).  A document's votes are a bit mask.
3. *Label model*: a generative model of votes given the hidden class.  Each
   class has its own tree of voter-voter dependencies (the pairs of largest
   mutual information), so accuracies and correlations are estimated together, by
   expectation maximisation over the counts of all masks of ALL documents.
   There are at most ``2 ** (LEXICON_VOTERS + 3)`` masks, however many documents.
   The sample's own documents are held to their labels.
4. *Linear classifier*: logistic regression over stem counts, trained on the
   label model's posteriors of the sample, scores every whole text.

Defined results: a null text is an empty one and is scored; repeated rows and
ids give a row each; an empty table gives an empty result; without labels (or
without telling stems) every score is the low prior.  Only ``doc_id`` and
``text`` are read; ``lang``, ``source`` and other columns never matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LlmQuery, table
from .labelled import held_out, labelled_sample

PREFIXES = (4, 5, 6, 7, 8)
MAX_STEMS = 600
LEAST_DOCUMENTS = 5
LEAST_EVIDENCE = 10.0
LEXICON_VOTERS = 8
VOTERS = LEXICON_VOTERS + 3
THRESHOLD = 0.5

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = str.maketrans(_PUNCTUATION, " " * len(_PUNCTUATION))


def words_of(text: str) -> list[str]:
    return text.lower().translate(_TO_SPACE).split()


def stems_of(word: str) -> list[str]:
    """The whole word (marked ``=``) and its proper prefixes."""
    return [f"={word}", *[word[:k] for k in PREFIXES if len(word) > k]]


@dataclass
class Voters:
    """Lexicon and pattern voters; ``stems`` maps a stem to its number."""

    stems: dict[str, int]
    heads: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.heads = {s.removeprefix("=")[:4] for s in self.stems}

    def hits(self, words: list[str]) -> Counter:
        """Number of distinct words per stem."""
        out: Counter = Counter()
        heads, stems = self.heads, self.stems
        for w in {w for w in words if w[:4] in heads}:
            out.update(k for s in stems_of(w) if (k := stems.get(s)) is not None)
        return out

    def votes(self, text: str) -> tuple[int, Counter]:
        """Bit mask of the voters that speak for toxic, and the stem hits."""
        words = words_of(text)
        hits = self.hits(words)
        mask = 0
        for k in hits:
            mask |= 1 << k % LEXICON_VOTERS
        if 50 * len(hits) >= len(words) > 0:
            mask |= 1 << LEXICON_VOTERS
        letters = np.frombuffer(text.encode(), dtype=np.uint8)
        if 2 * np.count_nonzero((letters >= 65) & (letters <= 90)) > len(letters):
            mask |= 2 << LEXICON_VOTERS
        if 50 * text.count("!") > len(words):
            mask |= 4 << LEXICON_VOTERS
        return mask, hits


class LabelModel:
    """Class-conditional trees over the votes, fitted by expectation maximisation."""

    def __init__(self, voters: int = VOTERS, rounds: int = 25, prior: float = 0.05) -> None:
        self.voters, self.rounds, self.prior = voters, rounds, prior
        self.trees: list[list[tuple[int, int, np.ndarray]]] = [[], []]

    @staticmethod
    def _tree(bits: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(voter, parent or -1, log table [parent's vote][vote]) in parent-first order."""
        m = bits.shape[1]
        smooth, total = 0.5, weight.sum() + 2.0
        on = (weight @ bits + 2 * smooth) / total
        both = (bits.T @ (bits * weight[:, None]) + smooth) / total
        gain = np.zeros((m, m))
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (on if a else 1 - on), (on if b else 1 - on)
                joint = both if a and b else (on[:, None] - both if a else (on[None, :] - both if b else 1 - on[:, None] - on[None, :] + both))
                joint = np.clip(joint, 1e-9, 1)
                gain += joint * np.log(joint / (pa_[:, None] * pb[None, :]))
        out = [(0, -1, np.log(np.array([[1 - on[0], on[0]]] * 2)))]
        inside, rest = [0], set(range(1, m))
        while rest:
            parent, child = max(((p, c) for p in inside for c in rest), key=lambda x: (gain[x], -x[0], -x[1]))
            given1 = np.clip(both[parent, child] / on[parent], 1e-6, 1 - 1e-6)
            given0 = np.clip((on[child] - both[parent, child]) / (1 - on[parent]), 1e-6, 1 - 1e-6)
            out.append((child, parent, np.log(np.array([[1 - given0, given0], [1 - given1, given1]]))))
            inside.append(child)
            rest.discard(child)
        return out

    def _bits(self, masks: np.ndarray) -> np.ndarray:
        return ((masks[:, None] >> np.arange(self.voters)) & 1).astype(float)

    def _log_likelihood(self, bits: np.ndarray, klass: int) -> np.ndarray:
        out = np.zeros(len(bits))
        which = bits.astype(int)
        for child, parent, log in self.trees[klass]:
            above = which[:, parent] if parent >= 0 else 0
            out += log[above, which[:, child]]
        return out

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """P(toxic | votes); the prior if the model could not be fitted."""
        if not self.trees[1]:
            return np.full(len(masks), self.prior)
        bits = self._bits(masks)
        odds = math.log(self.prior / (1 - self.prior)) + self._log_likelihood(bits, 1) - self._log_likelihood(bits, 0)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def fit(self, masks: np.ndarray, counts: np.ndarray, known: np.ndarray, labels: np.ndarray) -> LabelModel:
        """``masks`` with their ``counts`` over all documents; ``known`` masks with ``labels``."""
        if not len(masks) or not (labels == 1).any() or not (labels == 0).any():
            return self
        self.prior = float(np.clip(labels.mean(), 0.001, 0.5))
        bits, sure = self._bits(masks), self._bits(known)
        # The labelled rows weigh as much as all others together: they fix what the hidden class means.
        weight = counts / counts.sum()
        each = np.full(len(known), 1 / len(known))
        scale = float(counts.sum())
        toxic = np.clip(bits[:, :LEXICON_VOTERS].sum(1), 0, 1) * 0.9 + 0.02
        for _ in range(self.rounds):
            rows = np.vstack([bits, sure])
            for klass, (soft, hard) in enumerate(((1 - toxic, 1 - labels), (toxic, labels))):
                self.trees[klass] = self._tree(rows, scale * np.concatenate([weight * soft, each * hard]))
            self.prior = float(np.clip((weight @ toxic + labels.mean()) / 2, 1e-4, 0.9))
            toxic = self.posterior(masks)
        return self


@dataclass
class ToxicModel:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        hits = self.voters.hits(words_of(text))
        z = self.bias + sum(self.weights[k] * math.log1p(n) for k, n in hits.items())
        return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic and other documents with it) of each batch of (text, label)."""
    for batch in batches:
        sides = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sides[label].update({s for w in set(words_of(text)) if len(w) <= 30 for s in stems_of(w)})
        stems = list(sides[0].keys() | sides[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.string()), *[pa.array([side[s] for s in stems], pa.int64()) for side in sides]],
            names=["stem", "other", "toxic"],
        )


def _lexicon(sample: DataFrame) -> dict[str, int]:
    """At most ``MAX_STEMS`` telling stems, most telling first."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t, o = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not o:
        return {}
    counts = sample.select("text", "label").mapInArrow(_stem_counts, "stem string, other long, toxic long")
    counts = counts.groupBy("stem").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    odds = F.log(((F.col("toxic") + 0.5) / (t + 1)) / ((F.col("other") + 0.5) / (o + 1)))
    counts = counts.withColumn("evidence", odds * F.sqrt("toxic"))
    telling = (F.col("toxic") >= LEAST_DOCUMENTS) & (odds > math.log(20)) & (F.col("evidence") >= LEAST_EVIDENCE)
    rows = counts.where(telling).orderBy(F.desc("evidence"), "stem").limit(MAX_STEMS).collect()
    return {r["stem"]: k for k, r in enumerate(rows)}


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum on soft labels."""
    w, b, vw, vb = np.zeros(x.shape[1]), -2.0, 0.0, 0.0
    scale = 4 / max(1.0, float((x**2).sum(1).mean()))
    # Both classes weigh the same, so that a rare class moves its features.
    p1 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    each = np.where(y >= 0.5, 0.5 / p1, 0.5 / (1 - p1))
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y) * each / len(y)
        vw, vb = 0.9 * vw - scale * (x.T @ g + ridge * w), 0.9 * vb - scale * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    sample = labelled_sample(docs, labels, "toxic")
    voters = Voters(_lexicon(sample))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(voters.votes(x or "")[0] for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], names=["mask", "n"])

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [voters.votes(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([m for m, _ in rows], pa.int32()),
                    pa.array([list(h.keys()) for _, h in rows], pa.list_(pa.int32())),
                    pa.array([list(h.values()) for _, h in rows], pa.list_(pa.int32())),
                ],
                names=["label", "mask", "stems", "times"],
            )

    everywhere = docs.select("text").mapInArrow(masks, "mask int, n long").groupBy("mask").agg(F.sum("n").alias("n"))
    seen = sorted((r["mask"], r["n"]) for r in everywhere.collect())  # at most 2 ** VOTERS rows
    rows = sample.select("text", "label").mapInArrow(examples, "label int, mask int, stems array<int>, times array<int>").collect()
    known = np.array([r["mask"] for r in rows], dtype=np.int64)
    model = LabelModel().fit(
        np.array([m for m, _ in seen], dtype=np.int64),
        np.array([n for _, n in seen], dtype=float),
        known,
        np.array([r["label"] for r in rows], dtype=float),
    )
    x = np.zeros((len(rows), len(voters.stems)))
    for i, r in enumerate(rows):
        x[i, r["stems"]] = np.log1p(r["times"])
    if not rows or not voters.stems:
        return ToxicModel(voters, model, np.zeros(len(voters.stems)), math.log(model.prior / (1 - model.prior)))
    weights, bias = _logistic(x, model.posterior(known))
    return ToxicModel(voters, model, weights, bias)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs`` that do not score as toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(x or "") < THRESHOLD for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERY = LlmQuery(_run)
