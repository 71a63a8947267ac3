"""The suffix tree against a plain version that holds everything in dictionaries."""

import collections
import math
import random
import zlib

import pytest

from tidepool.llm import suffix_tree


def _fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


class _Plain:
    """Contexts as tuples of words, oldest first; all by the module's formulas."""

    def __init__(self, texts, max_depth, least_frequent):
        self.uni, self.next = collections.Counter(), collections.defaultdict(collections.Counter)
        for text in texts:
            tokens = suffix_tree.tokens_of(text)
            self.uni.update(tokens)
            for i, w in enumerate(tokens):
                for d in range(1, min(max_depth, i) + 1):
                    self.next[tuple(tokens[i - d : i])][w] += 1
        self.total, self.max_depth = sum(self.uni.values()), max_depth
        self.often = {w for w, n in self.uni.items() if n >= least_frequent * self.total}
        asked = sum(2 ** int(math.log2(n)) for w, n in self.uni.items() if w not in self.often) + 0.1
        self.unit = (1 - sum(self.base(w) for w in self.often)) / asked
        self.retained = {}
        self.candidates = collections.Counter()
        for context in sorted(self.next, key=len):
            shorter = [context[i:] for i in range(1, len(context))]
            if any(sum(self.next[s].values()) < 2 or len(self.next[s]) < 2 for s in shorter):
                continue  # a shorter one was not lengthened
            self._test(context)

    def root(self, w):
        if w in self.often:
            return self.base(w)
        return self.unit * (2 ** int(math.log2(self.uni[w])) if w in self.uni else 0.1)

    def base(self, w):
        return (self.uni[w] + 0.1) / (self.total + 0.1 * (len(self.uni) + 1))

    def p(self, context, w, root):
        """Probability in the longest retained suffix of ``context``."""
        for i in range(len(context)):
            if context[i:] in self.retained:
                own, over = self.retained[context[i:]]
                return own.get(w, 0.0) + over * self.p(context[i + 1 :], w, root)
        return root

    def _test(self, context):
        c = sum(self.next[context].values())
        self.candidates[len(context)] += c >= 2
        often = {w: n for w, n in self.next[context].items() if n >= 2}
        if not often:
            return
        low = {w: self.p(context[1:], w, self.root(w)) for w in often}
        rest, rest_p = c - sum(often.values()), min(max(1 - sum(low.values()), 1e-12), 1)
        gain = 2 * sum(n * math.log(n / (c * low[w])) for w, n in often.items())
        gain += 2 * rest * math.log(rest / (c * rest_p)) if rest else 0
        f = len(often)
        if gain - f > 3 * math.sqrt(2 * f) and (gain - f) / (2 * c) >= 0.01:
            self.retained[context] = ({w: (n - 0.5) / c for w, n in often.items()}, (rest + 0.5 * f) / c)

    def score(self, text):
        tokens = suffix_tree.tokens_of(text)
        return sum(math.log10(self.p(tuple(tokens[max(0, i - self.max_depth) : i]), w, self.root(w))) for i, w in enumerate(tokens))


def _texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(200):
        text, w = [], 0
        for _ in range(rng.randrange(0, 60)):
            w = (w * 7 + 3) % 60 if rng.random() < 0.5 else int(60 * rng.random() ** 3)
            text.append(words[w])
        texts.append(" ".join(text))
    return [*texts, *texts[:20], texts[1], "same " * 300, "only here twice in all texts " + "rareword", "only here twice in all texts rareword", "", None]


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"bucket_mass": 300},  # many buckets, spread words
        {"bucket_mass": 300, "least_frequent": 0.01},  # most words are rare
        {"max_depth": 1, "least_frequent": 0.01},
        {"max_depth": 5, "bucket_mass": 2000},
    ],
)
def test_scores_and_retention_against_plain_version(spark, options):
    rows = list(enumerate(_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    root = suffix_tree.fit_root(docs, **options)
    grown = suffix_tree.grow(docs, root)
    plain = _Plain([t or "" for i, t in rows if _fold(i)], root.max_depth, options.get("least_frequent", suffix_tree.LEAST_FREQUENT))
    got = {r["doc_id"]: r for r in suffix_tree.score_in(grown, root).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(plain.score(t or ""), abs=1e-8), (i, t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10(plain.base(w)) for w in suffix_tree.tokens_of(t or "")), abs=1e-8)
    if root.buckets == 1:
        sizes = {r["depth"]: (r["candidates"], r["retained"]) for r in suffix_tree.tree_size(grown).collect()}
        kept = collections.Counter(map(len, plain.retained))
        assert {d: s for d, s in sizes.items() if s[0]} == {d: (n, kept[d]) for d, n in plain.candidates.items() if n}
    elif "least_frequent" not in options:
        assert (root.counts > root.heavy).any() == (options["bucket_mass"] == 300)
    # After any context the words and the unseen one share a probability of 1.
    for context in [(), *list(plain.retained)[::9]]:
        assert sum(plain.p(context, w, plain.root(w)) for w in [*plain.uni, b"?"]) == pytest.approx(1)


def test_base_counts(spark, edge, sample):
    for docs in (edge.select("doc_id", "text", "score"), sample):
        got = suffix_tree.score(docs).collect()
        rows = docs.select("doc_id", "text").collect()
        c = collections.Counter()
        for i, t in rows:
            if _fold(i):
                c.update(suffix_tree.tokens_of(t or ""))
        total, distinct = sum(c.values()), len(c)
        want = []
        for i, t in rows:
            tokens = suffix_tree.tokens_of(t or "")
            base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
            want.append((str(i), len(tokens), sum(c[w] > 0 for w in tokens), total, round(base, 4)))
        assert sorted((str(r["doc_id"]), *tuple(r)[2:5], round(r["base_score"], 4)) for r in got) == sorted(want)


def test_repeated_rows_and_text_ids(spark):
    rows = [("a", "x y x y z"), ("a", "x y x y z"), (None, "x y"), ("b", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = suffix_tree.score(docs).collect()
    assert len(got) == 12 and len({round(r["score"], 9) for r in got if r["doc_id"] == "a"}) == 1


def test_no_training_text(spark):
    held = [i for i in range(100) if _fold(i) == 0]
    docs = spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in suffix_tree.score(docs).collect()} == {(0, 0, 0.0, 0.0)}


def test_learns_context(spark):
    rng = random.Random(0)
    texts = [" ".join("ab cd" if rng.random() < 0.5 else "ef gh" for _ in range(60)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = suffix_tree.score(docs).where("held_out").toPandas()
    assert (r.score > 0.7 * r.base_score).all()  # about one bit a pair instead of two a word


def test_grows_with_the_corpus(spark):
    few, many = (
        {r["depth"]: r["retained"] for r in suffix_tree.tree_size(suffix_tree.grow(d, suffix_tree.fit_root(d))).collect()}
        for d in (spark.read.parquet(f"/root/testdata/sf{s}/documents.parquet") for s in ("0.001", "0.01"))
    )
    assert all(many[d] > 4 * few[d] for d in (1, 2))


def test_spread_words_follow_their_share(spark, monkeypatch):
    """The same words are spread in a corpus five times as large, so what is sent ahead of them grows with it."""
    monkeypatch.setattr(suffix_tree, "SPREAD_LEAST", 20)
    texts = [f"the w{i % 97 * 5} of w{i % 89} the w{i % 83}" for i in range(300)]
    spread = []
    for times in (1, 5):
        docs = spark.createDataFrame(list(enumerate(texts * times)), "doc_id long, text string")
        root = suffix_tree.fit_root(docs)
        spread.append(root.hashes[root.counts > root.heavy].tolist())
    assert spread[0] == spread[1] and set(suffix_tree._hash([b"the", b"of"]).tolist()) <= set(spread[0])
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = _Plain([t for i, t in rows if _fold(i)], suffix_tree.MAX_DEPTH, suffix_tree.LEAST_FREQUENT)
    for r in suffix_tree.score(docs, bucket_mass=400).collect():
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), abs=1e-8)
