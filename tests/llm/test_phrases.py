"""Phrase mining against a plain count of all phrases, and the summaries' guarantee."""

import collections
import random
import re

import numpy as np
import pytest

from tidepool.llm import phrases as P

COLUMNS = "doc_id long, text string, lang string, phrase string, size int, n long"


def brute(rows, threshold, longest, top, percent):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        found = {w: a for w, a in own.items() if len(w) > 1 and a >= threshold}
        kept = []
        for w, a in found.items():
            if any(len(x) > len(w) and 100 * b >= percent * a and any(x[i : i + len(w)] == w for i in range(len(x))) for x, b in found.items()):
                continue
            score, _, le, r = min((1000 * a * n[lang] // (own[w[:k]] * own[w[k:]]), k, own[w[:k]], own[w[k:]]) for k in range(1, len(w)))
            kept.append((" ".join(w), a, le, r, n[lang], score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(kept[:top], 1)]
    return sorted(out)


def check(spark, rows, threshold=5, longest=5, top=2000, percent=100, partitions=4):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
    got = P.mine(docs, threshold, longest, top, percent).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = brute(rows, threshold, longest, top, percent)
    assert sorted(map(tuple, got)) == want
    return want


def _random(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "日本", "a'b", "\x1c", "\x00", "x\xa0y", "-", "zz", "\U0001f600"]
    out = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", "\x0b", "\r"]) for w in rng.choices(words, [20 / (k + 1) for k in range(12)], k=rng.randint(0, 60)))
        out.append((i, rng.choice([text] * 8 + [None, ""]), rng.choice(["en", "de", None, "und", ""]), "x", 1, 1))
    return out


@pytest.mark.parametrize("seed,percent", [(0, 100), (1, 60)])
def test_random_documents(spark, seed, percent):
    assert check(spark, _random(seed, 250), percent=percent, top=40)


def test_small_slices_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "_SLICE_CHARS", 50)
    monkeypatch.setattr(P, "PARTITION_MASS", 100)
    rows = _random(7, 150) + [(900, "again and again. " * 200 + "no mark " * 60, "en", "x", 1, 1), (901, "...,,," * 40, "en", "x", 1, 1)]
    assert check(spark, rows, threshold=4, longest=3)


def test_edges(spark, edge):
    assert check(spark, [(i, "to be or not to be, that is the question", "en", "x", 1, 1) for i in range(7)])
    assert check(spark, [(1, "ab ab " * 30_000 + "x" * 60_000, None, "x", 1, 1)] * 2, threshold=100)
    assert check(spark, [], threshold=1) == []
    assert check(spark, [(1, None, None, "x", 1, 1), (2, "", "en", "x", 1, 1), (3, " .\n", "en", "x", 1, 1)], threshold=1) == []
    assert P.mine(edge).count() >= 0


def test_hot_phrase_and_copies(spark):
    rows = [(i, "hot pair here, same line of text again and again" if i % 3 else f"w{i % 50} v{i % 9} hot pair", "en", "x", 1, 1) for i in range(900)]
    assert check(spark, rows, threshold=10, partitions=8)


@pytest.mark.parametrize("seed", range(3))
def test_summary_keeps_what_is_frequent(seed):
    """Capacity above mass / threshold: no hash with threshold occurrences is lost, however it is fed."""
    rng = np.random.default_rng(seed)
    stream = (rng.zipf(1.2, 40_000) % 9000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    threshold = 50
    s = P.Summary(len(stream) // threshold + 1)
    for part in np.array_split(stream, 300):
        s.add(*np.unique(part, return_counts=True))
        s.fold()
    hashes, counts = np.unique(stream, return_counts=True)
    frequent = set(hashes[counts >= threshold].tolist())
    assert 0 < s.taken < threshold and len(s.hashes) <= s.capacity
    assert frequent <= set(s.survivors(threshold).tolist())
    true = dict(zip(hashes.tolist(), counts.tolist()))
    assert all(c <= true[h] <= c + s.taken for h, c in zip(s.hashes.tolist(), s.counts.tolist()))


def test_scores_beyond_64_bits(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(60):
        a = rng.randrange(10**9, 10**12)
        le, r = a + rng.randrange(10**12), a + rng.randrange(10**12)
        n = 9 * 10**14 + i
        rows += [(f"l{i}", 0, "", n), (f"l{i}", 1, "x", le), (f"l{i}", 1, "y", r), (f"l{i}", 2, "x y", a)]
        want.append((f"l{i}", 1000 * a * n // (le * r)))
    got = P.rank_phrases(spark.createDataFrame(rows, "lang string, size int, phrase string, n long"), 10, 100)
    assert sorted((r["lang"], r["score"]) for r in got.collect()) == sorted(want)
