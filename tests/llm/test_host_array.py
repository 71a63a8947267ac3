"""The host suffix array over article elements (operator 2), against plain counts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidepool.llm import pages

SCHEMA = "page_id long, url string, html string"
LINE = "Sign up today for the weekly letter of this great house"


def words(rng, n, kinds=40_000):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def article(*blocks):
    return "<nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def plain(rows):
    """page_id -> text of pages that are ``(page_id, host, blocks)``."""
    content = {i: (h, b) for i, h, b in rows}
    runs_of = lambda b: {tuple(x.split()[i : i + pages.RUN]) for x in b for i in range(len(x.split()) - pages.RUN + 1)}
    distinct = defaultdict(dict)
    for h, b in content.values():
        distinct[h][" ".join(b)] = runs_of(b)
    common = {}
    for h, found in distinct.items():
        counts = Counter(r for x in found.values() for r in x)
        common[h] = {r for r, n in counts.items() if n >= max(pages.LEAST_PAGES, pages.LEAST_SHARE * len(found))}
    out = {}
    for i, (h, b) in content.items():
        kept, left, total = [], 0, 0
        for x in b:
            w = x.split()
            gone = {k + d for k in range(len(w) - pages.RUN + 1) if tuple(w[k : k + pages.RUN]) in common[h] for d in range(pages.RUN)}
            kept += [y for k, y in enumerate(w) if k not in gone]
            left, total = left + len(w) - len(gone), total + len(w)
        out[i] = " ".join(b) if total - left > pages.MOST_CUT * total else " ".join(kept)
    return out


def test_repeat_inside_articles_goes_and_the_rest_stays(spark):
    rng = random.Random(1)
    own = {i: (words(rng, 20), words(rng, 20)) for i in range(8)}
    rows = [(i, f"http://h.x/{i}", article(f"{LINE} {a}", b)) for i, (a, b) in own.items()]
    assert texts(spark, rows) == {i: f"{a} {b}" for i, (a, b) in own.items()}


def test_quotations_and_copies_in_articles_stay(spark):
    rng = random.Random(2)
    quoted = {i: [words(rng, 40), *([LINE] if i < 3 else [])] for i in range(8)}
    whole = words(rng, 60)
    copies = {i: [f"{whole} {words(rng, 5)}"] for i in range(20, 26)}
    rows = [(i, f"http://q.x/{i}", article(*b)) for i, b in quoted.items()] + [(i, f"http://c.x/{i}", article(*b)) for i, b in copies.items()]
    # A page put up ten times counts once; an advert's line makes no run of an article.
    rows += [(40 + i, f"http://d.x/{i}", article(f"{LINE} {whole}")) for i in range(10)]
    rows += [(60 + i, f"http://a.x/{i}", f"<div class='ad'>{LINE}</div>" + article(words(random.Random(60 + i), 30), *([LINE] if i == 0 else []))) for i in range(6)]
    got = texts(spark, rows)
    want = {i: " ".join(b) for i, b in (quoted | copies).items()} | {40 + i: f"{LINE} {whole}" for i in range(10)}
    want |= {60 + i: words(random.Random(60 + i), 30) + (f" {LINE}" if i == 0 else "") for i in range(6)}
    assert got == want


def test_same_content_in_and_out_of_articles(spark):
    rng = random.Random(6)
    own = [words(rng, 40) for _ in range(4)]
    rows = [(i, "http://s.x/", f"<p>{LINE} {x}</p>") for i, x in enumerate(own)] + [(10 + i, "http://s.x/", article(f"{LINE} {x}")) for i, x in enumerate(own)]
    # Outside of articles only whole blocks go.
    assert texts(spark, rows) == {i: f"{LINE} {x}" for i, x in enumerate(own)} | {10 + i: x for i, x in enumerate(own)}


def test_articles_equal_a_plain_count(spark):
    rng = random.Random(3)
    lines = [words(rng, n) for n in (7, 8, 9, 14, 30)]
    rows = []
    for host, n, share in (("big", 500, 0.55), ("half", 40, 0.5), ("few", 3, 1.0), ("two", 2, 1.0), ("", 5, 0.8)):
        for _ in range(n):
            blocks = [words(rng, rng.randrange(1, 40)) for _ in range(3)]
            blocks = [" ".join(x for x in (b, *(y for y in lines if rng.random() < share / 2), words(rng, 3)) if x) for b in blocks]
            rows += [(len(rows), host, blocks)] * rng.choice((1, 1, 1, 2))
    rows = [(i, h, b) for i, (_, h, b) in enumerate(rows)]
    got = texts(spark, [(i, f"http://{h}.x/{i}" if h else None, article(*b)) for i, h, b in rows])
    want = plain(rows)
    assert got == want
    assert sum(want[i] != " ".join(b) for i, _, b in rows) > 100


def test_sorted_suffixes_equal_a_plain_count():
    rng = random.Random(4)
    known = {}
    for kinds in (2, 3, 50):
        found = [pages.word_codes([words(rng, rng.randrange(1, 30), kinds) for _ in range(3)], known) for _ in range(30)]
        for least in (1, 3, 15):
            counts = Counter()
            for codes in found:
                counts.update({tuple(codes[i : i + pages.RUN]) for i in range(len(codes)) if len(c := codes[i : i + pages.RUN]) == pages.RUN and c.all()})
            want = [np.array(r, "<u2") for r, n in counts.items() if n >= least]
            want = {int(pages.code_runs(r, np.array([0]))[0]) for r in want}
            got = pages.shared_runs(found, least).tolist()
            assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_groups_of_a_host_miss_no_common_run(monkeypatch, batch):
    monkeypatch.setattr(pages, "GROUP_PAGES", 4)
    rng = random.Random(5)
    known, rows = {}, []
    lines = [words(rng, 12) for _ in range(6)]
    for host, n in (("a", 1), ("b", 30), ("c", 3), ("d", 2), ("e", 9)):
        for d in range(n):
            codes = pages.word_codes([words(rng, 10), *(x for x in lines if rng.random() < 0.6)], known)
            rows += [(host, d, codes)] * rng.choice((1, 2))
    cut = [rows[i : i + batch] for i in range(0, len(rows), batch)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in ([r[0] for r in c], [r[1] for r in c], [r[2].tobytes() for r in c])], names=["host", "digest", "words"]) for c in cut]
    got = defaultdict(set)
    for b in pages._propose(iter(batches)):
        for h, r in zip(*(c.to_pylist() for c in b.columns)):
            got[h].add(r)
    for host in "abcde":
        found = list({d: codes for h, d, codes in rows if h == host}.values())
        exact = pages.shared_runs(found, max(pages.LEAST_PAGES, -(-len(found) // 2)))
        assert set(exact.tolist()) <= got[host]
    assert not got["d"] and len(got["b"]) < 200
