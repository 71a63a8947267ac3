"""Main text of web pages with a host suffix array (operator 2).

1. Every page is read once, tag by tag, into blocks of text.  What stands in menus,
   headers, footers, sidebars, notices, adverts, forms, comments, scripts and
   the like (by element, role, or the whole names in class and id) is *chrome*; a class never
   takes away the main element, nor the only articles of a page; of the rest the
   article elements are the page's content, else the main element, else all.
2. The token streams of a host's pages, chrome and content, make up its suffix array:
   suffixes from every token, sorted by their first ``RUN`` tokens so that equal ones
   meet.  A longer run is a chain of overlapping ones, so what runs of any length cover
   is what those of ``RUN`` tokens cover.  Pages of the same content count once.
3. Of content that no article element marks, and of chrome, a run that begins suffixes of
   ``LEAST_PAGES`` distinct pages of the host is a long repeated substring; blocks of
   such content that repeated runs cover are boilerplate and go.  A page of nothing but
   repeats keeps its text.
4. In article elements text that some other pages repeat is a quotation, and an advert's line may
   be an article's own.  There a run is boilerplate if it stands in the articles of ``LEAST_PAGES``
   distinct pages of the host and of ``LEAST_SHARE`` of them; the token ranges such runs
   cover go, whatever the block's rest.  A page that they cover by more than ``MOST_CUT``
   is a copy of other pages and keeps its text.

Blocks of 3 are dealt out by (host, run), never by host, and counted before they meet,
so a host with a third of all pages is spread over all tasks.  Articles are dealt out in
ranges of (host, digest of the content) and sorted in groups of pages: a run of half
of a host's pages is one of half the pages of some group, so the groups' arrays
miss none.  What they find is then counted exactly, over all pages and by words.

Defined results: a null page or one without text gives the empty string; a null
url is a host of its own (empty name); every row gives one row, repeated ids too; an
empty table gives an empty result.  Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LlmQuery, table, written

RUN = 8
LEAST_PAGES = 3
LEAST_COVER = 0.9
# Of article elements: the share of a host's distinct pages, the part of a page that may go, and
# the distinct pages whose suffixes are sorted together (twice as many at the end of a host).
LEAST_SHARE = 0.5
MOST_CUT = 0.5
GROUP_PAGES = 64
GROUP_WORDS = 1 << 20

# Elements whose content is no markup and no text of the page.
_RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noembed noframes".split())
_CHROME = frozenset("nav footer aside form button select dialog menu header label fieldset".split())
_BLOCK = frozenset(
    """address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup
    option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words of class, id and role that tell chrome wherever they stand.
_CHROME_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
    menu submenu breadcrumb breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice notices popup modal
    overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies share sharing
    social related recommended recommendations pagination pager toolbar widget widgets skip search searchform
    contentinfo complementary alert form""".split()
)
# What may stand beside such a word in a name (ad-box, site-footer); any other word makes the name doubtful (has-sidebar).
_BESIDE = frozenset(
    """box block container wrapper wrap inner outer area list item items bar top bottom left right site page main global primary
    secondary links link buttons button section row column col slot unit panel content policy tools icons nav js""".split()
)
# Words that make chrome of an article, and of headings, paragraphs and other text elements; the rest of them is
# left to the repeat test there.
_ARTICLE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond".split())
_TEXT_WORDS = _ARTICLE_WORDS - {"comment", "comments", "reply", "replies", "respond"} | frozenset("cookie cookies gdpr share sharing".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dl dt dd td th figcaption summary address caption".split())
_PLAIN = frozenset("html body main".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOLD_BY = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _tells(name: str, words: frozenset[str]) -> bool:
    """Does a whole name of class, id or role consist of such words and what may stand beside them?"""
    parts = _WORDS.findall(name)
    return any(w in words for w in parts) and all(w in words or w in _CHROME_WORDS or w in _BESIDE for w in parts)


def _is_chrome(tag: str, attributes: str, in_article: bool) -> str:
    """"chrome" by element or hiding, "told" by the words of class, id or role, else empty."""
    if tag in _CHROME and not (tag == "header" and in_article):
        return "chrome"
    if not attributes or tag in _PLAIN or "=" not in attributes and "hidden" not in attributes:
        return ""
    words = _ARTICLE_WORDS if tag == "article" else _TEXT_WORDS if tag in _TEXT else _CHROME_WORDS if in_article else _CHROME_WORDS | {"header"}
    told = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _TOLD_BY:
            continue
        value = "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return "chrome"
        if name == "id" and (tag in _TEXT or tag in ("section", "article")):
            continue  # the place a link leads to
        if name in ("class", "id", "role") and any(_tells(x, words) for x in value.split()):
            told = "told"
    return told


@dataclass
class _Open:
    tag: str
    kind: str  # "", "chrome", "told" (chrome by its class), "article", "main", "header" (an article's)


@dataclass
class PageBlocks:
    """(zone, text) of a page's blocks in order; zones: article, main, open, chrome, held
    (an article within what its class tells to be chrome) and remark (an article told to be a comment or advert).
    The last two are content only of a page that has no better."""

    blocks: list[tuple[str, str]] = field(default_factory=list)

    def content(self) -> tuple[str, list[str]]:
        for zone in ("article", "main", "held", "open", "remark"):
            if found := [t for z, t in self.blocks if z == zone]:
                return "article" if zone in ("held", "remark") else zone, found
        return "open", []

    def chrome(self) -> list[str]:
        return [t for z, t in self.blocks if z in ("chrome", "remark")]


def read_page(source: str) -> PageBlocks:
    out, stack, text = PageBlocks(), [], []
    # Where in the stack elements of each kind, of each tag, block elements and headings stand.
    kinds: dict[str, list[int]] = {k: [] for k in ("chrome", "told", "article", "main", "header")}
    tags: dict[str, list[int]] = {}
    block_at: list[int] = []
    heading_at: list[int] = []

    def zone() -> str:
        if kinds["chrome"]:
            return "chrome"
        if kinds["told"]:
            last = kinds["told"][-1]
            held = kinds["article"] and kinds["article"][-1] >= last
            return "held" if held else "remark" if stack[last].tag == "article" else "chrome"
        if kinds["header"] and not heading_at:
            return "chrome"
        return "article" if kinds["article"] else "main" if kinds["main"] else "open"

    def flush() -> None:
        if text:
            if words := entities.unescape("".join(text)).split():
                out.blocks.append((zone(), " ".join(words)))
            text.clear()

    def places(o: _Open) -> list[list[int]]:
        found = [tags.setdefault(o.tag, [])]
        if o.kind in kinds:
            found.append(kinds[o.kind])
        if o.tag in _BLOCK:
            found.append(block_at)
        if o.tag in _HEADINGS:
            found.append(heading_at)
        return found

    def close(k: int) -> None:
        while len(stack) > k:
            for at_ in places(stack.pop()):
                at_.pop()

    def no_block_above(k: int) -> bool:
        return not block_at or block_at[-1] <= k

    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            text.append(source[at:])
            break
        if lt > at:
            text.append(source[at:lt])
        if source.startswith("<!--", lt):
            at = source.find("-->", lt + 4)
            at = end if at < 0 else at + 3
            continue
        closing = source.startswith("/", lt + 1)
        name = _NAME.match(source, lt + 1 + closing)
        if name is None:
            if source.startswith(("!", "?", "/"), lt + 1):  # declaration or a stray end
                at = source.find(">", lt)
                at = end if at < 0 else at + 1
            else:  # a bare sign
                text.append("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        rest = _REST.match(source, name.end())
        at = rest.end() if rest else source.find(">", name.end()) + 1 or end
        attributes = source[name.end() : at - 1]
        if closing:
            if tag in _BLOCK:
                flush()
            k = tags[tag][-1] if tags.get(tag) else -1
            if k >= 0:
                if tag not in _BLOCK and stack[k].kind:
                    flush()
                # An inline end does not close the blocks around it.
                if tag in _BLOCK or no_block_above(k):
                    close(k)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = end if stop is None else source.find(">", stop.end()) + 1 or end
            continue
        if tag in _BLOCK:
            flush()
            if stack and stack[-1].tag == "p" or any(o.tag == "p" for o in stack[-3:]):  # a block ends an open paragraph
                k = tags["p"][-1]
                if no_block_above(k) and tag != "br":
                    close(k)
            if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1].tag == tag:
                close(len(stack) - 1)
        if tag in _VOID or attributes.endswith("/"):
            continue
        chrome = _is_chrome(tag, attributes, bool(kinds["article"]))
        kind = chrome if chrome else tag if tag in ("article", "main") else "header" if tag == "header" else ""
        if not kind and "role" in attributes and re.search(r"role\s*=\s*[\"']?main", attributes):
            kind = "main"
        if kind == "main":  # what holds the main element is no chrome for its class
            for i in kinds["told"]:
                stack[i].kind = ""
            kinds["told"].clear()
        if kind and tag not in _BLOCK:
            flush()
        if kind or tag in _BLOCK or tag in _HEADINGS:
            stack.append(_Open(tag, kind))
            for at_ in places(stack[-1]):
                at_.append(len(stack) - 1)
    flush()
    return out


def run_hash(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(tokens), 0) - (1 << 63)


def suffix_runs(blocks: list[str]) -> list[tuple[int, int]]:
    """(run, block) of the suffixes the page's chrome or content outside of articles puts in its host's
    array: the first ``RUN`` tokens from every place of a block, or the whole of a
    shorter block.  Article elements put in theirs by ``word_codes`` (see ``article_runs``)."""
    out = []
    for k, block in enumerate(blocks):
        tokens = block.split(" ")
        if len(tokens) <= RUN:
            out.append((run_hash([*tokens, "\n"]), k))
        else:
            out += [(run_hash(tokens[i : i + RUN]), k) for i in range(len(tokens) - RUN + 1)]
    return out


def word_codes(blocks: list[str], known: dict[str, int]) -> np.ndarray:
    """The words as 16-bit codes, each block ended by 0.  Words may share a code: the
    arrays of codes only propose runs, ``common_in`` compares words."""
    out = []
    for block in blocks:
        for word in block.split(" "):
            code = known.get(word)
            if code is None:
                if len(known) >= 200_000:
                    known.clear()
                code = known[word] = 1 + xxhash.xxh64_intdigest(word, 0) % 0xFFFF
            out.append(code)
        out.append(0)
    return np.array(out, "<u2")


def run_starts(codes: np.ndarray) -> np.ndarray:
    """Places with ``RUN`` words before their block ends."""
    ends = np.flatnonzero(codes == 0)
    places = np.arange(len(codes))
    return places[ends[np.searchsorted(ends, places)] - places >= RUN]


def code_runs(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for the ``RUN`` codes from each place."""
    out = np.zeros(len(places), np.uint64)
    for k in range(RUN):
        out = (out ^ codes[places + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shared_runs(pages: list[np.ndarray], least: int) -> np.ndarray:
    """Runs (``code_runs``) of at least ``least`` of the pages, by the sorted suffixes of all of
    them: prefix doubling up to ``RUN`` words, then the stretches of equal ones."""
    codes = np.concatenate(pages)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    rank, width = codes.astype(np.int64), 1
    while width < RUN:
        step = min(width, RUN - width)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1]
        width += step
    places = run_starts(codes)
    if not len(places):
        return np.zeros(0, np.int64)
    places = places[np.argsort(rank[places], kind="stable")]  # the suffix array; equal ones by page
    new_run = np.diff(rank[places], prepend=-1) != 0
    new_page = new_run | (np.diff(page[places], prepend=-1) != 0)
    first = np.flatnonzero(new_run)
    return code_runs(codes, places[first[np.add.reduceat(new_page.astype(np.int64), first) >= least]])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in _slices(batches):
        words = [word_codes(b, known).tobytes() for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["host", "digest", "words"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, run: the common runs of groups of a host's pages; rows come by host and digest."""
    host, digest = None, None
    whole = False  # no page of the host was in the task before or in a group before
    group: list[np.ndarray] = []

    def runs(pages: list[np.ndarray], all_pages: bool) -> pa.RecordBatch:
        least = max(int(np.ceil(LEAST_SHARE * len(pages))), LEAST_PAGES if all_pages else 1)
        found = shared_runs(pages, least) if len(pages) >= least else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found)], names=["host", "run"])

    for batch in batches:
        for h, d, w in zip(*(c.to_pylist() for c in batch.columns)):
            if h != host:
                if group:
                    yield runs(group, whole)
                whole = host is not None
                host, digest, group = h, None, []
            if d == digest:
                continue
            if len(group) >= 2 * GROUP_PAGES or len(group) > 1 and sum(map(len, group)) >= 2 * GROUP_WORDS:
                half = len(group) // 2
                yield runs(group[:half], False)
                group, whole = group[half:], False
            digest = d
            group.append(np.frombuffer(w, "<u2"))
    if group:
        yield runs(group, False)


def common_in(blocks: list[str], proposed: np.ndarray, known: dict[str, int]) -> set[int]:
    """``run_hash`` of the page's runs that are among the proposed ones."""
    codes = word_codes(blocks, known)
    places = run_starts(codes)
    places = places[np.isin(code_runs(codes, places), proposed)]
    words = [w for block in blocks for w in (*block.split(" "), "")]
    return {run_hash(words[i : i + RUN]) for i in places.tolist()}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            yield whole.slice(first, 1000)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in _slices(batches):
        hosts, digests, out = [], [], []
        for host, digest, blocks, proposed in zip(*(c.to_pylist() for c in batch.columns)):
            found = common_in(blocks, np.array(proposed, np.int64), known)
            hosts += [host] * len(found)
            digests += [digest] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(out, pa.int64())], names=["host", "digest", "run"]
        )


def cut_runs(blocks: list[str], runs: set[int]) -> list[str]:
    """The blocks without the token ranges that the runs cover; all of them if that is over ``MOST_CUT``."""
    kept, total, left = [], 0, 0
    for block in blocks:
        words = block.split(" ")
        end, rest = 0, []
        for i, word in enumerate(words):
            if i + RUN <= len(words) and run_hash(words[i : i + RUN]) in runs:
                end = i + RUN
            if i >= end:
                rest.append(word)
        total += len(words)
        left += len(rest)
        if rest:
            kept.append(" ".join(rest))
    return blocks if total - left > MOST_CUT * total else kept


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        *others, blocks, drop = batch.columns
        if drop.null_count < batch.num_rows:
            kept = [cut_runs(b, set(r)) if r else b for b, r in zip(blocks.to_pylist(), drop.to_pylist())]
            blocks = pa.array(kept, blocks.type)
        yield pa.RecordBatch.from_arrays([*others, blocks], names=[*batch.schema.names[:-2], "kept"])


def _host(url: str | None) -> str:
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", (url or "").strip().lower())
    return found[1] if found else ""


_PARSED = "row long, page_id {id}, url string, host string, zone string, digest long, blocks array<string>, runs array<struct<run:long,block:int>>, chrome array<long>, first boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    pair = pa.list_(pa.struct([("run", pa.int64()), ("block", pa.int32())]))
    sent: set[tuple[str, int, str]] = set()  # the same content goes into the host's array once a task

    def first_of(host: str, digest: int, zone: str) -> bool:
        size = len(sent)
        sent.add((host, digest, zone))
        return len(sent) > size

    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            urls = batch.column(1).to_pylist()
            pages = [read_page(x or "") for x in batch.column(2).to_pylist()]
            content = [p.content() for p in pages]
            hosts = [_host(x) for x in urls]
            digests = [run_hash(b) for _, b in content]
            runs = [[{"run": r, "block": k} for r, k in suffix_runs(b)] if z != "article" else [] for z, b in content]
            chrome = [sorted({r for r, _ in suffix_runs(p.chrome())}) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(urls)), pa.int64()),
                    batch.column(0),
                    batch.column(1),
                    pa.array(hosts, pa.string()),
                    pa.array([z for z, _ in content], pa.string()),
                    pa.array(digests, pa.int64()),
                    pa.array([b for _, b in content], pa.list_(pa.string())),
                    pa.array(runs, pair),
                    pa.array(chrome, pa.list_(pa.int64())),
                    pa.array(map(first_of, hosts, digests, [z for z, _ in content]), pa.bool_()),
                ],
                names=["row", "page_id", "url", "host", "zone", "digest", "blocks", "runs", "chrome", "first"],
            )
            row += len(urls)


def article_runs(parsed: DataFrame) -> DataFrame:
    """``host, drop``: the runs that are boilerplate in the host's articles."""
    articles = parsed.where((F.col("zone") == "article") & F.col("first"))
    # Coded again by the sampling of the ranges: written with the pages, codes took the disk over its budget.
    dealt = articles.select("host", "digest", "blocks").mapInArrow(_encode, "host string, digest long, words binary")
    dealt = dealt.repartitionByRange("host", "digest")
    proposed = dealt.sortWithinPartitions("host", "digest").mapInArrow(_propose, "host string, run long")
    proposed = written(proposed.groupBy("host").agg(F.collect_set("run").alias("proposed")), "proposed")
    # The same content may come from several tasks.
    found = articles.select("host", "digest", "blocks").join(proposed, "host").mapInArrow(_count, "host string, digest long, run long")
    found = found.distinct().groupBy("host", "run").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    sizes = articles.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("of"))
    common = found.join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("of"))
    return written(common.groupBy("host").agg(F.collect_list("run").alias("drop")), "common")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_removed`` of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = written(pages.select("page_id", "url", "html").mapInArrow(_parse, _PARSED.format(id=kind)), "pages", "zstd")
    # Which runs do the host's pages repeat?  First one row per run and distinct content, then counts.
    is_open = F.col("zone") != "article"
    as_open = parsed.where(is_open).select("host", "digest", F.explode(F.array_distinct("runs.run")).alias("run"))
    as_chrome = parsed.select("host", "digest", F.explode("chrome").alias("run"))
    seen = as_open.unionByName(as_chrome).groupBy("host", "run", "digest").agg(F.lit(1).alias("one"))
    repeated = seen.groupBy("host", "run").agg(F.sum("one").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    repeated = written(repeated.select("host", "run"), "runs")
    # Suffixes that begin with such a run mark their blocks.
    suffixes = parsed.where(is_open).select("row", "host", F.inline("runs"))
    # The runs grow with the corpus: never broadcast, however small their compressed files look.
    marks = suffixes.join(repeated.hint("merge"), ["host", "run"]).select("row", "block", "run").distinct()
    marks = marks.groupBy("row", "block").agg(F.count("*").alias("n"))
    marks = marks.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("marks"))
    rows = parsed.where(is_open).join(marks, "row", "left")
    # Distinct runs of a block, marked against all.
    own = lambda k: F.size(F.array_distinct(F.transform(F.filter("runs", lambda r: r["block"] == k), lambda r: r["run"])))
    kept = F.filter(
        F.col("blocks"),
        lambda b, k: F.coalesce(F.element_at(F.col("marks"), k), F.lit(0)) < LEAST_COVER * F.greatest(own(k), F.lit(1)),
    )
    rows = rows.withColumn("kept", F.when(F.col("marks").isNull(), F.col("blocks")).otherwise(kept))
    rows = rows.withColumn("kept", F.when(F.size("kept") == 0, F.col("blocks")).otherwise(F.col("kept")))
    rows = rows.select("page_id", "url", F.size("blocks").alias("n_blocks"), "kept")
    # Spark moves the articles only if the hosts' runs are too many to broadcast.
    articles = parsed.where(~is_open).join(article_runs(parsed), "host", "left")
    articles = articles.select("page_id", "url", F.size("blocks").alias("n_blocks"), "blocks", "drop")
    rows = rows.unionByName(articles.mapInArrow(_cut, f"page_id {kind}, url string, n_blocks int, kept array<string>"))
    rows = rows.withColumn("text", F.array_join("kept", " "))
    return rows.select(
        "page_id",
        "url",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        "n_blocks",
        (F.col("n_blocks") - F.size("kept")).alias("n_removed"),
    )


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERY = LlmQuery(_run)
