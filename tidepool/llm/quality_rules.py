"""Quality rules by distribution divergence (operator 9, DataFrame functions only).

Two histograms of every document are held against references per language:
character classes (lower case, upper case, digits, ...) and the language's
common words.  The distance is Jensen-Shannon's (square root of the
divergence, logarithm to base 2, so 0 to 1).  The references are the mean
histograms of all distinct texts of the language, one for each ``lang``; they are
joined to the rows.  So that no hot group of copies moves its reference, texts
count once that have the smallest or the largest hash of their windows in common:
copies and most near copies do, other texts only where they share that passage.
Counts and histograms are taken once and written; means and verdicts read them.

Guards: a distance counts from a least number of words on, and its limit is
``floor + noise / sqrt(words)``: a sample of few words lies farther from its own
language's reference by chance alone, by about one over the square root.
Beside them stand the base rules (too short, too many repeated windows).

Defined results: a null text is an empty one (no words, base rule fails); a null
``lang`` is an empty one; a ``lang`` without a word list is judged by character
classes only; one without a reference has the distance 0; every
input row gives one result row, repeated rows and ids too; an empty table gives
an empty result.  Columns beyond ``doc_id``, ``text`` and ``lang`` are ignored;
helper columns never clash (they are prefixed until free).  Windows are
compared by a 64-bit hash of eight 64-bit word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, LlmQuery, fresh_names, table, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or from at an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus ce il ne se".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o si".split(),
}

#: Character classes besides white space and what is left over (letters
#: beyond ASCII, in the main); each is taken out of the text in turn.
CLASSES = (
    ("lower", LOWER),
    ("space", WS),
    ("upper", LOWER.upper()),
    ("digit", "0123456789"),
    ("stop", ".,"),
    ("symbol", SYMBOLS),
    ("mark", "!\"'()+-/:;=?@[\\]^_`{}~"),
)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Of each distance: least words, floor and noise of its limit.
CHARS_LIMIT = (20, 0.14, 1.2)
COMMON_LIMIT = (40, 0.12, 2.4)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_ALPHABET = ".ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    )


class _Rules:
    """Builds the helper columns under names that are free in ``docs``."""

    HELPERS = (
        ["text", "lang", "words", "n", "list", "marks"]
        + [f"left{i}" for i in range(len(CLASSES) + 1)]
        + ["short", "classes", "common", "classes_sum", "common_sum", "hashes", "pairs", "rep", "pos", "lines"]
        + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        + ["least", "most", "ref_lang", "ref_classes", "ref_common", "chars_distance", "common_distance", "kept"]
    )

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        self.names = dict(zip(self.HELPERS, fresh_names(docs.columns, *(f"__q_{h}" for h in self.HELPERS)), strict=True))

    def c(self, name: str) -> Column:
        return F.col(self.names[name])

    def add(self, df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({self.names[k]: v for k, v in columns.items()})

    def histograms(self) -> DataFrame:
        """``classes`` (counts per character class) and ``common`` (counts per
        common word, then the other words) of every document."""
        c, df = self.c, self.docs
        lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
        df = self.add(df, text=F.coalesce(F.col("text"), F.lit("")), lang=lang)
        df = self.add(df, words=_words(c("text")), left0=c("text"))
        for i, (_, chars) in enumerate(CLASSES):
            df = self.add(df, **{f"left{i + 1}": F.translate(c(f"left{i}"), chars, "")})
        lists = F.array().cast("array<string>")
        for name, words in COMMON_WORDS.items():
            lists = F.when(c("lang") == name, F.array(*map(F.lit, words))).otherwise(lists)
        df = self.add(df, n=F.size(c("words")), list=lists)
        # Longer words than any in a list need no look-up.
        longest = max(len(w.encode()) for words in COMMON_WORDS.values() for w in words)
        df = self.add(df, short=F.when(F.size(c("list")) > 0, F.filter(c("words"), lambda w: F.octet_length(w) <= longest)))
        # One letter per short word: its place in the language's list, a dot for any other.
        df = self.add(
            df,
            marks=F.coalesce(
                F.array_join(
                    F.transform(
                        c("short"),
                        lambda w: F.substr(F.lit(_ALPHABET), (F.array_position(c("list"), w) + 1).cast("int"), F.lit(1)),
                    ),
                    "",
                ),
                F.lit(""),
            ),
        )
        sizes = [F.length(c(f"left{i}")) for i in range(len(CLASSES) + 1)]
        letters = _ALPHABET[: max(map(len, COMMON_WORDS.values())) + 1]
        count = [F.length(c("marks")) - F.length(F.replace(c("marks"), F.lit(x), F.lit(""))) for x in letters]
        count[0] += F.coalesce(c("n") - F.size(c("short")), F.lit(0))
        df = self.add(
            df,
            classes=F.array(*[sizes[i] - sizes[i + 1] for i in range(len(CLASSES))], sizes[-1]),
            common=F.array(*count),
        )
        # Own columns: a sum inside the terms below would be taken anew for each of them.
        return self.add(df, **{f"{name}_sum": self._whole(name) for name in ("classes", "common")})

    def _whole(self, name: str) -> Column:
        return F.greatest(F.aggregate(self.c(name), F.lit(0), lambda a, x: a + x), F.lit(1))

    def references(self, counted: DataFrame) -> DataFrame:
        """Mean histograms per language over the distinct texts with a word."""
        c, names = self.c, self.names
        sizes = {"classes": len(CLASSES) + 1, "common": max(map(len, COMMON_WORDS.values())) + 1}
        bins = [(name, i) for name, size in sizes.items() for i in range(size)]
        shares = [(F.get(c(name), F.lit(i)) / c(f"{name}_sum")).alias(f"{name}{i}") for name, i in bins]
        df = counted.where(c("n") > 0).select(c("lang").alias("lang"), c("least").alias("least"), c("most").alias("most"), *shares)
        for keys, rest in ((["lang", "least"], [F.min("most").alias("most")]), (["lang", "most"], []), (["lang"], [])):
            df = df.groupBy(*keys).agg(*rest, F.count("*").alias("n"), *[F.sum(f"{name}{i}").alias(f"{name}{i}") for name, i in bins])
            df = df.select(*keys, *(["most"] if rest else []), *[(F.col(f"{name}{i}") / F.col("n")).alias(f"{name}{i}") for name, i in bins])
        means = {name: F.array(*[F.col(f"{name}{i}") for i in range(size)]) for name, size in sizes.items()}
        return df.select(F.col("lang").alias(names["ref_lang"]), *[m.alias(names[f"ref_{name}"]) for name, m in means.items()])

    def _distance(self, counts: str) -> Column:
        c = self.c
        reference = F.coalesce(c(f"ref_{counts}"), F.array().cast("array<double>"))

        def term(x: Column, q: Column) -> Column:
            p = x / c(f"{counts}_sum")
            m = (p + q) / 2
            half = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
            return (half(p) + half(q)) / 2

        terms = F.zip_with(c(counts), reference, term)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))))

    def counted(self) -> DataFrame:
        """Histograms, base counts and the ends of the sorted window hashes of every document."""
        c = self.c
        df = self.histograms()
        df = self.add(df, hashes=F.transform(c("words"), lambda w: F.xxhash64(w)))
        window = F.transform(
            F.sequence(F.lit(0), c("n") - WINDOW), lambda i: F.xxhash64(*[F.get(c("hashes"), i + k) for k in range(WINDOW)])
        )
        none = F.array().cast("array<bigint>")
        df = self.add(df, hashes=F.when(c("n") >= WINDOW, window).otherwise(none))
        # Shorter texts have no window: their copies meet by the whole text.
        ends = {"least": F.array_min(c("hashes")), "most": F.array_max(c("hashes"))}
        df = self.add(df, **{k: F.coalesce(v, F.xxhash64(c("text"))) for k, v in ends.items()})
        repeats = F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes"))
        pairs = F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        df = self.add(df, pairs=F.when(repeats, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
        df = self.add(
            df,
            rep=F.filter(
                c("pairs"),
                lambda p, i: ((i > 0) & (p["h"] == F.get(c("pairs"), i - 1)["h"])) | (p["h"] == F.get(c("pairs"), i + 1)["h"]),
            ),
        )
        df = self.add(df, pos=F.sort_array(F.transform(c("rep"), lambda p: p["i"])))
        # A window adds what the one before it (8 words or fewer away) has not covered.
        new = F.transform(
            c("pos"), lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(c("pos"), i - 1)))
        )
        lines = F.filter(F.split(c("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
        df = self.add(df, lines=lines)
        at = [name for name, _ in CLASSES]
        df = self.add(
            df,
            n_words=c("n").cast("long"),
            word_chars=(F.length(c("text")) - F.get(c("classes"), F.lit(at.index("space")))).cast("long"),
            n_symbols=F.get(c("classes"), F.lit(at.index("symbol"))).cast("long"),
            n_dup_lines=(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            n_repeat_words=F.aggregate(new, F.lit(0), lambda a, x: a + x).cast("long"),
        )
        return self.add(
            df, base_failed=(c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
        )

    def kept_counts(self, columns: list[str]) -> DataFrame:
        """``columns`` of ``docs`` and what the later steps need, written once."""
        held = ["lang", "n", "classes", "common", "classes_sum", "common_sum", "least", "most", *COUNTS]
        return written(self.counted().select(*columns, *[self.names[x] for x in held]), "quality")

    def judged(
        self,
        columns: list[str],
        refs: dict[str, tuple[list[float], list[float]]] | None = None,
        chars_limit: tuple[int, float, float] = CHARS_LIMIT,
        common_limit: tuple[int, float, float] = COMMON_LIMIT,
    ) -> DataFrame:
        """``columns`` of ``docs`` with the base counts, both distances and ``kept``."""
        c, df = self.c, self.kept_counts(columns)
        if refs is None:
            means = written(self.references(df), "references")
        else:
            rows = [(lang, list(map(float, a)), list(map(float, b))) for lang, (a, b) in refs.items()]
            schema = "{} string, {} array<double>, {} array<double>".format(*(self.names[f"ref_{x}"] for x in ("lang", "classes", "common")))
            means = self.docs.sparkSession.createDataFrame(rows, schema)
        df = df.join(means, c("lang") == c("ref_lang"), "left")
        listed = c("lang").isin(*COMMON_WORDS)
        df = self.add(
            df,
            chars_distance=self._distance("classes"),
            common_distance=F.when(listed, self._distance("common")).otherwise(F.lit(0.0)),
        )

        def odd(distance: str, least: int, floor: float, noise: float) -> Column:
            return (c("n") >= least) & (c(distance) > floor + noise / F.sqrt(F.greatest(c("n"), F.lit(1))))

        failed = c("base_failed") | odd("chars_distance", *chars_limit) | odd("common_distance", *common_limit)
        # A filter on a plain column is pushed below the projections it is made of, and every
        # name in it is replaced by its expression on the way, which multiplies a plan of this
        # depth without end.  It does not pass a row number.
        return self.add(df, kept=~failed & (F.monotonically_increasing_id() >= 0))


def language_references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean character-class and common-word histograms per language of ``docs``."""
    rules = _Rules(docs)
    rows = rules.references(rules.kept_counts([])).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def quality_report(docs: DataFrame, references: dict | None = None, **limits: tuple[int, float, float]) -> DataFrame:
    """One row per document: base counts, both distances, the verdict ``kept``."""
    rules = _Rules(docs)
    out = [*COUNTS, "kept", "chars_distance", "common_distance"]
    return rules.judged(["doc_id"], references, **limits).select("doc_id", *[rules.c(x).alias(x) for x in out])


def keep_by_rules(docs: DataFrame, references: dict | None = None, **limits: tuple[int, float, float]) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came."""
    rules = _Rules(docs)
    return rules.judged(docs.columns, references, **limits).where(rules.c("kept")).select(*docs.columns)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


QUERY = LlmQuery(_run)
