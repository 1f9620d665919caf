"""Quality rules by distribution divergence.

Two histograms describe a text: of its characters by class, and of its common words (each of the lists below, and
one place for all other words). The references are histograms of each listed language, from all its documents that pass
the base rules. A text's divergence is the smallest Jensen-Shannon distance (base 2, so
0 to 1) to a reference or, where that is over the limit, to a mix of two, as a text may be in two languages. Short texts stray from their language by chance, so the limit falls with the root of the
words, and below a number of words a test does not judge at all.

Only built-in functions run. One scan counts everything a text needs and writes it; the references are one small
aggregate of that table, and the verdict is a projection of it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import written

#: Common words by language (fixed values).
COMMON = {
    "en": "the of and to in is that for it was on are as with be by at this from or",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un une du est que dans qui par pour sur pas au plus",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
WORDS = sorted({w for x in COMMON.values() for w in x.split()})
SPACE = r"[\x20\x09-\x0D]"
#: Classes of the characters left after the classes before them.
CLASSES = ["[a-z]", "[A-Z]", "[0-9]", "[.,;:]", "[!?]", "[#*$%&|<>]", r"[\x21-\x7e]"]
SYMBOLS = CLASSES.index("[#*$%&|<>]")
#: How much of the first language a mix of two references has.
SHARES = (0.25, 0.5, 0.75)
MIN_WORDS = 50
MAX_REPEATED = 50
CHARACTER_WORDS, CHARACTER_LIMIT, CHARACTER_NOISE = 50, 0.10, 1.6
STEPS = 4096
WORD_WORDS, WORD_LIMIT, WORD_NOISE = 100, 0.14, 2.4


def _windows(w: Column) -> Column:
    """The 3-word windows of a word array with their place, in order of their words."""
    n = F.size(w)
    z = F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"),
                     F.sequence(F.lit(0), n - 1).alias("at"))
    return F.when(n >= 3, F.sort_array(F.slice(z, 1, n - 2))).otherwise(F.slice(F.arrays_zip(
        w.alias("a"), w.alias("b"), w.alias("c"), F.transform(w, lambda _: F.lit(0)).alias("at")), 1, 0))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the two histograms
    ``chars`` and ``common`` as shares."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    inner = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner != "", F.split(inner, f"{SPACE}+")).otherwise(F.array().cast("array<string>"))
    df = df.select("doc_id", "lang", "text", words.alias("w"),
                   F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                   F.regexp_replace("text", f"{SPACE}+", "").alias("left0"))
    for i, kind in enumerate(CLASSES):
        df = df.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", f"{kind}+", ""))
    left = [F.length(f"left{i}") for i in range(len(CLASSES) + 1)]
    known = F.filter(F.col("w"), lambda x: F.lower(x).isin(WORDS))
    df = df.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), left[0].cast("long").alias("word_chars"),
        (left[SYMBOLS] - left[SYMBOLS + 1]).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(F.length("text") - left[0], *(a - b for a, b in zip(left, left[1:])), left[-1]).alias("chars"),
        F.transform(known, lambda x: F.array_position(F.array(*map(F.lit, WORDS)), F.lower(x)).cast("int")).alias("found"),
        _windows(F.col("w")).alias("sorted"))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    s = F.col("sorted")
    twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
                     | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
    df = df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "chars",
        F.size("found").alias("n_common"), "found", F.sort_array(F.transform(twice, lambda x: x["at"])).alias("starts"))
    at = F.col("starts")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3))),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    found = F.col("found")
    common = F.transform(F.sequence(F.lit(1), F.lit(len(WORDS))),
                         lambda k: F.size(found) - F.size(F.array_remove(found, k)))
    df = df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                   covered.alias("n_repeat_words"), "chars",
                   F.concat(common, F.array((F.col("n_words") - F.col("n_common")).cast("int"))).alias("common"))
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)
    share = lambda c, n: F.transform(c, lambda x: x / F.greatest(n, F.lit(1)))
    return df.withColumns({"chars": share(F.col("chars"), total), "common": share(F.col("common"), F.col("n_words"))})


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares and a reference, base 2."""
    def term(a: Column, b: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return part(a) + part(b)
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def _middles(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, middle): the median of ``value``, numbers from 0 to 1, in steps of 1 / ``STEPS``."""
    counts = values.groupBy(*keys, F.round(F.col("value") * STEPS).cast("long").alias("step")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*keys))})
            .where("2 * upto >= all").groupBy(*keys).agg((F.min("step") / STEPS).alias("middle")))


def references(counted: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """By listed language: shares of character classes and of common words, so found that up to half of a language's
    documents may be noise: the medians of each share, then the mean of the half of the documents nearest to them."""
    fine = counted.where(F.col("lang").isin(*COMMON) & ~_base_failed()).select("lang", "chars", "common")
    n_chars, n_common = len(CLASSES) + 2, len(WORDS) + 1
    shares = fine.select("lang", F.posexplode(F.concat("chars", "common")).alias("place", "value"))
    middle: dict[str, list[float]] = {}
    for r in _middles(shares, "lang", "place").collect():
        middle.setdefault(r["lang"], [0.0] * (n_chars + n_common))[r["place"]] = r["middle"]

    def far(lang: str) -> Column:
        parts = middle[lang][:n_chars], middle[lang][n_chars:]
        return sum((distance(F.col(c), [x / (sum(p) or 1.0) for x in p]) for c, p in zip(("chars", "common"), parts)),
                   F.lit(0.0)) / 2

    if not middle:
        return {}
    away = reduce(lambda c, lang: F.when(F.col("lang") == lang, far(lang)).otherwise(c), sorted(middle), F.lit(1.0))
    ranked = written(fine.withColumn("value", F.round(away * STEPS) / STEPS), "distances")
    half = {r["lang"]: r["middle"] for r in _middles(ranked, "lang").collect()}
    near = reduce(lambda c, lang: c | ((F.col("lang") == lang) & (F.col("value") <= half[lang])), sorted(half), F.lit(False))
    means = [F.avg(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("chars", n_chars), ("common", n_common)) for i in range(n)]
    rows = ranked.where(near).groupBy("lang").agg(*means).collect()
    return {r["lang"]: ([r[f"chars{i}"] for i in range(n_chars)], [r[f"common{i}"] for i in range(n_common)])
            for r in sorted(rows, key=lambda r: r["lang"])}


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_divergence, word_divergence.

    Null text has no words. The nearest reference counts, whichever language a document names. A document that names a
    language without a reference is judged by the base rules alone, as nothing is known of its words and letters; one
    that names none is judged like any other. Without references the divergences are null and only the base rules
    judge. Repeated rows are judged each and equal texts of one language alike; an empty table gives an empty result.
    """
    counted = written(counts(docs, id_col, text_col, lang_col), "text-counts")
    known = references(counted)

    def nearest(col: str, to: list[list[float]]) -> Column:
        each = [distance(F.col(col), r) for r in to]
        return reduce(F.least, each) if each else F.lit(None).cast("double")

    n = F.col("n_words")

    def strays(col: str, least: int, limit: float, noise: float) -> Column:
        return F.coalesce((n >= least) & (F.col(col) > limit + noise / F.sqrt(n)), F.lit(False))

    one = {c: [r[i] for r in known.values()] for i, c in enumerate(("chars", "common"))}
    two = {c: [[share * x + (1 - share) * y for x, y in zip(a, b)] for a, b in combinations(refs, 2) for share in SHARES]
           for c, refs in one.items()}
    df = counted.select("*", nearest("chars", one["chars"]).alias("char_divergence"),
                        nearest("common", one["common"]).alias("word_divergence"), _base_failed().alias("base_failed"))
    if two["chars"]:  # most texts are near one language, so few are compared with the mixes
        df = df.withColumns({
            f: F.when(strays(f, *limits), F.least(F.col(f), nearest(c, two[c]))).otherwise(F.col(f))
            for f, c, limits in (
                ("char_divergence", "chars", (CHARACTER_WORDS, CHARACTER_LIMIT, CHARACTER_NOISE)),
                ("word_divergence", "common", (WORD_WORDS, WORD_LIMIT, WORD_NOISE)))})
    judged = F.col("lang").isNull() | F.col("lang").isin(list(known))
    kept = (~F.col("base_failed") & ~(judged & strays("char_divergence", CHARACTER_WORDS, CHARACTER_LIMIT, CHARACTER_NOISE))
            & ~(judged & strays("word_divergence", WORD_WORDS, WORD_LIMIT, WORD_NOISE)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     kept.alias("kept"), "char_divergence", "word_divergence")
