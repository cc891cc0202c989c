"""Quality rules: counts of each text, and its divergence from its language.

A document fails the base rules if it has fewer than 50 words, or if more than
half of its words stand in three-word windows that it holds twice or more. Else
it is compared with its language: the Jensen-Shannon distance (base 2, 0 to 1)
between its histogram of character classes and that of all documents of the
language, and the same for the language's common words. Either distance above
its limit rejects, but only on texts long enough for the histogram to mean
something. Languages without a list of common words are not compared.

The references are sums over all documents; a handful of rows, one for each
listed language, reaches the driver. DataFrame expressions only.

Defined results: a null text has no words and fails the base rules; repeated
rows each give a row; a null id stays null; other columns pass through where a
filter keeps them; an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: usual words of each language, unchanged in case ------------
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "est", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
}
#: Character classes beside a-z, as they are cut from what a-z leaves; the last holds the rest.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?]", "quote": "['\"()-]", "symbol": "[#*$%&|<>]", "letter": r"[\p{L}]"}
MIN_WORDS, MAX_REPEATED = 50, 50
MIN_CHARS_COMPARED, MIN_WORDS_COMPARED = 400, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.5
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the same array."""
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1), x + 3) - x))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def twice(sorted_: Column) -> Column:
        same = lambda j, s: F.coalesce(F.get(sorted_, j)["h"] == s["h"], F.lit(False))
        mine = F.filter(sorted_, lambda s, j: same(j - 1, s) | same(j + 1, s))
        return let(F.sort_array(F.transform(mine, lambda s: s["i"])), covered)

    def any_twice(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(by_hash, twice))

    return let(hashes, any_twice).cast("long")


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns ``_q`` (counts) and what the histograms need, from the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.withColumn("_words", F.array_remove(F.split(text, _SPACE, -1), ""))
    d = d.withColumn("_joined", F.array_join("_words", ""))
    d = d.withColumn("_rest", F.regexp_replace("_joined", "[a-z]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, _SPACE, "")) > 0)
    return d.withColumn("_lines", lines)


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern[:-1] + "]+", "")


def class_counts() -> list[Column]:
    """Characters in words: a-z, then each class in turn, then the rest."""
    out = [F.length("_joined") - F.length("_rest")]
    left = F.col("_rest")
    for pattern in CLASSES.values():
        fewer = _without(left, pattern)
        out.append(F.length(left) - F.length(fewer))
        left = fewer
    return [*out, F.length(left)]


def word_counts(lang_col: str) -> list[Column]:
    """Occurrences of each of the language's common words, then all other words; null without a list."""
    known = F.filter("_words", lambda w: w.isin(sorted({w for ws in COMMON_WORDS.values() for w in ws})))
    names = reduce(lambda c, lw: c.when(F.col(lang_col) == lw[0], F.array(*map(F.lit, lw[1]))), COMMON_WORDS.items(), F.when(F.lit(False), F.array(F.lit(""))))
    counts = let(known, lambda k: F.transform(names, lambda name: F.size(k) - F.size(F.array_remove(k, name))))
    return [counts]


def _histograms(d: DataFrame, lang_col: str) -> DataFrame:
    d = d.withColumn("_classes", F.array(*[c.cast("double") for c in class_counts()]))
    d = d.withColumn("_common", F.transform(word_counts(lang_col)[0], lambda x: x.cast("double")))
    other = F.size("_words") - F.aggregate("_common", F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("_common", F.concat("_common", F.array(other.cast("double"))))


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """For each listed language, the summed histograms of all its documents."""
    d = _histograms(base_counts(df.where(F.col(lang_col).isin(list(COMMON_WORDS))).select(text_col, lang_col), text_col), lang_col)
    n_classes, n_words = len(CLASSES) + 2, len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(n_words)]
    return {r[lang_col]: ([r[f"c{i}"] or 0.0 for i in range(n_classes)], [r[f"w{i}"] or 0.0 for i in range(n_words)]) for r in d.groupBy(lang_col).agg(*sums).collect()}


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda x, n: F.when(n > 0, x / n)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def both(s: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda x, y: let(
            F.struct(share(x, s["a"]).alias("p"), share(y, s["b"]).alias("q")),
            lambda t: (part(t["p"], (t["p"] + t["q"]) / 2) + part(t["q"], (t["p"] + t["q"]) / 2)) / 2))
        return F.when((s["a"] > 0) & (s["b"] > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0))))

    return let(F.struct(total(counts).alias("a"), total(reference).alias("b")), both)


def _by_language(refs: dict, which: int, lang_col: str) -> Column:
    c = F.when(F.lit(False), F.array(F.lit(0.0)))
    for lang, hists in sorted(refs.items()):
        c = c.when(F.col(lang_col) == lang, F.array(*[F.lit(float(x)) for x in hists[which]]))
    return c


def _judged(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    refs = references(df, text_col, lang_col)
    d = _histograms(base_counts(df, text_col), lang_col)
    d = d.withColumn("_n", F.size("_words").cast("long")).withColumn("_chars", F.length("_joined").cast("long"))
    d = d.withColumn("_repeated", repeated_words(F.col("_words")))
    d = d.withColumn("_failed", (F.col("_n") < MIN_WORDS) | (100 * F.col("_repeated") > MAX_REPEATED * F.col("_n")))
    classes = F.when(F.col("_chars") >= MIN_CHARS_COMPARED, distance(F.col("_classes"), _by_language(refs, 0, lang_col)))
    words = F.when(F.col("_n") >= MIN_WORDS_COMPARED, distance(F.col("_common"), _by_language(refs, 1, lang_col)))
    return d.withColumn("_class_distance", classes).withColumn("_word_distance", words)


def _kept() -> Column:
    near = (F.coalesce("_class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("_word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return ~F.col("_failed") & near


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the counts, both distances (null where not compared), base_failed and kept."""
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = _judged(d, "text", "lang")
    symbols = F.col("_classes")[1 + list(CLASSES).index("symbol")]
    return d.select(
        "doc_id", F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.col("_repeated").alias("n_repeat_words"),
        F.col("_failed").alias("base_failed"), _kept().alias("kept"),
        F.col("_class_distance").alias("class_distance"), F.col("_word_distance").alias("word_distance"),
    )


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that pass all rules, with their columns unchanged."""
    held = F.struct(*[df[c] for c in df.columns]).alias("_row")
    d = df.select(held, df[text_col].cast("string").alias("_text"), df[lang_col].cast("string").alias("_lang"))
    # a plain filter would be pushed below and repeat every expression above; a generator's output is not
    d = _judged(d, "_text", "_lang").select(F.posexplode_outer(F.when(_kept(), F.array("_row"))).alias("_at", "_row"))
    return d.where(F.col("_row").isNotNull()).select("_row.*")
