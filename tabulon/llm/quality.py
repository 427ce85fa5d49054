"""Quality rules by distribution divergence, with built-in functions only.

Each document gives two histograms: of character classes, and of the common words
of its language (with one bin for all other words). Both are compared with the
histograms of its language, summed over all documents of that language, by the
Jensen-Shannon distance. Short documents have noisy histograms: under a guard of
characters or words the comparison is skipped and only the base rules decide.

Defined results: null or empty text has no words and fails the base rules; a null
or unknown language is compared with the character classes of all such documents
together and has no common-word test; repeated rows are judged one by one, with
equal verdicts; an empty table gives an empty result; other columns pass through
``filter_documents`` untouched. A table column named like a result column of
``assess`` is ignored, as only id, text and language are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, words

#: Frequent function words of each language (public knowledge); the histogram's bins.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "as", "with", "be", "by", "at", "are", "this", "not", "have", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como"),
}
#: Character classes beside white space and all other characters (mostly lower-case letters).
CLASSES = {"symbol": "#*$%&|<>", "upper": r"\p{Lu}", "digit": "0-9", "mark": r"\p{P}\p{S}"}


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the divergence test."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Guards: a histogram of fewer characters or words than this is not compared.
    min_chars: int = 200
    min_compared_words: int = 50
    #: Greatest Jensen-Shannon distance (0 to 1) that a clean document has.
    max_char_distance: float = 0.3
    max_word_distance: float = 0.4
    common: dict = field(default_factory=lambda: COMMON)


def repeated_words(tokens: Column, window: int) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, the first
    included. Windows are compared by 64-bit hashes within one text."""

    def of_hashes(h: Column) -> Column:
        # hashes of 2, 4, ... words, each of two hashes of half as many: no index arithmetic for each word
        return let(doubled(h, 1), lambda w: let(F.slice(w, 1, F.size(h) - (window - 1)), covered))

    def doubled(h: Column, width: int) -> Column:
        if width == window:
            return h
        step = min(width, window - width)
        return let(F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)), lambda x: doubled(x, width + step))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ranked, lambda r: let(F.sort_array(F.filter(F.transform(r, lambda x, k: F.when((x["h"] == F.get(r, k - 1)["h"]) | (x["h"] == F.get(r, k + 1)["h"]), x["i"])), lambda x: x.isNotNull())), span)))

    def span(at: Column) -> Column:
        # each start covers up to the next start, at most one window
        return F.aggregate(F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(window), F.get(at, k + 1) - x), F.lit(window))), F.lit(0), lambda s, x: s + x)

    return F.when(F.size(tokens) > window, let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0)).cast("long")


def _lang(lang: Column, rules: Rules) -> Column:
    return F.when(lang.isin(*rules.common), lang).otherwise(F.lit(""))


def measures(df: DataFrame, rules: Rules, *, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Counts of each document: ``lang``, base counts, ``chars`` and ``common`` histograms."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lang = _lang(F.col(f"`{lang_col}`"), rules) if lang_col else F.lit("")
    kept = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]+", ""))
    bins = max([0, *map(len, rules.common.values())])

    def histogram(w: Column, vocabulary: tuple) -> Column:
        count = lambda c, t: F.size(F.filter(c, lambda x: x == t)).cast("long")
        zeros = [F.lit(0).cast("long")] * (bins - len(vocabulary))
        return let(F.filter(w, lambda x: x.isin(*vocabulary)), lambda c: F.array(*[count(c, t) for t in vocabulary], *zeros, (F.size(w) - F.size(c)).cast("long")))

    def common(w: Column, lang_: Column) -> Column:
        out = F.array(*[F.lit(0).cast("long")] * (bins + 1))
        for name, vocabulary in rules.common.items():
            out = F.when(lang_ == name, histogram(w, vocabulary)).otherwise(out)
        return out

    # a one-row generator keeps the tokens from being evaluated once for each use
    base = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), lang.alias("lang"), F.explode(F.array(words(text))).alias("w"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "id",
        "lang",
        F.explode(
            F.array(
                F.struct(
                    F.size("w").cast("long").alias("n_words"),
                    F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                    F.length(text).cast("long").alias("n"),
                    *[kept(cls).cast("long").alias(name) for name, cls in CLASSES.items()],
                    let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    repeated_words(F.col("w"), rules.window).alias("n_repeat_words"),
                    common(F.col("w"), F.col("lang")).alias("common"),
                )
            )
        ).alias("m"),
    ).select("id", "lang", "m.*")
    c = F.col
    marks = F.greatest(c("mark") - c("symbol"), F.lit(0))
    rest = c("word_chars") - c("symbol") - c("upper") - c("digit") - marks
    return counted.select("id", "lang", "n_words", "word_chars", c("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", F.array(c("n") - c("word_chars"), c("symbol"), c("upper"), c("digit"), marks, F.greatest(rest, F.lit(0))).alias("chars"), "common")


def references(measured: DataFrame, rules: Rules) -> DataFrame:
    """Histogram sums of each language over all documents: at most one row for each
    language that ``rules`` knows and one for the rest."""
    bins = max([0, *map(len, rules.common.values())]) + 1
    return measured.groupBy("lang").agg(
        F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CLASSES) + 2)]).alias("ref_chars"),
        F.array(*[F.sum(F.col("common")[i]) for i in range(bins)]).alias("ref_common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count arrays; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def js(tp: Column, tq: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        pair = F.zip_with(p, q, lambda x, y: F.struct((x / tp).alias("p"), (y / tq).alias("q")))
        terms = F.transform(pair, lambda z: (term(z["p"], (z["p"] + z["q"]) / 2) + term(z["q"], (z["p"] + z["q"]) / 2)) / 2)
        return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0))))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda t: js(t["p"], t["q"]))


def assess(df: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row for each document: id, the base counts, distances and verdicts."""
    measured = materialize(measures(df, rules, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality")
    return _verdicts(measured, references(measured, rules), rules).withColumnRenamed("id", id_col)


def _verdicts(measured: DataFrame, refs: DataFrame, rules: Rules) -> DataFrame:
    c = F.col
    # refs has one row for each known language: broadcasting it is bounded by the rules
    joined = measured.join(F.broadcast(refs), "lang", "left")
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    char_d = F.when(n_chars >= rules.min_chars, distance(c("chars"), c("ref_chars")))
    word_d = F.when((c("lang") != "") & (c("n_words") >= rules.min_compared_words), distance(c("common"), c("ref_common")))
    out = joined.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", char_d.alias("char_distance"), word_d.alias("word_distance"))
    failed = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce(c("char_distance"), F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce(c("word_distance"), F.lit(0.0)) <= rules.max_word_distance))


def filter_documents(df: DataFrame, rules: Rules = Rules(), *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that pass, with all their columns and no others. The verdict
    is taken beside the row, so that repeated or null ids need no join."""
    row = "__row"
    carried = df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias(row), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    measured = materialize(measures(carried, rules, id_col=row, text_col="text", lang_col="lang"), "quality")
    return _verdicts(measured, references(measured, rules), rules).where("kept").select("id.*")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
