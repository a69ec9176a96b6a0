"""Operator 7: quality rules by distribution divergence, in DataFrame functions alone.

Base figures of a text are counted with regular expressions and array
functions.  The method compares two histograms of each document with its
language's: of character classes, and of the language's most common words.
References are made of all documents of a language that has a guard's number of words
together.  A document that is far from its own language, or whose language has no
reference, may be in another: it is then measured against the ``TRIED`` languages with
the most words too, and the least distance counts.  It is dropped if that is still
too far by Jensen-Shannon distance (the square root of the divergence to base 2);
documents with fewer words than a guard, and all where there is no reference, keep
their place unless the base rules drop them.

Figures of the documents are written once with their texts; references and verdicts
are read from there.

Nulls and edge cases: a text that is null or empty has no words, all counts 0,
and fails the base rule of 50 words; a null lang makes a language of its own, the same
as an empty one; each row gives one row; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm.common import written

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Character classes by regular expression; white space is a class of its own, and what is left (most of it lower-case letters) is the last.
CLASSES = (("upper", r"\p{Lu}"), ("digit", "[0-9]"), ("stop", r"[.,;:'\-]"), ("mark", r"[!?\"()]"), ("symbol", r"[#*$%&|<>+=_/\\@~^\[\]{}]"))
#: So many of a language's words have bins of their own.
COMMON = 20
#: A language has a reference if its documents have this many words together.
LEAST_REFERENCE = 1_000
#: Documents far from their own language are measured against this many others, those with the most words.
TRIED = 100
LEAST_WORDS = 50
#: Too far by character classes alone, or by both histograms: (classes, words).
FAR_CLASSES, FAR_BOTH = 0.25, (0.115, 0.3)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more.  If no two windows are equal there are none; else windows are sorted with their places, those equal to a neighbour are kept, and the places they cover are summed in order."""

    def covered(windows: Column) -> Column:
        twice = F.filter(windows, lambda w, i: (F.get(windows, i - 1)["key"] == w["key"]) | (F.get(windows, i + 1)["key"] == w["key"]))
        places = F.sort_array(F.transform(twice, lambda w: w["at"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def counted(keys: Column) -> Column:
        windows = F.transform(keys, lambda x, i: F.struct(x.alias("key"), i.alias("at")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(F.sort_array(windows), covered))

    def keys(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: let(keys(w), counted))


def words_of(text: str | Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, the base figures and the numbers of the character classes."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text")).withColumn("words", words_of("text"))
    out = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_spaces": F.regexp_count("text", F.lit(SPACE)).cast("long"),
            "n_chars": F.length("text").cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("words")).cast("long"),
            "in_classes": F.array(*class_counts()),
        }
    ).drop("words")
    return out.withColumns({"word_chars": F.col("n_chars") - F.col("n_spaces"), "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))})


def class_counts(text: str = "text") -> list[Column]:
    return [F.regexp_count(text, F.lit(pattern)).cast("long") for _, pattern in CLASSES]


def shares(counts: list[Column], spaces: Column, chars: Column) -> Column:
    """Shares of the classes, of white space, and of what is left."""
    parts = [(c / chars) for c in [*counts, spaces]]
    return F.array(*parts, F.greatest(F.lit(0.0), 1 - sum(parts[1:], parts[0])))


def references(rows: DataFrame, common: int = COMMON, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """(lang, n_words, classes, words) of every language that has enough words: the shares of the character classes (white space and the rest last), and of its common words.  From all rows of ``base``."""
    numbers = [F.sum(F.col("in_classes")[k]).alias(name) for k, (name, _) in enumerate(CLASSES)]
    sums = rows.groupBy("lang").agg(F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"), F.sum("n_spaces").alias("n_spaces"), *numbers).where(F.col("n_words") >= max(1, least_reference))
    sums = sums.select("lang", "n_words", shares([F.col(name) for name, _ in CLASSES], F.col("n_spaces"), F.col("n_chars")).alias("classes"))
    counted = rows.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # The limit by row number is taken before the shuffle too, so no task gathers a language's words.
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= common)
    first = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("first"))
    return sums.join(first, "lang").select("lang", "n_words", "classes", F.transform("first", lambda x: F.struct(x["word"].alias("word"), (x["n"] / F.col("n_words")).alias("share"))).alias("words"))


def distance(pairs: Column) -> Column:
    """Jensen-Shannon distance to base 2 of histograms p and q, an array of their bins' shares; null of null."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (half(x["p"], x["q"]) + half(x["q"], x["p"])) / 2, lambda a: F.sqrt(F.greatest(a, F.lit(0.0))))


def class_distance(classes: Column, ref: Column) -> Column:
    return distance(F.zip_with(classes, ref, lambda p, q: F.struct(p.alias("p"), q.alias("q"))))


def word_distance(words: Column, ref: Column) -> Column:
    """Of a document's lower-cased words from a reference's common ones; all other words are one bin."""
    share = lambda x: (F.size(words) - F.size(F.array_remove(words, x["word"]))) / F.size(words)
    left = lambda b, name: F.greatest(F.lit(0.0), F.aggregate(b, F.lit(1.0), lambda a, x: a - x[name]))
    bins = F.transform(ref, lambda x: F.struct(share(x).alias("p"), x["share"].alias("q")))
    return let(bins, lambda b: distance(F.concat(b, F.array(F.struct(left(b, "p").alias("p"), left(b, "q").alias("q"))))))


def constant(refs: list) -> Column:
    """References as one constant array."""
    words = lambda r: F.array(*[F.struct(F.lit(w.word).alias("word"), F.lit(w.share).alias("share")) for w in r.words])
    return F.array(*[F.struct(F.array(*map(F.lit, r.classes)).alias("classes"), words(r).alias("words")) for r in refs])


def judge(docs: DataFrame, far_classes: float = FAR_CLASSES, far_both: tuple[float, float] = FAR_BOTH, least_words: int = LEAST_WORDS, least_reference: int = LEAST_REFERENCE, tried: int = TRIED) -> DataFrame:
    """Base figures with class_distance, word_distance (null below the length guard, or without references) and kept."""
    rows = written(base(docs), "figures", "zstd")
    refs = written(references(rows, least_reference=least_reference), "references")
    others = refs.orderBy(F.desc("n_words"), "lang").limit(tried).collect()

    def far(at: Column) -> Column:
        return (at["classes"] > far_classes) | ((at["classes"] > far_both[0]) & (at["words"] > far_both[1]))

    def measured(ref: Column, words: Column, classes: Column) -> Column:
        return F.struct(class_distance(classes, ref["classes"]).alias("classes"), word_distance(words, ref["words"]).alias("words"))

    def least(words: Column, classes: Column) -> Column:
        own = measured(F.struct(F.col("own_classes").alias("classes"), F.col("own_words").alias("words")), words, classes)
        if not others:
            return own
        both = lambda at: F.struct(*[F.least(at["own"][k], F.array_min(F.transform(at["others"], lambda x: x[k]))).alias(k) for k in ("classes", "words")])
        nearest = lambda at: let(F.struct(at.alias("own"), F.transform(constant(others), lambda r: measured(r, words, classes)).alias("others")), both)
        return let(own, lambda at: F.when(F.coalesce(far(at), F.lit(True)), nearest(at)).otherwise(at))

    # A small table of references is broadcast by Spark's own check of its size; a large one is joined by shuffle.
    rows = rows.join(refs.select("lang", F.col("classes").alias("own_classes"), F.col("words").alias("own_words")), "lang", "left")
    mine = let(words_of(F.lower("text")), lambda w: let(shares([F.col("in_classes")[k] for k in range(len(CLASSES))], F.col("n_spaces"), F.col("n_chars")), lambda c: least(w, c)))
    rows = rows.withColumn("at", F.when(F.col("n_words") >= least_words, mine))
    rows = rows.withColumns({"class_distance": F.col("at.classes"), "word_distance": F.col("at.words"), "kept": ~F.col("base_failed") & ~F.coalesce(far(F.col("at")), F.lit(False))})
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
