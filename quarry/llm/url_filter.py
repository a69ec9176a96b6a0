"""Operator 4: URL filter by rules, and by gradient-boosted trees where no rule fits.

A rule is (host, path): it fits its host and all subdomains if the url's path
starts with the rule's; of several the longest (host and path together) wins.
URLs that a rule fits are the labelled ones.  Of these a bounded sample, by a
hash of the url, trains gradient-boosted trees on lexical features: length,
depth, digit ratio, entropy, parameter counts, and the sample's statistics of
the host's suffix.  A labelled URL's own suffix statistics come from the other
folds of the sample, drawn towards the whole sample's rate by the weight of ``PRIOR``
rows, so no label is fed to its own row.  ``held_out_accuracy`` says how well the
trees do on labelled URLs that they weren't trained on, with and without the
suffix.  All else is column expressions over all rows.

Nulls and edge cases: a url that is null or has no ``://`` has an empty host and
path and no rule, and is judged by its features (all 0 for null); without
labelled URLs of both kinds everything left is allowed; each row gives one row;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000
#: Folds of the sample, and how many rows of the whole rate a suffix's own rate is mixed with.
FOLDS, PRIOR = 5, 50.0
FEATURES = ("length", "host_length", "depth", "labels_in_host", "digit_ratio", "entropy", "parameters", "fragment", "hyphens", "suffix_share", "suffix_blocked")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    # The longest is asked first, so it ends up outermost.
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Features of column url, beside its host and path."""
    url = F.coalesce("url", F.lit(""))
    length = F.length(url)
    chars = F.split(url, "")
    share = lambda c: (length - F.length(F.replace(url, c))) / length
    entropy = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return pages.withColumns(
        {
            "length": length.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
            "labels_in_host": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(url, F.lit("[0-9]")), length), F.lit(0.0)),
            "entropy": F.coalesce(entropy, F.lit(0.0)),
            "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (its verdict)."""
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "ruled": ruled})


def labelled(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """The sample, at most ``sample`` rows: features, blocked (0 or 1) and fold of each."""
    seen = judged(pages, rules).where("rule is not null").select("url", "host", "path", "ruled").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    return written(lexical(seen).withColumns({"blocked": (F.col("ruled") == "block").cast("double"), "fold": F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS))}), "labelled")


def suffix_statistics(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suffix, suffix_share, suffix_blocked) from all labelled rows, and the same by fold from the rows of the others."""
    n, blocked = F.col("n"), F.col("k")
    total, rate = seen.agg(F.count("*"), F.avg("blocked")).first()
    by_fold = seen.groupBy("suffix", "fold").agg(F.count("*").alias("own_n"), F.sum("blocked").alias("own_k"))
    every = seen.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("k"))
    figures = lambda n, k: [(n / F.lit(float(max(total, 1)))).alias("suffix_share"), ((k + PRIOR * (rate or 0.0)) / (n + PRIOR)).alias("suffix_blocked")]
    others = by_fold.join(every, "suffix")
    return every.select("suffix", *figures(n, blocked)), others.select("suffix", "fold", *figures(n - F.col("own_n"), blocked - F.col("own_k")))


def trees(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> GBTClassificationModel:
    """Boosted trees from a bounded sample with its features."""
    made = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select("features", "blocked").coalesce(1)
    return GBTClassifier(labelCol="blocked", maxIter=10, maxDepth=4, stepSize=0.2, seed=5, cacheNodeIds=False).fit(made)


def fitted(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> tuple[GBTClassificationModel | None, DataFrame, float]:
    """The trees (None without labels of both kinds), the suffix statistics of the sample, and its rate of blocked rows."""
    seen = labelled(pages, rules, sample)
    kinds, rate = seen.agg(F.count_distinct("blocked"), F.avg("blocked")).first()
    suffixes, others = suffix_statistics(seen)
    model = trees(seen.join(F.broadcast(others), ["suffix", "fold"])) if kinds == 2 else None
    return model, suffixes, rate or 0.0


def fit(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> tuple[GBTClassificationModel | None, DataFrame]:
    """The trees and the suffix statistics."""
    return fitted(pages, rules, sample)[:2]


def held_out_accuracy(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> dict[str, float]:
    """Share of the labelled URLs of the last fold that trees from the others judge as the rules do: with all features, without those of the suffix, and by the commoner label alone."""
    seen = labelled(pages, rules, sample)
    rest, test = seen.where(F.col("fold") != FOLDS - 1), seen.where(F.col("fold") == FOLDS - 1)
    suffixes, others = suffix_statistics(rest)
    rate = rest.agg(F.avg("blocked")).first()[0]
    train, test = rest.join(F.broadcast(others), ["suffix", "fold"]), with_suffix(test, suffixes, rate)
    out = {}
    for name, features in (("all", FEATURES), ("without_suffix", tuple(x for x in FEATURES if not x.startswith("suffix")))):
        judged_ = trees(train, features).transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(test))
        out[name] = judged_.agg(F.avg((F.col("prediction") == F.col("blocked")).cast("double"))).first()[0]
    out["commoner"] = test.agg(F.avg((F.col("blocked") == float(rate > 0.5)).cast("double"))).first()[0]
    return out


def with_suffix(rows: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    """Suffix statistics; a suffix that the sample hasn't has the whole rate.  The statistics have no more rows than the sample, so they are sent to all tasks."""
    return rows.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_share": 0.0, "suffix_blocked": rate})


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_probability) of each row."""
    model, suffixes, rate = fitted(pages, rules, sample)
    rows = with_suffix(lexical(judged(pages, rules)), suffixes, rate)
    if model is None:
        scored = rows.withColumn("blocked_probability", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)).withColumn("blocked_probability", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("blocked_probability") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "blocked_probability")
