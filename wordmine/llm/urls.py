"""URLs judged by rules and, where none fits, by boosted trees on lexical features.

The trees are fitted on labelled URLs; the query labels those that a rule
judges.  Only DataFrame functions and pyspark.ml are used.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.session import materialize

#: (verdict, host, path), fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Different labelled URLs that the trees are fitted on: the most from which Spark looks at
#: every value when it chooses split points, so the fit does not hang on layout.
SAMPLE_URLS = 10_000
TREES, DEPTH, BINS = 10, 4, 64

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio",
    "entropy", "params", "hyphens", "marks", "suffix_share", "suffix_block", "label_block",
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.regexp_extract(url, parts, 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumns(
        {"host": F.translate(host, upper, upper.lower()), "path": F.regexp_extract(url, parts, 2)}
    )


def rule_for(host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null without one."""
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, h, p in reversed(longest):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.length(text), F.lit(1))
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    return F.aggregate(
        shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )


def _suffix(host: str = "host") -> Column:
    return F.substring_index(F.col(host), ".", -1)


def _first_label(host: str = "host") -> Column:
    """The label in front of the last two, such as the name of a site."""
    return F.substring_index(F.substring_index(F.col(host), ".", -3), ".", 1)


def suffix_statistics(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Share and smoothed block rate of host suffixes, and block rate of site names.

    ``labelled`` holds ``host``, ``label`` and ``n``, the number of such rows.
    """
    sums = lambda name, c: labelled.groupBy(c.alias(name)).agg(
        F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("bad")
    )
    total = F.lit(max(1, labelled.agg(F.sum("n")).first()[0] or 0))
    suffix = sums("suffix", _suffix()).select(
        "suffix",
        (F.col("n") / total).alias("suffix_share"),
        ((F.col("bad") + 1) / (F.col("n") + 2)).alias("suffix_block"),
    )
    site = sums("site", _first_label()).select(
        "site", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("label_block")
    )
    return suffix, site


def features(pages: DataFrame, suffix: DataFrame, site: DataFrame) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) and the columns of ``FEATURES``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    count = lambda marks: F.length(url) - F.length(F.translate(url, marks, ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    rows = pages.withColumns(
        {
            "length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.length("path") - F.length(F.translate("path", "/", "")),
            "labels": F.length("host") - F.length(F.translate("host", ".", "")),
            "digit_ratio": count("0123456789") / size,
            "entropy": _entropy(url),
            "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
            "hyphens": count("-"),
            "marks": count("%_~=@"),
            "suffix": _suffix(),
            "site": _first_label(),
        }
    )
    rows = rows.join(suffix, "suffix", "left").join(site, "site", "left")
    rows = rows.fillna({"suffix_share": 0.0, "suffix_block": 0.5, "label_block": 0.5})
    return rows.withColumns({c: F.col(c).cast("double") for c in FEATURES})


class UrlModel:
    """Fitted trees and suffix statistics; without two labels a constant verdict."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE_URLS):
        """``labelled`` holds ``url`` and ``label`` (1: block).

        The statistics count every row.  The trees are fitted on different URLs
        with their numbers of rows as weights; of more than ``sample`` those with
        the smallest hash are taken.  A URL with both labels is there with both.
        """
        known = labelled.select("url", "label").where("url is not null and label is not null")
        hosts = with_parts(known).groupBy("host", "label").agg(F.count("*").alias("n"))
        self.suffix, self.site = (materialize(t) for t in suffix_statistics(materialize(hosts)))
        urls = known.groupBy("url").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
        rows = urls.orderBy(F.xxhash64("url"), "url").limit(sample)
        both = F.array(
            F.struct(F.lit(0).alias("label"), (F.col("n") - F.col("bad")).cast("double").alias("n")),
            F.struct(F.lit(1).alias("label"), F.col("bad").cast("double").alias("n")),
        )
        rows = rows.coalesce(1).select("url", F.inline(both)).where("n > 0")
        rows = materialize(with_parts(rows))
        seen = sorted(r["label"] for r in rows.select("label").distinct().collect())
        self.constant, self.trees = (float(seen[0]) if seen else 0.0), None
        if len(seen) > 1:
            gbt = GBTClassifier(
                featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                maxBins=BINS, stepSize=0.3, seed=1, maxMemoryInMB=256, weightCol="n",
            )
            self.trees = gbt.fit(self._assembled(rows).select("x", F.col("label").cast("double"), "n"))

    def _assembled(self, pages: DataFrame) -> DataFrame:
        rows = features(pages, self.suffix, self.site)
        return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)

    def blocked(self, pages: DataFrame) -> DataFrame:
        """Add ``prediction``: 1 for block."""
        if self.trees is None:
            return pages.withColumn("prediction", F.lit(self.constant))
        return self.trees.transform(self._assembled(pages))


def judge(pages: DataFrame, model: UrlModel) -> DataFrame:
    """``page_id, host, path, rule, verdict, by_model`` of every row of ``pages``."""
    rows = with_parts(pages.select("page_id", "url"))
    rule, verdict = rule_for()
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    judged = model.blocked(rows)
    learned = F.when(F.col("prediction") > 0, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", learned).alias("verdict"),
        F.col("ruled").isNull().alias("by_model"),
    )


def labelled_by_rules(pages: DataFrame) -> DataFrame:
    """``url, label`` of the pages that a rule judges."""
    _, verdict = rule_for()
    rows = with_parts(pages.select("url")).withColumn("v", verdict).where("v is not null")
    return rows.select("url", (F.col("v") == "block").cast("int").alias("label"))
