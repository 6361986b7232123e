"""URL filters: rules by host and path, and gradient-boosted trees over lexical features for the rest."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

ALLOW, BLOCK = "allow", "block"
# ---- Fixed values: rules as verdict, host and path ------------------------------------------------
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
SAMPLE = 20_000  # labelled URLs the trees are trained on, about
TREES, DEPTH = 12, 3
FEATURES = ("length", "host_length", "depth", "host_depth", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_seen", "domain_rate", "domain_seen")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host after the first ``://``, path after it up to ``?`` or ``#``; null or no ``://``: both empty."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(whole, r"://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"://[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, as a chain from the longest; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Length, depth, digit ratio, entropy of the characters, parameters, hyphens."""
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    characters = F.array_distinct(F.split(url, ""))
    plus = lambda s, c: s - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(F.lit(0.0))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": _count(path, "/").cast("double"),
        "host_depth": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
        "digits": _count(url, "[0-9]") / n,
        "entropy": F.aggregate(characters, F.lit(0.0), plus),
        "parameters": _count(F.regexp_extract(url, r"\?([^#]*)", 1), "=").cast("double"),
        "hyphens": _count(url, "[-_]") / n,
    }


def suffixes(host: Column) -> tuple[Column, Column]:
    """Last label of the host, and its last two."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """Smoothed share of blocked URLs and logarithm of their number, for each suffix among labelled URLs."""
    n, bad = F.count(F.lit(1)), F.sum("label")
    return labelled.groupBy(key).agg(((bad + 1) / (n + 2)).alias(f"{key}_rate"), F.log1p(n).alias(f"{key}_seen"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``block_score`` of every row.

    Where no rule fits, the verdict is that of boosted trees trained on the distinct URLs that a rule
    judges: a sample of about ``sample`` of them, drawn by the hash of the URL, spread over the whole
    table; suffix statistics come from all of them. Without labelled URLs of both verdicts, the verdict is
    that of the labelled ones, or ``allow`` if there are none, and the score null. A null URL has an empty
    host and path and features of an empty text. Equal URLs get equal verdicts.
    """
    host, path = host_and_path()
    read = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    suffix, domain = suffixes(F.col("host"))
    urls = read.withColumns({"rule": rule, "ruled": verdict, "suffix": suffix, "domain": domain})

    labelled = urls.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == BLOCK).cast("double"))
    distinct = materialise(labelled.select("url", "host", "path", "suffix", "domain", "label").distinct(), "labelled")
    seen = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        usual = BLOCK if seen.get(1.0) else ALLOW
        return urls.select(
            "page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(usual)).alias("verdict"), F.lit(None).cast("double").alias("block_score")
        )

    by_suffix, by_domain = (materialise(_rates(distinct, k), k) for k in ("suffix", "domain"))
    spread = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(min(1.0, sample / sum(seen.values())) * (1 << 20))
    model = _trained(_featured(distinct.filter(spread), by_suffix, by_domain))
    scored = model.transform(_featured(urls, by_suffix, by_domain))
    judged = F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", judged).alias("verdict"),
        vector_to_array("probability")[1].alias("block_score"),
    )


def _featured(urls: DataFrame, by_suffix: DataFrame, by_domain: DataFrame) -> DataFrame:
    lex = lexical(F.col("url"), F.col("host"), F.col("path"))
    wide = urls.withColumns(lex).join(by_suffix, "suffix", "left").join(by_domain, "domain", "left")
    unseen = {"suffix_rate": 0.5, "suffix_seen": 0.0, "domain_rate": 0.5, "domain_seen": 0.0}
    return wide.fillna(unseen)


def _trained(sample: DataFrame):
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return PipelineModel(stages=[vector, gbt.fit(vector.transform(sample))])
