"""Combined levels whose parts hold the separator themselves."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.missing import as_col
from ..sources.scratch import materialise


def _between(start: Column, end: Column) -> Column:
    """Pieces ``start`` to ``end`` (exclusive) of a level, with the separators that stood between them."""
    followed = F.zip_with("pieces", "between", lambda p, b: F.concat(p, F.coalesce(b, F.lit(""))))
    head = F.array_join(F.slice(followed, start + 1, end - start - 1), "")
    return F.concat(head, F.element_at("pieces", end))


def _seen(pairs: DataFrame, known: Mapping[str, Sequence[str]]) -> DataFrame:
    """``part``, ``value``: levels that can be read in one way only, and the ones that were given."""
    parts = F.when(F.size("names") == 1, F.array("level")).otherwise(as_col("pieces"))
    even = pairs.filter((F.size("names") == 1) | (F.size("names") == F.size("pieces")))
    seen = even.select(F.inline(F.arrays_zip(as_col("names").alias("part"), parts.alias("value"))))
    given = [(part, value) for part, values in known.items() for value in values]
    if given:
        seen = seen.unionByName(pairs.sparkSession.createDataFrame(given, "part string, value string"))
    return seen.distinct()


def combined_levels(
    df: DataFrame,
    name: str,
    level: str,
    known: Mapping[str, Sequence[str]] | None = None,
    separator: str = text.LEVEL_SEPARATOR,
) -> DataFrame:
    """``name``, ``level``, ``parts`` of every distinct pair whose level has more pieces than its name.

    A part may hold the separator, so neighbouring pieces are joined until there are as many parts
    as names, each a level that is known of its name: one of ``known``, or one that stands elsewhere in
    the table where it can be read in one way only (under a single name, which takes the whole level, or
    with as many pieces as names). ``parts`` is an error if no way or more than one way is left.

    Ways are counted along the pieces: per name one equality join of the stretches of pieces with
    the known levels, merged where they end at the same piece. All of it works on distinct pairs.
    """
    pairs = df.select(as_col(name).alias("name"), as_col(level).alias("level")).distinct()
    pairs = pairs.filter(as_col("name").isNotNull() & as_col("level").isNotNull()).select(
        "name",
        "level",
        text.split_levels("name", separator).alias("names"),
        text.split_levels("level", separator).alias("pieces"),
        F.regexp_extract_all("level", F.lit(separator), F.lit(0)).alias("between"),
    )
    pairs = materialise(pairs, "levels")
    m, k = F.size("names"), F.size("pieces")
    longer = pairs.filter(k > m)
    single = longer.filter(m == 1).select("name", "level", F.array("level").alias("parts"))
    open_pairs = longer.filter(m > 1)
    most = open_pairs.agg(F.max(m)).first()[0] or 0

    # Every name of a pair with every stretch of pieces that leaves one at least to each other name.
    placed = open_pairs.select("*", F.posexplode("names").alias("nth", "part"))
    placed = placed.select("*", F.explode(F.sequence(as_col("nth"), k - m + as_col("nth"))).alias("start"))
    placed = placed.select("*", F.explode(F.sequence(as_col("start") + 1, k - m + as_col("nth") + 1)).alias("end"))
    stretches = placed.select(
        "name", "level", "nth", "part", "start", "end",
        ((as_col("nth") == m - 1) & (as_col("end") == k)).alias("last"),
        _between(as_col("start"), as_col("end")).alias("value"),
    )
    fitting = stretches.join(_seen(pairs, known or {}), ["part", "value"]) if most else stretches
    fitting = materialise(fitting, "stretches") if most else fitting

    at = ["name", "level", "start"]
    ways = open_pairs.select("name", "level", F.lit(0).alias("start"), F.lit(1).alias("ways"), F.array().cast("array<string>").alias("parts"))
    whole = ways.select("name", "level", "ways", "parts").limit(0)
    for nth in range(most):
        step = ways.join(fitting.filter(as_col("nth") == nth), at)
        met = step.groupBy("name", "level", "end", "last").agg(
            F.least(F.sum("ways"), F.lit(2)).cast("int").alias("ways"),
            F.min(F.concat("parts", F.array("value"))).alias("parts"),
        )
        whole = whole.unionByName(met.filter("last").select("name", "level", "ways", "parts"))
        ways = met.select("name", "level", as_col("end").alias("start"), "ways", "parts")

    def failed(reason: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{level} {reason}: "), as_col("name"), F.lit(" = "), as_col("level")))

    found = open_pairs.select("name", "level").join(whole, ["name", "level"], "left")
    checked = (
        F.when(as_col("ways") == 1, as_col("parts"))
        .when(as_col("ways").isNull(), failed("is not made up of known levels"))
        .otherwise(failed("can be read in several ways"))
    )
    return single.unionByName(found.select("name", "level", checked.alias("parts")))
