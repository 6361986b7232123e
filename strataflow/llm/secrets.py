"""Secret scans in SQL functions: base patterns, and weak parts that count where complementary parts are near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import text_key, texts

# ---- Fixed values: the base patterns, in the order that breaks ties -------------------------------
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")
# The method's weak parts: alone they mean nothing.
WEAK = {
    "identifier": r"(?i:client_?id|user_?name|login|account|access_?id|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}",
    "key": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[^\x00-\x20\"'<>]{4,}",
}
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
# Roles of which one must be in scope for a weak part to be reported.
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
SCOPE = 240  # code points between the ends of two parts that belong together


def _spans(pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Array of (start, rank, end) of all leftmost non-overlapping matches, in code points.

    What lies between matches, and the matches, give the places: their lengths add up.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    between = F.split("text", pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    walked = F.aggregate(
        steps,
        zero,
        lambda s, x: F.struct(
            (s["at"] + x["b"] + x["m"]).alias("at"),
            F.array_append(s["spans"], F.struct((s["at"] + x["b"]).alias("start"), (s["at"] + x["b"] + x["m"]).alias("end"))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    rank = F.lit(KINDS.index(kind))
    if keep is not None:
        pairs = F.filter(F.arrays_zip(walked.alias("s"), keep.alias("k")), lambda p: p["k"])
        walked = F.transform(pairs, lambda p: p["s"])
    spans = F.transform(walked, lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.when(F.col("text").rlike(pattern), spans).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    part = lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: counts and places of the base findings, and all places.

    A null text counts as empty: no findings, the hash of an empty string. Rows equal in doc_id and text
    get equal results, each its own row.

    Weak parts come back through an interval join within each text: places are put into bins as wide
    as the scope, parts are reduced to the first start and last end of their role in each bin, and a
    candidate meets its own and the two neighbouring bins by equality. So no pairs of parts are formed,
    and a bin contributes one row per role.
    """
    long_enough = F.transform(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 8
    )
    read = texts(docs).withColumn("rk", text_key())
    found = read.select(
        "doc_id",
        "rk",
        _spans(ASSIGN, "assign", long_enough).alias("assign"),
        *[_spans(p, k).alias(k) for k, p in (("access", ACCESS), ("hex", HEX), *WEAK.items())],
    )
    base = F.array_sort(F.concat(*BASE))
    found = found.select(
        "doc_id", "rk", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base"), F.concat(*WEAK).alias("weak")
    )
    # A weak part that overlaps a base finding is that finding.
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    # Places only, without texts: written once, as three steps below read it.
    found = materialise(found.withColumn("weak", free), "found")

    linked = _linked(found, scope)
    back = found.alias("f").join(
        linked.alias("l"), F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("f.rk") == F.col("l.rk")), "left"
    )
    everything = F.when(F.col("l.kept").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "l.kept")))
    return back.select(
        F.col("f.doc_id").alias("doc_id"),
        *[F.col(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(everything).alias("spans"),
    )


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """``doc_id``, ``rk``, ``kept``: the weak parts with a complementary part in scope."""
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    needs = F.create_map(*[v for r, n in NEEDS.items() for v in (F.lit(r), F.array(*map(F.lit, n)))])
    parts = (
        found.filter(F.size("weak") > 0)
        .select("doc_id", "rk", F.explode(F.concat("base", "weak")).alias("s"))
        .select("doc_id", "rk", "s", roles[F.col("s.rank")].alias("role"))
        .distinct()
    )
    bin_of = lambda at: F.floor(at / scope)
    # A part longer than a bin lies in several.
    bins = parts.select(
        "doc_id", "rk", "role", "s", F.explode(F.sequence(bin_of(F.col("s.start")), bin_of(F.col("s.end")))).alias("bin")
    )
    extents = bins.groupBy("doc_id", "rk", "role", "bin").agg(F.min("s.start").alias("first"), F.max("s.end").alias("last"))
    wanted = (
        parts.filter(F.col("s.rank") >= len(BASE))
        .select("doc_id", "rk", "s", F.explode(needs[F.col("role")]).alias("role"))
        .withColumn("bin", F.explode(F.sequence(bin_of(F.col("s.start")) - 1, bin_of(F.col("s.end")) + 1)))
    )
    w, e = wanted.alias("w"), extents.alias("e")
    same = (
        F.col("w.doc_id").eqNullSafe(F.col("e.doc_id"))
        & (F.col("w.rk") == F.col("e.rk"))
        & (F.col("w.role") == F.col("e.role"))
        & (F.col("w.bin") == F.col("e.bin"))
    )
    # Before: the bin's last end is near enough; after: its first start is. Within one bin both hold.
    near = (F.col("e.first") <= F.col("w.s.end") + scope) & (F.col("e.last") >= F.col("w.s.start") - scope)
    met = w.join(e, same & near, "left_semi")
    return met.groupBy("doc_id", "rk").agg(F.collect_set("s").alias("kept"))
