"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of its id and text. Words are summed by source and first hash digits; the running sum finds the bucket
in which a source's budget ends; only that bucket is split by the next digits, until the threshold is exact. Documents
whose hash lies under the threshold are taken: a filter, no sort. A source with a target above its size is taken once whole and
a second time up to a second, nested threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import WORD, durable

#: Hexadecimal digits that each level of the histograms adds, 16 in all.
LEVELS = (3, 3, 3, 3, 4)


def targets(sizes: dict, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: share of all sizes by weight, none above most times its size, the excess shared again by weight.

    Sources go by code point, null last, and take the weights in turn. The level at which each source is either full or has its
    weight's part is found directly, from the source that fills first on.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, heavy = share * sum(sizes.values()), sum(weight.values())
    out = {}
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):
        if most * sizes[s] * heavy <= left * weight[s]:
            out[s] = most * sizes[s]
            left, heavy = left - most * sizes[s], heavy - weight[s]
        else:
            out[s] = weight[s] * left / heavy
    return out


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = (), max_sources: int = 100_000) -> DataFrame:
    """Columns doc_id, the columns named in keep, then size, source_size, target, copies and taken (size times copies).

    size: words of the whole text, 0 if null. copies: 0, 1 or 2. A source's taken words differ from its target by less than
    the size of the document at its threshold. Rows equal in id and text share a hash and are taken together. A null id is hashed as
    empty; a null source is a source. An empty table gives no rows. Figures of each source (not of documents) come to the driver;
    more than max_sources of them is an error. Columns in keep named like the new ones are replaced.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in keep if c.lower() not in ("size", "source_size", "target", "copies", "taken", doc_id.lower()))
    id_col = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    sized = durable(docs.select(
        F.col(doc_id), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(F.concat(id_col, F.lit(":"), F.coalesce(F.col(text), F.lit("")))), 1, 16).alias("_hash"),
    ), "mixing")
    per_source = {r[0]: r[1] for r in sized.groupBy("_source").agg(F.sum("size")).limit(max_sources + 1).collect()}
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    name = {s: s[1:] if s[0] == "s" else None for s in per_source}
    by_name = targets({name[s]: n for s, n in per_source.items()}, weights, share, most)
    goal = {s: by_name[name[s]] for s in per_source}
    # a budget for each copy of each source; prefix: the bucket where it ends; before: words in the buckets under it
    state = {}
    for s, n in per_source.items():
        for copy in (1, 2):
            budget = min(max(goal[s] - (copy - 1) * n, 0.0), float(n))
            state[s, copy] = {"budget": budget, "prefix": "", "before": 0, "whole": budget >= n, "none": budget <= 0}
    digits = 0
    for level in LEVELS:
        open_ = [(s, c, x["prefix"], x["before"], x["budget"]) for (s, c), x in state.items() if not (x["whole"] or x["none"])]
        if not open_:
            break
        bounds = spark.createDataFrame(open_, "_source string, copy int, prefix string, before long, budget double")
        digits += level
        running = Window.partitionBy("_source", "copy").orderBy("bucket")
        ends = (
            sized.join(F.broadcast(bounds), "_source").filter(F.expr(f"left(_hash, {digits - level}) = prefix"))
            .groupBy("_source", "copy", "before", "budget", F.expr(f"left(_hash, {digits})").alias("bucket")).agg(F.sum("size").alias("words"))
            .withColumn("upto", F.col("before") + F.sum("words").over(running)).filter("upto > budget")
            .groupBy("_source", "copy").agg(F.min(F.struct("bucket", "upto", "words")).alias("end")).collect()
        )
        for r in ends:
            state[r["_source"], r["copy"]] |= {"prefix": r["end"]["bucket"], "before": r["end"]["upto"] - r["end"]["words"], "upto": r["end"]["upto"]}
    rows = []
    for (s, c), x in state.items():
        take = x["whole"] or (not x["none"] and x["upto"] - x["budget"] < x["budget"] - x["before"])
        rows.append((s, c, "g" if x["whole"] else "" if x["none"] else x["prefix"], take and not x["none"]))
    last = {(s, c): (p, t) for s, c, p, t in rows}
    bounds = spark.createDataFrame([(s, n, goal[s], *last[s, 1], *last[s, 2]) for s, n in per_source.items()], "_source string, source_size long, target double, end1 string, with1 boolean, end2 string, with2 boolean")
    under = lambda i: F.expr(f"cast(_hash < end{i} or (with{i} and _hash = end{i}) as int)")
    return (
        sized.join(F.broadcast(bounds), "_source").withColumn("copies", under(1) + under(2))
        .select(doc_id, *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )
