"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key divided by its quality weight (Efraimidis and Spirakis); the
smallest keys of a source are a weighted sample. A source is taken as often whole as its target allows,
and the rest of the target goes to the documents with the smallest keys.

No source is ever sorted whole. A histogram over equal ranges of the key gives the range in which the
budget of a source ends; only that range, one of `RANGES`, is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upliftlens.functions.hashing import uniform_draw
from upliftlens.llm.common import SPACE, Scratch, word_count

#: Ranges of the key. A sort holds about this fraction of a source.
RANGES = 4096
SALT = "mix"


def quality_weight(text: Column) -> Column:
    """From 1 for plain prose down to 1/11 for nothing but odd characters."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(text, f"[\\p{{L}}\\p{{N}}{SPACE}.,;:!?'\"()-]++", ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * odd / F.greatest(F.length(text), F.lit(1)))


def sample_key(doc_id: Column, weight: Column, salt: str = SALT) -> Column:
    """An exponential variable with the document's weight as its rate, fixed by the id."""
    return -F.ln(uniform_draw([F.coalesce(doc_id.cast("string"), F.lit("null"))], salt) + 2.0**-53) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources by code point (NULL last) weigh 1, 2, 3, 1, ...; all targets sum to all sizes. A target stops
    at three times its source's size, and the excess goes to the others by weight. That fixes one level,
    target = min(3 * size, level * weight), found from running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    ratio = F.lit(3.0) * F.col("source_size") / F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * 3).over(before), F.lit(0))
    ) / F.sum("weight").over(onward)
    leveled = weighed.withColumn("ratio", ratio).withColumn("level", level)
    common = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(whole)
    cap = F.lit(3.0) * F.col("source_size")
    return leveled.withColumn("common", common).select(
        "source", "source_size", F.least(cap, F.coalesce(F.col("common") * F.col("weight"), cap)).alias("target")
    )


def mix_sources(
    docs: DataFrame, scratch: Scratch | None = None, weight: Column | None = None, ranges: int = RANGES
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, copies.

    size: words of the text (NULL: 0). taken = copies * size. A document is taken in the last, partial
    round if at least half of it fits into what is left, so a source misses its target by at most half
    a document. Rows that repeat an id are mixed like any others. Sources without words have target 0.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    weight = quality_weight(F.col("text")) if weight is None else weight
    sized = scratch.save(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), sample_key(F.col("doc_id"), weight).alias("key")
        ).withColumn("range", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * ranges).cast("int")),
        "sized",
    )
    histogram = scratch.save(
        sized.groupBy("source", "range").agg(F.sum("size").alias("words")), "histogram"
    )
    targets = source_targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = targets.withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    targets = scratch.save(targets, "targets")

    running = Window.partitionBy("source").orderBy("range")
    ends = (
        histogram.withColumn("until", F.sum("words").over(running))
        .join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("until") > F.col("rest")) & (F.col("until") - F.col("words") <= F.col("rest")))
        .groupBy("source")
        .agg(
            F.min(F.struct("range", (F.col("rest") - (F.col("until") - F.col("words"))).alias("left"))).alias("last")
        )
        .select(F.col("source").alias("s"), F.col("last.range").alias("last_range"), "last.left")
    )
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = scratch.save(plan.withColumnRenamed("source", "s"), "plan")
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    # Where no range ends the budget, the rest is the whole source or nothing.
    within = F.col("range") < F.col("last_range")
    outside = F.coalesce(F.col("range") != F.col("last_range"), F.lit(True))
    plain = planned.filter(outside).withColumn(
        "once", F.coalesce(within, F.col("rest") >= F.col("source_size")).cast("int")
    )
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        planned.filter(~outside)
        .withColumn("until", F.sum("size").over(in_order))
        .withColumn("once", (F.col("until") - F.col("size") / 2 <= F.col("left")).cast("int"))
        .drop("until")
    )
    # without a rest there is no partial round, for documents without words neither
    partial = F.when(F.col("rest") > 0, F.col("once")).otherwise(0)
    copies = (F.col("rounds") + partial).cast("int")
    return plain.unionByName(cut).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).cast("long").alias("taken"),
        copies.alias("copies"),
        "source",
    )
