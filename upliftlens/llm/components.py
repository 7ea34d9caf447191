"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(a, b) links -> (id, component) for every id on a link; component is the smallest id reached.

    Every id holds a parent, at first itself. A round takes the grandparents of the neighbours, gives
    their minimum to the id and to its parent, and lets each id skip to its grandparent. Ids only go down,
    and rounds end when none does; their number grows as the logarithm of the longest path. A round is
    three joins and an aggregate with partial sums, so ids with very many links are spread.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both.filter("a != b").distinct(), f"{name}_links")
    parents = scratch.save(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p")),
        f"{name}_parents_0",
    )
    step = 0
    while True:
        step += 1
        up = parents.select(F.col("id").alias("p"), F.col("p").alias("g"))
        grand = parents.join(up, "p").select("id", "p", "g")
        least = (
            both.join(grand.select(F.col("id").alias("b"), F.col("g").alias("n")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("n").alias("n"))
        )
        least = scratch.save(grand.join(least, "id"), f"{name}_least")
        offers = (
            least.select("id", F.least("g", "n").alias("p"))
            .union(least.select(F.col("p").alias("id"), F.col("n").alias("p")))
            .groupBy("id")
            .agg(F.min("p").alias("p"))
        )
        parents = scratch.save(offers, f"{name}_parents_{step % 2}")
        # the sums of the parents tell whether any went down
        if _total(parents) == _total(least):
            return parents.select("id", F.col("p").alias("component"))


def roots(parents: DataFrame, scratch: Scratch, name: str = "roots") -> DataFrame:
    """(a, b) with one b < a for each a -> (id, component) for all of them, where the pointers end.

    A pointer forest needs no search over links: each round replaces a pointer by its pointer's.
    """
    ends = parents.select(F.col("b").alias("id")).join(parents.select(F.col("a").alias("id")), "id", "left_anti").distinct()
    known = parents.select(F.col("a").alias("id"), F.col("b").alias("p")).union(ends.select("id", F.col("id").alias("p")))
    known = scratch.save(known, f"{name}_0")
    step = 0
    while True:
        step += 1
        up = known.select(F.col("id").alias("p"), F.col("p").alias("g"))
        jumped = known.join(up, "p").select("id", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
        jumped = scratch.save(jumped, f"{name}_{step % 2 + 1}")
        known = jumped.select("id", "p")
        if not jumped.filter("moved").take(1):
            return known.select("id", F.col("p").alias("component"))


def _total(parents: DataFrame):
    return parents.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]

