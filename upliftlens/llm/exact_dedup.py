"""Exact duplicates by block naming.

A text without white space is cut into blocks of a fixed size. Distinct blocks are sorted and numbered;
the number is the block's name. Adjacent names are paired, distinct pairs are numbered in turn, and so
on until one name is left. Texts with the same number of blocks are equal exactly if their last names
are equal. Block contents are shuffled once, after a partial aggregation, so a text with millions of
copies counts once per task; everything else moves numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import SPACE, Scratch


def block_key(salt: int, block: Column) -> tuple[Column, Column]:
    """128 bits that look a block's name up."""
    return F.xxhash64(F.lit(2 * salt), block), F.xxhash64(F.lit(2 * salt + 1), block)


def exact_dedup(
    docs: DataFrame,
    scratch: Scratch | None = None,
    block_bytes: int = 16384,
    key: Callable[[int, Column], tuple[Column, Column]] = block_key,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_blocks, name.

    Texts are equal if they are identical without white space. Of equal texts the row with the most code
    points in the original stays, then the one with the smallest doc_id (NULL last); of rows that repeat
    a doc_id, one. NULL text counts as empty, and all empty texts are one group. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    body = docs.select(
        "doc_id",
        F.length(text).alias("n_code"),
        F.regexp_replace(text, f"[{SPACE}]++", "").cast("binary").alias("body"),
    ).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int"))
    indexes = F.sequence(F.lit(0), F.col("n_blocks") - 1)

    def block(i: Column) -> Column:
        return F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))

    for salt in count():
        names = _numbered(
            body.select(F.explode(F.transform(indexes, block)).alias("block")).select(
                *_keys(key, salt), "block"
            ),
            ["block"],
            ["h1", "h2"],
        )
        names = scratch.save(names, "names_0")
        # two blocks under one key would mix their names up; another key then
        if not names.groupBy("h1", "h2").count().filter("count > 1").take(1):
            break

    rows = scratch.save(
        body.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_code",
            "n_blocks",
            F.sha2("body", 256).alias("text_sha256"),
            F.transform(indexes, lambda i: F.struct(*_keys(key, salt, block(i)))).alias("keys"),
        ),
        "rows",
    )
    level = scratch.save(
        rows.select("row", F.col("n_blocks").alias("n"), F.posexplode("keys").alias("pos", "k"))
        .select("row", "n", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .join(names, ["h1", "h2"])
        .select("row", "n", "pos", "name"),
        "level_0",
    )
    finished = level.filter("n = 1").select("row", "name")
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    step = 0
    while longest > 1:
        step, longest = step + 1, -(-longest // 2)
        pairs = scratch.save(
            level.filter("n > 1")
            .groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), "n")
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            ),
            f"pairs_{step}",
        )
        names = scratch.save(_numbered(pairs.select("a", "b"), ["a", "b"], ["a", "b"]), f"names_{step}")
        level = scratch.save(
            pairs.join(names, ["a", "b"]).select(
                "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"
            ),
            f"level_{step}",
        )
        finished = finished.unionByName(level.filter("n = 1").select("row", "name"))

    named = scratch.save(rows.drop("keys").join(finished, "row"), "named")
    best = F.struct(
        (-F.col("n_code")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"
    )
    groups = scratch.save(
        named.groupBy("n_blocks", "name").agg(
            F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    # Both sides are read from tables, so that a group with very many rows can be split in the join.
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "n_blocks",
        "name",
    )


def _keys(key: Callable, salt: int, block: Column | None = None) -> list[Column]:
    h1, h2 = key(salt, F.col("block") if block is None else block)
    return [h1.alias("h1"), h2.alias("h2")]


def _numbered(df: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Distinct rows, numbered in sort order within each partition: each number belongs to one row."""
    ordered = df.distinct().sortWithinPartitions(*order)
    return ordered.select(*keep, F.monotonically_increasing_id().alias("name"))
