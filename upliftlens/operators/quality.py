"""The tables' declared constraints as audits over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from upliftlens.schemas import TABLES

NOT_NULL = {"sessions": ("user_session", "user_id")}

DOMAINS: dict[str, dict[str, tuple]] = {
    "sessions": {
        "is_weekend": (0, 1),
        "converted": (0, 1),
        "cart_abandon": (0, 1),
        "is_new_user": (0, 1),
        "coupon_triggered": (0, 1),
        "user_type": ("New", "Returning"),
        "ab_group": ("A", "B"),
    },
    "ab_results": {"is_significant": (0, 1), "profit_pass": (0, 1)},
    "segment_results": {"ab_group": ("A", "B")},
    "profit_impact": {"verdict": ("Profitable", "Break-Even", "Loss")},
}

UNIQUE = {"sessions": "user_session", "ab_results": "ab_group"}


def _rules(table: str) -> dict[str, Column]:
    """Rule name -> condition that marks a violation. NULL passes a domain rule."""
    rules = {f"{c} not null": F.col(c).isNull() for c in NOT_NULL.get(table, ())}
    for column, values in DOMAINS.get(table, {}).items():
        listed = ",".join(map(str, values))
        rules[f"{column} in ({listed})"] = ~F.col(column).isin(*values)
    return rules


def rule_names(table: str) -> list[str]:
    """The rules of a table; a rule's place here is its bit in `broken_rules`."""
    return list(_rules(table))


def broken_rules(table: str) -> Column:
    """A bit for each rule that the row breaks, as a BIGINT."""
    bits = [F.when(violated, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, violated in enumerate(_rules(table).values())]
    return reduce(Column.__add__, bits, F.lit(0).cast("bigint"))


def rules_in(mask: Column, table: str) -> Column:
    """The names of the rules in a mask, joined by commas."""
    return F.concat_ws(", ", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(rule_names(table))])


def gate(df: DataFrame, table: str, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Store the rows that keep all rules of `table` apart from those that break one, in one pass.

    Returns the accepted rows, the quarantined ones with `broken_rules` and `rules`, and the counts that filled in
    during the write: `checked`, `accepted`, and the violations of each rule.
    """
    spark, mask, seen = df.sparkSession, F.col("broken_rules"), Observation(f"gate of {table}")
    ok = mask == 0
    counts = [F.count_if(mask.bitwiseAND(F.lit(1 << i)) != 0).alias(f"rule_{i}") for i in range(len(rule_names(table)))]
    checked = df.withColumn("broken_rules", broken_rules(table)).observe(
        seen, F.count(F.lit(1)).alias("checked"), F.count_if(ok).alias("accepted"), *counts
    )
    # both kinds of row in one write: the mask moves into the files of the broken ones only
    kept = F.when(~ok, F.struct("broken_rules", rules_in(mask, table).alias("rules"))).alias("broken")
    split = checked.select(*df.columns, kept, F.when(ok, "accepted").otherwise("quarantine").alias("part"))
    split.write.mode("overwrite").partitionBy("part").parquet(path)
    got = seen.get
    parts = []
    for part, n in (("accepted", got["accepted"]), ("quarantine", got["checked"] - got["accepted"])):
        if not n:  # Spark makes no folder for a part without rows
            split.drop("part").limit(0).write.mode("overwrite").parquet(f"{path}/part={part}")
        schema = split.drop("part").schema if part == "quarantine" else df.schema
        parts.append(spark.read.schema(schema).parquet(f"{path}/part={part}"))
    broken = parts[1].select(*df.columns, "broken.broken_rules", "broken.rules")
    named = {name: got[f"rule_{i}"] for i, name in enumerate(rule_names(table))}
    return parts[0], broken, {"checked": got["checked"], "accepted": got["accepted"], **named}


def gate_report(counts: dict[str, dict[str, int]], spark: SparkSession) -> DataFrame:
    """Rows (table_name, rule, checked, violations, accepted, quarantined) from the counts of each table's gate."""
    rows = [
        (table, rule, c["checked"], c[rule], c["accepted"], c["checked"] - c["accepted"])
        for table, c in counts.items()
        for rule in rule_names(table)
    ]
    schema = "table_name string, rule string, checked bigint, violations bigint, accepted bigint, quarantined bigint"
    return spark.createDataFrame(rows, schema)


def quality_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, rule, checked, violations): one pass per table for all its rules."""
    parts = []
    for name, df in tables.items():
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(rule).alias("rule"),
                    F.count(F.lit(1)).alias("checked"),
                    F.count_if(violated).alias("violations"),
                )
                for rule, violated in _rules(name).items()
            ]
        )
        parts.append(df.agg(rows.alias("rows")).select(F.inline("rows")))
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def quality_duplicates(
    tables: dict[str, DataFrame], unique: dict[str, str] = UNIQUE
) -> DataFrame:
    """Rows (table_name, key_name, duplicated_keys, surplus_rows) for keys that should be unique."""
    parts = [
        duplicate_keys(tables[name], key).agg(
            F.lit(name).alias("table_name"),
            F.lit(key).alias("key_name"),
            F.count(F.lit(1)).alias("duplicated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        )
        for name, key in unique.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def table_schemas(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, position, column_name, declared_type, type_ok, rows, nulls) per column."""
    parts = []
    for name, df in tables.items():
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(field.dataType.simpleString()).alias("declared_type"),
                    F.lit(int(df.schema[field.name].dataType == field.dataType)).alias("type_ok"),
                    F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col(field.name).isNull()).alias("nulls"),
                )
                for i, field in enumerate(TABLES[name].fields, start=1)
            ]
        )
        parts.append(df.agg(rows.alias("columns")).select(F.inline("columns")))
    return reduce(DataFrame.unionByName, parts)
