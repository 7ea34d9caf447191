"""Table and CSV sinks, reading back, and intermediate results on shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    # the writer trims by default
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


@lru_cache(maxsize=None)
def _local_scratch(application_id: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"upliftlens-{application_id}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that any folder is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder named by `spark.checkpoint.dir`.

    Every executor must see the folder. Only a session in one process may go without the setting; its
    folder goes at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _local_scratch(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to shared storage and read it back.

    Later readers get column pruning, and a lost executor costs no recomputation of what came before.
    """
    path = scratch_dir(df.sparkSession, label)
    write_parquet(df, path)
    return read_parquet(df.sparkSession, path, df.schema)


def write_csv(df: DataFrame, path: str) -> None:
    """One file per partition; nothing is gathered into a single task."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read what `write_csv` wrote: an empty field is NULL, a quoted empty field an empty text."""
    reader = spark.read.schema(schema).options(**CSV_OPTIONS)
    return reader.option("nullValue", "\0").csv(path)


def write_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a catalog table; with `path` the files live there and not in the warehouse."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def create_table(spark: SparkSession, name: str, schema: StructType, path: str | None = None) -> None:
    """Drop and create an empty table with the fixed schema."""
    drop_table(spark, name)
    write_table(spark.createDataFrame([], schema), name, path)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def declare_table(
    spark: SparkSession, name: str, schema: StructType, defaults: Mapping[str, float], path: str
) -> None:
    """Drop and create a table whose columns declare their types and defaults; files below `path` are its rows."""
    drop_table(spark, name)
    columns = [
        f"{f.name} {f.dataType.simpleString()}" + (f" DEFAULT {defaults[f.name]}" if f.name in defaults else "")
        for f in schema.fields
    ]
    spark.sql(f"CREATE TABLE {name} ({', '.join(columns)}) USING PARQUET LOCATION '{path}'")


def insert_by_name(df: DataFrame, name: str) -> None:
    """Append to a declared table by column name; columns that `df` lacks get their defaults, or NULL."""
    columns = ", ".join(df.columns)
    df.sparkSession.sql(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {{rows}}", rows=df)


def multiset_digest(columns: Sequence[str]) -> Column:
    """Aggregate: row count and two sums of row hashes over all columns; the order of rows does not matter.

    A column's place and whether it is NULL are hashed with its value, so values can't change places unseen.
    """

    def row_hash(seed: int) -> Column:
        cells = [F.xxhash64(F.lit(seed + i), F.col(c).isNull(), F.col(c)) for i, c in enumerate(columns)]
        return F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))

    return F.struct(F.count(F.lit(1)).alias("rows"), row_hash(0).alias("a"), row_hash(1 << 20).alias("b"))


def stored_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
