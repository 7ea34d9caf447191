"""Runs: each writes its tables to a folder of its own and is published by one manifest row at the end.

Readers ask the manifest for the latest run, so they see all tables of one run, whatever happens to another run
between two of its tables. The manifest is a small JSON table; Spark commits the file of a new row by a rename.
Files of earlier runs stay, as readers may hold them; files of a run without a manifest row belong to nobody.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upliftlens.sources.storage import read_parquet, write_parquet

MANIFEST = "sequence bigint, run string, folder string, about string, tables string"


@dataclass(frozen=True)
class Stored:
    """A table of a run: its files, its schema and the fingerprint of what it was made of."""

    path: str
    schema: str
    fingerprint: str

    def read(self, spark: SparkSession) -> DataFrame:
        return read_parquet(spark, self.path, StructType.fromJson(json.loads(self.schema)))


@dataclass(frozen=True)
class Manifest:
    """A published run. `about` holds what the run says of itself: its input and parameters."""

    sequence: int
    run: str
    folder: str
    about: dict
    tables: dict[str, Stored]


def fingerprint(*parts: object) -> str:
    """One hash of texts, numbers and what JSON can hold, in order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def input_fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files below `path`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum(each).alias("hashes")).first()
    return fingerprint(seen.n, seen.length, str(seen.hashes))


def published(spark: SparkSession, out: str) -> Manifest | None:
    """The latest published run of an output folder; None without one."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{out.rstrip('/')}/manifest")
        last = rows.orderBy(F.col("sequence").desc(), F.col("run").desc()).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if last is None:
        return None
    tables = {name: Stored(**entry) for name, entry in json.loads(last.tables).items()}
    return Manifest(last.sequence, last.run, last.folder, json.loads(last.about), tables)


def latest(spark: SparkSession, out: str) -> Manifest:
    found = published(spark, out)
    if found is None:
        raise FileNotFoundError(f"no published run in '{out}'")
    return found


@dataclass
class Run:
    """A run that is being written. Nothing of it can be seen before `publish`."""

    spark: SparkSession
    out: str
    about: dict = field(default_factory=dict)
    tables: dict[str, Stored] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.out = self.out.rstrip("/")
        self.name = uuid.uuid4().hex
        self.folder = f"{self.out}/runs/{self.name}"

    def path(self, name: str) -> str:
        return f"{self.folder}/tables/{name}"

    def store(self, df: DataFrame, name: str, made_of: str = "") -> DataFrame:
        write_parquet(df, self.path(name))
        return self.add(name, self.path(name), df.schema, made_of)

    def add(self, name: str, path: str, schema: StructType, made_of: str = "") -> DataFrame:
        """Enter files that have been written."""
        self.tables[name] = Stored(path, schema.json(), made_of)
        return self.tables[name].read(self.spark)

    def publish(self) -> Manifest:
        before = published(self.spark, self.out)
        entries = json.dumps({name: vars(t) for name, t in self.tables.items()})
        row = ((before.sequence if before else 0) + 1, self.name, self.folder, json.dumps(self.about), entries)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.out}/manifest")
        return latest(self.spark, self.out)
