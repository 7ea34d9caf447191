"""What several operators share: intermediate tables, word patterns, Arrow slices and word codes."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that separates words, as the body of a character class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


class Scratch:
    """Intermediate tables of one run, in the folder that all executors share.

    The folder is `spark.checkpoint.dir` of the session. Where that is unset, a local master gets a
    temporary folder that goes at exit, and a cluster a folder in its warehouse. Tables of a cluster
    stay until the folder's expiry removes them, since the result reads them.
    """

    def __init__(self, spark: SparkSession) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.conf.get("spark.master", "").startswith(("local[", "local")) and not spark.conf.get(
                "spark.master", ""
            ).startswith("local-cluster"):
                base = tempfile.mkdtemp(prefix="scratch-")
                atexit.register(shutil.rmtree, base, ignore_errors=True)
            else:
                base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        self.spark, self.root = spark, f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back; an earlier table of that name is replaced."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


    def free(self, *names: str) -> None:
        """Empty tables that nothing reads any more, neither a later step nor the result."""
        for name in names:
            path = f"{self.root}/{name}"
            schema = self.spark.read.parquet(path).schema
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

    def tidy(self) -> None:
        """Let the driver drop what it no longer holds, so that Spark removes the shuffle files of steps that are done."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """`df.mapInArrow`, whose workers can import this package wherever they run."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{os.path.basename(package)}.zip", "w") as packed:
            for place, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(place, name)
                        packed.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(packed.filename)
        _SHIPPED.add(context.applicationId)
    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has; NULL counts as empty. Each word becomes one mark, marks are counted."""
    trimmed = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.length(F.regexp_replace(trimmed, f"[^{SPACE}]++[{SPACE}]*+", "x")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts have at most `max_bytes`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words as codes: (code of each word, offsets of the rows, the distinct words)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    if empty >= 0:  # ends of texts that begin or end with white space
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, flat.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fixed_array(counted: DataFrame, slot: str, value: str, size: int, empty: int = 0) -> Column:
    """A scalar array of `size` numbers from (slot, value) rows, at most one per slot.

    Its size is fixed, whatever the input's; slots without a row hold `empty`.
    """
    spark = counted.sparkSession
    kind = counted.schema[value].dataType
    blank = spark.range(size).select(F.col("id").alias(slot), F.lit(empty).cast(kind).alias(value))
    filled = counted.select(F.col(slot).cast("long").alias(slot), value).unionByName(blank)
    one = filled.groupBy(slot).agg(F.max(value).alias(value))
    listed = F.array_sort(F.collect_list(F.struct(slot, value)))
    return one.agg(F.transform(listed, lambda x: x[value]).alias("all")).scalar()


def hashed_members(keys: DataFrame, key: str, words: int = 131072):
    """A test whether a key may be among `keys`; it is sure when it says no. 32 bits per word.

    It keeps rows out of a shuffle; a join must follow. Its size is fixed, whatever the number of keys.
    """
    h = F.xxhash64(key)
    marked = keys.select(_slot(h, words).alias("slot"), one_bit(_bit(h)).alias("bits"))
    marks = marked.groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    table = fixed_array(marks, "slot", "bits", words)

    def test(column: Column) -> Column:
        h = F.xxhash64(column)
        found = F.element_at(table, (_slot(h, words) + 1).cast("int"))
        return found.bitwiseAND(one_bit(_bit(h))) != 0

    return test


def one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _slot(h: Column, words: int) -> Column:
    return F.pmod(F.shiftright(h, 5), F.lit(words).cast("long"))


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(31)).cast("int")
