"""Reading the raw event log from CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from upliftlens import schemas
from upliftlens.functions.identity import user_key, whole_number
from upliftlens.functions.text import missing_to_null

# Position of a row in its file, whatever the split sizes: breaks ties between equal times. Files have
# no order of their own, so a hash stands for the path, which every event carries to its session.
INPUT_ORDER = "input_order"
USER_TEXT = "user_id_text"
# How user ids are read: as whole numbers, or as texts of any form
IDS = ("number", "text")


def load_raw(spark: SparkSession, path: str, multiline: bool = False, ids: str = "number") -> DataFrame:
    """The eight event columns, picked by header name; other columns of the file are not parsed.

    `price` stays text so that cleaning can tell numbers from junk. A time keeps its wall clock:
    a zone suffix such as 'UTC' is accepted and not applied. Quoted fields that span lines need
    `multiline`, which makes a file unsplittable. With `ids="text"` the user id is a text, see `user_key`;
    otherwise an id that is no whole number counts as missing.
    """
    if ids not in IDS:
        raise ValueError(f"ids must be one of {', '.join(IDS)}")
    reader = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    try:
        text = reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(
            f"no event log at '{path}': pass a CSV file or folder with the columns "
            + ", ".join(schemas.RAW_EVENTS.names)
        ) from error
    missing = [name for name in schemas.RAW_EVENTS.names if name not in text.columns]
    if missing:
        raise ValueError(f"event log '{path}' lacks the columns {', '.join(missing)}")

    columns = []
    for field in schemas.RAW_EVENTS.fields:
        text_column = F.col(field.name)
        if field.name == "user_id" and ids == "text":
            value = user_key(text_column)
        elif isinstance(field.dataType, StringType):
            value = missing_to_null(text_column)
        elif isinstance(field.dataType, LongType):
            value = whole_number(text_column)
        else:
            value = text_column.try_cast(field.dataType)  # no missing-value token is a number or time
        columns.append(value.alias(field.name))
    position = F.struct(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # the id as the file has it, for the events whose id is no number
    columns.append(F.col("user_id").alias(USER_TEXT))
    return text.select(*columns, position.alias(INPUT_ORDER))

