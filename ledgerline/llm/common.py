"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Words are runs of anything but these characters (space, tab, line feed, vertical tab, form feed,
#: carriage return); ``bytes.split()`` uses the same set.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Rows handed to Python at a time, so that a batch of very long texts stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the session's checkpoint folder, and read again.

    Cuts the lineage in a way that survives lost executors; unlike ``checkpoint()`` later passes
    read only the columns they need. The files live as long as the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the executors and bound the rows of an Arrow batch."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of (id, text); rows that agree in both are the same row for every operator."""
    i, t = F.col(id_col), F.col(text_col)
    return F.xxhash64(i, i.isNull(), t, t.isNull())


def keyed(docs: DataFrame, id_col: str, text_col: str, more: Iterable[str] = ()) -> DataFrame:
    """(rid, rk, text, *more): id with null as 0, row key, text with null as empty."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("rid"),
        row_key(id_col, text_col).alias("rk"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def doc_key(id_col: str) -> Column:
    """The id of ``keyed``: null as 0. Joined beside the row key, so that a key that two texts share is told apart."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_rest(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> tuple[DataFrame, Callable[[str], str]]:
    """``docs`` joined by (id, row key) to ``found`` (rid, rk, ...), whose other columns get names that ``docs`` does not
    have; and the function from a column of ``found`` to its name there."""
    names = dict(zip(found.columns, free_names(docs, *found.columns)))
    rows = docs.withColumn(names["rid"], doc_key(id_col)).withColumn(names["rk"], row_key(id_col, text_col))
    return rows.join(found.toDF(*names.values()), [names["rid"], names["rk"]], how), names.__getitem__


def words(text: Column) -> Column:
    """The words of a text, in order (empty array for null)."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_CLASS), ""), F.array().cast("array<string>"))


def normal_text(text: Column) -> Column:
    """A text as its lines are compared: lower case, blanks as spaces, runs of spaces as one."""
    # looked for first: few texts have any, and replacing takes several times as long
    blanks = "\t\x0b\x0c\r"
    found = reduce(or_, [F.contains(text, F.lit(blank)) for blank in blanks])
    spaced = reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit(" ")), blanks, text)
    lower = F.lower(F.when(found, spaced).otherwise(text))
    return F.when(found | F.contains(text, F.lit("  ")), F.regexp_replace(lower, "  +", " ")).otherwise(lower)
