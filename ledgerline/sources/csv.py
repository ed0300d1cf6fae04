"""CSV scan with the original application's tolerance rules (A1).

* header row, UTF-8;
* rows with MORE fields than the header are skipped, rows with fewer are NULL-padded;
* the NA spellings below read as NULL;
* column types inferred per column (integer, double, boolean, else string) in one pass.

Spark's stock modes do not give this: DROPMALFORMED also drops short rows and PERMISSIVE keeps
long rows truncated. Both row kinds land in the corrupt-record column, so long rows are
recognised by counting their fields outside quoted strings.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Optional
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: strings read as missing (the default NA list of pandas' CSV reader)
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOL_VALUES = ["True", "False", "true", "false", "TRUE", "FALSE"]
_CORRUPT = "_corrupt_record"
_QUOTED = '"([^"]|"")*"'
# the form of every string that casts to a double (and of some that do not, like "1.2.3")
_NUMBER = (
    r"\A[\x00-\x20]*[+-]?(?:[0-9.]+(?:[eE][+-]?[0-9]+)?[fFdD]?|0[xX][0-9a-fA-F.]*[pP][+-]?[0-9]+[fFdD]?"
    r"|[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)[\x00-\x20]*\z"
)
# the form of every string that casts to a bigint (and of some that do not, like a number of thirty digits)
_WHOLE = r"\A[\x00-\x20\x7f]*[+-]?[0-9]*[\x00-\x20\x7f]*\z"
# what some value of a column does not allow, as bits
_NO_LONG, _NO_DOUBLE, _NO_BOOL = 1, 2, 4


def files_with_broken_lines(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(files, those of them in which a quoted field may hold a line break): a line with an odd number of quotes
    opens or closes a field that goes on in another line. One scan of the text; only file names are collected."""
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
    found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_or(odd).alias("broken"))
    rows = sorted((unquote(r["file"]), r["broken"]) for r in found.collect())
    return [f for f, _ in rows], [f for f, broken in rows if broken]


def read_csv(
    spark: SparkSession, path: str | Sequence[str], infer_types: bool = True, multi_line: Optional[bool] = None
) -> DataFrame:
    """The files of ``path``. All must have the same header: columns go by position, and a file with
    another one is an error. Quoted fields may hold line breaks: files in which one may are found first
    (``files_with_broken_lines``) and read by one task each, the others are split. ``multi_line`` says it for
    all files instead, without looking."""
    paths = [path] if isinstance(path, str) else list(path)
    if multi_line is not None:
        kept = _rows(spark, paths, multi_line)
    else:
        files, broken = files_with_broken_lines(spark, paths)
        whole = set(broken)
        split = [f for f in files if f not in whole]
        if not broken:
            kept = _rows(spark, paths, False)
        elif not split:
            kept = _rows(spark, paths, True)
        else:
            kept = _rows(spark, split, False)
            other = _rows(spark, broken, True)
            if other.columns != kept.columns:
                raise ValueError(f"files with different headers: {kept.columns} and {other.columns}")
            kept = kept.unionByName(other)
    header = kept.columns
    na = F.array(*[F.lit(v) for v in NA_VALUES])
    clean = kept.select(*[F.when(F.array_contains(na, F.col(c)) | F.col(c).isNull(), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) for c in header])
    return infer_column_types(clean) if infer_types else clean


def _rows(spark: SparkSession, paths: Sequence[str], multi_line: bool) -> DataFrame:
    """Rows as strings, without those that have more fields than the header."""
    read = spark.read.option("header", True).option("multiLine", multi_line)
    header = read.option("inferSchema", False).csv(list(paths)).columns
    schema = StructType([StructField(c, StringType()) for c in header] + [StructField(_CORRUPT, StringType())])
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line).option("enforceSchema", False).option("mode", "PERMISSIVE").option("escape", '"')
        .option("columnNameOfCorruptRecord", _CORRUPT).option("nullValue", None)
        .schema(schema).csv(list(paths))
    )
    n_fields = F.size(F.split(F.regexp_replace(F.col(_CORRUPT), _QUOTED, ""), ",", -1))
    # the condition also reads the first data column: Spark refuses scans whose only
    # referenced column is the corrupt-record column (e.g. a bare row count)
    anchor = F.length(F.coalesce(F.col(header[0]), F.lit(""))) >= 0
    return raw.where((F.col(_CORRUPT).isNull() | (n_fields <= len(header))) & anchor).drop(_CORRUPT)


def as_double(v: Column) -> Column:
    """The string as a double, or null. The cast raises and catches an exception for each string that is no number,
    which costs many times what reading one does; so the form of the string is looked at first."""
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def as_long(v: Column) -> Column:
    """The string as a bigint, or null; see ``as_double``."""
    return F.when(v.rlike(_WHOLE), v.try_cast("bigint"))


def refused_types(df: DataFrame) -> DataFrame:
    """(pos, bits): per column that has values, the types that some value of it does not allow. The values are
    unpivoted, so that the tests stand once in the plan, not once per column."""
    each = df.select(F.posexplode(F.array(*[F.col(c) for c in df.columns])).alias("pos", "v")).where(F.col("v").isNotNull())
    v = F.col("v")
    tests = [(as_long(v).isNull(), _NO_LONG), (as_double(v).isNull(), _NO_DOUBLE), (~v.isin(BOOL_VALUES), _NO_BOOL)]
    bits = [F.when(test, F.lit(bit)).otherwise(F.lit(0)) for test, bit in tests]
    return each.groupBy("pos").agg(F.bit_or(bits[0] + bits[1] + bits[2]).alias("bits"))


def infer_column_types(df: DataFrame) -> DataFrame:
    """Cast string columns to bigint / double / boolean when every non-null value allows it."""
    cols = df.columns
    found = dict(refused_types(df).collect()) if cols else {}  # a number per column
    stats = [found.get(i) for i in range(len(cols))]
    out = []
    for c, bits in zip(cols, stats):
        if bits is None:
            out.append(F.col(c).cast("double").alias(c))  # an all-missing column is float
        elif not bits & _NO_BOOL:
            out.append(F.lower(F.col(c)).cast("boolean").alias(c))
        elif not bits & _NO_LONG:
            out.append(F.col(c).try_cast("bigint").alias(c))
        elif not bits & _NO_DOUBLE:
            out.append(F.col(c).try_cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
