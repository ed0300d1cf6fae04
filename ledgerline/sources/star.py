"""Verified keys and bucketed storage of the star tables.

Parquet does not enforce foreign keys, so a join may only be left out for data whose keys were looked at.
``verify`` counts the rows without a partner and the repeated partner keys of every constraint, once, and keeps
the result in the registry under a fingerprint of the tables' files; ``verified`` finds it for the same files
and no others. ``ingest`` also stores the tables, lineitem and orders bucketed by order key, so that the two join
without a shuffle; ``attach`` reads such a star in any later session.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .registry import _append, _delete, _exists, _table, store_root
from .tables import FOREIGN_KEYS, sales_of, table

TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")
#: Buckets of the two fact tables: a few per core of the cluster that reads them, so that a bucket pair fits a task.
BUCKETS = 64
_BUCKETED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def registry_root(spark: SparkSession, root: Optional[str] = None) -> str:
    """Where verified keys are kept: the stores' folder if one is named, else beside the checkpoints."""
    named = root or spark.conf.get("spark.ledgerline.store.root", None)
    return store_root(spark, named or f"{ensure_checkpoint_dir(spark)}/ledgerline-stores")


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """A hash of the names, lengths and modification times of the star tables' files."""
    jvm = spark.sparkContext._jvm
    said = []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = fs.getContentSummary(path)
        # reading a file may change its access time, nothing else does
        files = re.sub(r"access_time=\d+", "", jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(path)))
        said.append(f"{name} {size.getLength()} {size.getFileCount()} {files}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """foreign_key, n_rows, missing, repeated: per foreign key the rows of its table, those without a partner (NULL
    keys included), and the partner rows beyond the first of their key (each would double rows in a join).

    Both sides are counted per key first, so a frequent key is one row of the join.
    """
    parts = []
    for (child, key), (parent, target) in FOREIGN_KEYS.items():
        own = tables[child].groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        there = tables[parent].where(F.col(target).isNotNull()).groupBy(F.col(target).alias("k")).agg(F.count(F.lit(1)).alias("m"))
        both = own.join(there, "k", "full")  # a NULL key meets nothing
        parts.append(both.agg(
            F.lit(f"{child}.{key}").alias("foreign_key"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("missing"),
            F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m") - 1)), F.lit(0)).cast("bigint").alias("repeated"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _holding(report: DataFrame) -> tuple[DataFrame, list[str]]:
    rows = report.collect()  # one row per constraint
    held = report.sparkSession.createDataFrame(rows, report.schema)
    return held, sorted(r["foreign_key"] for r in rows if not r["missing"] and not r["repeated"])


def verify(spark: SparkSession, sf_dir: str, root: Optional[str] = None) -> DataFrame:
    """The key report of the star tables in ``sf_dir``; the constraints that hold are registered for these files."""
    files = fingerprint(spark, sf_dir)
    report, keys = _holding(key_report({t: table(spark, sf_dir, t) for t in TABLES}))
    if fingerprint(spark, sf_dir) == files:  # nothing changed while it was read
        _append(spark, "stars", [_row(files, sf_dir, keys)], registry_root(spark, root))
        _known(spark)[registry_root(spark, root), files] = frozenset(keys)
    return report


def verified(spark: SparkSession, sf_dir: str, root: Optional[str] = None) -> frozenset[str]:
    """The constraints ("table.column") that were verified for the files that are in ``sf_dir`` now."""
    conf = spark.conf
    if not (root or conf.get("spark.ledgerline.store.root", None) or conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        return frozenset()  # no place where a result could be
    at = registry_root(spark, root)
    known = _known(spark)
    if not known and not _exists(spark, f"{at}/stars"):
        return frozenset()
    files = fingerprint(spark, sf_dir)
    if (at, files) not in known:
        rows = _table(spark, "stars", at).where(F.col("fingerprint") == files).select("keys").limit(1).collect()
        if not rows:
            return frozenset()
        known[at, files] = frozenset(rows[0]["keys"])
    return known[at, files]


def _known(spark: SparkSession) -> dict:
    """Results that this application has read, by registry and fingerprint."""
    sc = spark.sparkContext
    if not hasattr(sc, "_ledgerline_stars"):
        sc._ledgerline_stars = {}
    return sc._ledgerline_stars


def _row(files: str, path: str, keys: list[str], star: str = "", buckets: int = 0) -> dict:
    return {
        "id": star, "fingerprint": files, "path": path, "keys": keys, "buckets": buckets,
        "created_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), "deleted": False,
    }


# ---- bucketed storage ---------------------------------------------------------------------------


@dataclass
class Star:
    """An ingested star: its tables, the constraints that hold, and the view made of them."""

    id: str
    tables: dict[str, DataFrame]
    keys: frozenset[str]

    def sales(self, columns: Optional[Iterable[str]] = None) -> DataFrame:
        return sales_of(self.tables, columns, self.keys, facts_first=True)


def ingest(spark: SparkSession, sf_dir: str, root: Optional[str] = None, buckets: int = BUCKETS) -> Star:
    """Store the star tables and verify their keys (as stored). Lineitem and orders are shuffled by order key once,
    here; later joins of both read bucket by bucket."""
    at, star = registry_root(spark, root), uuid.uuid4().hex[:12]
    path = f"{at}/stars-data/{star}"
    for name in TABLES:
        rows = table(spark, sf_dir, name)
        if name in _BUCKETED:
            key = _BUCKETED[name]
            writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            writer.option("path", f"{path}/{name}.parquet").saveAsTable(_name(star, name))
        else:
            rows.write.parquet(f"{path}/{name}.parquet")
    _, keys = _holding(key_report(_tables(spark, star, path, buckets)))
    _append(spark, "stars", [_row(fingerprint(spark, path), path, keys, star, buckets)], at)
    return Star(star, _tables(spark, star, path, buckets), frozenset(keys))


def attach(spark: SparkSession, star: str, root: Optional[str] = None) -> Star:
    """A star that was ingested before, in this session or another one. Its keys count only while its files are
    those that were verified; a missing id raises ``KeyError``."""
    rows = _table(spark, "stars", registry_root(spark, root)).where(F.col("id") == star).orderBy(F.desc("deleted")).limit(1).collect()
    if not rows or rows[0]["deleted"]:
        raise KeyError(f"Star not found: {star}")
    row = rows[0]
    same = fingerprint(spark, row["path"]) == row["fingerprint"]
    return Star(star, _tables(spark, star, row["path"], row["buckets"]), frozenset(row["keys"] if same else ()))


def drop(spark: SparkSession, star: str, root: Optional[str] = None) -> None:
    """Delete the stored copy and its registration; the tables it was made of are never touched."""
    at = registry_root(spark, root)
    row = _table(spark, "stars", at).where(F.col("id") == star).limit(1).collect()
    if not row:
        raise KeyError(f"Star not found: {star}")
    for name in _BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {_name(star, name)}")
    _delete(spark, row[0]["path"])
    _append(spark, "stars", [{**row[0].asDict(), "deleted": True}], at)


def _name(star: str, name: str) -> str:
    return f"ledgerline_star_{star}_{name}"


def _tables(spark: SparkSession, star: str, path: str, buckets: int) -> dict[str, DataFrame]:
    """The stored tables; the catalog learns of the bucketed ones where it does not know them."""
    out = {}
    for name in TABLES:
        at = f"{path}/{name}.parquet"
        if name not in _BUCKETED:
            out[name] = spark.read.parquet(at)
            continue
        if not spark.catalog.tableExists(_name(star, name)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(at).schema.fields)
            key = _BUCKETED[name]
            spark.sql(
                f"CREATE TABLE {_name(star, name)} ({columns}) USING parquet "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{at}'"
            )
        out[name] = spark.table(_name(star, name))
    return out
