"""Tables and folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, with the scheme of Hadoop's default file system if it names none; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        found = _own.get(spark.sparkContext.applicationId)
    if not found:
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quorix-")
        atexit.register(shutil.rmtree, found[7:], True)
    return found if "://" in found else qualified(spark, found)


def qualified(spark: SparkSession, found: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quorix-{tag}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: computed once, and a lost executor costs no lineage."""
    spark = rows.sparkSession
    path = scratch(spark, tag)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, by: str, name: str, tag: str, start: int = 0, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """rows with consecutive numbers in the order of ``by`` (unique): a distributed sort, then an offset a partition.

    The rows are stored before they are sorted, as a sort by ranges computes them twice, and
    after, so that numbers and offsets are of the same partitions; what is broadcast is a row
    a partition. ``then`` is done to the sorted rows, each by itself, before they are stored.
    """
    kept = stored(then(stored(rows, tag).orderBy(by)).withColumn("_id", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_id", 33)
    sizes = sorted(kept.groupBy(part.alias("p")).count().collect())
    offsets, total = [], start
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(offsets, "_p long, _first long")
    return kept.join(F.broadcast(first), part == F.col("_p")).withColumn(name, F.col("_first") + F.col("_id") - F.shiftleft("_p", 33)).drop("_id", "_p", "_first")
