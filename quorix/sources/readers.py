"""Reference vectors, category risks, request bodies; index tables and their checks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.functions.features import DEFAULT_RISKS, PAYLOAD, WIDTH
from quorix.functions.scalar import SCALE

REFERENCE = "vector array<float>, label string"


def fixed_length(vector, width: int = WIDTH):
    """Exactly so many floats: short ones end in zeros, long ones are cut."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(vector, i), F.lit(0.0)).cast("float"))


def read_references(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """(orig_id, vector, label) of a JSON array, gzipped if its name says so; orig_id is the place in it.

    The array is one record of one file, read by one task, so the order of rows is
    that of the file; ids are given there, before any shuffle.
    """
    rows = spark.read.schema(REFERENCE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.monotonically_increasing_id().alias("orig_id"), fixed_length(F.col("vector"), width).alias("vector"), (F.coalesce(F.col("label") == "fraud", F.lit(False))).cast("int").alias("label"))
    if not out.take(1):
        raise ValueError(f"{path} has no reference vectors")
    return out


def default_risks(spark: SparkSession) -> DataFrame:
    # From Arrow it is a local relation, for which no Python workers are started.
    return spark.createDataFrame(pa.table({"mcc_code": list(DEFAULT_RISKS), "risk": pa.array(list(DEFAULT_RISKS.values()), pa.float32())}))


def overlay_risks(defaults: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found where there are any for a code, else the default."""
    return defaults.select("mcc_code", F.col("risk").alias("_d")).join(found.select("mcc_code", F.col("risk").alias("_f")), "mcc_code", "full").select("mcc_code", F.coalesce("_f", "_d").cast("float").alias("risk"))


def read_risks(spark: SparkSession, path: str | None) -> DataFrame:
    """Defaults, overlaid with a JSON object of code to risk; a missing file or an empty object changes nothing."""
    defaults = default_risks(spark)
    if path is None:
        return defaults
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return defaults
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,float>")).alias("mcc_code", "risk"))
    return overlay_risks(defaults, pairs.where(F.col("mcc_code").rlike("^[0-9]{4}") & F.col("risk").isNotNull()).select(F.substring("mcc_code", 1, 4).alias("mcc_code"), "risk"))


def parse_payloads(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with the payload's fields beside their own columns; what can't be read is null."""
    return bodies.withColumn("_p", F.from_json(body, PAYLOAD)).select(*bodies.columns, *[F.col(f"_p.{f.name}").alias(f.name) for f in PAYLOAD.fields])


def write_index(vectors: DataFrame, clusters: DataFrame, path: str, k: int, d: int, scale: int = SCALE) -> None:
    vectors.repartition("cluster_id").sortWithinPartitions("cluster_id", "orig_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/vectors")
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    n = clusters.agg(F.sum("n")).first()[0] or 0
    meta = json.dumps({"format": 1, "n": int(n), "k": k, "d": d, "scale": scale})
    vectors.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_index(spark: SparkSession, path: str, k: int | None = None, d: int | None = None, scale: int = SCALE) -> tuple[DataFrame, DataFrame, dict]:
    """vectors, clusters and metadata; raises where they don't fit what is asked for or each other."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    for name, want in (("format", 1), ("k", k), ("d", d)):
        if want is not None and meta.get(name) != want:
            raise ValueError(f"{path}: {name} is {meta.get(name)}, not {want}")
    if abs(meta["scale"] - scale) > 0.01:
        raise ValueError(f"{path}: scale is {meta['scale']}, not {scale}")
    vectors, clusters = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/clusters")
    if vectors.count() != meta["n"] or clusters.count() != meta["k"]:
        raise ValueError(f"{path}: its tables are not as long as its metadata says")
    return vectors, clusters, meta
