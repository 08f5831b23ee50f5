"""Scoring of an unbounded stream of request bodies, a batch at a time, with the same code as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorix.operators import score

BODIES = "tx_id long, body string"


def read_bodies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(BODIES).format(fmt).load(path)


def start(bodies: DataFrame, refs: DataFrame, risks: DataFrame, out: str, checkpoint: str, options: score.Options | None = None, once: bool = True, clusters: DataFrame | None = None) -> StreamingQuery:
    """Scores go to out/scores, bad records to out/rejected; a batch that runs again replaces its own files.

    refs and risks are static; each batch of bodies is one set of queries against all
    refs, or a search of the index whose vectors and clusters are given. Stop it with
    ``query.stop()``; once: stop when what is there is done.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        good, bad = score.score_bodies(batch, refs, risks, "tx_id", options, clusters)
        good.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/scores/batch={epoch}")
        bad.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rejected/batch={epoch}")

    writer = bodies.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counters(bodies: DataFrame, name: str) -> DataFrame:
    """The stream with cumulative counts of each batch under ``name`` in the query's progress."""
    size = F.octet_length("body")
    return bodies.observe(name, F.count("*").alias("requests"), F.sum(size).alias("bytes"), F.count_if(size > score.MAX_BODY).alias("too_large"))
