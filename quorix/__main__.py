"""Jobs: ``python -m quorix build`` makes an index of references, ``serve`` scores bodies with it.

``build REFERENCES INDEX`` reads a JSON array and writes index tables. ``serve INDEX
BODIES OUT`` checks the index and scores Parquet files (tx_id, body) under BODIES as they
arrive; SIGTERM or SIGINT lets the batch at hand end, then stops. ``--once`` stops when
what is there is scored. Settings are those of ``Options`` under ``spark.quorix.``.
"""

from __future__ import annotations

import argparse
import signal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quorix.functions.features import WIDTH
from quorix.functions.scalar import quantize
from quorix.operators import score
from quorix.sources import readers
from quorix.streaming import scoring


def build(spark: SparkSession, references: str, index: str) -> None:
    options = score.Options.of(spark)
    refs = readers.read_references(spark, references).select("orig_id", F.transform("vector", lambda x: quantize(x, options.scale)).alias("q"), "label")
    vectors, clusters = score.build_index(refs, WIDTH, options)
    readers.write_index(vectors, clusters, index, options.clusters, WIDTH, options.scale)


def serve(spark: SparkSession, index: str, bodies: str, out: str, risks: str | None = None, once: bool = False) -> None:
    options = score.Options.of(spark)
    vectors, clusters, _ = readers.read_index(spark, index, options.clusters, WIDTH, options.scale)
    query = scoring.start(scoring.read_bodies(spark, bodies), vectors, readers.read_risks(spark, risks), f"{out}/answers", f"{out}/checkpoint", options, once, clusters)
    asked: list[int] = []
    before = {s: signal.signal(s, lambda s, _: asked.append(s)) for s in (signal.SIGTERM, signal.SIGINT)}
    try:
        while not query.awaitTermination(1):
            if asked and not query.status["isTriggerActive"]:
                query.stop()
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quorix", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("build")
    one.add_argument("references")
    one.add_argument("index")
    two = jobs.add_parser("serve")
    for name in ("index", "bodies", "out"):
        two.add_argument(name)
    two.add_argument("--risks")
    two.add_argument("--once", action="store_true")
    got = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if got.job == "build":
        build(spark, got.references, got.index)
    else:
        serve(spark, got.index, got.bodies, got.out, got.risks, got.once)


if __name__ == "__main__":
    main()
