"""Requests to answers: routing, validation, features, neighbours, vote, body."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.functions import features as feature
from quorix.functions.scalar import SCALE, quantize
from quorix.operators import knn
from quorix.sources import readers
from quorix.sources.shared import stored

MAX_BODY = 32_768


@dataclass(frozen=True)
class Options:
    k: int = knn.K
    nprobe: int = 1
    clusters: int = 256
    iterations: int = 10
    sample: int = 131_072
    scale: int = SCALE

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "spark.quorix.") -> Options:
        """From the session's settings; what is unset or isn't a whole number keeps its default."""
        out = {}
        for name, field in cls.__dataclass_fields__.items():
            try:
                out[name] = int(spark.conf.get(prefix + name, str(field.default)))
            except ValueError:
                out[name] = field.default
        return cls(**out)


def status(route: Column, body: Column, valid: Column) -> Column:
    """The HTTP status of a request; route is the start of its request line."""
    scored = F.when(body.isNull(), 400).when(F.octet_length(body) > MAX_BODY, 413).when(F.coalesce(valid, F.lit(False)), 200).otherwise(400)
    return F.when(route.startswith("GET /ready"), 200).when(route.startswith("POST /fraud-score"), scored).otherwise(404)


def quantized(rows: DataFrame, keep: list[str], scale: int = SCALE) -> DataFrame:
    """keep and q, the fixed-point vector of f0 to f13."""
    return rows.select(*keep, F.array(*[quantize(F.col(n), scale) for n in feature.NAMES]).alias("q"))


def featured(payloads: DataFrame, risks: DataFrame, keep: list[str]) -> DataFrame:
    """keep and f0 to f13 of valid payloads."""
    return feature.features(payloads.where(feature.is_valid()), risks, keep)


def vectors(payloads: DataFrame, risks: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """(key, keep, q) of valid payloads."""
    return quantized(featured(payloads, risks, [key, *keep]), [key, *keep])


def score(payloads: DataFrame, refs: DataFrame, risks: DataFrame, key: str = "tx_id", options: Options | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(key, frauds, fraud_score, approved, body) of valid payloads, by exact search of all refs (orig_id, q, label).

    With clusters, refs are the vectors of an index (orig_id, q, label, cluster_id), and the
    same neighbours come from a search of it. Options are those of the session unless given.
    """
    return answers(vectors(payloads, risks, key).withColumnRenamed(key, "qid"), refs, key, options, clusters)


def answers(queries: DataFrame, refs: DataFrame, key: str = "tx_id", options: Options | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """What ``score`` gives, for queries (qid, q) that are vectors already."""
    options = options or Options.of(refs.sparkSession)
    if clusters is None:
        found = knn.exact(refs, queries, options.k)
    else:
        queries = stored(queries, "queries")
        found, _ = knn.search(queries, refs, clusters, options.nprobe, clusters.count(), len(feature.NAMES), options.k)
    votes = knn.vote(queries, found, options.k)
    return votes.withColumn("body", knn.body()).withColumnRenamed("qid", key)


def score_bodies(bodies: DataFrame, refs: DataFrame, risks: DataFrame, key: str = "tx_id", options: Options | None = None, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of the bodies (key, body) that are valid, and the rest as (key, body, status).

    What was parsed is stored: a filter on it would parse a body again for each field that it looks at.
    """
    parsed = stored(readers.parse_payloads(bodies), "parsed")
    good = feature.is_valid() & (F.octet_length("body") <= MAX_BODY)
    bad = parsed.where(~F.coalesce(good, F.lit(False))).select(key, "body", F.when(F.octet_length("body") > MAX_BODY, 413).otherwise(400).alias("status"))
    return score(parsed.where(good), refs, risks, key, options, clusters), bad


def build_index(refs: DataFrame, width: int, options: Options) -> tuple[DataFrame, DataFrame]:
    """(vectors, clusters) of refs (orig_id, q, label), stored in the shared folder."""
    centroids = knn.train(refs, options.clusters, width, options.sample, options.iterations)
    assigned = stored(knn.assign(refs, centroids), "vectors")
    return assigned, stored(knn.clusters_of(assigned, centroids, width), "clusters")
