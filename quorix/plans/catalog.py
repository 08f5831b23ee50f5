"""Every scoring query, by name, with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.functions import features as feature
from quorix.functions import scalar
from quorix.operators import evaluate, knn, score
from quorix.plans.oracle import ORACLE, ROUNDS, SAMPLE, D, K
from quorix.sources import fixture, readers
from quorix.sources.shared import numbered, scratch, stored
from quorix.streaming import scoring

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(rows: DataFrame, keys: list[str], array: str, out: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(array).alias("dim", out)).withColumn("dim", F.col("dim").cast("long"))


def _emb(spark, d) -> tuple[DataFrame, DataFrame]:
    refs = fixture.embeddings(spark, d)
    return refs, refs.where("orig_id % 20 = 0").select(F.col("orig_id").alias("qid"), "q")


def _risks(spark) -> DataFrame:
    return readers.default_risks(spark)


def _vectors(spark, d) -> DataFrame:
    return score.vectors(fixture.transactions(spark, d), _risks(spark), "tx_id", ["fraud"])


def _numbered(spark, payloads) -> DataFrame:
    """(tx_id, fraud, orig_id, q) with ids by order of transaction.

    Features are sorted and then quantized: with both in one stage its generated code is too large to be compiled.
    """
    rows = score.featured(payloads, _risks(spark), ["tx_id", "fraud"])
    return numbered(rows, "tx_id", "orig_id", "references", then=lambda ordered: score.quantized(ordered, ["tx_id", "fraud"]))


def _refs(rows) -> DataFrame:
    return rows.select("orig_id", "q", F.col("fraud").alias("label"))


def _queries(rows) -> DataFrame:
    return rows.where("tx_id % 20 = 0").select(F.col("tx_id").alias("qid"), "q")


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    """refs: all rows (orig_id, q, label) with ids by order of transaction; queries (qid, q): those whose id is divisible by 20."""
    rows = _numbered(spark, fixture.transactions(spark, d))
    return _refs(rows), _queries(rows)


def _centroids(refs: DataFrame, rounds: int = ROUNDS) -> list[list[float]]:
    return knn.train(refs, K, D, SAMPLE, rounds)


def _index(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs, queries = _split(spark, d)
    vectors, clusters = score.build_index(refs, D, score.Options(clusters=K, sample=SAMPLE, iterations=ROUNDS))
    return queries, vectors, clusters


def _centroid_rows(spark, centroids) -> DataFrame:
    return _long(spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cluster_id long, x array<double>"), ["cluster_id"], "x", "x")


@query
def quantize_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _long(fixture.embeddings(spark, d).withColumnRenamed("orig_id", "vec_id"), ["vec_id"], "q", "q")


@query
def dequantize_grid(spark, d):
    rows = _long(fixture.embeddings(spark, d).withColumnRenamed("orig_id", "vec_id"), ["vec_id"], "q", "q")
    return rows.select("vec_id", "dim", scalar.dequantize(F.col("q")).cast("double").alias("g"))


@query
def pairwise_sq_l2(spark, d):
    refs, queries = _emb(spark, d)
    return knn.distances(refs, queries)


@query
def knn_brute_top5(spark, d):
    return knn.brute_force(*_emb(spark, d)).select("qid", "orig_id", "d", "rank")


@query
def knn_vote_score(spark, d):
    refs, queries = _emb(spark, d)
    return knn.vote(queries, knn.brute_force(refs, queries))


@query
def decision_table(spark, d):
    return knn.decide(spark.range(knn.K + 1).select(F.col("id").alias("frauds")))


@query
def response_body(spark, d):
    return decision_table(spark, d).select("frauds", knn.body().alias("body"))


@query
def tx_features(spark, d):
    return feature.features(fixture.transactions(spark, d), _risks(spark), ["tx_id"])


@query
def tx_quantized(spark, d):
    return _long(_vectors(spark, d), ["tx_id"], "q", "q")


@query
def tx_score(spark, d):
    refs, queries = _split(spark, d)
    return score.answers(queries, refs)


@query
def mcc_lookup(spark, d):
    return feature.with_risk(fixture.transactions(spark, d), _risks(spark)).select("tx_id", "mcc_risk")


@query
def mcc_overlay(spark, d):
    found = spark.createDataFrame([("5411", 0.9), ("1234", 0.1)], "mcc_code string, risk float")
    return readers.overlay_risks(_risks(spark), found)


@query
def unknown_merchant(spark, d):
    return fixture.transactions(spark, d).select("tx_id", feature.unknown_merchant().alias("unknown"))


@query
def unknown_merchant_antijoin(spark, d):
    rows = fixture.transactions(spark, d)
    known = rows.select(F.col("tx_id").alias("t"), F.explode("customer.known_merchants").alias("m"))
    return rows.join(known, (F.col("tx_id") == F.col("t")) & (F.col("merchant.id") == F.col("m")), "left_anti").select("tx_id")


def _bodies(spark, d, rows: DataFrame | None = None) -> DataFrame:
    rows = fixture.transactions(spark, d) if rows is None else rows
    return rows.select("tx_id", F.to_json(F.struct(*[f.name for f in feature.PAYLOAD.fields])).alias("body"))


def _spoiled(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Bodies of which some have a quoted number, no amount, an infinite number, or a short time."""
    i, body = F.col("tx_id"), F.col("body")
    out = F.when(i % 7 == 1, F.regexp_replace(body, r'"amount":([^,}]+)', r'"amount":"$1"'))
    out = out.when(i % 11 == 2, F.regexp_replace(body, r'"installments":[^,}]+,', ""))
    out = out.when(i % 13 == 3, F.regexp_replace(body, r'"km_from_home":[^,}]+', '"km_from_home":1e40'))
    out = out.when(i % 17 == 4, F.regexp_replace(body, r'"requested_at":"([^"]{10})[^"]*"', r'"requested_at":"$1"')).otherwise(body)
    return _bodies(spark, d, rows).withColumn("body", out)


@query
def validate_payload(spark, d):
    return readers.parse_payloads(_spoiled(spark, d)).select("tx_id", feature.is_valid().alias("is_valid"))


@query
def route_status(spark, d):
    i, body = F.col("tx_id"), F.col("body")
    rows = _bodies(spark, d).withColumn("body", F.when(i % 7 == 1, F.regexp_replace(body, '"amount"', '"amounts"')).when(i % 11 == 2, F.rpad(body, score.MAX_BODY + 1, " ")).otherwise(body))
    rows = readers.parse_payloads(rows.withColumn("route", F.when(i % 5 == 0, "GET /ready HTTP/1.1").when(i % 5 == 1, "GET / HTTP/1.1").otherwise("POST /fraud-score HTTP/1.1")))
    return rows.select("tx_id", score.status(F.col("route"), F.col("body"), feature.is_valid()).alias("status"))


@query
def hour_weekday(spark, d):
    ts = F.date_format("ts", fixture.ISO)
    return fixture.table(spark, d, "events").select("event_id", scalar.iso_hour(ts).alias("hour"), scalar.iso_weekday(ts).alias("weekday"))


@query
def minutes_between(spark, d):
    rows = fixture.transactions(spark, d).where("last_transaction is not null")
    return rows.select("tx_id", scalar.minutes_between(F.col("transaction.requested_at"), F.col("last_transaction.timestamp")).alias("minutes"))


@query
def days_from_civil(spark, d):
    return fixture.table(spark, d, "events").select("event_id", scalar.days_from_civil(F.year("ts"), F.month("ts"), F.day("ts")).alias("days"))


@query
def json_features(spark, d):
    return feature.features(readers.parse_payloads(_bodies(spark, d)), _risks(spark), ["tx_id"])


@query
def systematic_sample(spark, d):
    return knn.sample_rows(_split(spark, d)[0], SAMPLE, K).select("place", "orig_id")


@query
def kmeans_init(spark, d):
    return _centroid_rows(spark, knn.initial_centroids(knn.sample_rows(_split(spark, d)[0], SAMPLE, K), K, D))


@query
def kmeans_step(spark, d):
    return _centroid_rows(spark, _centroids(_split(spark, d)[0], 1))


@query
def kmeans_train(spark, d):
    return _centroid_rows(spark, _centroids(_split(spark, d)[0]))


@query
def assign_clusters(spark, d):
    return _index(spark, d)[1].select("orig_id", "cluster_id")


@query
def cluster_sizes(spark, d):
    return _index(spark, d)[2].select("cluster_id", "n")


@query
def empty_clusters(spark, d):
    return _index(spark, d)[2].agg(F.count_if(F.col("n") == 0).alias("empty"))


@query
def cluster_bbox(spark, d):
    clusters = _index(spark, d)[2]
    return clusters.select("cluster_id", F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "b")).select("cluster_id", F.col("dim").cast("long").alias("dim"), "b.lo", "b.hi")


@query
def cluster_offsets(spark, d):
    return _index(spark, d)[2].select("cluster_id", "start_off", "end_off")


@query
def cluster_positions(spark, d):
    _, vectors, clusters = _index(spark, d)
    return knn.positions(vectors, clusters)


@query
def centroid_distance(spark, d):
    queries, _, clusters = _index(spark, d)
    return knn.centroid_rows(queries, clusters, D).select("qid", "cluster_id", "cd")


@query
def nprobe_clusters(spark, d):
    queries, _, clusters = _index(spark, d)
    return knn.probes(queries, clusters, 3, K, D).select("qid", "cluster_id", "probe")


@query
def nprobe_clamp(spark, d):
    """Probes asked for beyond what there is: none gives one, too many give every cluster with rows."""
    queries, _, clusters = _index(spark, d)
    asked = [knn.probes(queries, clusters, n, K, D).select(F.lit(n).alias("asked"), "qid", "cluster_id", "probe") for n in (0, 9999)]
    return asked[0].unionByName(asked[1])


@query
def bbox_lower_bound(spark, d):
    queries, _, clusters = _index(spark, d)
    return queries.join(F.broadcast(clusters.where("n > 0"))).select("qid", "cluster_id", knn.box_bound(F.col("q"), F.col("lo"), F.col("hi"), D).alias("lb"))


@query
def repair_candidates(spark, d):
    queries, vectors, clusters = _index(spark, d)
    probed = knn.probes(queries, clusters, 1, K, D)
    return knn.repair(queries, clusters, knn.seeds(probed, vectors, clusters), probed, knn.K, D).select("qid", "cluster_id", "lb")


@query
def ivf_search(spark, d):
    queries, vectors, clusters = _index(spark, d)
    return knn.search(queries, vectors, clusters, 1, K, D)[0].select("qid", "orig_id", "d", "rank")


@query
def ivf_search_stats(spark, d):
    queries, vectors, clusters = _index(spark, d)
    return knn.scan_statistics(knn.search(queries, vectors, clusters, 1, K, D)[1], clusters)


@query
def small_n_vote(spark, d):
    refs, queries = _split(spark, d)
    return knn.vote(queries, knn.brute_force(refs.where("orig_id < 3"), queries))


@query
def tie_break_top5(spark, d):
    refs, queries = _split(spark, d)
    thrice = refs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("orig_id") * 3 + F.col("k")).alias("orig_id"), "q", "label")
    return knn.exact(thrice, queries).select("qid", "orig_id", "d", "rank")


@query
def profile_averages(spark, d):
    rows = numbered(fixture.table(spark, d, "events").select("event_id"), "event_id", "seq", "requests", 1)
    rows = rows.select("seq", (F.col("event_id") % 7 + 1).alias("parse"), (F.col("event_id") % 101 + 3).alias("search"), (F.col("event_id") % 5 + 2).alias("write"))
    return evaluate.running_profile(rows, 100)


def _judged(spark, d) -> DataFrame:
    """Flags of tx_score's votes beside the labels, both from the same numbered rows."""
    rows = _numbered(spark, fixture.transactions(spark, d))
    votes = score.answers(_queries(rows), _refs(rows)).select("tx_id", F.when(F.col("tx_id") % 300 != 0, F.col("frauds") >= 3).alias("flagged"))
    return votes.join(rows.where("tx_id % 20 = 0").select("tx_id", "fraud"), "tx_id")


@query
def confusion_matrix(spark, d):
    return evaluate.confusion(_judged(spark, d))


@query
def p99_score(spark, d):
    rows = fixture.table(spark, d, "events").select(((F.col("event_id") % 97).cast("double") / 4 + 0.5).alias("latency_ms"))
    return evaluate.p99(rows)


@query
def weighted_error(spark, d):
    return evaluate.weighted_error(evaluate.confusion(_judged(spark, d)))


@query
def readiness(spark, d):
    _, vectors, clusters = _index(spark, d)
    return evaluate.readiness(vectors, clusters)


@query
def references_json_scan(spark, d):
    """References written as one JSON array and read again."""
    rows = fixture.table(spark, d, "embeddings").orderBy("vec_id").coalesce(1)
    item = F.to_json(F.struct(F.slice("embedding", 1, 10).alias("vector"), F.when(F.col("label") < 3, "fraud").otherwise("legit").alias("label")))
    lines = F.concat(F.when(F.col("vec_id") == rows.agg(F.min("vec_id")).first()[0], "[").otherwise(","), item)
    path = scratch(spark, "references")
    rows.select(lines.alias("value")).unionByName(spark.createDataFrame([("]",)], "value string")).coalesce(1).write.option("compression", "gzip").text(path)
    return _long(readers.read_references(spark, path), ["orig_id", "label"], "vector", "x").withColumn("x", F.col("x").cast("double"))


@query
def index_roundtrip(spark, d):
    refs, _ = _split(spark, d)
    path = scratch(spark, "index")
    vectors, clusters = score.build_index(refs, D, score.Options(clusters=K, sample=SAMPLE, iterations=ROUNDS))
    readers.write_index(vectors, clusters, path, K, D)
    found, _, _ = readers.read_index(spark, path, K, D)
    return _long(found.withColumn("cluster_id", F.col("cluster_id").cast("long")), ["orig_id", "label", "cluster_id"], "q", "q")


@query
def stream_score(spark, d):
    # Bodies and references come from the same purchases; their windows are computed once.
    seen = stored(fixture.purchases(spark, d), "purchases")
    # Of the references' ids only the order counts here: they keep those of their transactions, so nothing is sorted.
    rows = stored(score.featured(fixture.payloads(seen), _risks(spark), ["tx_id", "fraud"]), "references")
    refs, path = _refs(score.quantized(rows, ["tx_id", "fraud"]).withColumnRenamed("tx_id", "orig_id")), scratch(spark, "stream")
    _spoiled(spark, d, fixture.payloads(seen)).where("tx_id % 20 = 0").write.parquet(f"{path}/in")
    scoring.start(scoring.read_bodies(spark, f"{path}/in"), refs, _risks(spark), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/scores").select("tx_id", "frauds", "fraud_score", "approved", "body")
