"""Features, neighbours, index and sources on small cases with known answers."""

import gzip
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorix.functions import features, scalar
from quorix.operators import evaluate, knn, score
from quorix.sources import readers

# The two payloads with published answers, and their vectors.
LEGIT = {"id": "a", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"}, "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None}
FRAUD = {"id": "b", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"}, "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008"]}, "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None}
GOLDEN = [[41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60], [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55]]


def bodies(spark, *items):
    return spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(items)], "tx_id long, body string")


def test_golden_vectors(spark):
    rows = score.vectors(readers.parse_payloads(bodies(spark, LEGIT, FRAUD)), readers.default_risks(spark), "tx_id").orderBy("tx_id").collect()
    assert [r["q"] for r in rows] == GOLDEN


def changed(path, value):
    out = json.loads(json.dumps(LEGIT))
    *up, last = path.split(".")
    at = out
    for k in up:
        at = at[k]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


@pytest.mark.parametrize(
    "body,valid",
    [
        (LEGIT, True), (changed("transaction.amount", "41.12"), False), (changed("transaction.amount", ...), False), (changed("transaction.amount", 1e40), False),
        (changed("transaction.requested_at", "2026-03-11"), False), (changed("customer.known_merchants", ...), True), (changed("last_transaction", {"timestamp": "2026-03-11T18:00:00Z"}), False),
        (changed("last_transaction", {"timestamp": "2026-03-11T18:00:00Z", "km_from_current": 3.5}), True), (changed("last_transaction", 5), True), ("not json", False), (None, False), ("{}", False),
    ],
)
def test_validation(spark, body, valid):
    got = readers.parse_payloads(bodies(spark, body)).select(features.is_valid()).first()[0]
    assert bool(got) == valid


def test_minutes_ignore_zone_and_session(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.range(1).select(scalar.minutes_between(F.lit("2026-03-08T03:30:59+03:00"), F.lit("2026-03-08T01:30:00Z")).alias("m"), scalar.iso_hour(F.lit("2026-03-08T23:30:59+03:00")).alias("h")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert (row["m"], row["h"]) == (120, 23)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), min_size=1, max_size=40))
def test_quantize(spark, values):
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v float").orderBy("i").select(scalar.quantize(F.col("v"))).collect()]
    want = []
    for v in np.array(values, np.float32):
        x = np.float32(min(max(v, np.float32(-1)), np.float32(1))) * np.float32(10000)
        want.append(int(np.float32(x + np.float32(0.5 if v >= 0 else -0.5))))
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(), min_size=1, max_size=20))
def test_civil_days_and_weekday(spark, days):
    rows = spark.createDataFrame([(i, d.isoformat() + "T00:00:00Z") for i, d in enumerate(days)], "i int, s string").orderBy("i")
    got = rows.select(scalar.iso_weekday(F.col("s")).alias("w"), scalar.iso_seconds(F.col("s")).alias("t")).collect()
    assert [r["w"] for r in got] == [d.weekday() for d in days]
    assert [r["t"] for r in got] == [(d.toordinal() - 719163) * 86400 for d in days]


def synthetic(spark, per=17):
    """256 clusters of vectors around evenly spaced centres."""
    rows = []
    for c in range(256):
        centre = -10000 + 20000 * c // 255
        for k in range(per):
            i = c * per + k
            rows.append((i, [max(-10000, min(10000, centre + (i + j) % 21 - 10)) for j in range(14)], i & 1))
    return spark.createDataFrame(rows, "orig_id long, q array<int>, label int")


QUERIES = [
    [.01, .02, .03, .04, .05, -1, -1, .06, .07, 1, 0, 1, .5, .08],
    [.10, .20, .30, .40, .50, -1, -1, .60, .70, 1, 0, 1, .5, .80],
    [1, 1, 1, 1, 1, .2, .3, 1, 1, 0, 1, 0, .85, 1],
]
NEAREST = [[2296, 2295, 2311, 2310, 2297], [2809, 2814, 2815, 2816, 2817], [3775, 3776, 3796, 3777, 3774]]


def queries(spark):
    return spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(QUERIES)], "qid long, v array<float>").select("qid", F.transform("v", lambda x: scalar.quantize(x)).alias("q"))


def ids(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["orig_id"])
    return [out[k] for k in sorted(out)]


def test_synthetic_neighbours(spark):
    refs = synthetic(spark)
    found = knn.brute_force(refs, queries(spark))
    assert ids(found) == NEAREST
    assert [r["frauds"] for r in knn.vote(queries(spark), found).orderBy("qid").collect()] == [3, 3, 2]


@pytest.mark.parametrize("nprobe", [1, 4, 99])
def test_index_equals_brute_force(spark, nprobe):
    refs = synthetic(spark, 4)
    vectors, clusters = score.build_index(refs, 14, score.Options(clusters=8, iterations=2, sample=256))
    found, scanned = knn.search(queries(spark), vectors, clusters, nprobe, 8, 14)
    assert ids(found) == ids(knn.brute_force(refs, queries(spark)))
    stats = knn.scan_statistics(scanned, clusters).collect()
    assert len(stats) == 3 and all(1 <= r["scanned_clusters"] <= 8 and r["scanned_vectors"] <= 1024 for r in stats)


def test_empty_clusters_and_few_rows(spark):
    refs = spark.createDataFrame([(i, [5] * 14, 1) for i in range(3)], "orig_id long, q array<int>, label int")
    vectors, clusters = score.build_index(refs, 14, score.Options(clusters=4, iterations=2, sample=10))
    rows = clusters.orderBy("cluster_id").collect()
    assert [r["n"] for r in rows] == [3, 0, 0, 0] and rows[1]["lo"] == [0] * 14
    found, _ = knn.search(queries(spark), vectors, clusters, 1, 4, 14)
    votes = knn.vote(queries(spark), found).collect()
    assert {r["frauds"] for r in votes} == {3} and not any(r["approved"] for r in votes)


def test_ties_by_id(spark):
    refs = spark.createDataFrame([(i, [7] * 14, i % 2) for i in (9, 3, 5, 1, 8, 2, 7)], "orig_id long, q array<int>, label int").repartition(5)
    assert ids(knn.brute_force(refs, queries(spark)))[0] == [1, 2, 3, 5, 7]


def test_no_queries_or_refs(spark):
    refs = synthetic(spark, 1)
    assert knn.brute_force(refs, queries(spark).limit(0)).count() == 0
    assert [r["frauds"] for r in knn.vote(queries(spark), knn.brute_force(refs.limit(0), queries(spark))).collect()] == [0, 0, 0]


def test_systematic_sample():
    assert knn.systematic_sample(10, 4, 2) == [(0, 0), (1, 2), (2, 5), (3, 7)]
    assert [i for _, i in knn.systematic_sample(3, 10, 6)] == [0, 0, 1, 1, 2, 2]


def test_references(spark, tmp_path):
    items = [{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [0.25], "label": "legit"}, {"vector": [1.0] * 20, "label": "Fraud"}]
    path = tmp_path / "refs.json.gz"
    path.write_bytes(gzip.compress(json.dumps(items).encode()))
    rows = readers.read_references(spark, f"file://{path}").orderBy("orig_id").collect()
    assert [r["orig_id"] for r in rows] == [0, 1, 2] and [r["label"] for r in rows] == [1, 0, 0]
    assert rows[1]["vector"] == [0.25] + [0.0] * 13 and len(rows[2]["vector"]) == 14
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.read_references(spark, f"file://{tmp_path}/none.json")


def test_risks(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"5411": 0.9, "12345": 0.1, "x": 1}')
    got = {r[0]: round(r[1], 4) for r in readers.read_risks(spark, f"file://{tmp_path}/r.json").collect()}
    assert got["5411"] == 0.9 and got["1234"] == 0.1 and got["7995"] == 0.85 and "x" not in got
    assert readers.read_risks(spark, f"file://{tmp_path}/missing.json").count() == 10


def test_index_is_checked(spark, tmp_path):
    vectors, clusters = score.build_index(synthetic(spark, 1), 14, score.Options(clusters=4, iterations=1, sample=64))
    readers.write_index(vectors, clusters, f"file://{tmp_path}/i", 4, 14)
    found, _, meta = readers.read_index(spark, f"file://{tmp_path}/i", 4, 14)
    assert found.count() == meta["n"] == 256
    for bad in ({"k": 5}, {"d": 3}, {"scale": 1}):
        with pytest.raises(ValueError):
            readers.read_index(spark, f"file://{tmp_path}/i", **bad)


def test_bad_bodies_go_aside(spark):
    refs = synthetic(spark, 1)
    long = json.dumps(LEGIT) + " " * score.MAX_BODY
    good, bad = score.score_bodies(bodies(spark, LEGIT, "nope", long, None), refs, readers.default_risks(spark))
    assert [r["tx_id"] for r in good.collect()] == [0]
    assert {r["tx_id"]: r["status"] for r in bad.collect()} == {1: 400, 2: 413, 3: 400}


def test_options(spark):
    spark.conf.set("spark.quorix.nprobe", "7")
    spark.conf.set("spark.quorix.k", "many")
    got = score.Options.of(spark)
    spark.conf.unset("spark.quorix.nprobe")
    spark.conf.unset("spark.quorix.k")
    assert (got.nprobe, got.k, got.clusters) == (7, 5, 256)


@pytest.mark.parametrize("p,want", [(3.99, 2399.0271), (0.5, 3000), (2500, -3000)])
def test_latency_score(spark, p, want):
    assert abs(spark.range(1).select(evaluate.latency_score(F.lit(float(p)))).first()[0] - want) < 0.5


def test_observed_counters(spark):
    from quorix.streaming import scoring

    rows = scoring.counters(bodies(spark, LEGIT, None), "seen")
    assert rows.count() == 2


def test_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 100)
    refs = synthetic(spark, 4)
    vectors, clusters = score.build_index(refs, 14, score.Options(clusters=3, iterations=2, sample=256))
    asked = refs.select(F.col("orig_id").alias("qid"), "q")
    found, _ = knn.search(asked, vectors, clusters, 1, 3, 14)
    assert ids(found) == ids(knn.brute_force(refs, asked))


def test_scores_by_index_equal_brute_force(spark, data):
    from quorix.plans import catalog
    from quorix.sources import fixture

    refs, _ = catalog._split(spark, data)
    vectors, clusters = score.build_index(refs, 14, score.Options(clusters=8, iterations=2, sample=256))
    payloads, risks = fixture.transactions(spark, data).where("tx_id % 20 = 0"), readers.default_risks(spark)
    by_index, by_all = (score.score(payloads, r, risks, clusters=c).collect() for r, c in ((vectors, clusters), (refs, None)))
    assert by_all and sorted(by_index) == sorted(by_all)


def test_folders_take_the_scheme_of_the_file_system(spark, tmp_path):
    from quorix.sources.shared import qualified

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}"


def test_more_queries_than_are_broadcast(spark, monkeypatch):
    refs = synthetic(spark, 2)
    asked = refs.select(F.col("orig_id").alias("qid"), "q").where("qid % 7 = 0")
    near, far = knn.brute_force(refs, asked).collect(), knn.distances(refs, asked).collect()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 10)
    monkeypatch.setattr(knn, "BLOCK", 50)
    monkeypatch.setattr(knn, "PAIR_BLOCK", 50)
    assert knn.few(asked) is None
    assert sorted(knn.brute_force(refs, asked).collect()) == sorted(near)
    assert sorted(knn.distances(refs, asked).collect()) == sorted(far) and len(far) == 74 * 512


def few_pairs(monkeypatch):
    """From now on every search is too large for brute force."""
    def refuse(*_):
        raise AssertionError("brute force")

    for name, value in (("MOST_PAIRS", 0), ("PART", 64), ("LEAF", 8), ("BLOCK", 50), ("brute_force", refuse)):
        monkeypatch.setattr(knn, name, value)


@pytest.mark.parametrize("values", [3, 40, 10_000])
def test_pruned_search_equals_brute_force(spark, monkeypatch, values):
    """Many ties and copies, some; every copy of a query is answered, and one id that asks twice."""
    r = np.random.default_rng(values)
    rows = r.integers(0, values, (600, 4))
    rows[:200] = rows[0]
    refs = spark.createDataFrame([(int(i), [int(x) for x in v], int(i) % 2) for i, v in zip(r.permutation(600), rows)], "orig_id long, q array<int>, label int").repartition(3)
    asked = spark.createDataFrame([(i // 2 if i < 4 else i, [int(x) for x in v]) for i, v in enumerate(np.concatenate([rows[150:350], r.integers(-5, values + 5, (50, 4))]))], "qid long, q array<int>")
    want = sorted(knn.brute_force(refs, asked).collect())
    tiny = sorted(knn.brute_force(refs.where("orig_id < 3"), asked).collect())
    few_pairs(monkeypatch)
    assert sorted(knn.exact(refs, asked).select("qid", "orig_id", "label", "d", "rank").collect()) == want and len(want) == 248 * 5
    assert sorted(knn.exact(refs.where("orig_id < 3"), asked).select("qid", "orig_id", "label", "d", "rank").collect()) == tiny


@pytest.mark.parametrize("name", ["tx_score", "tie_break_top5", "stream_score", "confusion_matrix", "weighted_error"])
def test_large_searches_are_pruned(spark, data, monkeypatch, name):
    from quorix.plans import catalog

    want = sorted(catalog.QUERIES[name](spark, data).collect())
    few_pairs(monkeypatch)
    assert sorted(catalog.QUERIES[name](spark, data).collect()) == want and want


@pytest.mark.parametrize("name", ["confusion_matrix", "weighted_error", "stream_score"])
def test_events_are_read_once(spark, data, monkeypatch, name):
    """References, queries and labels or bodies come from one computation of the fixture."""
    from quorix.plans import catalog
    from quorix.sources import fixture

    read, table = [], fixture.table
    monkeypatch.setattr(fixture, "table", lambda s, d, n: read.append(n) or table(s, d, n))
    catalog.QUERIES[name](spark, data)
    assert read.count("events") == 1


def test_equal_vectors_are_searched_as_one(spark, monkeypatch):
    """Each distinct vector is dealt once, and the k of least id of its rows are still all found."""
    refs = spark.range(600).select(F.col("id").alias("orig_id"), F.array(*[(F.col("id") % n).cast("int") for n in (2, 3, 5)]).alias("q"), (F.col("id") % 2).cast("int").alias("label"))
    asked = spark.range(40).select(F.col("id").alias("qid"), F.array(*[(F.col("id") % n).cast("int") for n in (4, 5, 6)]).alias("q"))
    want, seen, dealt = sorted(knn.brute_force(refs, asked).collect()), [], knn.dealt
    few_pairs(monkeypatch)
    monkeypatch.setattr(knn, "dealt", lambda rows, cuts: seen.append(rows.count()) or dealt(rows, cuts))
    assert sorted(knn.exact(refs, asked).select("qid", "orig_id", "label", "d", "rank").collect()) == want
    assert seen == [30, 40]


def test_copies_bound_the_pruned_search():
    """The k-th distance counts a vector as often as it has rows, and ties with it stay."""
    rows, ids = np.array([[0.0], [2], [-2], [3]]), np.arange(4)
    for copies, want in (([1, 1, 1, 1], [0, 1, 2, 3]), ([1, 4, 1, 1], [0, 1, 2]), ([5, 1, 1, 1], [0])):
        i, r, d = knn.pruned(np.zeros((1, 1)), rows, ids, 5, np.array([np.inf]), np.array(copies))
        assert sorted(r.tolist()) == want and not i.any()


def test_a_leaf_with_many_rows_in_reach_tightens_the_bound(monkeypatch):
    """The nearest leaf has the poorest rows, so its bound lets all others in."""
    rows = np.concatenate([np.tile([-1000.0, 1000.0], 16), np.arange(1.0, 801.0)])[:, None]
    monkeypatch.setattr(knn, "halves", lambda x, leaf: (np.arange(832), np.arange(32, 833, 100)))
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(knn.np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))
    i, r, d = knn.pruned(np.zeros((1, 1)), rows, np.arange(832), 5, np.array([np.inf]), np.ones(832, int))
    assert r.tolist() == [32, 33, 34, 35, 36] and d.tolist() == [1, 4, 9, 16, 25] and sorts == [5]


def test_bodies_are_parsed_once(spark):
    good, bad = score.score_bodies(bodies(spark, LEGIT, FRAUD, "nope"), synthetic(spark), readers.default_risks(spark))
    assert "from_json" not in "".join(x._jdf.queryExecution().optimizedPlan().toString() for x in (good, bad))
    assert (good.count(), bad.count()) == (2, 1)


def test_stream_references_are_not_sorted(spark, data, monkeypatch):
    """Only the order of their ids counts, and that is the order of their transactions."""
    from quorix.plans import catalog

    def refuse(*_, **__):
        raise AssertionError("numbered")

    monkeypatch.setattr(catalog, "numbered", refuse)
    assert catalog.stream_score(spark, data).count()


def test_texts_of_times_are_parsed_once(spark):
    """Hour, weekday and minutes: one parse of each date as a weekday, two for the minutes, whatever is done with them."""
    rows = features.features(readers.parse_payloads(bodies(spark, LEGIT)), readers.default_risks(spark), ["tx_id"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("weekday(") == 1 and plan.count("unix_date(") == 2


def test_an_index_on_disk_is_read_pruned(spark, tmp_path):
    refs = synthetic(spark, 2)
    vectors, clusters = score.build_index(refs, 14, score.Options(clusters=6, iterations=2, sample=256))
    readers.write_index(vectors, clusters, f"file://{tmp_path}/i", 6, 14)
    vectors, clusters, _ = readers.read_index(spark, f"file://{tmp_path}/i", 6, 14)
    pairs = knn.probes(queries(spark).limit(1), clusters, 1, 6, 14).withColumn("w0", F.lit(knn.FAR))
    plan = knn.scan(pairs, vectors, clusters)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan and "cast(cluster_id" in plan
    assert ids(knn.search(queries(spark), vectors, clusters, 1, 6, 14)[0]) == ids(knn.brute_force(refs, queries(spark)))


def test_votes_out_of_range_are_refused(spark):
    for bad in (-1, 6):
        with pytest.raises(Exception, match="votes out of range"):
            knn.decide(spark.createDataFrame([(bad,)], "frauds long")).collect()


def test_numbers_follow_the_order(spark):
    from quorix.sources.shared import numbered

    rows = spark.range(1000).select((F.col("id") * 7 % 1000 * 3).alias("key")).repartition(6)
    got = numbered(rows, "key", "n", "test", 1).orderBy("key").collect()
    assert [(r["key"], r["n"]) for r in got] == [(3 * i, i + 1) for i in range(1000)]
    assert numbered(rows.limit(0), "key", "n", "test").count() == 0


def test_jobs_build_and_serve(spark, tmp_path):
    from quorix import __main__ as job

    items = [{"vector": [((i * 37 + j * 11) % 100) / 100 for j in range(14)], "label": "fraud" if i % 3 else "legit"} for i in range(60)]
    (tmp_path / "refs.json").write_text(json.dumps(items))
    spark.conf.set("spark.quorix.clusters", "4")
    try:
        job.main(["build", f"file://{tmp_path}/refs.json", f"file://{tmp_path}/index"])
        asked = bodies(spark, LEGIT, FRAUD, "nope")
        asked.write.parquet(f"file://{tmp_path}/bodies")
        job.main(["serve", f"file://{tmp_path}/index", f"file://{tmp_path}/bodies", f"file://{tmp_path}/out", "--once"])
    finally:
        spark.conf.unset("spark.quorix.clusters")
    refs = readers.read_references(spark, f"file://{tmp_path}/refs.json").select("orig_id", F.transform("vector", lambda x: scalar.quantize(x)).alias("q"), "label")
    want, _ = score.score_bodies(asked, refs, readers.default_risks(spark))
    got = spark.read.parquet(f"file://{tmp_path}/out/answers/scores").select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    assert spark.read.parquet(f"file://{tmp_path}/out/answers/rejected").count() == 1
