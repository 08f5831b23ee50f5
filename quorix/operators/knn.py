"""Exact k nearest neighbours in quantized space, votes, and the index that prunes the search.

Distances are squared, in whole numbers; neighbours are ordered by (distance, id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quorix import ship
from quorix.sources.shared import stored

K = 5
#: Queries that go to all executors, with 64 dimensions 10 MB; more are dealt with the vectors in blocks.
QUERY_BLOCK = 20_000
FAR = 9_223_372_036_854_775_807
#: Vectors, and queries, that one task of an indexed search compares: with 64 dimensions, 17 MB each.
BLOCK = 32_768
#: The same where every distance is put out: a million rows a task at a time.
PAIR_BLOCK = 1_024
#: Distances that brute force may compute; larger searches are pruned by boxes.
MOST_PAIRS = 2_000_000_000
#: Vectors of a part of a pruned search, of a leaf inside a block, and those whose values place the cuts between parts.
PART, LEAF, CUT_SAMPLE = 16_384, 256, 65_536


def squared_distance(a: Column, b: Column, width: int) -> Column:
    """Unrolled, so that it stays in generated code."""
    total = None
    for j in range(width):
        gap = a[j].cast("long") - b[j].cast("long")
        total = gap * gap if total is None else total + gap * gap
    return total


def ranked(pairs: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of each query of (qid, d, orig_id, ...), with rank."""
    w = Window.partitionBy("qid").orderBy("d", "orig_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vectors_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query, ties by id; exact: all numbers are whole and under 2**53.

    With bound, only rows at most that far count.
    """
    d = np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", rows, rows)[None] - 2 * (queries @ rows.T)
    if bound is not None:
        worst = bound
    else:
        worst = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    q, r = np.nonzero(d <= worst[:, None])
    order = np.lexsort((ids[r], d[q, r], q))
    q, r = q[order], r[order]
    n = np.bincount(q, minlength=len(d))
    keep = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) < k
    q, r = q[keep], r[keep]
    return q, r, d[q, r]


def halves(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the ends of its leaves: halved at the median of the widest column, down to ``leaf`` rows or equal ones."""
    order, ends, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        part = x[order[a:b]]
        wide = np.ptp(part, 0)
        j = int(wide.argmax())
        if b - a <= leaf or not wide[j]:
            ends.append(b)
            continue
        m = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, j], m)]
        todo += [(a + m, b), (a, a + m)]
    return order, np.array(ends)


def gaps(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least squared distances of each query from any vector in each box."""
    total = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        x = q[:, j, None]
        gap = np.maximum(lo[None, :, j] - x, x - hi[None, :, j])
        np.maximum(gap, 0, out=gap)
        total += gap * gap
    return total


def kth(d: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The k-th distance of each row of d if each column counts with its copies; there are k in all at least."""
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
    d = np.take_along_axis(d, near, 1)
    by = d.argsort(axis=1)
    enough = np.cumsum(np.take_along_axis(copies[near], by, 1), axis=1) >= k
    return np.take_along_axis(np.take_along_axis(d, by, 1), enough.argmax(1)[:, None], 1)[:, 0]


def pruned(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``nearest`` gives, but only rows at most as far as bound count, and none beyond the k-th if each counts with its copies.

    Leaves whose boxes are farther off are passed over.
    """
    order, ends = halves(rows, LEAF)
    begin = np.append(0, ends[:-1])
    x, bound, times = rows[order], bound.astype(np.float64), copies[order]
    lo, hi = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    own = np.einsum("ij,ij->i", x, x)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, 1_000_000 // len(ends))
    for start in range(0, len(queries), step):
        q, w = queries[start : start + step], bound[start : start + step]
        mine = np.einsum("ij,ij->i", q, q)
        lb = gaps(q, lo, hi)

        def far(some, leaf):
            a, b = begin[leaf], ends[leaf]
            return mine[some, None] + own[None, a:b] - 2 * (q[some] @ x[a:b].T)

        # The k-th of the nearest leaf bounds the rest.
        home = lb.argmin(1)
        by = np.argsort(home, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(home[by])) + 1):
            leaf = home[some[0]]
            some = some[lb[some, leaf] <= w[some]]
            if len(some) and times[begin[leaf] : ends[leaf]].sum() >= k:
                w[some] = np.minimum(w[some], kth(far(some, leaf), times[begin[leaf] : ends[leaf]], k))
        for leaf in range(len(ends)):
            some = np.flatnonzero(lb[:, leaf] <= w)
            for a in range(0, len(some), 8192):
                at = some[a : a + 8192]
                d = far(at, leaf)
                # A leaf with many rows in reach gives a better bound.
                many = np.flatnonzero((d <= w[at, None]).sum(1) > 2 * k)
                w[at[many]] = np.minimum(w[at[many]], kth(d[many], times[begin[leaf] : ends[leaf]], k))
                i, r = np.nonzero(d <= w[at, None])
                found.append((at[i] + start, order[begin[leaf] + r], d[i, r]))
    i, r, d = (np.concatenate(z) for z in zip(*found))
    near = np.flatnonzero(d <= bound[i])
    i, r, d = i[near], r[near], d[near]
    by = np.lexsort((ids[r], d, i))
    i, r, d = i[by], r[by], d[by]
    n = np.bincount(i, minlength=len(queries))
    keep = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) < k
    return i[keep], r[keep], d[keep]


def few(queries: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of at most QUERY_BLOCK queries; None if there are more."""
    got = queries.select("qid", "q").limit(QUERY_BLOCK + 1).collect()
    if len(got) > QUERY_BLOCK:
        return None
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)


def brute_force(refs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(qid, orig_id, label, d, rank): queries (qid, q) against all refs (orig_id, q, label).

    Up to QUERY_BLOCK queries are broadcast, and each task over refs keeps its k best of
    each query. More are dealt with the refs in blocks, two blocks to a task. Either way
    what is shuffled for the ranks is k rows a query and task, whatever refs has.
    """
    ship(refs.sparkSession)
    spark, asked = refs.sparkSession, few(queries)
    if asked is None:
        return ranked(scan(as_one(queries).withColumn("w0", F.lit(FAR)), as_one(refs), one_cluster(refs), k), k)
    if not len(asked[0]):
        return ranked(spark.createDataFrame([], "qid long, orig_id long, label int, d long"), k)
    held = spark.sparkContext.broadcast(asked)

    def run(batches):
        qids, q = held.value
        best_q = best_i = best_l = np.zeros(0, np.int64)
        best_d = np.zeros(0)
        for batch in batches:
            rows, refs_of = vectors_of(batch, "q"), batch.column(0).to_numpy(zero_copy_only=False)
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            step = max(1, 4_000_000 // max(1, len(rows)))
            for a in range(0, len(q), step):
                i, r, d = nearest(q[a : a + step], rows, refs_of, k)
                best_q, best_i, best_l, best_d = np.append(best_q, i + a), np.append(best_i, refs_of[r]), np.append(best_l, labels[r]), np.append(best_d, d)
            order = np.lexsort((best_i, best_d, best_q))
            n = np.bincount(best_q, minlength=len(q))
            order = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < k]
            best_q, best_i, best_l, best_d = best_q[order], best_i[order], best_l[order], best_d[order]
        yield pa.RecordBatch.from_arrays([pa.array(qids[best_q]), pa.array(best_i.astype(np.int64)), pa.array(best_l.astype(np.int32)), pa.array(best_d.astype(np.int64))], ["qid", "orig_id", "label", "d"])

    return ranked(refs.select("orig_id", "q", F.col("label").cast("int")).mapInArrow(run, "qid long, orig_id long, label int, d long"), k)


def distances(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, orig_id, d) of every query with every ref; up to QUERY_BLOCK queries are broadcast and nothing is shuffled, more are dealt with the refs in blocks."""
    ship(refs.sparkSession)
    spark, asked, schema = refs.sparkSession, few(queries), "qid long, orig_id long, d long"

    def pairs(qids, q, ids, rows):
        d = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", q, q)[None] - 2 * (rows @ q.T)
        return [pa.array(np.tile(qids, len(rows))), pa.array(np.repeat(ids, len(q)).astype(np.int64)), pa.array(d.ravel().astype(np.int64))]

    if asked is None:
        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            sides = [(t.column(n).to_numpy(), vectors_of(t.combine_chunks().to_batches()[0], "q")) if t.num_rows else (np.zeros(0, np.int64), np.zeros((0, 1))) for t, n in ((right, "qid"), (left, "orig_id"))]
            parts = pairs(*sides[0], *sides[1]) if left.num_rows and right.num_rows else [pa.array([], pa.int64())] * 3
            return pa.table(dict(zip(("qid", "orig_id", "d"), parts)))

        return cells(as_one(queries), as_one(refs), one_cluster(refs), PAIR_BLOCK, ["orig_id", "q"], ["qid", "q"]).applyInArrow(cell, schema)
    if not len(asked[0]):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(asked)

    def run(batches):
        qids, q = held.value
        for batch in batches:
            rows, refs_of = vectors_of(batch, "q"), batch.column(0).to_numpy(zero_copy_only=False)
            step = max(1, 500_000 // len(q))
            for a in range(0, len(rows), step):
                yield pa.RecordBatch.from_arrays(pairs(qids, q, refs_of[a : a + step], rows[a : a + step]), ["qid", "orig_id", "d"])

    return refs.select("orig_id", "q").mapInArrow(run, schema)


def vote(queries: DataFrame, neighbours: DataFrame, k: int = K) -> DataFrame:
    """(qid, frauds, fraud_score, approved): missing neighbours count as legitimate."""
    n = neighbours.groupBy("qid").agg(F.sum("label").cast("long").alias("_n"))
    found = queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("_n", F.lit(0)).cast("long").alias("frauds"))
    return decide(found, k)


def decide(votes: DataFrame, k: int = K) -> DataFrame:
    checked = F.when(F.col("frauds").between(0, k), F.col("frauds")).otherwise(F.raise_error(F.lit("votes out of range")).cast("long"))
    return votes.withColumn("fraud_score", checked * F.lit(1.0 / k)).withColumn("approved", 2 * F.col("frauds") <= k)


def body() -> Column:
    return F.format_string('{"approved":%s,"fraud_score":%.4f}', F.col("approved"), F.col("fraud_score"))


# -- the clustered index ----------------------------------------------------------------------------


def systematic_sample(n: int, size: int, k: int) -> list[tuple[int, int]]:
    """(place, id): evenly spaced ids; at most n of them, but k at least, which then repeats some."""
    size = max(min(size, n), k)
    return [(i, i * n // size) for i in range(size)]


def sample_rows(refs: DataFrame, size: int, k: int) -> DataFrame:
    """(place, orig_id, q) of the systematic sample; ids are 0 to n - 1."""
    spark, n = refs.sparkSession, refs.count()
    size = max(min(size, n), k)
    places = spark.range(size).select(F.col("id").alias("place"), F.expr(f"id * {n}L div {size}L").alias("orig_id"))
    return places.join(refs.select("orig_id", "q"), "orig_id").select("place", "orig_id", "q")


def initial_centroids(sample: DataFrame, k: int, width: int) -> list[list[float]]:
    size = sample.count()
    want = [c * size // k for c in range(k)]
    rows = {r[0]: r[1] for r in sample.where(F.col("place").isin(want)).select("place", "q").collect()}
    return [[float(x) for x in rows[p]] for p in want]


def assign(rows: DataFrame, centroids: list[list[float]], name: str = "cluster_id") -> DataFrame:
    """rows with the nearest centroid of q; the first of equals. Distances add up left to right in double precision."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.float64))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                q = vectors_of(part, "q")
                total = np.zeros((len(q), len(held.value)))
                for j in range(q.shape[1]):
                    gap = q[:, j, None] - held.value[None, :, j]
                    total = gap * gap if not j else total + gap * gap
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total.argmin(1).astype(np.int64))], [*part.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def update(assigned: DataFrame, centroids: list[list[float]], width: int) -> list[list[float]]:
    """Means of the clusters; an empty one keeps its centroid. Sums are whole numbers, so their order doesn't matter."""
    sums = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[j].cast("long")).alias(f"s{j}") for j in range(width)]).collect()
    out = [list(c) for c in centroids]
    for r in sums:
        out[r["cluster_id"]] = [r[f"s{j}"] / r["n"] for j in range(width)]
    return out


def train(refs: DataFrame, k: int, width: int, sample: int = 131_072, iterations: int = 10) -> list[list[float]]:
    rows = sample_rows(refs, sample, k)
    rows = rows.persist()
    try:
        centroids = initial_centroids(rows, k, width)
        for _ in range(iterations):
            centroids = update(assign(rows, centroids), centroids, width)
    finally:
        rows.unpersist()
    return centroids


def clusters_of(assigned: DataFrame, centroids: list[list[float]], width: int) -> DataFrame:
    """(cluster_id, n, start_off, end_off, lo, hi, centroid) of all k clusters; empty ones have zero boxes."""
    spark, k = assigned.sparkSession, len(centroids)
    boxes = assigned.groupBy("cluster_id").agg(F.count("*").alias("_n"), F.array(*[F.min(F.col("q")[j]) for j in range(width)]).alias("_lo"), F.array(*[F.max(F.col("q")[j]) for j in range(width)]).alias("_hi"))
    every = spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cluster_id long, centroid array<double>")
    zero = F.array(*[F.lit(0)] * width)
    out = every.join(boxes, "cluster_id", "left").select("cluster_id", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_lo", zero).alias("lo"), F.coalesce("_hi", zero).alias("hi"), "centroid")
    return offsets(out, k)


def offsets(clusters: DataFrame, k: int) -> DataFrame:
    """Exclusive sums of the sizes by cluster; there are k rows in all."""
    before = F.sum("n").over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1))
    return clusters.withColumn("start_off", F.coalesce(before, F.lit(0)).cast("long")).withColumn("end_off", F.col("start_off") + F.col("n"))


def positions(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(orig_id, cluster_id, pos): the place in the order of (cluster, id)."""
    within = F.row_number().over(Window.partitionBy("cluster_id").orderBy("orig_id")) - 1
    return assigned.select("orig_id", "cluster_id", within.alias("_p")).join(F.broadcast(clusters.select("cluster_id", "start_off")), "cluster_id").select("orig_id", "cluster_id", (F.col("start_off") + F.col("_p")).cast("long").alias("pos"))


def box_bound(q: Column, lo: Column, hi: Column, width: int) -> Column:
    """Least squared distance of any vector in the box."""
    total = None
    for j in range(width):
        gap = F.greatest(lo[j].cast("long") - q[j].cast("long"), q[j].cast("long") - hi[j].cast("long"), F.lit(0).cast("long"))
        total = gap * gap if total is None else total + gap * gap
    return total


def clamp_probes(nprobe: int, k: int) -> int:
    return max(1, min(k, nprobe))


def centroid_rows(queries: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """(qid, q, cluster_id, cd) for clusters with rows; clusters has k rows, so it is the small side at any size."""
    full = F.broadcast(clusters.where("n > 0").select("cluster_id", "centroid"))
    total = None
    for j in range(width):
        gap = F.col("q")[j].cast("double") - F.col("centroid")[j]
        total = gap * gap if total is None else total + gap * gap
    return queries.select("qid", "q").join(full).select("qid", "q", "cluster_id", total.alias("cd"))


def probes(queries: DataFrame, clusters: DataFrame, nprobe: int, k: int, width: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("cd", "cluster_id")
    return centroid_rows(queries, clusters, width).withColumn("probe", F.row_number().over(w)).where(F.col("probe") <= clamp_probes(nprobe, k)).select("qid", "q", "cluster_id", "cd", "probe")


def as_one(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cluster_id", F.lit(0).cast("long"))


def one_cluster(refs: DataFrame) -> DataFrame:
    """(cluster_id, n): all refs as a single cluster."""
    return refs.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("cluster_id"), "n")


def cells(pairs: DataFrame, vectors: DataFrame, clusters: DataFrame, size: int, of_vectors: list[str], of_pairs: list[str]):
    """Vectors and queries of each cluster, cut by hash of their ids into blocks of about ``size``: a group for each two blocks.

    A cluster of any size is spread over tasks that way. Clusters that no query asks for
    aren't read: vectors partitioned by cluster_id (an index on disk) are pruned to the
    others. Nothing is broadcast but a row a cluster.
    """
    spark = vectors.sparkSession
    asked = dict(pairs.groupBy(F.col("cluster_id").cast("long")).count().collect())
    cut = lambda n: max(1, -(-n // size))
    grid = [(c, cut(n), cut(asked[c])) for c, n in clusters.select("cluster_id", "n").collect() if c in asked]
    held = pa.schema([("cluster_id", pa.int64()), ("_nv", pa.int32()), ("_nq", pa.int32())])
    held = F.broadcast(spark.createDataFrame(pa.Table.from_pylist([dict(zip(held.names, row)) for row in grid], held)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = vectors.where(F.col("cluster_id").isin([c for c, _, _ in grid])).withColumn("cluster_id", F.col("cluster_id").cast("long")).select("cluster_id", *of_vectors)
    v = v.join(held, "cluster_id").withColumn("_v", block("orig_id", "_nv")).withColumn("_q", each("_nq")).select("cluster_id", "_v", "_q", *of_vectors)
    p = pairs.withColumn("cluster_id", F.col("cluster_id").cast("long")).join(held, "cluster_id").withColumn("_q", block("qid", "_nq")).withColumn("_v", each("_nv"))
    # Fresh names: pairs and vectors may come from the same table.
    p = p.select("cluster_id", "_v", "_q", *[F.col(n).alias(n) for n in of_pairs])
    key = ("cluster_id", "_v", "_q")
    return v.groupBy(*key).cogroup(p.groupBy(*key))


def scan(pairs: DataFrame, vectors: DataFrame, clusters: DataFrame, k: int = K, boxes: bool = False) -> DataFrame:
    """(qid, orig_id, label, d): for each (qid, q, cluster_id, w0), the k nearest vectors of each block of the cluster, none farther off than w0.

    A task compares two blocks, so what is shuffled afterwards is k rows a query and block.
    With boxes, leaves inside a block are passed over where their boxes are too far off, and
    label is the number of rows that a vector stands for.
    """
    ship(vectors.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            (rows,), (asks,) = (t.combine_chunks().to_batches() for t in (left, right))
            refs, q = vectors_of(rows, "q"), vectors_of(asks, "q")
            ids, labels, qids, w0 = (b.column(n).to_numpy(zero_copy_only=False) for b, n in ((rows, "orig_id"), (rows, "label"), (asks, "qid"), (asks, "w0")))
            step = max(1, 2_000_000 // len(refs))
            if boxes:
                i, r, d = pruned(q, refs, ids, k, np.where(w0 < FAR, w0, np.inf), labels)
                parts.append((qids[i], ids[r], labels[r], d))
            for known in () if boxes else (False, True):
                some = np.flatnonzero((w0 < FAR) == known)
                for a in range(0, len(some), step):
                    at = some[a : a + step]
                    i, r, d = nearest(q[at], refs, ids, k, w0[at] if known else None)
                    parts.append((qids[at[i]], ids[r], labels[r], d))
        none = np.zeros(0, np.int64)
        out = [np.concatenate([none, *x]) for x in zip(*parts)] or [none] * 4
        return pa.table({n: pa.array(x.astype(t)) for n, x, t in zip(("qid", "orig_id", "label", "d"), out, (np.int64, np.int64, np.int32, np.int64))})

    ready = vectors.withColumn("label", F.col("label").cast("int"))
    return cells(pairs, ready, clusters, BLOCK, ["orig_id", "q", "label"], ["qid", "q", "w0"]).applyInArrow(run, "qid long, orig_id long, label int, d long")


def seeds(probed: DataFrame, vectors: DataFrame, clusters: DataFrame, k: int = K) -> DataFrame:
    return ranked(scan(probed.withColumn("w0", F.lit(FAR)), vectors, clusters, k), k)


def repair(queries: DataFrame, clusters: DataFrame, seed: DataFrame, probed: DataFrame, k: int, width: int) -> DataFrame:
    """(qid, q, cluster_id, lb, w0): clusters not scanned yet whose boxes may hold a neighbour, and the k-th distance so far."""
    worst = seed.where(F.col("rank") == k).select("qid", F.col("d").alias("w0"))
    boxes = F.broadcast(clusters.where("n > 0").select("cluster_id", "lo", "hi"))
    near = queries.select("qid", "q").join(worst, "qid", "left").join(boxes).select("qid", "q", "cluster_id", F.coalesce("w0", F.lit(FAR)).alias("w0"), box_bound(F.col("q"), F.col("lo"), F.col("hi"), width).alias("lb"))
    near = near.where(F.col("lb") <= F.col("w0"))
    return near.join(probed.select("qid", "cluster_id"), ["qid", "cluster_id"], "left_anti").select("qid", "q", "cluster_id", "lb", "w0")


def search(queries: DataFrame, vectors: DataFrame, clusters: DataFrame, nprobe: int, k_clusters: int, width: int, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The exact neighbours, and (qid, cluster_id) of what was scanned.

    The nearest clusters give a threshold; any cluster whose box isn't farther off
    than it is scanned too, ties included, so the result is that of brute force.
    vectors and clusters are read several times: have them stored.
    """
    queries = stored(queries.select("qid", "q"), "queries")
    probed = stored(probes(queries, clusters, nprobe, k_clusters, width), "probed")
    seed = stored(seeds(probed, vectors, clusters, k), "seed")
    more = stored(repair(queries, clusters, seed, probed, k, width), "repair")
    found = ranked(seed.select("qid", "orig_id", "label", "d").unionByName(scan(more, vectors, clusters, k)), k)
    return found, probed.select("qid", "cluster_id").unionByName(more.select("qid", "cluster_id"))


# -- the search for very many queries ---------------------------------------------------------------


def cuts_of(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, value) of the cuts of a full binary tree with ``parts`` leaves, a power of two; rows above the value go right."""
    column, value = np.zeros(parts, np.int64), np.full(parts, np.inf)
    held = {1: sample}
    for node in range(1, parts):
        x = held.pop(node)
        right = np.zeros(len(x), bool)
        wide = np.ptp(x, 0) if len(x) else np.zeros(1)
        j = int(wide.argmax())
        if wide[j]:
            # Below the largest value, so that both sides have rows.
            middle = np.median(x[:, j])
            cut = middle if middle < x[:, j].max() else x[x[:, j] < middle, j].max()
            column[node], value[node] = j, cut
            right = x[:, j] > cut
        held[2 * node], held[2 * node + 1] = x[~right], x[right]
    return column, value


def dealt(rows: DataFrame, cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows with the part of q as cluster_id."""
    held = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        column, value = held.value
        for batch in batches:
            q, node = vectors_of(batch, "q"), np.ones(batch.num_rows, np.int64)
            for _ in range(len(value).bit_length() - 1):
                node = 2 * node + (q[np.arange(len(q)), column[node]] > value[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - len(value))], [*batch.schema.names, "cluster_id"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cluster_id", LongType())]))


def within_reach(bounded: DataFrame, clusters: DataFrame) -> DataFrame:
    """(qid, q, cluster_id, w0) for the parts, besides that of the query, whose boxes aren't farther off than w0."""
    got = clusters.select("cluster_id", "lo", "hi").collect()
    held = bounded.sparkSession.sparkContext.broadcast(tuple(np.array([r[c] for r in got]) for c in range(3)))

    def run(batches):
        parts, lo, hi = held.value
        step = max(1, 2_000_000 // len(parts))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                home, w0 = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cluster_id", "w0"))
                i, j = np.nonzero((gaps(vectors_of(part, "q"), lo, hi) <= w0[:, None]) & (home[:, None] != parts[None]))
                near = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([near.column(near.schema.get_field_index("qid")), near.column(near.schema.get_field_index("q")), pa.array(parts[j]), pa.array(w0[i])], ["qid", "q", "cluster_id", "w0"])

    ask = bounded.select("qid", "q", "cluster_id", "w0")
    return ask.mapInArrow(run, ask.schema)


def exact(refs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """What ``brute_force`` gives. Beyond MOST_PAIRS distances the search is pruned.

    Equal vectors are searched as one, with the id of the first and the k of least id as
    members (no others can be neighbours), and equal queries are asked once: the k nearest
    of such vectors, by distance and first id, have the k nearest rows among their members.
    The vectors are dealt to parts by cuts at medians; each part has the box
    of all its vectors. The part of a query gives the k-th distance so far, and every
    other part whose box isn't farther off is searched too, ties included, so the result
    doesn't depend on the cuts, which come from a sample of about CUT_SAMPLE distinct vectors.
    """
    queries = stored(queries.select("qid", "q"), "queries")
    asked, n = queries.count(), refs.count()
    if asked * n <= MOST_PAIRS:
        return brute_force(refs, queries, k)
    ship(refs.sparkSession)
    # The hash before q: most comparisons of the sort are then of one number.
    copies = Window.partitionBy("_h", "q").orderBy("orig_id")
    every = refs.select("orig_id", "q", F.col("label").cast("int").alias("label")).withColumn("_h", F.xxhash64("q"))
    least = every.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k)
    row = F.struct("orig_id", "label")
    members = F.array_compact(F.array(row, *[F.lead(row, j).over(copies) for j in range(1, k)]))
    merged = stored(least.withColumn("members", members).where("_n = 1").select("orig_id", "q", "members"), "merged")
    m = merged.count()
    some = merged.where(F.pmod(F.xxhash64("orig_id"), F.lit(max(1, m // CUT_SAMPLE))) == 0).select("q").limit(2 * CUT_SAMPLE).toArrow().combine_chunks()
    sample = vectors_of(some.to_batches()[0], "q")
    parts = 1 << max(0, min(-(-m // PART), max(1, len(sample) // 16)) - 1).bit_length()
    cuts = cuts_of(sample, parts)
    vectors = stored(dealt(merged.select("orig_id", "q", F.size("members").alias("label")), cuts), "parts")
    width = range(sample.shape[1])
    clusters = stored(vectors.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array(*[F.min(F.col("q")[j]) for j in width]).alias("lo"), F.array(*[F.max(F.col("q")[j]) for j in width]).alias("hi")), "boxes")
    each = stored(dealt(queries.select("q").distinct().select(F.monotonically_increasing_id().alias("qid"), "q"), cuts), "asked")
    seed = stored(ranked(scan(each.withColumn("w0", F.lit(FAR)), vectors, clusters, k, True), k), "seed")
    rows = F.sum("label").over(Window.partitionBy("qid").orderBy("rank"))
    worst = seed.withColumn("_rows", rows).where(F.col("_rows") >= k).groupBy(F.col("qid").alias("s")).agg(F.min("d").alias("w0"))
    bounded = each.join(worst, F.col("qid") == F.col("s"), "left").select("qid", "q", "cluster_id", F.coalesce("w0", F.lit(FAR)).alias("w0"))
    more = stored(within_reach(bounded, clusters), "repair")
    near = ranked(seed.select("qid", "orig_id", "label", "d").unionByName(scan(more, vectors, clusters, k, True)), k)
    near = near.select("qid", "d", F.col("orig_id").alias("of")).join(merged.select(F.col("orig_id").alias("first"), "members"), F.col("of") == F.col("first"))
    found = stored(ranked(near.select("qid", "d", F.inline("members")), k).drop("rank"), "found")
    asks = queries.join(each.select(F.col("qid").alias("of"), F.col("q").alias("_q")), F.col("q") == F.col("_q")).select("qid", "of")
    return ranked(asks.join(found.withColumnRenamed("qid", "f"), F.col("of") == F.col("f")).select("qid", "orig_id", "label", "d"), k)


def scan_statistics(scanned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(qid, scanned_clusters, scanned_vectors)."""
    return scanned.join(F.broadcast(clusters.select("cluster_id", "n")), "cluster_id").groupBy("qid").agg(F.count("*").alias("scanned_clusters"), F.sum("n").alias("scanned_vectors"))
