"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: majority bits of the XXH64 (seed 42) of word shingles, repeats
included. Links: fingerprints that differ in at most ``most`` bits. Correlated
bits are grouped into partitions; a dynamic program gives each partition its own
threshold T_i with sum(T_i) = most - m + 1, from candidate counts estimated on a
bounded sample; any linked pair then lies within T_i in some partition i. A row is
put out for each way to blank T_i bits of partition i, so both ends of such a
pair share a row key. Buckets are verified on all 64 bits and leave stars, never
all pairs, so a group of k copies costs k rows for each key. The sample decides
costs only; the links found are the same for any plan.

Defined results: null or empty text, and text of white space, has fingerprint
zero and is linked like any other; fewer words than a shingle make one shingle;
repeated rows share a fingerprint; rows that share an id are one document, linked
through the fingerprint of any of them; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import LOWER, chunks, components, stored, table, texts_of

_ONES = np.uint64(0x0101010101010101)
#: Fingerprints looked at to plan the partitions.
SAMPLE = 2000
#: The plan is made for so many fingerprints at least: the same for all smaller inputs.
PLAN_FOR = 2_000_000
#: Buckets up to this size are compared pair by pair in bulk; larger ones grow their components.
SMALL = 12


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.translate(LOWER).split()
        n = len(words)
        joined = b" ".join(words)
        if n <= shingle:
            found = [digest(joined, 42)] if n else []
        else:
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            found = [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])]
        hashes += found
        counts.append(len(found))
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    has = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[has]
    # Eight bits at a time are summed in the eight bytes of a word, at most 255 shingles together.
    pieces = -(-n[has] // 255)
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first = np.cumsum(pieces) - pieces
    for k in range(8):
        part = np.add.reduceat((h >> np.uint64(k)) & _ONES, at)
        per = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        for j in range(8):
            out[has] |= (2 * per[:, j] > n[has]).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches):
            data, at = texts_of(batch)
            raw = data.tobytes()
            fp = fingerprints_of([raw[a:b] for a, b in zip(at, at[1:])], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each two bits are both set, over all of them."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(x), 1 << 16):
                bits = ((x[a : a + (1 << 16), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["i", "j", "c"])

    got = fps.select("fp").mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((64, 64)), 0
    for i, j, c in got:
        if i < 0:
            n = int(c)
        else:
            both[i, j] = c
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near equal width; each takes the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for width in np.diff(np.linspace(0, 64, m + 1).round().astype(int)):
        part = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(1))))]
        while len(part) < width:
            part.append(left.pop(int(np.argmax(corr[np.ix_(left, part)].sum(1)))))
        out.append(sorted(part))
    return out


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on that sum to total at least cost; cost[i][t + 1] is that of partition i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, x in enumerate(row):
                if (z := s + k - 1) not in new or c + x < new[z][0]:
                    new[z] = (c + x, [*ts, k - 1])
        best = new
    return best[total]


def plan(n: int, both: np.ndarray, sample: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, of the number of partitions that costs least."""
    options = []
    x = sample[:SAMPLE]
    size = max(n, PLAN_FOR)
    for m in range(2, most + 2):
        parts, cost = group_bits(n, both, m), []
        for bits in parts:
            mask = np.uint64(sum(1 << b for b in bits))
            count = np.zeros(65)
            for a in range(0, len(x), 256):
                count += np.bincount(np.bitwise_count((x[a : a + 256, None] ^ x[None]) & mask).ravel().astype(np.int64), minlength=65)
            count[0] -= len(x)
            share = np.cumsum(count) / max(1, len(x) * (len(x) - 1))
            cost.append([0.0] + [size * comb(len(bits), t) + 0.05 * share[t] * size * size / 2 for t in range(min(most, 3) + 1)])
        need = most - m + 1
        if need <= sum(len(c) - 2 for c in cost):
            options.append((*allocate(cost, need), parts))
    _, ts, parts = min(options, key=lambda o: o[0])
    return [(bits, t) for bits, t in zip(parts, ts) if t >= 0]


def grow(x: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint of a bucket the place of the first of its component."""
    root, left, place = np.arange(len(x)), x.copy(), np.arange(len(x))
    while len(left):
        seed, ahead = place[0], left[:1]
        left, place = left[1:], place[1:]
        while len(ahead) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, 4_000_000 // len(left))
            for a in range(0, len(ahead), step):
                rest = np.flatnonzero(~near)
                near[rest] |= (np.bitwise_count(ahead[a : a + step, None] ^ left[None, rest]) <= most).any(0)
                if near.all():
                    break
            root[place[near]] = seed
            ahead, left, place = left[near], left[~near], place[~near]
    return root


def linked(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each run of equal keys."""
    bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(bounds, len(keys)))
    ends = np.repeat(bounds + size, size)
    us, vs = [], []
    few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for lag in range(1, SMALL):
        few = few[few + lag < ends[few]]
        if not len(few):
            break
        hit = few[np.bitwise_count(fp[few] ^ fp[few + lag]) <= most]
        us.append(rep[hit])
        vs.append(rep[hit + lag])
    for k in np.flatnonzero(size > SMALL):
        a, b = bounds[k], bounds[k] + size[k]
        root = grow(fp[a:b], most) + a
        hit = np.flatnonzero(root != np.arange(a, b)) + a
        us.append(rep[hit])
        vs.append(rep[root[hit - a]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def near_edges(classes: DataFrame, partitions: list[tuple[list[int], int]], most: int) -> DataFrame:
    """(u, v) between the representatives of classes (fp, rep), enough of them to connect all that is linked."""
    masks = []
    for i, (bits, t) in enumerate(partitions):
        for blank in combinations(bits, t):
            masks.append((i, sum(1 << b for b in bits if b not in blank), sum(1 << b for b in blank)))
    keep = np.array([m[1] for m in masks], np.uint64)
    salt = np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keyed(batches):
        from quorix.llm.common import mix

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 20_000):
                x = fp[a : a + 20_000]
                key = mix((x[:, None] & keep) + salt).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(x, len(keep)).view(np.int64)), pa.array(np.repeat(rep[a : a + 20_000], len(keep)))], ["key", "fp", "rep"])

    def verify(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(parts, last):
            keys, fp, rep = (np.concatenate(c) for c in zip(*parts))
            stop = len(keys) if last else int(np.searchsorted(keys, keys[-1], "left"))
            u, v = linked(keys[:stop], fp[:stop], rep[:stop], most) if stop else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]), [(keys[stop:], fp[stop:], rep[stop:])]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= 200_000:
                edges, held = out(held, False)
                rows = len(held[0][0])
                yield edges
        if rows:
            yield out(held, True)[0]

    spread = classes.mapInArrow(keyed, "key long, fp long, rep long").repartition("key").sortWithinPartitions("key", "rep")
    return spread.mapInArrow(verify, "u long, v long").distinct()


def near_pairs(classes: DataFrame, most: int) -> DataFrame | None:
    """The edges of ``near_edges`` by the plan for these classes (fp, rep), which are stored; None for fewer than two."""
    n, both = bit_statistics(classes)
    if n < 2:
        return None
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    return near_edges(classes, plan(n, both, sample, most), most)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(id_col, fp, component_id) for each row of docs; ids are integers."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fp")
    classes = stored(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")).where("rep is not null"), "fpclass")
    named = classes.select(F.col("fp").alias("fp_"), F.col("rep").alias("component_id"))
    if (edges := near_pairs(classes, most)) is not None:
        groups = components(edges)
        named = stored(classes.join(groups, classes.rep == groups.node, "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id")), "fpcomp")
    return prints.join(named, prints.fp == named.fp_, "left").select(F.col(id_col), "fp", F.coalesce("component_id", F.col(id_col).cast("long")).alias("component_id"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
