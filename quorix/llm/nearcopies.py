"""Near copies: pairs of texts whose sets of word shingles have a Jaccard similarity of a limit or more.

Texts of equal shingle sets are one class. Candidates are classes whose SimHash
fingerprints over these shingles are linked by ``simhash`` (generalised pigeonhole, BITS
bits), and, as texts at 0.8 mostly differ in more bits, classes that agree in a
band of MinHash values: 40 bands of 5, so a pair at 0.8 is missed once in eight
million and one above it less often. Each candidate is verified on the full sets of
64-bit shingle hashes before it counts as a link; groups are the components of the
links. Buckets up to SMALL are verified pair by pair. Of larger ones some leaders are
verified against all members first, so a group of k copies is mostly one component at
the cost of k verifications for each leader. Buckets that still hold several
components are settled in blocks of a bounded number of shingles: each two blocks of a
bucket meet in one task, which counts common shingles as products of 0/1 matrices and
puts out no pairs but stars of what is linked. So each two members of a bucket end in
one group or were verified not to be linked, and no task holds more than two blocks.

Defined results: words are lower-cased (A-Z) runs of what isn't white space; null,
empty and blank texts have no shingle and are one group; fewer words than a shingle
make one shingle; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm import simhash
from quorix.llm.common import LOWER, chunks, components, mix, stored, texts_of

#: Fingerprints that differ in so many bits at most are candidates.
BITS = 4
BANDS, ROWS = 40, 5
_random = np.random.default_rng(20250607)
_FACTOR = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_ADDEND = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
#: Buckets up to this size are verified pair by pair.
SMALL = 12
#: Leaders of a larger bucket.
LEADERS = 2
#: Shingles of a block of a bucket, or one member; 2 MB.
BLOCK = 250_000


def shingles_of(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])], np.uint64))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each set, none of them empty, and each band."""
    if not sets:
        return np.zeros((0, BANDS), np.uint64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    out, y = np.empty((BANDS, len(sets)), np.uint64), np.empty_like(x)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.multiply(x, _FACTOR[k], out=y)
            np.add(y, _ADDEND[k], out=y)
            key = mix((key << np.uint64(1)) + np.minimum.reduceat(y, begin))
        out[band] = key
    return out.T


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, at = texts_of(batch)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, th, rh, cls, n, fp, bands) of rows (id, th, rh, text)."""
    def run(batches):
        for batch in chunks(batches):
            texts = _texts(batch)
            sets = [shingles_of(t, shingle) for t in texts]
            fp = simhash.fingerprints_of(texts, shingle).view(np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            keys = bands_of([s for s in sets if len(s)]).view(np.int64)
            at = np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))).astype(np.int32)
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cls), pa.array(n), pa.array(fp), pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(keys).ravel()))], ["id", "th", "rh", "cls", "n", "fp", "bands"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, rh long, cls long, n long, fp long, bands array<long>")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(u, v) of classes (cls, n, fp) that SimHash takes for near copies: a star for each fingerprint, and the edges between fingerprints."""
    some = classes.where("n > 0").select("cls", "fp")
    named = stored(some.groupBy("fp").agg(F.min("cls").alias("rep")), "nearfp")
    same = some.join(named.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("cls <> rep").select(F.col("rep").alias("u"), F.col("cls").alias("v"))
    near = simhash.near_pairs(named, BITS)
    return same if near is None else same.unionByName(near)


def buckets(classes: DataFrame, share: float) -> DataFrame:
    """(key, u, v, n): pairs u, v of small buckets, without a key; members u of larger ones, without v."""
    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows, hot = 0, None

        def out(last):
            nonlocal held, rows, hot
            key, cls, n = (np.concatenate(c) for c in zip(*held))
            bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(bounds, len(key)))
            large = size > SMALL
            if hot is not None and key[0] == hot:
                large[0] = True
            # The last bucket waits for its other rows, unless it is known to be large.
            stop = len(key) if last or large[-1] else int(bounds[-1])
            hot = key[-1] if large[-1] else None
            member = np.flatnonzero(np.repeat(large, size)[:stop])
            few = np.flatnonzero(np.repeat(~large & (size > 1), size)[:stop])
            ends = np.repeat(bounds + size, size)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, SMALL):
                few = few[few + lag < ends[few]]
                a, b = n[few], n[few + lag]
                hit = few[np.minimum(a, b) >= share * np.maximum(a, b) - 1e-6]
                us.append(cls[hit])
                vs.append(cls[hit + lag])
            u, v = np.concatenate(us), np.concatenate(vs)
            none = pa.nulls(len(u), pa.int64())
            held = [(key[stop:], cls[stop:], n[stop:])] if stop < len(key) else []
            rows = len(key) - stop
            absent = pa.nulls(len(member), pa.int64())
            return [pa.RecordBatch.from_arrays(c, ["key", "u", "v", "n"]) for c in ([none, pa.array(u), pa.array(v), none], [pa.array(key[member]), pa.array(cls[member]), absent, pa.array(n[member])])]

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
                rows += batch.num_rows
                if rows >= 200_000:
                    yield from out(False)
        if rows:
            yield from out(True)

    spread = classes.select(F.explode("bands").alias("key"), "cls", "n").repartition("key").sortWithinPartitions("key", "cls")
    return spread.mapInArrow(run, "key long, u long, v long, n long")


def linked(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity."""
    one, other = sets.select(F.col("cls").alias("u_"), F.col("set").alias("su")), sets.select(F.col("cls").alias("v_"), F.col("set").alias("sv"))
    both = pairs.distinct().join(other, F.col("v") == F.col("v_")).join(one, F.col("u") == F.col("u_"))
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(common >= share * (F.size("su") + F.size("sv") - common) - 1e-6).select("u", "v")


def stars(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, row or column) of a boolean matrix, columns after rows: the first row of each component with all else of it."""
    n, m = hit.shape
    free, open_ = hit.any(1), np.ones(m, bool)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while free.any():
        seed = int(free.argmax())
        free[seed] = False
        rows = np.array([seed])
        while len(rows):
            columns = np.flatnonzero(hit[rows].any(0) & open_)
            open_[columns] = False
            rows = np.flatnonzero(hit[:, columns].any(1) & free)
            free[rows] = False
            found = np.concatenate([columns + n, rows])
            us.append(np.full(len(found), seed))
            vs.append(found)
    return np.concatenate(us), np.concatenate(vs)


def block_links(share: float):
    """For the members (cls, comp, n, block, set) of two blocks, or of one: (u, v) that connect what is linked across components."""
    def run(table: pa.Table) -> pa.Table:
        cls, comp, n, block, lo, hi = (table.column(c).to_numpy() for c in ("cls", "comp", "n", "block", "lo", "hi"))
        sets = table.column("set").combine_chunks()
        value, ends = sets.flatten().to_numpy(), np.append(0, np.cumsum(n))
        a = np.flatnonzero(block == lo[0])
        b = a if lo[0] == hi[0] else np.flatnonzero(block == hi[0])
        owner = np.repeat(np.arange(len(n)), n)
        common = np.zeros((len(a), len(b)), np.float32)
        if len(a) and len(b):
            _, shingle = np.unique(value, return_inverse=True)
            side = np.zeros(len(n), np.int64)
            side[a] = 1
            in_a = np.bincount(shingle, side[owner])
            in_all = np.bincount(shingle)
            both = in_all > 1 if lo[0] == hi[0] else (in_a > 0) & (in_all > in_a)
            name = np.cumsum(both) - 1
            kept = np.flatnonzero(both[shingle])
            kept = kept[np.argsort(name[shingle[kept]], kind="stable")]
            key, who = name[shingle[kept]], owner[kept]
            width = 4096
            for start in range(0, int(both.sum()), width):
                i, j = np.searchsorted(key, [start, start + width])
                held = np.zeros((len(n), width), np.float32)
                held[who[i:j], key[i:j] - start] = 1
                common += held[a] @ held[b].T
        hit = (common >= share * (n[a][:, None] + n[b][None] - common) - 1e-6) & (comp[a][:, None] != comp[b][None])
        u, v = stars(hit)
        name = np.concatenate([a, b])
        return pa.table({"u": cls[name[u]], "v": cls[name[v]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def unsettled(big: DataFrame, groups: DataFrame) -> DataFrame:
    """The members (key, cls, n, comp, place, before) of buckets with several components; before: shingles of the members before."""
    named = big.join(groups, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("total")).where("lo <> hi").select(F.col("key").alias("k"), "total")
    order = Window.partitionBy("key").orderBy("n", "cls")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return stored(named.join(several, F.col("key") == F.col("k")).select("key", "cls", "n", "comp", "total", F.row_number().over(order).alias("place"), F.coalesce(before, F.lit(0)).alias("before")), "nearlive")


def groups_of(big: DataFrame, edges: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(node, component) once all members of large buckets are settled."""
    groups = stored(components(edges), "neargroups")

    def joined(new: DataFrame) -> DataFrame:
        # The stars so far stand for all edges before.
        return groups if new.isEmpty() else stored(components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new)), "neargroups")

    live = unsettled(big, groups)
    if live.isEmpty():
        return groups
    lead = live.where(F.col("place") <= LEADERS).select(*[F.col(c).alias(f"l_{c}") for c in live.columns])
    near = F.least("n", "l_n") >= share * F.greatest("n", "l_n") - 1e-6
    pairs = lead.join(live, F.col("key") == F.col("l_key")).where((F.col("place") > F.col("l_place")) & (F.col("comp") != F.col("l_comp")) & near).select(F.col("l_cls").alias("u"), F.col("cls").alias("v"))
    groups = joined(stored(linked(pairs, sets, share), "nearedges"))
    live = unsettled(live.select("key", "cls", "n"), groups)
    if live.isEmpty():
        return groups
    block = F.floor(F.col("before") / BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / BLOCK)))
    rows = live.select("key", "cls", "n", "comp", block.alias("block")).join(sets.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c")).drop("c")
    rows = rows.join(live.groupBy(F.col("key").alias("k")).agg(F.max("total").alias("total")), F.col("key") == F.col("k")).select("key", "cls", "n", "comp", "block", "set", other.alias("other"))
    rows = rows.select("key", "cls", "n", "comp", "block", "set", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return joined(stored(rows.groupBy("key", "lo", "hi").applyInArrow(block_links(share), "u long, v long").distinct(), "nearedges"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    rest = [F.col(f.name) for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    return [F.col(id_col).alias("_quorix_id"), F.xxhash64(text_col).alias("_quorix_th"), (F.xxhash64(*rest) if rest else F.lit(0).cast("long")).alias("_quorix_rh")]


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """docs with the row of least (id, hash of text) of each group of near copies; rows without an id all stay."""
    ship(docs.sparkSession)
    keyed = docs.where(F.col(id_col).isNotNull()).select("*", *_keys(docs, id_col, text_col))
    rows = keyed.select(F.col("_quorix_id").alias("id"), F.col("_quorix_th").alias("th"), F.col("_quorix_rh").alias("rh"), F.col(text_col).alias("text"))
    prints = stored(signatures(rows, shingle), "nearprints")
    classes = stored(prints.groupBy("cls").agg(F.min(F.struct("id", "th", "rh")).alias("rep"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nearclasses")
    found = stored(buckets(classes, share), "nearbuckets")
    either = found.where("v is not null").select("u", "v").unionByName(fingerprint_pairs(classes))
    pairs = stored(either.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "nearpairs")
    big = found.where("v is null").select("key", F.col("u").alias("cls"), "n")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("c")).unionByName(big.select(F.col("cls").alias("c")))
    wanted = classes.join(nodes.distinct(), F.col("cls") == F.col("c"), "left_semi").select("cls", F.col("rep.id").alias("i_"), F.col("rep.th").alias("t_"), F.col("rep.rh").alias("r_"))

    def run(batches):
        for batch in chunks(batches):
            sets = [shingles_of(t, shingle) for t in _texts(batch)]
            at = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], ["cls", "set"])

    texts = rows.join(wanted, (F.col("id") == F.col("i_")) & (F.col("th") == F.col("t_")) & (F.col("rh") == F.col("r_"))).select("cls", "text").dropDuplicates(["cls"])
    sets = stored(texts.mapInArrow(run, "cls long, set array<long>"), "nearsets")
    edges = stored(linked(pairs, sets, share), "nearedges")
    groups = groups_of(big, edges, sets, share)
    named = classes.join(groups, F.col("cls") == F.col("node"), "left").groupBy(F.coalesce("component", "cls").alias("group")).agg(F.min("rep").alias("rep"))
    kept = stored(named.select(F.col("rep.id").alias("i_"), F.col("rep.th").alias("t_"), F.col("rep.rh").alias("r_")), "nearkept")
    match = (F.col("_quorix_id") == F.col("i_")) & (F.col("_quorix_th") == F.col("t_")) & (F.col("_quorix_rh") == F.col("r_"))
    keys = ["_quorix_id", "_quorix_th", "_quorix_rh"]
    out = keyed.join(kept.hint("merge"), match, "left_semi").dropDuplicates(keys).drop(*keys)
    return out.unionByName(docs.where(F.col(id_col).isNull()))
