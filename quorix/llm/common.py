"""What the text operators share: shared-folder tables, Arrow chunks, word hashing and components.

Conventions, for every operator of this package: a null text is an empty one; a
null id is carried as any other value; extra columns of an input are ignored, so
they may clash with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix import ship
from quorix.sources.shared import scratch

#: Space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)
#: Text bytes that a Python step takes at once.
CHUNK = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most some MB, where the session has not set a size of its own: rows here are whole texts."""
    ship(spark)
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(4 * CHUNK))):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: the lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    df.write.parquet(path := scratch(spark, tag))
    out = spark.read.schema(df.schema).parquet(path)
    out._quorix_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quorix_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(column: str, n: int):
    """crc32 of an id as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def texts_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, without gaps, and n + 1 offsets; null is empty."""
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + array.offset)[array.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most that many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts_of(batch, column)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOL = np.random.default_rng(20250101).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int, name: str, base: np.uint64) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        x = np.full(max(n, CHUNK // 2), base, np.uint64)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """64-bit hashes of any spans of some bytes, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * _power(n, "up", _BASE), out=self.sums[1:])
        self.down = _power(n + 1, "down", _INVERSE)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(x + (ends - starts).astype(np.uint64))


#: Longer words are hashed one by one: sums of powers modulo 2**64 have known collisions from some hundred bytes on.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of some bytes."""
    out = Spans(data).hash(starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 11)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word crosses rows."""
    n = len(data)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) reaches.

    Large-star and small-star rounds in turn; each round is a table in the shared
    folder, and only one row of counts comes to the driver.
    """
    def total(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        return r["n"], r["h"]

    def star(e: DataFrame, small: bool) -> DataFrame:
        # e has u > v. Small star looks at smaller neighbours only.
        near = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = stored(least, tag)
        if small:
            out = near.join(least, near.u == least.w).select(F.col("v").alias("a"), "m")
            out = out.unionByName(least.select(F.col("w").alias("a"), "m"))
        else:
            out = near.join(least, near.u == least.w).where("v > u").select(F.col("v").alias("a"), "m")
        out = out.where("a > m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()
        out = stored(out, tag)
        drop(least)
        return out

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), tag)
    was = total(now)
    while was[0]:
        big = star(now, False)
        new = star(big, True)
        drop(now, big)
        now, then, was = new, was, total(new)
        if then == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
