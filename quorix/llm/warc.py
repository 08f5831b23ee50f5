"""Deterministic sharded WARC archives: written by range of record id, read back by manifest.

Records are dealt to shards that are ranges of the id of about equal size; the
ranges follow from the data alone (histograms of bytes over the ids, refined where
a bin is too heavy), so the same table gives the same files whatever its layout.
Each shard is sorted and rolled to the next file once the compressed size is
reached; each record is a gzip member whose headers and digests are made anew.
Files are written under temporary names and renamed when whole; a task that runs
again writes the same bytes to the same names. The manifest lists the files and is
committed by a rename after all of them, so a reader sees all of an archive or none.

Of records with equal payloads the one with the largest id is the response and the
others are revisits of it.

Defined results: null html is an empty payload; a record without an id is a
response and sorts first; of records equal in id and payload the first is the
response; a null url has no target header; an empty table gives an archive without
files. Extra columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import chunks, scratch, stored, table

FILE_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
SHARDS = 4096
BINS = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")
_NAMESPACE = uuid.UUID("5a1d6d1c-4f0e-5d57-9d59-3c1d4d6a7e10")

MANIFEST = "shard int, part int, file string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, own)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, own)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, size: int = 1 << 20):
    """Each gzip member of a stream, one in memory at a time."""
    left = b""
    while True:
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            if not left:
                left = stream.read(size)
                if not left:
                    if out:
                        raise ValueError("an archive ends within a record")
                    return
            out.append(unzip.decompress(left))
            left = unzip.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple:
    """(page_id, url, type, payload bytes, digest, refers_to, payload); raises on a wrong digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError(f"{fields['WARC-Record-ID']}: the block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != own):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    url = unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    return number("X-Page-ID"), url, kind, size, own, number("X-Refers-To-Page-ID"), payload if kind == "response" else None


def shard_bounds(rows: DataFrame) -> list[int]:
    """Least ids of the second shard and those after it, from (id, bytes) of all rows."""
    first = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("bytes").alias("b")).first()
    if first["lo"] is None:
        return []
    most = max(SHARD_BYTES, first["b"] // SHARDS)
    bins: list[tuple[int, int, int]] = []
    heavy = [(first["lo"], first["hi"])]
    while heavy:
        # Each heavy range is cut into equal bins; bins that are still too heavy are cut again.
        now, later = heavy[:32], heavy[32:]
        which = None
        for k, (lo, hi) in enumerate(now):
            width = (hi - lo) // BINS + 1
            place = F.struct(F.lit(k).alias("k"), F.expr(f"(id - cast({lo} as decimal(38,0))) div {width}").cast("long").alias("bin"))
            inside = F.col("id").between(lo, hi)
            which = F.when(inside, place) if which is None else which.when(inside, place)
        heavy = later
        for r in rows.where("id is not null").select(which.alias("w"), "bytes").where("w is not null").groupBy("w.k", "w.bin").agg(F.sum("bytes").alias("b")).collect():
            lo, hi = now[r["k"]]
            width = (hi - lo) // BINS + 1
            a = lo + r["bin"] * width
            b = min(hi, a + width - 1)
            if r["b"] > most and b > a:
                heavy.append((a, b))
            else:
                bins.append((a, b, r["b"]))
    cuts, size = [], 0
    for a, _, b in sorted(bins):
        if size and size + b > most:
            cuts.append(a)
            size = 0
        size += b
    return cuts


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> str:
    """Archive all rows of pages under a folder that driver and executors share; gives the folder."""
    ship(pages.sparkSession)
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    prints = stored(rows.select("id", F.sha1("html").alias("d"), (F.octet_length("html") + 500).cast("long").alias("bytes")), "warcprints")
    most = stored(prints.groupBy("d").agg(F.max("id").alias("m"), F.count("*").alias("c")).where("c > 1").select(F.col("d").alias("md"), "m"), "warcmost")
    revisits = prints.join(most, F.col("d") == F.col("md")).where("id <= m").select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "d", F.col("m").alias("refers"))
    bounds = shard_bounds(prints)
    every = rows.select("id", "url", "html", F.sha1("html").alias("d"), F.lit(None).cast("long").alias("refers")).unionByName(revisits.distinct())
    # The shard of an id: how many bounds are not above it.
    bound = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    shard = F.when(F.col("id").isNull() | F.lit(not bounds), F.lit(0)).otherwise(F.size(F.filter(bound, lambda b: b <= F.col("id")))).alias("shard")
    ready = every.select(shard, "*").repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("id"), "d", F.isnotnull("html"), "url")

    def run(batches):
        where, base = files.FileSystem.from_uri(path)
        where.create_dir(f"{base}/_temporary")
        made: list[tuple] = []
        out = None

        def close():
            nonlocal out
            if out:
                out["stream"].close()
                name = f"{out['shard']:06d}-{out['part']:05d}.warc.gz"
                if where.get_file_info(f"{base}/{name}").type != files.FileType.NotFound:
                    where.delete_file(f"{base}/{name}")
                where.move(out["temp"], f"{base}/{name}")
                made.append((out["shard"], out["part"], name, out["records"], out["bytes"], out["sha1"].hexdigest()))
            out = None

        def begin(shard, part):
            temp = f"{base}/_temporary/{uuid.uuid4().hex}"
            return {"shard": shard, "part": part, "temp": temp, "stream": where.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "sha1": hashlib.sha1()}

        refers = seen = None
        for batch in chunks(batches, "html"):
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for shard, page_id, url, page, own, target in zip(*columns):
                if page is None:
                    refers, seen = (page_id, own, target), False
                    continue
                to = None
                if refers and refers[:2] == (page_id, own) and page_id is not None:
                    # The largest id is the response once; equal rows after it revisit it.
                    to = refers[2] if page_id < refers[2] or seen else None
                    seen = True
                if out is None or out["shard"] != shard:
                    close()
                    out = begin(shard, 0)
                elif out["bytes"] >= file_bytes:
                    part = out["part"] + 1
                    close()
                    out = begin(shard, part)
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = zipper.compress(record(page_id, url, page.encode(), to)) + zipper.flush()
                out["stream"].write(data)
                out["sha1"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "part", "file", "records", "bytes", "sha1"])

    ready.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest.tmp")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    at = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at.delete(jvm(f"{path}/_manifest"), True)
    if not at.rename(jvm(f"{path}/_manifest.tmp"), jvm(f"{path}/_manifest")):
        raise OSError(f"the manifest of {path} can't be committed")
    at.delete(jvm(f"{path}/_temporary"), True)
    return path


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of an archive, of the files in its manifest; payload: also html, null for revisits."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    n = max(1, manifest.count())
    names = manifest.repartition(n, "file").select("file", "records", "bytes")

    def run(batches):
        where, base = files.FileSystem.from_uri(path)
        for batch in batches:
            for name, records, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if where.get_file_info(f"{base}/{name}").size != size:
                    raise ValueError(f"{name} is not as long as the manifest says")
                rows, held, count = [], 0, 0
                with where.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        row = parse(raw)
                        count += 1
                        rows.append(row if payload else row[:6])
                        held += len(raw) if payload else 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if count != records:
                    raise ValueError(f"{name} has {count} records; the manifest says {records}")
                if rows:
                    yield batch_of(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    titles = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]

    def batch_of(rows):
        n = 7 if payload else 6
        columns = [[r[i] for r in rows] for i in range(n)]
        if payload:
            columns[6] = [None if x is None else x.decode() for x in columns[6]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], titles[:n])

    return names.mapInArrow(run, RECORD + (", html string" if payload else ""))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "pages"))
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
