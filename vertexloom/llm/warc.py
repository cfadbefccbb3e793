"""A deterministic sharded WARC writer, and the reader that gets the records back.

Records are put into ranges of their id by an exact histogram, shuffled once, sorted in each, and written as members of gzip files that
roll when their compressed size is reached. Headers and digests are made anew from the payloads. Of records with equal payloads of a
minimum size one is the response and the others revisit it. A task writes under a temporary name of its own and renames to
the final one, which depends on the rows alone; so a task that runs again or twice leaves the same files. The driver
writes the manifest last, again by a rename: an archive without a manifest is not committed.

Defined results: a null payload is empty; null ids are in the first range and are written as ``null``; of repeated rows all
that bear the smallest id are responses. An empty table gives an archive of no file. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .fingerprints import in_ranges

MIN_SHARED, ROLL_BYTES = 100, 32 << 20
#: Payload bytes for each shard, which one task sorts and writes.
SHARD_BYTES = 128 << 20
#: WARC-Date of every record: a writer that took the time would not be deterministic.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "manifest.json"
#: What the writer and the reader return, for Arrow and for Spark.
_DDL = {
    "files": "file string, records long, bytes long, sha256 string, first string, last string",
    "read": "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string",
}
_FILES, _READ = (pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in ddl.split(", ")]) for ddl in _DDL.values())


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _digest(payload: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(payload, F.lit("")), "UTF-8"), 256)


def revisits(rows: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Of rows (shard, id, payload) those that repeat another's payload: shard, id, digest and refers_to, the smallest id
    of those with the payload. Payloads stay out of the shuffle: digests are grouped and joined."""
    narrow = rows.where(F.octet_length("payload") >= min_shared).select("shard", "id", _digest(F.col("payload")).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and refers_to is not null").drop("_n")
    return narrow.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("shard", "id", "digest", "refers_to")


def _record(page: object, url: str | None, payload: bytes, size: int, digest: str, refers: object) -> bytes:
    """A response, or a revisit that keeps the HTTP header alone. The header gives the payload's full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=';/?:@&=+$,#%[]!*()~')}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        mine, done = uuid.uuid4().hex, []
        out = shard = None
        state: dict = {}
        told: tuple = (None, {})  # an id, and what its rows refer to by their digest

        def close() -> None:
            nonlocal out
            if out is None:
                return
            out.close()
            name = f"part-{shard:06d}-{state['roll']:05d}.warc.gz"
            fs.move(f"{root}/_temporary/{mine}", f"{root}/{name}")
            done.append((name, state["records"], state["bytes"], state["hash"].hexdigest(), state["first"], state["last"]))
            out = None

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                for own, page, of, refers, url, payload in zip(*(c.to_pylist() for c in whole.slice(low, 256).columns), strict=True):
                    if told[0] != (page, own):
                        told = ((page, own), {})
                    if of is not None:
                        told[1][of] = refers
                        continue
                    if out is not None and (own != shard or state["bytes"] >= roll_bytes):
                        close()
                    if out is None:
                        state = {"roll": state["roll"] + 1 if own == shard else 0, "records": 0, "bytes": 0, "hash": hashlib.sha256(), "first": str(page)}
                        shard = own
                        fs.create_dir(f"{root}/_temporary", recursive=True)
                        out = fs.open_output_stream(f"{root}/_temporary/{mine}", compression=None)
                    data = (payload or "").encode()
                    digest = hashlib.sha256(data).hexdigest()
                    member = gzip.compress(_record(page, url, data, len(data), digest, told[1].get(digest)), 6, mtime=0)
                    out.write(member)
                    state["hash"].update(member)
                    state["records"] += 1
                    state["bytes"] += len(member)
                    state["last"] = str(page)
            if done:
                yield _batch(done, _FILES)
                done.clear()
        close()
        if done:
            yield _batch(done, _FILES)

    return write


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", n_shards: int | None = None, roll_bytes: int = ROLL_BYTES, min_shared: int = MIN_SHARED) -> list[dict]:
    """Writes an archive of df to folder (file://, hdfs:// or what else pyarrow opens; shared by all machines) and returns its
    manifest: a row for each file. Without n_shards their number follows the bytes, SHARD_BYTES for each."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    n = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // SHARD_BYTES))
    rows, n = in_ranges(rows, "id", n)
    rows = rows.withColumnRenamed("range_id", "shard")
    # Each payload is shuffled once. What it repeats comes to its shard as a row of its own, which stands before it.
    void = lambda kind: F.lit(None).cast(kind)
    told = revisits(rows, min_shared).select("shard", "id", "digest", "refers_to", void("string").alias("url"), void("string").alias("payload"))
    rows = rows.select("shard", "id", void("string").alias("digest"), void("long").alias("refers_to"), "url", "payload").unionAll(told)
    rows = rows.repartitionById(n, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), F.col("digest").asc_nulls_last(), "url", "payload")
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    files = sorted((r.asDict() for r in rows.mapInArrow(_writer(folder, roll_bytes), _DDL["files"]).collect()), key=lambda x: x["file"])
    with fs.open_output_stream(f"{root}/_{MANIFEST}", compression=None) as f:
        f.write(json.dumps({"files": files}, sort_keys=True).encode())
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")
    fs.move(f"{root}/_{MANIFEST}", f"{root}/{MANIFEST}")
    return files


def _lines(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def _records(stream) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    inflate, got, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(1 << 20)):
        got.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(got)
            inflate, got = zlib.decompressobj(31), []
    if any(got):
        raise ValueError("a record is cut off")


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    h = _lines(head)
    block = rest[: int(h["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"]:
        raise ValueError(f"{h['WARC-Record-ID']}: the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{h['WARC-Record-ID']}: the payload's digest differs")
    page, refers = (x.removeprefix("<urn:page:").rstrip(">") if x else None for x in (h["WARC-Record-ID"], h.get("WARC-Refers-To")))
    return (None if page == "null" else int(page), urllib.parse.unquote(h["WARC-Target-URI"]), int(_lines(http)["Content-Length"]), digest, h["WARC-Type"], refers and int(refers), payload.decode() if h["WARC-Type"] == "response" else None)


def _reader(folder: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for record in _records(f):
                        row = _parsed(record)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(record) if payloads else 1000
                        if held > 16 << 20:
                            yield _batch(rows, _READ)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, _READ)

    return read


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive, their digests checked; a task for each file. payloads: whether to carry them along."""
    ship(spark)
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        files = [(k, x["file"]) for k, x in enumerate(json.loads(f.read())["files"])]
    named = spark.createDataFrame(files, "number int, file string").repartitionById(max(1, len(files)), "number").select("file")
    return named.mapInArrow(_reader(folder, payloads), _DDL["read"])
