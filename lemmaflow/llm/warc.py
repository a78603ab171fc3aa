"""Deterministic sharded WARC writer, and the reader of its archives.

Records are range-sorted: shards are stretches of (id, digest) of about ``shard_bytes`` of payload each. Their cuts
are quantiles, weighted by bytes, of the rows with the smallest hashes, a bounded sample that any layout of the same
table gives; so dense, far-off and repeated ids do no harm, and the same table always gives the same shards. Which
records are revisits is decided on ids and digests alone. These decisions and the payloads go to their shard in one
shuffle, where the writer meets a decision just before its records. Records are compressed one by one; a file ends
once it passes ``roll_bytes``. Record ids, dates, digests and headers are made from the row alone. A file is
written under a temporary name of the task attempt and then renamed, so that a repeated attempt replaces it by
the same bytes; the manifest, written last and committed as a whole, names the files that count.

Of records with equal payloads of at least ``min_revisit`` bytes the smallest id is a response, others are
revisits of it without the payload; smaller ones are responses.

Defined cases: a null payload or url is empty; a null id is written as an empty id field, sorts first and is a
response; of repeated ids with equal payloads one row of the smallest id is the response (ties among wholly equal
rows: all of that id are responses); rows of one id and payload stay in one shard; other columns are ignored; an
empty table gives a manifest without files.
"""

import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm.common import bounded_batches

#: At most so many shards are made (beyond, they grow), from so many sampled rows each.
MOST_SHARDS, SAMPLED = 1 << 14, 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _named(n) -> str:
    return "" if n is None else str(n)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-Id: {_named(page_id)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _shards(sized: DataFrame, target: int):
    """The number of shards, and a row's shard as a column. MOST_SHARDS * SAMPLED rows come to the driver at most."""
    weight, id_ = F.col("payload_bytes") + 500, F.coalesce("page_id", F.lit(-(1 << 63)))
    total = sized.agg(F.sum(weight)).first()[0]
    n = min(MOST_SHARDS, max(1, -(-(total or 0) // target)))
    by_hash = sized.select(id_.alias("id"), "digest", weight.alias("w")).orderBy(F.xxhash64("digest", "id"), "digest", "id")
    rows = sorted(map(tuple, by_hash.limit(n * SAMPLED).collect())) if n > 1 else []
    before = np.cumsum([w for _, _, w in rows])
    at = np.searchsorted(before, np.arange(1, n) * (before[-1] / n)) if rows else []
    cuts = sorted({rows[k][:2] for k in at})
    if not cuts:
        return 1, F.lit(0)
    known = sized.sparkSession.sparkContext.broadcast(cuts)  # MOST_SHARDS at most

    @F.arrow_udf("int")
    def shard(ids: pa.Array, digests: pa.Array) -> pa.Array:
        return pa.array([bisect_right(known.value, key) for key in zip(ids.to_pylist(), digests.to_pylist(), strict=True)], pa.int32())

    return len(cuts) + 1, shard(id_, "digest")


def write_archives(pages: DataFrame, out: str, min_revisit: int = 100, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20) -> DataFrame:
    """Writes ``out``/*.warc.gz and ``out``/manifest; gives the manifest. pages: page_id, url, html."""
    bounded_batches(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    read = read.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    n, shard = _shards(read, shard_bytes)
    small = read.where((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last").drop("last")
    decided = small.join(first, "digest").where("page_id <> refers_to").distinct()
    none = F.lit(None)
    rows = decided.select("page_id", "digest", "refers_to", none.cast("string").alias("url"), none.cast("binary").alias("payload"))
    rows = rows.unionByName(read.select("page_id", "digest", none.cast("long").alias("refers_to"), "url", "payload")).withColumn("shard", shard)
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("page_id", "digest", F.col("refers_to").isNull(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        stream = name = now = None
        seq = records = size = 0
        done, digest, revisit = [], None, (None, None, None)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def close():
            nonlocal stream
            stream.close()
            store.move(f"{root}/.{name}.{attempt}.tmp", f"{root}/{name}")
            done.append((now, seq, name, records, size, digest.hexdigest()))
            stream = None

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("shard", "page_id", "url", "payload", "digest", "refers_to")]
            for shard, page_id, url, content, sha, refers_to in zip(*columns, strict=True):
                if refers_to is not None:
                    revisit = page_id, sha, refers_to
                    continue
                refers_to = revisit[2] if revisit[:2] == (page_id, sha) else None
                if stream is not None and (shard != now or size >= roll_bytes):
                    close()
                    seq = seq + 1 if shard == now else 0
                if stream is None:
                    seq = seq if shard == now else 0
                    now, records, size, digest = shard, 0, 0, hashlib.sha256()
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    stream = store.open_output_stream(f"{root}/.{name}.{attempt}.tmp", compression=None)
                packed = gzip.compress(record(page_id, url, content, sha, refers_to), 6, mtime=0)
                stream.write(packed)
                digest.update(packed)
                records, size = records + 1, size + len(packed)
        if stream is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["shard", "seq", "file", "records", "bytes", "sha256"])

    written = rows.mapInArrow(write, MANIFEST)
    written.write.parquet(f"{out}/manifest")
    return written.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _records(stream) -> Iterator[tuple]:
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not at the start of a record")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode().partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError("a record is damaged")
        body = block.partition(b"\r\n\r\n")[2]
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
            raise ValueError("a payload is damaged")
        number = lambda k: int(head[k]) if head.get(k) else None
        url = head["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        yield number("X-Page-Id"), size, digest, head["WARC-Type"], number("X-Refers-To-Page"), url


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """The records of the files that the manifest of ``out`` names, with digests and lengths checked."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("file")
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for file in batch["file"].to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows = list(_records(stream))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return manifest.repartition(min(max(1, manifest.count()), MOST_SHARDS)).mapInArrow(read, RECORD)
