"""WARC archives: deduplicated records, a normaliser for monolithic gzip files, and reading by offset.

1. ``write_monolithic`` writes one archive per Spark partition as a single gzip stream, as naive crawlers do.
2. ``normalise`` inflates each archive once, as a stream, rewrites every record as its own gzip member and writes a sidecar
   index (record number, offset, length, id) beside it.
3. ``read_indexed`` seeks to the members of an index and returns the records.

Files lie in the cluster's shared folder. Each is written under an attempt's name and then moved, so that a repeated or a
speculative task leaves a whole file. Memory is bounded by one record and fixed buffers.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import cut, file_system, fresh_path, hinted, text_of

MIN_REVISIT_BYTES = 1000
LEVEL = 4
BLOCK = 1 << 20
_GZIP = 31  # window bits of a gzip stream

INDEX = "archive string, record bigint, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest page_id is the response. Null html is an
    empty payload. Rows that repeat the largest page_id with the same payload are all responses; a null page_id is smaller
    than any other. Only digests that occur twice take part in the join, and they go to the pages while they are few.
    """
    payload = text_of("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    kept = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
            .agg(F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    kept = hinted(cut(kept, "repeated"), 64)
    revisit = F.col("_kept").isNotNull() & ~F.col("_kept").eqNullSafe(F.col("page_id"))
    return rows.join(kept, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_kept")).alias("refers_to"))


# --- records ------------------------------------------------------------------------------------

def _header_text(value) -> str:
    """A value on one header line; JSON text keeps line ends and any character."""
    return json.dumps(value, ensure_ascii=True)


def record_bytes(page_id, url, payload: bytes, payload_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block; both kinds carry length and digest of the full payload."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {_header_text(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:])


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, record's bytes) from any division of a WARC stream into chunks."""
    buffer, done = bytearray(), False
    need, head = 0, None
    while True:
        if head is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
            head = parse_head(bytes(buffer[:end]))
            need = end + 4 + int(head["Content-Length"]) + 4
        if head is not None and len(buffer) >= need:
            yield head, bytes(buffer[:need])
            del buffer[:need]
            head = None
            continue
        if done:
            if buffer:
                raise ValueError("the archive ends within a record")
            return
        chunk = next(chunks, None)
        if chunk is None:
            done = True
        else:
            buffer += chunk


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in blocks; a stream that is cut off raises an error."""
    z, within = zlib.decompressobj(_GZIP), False
    while data := stream.read(BLOCK):
        while data:
            out, within = z.decompress(data, BLOCK), True
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, within = z.unused_data, zlib.decompressobj(_GZIP), False
    if within:
        raise ValueError("the archive ends within a gzip stream")


class _Placed:
    """A file written under an attempt's name and moved to its place when whole."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


# --- the three steps ----------------------------------------------------------------------------

def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write classified rows as monolithic archives under ``folder``; returns archive, records (one row per archive)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        uri, n = f"{folder}/crawl-{TaskContext.get().partitionId():06d}.warc.gz", 0
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
        with _Placed(uri) as out:
            batch = first
            while batch is not None:
                for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                    out.write(z.compress(record_bytes(*row)))
                n += len(batch)
                batch = next(batches, None)
            out.write(z.flush())
        yield pd.DataFrame({"archive": [uri], "records": [n]})

    columns = records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # ids as decimals keep null apart from a number through pandas
    columns = columns.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return cut(columns.mapInPandas(run, "archive string, records bigint"), "archives")


def _dealt(df: DataFrame) -> DataFrame:
    """Whole archives, spread over the cluster."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), "archive")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column archive) with one gzip member per record under ``folder``.

    Beside each new archive lies its sidecar, NAME.idx: JSON lines of record, offset, length and id. Returns one row per
    archive: archive, sidecar, records. Input of any member layout is accepted; an archive that is cut off raises an error.
    """
    def one(uri: str) -> tuple[str, str, int]:
        fs, path = file_system(uri)
        target, at, n = f"{folder}/{path.rsplit('/', 1)[1]}", 0, 0
        with fs.open_input_stream(path, compression=None) as source, _Placed(target) as out, _Placed(f"{target}.idx") as index:
            for head, record in split_records(inflate(source)):
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                member = z.compress(record) + z.flush()
                out.write(member)
                index.write(json.dumps({"record": n, "offset": at, "length": len(member), "id": head["WARC-Record-ID"]}).encode() + b"\n")
                at, n = at + len(member), n + 1
        return target, f"{target}.idx", n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(a) for a in batch["archive"]], columns=["archive", "sidecar", "records"])

    return cut(_dealt(archives.select("archive")).mapInPandas(run, "archive string, sidecar string, records bigint"), "normalised")


def read_index(normalised: DataFrame) -> DataFrame:
    """The sidecars' rows: archive, record, offset, length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, sidecar in zip(batch["archive"], batch["sidecar"]):
                fs, path = file_system(sidecar)
                with fs.open_input_stream(path) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                frame = pd.DataFrame(entries, columns=["record", "offset", "length", "id"]).drop(columns="id")
                yield frame.assign(archive=archive)[["archive", "record", "offset", "length"]]

    return normalised.select("archive", "sidecar").mapInPandas(run, INDEX)


def read_indexed(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of index rows, each inflated from its own member. Without ``payloads`` that column is null.

    Length and digest are those of the full payload: counted from the block of a response, which must agree with its
    headers, and taken from the headers of a revisit.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        page = lambda urn: urn[len("<urn:page:"):-1] or None
        for batch in batches:
            for lo in range(0, len(batch), 500):
                out = []
                for archive, rows in batch.iloc[lo:lo + 500].groupby("archive", sort=False):
                    fs, path = file_system(archive)
                    with fs.open_input_file(path) as f:
                        for offset, length in zip(rows["offset"], rows["length"]):
                            f.seek(offset)
                            record = zlib.decompress(f.read(length), _GZIP)
                            end = record.index(b"\r\n\r\n")
                            h, body = parse_head(record[:end]), record[end + 4:-4]
                            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                            if h["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
                                raise ValueError(f"payload and headers differ in {archive} at {offset}")
                            out.append((page(h["WARC-Record-ID"]), json.loads(h["WARC-Target-URI"]), size, digest, h["WARC-Type"],
                                        page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, body if payloads else None))
                frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.select("archive", "offset", "length").mapInPandas(run, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; the records without payloads. An empty table gives no archives and no rows."""
    folder = folder or fresh_path(spark, "warc")
    archives = write_monolithic(classify(pages), f"{folder}/monolithic")
    return read_indexed(read_index(normalise(archives, f"{folder}/members")), payloads=False)
