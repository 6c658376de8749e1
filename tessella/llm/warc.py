"""WARC archives with one Zstandard dictionary per file.

Every archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, trained on the first records of that archive; every record is then
a frame of its own. A record frame is followed by a one-byte skippable frame
whose content is the line end of Spark's text writer: that writer puts the
bytes out, so commits, retries and remote stores are Spark's.

Of records with equal payloads the one with the largest id is the response and
the others revisit it.

Edge cases: a null payload is the empty payload; empty payloads are deduplicated
like others; a group whose ids are all null has only responses; a null id that
meets an id revisits it; rows that repeat the largest id are all responses; an
empty table gives no records. If too few records stand in an archive to train
on, the archive has no dictionary frame, which readers accept. Other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import scratch_path

# Fixed values of the format
DICTIONARY_MAGIC = 0x184D2A5D
PADDING_MAGIC = 0x184D2A50
_LINE_END = struct.pack("<II", PADDING_MAGIC, 1)  # Spark's writer adds the byte itself

#: Bounds of the sample a dictionary is trained on, and its size.
SAMPLE_BYTES = 1_500_000
SAMPLE_RECORD_BYTES = 16_384
DICTIONARY_BYTES = 32_768
MIN_SAMPLES = 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and drops the body."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(records) < MIN_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_RECORD_BYTES] for r in records], k=512, d=8)
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """Dictionary frame first, then a frame for each record."""
    first, held = [], 0
    for r in records:
        first.append(r)
        held += min(len(r), SAMPLE_RECORD_BYTES)
        if held >= SAMPLE_BYTES:
            break
    if not first:
        return
    trained = train(first)
    if trained is not None:
        data = trained.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data + _LINE_END
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained) if trained is not None else zstandard.ZstdCompressor(level=3)
    while first:
        yield packer.compress(first.pop(0)) + _LINE_END
    for r in records:
        yield packer.compress(r) + _LINE_END


def read_records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    at, trained = 0, None
    while at < len(archive):
        magic = int.from_bytes(archive[at : at + 4], "little")
        if magic >> 4 == PADDING_MAGIC >> 4:
            size = int.from_bytes(archive[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                trained = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
            at += 8 + size
            continue
        opener = (zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()).decompressobj()
        chunk, out = 1 << 16, []
        start = at
        while not opener.eof:
            part = archive[start : start + chunk]
            if not part:
                raise ValueError("an archive ends inside a record")
            out.append(opener.decompress(part))
            start += len(part)
        at = start - len(opener.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {
        "id": fields["WARC-Record-ID"][10:-1] or None, "url": fields["WARC-Target-URI"].encode().decode("unicode_escape"),
        "payload_bytes": stated, "payload_digest": digest, "record_type": kind,
        "refers_to": fields["WARC-Refers-To"][10:-1] if kind == "revisit" else None, "payload": payload,
    }


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload_bytes: int = 0) -> None:
    """Write ``pages`` as archives below ``path``, one file per partition of the plan.

    Records with equal payloads of at least ``min_payload_bytes`` are
    deduplicated; smaller ones are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("p"))
    rows = rows.withColumn("h", F.concat(F.sha1("p"), F.length("p").cast("string")))
    owners = rows.where(F.length("p") >= min_payload_bytes).groupBy("h").agg(F.max("i").alias("o"), F.count("*").alias("n")).where("n > 1 and o is not null").select(F.col("h").alias("g"), "o")
    kept = scratch_path(pages.sparkSession, "owners")
    owners.write.parquet(kept)
    owners = pages.sparkSession.read.schema(owners.schema).parquet(kept)
    joined = rows.join(owners, F.col("h") == F.col("g"), "left").select("i", "u", "p", F.when(F.col("i").eqNullSafe(F.col("o")), None).otherwise(F.col("o")).alias("o"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for b in batches:
                for i, u, p, o in zip(b["i"], b["u"], b["p"], b["o"]):
                    yield record_bytes(None if pd.isna(i) else int(i), u, bytes(p), None if pd.isna(o) else int(o))

        block: list[bytes] = []
        for f in frames(records()):
            block.append(f)
            if len(block) == 256:
                yield pd.DataFrame({"f": block})
                block = []
        if block:
            yield pd.DataFrame({"f": block})

    # ids travel as text, so that nulls do not turn them into floats
    joined.select(F.col("i").cast("string").alias("i"), "u", "p", F.col("o").cast("string").alias("o")).mapInPandas(run, "f binary").select(F.col("f").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; digests of responses are checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["content"]:
                block, held = [], 0
                for record in read_records(bytes(archive)):
                    block.append(parse_record(record))
                    held += len(record)
                    if held > 4_000_000:
                        yield pd.DataFrame(block)
                        block, held = [], 0
                if block:
                    yield pd.DataFrame(block)

    raw = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).where("length > 0")
    return raw.select("content").mapInPandas(run, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
