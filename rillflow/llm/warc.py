"""WARC archives: one Zstandard frame per record, the dictionary in the leading skippable frame.

An archive is a binary value: a row (archive, content) of a table in the shared folder, or a .warc.zst file, read with
Spark's binaryFile source (column content). Writing deals records to archives of bounded size by a hash of id, address,
payload and number among equal rows, so no id or payload makes an archive large;
reading takes one archive at a time, loads its dictionary, decodes frame after frame, and validates every record.

Equal payloads are written once: the record with the smallest id carries it, others are `revisit` records that refer to
it and keep its HTTP head, whose Content-Length is the length of the full payload.

Defined results: a null payload is an empty one; a null id is written as the word null, is read back as null, and
comes after all others, so a record refers to one without an id only where no equal one has any; rows equal in id and payload are each written (one of them is the response, the others revisit it); an empty
table gives no archives and an empty result; other columns are not written. A damaged frame, header, length or digest
raises WarcError in `read_archives`, or yields a row with `error` set where strict=False.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, table

#: Fixed values of the formats.
VERSION = b"WARC/1.1"
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive holds about so many records, or payloads of about so many bytes, whichever are fewer records.
RECORDS = 512
ARCHIVE_BYTES = 32 << 20
#: Payload bytes of a task that writes archives, about.
TASK_BYTES = 32 << 20
DICT_BYTES = 16 << 10
#: A dictionary is trained on at most so many bytes of an archive's own payloads.
TRAIN_BYTES = 1 << 20
DATE = "2026-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str, url: str, digest: str, copy: int) -> str:
    """Unique within a collection: the page's id, and a digest of what tells records of one id apart."""
    own = hashlib.sha1(f"{len(url)}:{url}{digest}{copy}".encode("utf-8", "surrogatepass")).hexdigest()[:24]
    return f"<urn:page:{urllib.parse.quote(key, safe='')}:{own}>"


def record_bytes(key: str, url: str, payload: bytes | None, length: int, digest: str, refers_to: str | None, copy: int = 0) -> bytes:
    """A response with its payload, or (payload None) a revisit of the record with the id refers_to. Ids and addresses are
    percent-encoded in headers."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = [f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(key, url, digest, copy)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if payload is None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the first TRAIN_BYTES of an archive's records; none where they are too few to train on."""
    taken, size = [], 0
    for s in samples:
        if size >= TRAIN_BYTES:
            break
        taken.append(s[: 64 << 10])
        size += len(taken[-1])
    try:
        return zstandard.train_dictionary(DICT_BYTES, taken).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes]) -> bytes:
    found = train_dictionary(records)
    frames = [struct.pack("<II", SKIPPABLE, len(found)) + found] if found else []
    tool = zstandard.ZstdCompressor(level=6, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(found) if found else None)
    return b"".join(frames + [tool.compress(r) for r in records])


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one per record; its dictionary may itself be a compressed frame."""
    at, found = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        raw, at = content[8 : 8 + size], 8 + size
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut short")
        found = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
    tool = zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()
    while at < len(content):
        one = tool.decompressobj()
        try:
            out = one.decompress(memoryview(content)[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut short")
        at = len(content) - len(one.unused_data)
        yield out


def parse_record(raw: bytes) -> dict:
    """Headers and block of one record; raises WarcError where version, headers, lengths or digests are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no {need} header")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is not a number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    block = rest[:size]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise WarcError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = headers["warc-type"]
    if kind == "response":
        if length != len(payload):
            raise WarcError(f"the payload has {len(payload)} bytes, its header says {length}")
        if "warc-payload-digest" in headers and headers["warc-payload-digest"] != f"sha1:{digest32(payload)}":
            raise WarcError("the payload's digest is wrong")
    return {"type": kind, "headers": headers, "payload": payload if kind == "response" else None, "payload_bytes": length}


def _key(value: str | None) -> str | None:
    """The page's id in a record's."""
    return None if value is None else urllib.parse.unquote(value.removeprefix("<urn:page:").removesuffix(">").rpartition(":")[0])


def write_records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(archive, content): archives of all rows, written to the shared folder. Payloads of fewer than least_bytes are always responses."""
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.col(key).cast("long").alias("rank"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    own = ["key", "url", "digest"]
    # Rows are counted before they are moved, so a large group of copies sends one row a task.
    counts = materialize(rows.groupBy(*own, "rank", "size").agg(F.count("*").alias("n")), "warc-counts")
    total, size = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    archives = max(1, -(-(total or 0) // RECORDS), -(-(size or 0) // ARCHIVE_BYTES))
    place = F.struct(F.col("rank").isNull().alias("none"), "rank", "key", "url")  # real ids first
    first = counts.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("n")).where("n > 1")
    first = materialize(first.select("digest", F.col("first.key").alias("first"), F.col("first.url").alias("first_url")), "warc-copies")
    # Rows equal in all are told apart by a number: one goes on with its payload, the others are made from their count.
    repeated = counts.where("n > 1").select(*own, "n")
    again = rows.select(*own, "size", F.lit(0).cast("long").alias("copy"), "payload")
    if not repeated.isEmpty():
        alike = again.join(repeated, own, "left_semi").groupBy(*own, "size", "copy").agg(F.first("payload").alias("payload"))
        others = counts.where("n > 1").select(*own, "size", F.explode(F.expr("sequence(1L, n - 1)")).alias("copy"), F.lit(None).cast("binary").alias("payload"))
        if least_bytes:  # small ones are responses each, with a payload of their own
            small = others.where(F.col("size") < least_bytes).drop("payload").join(alike.select(*own, "payload"), own)
            others = others.where(F.col("size") >= least_bytes).unionByName(small)
        again = again.join(repeated, own, "left_anti").unionByName(alike).unionByName(others)
    again = again.join(first, "digest", "left")
    revisits = F.col("first").isNotNull() & ((F.col("first") != F.col("key")) | (F.col("first_url") != F.col("url")) | (F.col("copy") > 0))
    again = again.select(*own, "size", "copy", "first", "first_url", revisits.alias("revisits"), F.when(~revisits, F.col("payload")).alias("payload"))
    again = again.withColumn("archive", F.pmod(F.xxhash64(*own, "copy"), F.lit(archives)).cast("long"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for r in pdf.sort_values([*own, "copy"], kind="stable").itertuples():
            digest = base64.b32encode(bytes.fromhex(r.digest)).decode()
            made.append(record_bytes(r.key, r.url, None if r.revisits else bytes(r.payload), r.size, digest, record_id(r.first, r.first_url, digest, 0) if r.revisits else None, r.copy))
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [write_archive(made)]})

    # As many tasks as the payloads' bytes ask for, whatever the session's own number is.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // TASK_BYTES + 1)
    return materialize(again.repartition(tasks, "archive").groupBy("archive").applyInPandas(build, "archive long, content binary"), "warc")


def read_archives(archives: DataFrame, strict: bool = True) -> DataFrame:
    """(record_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, error) from rows with `content`."""

    def decode(batches):
        for pdf in batches:
            for content in pdf["content"]:
                out = []
                try:
                    for raw in frames(content):
                        try:
                            r = parse_record(raw)
                        except WarcError as e:
                            if strict:
                                raise
                            out.append((None, None, None, None, None, None, None, str(e)))
                            continue
                        h = r["headers"]
                        out.append((_key(h["warc-record-id"]), urllib.parse.unquote(h.get("warc-target-uri", "")), r["type"], r["payload"], r["payload_bytes"], h.get("warc-payload-digest", "").removeprefix("sha1:"), _key(h.get("warc-refers-to")), None))
                except WarcError as e:
                    if strict:
                        raise
                    out.append((None, None, None, None, None, None, None, str(e)))
                yield pd.DataFrame(out, columns=["record_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "error"])

    return archives.select("content").mapInPandas(decode, "record_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, error string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(write_records(table(spark, sf_dir, "pages")))
    return back.select(F.expr("try_cast(record_id AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))


#: Base32 of the hexadecimal SHA-1: its 160 bits, five at a time.
SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
  SELECT page_id, body, octet_length(body) AS n, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', instr('0123456789abcdef', c) * 4 - 3, 4) for c in string_split(sha1(body), '')], '') AS bits FROM p
), d AS (
  SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1) for i in range(32)], '') AS digest, min(page_id) OVER (PARTITION BY body) AS head FROM h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d
"""
