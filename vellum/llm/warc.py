"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of the records. Each archive file begins with a skippable frame that
holds it; every record follows as a frame of its own, so that any record can be read by its offset. Records with
equal payloads are found by digest: one is stored, the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import NewFile, open_to_read
from .shared import new_path, small_side, written

#: When pages were fetched, where nothing tells.
DATE = "2024-01-01T00:00:00Z"
#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Dictionary bytes, and the bounds of its training sample: whole records, and bytes of all of them together.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 64 * 1024, 1000, 16 * 1024 * 1024
#: A file is closed beyond so many bytes.
FILE_BYTES = 64 * 1024 * 1024
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: So many repeated digests at most are broadcast (80 bytes each); more are joined by shuffling.
BROADCAST_DIGESTS = 100_000

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, path string, offset long"


def marked_records(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to) of each page; refers_to set on revisits."""
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    hashed = given.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = (
        hashed.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("r_digest"))
        .agg(F.max("page_id").alias("r_last"), F.count("*").alias("r_n"))
        .where("r_n > 1 and r_last is not null")
        .drop("r_n")
    )
    # written, so that the join below deals both sides anew and a digest on many rows can be split
    repeated = small_side(written(repeated, "repeated-digests"), BROADCAST_DIGESTS)
    return hashed.join(repeated, F.col("payload_digest") == F.col("r_digest"), "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("page_id").eqNullSafe(F.col("r_last")), None).otherwise(F.col("r_last")).alias("refers_to")
    )


def train_dictionary(pages: DataFrame, id_col: str, url_col: str, body_col: str, date: str = DATE, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from a sample of whole records, spread evenly by the hash of id and body; empty if there is too little.

    About twice ``sample_records`` rows are drawn, whatever the table's size. In the order of hashes they are taken as long
    as there are no more than ``sample_records``, and none that makes all taken exceed ``sample_bytes``; only these reach the
    driver, as records that hold their payload.
    """
    import zstandard

    share = int(min(1.0, 2 * sample_records / max(1, pages.count())) * 2**30)
    body = F.coalesce(F.col(body_col), F.lit(""))
    hashed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.xxhash64(F.col(id_col), F.lit("dictionary")).alias("h"), F.xxhash64(body, F.col(url_col)).alias("t"))
    few = hashed.where((F.pmod("h", F.lit(2**30)) <= share) & (F.col("body") != ""))
    taken, used = [], 0
    for r in few.select("h", "t", F.octet_length("body").alias("size")).orderBy("h", "t").limit(sample_records).collect():
        if used + r.size <= sample_bytes:
            taken.append((r.h, r.t))
            used += r.size
    if len(taken) < 8:
        return b""
    wanted = pages.sparkSession.createDataFrame(sorted(set(taken)), "w_h long, w_t long")
    rows = few.join(F.broadcast(wanted), (F.col("h") == F.col("w_h")) & (F.col("t") == F.col("w_t"))).orderBy("h", "t").limit(len(taken)).collect()
    bodies = [(r, r.body.encode()) for r in rows]
    sample = [record_bytes(None if r.page_id is None else str(r.page_id), r.url, b, hashlib.sha1(b).hexdigest(), None, date, f"sample:{i}") for i, (r, b) in enumerate(bodies)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 10)), sample).as_bytes()
    except zstandard.ZstdError:  # too uniform to learn from
        return b""


def header_value(value: str) -> str:
    """A value that stays on its header line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, own: str) -> bytes:
    """One WARC/1.1 record.

    A response of a page with id is named by id and digest, so that revisits can tell its name; all other records by
    ``own``, which no other record has.
    """
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, x)}>"
    mine = own if page_id is None or refers_to is not None else f"page:{page_id}:{digest}"
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", name(mine)), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("X-Page-ID", header_value(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(f"page:{refers_to}:{digest}")), ("X-Refers-To-Page-ID", header_value(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, dictionary: bytes, to: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of ``records`` as archive files below ``to``; returns the manifest (path, records, bytes).

    Files get names of their own and appear only when complete. The manifest is written as a table: it names the files
    of the attempts that succeeded, so files left by a lost task are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        learned = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=learned, write_content_size=True)
        file, count, size, done = None, 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if file is None:
                    file, count = NewFile(f"{to}/{uuid.uuid4().hex}.warc.zst"), 0
                    size = file.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                page = None if r["page_id"] is None else str(r["page_id"])
                refers = None if r["refers_to"] is None else str(r["refers_to"])
                size += file.stream.write(compressor.compress(record_bytes(page, r["url"], r["payload"], r["payload_digest"], refers, date, f"{file.uri}:{count}")))
                count += 1
                if size >= file_bytes:
                    file.finish()
                    done.append((file.uri, count, size))
                    file = None
        if file is not None:
            file.finish()
            done.append((file.uri, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return written(records.mapInArrow(run, MANIFEST), "warc-manifest")


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record; the digest and length of a stored payload are counted anew and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": fields.get("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": fields.get("X-Refers-To-Page-ID"),
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": None if revisit else payload,
    }


def archived_records(path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive file, read as a stream."""
    import zstandard

    with open_to_read(path) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} has no dictionary frame")
        dictionary = stream.read(size)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        offset, held = 8 + size, b""
        while held or (held := stream.read(1 << 20)):
            one, parts, taken = decompressor.decompressobj(), [], 0
            while not one.eof:
                if not held and not (held := stream.read(1 << 20)):
                    raise ValueError(f"{path} ends within a record")
                parts.append(one.decompress(held))
                rest = one.unused_data if one.eof else b""
                taken += len(held) - len(rest)
                held = rest
            yield offset, b"".join(parts)
            offset += taken


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the files that ``manifest`` (path) names, see RECORD; ``payloads`` False leaves payloads null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in RECORD.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for offset, raw in archived_records(path):
                    rows.append(parse_record(raw) | {"path": path, "offset": offset})
                    if not payloads:
                        rows[-1]["payload"] = None
                    size += len(raw) if payloads else 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types, strict=True))))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types, strict=True))))

    files = manifest.select("path")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = REVISIT_BYTES, to: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` and returns the manifest.

    Of rows with equal bodies of at least ``least`` bytes, that with the largest id is stored, the others are revisits
    of it; smaller ones are all stored.

    Null bodies are empty payloads; null urls leave out the target; null ids are stored without id and, of equal
    bodies, refer to the largest id there is (all stored if there is none). Repeated rows: all rows of the largest id
    are stored, and as they are one page of one body their records bear the same name. Bodies of any length are stored whole. An empty table gives no files. Other columns are left out.
    """
    records = marked_records(pages, id_col, url_col, body_col, least)
    return write_archives(records, train_dictionary(pages, id_col, url_col, body_col), to or new_path(pages.sparkSession, "warc"))


__all__ = ["archive", "archived_records", "parse_record", "read_archives", "record_bytes", "train_dictionary", "write_archives"]
