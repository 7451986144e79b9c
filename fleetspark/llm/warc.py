"""WARC archives in Zstandard: a writer, and a reader that trusts nothing it hasn't checked.

An archive is a leading skippable frame with the dictionary (magic 0x184D2A5D), then one Zstandard frame per record, so
that a record can be read without its neighbours. The reader takes the dictionary from that frame (plain or itself
compressed), walks the frames by their block headers, decodes one frame per record, and checks version line, header
syntax, mandatory fields, Content-Length, the closing blank lines and the block's and payload's digests.

Payloads that repeat are stored once: of records with equal payloads of at least ``least`` bytes, that with the largest
page_id is a response and the others are revisits that name it and carry no payload.

The writer's tasks put archives into the shared folder and report them in a table that Spark commits; archives of tasks
that were lost or ran twice are in no report and are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.shared import hash_sample, lean, new_folder, small_batches, table, written

# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC, PLAIN_DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

LEAST_REVISIT_BYTES = 1000
#: Compressed bytes after which a writer begins the next archive; the reader holds one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Bytes of the dictionary; payloads that it is learnt from, and bytes of each, from a place that its hash names.
DICTIONARY_BYTES, DICTIONARY_PAYLOADS, DICTIONARY_PAYLOAD_BYTES = 64 << 10, 400, 16 << 10
DATE = "1970-01-01T00:00:00Z"
#: The high halves of record ids: ids that hold a page_id, and those of records without one.
WITH_ID, WITHOUT_ID = 0x5741524350414745, 0x574152434E554C4C

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, error string"


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=((WITHOUT_ID << 64) if page_id is None else (WITH_ID << 64) | (page_id & (1 << 64) - 1)))}>"


def _page_id(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 != WITH_ID:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its HTTP message, or for refers_to a revisit record with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def frames(data: bytes):
    """(start, end) of each Zstandard frame, by the lengths in its block headers; skippable frames are passed over."""
    at, n = 0, len(data)
    while at < n:
        if n - at < 8:
            raise ValueError(f"cut off at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        flags, start = data[at + 4], at
        single = flags >> 5 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            if at + 3 > n:
                raise ValueError(f"the frame at byte {start} is cut off")
            header = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = header & 1, header >> 1 & 3, header >> 3
            if kind == 3:
                raise ValueError(f"a reserved block type at byte {at}")
            at += 3 + (1 if kind == 1 else size)
        at += 4 * (flags >> 2 & 1)
        if at > n:
            raise ValueError(f"the frame at byte {start} is cut off")
        yield start, at


def leading_dictionary(data: bytes) -> bytes:
    """The dictionary of an archive, empty without one."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return b""
    size = struct.unpack_from("<I", data, 4)[0]
    inside = data[8 : 8 + size]
    if len(inside) != size:
        raise ValueError("the dictionary frame is cut off")
    if inside[:4] == struct.pack("<I", FRAME_MAGIC):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(inside)
    return inside


def parse_record(data: bytes) -> dict:
    """The fields of RECORDS but for archive and error; ValueError if anything is amiss."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the headers")
    version, *lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"not a WARC version: {version[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"not a header: {line[:40]!r}")
        if name.lower() in fields:
            raise ValueError(f"a header twice: {name}")
        fields[name.lower()] = value.strip()
    for name in MANDATORY:
        if name.lower() not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {len(rest) - 4}")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha1(block):
        raise ValueError("the block differs from its digest")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return {"page_id": None, "url": None, "record_type": kind, "refers_to": None, "payload_bytes": None, "payload_digest": None, "payload": None}
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if not size:
        raise ValueError("no length of the payload")
    said = fields.get("warc-payload-digest", "")
    if not said.startswith("sha1:"):
        raise ValueError("no SHA-1 of the payload")
    refers_to = None
    if kind == "response":
        if len(payload) != int(size[1]):
            raise ValueError(f"the payload has {len(payload)} bytes, its length says {size[1].decode()}")
        if said != _sha1(payload):
            raise ValueError("the payload differs from its digest")
    else:
        if payload:
            raise ValueError("a revisit with a payload")
        if "warc-refers-to" not in fields:
            raise ValueError("a revisit of nothing")
        refers_to = _page_id(fields["warc-refers-to"])
    return {"page_id": _page_id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": refers_to, "payload_bytes": int(size[1]), "payload_digest": base64.b32decode(said[5:]).hex(), "payload": payload if kind == "response" else None}


def _filesystem(uri: str):
    """A file system that Python workers can write to, and the path in it."""
    import pyarrow.fs as fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def train_dictionary(pages: DataFrame, payload_column: str) -> bytes:
    """A dictionary from a bounded sample of different payloads in hash order, as records.

    It is trained where there is eight times its size to learn from; else it is the sample's records themselves, as
    plain content, or without any payload an empty record.
    """
    import zstandard

    payload, order = F.encode(F.col(payload_column).cast("string"), "UTF-8"), F.xxhash64(payload_column)
    rows = pages.where(F.octet_length(payload_column) > 0).select(payload.alias("p"), order.alias("h"))
    window = F.col("p").substr(F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("p") - DICTIONARY_PAYLOAD_BYTES + 1)).cast("int") + 1, F.lit(DICTIONARY_PAYLOAD_BYTES))
    # a payload that many pages share counts once
    picked = hash_sample(rows.select("h").distinct(), F.col("h"), DICTIONARY_PAYLOADS)
    found = rows.join(F.broadcast(picked), "h").groupBy("h").agg(F.min(window).alias("p"))  # DICTIONARY_PAYLOADS hashes at most
    samples = [bytes(r["p"]) for r in found.orderBy("h").collect()]
    records = [record_bytes(i, f"http://example.org/{i}", x, _sha1(x), None) for i, x in enumerate(samples)] or [record_bytes(0, None, b"", _sha1(b""), None)]
    if sum(map(len, records)) >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
        except zstandard.ZstdError:  # records too much alike
            pass
    return b"".join(records)[:DICTIONARY_BYTES]


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id of the records with the same payload, where that is another."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # equal payloads have equal digests and lengths; two digests are as good as the bytes
    key = [F.sha1(F.encode("html", "UTF-8")).alias("k1"), F.xxhash64("html").alias("k2")]
    sizes = p.where(F.octet_length("html") >= least).select("page_id", *key)
    groups = sizes.groupBy("k1", "k2").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    groups = written(groups, "warc-groups")
    keyed = p.select("*", F.when(F.octet_length("html") >= least, key[0]).alias("k1"), key[1])
    joined = keyed.join(groups, ["k1", "k2"], "left")  # payloads that many pages share are a skewed key, which Spark splits at run time
    return joined.select("page_id", "url", "html", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, level: int = 3) -> DataFrame:
    """Writes every row of pages (page_id, url, html) as a record; returns the report: archive, records, bytes.

    A null html is an empty payload, a null url about:blank. Rows that repeat are written each; of rows with the largest
    page_id of equal payloads all are responses. A page_id may be null; such a record is never one that others refer to.
    An empty table has no archives.
    """
    fs, where = _filesystem(f"{folder}/archives")
    fs.create_dir(where, recursive=True)
    dictionary = train_dictionary(pages, "html")

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, where = _filesystem(f"{folder}/archives")
        own = zstandard.ZstdCompressionDict(dictionary)
        own.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(dict_data=own, write_checksum=True, write_content_size=True)
        parts, size, count, made = [], 0, 0, 0

        def close():
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.warc.zst"
            with fs.open_output_stream(f"{where}/{name}", compression=None) as f:
                f.write(dictionary_frame(dictionary))
                for x in parts:
                    f.write(x)
            return pa.RecordBatch.from_pylist([{"archive": name, "records": count, "bytes": size}])

        for batch in small_batches(batches):
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                parts.append(packer.compress(record_bytes(page, url, html, _sha1(html), refers)))
                size, count = size + len(parts[-1]), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, size, count, made = [], 0, 0, made + 1
        if parts:
            yield close()

    typed = with_record_types(pages, least).withColumn("html", F.encode("html", "UTF-8"))
    return written(lean(typed, run, "archive string, records long, bytes long"), "warc-report")


def read_archives(spark: SparkSession, folder: str, report: DataFrame | None = None, on_error: str = "raise") -> DataFrame:
    """One row per record of the archives in folder, with RECORDS' columns; report limits it to the archives named there.

    on_error: "raise" fails on the first record that doesn't check, "keep" returns it with its error and no other values.
    """
    import pyspark.errors

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/archives")
    except pyspark.errors.AnalysisException:  # no folder: nothing was written
        return spark.createDataFrame([], RECORDS)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if report is not None:
        files = files.join(report.select("archive").distinct(), "archive", "left_semi")

    def run(batches):
        import zstandard

        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RECORDS.split(", ")])
        for batch in batches:
            for row in range(batch.num_rows):
                archive, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                out, size = [], 0
                try:
                    dictionary = leading_dictionary(data)
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
                    walk, walking = frames(data), True
                except (ValueError, zstandard.ZstdError) as e:
                    if on_error == "raise":
                        raise ValueError(f"{archive}: {e}") from e
                    out.append(dict.fromkeys(names) | {"archive": archive, "error": str(e)})
                    walking = False
                while walking:
                    try:
                        start, end = next(walk)
                    except StopIteration:
                        break
                    except (ValueError, IndexError) as e:
                        if on_error == "raise":
                            raise ValueError(f"{archive}: {e}") from e
                        out.append(dict.fromkeys(names) | {"archive": archive, "error": str(e)})
                        break
                    try:
                        record = parse_record(unpack.decompressobj().decompress(data[start:end])) | {"archive": archive, "error": None}
                    except (ValueError, zstandard.ZstdError) as e:
                        if on_error == "raise":
                            raise ValueError(f"{archive}, byte {start}: {e}") from e
                        record = dict.fromkeys(names) | {"archive": archive, "error": str(e)}
                    out.append(record)
                    size += len(record["payload"] or b"")
                    if size > 4 << 20 or len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return lean(files, run, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    report = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, report).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE n >= {LEAST_REVISIT_BYTES} GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.last IS NULL OR g.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.last <> p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""

QUERIES, ORACLES = {"op6_warc": op6_warc}, {"op6_warc": ORACLE}
