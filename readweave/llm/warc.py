"""WARC archives under Zstandard: written and read through Spark's own file sources.

An archive begins with a skippable frame that holds the dictionary; each record is
one frame. Which records are revisits is found from keys and digests alone. A filter of
their keys, a bitmap of bounded size, is broadcast: pages that it rules out go into
archives where they are, only the others' frames are shuffled, to be joined with the
revisits by key. Spark's text sink writes each archive as one row, its line separator
being an empty skippable frame, which every Zstandard reader passes over; its binary
source reads whole archives, of ``archive_bytes`` at most (a larger record has one of
its own), however much a partition holds. The reader finds each frame's end from its
block headers, decodes it with the dictionary, and checks version, headers, lengths and
the payload's digest: a record
that fails raises ValueError with the archive's name.

Payloads of ``least`` bytes or more that are equal (by SHA-1 and length) have one
response, the one with the largest key, and revisits that refer to it. Null payloads
count as empty, null URLs too. Rows with equal payloads that tie for the largest key are all
responses; a row without a key is a response of its own. Repeated rows have a record each.
No rows make no archives. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import flat

#: Fixed values of the formats.
DICTIONARY, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 100, 64 << 10, 32 << 10
ARCHIVE_BYTES = 64 << 20
#: Bits of the filter of revisits' keys: 16 MiB.
CELLS = 1 << 27
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = 0x52574541 << 96  # the upper half of our record ids


def record_id(key: int | None, serial: int = 0) -> str:
    """A URN for a key; without a key, one for the row's own number."""
    low = (key & ((1 << 64) - 1)) if key is not None else (serial & ((1 << 64) - 1))
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | ((key is None) << 64) | low)}>"


def key_of(urn: str) -> int | None:
    number = uuid.UUID(urn.removeprefix("<urn:uuid:").removesuffix(">")).int
    if number >> 64 & 1:
        return None
    low = number & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def record(key: int | None, serial: int, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key, serial)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or for few samples their plain bytes."""
    usual = record(0, 0, "https://www.example.com/", b"", 0, "0" * 40, None)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (usual + b"".join(s[:2048] for s in samples))[-DICTIONARY_BYTES:]


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its headers alone."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
            last = False
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise ValueError("a frame is cut short")
                last = bool(head & 1)
                end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            end += 4 * (flags >> 2 & 1)
    except struct.error as e:
        raise ValueError("a frame is cut short") from e
    if end > len(data):
        raise ValueError("a frame is cut short")
    return end


def frames(data: memoryview) -> Iterator[bytes]:
    """The decoded content of each data frame of an archive."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        (magic,) = struct.unpack_from("<I", data, at)
        if at == 0 and magic == DICTIONARY:
            content = bytes(data[8:end])
            if content[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
                content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 28)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME:
            size = zstandard.frame_content_size(data[at:end])
            yield reader.decompress(data[at:end], max_output_size=0 if size >= 0 else 1 << 31)
        at = end


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"no {', '.join(sorted(missing))}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't match the record")
    return fields, rest[:-4]


def maybe_in(rows: DataFrame, keys: DataFrame, cells: int = CELLS) -> DataFrame:
    """``rows`` with a column maybe: false where ``key`` is surely none of ``keys``.

    Keys are hashed to the bits of a bitmap that is broadcast: ``cells`` bits at most, however many keys there are. The
    more bits are set, the more rows are true by chance.
    """
    cell = F.pmod(F.xxhash64("key"), F.lit(cells)) + 1
    at = {"bucket": F.bitmap_bucket_number(cell), "bit": F.bitmap_bit_position(cell)}
    bits = keys.where("key is not null").select("key").withColumns(at).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1
    own = rows.withColumns({k: F.when(F.col("key").isNotNull(), v) for k, v in at.items()})
    return own.join(F.broadcast(bits), "bucket", "left").withColumn("maybe", F.coalesce(found, F.lit(False))).drop("bucket", "bit", "bits")


def write(
    df: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """One record for each row, in archives under ``folder``. The files keep the names that Spark's text sink gives them, so nothing is renamed one by one."""
    spark = df.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    # a hash picks about 4 * SAMPLES rows of all; taking the first of all rows would send as many from each partition to the driver
    share = min(1.0, 4 * SAMPLES / max(df.count(), 1))
    picked = rows.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(1 << 50)) < int(share * (1 << 50))))
    sampled = picked.where(F.octet_length("body").between(1, SAMPLE_BYTES)).orderBy(F.xxhash64("key")).limit(SAMPLES).select("body").collect()
    words = spark.sparkContext.broadcast(dictionary([bytes(r["body"]) for r in sampled]))
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    ids = rows.where(f"size >= {least} and key is not null").select("key", "digest", "size")
    twice = ids.groupBy("digest", "size").agg(F.max("key").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = ids.join(twice, ["digest", "size"]).where("key < refers_to").distinct().withColumnRenamed("key", "own").withColumnRenamed("digest", "whole")

    def frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _writer(words.value)
        for batch in batches:
            for lo, hi, buf, at in flat.windows(batch.column(2)):
                others = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, 3, 4, 5)]
                made = [
                    writer.compress(record(name, serial, target, buf[a:b].tobytes(), size, digest, None)) for a,
                    b,
                    name,
                    target,
                    size,
                    digest,
                    serial in zip(at[:-1].tolist(), at[1:].tolist(), *(o.to_pylist() for o in others), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*others, pa.array(made, pa.binary())], ["key", "url", "size", "digest", "serial", "frame"])

    # only what the filter of revisits' keys can't rule out moves
    marked = maybe_in(rows.withColumn("serial", F.monotonically_increasing_id()), again.select(F.col("own").alias("key")))
    marked = marked.select("key", "url", "body", "size", "digest", "serial", "maybe")
    schema = "key long, url string, size long, digest string, serial long, frame binary"
    framed = lambda some: some.drop("maybe").mapInArrow(frames_of, schema)
    alone = framed(marked.where("not maybe")).select("key", "url", "size", "digest", F.lit(None).cast("long").alias("refers_to"), "frame")
    met = framed(marked.where("maybe")).withColumnsRenamed({"key": "own", "digest": "whole"}).join(again, ["own", "whole", "size"], "left")
    frame = F.when(F.col("refers_to").isNull(), F.col("frame")).alias("frame")
    made = alone.union(met.select(F.col("own").alias("key"), "url", "size", F.col("whole").alias("digest"), "refers_to", frame))

    def archives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _writer(words.value)
        first = struct.pack("<II", DICTIONARY, len(words.value)) + words.value
        out, held = [first], len(first)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for (key, url, size, digest, refers_to), frame in zip(
                    zip(*(part.column(k).to_pylist() for k in range(5)), strict=True),
                    part.column(5),
                    strict=True
                ):
                    frame = frame.as_py() if refers_to is None else writer.compress(record(key, 0, url, b"", size, digest, refers_to))
                    if len(out) > 1 and held + len(frame) > archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])
                        out, held = [first], len(first)
                    out.append(frame)
                    held += len(frame)
        if len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    archives = made.mapInArrow(archives_of, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.options(lineSep=SEPARATOR.decode("ascii"), maxRecordsPerFile=1).text(folder)


def _writer(words: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """key, url, record_type, payload_bytes, payload_digest, refers_to and (unless not asked for) payload of each record."""
    names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads

    def one(content: bytes) -> tuple:
        fields, block = parsed(content)
        head, gap, body = block.partition(b"\r\n\r\n")
        kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if not gap or size is None or kind not in ("response", "revisit"):
            raise ValueError("neither a response nor a revisit")
        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError("the payload doesn't match its length or digest")
        if kind == "revisit" and (body or "warc-refers-to" not in fields):
            raise ValueError("a revisit without reference or with a payload")
        refers_to = key_of(fields["warc-refers-to"]) if kind == "revisit" else None
        return key_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, digest, refers_to, body

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                try:
                    for content in frames(memoryview(blob.as_buffer())):
                        rows.append(one(content))
                        held += len(content)
                        if held > flat.WINDOW or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)
                            rows, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    schema = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, schema)


def oracle(least: int = 1000) -> str:
    """What the archives give back for ``pages``, in DuckDB's SQL."""
    return f"""
    WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT *, n >= {least} AND page_id < max(page_id) OVER (PARTITION BY h, n) AS again, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
    SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM m"""
