"""WARC archives with revisit records for repeated payloads.

Headers (digest and id, no payload) are pre-aggregated by payload digest, which names the
original response of each group; records join their original by digest. Tasks put records with
fresh headers into archives: a warcinfo record, then the others, each a gzip member of its own, so
readers can seek to any of them. Archives hold FILE_BYTES at most, or one longer record, and go
through Spark's own text writer, so any file system that Spark knows will do; what the writer
puts behind each is an empty gzip member. Archives are read back member by member in tasks, once:
the sizes and digests of what was read are kept, and revisits join the response they refer to."""

import gzip
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import written

FILE_BYTES = 16 << 20
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MIN_REVISIT_BYTES = 100
END = "\r\n\r\n"
#: Bytes given to a member's reader at once; what it leaves of them is copied.
READ_BYTES = 16 << 10


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    Payloads of at least min_bytes bytes that are equal have one response, the smallest
    page_id; rows that repeat that id are responses too. Null payloads count as empty, null ids
    are responses that nothing refers to (unless the whole group has no id)."""
    base = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2(F.encode("payload", "UTF-8"), 256).alias("payload_digest"))
    originals = base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # only digests that repeat travel to the join; as a table of its own, so that a hot digest can be split there
    joined = base.join(written(originals.where("_n > 1").drop("_n"), "originals"), "payload_digest", "left")
    refers = F.when(F.col("page_id") > F.col("_first"), F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _header(c: str) -> Column:
    """A header value cannot hold line ends."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def _archives(file_bytes: int, date: str):
    """Archives of a task: rows of head and body -> the bytes of a file."""
    fields = b"software: palisade\r\nformat: WARC File Format 1.1\r\n"

    def run(batches):
        from pyspark import TaskContext

        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def info():
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{part}-{number}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}"
            return _member(head.encode() + fields + END.encode())

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info(), *members])], pa.binary())], ["data"])

        for batch in batches:
            for head, body in zip(batch.column("head"), batch.column("body"), strict=True):
                data = head.as_py().encode() + body.as_py().encode() + END.encode()
                if members and size + len(data) > file_bytes:
                    yield archive()
                    number, members, size = number + 1, [], 0
                members.append(_member(data))
                size += len(data)
        if members:
            yield archive()

    return run


def write_archives(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write records() as WARC files under path, of at most file_bytes bytes before compression or one
    longer record. date: fresh WARC-Date of every record. Record ids are those of the
    pages: rows that repeat a page_id repeat it too."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.when(F.col("page_id").isNull(), F.lit("\r\nWARC-Record-ID: <urn:page:>")).otherwise(line("WARC-Record-ID", _record_id(F.col("page_id")))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _header("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body).cast("string")), F.lit(END),
    )
    files = rows.select(head.alias("head"), body.alias("body")).mapInArrow(_archives(file_bytes, date), "data binary")
    writer = files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


PARSED = "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def parse(data: bytes):
    """(headers, payload) of each record of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = cut + 4
        end = start + int(head["Content-Length"])
        if not lines[0].startswith("WARC/") or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        yield head, data[start:end]
        at = end + 4


def members(data: bytes):
    """The contents of an archive's gzip members, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, out = zlib.decompressobj(31), []
        while not reader.eof:
            piece = view[at : at + READ_BYTES]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            out.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(out)


def _parsed(batches):
    def number(x):
        m = _ID.fullmatch(x or "")
        return int(m[1]) if m else None

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        for content in batch.column("content"):
            out, size = [], 0
            for member in members(content.as_py()):
                for head, payload in parse(member):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    out.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], payload, head["WARC-Payload-Digest"].removeprefix("sha256:"), number(head.get("WARC-Refers-To"))))
                    size += len(payload) + 200
                if size > 4 << 20:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)


def read_archives(spark, path: str) -> DataFrame:
    """The records under path, as they are written: page_id, url, record_type, payload (empty
    for revisits), payload_digest, refers_to."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, PARSED)


def resolve(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes its size
    from the response it refers to, whose digest must agree. The archives are read once."""
    own = read.select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("bigint").alias("_own"), F.sha2("payload", 256).alias("_sha"))
    own = written(own, "warc-read")
    responses = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("_sha").alias("payload_digest")).agg(F.min("_own").alias("_there"))
    joined = own.join(responses, ["refers_to", "payload_digest"], "left")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.when(F.col("_there").isNotNull(), F.col("payload_digest"))).otherwise(F.col("_sha"))
    return joined.select("page_id", F.when(revisit, F.col("_there")).otherwise(F.col("_own")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
