"""WARC archives: revisit records resolved, repeated payloads written once.

1. Headers alone (no payload) are grouped by payload digest; the earliest response of a
   digest (then the least record id) is its original.
2. Each header is joined with its digest's original. A later response with the same
   digest becomes a revisit of it, and a revisit gets fresh WARC-Refers-To headers of it. A
   revisit whose digest no response has stays as it is, marked unresolved.
3. Payloads join their record's verdict by record id, and every task writes one gzip
   archive, a member a record, with fresh headers; the index says where each record is.
   A task writes under a name of its attempt and renames, so one that runs again leaves
   no half file and no second copy.

Rows: a response without digest is written as it is; a revisit without one is unresolved.
A null payload of a response is written as an empty block; null headers are left out.
A record without id gets one from its other headers. Records that share an id are each
written, with the verdict of the earliest and the least of their payloads. Payloads are
strings or binary. Columns of records other than these are no part of an archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
HEADERS = ["record_id", "warc_type", "target_uri", "warc_date", "payload_digest"]
_DASHED = ("(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def _id(*parts):
    return F.regexp_replace(F.md5(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts))), *_DASHED)


def captures(pages: DataFrame) -> DataFrame:
    """Records of two crawls of the pages: a response for each page, and a day later a
    revisit record, as a crawler writes one that finds the payload unchanged."""
    digest = F.when(F.col("html").isNotNull(), F.concat(F.lit("sha1:"), F.sha1(F.col("html"))))

    def date(seconds: int):
        return F.date_format(F.timestamp_seconds(F.lit(1704067200 + seconds) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    first = pages.select(
        _id("page_id", "url", F.lit("response")).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"),
        date(0).alias("warc_date"), digest.alias("payload_digest"), F.col("html").cast("string").alias("payload"),
    )
    again = pages.select(
        _id("page_id", "url", F.lit("revisit")).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"),
        date(86400).alias("warc_date"), digest.alias("payload_digest"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def _named(records: DataFrame) -> DataFrame:
    return records.withColumn("record_id", F.coalesce("record_id", _id("warc_type", "target_uri", "warc_date", "payload_digest")))


def resolve(records: DataFrame) -> DataFrame:
    """(headers, refers_to, refers_to_uri, refers_to_date, resolved) of every record, in
    which a response that repeats an earlier payload is a revisit."""
    headers = _named(records).select(*HEADERS)
    is_response = F.col("warc_type") == "response"
    original = F.min(F.when(is_response, F.struct("warc_date", "record_id", "target_uri")))
    first = headers.filter("payload_digest IS NOT NULL").groupBy("payload_digest").agg(original.alias("o"))
    joined = headers.join(first, "payload_digest", "left")
    own = is_response & (F.col("o").isNull() | (F.col("o.record_id") == F.col("record_id")))
    refers = F.col("warc_type").isin("response", "revisit") & ~F.coalesce(own, F.lit(False)) & F.col("o").isNotNull()
    return joined.select(
        "record_id", F.when(refers, F.lit("revisit")).otherwise(F.col("warc_type")).alias("warc_type"), "target_uri", "warc_date", "payload_digest",
        F.when(refers, F.col("o.record_id")).alias("refers_to"), F.when(refers, F.col("o.target_uri")).alias("refers_to_uri"),
        F.when(refers, F.col("o.warc_date")).alias("refers_to_date"), (refers | ~F.coalesce(F.col("warc_type") == "revisit", F.lit(False))).alias("resolved"),
    )


def record_bytes(row: dict) -> bytes:
    """One record with its headers and block."""
    payload = row["payload"] or b""
    block = b"" if row["warc_type"] == "revisit" else payload.encode() if isinstance(payload, str) else payload
    fields = [
        ("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()),
        ("WARC-Profile", PROFILE if row["warc_type"] == "revisit" else None), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", row["refers_to_uri"]), ("WARC-Refers-To-Date", row["refers_to_date"]),
        ("Content-Type", None if row["warc_type"] == "revisit" else "text/html"), ("Content-Length", str(len(block))),
    ]
    clean = "".join(f"{k}: {v.replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + clean.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_archive(data: bytes) -> list[tuple[dict, bytes]]:
    """Headers and blocks of an archive (or of one member of it)."""
    return list(_records(gzip.GzipFile(fileobj=io.BytesIO(data))))


def _records(f) -> Iterator[tuple[dict, bytes]]:
    """Headers and blocks of a stream of records, one at a time."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no record begins with {line[:20]!r}")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            headers[k] = v.strip()
        yield headers, f.read(int(headers["Content-Length"]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives (.warc, .warc.gz) under a folder, as resolve() and
    write_archives() take them; a task reads an archive as a stream, a record at a time.
    The payload is a record's whole block."""
    path = qualified(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    names = []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith((".warc", ".warc.gz")) and not name.rpartition("/")[2].startswith((".", "_")):
            names.append(name)
    files = spark.createDataFrame([(n,) for n in sorted(names)], "name string").repartition(max(1, len(names)), "name")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                with store.open_input_stream(root, compression=None) as f:
                    raw = gzip.GzipFile(fileobj=f) if name.endswith(".gz") else io.BufferedReader(f)
                    rows, held = [], 0
                    for h, block in _records(raw):
                        rows.append((h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("WARC-Payload-Digest"), None if h.get("WARC-Type") == "revisit" else block))
                        held += len(block)
                        if held > C.SLICE_BYTES:
                            yield _read(rows)
                            rows, held = [], 0
                    if rows:
                        yield _read(rows)

    def _read(rows):
        kinds = [pa.string()] * len(HEADERS) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*HEADERS, "payload"])

    return files.mapInArrow(run, ", ".join(f"{c} string" for c in HEADERS) + ", payload binary")


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: that of Hadoop's default file system, where it names none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes the records, deduplicated, as archives under path; gives the index: what
    resolve() gives, and archive, offset and length of each record."""
    path = qualified(records.sparkSession, path)
    verdict = resolve(records).withColumn("__order", F.struct("warc_date", "target_uri"))
    columns = [c for c in verdict.columns if c != "__order"]
    one = verdict.groupBy("record_id").agg(F.min_by(F.struct(*columns), "__order").alias("v"), F.count("*").cast("int").alias("n"))
    bodies = _named(records).filter("payload IS NOT NULL AND warc_type <> 'revisit'").groupBy("record_id").agg(F.min("payload").alias("payload"))
    joined = one.join(bodies, "record_id", "left").withColumn("nth", F.explode(F.sequence(F.lit(1), "n")))
    rows = joined.select("v.*", "payload")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}.warc.gz"
        part = f"{root}/.{name}.{task.taskAttemptId()}"
        at, index = 0, []
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    member = gzip.compress(record_bytes(row), LEVEL, mtime=0)
                    out.write(member)
                    index.append((*(row[c] for c in columns), name, at, len(member)))
                    at += len(member)
                if index:
                    yield _table(index)
                    index = []
        if at:
            store.move(part, f"{root}/{name}")
        else:
            store.delete_file(part)

    kinds = {"resolved": pa.bool_(), "offset": pa.int64(), "length": pa.int64()}
    names = [*columns, "archive", "offset", "length"]

    def _table(index):
        return pa.RecordBatch.from_arrays([pa.array(list(v), kinds.get(c, pa.string())) for c, v in zip(names, zip(*index))], names=names)

    ddl = ", ".join(f"{c} {'boolean' if c == 'resolved' else 'bigint' if c in kinds else 'string'}" for c in names)
    index, _path = C.written(rows.mapInArrow(run, ddl), "cdx")
    return index


def archives_of(spark: SparkSession, records: DataFrame) -> tuple[DataFrame, str]:
    path = C.new_path(spark, "warc")
    return write_archives(records, path), path


def op3_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """All captures of all pages, resolved and written; where each lies is left out."""
    index, _path = archives_of(spark, captures(C.read(spark, sf_dir, "pages")))
    return index.drop("archive", "offset", "length")


OP3_SQL = r"""
WITH captures AS (
  SELECT p.page_id, p.url, kind AS warc_type,
         strftime(make_timestamp((1704067200 + CASE kind WHEN 'revisit' THEN 86400 ELSE 0 END + coalesce(p.page_id, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
         'sha1:' || sha1(p.html) AS payload_digest,
         '<urn:uuid:' || regexp_replace(md5(coalesce(CAST(p.page_id AS VARCHAR), '') || '|' || coalesce(p.url, '') || '|' || kind), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') || '>' AS record_id
  FROM pages p CROSS JOIN (VALUES ('response'), ('revisit')) AS k(kind)
), originals AS (
  SELECT * FROM (
    SELECT payload_digest, record_id AS o_id, url AS o_uri, warc_date AS o_date,
           row_number() OVER (PARTITION BY payload_digest ORDER BY warc_date, record_id) AS nth
    FROM captures WHERE warc_type = 'response' AND payload_digest IS NOT NULL) x WHERE nth = 1
), joined AS (
  SELECT c.*, o.o_id, o.o_uri, o.o_date, o.o_id IS NOT NULL AND NOT (c.warc_type = 'response' AND o.o_id = c.record_id) AS refers
  FROM captures c LEFT JOIN originals o USING (payload_digest)
)
SELECT record_id, CASE WHEN refers THEN 'revisit' ELSE warc_type END AS warc_type, url AS target_uri, warc_date, payload_digest,
       CASE WHEN refers THEN o_id END AS refers_to, CASE WHEN refers THEN o_uri END AS refers_to_uri,
       CASE WHEN refers THEN o_date END AS refers_to_date, refers OR warc_type <> 'revisit' AS resolved
FROM joined
"""
