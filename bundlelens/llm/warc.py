"""Operator 3: WARC archives, written by Spark and read by a Python data source.

Writing. A record is built as one string by native functions and the archive is written by
Spark's text writer (commit protocol, retries and any Hadoop file system included) with the
record separator of WARC. A file takes maxRecordsPerFile records at most, and files are what the
reader plans by. Among records of equal payloads of at least `min_bytes` bytes the one with the
largest key is a response, the others are revisits of it (without payload); smaller ones are all responses.

Reading. spark.read.format("warc"): partitions are groups of files; predicates on record_type,
record_id, target_uri, date and payload_digest are pushed to the reader, which parses a record's headers first and skips the
block of a record that they exclude; if the schema asked for has no payload, every block is skipped.

Semantics. A null payload is the empty one. A null URL is left out; CR, LF and blanks in a URL
are percent-encoded. A row with a null key is a revisit if its payload has a response with a
key, else a response without one. Repeated rows of one key and payload are responses each. An
empty table gives an archive without records. Columns other than those named are not read.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from bundlelens.llm.common import cut, open_fs, shared_dir

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, content_length long, headers map<string,string>, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), key.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column `record`: each row's WARC record without the separator behind it."""
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    p = pages.select(pages[key].cast("long").alias("key"), pages[url].cast("string").alias("url"), body.alias("body"))
    p = p.withColumns({"digest": base32_sha1(F.col("body")), "bytes": F.octet_length("body")})
    # written first: with its size known, the pages are shuffled only if the table of copies is large
    copies = cut(p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "copies")
    p = p.join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")) & (F.col("bytes") >= min_bytes)
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("body").cast("string")))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")

    def line(name: str, value: Column) -> Column:  # nothing for null
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    p = p.withColumns({"revisit": revisit, "block": block})
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(record_id(F.col("key")), record_id(F.concat_ws(" ", "digest", "url")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first"))), line("X-Refers-To-Key", F.col("first")))).otherwise(""),
        line("X-Record-Key", F.col("key")),
        line("X-Payload-Length", F.col("bytes")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, F.col("block")).alias("record"))


def write_warc(pages: DataFrame, folder: str, key: str, url: str, payload: str, min_bytes: int = 0, per_file: int = 20_000, compression: str = "none") -> None:
    out = records(pages, key, url, payload, min_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file)
    out.option("compression", compression).text(folder)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcSource(DataSource):
    """Options: path (a folder or file), paths (a JSON list), group_bytes (of files a partition; 128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names, self.tests = options, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what the headers decide, hands the rest back to Spark."""
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "there", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.tests.append((FIELDS[f.attribute[0]], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            x = headers.get(name)
            if x is None:
                return False
            if not {"eq": lambda: x == value, "in": lambda: x in value, "there": lambda: True, "starts": lambda: x.startswith(value), "ends": lambda: x.endswith(value), "has": lambda: value in x}[kind]():
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        group, found = int(self.options.get("group_bytes", 128 << 20)), []
        for path in json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]:
            system, p = open_fs(path)
            info = system.get_file_info(p)
            if info.type == fs.FileType.Directory:
                found += [(f"{path.rstrip('/')}/{i.base_name}", i.size) for i in system.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.File and i.base_name[0] not in "_."]
            else:
                found.append((path, info.size))
        parts, size = [], 0
        for path, n in sorted(found):
            if not parts or size + n > group:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        types = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "content_length": pa.int64()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in self.names])
        rows, size = [], 0
        for path in partition.value:
            for headers, payload in read_warc(path, self.wanted, "payload" in self.names):
                row = {n: headers.get(FIELDS[n]) for n in self.names if n in FIELDS}
                row |= {"headers": list(headers.items()), "payload": payload, "content_length": int(headers["content-length"])}
                rows.append({n: row.get(n) for n in self.names})
                size += len(payload or b"") + 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(path: str, wanted=lambda headers: True, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers in lower case, payload) of each wanted record. The payload is what follows the
    HTTP headers of a block that is an HTTP message, else the block; null if it isn't asked for."""
    system, p = open_fs(path)
    with system.open_input_file(p) as raw:
        zipped = path.endswith(".gz")
        f = gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw, 1 << 20)
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record where one is due: {line[:60]!r}")
            headers: dict[str, str] = {}
            name = ""
            while (line := f.readline()).strip():
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[0] in " \t" and name:  # folded
                    headers[name] += " " + text.strip()
                    continue
                name, _, value = text.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
            n = int(headers["content-length"])
            take = wanted(headers)
            if not take or not payloads:
                end = f.tell() + n
                f.seek(end)  # a plain file can be sought beyond its end, a zipped one stops there
                if f.tell() < end or not zipped and end > raw.size():
                    raise ValueError(f"{path}: a record ends early")
                if take:
                    yield headers, None
                continue
            block = f.read(n)
            if len(block) < n:
                raise ValueError(f"{path}: a record ends early")
            if headers.get("content-type", "").startswith("application/http") and block:
                head, gap, body = block.partition(b"\r\n\r\n")
                block = body if gap else b""
            yield headers, block


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).option("path", path).load()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, "page_id", "url", "html")
    r = read(spark, folder)
    response = F.col("record_type") == "response"
    return r.select(
        F.col("headers")["x-record-key"].cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("headers")["x-payload-length"].cast("int")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.expr("substring(payload_digest, 6)")).alias("payload_digest"),
        "record_type",
        F.col("headers")["x-refers-to-key"].cast("long").alias("refers_to"),
    )


_DIGITS = " || ".join(f"to_base(('0x' || substr(sha1(h), {1 + 5 * k}, 5))::BIGINT, 32, 4)" for k in range(8))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
             translate(upper({_DIGITS}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM m
"""
