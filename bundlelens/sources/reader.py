"""A Spark data source of the members of archives: filters on the path and on `is_binary` are pushed into it.

Partitions are archives, or pieces of large zips (byte ranges that hold the starts of their members), planned from
the listing alone. A member that the filters exclude is not inflated; of one that is only known by its first bytes no more
than these are. Rows are those of `bundles.expand` without checksums; rows of bad archives (`error`)
have an empty path, so a filter on the path leaves them out like any other row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from bundlelens.sources.bundles import MEMBER, PIECE, SUFFIX, Wanted, bundle_of, in_batches, rows_of_archive

KINDS = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "support_bundles"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(dict(self.options))


class Piece(InputPartition):
    def __init__(self, uri: str, k: int, n: int):
        self.uri, self.k, self.n = uri, k, n


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests, self.bundles, self.binary = options, [], [], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of the path, of is_binary and of the bundle; all are given back too, as rows of
        nested archives and folders are left to Spark."""
        for f in filters:
            column, kind = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, KINDS.get(type(f))
            if column == "path" and kind:
                self.tests.append((kind, f.value))
            elif column == "is_binary" and kind == "eq":
                self.binary = f.value
            elif column == "bundle_id" and kind:
                self.bundles.append((kind, f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        piece, top = int(self.options.get("piece_bytes", PIECE)), self.options["path"]
        system, path = fs.FileSystem.from_uri(top) if ":" in top else (fs.LocalFileSystem(), top)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File]
        out, scheme = [], top[: len(top) - len(path)] if top.endswith(path) else ""
        for i in sorted(found, key=lambda i: i.path):
            if SUFFIX.search(i.path) and i.base_name[0] not in "_." and Wanted(tuple(self.bundles)).path(bundle_of(scheme + i.path)):
                n = max(1, -(-i.size // piece)) if i.path.lower().endswith(".zip") else 1
                out += [Piece(scheme + i.path, k, n) for k in range(n)]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        schema = pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("extension", pa.string()), ("is_binary", pa.bool_()), ("part", pa.int32()), ("first_line", pa.int64()), ("content", pa.string()), ("status", pa.string()), ("reason", pa.string())])
        wanted = Wanted(tuple(self.tests), self.binary)
        for rows in in_batches(rows_of_archive(partition.uri, bundle_of(partition.uri), partition.k, partition.n, wanted)):
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_members(spark: SparkSession, folder: str, piece: int = PIECE) -> DataFrame:
    """The members of the archives below a folder; filters on the result reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemberSource)
    return spark.read.format("support_bundles").option("path", folder).option("piece_bytes", str(piece)).load()
