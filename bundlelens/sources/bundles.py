"""Support bundles as tables: archives are opened in the workers, one task an archive, several for a large zip.

expand() gives a row for each member (directories, symlinks and files, text in batches of lines) and the
archive's checksum, from one pass over its bytes; `sources.reader` reads chosen members only. resources() gives a row for
each item of a YAML list. A bad archive, member or document is a row of its own with an error, never a failed job.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import posixpath
import re
import shutil
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import count
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.functions.text import archive_type

#: Limits of one archive.
MAX_ENTRIES, MAX_BYTES, MAX_DEPTH, PEEK = 20_000, 2 << 30, 3, 4096
#: A nested archive of more bytes waits in a file of its task.
SPOOLED = 16 << 20
SUFFIX = re.compile(r"\.(zip|tar|tgz|tar\.gz|txz|tar\.xz|tbz2?|tar\.bz2|tzst|tar\.zst)$", re.I)
MEMBER = "bundle_id string, path string, type string, size long, mtime timestamp, extension string, is_binary boolean, part int, first_line long, content string, status string, reason string"
COLUMNS = [c.split()[0] for c in MEMBER.split(", ")]
PART = 1 << 20


#: Bytes of a zip that one task reads.
PIECE = 256 << 20


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """bundle_id, name, uri, file_size, mtime, kind of the archives below a folder; no content is read. The id
    is the file's name and a hash of its whole path, so that archives of one name stay apart."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), SUFFIX.pattern.replace(r"\.(", r"(?i)\.(", 1), "").alias("name")
    f = f.select(name, F.col("path").alias("uri"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), archive_type(F.col("path")).alias("kind")).where("kind is not null")
    return f.select(F.concat("name", F.lit("-"), F.substring(F.sha1(F.regexp_replace("uri", "^file:/+", "/").cast("binary")), 1, 12)).alias("bundle_id"), *f.columns)


def bundle_of(uri: str) -> str:
    """The bundle_id that archives() gives a file."""
    return SUFFIX.sub("", uri.rsplit("/", 1)[-1]) + "-" + hashlib.sha1(re.sub("^file:/+", "/", uri).encode()).hexdigest()[:12]


class Hashed(io.RawIOBase):
    """A file that hashes its bytes as they are first read in order; finish() reads what was left out."""

    def __init__(self, raw):
        self.raw, self.sum, self.done = raw, hashlib.sha256(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.raw.seek(offset, whence)
        return self.raw.tell()

    def tell(self) -> int:
        return self.raw.tell()

    def readinto(self, buffer) -> int:
        at, data = self.raw.tell(), self.raw.read(len(buffer))
        if at <= self.done < at + len(data):
            self.sum.update(data[self.done - at :])
            self.done = at + len(data)
        buffer[: len(data)] = data
        return len(data)

    def finish(self) -> tuple[int, str]:
        """The number of bytes and their SHA-256."""
        self.seek(self.done)
        while self.read(PART):
            pass
        return self.done, self.sum.hexdigest()


def unsafe(path: str) -> bool:
    p = path.replace("\\", "/")
    return not p or "\0" in p or p.startswith("/") or bool(re.match(r"[A-Za-z]:", p)) or ".." in p.split("/")


def binary(head: bytes) -> bool:
    """A NUL, or control bytes for over 8 of 100, in the first 4096."""
    odd = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
    return b"\0" in head or odd > 0.08 * len(head)


def _open(data: io.IOBase, name: str, piece: tuple[int, int] | None = None):
    """(path, kind, size, mtime, opener) of each member, in archive order. Of a zip read in pieces, the
    opener is None for members that start outside of the bytes of this piece."""
    low = name.lower()
    if low.endswith(".zip"):
        z = zipfile.ZipFile(data)
        for i in z.infolist():
            if piece and not piece[0] <= i.header_offset < piece[1]:
                yield i.filename, "directory" if i.is_dir() else "elsewhere", i.file_size, None, None
                continue
            link = (i.external_attr >> 16) & 0o170000 == 0o120000
            kind = "directory" if i.is_dir() else "symlink" if link else "file"
            yield i.filename, kind, i.file_size, datetime(*i.date_time, tzinfo=UTC), lambda i=i: z.open(i)
        return
    if low.endswith(("gz", ".tgz")):
        data = gzip.GzipFile(fileobj=data)
    elif low.endswith(("xz",)):
        data = lzma.LZMAFile(data)
    elif low.endswith(("bz2", ".tbz")):
        data = bz2.BZ2File(data)
    elif low.endswith(("zst",)):
        import pyarrow as pa

        data = pa.CompressedInputStream(pa.PythonFile(data, mode="r"), "zstd")
    with tarfile.open(fileobj=data, mode="r|") as t:
        for m in t:
            kind = "directory" if m.isdir() else "symlink" if m.issym() or m.islnk() else "file" if m.isfile() else "other"
            yield m.name, kind, m.size, datetime.fromtimestamp(m.mtime, UTC), lambda m=m: t.extractfile(m)


class Wanted:
    """Which members are read: tests (kind, value) of their paths, and whether they are binary."""

    def __init__(self, tests: tuple[tuple[str, object], ...] = (), binary: bool | None = None):
        self.tests, self.binary = tests, binary

    def path(self, path: str) -> bool:
        holds = {"eq": lambda v: path == v, "in": lambda v: path in v, "starts": lambda v: path.startswith(v), "ends": lambda v: path.endswith(v), "has": lambda v: v in path}
        return all(holds[kind](value) for kind, value in self.tests)

    def below(self, folder: str) -> bool:
        """Whether members of a nested archive, which go to this folder or one named after it, can be wanted."""
        near = lambda v: v.startswith(folder) or folder.startswith(v)
        holds = {"eq": near, "in": lambda v: any(map(near, v)), "starts": near}
        return all(holds[kind](value) for kind, value in self.tests if kind in holds)


class Expansion:
    """The rows of one archive, nested archives included, within its budget of bytes and entries."""

    def __init__(self, bundle: str, wanted: Wanted | None = None, piece: tuple[int, int] | None = None):
        self.bundle, self.left, self.entries, self.taken = bundle, MAX_BYTES, 0, set()
        self.wanted, self.piece = wanted or Wanted(), piece

    def row(self, path: str, kind: str, **more) -> dict:
        return dict.fromkeys(COLUMNS) | {"bundle_id": self.bundle, "path": path, "type": kind} | more

    def target(self, path: str) -> str:
        """Where a nested archive's members go: its path without the suffix, or .contents, .contents-2, ..."""
        base = SUFFIX.sub("", path)
        names = [base, f"{base}.contents", *(f"{base}.contents-{k}" for k in range(2, 1000))]
        return next(n for n in names if n not in self.taken)

    def walk(self, data, name: str, prefix: str = "", depth: int = 0) -> Iterator[dict]:
        nested = []
        for path, kind, size, mtime, opened in _open(data, name, None if depth else self.piece):
            self.entries += 1
            if self.entries > MAX_ENTRIES:
                raise ValueError("too many entries")
            clean = path.replace("\\", "/")
            if unsafe(clean):
                raise ValueError(f"unsafe entry: {path!r}")
            full = posixpath.normpath(posixpath.join(prefix, clean))
            if full == ".":
                continue
            parts = full.split("/")
            self.taken.update("/".join(parts[:k]) for k in range(1, len(parts) + 1))
            self.left -= 0 if kind in ("directory", "symlink", "other") else size
            if self.left < 0:
                raise ValueError("extracted bytes over the quota")
            if opened is None:
                continue
            if kind != "file":
                yield self.row(full, kind, size=0, mtime=mtime)
                continue
            inside = SUFFIX.search(full) and self.wanted.below(SUFFIX.sub("", full))
            if not inside and not self.wanted.path(full):
                continue  # not inflated
            extension = posixpath.splitext(full)[1].lower()
            f = opened()
            if SUFFIX.search(full):
                inner = tempfile.SpooledTemporaryFile(SPOOLED)  # read by this task only, gone with it
                shutil.copyfileobj(f, inner, PART)
                nested.append((full, inner))
                yield self.row(full, kind, size=size, mtime=mtime, extension=extension, is_binary=True, part=0, first_line=1)
                continue
            yield from self.text(f, full, size=size, mtime=mtime, extension=extension)
        for full, inner in nested:
            if depth + 1 > MAX_DEPTH:
                yield self.row(full, "nested", status="skipped", reason="depth")
                continue
            before, left, at = self.entries, self.left, self.target(full)
            self.taken.add(at)
            try:
                self.check(inner, full)
            except Exception as e:
                self.entries, self.left = before, left
                known = isinstance(e, ValueError) and not isinstance(e, UnicodeError)
                reason = "quota-exceeded" if "quota" in str(e) else "budget-exhausted" if "entries" in str(e) else str(e) if known else "list-failed"
                yield self.row(full, "nested", status="skipped", reason=reason)
                continue
            self.entries, self.left = before, left
            inner.seek(0)
            yield from self.walk(inner, full, at, depth + 1)
            yield self.row(full, "nested", status="expanded", reason=str(self.entries - before))
            inner.close()

    def check(self, data, name: str) -> None:
        """Read an archive through without keeping anything of it; a bad one raises."""
        data.seek(0)
        for path, kind, size, _, opened in _open(data, name):
            self.entries += 1
            self.left -= size
            if self.entries > MAX_ENTRIES:
                raise ValueError("too many entries")
            if self.left < 0:
                raise ValueError("extracted bytes over the quota")
            if unsafe(path):
                raise ValueError(f"unsafe entry: {path!r}")
            if kind == "file":
                f = opened()
                while f.read(PART):
                    pass

    def text(self, f, path: str, **more) -> Iterator[dict]:
        """A member's text in parts of whole lines, about a megabyte each."""
        head, part, line = f.read(PEEK), 0, 1
        if binary(head):
            if self.wanted.binary is not False:
                yield self.row(path, "file", is_binary=True, part=0, first_line=1, **more)
            return
        if self.wanted.binary:
            return  # no more of it is inflated
        head += f.read(PART - len(head))
        while True:
            rest = f.read(PART)
            cut = len(head) if not rest else head.rfind(b"\n") + 1
            if cut or not rest:
                text = head[:cut].decode("utf-8", "replace")
                yield self.row(path, "file", is_binary=False, part=part, first_line=line, content=text, **more)
                part, line = part + 1, line + text.count("\n")
            if not rest:
                return
            head = head[cut:] + rest


def rows_of_archive(uri: str, bundle: str, piece: int = 0, pieces: int = 1, wanted: Wanted | None = None) -> Iterator[dict]:
    """The members of an archive, or of one of a zip's pieces; at the end a `checksum` row (SHA-256 in `reason`, bytes
    in `size`) of the bytes that were read on the way, and an `error` row for a bad one. Of several pieces the
    one behind the last only takes the checksum."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    with system.open_input_file(path) as raw:
        size, data = raw.size(), Hashed(raw)
        bounds = (piece * size // pieces, size if piece == pieces - 1 else (piece + 1) * size // pieces) if pieces > 1 else None
        e = Expansion(bundle, wanted, bounds)
        if piece < pieces:
            try:
                yield from e.walk(data if uri.lower().endswith(".zip") else io.BufferedReader(data, PART), uri)
            except Exception as x:
                yield e.row("", "error", status="rejected", reason=str(x)[:500])
        if wanted is None and (pieces == 1 or piece == pieces):
            n, digest = data.finish()
            yield e.row("", "checksum", size=n, reason=digest)


def in_batches(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Rows in lists of about eight megabytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r["content"] or "") + 200
        if size > 8 << 20:
            yield out
            out, size = [], 0
    if out:
        yield out


def expand(found: DataFrame, piece: int = PIECE) -> DataFrame:
    """Members of archives(bundle_id, uri, file_size), with their checksums and errors, as rows_of_archive() has
    them. One archive a task, each byte read once; a zip of more than `piece` bytes is read by several tasks, each with
    the members that start in its bytes, and by one more for its checksum. Nothing of an archive is held whole but nested
    archives, and those of a piece share the budget that its own members leave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bundle, uri, k, n in b[["bundle_id", "uri", "k", "n"]].itertuples(index=False):
                for rows in in_batches(rows_of_archive(uri, bundle, k, n)):
                    yield pd.DataFrame(rows, columns=COLUMNS)

    size = F.col("file_size") if "file_size" in found.columns else F.lit(0)
    n = F.when(F.lower("uri").endswith(".zip"), F.greatest(F.ceil(size / piece), F.lit(1))).otherwise(1).cast("int")
    tasks = found.select("bundle_id", "uri", n.alias("n"))
    tasks = tasks.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1, F.col("n")).otherwise(0))).alias("k"))
    count = max(1, min(tasks.count(), 10_000))
    return tasks.repartitionByRange(count, "uri", "k").mapInPandas(run, MEMBER)


def rejected(members: DataFrame) -> DataFrame:
    return members.where("type = 'error'").select("bundle_id", "reason")


def expansions(members: DataFrame) -> DataFrame:
    return members.where("type = 'nested'").select("bundle_id", "path", "status", "reason")


def bundle_files(members: DataFrame, hidden: str = ".bundle-metadata/") -> DataFrame:
    """The file index: one row a path, parent directories that the archive doesn't list included;
    none for a rejected bundle."""
    bad = rejected(members).select("bundle_id").distinct()
    m = members.where("type in ('file', 'directory', 'symlink')").join(bad, "bundle_id", "left_anti")
    own = m.where("coalesce(part, 0) = 0").select("bundle_id", "path", "type", "size", "mtime", "extension", F.coalesce("is_binary", F.lit(False)).alias("is_binary"))
    parts = F.split("path", "/")
    above = own.select("bundle_id", parts.alias("p")).where("size(p) > 1").select("bundle_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("path")).distinct()
    more = above.join(own.select("bundle_id", "path"), ["bundle_id", "path"], "left_anti").select("bundle_id", "path", F.lit("directory").alias("type"), F.lit(0).cast("long").alias("size"))
    return own.unionByName(more, allowMissingColumns=True).where(~F.startswith("path", F.lit(hidden)))


def text_files(members: DataFrame) -> DataFrame:
    """Text members by parts; none of a rejected bundle, whose archive was read in part only."""
    bad = members.where("type = 'error'").select("bundle_id").distinct()
    return members.where("type = 'file' and not is_binary").select("bundle_id", "path", "part", "first_line", "content").join(bad, "bundle_id", "left_anti")


def whole_files(texts: DataFrame) -> DataFrame:
    """bundle_id, path, content: the parts of each file joined again, for formats that can't be cut
    by lines; a file is bounded by the archive's budget."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"])
    return texts.groupBy("bundle_id", "path").agg(F.array_join(parts, "").alias("content"))


def log_lines(members: DataFrame) -> DataFrame:
    """bundle_id, path, line_no, line; numbered before blank lines go."""
    t = text_files(members)
    e = t.select("bundle_id", "path", "first_line", F.posexplode(F.split("content", "\r?\n")).alias("k", "line"))
    return e.select("bundle_id", "path", (F.col("first_line") + F.col("k")).alias("line_no"), "line").where(F.trim("line") != "")


def key_values(members: DataFrame, suffix: str = "metadata.yaml") -> DataFrame:
    """bundle_id, metadata (map) of the top-level `key: value` lines of the first such file; of a repeated key the last."""
    t = text_files(members).where(F.col("path").endswith(suffix))
    first = t.join(t.groupBy("bundle_id").agg(F.min("path").alias("path")), ["bundle_id", "path"])
    line = first.select("bundle_id", "part", F.posexplode(F.split("content", "\r?\n")).alias("k", "line")).where(F.col("line").rlike(r"^[A-Za-z][\w.-]*:\s*\S"))
    value = F.regexp_replace(F.regexp_extract("line", r"^[^:]+:\s*(.*?)\s*$", 1), "^['\"](.*)['\"]$", "$1")
    kv = line.select("bundle_id", F.struct("part", "k").alias("at"), F.lower(F.regexp_extract("line", r"^([^:]+):", 1)).alias("k"), value.alias("v")).where("v <> 'null'").groupBy("bundle_id", "k").agg(F.max_by("v", "at").alias("v"))
    return kv.groupBy("bundle_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))


ALERTS = "array<struct<Labels:map<string,string>,Annotations:map<string,string>,State:string>>"


def alerts(members: DataFrame, suffix: str = "prometheus-alerts.json") -> DataFrame:
    """bundle_id, path, seq, labels, annotations, state; valid false (and no alert) for a file that isn't JSON."""
    t = whole_files(text_files(members).where(F.col("path").endswith(suffix)))
    ok = F.try_parse_json("content").isNotNull()
    t = t.select("bundle_id", "path", ok.alias("valid"), F.when(ok & F.trim("content").startswith("["), F.from_json("content", ALERTS)).alias("a"))
    e = t.select("bundle_id", "path", "valid", F.posexplode_outer("a").alias("seq", "x")).where("x is not null or not valid")
    return e.select("bundle_id", "path", "valid", "seq", F.col("x.Labels").alias("labels"), F.col("x.Annotations").alias("annotations"), F.col("x.State").alias("state"))


CONDITION = "struct<type:string,status:string,reason:string,message:string>"
RESOURCE = f"bundle_id string, path string, item_no int, api_version string, kind string, namespace string, name string, text string, metadata string, spec string, status string, value string, conditions array<{CONDITION}>, error string"
RESOURCE_COLUMNS = ["bundle_id", "path", "item_no", "api_version", "kind", "namespace", "name", "text", "metadata", "spec", "status", "value", "conditions", "error"]


#: The first item of a list file, behind `items:` or at the start; group 1 or 2 is the list's indentation.
FIRST_ITEM = r"(?m)(?:^items:[ \t]*\r?\n(?:[ \t]*(?:#[^\n]*)?\r?\n)*( *)- |\A(?:(?:---)?[ \t]*(?:#[^\n]*)?\r?\n)*( *)- )"


def _marks(content: str, indent: int) -> Iterator[tuple[int, bool | None]]:
    """(place, None) of each line that opens an item of the list if one is open, and (place, whether a list follows)
    of each line that ends the list."""
    closing = r"[^\s#-]" if indent == 0 else rf" {{0,{indent - 1}}}[^\s#]"
    for m in re.finditer(rf"(?m)^(?:({' ' * indent}- )|({closing}|---|\.\.\.)[^\n]*)", content):
        if m[1]:
            yield m.start(), None
        elif m[0].startswith(("---", "...")):
            yield m.start(), bool(re.compile(rf"\n(?:[ \t]*(?:#[^\n]*)?\r?\n)*{' ' * indent}- ").match(content, m.end()))
        else:
            yield m.start(), bool(re.match(r"items:[ \t]*\r?$", m[0]))


def _cut(content: str, indent: int, in_list: bool, base: int, part: int) -> Iterator[tuple[int, int, str]]:
    """(item_no, part, text) of a part's items: runs of whole items with part -1, an item that may go on in
    another part by itself."""
    no, run, start = base - 1, None, 0 if in_list and base else None  # the open item, where a run of items and where the item began
    for place, follows in [*_marks(content, indent), (len(content), False)]:
        if follows is None and not in_list:
            continue
        last = place == len(content)
        if start is not None:
            crosses = last or start == 0 and part > 0 and no < base
            if crosses:
                if run is not None and start > run[1]:
                    yield run[0], -1, content[run[1] : start]
                yield no, part, content[start:place]
                run = None
            elif follows is not None and run is not None:
                yield run[0], -1, content[run[1] : place]
                run = None
        if follows is None:
            no, start = no + 1, place
            run = (no, place) if run is None else run
        else:
            in_list, start = follows, None


def _runs_of_file(content: str) -> list[tuple[int, str, bool]]:
    """(item_no, text, listed) of a file that is one part, as item_runs() has them."""
    m = re.search(FIRST_ITEM, content)
    if not m:
        return [(0, content, False)]
    indent, bare = len(m[1] or m[2] or ""), not re.search(r"(?m)^items:[ \t]*\r?$", content)
    return [(no, text, True) for no, _, text in _cut(content, indent, bare, 0, 0)]


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of batches, few of them as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 16):
            few = b.slice(at, 16)
            yield from zip(*(few.column(c).to_pylist() for c in names), strict=True)


def _bounded(rows: Iterator[tuple], of: Callable[[tuple], int] = lambda r: sum(len(x) for x in r if isinstance(x, str))) -> Iterator[list[tuple]]:
    """Rows in lists of 2000 rows or about four megabytes; `of` is a row's size."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += of(r)
        if len(out) == 2000 or size > 4 << 20:
            yield out
            out, size = [], 0
    if out:
        yield out


def item_runs(texts: DataFrame) -> DataFrame:
    """bundle_id, path, item_no, listed, content: the items of YAML list files in runs of whole items, none longer than
    a part of a file but for a single long item; other files whole.

    Each part is looked through for lines that open an item or end the list. What a part leaves open
    and how many items it has is carried to the next ones (a row a part, without its text); then parts are cut at
    their items, and only an item that lies across parts is put together.
    """
    file, whole = ["bundle_id", "path"], Window.partitionBy("bundle_id", "path").orderBy("part")
    t = texts.select(*file, "part", "content")
    shape = t.where("part = 0 and content is not null").select(*file, F.regexp_extract("content", FIRST_ITEM, 1).alias("a"), F.regexp_extract("content", FIRST_ITEM, 2).alias("b"), F.col("content").rlike(FIRST_ITEM).alias("listed"), F.col("content").rlike(r"(?m)^items:[ \t]*\r?$").alias("named"))
    shape = shape.select(*file, "listed", F.greatest(F.length("a"), F.length("b")).alias("indent"), (F.col("listed") & ~F.col("named")).alias("bare"))
    t = t.join(shape, file)

    def look(batches):
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        for rows in _bounded(map(counted, _rows(batches, ("bundle_id", "path", "part", "content", "indent")))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bundle_id", "path", "part", "early", "late", "end"])

    def counted(r: tuple) -> tuple:
        bundle, path, part, content, indent = r
        early = late = 0
        end = None
        for _, follows in _marks(content, indent):
            if follows is not None:
                end = follows
            elif end is None:
                early += 1
            else:
                late += end
        return bundle, path, part, early, late, end

    seen = t.where("listed").mapInArrow(look, "bundle_id string, path string, part int, early long, late long, end boolean").join(shape.select(*file, "bare"), file)
    open_ = F.coalesce(F.last("end", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.col("bare"))
    seen = seen.withColumn("open", open_).withColumn("n", F.when(F.col("open"), F.col("early")).otherwise(0) + F.col("late"))
    seen = seen.withColumn("base", F.sum("n").over(whole) - F.col("n")).select(*file, "part", "open", "base")

    def cut(batches):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
        for rows in _bounded((bundle, path, *piece) for bundle, path, part, content, indent, in_list, base in _rows(batches, ("bundle_id", "path", "part", "content", "indent", "open", "base")) for piece in _cut(content, indent, in_list, base, part)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bundle_id", "path", "item_no", "part", "content"])

    pieces = t.where("listed").join(seen, [*file, "part"]).mapInArrow(cut, "bundle_id string, path string, item_no long, part int, content string")
    across = pieces.where("part >= 0").groupBy(*file, "item_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "").alias("content"))
    runs = pieces.where("part < 0").select(*file, "item_no", "content").unionByName(across).withColumn("listed", F.lit(True))
    return runs.unionByName(whole_files(t.where("not listed")).select(*file, F.lit(0).cast("long").alias("item_no"), "content", F.lit(False).alias("listed")))


#: A line of plain block YAML: indentation, dashes, then a key with a plain or simply quoted value or none, or a value.
_BARE, _QUOTED = r"[A-Za-z0-9_/][\w./,;()+=@%-]*(?:(?: |:(?=[\w/]))[\w/(+=@][\w./,;()+=@%-]*)*", r"[ \w./,;:()+=@%#-]*"
_PLAIN = rf"""{_BARE}|"{_QUOTED}"|'{_QUOTED}'"""
_LINE = re.compile(rf"(?a)( *)((?:- )*)(?:([A-Za-z_][\w./-]{{0,200}}):(?: ({_PLAIN}))?|({_PLAIN}))")
#: Shapes of items that a task learns.
SHAPES = 64


def plain_items(content: str) -> list | None:
    """The items of a list in plain block YAML, as the loader of YAML has them; None where a line is anything else."""
    lines = [_LINE.fullmatch(line) for line in content.rstrip("\n").split("\n")]
    if None in lines:
        return None
    bare = lambda v: v[1:-1] if v and v[0] in "\"'" else v
    return _tree((len(b), len(d), key, bare(value), bare(single)) for b, d, key, value, single in (m.groups() for m in lines))


def _tree(lines: Iterable[tuple[int, int, str | None, str | None, str | None]]) -> list | None:
    """The list that plain lines (indentation, length of the dashes, key, its value, value without a key) make up."""
    root: list = []
    tops: list = []  # (column, list or dict) that are open, the innermost last
    waiting = None  # (column, dict, key) of a key without a value so far
    for at, dashes, key, value, single in lines:
        if not tops:
            if not dashes:
                return None
            tops.append((at, root))
        fresh = False  # whether a dash opened the place at this column
        for _ in range(0, dashes, 2):
            if fresh:
                new: list = []
                tops[-1][1].append(new)
                tops.append((at, new))
            elif waiting is not None and at >= waiting[0]:
                new = waiting[1][waiting[2]] = []
                tops.append((at, new))
            else:
                while tops and (tops[-1][0] > at or tops[-1][0] == at and type(tops[-1][1]) is dict):
                    tops.pop()
                if not tops or tops[-1][0] != at:
                    return None
            waiting, fresh, at = None, True, at + 2
        if key is None:
            if not fresh:
                return None
            tops[-1][1].append(single)
            continue
        if fresh:
            own: dict = {}
            tops[-1][1].append(own)
            tops.append((at, own))
        elif waiting is not None and at > waiting[0]:
            own = waiting[1][waiting[2]] = {}
            tops.append((at, own))
        else:
            while tops and (tops[-1][0] > at or tops[-1][0] == at and type(tops[-1][1]) is list):
                tops.pop()
            if not tops or tops[-1][0] != at:
                return None
            own = tops[-1][1]
        if value is None:
            own[key], waiting = "", (at, own, key)
        else:
            own[key], waiting = value, None
    return root


def _filled(column: str | None) -> Callable[[tuple], str | None]:
    """Puts the values of an item in their places <0>, <1>, ... of a column."""
    places = [int(k) for k in re.findall(r"<(\d+)>", column or "")]
    if not places:
        return lambda values: column
    own = itemgetter(*places)
    if column == f"<{places[0]}>":
        return own
    text = re.sub(r"<\d+>", "%s", column.replace("%", "%%"))
    return lambda values: text % own(values)


def _shape(item: str, indent: int, row: Callable[[dict], tuple]) -> tuple | None:
    """What items of the same lines but for the values have in common: a regex of such an item, the columns of its row
    and its conditions as functions of the values (None for an item that is no row). None if the item isn't plain."""
    patterns, lines, places = [], [], count()
    for line in item.rstrip("\n").split("\n"):
        m = _LINE.fullmatch(line)
        if m is None:
            return None
        blanks, dashes, key, value, single = m.groups()
        text = single if key is None else value
        kind = "" if text is None else f"{text[0]}({_QUOTED}){text[0]}" if text[0] in "\"'" else f"({_BARE})"
        patterns.append(re.escape(line[: len(line) - len(text or "")]) + kind)
        place = None if text is None else f"<{next(places)}>"
        lines.append((len(blanks), len(dashes), key, place, place))
    found = _tree(lines)
    if found is None or len(found) != 1:
        return None
    regex = re.compile("(?a)" + "\n".join(patterns) + rf"(?:\n(?={' ' * indent}- )|\n*\Z)")
    if not isinstance(found[0], dict):
        return regex, None, None
    *columns, conditions, _ = row(found[0])
    return regex, [_filled(c) for c in columns], [[(name, _filled(c)) for name, c in x.items()] for x in conditions]


def _shaped(content: str, shapes: dict[int, list], row: Callable[[dict], tuple]) -> list[tuple | None] | None:
    """Rows of a run of items (None for an item that is no row), most of them by the shapes that were seen before, the last
    used first; None where an item isn't plain."""
    indent = len(content) - len(content.lstrip(" "))
    known, dash = shapes.setdefault(indent, []), "\n" + " " * indent + "- "
    if not content.startswith(dash[1:]):
        return None
    out: list[tuple | None] = []
    at, size = 0, len(content)
    while at < size:
        for k, (regex, columns, conditions) in enumerate(known):
            if m := regex.match(content, at):
                if k:
                    known.insert(0, known.pop(k))
                break
        else:
            end = content.find(dash, at) + 1 or size
            item = content[at:end]
            if sum(map(len, shapes.values())) < SHAPES:
                if (new := _shape(item, indent, row)) is None:
                    return None
                known.insert(0, new)
                if new[0].match(content, at):
                    continue
                known.pop(0)
            m = None
        values = m.groups() if m else ()
        if m is None or "" in values or "null" in values:  # what is no value depends on its place
            end = m.end() if m else end
            found = plain_items(content[at:end])
            if found is None or len(found) != 1:
                return None
            out.append(row(found[0]) if isinstance(found[0], dict) else None)
            at = end
            continue
        at = m.end()
        out.append(None if columns is None else (*[c(values) for c in columns], [{name: c(values) for name, c in x} for x in conditions], None))
    return out


def _parsed(runs: Iterator[tuple[str, str, int, str, bool]]) -> Iterator[tuple]:
    """Rows of resources() of runs (bundle_id, path, item_no, content, listed)."""
    import json

    import yaml

    base = getattr(yaml, "CBaseLoader", yaml.BaseLoader)  # scalars stay text
    plain = lambda v: None if v in (None, "", "null", "~") or isinstance(v, (dict, list)) else str(v)

    def items_of(content: str) -> list:
        out = []
        for doc in yaml.load_all(content, base):
            out += doc.get("items", [doc]) if isinstance(doc, dict) else doc if isinstance(doc, list) else []
        return out

    def row(i: dict) -> tuple:
        part = lambda name: i.get(name) if isinstance(i.get(name), dict) else {}
        meta, status = part("metadata"), part("status")
        cond = status.get("conditions")
        cond = [{c: plain(x.get(c)) for c in ("type", "status", "reason", "message")} for x in (cond if isinstance(cond, list) else cond.values() if isinstance(cond, dict) else []) if isinstance(x, dict) and x.get("type")]
        own = {name: json.dumps(x) for name, x in i.items()}  # the whole item is put together of these
        section = lambda name: own[name] if isinstance(i.get(name), dict) else "{}"
        text = "{" + ", ".join([f"{json.dumps(name)}: {x}" for name, x in own.items()]) + "}"
        return (plain(i.get("apiVersion")), plain(i.get("kind")), plain(meta.get("namespace")), plain(meta.get("name")), text, section("metadata"), section("spec"), section("status"), plain(i.get("value")), cond, None)

    shapes: dict[int, list] = {}
    for bundle, path, first, content, listed in runs:
        bad = lambda k, e, bundle=bundle, path=path: (bundle, path, k, *[None] * 10, str(e)[:500])
        shaped = _shaped(content, shapes, row) if listed else None
        if shaped is not None:
            yield from ((bundle, path, first + k, *r) for k, r in enumerate(shaped) if r is not None)
            continue
        rows = []
        try:
            found = items_of(content)
            found = found if listed else [i for i in found if isinstance(i, dict)]
            rows = [(bundle, path, first + k, *row(i)) for k, i in enumerate(found) if isinstance(i, dict)]
        except yaml.YAMLError as e:
            indent = len(content) - len(content.lstrip(" "))
            starts = [m.start() for m in re.finditer(rf"(?m)^{' ' * indent}- ", content)] if listed else []
            rows = [] if len(starts) > 1 else [bad(int(first) if listed else -1, e)]
            for k, (at, end) in enumerate(zip(starts, [*starts[1:], len(content)], strict=True) if len(starts) > 1 else ()):
                try:
                    rows += [(bundle, path, first + k, *row(i)) for i in items_of(content[at:end]) if isinstance(i, dict)]
                except yaml.YAMLError as x:
                    rows.append(bad(first + k, x))
        yield from rows


def resources(members: DataFrame) -> DataFrame:
    """A row for each item of the YAML lists: metadata, spec and status as JSON, conditions typed.

    A file of one part is parsed where it is, a longer one by runs of items, so neither a task nor a parser has a
    whole long file. Rows leave in batches of bounded size, however many files there are and however small they
    are. Bad YAML is one row with an error: a bad item of a list by itself, under its own number, another bad file
    as a whole (-1).
    """
    t = text_files(members).where(F.col("path").rlike(r"(?i)\.ya?ml$"))
    file = ["bundle_id", "path"]
    several = t.where("part > 0").select(*file).distinct()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        text = pa.string()
        cond = pa.list_(pa.struct([(c, text) for c in ("type", "status", "reason", "message")]))
        kinds = {"item_no": pa.int32(), "conditions": cond}
        return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, text)) for c, x in zip(RESOURCE_COLUMNS, zip(*rows, strict=True), strict=True)], names=RESOURCE_COLUMNS)

    def whole(batches):
        runs = ((bundle, path, *run) for bundle, path, content in _rows(batches, ("bundle_id", "path", "content")) for run in _runs_of_file(content))
        yield from map(batch, _bounded(_parsed(runs), size))

    def by_runs(batches):
        rows = _rows(batches, ("bundle_id", "path", "item_no", "content", "listed"))  # a list may begin behind the first part
        runs = ((bundle, path, *run) for bundle, path, no, content, listed in rows for run in ([(no, content, True)] if listed else _runs_of_file(content)))
        yield from map(batch, _bounded(_parsed(runs), size))

    text, error = RESOURCE_COLUMNS.index("text"), RESOURCE_COLUMNS.index("error")

    def size(r: tuple) -> int:
        return 2 * len(r[text] or "") + len(r[error] or "")  # the sections are parts of the text

    short = t.where("part = 0 and content is not null").join(several, file, "left_anti").select(*file, "content").mapInArrow(whole, RESOURCE)
    return short.unionByName(item_runs(t.join(several, file, "left_semi")).mapInArrow(by_runs, RESOURCE))


def sink_reports(reports: DataFrame, folder: str) -> None:
    """One JSON document a bundle."""
    reports.write.mode("overwrite").json(folder)


def sink_index(chunks: DataFrame, folder: str) -> None:
    """Chunks partitioned by their descriptor, so that other descriptors' vectors aren't read."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "model", "dimensions").parquet(folder)
