"""Operator 5: token-id output as length-delimited binary records, and the tokenizer helper.

File format. A data file is a run of records

    uint64 length | uint32 masked checksum of the length | payload | uint32 masked checksum of the payload

all little-endian; the checksum is CRC-32, rotated right by 15 and offset by a constant, so that
a checksum stored inside checked data does not weaken it. A payload is

    uint8 width of an id in bytes (2 or 4) | uint8 1 if there is a key | int64 key | ids

Its index file (`.idx`) is an 8-byte magic and, per record, uint64 byte offset and uint64 number
of ids: a shuffled reader seeks to any record without scanning the data file.

Semantics. Null text is the empty text: only the end id is written. Rows with equal keys are
all kept, ordered by XXH64 of their text, then text. Null keys sort first and come back null.
An empty table writes no file and gives an empty result. Columns other than key and text
are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import join_path, open_fs, rows_of, shared_dir

MAGIC = b"IDSIDX01"
MASK_DELTA = 0xA282EAD8  # fixed value: the usual offset of masked checksums
INDEX = np.dtype([("at", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at a byte, and the byte behind the record; bad checksums raise."""
    size = data[at : at + 8]
    if len(size) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(size):
        raise ValueError(f"bad record length at byte {at}")
    n = struct.unpack("<Q", size)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != masked(payload):
        raise ValueError(f"bad record payload at byte {at}")
    return bytes(payload), at + 16 + n


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A capital that a mark behind it may compose with, before it is lower-cased.
MAY_COMPOSE = re.compile(rb"[A-Z][\x80-\xff]")
#: The normaliser and pre-tokenizer of a model whose texts can be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write a byte: itself if it is printable in Latin-1,
    else one of the letters from 256 on, in the order of the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """A lower-casing byte-level BPE model of `tokenizers` whose ids never span ASCII white space,
    with a bounded memo by word.

    Of such a model (its pre-tokenizer drops white space) the ids of a text are those of its
    words, one after the other. A word of letters only is one piece to the pre-tokenizer and
    goes to the library's BPE model as it is, a comma or full stop behind it is a piece of its
    own; all other words go through the whole of the library's tokenizer. The memo keeps two
    generations of `cap` words at most. Texts are lower-cased before the memo is asked, but for
    words in which a capital has another than an ASCII character behind it: the library composes
    first, and some capitals compose with marks that their small letters don't, or the other way.

    A file with another normaliser, pre-tokenizer or kind of added token is not taken apart: its
    texts go to the library whole.
    """

    def __init__(self, path: str, cap: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model, self.letters = self.full.model, _byte_letters()
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.cap, self.new, self.old = cap, {}, {}
        self.tails = {c: self._whole(c) for c in (b",", b".")}
        spec = json.loads(self.full.to_str())
        marked = all("<|" in t["content"] and t["content"] == t["content"].lower() for t in spec["added_tokens"])
        self.by_word = marked and spec["model"]["type"] == "BPE" and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.full.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        tail = word[-1:] if word[-1:] in self.tails else b""
        base = word[: len(word) - len(tail)]
        if base.isalpha():
            piece = base.translate(LOWER).decode()
        else:
            piece = base.decode()
            if not piece.isalpha() or not unicodedata.is_normalized("NFC", piece) or any(c.lower() != c for c in piece):
                return self._whole(word)
            piece = base.decode("latin-1").translate(self.letters)
        if tail and (known := self.new.get(base) or self.old.get(base)) is not None:
            return known + self.tails[tail]
        ids = np.array([t.id for t in self.model.tokenize(piece)], self.dtype).tobytes()
        if tail:
            self.new[base] = ids
            return ids + self.tails[tail]
        return ids

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        if b"<|" in text:  # a special token is written in lower case: a text that may hold one is left as it is
            return text.split()
        if MAY_COMPOSE.search(text):
            return [w if MAY_COMPOSE.search(w) else w.translate(LOWER) for w in text.split()]
        return text.translate(LOWER).split()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (UTF-8; null: none) as bytes of `dtype`."""
        if not self.by_word:
            return [self._whole(t) if t else b"" for t in texts]
        out = []
        for text in texts:
            words = self._words(text) if text else []
            new = self.new
            ids = list(map(new.get, words))
            if None in ids:
                old = self.old.get
                for i in [i for i, x in enumerate(ids) if x is None]:
                    w = words[i]
                    if (x := new.get(w)) is None:
                        if (x := old(w)) is None:
                            x = self._word(w)
                        new[w] = x
                    ids[i] = x
                if len(new) > self.cap:
                    self.old, self.new = new, {}
            out.append(b"".join(ids))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, bytes, np.dtype]]:
    """(key, ids as bytes, dtype) of each row; the first column is the key, the second the text."""
    t = tokenizer(path)
    for batch in batches:
        for part in rows_of(batch, 1_000_000):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            for key, ids in zip(part.column(0).to_pylist(), t.encode(texts), strict=True):
                yield key, ids, t.dtype


MANIFEST = "path string, first_key long, first_hash long, rows long, ids long, bytes long"


def _writer(tokenizer_path: str, end_id: int, folder: str, roll_bytes: int):
    def write(batches):
        batches = iter(batches)
        hashes: list[int] = []

        def seen():
            for b in batches:
                hashes.extend(b.column(2).to_pylist())
                yield b

        ctx, out, done, row = TaskContext.get(), None, [], 0
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def close():
            nonlocal out
            if out:
                out["data"].close()
                with fs.open_output_stream(f"{base}/{out['name']}.idx") as f:
                    f.write(MAGIC + np.array(out["index"], INDEX).tobytes())
                done.append((join_path(folder, out["name"]), out["key"], out["hash"], len(out["index"]), sum(n for _, n in out["index"]), out["at"]))
                out = None

        for key, ids, dtype in encoded(seen(), tokenizer_path):
            if out and out["at"] >= roll_bytes:
                close()
            if not out:
                # another attempt of this task writes other files; only those of the manifest count
                name = f"part-{ctx.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.ids"
                out = {"name": name, "data": fs.open_output_stream(f"{base}/{name}"), "at": 0, "index": [], "key": key, "hash": hashes[row]}
            ids += np.array([end_id], dtype).tobytes()
            record = frame(struct.pack("<BBq", dtype.itemsize, key is not None, key or 0) + ids)
            out["data"].write(record)
            out["index"].append((out["at"], len(ids) // dtype.itemsize))
            out["at"] += len(record)
            row += 1
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "first_key", "first_hash", "rows", "ids", "bytes"), x, strict=True)) for x in done], pa.schema([("path", pa.string())] + [(c, pa.int64()) for c in ("first_key", "first_hash", "rows", "ids", "bytes")]))

    return write


def write_token_records(docs: DataFrame, key: str, text: str, folder: str, tokenizer_path: str, end_id: int, roll_bytes: int = 256 << 20) -> DataFrame:
    """Tokenize and write all rows in ascending key order; one row per file comes back, with
    `base`, the number of ids in all files before it.

    The rows are dealt by ranges of (key, hash of the text), so a key of many rows is spread.
    The manifest has a row per file (of up to roll_bytes), which is what the driver sums.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t")
    files = rows.mapInArrow(_writer(tokenizer_path, end_id, folder, roll_bytes), MANIFEST).collect()
    files.sort(key=lambda f: (f.first_key is not None, f.first_key or 0, f.first_hash, f.path))
    base, out = 0, []
    for f in files:
        out.append((*f, base))
        base += f.ids
    return spark.createDataFrame(out, MANIFEST + ", base long")


def read_index(path: str) -> np.ndarray:
    fs, p = open_fs(f"{path}.idx")
    with fs.open_input_stream(p) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"not an index: {path}.idx")
    return np.frombuffer(data[8:], INDEX)


def read_records(path: str, order: np.ndarray | None = None, chunk: int = 16 << 20) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(number of the record, key, ids) in file order, or in a given order by the offset index."""
    index = read_index(path)
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        ends = np.append(index["at"][1:], np.uint64(f.size())).astype(np.int64)
        starts = index["at"].astype(np.int64)

        def parsed(i: int, data: bytes, at: int):
            payload, _ = unframe(data, at)
            width, keyed, key = struct.unpack_from("<BBq", payload)
            return i, key if keyed else None, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=10)

        if order is not None:
            for i in map(int, order):
                yield parsed(i, f.read_at(int(ends[i] - starts[i]), int(starts[i])), 0)
            return
        i = 0
        while i < len(index):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, "right")))
            data = f.read_at(int(ends[j - 1] - starts[i]), int(starts[i]))
            for k in range(i, j):
                yield parsed(k, data, int(starts[k] - starts[i]))
            i = j


def read_token_records(files: DataFrame, batch_ids: int = 2_000_000) -> DataFrame:
    """Read the files of a manifest back, a task per file: doc_id, start, ids (array of int)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at, rows, size = r["base"], [], 0
                for _, key, ids in read_records(r["path"]):
                    rows.append({"doc_id": key, "start": at, "ids": ids})
                    at += len(ids)
                    size += len(ids)
                    if size >= batch_ids:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _by_file(files).mapInArrow(read, "doc_id long, start long, ids array<long>")


def _by_file(files: DataFrame) -> DataFrame:
    spark = files.sparkSession
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism, 10_000))
    return files.repartition(n, "path")


def record_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""
    cols = ("doc_id", "start", "n_tokens", "ids_crc32")

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at, rows = r["base"], []
                for _, key, ids in read_records(r["path"]):
                    rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=list(cols))

    return _by_file(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_records(docs, "doc_id", "text", shared_dir(spark, "token-records"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return record_digests(files)


def crc32_of(ids: Column) -> Column:
    """CRC-32 of an array of ids as little-endian unsigned 32-bit integers, natively."""
    return F.crc32(F.unhex(F.array_join(F.transform(ids, lambda x: F.concat_ws("", *[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])), "")))
