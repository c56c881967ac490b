"""Operator 8: hierarchical residual best-fit packing.

Pieces of at most `capacity` tokens are dealt to tasks and packed there, longest first, each
into the open sequence with the least room that still takes it. A task leaves at most one sequence
that is half full or less, as two would have been one. Those go up as items of their whole length
to a round of fewer tasks, and so on to one task, with as many of the fuller sequences, those
with the most room: no two of these fit together, and each needs one of the others. All the rest
is emitted, so that a round gets at most two sequences of each task of the round before, whatever
the lengths are.

Semantics. Null text is the empty text (its end id alone). A repeated row is packed as often
as it is there. Null keys are packed like others and come back null. An empty table gives an
empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import cut, shared_dir, text_batches
from bundlelens.llm.tokens import encoded

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenize; documents longer than the capacity are cut into pieces of it."""

    def cut_up(batches):
        rows = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, PIECE, strict=True)], schema=PIECE)

        for doc, ids, dtype in encoded(batches, tokenizer_path):
            ids = np.append(np.frombuffer(ids, dtype), dtype.type(end_id)).astype("<u4")
            for p, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                rows.append((doc, p, at, len(part), zlib.crc32(part.tobytes())))
            if len(rows) >= 20_000:
                yield batch()
                rows.clear()
        yield batch()

    text_batches(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open sequences by room: a stack for each room from 0 to the capacity, and a bit set of
    those that aren't empty, whose lowest set bit from a size on is the best fit."""

    def __init__(self, capacity: int):
        self.stacks, self.rooms = [[] for _ in range(capacity + 1)], 0
        self.capacity = capacity

    def put(self, size: int, items: list) -> None:
        fit = self.rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            seq = self.stacks[room].pop()
            if not self.stacks[room]:
                self.rooms &= ~(1 << room)
            seq.extend(items)
        else:
            room, seq = self.capacity, list(items)
        self.stacks[room - size].append(seq)
        self.rooms |= 1 << (room - size)


ITEMS = pa.list_(pa.struct(list(PIECE)))
OPEN = pa.schema([("size", pa.int64()), ("sequence_id", pa.int64()), ("open", pa.bool_()), ("items", ITEMS)])


def _round(capacity: int, spare: int, number: int):
    """Pack a task's items (sorted, longest first); sequences with more than `spare` room are open."""

    def run(batches):
        fit = BestFit(capacity)
        for b in batches:
            for size, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fit.put(size, items)
        base, k, rows = (number << 56) | (TaskContext.get().partitionId() << 32), 0, []
        for room, stack in enumerate(fit.stacks):
            for seq in stack:
                rows.append({"size": capacity - room, "sequence_id": base + k, "open": room > spare, "items": seq})
                k += 1
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, OPEN)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, OPEN)

    return run


def pack(found: DataFrame, capacity: int, spare: int | None = None, per_task: int = 50_000, fan_in: int = 8) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) in sequences of up to `capacity`.

    A task of the first round gets about per_task pieces, one of each later round about the
    open sequences of fan_in tasks before (2 * fan_in), or per_task of them. A sequence is nearly full if `spare` tokens or fewer
    are free (default: a 64th of the capacity).
    """
    spare = capacity // 64 if spare is None else spare
    spark = found.sparkSession
    item = F.array(F.struct(*[F.col(f.name) for f in PIECE]))
    kind = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
    items = found.select(F.col("length").alias("size"), item.cast(kind).alias("items"))
    folder, number, tasks = shared_dir(spark, "packing"), 0, max(1, -(-found.count() // per_task))
    schema, up = f"size long, sequence_id long, items {kind}, round int, open boolean", None
    while True:
        last = tasks == 1
        first = F.col("items")[0]
        dealt = items.repartition(tasks, F.xxhash64(first)) if tasks > 1 else items.coalesce(1) if number else items.repartition(1)
        dealt = dealt.sortWithinPartitions(F.desc("size"), first["doc_id"], first["piece"], first["ids_crc32"])
        packed = dealt.mapInArrow(_round(capacity, capacity if last else spare, number), f"size long, sequence_id long, open boolean, items {kind}")
        packed.write.partitionBy("open").parquet(f"{folder}/round={number}")
        if last:
            break
        left = spark.read.schema(schema).parquet(folder).where(f"round = {number} and open").select("size", "sequence_id", "items")
        half = left.where(2 * F.col("size") <= capacity)
        n = half.count()  # one a task at most
        if not n:
            break
        items = cut(half.unionByName(left.where(2 * F.col("size") > capacity).orderBy("size", "sequence_id").limit(n)), "open")
        gone = items.select("sequence_id")
        up = gone if up is None else up.unionByName(gone)
        items = items.select("size", "items")
        tasks, number = max(1, min(-(-tasks // fan_in), -(-2 * n // per_task))), number + 1
    full = spark.read.schema(schema).parquet(folder)
    full = full if up is None else full.join(F.broadcast(up), "sequence_id", "left_anti")
    ends = F.expr("transform(sequence(1, size(items)), i -> struct(items[i - 1] as piece, aggregate(slice(items, 1, i - 1), 0L, (s, x) -> s + x.length) as offset))")
    placed = full.select("sequence_id", F.explode(ends).alias("e"))
    return placed.select(*[F.col("e.piece")[f.name].alias(f.name) for f in PIECE], "sequence_id", F.col("e.offset").alias("offset"))


def pack_documents(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenize once, then pack; full pieces need no packing and get a sequence each."""
    return pack(cut(pieces(docs, key, text, tokenizer_path, end_id, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int) and lengths of the parts.
    Keys must be unique; a sequence is bounded by the capacity, so is each group here."""

    def tokens(batches):
        for doc, ids, dtype in encoded(batches, tokenizer_path):
            ids = np.append(np.frombuffer(ids, dtype), dtype.type(end_id)).astype(np.int32)
            cuts = range(0, len(ids), capacity)
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cuts), pa.int64()), pa.array(list(range(len(cuts))), pa.int32()), pa.array([ids[a : a + capacity] for a in cuts], pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    parts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tokens, "doc_id long, piece int, ids array<int>")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(parts, ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts.ids", F.size).alias("lengths"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 0, 2048)
