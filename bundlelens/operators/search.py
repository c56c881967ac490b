"""Search of log lines, windows around hits, and mentions of names in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlelens.session import shared_dir, written

#: Lines around a hit, and the most lines of a preview.
AROUND, MOST_LINES = 80, 220


def line_filter(line: Column, needle: str, regex: bool = False, ignore_case: bool = False, least: int = 1) -> Column:
    """Lines with the needle; its blanks and closing dots of a cut excerpt don't count."""
    if regex:
        try:
            re.compile(needle)
        except re.error as e:
            raise ValueError(f"bad regex: {needle}") from e
        return line.rlike(("(?i)" if ignore_case else "") + needle)
    needle = needle.strip()
    needle = needle[:-3].rstrip() if needle.endswith("...") else needle
    if len(needle) < least:
        raise ValueError(f"a search needs {least} characters")
    return F.lower(line).contains(needle.lower()) if ignore_case else line.contains(needle)


def first_hits(lines: DataFrame, by: list[str], line_no: str, line: str, needle: str, **how) -> DataFrame:
    """The first line of each file with the needle."""
    return lines.where(line_filter(F.col(line), needle, **how)).groupBy(*by).agg(F.min(line_no).alias(line_no))


def line_windows(lines: DataFrame, hits: DataFrame, by: list[str], line_no: str, line: str, before: int = AROUND, after: int = AROUND, most: int = MOST_LINES) -> DataFrame:
    """Lines around each hit. Files are cut into bands of as many lines as a window has; a hit goes to the bands that
    its window touches (three at most), and lines meet the hits of their own band only."""
    width = before + after + 1
    touched = F.sequence(F.expr(f"({line_no} - {before}) div {width}"), F.expr(f"({line_no} + {after}) div {width}"))
    h = hits.select(*by, F.col(line_no).alias("__hit"), F.explode(touched).alias("__band"))
    j = lines.withColumn("__band", F.expr(f"{line_no} div {width}")).join(h, [*by, "__band"]).where(F.col(line_no).between(F.col("__hit") - before, F.col("__hit") + after))
    if width > most:
        j = j.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__hit").orderBy(line_no))).where(F.col("__k") <= most)
    return j.select(*by, F.col("__hit").alias("hit_line"), line_no, line)


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name_key: str, name: str, block_chars: int = 8_000_000) -> DataFrame:
    """(key, name_key) of all texts that contain a name, wherever it is from, in one scan of the texts for each block
    of names: an automaton of all names of a block (up to about block_chars characters, which is
    what is broadcast) reads each text once, whatever their number. Blocks are worked off one after the other, so the driver has one at a time."""
    n = names.select(F.col(name_key).cast("long").alias("k"), F.col(name).alias("n")).where("n <> '' and k is not null")
    blocks = max(1, -(-(n.agg(F.sum(F.length("n"))).first()[0] or 0) // block_chars))
    t = texts.select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).where("t is not null")
    schema, context = f"`{key}` long, `{name_key}` long", texts.sparkSession.sparkContext
    if blocks == 1:
        return t.mapInArrow(_scan(context.broadcast([(r.n, r.k) for r in n.collect()])), schema).distinct()
    path = shared_dir(texts.sparkSession, "mentions")
    for b in range(blocks):
        shared = context.broadcast([(r.n, r.k) for r in n.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).collect()])
        t.mapInArrow(_scan(shared), schema).write.mode("append").parquet(path)
        shared.destroy()
    return texts.sparkSession.read.schema(schema).parquet(path).distinct()


def naming(rows: DataFrame, text: Column, names: DataFrame, name: str, by: str = "bundle_id", named: str = "named", text_chars: int = 32_000_000, name_chars: int = 4_000_000) -> DataFrame:
    """rows with `named`, a row for each distinct name of the row's own bundle that the text contains.

    Texts and names are dealt by bundle, a bundle of many texts in parts of about text_chars characters and one of
    many names in blocks of about name_chars; each part meets each block of its bundle in one task, which
    builds an automaton of the names. Nothing goes through the driver, and no text meets another bundle's names.
    """
    columns = rows.columns
    n = names.select(F.col(by), F.col(name).alias("__name")).where("__name <> ''").distinct()
    t = rows.withColumn("__text", text).where("__text <> ''")
    blocks = n.groupBy(by).agg(F.ceil(F.sum(F.length("__name")) / name_chars).cast("int").alias("__blocks"))
    parts = t.groupBy(by).agg(F.ceil(F.sum(F.length("__text")) / text_chars).cast("int").alias("__parts"))
    shares = written(blocks.join(parts, by), "shares")
    part, block = F.sequence(F.lit(0), F.col("__parts") - 1), F.sequence(F.lit(0), F.col("__blocks") - 1)
    left = t.join(shares, by).withColumn("__part", F.pmod(F.xxhash64(*columns), F.col("__parts")).cast("int")).withColumn("__block", F.explode(block)).drop("__parts", "__blocks")
    right = n.join(shares, by).withColumn("__block", F.pmod(F.xxhash64("__name"), F.col("__blocks")).cast("int")).withColumn("__part", F.explode(part)).drop("__parts", "__blocks")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{named}` string"

    def found(texts, own):
        import pyarrow as pa

        a = _automaton((x, x) for x in own.column("__name").to_pylist())
        at, hits = [], []
        for i, x in enumerate(texts.column("__text").to_pylist()):
            found = {k for _, keys in a.iter(x) for k in keys}
            at += [i] * len(found)
            hits += found
        kept = texts.select(columns).take(pa.array(at, pa.int64()))
        loose = pa.schema([(f.name, _nullable(f.type)) for f in kept.schema])  # as the schema above has it
        return kept.cast(loose).append_column(named, pa.array(hits, pa.string()))

    key = [by, "__part", "__block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(found, schema)


def _nullable(kind):
    import pyarrow as pa

    if pa.types.is_struct(kind):
        return pa.struct([(f.name, _nullable(f.type)) for f in kind])
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _automaton(pairs):
    import ahocorasick

    by: dict[str, list] = {}
    for name, k in pairs:
        by.setdefault(name, []).append(k)
    a = ahocorasick.Automaton()
    for name, keys in by.items():
        a.add_word(name, keys)
    if not len(a):
        a.add_word("\0", [])  # an automaton needs a word
    a.make_automaton()
    return a


def _scan(shared):
    def run(batches):
        import pyarrow as pa

        a = _automaton(shared.value)
        for batch in batches:
            ids, hits = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {k for _, keys in a.iter(text) for k in keys}
                ids += [doc] * len(found)
                hits += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], names=["a", "b"])

    return run
