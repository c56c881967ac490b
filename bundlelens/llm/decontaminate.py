"""Operator 2: benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words without surrounding punctuation in lower
case, but <num> for a number, <qty> for a number with a unit behind it, <name> for a run of
capitalised words within a sentence. Windows of `width` template tokens of documents and
benchmark items are hash-joined, and the templates compared. Where a document shares enough of
an item's windows at one shift, or at shifts `drift` or less apart (a few words put in or left out
between them), the values in the placeholders are compared by
type and place: a copy of the question, re-parameterised or not, replaces its names one to one,
and its numbers freely if all windows are there; with fewer windows at least half of the number
slots must hold the value that most slots of the same number of the item hold. Names that
contradict each other are another text of the same form.

Windows are first joined for an item's rarest ones only (in documents), as many as a document with
enough of its windows can't do without; only documents and items that meet there are
compared in full. A phrase that many items and documents have is thus no key of all their pairs.

Semantics. An item with fewer tokens than `width` is one window as a whole; windows with fewer
than `literals` words beside placeholders say too little and don't count, neither as shared nor
as the item's. An item of such windows only is one window as a whole; if that has too few words
still, only the same values match. Items under `least` tokens match nothing. Null texts, null items and empty tables match nothing. Rows of one key count
as one document; a null key is reported as null. Columns other than key and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import BASES, Windows, cut, rows_of, text_batches

#: Words that count as a unit behind a number.
UNITS = frozenset(
    """% $ € £ c m km cm mm mi mile miles ft foot feet in inch inches yd yard yards g kg mg lb lbs oz pound pounds ounce ounces
    ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
    month months year years km/h mph m/s dollar dollars cent cents euro euros percent degree degrees °c °f k b kb mb gb tb hz khz mhz
    ghz w kw v a n j kj cal kcal pa bar mol""".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
EDGE = re.compile(r"^[^\w$€£+%°-]+|[^\w%$€£°]+$")
PLACEHOLDERS = ("<num>", "<qty>", "<name>")
NONE, LITERAL, CAPITAL, NUM, UNIT, QTY = range(6)
NEWLINE = b"\x00"


def classify(word: bytes) -> tuple[int, str, bool]:
    """(class, core, whether a sentence ends behind it) of a word."""
    if word == NEWLINE:
        return NONE, "", True
    w = word.decode()
    core, ends = EDGE.sub("", w), w.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
    if not any(c.isalnum() or c in "%$€£°" for c in core):
        return NONE, "", ends
    m = NUMBER.match(core)
    if m:
        rest = core[m.end() :].lower()
        kind = NUM if not rest and m[0][0] not in "$€£" else QTY if not rest or rest in UNITS else LITERAL
        return kind, core, ends
    if core.lower() in UNITS:
        return UNIT, core, ends
    return CAPITAL if core[0].isupper() else LITERAL, core, ends


class Templates:
    """Template tokens of many texts at once; a bounded memo by word."""

    def __init__(self, cap: int = 300_000):
        self.cap = cap
        self.marks = np.array([xxhash.xxh64_intdigest(p.encode(), 1) for p in PLACEHOLDERS], np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.kind, self.hash, self.ends, self.core = [], [], [], []

    def _add(self, w: bytes) -> int:
        kind, core, ends = classify(w)
        self.index[w] = k = len(self.kind)
        self.kind.append(kind)
        self.core.append(core)
        self.ends.append(ends)
        self.hash.append(xxhash.xxh64_intdigest(core.lower().encode()))
        return k

    def parse(self, texts: list[bytes | None]) -> dict:
        """Flat arrays over the tokens of all texts: hash, mark (-1 for a word, else the number of the
        placeholder), doc, first and last word; words: each text's words, base: the first word's number."""
        if len(self.index) > self.cap:
            self._clear()
        words = [t.replace(b"\n", b" \x00 ").split() if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        get, add = self.index.get, self._add
        at = [i if (i := get(w)) is not None else add(w) for w in flat]
        at = np.array(at, np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        n = len(at)
        kind, ends = np.array(self.kind, np.int8)[at] if n else np.zeros(0, np.int8), np.array(self.ends, bool)[at] if n else np.zeros(0, bool)
        starts = np.ones(n, bool)
        starts[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        keep = np.flatnonzero(kind != NONE)
        kind, d, starts = kind[keep], doc[keep], starts[keep]
        same = np.zeros(len(keep), bool)
        same[1:] = d[1:] == d[:-1]
        mark = np.full(len(keep), -1, np.int8)
        mark[kind == NUM] = 0
        mark[kind == QTY] = 1
        mark[(kind == CAPITAL) & ~starts] = 2
        unit = (kind == UNIT) & same
        unit[1:] &= mark[:-1] == 0
        mark[np.flatnonzero(unit) - 1] = 1
        more = (mark == 2) & same
        more[1:] &= mark[:-1] == 2
        head = np.flatnonzero(~(unit | more))
        last = np.append(head[1:], len(keep)) - 1 if len(head) else head
        h = np.array(self.hash, np.uint64)[at[keep[head]]] if len(head) else np.zeros(0, np.uint64)
        m = mark[head]
        h = np.where(m >= 0, self.marks[np.maximum(m, 0)], h)
        return {"hash": h, "mark": m, "doc": d[head], "first": keep[head], "last": keep[last], "at": at}

    def token(self, p: dict, i: int) -> str:
        return PLACEHOLDERS[p["mark"][i]] if p["mark"][i] >= 0 else self.core[p["at"][p["first"][i]]].lower()

    def value(self, p: dict, i: int) -> str:
        cores = (self.core[k] for k in p["at"][p["first"][i] : p["last"][i] + 1])
        return "".join(c.lower() for c in cores if c) if p["mark"][i] < 2 else " ".join(c for c in cores if c)


ROWS = "key long, width int, h long, at int, n int, template string, slots array<string>"
SCHEMA = pa.schema([("key", pa.int64()), ("width", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("template", pa.string()), ("slots", pa.list_(pa.string()))])


BARE = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("width", pa.int32()), ("h", pa.int64()), ("at", pa.int32())])


def template_windows(rows: DataFrame, widths: dict[int, int], known=None, whole: tuple[int, int, int] | None = None, bare: bool = False) -> DataFrame:
    """Windows of rows(key, text): key, width, h, at, n (tokens of the text), template, slots
    (n for a name or v for a number, place in the window, blank, value). bare: of rows(key, text, row)
    key, row, width, h, at only. A column `picks` of rows (array of width, at) names the windows to take.

    widths: {width: least number of words beside placeholders}. known: {width: sorted hashes},
    broadcast; other windows are not made rows. whole = (width, least, literals): texts with fewer
    tokens than width, but least, are one window, as are those without a window of `literals` words.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        t, w = Templates(), Windows(BASES[0])
        tables = {}
        if shared is not None:
            for width, hashes in shared.value.items():
                table = np.zeros(1 << 22, bool)
                table[(hashes >> np.uint64(42)).astype(np.int64)] = True
                tables[width] = table
        for batch in batches:
            for part in rows_of(batch, 3_000_000):
                keys = part.column(0).to_pylist()
                picks = part.column("picks").to_pylist() if "picks" in part.schema.names else None
                p = t.parse(part.column(1).cast(pa.binary()).to_pylist())
                size = np.bincount(p["doc"], minlength=len(keys))
                ends = np.cumsum(size)
                prefix = w.prefix(p["hash"])
                words = np.concatenate([[0], np.cumsum(p["mark"] < 0)])
                out = []
                sets = [(width, None, floor) for width, floor in widths.items()]
                if whole:
                    at = np.arange(max(0, len(p["hash"]) - whole[0] + 1))
                    d = p["doc"][: len(at)]
                    full = np.zeros(len(keys), bool)
                    full[d[(at + whole[0] <= ends[d]) & (words[at + whole[0]] - words[at] >= whole[2])]] = True
                    sets = [(whole[0], full, whole[2])] + [(int(k), ~full & (size == k), 0) for k in np.unique(size[~full]) if k >= whole[1]]
                for width, only, floor in sets:
                    at = np.arange(max(0, len(p["hash"]) - width + 1))
                    d = p["doc"][: len(at)]
                    ok = (at + width <= ends[d]) & (words[at + width] - words[at] >= floor)
                    if only is not None:
                        ok &= only[d]
                    if picks is not None:
                        asked = np.zeros(len(ok), bool)
                        asked[[int(ends[i] - size[i]) + x["at"] for i, own in enumerate(picks) for x in own if x["width"] == width]] = True
                        ok &= asked
                    at = at[ok]
                    h = w.at(prefix, at, width)
                    if bare:
                        own = part.take(pa.array(p["doc"][at]))
                        starts = (ends - size)[p["doc"][at]]
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(np.full(len(at), width, np.int32)), pa.array(h.view(np.int64)), pa.array((at - starts).astype(np.int32))], schema=BARE)
                        continue
                    if shared is not None:
                        hit = tables[width][(h >> np.uint64(42)).astype(np.int64)]
                        at, h = at[hit], h[hit]
                        hashes = shared.value[width]
                        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        at, h = at[hashes[k] == h], h[hashes[k] == h]
                    for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        d = int(p["doc"][i])
                        span = range(i, i + width)
                        out.append({"key": keys[d], "width": width, "h": x, "at": i - int(ends[d] - size[d]), "n": int(size[d]), "template": " ".join(t.token(p, j) for j in span), "slots": [f"{'n' if p['mark'][j] == 2 else 'v'}{j - i} {t.value(p, j)}" for j in span if p["mark"][j] >= 0]})
                for k in range(0, 0 if bare else max(1, len(out)), 20_000):
                    yield pa.RecordBatch.from_pylist(out[k : k + 20_000], SCHEMA)

    text_batches(rows.sparkSession)
    return rows.mapInArrow(run, "key long, row long, width int, h long, at int" if bare else ROWS)


def contamination(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = 8, least: int = 5, literals: int = 3, share: float = 0.5, broadcast_windows: int = 1_000_000, drift: int = 4) -> DataFrame:
    """doc_id, item_id, n_shared, n_windows, share, exact of each document that holds at least
    `share` of an item's windows, at one shift or at shifts `drift` or less apart, with consistent values.

    The hashes of the items' windows are broadcast to filter the documents' windows at their
    source if there are broadcast_windows of them or fewer (8 MB at most); with more, the bare
    hashes of all windows are shuffled to a semi-join, and templates are built of those left only.
    """
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).where("text is not null")
    bench = items.select(items[item_key].cast("long").alias("key"), items[item_text].cast("string").alias("text")).where("key is not null and text is not null")
    of_items = cut(template_windows(bench, {}, whole=(width, least, literals)), "items")
    words = F.col("width") - F.size("slots")
    floors = {r.width: r.words for r in of_items.groupBy("width").agg(F.min(words).alias("words")).collect()}
    hashes = of_items.select("width", "h").distinct()
    some = hashes.limit(broadcast_windows + 1).collect()
    known = {k: np.unique(np.array([r.h for r in some if r.width == k], np.int64).view(np.uint64)) for k in floors} if len(some) <= broadcast_windows else None
    if known is None:
        keyed = rows.withColumn("row", F.xxhash64("text"))
        hit = template_windows(keyed, floors, bare=True).join(hashes, ["width", "h"], "left_semi").groupBy("key", "row").agg(F.collect_set(F.struct("width", "at")).alias("picks"))
        hit = cut(hit, "picks").select(F.col("key").alias("k"), F.col("row").alias("r"), "picks")
        rows = keyed.join(hit, F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r"))).select("key", "text", "picks")
    of_docs = cut(template_windows(rows, floors, known), "windows")
    sizes = of_items.groupBy("key", "n").agg(F.countDistinct("at").alias("n_windows"))
    window = ["width", "h", "template"]
    a = of_docs.select(*window, F.struct("key").alias("doc"), F.col("at").alias("da"), F.col("slots").alias("ds"))
    b = of_items.join(sizes, ["key", "n"]).select(*window, F.col("key").alias("item_id"), F.col("at").alias("ia"), F.col("slots").alias("bs"), "n", "n_windows", (words < literals).alias("weak"))
    # a document with enough of an item's windows has one of its rarest n - ceil(share n) + 1
    seen = of_docs.groupBy(*window).agg(F.count("*").alias("docs"))
    rarity = F.row_number().over(Window.partitionBy("item_id", "n").orderBy("docs", "ia"))
    rarest = b.join(seen, window).withColumn("place", rarity + F.col("n_windows") - F.count("*").over(Window.partitionBy("item_id", "n")))
    rarest = rarest.where(F.col("place") <= F.col("n_windows") - F.ceil(share * F.col("n_windows")) + 1).select(*window, "item_id", "n").distinct()
    likely = cut(a.select(*window, "doc").distinct().join(rarest, window).select("doc", "item_id", "n").distinct(), "likely")
    pairs = a.join(likely, "doc").join(b, [*window, "item_id", "n"]).withColumn("doc_id", F.col("doc.key")).withColumn("shift", F.col("da") - F.col("ia"))
    # each run of one shift, and of drift + 1 neighbouring ones from each on that some window lies in
    near = F.transform(F.sequence(F.lit(0), F.lit(drift)), lambda k: F.struct((F.col("shift") - k).alias("base"), F.lit(drift).alias("span")))
    pairs = pairs.withColumn("run", F.explode(F.concat(F.array(F.struct(F.col("shift").alias("base"), F.lit(0).alias("span"))), near)))
    by = ["doc_id", "item_id", "run", "n", "n_windows", "weak"]
    slot = lambda x: F.struct(F.substring(x["b"], 1, 1).alias("kind"), (F.col("ia") + F.regexp_extract(x["b"], "^.([0-9]+) ", 1).cast("int")).alias("place"), *[F.regexp_replace(x[c], "^.[0-9]+ ", "").alias(c) for c in ("b", "d")])
    pairs = pairs.withColumn("values", F.transform(F.arrays_zip(F.col("bs").alias("b"), F.col("ds").alias("d")), slot))
    runs = pairs.groupBy(*by).agg(F.countDistinct("ia").alias("n_shared"), F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"))
    values = F.col("values")
    names = F.array_distinct(F.transform(F.filter(values, lambda v: v["kind"] == "n"), lambda v: F.struct(v["b"].alias("b"), v["d"].alias("d"))))
    one_to_one = (F.size(F.array_distinct(names["b"])) == F.size(names)) & (F.size(F.array_distinct(names["d"])) == F.size(names))
    numbers = F.filter(values, lambda v: v["kind"] == "v")
    # slots of each number of the item that hold its most frequent replacement
    most = lambda b: F.array_max(F.transform(F.filter(numbers, lambda v: v["b"] == b), lambda v: F.size(F.filter(numbers, lambda w: (w["b"] == b) & (w["d"] == v["d"])))))
    agree = F.aggregate(F.transform(F.array_distinct(numbers["b"]), most), F.lit(0), lambda s, x: s + x)
    runs = runs.withColumn("consistent", one_to_one & ((F.col("n_shared") == F.col("n_windows")) | (2 * agree >= F.size(numbers))))
    runs = runs.withColumn("exact", F.forall(values, lambda v: v["b"] == v["d"]))
    runs = runs.withColumn("share", F.col("n_shared") / F.col("n_windows")).where(F.col("consistent") & (F.col("exact") | ~F.col("weak")) & (F.col("share") >= share))
    best = runs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_windows", "share", "exact")).alias("r"))
    r = F.col("r")
    return best.select("doc_id", "item_id", r["n_shared"].alias("n_shared"), r["n_windows"].cast("long").alias("n_windows"), r["share"].alias("share"), r["exact"].alias("exact"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, "doc_id", "text", items, "item_id", "text")
