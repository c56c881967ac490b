"""Operator 11: repair of conversations' structure by a run-length DP.

Role initials of a repaired conversation are `(s?(ua)+)?`: an automaton of four states (start, after s,
after u, after a). A row's symbol is its role's class and its fault; each symbol has a min-plus matrix
of the costs to get from state to state with it, insertions before it included. Equal consecutive symbols
are one run, and a run is one product of the symbol's cached binary powers.

A conversation can be of any length. Rows are sorted by ranges of (conversation, turn, role, text) and cut into
chunks of `CHUNK` at most; a chunk's runs make one matrix. From a conversation's matrices follow the costs behind
each chunk (`_behind`), with these each chunk unrolls its choices for each state it may be entered in (`_unrolled`),
and its exits say in which one it is (`_entered`). What one task has of a whole conversation is 16 numbers a chunk; as an audit
is one string, these are 2^31 / `CHUNK` chunks at most, 64 MB. Hashes of repaired texts are sequential by
nature: the rows of a conversation stream through one task in order, which keeps its audit only.

Semantics. Null role or text is one space. Rows go by turn (nulls first), those of one turn by role and text in bytes;
equal ones are copies of each other, and all but the first are duplicates. A null conversation is one, too. An
empty role has no initial: it can be reroled or deleted only, like any other that begins with none of s, u, a. Of equally cheap
edits the ASCII-least string of initials is taken (a Delete before an Insert, a Keep, a Rerole). A conversation without rows has zeros, an empty audit and
the empty string's hash. Texts may be of any length. An empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import cut, rows_of, text_batches

CHUNK = 4096
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Classes of roles and kinds of faults; a symbol is 3 * class + fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
CLEAN, CUT, GONE = range(3)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FAR = 1 << 40
#: Where an inserted or reroled row leads from each state (user, or assistant after a user).
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Costs of the insertions that end a conversation in each state.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _kept(symbol: int, q: int) -> int | None:
    """The state after a row that is kept as it is, if it may be."""
    role, fault = divmod(symbol, 3)
    if fault != GONE and (role, q) == (SYSTEM, START):
        return AFTER_S
    fits = (role == USER and q != AFTER_U) or (role == ASSISTANT and q == AFTER_U)
    return NEXT[q] if fault != GONE and fits else None


def times(a, b):
    """The min-plus product."""
    return tuple(tuple(min(x + y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


@lru_cache(None)
def transition(symbol: int):
    """Costs from state to state over one row, with insertions before it."""
    more = TRUNCATED if symbol % 3 == CUT else 0
    row = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        row[q][q] = DELETE
        if symbol % 3 != GONE:
            row[q][NEXT[q]] = min(row[q][NEXT[q]], REROLE + more)
        if (to := _kept(symbol, q)) is not None:
            row[q][to] = min(row[q][to], more)
    inserted = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        inserted[q][q], one, two = 0, NEXT[q], NEXT[NEXT[q]]
        inserted[q][one] = INSERT
        inserted[q][two] = min(inserted[q][two], 2 * INSERT)
    return times(inserted, row)


@lru_cache(None)
def power(symbol: int, k: int):
    """The transition of 2^k equal rows."""
    return times(power(symbol, k - 1), power(symbol, k - 1)) if k else transition(symbol)


@lru_cache(1 << 14)
def advance(symbol: int, n: int):
    """The transition of a run, by its binary powers."""
    out, k = None, 0
    while n >> k:
        if n >> k & 1:
            out = power(symbol, k) if out is None else times(out, power(symbol, k))
        k += 1
    return out


def before(matrix, v):
    """Costs to the end before a transition, of those behind it."""
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in matrix)


def least(v):
    """Costs without what they have in common."""
    low = min(v)
    return tuple(x - low for x in v)


@lru_cache(1 << 16)
def back(symbol: int, v):
    return least(before(transition(symbol), v))


@lru_cache(1 << 16)
def choice(symbol: int, q: int, v):
    """The initials of the edits up to and with a row that is met in state q, and the state after it; v: costs behind the row."""
    here, edits, more = before(transition(symbol), v), "", TRUNCATED if symbol % 3 == CUT else 0
    while True:
        if DELETE + v[q] == here[q]:
            return edits + "D", q
        if INSERT + here[NEXT[q]] == here[q]:
            edits, q = edits + "I", NEXT[q]
            continue
        kept = _kept(symbol, q)
        if kept is not None and more + v[kept] == here[q]:
            return edits + "K", kept
        return edits + "R", NEXT[q]


def runs_of(entries) -> list[tuple[int, int]]:
    """Runs (symbol, length) of entries with role class, fault and number of copies."""
    out: list[tuple[int, int]] = []
    for e in entries:
        own = 3 * e["role"] + e["fault"]
        gone = e["n"] if e["fault"] == GONE else e["n"] - 1
        for symbol, n in ((own, e["n"] - gone), (3 * e["role"] + GONE, gone)):
            if n and out and out[-1][0] == symbol:
                out[-1] = (symbol, out[-1][1] + n)
            elif n:
                out.append((symbol, n))
    return out


def unroll(entries, behind, q: int, runs=None) -> tuple[list[str], int]:
    """The initials of each entry's edits, and the state after the last."""
    runs = runs_of(entries) if runs is None else runs
    v, costs = behind, []
    for symbol, n in reversed(runs):
        here = v
        v = least(before(advance(symbol, n), v))
        inside = []
        for _ in range(n):
            inside.append(here)
            here = back(symbol, here)
        costs.append((symbol, inside[::-1]))
    rows = ((symbol, c) for symbol, inside in reversed(costs) for c in inside)
    out = []
    for e in entries:
        edits = []
        for _ in range(e["n"]):
            symbol, c = next(rows)
            made, q = choice(symbol, q, c)
            edits.append(made)
        out.append("".join(edits))
    return out, q


def _map(df: DataFrame, schema: str, f) -> DataFrame:
    """One dict out of each row's dict, as a column of small rows."""

    def run(batches):
        arrow = None
        for batch in batches:
            for part in rows_of(batch):
                made = [f(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_pylist(made, schema=arrow or SCHEMAS[schema])

    return df.mapInArrow(run, schema)


_NUMBERS = pa.list_(pa.int64())
SUMMARY = "conv struct<id:bigint>, part bigint, chunk bigint, entries array<struct<k:bigint,role:int,fault:int,n:bigint>>, costs array<bigint>, illegal bigint, first int, last int"
BEHIND = "conv struct<id:bigint>, chunks array<struct<part:bigint,chunk:bigint,behind:array<bigint>>>, cost bigint, illegal bigint"
UNROLLED = "conv struct<id:bigint>, part bigint, chunk bigint, exits array<bigint>, edits array<array<struct<k:bigint,edits:string>>>"
ENTERED = "conv struct<id:bigint>, chunks array<struct<part:bigint,chunk:bigint,q:bigint>>"
_CONV = pa.struct([("id", pa.int64())])
_ENTRY = pa.struct([("k", pa.int64()), ("role", pa.int32()), ("fault", pa.int32()), ("n", pa.int64())])
_AT = [("part", pa.int64()), ("chunk", pa.int64())]
SCHEMAS = {
    SUMMARY: pa.schema([("conv", _CONV), *_AT, ("entries", pa.list_(_ENTRY)), ("costs", _NUMBERS), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]),
    BEHIND: pa.schema([("conv", _CONV), ("chunks", pa.list_(pa.struct([*_AT, ("behind", _NUMBERS)]))), ("cost", pa.int64()), ("illegal", pa.int64())]),
    UNROLLED: pa.schema([("conv", _CONV), *_AT, ("exits", _NUMBERS), ("edits", pa.list_(pa.list_(pa.struct([("k", pa.int64()), ("edits", pa.string())]))))]),
    ENTERED: pa.schema([("conv", _CONV), ("chunks", pa.list_(pa.struct([*_AT, ("q", pa.int64())])))]),
}


def _summary(r: dict) -> dict:
    """A chunk's matrix, and its pairs of neighbours."""
    matrix = None
    for symbol, n in runs_of(r["entries"]):
        matrix = advance(symbol, n) if matrix is None else times(matrix, advance(symbol, n))
    roles = [e["role"] for e in r["entries"]]
    illegal = sum(e["n"] - 1 for e in r["entries"]) + sum(p not in LEGAL for p in zip(roles, roles[1:], strict=False))
    return r | {"costs": [x for row in matrix for x in row], "illegal": illegal, "first": roles[0], "last": roles[-1]}


def _behind(r: dict) -> dict:
    """Costs behind each chunk of a conversation."""
    v, cost, out, chunks = END, 0, [], sorted(r["chunks"], key=lambda c: (c["part"], c["chunk"]))
    for c in reversed(chunks):
        out.append({"part": c["part"], "chunk": c["chunk"], "behind": v})
        v = before([c["costs"][k : k + 4] for k in range(0, 16, 4)], v)
        if c is not chunks[0]:
            cost, v = cost + min(v), least(v)
    met = zip(chunks, chunks[1:], strict=False)
    return {"conv": r["conv"], "chunks": out, "cost": cost + v[START], "illegal": sum(c["illegal"] for c in chunks) + sum((a["last"], b["first"]) not in LEGAL for a, b in met)}


def _unrolled(r: dict) -> dict:
    """Edits of a chunk's entries and the exit, for each state it may be entered in."""
    runs, behind = runs_of(r["entries"]), tuple(r["behind"])
    exits, edits = [], []
    for q in range(4):
        made, out = unroll(r["entries"], behind, q, runs)
        exits.append(out)
        edits.append([{"k": e["k"], "edits": m} for e, m in zip(r["entries"], made, strict=True)])
    return {"conv": r["conv"], "part": r["part"], "chunk": r["chunk"], "exits": exits, "edits": edits}


def _entered(r: dict) -> dict:
    """The state in which each chunk of a conversation is entered."""
    q, out = START, []
    for c in sorted(r["chunks"], key=lambda c: (c["part"], c["chunk"])):
        out.append({"part": c["part"], "chunk": c["chunk"], "q": q})
        q = c["exits"][q]
    return {"conv": r["conv"], "chunks": out}


def _gathered(chunks: DataFrame, *columns: str) -> DataFrame:
    return chunks.groupBy("conv").agg(F.collect_list(F.struct("part", "chunk", *columns)).alias("chunks"))


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text, n) with class and the first fault: blank, duplicate (not the first copy of
    its role and text; other copies of a first one are duplicates, too), truncated."""
    end = F.rtrim("text", F.lit(BLANKS))
    digest = F.sha2("text", 256)
    seen = rows.where(end != "").groupBy("conv", "role", digest.alias("digest")).agg(F.min(F.struct("turn")).alias("turn"))
    first = seen.select(F.struct("conv", "turn", "role", "digest").alias("at"), F.lit(True).alias("is_first"))
    at = F.struct("conv", F.struct("turn").alias("turn"), "role", digest.alias("digest"))
    found = rows.withColumn("at", at).join(first, "at", "left").drop("at")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    kind = F.when(end == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    return found.withColumn("class", role).withColumn("kind", kind).drop("is_first")


def _hashed(rows: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256 of rows(conv_id, role, text, edits) that are sorted by conversation and place."""

    def run(batches):
        def closed():
            for _ in range(END[q] // INSERT):
                add(b"", b"", insert=True)
                audit.append(ord("I"))
            return pa.RecordBatch.from_pylist([{"conv": {"id": conv}, "audit": audit.decode(), "repaired_sha256": digest.hexdigest()}], schema=pa.schema([("conv", _CONV), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        def add(role, text, insert=False, rerole=False):
            nonlocal q, lines
            to = NEXT[q]
            if insert or rerole:
                role = b"assistant" if to == AFTER_A else b"user"
            elif role[:1] == b"s":
                to = AFTER_S
            digest.update((b"\n" if lines else b"") + role + b":" + text)
            q, lines = to, lines + 1

        conv, open_, q, lines, audit, digest = None, False, START, 0, bytearray(), hashlib.sha256()
        for batch in batches:
            for part in rows_of(batch):
                keys, roles, texts, edits = (part.column(i).to_pylist() if i in (0, 3) else part.column(i).cast(pa.binary()).to_pylist() for i in range(4))
                for key, role, text, made in zip(keys, roles, texts, edits, strict=True):
                    if not open_ or key != conv:
                        if open_:
                            yield closed()
                        conv, open_, q, lines, audit, digest = key, True, START, 0, bytearray(), hashlib.sha256()
                    audit += made.encode()
                    for e in made:
                        if e != "D":
                            add(role, text if e != "I" else b"", insert=e == "I", rerole=e == "R")
        if open_:
            yield closed()

    text_batches(rows.sparkSession)
    return rows.mapInArrow(run, "conv struct<id:bigint>, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Of rows(conv_id, turn, role, text, n copies), for each conversation that has any: conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    conv = F.struct(F.col("conv_id").cast("long").alias("id")).alias("conv")
    rows = cut(rows.groupBy(conv, "turn", "role", "text").agg(F.sum("n").alias("n")), "rows")
    order = ["conv", "turn", "role", "text"]
    placed = faults(rows).repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("k")).drop("at"), "placed")
    blank, first = F.col("kind") == "blank", ~F.col("kind").isin("blank", "duplicate")
    counts = placed.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(first, F.col("n") - 1).otherwise(F.col("n"))).alias("duplicate"),
        F.sum(F.when(F.col("kind") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    fault = F.when(F.col("kind") == "none", CLEAN).when(F.col("kind") == "truncated", CUT).otherwise(GONE)
    entry = F.struct("k", F.col("class").alias("role"), fault.alias("fault"), "n")
    chunks = placed.groupBy("conv", "part", F.expr(f"k div {chunk}").alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    chunks = cut(_map(chunks, SUMMARY, _summary), "chunks")
    costs = cut(_map(_gathered(chunks, "costs", "illegal", "first", "last"), BEHIND, _behind), "costs")
    behind = costs.select("conv", F.inline("chunks"))
    unrolled = cut(_map(chunks.select("conv", "part", "chunk", "entries").join(behind, ["conv", "part", "chunk"]), UNROLLED, _unrolled), "unrolled")
    entered = _map(_gathered(unrolled, "exits"), ENTERED, _entered).select("conv", F.inline("chunks"))
    edits = unrolled.join(entered, ["conv", "part", "chunk"]).select("part", F.inline(F.expr("edits[int(q)]")))
    used = F.col("edits").rlike("[KR]")
    done = placed.join(edits, ["part", "k"]).select("conv", "part", "k", F.when(used, F.col("role")).otherwise("").alias("role"), F.when(used, F.col("text")).otherwise("").alias("text"), "edits")
    done = done.repartition("conv").sortWithinPartitions("conv", "part", "k").select(F.col("conv.id").alias("conv_id"), "role", "text", "edits")
    return counts.join(costs.select("conv", "cost", "illegal"), "conv").join(_hashed(done), "conv")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of conversations with planted faults."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind")
    r = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return r.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = rows.select(F.struct(rows["conv_id"].cast("long").alias("id")).alias("conv")).distinct()
    found = every.join(repaired(damaged(rows)), "conv", "left")
    number: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("conv.id").alias("conv_id"), *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The cheapest edits row by row, for each state [cost, audit, repaired text]; s0 to s3 as above.
SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS prior FROM o),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, ['000000000', '', ''] AS s0, NULL::VARCHAR[] AS s1, NULL::VARCHAR[] AS s2, NULL::VARCHAR[] AS s3 FROM f
  UNION ALL
  SELECT conv_id, rn, d0, list_sort([d1, CASE WHEN ok AND i = 's' THEN k[1] END], 'ASC', 'NULLS LAST')[1],
    list_sort([d2, CASE WHEN ok AND i = 'u' THEN k[1] END, CASE WHEN ok AND i = 'u' THEN k[2] END, CASE WHEN ok AND i = 'u' THEN k[4] END, CASE WHEN ok THEN ru[1] END, CASE WHEN ok THEN ru[2] END, CASE WHEN ok THEN ru[3] END], 'ASC', 'NULLS LAST')[1],
    list_sort([d3, CASE WHEN ok AND i = 'a' THEN k[3] END, CASE WHEN ok THEN ra END], 'ASC', 'NULLS LAST')[1]
  FROM (SELECT conv_id, rn, i, fault IN ('none', 'truncated') AS ok, d[1] AS d0, d[2] AS d1, d[3] AS d2, d[4] AS d3, k, ru, ra FROM (
    SELECT *, list_transform([s0, s1, t2, t3], lambda x: CASE WHEN x IS NOT NULL THEN [lpad((x[1]::BIGINT + 4)::VARCHAR, 9, '0'), x[2] || 'D', x[3]] END) AS d,
      list_transform([s0, s1, t2, t3], lambda x: CASE WHEN x IS NOT NULL THEN [lpad((x[1]::BIGINT + more)::VARCHAR, 9, '0'), x[2] || 'K', x[3] || chr(10) || role || ':' || text] END) AS k,
      list_transform([s0, s1, t3], lambda x: CASE WHEN x IS NOT NULL THEN [lpad((x[1]::BIGINT + more + 3)::VARCHAR, 9, '0'), x[2] || 'R', x[3] || chr(10) || 'user:' || text] END) AS ru,
      CASE WHEN t2 IS NOT NULL THEN [lpad((t2[1]::BIGINT + more + 3)::VARCHAR, 9, '0'), t2[2] || 'R', t2[3] || chr(10) || 'assistant:' || text] END AS ra
    FROM (SELECT *, list_sort([s3, CASE WHEN t2 IS NOT NULL THEN [lpad((t2[1]::BIGINT + 3)::VARCHAR, 9, '0'), t2[2] || 'I', t2[3] || chr(10) || 'assistant:'] END], 'ASC', 'NULLS LAST')[1] AS t3
      FROM (SELECT p.conv_id, f.rn, f.role, f.text, f.fault, f.i, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS more, s0, s1, s3,
        list_sort(list_concat([s2], list_transform([s0, s1, s3], lambda x: CASE WHEN x IS NOT NULL THEN [lpad((x[1]::BIGINT + 3)::VARCHAR, 9, '0'), x[2] || 'I', x[3] || chr(10) || 'user:'] END)), 'ASC', 'NULLS LAST')[1] AS t2
        FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.rn = p.rn + 1))))),
z AS (SELECT conv_id, list_sort([s0, s3, CASE WHEN s2 IS NOT NULL THEN [lpad((s2[1]::BIGINT + 3)::VARCHAR, 9, '0'), s2[2] || 'I', s2[3] || chr(10) || 'assistant:'] END,
  CASE WHEN s1 IS NOT NULL THEN [lpad((s1[1]::BIGINT + 6)::VARCHAR, 9, '0'), s1[2] || 'II', s1[3] || chr(10) || 'user:' || chr(10) || 'assistant:'] END], 'ASC', 'NULLS LAST')[1] AS best
  FROM p WHERE rn = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best[1]::BIGINT, 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(substr(best[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM e.conv_id
"""
