"""Operator 7: conversations from reply trees, with DataFrame functions only.

A tree is rows (tree, node, parent, role, text, score). Self-joins by pointer doubling give each
node its root, depth and total score in as many rounds as the depth has binary digits. A leaf
stands for a branch; branches are ranked by score within their tree, and the nodes of each chosen
one are found by the saved jumps, again by self-joins, then written as one conversation:

    ### role: text</turn>\\n

for each turn. In role and text a backslash goes before every `\\`, `#`, `/` and `:`, so that
neither `###` nor `</turn>` can stand inside a text, and taking the backslashes out gives the text
back. The loss mask is an array of (start, length) in code points of the output: the escaped texts
of the roles that are learned.

Semantics. Null role or text is empty. A parent that isn't there, or null, makes a root; nodes on
a cycle belong to no root and are left out. Rows of one (tree, node) keep the smallest (role, text).
Equal scores rank the smaller leaf first; a null score is 0. Role and text may be of any length. Null tree or node is left out. An empty
table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import cut

END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#/:])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chains(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as trees: the parent of a row is the row before it.

    Rows are sorted by ranges of (tree, turn, ...), which splits a long conversation, and
    numbered: within each range, plus the rows of the ranges before (one number a partition).
    The row before is then one self-join away.
    """
    r = rows.select(rows[tree].cast("long").alias("tree"), rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    r = r.where("tree is not null")
    order = ["tree", "turn", "role", "text"]
    placed = r.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("id"))
    placed = cut(placed.select("tree", "role", "text", F.shiftright("id", 33).alias("part"), (F.col("id").bitwiseAND((1 << 33) - 1)).alias("k")), "turns")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    numbered = placed.join(F.broadcast(before), "part").select("tree", (F.col("before") + F.col("k")).alias("node"), "role", "text")
    prior = numbered.select("tree", (F.col("node") + 1).alias("node"), F.col("node").alias("parent"))
    return numbered.join(prior, ["tree", "node"], "left").select("tree", "node", "parent", "role", "text", F.lit(0.0).alias("score"))


def branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, branch (number of the leaf), rank, depth, role, text: the nodes of the `best` branches
    of each tree (null: of all) by total score."""
    own = ["tree", "node"]
    n = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = n.where("tree is not null and node is not null").groupBy(*own).agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select(*own, "m.*")
    n = cut(n, "nodes")
    there = n.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    # jump: a node's ancestor 2^k levels up (null beyond the root); depth: levels walked; total: their scores
    state = cut(n.join(there, ["tree", "parent"], "left").select(*own, F.when(F.col("there"), F.col("parent")).alias("jump"), F.when(F.col("there"), 1).otherwise(0).alias("depth"), F.col("score").alias("total")), "jumps")
    reached, walking, jumps, last = state.where("jump is null"), state.where("jump is not null"), [], -1
    while (left := walking.count()) not in (0, last):  # a round that ends no walk: those left go around in cycles
        jumps.append(walking.select(*own, "jump"))
        last = left
        to = reached.unionByName(walking).select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        state = cut(walking.join(to, ["tree", "jump"]).select(*own, F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total")), "jumps")
        reached, walking = reached.unionByName(state.where("jump is null")), state.where("jump is not null")
    parents = n.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reached.join(parents, own, "left_anti")
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.select("tree", F.col("node").alias("branch"), F.col("depth").alias("length"), place.alias("rank"))
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    path = chosen.withColumn("node", F.col("branch"))
    for jump in reversed(jumps):  # of each node found, the one 2^k levels up is found too
        above = path.join(jump, own).select("tree", "branch", "length", "rank", F.col("jump").alias("node"))
        path = cut(path.unionByName(above), "paths")
    text = n.select(*own, "role", "text")
    return path.join(reached.select(*own, "depth"), own).join(text, own).select("tree", "branch", "rank", "depth", "role", "text")


def conversations(paths: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, branch, rank, n_turns, formatted, mask (array of start, length in code points).

    A conversation is one row, so its turns meet in one task; where each turn starts is summed
    before that, by a running sum within the branch.
    """
    head, body = F.concat(F.lit("### "), escape(F.col("role")), F.lit(": ")), escape(F.col("text"))
    p = paths.select("tree", "branch", "rank", "depth", F.concat(head, body, F.lit(END)).alias("turn"), F.length(head).alias("a"), F.length(body).alias("b"), F.col("role").isin(*learned).alias("learn"))
    in_order = Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("turn").cast("long")).over(in_order) - F.length("turn") + F.col("a")
    p = p.withColumn("span", F.when(F.col("learn"), F.struct(start.alias("start"), F.col("b").cast("long").alias("length"))))
    turns = F.array_sort(F.collect_list(F.struct("depth", "turn", "span")))
    c = p.groupBy("tree", "branch", "rank").agg(turns.alias("turns"), F.count("*").alias("n_turns"))
    return c.select("tree", "branch", "rank", "n_turns", F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("mask"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped.

    The repetitions of the pattern are possessive, as Java's engine walks those in a loop; a plain
    repeated group calls itself for each character of a role.
    """
    parts = F.filter(F.split(formatted, END), lambda t: t != "")
    pattern = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(parts, lambda t: F.struct(unescape(F.regexp_extract(t, pattern, 1)).alias("role"), unescape(F.regexp_extract(t, pattern, 2)).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = cut(conversations(branches(chains(rows, "conv_id", "turn", "role", "text"))), "conversations")
    turns = F.array_join(F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = under_mask(F.col("formatted"), F.col("mask"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
             4 + length(regexp_replace(role, '[\\#/:]', 'xx', 'g')) + 2 + length(regexp_replace(text, '[\\#/:]', 'xx', 'g')) + 8 AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             string_agg(loss, '' ORDER BY turn, role, text) AS loss, sum(chars) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""
