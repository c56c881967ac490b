"""Operator 13: a Merkle manifest of a table, with a membership proof of every row by pointer jumping.

Each row is a leaf: the SHA-256 of its framed fields. Leaves of one group (a source) ascend by key
and are hashed in runs of `FANOUT` to a subroot; subroots, ordered by group, go to the root
in the same way. Leaves are numbered without a task that sees a whole group: rows are sorted by ranges of
(group, key, leaf), counted per range and group, and the counts before are added.

Proofs are the siblings on the way to the root. Every node above the leaves holds a segment, the
siblings towards one of its ancestors, first towards its parent. In each round a self-join
takes a node's ancestor's segment and appends it, so that the distance doubles until all segments end
at the root. Leaves are most of a tree and the leaves of a run share all but the last step, so they
keep no segments of their own: at the end each takes its run's and puts its siblings in the run before it. Nodes
of which many have the same ancestor (near the root) meet copies of that ancestor's segment, one for
every 65,536 of them, so no task has them all.

Semantics. A null field is `-`, any other its length in UTF-8 bytes, `:` and the value. A null group is a
group of its own and the first; a null key comes first in its group. Rows of one key (repeated or not)
keep one leaf each, in the order of their hashes; equal rows have equal leaves, each in its own place. A null
key is not tampered with. An empty table gives an empty result. Texts of any length are hashed whole.
Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import cut, dealt_join

#: Nodes of a run.
FANOUT = 16
HEX = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def framed(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def _parts(placed: DataFrame) -> DataFrame:
    """Rows sorted by ranges get part and k, their range and place in it, and are written."""
    at = placed.select("*", F.monotonically_increasing_id().alias("at"))
    return cut(at.select(*placed.columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("k")), "placed")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) in the order of the columns named."""
    placed = _parts(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row a range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(before, "part").withColumn(name, F.col("before") + F.col("k")).drop("part", "k", "before")


def placed_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaves(grp, key, leaf, ...): the same with tree (number of the group) and i, n (place in the
    group, and its leaves), and the groups (grp, tree, n)."""
    order = ["grp", "key", "leaf"]
    placed = _parts(leaves.repartitionByRange(*order).sortWithinPartitions(*order))
    sections = cut(placed.groupBy("part", "grp").agg(F.min("k").alias("first"), F.count("*").alias("size")), "sections")
    groups = cut(numbered(sections.groupBy("grp").agg(F.sum("size").alias("n")), ["grp"], "tree"), "groups")
    before = F.sum("size").over(Window.partitionBy("grp").orderBy("part")) - F.col("size")  # a row a range
    starts = sections.select("part", "grp", (before - F.col("first")).alias("start"))
    starts = starts.join(groups.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).select("part", "grp", "start", "tree", "n")
    starts = starts.withColumnsRenamed({"part": "p", "grp": "g"})
    met = placed.join(starts, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return met.withColumn("i", F.col("k") + F.col("start")).drop("p", "g", "part", "k", "start"), groups


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The nodes above leaves(tree, i, n, hash), one table (tree, i, n, kids, hash) for each level;
    n is the number of nodes of the tree at that level, kids the hashes of its run, joined."""
    out = []
    level = leaves
    while True:
        runs = level.where("n > 1").groupBy("tree", F.expr(f"i div {fanout}").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "hash"))).alias("run"), F.max("n").alias("n"))
        kids = F.array_join(F.transform("run", lambda x: x["hash"]), "").alias("kids")
        level = cut(runs.select("tree", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), kids).withColumn("hash", F.sha2("kids", 256)), "level")
        if level.isEmpty():
            return out
        out.append(level)


def _id(tree: Column | str, level: Column, i: Column | str) -> Column:
    return F.struct(F.col(tree).cast("long").alias("t") if isinstance(tree, str) else tree.cast("long").alias("t"), level.cast("int").alias("l"), (F.col(i) if isinstance(i, str) else i).cast("long").alias("i"))


def _top(tree: str, level: int, i: Column | str) -> Column:
    """A node's id; the one node that is left of a group's tree is a leaf of the upper tree (-1)."""
    return F.when((F.col("n") == 1) & (F.col(tree) >= 0), _id(F.lit(-1), F.lit(0), tree)).otherwise(_id(tree, F.lit(level), i))


def siblings(kids: str, at: Column) -> Column:
    """The run without its node `at`."""
    return F.concat(F.expr(kids).substr(F.lit(1), at * HEX), F.expr(kids).substr((at + 1) * HEX + 1, F.length(kids)))


def segments(tables: list[tuple[int, DataFrame]], root: tuple[int, int, int]) -> DataFrame:
    """(id, steps) of all nodes above the leaves, by pointer jumping: steps(at, sibs) lead to the root.

    tables: (level of the children, nodes with their kids)."""
    hops = []
    for level, table in tables:
        child = table.select(_top("tree", level + 1, "i").alias("anc"), "tree", "kids", F.col("i").alias("up"), F.explode(F.sequence(F.lit(0), F.expr(f"cast(length(kids) div {HEX} as int)") - 1)).alias("at"))
        hops.append(child.select(_id("tree", F.lit(level), F.col("up") * FANOUT + F.col("at")).alias("id"), "anc", F.array(F.struct("at", siblings("kids", F.col("at")).alias("sibs"))).alias("steps")))
    end = F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(root, ("long", "int", "long"), "tli", strict=True)])
    if not hops:
        return None
    nodes = hops[0]
    for h in hops[1:]:
        nodes = nodes.unionByName(h)
    nodes = cut(nodes, "segments")
    while not nodes.where(F.col("anc") != end).isEmpty():
        on = nodes.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("steps").alias("more"))
        moved = dealt_join(nodes.where(F.col("anc") != end), on, "anc", ["id"]).select("id", F.col("next").alias("anc"), F.concat("steps", "more").alias("steps"))
        nodes = cut(moved.unionByName(nodes.where(F.col("anc") == end)), "segments")
    return nodes.select("id", "steps")


def folded(steps: Column | str, leaf: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["sibs"].substr(F.lit(1), s["at"] * HEX), acc, s["sibs"].substr(s["at"] * HEX + 1, F.length(s["sibs"]))), 256))


def manifest(leaves: DataFrame) -> DataFrame:
    """Of leaves(grp, key, leaf, ...): the same with subroot, root and steps, the proof."""
    leaves = cut(leaves, "leaves")
    placed, groups = placed_leaves(leaves)
    placed = cut(placed.drop("grp"), "numbered")
    lower = levels(placed.select("tree", "i", "n", F.col("leaf").alias("hash")))
    lone = placed.where("n = 1").select("tree", F.col("leaf").alias("hash"))
    for level in lower:
        lone = lone.unionByName(level.where("n = 1").select("tree", "hash"))
    subroots = cut(lone.withColumnRenamed("hash", "subroot"), "subroots")
    count = groups.count()
    top = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("hash"))
    upper = levels(top)
    root = (upper[-1] if upper else top).select("hash").first()
    root = root and root[0]
    steps = segments([(k, t) for k, t in enumerate(lower) if k] + list(enumerate(upper)), (-1, len(upper), 0))
    # a run of leaves: its hashes, its own way to the root and its subroot
    runs = (lower[0] if lower else placed.where("false").select("tree", "i", "n", F.col("leaf").alias("kids"))).select("tree", F.col("i").alias("run"), "kids", _top("tree", 1, "i").alias("id"))
    runs = runs.unionByName(placed.where("n = 1").select("tree", F.lit(0).cast("long").alias("run"), F.lit(None).cast("string").alias("kids"), _top("tree", 0, "i").alias("id")))
    none = F.array().cast("array<struct<at int, sibs string>>")
    # a proof is thousands of bytes that compress to a hundred, so neither join may go by the size of a file
    runs = dealt_join(runs, subroots, "tree", ["run"])
    runs = runs.join(steps.hint("merge"), "id", "left").withColumn("steps", F.coalesce("steps", none)) if steps is not None else runs.withColumn("steps", none)
    rows = placed.withColumn("run", F.expr(f"i div {FANOUT}")).join(runs.drop("id").hint("merge"), ["tree", "run"])
    at = F.expr(f"cast(i % {FANOUT} as int)")
    own = F.when(F.col("kids").isNull(), F.col("steps")).otherwise(F.concat(F.array(F.struct(at.alias("at"), siblings("kids", at).alias("sibs"))), "steps"))
    return rows.withColumn("steps", own).withColumn("root", F.lit(root)).drop("tree", "run", "i", "n", "kids")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = docs["text"].cast("string")
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    leaves = docs.select(docs["source"].alias("grp"), docs["doc_id"].alias("key"), leaf_hash([*fields, text]).alias("leaf"), F.when(tampered, leaf_hash([*fields, F.translate(text, UPPER, UPPER.lower())])).alias("tampered"))
    m = manifest(leaves)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: s["sibs"]), ""), 256)
    out = m.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded("steps", F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels by recursion over all nodes of the level before; the way up of each leaf by a second recursion.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head, text,
    (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 5 = 0 AS hit FROM documents),
l AS (SELECT rid, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS bad, coalesce(hit, false) AS hit FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM l),
low AS (
  SELECT tree, 0 AS lv, i, n, leaf AS h, '' AS kids FROM p
  UNION ALL
  SELECT tree, any_value(lv) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i) FROM low WHERE n > 1 GROUP BY tree, i // 16),
sub AS (SELECT tree, h FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lv, tree AS i, (SELECT count(*) FROM sub) AS n, h, '' AS kids FROM sub
  UNION ALL
  SELECT any_value(lv) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i) FROM top WHERE n > 1 GROUP BY i // 16),
up AS (
  SELECT rid, tree, 0 AS lv, i, n, '' AS sibs, CASE WHEN hit THEN bad ELSE leaf END AS acc FROM p
  UNION ALL
  SELECT rid, u.tree, u.lv + 1, u.i // 16, k.n, sibs || left(k.kids, (u.i % 16) * 64) || substr(k.kids, (u.i % 16 + 1) * 64 + 1),
    sha256(left(k.kids, (u.i % 16) * 64) || acc || substr(k.kids, (u.i % 16 + 1) * 64 + 1)) FROM up u JOIN low k ON k.tree = u.tree AND k.lv = u.lv + 1 AND k.i = u.i // 16 WHERE u.n > 1),
upper AS (
  SELECT rid, 0 AS lv, tree AS i, (SELECT count(*) FROM sub) AS n, sibs, acc FROM up WHERE n = 1
  UNION ALL
  SELECT rid, u.lv + 1, u.i // 16, k.n, sibs || left(k.kids, (u.i % 16) * 64) || substr(k.kids, (u.i % 16 + 1) * 64 + 1),
    sha256(left(k.kids, (u.i % 16) * 64) || acc || substr(k.kids, (u.i % 16 + 1) * 64 + 1)) FROM upper u JOIN top k ON k.lv = u.lv + 1 AND k.i = u.i // 16 WHERE u.n > 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, t.h AS root, sha256(u.sibs) AS proof_sha256, u.acc AS folded_root, u.acc = t.h AS verified
FROM p JOIN sub USING (tree) JOIN upper u ON u.rid = p.rid AND u.n = 1 JOIN top t ON t.n = 1
"""
