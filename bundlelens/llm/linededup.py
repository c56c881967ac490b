"""Operator 9: line dedup by a log-template tree, with DataFrame functions.

The tree has a fixed depth: a line goes by its number of tokens, then by its first `depth`
tokens, to a leaf. Tokens that hold a digit are variable fields (<*>) from the start. A leaf may
hold several templates. Of each position behind the leading tokens the documents are counted that
have a token there. A line's own template is the coarsest one that keeps enough of it: its
tokens are ordered by those counts, and with them the share (a half, a quarter, ... of the leaf's
lines, or all) that at least `constant` of the positions reach; tokens which that share has are
constants, all others variable fields. Lines of one template find the same share, as their
constants are counted in all of them. A line without enough tokens that min_docs documents have
is a template by itself. Lines whose template comes in min_docs documents or more are dropped, but
for the template's first line (smallest key, then line number), so that no content is lost.

Leading tokens are the same in all of a leaf and say nothing, nor does <*>: neither is
counted as a constant, and lines of variable fields only (rows of numbers) are kept.

Kinds of lines are counted before anything is compared, so what is shuffled of a line that a
third of all documents hold is a row a task; kinds and occurrences carry 128-bit digests, and the
text is shuffled only of lines whose leaf recurs. The tokens of a crowded leaf are joined with
their counts by a salted key.

Semantics. Lines of fewer than min_tokens tokens have too little structure and are kept. Null
text stays null. Rows equal in key and text are one document; a row with a null key is kept
whole and counts nowhere. An empty table gives an empty result. Columns other than key and text
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import cut

ANY = "<*>"
DEPTH, MIN_TOKENS, MIN_DOCS, CONSTANT = 3, 4, 10, 0.6
#: Parts into which the lines of one (leaf, position, token) are dealt.
SALTS = 8


def masked_lines(text: Column) -> Column:
    """The lines of a text with single blanks between tokens, tokens with a digit as variable fields.

    Most lines need neither, and a look for a character costs much less than a replacement; two
    passes over the lines, so that the second one's uses of a line don't repeat the first.
    """
    odd = lambda x: x.contains("  ") | x.contains("\t") | x.contains("\r") | x.contains("\f") | x.contains("\x0b")
    even = F.transform(F.split(text, "\n"), lambda x: F.trim(F.when(odd(x), F.regexp_replace(x, "[ \t\r\f\x0b]+", " ")).otherwise(x)))
    return F.transform(even, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "[^ ]*[0-9][^ ]*", ANY)).otherwise(x))


def _enough(min_tokens: int) -> Column:
    """Lines of enough tokens, one of them literal."""
    enough = F.substring_index("line", " ", min_tokens - 1) != F.col("line")
    return enough & ~(F.col("line").startswith(ANY) & F.col("line").rlike(r"^<\*>( <\*>)*$"))


def _leaf(depth: int) -> Column:
    """128 bits of a line's way through the tree: its number of tokens and its first tokens."""
    blanks = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    return F.unhex(F.md5(F.concat_ws(" ", (blanks + 1).cast("string"), F.substring_index("line", " ", depth)).cast("binary")))


def leaf_templates(kinds: DataFrame, constant: float, behind: int, min_docs: int) -> DataFrame:
    """line, template (digests) of the kinds of lines (leaf, total, line, docs) of recurring
    leaves that have enough constants behind their `behind` leading tokens."""
    key, line = ["leaf", "pos", "token"], ["digest", "leaf", "total", "n"]
    tokens = kinds.select("leaf", "total", "docs", F.unhex(F.md5("line")).alias("digest"), F.split("line", " ").alias("t")).withColumn("n", F.size("t"))
    at = tokens.select(*line, "docs", F.posexplode("t").alias("pos", "token")).where((F.col("pos") >= behind) & (F.col("token") != ANY))
    seen = cut(at.groupBy(*key).agg(F.sum("docs").alias("seen")).where(F.col("seen") >= min_docs), "tokens")
    salted = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = at.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"])
    own = F.sort_array(F.collect_list(F.struct("seen", "pos", "token")), False)  # a line's tokens, the most frequent first
    # the number of positions that must be constant, rounded up
    k = each.groupBy(*line).agg(own.alias("own")).withColumn("need", F.expr(f"({round(100 * constant)} * (n - {behind}) + 99) div 100")).where(F.size("own") >= F.col("need"))
    # halvings of the leaf's lines until the share is no more than the count of the last constant needed
    k = k.withColumn("over", F.expr("(total - 1) div own[need - 1].seen"))
    k = k.withColumn("share", F.expr("shiftleft(1L, if(over > 0, length(bin(over)), 0))"))
    fixed = F.array_sort(F.transform(F.filter("own", lambda x: x["seen"] * F.col("share") >= F.col("total")), lambda x: F.struct(x["pos"], x["token"])))
    template = F.array_join(F.transform(fixed, lambda x: F.concat_ws(" ", x["pos"].cast("string"), x["token"])), "\n")
    return k.select(F.col("digest").alias("line"), F.unhex(F.md5(F.concat("leaf", template.cast("binary")))).alias("template"))


def recurring_lines(docs: DataFrame, key: str, text: str, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """doc_id, row, dropped (numbers of the lines to drop, from 0)."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("row"), docs[text].cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    digest = F.unhex(F.md5("line"))
    # the distinct kinds of lines of each row
    per_doc = rows.select(F.explode(F.array_distinct(masked_lines(F.col("text")))).alias("line")).where(_enough(min_tokens))
    kinds = cut(per_doc.groupBy(_leaf(depth).alias("leaf"), digest.alias("line")).agg(F.count("*").alias("docs")), "kinds")
    leaves = cut(kinds.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count("*").alias("kinds")).where((F.col("total") >= min_docs) & (F.col("kinds") > 1)).drop("kinds"), "leaves")
    # only lines of recurring leaves are looked at by their tokens
    told = per_doc.select("line", _leaf(depth).alias("leaf")).join(leaves, "leaf").groupBy("leaf", "total", "line").agg(F.count("*").alias("docs"))
    general = cut(leaf_templates(cut(told, "told"), constant, depth, min_docs), "templates")
    own = kinds.where(F.col("docs") >= min_docs).join(general, "line", "left_anti").select("line", F.col("line").alias("template"))
    known = cut(own.unionByName(general), "known")
    lines = rows.select("doc_id", "row", F.posexplode(masked_lines(F.col("text"))).alias("no", "line")).where(_enough(min_tokens))
    seen = cut(lines.select("doc_id", "row", "no", digest.alias("line")).join(known, "line").drop("line"), "occurrences")
    per = seen.select("template", "doc_id", "row").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    first = cut(seen.groupBy("template").agg(F.min(F.struct("doc_id", "row", "no")).alias("first")).join(per, "template").select("template", "first"), "first")
    gone = seen.join(first, "template").where(F.struct("doc_id", "row", "no") != F.col("first"))
    return cut(gone.groupBy("doc_id", "row").agg(F.collect_set("no").alias("dropped")), "dropped")


def without_recurring_lines(docs: DataFrame, key: str, text: str, **limits) -> DataFrame:
    """n_lines, n_dropped, doc (the row as it was, as a struct) and kept (the text that is left)."""
    gone = recurring_lines(docs, key, text, **limits)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("row"))
    # as a corpus grows the dropped lines do too: joined by sorting at every size
    joined = rows.join(gone.hint("merge"), ["doc_id", "row"], "left").withColumn("lines", F.split(F.col("doc")[text].cast("string"), "\n"))
    left = F.filter("lines", lambda x, i: ~F.array_contains(F.col("dropped"), i))
    kept = F.when(F.col("dropped").isNull(), F.col("doc")[text].cast("string")).otherwise(F.array_join(left, "\n"))
    sizes = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(n) for c, n in (("lines", "n_lines"), ("dropped", "n_dropped"))]
    return joined.select(*sizes, F.col("doc"), kept.alias("kept"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = without_recurring_lines(docs.select("doc_id", "text"), "doc_id", "text")
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM d),
m AS (SELECT *, regexp_replace(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{ANY}', 'g') AS masked FROM l),
t AS (SELECT *, string_split(masked, ' ') AS toks FROM m WHERE len(string_split(masked, ' ')) >= {MIN_TOKENS} AND len(list_filter(string_split(masked, ' '), lambda x: x <> '{ANY}')) > 0),
k AS (SELECT masked, any_value(toks) AS toks, any_value(len(toks)) AS n, array_to_string(any_value(toks)[1:{DEPTH}], ' ') AS lead, count(DISTINCT doc_id) AS docs
      FROM t GROUP BY masked),
leaf AS (SELECT n, lead, sum(docs) AS total FROM k GROUP BY n, lead HAVING sum(docs) >= {MIN_DOCS} AND count(*) > 1),
kt AS (SELECT k.masked, k.n, k.lead, k.docs, leaf.total, unnest(k.toks) AS token, unnest(range(k.n)) AS pos FROM k JOIN leaf ON k.n = leaf.n AND k.lead = leaf.lead),
c AS (SELECT n, lead, pos, token, sum(docs) AS seen FROM kt WHERE pos >= {DEPTH} AND token <> '{ANY}' GROUP BY n, lead, pos, token HAVING sum(docs) >= {MIN_DOCS}),
q AS (SELECT masked, list_reverse_sort(list(seen))[need] AS least FROM
      (SELECT kt.masked, c.seen, CAST(({round(100 * CONSTANT)} * (kt.n - {DEPTH}) + 99) // 100 AS BIGINT) AS need FROM kt JOIN c ON kt.n = c.n AND kt.lead = c.lead AND kt.pos = c.pos AND kt.token = c.token)
      GROUP BY masked, need HAVING count(*) >= need),
h AS (SELECT q.masked, CASE WHEN (any_value(kt.total) - 1) // q.least > 0 THEN length(bin(CAST((any_value(kt.total) - 1) // q.least AS BIGINT))) ELSE 0 END AS halvings FROM q JOIN kt ON q.masked = kt.masked GROUP BY q.masked, q.least),
g AS (SELECT kt.masked, string_agg(CASE WHEN kt.pos < {DEPTH} OR c.seen * CAST(pow(2, h.halvings) AS HUGEINT) >= kt.total THEN kt.token ELSE '{ANY}' END, ' ' ORDER BY kt.pos) AS template
      FROM kt JOIN h ON kt.masked = h.masked LEFT JOIN c ON kt.n = c.n AND kt.lead = c.lead AND kt.pos = c.pos AND kt.token = c.token
      GROUP BY kt.masked),
o AS (SELECT t.doc_id, t.no, coalesce(g.template, t.masked) AS template FROM t LEFT JOIN g ON t.masked = g.masked),
r AS (SELECT template, min(doc_id) AS first_doc FROM o GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
f AS (SELECT r.template, r.first_doc, min(o.no) AS first_no FROM r JOIN o ON o.template = r.template AND o.doc_id = r.first_doc GROUP BY r.template, r.first_doc),
gone AS (SELECT o.doc_id, o.no FROM o JOIN f ON o.template = f.template WHERE NOT (o.doc_id = f.first_doc AND o.no = f.first_no)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.no) AS n_dropped, string_agg(CASE WHEN gone.no IS NULL THEN line END, chr(10) ORDER BY l.no) AS text
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.no = gone.no GROUP BY l.doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id
"""
