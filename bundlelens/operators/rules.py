"""Log rules and condition rules as Columns: rules are small and come as lists of dicts, the
data is scanned once whatever their number."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as re_constants
from re import _parser as re_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.functions.text import SEVERITIES

FLAGS = {"i": "(?i)", "m": "(?m)", "s": "(?s)", "u": "(?u)", "g": ""}
LOG_FILE = r"\.(log|log\.\d+|\d+)$"


def load_rules(path: str | None, defaults: dict) -> dict:
    """Rules of a YAML file; a section that it has replaces the default one, no file leaves all defaults."""
    import yaml

    if path is None:
        return defaults
    try:
        with open(path) as f:
            given = yaml.safe_load(f) or {}
    except FileNotFoundError:
        return defaults
    return {k: given.get(k, defaults.get(k)) for k in {*given, *defaults}}


def check_rules(spark: SparkSession, rules: dict) -> None:
    """Compile every regex on the JVM and every predicate before a job starts; bad ones raise ValueError."""
    for r in rules.get("logs", {}).get("rules", []):
        if r.get("severity") not in SEVERITIES:
            raise ValueError(f"{r.get('id')}: unknown severity")
        try:
            spark.range(1).select(F.lit("").rlike(rule_regex(r))).collect()
        except Exception as e:
            raise ValueError(f"{r.get('id')}: bad regex") from e
    for r in rules.get("conditions", {}).get("rules", []):
        predicate(r["when"], {})
        try:
            spark.range(1).select(predicate(r["when"], {})).collect()
        except Exception as e:
            raise ValueError(f"{r.get('id')}: bad condition") from e


def rule_regex(rule: dict) -> str:
    return "".join(FLAGS[f] for f in rule.get("flags", "")) + rule["regex"]


def in_log_scope(path: Column, include: list[str]) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    return reduce(lambda a, b: a | b, [p.contains(x) for x in include]) & p.rlike(LOG_FILE)


def log_priority(path: Column, priorities: list[dict], default: int = 1000) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    found = [F.when(p.contains(x["pattern"]), int(x["priority"])) for x in priorities]
    return F.least(*found, F.lit(default)) if found else F.lit(default)


def required_literals(regex: str, least: int = 2) -> list[str] | None:
    """Texts of which every match of a regex contains one, whatever its case; None if there is no such set of texts of
    `least` characters or more, or the pattern isn't understood."""
    if re.search(r"\(\?[a-z]*u", regex):
        return None  # matches letters that lower-casing keeps apart
    try:
        return _required(re_parser.parse(regex), least)
    except (re.error, OverflowError, AttributeError):
        return None


def _required(tokens, least: int) -> list[str] | None:
    """The best set of a sequence of parsed tokens: the one whose shortest text is longest."""
    found, run = [], ""
    for op, value in [*tokens, (None, None)]:
        if op is re_constants.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if len(run) >= least:
            found.append([run])
        run, inner = "", None
        if op is re_constants.SUBPATTERN:
            inner = _required(value[3], least)
        elif op is re_constants.BRANCH:
            each = [_required(b, least) for b in value[1]]
            inner = [x for e in each for x in e] if all(each) else None
        elif op in (re_constants.MAX_REPEAT, re_constants.MIN_REPEAT) and value[0] > 0:
            inner = _required(value[2], least)
        if inner:
            found.append(inner)
    return max(found, key=lambda texts: min(map(len, texts)), default=None)


def matching_rules(line: Column, rules: list[dict], low: Column | None = None) -> Column:
    """Ids of all rules whose regex is in the line: one array column, one pass over the lines. low: the line in lower
    case; a rule's regex then runs on lines only that hold one of the texts it can't match without."""

    def test(r: dict) -> Column:
        texts = required_literals(r["regex"]) if low is not None and "u" not in r.get("flags", "") else None
        full = line.rlike(rule_regex(r))
        return reduce(lambda a, b: a | b, [low.contains(x) for x in texts]) & full if texts else full

    return F.filter(F.array(*[F.when(test(r), F.lit(r["id"])) for r in rules]), lambda x: x.isNotNull())


def log_matches(lines: DataFrame, line: str, rules: list[dict]) -> DataFrame:
    """A row for each line and rule that matches it, with the column rule_id."""
    low = lines.withColumn("__low", F.lower(line))
    return low.withColumn("rule_id", F.explode(matching_rules(F.col(line), rules, F.col("__low")))).drop("__low")


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    cols = ("id", "severity", "category", "title", "description")
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rules], ", ".join(f"{c} string" for c in cols)).withColumnRenamed("id", "rule_id")


def log_findings(lines: DataFrame, spark: SparkSession, rules: list[dict], by: str, path: str, line_no: str, line: str, evidence: int = 4, width: int = 220, priority: Column | None = None) -> DataFrame:
    """Per (by, rule): count, first path and the first `evidence` lines in order of (priority, path, line).

    The lines are scanned once: what the rules leave of them is written, cut to `width`, and read
    for the counts and for the first lines. First lines are taken per path before they are
    ranked per bundle, so a bundle that holds most lines is ranked by its first rows of each
    path, not by all of them.
    """
    from pyspark.sql import Window

    from bundlelens.functions.text import truncate
    from bundlelens.session import written

    m = log_matches(lines.withColumn("prio", priority if priority is not None else F.lit(0)), line, rules)
    m = written(m.select(by, "rule_id", "prio", path, line_no, truncate(F.trim(F.col(line)), width).alias("excerpt")), "matches")
    per_path = m.groupBy(by, "rule_id", "prio", path).agg(F.count("*").alias("n"), F.min(F.col(line_no)).alias("at"))
    totals = per_path.groupBy(by, "rule_id").agg(F.sum("n").alias("count"), F.min(F.struct("prio", F.col(path), "at")).alias("first"))
    in_path = Window.partitionBy(by, "rule_id", path).orderBy(line_no)
    few = m.withColumn("k", F.row_number().over(in_path)).where(F.col("k") <= evidence)
    in_all = Window.partitionBy(by, "rule_id").orderBy("prio", path, line_no)
    few = few.withColumn("k", F.row_number().over(in_all)).where(F.col("k") <= evidence)
    ref = F.struct(F.col("k"), F.col(path).alias("path"), F.col(line_no).alias("line"), "excerpt")
    refs = few.groupBy(by, "rule_id").agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    out = totals.join(refs, [by, "rule_id"]).join(F.broadcast(rule_table(spark, rules)), "rule_id")
    return out.select(by, F.col("rule_id").alias("id"), "severity", "category", "title", "description", F.col("refs.excerpt").alias("evidence"), F.transform("refs", lambda r: F.struct(r["path"].alias("path"), r["line"].alias("lineStart"), r["excerpt"].alias("excerpt"))).alias("evidence_refs"), "count", F.col("first")[path].alias("path"))


def _field(name: str, facts: dict[str, Column]) -> Column:
    """A fact; a missing one, like a null, is the empty text."""
    return F.coalesce(F.trim(facts[name].cast("string")), F.lit("")) if name in facts else F.lit("")


def predicate(when: str, facts: dict[str, Column]) -> Column:
    """`a == b; c in x|y; d notIn x; e matches re; f exists; g notEmpty`, all of which must hold."""
    terms = []
    for part in filter(None, (p.strip() for p in when.split(";"))):
        word = part.split()
        name, op = word[0], word[1] if len(word) > 1 else ""
        value = part[part.index(op) + len(op) :].strip() if op else ""
        f, options = _field(name, facts), [v.strip() for v in value.split("|")]
        if op == "==":
            terms.append(f == value)
        elif op == "!=":
            terms.append(f != value)
        elif op == "in":
            terms.append(f.isin(options))
        elif op == "notIn":
            terms.append(~f.isin(options))
        elif op == "matches":
            terms.append(f.rlike(f"(?i){value}"))
        elif op == "exists":
            terms.append(facts[name].isNotNull() if name in facts else F.lit(False))
        elif op == "notEmpty":
            terms.append(f != "")
        else:
            raise ValueError(f"unknown predicate: {part}")
    if not terms:
        raise ValueError("a condition rule needs a predicate")
    return reduce(lambda a, b: a & b, terms)


def render(template: str, facts: dict[str, Column]) -> Column:
    """{field} becomes the fact's value, or nothing."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), _field(name, facts)]
    return F.concat(*out, F.lit(rest))


def _pairs(text: str, part: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in p.split(part, 1)) for p in text.split(",") if part in p] if text else []


def evidence(spec: str, facts: dict[str, Column]) -> Column:
    """`Label=field,...` as `Label: value` of the fields that aren't blank, in order."""
    items = [F.when(_field(f, facts) != "", F.concat(F.lit(f"{label}: "), _field(f, facts))) for label, f in _pairs(spec, "=")]
    return F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")


def severity(rule: dict, facts: dict[str, Column]) -> Column:
    """`field=value:severity,...`: the first that equals wins over the rule's own."""
    out = F.lit(rule["severity"])
    for name, rest in reversed(_pairs(rule.get("severityOverrides", ""), "=")):
        value, _, level = rest.rpartition(":")
        out = F.when(_field(name, facts) == value, level).otherwise(out)
    return out


def first_condition(rules: list[dict], resource: str, facts: dict[str, Column]) -> Column:
    """The finding (id, severity, category, title, description, evidence) of the first rule of a
    resource kind, in file order, whose predicates hold; null if none does."""
    found = []
    for r in (r for r in rules if r["resource"] == resource):
        finding = F.struct(render(r["id"], facts).alias("id"), severity(r, facts).alias("severity"), F.lit(r["category"]).alias("category"), render(r["title"], facts).alias("title"), render(r["description"], facts).alias("description"), evidence(r.get("evidence", ""), facts).alias("evidence"))
        found.append(F.when(predicate(r["when"], facts), finding))
    return F.coalesce(*found)
