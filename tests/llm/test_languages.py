from collections import Counter

from pyspark.sql import functions as F

from bundlelens.llm import languages
from tests.conftest import SF


def brute_grams(text):
    s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    s = " " + " ".join(s.split()) + " "
    if not s.strip():
        return Counter()
    return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " ")


def code(g):
    out = 0
    for c in g:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def top(counter, k):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))[:k]]


def test_equals_brute_force(spark):
    rows = [(1, "The cat and the dog", "en"), (2, "Der Hund und die Katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "fr"), (5, "no language", None), (None, "der und die", None), (6, "42 -- !", "en"), (7, "", "en"), (8, "ÉÀ straße İx", "fr"), (8, "ÉÀ straße İx", "fr"), (9, "the " * 9000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "und") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    profiles = languages.learn(docs, "text", "lang", top=20)
    sums = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            sums.setdefault(lang, Counter()).update(brute_grams(t))
    want = {lang: {g: i for i, g in enumerate(top(c, 20))} for lang, c in sums.items()}
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in languages.identify(docs, "text", profiles, [F.col("doc_id")]).collect())
    expected = []
    for k, t, _ in rows:
        doc = top(brute_grams(t), 20)
        d = sorted((sum(abs(i - p.get(g, 20)) if g in p else 20 for i, g in enumerate(doc)), lang) for lang, p in want.items())
        expected.append((str(k), d[0][1], round(1 - d[0][0] / (20 * len(doc)), 9)) if doc else (str(k), "und", 0.0))
    assert got == sorted(expected)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = languages.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 200 and r.a > 0.97


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    p = languages.learn(docs, "text", "lang")
    assert [tuple(r) for r in languages.identify(docs, "text", p, [F.col("doc_id")]).collect()] == [(1, "und", 0.0)]
    assert languages.identify(docs.limit(0), "text", p, [F.col("doc_id")]).count() == 0
