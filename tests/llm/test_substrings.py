import random

import pytest

from bundlelens.llm import substrings


def brute(rows, width):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - width + 1):
                s = tuple(w[i : i + width])
                first[s] = min(first.get(s, k), k)
    out = []
    for k, w in words:
        gone = set()
        if k is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < k:
                    gone |= set(range(i, i + width))
        out.append((str(k), len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("period", range(2, 60))
def test_cover_has_every_difference(period):
    d = substrings.difference_cover(period)
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gé hi".split()) + str(rng.randrange(30))
    passages = [[word() for _ in range(n)] for n in (50, 51, 64, 120, 49)]
    rows = [(None, None), (4, None), (6, ""), (5, " ".join(passages[3])), (5, " ".join(passages[3])), (None, " ".join(passages[3])), (700, "x " * 300), (2, "x\t" * 120)]
    for k in range(40):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(40))] + rng.choice(passages)
        rows.append((1000 - k, "\n".join(w)))
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, row int, starts string").repartition(4)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs, "doc_id", "text").collect())
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_other_widths_and_no_rows(spark):
    rows = [(1, "a b c d e f g"), (2, "x c d e f y"), (3, "c d e q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs, "doc_id", "text", 3, 2).collect())
    assert got == brute(rows, 3)
    assert substrings.without_repeats(docs.limit(0), "doc_id", "text").count() == 0
