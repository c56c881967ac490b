from bundlelens.llm import linededup
from bundlelens.llm.linededup import without_recurring_lines


def run(spark, rows, **limits):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, no int, line string").repartition(3)
    out = [(r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in without_recurring_lines(df, "doc_id", "text", **limits).collect()]
    return sorted(out, key=str)


def test_variable_fields_are_generalised(spark):
    rows = [(k, f"Unique body of document {'abcdefgh'[k]} here\nUser {'ann bob cy dee eve fay gus hal'.split()[k]} logged in from host h{k}") for k in range(8)]
    rows += [(50, "User a b c d e f"), (51, "x\nshort line\n\nshort line")]
    got = run(spark, [(k, t.replace("User", "The user named")) for k, t in rows], min_docs=5)
    for k, n, dropped, kept in got:
        if k < 8:
            body = f"Unique body of document {'abcdefgh'[k]} here"
            # the bodies differ in one of six tokens too: the first document keeps both lines
            assert dropped == (0 if k == 0 else 2) and (k == 0) == (body in kept)
        else:
            assert dropped == 0


def test_prose_with_common_leading_tokens_is_kept(spark):
    rows = [(k, " ".join(["in the end", *[f"{w}{c}" for w in "pqrstu" for c in "abcdefghijkl"[k]]])) for k in range(12)]
    assert all(r[2] == 0 for r in run(spark, rows, min_docs=5))


def test_counts_are_of_documents_and_the_first_stays(spark):
    line = "all rights are reserved here"
    rows = [(3, f"{line}\n{line}\nown text of three x"), (1, f"\n{line}"), (2, f"{line}\ntail"), (9, "other " * 20), (None, line), (7, None), (8, ""), (2, f"{line}\ntail")]
    got = {str(r[0]): r for r in run(spark, rows, min_docs=3)}
    assert got["1"][2:] == (0, f"\n{line}") and got["3"][2:] == (2, "own text of three x") and got["2"][2:] == (1, "tail")
    assert got["None"][2:] == (0, line) and got["7"] == (7, 0, 0, None) and got["8"] == (8, 1, 0, "")
    assert all(r[2] == 0 for r in run(spark, rows, min_docs=4))


def test_long_text_and_no_rows(spark):
    rows = [(k, "\n".join(f"line word{chr(97 + i % 26)} of text {chr(97 + i // 26 % 26)}{chr(97 + k)}" for i in range(20_000))) for k in range(2)]
    assert [r[1] for r in run(spark, rows, min_docs=3)] == [20_000, 20_000]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert without_recurring_lines(df, "doc_id", "text").count() == 0


def test_limits_are_those_of_the_sql():
    assert (linededup.DEPTH, linededup.MIN_TOKENS, linededup.MIN_DOCS, linededup.CONSTANT) == (3, 4, 10, 0.6)


def test_lines_that_only_begin_alike_and_rows_of_numbers_are_kept(spark):
    word = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch".split()
    rows = [(k, f"this is the {w}\nthis is the {w} tree\n{k} {k} {k} {k}\nsigned by the one author today") for k, w in enumerate(word)]
    got = run(spark, rows)
    assert [r[2] for r in sorted(got)] == [0] + [1] * 11
    assert all(r[3].startswith(rows[r[0]][1].rsplit("\n", 1)[0]) for r in got)


def test_a_leaf_may_hold_several_templates(spark):
    names = "ann bob cy dee eve fay gus hal ivo jo kim lee".split()
    one = [(k, f"the worker thread {n} has fetched its page from the store") for k, n in enumerate(names)]
    two = [(100 + k, f"the worker thread {n} was stopped by order of its owner") for k, n in enumerate(names)]
    alone = [(200, "the worker thread pool is kept small for reasons of economy")]
    got = {r[0]: r[2] for r in run(spark, one + two + alone)}
    assert sum(got.values()) == 22 and got[0] == got[100] == got[200] == 0
    # unequal shares of the leaf, and a token that both have at one place
    more = [(300 + k, f"the worker thread x{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abc'[k // 26]} has slept for want of any work") for k in range(60)]
    got = {r[0]: r[2] for r in run(spark, one + two + more)}
    assert sum(got.values()) == 11 + 11 + 59
