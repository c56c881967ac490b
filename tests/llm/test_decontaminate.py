
from bundlelens.llm import decontaminate as D
from tests.conftest import SF

ITEM = "A train leaves Paris at 9 and travels 120 km to Lyon. How long does it take Anna Smith to arrive if she rides 60 km per hour?"


def found(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.contamination(docs, "doc_id", "text", bench, "item_id", "text", **more).collect()}


def test_templates():
    t = D.Templates()
    p = t.parse([ITEM.encode(), b"3 kg, 5km of New York City! Bob said: $5 or 10%.\n7\nOf"])
    tokens = [t.token(p, i) for i in range(len(p["hash"]))]
    assert " ".join(tokens[:14]) == "a train leaves <name> at <num> and travels <qty> to <name> how long does"
    assert [(t.token(p, i), t.value(p, i)) for i in range(len(tokens)) if p["doc"][i] == 1] == [("<qty>", "3kg"), ("<qty>", "5km"), ("of", "of"), ("<name>", "New York City"), ("bob", "bob"), ("said", "said"), ("<qty>", "$5"), ("or", "or"), ("<qty>", "10%"), ("<num>", "7"), ("of", "of")]


def test_reparameterised_copies_are_found_and_contradictions_are_not(spark):
    same = "Intro words here. " + ITEM + " More."
    other = "Intro. " + ITEM.replace("Paris", "Rome").replace("Lyon", "Bari").replace("9", "7").replace("120", "300").replace("60", "50").replace("Anna Smith", "Bo")
    clash = other.replace("Bari", "Rome")  # two of the item's names become one
    half = "Something else. " + " ".join(ITEM.split()[:10])
    for bound in (1_000_000, 0):
        got = found(spark, [same, other, clash, half, None, "", "plain text of no use"], [ITEM, None, "", "too short"], broadcast_windows=bound)
        assert set(got) == {(0, 0), (1, 0)}
        assert got[0, 0].exact and not got[1, 0].exact and got[0, 0].share == 1


def test_null_keys_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "Intro. " + ITEM, 1, 2, "t"), (4, ITEM, 1, 2, "t"), (4, ITEM, 1, 2, "t"), (4, "nothing of it", 1, 2, "t")], "doc_id long, text string, key int, h int, template string")
    items = spark.createDataFrame([(7, ITEM, 0), (None, ITEM, 0)], "item_id long, text string, row int")
    for bound in (1_000_000, 0):
        got = D.contamination(docs, "doc_id", "text", items, "item_id", "text", broadcast_windows=bound).collect()
        assert sorted((str(r.doc_id), r.item_id, r.share) for r in got) == [("4", 7, 1.0), ("None", 7, 1.0)]


def test_short_items_and_long_texts(spark):
    item = "which colour is the sky"
    got = found(spark, ["w " * 50_000 + item + " w" * 10, "which colour is the sea"], [item])
    assert set(got) == {(0, 0)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert D.contamination(docs, "doc_id", "text", full, "doc_id", "text").count() == 0
    assert D.contamination(full, "doc_id", "text", items, "item_id", "text").count() == 0
    twice = full.union(full)
    assert [tuple(r)[:2] for r in D.contamination(twice, "doc_id", "text", full, "doc_id", "text").collect()] == [(1, 1)]


def test_equals_brute_force_on_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    t = D.Templates()

    def tokens(text):
        p = t.parse([text.encode()])
        return [t.token(p, i) for i in range(len(p["hash"]))]

    docs = [(k, tokens(x)) for k, x in docs]
    want = set()
    for item, x in items:
        w = tokens(x)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)] or [tuple(w)]
        for doc, d in docs:
            size = len(grams[0])
            at = {}
            for i in range(len(d) - size + 1):
                at.setdefault(tuple(d[i : i + size]), []).append(i)
            shifts = {}
            for i, g in enumerate(grams):
                for j in at.get(g, []):
                    shifts.setdefault(j - i, set()).add(i)
            if any(len(s) >= len(grams) / 2 for s in shifts.values()):
                want.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in D.op2_decontamination(spark, SF).collect()} == want
    assert len(want) > 20


def test_items_of_few_words_and_items_with_a_word_put_in(spark):
    numbers = "Compute the sum of 3 5 7 9 11 13 15 17 19 21"
    only = "1 2 3 4 5 6 7 8 9 10 Alpha"
    words = ITEM.split()
    more = " ".join([*words[:13], "exactly", *words[13:]])
    for bound in (1_000_000, 0):
        got = found(spark, ["Well. " + numbers + " now", "see " + only, "see " + only.replace("7", "70"), "Intro. " + more], [numbers, only, ITEM], broadcast_windows=bound)
        assert set(got) == {(0, 0), (1, 1), (3, 2)}
        assert got[0, 0].share == 1 and got[1, 1].exact and got[3, 2].share < 1


def test_numbers_may_meet_and_part_but_names_may_not(spark):
    items = ["Tom has 3 apples and 5 pears in a basket, how much fruit does he hold in all", "Take 2 apples out of 2 baskets and count what is left of the fruit for Jane Roe"]
    texts = [items[0].replace("3", "4").replace("5", "4"), items[1].replace("2", "3", 1).replace("2", "7"), items[1].replace("Jane Roe", "Bo Li")]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1)}
    assert not any(r.exact for r in got.values())
