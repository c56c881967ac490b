import random

import xxhash
from pyspark.sql import functions as F

from bundlelens.llm import setjoin, simhash
from bundlelens.llm.components import components


def brute_fp(text, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    n = len(fps)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice("Alpha beta gamma Delta ÉTÉ x1".split()) + str(rng.randrange(40)) for _ in range(120))
    texts = [None, "", " \t\n", "One", "two words", "A b C"] + [base] * 3 + [base.replace("x1", f"y{k}", 1) for k in range(6)] + [" ".join(str(rng.random()) for _ in range(30)) for _ in range(40)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, "doc_id", "text", 3).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i].fp for i in range(len(texts))] == [signed(f) for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


def test_crowded_entries_lose_no_link(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(150):
            f = c
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    at = {signed(f): i for i, f in enumerate(fps)}
    want = brute_components(fps)
    for paired in (2, 10, 10_000):
        links = simhash.fingerprint_links(df, paired)
        assert links.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) > 2).count() == 0
        pairs = spark.createDataFrame([(at[r.fa], at[r.fb]) for r in links.collect()], "a long, b long")
        label = {r.node: r.component for r in components(pairs).collect()}
        assert [label.get(i, i) for i in range(len(fps))] == want


def test_components_of_a_path_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    random.Random(0).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs, "doc_id", "text", 3).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0), "doc_id", "text", 3).count() == 0


def shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_near_copies_beyond_two_bits_are_grouped(spark):
    rng = random.Random(9)
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        words = said(200)
        for copy in range(3):
            w = list(words)
            for at in rng.sample(range(10, 190), copy):
                w[at] = f"new{k}x{at}"
            rows.append((10 * k + copy, " ".join(w)))
            if copy:
                assert len(shingles(rows[-1][1]) & shingles(" ".join(words))) >= 0.8 * len(shingles(rows[-1][1]) | shingles(" ".join(words)))
                want[10 * k + copy] = 10 * k
    rows += [(1000 + k, " ".join(said(40))) for k in range(20)] + [(2000, None), (2001, "")]
    half = said(100)
    rows += [(3000, " ".join(half + said(100))), (3001, " ".join(half + said(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs, "doc_id", "text", (3, 5)).collect()}
    assert got == want | {2001: 2000}


def test_bands_of_many_sets_lose_no_link(spark):
    rng = random.Random(1)
    chain = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(chain[k : k + 50])) for k in range(10)] + [(100 + k, " ".join(f"v{rng.randrange(900)}" for _ in range(30))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = simhash.sketches(docs, "doc_id", "text", 5)
    links = simhash.similar_links(docs, "doc_id", "text", found, 5, 80)
    assert {r.node: r.component for r in components(links).collect()} == {k: 0 for k in range(10)}


def test_texts_of_one_key_are_rows_of_their_own(spark):
    said = lambda c: " ".join(f"{c}{k}" for k in range(50))
    docs = spark.createDataFrame([(5, said("a"), 1), (5, said("b"), 2), (5, said("b"), 3), (9, said("a"), 4), (9, said("c"), 5), (11, said("c") + " more", 6)], "doc_id long, text string, row int")
    got = simhash.near_duplicate_groups(docs, "doc_id", "text", (3, 5)).select("doc_id", "row").collect()
    gone = {(r.doc_id, r.row) for r in got}
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").distinct().collect()
    left = sorted((r.doc_id, r.text[0]) for r in rows if (r.doc_id, r.h) not in gone)
    assert len(left) == 3 and {c for _, c in left} == {"a", "b", "c"} and (5, "a") in left


def test_very_long_texts(spark):
    text = " ".join(f"w{k % 977}x{k % 1009}" for k in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, "doc_id", "text", 3).collect()}
    assert got[3] == 3 and got[1] == 1 and got[2] in (1, 2)
    assert {r.doc_id for r in simhash.near_duplicate_groups(docs, "doc_id", "text", (3, 5)).collect()} == {2}


def test_a_large_group_is_verified_in_parts(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(30)]
    words = {0: base} | {k: base[: rng.randrange(12, 31)] + [f"x{k}"] * rng.randrange(2) for k in range(1, 40)} | {k: [f"y{k}z{j}" for j in range(9)] for k in range(40, 44)}
    sets = spark.createDataFrame([(bytes([k]), [hash(s) for s in shingles(" ".join(w))]) for k, w in words.items()], "digest binary, hashes array<long>")
    # one set is in nearly all pairs; two pairs have another one
    asked = [(0, k) for k in range(1, 44)] + [(41, 42), (5, 6)]
    pairs = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in asked], "da binary, db binary")
    said = {k: shingles(" ".join(w)) for k, w in words.items()}
    want = sorted((a, b) for a, b in asked if len(said[a] & said[b]) >= 0.8 * len(said[a] | said[b]))
    assert 0 < len(want) < len(asked)
    for part in (1, 4, 1000):
        assert sorted((r.da[0], r.db[0]) for r in setjoin.verified(pairs, sets, 80, part).collect()) == want
    assert setjoin.verified(pairs.limit(0), sets, 80).count() == 0
