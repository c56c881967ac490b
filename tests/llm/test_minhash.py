import random

import numpy as np
import pytest

from bundlelens.llm import minhash, setjoin
from bundlelens.llm.common import BASES, Windows
from bundlelens.llm.components import components

SCHEMA = "doc_id long, text string, n int, digest string, component long"


def brute_set(text, width=2):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def roots(sets, similar):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and similar(a, sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def brute(rows, width=2, percent=80):
    sets = [brute_set(t, width) for _, t, *_ in rows]
    group = roots(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))
    low = {}
    for (k, *_), g in zip(rows, group, strict=True):
        if k is not None:
            low[g] = min(low.get(g, k), k)
    out = []
    for (k, *_), s, g in zip(rows, sets, group, strict=True):
        c = low.get(g) if s else k
        out.append((k, len(s), c, k == c))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(k, " ".join(said(60))) for k in range(40)]
    k = 100
    for n in (6, 12, 40, 200):  # near copies at all distances round the threshold
        base = said(n)
        for changes in range(0, n // 4 + 2):
            for _ in range(3):
                w = list(base)
                for i in rng.sample(range(n), min(n, changes)):
                    w[i] = rng.choice(vocabulary)
                rows.append((k, " ".join(w)))
                k += 1
    rows += [(k + i, rows[0][1].upper() + " \t") for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "two words"), (906, "Two  Words"), (907, "a a a a"), (None, rows[1][1]), (None, "nowhere else at all"), (None, None), (2, rows[3][1]), (2, rows[2][1]), (908, " ".join(said(120_000))), (909, "é É ﬀ x" + "y" * 200_000)]
    return rows


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_components_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, "doc_id", "text").collect()), key=str)
    assert got == brute(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(docs, "doc_id", "text").collect() == []


def test_sketches_estimate_similarity_and_lose_none():
    rng = np.random.default_rng(1)
    cut, lost, errors = minhash.odd_cutoff(minhash.SAMPLES, minhash.BITS, 80, 1e-6), 0, []
    for n in (20, 100, 1000):
        for _ in range(150):
            both, a, b = (rng.integers(0, 2**63, m, dtype=np.uint64) for m in (n * 8 // 10, n // 10, n - n * 8 // 10 - n // 10))
            (ba, oa), (bb, ob) = (minhash.bands_and_odd(minhash.samples(np.concatenate([both, x]))) for x in (a, b))
            z = sum(int(x).bit_count() for x in (oa ^ ob).view(np.uint64))
            errors.append(minhash.similarity(z) - 0.8)
            lost += z > cut or not (ba == bb).any()
    assert lost == 0
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_shingles_are_those_of_the_words():
    windows = Windows(BASES[0])
    for text in ("", "One", "a b", "a b a b a", "É é\x0bX\x0cy \xa0z"):
        assert len(minhash.shingles(text.encode(), 2, windows)) == len(brute_set(text))
    assert list(minhash.shingles(b"A B c", 2, windows)) == list(minhash.shingles(b"a\n b  C", 2, windows))


def crowd(seed, sets, links):
    """Sets of three quarters of common tokens, so that all are alike but not enough, some of them with a near copy."""
    rng = random.Random(seed)
    common = [rng.getrandbits(62) for _ in range(150)]
    out = [common[:] + [rng.getrandbits(62) for _ in range(50)] for _ in range(sets)]
    for _ in range(links):
        s = list(rng.choice(out))
        for i in rng.sample(range(len(s)), 15):
            s[i] = rng.getrandbits(62)
        out.append(s)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("part", [8, 2048])
def test_crowded_bands_lose_no_link(spark, monkeypatch, part):
    monkeypatch.setattr(setjoin.prefix_pairs, "__defaults__", (part,))
    sets = crowd(3, 130, 60)
    odd = [minhash.bands_and_odd(minhash.samples(np.array(s, np.uint64)))[1].tolist() for s in sets]
    nodes = spark.createDataFrame([(b"%04d" % i, len(s), o, minhash.parity(np.array(s, np.uint64)).tolist(), [1, 2, 3]) for i, (s, o) in enumerate(zip(sets, odd, strict=True))], "digest binary, n int, odd array<long>, parity array<long>, bands array<long>")
    full = spark.createDataFrame([(b"%04d" % i, s) for i, s in enumerate(sets)], "digest binary, hashes array<long>")
    links = setjoin.linked_sets(nodes, lambda asked: full.join(asked, "digest"), 80, minhash.odd_cutoff(minhash.SAMPLES, minhash.BITS, 80, 1e-6), minhash.LONGS, 8)
    found = {bytes(r.node): bytes(r.component) for r in components(links.toDF("a", "b")).collect()}
    frozen = [frozenset(s) for s in sets]
    want = roots(frozen, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = [int(found.get(b"%04d" % i, b"%04d" % i)) for i in range(len(sets))]
    assert got == want
    assert len(set(want)) > 96


def test_prefix_pairs_hold_all_similar_pairs(spark):
    rng = random.Random(6)
    sets = [frozenset(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(60)]
    sets += [frozenset(list(s)[1:]) | {99} for s in sets if len(s) > 9]
    rows = [(b"%04d" % i, b"%d" % (i % 5), list(s), minhash.parity(np.array([x << 57 for x in s], np.uint64)).tolist()) for i, s in enumerate(sets)]
    for percent in (50, 80, 100):
        got = {(int(r.da), int(r.db)) for r in setjoin.prefix_pairs(spark.createDataFrame(rows, "digest binary, c binary, hashes array<long>, parity array<long>"), percent, 8, 3).collect()}
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    assert ((j, i) in got) == (i % 5 != j % 5)
