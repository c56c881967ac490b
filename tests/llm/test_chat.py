import random

from bundlelens.llm import chat

TREE = "tree long, node long, parent long, role string, text string, score double, depth int"


def paths_of(rows, best):
    kept = {}
    for t, n, p, role, text, score in rows:
        if t is not None and n is not None:
            kept[t, n] = min(kept.get((t, n), (role or "", text or "", p, score or 0.0)), (role or "", text or "", p, score or 0.0), key=lambda x: x[:2])
    out = []
    parents = {(t, v[2]) for (t, n), v in kept.items()}
    by = {}
    for (t, n), _ in kept.items():
        path, seen, at = [], set(), n
        while at is not None and (t, at) in kept and at not in seen:
            seen.add(at)
            path.append(at)
            at = kept[t, at][2]
        if (t, n) not in parents and at not in seen:
            by.setdefault(t, []).append((-sum(kept[t, x][3] for x in path), n, path[::-1]))
    for t, ls in by.items():
        for rank, (_, leaf, path) in enumerate(sorted(ls)[:best], 1):
            out += [(t, leaf, rank, d, *kept[t, x][:2]) for d, x in enumerate(path)]
    return sorted(out)


def test_branches_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(1, 0, None, "user", None, None), (1, 0, None, None, "dup", 0.0), (2, 5, 99, "user", "parent gone", 1.0), (None, 1, None, "user", "x", 1.0), (3, 1, 2, "a", "cycle", 1.0), (3, 2, 1, "a", "cycle", 1.0), (3, 9, None, "a", "fine", 1.0)]
    rows += [(4, i, rng.randrange(i) if i else None, "user", f"t{i}", float(rng.randrange(4))) for i in range(60)]
    rows += [(5, i, i - 1 if i else None, "user", f"d{i}", 1.0) for i in range(37)]
    df = spark.createDataFrame([(*r, 7) for r in rows], TREE).repartition(3)
    for best in (1, 3):
        got = sorted(tuple(r) for r in chat.branches(df, best).collect())
        assert got == paths_of(rows, best)


def test_format_and_mask_round_trip(spark):
    nasty = ["", None, "\\", "###", "\\### Assistant: </turn> ok", "a: b</turn>\n### x: y", "é😀\n", "<", "\\\\#", "x" * 70_000, "$1 \\$1"]
    roles = ["user", "assistant", None, "odd: role\\\n</turn>"]
    rows = [(k % 4, k // 4, roles[k % len(roles)] if k % 3 else "assistant", nasty[k % len(nasty)]) for k in range(44)]
    rows += [(9, 1, "user", "tie"), (9, 1, "assistant", "tie"), (9, 1, "user", "tie"), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, tree int, mask string").repartition(3)
    out = chat.conversations(chat.branches(chat.chains(df, "conv_id", "turn", "role", "text")))
    got = {r.tree: r for r in out.select("tree", "n_turns", "formatted", chat.parsed(out.formatted).alias("p"), chat.under_mask(out.formatted, out["mask"]).alias("loss")).collect()}
    want = {}
    for c, t, role, text in rows:
        if c is not None:
            want.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(p.role, p.text) for p in got[c].p] == [t[1:] for t in turns] and got[c].n_turns == len(turns)
        assert got[c].loss == "".join(t[2] for t in turns if t[1] == "assistant")
        assert got[c].formatted.count("</turn>\n") == len(turns)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversations(chat.branches(chat.chains(df, "conv_id", "turn", "role", "text"))).count() == 0


def test_long_roles_and_texts(spark):
    role, text = "a: \\role</turn>\n#" * 20_000 + "x" * 200_000, "b: \\" * 100_000
    df = spark.createDataFrame([(1, 1, role, text), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.conversations(chat.branches(chat.chains(df, "conv_id", "turn", "role", "text")))
    r = out.select(chat.parsed(out.formatted).alias("p"), chat.under_mask(out.formatted, out["mask"]).alias("loss")).first()
    assert [tuple(x) for x in r.p] == [(role, text), ("assistant", text)] and r.loss == text
