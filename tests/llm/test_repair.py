import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from bundlelens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, n int, conv string, audit string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r[1:])
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            last = text.rstrip(SPACE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "none" if last in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        # state: role initials so far as "", "s", "u" or "a"; (cost, audit, lines)
        best = {"": (0, "", ())}

        def inserted(best):
            best = dict(best)
            for _ in range(2):
                for q, (cost, audit, lines) in list(best.items()):
                    to, role = ("a", "assistant") if q == "u" else ("u", "user")
                    new = (cost + 3, audit + "I", (*lines, role + ":"))
                    best[to] = min(best.get(to, new), new)
            return best

        for (_, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for q, (cost, audit, lines) in inserted(best).items():
                options = [(q, 4, "D", None)]
                if fault in ("none", "truncated"):
                    more = 3 * (fault == "truncated")
                    want = "a" if q == "u" else "u"
                    options.append((want, 3 + more, "R", {"a": "assistant", "u": "user"}[want]))
                    if role[:1] == want or (role[:1] == "s" and q == ""):
                        options.append((role[:1], more, "K", role))
                for to, price, edit, name in options:
                    new = (cost + price, audit + edit, lines if name is None else (*lines, f"{name}:{text}"))
                    after[to] = min(after.get(to, new), new)
            best = after
        cost, audit, lines = min(v for q, v in inserted(best).items() if q in ("", "a"))
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "umpire", "é"]
    texts = ["Yes.", "no", " \t", "", None, "Why? ", "end.\x0b\n", "é", "Go!\xa0", "x.\x1f"]
    rows = []
    for c in range(60):
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for t in range(rng.randrange(0, 12))]
    rows += [(100, t // 3, "user" if t % 5 else "assistant", rng.choice(["again.", f"t{t}", f"t{t}."])) for t in range(700)]
    rows += [(101, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(300)]
    rows += [(None, t, rng.choice(roles), "z.") for t in (None, 1, 2, 2, 9)]
    rows += [(102, None, "user", "q."), (102, None, "assistant", "q."), (103, 0, "user", "long " * 200_000 + "."), (103, 1, "assistant", "." + " " * 300_000), (104, 5, "u" * 100_000, "."), (-3, -7, "system", "s."), (-3, 4, "user", "u.")]
    rows += [(105, 1, "user", "same.")] * 40
    return rows


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in repair.op11_repair(spark, str(tmp_path)).collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus()
    assert run(spark, tmp_path, rows) == brute(rows)


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


@pytest.mark.parametrize("chunk", [1, 7])
def test_chunks_make_no_difference(spark, chunk):
    rows = corpus(2)
    given = [(c, t, " " if r is None else r, " " if x is None else x, 1) for c, t, r, x in damage(rows)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, n long").repartition(3)
    got = sorted(((r.conv.id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.repaired(df, chunk).collect()), key=str)
    with_rows = {c for c, *_ in given}
    assert got == [r for r in brute(rows) if r[0] in with_rows]


def test_powers_equal_single_steps():
    for symbol in range(12):
        for n in (1, 2, 3, 7, 64, 100):
            m = repair.transition(symbol)
            for _ in range(n - 1):
                m = repair.times(m, repair.transition(symbol))
            assert m == repair.advance(symbol, n)


def test_unrolled_edits_cost_what_the_matrices_say():
    for symbols in product(range(12), repeat=3):
        entries = [{"k": k, "role": s // 3, "fault": s % 3, "n": 1} for k, s in enumerate(symbols)]
        v = repair.END
        for symbol, n in reversed(repair.runs_of(entries)):
            v = repair.before(repair.advance(symbol, n), v)
        edits, q = repair.unroll(entries, repair.END, 0)
        cost = repair.END[q]
        for e, made in zip(entries, edits, strict=True):
            cost += 3 * made.count("I") + {"D": 4, "K": 0, "R": 3}[made[-1]] + 3 * (made[-1] != "D" and e["fault"] == repair.CUT)
        assert cost == v[0]
