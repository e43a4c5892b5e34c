"""Conversation repair against a search over all edits, and its block tables against single steps."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from telewatch.llm import conversations as C

CONV = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def slow(rows):
    """Faults, cost, audit and repaired turns of (turn, role, text) rows in order, by recursion over all edits."""
    marked, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role, text, fault))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserts):
        options = []
        if i == len(marked):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = marked[i]
            c, a, said = best(i + 1, state, 0)
            options.append((4 + c, "D" + a, said))
            if fault in (None, "truncated"):
                extra = 3 if fault else 0
                for letter, cost, r in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    after = step.get((state, r[:1]))
                    if after:
                        c, a, said = best(i + 1, after, 0)
                        options.append((cost + extra + c, letter + a, ((r, text), *said)))
        if inserts < 3:
            for r in ("user", "assistant"):
                after = step.get((state, r[0]))
                if after:
                    c, a, said = best(i, after, inserts + 1)
                    options.append((3 + c, "I" + a, ((r, ""), *said)))
        return min(options, default=(10 ** 9, "", ()))

    cost, audit, said = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()}


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def random_conversations(rng, n, most):
    out = []
    for c in range(n):
        for t in range(int(rng.integers(0, most + 1))):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""])
            out.append((c if c else None, None if rng.random() < 0.1 else int(rng.integers(0, most)) if rng.random() < 0.3 else t,
                        str(role), str(rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why?\n", "more. text"]))))
    return out


def test_tables_equal_single_steps():
    rng, tables = np.random.default_rng(0), C.tables()
    assert len(tables.vectors) < 200 and {len(x) for x in tables.many} == {C.SYMBOLS ** C.BLOCK}
    for n in (0, 1, 3, 4, 5, 31):
        symbols = bytes(rng.integers(0, C.SYMBOLS, n).tolist())
        for start in tables.start:
            v = tables.vectors[start]
            for x in reversed(symbols):
                v = C._step(v, x)
            _, left, total = tables.back(symbols, start)
            assert C._normal(v) == (tables.vectors[left], total)


@pytest.mark.parametrize("piece", [4096, 3])
def test_repair_equals_a_search_over_all_edits(spark, piece):
    rows = random_conversations(np.random.default_rng(11), 60, 9)
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"part {t % 7}.") for t in range(60)]  # one that spans tasks
    got = {r.conv_id: r.asDict() for r in C.repair(spark.createDataFrame(rows, CONV).repartition(3), piece=piece).collect()}
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert got.keys() == by.keys()
    for c, r in by.items():
        want = slow(in_order(r))
        assert {k: got[c][k] for k in want} == want, (c, in_order(r))


def test_repaired_turns_alternate(spark):
    rows = random_conversations(np.random.default_rng(3), 30, 8)
    for r in C.repair(spark.createDataFrame(rows, CONV), messages=True, piece=4).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[0] for m in r.messages))
        assert len(r.audit) == r.audit.count("D") + len(r.messages)


def test_damage_and_defined_cases(spark):
    rows = random_conversations(np.random.default_rng(7), 80, 7) + [(900, None, None, None), (None, None, "user", None), (901, 2 ** 62, "user", "x" * 300_000)]
    rows += [(902, k, "assistant", "Same.") for k in range(40)] + [(903, -2 ** 62, "user", "a."), (903, 2 ** 62, "assistant", "b.")]
    rows += [(1000 + k, 0, "user", "Hi.") for k in range(60)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], CONV + ", n long, key string").drop("n")
    got = {r.conv_id: r.asDict() for r in C.repair(C.damage(df)).collect()}
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        hit, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            by[c] += [(t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    assert got.keys() == by.keys() and any(not r for r in by.values())
    for c, r in by.items():
        want = slow(in_order(r))
        want["gaps"] = (want["gaps"] + 2 ** 63) % 2 ** 64 - 2 ** 63
        assert {k: got[c][k] for k in want} == want, c
    empty = C.repair(C.damage(df.limit(0)))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
