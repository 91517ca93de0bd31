"""Conversation repair against a forward search by (cost, audit), whatever the size of chunks and the number of passes."""

import hashlib
import random
import zlib

import pytest

from lakeline.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    put = lambda state: (3, "assistant") if state == "u" else (2, "user")

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                name = put(state)[1]
                option = (cost + 3, audit + "I", [*lines, f"{name}:"])
                best[name[0]] = min(best.get(name[0], option), option)
        return best

    best = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            found = [(state, cost + 4, "D", lines)]
            if fault not in ("b", "d"):
                more, name = 3 * (fault == "t"), put(state)[1]
                if role and state + role[:1] in ("s", "u", "su", "ua", "au"):
                    found.append((role[0], cost + more, "K", [*lines, f"{role}:{text}"]))
                found.append((name[0], cost + more + 3, "R", [*lines, f"{name}:{text}"]))
            for to, c, edit, body in found:
                option = (c, audit + edit, body)
                after[to] = min(after.get(to, option), option)
        best = inserted(after)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    return (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_hand(rows):
    found = {conv: [] for conv, *_ in rows}
    for r in damage(rows):
        found[r[0]].append(r)
    return {conv: repaired(own) for conv, own in found.items()}


def made(seed, conversations=60, longest=40):
    rng, rows = random.Random(seed), []
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", "s", None]
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "Once more.", "é ü. ", "." * 3]
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice(['.', '', '! '])}"
            rows.append((conv, rng.choice([None, turn, turn, turn + 3]), rng.choice(roles), text))
    # all rows but the first must go: vectors keep their dependence on the end
    return rows + [(1000, t, "user", "Again.") for t in range(90)] + [(1001, 5, "assistant", "Equal rows.")] * 50 + [(1002, t, ("user", "assistant")[t % 2], f"{t} fine.") for t in range(200)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def rows_of(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize(("size", "passes"), [(128, 8), (3, 4), (1, 1), (7, 40)])
def test_same_as_a_forward_search(spark, size, passes):
    rows = made(size)
    assert rows_of(repair.report(repair.damaged(frame(spark, rows)), size, passes)) == by_hand(rows)


def test_repaired_rows_are_whole_conversations(spark):
    rows = made(5, 20)
    pieces = repair.repaired(repair.chunks(repair.damaged(frame(spark, rows)), 4), 2).collect()
    found = {}
    for p in sorted(pieces, key=lambda p: p["no"]):
        found.setdefault(p["conv"], []).extend(f"{r}:{t}" for r, t in zip(p["roles"], p["texts"]))
    want = by_hand(rows)
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in found.items()} == {c: want[c][-1] for c in found}
    for lines in found.values():
        initials = "".join(x[0] for x in lines)
        assert len(initials.removeprefix("s")) % 2 == 0 and set(initials.removeprefix("s")[::2]) <= {"u"} and set(initials.removeprefix("s")[1::2]) <= {"a"}


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "word " * 1_000_000), (1, 1, "assistant", "short."), (2, None, None, None), (3, 1, "user", "x."), (3, 1, "user", "x.")]
    df = frame(spark, rows)
    for name in ("conv", "copies", "part", "codes", "audit", "first", "n"):
        df = df.withColumn(name, F.lit("taken"))
    assert rows_of(repair.report(repair.damaged(df))) == by_hand(rows)
    empty = repair.report(repair.damaged(df.limit(0)))
    assert empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and empty.count() == 0
