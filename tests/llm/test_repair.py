import hashlib
import random
import re
import sys
import time
import zlib
from functools import lru_cache

import pytest

from tallywise.llm import queries, repair

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(roles, faults):
    """Least (cost, audit) by a plain recursion over the grammar's states, no target strings."""
    n = len(roles)
    sys.setrecursionlimit(20_000)

    @lru_cache(maxsize=None)
    def rest(i, state, inserted):
        # states: 0 nothing yet, 1 after s, 2 after u, 3 after a
        options = [(0, "")] if i == n and state in (0, 3) else []
        if inserted < 2:  # more than two inserted turns in a row never pay
            if state in (0, 1, 3):
                options.append((3, "I", i, 2, inserted + 1))
            if state == 2:
                options.append((3, "I", i, 3, inserted + 1))
        if i < n:
            options.append((4, "D", i + 1, state, 0))
            if faults[i] not in (1, 2):
                extra = 3 * (faults[i] == 3)
                after = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
                if roles[i] in after:
                    options.append((extra, "K", i + 1, " sua".index(roles[i]), 0))
                options.append((extra + 3, "R", i + 1, 3 if state == 2 else 2, 0))
        best = None
        for o in options:
            if len(o) == 2:
                found = o
            else:
                more = rest(*o[2:])
                if more is None:
                    continue
                found = (o[0] + more[0], o[1] + more[1])
            best = found if best is None else min(best, found)
        return best

    return rest(0, 0, 0)


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(4000):
        n = rng.randrange(0, 12)
        roles = "".join(rng.choice("ssuuuaaat ") for _ in range(n))
        faults = bytes(rng.choice((0, 0, 0, 0, 1, 2, 3, 3)) for _ in range(n))
        assert repair.aligned(roles, faults) == cheapest(roles, faults), (roles, faults)


@pytest.mark.parametrize("n", [63, 200, 411])
def test_long_conversations_with_rows_computed_in_blocks(n):
    rng = random.Random(n)
    for kinds in ("su", "ua", "suat", "u", "uua"):
        roles = "".join(rng.choice(kinds) for _ in range(n))
        faults = bytes(rng.choice((0, 0, 0, 1, 3)) for _ in range(n))
        assert repair.aligned(roles, faults) == cheapest(roles, faults)


def test_a_very_long_conversation_stays_bounded():
    began = time.monotonic()
    cost, audit = repair.aligned("u" * 4000 + "ua" * 500, bytes(5000))
    assert time.monotonic() - began < 60
    assert (cost, len(audit)) == (3 * 2000, 5000)


def brute(rows, damage=True):
    out = {}
    originals = {r[0] for r in rows if r[0] is not None}
    hurt = []
    for c, t, role, text in rows:
        if c is None:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        hurt += [(c, t, role, text)] * (1 + (h == 3))
    for c in originals:
        mine = [r for r in hurt if r[0] == c]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, text))
        roles = [r[2][:1] for r in mine]
        turns = {r[1] for r in mine} - {None}
        cost, audit = cheapest("".join(r or " " for r in roles), bytes(faults))
        lines, at, before = [], 0, "a"
        for edit in audit:
            role, text = (mine[at][2], mine[at][3]) if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if before == "u" else "user"
            before = role[0]
            lines.append(f"{role}:{text}")
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_repair"](spark, data).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


def odd(spark):
    rng = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", None, "", "tool"])
            text = rng.choice(["Yes.", "No", " \t", "", None, "Why? ", "x" * 40 + "!", "x" * 40 + "?", "é."])
            rows.append((c, rng.choice([t, t, t, None, 2**60 + t]), role, text))
    rows += [(None, 1, "user", "lost."), (900, None, None, None), (901, 1, "user", "long. " * 200_000), (902, 5, "user", "a."), (902, 5, "user", "a.")]
    return spark.createDataFrame(rows, COLUMNS)


def test_odd_rows(spark):
    df = odd(spark)
    rows = [tuple(r) for r in df.collect()]
    wide = df.selectExpr("*", "1 as audit", "2 as cost", "'x' as digest")
    for made, damage in ((repair.repair(wide), False), (repair.repair(wide, repair.damaged(wide)), True)):
        assert {r[0]: tuple(r[1:]) for r in made.collect()} == brute(rows, damage)
    assert repair.repair(df.limit(0)).count() == 0


def test_repaired_turns_are_sound(spark):
    rows = repair.rows_of(odd(spark))
    found = repair.audits(rows)
    digests = {r[0]: r[1] for r in repair.repaired(rows, found).collect()}
    turns = {}
    for r in repair.turns(rows, found).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    assert set(turns) <= set(digests)
    for c, sha in digests.items():
        mine = turns.get(c, [])
        assert [r.place for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == sha
