"""Repair of conversations by alignment with the strings of a grammar of roles.

A sound conversation's role initials are empty, or pairs of user and assistant with at most
one system turn before them: ``(s?(ua)+)?``.  The turns are aligned with each such string by
Wagner and Fischer's table of edit costs, from the ends backwards, so that one table holds
the strings of all lengths: a string's rest is told by its length.  Ukkonen's bands bound the
table: cells whose surplus of turns or of marks alone costs more than the best repair known
so far are not computed.  Every cheapest string is traced back, the smallest edit first, and
the audits are compared.

Costs: Keep 0, Rerole (to user or assistant) 3, Delete 4, Insert (user or assistant, without
text) 3; a truncated turn that is not deleted adds 3; blank and duplicate turns must go.

A conversation's faults and roles (a few bytes a turn) are looked at together; its texts
pass by one after another and are never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 29
HEAD = 32  # characters of a text that rows of equal turn and role are ordered by, before its digest
WHITE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


# --- one conversation -------------------------------------------------------------------


def _incumbent(roles: str, cut: list[bool]) -> int:
    """Cost of a plain repair: keep what comes in turn, put in what is missing, rename others."""
    cost, wanted = 0, "u"
    for i, role in enumerate(roles):
        cost += TRUNCATED * cut[i]
        if role in "ua" and role != wanted:
            cost += INSERT
        elif role not in ("u", "a"):
            cost += REROLE
            role = wanted
        wanted = "a" if role == "u" else "u"
    return cost + INSERT * (wanted == "a")


class Table:
    """Edit costs of the turns from ``i`` on against the last ``r`` marks of an alternating string.

    ``plain[i, r]`` has no system mark to come; ``system[i, r]`` has one, before those ``r``.
    Rows are kept at every ``step``-th turn and computed again between two of them, so that a
    long conversation takes memory by the square root of its length.
    """

    def __init__(self, roles: str, cut: list[bool]):
        self.n, self.roles, self.cut = len(roles), roles, cut
        bound = _incumbent(roles, cut)
        least_delete = DELETE - TRUNCATED if any(cut) else DELETE
        # Truncated turns cost 3 in any case, kept or as part of 4; the bands count from there.
        spare = bound - TRUNCATED * sum(cut)
        self.more, self.fewer = spare // INSERT, spare // least_delete
        self.width = self.n + self.more + 2
        self.step = max(8, int(self.n**0.5))
        marks = np.arange(self.width, dtype=np.int32)
        self.is_user = marks % 2 == 0  # the mark before which r marks are left, itself included
        self.slope = INSERT * marks
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        row = self._last()
        for i in range(self.n, -1, -1):
            if i < self.n:
                row = self._before(i, *row)
            if i % self.step == 0 or i == self.n:
                self.kept[i] = row
        self.first = row

    def _band(self, i: int) -> tuple[int, int]:
        left = self.n - i
        return max(0, left - self.fewer), min(self.width, left + self.more + 1)

    def _last(self) -> tuple[np.ndarray, np.ndarray]:
        plain = np.full(self.width, FAR, np.int32)
        low, high = self._band(self.n)
        plain[low:high] = self.slope[low:high]
        return plain, np.full(self.width, FAR, np.int32)

    def _before(self, i: int, plain: np.ndarray, system: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs from turn ``i`` on, from those after it."""
        low, high = self._band(i)
        extra, role = TRUNCATED * self.cut[i], self.roles[i]
        new = np.full(self.width, FAR, np.int32)
        cost = plain[low:high] + DELETE
        at = max(low, 1)
        if role in ("u", "a"):
            same = np.where(self.is_user[at:high] == (role == "u"), 0, REROLE)
        else:
            same = REROLE
        cost[at - low :] = np.minimum(cost[at - low :], plain[at - 1 : high - 1] + same + extra)
        slope = self.slope[low:high]
        new[low:high] = np.minimum.accumulate(cost - slope) + slope  # any number of inserts
        other = system + DELETE
        if role == "s":
            other = np.minimum(other, plain + extra)
        return np.minimum(new, FAR), np.minimum(other, FAR)

    def at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The two rows of turn ``i``."""
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(self.n, (i // self.step + 1) * self.step)
            row, self.block = self.kept[end], {}
            for k in range(end - 1, i // self.step * self.step, -1):
                row = self.block[k] = self._before(k, *row)
        return self.block[i]

    def best(self) -> tuple[int, list[tuple[bool, int]]]:
        """The least cost, and the strings that reach it: (with a system turn, marks after it)."""
        plain, system = (row[::2].copy() for row in self.first)
        system[0] = FAR  # a system turn alone is no sound conversation
        cost = int(min(plain.min(), system.min()))
        return cost, [(False, 2 * int(k)) for k in np.flatnonzero(plain == cost)] + [(True, 2 * int(k)) for k in np.flatnonzero(system == cost)]

    def trace(self, strings: list[tuple[bool, int]]) -> list[str]:
        """Each string's least audit among the cheapest: at each turn the smallest edit that loses nothing.

        All strings are traced together, turn by turn, since rows are computed in blocks;
        audits that have become larger than another are given up.
        """
        states, audits = list(strings), [""] * len(strings)
        for i in range(self.n + 1):
            if i % 256 == 255 and len(states) > 1:
                least = min(audits)
                alive = [k for k, a in enumerate(audits) if a.startswith(least)]
                states, audits = [states[k] for k in alive], [audits[k] for k in alive]
            plain, system = self.at(i)
            following = self.at(i + 1) if i < self.n else None
            for k, (ahead, r) in enumerate(states):
                while True:
                    here = int(system[r] if ahead else plain[r])
                    if following is not None and int(following[ahead][r]) + DELETE == here:
                        audits[k] += "D"
                        break
                    if not ahead and r and int(plain[r - 1]) + INSERT == here:
                        audits[k] += "I"
                        r -= 1
                        continue
                    if following is None:
                        break
                    extra = TRUNCATED * self.cut[i]
                    if ahead:  # only the system turn itself is left
                        audits[k] += "K"
                        ahead = False
                        break
                    same = self.roles[i] == ("u" if r % 2 == 0 else "a")
                    assert int(following[0][r - 1]) + extra + REROLE * (not same) == here
                    audits[k] += "K" if same else "R"
                    r -= 1
                    break
                states[k] = (ahead, r)
        return audits


def align(roles: str, must_go: list[bool], cut: list[bool]) -> tuple[int, str]:
    """Cost and least audit of the cheapest repair of turns with these role initials."""
    left = [i for i, gone in enumerate(must_go) if not gone]
    table = Table("".join(roles[i] for i in left), [cut[i] for i in left])
    cost, strings = table.best()
    audits = []
    for audit in table.trace(strings):
        # Turns that must go are deleted as soon as they come: D sorts before all other edits.
        out, i = [], 0
        for edit in audit:
            while i < len(roles) and must_go[i]:
                out.append("D")
                i += 1
            out.append(edit)
            i += edit != "I"
        out += "D" * sum(must_go[i:])
        audits.append("".join(out))
    return cost + DELETE * (len(roles) - len(left)), min(audits)


@lru_cache(maxsize=1 << 14)
def _align_short(roles: str, faults: bytes) -> tuple[int, str]:
    return align(roles, [f in (1, 2) for f in faults], [f == 3 for f in faults])


def aligned(roles: str, faults: bytes) -> tuple[int, str]:
    """``align`` with faults 1 blank, 2 duplicate, 3 truncated, 0 none; short answers are remembered."""
    return (_align_short if len(roles) <= 64 else _align_short.__wrapped__)(roles, faults)


# --- all conversations ------------------------------------------------------------------


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, head, digest); null role or text become one space, rows without conv_id go."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return _marked(rows)


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", F.substring("text", 1, HEAD).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage that depends on nothing but crc32 of ``conv_id:turn`` (nulls: one space).

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and
    ``?``, 3 repeats it, 4 makes it a user's.
    """
    rows = rows_of(conversations).select("conv_id", "turn", "role", "text")
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("hurt", F.crc32(name.cast("binary")) % 20).where("hurt <> 0")
    copies = F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    return _marked(rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)))


ORDER = ("turn", "role", "head", "digest")
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
DIGESTS = "conv_id long, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _faults() -> tuple[Column, Column]:
    """Is the text blank; is its last mark other than the end of a sentence?"""
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    return shown == "", ~F.right(shown, F.lit(1)).isin(".", "!", "?")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and audit of the cheapest repair.

    ``rows`` are as ``rows_of`` gives them.  Turns are taken in order (null first); rows of
    equal turn by role, by the first 32 characters of the text, then by its SHA-256.
    Repeated rows are duplicates.  Texts do not travel; a worker holds one conversation's
    initials, faults and digests at a time.
    """
    small_batches(rows.sparkSession)
    blank, open_end = _faults()
    light = rows.select("conv_id", *ORDER, blank.alias("blank"), open_end.alias("open_end"))
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    # Turns as text: pandas would turn whole numbers with nulls into floats.
    ordered = ordered.select("conv_id", F.col("turn").cast("string").alias("turn"), "role", "digest", "blank", "open_end")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, held = None, None
        for batch in batches:
            out = []
            for c, turn, role, digest, is_blank, is_open in zip(*(batch[x].tolist() for x in batch.columns), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        out.append((conv, *held.done()))
                    conv, held = c, _Conversation()
                held.add(turn, role, digest, is_blank, is_open)
            yield _frame(out, AUDIT)
        if held is not None:
            yield _frame([(conv, *held.done())], AUDIT)

    return ordered.mapInPandas(look, AUDIT)


class _Conversation:
    """What is known of a conversation's turns so far."""

    def __init__(self):
        self.seen, self.roles, self.faults = set(), [], bytearray()
        self.low = self.high = self.last = None
        self.distinct = 0

    def add(self, turn, role: str, digest: bytes, is_blank: bool, is_open: bool) -> None:
        if turn is not None:
            turn = int(turn)
            if turn != self.last:
                self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
                self.distinct += 1
        key = hashlib.blake2b(digest + role.encode(), digest_size=16).digest()
        self.faults.append(1 if is_blank else 2 if key in self.seen else 3 if is_open else 0)
        self.seen.add(key)
        self.roles.append(role[:1] or " ")

    def done(self) -> tuple:
        roles, faults = "".join(self.roles), bytes(self.faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, *aligned(roles, faults))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of the repaired ``role:text`` lines, by the audits ``found``.

    Each conversation's audit travels ahead of its rows; texts pass one at a time.
    """
    return _repairs(rows, found, False)


def turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves."""
    return _repairs(rows, found, True)


def _repairs(rows: DataFrame, found: DataFrame, whole: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    none = F.lit(None)
    head = found.select(
        "conv_id", F.lit(0).alias("part"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit("").alias("head"), none.cast("binary").alias("digest"),
    )
    both = head.unionByName(rows.select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", "head", "digest"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER).select("conv_id", "part", "role", "text")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(conv_id, role, text) of repaired turns; (conv_id, None, None) ends a conversation."""
        conv, audit, at, roles = None, "", 0, _Roles()
        for batch in batches:
            for c, part, role, text in zip(*(batch[x].tolist() for x in batch.columns), strict=True):
                if part == 0:
                    if conv is not None:
                        yield from roles.inserts(conv, audit, at)
                        yield conv, None, None
                    conv, audit, at = c, text, 0
                    roles = _Roles()
                    continue
                while audit[at] == "I":
                    yield conv, roles.next(), ""
                    at += 1
                edit, at = audit[at], at + 1
                if edit == "K":
                    yield conv, roles.keep(role), text
                elif edit == "R":
                    yield conv, roles.next(), text
        if conv is not None:
            yield from roles.inserts(conv, audit, at)
            yield conv, None, None

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, first, digest = [], True, hashlib.sha256()
        for conv, role, text in lines(batches):
            if role is None:
                out.append((conv, digest.hexdigest()))
                first, digest = True, hashlib.sha256()
            else:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            if len(out) >= 1024:
                yield _frame(out, DIGESTS)
                out = []
        yield _frame(out, DIGESTS)

    def whole_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place, size = [], 0, 0
        for conv, role, text in lines(batches):
            if role is None:
                place = 0
                continue
            out.append((conv, place, role, text))
            place, size = place + 1, size + len(text) + 64
            if size > 1 << 20:
                yield _frame(out, TURNS)
                out, size = [], 0
        yield _frame(out, TURNS)

    if whole:
        return ordered.mapInPandas(whole_turns, TURNS)
    return ordered.mapInPandas(digests, DIGESTS)


class _Roles:
    """The roles of repaired turns in order: marks alternate after a system turn, if there is one."""

    def __init__(self):
        self.wanted = "u"

    def next(self) -> str:
        mark = self.wanted
        self.wanted = "a" if mark == "u" else "u"
        return NAMES[mark]

    def keep(self, role: str) -> str:
        if role[:1] != "s":
            self.wanted = "a" if role[:1] == "u" else "u"
        return role

    def inserts(self, conv, audit: str, at: int) -> Iterator[tuple]:
        for _ in range(len(audit) - at):
            yield conv, self.next(), ""


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Every conv_id of ``conversations`` with faults, cost, audit and digest of its repair.

    ``rows`` are the rows to repair, by default the conversations' own; a conversation left
    without rows has zeros, an empty audit and the digest of nothing.  Null roles and texts
    count as one space; rows without conv_id belong to no conversation; extra columns are
    ignored; an empty table gives an empty table.
    """
    rows = rows_of(conversations) if rows is None else rows
    found = stored(audits(rows), "audits")
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    made = ids.join(found, "conv_id", "left").join(repaired(rows, found), "conv_id", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return made.select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
