"""A trie of conversation prefixes, counted in node tables over minimal perfect hashes.

A node is a distinct sequence of turns, known by a 128-bit digest chained from turn to turn.
Runs of rows form shards.  A shard's distinct digests are enumerated and given slots by a
minimal perfect hash; a look-up compares the digest kept in its slot, so a foreign digest is
never taken for a member.  Counts are scattered into flat arrays by slot and added up through
an array of parents' slots, the deepest nodes first.  Shards meet only in sums by node, each
shard bringing one row for a node, however many conversations pass through it.

What a node adds to the sums of its ancestors is counted in one place only: on the path of
its smallest member, whose shard knows all those ancestors.

Long conversations are cut into blocks of turns.  A digest chain starts anew in each block and
is then tied to the block before; sums pass from block to block by one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import _spread, stored

BLOCK = 4096  # turns of one conversation whose digests are chained in one go
SHARD = 1 << 17  # rows of a shard, about
PACK = 1 << 16  # characters of a piece of a node's list of members
SALTS = 64  # parts of the children of one node
BATCH = 4096  # rows that reach a worker at once; they are small, texts are not among them
WORD = r"[^\x20\x09-\x0D]+"
HEAD = 32  # characters of a text that rows of equal turn and role are ordered by, before its digest


# --- one shard ---------------------------------------------------------------------------


class MinimalHash:
    """Slots 0 to n-1 for n distinct 128-bit keys.

    Level by level, keys fall into a field of places by a seeded hash; those alone in their
    place are settled, the others go on to the next level.  A key's slot is the rank of its
    place among all settled ones.
    """

    ROOM = 2  # places for each key of a level

    def __init__(self, keys: np.ndarray):
        """``keys``: distinct rows of two unsigned 64-bit numbers."""
        self.levels: list[tuple[int, np.ndarray]] = []
        left, before = keys, 0
        while len(left):
            size = self.ROOM * len(left)
            place = self._place(left, size)
            held = np.bincount(place, minlength=size)
            alone = held == 1
            ranks = np.where(alone, before + np.cumsum(alone) - 1, -1)
            self.levels.append((size, ranks))
            before += int(alone.sum())
            left = left[~alone[place]]
        self.kept = np.zeros((before, 2), np.uint64)
        self.kept[self._slots(keys)] = keys

    def _place(self, keys: np.ndarray, size: int, level: int | None = None) -> np.ndarray:
        seed = np.uint64(((len(self.levels) if level is None else level) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (_spread(keys[:, 0] ^ _spread(keys[:, 1] + seed)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, ranks) in enumerate(self.levels):
            found = ranks[self._place(keys[open_], size, level)]
            slots[open_] = found
            open_ = open_[found < 0]
            if not len(open_):
                break
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not members."""
        slots = self._slots(keys)
        if not len(self.kept):
            return slots
        return np.where((slots >= 0) & (self.kept[slots] == keys).all(axis=1), slots, -1)


class NodeTable:
    """The nodes of a shard's rows: flat arrays by slot."""

    def __init__(self, node: np.ndarray, parent: np.ndarray, depth: np.ndarray):
        order = np.lexsort((node[:, 1], node[:, 0]))
        ranked = node[order]
        new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)) if len(node) else np.zeros(0, bool)
        first = order[new]
        self.hash = MinimalHash(node[first])
        self.row_slot = self.hash.slots(node)
        self.n = len(first)
        at = self.row_slot[first]
        self.node, self.parent, self.depth = np.empty((self.n, 2), np.uint64), np.empty((self.n, 2), np.uint64), np.empty(self.n, np.int64)
        self.node[at], self.parent[at], self.depth[at] = node[first], parent[first], depth[first]
        if (self.parent[self.row_slot] != parent).any() or (self.depth[self.row_slot] != depth).any():
            raise ValueError("two different sequences of turns have one digest")
        self.parent_slot = self.hash.slots(self.parent)

    def count(self, values: np.ndarray | int = 1) -> np.ndarray:
        """Sum of ``values`` of the rows by slot."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.row_slot, values)
        return out

    def least(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(out, self.row_slot, values)
        return out

    def gathered(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, as far as they lie in this shard."""
        out = values.copy()
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        for level in np.split(order, cuts):
            up = self.parent_slot[level]
            np.add.at(out, up[up >= 0], out[level[up >= 0]])
        return out


def _keys(batch: pd.DataFrame, *names: str) -> np.ndarray:
    return np.stack([batch[c].to_numpy(np.int64, na_value=0) for c in names], axis=1).view(np.uint64)


def _runs(batches: Iterator[pd.DataFrame], rows: int, whole: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``rows`` rows; rows equal in ``whole``, which lie together, stay together."""
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        if n >= rows:
            edge = 0
            if whole:
                last = held[-1].iloc[-1]
                same = np.logical_and.reduce([batch[c].to_numpy() == last[c] for c in whole])
                edge = len(batch) if same.all() else int(np.argmin(same))
            if edge < len(batch):
                yield pd.concat([*held, batch.iloc[:edge]], ignore_index=True)
                held, n, batch = [], 0, batch.iloc[edge:]
        held.append(batch)
        n += len(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


# --- turns -------------------------------------------------------------------------------


def _wide_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): each conversation's turns by number, from 0.

    Order is by turn (null first); rows of equal turn by role, by the first 32 characters of
    the text, then by the digest of both, so repeated rows stand side by side.  Null roles
    and texts count as empty, rows without conv_id are left out.  Rows are dealt by ranges of
    that order, so a conversation of any size is spread over tasks; no text travels.
    """
    _wide_batches(conversations)
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ("conv_id", "turn", "role", "head", "digest")
    # Equal rows may part: their order is without meaning.
    spread = rows.withColumn("salt", F.rand(7)).repartitionByRange(shuffle_partitions(spark), *order, "salt")
    spread = spread.sortWithinPartitions(*order).select("conv_id", "digest", "words")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, past = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch["conv_id"].to_numpy()
            new = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            size = np.diff(np.append(new, len(conv)))
            at = np.arange(len(conv)) - np.repeat(new, size)
            if conv[0] == last:
                at[: size[0]] += past
            last, past = conv[-1], int(at[-1]) + 1
            yield batch.assign(part=part, at=at)

    made = stored(spread.mapInPandas(number, "conv_id long, digest binary, words long, part int, at long"), "turns")
    sizes = made.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "part", F.sum("n").over(before).alias("before")).where("before > 0")
    # At most one conversation of a part has begun in an earlier one: no more rows than parts.
    return made.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "words"
    )


def with_shared_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the head of another: (turns, ids).

    Conversation c takes the first h turns of conversation c - c % ``group`` (all if it has
    fewer, none if there is no such one) in place of its own first h; h is
    crc32(c as text) % ``heads``.  ``ids`` names all conversations, those without turns too.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ids = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    ids = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    ids = stored(ids.select("conv_id", "base", "h", "taken"), "conversations")
    first = turns.where(F.col("at") < heads - 1).withColumnRenamed("conv_id", "base")
    shared = ids.join(first, "base").where("at < h").select("conv_id", "at", "digest", "words")
    own = turns.join(ids, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "words")
    return shared.unionByName(own), ids.select("conv_id")


NODE, PARENT = ("n0", "n1"), ("p0", "p1")
LINKS = "n0 long, n1 long, p0 long, p1 long"


def _pairs(names: tuple[str, str], digests: list[bytes]) -> dict[str, np.ndarray]:
    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return dict(zip(names, (halves[:, 0], halves[:, 1]), strict=True))


def _joined(a: bytes, b: bytes) -> bytes:
    return hashlib.blake2b(a + b, digest_size=16).digest()


def chained(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, block, words, n0, n1, p0, p1): each turn's node and its parent's, two numbers each.

    The root is 0, 0.  Chains run inside blocks first; the node that a block begins at is
    chained over the blocks, one row each, and joined to what hangs on it.
    """
    _wide_batches(turns)
    root = b"\0" * 16

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, node = None, root
        for batch in batches:
            nodes, ups = [], []
            for conv, part, digest in zip(batch["conv_id"].tolist(), batch["block"].tolist(), batch["digest"], strict=True):
                if now != (conv, part):
                    now, node = (conv, part), root
                ups.append(node)
                node = _joined(node, digest)
                nodes.append(node)
            yield batch.drop(columns="digest").assign(**_pairs(NODE, nodes), **_pairs(PARENT, ups))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entry = None, root
        for batch in batches:
            entries = []
            for conv, node in zip(batch["conv_id"].tolist(), _bytes(batch, NODE), strict=True):
                entry, now = node if conv != now else _joined(entry, node), conv
                entries.append(entry)
            yield pd.DataFrame({"conv_id": batch["conv_id"], "block": batch["block"] + 1, **_pairs(("e0", "e1"), entries)})

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries = _bytes(batch, ("e0", "e1"))
            nodes = [_joined(e, n) for e, n in zip(entries, _bytes(batch, NODE), strict=True)]
            ups = [e if p == root else _joined(e, p) for e, p in zip(entries, _bytes(batch, PARENT), strict=True)]
            yield batch.drop(columns=["e0", "e1"]).assign(**_pairs(NODE, nodes), **_pairs(PARENT, ups))

    columns = f"conv_id long, at long, block long, words long, {LINKS}"
    rows = turns.withColumn("block", F.floor(F.col("at") / block)).select("conv_id", "at", "block", "words", "digest")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    local = stored(rows.mapInPandas(chain, columns), "chains")
    full = local.where(F.col("at") % block == block - 1).select("conv_id", "block", *NODE)
    full = full.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    entries = full.mapInPandas(begin, "conv_id long, block long, e0 long, e1 long")
    later = local.where("block > 0").join(entries, ["conv_id", "block"]).select(*local.columns, "e0", "e1")
    return local.where("block = 0").unionByName(later.mapInPandas(tie, columns))


def _bytes(batch: pd.DataFrame, names: tuple[str, str]) -> list[bytes]:
    flat = np.ascontiguousarray(_keys(batch, *names)).tobytes()
    return [flat[i : i + 16] for i in range(0, len(flat), 16)]


# --- nodes -------------------------------------------------------------------------------


def _counted(rows: DataFrame) -> DataFrame:
    """One row per node: parent, depth, words, n_convs and conv_id, the smallest member."""
    columns = ("n0", "n1", "p0", "p1", "depth", "words", "n_convs", "conv_id")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches, SHARD):
            nodes = NodeTable(_keys(run, *NODE), _keys(run, *PARENT), run["at"].to_numpy() + 1)
            words = np.zeros(nodes.n, np.int64)
            words[nodes.row_slot] = run["words"].to_numpy()
            n, p = nodes.node.view(np.int64), nodes.parent.view(np.int64)
            values = (n[:, 0], n[:, 1], p[:, 0], p[:, 1], nodes.depth, words, nodes.count(), nodes.least(run["conv_id"].to_numpy()))
            yield pd.DataFrame(dict(zip(columns, values, strict=True)))

    found = rows.mapInPandas(look, ", ".join(f"{c} long" for c in columns))
    fixed = ("p0", "p1", "depth", "words")
    made = found.groupBy(*NODE).agg(
        *(f(c).alias(f"{c}_{name}") for c in fixed for name, f in (("low", F.min), ("high", F.max))),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    agree = F.lit(True)
    for c in fixed:
        agree &= F.col(f"{c}_low") == F.col(f"{c}_high")
    differ = F.raise_error(F.lit("two different sequences of turns have one digest")).cast("long")
    return made.select(
        *NODE, *(F.when(agree, F.col(f"{c}_low")).otherwise(differ).alias(c) for c in fixed), "n_convs", "conv_id"
    )


def _carried(rows: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """For long conversations, what the blocks after a block add to its last node: rows as in ``own``."""
    full = rows.where(F.col("at") % block == block - 1).select("conv_id", "block")
    late = own.where(F.col("block") > 0).select("conv_id", "block", "saved", "leaves")
    zero = F.lit(0).cast("long")
    sums = full.select("*", zero.alias("saved"), zero.alias("leaves")).unionByName(late).groupBy("conv_id", "block")
    sums = sums.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "conv_id", "block", ((F.col("block") + 1) * block - 1).alias("at"), F.sum("saved").over(after).alias("saved"), F.sum("leaves").over(after).alias("leaves")
    ).where("saved > 0 or leaves > 0")


def _gathered(rows: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """(n0, n1, saved, leaves): sums of ``own`` over the subtree of each node but the root."""
    none = F.lit(0).cast("long")
    paths = rows.select("conv_id", "block", "at", F.lit(0).alias("part"), *NODE, *PARENT, none.alias("saved"), none.alias("leaves"))
    added = own.unionByName(_carried(rows, own, block))
    added = added.select("conv_id", "block", "at", F.lit(1).alias("part"), *(none.alias(c) for c in (*NODE, *PARENT)), "saved", "leaves")
    both = paths.unionByName(added).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at", "part")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches, SHARD, ("conv_id", "block")):
            is_path = run["part"].to_numpy() == 0
            # What is added stands behind the row of the path that it belongs to.
            row = np.cumsum(is_path) - 1
            path = run[is_path]
            at, up = path["at"].to_numpy(), _keys(path, *PARENT)
            up = np.where((at % block == 0)[:, None], np.uint64(0), up)  # sums do not leave a block here
            nodes = NodeTable(_keys(path, *NODE), up, at + 1)
            out = {}
            for name in ("saved", "leaves"):
                values = np.bincount(row, minlength=len(path)) * 0
                np.add.at(values, row, run[name].to_numpy())
                out[name] = nodes.gathered(nodes.count(values))
            n, some = nodes.node.view(np.int64), (out["saved"] > 0) | (out["leaves"] > 0)
            yield pd.DataFrame({"n0": n[some, 0], "n1": n[some, 1], "saved": out["saved"][some], "leaves": out["leaves"][some]})

    found = both.mapInPandas(look, "n0 long, n1 long, saved long, leaves long")
    return found.groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _ends(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(n0, n1, ends_sha256): digest of the ids of conversations that end at a node, in order.

    Ids are ordered and packed by ranges, so that the one task that must run over a node's
    whole list gets few rows and holds one of them.
    """
    last = rows.groupBy("conv_id").agg(F.max(F.struct("at", *NODE)).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(*(F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in NODE), "conv_id")
    order = (*NODE, "conv_id")
    spread = ends.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, size, out = None, [], 0, []
        for batch in batches:
            for a, b, conv in zip(*(batch[c].tolist() for c in order), strict=True):
                if now is not None and (now[:2] != (a, b) or size > PACK):
                    out.append((*now, ",".join(held)))
                    now = None
                if now is None:
                    now, held, size = (a, b, conv), [], 0
                held.append(str(conv))
                size += len(held[-1])
            yield pd.DataFrame(out, columns=["n0", "n1", "first", "ids"], dtype=object)
            out = []
        if now is not None:
            yield pd.DataFrame([(*now, ",".join(held))], columns=["n0", "n1", "first", "ids"], dtype=object)

    packed = spread.mapInPandas(pack, "n0 long, n1 long, first long, ids string")
    packed = packed.repartition(*NODE).sortWithinPartitions(*NODE, "first")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch["n0"].tolist(), batch["n1"].tolist(), batch["ids"].tolist(), strict=True):
                if now == (a, b):
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["n0", "n1", "ends_sha256"], dtype=object)
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["n0", "n1", "ends_sha256"], dtype=object)

    return packed.mapInPandas(digest, "n0 long, n1 long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, at, digest, words), as ``numbered`` gives them.

    ``ids`` (conv_id) may name further conversations, which have no turn and end at the root.
    Per node: node and parent (digests in hexadecimal; the root's is all zeros, its parent
    null), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves
    and saved_tokens of the subtree, ends_sha256.  No conversation, no node.
    """
    rows = chained(turns, block)
    ids = turns.select("conv_id").distinct() if ids is None else ids
    zero = F.lit(0).cast("long")
    nodes = stored(_counted(rows), "nodes")
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"), zero.alias("depth"), zero.alias("words"), "n_convs", "conv_id")
    every = nodes.unionByName(root)
    # A node's children may be many: they meet their parent's row in parts.
    salt = F.pmod(F.col("n0"), F.lit(SALTS)).alias("salt")
    parts = nodes.groupBy(*PARENT, salt).agg(F.count(F.lit(1)).alias("n"))
    children = parts.groupBy(F.col("p0").alias("n0"), F.col("p1").alias("n1")).agg(F.sum("n").alias("n_children"))
    above = every.select(F.col("n0").alias("p0"), F.col("n1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    above = parts.select(*PARENT, "salt").join(above, list(PARENT))
    counted = stored(every.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", zero)), "counted")
    weight = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    leaf = (F.col("n_children") == 0).cast("long").alias("leaves")
    own = counted.where("depth > 0").select("conv_id", F.floor((F.col("depth") - 1) / block).alias("block"), (F.col("depth") - 1).alias("at"), weight, leaf)
    own = own.where("saved > 0 or leaves > 0")
    # The root's sums are those of all nodes.
    whole = counted.agg(F.sum(weight).alias("saved"), F.sum(leaf).alias("leaves")).where("leaves > 0")
    sums = _gathered(rows, own, block).unionByName(whole.select(*(zero.alias(c) for c in NODE), "saved", "leaves"))
    made = counted.withColumn("salt", salt).join(above, [*PARENT, "salt"], "left").join(sums, list(NODE), "left").join(_ends(rows, ids), list(NODE), "left")

    def hexadecimal(names: tuple[str, str]):
        return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in names)))

    return made.select(
        hexadecimal(NODE).alias("node"), hexadecimal(PARENT).alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
