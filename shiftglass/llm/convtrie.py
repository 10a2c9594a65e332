"""Conversation prefix trie: sorted turn arrays, LCPs of neighbours, a stack sweep, stitched over partitions.

A turn becomes a 128-bit fingerprint of its role and text, a conversation the concatenation
of its turns', so that a key's prefixes of whole fingerprints are the trie's nodes. Equal
conversations become one key with their number and smallest id. Keys are range-sorted over
the cluster; each task sweeps its keys with a stack of open nodes: the common prefix with
the key before tells which nodes are complete. Nodes on the path of a task's first or last
key may go on in other tasks: what each task knows of them (a row a task and depth, so as
many as tasks times depth, whatever the number of conversations) meets in one place and is
summed up the tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, Scratch, hot_join

WIDTH = 16
#: Ids of one key that travel as one row to its digest.
IDS_AT_ONCE = 8192


# --------------------------------------------------------------------------- keys
def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (mark, words).

    Null turns come first; rows of the same turn are ordered by role and fingerprint. Null
    roles and texts are empty; rows of no conversation (null id) are left out.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    row = F.struct(
        F.col(turn).alias("turn"), who.alias("role"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)).alias("mark"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    kept = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), row.alias("row"))
    ordered = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return ordered.select("conv_id", F.transform("rows", lambda r: F.struct(r["mark"].alias("mark"), r["words"].alias("words"))).alias("turns"))


def rebuilt(found: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c of ``turns``, its first crc32(c) % ``heads`` turns those of conversation c - c % ``family``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = found.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    begun = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return own.join(base, "base", "left").select("conv_id", F.concat(begun, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


# --------------------------------------------------------------------------- the sweep
FIELDS = "id binary, parent_id binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long"
SCHEMA = pa.schema([("id", pa.binary()), ("parent_id", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words"))])
SWEPT = pa.schema([*SCHEMA, ("open", pa.bool_())])


class Node:
    """An open node: what is known of it without its open children."""

    __slots__ = ("state", "words", "edge", "conv", "n", "children", "leaves", "saved")

    def __init__(self, state, words: int, edge: bool):
        self.state, self.words, self.edge = state, words, edge
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0

    def meet(self, conv: int | None, n: int) -> None:
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
            self.n += n

    def close(self) -> None:
        """All of it is known: count itself."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words


def sweep(batches):
    """Nodes of the sorted keys (key, conv_id, n, words) of a task; ``open`` ones may go on in others."""
    stack, before, out = [], None, []

    def put(depth: int, node: Node, edge: bool) -> None:
        above = stack[depth - 1].state.digest() if depth else None
        out.append((node.state.digest(), above, depth, node.conv, node.n, node.children, node.leaves, node.saved, node.words, edge))

    def shut(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if node.edge:
                put(len(stack), node, True)
                continue
            node.close()
            put(len(stack), node, False)
            up = stack[-1]
            up.meet(node.conv, node.n)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved

    def rows():
        got = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SWEPT)], schema=SWEPT)
        out.clear()
        return got

    for b in batches:
        for key, conv, n, words in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "n", "words"))):
            common = 0
            if before is None:
                stack.append(Node(hashlib.md5(), 0, True))
            else:
                most = min(len(key), len(before))
                while common < most and key[common : common + WIDTH] == before[common : common + WIDTH]:
                    common += WIDTH
                shut(common // WIDTH + 1)
            for k in range(common, len(key), WIDTH):
                state = stack[-1].state.copy()
                state.update(key[k : k + WIDTH])
                stack.append(Node(state, words[k // WIDTH], before is None))
            stack[-1].meet(conv, n)
            before = key
            if len(out) >= 10_000:
                yield rows()
    for node in stack:
        node.edge = True
    shut(0)
    if out:
        yield rows()


def stitch(table: pa.Table) -> pa.Table:
    """Whole nodes from what the tasks know of open ones."""
    nodes, up, depth = {}, {}, {}
    for r in table.to_pylist():
        node = nodes.setdefault(r["id"], Node(None, r["words"], True))
        node.meet(r["conv_id"], r["n_convs"])
        node.children, node.leaves, node.saved = node.children + r["n_children"], node.leaves + r["n_leaves"], node.saved + r["saved_tokens"]
        up[r["id"]], depth[r["id"]] = r["parent_id"], r["depth"]
    out = []
    for i in sorted(nodes, key=depth.get, reverse=True):
        node, above = nodes[i], nodes.get(up[i])
        node.close()
        if above is not None:
            above.meet(node.conv, node.n)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        out.append((i, up[i], depth[i], node.conv, node.n, node.children, node.leaves, node.saved, node.words))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)


# --------------------------------------------------------------------------- digests of members
def id_runs(batches):
    """(id, first, ids): ids of a key in order, comma-joined, some thousands a row."""
    for b in batches:
        key, conv = b.column("id").to_pylist(), b.column("conv_id").to_pylist()
        out, a = [], 0
        for i in range(1, len(key) + 1):
            if i == len(key) or key[i] != key[a] or i - a == IDS_AT_ONCE:
                out.append((key[a], conv[a], ",".join(map(str, conv[a:i]))))
                a = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["id", "first", "ids"])


def digests(batches):
    """(id, ends_sha256) of sorted runs, one open digest at a time."""
    at, state = None, None
    for b in batches:
        out = []
        for key, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist()):
            if key != at:
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["id", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])


def trie(found: DataFrame) -> DataFrame:
    """The nodes of the prefix trie over (conv_id, turns: structs of mark, words), one row each.

    Conversations without a turn belong to the root alone; repeated conversations are members
    of the same nodes. A conversation's fingerprints (16 bytes a turn) must fit a row. An
    empty table has no member and so no node.
    """
    scratch = Scratch(found.sparkSession, "trie")
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("key")
    keyed = scratch.keep(found.select("conv_id", key, F.transform("turns", lambda t: t["words"]).alias("words")))
    # a key's words are the same in all its conversations
    classes = scratch.keep(keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("words").alias("words")))
    swept = scratch.keep(classes.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(sweep, FIELDS + ", open boolean"))
    whole = swept.where("open").drop("open").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(stitch, FIELDS)
    nodes = scratch.keep(swept.where("not open").drop("open").unionByName(whole))
    facts = nodes.where("n_children > 0").select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("asked"))
    named = hot_join(nodes, facts, ["parent_id"], "asked", max(nodes.count(), 1), ["id"])

    members = scratch.keep(keyed.select(F.unhex(F.md5("key")).alias("id"), "conv_id"))
    runs = members.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(id_runs, "id binary, first long, ids string")
    ends = runs.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digests, "id binary, ends_sha256 string")
    none = hashlib.sha256().hexdigest()
    return named.join(ends, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
