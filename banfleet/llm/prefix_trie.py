"""Trie of conversation prefixes, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. A turn's hash depends on its content and its place, so
the exclusive or of a conversation's first d hashes names the node at depth d, and taking the last
turn's hash out again names the parent. Rounds of joins contract the tree: leaves are raked, their
totals added to their parents; of each unary chain, nodes that no neighbour in the chain precedes by
a random mark are spliced out, their own totals pushed up. Then the rounds are undone, last first:
what was spliced out has its own total and that of the child it had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from banfleet.llm.workers import discard, written
from banfleet.operators.running import CHUNK_COLUMN, running, running_count, running_xor

#: Rows of a conversation that one task numbers, and ids of a node's members in one string: 2 to the power of these.
_ROWS, _IDS = 14, 12
#: First turns that a branched conversation may take from another, less one, and ids that share one.
HEADS, FAMILY = 6, 100
NODE = ["conv_id", "depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, pos from 1, digest, chars) in the order of ``turn``, nulls first.

    Equal turns are ordered by role, then text; null roles and texts are empty. Rows with a null
    conv_id belong to no conversation and go.
    """
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    stretch = F.coalesce(F.shiftright("turn", _ROWS), F.lit(-(1 << 62)))
    placed = running(rows, ["conv_id"], ["turn", "role", "text"], {"pos": running_count()}, chunk=stretch)
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return placed.select("conv_id", "pos", F.sha2(content, 256).alias("digest"), F.length("text").cast("long").alias("chars"))


def branched(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """Conversations that begin like the first one of their family.

    Each conversation c has the first h turns of conversation c - c % ``family`` (all if it has
    fewer, none if it isn't there), then its own from the h + 1st on; h is crc32(c) % ``heads``.
    ``turns`` is a table as :func:`numbered` gives it.
    """
    ids = turns.where("pos = 1").select("conv_id")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads))
    first = first.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("_head"))
    c = F.col("conv_id")
    starts = ids.select("conv_id", (c - c % family).alias("_base"), (F.crc32(c.cast("string")) % heads).cast("int").alias("_h"))
    given = F.slice(F.coalesce("_head", F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")), F.lit(1), F.col("_h"))
    starts = starts.join(first, "_base", "left").select("conv_id", "_h", given.alias("_given"))
    own = turns.join(starts.select("conv_id", "_h", F.size("_given").alias("_k")), "conv_id").where("pos > _h")
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("pos"), "digest", "chars")
    return own.unionByName(starts.select("conv_id", F.inline("_given")))


def _mark(n: int, conv: Column, depth: Column) -> Column:
    return F.xxhash64(F.lit(n), conv, depth)


def _added(columns: list[str], more: str) -> list[Column]:
    return [(F.col(c) + F.coalesce(F.col(f"{more}_{c}"), F.lit(0).cast("long"))).alias(c) for c in columns]


def subtree_totals(nodes: DataFrame, values: list[str], node: list[str] = NODE) -> DataFrame:
    """Sums of ``values`` (long) over every node's subtree, the node included.

    ``nodes`` has the two integer columns ``node``, those of the parent as ``parent_0`` and
    ``parent_1`` (null: a root), ``n``, the number of children, and the values. A round rakes all
    leaves and splices out about a third of each chain, so rounds go with the logarithm of the
    number of nodes, and each is smaller than the last. No rows, no totals.
    """
    a, b = node
    up, parent, zero = ["parent_0", "parent_1"], F.col("parent_0").isNotNull(), F.lit(0).cast("long")
    state, rounds, left = written(nodes.select(*node, *up, "n", *values), "trie"), [], 1
    scratch = [state]
    while left:
        leaf, mark = F.col("n") == 0, len(rounds)
        below = state.where(parent).groupBy(*up).agg(
            *[F.sum(F.when(leaf, F.col(v))).alias(f"raked_{v}") for v in values],
            F.count_if(~leaf).alias("_n"), F.max(F.when(~leaf, F.col(a))).alias("child_0"), F.max(F.when(~leaf, F.col(b))).alias("child_1"),
        )
        below = below.withColumnsRenamed({"parent_0": a, "parent_1": b})
        here = _mark(mark, F.col(a), F.col(b))
        first = (here < _mark(mark, F.col("child_0"), F.col("child_1"))) & (here < _mark(mark, *map(F.col, up)))
        over = F.coalesce((F.col("_n") == 1) & parent & first, F.lit(False))
        kept = state.where(~leaf).join(below, node, "left")
        kept = kept.select(*node, *up, F.col("_n").alias("n"), "child_0", "child_1", *_added(values, "raked"), over.alias("spliced"))
        # what a node that goes tells its child (a new parent) and its parent (its own totals)
        none = F.lit(None).cast("long")
        told = F.array(
            F.struct(F.col("child_0").alias(a), F.col("child_1").alias(b), *up, *[zero.alias(v) for v in values]),
            F.struct(F.col("parent_0").alias(a), F.col("parent_1").alias(b), *[none.alias(u) for u in up], *values),
        )
        changes = kept.where("spliced").select(F.inline(told)).groupBy(*node).agg(
            *[F.max(u).alias(f"_{u}") for u in up], *[F.sum(v).alias(f"pushed_{v}") for v in values]
        )
        after = kept.join(changes, node, "left").select(
            *node, *[F.coalesce(f"_{u}", u).alias(u) for u in up], "n", "child_0", "child_1", *_added(values, "pushed"), "spliced"
        )
        seen = Observation()
        after = written(after.observe(seen, F.count_if(~F.col("spliced")).alias("left"), F.count_if("spliced").alias("cut")), "trie")
        left = seen.get["left"]
        rounds.append((state.where("n = 0"), after.where("spliced") if seen.get["cut"] else None))
        scratch.append(after)
        state = after.where("not spliced").drop("child_0", "child_1", "spliced")
    known = state.select(*node, *values)
    for raked, cut in reversed(rounds):
        parts = [raked.select(*node, *values)]
        if cut is not None:
            later = known.select(F.col(a).alias("child_0"), F.col(b).alias("child_1"), *[F.col(v).alias(f"child_{v}") for v in values])
            parts.append(written(cut.join(later, ["child_0", "child_1"]).select(*node, *_added(values, "child")), "totals"))
            scratch.append(parts[-1])
        for part in parts:
            known = known.unionByName(part)
    totals = written(known, "totals")
    discard(*scratch)
    return totals


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its members' ids, a bounded string at a time."""
    at, digest, out = None, None, []

    def frame() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=[*NODE, "ends_sha256"])

    for batch in batches:
        for conv, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at == (conv, depth):
                digest.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((*at, digest.hexdigest()))
            at, digest = (conv, depth), hashlib.sha256(ids.encode())
        if out:
            yield frame()
            out = []
    if at is not None:
        out.append((*at, digest.hexdigest()))
        yield frame()


def _ends(prefixes: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("last"))
    zero = F.lit(0).cast("long")
    ended = ids.join(last, "conv_id", "left").select(
        F.col("conv_id").alias("_c"), *[F.coalesce(f"last.{x}", zero).alias(y) for x, y in (("pos", "depth"), ("p1", "p1"), ("p2", "p2"))]
    )
    members = ended.join(nodes.select("depth", "p1", "p2", "conv_id"), ["depth", "p1", "p2"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c.cast("string")), ",")
    parts = members.groupBy(*NODE, F.shiftright("_c", _IDS).alias("_part")).agg(texts.alias("_ids"))
    dealt = parts.repartition(*NODE).sortWithinPartitions(*NODE, "_part").select(*NODE, "_ids")
    return dealt.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations, one row each.

    ``turns`` has conv_id, pos (1, 2, ... in each conversation), digest (of the turn's content) and
    chars; ``ids`` all conv_ids once, those without turns too. A node is named by its smallest
    member and its depth. Columns: conv_id, depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves and saved_tokens (over the subtree; a node saves its chars once for each
    member but one), ends_sha256 (ids of the members that end there, ascending). No ids, no nodes.
    """
    hashes = {f"z{i}": F.xxhash64(F.lit(i), "pos", "digest") for i in (1, 2)}
    rows = turns.withColumns(hashes).drop("digest")
    prefixes = running(rows, ["conv_id"], "pos", {f"p{i}": running_xor(F.col(f"z{i}")) for i in (1, 2)}, width=1 << _ROWS)
    prefixes = written(prefixes, "prefixes")
    up = [F.max(F.col(f"p{i}").bitwiseXOR(F.col(f"z{i}"))).alias(f"q{i}") for i in (1, 2)]
    found = prefixes.groupBy(F.col("pos").alias("depth"), "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *up
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("chars"), none.alias("q1"), none.alias("q2")
    )
    found = written(found.unionByName(root), "nodes")
    above = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id")
    )
    nodes = written(found.join(above, ["depth", "q1", "q2"], "left").drop("q1", "q2"), "nodes")
    above_depth = F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1)
    parents = nodes.withColumn("parent_depth", above_depth)
    fanout = parents.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth"))
    n = F.coalesce("n_children", zero)
    tree = parents.join(fanout.agg(F.count(F.lit(1)).alias("n_children")), NODE, "left").withColumn("n_children", n)
    own = tree.select(
        *NODE, F.col("parent_conv_id").alias("parent_0"), F.col("parent_depth").alias("parent_1"), F.col("n_children").alias("n"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    every = tree.select(*NODE, "parent_conv_id", "n_convs", "n_children").join(totals, NODE)
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return every.join(_ends(prefixes, ids, nodes), NODE, "left").withColumn("ends_sha256", ends)


def branched_trie(conversations: DataFrame) -> DataFrame:
    """The trie of :func:`branched` conversations; see there, :func:`numbered` and :func:`trie`.

    Other columns aren't read, and an empty table gives no rows.
    """
    turns = written(numbered(conversations), "turns")
    ids = turns.where("pos = 1").select("conv_id")
    return trie(branched(turns), ids)
