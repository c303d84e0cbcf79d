"""The prefix trie of conversations, measured by an Euler tour.

A node is the sequence of the first turns that some conversations share. Every node
gives an arc that enters it and one that leaves it; the arcs form one list, the tour.
Its list ranks put the arcs in order without walking down the tree, however deep or wide
it is, and what a subtree holds is a difference of two prefix sums: at the arc that
leaves the node and the one that enters it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions.positions import SALT, in_lots, lot_offsets, numbered, positions, salted, same
from driftlane.llm.list_ranking import list_ranks
from driftlane.session import materialise

#: Turns of a conversation, and arcs of the tour, that one window sees at most.
BLOCK = 1024
ARCS = 65_536
NODE = ["depth", "x1", "x2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ENDS = "depth bigint, x1 bigint, x2 bigint, ends_sha256 string"


def turn_digest(role: Column, text: Column) -> Column:
    """Tells turns apart, and orders turns of one number."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def _original(conversations: DataFrame) -> DataFrame:
    return materialise(salted(conversations.select(
        "conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"),
    )))


def rebuilt(conversations: DataFrame, group: int = 5, turns: int = 9) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, digest, bytes, length`` of all turns, and ``conv_id, length`` of all conversations.

    Conversation c starts with the first h turns of conversation c - c % ``group``, h being
    crc32(c) % ``turns``, and goes on with its own turns after its first h.
    """
    order = ["turn", "digest", SALT]
    lots = in_lots(_original(conversations), ["conv_id"], order)
    offsets = materialise(lot_offsets(lots, ["conv_id"]))
    own = offsets.groupBy("conv_id").agg(F.max("total").alias("own")).withColumns({
        "donor": F.col("conv_id") - F.col("conv_id") % group,
        "h": F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns, F.lit(0)),
    })
    lengths = own.select(F.col("conv_id").alias("donor"), F.col("own").alias("of_donor"))
    members = own.join(lengths, "donor", "left").withColumn(
        "taken", F.least("h", F.coalesce("of_donor", F.lit(0)))
    ).select("conv_id", "donor", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    members = materialise(members)
    # What a conversation's rows need to know goes along with the offset of each lot: a long one isn't one join key.
    offsets = offsets.alias("a").join(members.alias("b"), same("a", "b", ["conv_id"])).select("a.*", "b.h", "b.taken", "b.length")
    ranked = materialise(numbered(lots, offsets, ["conv_id"], order, "n"))
    later = ranked.where("n >= h").select(
        "conv_id", (F.col("n") + 1 - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes", "length"
    )
    lent = ranked.where(F.col("n") < turns).select(F.col("conv_id").alias("donor"), "n", "digest", "bytes")
    first = lent.join(members.select("conv_id", "donor", "taken", "length"), "donor").where("n < taken").select(
        "conv_id", (F.col("n") + 1).alias("depth"), "digest", "bytes", "length"
    )
    return later.unionByName(first), members.select("conv_id", "length")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Adds the hash ``x1, x2`` of the turns up to each turn and ``p1, p2`` of those before it.

    The hash of a prefix is the exclusive or of its turns' hashes, each taken with its depth; it is rolled
    per block of turns first, so that no window holds a long conversation.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK)
    hashed = materialise(turns.withColumns({
        "block": block, "h1": F.xxhash64("depth", "digest"), "h2": F.xxhash64("digest", F.lit(1), "depth"),
    }))
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several blocks have any; the table's size decides how it is joined.
    blocks = materialise(blocks.select(
        "conv_id", "block", F.bit_xor("b1").over(ahead).alias("a1"), F.bit_xor("b2").over(ahead).alias("a2")
    ).where("block > 0"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"r1": F.bit_xor("h1").over(inside), "r2": F.bit_xor("h2").over(inside)})

    def whole(rolled_hash: str, block_hash: str) -> Column:
        return F.col(rolled_hash).bitwiseXOR(F.coalesce(block_hash, F.lit(0)))

    return rolled.alias("a").join(blocks.alias("b"), same("a", "b", ["conv_id", "block"]), "left").select(
        *[F.col(f"a.{c}") for c in turns.columns], "a.h1", "a.h2", whole("a.r1", "b.a1").alias("x1"), whole("a.r2", "b.a2").alias("x2")
    ).withColumns({"p1": F.col("x1").bitwiseXOR(F.col("h1")), "p2": F.col("x2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2")


def _nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: its hash, its parent's, the smallest member, the members and the bytes of its last turn."""
    below = turns.groupBy(*NODE, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("bytes")
    )
    return below.unionByName(root)


def _hashes(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each node's list, read as a stream: only the state of the hash is kept, however long the list is."""
    now, state, found = None, None, []
    for batch in rows:
        for depth, x1, x2, member in zip(batch["depth"], batch["x1"], batch["x2"], batch["member"]):
            if (depth, x1, x2) != now:
                if state:
                    found.append((*now, state.hexdigest()))
                now, state = (depth, x1, x2), hashlib.sha256(member.encode())
            else:
                state.update(b"," + member.encode())
        if found:
            yield pd.DataFrame(found, columns=["depth", "x1", "x2", "ends_sha256"])
            found = []
    if state:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=["depth", "x1", "x2", "ends_sha256"])


def _ends(turns: DataFrame, members: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    ends = turns.where("depth = length").select(*NODE, "conv_id").unionByName(
        members.where("length = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id")
    )
    ordered = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").select(
        *NODE, F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("member")
    )
    return ordered.mapInPandas(_hashes, _ENDS)


def _tree(nodes: DataFrame) -> DataFrame:
    """Nodes numbered ``v`` so that children of one parent follow each other, with their place among them."""
    v = materialise(positions(nodes, [], ["depth", "p1", "p2", "conv_id", "x1", "x2"], "v"))
    family = ["depth", "p1", "p2"]
    # Per lot: the children of one node may be many.
    per_lot = v.where("depth > 0").groupBy(*family, "lot").agg(
        F.count("*").alias("here"), F.min("v").alias("first"), F.max("v").alias("last")
    )
    everything = Window.partitionBy(*family)
    families = materialise(per_lot.select(
        *family, "lot", F.min("first").over(everything).alias("first"), F.max("last").over(everything).alias("last"),
        F.sum("here").over(everything).alias("n_children"),
    ))
    parents = v.select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("v").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    of_child = families.join(parents, family).select(*family, "lot", "last", "parent", "parent_conv_id")
    of_parent = families.groupBy(*family).agg(F.max("first").alias("first_child"), F.max("n_children").alias("n_children")).select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), "first_child", "n_children"
    )
    return materialise(
        v.join(of_child, [*family, "lot"], "left").drop("lot").join(of_parent, NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    )


def _arcs(tree: DataFrame) -> DataFrame:
    """The tour: node ``v`` is entered by arc 2 v and left by arc 2 v + 1."""
    v, none = F.col("v"), F.lit(None).cast("bigint")
    after_enter = F.coalesce(2 * F.col("first_child"), 2 * v + 1)
    after_exit = F.when(v < F.col("last"), 2 * (v + 1)).when(F.col("parent").isNotNull(), 2 * F.col("parent") + 1).otherwise(none)
    arc = F.explode(F.array(
        F.struct((2 * v).alias("element"), after_enter.alias("to")), F.struct((2 * v + 1).alias("element"), after_exit.alias("to")),
    ))
    return tree.select(arc.alias("arc")).select("arc.element", "arc.to")


def _subtree_sums(tree: DataFrame) -> DataFrame:
    """``v, enter_at, exit_at, n_leaves, saved_tokens`` from prefix sums along the tour; a node counts where it is entered."""
    n_arcs = 2 * tree.count()
    weights = tree.select(
        F.explode(F.array(2 * F.col("v"), 2 * F.col("v") + 1)).alias("element"), (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    ).withColumns({c: F.when(F.col("element") % 2 == 0, F.col(c)).otherwise(0) for c in ("leaf", "saved")})
    at = F.lit(n_arcs) - F.col("rank")
    tour = materialise(weights.join(list_ranks(_arcs(tree)), "element").withColumn("at", at).withColumn("block", F.floor(at / ARCS)))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per 65,536 arcs.
    blocks = tour.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select(
        "block", F.coalesce(F.sum("leaf").over(ahead), F.lit(0)).alias("leaf_ahead"),
        F.coalesce(F.sum("saved").over(ahead), F.lit(0)).alias("saved_ahead"),
    )
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = tour.withColumns({"leaf_here": F.sum("leaf").over(inside), "saved_here": F.sum("saved").over(inside)}).join(blocks, "block")
    enters = F.col("element") % 2 == 0

    def difference(name: str) -> Column:
        before = F.col(f"{name}_ahead") + F.col(f"{name}_here") - F.col(name)
        return F.sum(F.when(enters, -before).otherwise(before)).alias(name)

    return summed.groupBy(F.floor(F.col("element") / 2).alias("v")).agg(
        F.max(F.when(enters, F.col("at"))).alias("enter_at"), F.max(F.when(~enters, F.col("at"))).alias("exit_at"),
        difference("leaf"), difference("saved"),
    ).select("v", "enter_at", "exit_at", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, group: int = 5, turns: int = 9) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs`` (members),
    ``n_children, n_leaves`` (nodes without children in the subtree), ``saved_tokens`` (bytes
    that the subtree's turns need less if shared ones are kept once), ``ends_sha256`` (of the
    members that end at the node) and ``enter_at, exit_at`` (the node's place in the tour).

    Turns are ordered by number, null first; turns of one number by a digest of role and
    text; repeated rows are repeated turns. Null roles and texts are empty. Rows without a
    conversation id are one conversation: it borrows no turns, is smallest only where it is
    alone, and its id in a list of ends is empty and first. Other columns don't count. An
    empty table gives an empty result. The list of ends of a node is hashed as a stream by
    one task, because SHA-256 can't be put together from parts; its memory stays the same.
    """
    rows, members = rebuilt(conversations, group, turns)
    rows = materialise(with_prefixes(rows))
    tree = _tree(_nodes(rows, members))
    result = tree.join(_subtree_sums(tree), "v").join(_ends(rows, members), NODE, "left")
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "enter_at", "exit_at",
    )
