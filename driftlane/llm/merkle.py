"""Merkle manifest of a dataset by slot pivot.

The nodes of a level are numbered; sixteen consecutive ones make a run. Conditional
aggregates spread a run into sixteen slot columns: the columns concatenated and hashed
are the parent, and all columns but a child's own are its siblings, the level's part of
its proof. What lies above a run is handed down from the few upper nodes, and the runs
of leaves are dealt out again into documents at the end, so that no document is joined
with a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions.positions import SALT, in_lots, lot_offsets, numbered, positions, salted, same
from driftlane.llm.common import LOWER, UPPER
from driftlane.session import materialise

FANOUT = 16
_PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    """Byte count, a colon and the value; a hyphen for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def _slots(table: str = "") -> list[Column]:
    return [F.col(f"{table}s{i}") for i in range(FANOUT)]


def _joined(slots: list[Column]) -> Column:
    return F.concat(F.lit(""), *[F.coalesce(s, F.lit("")) for s in slots])


def _pivot(nodes: DataFrame, digest: Column) -> DataFrame:
    """Runs of a level: ``tree, pos`` of the parent, ``many`` (are there several nodes?) and the slots ``s0, s1, ...``."""
    slot = F.pmod("pos", F.lit(FANOUT))
    return nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos"), (F.col("n_nodes") > 1).alias("many")).agg(
        F.max("n_nodes").alias("n_nodes"), *[F.max(F.when(slot == i, digest)).alias(f"s{i}") for i in range(FANOUT)]
    )


def _parents(runs: DataFrame, slots: list[Column]) -> DataFrame:
    """The next level up: a single node stays what it is."""
    return runs.select(
        "tree", "pos", F.ceil(F.col("n_nodes") / FANOUT).cast("bigint").alias("n_nodes"),
        F.when(F.col("many"), F.sha2(_joined(slots), 256)).otherwise(slots[0]).alias("digest"),
    )


def _around(slots: list[Column], i: int, many: Column) -> Column:
    """The siblings left and right of slot ``i`` as a path of one step, or of none."""
    step = F.array(F.struct(_joined(slots[:i]).alias("left"), _joined(slots[i + 1 :]).alias("right")))
    return F.when(many, step).otherwise(F.array().cast(_PATH))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level over ``tree, pos, n_nodes, digest``, lowest first, and one top node per tree."""
    levels = []
    widest = nodes.agg(F.max("n_nodes")).first()[0] or 1
    while widest > 1:
        runs = materialise(_pivot(nodes, F.col("digest")))
        levels.append(runs)
        nodes = materialise(_parents(runs, _slots()))
        widest = -(-widest // FANOUT)
    return levels, nodes


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tree, pos, path, root`` of the lowest nodes, from the same of the top nodes: each level puts its step in front."""
    above = tops
    for runs in reversed(levels):
        met = runs.alias("r").join(above.alias("a"), same("r", "a", ["tree", "pos"]))
        slots = _slots("r.")
        children = F.array(*[
            F.when(slots[i].isNotNull(), F.struct(
                F.lit(i).alias("slot"), F.concat(_around(slots, i, F.col("r.many")), F.col("a.path")).alias("path")
            )) for i in range(FANOUT)
        ])
        above = materialise(
            met.select("r.tree", "r.pos", "a.root", *_added(above), F.explode(F.filter(children, lambda c: c.isNotNull())).alias("c"))
            .select("tree", (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), F.col("c.path").alias("path"), "root", *_added(above))
        )
    return above


def _added(tops: DataFrame) -> list[str]:
    return [c for c in tops.columns if c not in ("tree", "pos", "path", "root")]


def manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per document: ``doc_id, source, pos, leaf, subroot, root, proof, folded_root, verified``.

    A leaf is the digest of the ``fields``; ``tampered`` is true where a changed copy of
    the text (A-Z in lower case) is to be verified against the manifest. The leaves of a
    source, by ``doc_id``, are hashed up to its subroot, and the subroots by source up
    to the root. ``proof`` is the siblings on the way, level by level, left to right;
    ``folded_root`` is what the leaf to be verified gives with them.

    Null and empty values differ. A null source is a source of its own and comes first,
    null ids come first; rows of one id are ordered by their digests, and repeated rows
    are repeated leaves. Other columns don't count. A text is hashed in memory of its
    own size. An empty table gives an empty result.
    """
    changed = {**{f: F.col(f) for f in fields}, "text": F.translate("text", UPPER, LOWER)}
    # Stored before they are dealt out: finding the ranges reads them once more, and shouldn't hash texts again.
    leaves = materialise(salted(docs.select(
        F.col("source").alias("tree"), "doc_id", leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_digest([changed[f] for f in fields])).alias("other"),
    )))
    order = ["doc_id", "leaf", SALT]
    lots = in_lots(leaves, ["tree"], order)
    sizes = lot_offsets(lots, ["tree"]).withColumn("n_nodes", F.col("total"))
    placed = numbered(lots, sizes, ["tree"], order, "pos")
    # The lowest runs keep what their documents are told apart by.
    lowest = materialise(_pivot(placed, F.struct("leaf", "doc_id", "other")))
    slots = [s.getField("leaf") for s in _slots()]
    levels, tops = _climb(materialise(_parents(lowest, slots)))

    sources = positions(tops.select(F.col("tree").alias("source"), F.col("digest")), [], ["source"], "pos")
    n_sources = tops.count()
    sources = materialise(sources.select(F.lit(0).alias("tree"), "pos", F.lit(n_sources).cast("bigint").alias("n_nodes"), "digest", "source"))
    source_levels, root = _climb(sources.drop("source"))
    start = root.select("tree", "pos", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    below_root = _descend(source_levels, start)
    subroots = sources.alias("s").join(below_root.alias("b"), same("s", "b", ["tree", "pos"])).select(
        F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", "root", F.col("digest").alias("subroot")
    )
    above = _descend(levels, materialise(subroots))

    slots = _slots("r.")
    digests = [s.getField("leaf") for s in slots]
    children = F.array(*[
        F.when(slots[i].isNotNull(), F.struct(
            F.lit(i).alias("slot"), slots[i].alias("own"), _around(digests, i, F.col("r.many")).alias("step")
        )) for i in range(FANOUT)
    ])
    documents = lowest.alias("r").join(above.alias("a"), same("r", "a", ["tree", "pos"])).select(
        "r.tree", "r.pos", "a.path", "a.root", "a.subroot", F.explode(F.filter(children, lambda c: c.isNotNull())).alias("c")
    ).select(
        F.col("c.own.doc_id").alias("doc_id"), F.col("tree").alias("source"), (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"),
        F.col("c.own.leaf").alias("leaf"), "subroot", "root", F.concat("c.step", "path").alias("path"),
        F.coalesce("c.own.other", "c.own.leaf").alias("shown"),
    )
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("shown"), lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
    return documents.select(
        "doc_id", "source", "pos", "leaf", "subroot", "root", proof.alias("proof"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
