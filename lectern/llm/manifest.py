"""A dataset manifest: a hash tree over the rows of a table, with versions by copied paths.

A row's fields give its leaf. The leaves of a group (a source) in key order are hashed ``FAN`` by
``FAN`` until one node, the group's subroot, is left; subroots in group order give the root likewise.

The tree is persistent. A changed leaf starts a version that shares every node off its path and copies
its ancestors only. Nodes live in rows of ``BLOCK`` aligned nodes, three levels of the tree at a time:
inside such a row the ancestors are copied next to their untouched siblings, and above it the version
goes on along the path that all leaves of the block share. Upper nodes are again cut into aligned
blocks, so no row of the tree grows with the table and a group of any size is spread over many rows.

All of it is DataFrame functions. Positions in a group come from a range-sorted, written table, so a
retried task finds the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.columns import narrow
from lectern.session import apart, pin

FAN = 16
LEVELS = 3
BLOCK = FAN**LEVELS

PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(column: Column) -> Column:
    """A field as it enters a leaf: ``-`` for null, else byte count, colon and value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def _above(nodes: Column) -> Column:
    """One level up: the digests of every ``FAN`` consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "")))


def _step(nodes: Column, at: Column) -> Column:
    """The siblings of node ``at`` in its run: digests left of it and right of it, joined."""
    inside = at % FAN
    left = F.slice(nodes, at - inside + 1, inside)
    right = F.slice(nodes, at + 2, FAN - 1 - inside)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _climb(start: Column, path: Column) -> Column:
    """The node at the path's end if ``start`` stands at its beginning: every ancestor is a copy."""
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def _siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _shared_path(at: Column) -> Column:
    """What the leaves below node ``at`` of ``level1`` share of their paths inside the row."""
    steps = [_step(F.col(f"level{k}"), F.floor(at / FAN ** (k - 1)).cast("int")) for k in range(1, LEVELS)]
    return F.slice(F.array(*steps).cast(PATH), F.lit(1), F.greatest(F.col("levels") - 1, F.lit(0)))


def _inside(member: Column) -> Column:
    return (member["pos"] % BLOCK).cast("int")


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (from 0, in ``order`` within ``group``) and ``n``, the group's size.

    ``group`` must not be null. One range shuffle; a group larger than a task is spread over several,
    and the places before each come from counts (one row per group and task).
    """
    keys = [group, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = pin(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = numbered.groupBy(group, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group,
        "__part",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(Window.partitionBy(group)).alias("n"),
    )
    placed = numbered.withColumn("__part", part).join(starts, [group, "__part"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def blocks(nodes: DataFrame, group: str, members: Sequence[str]) -> DataFrame:
    """One row per aligned block of ``nodes`` (``group``, ``pos``, ``n``, ``digest`` and ``members``).

    ``level0`` to ``level2`` are the digests of its nodes and of the two levels above, ``levels`` how
    many levels the row climbs, ``top`` the node it ends in, ``members`` its nodes' columns in order.
    """
    rows = nodes.groupBy(group, F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "digest", *members))).alias("members"),
    )
    levels = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        levels = F.when(F.col("n") <= FAN**k, k).otherwise(levels)
    rows = rows.select("*", levels.alias("levels"), F.col("members.digest").alias("level0"))
    for k in range(1, LEVELS + 1):
        below = F.col(f"level{k - 1}")
        rows = rows.withColumn(f"level{k}", F.when(F.col("levels") >= k, _above(below)).otherwise(below))
    # Worked out once per run and written down with the row, not again for every leaf.
    runs = F.sequence(F.lit(0), F.size("level1") - 1)
    rows = rows.withColumn("shared", F.transform(runs, _shared_path))
    return rows.select(
        group, "block", "n", "levels", "members", "level0", "shared", F.col(f"level{LEVELS}")[0].alias("top"),
        F.transform("shared", _siblings).alias("shared_text"),
    )


def paths(nodes: DataFrame, group: str) -> DataFrame:
    """``group``, ``pos``, ``digest``, ``path`` to the group's subroot, and ``subroot``, of every node.

    Meant for the upper nodes, of which there is one per block below.
    """
    here = pin(blocks(nodes, group, []))

    def own(member: Column) -> Column:
        at = _inside(member)
        first = F.slice(F.array(_step(F.col("level0"), at)), F.lit(1), F.least("levels", F.lit(1)))
        path = F.concat(first, F.col("shared")[F.floor(at / FAN).cast("int")])
        return F.struct(member["pos"].alias("pos"), member["digest"].alias("digest"), path.alias("path"))

    local = here.select(group, "block", "top", F.inline(F.transform("members", own)))
    if here.where(F.col("n") > BLOCK).isEmpty():
        return local.select(group, "pos", "digest", "path", F.col("top").alias("subroot"))
    upper = paths(_tops(here, group), group)
    upper = upper.select(group, F.col("pos").alias("block"), F.col("path").alias("__above"), "subroot")
    joined = local.join(upper, [group, "block"])
    return joined.select(group, "pos", "digest", F.concat("path", "__above").alias("path"), "subroot")


def _tops(rows: DataFrame, group: str) -> DataFrame:
    n = F.ceil(F.col("n") / BLOCK).cast("long")
    return rows.select(group, F.col("block").alias("pos"), n.alias("n"), F.col("top").alias("digest"))


@dataclass(frozen=True)
class Manifest:
    """``base``: one row per aligned block of leaves, with what the tree has above it.

    ``subroots``: ``group`` and ``subroot``; ``root``: one row, or none for an empty table.
    """

    base: DataFrame
    subroots: DataFrame
    root: DataFrame

    def versions(self) -> DataFrame:
        """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` and ``folded_root`` of every row.

        ``proof`` is the digest of the path's siblings, bottom up and left to right. ``folded_root`` is
        the root of the row's version: for a changed leaf its ancestors are copied, all else is shared;
        rows without a change share the version of their block.
        """
        def row(member: Column) -> Column:
            at = _inside(member)
            run = F.floor(at / FAN).cast("int")
            step = _step(F.col("level0"), at)
            first = F.slice(F.array(step), F.lit(1), F.least("levels", F.lit(1)))
            copied = _climb(_climb(_climb(member["changed"], first), F.col("shared")[run]), F.col("above"))
            beside = F.concat(step["left"], step["right"], F.col("shared_text")[run], F.col("above_text"))
            return F.struct(
                member["doc_id"].alias("doc_id"),
                member["digest"].alias("leaf"),
                digest(beside).alias("proof"),
                F.when(member["changed"].isNull(), F.col("untouched")).otherwise(copied).alias("folded_root"),
            )

        return self.base.select("subroot", "root", F.inline(F.transform("members", row))).select(
            "doc_id", "leaf", "subroot", "root", "proof", "folded_root"
        )


def build_manifest(leaves: DataFrame, doc_id: str = "doc_id", group: str = "source", digest: str = "leaf", changed: str = "changed") -> Manifest:
    """The tree over ``leaves``: per row an id, a group, the leaf's digest, and that of a changed leaf or null.

    Leaves of a group ascend by id, a null id first, then by digest: rows that tie in both are equal
    leaves, so which comes first makes no difference. The null group comes first, then groups bytewise.
    An id may repeat; every row has a leaf of its own. Further columns are ignored. An empty table has
    no subroots and no root.
    """
    rows = narrow(leaves, doc_id=doc_id, source=group, digest=digest, changed=changed)
    # A mark before each group's name keeps null apart from the empty name, and first.
    rows = pin(rows.select("doc_id", "digest", "changed", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")))
    base = pin(blocks(positions(rows, "key", ["doc_id", "digest"]), "key", ["doc_id", "changed"]))
    above = pin(paths(_tops(base, "key"), "key"))
    subroots = pin(above.where("pos = 0").select("key", "subroot"))
    ranked = positions(subroots.select(F.lit("").alias("all"), "key", F.col("subroot").alias("digest")), "all", ["key"])
    ranked = pin(ranked)
    to_root = paths(ranked, "all").withColumnRenamed("subroot", "root").join(ranked.select("pos", "key"), "pos")
    to_root = pin(to_root.select("key", F.col("path").alias("__to_root"), "root"))
    joined = above.join(apart(to_root), "key").select(
        "key", F.col("pos").alias("block"), "digest", "subroot", "root", F.concat("path", "__to_root").alias("above")
    )
    # The version without a change is folded once per block, from the block's own node.
    beyond = pin(joined.select(
        "key", "block", "subroot", "root", "above",
        _siblings(F.col("above")).alias("above_text"), _climb(F.col("digest"), F.col("above")).alias("untouched"),
    ))
    named = subroots.select(F.expr("CASE WHEN key <> '' THEN substr(key, 2) END").alias("source"), "subroot")
    return Manifest(base.join(beyond, ["key", "block"]), named, to_root.select("root").limit(1))
