"""Documents whose word shingles overlap, by an LSH forest of MinHash prefixes and exact verification.

A text's MinHash values form one label per tree; texts sorted by label are a prefix trie. The matched
prefix starts at the full label and is shortened until a pair at the similarity threshold shares a
prefix in some tree with the target probability, so ``matched_depth`` follows from threshold, trees and
target. Texts under one trie node are compared exactly, on their whole sets of shingles.

Equal texts are one text with a count from the start. Nodes with the same members are compared once. A
node of any size is cut into blocks by counted size; a task compares two blocks and returns per text
what it found, and enough edges to connect it, never the pairs. A pair under several nodes counts at
the first.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map, mixed, slices
from lectern.llm.components import components
from lectern.operators.running import number_rows
from lectern.session import apart, pin

BLOCK = 256
_NODE_BITS = np.uint64((1 << 56) - 1)


def matched_depth(threshold: float, trees: int, label: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``target``."""
    for depth in range(label, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(tokens: list[str], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``n`` words; a shorter text is one run; none if empty."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(tokens)}
    hashed = np.array([known[w] for w in tokens], dtype=np.uint64)
    n = min(n, len(hashed))
    size = len(hashed) - n + 1
    rolled = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + size])
    return np.unique(rolled)


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 2**63, size=count, dtype=np.uint64)


def trie_nodes(grams: np.ndarray, trees: int, depth: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each tree, the id of the node at ``depth`` that holds the text; ids tell trees apart."""
    least = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(grams), 2048):
        values = grams[start : start + 2048, None] * family[0] + family[1]
        np.minimum(least, (values ^ (values >> np.uint64(29))).min(axis=0), out=least)
    node = np.zeros(trees, dtype=np.uint64)
    for level in least.reshape(trees, depth).T:
        node = mixed(node * np.uint64(31) + level)
    return ((np.arange(trees, dtype=np.uint64) << np.uint64(56)) | (node & _NODE_BITS)).view(np.int64)


def compare(node: int, left: dict, right: dict | None, threshold: float) -> dict:
    """Links between two blocks of a node (or within one): per text counts, and its block's smallest linked id."""
    sides = [left] if right is None else [left, right]
    docs = np.concatenate([s["doc"] for s in sides])
    docs, first = np.unique(docs, return_index=True)
    copies = np.concatenate([s["copies"] for s in sides])[first]
    nodes = np.concatenate([s["nodes"] for s in sides])[first]
    sets = [x for s in sides for x in s["grams"]]
    sets = [sets[i] for i in first]
    n = np.array([len(x) for x in sets])
    in_left = np.isin(docs, left["doc"])
    owner = np.repeat(np.arange(len(docs)), n)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    common = np.zeros((len(docs), len(docs)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(docs), 4096), dtype=np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    union = n[:, None] + n[None, :] - common
    i, j = np.nonzero(np.triu(common >= threshold * union - 1e-6, 1))
    if right is not None:
        across = in_left[i] != in_left[j]
        i, j = i[across], j[across]
    same = nodes[i] == nodes[j]
    counted = nodes[i, np.argmax(same, axis=1)] == node if len(i) else np.empty(0, dtype=bool)
    i, j = i[counted], j[counted]
    texts = np.bincount(i, minlength=len(docs)) + np.bincount(j, minlength=len(docs))
    rows = np.bincount(i, copies[j], len(docs)) + np.bincount(j, copies[i], len(docs))
    root = np.arange(len(docs))
    while len(i):
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    linked = np.flatnonzero(texts)
    return {"doc": docs[linked], "texts": texts[linked], "rows": rows[linked].astype(np.int64), "root": docs[root[linked]]}


def near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    trees: int = 24,
    label: int = 8,
    target: float = 0.99999,
) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``n_text_links`` for every row with an id.

    Texts are linked if the Jaccard similarity of their sets of lower-cased ``n``-word shingles reaches
    ``threshold``; a class is what links connect, named by its smallest ``doc_id``. ``n_links`` counts
    other rows that are linked, copies included, ``n_text_links`` other texts. A text of fewer than
    ``n`` words is one shingle; null and empty texts link to nothing. Repeated rows count as copies. Texts
    that share an id are texts of their own: each row gets the class and links of its text. Rows with a
    null id take no part and are not returned, and neither are further columns.
    """
    depth = matched_depth(threshold, trees, label, target)
    family = _hash_family(trees * depth)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null")
    rows = rows.withColumn("raw", F.unhex(F.md5("text")))

    def sign(batches: Batches) -> Iterable[dict]:
        for whole in batches:
            for batch in slices(whole):
                tokens = [words(t) for t in batch.column("text").to_pylist()]
                yield {
                    "doc_id": batch.column("doc_id"),
                    "raw": batch.column("raw"),
                    "key": [xxhash.xxh3_128_digest(" ".join(t)) if t else None for t in tokens],
                    "nodes": [trie_nodes(shingles(t, n), trees, depth, family) if t else None for t in tokens],
                }

    signed = pin(arrow_map(rows, sign, "doc_id bigint, raw binary, key binary, nodes array<bigint>"))
    counted = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # Texts are numbered by their smallest id, so the smallest number of a class is of its smallest id.
    texts = pin(number_rows(counted.withColumn("place", F.struct("low", "key")), "place", "doc").drop("place"))
    first = pin(
        signed.withColumnRenamed("doc_id", "low")
        .join(texts, ["low", "key"])
        .groupBy("doc")
        .agg(
            F.first("low").alias("low"), F.min("raw").alias("raw"), F.first("copies").alias("copies"),
            F.first("nodes").alias("nodes"), F.count(F.lit(1)).alias("alike"),
        )
    )
    members = first.select("doc", F.explode("nodes").alias("node"))
    groups = (
        members.groupBy("node")
        .agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("low"), F.bit_xor(F.xxhash64("doc")).alias("mark"))
        .where("size > 1")
    )
    kept = pin(groups.groupBy("size", "low", "mark").agg(F.min("node").alias("node")).select("node", "size"))
    placed = pin(members.join(kept, "node"))
    wanted = pin(placed.select("doc").distinct())

    def gather(batches: Batches) -> Iterable[dict]:
        for whole in batches:
            for batch in slices(whole):
                grams = [shingles(words(t), n).tobytes() for t in batch.column("text").to_pylist()]
                yield {c: batch.column(c) for c in ("doc", "copies", "nodes", "alike")} | {"grams": grams}

    candidates = rows.withColumnRenamed("doc_id", "low").join(apart(first.join(wanted, "doc", "left_semi")), ["low", "raw"])
    gathered = pin(
        arrow_map(candidates, gather, "doc bigint, copies bigint, nodes array<bigint>, alike bigint, grams binary")
    )
    # A row that is there several times is one member.
    sets = gathered.where("alike = 1").unionByName(gathered.where("alike > 1").dropDuplicates(["doc"])).drop("alike")
    blocks = (
        placed.join(sets, "doc")
        .withColumn("block", F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / BLOCK)))
        .groupBy("node", "size", "block")
        .agg(F.collect_list(F.struct("doc", "copies", "nodes", "grams")).alias("members"))
    )
    cut = pin(blocks.where(F.col("size") > BLOCK).drop("size"))
    ahead, behind = cut.alias("a"), cut.alias("b")
    across = ahead.join(behind, F.expr("a.node = b.node and a.block < b.block")).select(
        "a.node", F.col("a.members").alias("one"), F.col("b.members").alias("other")
    )
    nothing = F.lit(None).cast(blocks.schema["members"].dataType).alias("other")
    inside = blocks.where(F.col("size") <= BLOCK).drop("size").union(cut).select("node", F.col("members").alias("one"), nothing)

    def verify(batches: Batches) -> Iterable[dict]:
        def side(scalar) -> dict | None:
            if not scalar.is_valid:
                return None
            v = scalar.values
            return {
                "doc": v.field("doc").to_numpy(),
                "copies": v.field("copies").to_numpy(),
                "nodes": v.field("nodes").flatten().to_numpy().reshape(-1, trees),
                "grams": [np.frombuffer(g, dtype=np.uint64) for g in v.field("grams").to_pylist()],
            }

        for batch in batches:
            for i in range(batch.num_rows):
                one, other = side(batch.column("one")[i]), side(batch.column("other")[i])
                yield compare(batch.column("node")[i].as_py(), one, other, threshold)

    found = pin(arrow_map(inside.union(across), verify, "doc bigint, texts bigint, rows bigint, root bigint"))
    links = found.groupBy("doc").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    roots = components(found.where("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")))
    heads = roots.select(F.col("root").alias("doc")).distinct().join(texts.select("doc", "low"), "doc")
    named = roots.join(apart(heads.select(F.col("doc").alias("root"), F.col("low").alias("class_id"))), "root")
    classes = pin(
        texts.join(links, "doc", "left")
        .join(named.select(F.col("node").alias("doc"), "class_id"), "doc", "left")
        .select(
            "key",
            F.coalesce("class_id", "low").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        )
    )
    return (
        signed.select("doc_id", "key")
        .join(classes, "key", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        )
    )
