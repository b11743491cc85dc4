"""Hard negatives: rows of other labels that score just below an anchor's positives.

A positive with score p admits negatives from ``lower`` to ``upper`` per cent of p. The windows of an
anchor's positives overlap, so they are not searched one by one: their upper limits cut the scores into
disjoint slots, highest first. Every task keeps the ``negatives`` best rows of each slot, a combiner
keeps them over all tasks, and a positive's answer is the merge of its own slot and the ones below,
read off from the top and cut at its lower limit. The best rows up to a limit always lie in those
slots, so nothing is lost.

Scores are inner products of whole numbers. Anchors meet all rows in blocks: rows are dealt into shards
and anchors into blocks by counted sizes, and a task scores one block against one shard. Positives need
rows of one label only, so there labels are dealt into buckets first, and a bucket of a frequent label
is cut into as many shards as its rows take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map
from lectern.session import pin

LONGEST = np.iinfo(np.int64).max
EXACT = 2.0**53


def quantised(df: DataFrame, vec_id: Column, embedding: Column, label: Column, steps: int) -> DataFrame:
    """``id``, ``label`` (as text) and ``vector`` (bytes of doubles, floor of ``steps`` times each component).

    Rows without an id, label or vector, or with a null or non-finite component, are left out; rows
    equal in all three count once.
    """
    rows = df.select(vec_id.cast("long").alias("id"), label.cast("string").alias("label"), embedding.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)

    def pack(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            cells = [np.floor(steps * np.asarray(v, dtype=np.float64)).tobytes() for v in batch.column("v").to_pylist()]
            yield {"id": batch.column("id"), "label": batch.column("label"), "vector": cells}

    return arrow_map(rows, pack, "id bigint, label string, vector binary").dropDuplicates()


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly, cut to what a long holds.

    Doubles are exact below 2 ** 53; rows too large for that are multiplied as integers of any size.
    """
    limit = np.sqrt(EXACT / max(1, left.shape[1]))
    tame = [np.abs(m).max(axis=1, initial=0) < limit for m in (left, right)]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    out[np.ix_(*tame)] = (left[tame[0]] @ right[tame[1]].T).astype(np.int64)

    def by_integers(rows: np.ndarray, columns: np.ndarray) -> None:
        if len(rows) and len(columns):
            a, b = ([[int(x) for x in row] for row in m] for m in (left[rows], right[columns]))
            out[np.ix_(rows, columns)] = [
                [max(-LONGEST, min(LONGEST, sum(x * y for x, y in zip(r, c, strict=True)))) for c in b] for r in a
            ]

    wild = [np.flatnonzero(~t) for t in tame]
    by_integers(wild[0], np.arange(len(right)))
    by_integers(np.flatnonzero(tame[0]), wild[1])
    return out


def per_cent(score: np.ndarray, share: int) -> np.ndarray:
    """Floor of ``share`` per cent of whole numbers, without leaving 64 bits."""
    return score // 100 * share + score % 100 * share // 100


def limits(positives: list[int], lower: int, upper: int) -> tuple[np.ndarray, int]:
    """The different upper limits of the positives' windows, highest first, and the lowest lower limit."""
    score = np.array(positives, dtype=np.int64)
    return np.unique(per_cent(score, upper))[::-1], int((-per_cent(-score, lower)).min())


def best(which: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each (which, slot): higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, slot, which))
    starts = np.ones(len(order), dtype=bool)
    starts[1:] = (which[order][1:] != which[order][:-1]) | (slot[order][1:] != slot[order][:-1])
    first = np.flatnonzero(starts)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[rank < k]


def _kth(found: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row the ``k``-th highest allowed score, or the least there is if fewer are allowed."""
    masked = np.where(allowed, found, -LONGEST)
    return np.partition(masked, -min(k, masked.shape[1]), axis=1)[:, -min(k, masked.shape[1])]


def _same_length(rows: pa.Table, anchors: pa.Table, chunk: int) -> Iterable[tuple]:
    """Per vector length and chunk of anchors: the anchors' places, the rows' ids, scores, equal labels, equal ids."""
    labels = np.unique(rows.column("label").to_pylist() + anchors.column("label").to_pylist(), return_inverse=True)[1]
    row_label, anchor_label = labels[: rows.num_rows], labels[rows.num_rows :]
    cells = [t.column("vector").to_pylist() for t in (rows, anchors)]
    sizes = [np.array([len(c) for c in side]) for side in cells]
    ids, anchor_ids = rows.column("id").to_numpy(), anchors.column("id").to_numpy()
    for size in np.intersect1d(*sizes):
        at, asked = (np.flatnonzero(s == size) for s in sizes)
        matrix = lambda side, places: np.frombuffer(b"".join(side[i] for i in places)).reshape(len(places), size // 8)
        right = matrix(cells[0], at)
        for start in range(0, len(asked), chunk):
            part = asked[start : start + chunk]
            found = scores(matrix(cells[1], part), right)
            alike = anchor_label[part][:, None] == row_label[at][None, :]
            yield part, ids[at], found, alike, anchor_ids[part][:, None] == ids[at][None, :]


def _by_bucket(rows: DataFrame, anchors: DataFrame, shard: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both with the numbers of ``shards`` and ``blocks`` of their bucket; buckets without anchors are left out."""

    def counted(frame: DataFrame, most: int, name: str) -> DataFrame:
        return frame.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    # One row per bucket, of which there is one per ``shard`` rows.
    cuts = pin(counted(rows, shard, "shards").join(counted(anchors, block, "blocks"), "bucket"))
    return rows.join(cuts, "bucket"), anchors.join(cuts, "bucket")


def _meet(rows: DataFrame, anchors: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on every pair of a shard of rows and a block of anchors of one bucket."""
    part = lambda of: F.pmod(F.xxhash64("id", "vector"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rows.withColumn("shard", part("shards")).withColumn("block", every("blocks"))
    right = anchors.withColumn("block", part("blocks")).withColumn("shard", every("shards"))
    keys = ["bucket", "shard", "block"]
    left = left.select(*keys, "id", "label", "vector")
    # Anchors are rows themselves; columns named anew tell the two sides apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns if c not in ("shards", "blocks")])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 3,
    lower: int = 50,
    upper: int = 95,
    steps: int = 256,
    shard: int = 8192,
    block: int = 4096,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on column ``id``; ``label`` may be an expression. An anchor's positives
    are the first rows of its label, its negatives per positive the first rows of other labels in the
    positive's window. Higher scores come first, ties by smaller id. Rows of the anchor's own id are
    neither, and vectors of another length than the anchor's have no score with it. Rows that share an
    id are rows of their own; several anchors of one id each give their rows. Scores beyond a long count
    as the largest or smallest long.
    Anchors without positives and windows without rows give nothing, nor does an empty table.
    """
    key = df[label] if isinstance(label, str) else label
    rows = pin(quantised(df, df[vec_id], df[embedding], key, steps))
    # A bucket per shard's worth of rows: many rare labels share one, a frequent one is cut.
    in_all = rows.count()
    buckets = max(1, -(-in_all // shard))
    by_label = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    named = F.md5(F.concat(F.col("id").cast("string").cast("binary"), F.lit(b"|"), F.col("label").cast("binary"), F.lit(b"|"), "vector"))
    anchors = pin(by_label.where(is_anchor).withColumn("anchor", named))

    def nearest_alike(mine: pa.Table, asked: pa.Table) -> pa.Table:
        names, out = np.array(asked.column("anchor").to_pylist(), dtype=object), []
        for part, ids, found, alike, same in _same_length(mine, asked, 256):
            allowed = alike & ~same
            at, column = np.nonzero(allowed & (found >= _kth(found, allowed, positives)[:, None]))
            score = found[at, column]
            kept = best(at, np.zeros(len(at)), score, ids[column], positives)
            out.append((names[part[at[kept]]], ids[column[kept]], score[kept]))
        return _table(out, ("anchor", "id", "score"))

    found = _meet(*_by_bucket(by_label, anchors, shard, block), nearest_alike, "anchor string, id bigint, score bigint")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    top = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # At most ``positives`` rows per anchor.
    chosen = top.groupBy("anchor").agg(F.collect_list(F.struct("score", F.col("id").alias("positive_id"))).alias("chosen"))
    asking = pin(anchors.drop("bucket").join(chosen, "anchor"))

    def best_of_slots(mine: pa.Table, asked: pa.Table) -> pa.Table:
        names, out = np.array(asked.column("anchor").to_pylist(), dtype=object), []
        cuts = [limits([p["score"] for p in row], lower, upper) for row in asked.column("chosen").to_pylist()]
        tops = np.full((len(cuts), positives), -LONGEST)
        for i, (upto, _) in enumerate(cuts):
            tops[i, : len(upto)] = upto
        last = np.array([upto[-1] for upto, _ in cuts], dtype=np.int64)
        least = np.array([low for _, low in cuts], dtype=np.int64)
        for part, ids, found, alike, same in _same_length(mine, asked, 256):
            allowed = ~alike & ~same & (found <= tops[part, :1]) & (found >= least[part][:, None])
            # The lowest slot is the widest: rows there that cannot be among its first are left out early.
            lowest = allowed & (found <= last[part][:, None])
            allowed &= (found > last[part][:, None]) | (found >= _kth(found, lowest, negatives)[:, None])
            at, column = np.nonzero(allowed)
            score = found[at, column]
            slot = (tops[part[at]] >= score[:, None]).sum(axis=1) - 1
            kept = best(at, slot, score, ids[column], negatives)
            out.append((names[part[at[kept]]], slot[kept], ids[column[kept]], score[kept]))
        return _table(out, ("anchor", "slot", "id", "score"))

    # Rows of any label: one bucket, cut by the counts of all rows and anchors.
    whole = {"bucket": 0, "shards": max(1, -(-in_all // shard)), "blocks": max(1, -(-asking.count() // block))}
    whole = {name: F.lit(value) for name, value in whole.items()}
    schema = "anchor string, slot bigint, id bigint, score bigint"
    offered = _meet(rows.withColumns(whole), asking.withColumns(whole), best_of_slots, schema)
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    offered = offered.withColumn("place", F.row_number().over(first)).where(F.col("place") <= negatives)
    # At most ``positives`` times ``negatives`` rows per anchor, slot by slot from the top.
    slots = offered.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("slots"))
    upto = lambda score: F.floor(_per_cent(score, upper)).cast("long")
    tops = F.array_distinct(F.reverse(F.array_sort(F.transform("chosen", lambda p: upto(p["score"])))))
    merged = (
        asking.join(slots, "anchor")
        .select("id", "slots", tops.alias("tops"), F.explode("chosen").alias("p"))
        .withColumn("own", F.array_position("tops", upto(F.col("p.score"))) - 1)
        .withColumn("below", F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("own")), 1, negatives))
        .withColumn("low", F.ceil(_per_cent(F.col("p.score"), lower)).cast("long"))
        .select("id", "p", F.posexplode(F.filter("below", lambda s: s["score"] >= F.col("low"))).alias("rank", "n"))
    )
    return merged.select(
        F.col("id").alias("anchor_id"), "p.positive_id", (F.col("rank") + 1).alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


def _per_cent(score: Column, share: int) -> Column:
    """``share`` per cent of a long, as an exact decimal."""
    return score.cast("decimal(20,0)") * F.lit(Decimal(share)) / F.lit(Decimal(100))


def _table(parts: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
    types = [pa.string() if n == "anchor" else pa.int64() for n in names]
    return pa.table([pa.array(c.tolist(), type=t) for c, t in zip(columns, types, strict=True)], names=list(names))
