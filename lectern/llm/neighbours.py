"""Approximate nearest neighbours by cosine: balanced posting lists with replicated boundaries.

A bounded sample is cut into lists of equal size by balanced two-means splits. The lists' centroids
form a small graph (nearest neighbours of each, plus random links), which tasks hold in memory and
walk best-first, for many vectors at once. A vector goes to its nearest list and to those further
ones that are about as near, unless a list already chosen lies closer to that list than the vector
does. A query reads the lists whose centroid is within a distance ratio of its nearest one.

Lists are cut into shards and a list's queries into blocks, both by counted sizes, so that a task
scores one block against one shard however the vectors are spread. Of identical vectors only the
smallest ids can be among the nearest of any query: each distinct vector keeps ``k + 1`` ids, which
loses nothing and keeps copies from filling a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map
from lectern.session import pin


@dataclass(frozen=True)
class Index:
    """Centroids of the lists (unit vectors) and each one's links in the graph."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def balanced_centroids(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` parts of the sample whose sizes differ by one at most."""
    parts = [(np.arange(len(sample)), lists)]
    out = []
    while parts:
        rows, n = parts.pop()
        if n == 1 or len(rows) < 2:
            out.append(sample[rows].mean(axis=0))
            continue
        data = sample[rows]
        a, b = data[rng.integers(len(rows))], data[rng.integers(len(rows))]
        left = n // 2
        cut = len(rows) * left // n
        for _ in range(8):
            order = np.argsort(data @ (b - a), kind="stable")
            a, b = data[order[:cut]].mean(axis=0), data[order[cut:]].mean(axis=0)
        order = np.argsort(data @ (b - a), kind="stable")
        parts += [(rows[order[:cut]], left), (rows[order[cut:]], n - left)]
    found = np.array(out)
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return np.where(length > 0, found / np.maximum(length, 1e-12), sample[: len(found)] if len(found) <= len(sample) else 0)


def build_index(sample: np.ndarray, lists: int, links: int = 24, random_links: int = 8, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    centroids = balanced_centroids(unit(sample), lists, rng)
    n = len(centroids)
    near = np.empty((n, min(links, n)), dtype=np.int32)
    for start in range(0, n, 1024):
        near[start : start + 1024] = np.argsort(-(centroids[start : start + 1024] @ centroids.T), axis=1)[:, :links]
    far = rng.integers(n, size=(n, random_links), dtype=np.int32)
    entries = rng.choice(n, size=min(n, 16), replace=False).astype(np.int32)
    return Index(centroids, np.concatenate([near, far], axis=1), entries)


def search_graph(index: Index, vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector the (about) ``width`` nearest centroids, nearest first, and their distances.

    All vectors walk at once: each step expands every vector's best centroid not yet expanded, until
    the ``width`` best of all are expanded. Where fewer exist, places are filled with -1.
    """
    n, rows = len(index.centroids), np.arange(len(vectors))[:, None]
    width = min(width, n)
    seen = np.zeros((len(vectors), n), dtype=bool)
    seen[:, index.entries] = True
    beam = np.full((len(vectors), width), -1, dtype=np.int32)
    gap = np.full((len(vectors), width), np.inf)
    expanded = np.zeros((len(vectors), width), dtype=bool)

    def distances(nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", index.centroids[nodes], vectors), 0))

    def take(nodes: np.ndarray, far: np.ndarray) -> None:
        nonlocal beam, gap, expanded
        every = np.concatenate([gap, far], axis=1)
        best = np.argsort(every, axis=1, kind="stable")[:, :width]
        beam = np.concatenate([beam, nodes], axis=1)[rows, best]
        expanded = np.concatenate([expanded, np.zeros(nodes.shape, dtype=bool)], axis=1)[rows, best]
        gap = every[rows, best]

    start = np.broadcast_to(index.entries, (len(vectors), len(index.entries)))
    take(start, distances(start))
    while True:
        open_gap = np.where(expanded, np.inf, gap)
        at = np.argmin(open_gap, axis=1)
        live = np.isfinite(open_gap[rows[:, 0], at])
        if not live.any():
            return np.where(np.isfinite(gap), beam, -1), gap
        expanded[rows[:, 0], at] = True
        nodes = index.links[np.where(live, beam[rows[:, 0], at], 0)]
        order = np.sort(nodes, axis=1)
        twice = np.concatenate([np.zeros((len(vectors), 1), dtype=bool), order[:, 1:] == order[:, :-1]], axis=1)
        far = np.where(seen[rows, order] | twice | ~live[:, None], np.inf, distances(order))
        seen[rows, order] |= live[:, None]
        take(order, far)


def lists_of_vectors(index: Index, vectors: np.ndarray, ratio: float, most: int) -> list[list[int]]:
    """The nearest list and the replicas at the boundary: near in ratio, and not behind a chosen one."""
    found, gap = search_graph(index, vectors, 4 * most)
    between = index.centroids
    out = []
    for nodes, far in zip(found, gap, strict=True):
        chosen = [int(nodes[0])]
        for node, d in zip(nodes[1:], far[1:], strict=True):
            if len(chosen) == most or node < 0 or d > ratio * far[0]:
                break
            apart = np.sqrt(np.maximum(2 - 2 * (between[chosen] @ between[node]), 0))
            if (apart > d).all():
                chosen.append(int(node))
        out.append(chosen)
    return out


def lists_of_queries(index: Index, vectors: np.ndarray, ratio: float, most: int) -> list[list[int]]:
    found, gap = search_graph(index, vectors, most)
    return [[int(c) for c, d in zip(n, g, strict=True) if c >= 0 and d <= ratio * g[0] + 1e-9] for n, g in zip(found, gap, strict=True)]


def top_pairs(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[list[int], list[int], list[float]]:
    """The ``k`` nearest of the shard for each query, by exact cosine, ties to the smaller id."""
    rough = unit(queries) @ unit(vectors).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    out: tuple[list, list, list] = ([], [], [])
    kth = min(k, rough.shape[1]) - 1
    least = -np.partition(-rough, kth, axis=1)[:, kth] - 1e-9
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    for q in range(len(queries)):
        near = np.flatnonzero((rough[q] >= least[q]) & np.isfinite(rough[q]))
        dots = (vectors[near] * queries[q]).sum(axis=1)
        exact = dots / (lengths[near] * np.sqrt((queries[q] * queries[q]).sum()))
        for i in np.lexsort((ids[near], -exact))[:k]:
            out[0].append(int(query_ids[q]))
            out[1].append(int(ids[near[i]]))
            out[2].append(float(exact[i]))
    return out


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.float64).reshape(len(cells), -1)


def _assign(rows: DataFrame, choose, index: Index, ratio: float, most: int) -> DataFrame:
    def run(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cells = part.column("vector").to_pylist()
                lists = choose(index, unit(_matrix(cells)), ratio, most)
                yield {"id": part.column("id"), "vector": cells, "lists": lists}

    return arrow_map(rows, run, "id bigint, vector binary, lists array<int>")


def usable_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id`` and ``vector`` (bytes of doubles, scaled by a power of two) of rows with an id and a finite
    vector that is not zero."""
    column = df[embedding]
    rows = df.select(df[vec_id].cast("long").alias("id"), column.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))

    def pack(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in batch.column("v").to_pylist()]
            # A power of two changes no cosine and no rounding, and keeps squares finite.
            cells = [np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes() for v in vectors]
            yield {"id": batch.column("id"), "vector": cells}

    return arrow_map(rows, pack, "id bigint, vector binary")


def nearest(
    df: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 5,
    list_size: int = 256,
    most_lists: int = 4096,
    sample_per_list: int = 32,
    replicas: int = 4,
    boundary_ratio: float = 1.15,
    query_ratio: float = 1.45,
    query_lists: int = 128,
    shard: int = 2048,
    query_block: int = 512,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (cosine) of the ``k`` nearest found per query.

    ``is_query`` is a condition on column ``id``. The sample that cuts the lists has about
    ``sample_per_list`` vectors for each of at most ``most_lists`` lists; every usable vector is then
    indexed. Unusable ones (null, empty, zero, null or non-finite component, null id, or a length other
    than the most common) take no part. Rows of the same id never find each other, equal ids in a
    result are reported once with their best score, and equal scores go by id. An empty table gives no rows.
    """
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = pin(usable_vectors(df, vec_id, embedding).dropDuplicates())
    sizes = rows.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.length("vector") == sizes["bytes"])
    n = sizes["count"]
    lists = max(1, min(most_lists, n // list_size))
    share = min(1.0, 1.25 * lists * sample_per_list / n)
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))
    drawn = _matrix([bytes(r.vector) for r in rows.where(draw).select("vector").limit(2 * lists * sample_per_list).collect()] or
                    [bytes(rows.first().vector)])
    index = build_index(drawn, min(lists, len(drawn)))

    same = Window.partitionBy("vector").orderBy("id")
    candidates = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")
    stored = pin(_assign(candidates, lists_of_vectors, index, boundary_ratio, replicas))
    asked = pin(_assign(rows.where(is_query), lists_of_queries, index, query_ratio, query_lists))

    def counted(frame: DataFrame, most: int, name: str) -> DataFrame:
        counts = frame.select(F.explode("lists").alias("list")).groupBy("list").count()
        return counts.select("list", F.ceil(F.col("count") / most).cast("int").alias(name))

    # One row per list: at most ``most_lists`` rows.
    cuts = F.broadcast(pin(counted(stored, shard, "shards").join(counted(asked, query_block, "blocks"), "list")))

    def spread(frame: DataFrame, part: str, of: str) -> DataFrame:
        return (
            frame.select("id", "vector", F.explode("lists").alias("list"))
            .join(cuts, "list")
            .withColumn(part, F.pmod(F.xxhash64("id", "vector"), F.col(of)).cast("int"))
            .groupBy("list", "shards", "blocks", part)
            .agg(F.collect_list(F.struct("id", "vector")).alias(f"{part}_rows"))
        )

    shards = spread(stored, "shard", "shards").drop("blocks")
    blocks = spread(asked, "block", "blocks").select(
        "list", "block_rows", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    )
    meeting = shards.join(blocks, ["list", "shard"]).select("shard_rows", "block_rows")

    def score(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("shard_rows")[i].values, batch.column("block_rows")[i].values
                ids, qids = left.field("id").to_numpy(), right.field("id").to_numpy()
                pairs = top_pairs(
                    qids, _matrix(right.field("vector").to_pylist()), ids, _matrix(left.field("vector").to_pylist()), k
                )
                yield dict(zip(("query_id", "vec_id", "score"), pairs, strict=True))

    found = arrow_map(meeting, score, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
