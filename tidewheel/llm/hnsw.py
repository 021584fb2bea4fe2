"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, whose results are merged.

Vectors go to shards of about SHARD_ROWS by a hash of their id. A shard's graph is built in numpy and stored as flat
arrays: for each level the ids of its nodes and a matrix of their neighbours, -1 for none. Every vector is a query
to every shard: descent through the upper levels, then a beam of BEAM on the lowest one; the K nearest of
all shards are kept. Searches run in lockstep over many queries, so that each step is one numpy operation. Insertion runs
in batches of at most a sixteenth of the graph, whose members also see each other.

Cost: tasks form a grid of groups of shards and blocks of queries; a task holds a group and a block and keeps the nearest of its group. Either side is
copied to the tasks of its row or column only: with n vectors, groups and blocks are n / TASK_ROWS each, or about the square root of the cores if that is
more, so that n * (groups + blocks) rows are moved and n * groups * (K + 1) results. As every vector is a query to every shard, searches are n * n / SHARD_ROWS:
choose SHARD_ROWS and TASK_ROWS as large as executors' memory allows (about 400 bytes a row at 64 dimensions, and LANES bytes a row of a shard in search).

Defined cases: rows without an id or vector, with nulls or NaNs in it, or of another length than the
most frequent one are left out; an id that repeats counts once, with its least vector; a vector isn't its
own neighbour, but equal vectors of other ids are; equal distances are ordered by id; fewer than K others give
fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import written

K = 10
SHARD_ROWS = 32768
#: Rows of either side that a task of the search holds.
TASK_ROWS = 131072
#: Neighbours on upper levels (twice as many on the lowest), and the beams of insertion and search.
LINKS, BUILD_BEAM, BEAM = 16, 64, 192
#: Queries in lockstep, and the number of first vectors that are linked by comparing all.
LANES, FIRST = 512, 128


@dataclass
class Graph:
    vectors: np.ndarray  # float32
    levels: list[tuple[np.ndarray, np.ndarray]]  # from the lowest: rows of the nodes, and neighbours as rows of vectors
    entry: int


def distances(vectors: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of queries (q x d) to their rows (q x r)."""
    return np.square(vectors[rows] - queries[:, None, :]).sum(axis=2)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest rows that a best-first search finds from the entries (q x e), nearest first; -1 and inf fill up.

    links[row] are the neighbours of a row."""
    q = len(queries)
    ids = np.full((q, width), -1, np.int64)
    dist = np.full((q, width), np.inf, np.float32)
    done = np.zeros((q, width), bool)
    seen = np.zeros((q, len(links) + 1), bool)  # the last column is for -1
    seen[:, -1] = True
    lanes = np.arange(q)[:, None]
    e = entries[:, :width]
    ids[:, : e.shape[1]] = e
    dist[:, : e.shape[1]] = np.where(e < 0, np.inf, distances(vectors, e, queries))
    seen[lanes, e] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[lanes, order], dist[lanes, order]
    active = np.arange(q)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        more = open_.any(axis=1)
        active, open_ = active[more], open_[more]
        if not len(active):
            break
        at = open_.argmax(axis=1)
        done[active, at] = True
        near = links[ids[active, at]]
        fresh = ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        seen[active[:, None], near] = True
        d = np.where(fresh, distances(vectors, near, queries[active]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[active], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        rows = np.arange(len(active))[:, None]
        dist[active] = all_d[rows, order]
        ids[active] = np.concatenate([ids[active], near], axis=1)[rows, order]
        done[active] = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)[rows, order]
    return np.where(np.isinf(dist), -1, ids), dist


def diverse(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) up to ``most``: those nearer to the row than to any chosen before, then the nearest others."""
    n, c = ids.shape
    v = vectors[ids]
    norms = np.square(v).sum(axis=2)
    pair = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    chosen = np.zeros((n, c), bool)
    least = np.full((n, c), np.inf, np.float32)  # distance to the chosen
    for i in range(c):
        take = (ids[:, i] >= 0) & (dist[:, i] < least[:, i]) & (chosen.sum(axis=1) < most)
        chosen[:, i] = take
        least = np.where(take[:, None], np.minimum(least, pair[:, :, i]), least)
    key = np.where(ids < 0, 2 * c, np.where(chosen, 0, c)) + np.arange(c)
    order = np.argsort(key, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _join(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
    """Link new rows with the best of their candidates, both ways."""
    cap = links.shape[1]
    links[new] = np.pad(diverse(vectors, ids, dist, cap // 2), ((0, 0), (0, cap - cap // 2)), constant_values=-1)
    src = np.repeat(new, cap)
    dst = links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    who, first, count = np.unique(dst, return_index=True, return_counts=True)
    most = int(count.max(initial=0))
    if not most:
        return
    extra = np.full((len(who), most), -1, np.int64)
    extra[np.repeat(np.arange(len(who)), count), np.arange(len(src)) - np.repeat(first, count)] = src
    both = np.concatenate([links[who], extra], axis=1)
    again = (both[:, :, None] == both[:, None, :]) & np.tri(both.shape[1], k=-1, dtype=bool)[None]
    both = np.where(again.any(axis=2), -1, both)
    d = np.where(both < 0, np.inf, distances(vectors, both, vectors[who]))
    order = np.argsort(d, axis=1, kind="stable")
    both, d = np.take_along_axis(both, order, 1), np.take_along_axis(d, order, 1)
    full = (both >= 0).sum(axis=1) > cap
    links[who[~full]] = both[~full, :cap]
    if full.any():
        links[who[full]] = diverse(vectors, both[full], d[full], cap)


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    vectors = np.ascontiguousarray(vectors, np.float32)
    n = len(vectors)
    rng = np.random.default_rng(seed)
    height = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    order = rng.permutation(n)
    # the first rows have the greatest heights, so that each level starts with its entry
    top = order[np.argsort(-height[order], kind="stable")][: min(n, FIRST)]
    order = np.concatenate([top, order[~np.isin(order, top)]])
    links = [np.full((n, (2 if k == 0 else 1) * LINKS), -1, np.int64) for k in range(int(height.max(initial=0)) + 1)]
    entry = int(order[0]) if n else -1
    lo = 0
    while lo < n:
        size = FIRST if lo == 0 else max(16, min(1024, lo // 16))
        new = order[lo : lo + size]
        near = np.full((len(new), 1), entry)
        for k in range(len(links) - 1, -1, -1):
            mine = np.flatnonzero(height[new] >= k)
            rest = np.flatnonzero(height[new] < k)
            if lo and len(rest):
                near[rest] = beam_search(vectors, links[k], vectors[new[rest]], near[rest], 1)[0]
            if len(mine):
                rows = new[mine]
                if lo:
                    old, d = (np.concatenate(x) for x in zip(*(beam_search(vectors, links[k], vectors[rows[i : i + LANES]], near[mine[i : i + LANES]], BUILD_BEAM) for i in range(0, len(rows), LANES)), strict=True))
                    near[mine, 0] = np.where(old[:, 0] >= 0, old[:, 0], near[mine, 0])
                else:
                    old, d = np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.float32)
                peers = np.broadcast_to(rows, (len(rows), len(rows)))
                pd_ = distances(vectors, peers, vectors[rows]) if len(rows) <= 128 else np.maximum(np.square(vectors[rows]).sum(1)[:, None] + np.square(vectors[rows]).sum(1)[None] - 2 * vectors[rows] @ vectors[rows].T, 0)
                pd_ = np.where(np.eye(len(rows), dtype=bool), np.inf, pd_)
                ids, d = np.concatenate([old, peers], 1), np.concatenate([d, pd_], 1)
                best = np.argsort(d, axis=1, kind="stable")[:, :BUILD_BEAM]
                ids, d = np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)
                _join(vectors, links[k], rows, np.where(np.isinf(d), -1, ids), d)
        lo += len(new)
    return Graph(vectors, [(np.flatnonzero(height >= k), links[k]) for k in range(len(links))], entry)


def search(graph: Graph, queries: np.ndarray, k: int, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of about the k nearest to each query; -1 and inf where there are fewer."""
    out_i, out_d = [np.zeros((0, k), np.int64)], [np.zeros((0, k), np.float32)]
    for lo in range(0, len(queries), LANES):
        q = queries[lo : lo + LANES]
        near = np.full((len(q), 1), graph.entry)
        for _, links in reversed(graph.levels[1:]):
            near = beam_search(graph.vectors, links, q, near, 1)[0]
        i, d = beam_search(graph.vectors, graph.levels[0][1], q, near, max(width, k))
        out_i.append(i[:, :k])
        out_d.append(d[:, :k])
    return np.concatenate(out_i), np.concatenate(out_d)


INDEX = "shard int, n long, dim int, ids binary, vectors binary, entry long, nodes array<binary>, neighbours array<binary>"


def packed(shard: int, ids: np.ndarray, graph: Graph) -> pd.DataFrame:
    """An index row: the ids, vectors, nodes of each level and their neighbours, each as one flat array."""
    nodes = [rows.astype(np.int32).tobytes() for rows, _ in graph.levels]
    flat = [links[rows].astype(np.int32).tobytes() for rows, links in graph.levels]
    row = [shard, len(ids), graph.vectors.shape[1], ids.tobytes(), graph.vectors.tobytes(), graph.entry, nodes, flat]
    return pd.DataFrame([row], columns=["shard", "n", "dim", "ids", "vectors", "entry", "nodes", "neighbours"])


def unpacked(row) -> tuple[np.ndarray, Graph]:  # noqa: ANN001
    vectors = np.frombuffer(row.vectors, np.float32).reshape(row.n, row.dim)
    levels = []
    for nodes, flat in zip(row.nodes, row.neighbours, strict=True):
        rows = np.frombuffer(nodes, np.int32).astype(np.int64)
        some = np.frombuffer(flat, np.int32).reshape(len(rows), -1)
        links = np.full((row.n, some.shape[1]), -1, np.int64)
        links[rows] = some
        levels.append((rows, links))
    return np.frombuffer(row.ids, np.int64), Graph(vectors, levels, int(row.entry))


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    return packed(int(key[0]), pdf["id"].to_numpy(np.int64), build(np.stack(pdf["vec"].to_numpy()).astype(np.float32)))


def grid(n: int, parts: int, cores: int, task_rows: int = TASK_ROWS) -> tuple[int, int]:
    """Groups of shards and blocks of queries."""
    side = max(-(-n // task_rows), math.ceil(math.sqrt(cores)))
    groups = min(parts, side)
    return groups, max(-(-n // task_rows), -(-cores // groups))


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, neighbour, rank, distance): about the k nearest others of every vector, by Euclidean distance; id has the name of id_col."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<float>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    )
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    rows = written(rows, "hnsw-vectors")
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = f"{id_col} long, neighbour long, rank int, distance double"
    if usual is None:
        return spark.createDataFrame([], out)
    parts = -(-usual["count"] // shard_rows)
    groups, blocks = grid(usual["count"], parts, spark.sparkContext.defaultParallelism, task_rows)
    rows = rows.filter(F.size("vec") == usual.dim).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    index = written(rows.groupBy("shard").applyInPandas(_build, INDEX), "hnsw-index")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "neighbour": [], "d": []}).astype({"id": "int64", "neighbour": "int64", "d": "float64"})
        query = right["id"].to_numpy(np.int64)
        q = np.stack(right["vec"].to_numpy()).astype(np.float32)
        best_i, best_d = np.full((len(q), 0), -1, np.int64), np.full((len(q), 0), np.inf, np.float32)
        for row in left.sort_values("shard").itertuples(index=False):
            ids, graph = unpacked(row)
            at, d = search(graph, q, k + 1)
            best_i = np.concatenate([best_i, np.where(at >= 0, ids[at], -1)], axis=1)
            best_d = np.concatenate([best_d, d], axis=1)
            best_d[best_i == query[:, None]] = np.inf  # a vector isn't its own neighbour
            order = np.lexsort((best_i, best_d), axis=1)[:, :k]
            best_i, best_d = np.take_along_axis(best_i, order, 1), np.take_along_axis(best_d, order, 1)
        fine = np.isfinite(best_d)
        return pd.DataFrame({"id": np.broadcast_to(query[:, None], best_i.shape)[fine], "neighbour": best_i[fine], "d": best_d[fine].astype(np.float64)})

    in_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.select("id", "vec", F.pmod(F.hash("id"), F.lit(blocks)).cast("int").alias("block"), in_blocks(groups).alias("group"))
    shards = index.withColumn("group", F.pmod("shard", F.lit(groups)).cast("int")).withColumn("block", in_blocks(blocks))
    found = shards.groupBy("group", "block").cogroup(queries.groupBy("group", "block")).applyInPandas(find, "id long, neighbour long, d double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("id").alias(id_col), "neighbour", "rank", F.round(F.sqrt("d"), 6).alias("distance"))
