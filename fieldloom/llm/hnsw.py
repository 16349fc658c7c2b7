"""Approximate nearest neighbours: a hierarchical navigable small world per shard, shard results merged.

Distinct vectors, each with its smallest ids, are spread by hash over shards. Each
shard's graph is kept as flat arrays: for every layer the neighbours of its nodes,
a row of numbers each. Layers are built from the top down, in batches: a batch
searches the graph so far, its lists are chosen by the usual diversity rule, and
back links are pruned by the same rule. Blocks of queries meet every shard, beams
of a whole block advance together, and each query keeps the best of all shards.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

_BATCH = 256


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _diverse(near: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates in order of distance (rows; -1 for none) the ``keep`` to link to.

    A candidate is taken if it is nearer to the node than to any one taken before;
    places left over go to the nearest of the others.
    """
    rows, width = ids.shape
    v = x[np.maximum(ids, 0)]
    square = (v * v).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    real = ids >= 0
    for j in range(width):
        blocked = (taken[:, :j] & (between[:, j, :j] < near[:, j : j + 1])).any(1)
        taken[:, j] = real[:, j] & ~blocked & (taken.sum(1) < keep)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, 1, kind="stable")[:, :keep]
    return np.take_along_axis(np.where(real, ids, -1), order, 1)


class _Seen:
    """Which nodes the searches of a batch have met; never cleared, as every batch has its own stamp."""

    def __init__(self, rows: int, nodes: int):
        self.stamps, self.marks, self.now = np.zeros((rows, nodes), np.uint16), np.empty((rows, nodes), np.int32), 0

    def renew(self) -> None:
        self.now += 1
        if self.now == 1 << 16:
            self.stamps[:] = 0
            self.now = 1


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, seen: _Seen, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the ``ef`` nearest nodes that a search from ``entry`` finds, a row for each query."""
    rows = len(q)
    seen.renew()
    stamps, marks, now = seen.stamps, seen.marks, seen.now
    ids = np.full((rows, ef), -1, np.int64)
    near = np.full((rows, ef), np.inf, np.float32)
    done = np.ones((rows, ef), bool)
    start = entry[:, :ef]
    width = start.shape[1]
    ids[:, :width] = start
    near[:, :width] = np.where(start >= 0, ((x[np.maximum(start, 0)] - q[:, None]) ** 2).sum(2), np.inf)
    done[:, :width] = start < 0
    order = np.argsort(near, 1, kind="stable")
    ids, near, done = (np.take_along_axis(a, order, 1) for a in (ids, near, done))
    r, c = np.nonzero(start >= 0)
    stamps[r, start[r, c]] = now
    active = np.arange(rows)
    while len(active):
        open_ = ~done[active]
        rank = np.cumsum(open_, 1)
        pick = open_ & (rank <= wide)
        done[active] |= pick
        r, c = np.nonzero(pick)
        node = ids[active[r], c]
        found = links[node]
        r = np.repeat(active[r], found.shape[1])
        found = found.ravel()
        ok = found >= 0
        r, found = r[ok], found[ok]
        new = stamps[r, found] != now
        r, found = r[new], found[new]
        here = np.arange(len(r), dtype=np.int32)
        marks[r, found] = here
        first = marks[r, found] == here
        r, found = r[first], found[first]
        stamps[r, found] = now
        d = ((x[found] - q[r]) ** 2).sum(1)
        better = d < near[r, -1]
        r, found, d = r[better], found[better], d[better]
        if len(r):
            count = np.bincount(r, minlength=rows)
            most = int(count.max())
            first_of = np.zeros(rows + 1, np.int64)
            np.cumsum(count, out=first_of[1:])
            sort = np.argsort(r, kind="stable")
            r, found, d = r[sort], found[sort], d[sort]
            place = np.arange(len(r)) - first_of[r]
            touched = np.flatnonzero(count)
            at = np.searchsorted(touched, r)
            more_i = np.full((len(touched), most), -1, np.int64)
            more_d = np.full((len(touched), most), np.inf, np.float32)
            more_i[at, place], more_d[at, place] = found, d
            all_d = np.concatenate((near[touched], more_d), 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :ef]
            near[touched] = np.take_along_axis(all_d, order, 1)
            ids[touched] = np.take_along_axis(np.concatenate((ids[touched], more_i), 1), order, 1)
            done[touched] = np.take_along_axis(np.concatenate((done[touched], more_i < 0), 1), order, 1)
        active = active[(~done[active]).any(1)]
    return near, ids


class Graph:
    """Vectors in ``x``, top layer's nodes first; ``layers`` from the bottom up: a flat array of links for its first nodes."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @staticmethod
    def build(x: np.ndarray, level: np.ndarray, m: int, ef: int) -> tuple[Graph, np.ndarray]:
        """The graph, and the order in which it holds the rows of ``x``."""
        order = np.argsort(-level, kind="stable")
        x, level = np.ascontiguousarray(x[order], np.float32), level[order]
        layers: list[np.ndarray] = []
        seen = _Seen(min(_BATCH, len(x)), len(x))
        for k in range(int(level[0]), -1, -1):
            n = int((level >= k).sum())
            width = 2 * m if k == 0 else m
            links = np.full((n, width), -1, np.int32)
            size = len(layers[0]) if layers else min(n, _BATCH)
            for s in range(0, size, _BATCH):  # the nodes of the layer above find each other there
                batch = np.arange(s, min(size, s + _BATCH))
                if layers:
                    near, ids = _beam(x, layers[0], x[batch], Graph._descend(x, layers[1:], x[batch], seen), ef, seen)
                else:
                    near = _distances(x[batch], x[:size]).astype(np.float32)
                    ids = np.broadcast_to(np.arange(size), near.shape)
                near = np.where(ids == batch[:, None], np.inf, near)
                take = np.argsort(near, 1, kind="stable")[:, :ef]
                near, ids = np.take_along_axis(near, take, 1), np.take_along_axis(ids, take, 1)
                chosen = _diverse(near, np.where(np.isfinite(near), ids, -1), x, m)
                links[batch, : chosen.shape[1]] = chosen
                Graph._back(x, links, batch, chosen, width)
            at = size
            while at < n:
                batch = np.arange(at, min(n, at + _BATCH))
                entry = Graph._descend(x, layers, x[batch], seen)
                near, ids = _beam(x[:at], links[:at], x[batch], entry, ef, seen)
                own = _distances(x[batch], x[batch]).astype(np.float32)
                own[np.triu_indices(len(batch))] = np.inf  # each sees those before it
                near = np.concatenate((near, own), 1)
                ids = np.concatenate((ids, np.where(np.isfinite(own), batch[None], -1)), 1)
                take = np.argsort(near, 1, kind="stable")[:, :ef]
                chosen = _diverse(np.take_along_axis(near, take, 1), np.take_along_axis(ids, take, 1), x, m)
                links[batch, : chosen.shape[1]] = chosen
                Graph._back(x, links, batch, chosen, width)
                at += len(batch)
            layers.insert(0, links)
        return Graph(x, layers), order

    @staticmethod
    def _descend(x: np.ndarray, above: list[np.ndarray], q: np.ndarray, seen: _Seen) -> np.ndarray:
        """Entry nodes for the layer below ``above``."""
        entry = np.zeros((len(q), 1), np.int64)
        for links in reversed(above):
            near, ids = _beam(x[: len(links)], links, q, entry, 4, seen)
            entry = ids
        return entry

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """Link the chosen nodes back; full lists are chosen anew from the old and the new."""
        to = chosen.ravel().astype(np.int64)
        of = np.repeat(batch, chosen.shape[1])
        ok = to >= 0
        to, of = to[ok], of[ok]
        sort = np.lexsort((((x[of] - x[to]) ** 2).sum(1), to))
        to, of = to[sort], of[sort]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        fits = place < width  # the nearest of the new; more could not stay anyway
        new = np.full((len(nodes), min(width, int(count.max(initial=0)))), -1, np.int64)
        new[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = of[fits]
        for s in range(0, len(nodes), 512):
            some = nodes[s : s + 512]
            ids = np.concatenate((links[some], new[s : s + 512]), 1)
            twice = (ids[:, :, None] == ids[:, None, :]) & (np.arange(ids.shape[1])[None, :, None] > np.arange(ids.shape[1])[None, None, :])
            ids = np.where(twice.any(2), -1, ids)
            near = np.where(ids >= 0, ((x[np.maximum(ids, 0)] - x[some][:, None]) ** 2).sum(2), np.inf).astype(np.float32)
            order = np.argsort(near, 1, kind="stable")
            near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
            full = (ids >= 0).sum(1) > width
            out = ids[:, :width].copy()
            if full.any():
                out[full] = _diverse(near[full], ids[full], x, width)
            links[some] = out

    def search(self, q: np.ndarray, k: int, ef: int, seen: _Seen) -> tuple[np.ndarray, np.ndarray]:
        entry = self._descend(self.x, self.layers[1:], q, seen)
        near, ids = _beam(self.x, self.layers[0], q, entry, max(ef, k), seen)
        return near[:, :k], ids[:, :k]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, **{f"layer{k}": a for k, a in enumerate(self.layers)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return Graph(z["x"], [z[f"layer{k}"] for k in range(len(z.files) - 1)])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float32())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(len(column), -1)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(col(df, id_col).alias("id"), col(df, vector_col).cast("array<float>").alias("x"))
    return rows.filter("id IS NOT NULL AND size(x) > 0").filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    m: int = 16,
    ef_build: int = 64,
    ef_search: int = 96,
    shard_rows: int = 32_768,
    block_rows: int = 8_192,
    dim: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The about ``k`` nearest other ids of every query by Euclidean distance.

    ``queries`` are rows with the same two columns, by default all of ``vectors``.
    Returns ``id_col, rank, neighbour, distance``: rank from 1, ties by the smaller
    id, distance rounded to 6 places. An id never is its own neighbour; with fewer
    than ``k`` others there are fewer rows.

    Every vector is indexed, in shards of at most about ``shard_rows`` distinct
    ones, and in no fewer shards than there are tasks at a time, while these have
    4,096 each. Equal vectors are one node with the ``k + 1`` smallest of their
    ids; no answer can hold more of them.

    ``dim`` is the vectors' length; by default the most frequent one (of ties the
    largest). Ids are of any type that has an order. Rows with a null id, a null
    or empty vector, one of another length, or one with a null, NaN or infinite
    number are left out. Repeated rows count once; an id with several vectors is
    as near as the nearest of them. An empty table gives no rows. Other columns
    are ignored.
    """
    rows = _usable(vectors, id_col, vector_col)
    if dim is None:
        lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dim = lengths.d if lengths else 1
    rows = rows.filter(F.size("x") == dim)
    asked = (rows if queries is None else _usable(queries, id_col, vector_col).filter(F.size("x") == dim)).dropDuplicates(["id", "x"])
    kind = rows.schema["id"].dataType.simpleString()
    few = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("place") <= k + 1)
    nodes = cut(few.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    count, own = nodes.select(F.count("*"), F.sum(F.size("ids"))).first()
    repeated = (own or 0) > nodes.select(F.explode("ids").alias("id")).distinct().count()
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-count // shard_rows), min(tasks, count // 4096))
    blocks = max(1, -(-asked.count() // block_rows))
    level = F.pmod(F.xxhash64(F.lit(2), "x"), F.lit(1 << 30))
    nodes = nodes.select("ids", "x", F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int").alias("shard"), level.alias("u"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("u", "ascending")])
        u = (t.column("u").to_numpy() + 1.0) / (1 << 30)
        x = _matrix(t.column("x"))
        graph, order = Graph.build(x, np.floor(-np.log(u) / math.log(m)).astype(int), m, ef_build)
        ids = t.column("ids").combine_chunks().take(pa.array(order))
        sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
        return pa.table({"shard": t.column("shard").slice(0, 1), "sizes": pa.array([sizes.tobytes()], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array([0, int(sizes.sum())], pa.int32()), ids.flatten()), "graph": pa.array([graph.dump()], pa.binary())})

    graphs = cut(nodes.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(build, f"shard int, sizes binary, ids array<{kind}>, graph binary"))

    def search(asks: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["id", "neighbour", "d"]
        own = asks.column("id").combine_chunks()
        if not asks.num_rows or not shard.num_rows:
            return pa.table([own.slice(0, 0), own.slice(0, 0), pa.array([], pa.float64())], names=names)
        graph = Graph.load(shard.column("graph")[0].as_py())
        sizes = np.frombuffer(shard.column("sizes")[0].as_py(), np.int64)
        start, ids = np.cumsum(sizes) - sizes, shard.column("ids")[0].values
        q, out, seen = _matrix(asks.column("x")), [], _Seen(min(_BATCH, asks.num_rows), len(graph.x))
        for s in range(0, len(q), _BATCH):
            _, at = graph.search(q[s : s + _BATCH], max(ef_search, k + 1), ef_search, seen)
            r, c = np.nonzero(at >= 0)
            node = at[r, c]
            exact = np.sqrt(((graph.x[node].astype(np.float64) - q[s + r].astype(np.float64)) ** 2).sum(1))
            n = sizes[node]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            r, exact, other = np.repeat(s + r, n), np.repeat(exact, n), ids.take(pa.array(np.repeat(start[node], n) + place))
            ok = np.flatnonzero(pc.not_equal(other, own.take(pa.array(r))).to_numpy(zero_copy_only=False))
            r, exact, other = r[ok], exact[ok], other.take(pa.array(ok))
            order = np.unique(other.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            sort = np.lexsort((order, exact, r))
            r = r[sort]
            if not repeated:
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, sort = r[first], sort[first]
            out.append(pa.table([own.take(pa.array(r)), other.take(pa.array(sort)), pa.array(exact[sort])], names=names))
        return pa.concat_tables(out)

    asks = asked.select("id", "x", F.pmod(F.xxhash64(F.lit(1), "id", "x"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = graphs.select("shard", "sizes", "ids", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = asks.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(search, f"id {kind}, neighbour {kind}, d double")
    found = found.groupBy("id", "neighbour").agg(F.min("d").alias("d"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbour"))).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias(id_col), "rank", "neighbour", F.round("d", 6).alias("distance"))
