"""The most similar vectors of every vector, with a stated loss of accuracy.

Vectors are sharded by the nearest of a bounded sample of pivots. Each shard holds a vantage-point tree. Pruning by the triangle
inequality is relaxed by factors: at one the search is exact, above one a branch or shard is dropped although it could still hold a
neighbour. Shards are searched twice: at home, which bounds each vector's distance to its k-th neighbour, and then together with
the vectors of other shards that this bound lets in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Search:
    """Parameters of the search.

    ``k`` neighbours; vectors are ``size`` long; about ``shard_rows`` vectors in a shard; at most about ``max_pivots`` sampled pivots,
    which every task holds in memory (64 numbers each: 16 MB). ``route_factor`` relaxes the choice of shards, ``tree_factor`` the
    pruning within one. Where ``route_factor`` is None both are fitted, so that of the true neighbours of ``fit_queries`` vectors, compared
    with all others, the share ``target`` lies in shards that are let in. A vector whose neighbours were mostly cut off from its shard
    looks for them no farther than ``bound_factor`` times the shard's median distance to a k-th neighbour. With ``half`` vectors visit
    other shards as whole numbers of 16 bits, which leaves an error under 0.0001 in such a pair's similarity. 1, 1, infinity and False make
    the search exact. ``leaf_rows`` vectors end a branch. From ``hot_copies`` equal vectors on, only k + 1 of them are searched; the
    others have these as neighbours.
    """

    k: int = 5
    size: int = 64
    shard_rows: int = 400
    max_pivots: int = 65_536
    route_factor: float | None = None
    tree_factor: float | None = None
    target: float = 0.92
    fit_queries: int = 256
    bound_factor: float = 1.6
    half: bool = True
    leaf_rows: int = 96
    hot_copies: int = 200


def usable(column: str, size: int) -> F.Column:
    """Whether a vector takes part: not null, of the right length, without null, NaN or infinite numbers, not all zero."""
    v = F.col(column)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


class VantagePointTree:
    """A tree over unit vectors. A node splits its points at the median distance to a vantage point; its leaves hold the points."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.points = points
        self.random = np.random.default_rng(len(points))
        self.root = self._build(np.arange(len(points)), leaf_rows)

    def _build(self, rows: np.ndarray, leaf_rows: int):
        if len(rows) <= leaf_rows:
            return rows
        vantage = self.points[rows[self.random.integers(len(rows))]]
        distance = chord(self.points[rows] @ vantage)
        half = len(rows) // 2
        order = np.argpartition(distance, half)
        inner, outer = order[:half], order[half:]
        return vantage, float(distance[inner].max()), float(distance[outer].min()), self._build(rows[inner], leaf_rows), self._build(rows[outer], leaf_rows)

    def nearest(self, k: int, factor: float, bound: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every point, the similarities and rows of its k nearest others that are nearer than its ``bound``; row -1: none.

        Points of one ``label`` are not compared with each other, nor a point with itself."""
        self.k, self.factor, self.label = k, factor, label
        self.best = np.repeat((1 - np.minimum(bound, 2.0) ** 2 / 2).astype(np.float32)[:, None], k, axis=1)
        self.best[np.isinf(bound)] = -np.inf
        self.rows = np.full((len(self.points), k), -1, dtype=np.int64)
        self._visit(self.root, np.arange(len(self.points)))
        return self.best, self.rows

    def _visit(self, node, queries: np.ndarray) -> None:
        if not len(queries):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, queries)
            return
        vantage, inner_most, outer_least, inner, outer = node
        distance = chord(self.points[queries] @ vantage)
        near_inner = distance * 2 <= inner_most + outer_least
        self._visit(inner, queries[near_inner])
        self._visit(outer, queries[~near_inner])
        reach = chord(self.best[queries].min(axis=1))
        self._visit(inner, queries[~near_inner & ((distance - inner_most) * self.factor <= reach)])
        self._visit(outer, queries[near_inner & ((outer_least - distance) * self.factor <= reach)])

    def _scan(self, leaf: np.ndarray, queries: np.ndarray) -> None:
        found = self.points[queries] @ self.points[leaf].T
        found[self.label[queries][:, None] == self.label[leaf][None, :]] = -np.inf
        keep = np.flatnonzero(found.max(axis=1) > self.best[queries].min(axis=1))
        if not len(keep):
            return
        at = queries[keep]
        scores = np.concatenate([self.best[at], found[keep]], axis=1)
        rows = np.concatenate([self.rows[at], np.broadcast_to(leaf, (len(at), len(leaf)))], axis=1)
        top = np.argpartition(-scores, self.k - 1, axis=1)[:, : self.k]
        self.best[at] = np.take_along_axis(scores, top, axis=1)
        self.rows[at] = np.take_along_axis(rows, top, axis=1)


def chord(cosine: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with a given cosine; a metric, unlike the cosine."""
    return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(cosine, -1)))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _unpack(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of single precision or of whole numbers of 16 bits, as their lengths tell, in single precision and of unit length."""
    packed = column.to_pylist()
    whole = np.fromiter((len(p) == 4 * size for p in packed), dtype=bool, count=len(packed))
    out = np.empty((len(packed), size), dtype=np.float32)
    for rows, kind in ((whole, np.float32), (~whole, np.int16)):
        out[rows] = np.frombuffer(b"".join(packed[i] for i in np.flatnonzero(rows)), dtype=kind).reshape(-1, size)
    out[~whole] /= np.linalg.norm(out[~whole], axis=1, keepdims=True)
    return out


def _small(vectors: np.ndarray) -> np.ndarray:
    """Vectors as whole numbers of 16 bits; their length is lost."""
    return np.rint(vectors * (32_767 / np.abs(vectors).max(axis=1, keepdims=True))).astype(np.int16)


def _pack(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * vectors.itemsize
    offsets = np.arange(0, (len(vectors) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(vectors))])


def most_similar(df: DataFrame, id_column: str, vector_column: str, search: Search = Search()) -> DataFrame:
    """Rows (id, neighbour, similarity, rank): the ``search.k`` vectors of highest cosine for every usable vector, itself excluded.

    One vector counts per id, the smallest of different ones; rows with a null id or an unusable vector take no part. Equal
    similarities are ordered by id; where more than k are equal, any k of them come out. With fewer than k + 1 vectors all others come out; an empty table gives no rows. The measured
    recall is in the README.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector", search.size))
    pivots = _pivots(rows, search)
    if search.route_factor is None:
        search = _fitted(rows, pivots, search)
    vectors = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    copies = rows.groupBy(F.xxhash64("vector").alias("_hash")).agg(F.count("*").alias("_n")).where(F.col("_n") >= search.hot_copies).select("_hash")
    if copies.isEmpty():
        return _top(_search(vectors, pivots, search), search.k)
    hashed = vectors.withColumn("_hash", F.xxhash64("vector"))
    ranked = hashed.join(copies, "_hash").withColumn("_rank", F.row_number().over(Window.partitionBy("vector").orderBy("id")))
    stands = ranked.where(F.col("_rank") <= search.k + 1)
    searched = hashed.join(copies, "_hash", "left_anti").select("id", "vector").unionByName(stands.select("id", "vector"))
    others = hashed.join(copies, "_hash").join(stands.select("id"), "id", "left_anti")
    near = stands.where(F.col("_rank") <= search.k).select("vector", F.col("id").alias("neighbour"))
    of_others = others.join(near, "vector").select("id", "neighbour", F.lit(1.0).alias("similarity"))
    return _top(_search(searched, pivots, search).unionByName(of_others), search.k)


def _pivots(rows: DataFrame, search: Search) -> np.ndarray:
    """A sample of about one vector per shard, at most about ``max_pivots``, chosen by the hash of the id; the index holds every row."""
    n = rows.count()
    share = min(1.0, min(max(1, n // search.shard_rows), search.max_pivots) / max(1, n))
    places = 1 << 40
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(places)) < int(share * places)).dropDuplicates(["id"])
    sample = [r.vector for r in chosen.select("vector").collect()]
    if not sample:
        sample = [r.vector for r in rows.select("vector").take(1)]
    return np.unique(unit(np.array(sample, dtype=np.float32).reshape(-1, search.size)), axis=0) if sample else np.zeros((0, search.size), np.float32)


def _nearest_pivot(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The number of each point's nearest pivot, for a bounded number of points at a time."""
    blocks = [np.argmax(points[i : i + 512] @ pivots.T, axis=1) for i in range(0, len(points), 512)]
    return np.concatenate(blocks).astype(np.int32) if blocks else np.zeros(0, np.int32)


def _fitted(rows: DataFrame, pivots: np.ndarray, search: Search) -> Search:
    """The search with factors that let in the shards of ``target`` of the true neighbours of a bounded sample of vectors.

    The sample is compared with all vectors: a task keeps a few rows per sampled vector, over all and in its own shard; the driver gets k of
    both. Those in its own shard give the bound that the search will start from; a neighbour in a shard whose pivot lies farther by a gap
    is let in up to the factor 2 * bound / gap.
    """
    chosen = rows.select("id", "vector", F.xxhash64("id", F.lit("query")).alias("_at")).dropDuplicates(["id"]).orderBy("_at", "id").limit(search.fit_queries).collect()
    if len(chosen) < 2 or len(pivots) < 2:
        return replace(search, route_factor=1.0, tree_factor=1.0)
    ids, queries = [r.id for r in chosen], unit(np.array([r.vector for r in chosen], dtype=np.float32))
    own_home = _nearest_pivot(queries, pivots)
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries, own_home, pivots))
    keep = 2 * search.k + 1
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("home", T.BooleanType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("vector", T.BinaryType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own, homes, centres = shared.value
        best: dict[tuple[int, bool], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, search.size))
            there, shard = batch.column("id").to_pylist(), _nearest_pivot(points, centres)
            for at, cosine in enumerate(own @ points.T):
                for home, among in ((False, np.arange(len(cosine))), (True, np.flatnonzero(shard == homes[at]))):
                    top = among[np.argpartition(-cosine[among], min(keep, len(among)) - 1)[:keep]] if len(among) else among
                    found = best.get((at, home), []) + [(-float(cosine[i]), there[i], points[i]) for i in top if there[i] != own_ids[at]]
                    best[at, home] = sorted(found, key=lambda x: x[:2])[:keep]
        flat = [(at, home, i, -c, v) for (at, home), hits in best.items() for c, i, v in hits]
        if flat:
            numbers, own_shard, names, cosines, vectors = zip(*flat)
            columns = [pa.array(numbers, pa.int32()), pa.array(own_shard), pa.array(names, batch.schema.field("id").type), pa.array(cosines), _pack(np.stack(vectors))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    near = rows.select("id", "vector").mapInArrow(compare, schema).dropDuplicates(["query", "home", "id"])
    place = Window.partitionBy("query", "home").orderBy(F.col("cosine").desc(), "id")
    rows_near = near.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= search.k).collect()
    near, at_home = [r for r in rows_near if not r.home], [r for r in rows_near if r.home]
    if not near:
        return replace(search, route_factor=1.0, tree_factor=1.0)
    reach = np.full(len(queries), np.inf)
    for r in at_home:
        if r["_rank"] == search.k:
            reach[r["query"]] = chord(np.array(r.cosine))
    middle = float(np.median(reach))
    if np.isfinite(middle) and middle > 0:
        reach = np.minimum(reach, middle * search.bound_factor)
    if len(pivots) > search.k + 1:
        reach = np.minimum(reach, np.partition(chord(queries @ pivots.T), search.k, axis=1)[:, search.k])
    at = np.array([r["query"] for r in near])
    home = _nearest_pivot(np.frombuffer(b"".join(r.vector for r in near), dtype=np.float32).reshape(-1, search.size), pivots)
    gap = chord(np.einsum("ij,ij->i", queries[at], pivots[home])) - chord(np.einsum("ij,ij->i", queries, pivots[own_home]))[at]
    allowed = np.where(home == own_home[at], np.inf, 2 * reach[at] / np.maximum(gap, 1e-9))
    route = float(np.clip(np.sort(allowed)[int((1 - search.target) * len(allowed))], 1.0, 64.0))
    return replace(search, route_factor=route, tree_factor=float(np.clip(route / 4, 1.0, 6.0)) if search.tree_factor is None else search.tree_factor)


def _search(vectors: DataFrame, pivots: np.ndarray, search: Search) -> DataFrame:
    """Candidates (id, neighbour, similarity) from both searches of the shards."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    id_type = vectors.schema["id"].dataType
    placed_schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("id", id_type), T.StructField("vector", T.BinaryType())])
    routed_schema = T.StructType([*placed_schema.fields, T.StructField("bound", T.FloatType()), T.StructField("home", T.IntegerType())])
    found_schema = T.StructType([T.StructField("id", id_type), T.StructField("neighbour", id_type), T.StructField("similarity", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, search.size))
                shard = _nearest_pivot(points, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("id"), _pack(points)], names=["shard", "id", "vector"])

    def route(table: pa.Table) -> pa.Table:
        """Bounds each vector's k-th distance at home and sends it to every shard that the relaxed bound lets in."""
        points = _unpack(table.column("vector"), search.size)
        tree = VantagePointTree(points, search.leaf_rows)
        best, _ = tree.nearest(search.k, search.tree_factor, np.full(len(points), np.inf), np.arange(len(points)))
        bound = np.where(np.isinf(best).any(axis=1), np.inf, chord(best.min(axis=1)))
        home = table.column("shard")[0].as_py()
        middle = float(np.median(bound))
        if np.isfinite(middle) and middle > 0:
            bound = np.minimum(bound, middle * search.bound_factor)
        rows, shards = [], []
        for start in range(0, len(points), 512):
            distance = chord(points[start : start + 512] @ shared.value.T)
            if distance.shape[1] > search.k + 1:  # pivots are vectors too, so they bound the distance as well
                bound[start : start + 512] = np.minimum(bound[start : start + 512], np.partition(distance, search.k, axis=1)[:, search.k])
            gap = distance - distance[:, home][:, None]
            gap[:, home] = 0
            row, shard = np.nonzero(gap * (search.route_factor / 2) <= bound[start : start + 512, None])
            rows.append(row + start)
            shards.append(shard)
        row, shard = np.concatenate(rows), np.concatenate(shards).astype(np.int32)
        row, shard = row[shard != home], shard[shard != home]
        stay = np.arange(len(points))
        parts = [(stay, np.full(len(points), home, np.int32), np.full(len(points), np.inf), points), (row, shard, bound[row], _small(points[row]) if search.half and len(row) else points[row])]
        return pa.concat_tables(
            pa.table({"shard": pa.array(s), "id": table.column("id").take(pa.array(r)), "vector": _pack(v), "bound": pa.array(b.astype(np.float32)), "home": pa.array(np.full(len(r), home, np.int32))})
            for r, s, b, v in parts
        )

    def match(table: pa.Table) -> pa.Table:
        points = _unpack(table.column("vector"), search.size)
        tree = VantagePointTree(points, search.leaf_rows)
        home = table.column("home").to_numpy()
        at_home = home == table.column("shard")[0].as_py()
        label = np.where(at_home, -1 - np.arange(len(points)), home)  # visitors from one shard have met there
        _, near = tree.nearest(search.k, search.tree_factor, table.column("bound").to_numpy(), label)
        row, place_ = np.nonzero(near >= 0)
        other = near[row, place_]
        cosine = np.einsum("ij,ij->i", points[row].astype(np.float64), points[other].astype(np.float64))
        ids = table.column("id")
        return pa.table({"id": ids.take(pa.array(row)), "neighbour": ids.take(pa.array(other)), "similarity": pa.array(cosine)})

    placed = vectors.mapInArrow(place, placed_schema)
    routed = placed.groupBy("shard").applyInArrow(route, routed_schema)
    return routed.groupBy("shard").applyInArrow(match, found_schema)


def _top(candidates: DataFrame, k: int) -> DataFrame:
    """The best k candidates of every id. A pair found in two shards counts once; both steps use one partitioning by id."""
    once = candidates.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def neighbour_pairs(similar: DataFrame) -> DataFrame:
    """Unordered pairs in which at least one is among the most similar of the other, smaller id first."""
    return similar.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
