"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams.

Vectors are dealt into shards by a hash. In a shard every vector gets neighbours by greedy search in the graph so far and
by relaxed-distance pruning: the nearest candidate stays, and drops every other one that is closer to it, times
``ALPHA``, than to the vector itself. What stays points in diverse directions. Edges are added both ways, and a node with
too many is pruned again. A query walks each shard's graph with a beam of nodes; the nearest of all shards remain.
Cosines of what the beams found are computed from the original vectors in double precision, so only the choice of
candidates is approximate.

Shards grow with the index, from ``SHARD_ROWS`` to ``MOST_SHARD_ROWS`` vectors or ``SHARD_BYTES``, and the beam with the
root of a shard's size. A task holds one shard and its graph; queries come after the shard's vectors and are searched
as they come, so its memory doesn't depend on their number.

Equal vectors are indexed once: a query can meet at most k + 1 of the same vector, so each keeps its k + 1 smallest ids.

Building goes through numpy in waves: all vectors of a wave search the same graph at once.

Defined results: vectors that are null, of zero length, or that hold null or non-finite components take no part, as query
or as candidate, nor do rows without an id; vectors of another dimension than the query's are never its neighbours; with
fewer than k other vectors all are given; ties go to the smaller id. Rows that repeat an id with the same vector count
once. Columns beside id and vector are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

SHARD_ROWS, MOST_SHARD_ROWS = 4000, 32_000
#: Vectors of a shard in doubles, at most (but no fewer than a few hundred rows).
SHARD_BYTES = 64 << 20
#: Shards that an index has before they grow.
SHARDS = 64
DEGREE = 24
BUILD_BEAM = 48
#: Of a search in ``SHARD_ROWS`` vectors.
BEAM = 96
ALPHA = 1.2
WAVE = 128
#: Queries that one task searches a shard with at once.
QUERY_BLOCK = 512


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and a vector of doubles of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0) & (norm < float("inf"))
    return vectors.select(F.col(key).alias("vec_id"), F.when(fine, v).alias("v")).where("v is not null and vec_id is not null")


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """A shard's directed graph: row i of ``edges`` has the neighbours of vector i, -1 where there is none."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0):
        self.x = x
        self.visits = 0  # vectors that searches have compared with their queries
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(np.argmax(x @ x.mean(0))) if n else 0
        rng = np.random.default_rng(seed)
        if n <= 1:
            return
        for i in range(min(degree // 2, n - 1)):  # a random graph to begin with
            to = rng.integers(0, n - 1, n)
            self.edges[:, i] = to + (to >= np.arange(n))
        for a in (1.0, alpha):
            order = rng.permutation(n)
            for k in range(0, n, WAVE):
                wave = order[k : k + WAVE]
                found, _ = self.search(x[wave], beam)
                self._connect(wave, found, a)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each query's final beam, nearest first, and their cosines; -1 fills what is missing."""
        q, n = len(queries), len(self.x)
        width = min(beam, n)
        ids = np.full((q, width), -1, np.int32)
        sims = np.full((q, width), -np.inf, np.float32)
        done = np.ones((q, width), bool)
        seen = np.zeros((q, n), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.start, queries @ self.x[self.start], False
        seen[:, self.start] = True
        alive = np.arange(q)
        while len(alive):
            open_ = ~done[alive]
            live = open_.any(1)
            alive, open_ = alive[live], open_[live]
            if not len(alive):
                break
            # The two nearest open nodes of every query are expanded at once.
            picks = np.argsort(~open_, axis=1, kind="stable")[:, :2]
            valid = np.take_along_axis(open_, picks, 1)
            nodes = np.where(valid, ids[alive[:, None], picks], -1)
            done[alive[:, None], picks] = True
            near = np.where(nodes[:, :, None] >= 0, self.edges[np.maximum(nodes, 0)], -1).reshape(len(alive), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & ~seen[alive[:, None], np.maximum(near, 0)]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            to = near[r, c]
            seen[alive[r], to] = True
            self.visits += len(to)
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", queries[alive[r]], self.x[to])
            new = np.where(fresh, near, -1)
            all_ids = np.concatenate([ids[alive], new], 1)
            all_sims = np.concatenate([sims[alive], sim], 1)
            all_done = np.concatenate([done[alive], ~fresh], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[alive] = np.take_along_axis(all_ids, best, 1)
            sims[alive] = np.take_along_axis(all_sims, best, 1)
            done[alive] = np.take_along_axis(all_done, best, 1) | (ids[alive] < 0)
        return ids, sims

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Relaxed-distance pruning of each node's candidates (-1: none), for all nodes at once."""
        degree = self.edges.shape[1]
        candidates = np.sort(candidates, axis=1)
        bad = (candidates < 0) | (candidates == nodes[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        points = self.x[np.maximum(candidates, 0)]
        # Squared distances of unit vectors; what is near by cosine is near by them.
        own = 2 - 2 * np.einsum("ij,ikj->ik", self.x[nodes], points)
        own[bad] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
        points = np.take_along_axis(points, order[:, :, None], 1)
        out = np.full((len(nodes), degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(degree):
            at = np.argmin(own, axis=1)  # the first that is left is the nearest, as rows are sorted
            left = np.isfinite(own[rows, at])
            if not left.any():
                break
            out[left, k] = candidates[left, at[left]]
            between = 2 - 2 * np.einsum("ij,ikj->ik", points[rows, at], points)
            own[(alpha * np.maximum(between, 0) <= own) & left[:, None]] = np.inf
            own[rows, at] = np.inf
        return out

    def _connect(self, wave: np.ndarray, found: np.ndarray, alpha: float) -> None:
        degree = self.edges.shape[1]
        self.edges[wave] = self._pruned(wave, np.concatenate([found, self.edges[wave]], 1), alpha)
        # Edges back: gathered by their end, added where there is room, else pruned with the others.
        source = np.repeat(wave, degree)
        target = self.edges[wave].reshape(-1)
        keep = target >= 0
        source, target = source[keep].astype(np.int32), target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), count.max(initial=1)), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        back[np.repeat(np.arange(len(ends)), count), place] = source
        have = self.edges[ends]
        known = (back[:, :, None] == have[:, None, :]).any(2)
        back[known] = -1
        free = (have < 0).sum(1)
        some = (back >= 0).sum(1)
        full = some > free
        if full.any():
            self.edges[ends[full]] = self._pruned(ends[full], np.concatenate([have[full], back[full]], 1), alpha)
        fits = np.flatnonzero(~full & (some > 0))
        if len(fits):
            both = np.concatenate([have[fits], back[fits]], 1)
            self.edges[ends[fits]] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """v, ids: every different vector with its ``ids`` smallest ids. Groups are cut before and after the shuffle."""
    by = Window.partitionBy("h", "v").orderBy("vec_id")
    rows = vectors.withColumn("h", F.xxhash64("v")).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= ids)
    return rows.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def shard_count(rows: int, dim: int, shard_rows: int | None = None) -> int:
    """How many shards an index of so many different vectors of at most ``dim`` components has."""
    most = max(256, min(MOST_SHARD_ROWS, SHARD_BYTES // (8 * max(dim, 1))))
    return max(1, -(-rows // (shard_rows or min(most, max(SHARD_ROWS, rows // SHARDS)))))


def beam_of(rows: int) -> int:
    """The beam that searches a shard of so many vectors."""
    return max(BEAM, round(BEAM * (rows / SHARD_ROWS) ** 0.5))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself left out."""
    spark = vectors.sparkSession
    small_batches(spark)
    index = stored(distinct_vectors(usable(vectors, vector, key), k + 1), "vectors")
    asked = usable(queries, vector, key).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    held = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    shards = shard_count(held["n"], held["dim"] or 1, shard_rows)
    rows = index.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), F.lit(None).cast("long").alias("query_id"), "v", "ids")
    # Every query visits every shard; a shard's graph is built once, when its first query comes.
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "query_id", "v", F.lit(None).cast("array<long>").alias("ids"))

    def work(batches: Iterator) -> Iterator:
        at, shard = None, None
        for batch in batches:
            for key, part in _parts(batch):
                if key != at:
                    at, shard = key, Shard(key[1])
                yield from shard.take(part, k)

    found = (
        rows.unionByName(visits).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", F.col("query_id").asc_nulls_first())
        .mapInArrow(work, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _parts(batch) -> Iterator:
    """Runs of equal (shard, dim) of a sorted batch."""
    shard, dim = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    cuts = np.r_[0, np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1])) + 1, len(shard)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield (int(shard[a]), int(dim[a])), batch.slice(a, b - a)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Shard:
    """A shard's vectors of one dimension, their graph, and the search of queries as they come."""

    def __init__(self, dim: int):
        self.dim, self.vectors, self.ids, self.graph = dim, [], [], None

    def take(self, part, k: int) -> Iterator:
        """Adds vectors (rows without a query's id, which come first); answers queries."""
        import pyarrow.compute as pc

        asks = part.column(2).is_valid()
        own = part.filter(pc.invert(asks))
        if own.num_rows:
            self.vectors.append(_matrix(own.column(3), self.dim))
            self.ids += own.column(4).to_pylist()
        asked = part.filter(asks)
        if asked.num_rows and self.vectors:
            if self.graph is None:
                self.x = np.concatenate(self.vectors)
                self.vectors = [self.x]
                self.norms = np.sqrt((self.x * self.x).sum(1))
                self.graph = Graph(unit(self.x))
            for a in range(0, asked.num_rows, QUERY_BLOCK):
                some = asked.slice(a, QUERY_BLOCK)
                yield from self._answers(some.column(2).to_pylist(), _matrix(some.column(3), self.dim), k)

    def _answers(self, names: list[int], v: np.ndarray, k: int) -> Iterator:
        import pyarrow as pa

        lengths = np.sqrt((v * v).sum(1))
        beams, _ = self.graph.search(unit(v), beam_of(len(self.x)))
        rows = []
        for i, (query, beam) in enumerate(zip(names, beams, strict=True)):
            beam = beam[beam >= 0]
            score = (self.x[beam] * v[i]).sum(1) / (self.norms[beam] * lengths[i])
            rows += [(query, other, -s) for s, other in _best(beam, score, self.ids, query, k)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def _best(beam: np.ndarray, score: np.ndarray, ids: list, query: int, k: int) -> list[tuple[float, int]]:
    """The k best by cosine, then id; one more node than k covers the query itself, equal scores come along."""
    near = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]) if len(score) > k else np.arange(len(score))
    return sorted((-s, other) for node, s in zip(beam[near].tolist(), score[near].tolist(), strict=True) for other in ids[node] if other != query)[:k]
