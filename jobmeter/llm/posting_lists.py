"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by splitting it again and again until every part is small, so
that dense regions get more of them. A graph over the centroids, held in memory, finds the nearest
ones of a vector or a query. Every vector goes to the list of its nearest centroid and, if it lies
near a boundary, to further lists, but to none whose centroid is nearer to one chosen before than to
the vector. A query reads the lists whose centroid is not much farther than the nearest. How many
copies and how many lists that takes is measured in the run: a bounded sample of the queries is
compared with every vector, and the cheapest way that finds the asked share of its exact neighbours
is taken.

Lists that lie together form shards of bounded size. A query goes to each shard once, with all its
lists there, reads them nearest first, leaves out those that cannot hold anything better than what
it has (by the list's radius), and comes back with one row.

Largest inner product is turned into smallest distance by one more dimension that lifts all vectors
to the same norm. Found candidates are scored again by the plain inner product in double precision,
added up in component order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.llm.tables import batch, bounded_batches, col
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize

SAMPLE = 32_768
LIST_SIZE = 128
MOST_LISTS = SAMPLE // 8
NEIGHBOURS = 24
BEAM = 64
CANDIDATES = 16  # nearest centroids that a vector's lists are chosen from
COPIES = 4  # lists of a boundary vector, at most
BOUNDARY = 1.15
PROBES = 8  # lists of a query and
RATIO = 1.2  # ratio of their distances to the nearest, at least
RECALL = 0.96  # share of the exact neighbours of the trial queries that their lists must hold
TRIAL_QUERIES = 256
SHARD, QUERY_BLOCK = 65_536, 8192
ROOM = 9  # candidates beyond k that are scored again: products in blocks may differ in the last bits
PRODUCTS = 4 << 20  # held at once


def split(points: np.ndarray, leaf: int, seed: int = 0) -> list[np.ndarray]:
    """Centroids of parts of at most ``leaf`` points each, by repeated splitting in up to eight."""
    waiting, centroids = [points], []
    rng = np.random.default_rng(seed)
    while waiting:
        part = waiting.pop()
        if len(part) <= leaf:
            centroids.append(part.mean(axis=0))
            continue
        k = int(min(8, max(2, -(-len(part) // leaf))))
        centre = part[rng.choice(len(part), k, replace=False)]
        for _ in range(8):
            label = ((centre**2).sum(axis=1) - 2 * part @ centre.T).argmin(axis=1)
            counts = np.bincount(label, minlength=k)
            centre = np.stack([part[label == j].mean(axis=0) if counts[j] else centre[j] for j in range(k)])
        if counts.max() == len(part):  # nothing to tell these points apart
            centroids.append(part.mean(axis=0))
            continue
        waiting += [part[label == j] for j in range(k) if counts[j]]
    return centroids


@dataclass(frozen=True)
class Index:
    """Centroids in the lifted space, their neighbour graph, and the norm that all vectors are lifted to."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float

    @classmethod
    def of(cls, sample: np.ndarray, leaf: int, norm: float) -> Index:
        centroids = np.stack(split(lift(sample, norm), leaf))
        n = len(centroids)
        square = (centroids**2).sum(axis=1)
        distance = square[:, None] - 2 * centroids @ centroids.T + square[None, :]
        near = np.argsort(distance, axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        # A few far links keep separate regions within reach.
        far = np.random.default_rng(1).integers(0, n, (n, 4 if n > NEIGHBOURS else 0))
        entries = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(np.int64))
        return cls(centroids, np.concatenate([near, far], axis=1).astype(np.int64), entries, norm)

    def nearest(self, points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of about the ``count`` nearest centroids of each point, nearest first.

        Best-first search in the graph, all points in step. Places without a centroid have distance inf.
        """
        rows, n = len(points), len(self.centroids)
        beam = max(BEAM, count)
        seen = np.zeros((rows, n), bool)
        square = (self.centroids**2).sum(axis=1)
        size = (points**2).sum(axis=1)

        def distances(lists: np.ndarray) -> np.ndarray:
            dots = np.einsum("rd,rkd->rk", points, self.centroids[lists])
            return np.maximum(size[:, None] - 2 * dots + square[lists], 0.0)

        lists = np.tile(self.entries, (rows, 1))
        far = distances(lists)
        seen[:, self.entries] = True
        done = np.zeros(lists.shape, bool)
        at = np.arange(rows)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            lists, far, done = (np.take_along_axis(x, order, axis=1) for x in (lists, far, done))
            open_ = ~done & np.isfinite(far)
            if not open_.any():
                break
            pick = open_.argmax(axis=1)
            going = open_[at, pick]
            done[at, pick] |= going
            more = self.graph[lists[at, pick]]
            fresh = ~seen[at[:, None], more] & going[:, None]
            seen[at[:, None], more] |= going[:, None]
            gap = np.where(fresh, distances(more), np.inf)
            # The same centroid may be a near and a far neighbour: keep one.
            ranked = np.sort(np.where(fresh, more, -1 - np.arange(more.shape[1])), axis=1)
            if (ranked[:, 1:] == ranked[:, :-1]).any():
                for j in range(1, more.shape[1]):
                    gap[(more[:, :j] == more[:, j : j + 1]).any(axis=1), j] = np.inf
            lists, far = np.concatenate([lists, more], axis=1), np.concatenate([far, gap], axis=1)
            done = np.concatenate([done, ~np.isfinite(gap)], axis=1)
        return lists[:, :count], np.sqrt(far[:, :count])

    def ranked(self, points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of exactly the ``count`` nearest centroids of each point, nearest first."""
        square = (self.centroids**2).sum(axis=1) - 2 * points @ self.centroids.T
        far = np.maximum(square + (points**2).sum(axis=1)[:, None], 0.0)
        lists = np.argsort(far, axis=1, kind="stable")[:, :count]
        return lists, np.sqrt(np.take_along_axis(far, lists, axis=1))


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that gives all the same norm."""
    rest = np.maximum(norm**2 - (vectors**2).sum(axis=1), 0.0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _query_points(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Queries in the lifted space: their length does not change the order, at the common norm distances compare."""
    points = vectors * (norm / np.sqrt((vectors**2).sum(axis=1)))[:, None]
    return np.concatenate([points, np.zeros((len(points), 1))], axis=1)


def _lists_of(index: Index, vectors: np.ndarray, copies: int = COPIES) -> np.ndarray:
    """(rows, copies) lists that hold each vector, the nearest first; -1 where there are fewer.

    A further list must be about as near as the first, and its centroid nearer to the vector than to
    any centroid chosen before; lists on the same side would hold the vector for nothing.
    """
    points = lift(vectors, index.norm)
    lists, far = index.nearest(points, CANDIDATES)
    chosen = np.full((len(points), copies), -1, np.int64)
    chosen[:, 0] = lists[:, 0]
    count = np.ones(len(points), np.int64)
    for j in range(1, lists.shape[1]):
        fits = (far[:, j] <= BOUNDARY * far[:, 0] + 1e-12) & (count < copies)
        for i in range(copies):
            rows = np.flatnonzero(fits & (i < count))
            gap = index.centroids[lists[rows, j]] - index.centroids[chosen[rows, i]]
            fits[rows] = np.sqrt((gap**2).sum(axis=1)) >= far[rows, j]
        rows = np.flatnonzero(fits)
        chosen[rows, count[rows]] = lists[rows, j]
        count[rows] += 1
    return chosen


@dataclass(frozen=True)
class Reading:
    """Copies of a vector, lists that a query reads at most, and their ratio of distances at most."""

    copies: int
    lists: int
    ratio: float


def _postings(index_: object, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_.value
        for given in batches:
            for first in range(0, given.num_rows, 512):
                part = given.slice(first, 512)
                lists = _lists_of(index, _matrix(part["vector"]), copies)
                row, place = np.nonzero(lists >= 0)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[row, place].astype(np.int32)), taken["vector"], taken["ids"]],
                    schema=pa.schema([("list", pa.int32()), part.schema.field("vector"), part.schema.field("ids")]),
                )

    return run


def _trial(index_: object, trial_: object, k: int):
    """For each trial query the best ``k`` vectors of a task by brute force, with the lists that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (names, points) = index_.value, trial_.value
        best = np.full((len(names), k), -np.inf)
        held = np.full((len(names), k, COPIES), -1, np.int32)
        for given in batches:
            for first in range(0, given.num_rows, 4096):
                part = given.slice(first, 4096)
                vectors = _matrix(part["vector"])
                score = points @ vectors.T
                only = np.array([x[0] if len(x) == 1 else None for x in part["ids"].to_pylist()], object)
                score[names[:, None] == only[None, :]] = -np.inf  # the query itself
                top = np.argpartition(-score, min(k, part.num_rows) - 1, axis=1)[:, :k]
                score = np.take_along_axis(score, top, axis=1)
                score[score <= best.min(axis=1)[:, None]] = -np.inf
                used, place = np.unique(top[np.isfinite(score)], return_inverse=True)
                if not len(used):
                    continue
                new = np.full((*top.shape, COPIES), -1, np.int32)
                new[np.isfinite(score)] = _lists_of(index, vectors[used])[place]
                score, new = np.concatenate([best, score], axis=1), np.concatenate([held, new], axis=1)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(score, order, axis=1)
                held = np.take_along_axis(new, order[:, :, None], axis=1)
        query, place = np.nonzero(np.isfinite(best))
        kinds = {"query": pa.int32(), "score": pa.float64(), "lists": pa.list_(pa.int32())}
        yield batch({"query": query, "score": best[query, place], "lists": list(held[query, place])}, kinds)

    return run


def _reading(
    nodes: DataFrame, queries: DataFrame, drawn: np.ndarray, index: Index, index_: object, k: int, recall: float
) -> Reading:
    """The cheapest reading that finds ``recall`` of the neighbours of the trial queries.

    Trial queries are the ``TRIAL_QUERIES`` queries of the smallest hashes. Half of what may be missed
    is left to each of the two limits. More copies make lists longer and let queries read fewer of
    them; the product of both is the cost.
    """
    few = Reading(1, PROBES, RATIO)
    order = F.xxhash64("query_id", "vector")
    trial = queries.orderBy(order, "query_id", "vector").limit(TRIAL_QUERIES).toArrow()
    if not trial.num_rows:
        return few
    vectors = _matrix(trial["vector"].combine_chunks())
    trial_ = nodes.sparkSession.sparkContext.broadcast((trial["query_id"].to_numpy(), vectors))
    found = nodes.mapInArrow(_trial(index_, trial_, k), "query int, score double, lists array<int>")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "lists"))
    exact = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "lists").toArrow()
    trial_.unpersist()
    if not exact.num_rows:
        return few
    lists, far = index.ranked(_query_points(vectors, index.norm), len(index.centroids))
    places = np.argsort(lists, axis=1)
    query = exact["query"].to_numpy()
    holds = _matrix(exact["lists"].combine_chunks()).astype(np.int64)
    place = np.where(holds >= 0, places[query[:, None], holds], len(index.centroids))
    stored = (_lists_of(index, drawn[:4096]) >= 0).mean(axis=0).cumsum()
    share = 1 - (1 - recall) / 2
    ways = []
    for copies in range(1, COPIES + 1):
        first = place[:, :copies].min(axis=1)
        need = max(PROBES, int(np.quantile(first, share, method="higher")) + 1)
        ratio = far[query, first] / np.maximum(far[query, 0], 1e-12)
        wide = max(RATIO, float(np.quantile(ratio, share, method="higher")) * (1 + 1e-9))
        read = ((far <= wide * far[:, :1]) & (np.arange(far.shape[1]) < need)).sum(axis=1).mean()
        ways.append((read * stored[copies - 1], Reading(copies, need, wide)))
    return min(ways, key=lambda way: way[0])[1]


@dataclass(frozen=True)
class Shards:
    """The first shard of every list, and how many shards a very long list takes; -1 for an empty list."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: dict[int, int], lists: int) -> Shards:
        """Lists in their order, neighbours mostly next to each other, as many as fit into a shard."""
        first, parts = np.full(lists, -1, np.int64), np.ones(lists, np.int64)
        shard, filled = 0, 0
        for i in sorted(sizes):
            if filled and filled + sizes[i] > SHARD:
                shard, filled = shard + 1, 0
            first[i], parts[i] = shard, -(-sizes[i] // SHARD)
            filled += sizes[i]
            if parts[i] > 1:
                shard, filled = shard + parts[i], 0
        return cls(first, parts)


def _probes(index_: object, shards_: object, reading: Reading):
    """(shard, query_id, vector, lists, far): every query once for each shard that it reads in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shards = index_.value, shards_.value
        schema = None
        for given in batches:
            for start in range(0, given.num_rows, 256):
                part = given.slice(start, 256)
                lists, far = index.nearest(_query_points(_matrix(part["vector"]), index.norm), reading.lists)
                near = (far <= reading.ratio * far[:, :1] + 1e-12) & np.isfinite(far) & (shards.first[lists] >= 0)
                row, place = np.nonzero(near)
                which, distance = lists[row, place], far[row, place]
                copies = shards.parts[which]
                turn = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, which, distance = (np.repeat(x, copies) for x in (row, which, distance))
                shard = shards.first[which] + turn
                order = np.lexsort((distance, shard, row))
                row, which, distance, shard = row[order], which[order], distance[order], shard[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])][: len(row)])
                ends = np.append(new, len(row))[: len(new) + 1].astype(np.int32)
                taken = part.take(pa.array(row[new]))
                schema = schema or pa.schema(
                    [("shard", pa.int32()), part.schema.field("query_id"), part.schema.field("vector"),
                     ("lists", pa.list_(pa.int32())), ("far", pa.list_(pa.float64()))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[new].astype(np.int32)), taken["query_id"], taken["vector"],
                        pa.ListArray.from_arrays(ends, pa.array(which.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(distance)),
                    ],
                    schema=schema,
                )

    return run


def _scan(index_: object | None, k: int, copies: int):
    """One row per query of a shard: its best ``k`` (vec_id, score) there."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        vectors = vectors.sort_by("list")
        v, q = (_matrix(t["vector"].combine_chunks()) for t in (vectors, queries))
        names, bounds = np.unique(vectors["list"].to_numpy(), return_index=True)
        bounds = np.append(bounds, len(v))
        asked, far = queries["lists"].combine_chunks(), queries["far"].combine_chunks()
        row = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy()))
        turn = np.arange(len(row)) - np.repeat(asked.offsets.to_numpy()[:-1] - asked.offsets[0].as_py(), np.diff(asked.offsets.to_numpy()))
        which, distance = asked.flatten().to_numpy(), far.flatten().to_numpy()
        # A list's radius bounds what a query can find in it.
        radius = np.full(len(names), np.inf)
        if index_ is not None:
            index: Index = index_.value
            size = np.sqrt((q**2).sum(axis=1))
            for i, name in enumerate(names):
                gap = lift(v[bounds[i] : bounds[i + 1]], index.norm) - index.centroids[name]
                radius[i] = np.sqrt((gap**2).sum(axis=1).max())
        width = (k + ROOM) * copies  # a vector may come once for each of its lists
        best, held = np.full((len(q), width), -np.inf), np.full((len(q), width), -1, np.int64)
        place = np.minimum(np.searchsorted(names, which), len(names) - 1)
        here = names[place] == which
        for low in [0, *(1 << np.arange(20))]:
            now = here & (turn >= low) & (turn < max(2 * low, 1))
            if index_ is not None and low:
                # In the lifted space a vector at distance d has the product norm**2 - d**2 / 2.
                nearest = np.maximum(distance - radius[place], 0.0)
                most = (index.norm**2 - nearest**2 / 2) * (size / index.norm)[row]
                now &= most >= best[row].min(axis=1) - 1e-9 * index.norm * size[row]
            order = np.flatnonzero(now)[np.argsort(place[now], kind="stable")]
            cut = np.flatnonzero(np.diff(place[order])) + 1
            for pairs in np.split(order, cut) if len(order) else []:
                a, b = bounds[place[pairs[0]]], bounds[place[pairs[0]] + 1]
                for first in range(0, len(pairs), max(1, PRODUCTS // (b - a))):
                    rows = row[pairs[first : first + max(1, PRODUCTS // (b - a))]]
                    score = q[rows] @ v[a:b].T
                    top = np.argpartition(-score, min(width, b - a) - 1, axis=1)[:, :width]
                    both = np.concatenate([best[rows], np.take_along_axis(score, top, axis=1)], axis=1)
                    keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
                    best[rows] = np.take_along_axis(both, keep, axis=1)
                    held[rows] = np.take_along_axis(np.concatenate([held[rows], top + a], axis=1), keep, axis=1)
        ids = vectors["ids"].to_pylist()
        score = np.zeros(held.shape)
        for d in range(v.shape[1]):
            score += q[:, d : d + 1] * v[held, d]
        found_ids, found_scores = [], []
        for name, places, scores in zip(queries["query_id"].to_pylist(), held.tolist(), score.tolist()):
            pairs = {x: -s for j, s in sorted(zip(places, scores), key=lambda p: p[1]) if j >= 0 for x in ids[j] if x != name}
            ranked = sorted((s, x) for x, s in pairs.items())[:k]
            found_ids.append([x for _, x in ranked])
            found_scores.append([-s for s, _ in ranked])
        return pa.Table.from_batches(
            [batch({"query_id": queries["query_id"].combine_chunks(), "ids": found_ids, "scores": found_scores}, kinds)]
        )

    return run


def _meet(postings: DataFrame, probes: DataFrame, index_: object | None, k: int, copies: int) -> DataFrame:
    """(query_id, ids, scores): the best k of every shard for each query that reads in it."""
    asked = probes.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = small_side(materialize(asked, "shards"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    one = F.pmod(F.xxhash64("query_id", "vector"), F.col("blocks")).cast("int").alias("block")
    left = postings.join(asked, "shard").select("shard", every, "list", "vector", "ids")
    right = probes.join(asked, "shard").select("shard", one, "query_id", "vector", "lists", "far")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _scan(index_, k, copies), "query_id long, ids array<long>, scores array<double>"
    )


def _merge(k: int):
    def run(found: pa.Table) -> pa.Table:
        ids = found["ids"].combine_chunks()
        query = np.repeat(found["query_id"].to_numpy(), np.diff(ids.offsets.to_numpy()))
        vec, score = ids.flatten().to_numpy(), found["scores"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        new = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])][: len(query)]
        query, vec, score = query[new], vec[new], score[new]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left") + 1
        keep = rank <= k
        kinds = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.Table.from_batches(
            [batch({"query_id": query[keep], "rank": rank[keep], "vec_id": vec[keep], "score": score[keep]}, kinds)]
        )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query over all shards; groups of queries hold bounded answers."""
    found = materialize(found, "answers")
    blocks = 1 + found.count() * k // PRODUCTS
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return found.groupBy(block.alias("block")).applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query.

    Queries are the rows of ``vectors`` that satisfy ``is_query`` (over the column ``vec_id``); their
    candidates are all rows of another id. Ties go to the smaller id. A query for which fewer than
    ``k`` candidates were found in its lists is compared with all rows, in blocks.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do vectors whose length is not the most common one (the smaller at a tie). Rows of
    equal id and vector are one; equal vectors are indexed once with their k + 1 smallest ids, which
    is all that a result can hold. An empty table gives an empty table. The centroids are fitted on at
    most ``sample`` vectors, those with the smallest hashes; every vector is indexed. How many lists a
    query reads follows from the ``recall`` measured on a sample of the queries, so it grows with the
    number of lists where neighbours spread over many of them.
    """
    cast = bounded_batches(vectors).select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    nonzero = F.exists("vector", lambda x: x != 0)
    valid = cast.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & sound & nonzero)
    valid = valid.select("vec_id", F.transform("vector", lambda x: x + 0.0).alias("vector"))
    sizes = valid.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").select("d").limit(1)
    rows = valid.join(F.broadcast(common), F.size("vector") == F.col("d"), "left_semi").distinct()
    rows = materialize(rows, "vectors")

    few = rows
    for salt in (F.pmod(F.xxhash64("vec_id"), F.lit(64)), F.lit(0)):
        order = W.partitionBy("vector", salt).orderBy("vec_id")
        few = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "nodes")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector")

    total = nodes.agg(
        F.count("*").alias("n"),
        F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"),
    ).first()
    drawn = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()
    if not drawn.num_rows:
        return queries.select(
            "query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")
        ).limit(0)
    points = _matrix(drawn["vector"].combine_chunks())
    lists = min(max(1, total["n"] // LIST_SIZE), MOST_LISTS)
    index = Index.of(points, max(1, len(points) // lists), total["norm"] * (1 + 1e-9))
    spark = vectors.sparkSession
    # At most about 2 * MOST_LISTS centroids with their neighbours, whatever the number of vectors.
    index_ = spark.sparkContext.broadcast(index)
    reading = _reading(nodes, queries, points, index, index_, k, recall)
    postings = materialize(
        nodes.mapInArrow(_postings(index_, reading.copies), "list int, vector array<double>, ids array<long>"), "postings"
    )
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # one row per centroid
    shards = Shards.of(sizes, len(index.centroids))
    shards_ = spark.sparkContext.broadcast(shards)
    table = spark.createDataFrame(
        [(i, int(shards.first[i]), int(shards.parts[i])) for i in sizes], "list int, first int, parts int"
    )
    shard = (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts"))).cast("int").alias("shard")
    placed = postings.join(F.broadcast(table), "list").select(shard, "list", "vector", "ids")
    probes = materialize(
        queries.mapInArrow(
            _probes(index_, shards_, reading), "shard int, query_id long, vector array<double>, lists array<int>, far array<double>"
        ),
        "probes",
    )
    best = materialize(_best(_meet(placed, probes, index_, k, reading.copies), k), "neighbours")

    # Where lists hold too few candidates, the query is compared with every vector once.
    possible = rows.select("vec_id").distinct().count() - 1
    complete = best.groupBy("query_id").count().where(F.col("count") >= min(k, possible))
    short = materialize(queries.join(complete, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        parts = 1 + total["n"] // SHARD
        part = F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int").alias("shard")
        whole = nodes.select(part, F.lit(0).alias("list"), "vector", "ids")
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard")
        none = [F.array(F.lit(0)).alias("lists"), F.array(F.lit(0.0)).alias("far")]
        rest = _best(_meet(whole, short.select(every, "query_id", "vector", *none), None, k, 1), k)
        best = best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
    return best.select("query_id", "rank", "vec_id", "score")
