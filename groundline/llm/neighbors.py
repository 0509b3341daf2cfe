"""Problem 1: the most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on full clusters, so that lists stay balanced; every vector is indexed. A vector
goes to its nearest centroid and, near a boundary, to each further one within a ratio of that distance, up to ``LISTS``; the same rule
selects the lists it searches. Centroids are found through an in-memory graph: a few pivots, then hops over each centroid's neighbours.
Two tables with centroids of their own make it unlikely that a pair is parted in both. A list of more than about ``LIST_ROWS`` vectors (by
the sample's share) is cut into blocks, and every block of searching vectors is held against every block of the list in a task of its own,
so nothing is left out of a crowded list and no task holds all of it.

Copies of one vector are indexed once and expanded afterwards, each class by its least ids, so a class of a third of all rows adds a few
rows for each of its members.

Cosines are computed exactly, in double precision, for all candidates of a list. Ranking is by cosine, then by id.

Defined results: null vectors, vectors of another length, with null, NaN or infinite values, or all zero, are not usable and have no
neighbours; the norm does not matter; rows with one id count once; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.session import checkpoint

#: Vectors for each centroid; the most centroids (16 MB as broadcast); rows of the sample for each centroid, and at most (about, since the
#: sample is drawn by a hash of the id).
PER_CENTROID, CENTROIDS, PER_SAMPLE, SAMPLE = 256, 65_536, 12, 131_072
TABLES, LISTS, RATIO, LIST_ROWS = 2, 3, 1.06, 20_000
DEGREE, BEAM, HOPS = 24, 8, 3


def usable(embedding: Column, width: int) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(embedding) == width) & finite & F.exists(embedding, lambda x: x != 0)


def unit(rows: np.ndarray, kind: type = np.float64) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(kind)


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, in order."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable"), axis=1)


class Graph:
    """Centroids with pivots and a neighbour graph over them."""

    def __init__(self, sample: np.ndarray, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.centroids = sample[rng.permutation(len(sample))[:count]]
        self._link()
        size = np.full(len(self.centroids), len(sample) / len(self.centroids))
        for _ in range(2):
            near, score = self.search(sample, 4)
            full = size[near] / size.mean()
            own = near[np.arange(len(sample)), (score - 0.05 * np.log1p(full)).argmax(axis=1)]
            size = np.bincount(own, minlength=len(self.centroids)).astype(float)
            moved = np.zeros_like(self.centroids)
            np.add.at(moved, own, sample)
            held = size > 0
            moved[held] /= np.maximum(np.linalg.norm(moved[held], axis=1, keepdims=True), 1e-12)
            self.centroids = np.where(held[:, None], moved, self.centroids).astype(np.float32)
            self._link()

    def _link(self) -> None:
        """Each centroid's neighbours, sought among the centroids of the pivots nearest to it."""
        c = self.centroids
        self.pivots = np.arange(0, len(c), max(1, int(len(c) ** 0.5)))
        near = np.concatenate([top(c[i : i + 4096] @ c[self.pivots].T, 8) for i in range(0, len(c), 4096)])
        order = np.argsort(near[:, 0], kind="stable")
        first = np.searchsorted(near[order, 0], np.arange(len(self.pivots) + 1))
        self.links = np.zeros((len(c), min(DEGREE, len(c))), np.int32)
        for p in range(len(self.pivots)):
            mine = order[first[p] : first[p + 1]]
            if len(mine):
                pool = np.unique(np.concatenate([order[first[q] : first[q + 1]] for q in np.unique(near[mine])]))
                links = pool[top(c[mine] @ c[pool].T, DEGREE)]
                self.links[mine] = links[:, np.arange(self.links.shape[1]) % links.shape[1]]

    def search(self, rows: np.ndarray, k: int, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of about the k nearest centroids of each row: from the best pivots over the graph."""
        found, scores = [], []
        for i in range(0, len(rows), chunk):
            x = rows[i : i + chunk]
            ids = self.pivots[top(x @ self.centroids[self.pivots].T, BEAM)]
            score = np.einsum("nd,nkd->nk", x, self.centroids[ids])
            for _ in range(HOPS):
                ids = np.concatenate([ids, self.links[ids[:, :BEAM]].reshape(len(x), -1)], axis=1)
                ids.sort(axis=1)
                score = np.matmul(self.centroids[ids], x[:, :, None])[:, :, 0]
                score[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
                best = top(score, max(BEAM, k))
                ids, score = np.take_along_axis(ids, best, axis=1), np.take_along_axis(score, best, axis=1)
            if ids.shape[1] < k:
                more = k - ids.shape[1]
                ids, score = np.pad(ids, ((0, 0), (0, more)), mode="edge"), np.pad(score, ((0, 0), (0, more)), constant_values=-2)
            found.append(ids[:, :k])
            scores.append(score[:, :k])
        return np.concatenate(found), np.concatenate(scores)

    def lists(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the nearest centroid of each row and every further one within the ratio of its distance."""
        ids, score = self.search(rows, LISTS)
        distance = np.sqrt(np.maximum(2 - 2 * score, 1e-12))
        keep = (distance <= RATIO * distance[:, :1]) & (score > -1.5)
        keep[:, 0] = True
        row, place = np.nonzero(keep)
        return row, ids[row, place]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _crowded(graphs: list[Graph], sample: np.ndarray, count: int) -> dict[int, int]:
    """The number of blocks of each list that has more than LIST_ROWS of all rows, by its share of the sample."""
    blocks = {}
    for number, graph in enumerate(graphs):
        sizes = np.bincount(graph.lists(sample)[1], minlength=len(graph.centroids)) * (count / len(sample))
        blocks.update({int(p) * len(graphs) + number: int(-(-sizes[p] // LIST_ROWS)) for p in np.flatnonzero(sizes > LIST_ROWS)})
    return blocks


def nearest(vectors: DataFrame, k: int, width: int, least: float = -1.0) -> DataFrame:
    """(a, b, cosine): for each row of vectors (id, embedding), all usable and different, its k nearest others of cosine at least least."""
    spark = vectors.sparkSession
    count = vectors.count()
    centroids = int(min(CENTROIDS, max(1, count // PER_CENTROID)))
    if not count:
        return spark.createDataFrame([], "a string, b string, cosine double")
    share = min(SAMPLE, max(4096, PER_SAMPLE * centroids)) / count
    taken = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1).select("embedding").toArrow()
    if not taken.num_rows:
        taken = vectors.select("embedding").limit(1).toArrow()
    sample = unit(_matrix(taken.column(0).combine_chunks(), width), np.float32)
    graphs = spark.sparkContext.broadcast([Graph(sample, centroids, seed) for seed in range(TABLES)])

    def assigned(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = unit(_matrix(batch.column("embedding"), width), np.float32)
        for number, graph in enumerate(graphs.value):
            row, place = graph.lists(rows)
            yield row, place * TABLES + number

    crowded = spark.sparkContext.broadcast(_crowded(graphs.value, sample, count))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                names = np.fromiter((crc32(i.encode()) for i in batch.column("id").to_pylist()), np.int64, batch.num_rows)
                for row, place in assigned(batch):
                    cut = np.array([crowded.value.get(p, 1) for p in place.tolist()], np.int64)
                    own = names[row] % cut  # by the id, so that a task that runs again deals out alike
                    copies = 2 * cut - 1  # its block against each, then each other against its block
                    again = np.repeat(np.arange(len(row)), copies)
                    turn, mine, cuts = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies), own[again], cut[again]
                    other = np.where(turn < cuts, turn, (mine + 1 + turn - cuts) % cuts)
                    query = turn < cuts
                    block = np.where(query, mine * cuts + other, other * cuts + mine)
                    rows = batch.take(pa.array(row[again]))
                    flags = [pa.array(place[again]), pa.array(block), pa.array(query), pa.array(~query | (other == mine))]
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("embedding"), *flags], ["id", "embedding", "list", "block", "query", "member"])

    def compared(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        rows = unit(_matrix(group.column("embedding").combine_chunks(), width))
        query, member = (np.flatnonzero(group.column(c).to_numpy()) for c in ("query", "member"))
        inside = rows[member]
        a, b, cosine = [], [], []
        for i in range(0, len(query) if len(member) else 0, 1024):
            asked = query[i : i + 1024]
            score = rows[asked] @ inside.T
            itself = np.minimum(np.searchsorted(member, asked), len(member) - 1)
            same = np.flatnonzero(member[itself] == asked)
            score[same, itself[same]] = -2
            hit = np.flatnonzero((score >= least).any(axis=1))
            if len(hit):
                best = top(score[hit], k)
                value = np.take_along_axis(score[hit], best, axis=1)
                r, c = np.nonzero((value >= least) & (value > -1.5))
                a.append(asked[hit[r]])
                b.append(member[best[r, c]])
                cosine.append(value[r, c])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"a": pa.array(ids[cat(a, np.int64)], pa.string()), "b": pa.array(ids[cat(b, np.int64)], pa.string()), "cosine": pa.array(cat(cosine, np.float64))})

    lists = vectors.select("id", "embedding").mapInArrow(placed, "id string, embedding array<float>, list long, block long, query boolean, member boolean")
    found = lists.groupBy("list", "block").applyInArrow(compared, "a string, b string, cosine double")
    once = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def similar_pairs(items: DataFrame, k: int = 5, least: float = 0.9, width: int = 64, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(a, b), a < b: pairs of ids where one is among the other's k most similar, and their cosine is at least least."""
    rows = items.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("embedding")).filter(F.col("id").isNotNull() & usable(F.col("embedding"), width))
    print_ = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g")]
    # minus zero would hash apart from zero
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))
    members = rows.select("id", *print_).distinct()
    classes = checkpoint(rows.select(*print_, F.struct("id", "embedding").alias("_")).groupBy("h", "g").agg(F.min("_").alias("_")).select("h", "g", "_.id", "_.embedding"))
    edges = nearest(classes.select("id", "embedding"), k, width, least)
    # the least ids of each class: enough for every member to find k others
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).filter(F.col("n") <= k + 1)
    named = classes.select("h", "g", F.col("id").alias("class"))
    first = first.join(named, ["h", "g"]).select("class", F.col("id").alias("other"))
    own = named.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(2.0).alias("cosine"))
    near = edges.unionByName(own).join(first, F.col("b") == F.col("class")).select("a", "cosine", "other")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "other"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    listed = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("near")).filter(F.size("near") > 1)
    each = members.join(named, ["h", "g"]).join(listed, F.col("class") == F.col("a"))
    others = F.slice(F.filter("near.other", lambda x: x != F.col("id")), 1, k)
    return each.select("id", F.explode(others).alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
