"""Approximate nearest neighbours by query-aware collision counting (QALSH, Huang et al. 2015).

Inner products become distances by one more coordinate (Neyshabur & Srebro 2015),
scaled by the longest vector.  Vectors are ordered by one projection and cut into
blocks of equal size; a block keeps a sorted array for each projection.  A query
opens a window around its own projection in every array, and vectors that lie in
enough windows have collided often enough and are verified by their exact product.
Directions are columns of random rotations, so the windows of all projections
together hold as much about the distance as so many numbers can.

A query first searches the block that its own projection falls in, widening windows by
virtual rehashing until enough neighbours within the windows' radius are verified.
That radius bounds its neighbours' distance, and a projection never exceeds a
distance, so all that remain are the blocks whose range of the ordering projection
lies within the radius; there the windows have the radius' width at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow
from .sharding import number_rows

#: Rotations, each of which gives as many projections as the vectors have dimensions and one.
ROTATIONS = 2
#: A vector is verified once it lies in this share of the windows; windows are so wide that one at the radius does, but for MARGIN standard deviations.
THRESHOLD, MARGIN = 0.85, 0.82
#: Radius of the first windows.
START = 0.1
#: Windows with fewer entries than this share of a block are read from the sorted arrays, wider ones are compared by rank.
SPARSE = 0.1
BLOCK_ROWS = 16_384
#: Blocks at most, so that the table of their ranges stays below 16 MB.
MOST_BLOCKS = 1_000_000
#: Queries of one block that one task answers.
QUERY_ROWS = 1024
SEED = 7


def directions(dimensions: int, rotations: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """Unit columns, orthogonal within each rotation, for vectors with the additional coordinate."""
    r = np.random.default_rng(seed)
    return np.column_stack([np.linalg.qr(r.standard_normal((dimensions + 1, dimensions + 1)))[0] for _ in range(rotations)])


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled by the longest, with the coordinate that makes them of length one."""
    scaled = vectors / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])


def asked(queries: np.ndarray) -> np.ndarray:
    """Queries of length one with the additional coordinate, which is 0."""
    return np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))])


class BlockIndex:
    """Sorted projections of one block of vectors, and each vector's rank in each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, lines: np.ndarray):
        self.ids, self.vectors, self.longest, self.lines = ids, vectors, longest, lines
        made = (lifted(vectors, longest) @ lines).T
        self.order = np.argsort(made, axis=1, kind="stable")
        self.sorted = np.take_along_axis(made, self.order, axis=1)
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.ranks = np.empty(made.shape, kind)
        np.put_along_axis(self.ranks, self.order, np.broadcast_to(np.arange(len(ids), dtype=kind), made.shape), axis=1)
        self.room, self.inside = np.empty_like(self.ranks), np.empty(made.shape, bool)
        m = lines.shape[1]
        self.need = int(np.ceil(THRESHOLD * m))
        share = min(0.9999, THRESHOLD + MARGIN * np.sqrt(THRESHOLD * (1 - THRESHOLD) / m))
        self.reach = NormalDist().inv_cdf((1 + share) / 2) / np.sqrt(lines.shape[0])
        self.typical, self.verified = START, 0

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and size of each projection's window, a row for each query."""
        width = radius[:, None] * self.reach
        lo = np.array([row.searchsorted(x, "left") for row, x in zip(self.sorted, (at - width).T)]).T
        hi = np.array([row.searchsorted(x, "right") for row, x in zip(self.sorted, (at + width).T)]).T
        return lo, hi - lo

    def hits(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many of the first windows, as many as are given, each row lies."""
        n, kind = len(lo), self.ranks.dtype
        np.subtract(self.ranks[:n], lo.astype(kind)[:, None], out=self.room[:n])
        np.less(self.room[:n], size.astype(kind)[:, None], out=self.inside[:n])
        return np.add.reduce(self.inside[:n].view(np.uint8), axis=0, dtype=np.uint8 if n < 256 else np.uint32)

    def colliding(self, lo: np.ndarray, size: np.ndarray, least: int = 0) -> np.ndarray:
        """Rows that lie in enough of a query's windows; none, where a part of the windows shows that fewer than least do."""
        if least:
            part = len(lo) // 4
            if np.count_nonzero(self.hits(lo[:part], size[:part]) >= self.need - (len(lo) - part)) < least:
                return np.zeros(0, np.int64)
        if size.sum() <= SPARSE * self.ranks.size:
            met = np.concatenate([row[a : a + n] for row, a, n in zip(self.order, lo.tolist(), size.tolist())])
            return np.flatnonzero(np.bincount(met, minlength=len(self.ids)) >= self.need)
        return np.flatnonzero(self.hits(lo, size) >= self.need)

    def search(self, own: np.ndarray, queries: np.ndarray, at: np.ndarray, k: int, radius: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each query, ids and exact products of the best k verified rows but those of its own id, best first, ties to the smaller id, and the radius searched.

        Where radius is NaN, windows widen until k rows within their radius are verified,
        or the block is; else they are opened for it once.
        """
        out: list = [None] * len(own)
        scale = self.longest * np.linalg.norm(queries, axis=1)

        def level(open_: np.ndarray, wide: np.ndarray, least: int = 0) -> np.ndarray:
            lo, size = self.windows(at[open_], wide)
            far = np.empty(len(open_))
            for j, i in enumerate(open_.tolist()):
                rows = self.colliding(lo[j], size[j], least) if wide[j] < 4 else np.arange(len(self.ids))
                ids, scores = self.verify(rows, own[i], queries[i], k)
                # the distance of the k-th best that has been verified bounds the radius wanted
                far[j] = np.sqrt(max(0.0, 2 - 2 * scores[-1] / scale[i])) if len(ids) == k else np.inf
                out[i] = (ids, scores, float(far[j]))
            return far

        def widen(open_: np.ndarray) -> None:
            """Levels at the bounds known, or wider and wider ones, until each query has k rows within its windows' radius."""
            last = np.full(len(open_), 1.0 / 1.25)
            while len(open_):
                far = np.array([out[i][2] for i in open_])
                wide = np.where(np.isfinite(far), far, np.minimum(4.0, 1.25 * last))
                far = level(open_, wide)
                left = (far > wide * (1 + 1e-9)) & (wide < 4)
                open_, last = open_[left], wide[left]

        known = ~np.isnan(radius)
        if known.any():
            level(np.flatnonzero(known), radius[known])
        open_ = np.flatnonzero(~known)
        wide = np.full(len(open_), START)
        if len(open_):
            far = level(open_, wide, k)
            open_ = open_[far > wide]
        if len(open_) and self.typical == START:
            # the first queries tell from which radius on most are answered
            widen(open_[:8])
            known_ = [out[i][2] for i in open_[:8] if np.isfinite(out[i][2])]
            self.typical = 1.02 * float(np.median(known_)) if known_ else 4.0
            open_ = open_[8:]
        if len(open_):
            wide = np.full(len(open_), self.typical)
            far = level(open_, wide)
            widen(open_[far > wide])
        return out

    def verify(self, rows: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        self.verified += len(rows)
        score = np.einsum("ij,j->i", self.vectors[rows], query)  # one order of summation for all rows
        if len(rows) > k:
            near = np.flatnonzero(score >= np.partition(score, len(rows) - k)[len(rows) - k])
            rows, score = rows[near], score[near]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def usable(vectors: DataFrame, key: str, vector: str, is_query: str) -> DataFrame:
    """vec_id, vector as doubles, and whether a row is a query, of the rows that take part.

    Left out are null ids, vectors that are null, empty or zero or hold null or
    non-finite components or whose squares overflow, and those of another length than
    most have.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.filter(F.forall("vector", finite)).withColumn("square", square).filter(finite(F.col("square")) & (F.col("square") > 0))


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, dimensions)


VISIT = "block long, query_id long, vector array<double>, radius double"
FOUND = "query_id long, vec_id long, score double, radius double"


def search(vectors: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that fulfils the SQL condition is_query its k best others.

    Rows that repeat an id are candidates each, but no candidates of that id's
    query, which is searched once, with the smallest vector.  Fewer than k candidates give
    fewer rows; an empty table gives none.  Queries stay on the executors.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector, is_query)
    shapes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions, total, longest = shapes[0]["d"], shapes[0]["n"], float(np.sqrt(shapes[0]["square"])) * (1 + 1e-9)
    lines = directions(dimensions)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lifted(_matrix(batch, dimensions), longest) @ lines[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    rows = rows.filter(F.size("vector") == dimensions).select("vec_id", "asks", "vector").mapInArrow(project, "vec_id long, asks boolean, vector array<double>, at double")
    numbered, _ = number_rows(rows, "at", F.xxhash64("vec_id"), "vector")
    size = max(block_rows, -(-total // MOST_BLOCKS))
    placed = materialize(numbered.withColumn("block", F.floor(F.col("row_number") / size).cast("long")).select("block", "vec_id", "asks", "vector", "at"), "placed")
    ranges = placed.groupBy("block").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("block").toPandas()  # MOST_BLOCKS at most
    bounds = spark.sparkContext.broadcast((ranges["lo"].to_numpy(), ranges["hi"].to_numpy()))
    queries = placed.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))

    def visit(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi = bounds.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = asked(_matrix(batch, dimensions)) @ lines[:, 0]
                home = np.maximum(0, np.searchsorted(lo, at, "right") - 1)
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array(home), batch.column("query_id"), batch.column("vector"), pa.nulls(len(home), pa.float64())], names=["block", "query_id", "vector", "radius"])
                    continue
                radius = batch.column("radius").to_numpy(zero_copy_only=False)
                # blocks are in order, so those in reach are neighbours
                a, b = np.searchsorted(hi, at - radius * (1 + 1e-9)), np.searchsorted(lo, at + radius * (1 + 1e-9), "right")
                n = np.maximum(0, b - a)
                which = np.repeat(np.arange(len(at)), n)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]
                other = block != home[which]
                which, block = which[other], block[other]
                for i in range(0, len(which), 1000):
                    part = batch.take(pa.array(which[i : i + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 1000]), part.column("query_id"), part.column("vector"), part.column("radius")], names=["block", "query_id", "vector", "radius"])

        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group, vectors before queries: each group's index is built and its queries are answered as they come."""
        group: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index: BlockIndex | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("block", "part")])
            is_query, ids, vectors_ = batch.column("query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), _matrix(batch, dimensions)
            radii = batch.column("radius").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)]):
                if group != tuple(keys[a]):
                    group, held, index = tuple(keys[a]), [], None
                if not is_query[a]:
                    held.append((ids[a:b], vectors_[a:b]))
                    continue
                if index is None:
                    index = BlockIndex(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), longest, lines)
                    held = []
                got = index.search(ids[a:b], vectors_[a:b], asked(vectors_[a:b]) @ lines, k, radii[a:b])
                n = [len(x) for x, _, _ in got]
                # a query without a single neighbour in its home block still has a radius
                none = [i for i, x in enumerate(n) if not x]
                for i in none:
                    got[i] = (np.array([-1]), np.array([-np.inf]), got[i][2])
                n = [len(x) for x, _, _ in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], n)), pa.array(np.concatenate([x for x, _, _ in got])), pa.array(np.concatenate([s for _, s, _ in got])), pa.array(np.repeat(np.array([r for _, _, r in got], float), n))], names=["query_id", "vec_id", "score", "radius"])

    def searched(visits: DataFrame) -> DataFrame:
        parts = materialize(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("parts")), "parts")
        near = narrow(parts)
        data = placed.join(near, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), F.col("vec_id").alias("id"), "vector", F.lit(None).cast("double").alias("radius"))
        asks = visits.join(near, "block").select("block", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"), F.col("query_id").alias("id"), "vector", "radius")
        return data.unionAll(asks).repartition("block", "part").sortWithinPartitions("block", "part", "query").mapInArrow(answer, FOUND)

    at_home = materialize(searched(materialize(queries.mapInArrow(visit(True), VISIT), "visits")), "home")
    radii = at_home.groupBy("query_id").agg(F.max("radius").alias("radius"))
    visits = materialize(queries.join(radii, "query_id").mapInArrow(visit(False), VISIT), "visits")
    all_found = at_home.unionAll(searched(visits)).filter("vec_id <> -1 OR score > double('-Infinity')")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
