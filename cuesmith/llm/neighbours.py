"""Nearest neighbours by collision counting: sorted projections, windows that widen around the query, verification of what collides often."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.llm.common import row_ids

#: Vectors of one part, whose windows a task holds: about 1100 bytes a vector at the most.
PART = 1 << 17
#: Projections. A window reaches WIDTH radii to either side of the query.
PROJECTIONS, WIDTH = 64, 1.5
#: A vector as far as the radius collides less often than the threshold in 0.13 % of cases (so many standard deviations); nearer ones, rarer.
MARGIN = 3.0
#: Ranges of about equal numbers of vectors into which a sorted projection is cut; windows are made of whole ranges.
RANGES = 32
#: One vector in FIRST is verified for the first radius, but no fewer than LEAST; the others' collisions are counted CHUNK at a time.
FIRST, LEAST, CHUNK = 16, 64, 1 << 15
#: Queries searched together, those counted together, and vectors of one matrix product.
BLOCK, COUNTED, TILE = 64, 32, 1 << 12
#: Candidates of a chunk, one in so many, up to which they are verified one by one.
SCATTERED = 64

SEED = 20_231


def directions(dimension: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Fixed random directions, orthogonal in groups of `dimension`, scaled so that a difference of length s has projections of variance s ** 2."""
    rng = np.random.Generator(np.random.PCG64([SEED, dimension]))
    bases = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-projections // dimension))]
    return np.concatenate(bases, axis=1)[:, :projections] * sqrt(dimension)


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, margin: float = MARGIN) -> int:
    """Collisions that make a vector a candidate: what one at the radius has, less `margin` standard deviations."""
    p = erf(width / sqrt(2))
    return max(1, int(projections * p - margin * sqrt(projections * p * (1 - p))))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order; query: one vector, or one for each."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        d = vectors[:, j].astype(np.float64) - query[..., j].astype(np.float64)
        total += d * d
    return np.sqrt(total)


def often(windows: Iterator[np.ndarray], least: int) -> np.ndarray:
    """Bits that are set in `least` or more of the bitmaps: counts are kept in bit slices, added three bitmaps of one weight at a time."""
    waiting: list[list[np.ndarray]] = []

    def put(x: np.ndarray, weight: int) -> None:
        if weight == len(waiting):
            waiting.append([])
        waiting[weight].append(x)
        if len(waiting[weight]) == 3:
            a, b, c = waiting[weight]
            odd = a ^ b
            a &= b
            b = odd & c
            a |= b
            odd ^= c
            waiting[weight] = [odd]
            put(a, weight + 1)

    for w in windows:
        put(w, 0)
    slices, weight = [], 0
    while weight < len(waiting):
        if len(waiting[weight]) == 2:
            a, b = waiting[weight]
            waiting[weight] = [a ^ b]
            put(a & b, weight + 1)
        slices += waiting[weight]
        weight += 1
    if least >> len(slices):
        return np.zeros_like(slices[0])
    more, equal = np.zeros_like(slices[0]), ~np.zeros_like(slices[0])
    for i in reversed(range(len(slices))):
        if least >> i & 1:
            equal &= slices[i]
        else:
            more |= equal & slices[i]
            equal &= ~slices[i]
    return more | equal


class SortedProjections:
    """One part's vectors (all of one length) with their projections, each sorted and cut into ranges, with a bitmap of what lies before each cut.

    A few vectors, verified whole, give each query a first radius: the distance of its k-th nearest so far, which later ones shorten. All
    others are compared with the query's window in each projection, WIDTH radii to either side, and their collisions are counted; those
    that reach the threshold are verified by their distance. As no vector of the k nearest lies beyond the radius, what is missed is what
    collides too rarely. Of equal vectors, only the first k + 1 in the given order take part: no query's k nearest hold more of them.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
        order = np.lexsort((rows, ids))
        vectors, ids, rows = vectors[order], ids[order], rows[order]
        whole = np.ascontiguousarray(vectors + np.float32(0)).view(np.dtype((np.void, vectors.shape[1] * 4))).ravel()
        same = np.unique(whole, return_inverse=True)[1].ravel()
        by = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(same[by]) != 0))
        nth = np.empty(len(same), np.int64)
        nth[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        first = np.flatnonzero(nth <= k)
        mixed = np.random.Generator(np.random.PCG64(SEED)).permutation(len(first))  # the first ones are like the others
        self.place, first = mixed, first[mixed]
        self.vectors, self.ids, self.rows, self.k = vectors[first], ids[first], rows[first], k
        largest = float(np.abs(self.vectors).max())
        self.scale = 1.0 / largest if largest else 1.0
        self.middle = self.vectors.mean(axis=0, dtype=np.float64) * self.scale
        self.near = (self.vectors.astype(np.float64) * self.scale - self.middle).astype(np.float32)
        self.square = np.einsum("ij,ij->i", self.near, self.near)
        self.axes = directions(vectors.shape[1])
        n = len(first)
        self.verified = min(n, max(LEAST, n // FIRST))
        self.cuts, self.before = np.zeros((PROJECTIONS, 0)), []
        if n > self.verified:
            some = self.near[: max(self.verified, 1 << 12)] @ self.axes
            self.cuts = np.quantile(some, np.arange(1, RANGES) / RANGES, axis=0).T.copy()
        for a in range(self.verified, n, CHUNK):
            shadow = (self.near[a : a + CHUNK] @ self.axes).T
            width = -(-shadow.shape[1] // 64) * 64
            bits = np.zeros((PROJECTIONS, RANGES + 1, width), bool)
            for i, cut in enumerate(self.cuts):
                bits[i, :, : shadow.shape[1]] = np.searchsorted(cut, shadow[i], side="right") < np.arange(RANGES + 1)[:, None]
            self.before.append(np.packbits(bits, axis=2, bitorder="little").view(np.uint64))

    def search(self, queries: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of its k nearest vectors, its own row left out, nearest first, ties by the given order; and their distances."""
        for a in range(0, len(queries), BLOCK):
            yield from self._block(queries[a : a + BLOCK], rows[a : a + BLOCK])

    def _block(self, queries: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, n, k = len(queries), len(self.ids), self.k
        near = queries.astype(np.float64) * self.scale - self.middle
        shadow, square, single = near @ self.axes, np.einsum("ij,ij->i", near, near), (-2 * near).astype(np.float32)
        # what single precision may add to a squared distance, with some to spare
        slack = 1e-7 * (near.shape[1] + 16) * (square + float(self.square.max()) + 1e-30)
        huge = ~(square < 1e30)  # beyond single precision: verified without it
        single[huge] = 0
        best = np.zeros((4, 0))  # query, distance, rank in the given order, place

        def radius() -> np.ndarray:
            full = np.full(m, np.inf)
            kth = np.flatnonzero(np.bincount(best[0].astype(np.int64), minlength=m) == k)
            last = np.searchsorted(best[0], kth, side="right") - 1
            full[kth] = best[1, last] * self.scale
            return full

        def verify(found: np.ndarray, first: int) -> None:
            nonlocal best
            q, x = np.divmod(np.flatnonzero(found), found.shape[1])
            x += first
            other = self.rows[x] != rows[q]
            q, x = q[other], x[other]
            if len(q):
                found = np.concatenate([best, np.stack([q, distances(self.vectors[x], queries[q]), self.place[x], x])], axis=1)
                found = found[:, np.lexsort((found[2], found[1], found[0]))]
                start = np.searchsorted(found[0], found[0], side="left")
                best = found[:, np.arange(found.shape[1]) - start < k]

        def product(a: int, b: int, candidates: np.ndarray | None) -> None:
            for t in range(a, b, TILE):
                e = min(b, t + TILE)
                far = single @ self.near[t:e].T
                far += self.square[t:e]
                most = radius() ** 2 * (1 + 1e-9)
                if candidates is None and e - t > k + 1:  # k others are no farther than that
                    most = np.minimum(most, np.partition(far, k, axis=1)[:, k] + square + 2 * slack)
                inside = (far <= np.minimum(most - square + slack, 3e38).astype(np.float32)[:, None]) | huge[:, None]
                if candidates is not None:
                    inside &= candidates[:, t - a : e - a]
                verify(inside, t)

        product(0, self.verified, None)
        for c, before in enumerate(self.before):
            a = self.verified + c * CHUNK
            b, reach = min(n, a + CHUNK), radius() * WIDTH
            reach = np.where(np.isfinite(reach), reach * (1 + 1e-6) + 1e-9, np.inf)
            low, high = (np.stack([np.searchsorted(cut, x, side="right") for cut, x in zip(self.cuts, (shadow + s * reach[:, None]).T, strict=True)]) for s in (-1, 1))
            candidates = np.concatenate([often((before[i][high[i, q : q + COUNTED] + 1] ^ before[i][low[i, q : q + COUNTED]] for i in range(PROJECTIONS)), threshold()) for q in range(0, m, COUNTED)])
            few = np.bitwise_count(candidates).sum() * SCATTERED <= m * (b - a)
            candidates = np.unpackbits(candidates.view(np.uint8), axis=1, bitorder="little").view(bool)[:, : b - a]
            if few:
                verify(candidates, a)
            else:
                product(a, b, candidates)
        cut = np.searchsorted(best[0], np.arange(m + 1))
        for i in range(m):
            yield best[3, cut[i] : cut[i + 1]].astype(np.int64), best[1, cut[i] : cut[i + 1]]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the k nearest vectors found for each row where is_query holds, among all other rows.

    Nearness is Euclidean distance in double precision, of vectors with the query's number of components; ties go to the smaller id,
    then the earlier row; null ids come last. Fewer than k candidates are all returned. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, as query or candidate. A row is told from its copies by its place in the scan, so
    repeated rows are one another's neighbours at distance 0. An empty table gives no rows. Other columns aren't read.

    All rows are indexed: dealt evenly, whatever they hold, into parts of PART vectors. Each part's task sorts its projections, then
    lets the queries, which are dealt to all parts, pass by in batches, searched in blocks; each part's k best meet in one ranking per
    query. A task's memory is one part's index; shuffled are the vectors once and the queries once for each part. The work is queries
    times vectors, as in high dimensions no part can be left out; recall is measured in the tests and README. vectors must be a plain
    scan.
    """
    x = F.col("v")
    good = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x != 0)")
    slim = row_ids(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), is_query.alias("asks")), "row")
    slim = slim.where(x.isNotNull() & good).withColumn("n", F.size(x))
    parts = max(1, -(-slim.count() // PART))
    data = slim.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "n", F.lit(0).alias("asks"), "row", "id", "v")
    asked = slim.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "n", F.lit(1).alias("asks"), "row", "id", "v")
    dealt = data.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "n", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            part, n, asks, row = (batch.column(c).to_numpy() for c in ("part", "n", "asks", "row"))
            ids = batch.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(n) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(part)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                block = batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, n[a])
                if at != (part[a], n[a]):
                    at, held, index = (part[a], n[a]), [], None
                if not asks[a]:
                    held.append((block, ids[a:b], row[a:b]))
                    continue
                if index is None and held:
                    index, held = SortedProjections(*(np.concatenate(c) for c in zip(*held, strict=True)), k), []
                if index is None:
                    continue
                out = [(row[a + i], batch.column("id")[a + i].as_py(), found, far) for i, (found, far) in enumerate(index.search(block, row[a:b]))]
                size = [len(f) for _, _, f, _ in out]
                places = np.concatenate([f for _, _, f, _ in out])
                yield pa.record_batch(
                    {
                        "asker": pa.array(np.repeat([r for r, _, _, _ in out], size), pa.int64()),
                        "query_id": pa.array(np.repeat([q for _, q, _, _ in out], size), pa.int64()),
                        "vec_id": pa.array(index.ids[places], pa.int64(), mask=index.ids[places] == np.iinfo(np.int64).max),
                        "row": pa.array(index.rows[places], pa.int64()),
                        "score": pa.array(np.concatenate([d for _, _, _, d in out]), pa.float64()),
                    }
                )

    found = dealt.mapInArrow(run, "asker long, query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("asker").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
