"""How well one cloud of points covers another: nearest neighbours, balls, centroids, Frechet distance.

Exact neighbours need every point against every point. One cloud is cut into
blocks that are broadcast in turn (a bounded number of bytes each), the other is
scanned in Arrow batches, and each batch keeps a running result per point, so no
pair of points is ever a row. A matrix product rules out most pairs, the others'
distances are computed one by one. Results per point are joined and averaged in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.numeric import stable_hash
from chronoloom.operators.relational import prefix_sums
from chronoloom.operators.sampling import fixed_size_sample
from chronoloom.sources.readers import stored

#: Neighbours, points at most on either side, points of the quantile grid.
K, MOST_POINTS, GRID = 5, 100_000, 30
BLOCK_BYTES = 32_000_000
#: Points of a batch, and points of a block, that are compared at a time.
_STEP, TILE = 1024, 4096
#: More than underflow can hide in single precision.
TINY = 1e-30


def points(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))


def capped(df: DataFrame, n: int = MOST_POINTS, seed: int = 42) -> DataFrame:
    """At most n points, drawn by hash."""
    return fixed_size_sample(df, n, ["id"], seed)


def _blocks(spark: SparkSession, df: DataFrame, extra: Sequence[str]) -> Iterator[tuple]:
    """(ids, matrix, extra columns) of hash buckets of the points, each collected and broadcast by itself."""
    head = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n_blocks = max(1, -(-head["n"] * (head["d"] or 1) * 8 // BLOCK_BYTES))
    for b in range(n_blocks):
        rows = df.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").toArrow()
        if rows.num_rows:
            x = np.array(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(rows.num_rows, -1)
            yield spark.sparkContext.broadcast((rows.column("id").to_numpy(), x, *(rows.column(c).to_numpy() for c in extra)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences: no cancellation, so a point is exactly 0 from itself."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return np.sqrt(out)


class Block:
    """Points that others are compared with. One matrix product in single precision gives a bound below
    the squared distances; what the bound can't rule out is computed as ``distances`` does, to the same bit.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, *extra: np.ndarray):
        self.ids, self.x, self.extra = ids, x, extra
        self.columns = np.ascontiguousarray(x.T)
        # rounding of the product and of its terms, twice over, as a share of the squared norms
        self.slack = 4 * (x.shape[1] + 8) * 2.0**-24
        with np.errstate(all="ignore"):
            self.centre = x.mean(0)
            self.scale = float(np.abs(x - self.centre).max(initial=0)) or 1.0
            self.bound, self.norms = self.terms(x, -2.0, False)
        self.most = self.norms.max(initial=0)
        # where squares would be lost in double precision, too, all distances are computed
        self.plain = not (np.isfinite(self.bound).all() and 1e-130 < self.scale < 1e130)

    def terms(self, x: np.ndarray, times: float, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """What the product takes of points, and their squared norms."""
        with np.errstate(all="ignore"):
            u = (x - self.centre) / self.scale
            norms = (u * u).sum(1)
            own, one = (1 - self.slack) * norms - TINY, np.ones(len(x))
            return np.column_stack([times * u, *((one, own) if first else (own, one))]).astype(np.float32), norms

    def exact(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for a, b in zip(np.ascontiguousarray(x.T), self.columns):
            d = a[i] - b[j]
            out += d * d
        return np.sqrt(out)

    def squared(self, d: np.ndarray) -> np.ndarray:
        """Above the square of a distance, in the product's unit."""
        with np.errstate(all="ignore"):
            return ((d / self.scale) ** 2 * (1 + 1e-6) + TINY).astype(np.float32)

    def nearest(self, x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places of the k points among ``at`` (ascending) nearest to each; of equally near ones the first."""
        m = min(k, len(at))
        terms, norms = self.terms(x, 1.0, True)
        if not m or self.plain or not np.isfinite(terms).all():
            found = [self._dense(x[a : a + 64], at, m) for a in range(0, len(x), 64)]
            return np.concatenate([np.zeros((0, m)), *(f[0] for f in found)]), np.concatenate([np.zeros((0, m), np.int64), *(f[1] for f in found)])
        every = np.arange(len(x))
        best, place, lo = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64), 0
        while lo < len(at):
            cols = at[lo : lo + (TILE if lo else max(TILE // 4, m))]
            low = terms @ self.bound[cols].T
            # so many points are as near as this at the least
            most = self.squared(best[:, -1]) if lo else (np.partition(low, m - 1, 1)[:, m - 1] + 2 * self.slack * (norms + self.most) * (1 + 1e-6) + 4 * TINY).astype(np.float32)
            i, j = np.nonzero(low <= (most if lo else np.nextafter(most, np.float32(np.inf)))[:, None])
            if len(i) * 8 > low.size:
                d, j = self._dense(x, cols, m)
                i, d, j = np.repeat(every, d.shape[1]), d.ravel(), j.ravel()
            else:
                j = cols[j]
                d = self.exact(x, i, j)
            i, d, j = np.concatenate([np.repeat(every, best.shape[1]), i]), np.concatenate([best.ravel(), d]), np.concatenate([place.ravel(), j])
            order = np.lexsort((j, d, i))
            first = np.searchsorted(i[order], every)
            kept = order[first[:, None] + np.arange(m)]
            best, place, lo = d[kept], j[kept], lo + len(cols)
        return best, place

    def _dense(self, x: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, self.x[at])
        order = np.argsort(d, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(d, order, 1), at[order]

    def holding(self, x: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """How many balls around the points at ``at`` hold each point, strictly inside."""
        out, (terms, _) = np.zeros(len(x), np.int64), self.terms(x, 1.0, True)
        plain, most = self.plain or not np.isfinite(terms).all(), self.squared(radius)
        for lo in range(0, len(at), TILE):
            cols = at[lo : lo + TILE]
            i, j = (None, None) if plain else np.nonzero(terms @ self.bound[cols].T <= most[None, lo : lo + TILE])
            if plain or len(i) * 8 > len(x) * len(cols):
                out += (distances(x, self.x[cols]) < radius[None, lo : lo + TILE]).sum(1)
            else:
                out += np.bincount(i[self.exact(x, i, cols[j]) < radius[lo + j]], minlength=len(x))
        return out


def _pairs(d: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Lists of (distance, neighbour)."""
    pairs = pa.StructArray.from_arrays([pa.array(d.ravel()), pa.array(ids.ravel(), pa.int64())], names=["distance", "neighbour"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pairs)


_PAIRS = "array<struct<distance:double,neighbour:bigint>>"


def _against(df: DataFrame, other: DataFrame, schema: str, per_batch: Callable[[tuple, Block], list[pa.Array]], extra: Sequence[str] = (), own: Sequence[str] = ()) -> DataFrame:
    """Rows made of each point (id, x and its columns ``own``) and each block of ``other``, with the block's columns ``extra``."""
    spark, out = df.sparkSession, None
    names = [c.split()[0] for c in schema.split(", ")]
    for shared in _blocks(spark, other, extra):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                block = block or Block(*shared.value)
                for a in range(0, len(batch), _STEP):
                    part = batch.slice(a, _STEP)
                    point = (part.column("id").to_numpy(), _matrix(part), *(part.column(c).to_numpy(zero_copy_only=False) for c in own))
                    yield pa.RecordBatch.from_arrays(per_batch(point, block), names=names)

        # computed while the block is there, so one block at a time is
        part = stored(df.select("id", "x", *own).mapInArrow(scan, schema))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _best(name: str, k: int):
    """The k nearest of all blocks' nearest."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(name))), 1, k).alias(name)


def neighbours(df: DataFrame, other: DataFrame, k: int = K) -> DataFrame:
    """(id, rank, neighbour, distance): each point's k nearest points of ``other``, itself included if it is there."""

    def nearest(point: tuple, block: Block) -> list[pa.Array]:
        d, at = block.nearest(point[1], np.arange(len(block.x)), k)
        return [pa.array(point[0]), _pairs(d, block.ids[at])]

    best = _against(df, other, f"id long, found {_PAIRS}", nearest).groupBy("id").agg(_best("found", k))
    return best.select("id", F.posexplode("found").alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), "n.neighbour", "n.distance")


def radii(df: DataFrame, k: int = K) -> DataFrame:
    """(id, radius): distance to the k-th nearest point of the cloud, the point itself counting as the first."""
    return neighbours(df, df, k).groupBy("id").agg(F.max("distance").alias("radius"))


def in_balls(df: DataFrame, centres: DataFrame, radius: DataFrame) -> DataFrame:
    """(id, n_balls): how many balls around ``centres`` hold each point, strictly inside."""
    balls = centres.join(radius, "id")
    hits = _against(df, balls, "id long, n_balls long", lambda point, block: [pa.array(point[0]), pa.array(block.holding(point[1], np.arange(len(block.x)), block.extra[0]))], ["radius"])
    return hits.groupBy("id").agg(F.sum("n_balls").alias("n_balls"))


def prdc(real: DataFrame, synth: DataFrame, k: int = K) -> DataFrame:
    """One row: precision, recall, density, coverage."""
    r_real, r_synth = stored(radii(real, k)), stored(radii(synth, k))
    inside = in_balls(synth, real, r_real).agg(F.avg((F.col("n_balls") > 0).cast("double")).alias("precision"), (F.avg("n_balls") / k).alias("density"))
    covered = in_balls(real, synth, r_synth).agg(F.avg((F.col("n_balls") > 0).cast("double")).alias("recall"))
    near = neighbours(real, synth, 1).join(r_real, "id").agg(F.avg((F.col("distance") < F.col("radius")).cast("double")).alias("coverage"))
    return inside.crossJoin(covered).crossJoin(near).select("precision", "recall", "density", "coverage")


def authenticity(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One row: share of synthetic points farther from their nearest real point than that is from its nearest real one."""
    own = neighbours(real, real, 2).where("rank = 2").select(F.col("id").alias("neighbour"), F.col("distance").alias("own"))
    return neighbours(synth, real, 1).join(own, "neighbour").agg(F.avg((F.col("distance") > F.col("own")).cast("double")).alias("authenticity"))


def centroid(df: DataFrame) -> list[float]:
    """Mean of each dimension; one aggregation, a vector of the data's width."""
    rows = df.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).orderBy("j").collect()
    return [r["m"] for r in rows]


def _from(c: list[float]):
    return F.sqrt(F.aggregate(F.zip_with("x", F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def _score(gap: list[float]) -> float:
    """From the gaps at all levels: 1 for none."""
    return 1 - 2 * sum((a + b) / 2 / len(gap) for a, b in zip(gap, gap[1:]))


def alpha_beta(real: DataFrame, synth: DataFrame, grid: int = GRID) -> DataFrame:
    """One row: alpha-precision, beta-recall, distance of centroids."""
    c_real, c_synth = centroid(real), centroid(synth)
    levels = [(i + 1) / grid for i in range(grid)]

    def score(reference: DataFrame, other: DataFrame, c: list[float]) -> float:
        cuts = reference.agg(F.percentile(_from(c), levels).alias("q")).first()["q"]
        if cuts is None:
            return float("nan")
        d = other.withColumn("_d", _from(c))
        hat = d.agg(*[F.avg((F.col("_d") <= q).cast("double")).alias(f"h{i}") for i, q in enumerate(cuts)]).first()
        return _score([abs(t - hat[f"h{i}"]) for i, t in enumerate(levels)])

    delta = float(np.linalg.norm(np.array(c_real) - np.array(c_synth)))
    return real.sparkSession.createDataFrame([(score(real, synth, c_real), score(synth, real, c_synth), delta)], "alpha_precision double, beta_recall double, delta_centroid double")


def moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance; partitions send sums of the data's width squared."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), -1)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    parts = df.select("x").mapInArrow(add, "n long, s array<double>, q array<double>")
    sums = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "q")).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v")).orderBy("j").collect()
    total, v = (int(sums[0]["v"]) if sums else 0), np.array([r["v"] for r in sums[1:]])
    d = math.isqrt(len(v))  # d sums and d * d of products
    s, q = v[:d], v[d:]
    return s / total, (q.reshape(d, d) - np.outer(s, s) / total) / max(1, total - 1)


def _root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T


def _frechet(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    r = _root(c1)
    return float((m1 - m2) @ (m1 - m2) + np.trace(c1) + np.trace(c2) - 2 * np.trace(_root(r @ c2 @ r)))


def frechet(real: DataFrame, synth: DataFrame) -> float:
    """Distance of the two clouds' normal distributions."""
    return _frechet(*moments(real), *moments(synth))


def all_metrics(real: DataFrame, synth: DataFrame, k: int = K, seed: int = 42) -> DataFrame:
    """One row with all nine metrics, over at most MOST_POINTS points a side."""
    real, synth = capped(real, seed=seed), capped(synth, seed=seed)
    return prdc(real, synth, k).crossJoin(alpha_beta(real, synth)).crossJoin(authenticity(real, synth)).withColumn("fd", F.lit(frechet(real, synth)))


def _halved(real: DataFrame, n: int, splits: int) -> DataFrame:
    """(id, x, s0, s1, ...): each of n points' half in each split as ``random_halves`` has it, 0 beyond MOST_POINTS a side."""
    each = real.select("id", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    ranked = prefix_sums(each.withColumn("_h", stable_hash(F.col("id"), F.col("split"))), "_h", {"_rank": F.lit(1)}, ["split"])
    halves = ranked.select("id", "split", F.when(F.col("_rank") < (n + 1) // 2, 1).otherwise(2).alias("half"))
    if n - n // 2 > MOST_POINTS:
        halves = stored(halves)
        halves = reduce(DataFrame.unionByName, [capped(halves.where(f"split = {i} AND half = {h}")) for i in range(splits) for h in (1, 2)])
    sides = [F.coalesce(F.max(F.when(F.col("split") == i, F.col("half"))), F.lit(0)).alias(f"s{i}") for i in range(splits)]
    return real.join(halves.groupBy("id").agg(*sides), "id")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), -1)


def _shapes(cloud: DataFrame, splits: int, grid: int = GRID) -> list[tuple]:
    """(split, alpha-precision, beta-recall, distance of centroids, Frechet distance) of all splits, in three jobs."""
    sides = [(i, h) for i in range(splits) for h in (1, 2)]
    levels = [(i + 1) / grid for i in range(grid)]
    cols = ["x", *(f"s{i}" for i in range(splits))]

    def of_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            if len(batch):
                x, own = _matrix(batch), [batch.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(splits)]
                yield from ((i, h, y) for i, h in sides if len(y := x[own[i] == h]))

    def total(v: Callable[[int, int, np.ndarray], np.ndarray]) -> dict[tuple, np.ndarray]:
        """Sums of vectors of each half; partitions send one of each."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for i, h, y in of_halves(batches):
                sums[i, h] = sums.get((i, h), 0.0) + v(i, h, y)
            for (i, h), w in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([h], pa.int32()), pa.array([w.tolist()])], names=["split", "half", "v"])

        rows = cloud.select(*cols).mapInArrow(add, "split int, half int, v array<double>").select("split", "half", F.posexplode("v").alias("j", "v"))
        t = rows.groupBy("split", "half", "j").agg(F.sum("v").alias("v")).orderBy("split", "half", "j").toArrow()
        split, half, values = (t.column(c).to_numpy() for c in ("split", "half", "v"))
        return {(i, h): values[(split == i) & (half == h)] for i, h in sides}

    sums = total(lambda i, h, y: np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()]))
    if not all(len(w) for w in sums.values()):
        return [(i, *[float("nan")] * 4) for i in range(splits)]
    d = next(math.isqrt(len(w) - 1) for w in sums.values())  # d sums and d * d of products
    count = {k: w[0] for k, w in sums.items()}
    mean = {k: w[1 : d + 1] / w[0] for k, w in sums.items()}
    cov = {k: (w[d + 1 :].reshape(d, d) - np.outer(w[1 : d + 1], w[1 : d + 1]) / w[0]) / max(1, w[0] - 1) for k, w in sums.items()}

    def from_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, h, y in of_halves(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), i, np.int32)), pa.array(np.full(len(y), h, np.int32)), pa.array(distances(y, mean[i, h][None])[:, 0])], names=["split", "half", "d"])

    rows = cloud.select(*cols).mapInArrow(from_own, "split int, half int, d double").groupBy("split", "half").agg(F.percentile("d", levels).alias("q"))
    cuts = {(r["split"], r["half"]): np.array(r["q"]) for r in rows.collect()}
    within = total(lambda i, h, y: (distances(y, mean[i, 3 - h][None]) <= cuts[i, 3 - h][None]).sum(0).astype(float))

    def score(i: int, h: int) -> float:
        return _score([abs(t - v / count[i, 3 - h]) for t, v in zip(levels, within[i, 3 - h])])

    return [(i, float(score(i, 1)), float(score(i, 2)), float(np.linalg.norm(mean[i, 1] - mean[i, 2])), _frechet(mean[i, 1], cov[i, 1], mean[i, 2], cov[i, 2])) for i in range(splits)]


def null_baseline(real: DataFrame, splits: int = 5, k: int = K) -> DataFrame:
    """(metric, mean, std): the metrics between random halves of one cloud, ``all_metrics`` of each split.

    One scan for the neighbours, one for the balls and three for the rest serve all splits, so the
    number of jobs depends neither on that of splits nor on the passes that each would take.
    """
    spark, real = real.sparkSession, stored(real)
    sides, rows = [f"s{i}" for i in range(splits)], "id long, split int, half int"
    n = real.count()
    cloud = stored(_halved(real, n, splits))
    # every task has the points of some 200 million comparisons
    dealt = cloud.repartition(max(1, min(-(-n * n * splits // 200_000_000), -(-n // 512))), "id")

    def each(point: tuple, block: Block, make: Callable[[np.ndarray, int, np.ndarray, np.ndarray], list]) -> list[list]:
        """By columns what ``make`` says of the points of each half: their matrix, split, places of their half and of the other."""
        ids, x, own = point[0], point[1], point[2:]
        out = []
        for i in range(splits):
            at = [None, *(np.flatnonzero(block.extra[i] == h) for h in (1, 2))]
            for h in (1, 2):
                of = np.flatnonzero(own[i] == h)
                out.append([pa.array(ids[of]), pa.array(np.full(len(of), i, np.int32)), pa.array(np.full(len(of), h, np.int32)), *make(x[of], i, at[h], at[3 - h])])
        return [pa.concat_arrays(c) for c in zip(*out)]

    def nearest(point: tuple, block: Block) -> list[pa.Array]:
        def make(x: np.ndarray, i: int, same: np.ndarray, other: np.ndarray) -> list:
            pairs = [block.nearest(x, same, max(k, 2)), block.nearest(x, other, 1)]
            return [_pairs(d, block.ids[at]) for d, at in pairs]

        return each(point, block, make)

    found = _against(dealt, cloud, f"{rows}, found {_PAIRS}, near {_PAIRS}", nearest, sides, sides)
    found = found.groupBy("id", "split", "half").agg(_best("found", max(k, 2)), _best("near", 1))
    near, last = F.get("near", F.lit(0)), F.get("found", F.least(F.lit(k), F.size("found")) - 1)
    found = stored(found.select("id", "split", "half", last["distance"].alias("radius"), F.get("found", F.lit(1))["distance"].alias("own"), near["distance"].alias("distance"), near["neighbour"].alias("neighbour")))

    wide = found.groupBy("id").agg(*[F.max(F.when(F.col("split") == i, F.col("radius"))).alias(f"r{i}") for i in range(splits)])

    def holding(point: tuple, block: Block) -> list[pa.Array]:
        return each(point, block, lambda x, i, same, other: [pa.array(block.holding(x, other, block.extra[splits + i][other]))])

    balls = _against(dealt, stored(cloud.join(wide, "id")), f"{rows}, n_balls long", holding, [*sides, *(f"r{i}" for i in range(splits))], sides)
    balls = balls.groupBy("id", "split", "half").agg(F.sum("n_balls").alias("n"))

    of = lambda half, c: F.avg(F.when(F.col("half") == half, c))
    out = balls.groupBy("split").agg(of(2, (F.col("n") > 0).cast("double")).alias("precision"), of(1, (F.col("n") > 0).cast("double")).alias("recall"), (of(2, F.col("n")) / k).alias("density"))
    out = out.join(found.groupBy("split").agg(of(1, (F.col("distance") < F.col("radius")).cast("double")).alias("coverage")), "split")
    own = found.where("half = 1").select("split", F.col("id").alias("neighbour"), F.col("own").alias("theirs"))
    out = out.join(found.where("half = 2").join(own, ["split", "neighbour"]).groupBy("split").agg(F.avg((F.col("distance") > F.col("theirs")).cast("double")).alias("authenticity")), "split")
    out = out.join(spark.createDataFrame(_shapes(cloud, splits), "split int, alpha_precision double, beta_recall double, delta_centroid double, fd double"), "split").drop("split")
    return out.unpivot([], out.columns, "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def coverage_method(univariate_series, least: int = 500):
    """Which comparison a number of series allows."""
    return F.when(univariate_series >= least, F.lit("PRDC")).otherwise(F.lit("centroid"))


