"""Exact integer k-means whose rescans are spared by Drake's adaptive bounds.

Each vector carries an upper bound of its distance to its centroid, lower bounds of those to its next few
nearest centroids, and one lower bound for all the others. A centroid's move widens the bounds. Only where they
cannot certify the order are distances computed: to the few centroids in doubt, or, where the last bound
fails, to all. Vectors are integers and distances exact, so the answer is that of plain rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import fresh_path, remove, save_at

LONG_MAX = (1 << 63) - 1
#: Largest finite float; a component beyond it counts as not finite.
FLOAT_MAX = 3.4028234663852886e38
#: Sums travel as so many limbs of so many bits, of which the last is signed.
_LIMBS, _LIMB_BITS = 8, 40
_MASK = (1 << _LIMB_BITS) - 1
#: Bounds are moved apart by this share at every step, far more than what float arithmetic can lose.
_SLACK = 1e-12
_STATE = "vector array<{kind}>, near array<int>, upper double, lows array<double>, distance long, cluster int, totals array<long>, deepest int"


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x - np.abs(x) * _SLACK, 0.0)


def largest(dims: int) -> int:
    """The size of components up to which every squared distance of ``dims`` of them fits 63 bits."""
    return math.isqrt((1 << 62) // (4 * dims))


def integers(flat: np.ndarray, scale: int, small: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit numbers where all are ``small``, else Python's."""
    scaled = np.floor(scale * flat)
    if not len(scaled) or np.abs(scaled).max() <= small:
        return scaled.astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 2.0**52 else math.floor(scale * x)
    return np.array([exact(x) for x in flat.tolist()], dtype=object)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Pass:
    """One assignment of all vectors, given the centroids and how far each has moved since the last."""

    def __init__(self, centroids: list[list[int]], moved: list[float] | None, tracked: int, scale: int, final: bool):
        self.centroids, self.moved, self.tracked, self.scale, self.final = centroids, moved, tracked, scale, final
        self.limit = largest(len(centroids[0]))
        self.small = all(abs(x) <= self.limit for c in centroids for x in c)

    def _narrowed(self, near: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of fewer tracked centroids: those given up join the last bound."""
        if near.shape[1] - 1 <= self.tracked:
            return near, lows
        rest = lows[:, self.tracked :].min(axis=1)
        return near[:, : self.tracked + 1].copy(), np.concatenate([lows[:, : self.tracked], rest[:, None]], axis=1)

    def _scan(self, v: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all centroids, nearest first, of equal ones the smaller number."""
        d = np.stack([_squares(v, c) for c in cents], axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        roots = np.sqrt(d.astype(np.float64))
        t = self.tracked
        rest = roots[:, t + 1 : t + 2] if d.shape[1] > t + 1 else np.full((len(v), 1), np.inf)
        lows = np.where(np.isinf(rest), rest, _down(rest))
        return order[:, : t + 1], _up(roots[:, 0]), np.concatenate([_down(roots[:, 1 : t + 1]), lows], axis=1), d[:, 0]

    def assign(self, v: np.ndarray, near: np.ndarray | None, upper: np.ndarray | None, lows: np.ndarray | None) -> tuple:
        """(near, upper, lows, exact squared distances or None, deepest bound that was needed)."""
        cents = np.array(self.centroids, dtype=np.int64 if v.dtype == np.int64 and self.small else object)
        if near is None:
            near, upper, lows, d = self._scan(v, cents)
            return near, upper, lows, d, 0
        moved = np.array(self.moved)
        upper = _up(upper + moved[near[:, 0]])
        drift = np.concatenate([moved[near[:, 1:]], np.full((len(near), 1), moved.max())], axis=1)
        lows = np.where(np.isinf(lows), lows, _down(_down(lows) - _up(drift)))
        near, lows = self._narrowed(near, lows)
        exact = np.zeros(len(v), dtype=cents.dtype)

        def depths(rows: np.ndarray) -> np.ndarray:
            """How many of the nearest bounds do not certify; one more than are tracked where the last does not."""
            least = np.minimum.accumulate(lows[rows][:, ::-1], axis=1)[:, ::-1]
            return (upper[rows][:, None] >= least).sum(axis=1)

        rows = np.arange(len(v)) if self.final else np.flatnonzero(depths(np.arange(len(v))) > 0)
        if len(rows):  # first the bound of the own centroid is made exact
            exact[rows] = _squares(v[rows], cents[near[rows, 0]])
            upper[rows] = _up(np.sqrt(exact[rows].astype(np.float64)))
            depth = depths(rows)
        else:
            depth = np.zeros(0, np.int64)
        for z in range(1, near.shape[1]):
            some = rows[depth == z]
            if len(some):
                own = near[some, : z + 1]
                d = np.stack([exact[some], *[_squares(v[some], cents[own[:, i]]) for i in range(1, z + 1)]], axis=1)
                by_number = np.argsort(own, axis=1, kind="stable")
                own, d = np.take_along_axis(own, by_number, axis=1), np.take_along_axis(d, by_number, axis=1)
                order = np.argsort(d, axis=1, kind="stable")
                own, d = np.take_along_axis(own, order, axis=1), np.take_along_axis(d, order, axis=1)
                near[some, : z + 1], exact[some] = own, d[:, 0]
                roots = np.sqrt(d.astype(np.float64))
                upper[some] = _up(roots[:, 0])
                lows[some, :z] = _down(roots[:, 1:])
        some = rows[depth >= near.shape[1]]
        if len(some):
            width = near.shape[1]
            order, up, low, d = self._scan(v[some], cents)
            near[some], upper[some], lows[some], exact[some] = order[:, :width], up, low, d
        return near, upper, lows, exact, int(depth.max(initial=0))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors with their new bounds, then a row of sums for each centroid that has some."""
        k, dims = len(self.centroids), len(self.centroids[0])
        sums, count, inertia, deepest, last = np.zeros((k, dims), dtype=object), [0] * k, [0] * k, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            last, n = b, b.num_rows
            v = integers(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), self.scale, self.limit).reshape(n, dims)
            state: list = [None, None, None]
            if self.moved is not None:
                flat = [b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 4)]
                state = [flat[0].reshape(n, -1).copy(), b.column(3).to_numpy(zero_copy_only=False).copy(), flat[1].reshape(n, -1).copy()]
            near, upper, lows, exact, depth = self.assign(v, *state)
            deepest = max(deepest, depth)
            for c in range(k):
                if (mine := near[:, 0] == c).any():
                    sums[c] += v[mine].sum(axis=0)
                    count[c] += int(mine.sum())
                    inertia[c] += sum(exact[mine].tolist()) if self.final else 0
            far = pa.array([min(x, LONG_MAX) for x in exact.tolist()] if self.final else [None] * n, pa.int64())
            lists = [pa.ListArray.from_arrays(np.arange(0, n * a.shape[1] + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel(), kind)) for a, kind in ((near, pa.int32()), (lows, pa.float64()))]
            none = [pa.nulls(n, kind) for kind in (pa.list_(pa.int64()), pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists[0], pa.array(upper), lists[1], far, pa.array(near[:, 0].astype(np.int32)), *none], NAMES)
        if last is not None:
            limbs = lambda x: [x >> _LIMB_BITS * i & _MASK for i in range(_LIMBS - 1)] + [x >> _LIMB_BITS * (_LIMBS - 1)]
            have = [c for c in range(k) if count[c]]
            totals = [[limb for x in (*sums[c], inertia[c]) for limb in limbs(int(x))] + [count[c]] for c in have]
            kinds = [last.column(0).type, last.column(1).type, pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(len(have), kind) for kind in kinds], pa.array(have, pa.int32()), pa.array(totals, pa.list_(pa.int64())), pa.array([deepest] * len(have), pa.int32())], NAMES
            )


NAMES = ["id", "vector", "near", "upper", "lows", "distance", "cluster", "totals", "deepest"]


def finite(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null and each within the range of a float."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= FLOAT_MAX))
    return F.coalesce((F.size(vector) == dims) & good, F.lit(False))


class Clustering:
    """Vectors in ``k`` clusters by ``rounds`` rounds of k-means over floor(scale * x).

    ``centroids`` holds the final ones as Python integers, ``inertias`` the sum of squared distances of each
    cluster, ``tracked`` how many single bounds each pass kept, ``rescans`` how deep each had to look.

    Rows whose vector has another length, or a null or non-finite component, are left out. The start is the
    ``k`` rows with the least SHA-256 of ``seed:id`` (a null id hashes as the empty string; rows of one id
    start by their components), fewer where there are fewer rows; repeated rows are rows like others; equal
    centroids and equal distances go to the smaller number; a centroid without vectors stays. Components of any
    finite size are exact; a distance or inertia beyond a long is given as the largest long. An empty table
    gives an empty result; other columns are ignored.

    Each pass reads the vectors with their bounds once and writes them once to the shared folder, after
    which the table before is deleted, so two are on disk at most and a lost executor costs its tasks
    only; sums are made in the tasks, and the driver sees some numbers a centroid and component. The
    number of single bounds starts at k / 4 and falls to what the passes need, k / 8 at least.
    """

    def __init__(self, vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: int = 3):
        self.spark, self.id_col, self.dims, self.scale, self.seed = vectors.sparkSession, id_col, dims, scale, seed
        named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        kept = named.where(finite(F.col("vector"), dims))
        self.kinds = [named.schema["id"].dataType.simpleString(), named.schema["vector"].dataType.elementType.simpleString()]
        self.centroids, self.inertias, self.tracked, self.rescans = self._start(kept, k), [], [], []
        self._table: str | None = None
        if self.centroids:
            self._cluster(kept, rounds)

    def _start(self, kept: DataFrame, k: int) -> list[list[int]]:
        key = F.sha2(F.encode(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "UTF-8"), 256)
        first = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()  # k rows
        return [[int(x) for x in integers(np.array(r["vector"], dtype=np.float64), self.scale, largest(self.dims))] for r in first]

    def _cluster(self, kept: DataFrame, rounds: int) -> None:
        k = len(self.centroids)
        tracked, moved, rows = min(max(1, k // 4), k - 1), None, kept.select("id", "vector")
        for step in range(rounds + 1):
            one = Pass(self.centroids, moved, tracked, self.scale, final=step == rounds)
            path = fresh_path(self.spark, "clustered")
            save_at(rows.mapInArrow(one.run, f"id {self.kinds[0]}, {_STATE.format(kind=self.kinds[1])}"), path)
            if self._table:
                remove(self.spark, self._table)
            self._table = path
            table = self.spark.read.schema(f"id {self.kinds[0]}, {_STATE.format(kind=self.kinds[1])}").parquet(path)
            sums, counts, self.inertias, deepest = self._totals(table)
            self.tracked.append(tracked)
            self.rescans.append(deepest)
            if step:
                tracked = min(tracked, max(deepest, -(-k // 8)))
            if step < rounds:
                new = [[x // counts[c] for x in sums[c]] if counts[c] else self.centroids[c] for c in range(k)]
                moved = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(new, self.centroids, strict=True)]
                self.centroids = new
            rows = table.where(F.col("near").isNotNull()).select(*NAMES[:5])

    def _totals(self, table: DataFrame) -> tuple[list[list[int]], list[int], list[int], int]:
        """Sums, counts and inertia of each cluster, of the rows that the tasks have left; a row each for k * dims sums."""
        parts = table.where(F.col("totals").isNotNull()).select("cluster", "deepest", F.posexplode("totals").alias("at", "x"))
        k, width = len(self.centroids), _LIMBS
        flat = [[0] * (width * (self.dims + 1) + 1) for _ in range(k)]
        deepest = 0
        for r in parts.groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.max("deepest").alias("deepest")).collect():
            flat[r["cluster"]][r["at"]] = r["x"]
            deepest = max(deepest, r["deepest"])
        whole = [[sum(x << _LIMB_BITS * i for i, x in enumerate(f[at : at + width])) for at in range(0, len(f) - 1, width)] for f in flat]
        return [w[:-1] for w in whole], [f[-1] for f in flat], [w[-1] for w in whole], deepest

    def by_cluster(self, values: list, kind: str) -> Column:
        """The value of a row's cluster, out of ``k`` values."""
        return F.array(*[F.lit(v) for v in values])[F.col("cluster")].cast(kind) if values else F.lit(None).cast(kind)

    def assigned(self) -> DataFrame:
        """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia."""
        kind = self.kinds[0]
        if not self._table:
            return self.spark.createDataFrame([], f"`{self.id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long")
        table = self.spark.read.schema(f"id {kind}, {_STATE.format(kind=self.kinds[1])}").parquet(self._table)
        capped = [min(x, LONG_MAX) for x in self.inertias]
        return table.where(F.col("near").isNotNull()).select(
            F.col("id").alias(self.id_col), "cluster", "distance",
            self.by_cluster(capped, "long").alias("cluster_inertia"), F.lit(min(sum(self.inertias), LONG_MAX)).cast("long").alias("inertia"),
        )
