"""Centroid clustering of vectors by Exponion search, in whole numbers.

Every vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of that
to any other. A round moves the bounds by how far the centroids went; a vector whose bounds then overlap
scans only the centroids inside a ball around its own one, found in that centroid's sorted list of
distances to the others. Bounds are doubles, widened a little; what they leave open is decided by exact
squared distances in whole numbers, and the ball includes its surface, so that ties go to the smaller number.

A round is one pass over the vectors, which stay in the tasks that read them and are written with their
bounds for the next round; what is shuffled is a sum for each task, cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import table, written

#: Centroids, rounds, components, steps of a unit, what is hashed before an id to choose the starts.
CENTROIDS, ROUNDS, PARTS, STEPS, SALT = 16, 3, 64, 64, "1:"
#: Bounds are widened by this share.
SLACK = 1e-9
MOST = (1 << 63) - 1


def _bound(parts: int, bits: int) -> int:
    """The largest power of two b such that `parts` squares of 2b sum to at most 2^bits."""
    return 1 << ((bits - (parts - 1).bit_length()) // 2 - 1)


def whole_numbers(embedding: Column, parts: int = PARTS, steps: int = STEPS) -> Column:
    """The components as whole numbers floor(steps * x); null unless there are just `parts` of them, none null or non-finite.

    Numbers too far from 0 for squared distances in a long (2^27 with 64 components) are taken as that bound.
    """
    fine = (F.size(embedding) == parts) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = F.lit(float(_bound(parts, 62)))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(F.greatest(-far, F.least(far, x.cast("double") * steps))).cast("int")))


class Rings:
    """Centroids with, for each, the others in order of their distance from it."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.own, k = centroids, len(centroids)
        gap = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(np.float64))
        np.fill_diagonal(gap, -1.0)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gap, self.order, axis=1)
        self.nearest = self.gaps[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64))
        # for each centroid, how far the one of the others that went farthest went
        self.others = np.array([np.delete(self.moved, i).max(initial=0.0) for i in range(k)])

    def squared(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows of x, centroids among); products of doubles are exact for small numbers."""
        c, small = self.own[among], _bound(x.shape[1], 52)
        if np.abs(x).max(initial=0) <= small and np.abs(c).max(initial=0) <= small:
            p, q = x.astype(np.float64), c.astype(np.float64)
            return np.rint((p * p).sum(axis=1)[:, None] - 2 * (p @ q.T) + (q * q).sum(axis=1)).astype(np.int64)
        return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)

    def to_own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.own[cluster]) ** 2).sum(axis=1)


def assign(x: np.ndarray, cluster: np.ndarray, up: np.ndarray, low: np.ndarray, rings: Rings) -> int:
    """Moves cluster, up and low, in place, to the nearest of rings (the smallest number of equally near ones); how many distances were taken."""
    up += rings.moved[cluster]
    low -= rings.others[cluster]
    wide, taken = 1 + SLACK, 0
    open_ = np.flatnonzero(up * wide + SLACK >= np.maximum(low, rings.nearest[cluster] / 2))
    if not len(open_):
        return 0
    up[open_] = np.sqrt(rings.to_own(x[open_], cluster[open_]).astype(np.float64))
    taken += len(open_)
    open_ = open_[up[open_] * wide + SLACK >= np.maximum(low[open_], rings.nearest[cluster[open_]] / 2)]
    radius = (2 * up[open_] + rings.nearest[cluster[open_]]) * wide + SLACK
    was = cluster[open_].copy()
    for c in np.unique(was):
        here = np.flatnonzero(was == c)
        inside = np.searchsorted(rings.gaps[c], radius[here], side="right")
        for n in np.unique(inside):
            rows = open_[here[inside == n]]
            among = np.sort(np.append(rings.order[c, :n], c))
            d = rings.squared(x[rows], among)
            taken += d.size
            best = np.argmin(d, axis=1)  # the first of equal ones
            at = np.arange(len(rows))
            cluster[rows], up[rows] = among[best], np.sqrt(d[at, best].astype(np.float64))
            d[at, best] = MOST
            low[rows] = np.sqrt(d.min(axis=1).astype(np.float64)) if n else np.inf
    return taken


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


@dataclass
class Clustering:
    """labels: rows (id, cluster, distance); centroids: the last ones; inertia: the distances summed by cluster, as Python integers."""

    labels: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]


def starts(kept: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The vectors of rows (id, v) with the k smallest SHA-256 of salt and id, in that order (equal ones by vector); ids that are null are passed over."""
    said = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = kept.select(said.alias("said"), "v").where("said IS NOT NULL").orderBy("said", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _step(state: DataFrame, rings: Rings, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = _numbers(batch), batch.column("cluster").to_numpy().copy()
            up, low = batch.column("up").to_numpy().copy(), batch.column("low").to_numpy().copy()
            assign(x, cluster, up, low, rings)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(rings.to_own(x, cluster))], ["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cluster), pa.array(up), pa.array(low)], ["id", "v", "cluster", "up", "low"])

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(run, f"id {kind}, cluster int, distance long" if last else f"id {kind}, v array<int>, cluster int, up double, low double")


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floors of the clusters' exact means; a cluster without vectors keeps its centroid. k * parts numbers reach the driver."""
    k, parts = before.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, parts), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, cluster = _numbers(batch), batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                here = cluster == c
                sums[c] += x[here].sum(axis=0)
                n[c] += int(here.sum())
        has = np.repeat(n > 0, parts)
        columns = [np.repeat(np.arange(k, dtype=np.int32), parts), np.tile(np.arange(parts, dtype=np.int32), k), sums.ravel(), np.repeat(n, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(c[has]) for c in columns], ["cluster", "part", "total", "n"])

    sums = state.select("cluster", "v").mapInArrow(run, "cluster int, part int, total long, n long")
    after = before.copy()
    for r in sums.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        after[r["cluster"], r["part"]] = int(r["total"]) // r["n"]
    return after


def clustered(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, parts: int = PARTS, steps: int = STEPS, salt: str = SALT) -> Clustering:
    """Clusters of the rows whose embedding has `parts` components, none null or non-finite; the others are left out.

    Each round assigns all vectors and moves the centroids; a last assignment follows. Repeated rows count each. A null
    vec_id is clustered but starts no centroid; fewer than k ids give as many centroids, and without any
    (or with an empty table) there are no labels. Of other columns nothing is read.
    """
    kept = rows.select(F.col(vec_id).alias("id"), whole_numbers(F.col(embedding), parts, steps).alias("v")).where("v IS NOT NULL")
    centroids = starts(kept, k, salt)
    state = kept.withColumns({"cluster": F.lit(0), "up": F.lit(float("inf")), "low": F.lit(0.0)})
    if not len(centroids):
        return Clustering(state.where("false").select("id", "cluster", F.lit(0).cast("long").alias("distance")), centroids, {})
    before = None
    for _ in range(rounds):
        state = written(_step(state, Rings(centroids, before), last=False), "centroids")
        before, centroids = centroids, _means(state, centroids)
    labels = written(_step(state, Rings(centroids, before), last=True), "clusters")
    sums = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    return Clustering(labels, centroids, {r["cluster"]: int(r["inertia"]) for r in sums})


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector that clustered keeps; sums beyond a long are its largest."""
    got = clustered(table(spark, sf_dir, "embeddings"))
    k = range(len(got.centroids))
    own = F.array(*[F.lit(min(MOST, got.inertia.get(c, 0))).cast("long") for c in k]) if k else F.array().cast("array<long>")
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in got.centroids.tolist()]
    said = F.array(*map(F.lit, said)) if k else F.array().cast("array<string>")
    return got.labels.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(MOST, sum(got.inertia.values()))).cast("long").alias("inertia"), F.get(said, F.col("cluster")).alias("centroid_sha256"),
    )


def _sql() -> str:
    near = f"SELECT r, vec_id, any_value(e) AS e, CAST(min(d * {CENTROIDS} + c) % {CENTROIDS} AS INTEGER) AS cluster, min(d) AS distance FROM (SELECT v.r, v.vec_id, v.e, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{{i}} c) x GROUP BY r, vec_id"
    mean = "SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT cluster, list(t ORDER BY p) AS e FROM (SELECT cluster, p, CAST(floor(CAST(sum(t) AS DOUBLE) / count(*)) AS BIGINT) AS t FROM (SELECT cluster, unnest(e) AS t, unnest(range(len(e))) AS p FROM a{i}) y GROUP BY cluster, p) z GROUP BY cluster) m ON m.cluster = c.c"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({STEPS} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {PARTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {PARTS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256(concat('{SALT}', CAST(vec_id AS VARCHAR))) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {CENTROIDS}) t)",
    ]
    for i in range(ROUNDS):
        ctes += [f"a{i} AS MATERIALIZED ({near.format(i=i)})", f"c{i + 1} AS MATERIALIZED ({mean.format(i=i)})"]
    ctes.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(i=ROUNDS)})")
    return f"""WITH {", ".join(ctes)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.cluster"""


OP12_SQL = _sql()
