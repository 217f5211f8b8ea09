"""Near-duplicate vectors by lattice hashing.

In each of several tables, random projections take a unit vector to eight coordinates (one block) or
more, each block is decoded to the nearest point of the E8 lattice, and the vector is filed under the points found
and under the neighbouring points nearest to it. Vectors with a point in common are compared by
cosine in double precision; a pair is counted in the first of its common cells only, so that pairs are
never written out. A cell's vectors are split in chunks, and pairs of chunks are compared as tasks of
their own, so that a cell that holds a third of all vectors is no single task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import checkpointed, table
from comptoir.llm.simhash import merge
from comptoir.operators.components import connected_components

#: Tables, blocks of eight coordinates in each, cells probed for each block, edge of the lattice as a share of a unit vector's mean coordinate, vectors in a chunk.
TABLES, BLOCKS, PROBES, SCALE, CHUNK, SEED = 5, 3, 2, 1.3, 4096, 11
#: What names a task; runs up to this size are compared by offsets; pairs compared at once.
TASK, SMALL, STEP = ["dim", "label", "cell", "i", "j"], 48, 1 << 14


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of D8 (integer coordinates of even sum) to the rows of x, doubled, and the second nearest found by one flip."""
    near = np.rint(x)
    off = x - near
    step = np.where(off >= 0, 1.0, -1.0)
    cost = 1 - 2 * np.abs(off)  # of rounding a coordinate the other way
    order = np.argsort(cost, axis=1)
    rows = np.arange(len(x))
    flipped = near.copy()
    flipped[rows, order[:, 0]] += step[rows, order[:, 0]]
    even = near.sum(axis=1) % 2 == 0
    best = np.where(even[:, None], near, flipped)
    # the next best: two flips from an even rounding, another single flip from an odd one
    other = near.copy()
    other[rows, order[:, 1]] += step[rows, order[:, 1]]
    both = flipped.copy()
    both[rows, order[:, 1]] += step[rows, order[:, 1]]
    return best, np.where(even[:, None], both, other)


def e8_points(x: np.ndarray, probes: int) -> np.ndarray:
    """(n, probes, 8) doubled coordinates of lattice points near each row, nearest first: of D8 and D8 + 1/2, the two nearest of each."""
    whole, half = _d8(x), _d8(x - 0.5)
    points = np.stack([whole[0], half[0] + 0.5, whole[1], half[1] + 0.5], axis=1)
    order = np.argsort(((points - x[:, None, :]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :probes]
    return np.rint(2 * np.take_along_axis(points, order[:, :, None], axis=1)).astype(np.int64)


def _mix(cells: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of the last axis."""
    h = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(units: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """(n, tables, probes ** blocks) cell keys of unit vectors, the vector's own first."""
    n, dim = units.shape
    draw = np.random.default_rng(seed)
    turns, moves, out = [], [], []
    for _ in range(tables * blocks):
        turns.append(np.linalg.qr(draw.standard_normal((max(dim, 8), 8)))[0][:dim])
        moves.append(draw.random(8))
    turn, placed = np.concatenate(turns, axis=1), np.zeros((n, 8 * tables * blocks))
    for i in range(dim):  # element by element, so that a vector's cells never depend on the rows beside it
        placed += units[:, i : i + 1] * turn[i]
    placed = placed * np.sqrt(dim) / (scale * 2) + np.concatenate(moves)
    for t in range(tables):
        key = None
        for b in range(blocks):
            at = 8 * (t * blocks + b)
            points = _mix(e8_points(placed[:, at : at + 8], probes), t * 64 + b)
            key = points if key is None else _mix(np.stack(np.broadcast_arrays(key[:, :, None], points[:, None, :]), axis=-1), t).reshape(n, -1)
        out.append(key)
    return np.stack(out, axis=1)


def units_of(vectors: pd.Series) -> np.ndarray:
    """Rows of length one in double precision; every vector has the same number of finite components, not all zero."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    squares = np.zeros(len(x))
    for i in range(x.shape[1]):  # in one order for every row
        squares += x[:, i] * x[:, i]
    return x / np.sqrt(squares)[:, None]


def _pairs(units: np.ndarray, runs: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same run at this cosine or more; a run's rows stand together."""
    begin = np.concatenate(([0], np.flatnonzero(np.diff(runs)) + 1))
    size = np.diff(begin, append=len(runs))
    xs, ys = [], []
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, int(size.max()))):
        x = np.flatnonzero((runs[d:] == runs[:-d]) & small[d:])
        if not len(x):
            break
        near = np.concatenate([np.einsum("ij,ij->i", units[x[k : k + STEP]], units[x[k : k + STEP] + d]) >= cosine for k in range(0, len(x), STEP)])
        xs.append(x[near])
        ys.append(x[near] + d)
    for i in np.flatnonzero(size > SMALL):
        own = units[begin[i] : begin[i] + size[i]]
        for k in range(0, len(own), 256):
            x, y = np.nonzero(own[k : k + 256] @ own.T >= cosine - 1e-9)
            ahead = x + k < y
            x, y = x[ahead] + k + begin[i], y[ahead] + begin[i]
            exact = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
            xs.append(x[exact])
            ys.append(y[exact])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def compared(pdf: pd.DataFrame, cosine: float, shape: dict) -> pd.DataFrame:
    """Links within the runs of equal TASK of rows of one dimension: (node, others, a); a pair counts in the first of its common cells, by table and then by key."""
    units, cell, part = units_of(pdf["v"]), pdf["cell"].to_numpy(), pdf["part"].to_numpy()
    fresh = (pdf[TASK].to_numpy()[1:] != pdf[TASK].to_numpy()[:-1]).any(axis=1)
    x, y = _pairs(units, np.concatenate(([0], np.cumsum(fresh))), cosine)
    apart = (part[x] != part[y]) | (pdf["i"].to_numpy() == pdf["j"].to_numpy())[x]
    x, y = x[apart], y[apart]
    node, index = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    labels, others = np.arange(len(node)), np.zeros(len(node), np.int64)
    weight = np.zeros(len(node), np.int64)
    weight[index] = pdf["weight"].to_numpy()
    if len(x):
        used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        keys = np.concatenate([cells(units[used[k : k + 4096]], **shape) for k in range(0, len(used), 4096)])
        none = np.iinfo(np.int64).max
        for k in range(0, len(x), STEP):
            a, b = keys[at[: len(x)][k : k + STEP]][:, :, :, None], keys[at[len(x) :][k : k + STEP]][:, :, None, :]
            common = np.where(a == b, a, none).min(axis=(2, 3))
            first = np.take_along_axis(common, np.argmax(common != none, axis=1)[:, None], axis=1)[:, 0]
            mine = first == cell[x[k : k + STEP]]
            a, b = index[x[k : k + STEP][mine]], index[y[k : k + STEP][mine]]
            np.add.at(others, a, weight[b])
            np.add.at(others, b, weight[a])
            merge(labels, a, b)
    spans, seen = np.flatnonzero(labels != np.arange(len(node))), np.flatnonzero(others)
    return pd.DataFrame({"node": np.concatenate([node[seen], node[spans]]), "others": np.concatenate([others[seen], np.zeros(len(spans), np.int64)]), "a": np.concatenate([node[seen], node[labels[spans]]])})


def lattice_links(vectors: DataFrame, cosine: float = 0.93, chunk: int = CHUNK, **shape) -> tuple[DataFrame, DataFrame]:
    """(degrees, links) of distinct vectors (node long, label long, weight long, v: array of finite numbers, not all zero).

    degrees: rows (node, others), the weights of the vectors linked directly, in parts to be summed by node;
    links: rows (a, b) that span each batch's linked sets.
    """

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["v"].map(len)):
                keys = np.concatenate([cells(units_of(same["v"].iloc[k : k + 4096]), **shape) for k in range(0, len(same), 4096)])
                keys = keys.reshape(len(same), -1)
                yield pd.DataFrame({"node": np.repeat(same["node"].to_numpy(), keys.shape[1]), "label": np.repeat(same["label"].to_numpy(), keys.shape[1]), "dim": dim, "cell": keys.ravel()})

    filed = checkpointed(vectors.select("node", "label", "v").mapInPandas(file, "node long, label long, dim int, cell long"))
    sizes = filed.groupBy("label", "dim", "cell").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / chunk).cast("int")).drop("count")
    member = filed.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # a chunk meets itself and every other chunk of its cell: it goes to all tasks (i, j) of its own number
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    member = member.withColumn("task", F.explode(tasks)).select("node", "dim", "label", "cell", "part", F.col("task.i").alias("i"), F.col("task.j").alias("j"))
    rows = member.join(vectors.select("node", "weight", "v"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the rows of the last task seen, which may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[TASK] == pdf[TASK].iloc[-1]).all(axis=1)
            whole, held = pdf[~last], pdf[last]
            for _, same in whole.groupby("dim", sort=False):
                yield compared(same.reset_index(drop=True), cosine, shape)
        if held is not None:
            yield compared(held.reset_index(drop=True), cosine, shape)

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = checkpointed(rows.repartition(parts, *TASK).sortWithinPartitions(*TASK).mapInPandas(compare, "node long, others long, a long"))
    return met.groupBy("node").agg(F.sum("others").alias("others")), met.where("a != node").select("a", F.col("node").alias("b"))


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, chunk: int = CHUNK, **shape) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `rows`.

    Vectors link at this cosine or more if their labels are equal and not null; a null, empty or zero vector,
    or one with a null or non-finite component, or of another length, links with nothing. Labels may be of any type. Equal vectors are one node with a weight; repeated
    rows count as vectors of their own. Rows with a null vec_id count as linked vectors but give no component its id. Other columns are dropped.
    """
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(fine, F.xxhash64("label", "v")))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node", "label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    nodes = checkpointed(nodes)
    degrees, links = lattice_links(nodes.select("node", "label", "weight", "v"), cosine, chunk, **shape)
    members = connected_components(links)
    lowest = members.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("lowest"))
    lowest = members.join(lowest, "component").select("node", "lowest")
    told = nodes.select("node", "first", "weight").join(degrees, "node", "left").join(lowest, "node", "left")
    told = told.select("node", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "first").alias("component_id"))
    out = rows.where(F.col("node").isNotNull()).select("vec_id", "node").join(told, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_lattice(spark, sf_dir: str) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of embeddings, as near_vectors states."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
