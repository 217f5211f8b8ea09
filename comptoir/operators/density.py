"""Density clusters and k-th neighbours over three columns without lists of pairs.

Equal rows are one place with a weight. DBSCAN deals places into cells so small that all of a cell lie within
epsilon of one another: a cell of enough weight is core as a whole, and only places of thin cells, of
which a cell holds fewer than the minimum, look at the cells around. Cells with core places are nodes; two
of them are linked by their bounding boxes (surely near, or surely apart), and what boxes leave open is
decided by places where these are few, and by the boxes of smaller cells where they are many. So a node has
some neighbouring cells and nothing grows with the square of what lies in a cell.

Cells are dealt out in blocks that hold a bounded number of places, each with the cells around it, so that a row is
sent about once and a block says which of its cells are linked through one another (blocks.py). A radius at which even
small blocks would hold more is crowded, and its cells meet by joins instead.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.functions.stats import running
from comptoir.operators import blocks
from comptoir.operators.components import connected_components
from comptoir.session import cut

AXES = ["z_r", "z_f", "z_m"]
CELL = ["c0", "c1", "c2"]
#: Pairs of places that two boxes may hold to be compared one by one; halvings of a cell's side, and those of one step; sizes of cells among which a k-th neighbour's search chooses.
PAIRS, DEEPEST, DEEPER, SIZES = 1024, 24, 2, 24
#: Places of a block of cells at most, without those around it; halvings of its coordinates from a cell's, least and most.
BLOCK, SMALLEST, LARGEST = 1 << 17, 3, 18


def _steps(reach: int, half: bool = False) -> Column:
    """The offsets of cells up to `reach` away; half: one of each two opposite ones, and no offset."""
    all_ = [s for s in product(range(-reach, reach + 1), repeat=3) if not half or s > (0, 0, 0)]
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(CELL, s, strict=True)]) for s in all_])


def _cells(side: Column, names: list[str] = CELL) -> list[Column]:
    return [F.floor(F.col(a) / side).cast("long").alias(c) for a, c in zip(AXES, names, strict=True)]


def _distance(gaps: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))


def _around(rows: DataFrame, reach: int = 1, half: bool = False) -> DataFrame:
    """rows once for every cell around theirs, in CELL."""
    others = [c for c in rows.columns if c not in CELL]
    return rows.withColumn("_s", F.explode(_steps(reach, half))).select(*others, *[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in CELL])


def _met(seekers: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of a seeker (i, radius, seeker, AXES) with each place (i, place, weight, AXES) at most its radius away, and the gap; a seeker meets the places of 27 cells of that side."""
    tries = seekers.select("i", "radius").distinct()  # a row for each candidate
    home = places.join(F.broadcast(tries), "i").select("i", "place", "weight", *[F.col(a).alias(f"o_{a}") for a in AXES], *_cells(F.col("radius")))
    met = _around(seekers.select("i", "radius", "seeker", *AXES, *_cells(F.col("radius")))).join(home, ["i", *CELL])
    return met.withColumn("gap", _distance([F.col(a) - F.col(f"o_{a}") for a in AXES])).where(F.col("gap") <= F.col("radius")).select("i", "seeker", "place", "weight", "gap")


def places_of(rows: DataFrame, key: str) -> DataFrame:
    """Rows (place, weight, AXES): each point once, named by its smallest key."""
    return rows.groupBy(*AXES).agg(F.count("*").alias("weight"), F.min(key).alias("place"))


def least_neighbours(n: int, least: int = S.DBSCAN_MIN) -> int:
    """Neighbours that make a core point among n points: `least`, fewer for a handful of points."""
    return min(least, max(2, n - 1))


# --- DBSCAN ---

_BOX = [f"{end}_{a}" for a in AXES for end in ("low", "high")]


def _box() -> list[Column]:
    return [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]


def _box_gaps(a: str, b: str) -> tuple[Column, Column]:
    """The smallest and the greatest distance of two boxes' points. Rounding is monotonous, so no distance of two points as computed lies outside."""
    low = [F.greatest(F.lit(0.0), F.col(f"{a}.low_{x}") - F.col(f"{b}.high_{x}"), F.col(f"{b}.low_{x}") - F.col(f"{a}.high_{x}")) for x in AXES]
    high = [F.greatest(F.col(f"{a}.high_{x}") - F.col(f"{b}.low_{x}"), F.col(f"{b}.high_{x}") - F.col(f"{a}.low_{x}")) for x in AXES]
    return _distance(low), _distance(high)


def _boxes(core: DataFrame, level: int, *more: str) -> DataFrame:
    """Rows (i, e, cell, box, places, bounds) of core places; a box is its cell halved `level` times, named by its smallest place."""
    deep = [F.shiftright(c.replace("c", "f"), DEEPEST - level).alias(c.replace("c", "b")) for c in CELL]
    rows = core.select("i", "e", "cell", "place", *AXES, *deep, *more)
    return rows.groupBy("i", "e", "cell", *[c.replace("c", "b") for c in CELL], *more).agg(F.min("place").alias("box"), F.count("*").alias("places"), *_box()).drop("b0", "b1", "b2")


def _judged(pairs: DataFrame) -> DataFrame:
    """pairs (a and b: boxes) less those surely apart, with sure: they are near."""
    least, most = _box_gaps("a", "b")
    return pairs.withColumns({"_least": least, "_most": most}).where(F.col("_least") <= F.col("a.e")).select("a", "b", (F.col("_most") <= F.col("a.e")).alias("sure"))


def cell_links(core: DataFrame, pairs: int = PAIRS, shifts: dict[int, int] | None = None) -> DataFrame:
    """Links (i, a, b, only) of cells with core places within epsilon of one another, a and b being the cells' smallest core places.

    core: (i, e, place, AXES, c0..c2, cell). `pairs`: two boxes with as many pairs of places or fewer are compared place
    by place. shifts: how often the coordinates of each candidate's blocks are halved; none for a crowded one, or for all.
    In blocks a cell is linked with the smallest it can reach there, be it by several steps; only: a has no other link, since no other block knows it.
    """
    dealt, crowded = _ways(shifts or {}, core)
    made = ([] if dealt is None else [_links_in_blocks(dealt, shifts)]) + ([] if crowded is None else [_links_by_joins(crowded, pairs).withColumn("only", F.lit(False))])
    return reduce(DataFrame.unionByName, made)


def _ways(shifts: dict[int, int], rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """rows of the candidates that are dealt out in blocks, and of the crowded ones; None if there is no such candidate."""
    dealt = [i for i, s in shifts.items() if s is not None]
    here = F.col("i").isin(dealt)
    return (rows.where(here) if dealt else None), (rows.where(~here) if len(dealt) < max(1, len(shifts)) else None)


def _links_by_joins(core: DataFrame, pairs: int) -> DataFrame:
    """As cell_links, without only."""
    core = core.select("*", *[F.floor(F.col(a) / _side() * 2**DEEPEST).cast("long").alias(f"f{k}") for k, a in enumerate(AXES)])  # the cell halved DEEPEST times
    boxes = cut(_boxes(core, 0, *CELL))
    # cells up to two apart lie in the same or neighbouring blocks of two
    whole = F.struct("i", "e", "cell", "box", "places", *_BOX).alias("x")
    block = [F.shiftright(c, 1).alias(c) for c in CELL]
    at = boxes.select("i", whole, F.struct(*CELL).alias("own"), *block)
    ahead = _around(at, half=True).unionByName(at.select("i", "x", "own", *CELL).where("true"))
    met = ahead.alias("p").join(at.alias("q"), ["i", *CELL]).where((F.col("p.x.box") != F.col("q.x.box")) & reduce(lambda x, y: x & y, [F.abs(F.col(f"p.own.{c}") - F.col(f"q.own.{c}")) <= 2 for c in CELL]))
    # in the same block either order is met, so one is left out
    same = reduce(lambda x, y: x & y, [F.shiftright(f"p.own.{c}", 1) == F.shiftright(f"q.own.{c}", 1) for c in CELL])
    open_ = _judged(met.where(~same | (F.col("p.x.box") < F.col("q.x.box"))).select(F.col("p.x").alias("a"), F.col("q.x").alias("b")))
    open_ = cut(open_)
    found, level, name = [], 0, ["i", "ca", "cb"]
    while True:
        said = [F.col("a.i").alias("i"), F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb")]
        found.append(open_.where("sure").select(*said).distinct())
        left = open_.where("NOT sure").select("a", "b", *said).join(found[-1], name, "left_anti")
        few = (F.col("a.places") * F.col("b.places") <= pairs) | F.lit(level + DEEPER > DEEPEST)
        found.append(_by_places(left.where(few).select("a", "b", *said), core, level))
        left = cut(left.where(~few).select("a", "b", *said).join(found[-1], name, "left_anti").select("a", "b"))
        if left.isEmpty():
            break
        kids = _boxes(_inside(left, core, level), level + DEEPER, "parent").select("parent", F.struct("i", "e", "cell", "box", "places", *_BOX).alias("x"))
        kids = cut(kids)
        split = left.select(F.col("a.i").alias("i"), F.col("a.box").alias("ka"), F.col("b.box").alias("kb"))
        split = split.join(kids.select(F.col("x.i").alias("i"), F.col("parent").alias("ka"), F.col("x").alias("a")), ["i", "ka"]).join(kids.select(F.col("x.i").alias("i"), F.col("parent").alias("kb"), F.col("x").alias("b")), ["i", "kb"])
        open_, level = cut(_judged(split.select("a", "b"))), level + DEEPER
    return reduce(DataFrame.unionByName, found).distinct().select("i", F.col("ca").alias("a"), F.col("cb").alias("b"))


def _inside(pairs: DataFrame, core: DataFrame, level: int) -> DataFrame:
    """The core places of the boxes of pairs, with their box as parent."""
    deep = [F.shiftright(c.replace("c", "f"), DEEPEST - level).alias(c.replace("c", "d")) for c in CELL]
    at = core.select("*", *deep)
    names = at.groupBy("i", "d0", "d1", "d2", "cell").agg(F.min("place").alias("parent"))
    wanted = pairs.select(F.col("a.i").alias("i"), F.col("a.box").alias("parent")).unionByName(pairs.select(F.col("b.i").alias("i"), F.col("b.box").alias("parent"))).distinct()
    return at.join(names.join(wanted, ["i", "parent"], "left_semi"), ["i", "d0", "d1", "d2", "cell"])


def _by_places(pairs: DataFrame, core: DataFrame, level: int) -> DataFrame:
    """Rows (i, ca, cb) of the cells of those pairs of boxes that hold two places within epsilon."""
    pairs = cut(pairs)
    inside = cut(_inside(pairs, core, level).select("i", "parent", "e", *AXES))
    a = inside.select("i", "e", F.col("parent").alias("ka"), *[F.col(x).alias(f"a_{x}") for x in AXES])
    b = inside.select("i", F.col("parent").alias("kb"), *[F.col(x).alias(f"b_{x}") for x in AXES])
    met = pairs.select("i", "ca", "cb", F.col("a.box").alias("ka"), F.col("b.box").alias("kb")).join(a, ["i", "ka"]).join(b, ["i", "kb"])
    return met.where(_distance([F.col(f"a_{x}") - F.col(f"b_{x}") for x in AXES]) <= F.col("e")).select("i", "ca", "cb").distinct()


def _side() -> Column:
    return F.col("e") / 3**0.5 * (1 - 1e-9)  # a cell's corners lie just within epsilon


def _halved(c: Column | str, times: Column) -> Column:
    return F.call_function("shiftright", F.col(c) if isinstance(c, str) else c, times)


def _shifts(cells: DataFrame, n: int) -> dict[int, int | None]:
    """For each of n candidates how often the coordinates of its cells (i, c0..c2, n) are halved for the largest blocks of BLOCK places at most; None if SMALLEST is too often."""
    small = cut(cells.groupBy("i", *[_halved(c, F.lit(SMALLEST)).alias(c) for c in CELL]).agg(F.sum("n").alias("n")))
    times = F.explode(F.sequence(F.lit(0), F.lit(LARGEST - SMALLEST))).alias("s")
    each = small.select("i", "n", *CELL, times).groupBy("i", "s", *[_halved(c, F.col("s")).alias(c) for c in CELL]).agg(F.sum("n").alias("n"))
    fit = {r["i"]: r["s"] for r in each.groupBy("i", "s").agg(F.max("n").alias("n")).where(F.col("n") <= BLOCK).groupBy("i").agg(F.max("s").alias("s")).collect()}  # a row for each candidate
    return {i: SMALLEST + fit[i] if i in fit else None for i in range(n)}


def _in_blocks(rows: DataFrame, shifts: dict[int, int | None]):
    """rows (i, c0..c2) grouped by block, each in its own block (own) and in those that its cell is in reach of (alone: there are none)."""
    times = F.element_at(F.array(*[F.lit(s or 0) for s in shifts.values()]), F.col("i") + 1)
    ends = {c: [_halved(F.col(c) + d, times) for d in (-blocks.REACH, blocks.REACH)] for c in CELL}
    both = lambda tests: reduce(lambda x, y: x & y, tests)
    rows = rows.withColumn("alone", both(low == high for low, high in ends.values()))
    for c in CELL:
        rows = rows.withColumn(c.replace("c", "b"), F.explode(F.array_distinct(F.array(*ends[c]))))
    return rows.withColumn("own", both(_halved(c, times) == F.col(c.replace("c", "b")) for c in CELL)).groupBy("i", *[c.replace("c", "b") for c in CELL])


def _told_in_blocks(at: DataFrame, shifts: dict[int, int | None], least: int) -> DataFrame:
    """Rows (i, e, place, AXES, core, other) of core places (other: the place), and of those that are not for each place within epsilon of them (other)."""
    kind, columns = at.schema["place"].dataType.simpleString(), ["i", "e", "place", *AXES]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        core, a, b = blocks.cores(pdf[AXES].to_numpy(float), pdf[CELL].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64), pdf["own"].to_numpy(bool), float(pdf["e"].iloc[0]), least)
        c = np.flatnonzero(core & pdf["own"].to_numpy(bool))
        return pdf[columns].iloc[np.concatenate([c, a])].assign(core=np.arange(len(c) + len(a)) < len(c), other=pdf["place"].to_numpy()[np.concatenate([c, b])])

    made = ", ".join(["i int", "e double", f"place {kind}", *[f"{c} double" for c in AXES], "core boolean", f"other {kind}"])
    return _in_blocks(at, shifts).applyInPandas(run, made)


def _links_in_blocks(core: DataFrame, shifts: dict[int, int | None]) -> DataFrame:
    """Links (i, a, b, only) of cells with the smallest of their block that they reach."""
    kind = core.schema["place"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(pdf["place"].to_numpy(), return_inverse=True)
        at, a, b = blocks.linked(pdf[AXES].to_numpy(float), pdf[CELL].to_numpy(np.int64), codes, float(pdf["e"].iloc[0]))
        some = a != b
        return pd.DataFrame({"i": int(pdf["i"].iloc[0]), "a": names[a[some]], "b": names[b[some]], "only": pdf["alone"].to_numpy(bool)[at[some]]})

    return _in_blocks(core.select("i", "e", "place", *AXES, *CELL), shifts).applyInPandas(run, f"i int, a {kind}, b {kind}, only boolean")


def dbscan_places(places: DataFrame, epsilons: list[float], least: int, pairs: int = PAIRS) -> DataFrame:
    """Rows (i, place, cluster_id) of the places that belong to a cluster for epsilons[i]: clusters are numbered by their smallest core place, and a border place takes the lowest cluster beside it."""
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(e)).alias("e")) for i, e in enumerate(epsilons)])
    at = places.select("place", "weight", *AXES, F.explode(tries).alias("t")).select("place", "weight", *AXES, "t.i", "t.e")
    at = cut(at.select("*", *_cells(_side())))
    cells = at.groupBy("i", *CELL).agg(F.sum("weight").alias("in_cell"), F.count("*").alias("n"))
    shifts = _shifts(cells, len(epsilons))
    dealt, crowded = _ways(shifts, at)
    cores, beside = [], []
    if dealt is not None:
        told = cut(_told_in_blocks(dealt, shifts, least))
        cores.append(told.where("core").select("i", "e", "place", *AXES, *_cells(_side())))
        beside.append(told.where("NOT core").select("i", "place", "other"))
    if crowded is not None:
        crowded = crowded.join(cells, ["i", *CELL])
        thin = cut(crowded.where(F.col("in_cell") < least))
        near = _met(thin.select("i", F.col("e").alias("radius"), F.col("place").alias("seeker"), *AXES), crowded.select("i", "place", "weight", *AXES))
        counted = near.groupBy("i", F.col("seeker").alias("place")).agg(F.sum("weight").alias("near"))
        thin = cut(thin.join(counted, ["i", "place"]))
        cores += [r.select("i", "e", "place", *AXES, *CELL) for r in (crowded.where(F.col("in_cell") >= least), thin.where(F.col("near") >= least))]
    core = reduce(DataFrame.unionByName, cores)
    named = core.groupBy("i", *CELL).agg(F.min("place").alias("cell"))
    core = cut(core.join(named, ["i", *CELL]))
    links = cut(cell_links(core, pairs, shifts))
    open_ = links.where("NOT only").select(F.struct("i", F.col("a").alias("key")).alias("a"), F.struct("i", F.col("b").alias("key")).alias("b"))
    known = connected_components(open_).select(F.col("node.i").alias("i"), F.col("node.key").alias("root"), F.col("component.key").alias("label"))
    cells = core.select("i", "cell").distinct().join(links.where("only").select("i", F.col("a").alias("cell"), F.col("b").alias("root")), ["i", "cell"], "left").withColumn("root", F.coalesce("root", "cell"))
    labels = cut(cells.join(known, ["i", "root"], "left").select("i", "cell", F.coalesce("label", "root").alias("label")))
    roots = labels.select("i", "label").distinct()
    counts = {f"n{i}": (F.col("i") == i).cast("long") for i in range(len(epsilons))}
    own = F.element_at(F.array(*map(F.col, counts)), F.col("i") + 1)
    numbers = running(roots, "label", counts, ties=("label", "i")).select("i", "label", (own - 1).cast("int").alias("cluster_id"))
    numbered = cut(core.select("i", "place", "cell", *AXES).join(labels.join(numbers, ["i", "label"]).select("i", "cell", "cluster_id"), ["i", "cell"]))
    if crowded is not None:
        border = thin.where(F.col("near") < least).select("i", F.col("e").alias("radius"), F.col("place").alias("seeker"), *AXES)
        beside.append(_met(border, numbered.select("i", "place", F.lit(1).alias("weight"), *AXES)).select("i", F.col("seeker").alias("place"), F.col("place").alias("other")))
    reach = reduce(DataFrame.unionByName, beside).join(numbered.select("i", F.col("place").alias("other"), "cluster_id"), ["i", "other"]).groupBy("i", "place").agg(F.min("cluster_id").alias("cluster_id"))
    return cut(numbered.select("i", "place", "cluster_id").unionByName(reach))


def dbscan_sweep(rows: DataFrame, epsilons: list[float], least: int | None = None, key: str = "client_id", pairs: int = PAIRS) -> list[DataFrame]:
    """For each epsilon, rows with cluster_id: -1 for noise.

    A point is core with `least` neighbours or more, itself included (least_neighbours of the rows if None). All
    candidates go through the same jobs.
    """
    least = least_neighbours(rows.count()) if least is None else least
    places = cut(places_of(rows, key))
    found = dbscan_places(places, epsilons, least, pairs)
    each = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("cluster_id"))), F.lit(-1)).alias(f"_of_{i}") for i in range(len(epsilons))]
    named = places.select(*AXES, "place").join(found.groupBy("place").agg(*each), "place", "left").drop("place")
    made = cut(rows.join(named, AXES).select(*rows.columns, *[f"_of_{i}" for i in range(len(epsilons))]))  # once, for all candidates
    return [made.select(*rows.columns, F.coalesce(f"_of_{i}", F.lit(-1)).alias("cluster_id")) for i in range(len(epsilons))]


# --- k-th neighbours ---


def knn_distances(rows: DataFrame, k: int | None = None, key: str = "client_id") -> DataFrame:
    """Rows (key, distance) to the k-th nearest other point of every row, exact (the farthest if there are fewer): a curve to choose epsilon by.

    Equal points are one place with a weight. Points are counted in cells of many sizes at once, and each place
    starts with the smallest size at which its own cell holds k others: dense and sparse places alike meet a
    number of others that depends on k. Those that find fewer than k within that radius try twice of it, which is
    more than the cell's diagonal, so that there are two rounds whatever the number of places.
    """
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(None).cast("double").alias("distance")).where("false")
    k = min(least_neighbours(n) if k is None else k, n - 1)
    places = cut(places_of(rows, key))
    ends = places.agg(*[(F.max(c) - F.min(c)).alias(c) for c in AXES]).first()
    span = 2 * max([*(x or 0.0 for x in ends), 1e-9])  # within a radius of half of it lies everything
    sized = F.explode(F.sequence(F.lit(0), F.lit(SIZES))).alias("i")
    side = F.lit(span) / F.pow(F.lit(2.0), F.col("i"))
    dealt = places.select("place", "weight", *AXES, sized).select("place", "weight", "i", *_cells(side))
    full = dealt.groupBy("i", *CELL).agg(F.sum("weight").alias("n")).where(F.col("n") > k)
    start = dealt.join(full, ["i", *CELL]).groupBy("place").agg(F.max("i").alias("i"))
    left = cut(places.join(start, "place", "left").withColumn("i", F.coalesce("i", F.lit(0))))
    done = []
    while True:
        seekers = left.select("i", side.alias("radius"), F.col("place").alias("seeker"), *AXES)
        used = [r["i"] for r in seekers.select("i").distinct().collect()]  # of SIZES + 1 at most
        met = _met(seekers, places.select("*", F.explode(F.array(*map(F.lit, used))).alias("i")))
        met = met.withColumn("weight", F.col("weight") - (F.col("seeker") == F.col("place")).cast("int")).where("weight > 0")
        # k rows hold k points at least; Spark keeps no more of a seeker's before the shuffle
        met = met.withColumn("rank", F.row_number().over(W.partitionBy("seeker").orderBy("gap", "place"))).where(F.col("rank") <= k)
        got = met.groupBy(F.col("seeker").alias("place")).agg(F.array_sort(F.collect_list(F.struct("gap", "weight"))).alias("near"), F.sum("weight").alias("all"))
        up = F.reduce("near", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d")), lambda s, x: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + x["weight"]).alias("n"), x["gap"].alias("d"))))
        got = cut(got.where(F.col("all") >= k).select("place", up["d"].alias("distance")))
        done.append(got)
        left = cut(left.join(got, "place", "left_anti").withColumn("i", F.col("i") - 1).where("i >= 0"))
        if left.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    return rows.select(key, *AXES).join(places.join(found, "place").select(*AXES, "distance"), AXES).select(key, "distance")
