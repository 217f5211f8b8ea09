"""Joins that are not by equality alone: the last row before a time, and overlapping intervals.

Both are made of equi-joins, windows of bounded length and aggregations, so that no plan holds a nested
loop, and no key, time or interval that holds many rows is one task's work. Where only totals of pairs are
asked, no pair is made: overlapping days are counted by what begins and ends on each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from comptoir.functions.stats import binned
from comptoir.session import cut

#: Levels of interval length, each of twice the last one's.
LEVELS = 40
#: A key with more than one in so many rows is dealt on; items that the sketch of keys tracks.
BUSY, TRACKED = 1024, 16_384


def as_number(df: DataFrame, column: str) -> Column:
    """The column in order as a number: days of a date, microseconds of a time, else a double."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("double")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, ties: tuple[str, ...] = (), within: float | None = None, strict: bool = False, forward: bool = False, inner: bool = False, prefix: str = "derniere_", busy: int = 10_000) -> DataFrame:
    """left with the columns of the last row of right of the same keys at or before its time, named with prefix (nulls if there is none; left out if inner).

    strict: before, not at; forward: the first at or after; within: at most so far off, in days of dates,
    microseconds of times, units of numbers. Of rows of right with the same keys and time the greatest by `ties`, then
    by its other columns, counts. Null keys and times match nothing; repeated rows of left stay.

    Rows of both sides meet in one shuffle by key and are sorted by time, the last row of right carried forward. Keys that hold
    more than a thousandth of all rows, and more than `busy`, are found by a sketch and dealt on by `_asof_of_busy_keys`.
    """
    sign = -1 if forward else 1
    keys = [f"_k{i}" for i in range(len(on))]
    taken = [c for c in right.columns if c not in on]
    order = [*ties, *[c for c in taken if c not in ties]]
    named = lambda df, time: [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)] + [(sign * as_number(df, time)).alias("_t")]
    known = right.select(*named(right, right_time), F.struct(*[F.col(c) for c in order]).alias("_r")).dropna(subset=[*keys, "_t"])
    asked = left.select(*named(left, left_time), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    kinds = known.select(*keys, "_t").unionByName(asked.select(*keys, "_t")).schema  # a key has one type, so one hash
    known, asked = (df.withColumns({k: F.col(k).cast(kinds[k].dataType) for k in [*keys, "_t"]}) for df in (known, asked))
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in [*keys, "_t"]])
    unknown, asked = asked.where(~whole).withColumn("_x", F.lit(None)), asked.where(whole)
    own = F.xxhash64(*keys)
    hot = _busy(known.select(own.alias("h")).unionByName(asked.select(own.alias("h"))), busy)
    few = ~own.isin(hot) if hot else F.lit(True)
    kind = known.select(F.struct("_t", "_r").alias("x")).schema["x"].dataType
    side = F.lit(0 if strict else 2)  # at equal times a known row comes before those asked unless strict
    both = known.where(few).select(*keys, "_t", F.lit(1).alias("_side"), F.struct("_t", "_r").alias("_x"), F.lit(None).cast(asked.schema["_l"].dataType).alias("_l"))
    both = both.unionByName(asked.where(few).select(*keys, "_t", side.alias("_side"), F.lit(None).cast(kind).alias("_x"), "_l"))
    seen = F.last("_x", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_side", "_x").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_x", seen).where("_side != 1").select("_t", "_l", "_x")
    if hot:
        found = found.unionByName(_asof_of_busy_keys(known.where(~few), asked.where(~few), keys, side).select("_t", "_l", "_x"))
    if within is not None:
        found = found.withColumn("_x", F.when(F.col("_t") - F.col("_x._t") <= within, F.col("_x")))
    found = found.where("_x IS NOT NULL") if inner else found.unionByName(unknown.select("_t", "_l", F.col("_x").cast(kind).alias("_x")))
    return found.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *[F.col(f"_x._r.`{c}`").alias(f"{prefix}{c}") for c in taken])


def _busy(hashes: DataFrame, least: int) -> list[int]:
    """The hashes (h) that hold more than `least` rows and a share of one in BUSY or more, by a sketch: at most BUSY of them. A sketch's error only deals a key otherwise."""
    got = hashes.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {BUSY}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in got["top"] or [] if x["count"] > max(least, got["n"] / BUSY)]


def _asof_of_busy_keys(known: DataFrame, asked: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """asked with _x, the last row of known (keys, _t, _r) or null.

    The two sides' times, each once for each key, are sorted in blocks of time, and the last row seen is carried
    forward within a block; what a key brings into a block is one row for each of its blocks. So a key with
    many times is many tasks' work, and one with many rows at one time is reduced before that.
    """
    kind = known.select(F.struct("_t", "_r").alias("x")).schema["x"].dataType
    known = known.groupBy(*keys, "_t").agg(F.max("_r").alias("_r"))
    times = asked.select(*keys, "_t").distinct()
    both = known.select(*keys, "_t", F.lit(1).alias("_side"), F.struct("_t", "_r").alias("_x")).unionByName(times.select(*keys, "_t", side.alias("_side"), F.lit(None).cast(kind).alias("_x")))
    both = cut(binned(cut(both), "_t"))
    seen = F.last("_x", ignorenulls=True).over(W.partitionBy(*keys, "_bin").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    brought = both.where("_side = 1").groupBy(*keys, "_bin").agg(F.max_by("_x", "_t").alias("_x"))
    blocks = both.where("_side != 1").select(*keys, "_bin").distinct().join(brought, [*keys, "_bin"], "full")
    ahead = blocks.withColumn("_ahead", F.last("_x", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)))  # a row for each block of a key
    found = both.withColumn("_seen", seen).where("_side != 1").select(*keys, "_bin", "_t", "_seen").join(ahead.select(*keys, "_bin", "_ahead"), [*keys, "_bin"], "left")
    return asked.join(found.select(*keys, "_t", F.coalesce("_seen", "_ahead").alias("_x")), [*keys, "_t"])


def range_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], on: list[str] = (), outer: bool = False, prefix: str = "r_") -> DataFrame:
    """Pairs of a row of left and one of right of the same keys whose intervals, ends included, have a point in common; columns of right are named with prefix. outer: rows of left without one stay, with nulls.

    A point is an interval with equal ends. Null ends and intervals that end before they start meet nothing.
    Repeated rows count each. An interval is filed in bins of its own length's power of two and those above that the
    other side uses, in two at most of each; two intervals meet in bins of the longer one's size, in the first
    of those that they share, so that no pair is met twice and none is removed later. The join is one
    by equality, whose large bins Spark splits.
    """
    left = cut(left.withColumn("_id", F.monotonically_increasing_id())) if outer else left
    sides = []
    for df, (a, b), keep in ((left, left_ends, left.columns), (right, right_ends, right.columns)):
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(on)], as_number(df, a).cast("double").alias("a"), as_number(df, b).cast("double").alias("b"))
        sides.append(rows.where("a <= b"))
    lengths = [s.where("b > a").agg(F.percentile_approx(F.col("b") - F.col("a"), 0.1, 1000)).first()[0] for s in sides]
    unit = min([x for x in lengths if x], default=1.0)
    level = F.when(F.col("b") - F.col("a") <= unit, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log2((F.col("b") - F.col("a")) / unit)))).cast("int")
    sides = [s.withColumn("own", level) for s in sides]
    used = sorted({r["own"] for s in sides for r in s.select("own").distinct().collect()})  # LEVELS + 1 at most
    size = F.lit(unit) * F.pow(F.lit(2.0), F.col("level"))
    filed = []
    for s in sides:
        s = s.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"), lambda x: x >= F.col("own"))))
        s = s.withColumns({"first": F.floor(F.col("a") / size), "last": F.floor(F.col("b") / size)})
        filed.append(s.withColumn("bin", F.explode(F.sequence("first", "last"))))
    keys = ["level", "bin", *[f"k{i}" for i in range(len(on))]]
    x, y = filed[0].alias("x"), filed[1].alias("y")
    met = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    met = met.where(((F.col("x.own") == F.col("x.level")) | (F.col("y.own") == F.col("x.level"))) & (F.col("x.bin") == F.greatest("x.first", "y.first")) & (F.col("x.a") <= F.col("y.b")) & (F.col("y.a") <= F.col("x.b")))
    pairs = met.select(F.col("x.row").alias("l"), F.col("y.row").alias("r"))
    told = [F.col(f"r.`{c}`").alias(f"{prefix}{c}") for c in right.columns]
    if not outer:
        return pairs.select(*[F.col(f"l.`{c}`") for c in left.columns], *told)
    got = pairs.select(F.col("l._id").alias("_id"), *told)
    return left.join(got, "_id", "left").drop("_id")


def overlap_totals(rows: DataFrame, ends: tuple[str, str], on: list[str], same: str, pairs: str = "paires", days: str = "jours") -> DataFrame:
    """For each `on`, how many pairs of rows with different `same` have overlapping intervals of dates, ends included, and how many days they share in all; keys without such a pair are left out.

    Two intervals share a stretch of days, so a pair counts one day more than it counts of two days on end: of n rows that
    hold a day n (n - 1) / 2 pairs share it, and of m rows that hold the day before as well m (m - 1) / 2 share both.
    Pairs of rows of the same `same` are taken off in the same way. Rows with null keys or ends, or that end before they start, count nothing.
    """
    a, b = as_number(rows, ends[0]).alias("a"), as_number(rows, ends[1]).alias("b")
    spans = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)], F.col(same).alias("own"), a, b).where("a <= b").dropna()
    keys = [f"k{i}" for i in range(len(on))]
    found = _shared(spans, keys)
    often = spans.groupBy(*keys, "own").agg(F.count("*").alias("n")).where("n > 1")
    within = _shared(spans.join(often.drop("n"), [*keys, "own"], "left_semi"), [*keys, "own"])
    off = within.select(*keys, (-F.col("pairs")).alias("pairs"), (-F.col("days")).alias("days"))
    got = found.unionByName(off).groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("days").alias("days")).where("pairs > 0")
    return got.select(*[F.col(k).alias(c) for k, c in zip(keys, on, strict=True)], F.col("pairs").alias(pairs), F.col("days").alias(days))


def _shared(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, pairs, days) of spans (keys, a, b): all pairs of rows with a day in common, and those days.

    What is sorted for a key has a row for each day on which a span begins or has ended; between two of them nothing changes.
    """
    begun = spans.groupBy(*keys, F.col("a").alias("d")).agg(F.count("*").alias("more"))
    ended = spans.groupBy(*keys, (F.col("b") + 1).alias("d")).agg(F.count("*").alias("less"))
    turns = begun.withColumn("less", F.lit(0).cast("long")).unionByName(ended.withColumn("more", F.lit(0).cast("long"))).groupBy(*keys, "d").agg(F.sum("more").alias("more"), F.sum("less").alias("less"))
    own = W.partitionBy(*keys).orderBy("d")
    turns = turns.withColumns({"n": F.sum(F.col("more") - F.col("less")).over(own), "until": F.lead("d").over(own)}).withColumn("kept", F.col("n") - F.col("more"))
    two = lambda n: F.shiftright(n * (n - 1), 1)
    held = F.coalesce(F.col("until") - F.col("d"), F.lit(0))  # days that n rows hold
    return turns.groupBy(*keys).agg(F.sum(F.when(F.col("more") > 0, two(F.col("n")) - two(F.col("kept")))).alias("pairs"), F.sum(two(F.col("n")) * held).alias("days"))
