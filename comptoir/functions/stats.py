"""Order statistics, running sums and scores that hold at any size.

A window without partitions sends all rows to one task. Here rows are dealt by value into bins whose
bounds are approximate quantiles; windows stay within a bin, and the bins' totals (a row for each bin) give the rest. A
value that repeats is dealt on by what breaks its ties; without that callers aggregate by value first.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType

from comptoir.session import cut

ACCURACY = 10_000


def _array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<double>")


def binned(df: DataFrame, by: str, bins: int | None = None, tie: str | None = None) -> DataFrame:
    """df with _bin, ascending with the number `by` (null: 0); only bounds reach the driver, about as many as `bins`, which is the number of shuffle partitions if None.

    tie: a number or day by which a value that repeats through several bins is dealt to bins of its own, in order of (by, tie).
    """
    bins = bins or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = lambda c, n: F.percentile_approx(c, [i / n for i in range(1, n)], ACCURACY)
    value = F.col(by).cast("double")
    found = df.agg(shares(value, bins)).first()[0] or []
    limits = sorted(set(found))
    number = F.coalesce(F.size(F.filter(_array(limits), lambda b: b < value)), F.lit(0))
    hot = {b: found.count(b) for b in limits if found.count(b) > 1}  # each stands for a bin or more of the rows
    if not hot or tie is None or not isinstance(df.schema[tie].dataType, NumericType | DateType):
        return df.withColumn("_bin", number)
    own = F.datediff(tie, F.lit("1970-01-01").cast("date")) if isinstance(df.schema[tie].dataType, DateType) else F.col(tie)
    own, pieces = own.cast("double"), 1 + max(hot.values())
    inner = {r["v"]: r["b"] or [] for r in df.where(value.isin(list(hot))).groupBy(value.alias("v")).agg(shares(own, pieces).alias("b")).collect()}  # a row for each hot value, at most half as many as bins
    number = number + F.coalesce(F.size(F.filter(_array(sorted(hot)), lambda h: h <= value)), F.lit(0))  # a hot value is alone in its bin
    cuts, base, at = {h: sorted(set(inner.get(h, []))) for h in hot}, [], 0
    for b in range(len(limits) + len(hot) + 1):
        base.append(at)
        h = next((h for i, h in enumerate(sorted(hot)) if limits.index(h) + i + 1 == b), None)
        at += 1 + (len(cuts[h]) if h is not None else 0)
    within = reduce(lambda c, h: c.when(value == h, F.size(F.filter(_array(cuts[h]), lambda b: b < own))), hot, F.when(F.lit(False), 0))
    return df.withColumn("_bin", F.element_at(F.array(*map(F.lit, base)), number + 1) + F.coalesce(within, F.lit(0)))


def running(df: DataFrame, by: str, sums: dict[str, Column], ties: tuple = (), bins: int | None = None) -> DataFrame:
    """df with a running total, itself included, of each of sums in ascending order of (by, *ties)."""
    rows = binned(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), by, bins, ties[0] if ties else None)
    totals = {r["_bin"]: r for r in rows.groupBy("_bin").agg(*[F.sum(f"_v_{k}").alias(k) for k in sums]).collect()}  # a row for each bin
    kinds = {k: rows.agg(F.sum(f"_v_{k}").alias("t")).schema["t"].dataType for k in sums}
    within = W.partitionBy("_bin").orderBy(by, *ties).rowsBetween(W.unboundedPreceding, 0)
    for k, kind in kinds.items():
        before = [0]
        for i in range(max(totals, default=0)):
            before.append(before[-1] + ((totals[i][k] or 0) if i in totals else 0))
        ahead = F.element_at(F.array(*[F.lit(v).cast(kind) for v in before]), F.col("_bin") + 1)  # one lookup, whatever the number of bins
        rows = rows.withColumn(k, F.sum(f"_v_{k}").over(within) + ahead)
    return rows.drop("_bin", *[f"_v_{k}" for k in sums])


def quantiles(df: DataFrame, column: str, shares: list[float], bins: int | None = None) -> list[float | None]:
    """Exact quantiles with linear interpolation, nulls left out; a list of nulls for an empty column.

    Distinct values with their counts are ranked; one row for each asked rank reaches the driver.
    """
    counts = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")))  # read four times
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [None] * len(shares)
    ranked = running(counts, "v", {"up": F.col("n")}, bins=bins)
    places = [s * (total - 1) for s in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    hit = reduce(lambda a, b: a | b, [(F.col("up") > F.lit(k)) & (F.col("up") - F.col("n") <= F.lit(k)) for k in wanted])
    got = [(r["up"] - r["n"], r["up"], r["v"]) for r in ranked.where(hit).collect()]
    at = {k: next(v for a, b, v in got if a <= k < b) for k in wanted}
    return [at[int(p)] + (at[min(int(p) + 1, total - 1)] - at[int(p)]) * (p - int(p)) for p in places]


def discrete_quantile(df: DataFrame, column: str, share: float, bins: int | None = None) -> float | None:
    """The smallest value that `share` of all rows or more do not exceed, nulls left out; null for an empty column. As `quantiles`, distinct values with their counts are ranked, so that no task holds them all."""
    counts = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked = running(counts, "v", {"up": F.col("n")}, bins=bins)
    return ranked.where(F.col("up") >= F.lit(ceil(Decimal(str(share)) * total))).agg(F.min("v")).first()[0] if total else None


def winsor_cap(df: DataFrame, column: str, percentile: float = 99.0, factor: float = 1.5) -> float | None:
    """min(percentile, Q3 + factor * IQR if IQR > 0), at least the median; None with fewer than two distinct values."""
    low, mid, high, top = quantiles(df, column, [0.25, 0.5, 0.75, percentile / 100])
    if low is None or df.select(F.col(column)).distinct().limit(2).count() < 2:
        return None
    cap = min(top, high + factor * (high - low)) if high > low else top
    return max(cap, mid)


def winsorised(df: DataFrame, column: str, out: str, percentile: float = 99.0) -> tuple[DataFrame, float | None]:
    """df with `out`: the column, clipped above at its cap; and the cap."""
    cap = winsor_cap(df, column, percentile)
    value = F.col(column).cast("double")
    return df.withColumn(out, value if cap is None else F.least(value, F.lit(cap))), cap


def quintile(df: DataFrame, column: str, out: str, inverted: bool = False, source: DataFrame | None = None) -> DataFrame:
    """df with `out`: ceil(5 * average rank / n), 1 to 5, 6 minus that if inverted; 3 throughout for a constant column. source: where to rank, df if None."""
    counts = (df if source is None else source).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    counts = cut(counts)  # read three times
    ranked = running(counts, "_v", {"_up": F.col("_n")})
    total = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_values"))
    share = (F.col("_up") - (F.col("_n") - 1) / 2) / F.col("_total")
    score = F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(share * 5))).cast("int")
    score = F.when(F.col("_values") <= 1, 3).otherwise(F.lit(6) - score if inverted else score).cast("int")
    scores = ranked.crossJoin(F.broadcast(total)).select("_v", score.alias(out))  # total is one row
    return df.join(scores, df[column].eqNullSafe(scores["_v"])).drop("_v")


def quintiles(df: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """As quintile for several columns of numbers without nulls at once: {column: (out, inverted)}. All columns' values are counted, binned and ranked in the same jobs; bins' bounds and totals reach the driver."""
    names, bins = list(columns), max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])).alias("x")
    counts = cut(df.select(each).groupBy("x.c", "x.v").agg(F.count("*").alias("n")))
    bounds = {r["c"]: sorted(set(r["b"] or [])) for r in counts.groupBy("c").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], ACCURACY).alias("b")).collect()}
    own = lambda make, otherwise: reduce(lambda w, i: w.when(F.col("c") == i, make(i)), range(len(names)), F.when(F.lit(False), otherwise))
    counts = counts.withColumn("bin", own(lambda i: F.size(F.filter(_array(bounds.get(i, [])), lambda b: b < F.col("v"))), F.lit(0)))
    totals = {(r["c"], r["bin"]): (r["n"], r["values"]) for r in counts.groupBy("c", "bin").agg(F.sum("n").alias("n"), F.count("*").alias("values")).collect()}  # a row for each column and bin
    ahead, whole, values = {}, {}, {}
    for i in range(len(names)):
        sums = [totals.get((i, b), (0, 0)) for b in range(len(bounds.get(i, [])) + 1)]
        ahead[i] = [sum(n for n, _ in sums[:b]) for b in range(len(sums))]
        whole[i], values[i] = sum(n for n, _ in sums), sum(k for _, k in sums)
    up = F.sum("n").over(W.partitionBy("c", "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + own(lambda i: F.element_at(F.array(*[F.lit(a).cast("long") for a in ahead[i]]), F.col("bin") + 1), F.lit(0).cast("long"))
    share = (F.col("up") - (F.col("n") - 1) / 2) / own(lambda i: F.lit(float(whole[i] or 1)), F.lit(1.0))
    score = F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(share * 5))).cast("int")
    turned = own(lambda i: F.lit(3) if values[i] <= 1 else F.lit(6) - score if columns[names[i]][1] else score, F.lit(3)).cast("int")
    scores = cut(counts.withColumn("up", up).select("c", "v", turned.alias("score")))
    for i, n in enumerate(names):
        one = scores.where(F.col("c") == i).select(F.col("v").alias("_v"), F.col("score").alias(columns[n][0]))
        df = df.join(one, F.col(n).cast("double") == F.col("_v")).drop("_v")
    return df


def standardised(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """df with log1p and z-score (population deviation; 1 if that is 0) of each column."""
    logs = {f"_l_{c}": F.log1p(F.col(c).cast("double")) for c in columns}
    rows = df.withColumns(logs)
    stats = rows.agg(*[f(f"_l_{c}").alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = rows.crossJoin(F.broadcast(stats))  # stats is one row
    z = {f"{prefix}{c}": (F.col(f"_l_{c}") - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return rows.withColumns(z).drop(*logs, *[f"_{n}_{c}" for c in columns for n in "ms"])
