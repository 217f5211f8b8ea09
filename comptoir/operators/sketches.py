"""Approximate distinct counts: a small sketch for each group and day, kept in a table and united when asked.

A sketch of 2^lg_k registers has a relative standard error of about 0.83 / sqrt(2^lg_k), however many rows it
has seen, and sketches of parts give that of the whole. So new days add rows, old ones are never read again
from the sales, and any span of days is a union of some hundred sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.sources.stores import Store

#: Registers as a power of two; standard errors that a bound takes.
LG_K, ERRORS = 12, 4


def error_bound(lg_k: int = LG_K, errors: float = ERRORS) -> float:
    """The relative error that an estimate keeps within, but for one in some ten thousand."""
    return errors * 0.83 / (1 << lg_k) ** 0.5


def daily_sketches(rows: DataFrame, day: Column, value: str, by: tuple[str, ...] = (), lg_k: int = LG_K) -> DataFrame:
    """Rows (jour, *by, esquisse, lignes): a sketch of the distinct values of each day and group; null values are not counted, null days are left out. Sketches are made in tasks before the shuffle."""
    sketched = rows.withColumn("jour", F.to_date(day)).where("jour IS NOT NULL").groupBy("jour", *by)
    return sketched.agg(F.hll_sketch_agg(F.col(value), lg_k).alias("esquisse"), F.count(value).alias("lignes"))


def keep_sketches(store: Store, name: str, sketches: DataFrame) -> None:
    """Adds days to a table of sketches. A day that comes again brings another sketch, and both are united when asked, so that late rows and repeated ones count once."""
    store.append(name, sketches)


def distinct_between(sketches: DataFrame, first: str | None = None, last: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, distincts, lignes) of the days from first to last: the estimated number of distinct values, from sketches alone."""
    if first is not None:
        sketches = sketches.where(F.col("jour") >= F.lit(first).cast("date"))
    if last is not None:
        sketches = sketches.where(F.col("jour") <= F.lit(last).cast("date"))
    united = sketches.groupBy(*by).agg(F.hll_union_agg("esquisse").alias("u"), F.sum("lignes").alias("lignes"))
    return united.select(*by, F.coalesce(F.hll_sketch_estimate("u"), F.lit(0)).alias("distincts"), F.coalesce("lignes", F.lit(0)).alias("lignes"))
