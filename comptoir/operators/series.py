"""Daily series, calendar features, splits, plain forecasts and their readings.

A series has one row a day, so windows over all its days are small whatever the size of the sales.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.functions.stats import winsorised
from comptoir.operators.cashflow import spine
from comptoir.operators.indicators import sold
from comptoir.session import cut

#: Public holidays of the calendar, month and day.
FIXED_HOLIDAYS = [(1, 1), (2, 11), (5, 1), (5, 20), (8, 15), (12, 25)]


def by_day():
    """The window over all days in order; made when used, as it needs a session."""
    return W.orderBy("jour")


def easter(year: int) -> date:
    """Sunday of the Gregorian computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def holidays(first: int, last: int) -> list[date]:
    """Fixed days, Good Friday, Easter Monday and Ascension. Days of the lunar calendar are left to the caller, who may add them."""
    out = []
    for y in range(first, last + 1):
        sunday = easter(y)
        out += [date(y, m, d) for m, d in FIXED_HOLIDAYS] + [sunday + timedelta(d) for d in (-2, 1, 39)]
    return sorted(set(out))


def daily_revenue(sales: DataFrame) -> DataFrame:
    """Rows (jour, ca) for every day between the first and the last sale; days without sales have 0."""
    each = sold(sales).groupBy(F.to_date("date_transaction").alias("jour")).agg(F.sum("montant").alias("ca"))
    each = cut(each)  # a row a day, read several times
    return spine(each).join(each, "jour", "left").select("jour", F.coalesce("ca", F.lit(0)).cast("double").alias("ca"))


def winsorised_revenue(series: DataFrame, percentile: float = S.WINSOR_PERCENTILE) -> tuple[DataFrame, float | None]:
    """series with y: ca clipped at the cap of the days with sales; and the cap."""
    _, cap = winsorised(series.where("ca > 0"), "ca", "y", percentile)
    return series.withColumn("y", F.col("ca") if cap is None else F.least("ca", F.lit(cap))), cap


def calendar(days: DataFrame, extra: list[date] = ()) -> DataFrame:
    """days with jour_semaine (Monday 0), mois, est_weekend and est_ferie."""
    closed = [*holidays(1990, 2040), *extra]
    dow = F.weekday("jour")
    return days.withColumns({"jour_semaine": dow, "mois": F.month("jour"), "est_weekend": (dow >= 5).cast("int"), "est_ferie": F.col("jour").isin(closed).cast("int")})


def lags(series: DataFrame, y: str = "y") -> DataFrame:
    """series with lag_1, lag_7 and the mean of up to seven days before."""
    return series.withColumns({"lag_1": F.lag(y, 1).over(by_day()), "lag_7": F.lag(y, 7).over(by_day()), "moyenne_mobile_7": F.avg(y).over(by_day().rowsBetween(-7, -1))})


def split(series: DataFrame) -> DataFrame:
    """series with rang (from 1) and partie: the last fifth (3 days at least, and 3 left) is "test"."""
    n = F.count("*").over(W.partitionBy())
    test = F.when(n <= S.TEST_MIN, 0).otherwise(F.least(F.greatest(F.lit(S.TEST_MIN), F.floor(n * S.TEST_SHARE)), n - S.TEST_MIN))
    rows = series.withColumn("rang", F.row_number().over(by_day()))
    return rows.withColumn("partie", F.when(F.col("rang") > n - test, "test").otherwise("train"))


def mean_forecast(series: DataFrame, horizon: int, y: str = "y") -> DataFrame:
    """Rows (i, jour, valeur): the mean of all days, for each day after the last."""
    got = series.agg(F.max("jour").alias("fin"), F.avg(y).alias("valeur")).where("fin IS NOT NULL")
    rows = got.select("valeur", "fin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    return rows.select("i", F.date_add("fin", F.col("i")).alias("jour"), "valeur")


def repeated_week(series: DataFrame, horizon: int, y: str = "y") -> DataFrame:
    """Rows (i, jour, valeur): the last seven days, again and again."""
    last = series.withColumn("k", 8 - F.row_number().over(W.orderBy(F.desc("jour")))).where("k >= 1").select("k", F.col(y).alias("valeur"), F.max("jour").over(W.partitionBy()).alias("fin"))
    steps = last.select("k", "valeur", "fin", F.explode(F.sequence(F.lit(0), F.lit((horizon - 1) // 7))).alias("w")).withColumn("i", F.col("k") + 7 * F.col("w"))
    return steps.where(F.col("i") <= horizon).select("i", F.date_add("fin", F.col("i").cast("int")).alias("jour"), "valeur")


def errors(rows: DataFrame, actual: str, predicted: str) -> list[Column]:
    gap = F.col(actual) - F.col(predicted)
    return [F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae")]


def naive_errors(series: DataFrame, y: str = "y") -> DataFrame:
    """RMSE, MAE and MASE (against the mean step of one week in the training days) on the test days, of the mean of the training days, of the value a week before, and of the last training week repeated."""
    rows = split(series).withColumn("semaine", F.lag(y, 7).over(by_day()))
    train = F.col("partie") == "train"
    one = rows.agg(F.avg(F.when(train, F.col(y))).alias("moyenne"), F.avg(F.when(train, F.abs(F.col(y) - F.col("semaine")))).alias("echelle"), F.max(F.when(train, F.col("rang"))).alias("n_train"))
    test = rows.where(~train).crossJoin(F.broadcast(one))  # one row
    week = rows.where(train).select(F.col("rang").alias("source"), F.col(y).alias("repetee"))
    test = test.withColumn("source", F.col("n_train") - 6 + (F.col("rang") - F.col("n_train") - 1) % 7).join(week, "source", "left")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("modele"), F.col(c).alias("p")) for n, c in (("moyenne", "moyenne"), ("semaine_precedente", "semaine"), ("semaine_repetee", "repetee"))])).alias("x")
    long = test.select(F.col(y).alias("y"), "echelle", kinds).select("y", "echelle", "x.modele", "x.p")
    got = long.groupBy("modele").agg(*errors(long, "y", "p"), F.max("echelle").alias("echelle"))
    return got.select("modele", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round(F.try_divide("mae", "echelle"), 6).alias("mase"))


def _cents(c: str) -> Column:
    """A sum that does not depend on the order of its rows, in cents."""
    return F.round(F.sum(F.col(c).cast("decimal(20,6)")), 2).cast("double")


def weekly(points: DataFrame) -> DataFrame:
    """Rows (semaine, du, au, ventes_prevues) of seven days each."""
    rows = points.groupBy(F.floor((F.col("i") - 1) / 7).cast("int").alias("semaine"))
    return rows.agg(F.min("jour").alias("du"), F.max("jour").alias("au"), _cents("valeur").alias("ventes_prevues"))


def level_break(series: DataFrame, y: str = "ca") -> DataFrame:
    """One row: the mean of the last 30 days, of the 90 before, the change and whether it is a break."""
    back = F.row_number().over(W.orderBy(F.desc("jour")))
    rows = series.withColumn("k", back)
    got = rows.agg(F.avg(F.when(F.col("k") <= S.REFERENCE_DAYS, F.col(y))).alias("recent"), F.avg(F.when((F.col("k") > S.REFERENCE_DAYS) & (F.col("k") <= S.REFERENCE_DAYS + S.HISTORY_DAYS), F.col(y))).alias("avant"))
    change = F.when(F.col("avant") > 0, F.col("recent") / F.col("avant") - 1)
    return got.select(F.round("recent", 4).alias("recent"), F.round("avant", 4).alias("avant"), F.round(change, 6).alias("variation"), F.coalesce(F.abs(change) > S.BREAK, F.lit(False)).alias("rupture"))


def indicators(points: DataFrame, reference: DataFrame, quality: DataFrame) -> DataFrame:
    """One row on a forecast (i, valeur): total, mean, gap to the recent level (reference.recent), trend, relative error and reliability (quality.rmse, quality.moyenne)."""
    h = points.agg(F.max("i").alias("h"))
    k = F.greatest(F.lit(1), F.least(F.lit(7), F.floor(F.col("h") / 3)))
    rows = points.crossJoin(F.broadcast(h)).withColumn("k", k)  # one row
    got = rows.agg(_cents("valeur").alias("total"), F.avg("valeur").alias("moyenne"), F.avg(F.when(F.col("i") <= F.col("k"), F.col("valeur"))).alias("debut"), F.avg(F.when(F.col("i") > F.col("h") - F.col("k"), F.col("valeur"))).alias("fin"))
    got = got.crossJoin(reference.select("recent")).crossJoin(quality.select("rmse", F.col("moyenne").alias("base")))  # one row each
    trend = F.when(F.col("debut") > 0, (F.col("fin") - F.col("debut")) / F.col("debut")).otherwise(0.0)
    error = F.when(F.col("base") > 0, F.col("rmse") / F.col("base"))
    return got.select(
        F.col("total").alias("total_prevu"), F.round("moyenne", 2).alias("moyenne_jour"), F.round(F.when(F.col("recent") > 0, F.col("moyenne") / F.col("recent") - 1), 6).alias("ecart_niveau"), F.round(trend, 6).alias("tendance"),
        F.when(trend > S.TREND, "hausse").when(trend < -S.TREND, "baisse").otherwise("stable").alias("sens"), F.round(error, 6).alias("erreur_relative"),
        F.when(error < 0.25, "bonne").when(error < 0.5, "moyenne").when(error.isNotNull(), "faible").alias("fiabilite"),
    )


def scenarios(points: DataFrame, mae: DataFrame) -> DataFrame:
    """One row (bas, haut): the sums of the bounds if every point has both, else the total with the mean error (mae.mae) of each day; never below 0."""
    if {"borne_basse", "borne_haute"} <= set(points.columns):
        whole = F.count_if(F.col("borne_basse").isNull() | F.col("borne_haute").isNull()) == 0
        low, high = F.when(whole, F.sum("borne_basse")), F.when(whole, F.sum("borne_haute"))
    else:
        low = high = F.lit(None).cast("double")
    got = points.agg(F.sum("valeur").alias("total"), F.count("*").alias("n"), low.alias("low"), high.alias("high")).crossJoin(mae.select("mae"))  # one row each
    margin = F.col("mae") * F.col("n")
    return got.select(F.round(F.greatest(F.lit(0.0), F.coalesce("low", F.col("total") - margin)), 2).alias("bas"), F.round(F.coalesce("high", F.col("total") + margin), 2).alias("haut"))
