"""Recency, frequency and amount: scores, segments and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.functions.stats import quintiles, standardised, winsorised
from comptoir.operators.indicators import sold
from comptoir.session import cut


def reference_date(sales: DataFrame) -> DataFrame:
    """One row: the last sale of all, returns included."""
    return sales.agg(F.max("date_transaction").alias("ref"))


def _in_window(rows: DataFrame, sales: DataFrame, days: int) -> DataFrame:
    rows = rows.where("client_id IS NOT NULL").crossJoin(F.broadcast(reference_date(sales)))  # one row
    return rows.where((F.col("date_transaction") >= F.col("ref") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("date_transaction") <= F.col("ref")))


def rfm(sales: DataFrame, days: int = S.WINDOW_DAYS) -> DataFrame:
    """For each customer with a purchase in the window: whole days since the last one, distinct invoices (lines if none has a number), amount."""
    each = _in_window(sold(sales), sales, days).groupBy("client_id").agg(F.max("date_transaction").alias("last"), F.max("ref").alias("ref"), F.count("numero_facture").alias("numbered"), F.countDistinct("numero_facture").alias("invoices"), F.count("*").alias("lines"), F.sum("montant").alias("montant_total"))
    return each.select("client_id", F.timestamp_diff("DAY", "last", "ref").cast("int").alias("recence_jours"), F.when(F.col("numbered") > 0, F.col("invoices")).otherwise(F.col("lines")).alias("frequence_achats"), F.col("montant_total").cast("double").alias("montant_total"))


def scored(base: DataFrame) -> DataFrame:
    """base with score_r, score_f and score_m, 1 to 5."""
    return cut(quintiles(cut(base), {"recence_jours": ("score_r", True), "frequence_achats": ("score_f", False), "montant_total": ("score_m", False)}))


def matrix(base: DataFrame, percentile: float = S.WINSOR_PERCENTILE) -> tuple[DataFrame, float | None]:
    """base with z_r, z_f and z_m: the amount winsorised, all log1p and z-scored; and the amount's cap. The stored amount is not changed."""
    base = cut(base)
    rows, cap = winsorised(base, "montant_total", "montant_plafonne", percentile)
    return standardised(rows.withColumnsRenamed({"recence_jours": "r", "frequence_achats": "f", "montant_plafonne": "m"}), ["r", "f", "m"]).withColumnsRenamed({"r": "recence_jours", "f": "frequence_achats", "m": "montant_plafonne"}), cap


def with_churn(rows: DataFrame, days: int = S.WINDOW_DAYS) -> DataFrame:
    return rows.withColumn("score_churn", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("recence_jours") / F.lit(float(days)))), 4))


def with_segment(rows: DataFrame, days: int = S.WINDOW_DAYS) -> DataFrame:
    """rows (recence_jours, frequence_achats, score_f, score_m, cluster_id) with segment_rfm; the first rule that holds decides.

    A cluster is of high value if its active, recurrent members have mean scores of 3 or more in F and M;
    the noise cluster -1 never is. The clusters' means are a small aggregate, joined back.
    """
    dormant, recurrent, noise = F.col("recence_jours") > days / 2, F.col("frequence_achats") > 1, F.coalesce(F.col("cluster_id") == -1, F.lit(False))
    means = rows.where(recurrent & ~dormant & ~noise).groupBy("cluster_id").agg(F.avg("score_f").alias("_f"), F.avg("score_m").alias("_m"))
    high = means.where((F.col("_f") >= S.SCORE_FIDELE) & (F.col("_m") >= S.SCORE_FIDELE)).select("cluster_id", F.lit(True).alias("_high"))
    rows = rows.join(high, "cluster_id", "left")
    own = (F.col("score_f") >= S.SCORE_FIDELE) & (F.col("score_m") >= S.SCORE_FIDELE)
    label = (
        F.when(dormant & recurrent, S.RISQUE).when(dormant, S.PERDU).when(noise & (F.col("score_m") >= S.SCORE_ATYPIQUE), S.ATYPIQUE)
        .when(~recurrent, S.NOUVEAU).when(F.coalesce(F.col("_high"), F.lit(False)) & own, S.FIDELE).otherwise(S.OCCASIONNEL)
    )
    return rows.withColumn("segment_rfm", label).drop("_high")


def out_of_window(sales: DataFrame, days: int = S.WINDOW_DAYS) -> DataFrame:
    """Customers with purchases but none in the window, and whole days since the last."""
    ever = sold(sales).where("client_id IS NOT NULL").groupBy("client_id").agg(F.max("date_transaction").alias("last")).crossJoin(F.broadcast(reference_date(sales)))  # one row
    late = ever.where((F.col("last") < F.col("ref") - F.expr(f"INTERVAL {days} DAYS")))
    return late.select("client_id", F.timestamp_diff("DAY", "last", "ref").cast("int").alias("recence_jours"))


def segmented(sales: DataFrame, labelled: DataFrame, days: int = S.WINDOW_DAYS) -> DataFrame:
    """All customers with purchases: those in the window by their segment, the others rewritten as lost with zero activity."""
    inside = with_churn(with_segment(labelled, days), days)
    columns = ["client_id", "recence_jours", "frequence_achats", "montant_total", "score_r", "score_f", "score_m", "cluster_id", "segment_rfm", "score_churn"]
    lost = out_of_window(sales, days).select(
        "client_id", "recence_jours", F.lit(0).cast("long").alias("frequence_achats"), F.lit(0.0).alias("montant_total"), *[F.lit(1).alias(f"score_{c}") for c in "rfm"],
        F.lit(None).cast("int").alias("cluster_id"), F.lit(S.PERDU).alias("segment_rfm"), F.lit(1.0).alias("score_churn"),
    )
    return inside.select(*columns).unionByName(lost)


def rule_clusters(rows: DataFrame) -> DataFrame:
    """A cluster by the scores alone, for reports without a fitted model."""
    return rows.withColumn("cluster_id", F.floor((F.col("score_f") + F.col("score_m")) / 3).cast("int"))


def action(segment: Column) -> Column:
    out = F.lit("Action à définir")
    for name, said in S.ACTIONS.items():
        out = F.when(segment == name, said).otherwise(out)
    return out


def summary(clients: DataFrame) -> DataFrame:
    """For each segment: customers, mean amount, mean churn and the advised action."""
    return clients.where("segment_rfm IS NOT NULL").groupBy("segment_rfm").agg(F.count("*").alias("nb_clients"), F.round(F.sum(F.col("montant_total").cast("decimal(20,2)")).cast("double") / F.count("*"), 4).alias("montant_total_moyen"), F.round(F.sum(F.col("score_churn").cast("decimal(10,4)")).cast("double") / F.count("*"), 6).alias("score_churn_moyen")).withColumn("action_marketing_recommandee", action(F.col("segment_rfm")))


def by_segment(clients: DataFrame, segment: str | None = None, limit: int = 200) -> DataFrame:
    rows = clients.where("segment_rfm IS NOT NULL")
    rows = rows.where(F.col("segment_rfm") == segment) if segment else rows
    return rows.orderBy(F.desc_nulls_last("montant_total"), "client_id").limit(limit)


def examples(clients: DataFrame, n: int = 5) -> DataFrame:
    """The n largest customers of each segment. max_by-style aggregation keeps n rows for each segment and task, so no segment is sorted whole."""
    from functools import reduce

    names = [*S.ACTIONS]
    each = [clients.where(F.col("segment_rfm") == s).orderBy(F.desc_nulls_last("montant_total"), "client_id").limit(n) for s in names]
    return reduce(DataFrame.unionByName, each).withColumn("rang", F.row_number().over(W.partitionBy("segment_rfm").orderBy(F.desc_nulls_last("montant_total"), "client_id")))  # n rows a segment


def reading(clients: DataFrame) -> DataFrame:
    """One row: the largest segment, the one of highest mean amount, and the riskiest."""
    return summary(clients).agg(F.max_by("segment_rfm", F.struct("nb_clients", "segment_rfm")).alias("plus_grand"), F.max_by("segment_rfm", F.struct("montant_total_moyen", "segment_rfm")).alias("plus_rentable"), F.max_by("segment_rfm", F.struct("score_churn_moyen", "segment_rfm")).alias("plus_a_risque"))
