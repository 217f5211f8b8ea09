"""Key figures, concentration, stock alerts and reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.functions.stats import running
from comptoir.session import cut
from comptoir.sources.model import Model


def sold(sales: DataFrame) -> DataFrame:
    """Sales without returns."""
    return sales.where(~F.col("est_retour"))


def global_figures(m: Model) -> DataFrame:
    """One row: customers, sale lines, revenue, units in stock, cash balance; zero where a table is empty."""
    zero = lambda c, kind="double": F.coalesce(c.cast(kind), F.lit(0).cast(kind))
    signed = F.when(F.col("type_mouvement") == "encaissement", F.col("montant")).otherwise(-F.col("montant"))
    one = [
        m.clients.agg(F.count("*").alias("nb_clients")),
        sold(m.transactions).agg(F.count("*").alias("nb_transactions"), zero(F.sum("montant")).alias("chiffre_affaires_total")),
        m.stocks.agg(zero(F.sum("quantite_disponible"), "long").alias("stock_total_unites")),
        m.cash.agg(zero(F.sum(signed)).alias("solde_tresorerie_estime")),
    ]
    out = one[0]
    for more in one[1:]:
        out = out.crossJoin(more)  # one row each
    return out


def revenue_by_client(sales: DataFrame) -> DataFrame:
    return sold(sales).where("client_id IS NOT NULL").groupBy("client_id").agg(F.sum("montant").alias("ca"), F.countDistinct("numero_facture").alias("nb_factures"))


def top_clients(m: Model, limit: int = 10) -> DataFrame:
    """The customers of most revenue over all history, with their share of it."""
    each = revenue_by_client(m.transactions)
    total = each.agg(F.sum("ca").cast("double").alias("total"))
    top = each.orderBy(F.desc("ca"), "client_id").limit(limit)
    rows = top.crossJoin(F.broadcast(total)).join(m.clients, "client_id", "left")  # total is one row
    return rows.select("client_id", F.coalesce("nom", F.col("client_id").cast("string")).alias("client"), F.col("ca").cast("double").alias("chiffre_affaires"), F.round(F.col("ca").cast("double") / F.col("total"), 6).alias("part_ca"), "nb_factures")


def pareto(sales: DataFrame, share: float = S.PARETO) -> DataFrame:
    """One row: how many customers make this share of revenue, out of how many."""
    each = cut(revenue_by_client(sales).withColumn("down", -F.col("ca")))  # read four times
    cum = running(each, "down", {"cumul": F.col("ca"), "rang": F.lit(1)}, ties=("client_id",))
    total = each.agg(F.sum("ca").alias("total"), F.count("*").alias("n"))
    reached = F.min(F.when(F.col("cumul") >= F.col("total") * F.lit(str(share)).cast("decimal(3,2)"), F.col("rang")))
    return cum.crossJoin(F.broadcast(total)).groupBy().agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("nb_clients"), F.coalesce(reached, F.lit(0)).cast("long").alias("nb_clients_80pct"), F.coalesce(F.max("total").cast("double"), F.lit(0.0)).alias("ca_total_clients"))


def signature(sales: DataFrame) -> DataFrame:
    """One row that changes when sales change: the key of cached results."""
    return sold(sales).agg(F.count("*").alias("n"), F.max("date_transaction").alias("derniere"), F.coalesce(F.sum("montant").cast("double"), F.lit(0.0)).alias("total"))


def stock_alerts(stocks: DataFrame) -> DataFrame:
    """Products at or below a threshold, with the order in which to show them: ordre (level first, then the ratio to the threshold)."""
    level = F.when(F.col("quantite_disponible") <= F.col("seuil_alerte"), "critique").when(F.col("quantite_disponible") <= F.col("seuil_reapprovisionnement"), "attention").otherwise("ok")
    ratio = F.when(F.col("seuil_alerte") != 0, F.col("quantite_disponible") / F.col("seuil_alerte")).otherwise(F.col("quantite_disponible").cast("double"))
    rows = stocks.withColumn("niveau", level).where("niveau != 'ok'").withColumn("ratio", F.round(ratio, 6))
    return rows.select("code_produit", "nom_produit", "quantite_disponible", "seuil_alerte", "niveau", "ratio")


def ordered_alerts(stocks: DataFrame) -> DataFrame:
    return stock_alerts(stocks).orderBy(F.col("niveau") != "critique", "ratio", "code_produit")


def reorder(stocks: DataFrame, sales: DataFrame, cover: int = 30, days: int = S.REORDER_DAYS) -> DataFrame:
    """For every product: rate of sale over the last days (strictly after), stock left in days, quantity to order, cost and urgency.

    The anchor is the last sale of all, returns included. A lead time of 0 or null is the default; a cost of 0 is unknown.
    """
    last = sales.agg(F.max("date_transaction").alias("derniere"))
    recent = sold(sales).crossJoin(F.broadcast(last)).where(F.col("date_transaction") > F.col("derniere") - F.expr(f"INTERVAL {days} DAYS"))  # last is one row
    units = recent.groupBy("code_produit").agg(F.sum("quantite").alias("vendues"))
    rate = F.coalesce(F.col("vendues"), F.lit(0)).cast("double") / days
    rows = stocks.join(units, "code_produit", "left").withColumn("rythme", rate)
    lead = F.when(F.coalesce(F.col("delai_livraison_jours"), F.lit(0)) == 0, S.LEAD_DEFAULT).otherwise(F.col("delai_livraison_jours")).cast("int")
    rows = rows.withColumn("delai", lead).withColumn("couverture", F.when(F.col("rythme") > 0, F.col("quantite_disponible") / F.col("rythme")))
    need = F.ceil(F.col("rythme") * (F.col("delai") + cover) - F.col("quantite_disponible"))
    rows = rows.withColumn("quantite_a_commander", F.when(F.col("rythme") > 0, F.greatest(F.lit(0), need)).otherwise(0).cast("long"))
    urgency = F.when(F.col("couverture") < F.col("delai"), "urgent").when(F.col("quantite_a_commander") > 0, "à prévoir").otherwise("suffisant")
    cost = F.when(F.col("cout_unitaire") != 0, (F.col("quantite_a_commander") * F.col("cout_unitaire")).cast("double"))
    return rows.select(
        "code_produit", F.col("nom_produit").alias("produit"), F.col("quantite_disponible").alias("stock_disponible"), F.round("rythme", 2).alias("ventes_par_jour"),
        F.round("couverture", 1).alias("jours_de_stock_restants"), F.col("delai").alias("delai_livraison_jours"), "quantite_a_commander", F.round(cost, 2).alias("cout_estime"), urgency.alias("urgence"),
    )


def reorder_list(rows: DataFrame, limit: int = S.REORDER_LIST) -> DataFrame:
    """What to show first: urgent, then to plan; days left ascending, 0 and unknown last."""
    rank = F.when(F.col("urgence") == "urgent", 0).when(F.col("urgence") == "à prévoir", 1).otherwise(2)
    left = F.when(F.coalesce(F.col("jours_de_stock_restants"), F.lit(0.0)) == 0, float("inf")).otherwise(F.col("jours_de_stock_restants"))
    return rows.where("urgence != 'suffisant'").orderBy(rank, left, "code_produit").limit(limit)


def reorder_totals(rows: DataFrame) -> DataFrame:
    """One row: urgent products, products to order, and their cost (null if no cost is known)."""
    todo = F.col("urgence") != "suffisant"
    return rows.agg(F.count_if(F.col("urgence") == "urgent").alias("produits_urgents"), F.count_if(todo).alias("produits_a_commander"), F.round(F.sum(F.when(todo, F.col("cout_estime").cast("decimal(20,2)"))).cast("double"), 2).alias("cout_total_estime"))
