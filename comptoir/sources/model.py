"""The canonical tables over the driver's star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Model:
    """clients, transactions, stocks and cash; lazy, so that a query scans only the columns it uses."""

    clients: DataFrame
    transactions: DataFrame
    stocks: DataFrame
    cash: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_star(spark: SparkSession, sf_dir: str) -> Model:
    """Customers with their nation; order lines as sales; parts with derived stock levels; orders as receipts and lines as payments."""
    t = lambda name: table(spark, sf_dir, name)
    clients = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("nom"), F.col("n_name").alias("pays"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sales = lines.select(
        F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("numero_facture"), F.col("l_partkey").alias("code_produit"), F.col("l_quantity").cast("int").alias("quantite"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("montant"), F.col("o_orderdate").alias("date_transaction"), (F.col("l_returnflag") == "R").alias("est_retour"),
    )
    key = F.col("p_partkey")
    stocks = t("part").select(
        key.alias("code_produit"), F.col("p_name").alias("nom_produit"), ((key * 37) % 200).cast("int").alias("quantite_disponible"), (F.col("p_size") + 20).cast("int").alias("seuil_alerte"),
        ((F.col("p_size") + 20) * 2).cast("int").alias("seuil_reapprovisionnement"), (F.col("p_size") % 15).cast("int").alias("delai_livraison_jours"), F.col("p_retailprice").cast("decimal(12,2)").alias("cout_unitaire"),
    )
    paid_in = t("orders").select(F.to_date("o_orderdate").alias("date_mouvement"), F.lit("encaissement").alias("type_mouvement"), F.lit("vente").alias("categorie"), F.col("o_totalprice").cast("decimal(14,2)").alias("montant"))
    out = (F.col("l_extendedprice").cast("decimal(14,2)") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(14,2)")
    paid_out = t("lineitem").select(F.to_date("l_shipdate").alias("date_mouvement"), F.lit("decaissement").alias("type_mouvement"), F.lit("fournisseur").alias("categorie"), out.alias("montant"))
    return Model(clients, sales, stocks, paid_in.unionByName(paid_out))


#: The same tables in DuckDB SQL, as the start of a WITH clause.
SQL = """
clients AS (SELECT c_custkey AS client_id, c_name AS nom, n_name AS pays FROM customer JOIN nation ON c_nationkey = n_nationkey),
transactions AS (
  SELECT o_custkey AS client_id, o_orderkey AS numero_facture, l_partkey AS code_produit, CAST(l_quantity AS INTEGER) AS quantite,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS montant, o_orderdate AS date_transaction, l_returnflag = 'R' AS est_retour
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
stocks AS (
  SELECT p_partkey AS code_produit, p_name AS nom_produit, CAST((p_partkey * 37) % 200 AS INTEGER) AS quantite_disponible, CAST(p_size + 20 AS INTEGER) AS seuil_alerte,
    CAST((p_size + 20) * 2 AS INTEGER) AS seuil_reapprovisionnement, CAST(p_size % 15 AS INTEGER) AS delai_livraison_jours, CAST(p_retailprice AS DECIMAL(12,2)) AS cout_unitaire
  FROM part),
cash AS (
  SELECT CAST(o_orderdate AS DATE) AS date_mouvement, 'encaissement' AS type_mouvement, 'vente' AS categorie, CAST(o_totalprice AS DECIMAL(14,2)) AS montant FROM orders
  UNION ALL
  SELECT CAST(l_shipdate AS DATE), 'decaissement', 'fournisseur', CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(14,2)) FROM lineitem)
"""
