"""Sales, stock and cash files from two well-known kinds of source: a star-schema dump and an order-processing database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.functions.text import client_code, invoice_number, product_code, without_prefix
from comptoir.sources.accounts import ACTUAL, ORGANISATIONS, AccountMap


def current_products(products: DataFrame, key: str = "ProductAlternateKey", version: str = "ProductKey") -> DataFrame:
    """The latest version of each article."""
    return products.groupBy(key).agg(F.max_by(F.struct(*[c for c in products.columns if c != key]), F.col(version).cast("int")).alias("x")).select(key, "x.*")


def star_sales(sales: DataFrame, customers: DataFrame, places: DataFrame, products: DataFrame) -> DataFrame:
    """Sales lines with customer, country and product; left joins, so that no line is lost."""
    where = customers.join(places, "GeographyKey", "left").select("CustomerKey", F.concat_ws(" ", "FirstName", "LastName").alias("Nom Client"), F.col("EmailAddress").alias("Email"), F.col("EnglishCountryRegionName").alias("Pays"), F.concat(F.lit("CLI-"), without_prefix(F.col("CustomerAlternateKey")).try_cast("int").cast("string")).alias("Code Client"))
    what = products.select("ProductKey", F.col("ProductAlternateKey").alias("Code Produit"), F.col("EnglishProductName").alias("Description"))
    rows = sales.join(where, "CustomerKey", "left").join(what, "ProductKey", "left")
    return rows.select(F.substring("OrderDate", 1, 10).alias("Date Vente"), "Code Client", "Nom Client", "Email", "Pays", F.col("SalesOrderNumber").alias("Numero Facture"), "Code Produit", "Description", F.col("OrderQuantity").try_cast("int").alias("Quantite"), F.col("UnitPrice").try_cast("double").alias("Prix Unitaire"))


def stock_snapshot(inventory: DataFrame, day: str) -> DataFrame:
    """The last row of each product at or before a day: rows (ProductKey, DateKey, UnitsBalance)."""
    return inventory.where(F.col("DateKey") <= day).groupBy("ProductKey").agg(F.max("DateKey").alias("DateKey"), F.max_by("UnitsBalance", "DateKey").try_cast("int").alias("UnitsBalance"))


def star_stock(inventory: DataFrame, products: DataFrame, sales: DataFrame, day: str) -> DataFrame:
    """Stock at a day of the articles that were sold; a negative balance counts 0."""
    sold_keys = sales.select("ProductKey").distinct()
    rows = stock_snapshot(inventory, day).join(sold_keys, "ProductKey", "left_semi").join(products, "ProductKey", "left")
    alert = F.coalesce(F.col("ReorderPoint").try_cast("int"), F.lit(10))
    return rows.select(F.col("ProductAlternateKey").alias("Code Produit"), F.col("EnglishProductName").alias("Nom Produit"), F.greatest(F.col("UnitsBalance"), F.lit(0)).alias("Quantite Disponible"), alert.alias("Seuil Alerte"), F.greatest(F.coalesce(F.col("SafetyStockLevel").try_cast("int"), F.lit(20)), alert).alias("Seuil Max"), F.col("StandardCost").try_cast("double").alias("Cout Unitaire"))


def star_cash(finance: DataFrame, accounts: AccountMap | None = None, organisations: list[str] = ORGANISATIONS, scenario: str = ACTUAL) -> DataFrame:
    """Cash by day and category, by an account map (the usual one if None); other accounts, organisations and scenarios are left out. Receipts are positive, payments negative, whatever their sign in the ledger's account."""
    known = (accounts or AccountMap.of()).frame(finance.sparkSession)
    rows = finance.where((F.col("ScenarioKey") == scenario) & F.col("OrganizationKey").isin(organisations)).join(F.broadcast(known), "AccountKey")  # a thousand rows at most
    total = F.round(F.sum(F.col("Amount").try_cast("double") * F.col("sens")), 2)
    return rows.groupBy(F.to_date(F.substring("Date", 1, 10)).alias("Date Mouvement"), F.col("categorie").alias("Categorie")).agg(total.alias("Montant")).where("Montant != 0")


def order_sales(rows: DataFrame) -> DataFrame:
    """Invoice lines; credit notes have a negative quantity."""
    n = F.col("quantity").try_cast("int")
    return rows.select(F.to_date("invoice_date").alias("Date Vente"), client_code(F.col("customer_id").try_cast("int")).alias("Code Client"), F.col("customer_name").alias("Nom Client"), F.col("country").alias("Pays"), invoice_number(F.col("invoice_id").try_cast("int")).alias("Numero Facture"), product_code(F.col("stock_item_id").try_cast("int")).alias("Code Produit"), F.col("description").alias("Description"), F.when(F.col("is_credit_note").try_cast("boolean"), -F.abs(n)).otherwise(n).alias("Quantite"), F.col("unit_price").try_cast("double").alias("Prix Unitaire"))


def order_stock(rows: DataFrame) -> DataFrame:
    """Stock with a target of at least the alert level; a negative quantity counts 0."""
    alert = F.col("reorder_level").try_cast("int")
    return rows.select(product_code(F.col("stock_item_id").try_cast("int")).alias("Code Produit"), F.col("stock_item_name").alias("Nom Produit"), F.greatest(F.col("quantity_on_hand").try_cast("int"), F.lit(0)).alias("Quantite Disponible"), alert.alias("Seuil Alerte"), F.greatest(F.col("target_stock_level").try_cast("int"), alert).alias("Seuil Max"), F.col("last_cost_price").try_cast("double").alias("Cout Unitaire"), F.col("lead_time_days").try_cast("int").alias("Delai Livraison"))


# What a transaction's type says, in order: words of it, its category, and whether cash comes in.
ORDER_CASH = [("refund", "Remboursements clients", -1), ("payment", "Encaissements clients", 1)]
SUPPLIER_CASH = [("refund", "Remboursements fournisseurs", 1), ("payment", "Paiements fournisseurs", -1)]


def order_cash(receipts: DataFrame, payments: DataFrame) -> DataFrame:
    """Cash by day and category from customer and supplier transactions (transaction_date, transaction_type, amount): receipts positive, payments and refunds to customers negative; invoices do not move cash."""

    def moved(rows: DataFrame, kinds: list[tuple[str, str, int]]) -> DataFrame:
        said = F.lower("transaction_type")
        pick = lambda at: reduce(lambda c, k: c.when(said.contains(k[0]), F.lit(k[at])), kinds, F.when(F.lit(False), F.lit(kinds[0][at])))
        return rows.select(F.to_date("transaction_date").alias("d"), pick(1).alias("c"), (pick(2) * F.abs(F.col("amount").try_cast("double"))).alias("v")).where("c IS NOT NULL")

    both = moved(receipts, ORDER_CASH).unionByName(moved(payments, SUPPLIER_CASH))
    return both.groupBy(F.col("d").alias("Date Mouvement"), F.col("c").alias("Categorie")).agg(F.round(F.sum("v"), 2).alias("Montant")).where("Montant != 0")


def simulated_stock(sales: DataFrame) -> DataFrame:
    """Stock rows anchored on what sold: thresholds from the mean quantity of a line; the quantity by a hash of the code."""
    each = sales.where("code_produit IS NOT NULL").groupBy("code_produit").agg(F.avg("quantite").alias("moyenne"))
    alert = F.greatest(F.lit(5), F.floor(F.col("moyenne") * 2).cast("int"))
    rows = each.select("code_produit", alert.alias("seuil_alerte"), F.floor(alert * 1.5).cast("int").alias("seuil_reapprovisionnement"))
    return rows.withColumn("quantite_disponible", F.pmod(F.xxhash64("code_produit"), F.col("seuil_reapprovisionnement") * 3).cast("int"))


def simulated_receipts(series: DataFrame, days: int = 180) -> DataFrame:
    """One receipt a day with sales, of the first days: rows (jour, montant) of rows (jour, ca)."""
    return series.where("ca > 0").orderBy("jour").limit(days).select("jour", F.col("ca").alias("montant"))
