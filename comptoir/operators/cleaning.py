"""From raw files to canonical rows: lenient casts, amounts, returns, duplicates, upserts and a quality report.

The order of a file's rows is a column, `ordinal`, so that "first" and "last" mean the same on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir.operators.cashflow import direction

#: Fixed value: invoice numbers of cancellations and credit notes.
RETURN_INVOICE = r"^(?:[CA]\d|AV(?:OIR|O)?[\s\-_/]*\d)"
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy H:mm", "M/d/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]


@dataclass
class SalesMapping:
    """Columns of a file by meaning; a price needs a quantity, else an amount is needed."""

    date_col: str
    client_col: str
    montant_col: str | None = None
    prix_unitaire_col: str | None = None
    quantite_col: str | None = None
    code_produit_col: str | None = None
    description_produit_col: str | None = None
    numero_facture_col: str | None = None
    pays_col: str | None = None
    nom_client_col: str | None = None
    email_client_col: str | None = None

    def check(self, columns: list[str]) -> None:
        missing = [v for v in vars(self).values() if v and v not in columns]
        if missing:
            raise ValueError(f"columns not in the file: {missing}")
        if not (self.montant_col or (self.prix_unitaire_col and self.quantite_col)):
            raise ValueError("an amount, or a quantity and a unit price, is needed")


def number(c: Column) -> Column:
    """A double, or null."""
    return F.trim(c.cast("string")).try_cast("double")


def timestamp(c: Column) -> Column:
    """The first format that fits, or null."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def client_code(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def amounts(quantity: Column | None, price: Column | None, amount: Column | None) -> tuple[Column, Column, Column]:
    """(quantity, unit price, fallback): quantity and price as given; else the price implied by the amount, with quantity 1 (or -1) and fallback true where the quantity is 0, missing or not a number; else one unit at the amount."""
    no = F.lit(False)
    if quantity is not None and price is not None:
        return number(quantity), number(price), no
    total = number(amount)
    one = F.when(total < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    if quantity is None:
        return one, F.abs(total), no
    n = number(quantity)
    bad = (n.isNull() | F.isnan(n) | (F.abs(n) <= 1e-9)) & total.isNotNull()
    return F.when(bad, one).otherwise(n), F.when(bad, F.abs(total)).otherwise(F.abs(F.try_divide(total, n))), bad


def is_return(quantity: Column, price: Column, invoice: Column | None) -> Column:
    """By a negative quantity or price, or by the invoice number."""
    by_sign = F.coalesce(quantity < 0, F.lit(False)) | F.coalesce(price < 0, F.lit(False))
    return by_sign if invoice is None else by_sign | F.coalesce(F.upper(F.trim(invoice.cast("string"))).rlike(RETURN_INVOICE), F.lit(False))


#: What makes two lines of sales the same.
SALE_KEYS = ["code_client_externe", "date_transaction", "p", "q", "code_produit", "numero_facture"]


def keep_one(rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """One row for each value of the keys: the first by ordinal, or the last. An aggregate of structs, so that a key repeated in a third of all rows is reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = (F.max_by if last else F.min_by)(F.struct(*others), F.col("ordinal")).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_row").getField(c).alias(c) for c in others]).select(*rows.columns)


def prepared_sales(raw: DataFrame, m: SalesMapping) -> DataFrame:
    """raw (with ordinal) in canonical columns, nothing dropped: rejet is true where date, customer or price is missing, or the quantity is."""
    m.check(raw.columns)
    at = lambda c: F.col(f"`{c}`") if c else None
    text = lambda c: F.trim(at(c).cast("string")) if c else F.lit(None).cast("string")
    quantity, price, fallback = amounts(at(m.quantite_col), at(m.prix_unitaire_col) if m.quantite_col else None, at(m.montant_col) if m.montant_col else at(m.prix_unitaire_col))
    rows = raw.select(
        "ordinal", timestamp(at(m.date_col)).alias("date_transaction"), client_code(at(m.client_col)).alias("code_client_externe"), quantity.alias("q"), price.alias("p"), fallback.alias("repli"),
        text(m.code_produit_col).alias("code_produit"), text(m.description_produit_col).alias("description_produit"), text(m.numero_facture_col).alias("numero_facture"), text(m.pays_col).alias("pays"), text(m.nom_client_col).alias("nom"), text(m.email_client_col).alias("email"),
    )
    missing = F.col("date_transaction").isNull() | F.coalesce(F.col("code_client_externe") == "", F.lit(True)) | F.col("p").isNull() | F.col("q").isNull()
    returned = is_return(F.col("q"), F.col("p"), F.col("numero_facture"))
    return rows.withColumns({"rejet": missing, "est_retour": returned}).withColumns({"q": F.abs("q"), "p": F.abs("p")})


def clean_sales(prepared: DataFrame) -> DataFrame:
    """Accepted rows without exact duplicates; the quantity truncated, the price in cents."""
    rows = keep_one(prepared.where("NOT rejet"), SALE_KEYS)
    return rows.withColumns({"quantite": F.col("q").cast("int"), "prix_unitaire": F.col("p").cast("decimal(12,2)")}).drop("q", "p", "rejet", "repli")


def quality(prepared: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: lines read, rejected, duplicate, imported, returns, and quantities that fell back to 1."""
    a = prepared.agg(F.count("*").alias("lues"), F.count_if("rejet").alias("rejetees"), F.count_if(F.col("repli") & ~F.col("rejet")).alias("replis"))
    b = kept.agg(F.count("*").alias("importees"), F.count_if("est_retour").alias("retours"))
    return a.crossJoin(b).withColumn("doublons", F.col("lues") - F.col("rejetees") - F.col("importees"))  # one row each


def quality_of(prepared: DataFrame) -> DataFrame:
    """As quality, of clean_sales(prepared), in one pass: rows are reduced to one for each duplicate key before they are counted."""
    kept = lambda c: F.when(~F.col("rejet"), F.col(c)).alias(c)
    each = prepared.select("rejet", "repli", "est_retour", "ordinal", *map(kept, SALE_KEYS)).groupBy("rejet", *SALE_KEYS)
    each = each.agg(F.count("*").alias("n"), F.count_if(F.col("repli") & ~F.col("rejet")).alias("r"), F.min_by("est_retour", "ordinal").alias("back"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = each.agg(zero(F.sum("n")).alias("lues"), zero(F.sum(F.when(F.col("rejet"), F.col("n")))).alias("rejetees"), zero(F.sum("r")).alias("replis"), F.count_if(~F.col("rejet")).alias("importees"), F.count_if(~F.col("rejet") & F.col("back")).alias("retours"))
    return got.withColumn("doublons", F.col("lues") - F.col("rejetees") - F.col("importees"))


def import_report(prepared: DataFrame, kept: DataFrame, clients: DataFrame) -> DataFrame:
    """One row: quality() with the customers that enriched_clients made or completed, and what to look at (avertissements)."""
    both = quality(prepared, kept).crossJoin(clients.agg(F.count_if(F.col("etat") == "cree").alias("clients_crees"), F.count_if(F.col("etat") == "complete").alias("clients_completes")))  # one row each
    said = {"rejetees": "lignes rejetées", "replis": "quantités ramenées à 1", "doublons": "doublons écartés"}
    notes = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(t))) for c, t in said.items()]))
    return both.withColumn("avertissements", notes)


def enriched_clients(known: DataFrame, sales: DataFrame) -> DataFrame:
    """known (code_client_externe, nom, email, pays) with new customers of sales, and gaps filled by the first value in file order; what is known is never overwritten. etat: cree, complete or inchange."""
    fields = ["nom", "email", "pays"]
    first = sales.groupBy("code_client_externe").agg(*[F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("ordinal"))).alias(f"_{c}") for c in fields])
    old = known.select("code_client_externe", *fields, F.lit(True).alias("_known"))
    both = old.join(first, "code_client_externe", "full_outer")
    filled = [F.col(c).isNull() & F.col(f"_{c}").isNotNull() for c in fields]
    state = F.when(F.col("_known").isNull(), "cree").when(filled[0] | filled[1] | filled[2], "complete").otherwise("inchange")
    return both.select("code_client_externe", *[F.coalesce(c, f"_{c}").alias(c) for c in fields], state.alias("etat"))


def upserted_stock(known: DataFrame, new: DataFrame, key: str = "code_produit", defaults: dict | None = None) -> DataFrame:
    """known with the rows of new (with ordinal; the last of a code holds): its non-null fields over what is known, defaults for new codes. Written as a new snapshot by the caller."""
    defaults = defaults or {"seuil_alerte": 10, "seuil_reapprovisionnement": 20, "delai_livraison_jours": 7, "quantite_disponible": 0}
    last = keep_one(new.where(F.col(key).isNotNull()), [key], last=True)
    both = known.alias("o").join(last.alias("n"), key, "full_outer")
    value = lambda c: F.coalesce(*([F.col(f"n.{c}")] if c in last.columns else []), F.col(f"o.{c}"), *([F.lit(defaults[c])] if c in defaults else []))
    return both.select(key, *[value(c).cast(known.schema[c].dataType).alias(c) for c in known.columns if c != key])


def cash_rows(raw: DataFrame, date_col: str, amount_col: str, kind_col: str | None = None, category_col: str | None = None) -> DataFrame:
    """Cash movements (ordinal, date_mouvement, type_mouvement, categorie, montant >= 0); rows without date or amount are left out."""
    amount = number(F.col(f"`{amount_col}`"))
    rows = raw.select("ordinal", F.to_date(timestamp(F.col(f"`{date_col}`"))).alias("date_mouvement"), direction(F.col(f"`{kind_col}`").cast("string") if kind_col else None, amount).alias("type_mouvement"), (F.col(f"`{category_col}`").cast("string") if category_col else F.lit(None).cast("string")).alias("categorie"), F.abs(amount).cast("decimal(14,2)").alias("montant"))
    return rows.where("date_mouvement IS NOT NULL AND montant IS NOT NULL")
