"""Cash: directions, balances, back-filled rows, alerts and what-if projections."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.functions.stats import running
from comptoir.session import cut
from comptoir.sources.stores import Store

#: Texts that say a movement is a receipt.
RECEIPTS = ["encaissement", "credit", "in", "entree", "recette"]
RECEIPT_PARTS = "encaiss|crédit|credit"


def direction(kind: Column | None, amount: Column) -> Column:
    """By the text if there is one, else by the sign of the amount. A blank cell of a mapped column goes by the sign too."""
    by_sign = F.when(amount >= 0, "encaissement").otherwise("decaissement")
    if kind is None:
        return by_sign
    said = F.lower(F.trim(kind))
    return F.when(kind.isNull() | (said == ""), by_sign).when(said.isin(RECEIPTS) | said.rlike(RECEIPT_PARTS), "encaissement").otherwise("decaissement")


def signed(amount: str = "montant", kind: str = "type_mouvement") -> Column:
    return F.when(F.col(kind) == "encaissement", F.col(amount)).otherwise(-F.col(amount))


def balances(cash: DataFrame, order: str = "date_mouvement", ties: tuple = ("sequence",), opening: Decimal | float | int = 0) -> DataFrame:
    """Every movement with the balance after it, from `opening` on, in order of (date, sequence). Days are dealt in bins and busy days by their sequence, so no task sees all rows."""
    rows = cash.withColumn("_day", F.datediff(order, F.lit("1970-01-01").cast("date")))
    got = running(rows, "_day", {"solde_apres_mouvement": signed()}, ties=ties).drop("_day")
    if not opening:
        return got
    kind = got.schema["solde_apres_mouvement"].dataType
    return got.withColumn("solde_apres_mouvement", (F.col("solde_apres_mouvement") + F.lit(opening)).cast(kind))


def day_totals(cash: DataFrame, day: str = "date_mouvement") -> DataFrame:
    """Rows (day, flux, mouvements)."""
    return cash.groupBy(day).agg(F.sum(signed()).alias("flux"), F.count("*").alias("mouvements"))


def merged_balances(store: Store, batch: DataFrame, name: str = "tresorerie", day: str = "date_mouvement", key: str = "mouvement_id") -> dict:
    """Adds movements to a table of balances and makes anew those from the earliest new day on.

    Earlier days are neither read nor written: the balance that they leave is the sum of day totals kept beside them.
    Known ids and repeats within the batch add nothing. A movement without a day comes before all days,
    so that it makes everything anew, as does a table without day totals. Returns the number of new movements, the day from which
    balances were made (None: all), and how many known movements got another balance.
    """
    batch = batch.dropDuplicates([key])
    known = store.read(name) if store.exists(name) else None
    fresh = cut(batch if known is None else batch.join(known.select(key), key, "left_anti"))
    n, dated, first = fresh.agg(F.count("*"), F.count(day), F.min(day)).first()
    if not n:
        return {"nouveaux": 0, "depuis": None, "ajustes": 0}
    kept = known is not None and all(v for v, *_ in store.segments(name))  # version 0 was appended without totals
    if known is None or n > dated or not kept:
        rows = fresh if known is None else known.drop("solde_apres_mouvement").unionByName(fresh)
        made = cut(balances(cut(rows)))
        store.replace(name, made, {"totaux": day_totals(made, day)}, day)
        old, since = known, None
    else:
        since = str(first)
        old = cut(known.where(F.col(day) >= F.lit(first)))
        opening = store.read(name, "totaux").where(F.col(day).isNull() | (F.col(day) < F.lit(first))).agg(F.sum("flux")).first()[0]
        made = cut(balances(cut(old.drop("solde_apres_mouvement").unionByName(fresh)), opening=opening or 0))
        store.replace_from(name, made, day, since, {"totaux": day_totals(made, day)})
    changed = 0 if old is None or "solde_apres_mouvement" not in old.columns else changed_balances(old, made, key).count()
    return {"nouveaux": n, "depuis": since, "ajustes": changed}


def changed_balances(before: DataFrame, after: DataFrame, key: str = "mouvement_id") -> DataFrame:
    """Movements known before whose balance is another after a back-fill."""
    old = before.select(key, F.col("solde_apres_mouvement").alias("ancien"))
    return after.join(old, key).where(F.abs(F.col("solde_apres_mouvement").cast("double") - F.col("ancien").cast("double")) > 1e-9).select(key, "ancien", F.col("solde_apres_mouvement").alias("nouveau"))


def daily_net(cash: DataFrame) -> DataFrame:
    return cash.groupBy(F.col("date_mouvement").alias("jour")).agg(F.sum(signed()).alias("flux"))


def spine(days: DataFrame, day: str = "jour") -> DataFrame:
    """Every day between the first and the last."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias(day))


def daily_balance(cash: DataFrame) -> DataFrame:
    """The balance at the end of every calendar day; days without movements carry it on. Aggregated to days first: the window then sees one row a day."""
    net = daily_net(cash)
    rows = spine(net).join(net, "jour", "left").withColumn("flux", F.coalesce("flux", F.lit(0)))
    return rows.withColumn("solde", F.sum("flux").over(W.orderBy("jour").rowsBetween(W.unboundedPreceding, 0)))


def by_category(cash: DataFrame) -> DataFrame:
    """Day, direction and category with their total; zero totals are dropped."""
    return cash.groupBy("date_mouvement", "type_mouvement", "categorie").agg(F.sum("montant").alias("montant")).where("montant != 0")


def alert(points: DataFrame, critical: float = 0.0, margin: float | None = None) -> DataFrame:
    """One row from a projection (jour, valeur): its lowest point (the first on ties) against the critical level and a margin of caution."""
    low = F.min_by(F.struct("jour", "valeur"), F.struct("valeur", "jour"))
    spread = F.greatest((F.max("valeur") - F.min("valeur")) * S.CASH_MARGIN, F.lit(1.0)) if margin is None else F.lit(float(margin))
    got = points.agg(low.alias("bas"), spread.alias("marge"), F.count("*").alias("n"))
    value = F.col("bas.valeur")
    level = F.when(F.col("n") == 0, "ok").when(value < critical, "risque_deficit").when(value < critical + F.col("marge"), "vigilance").otherwise("ok")
    return got.select(F.coalesce(F.col("bas.jour"), F.current_date()).alias("date_alerte"), F.round(F.coalesce(value, F.lit(0.0)), 2).alias("solde_projete"), F.lit(float(critical)).alias("seuil_critique"), level.alias("niveau"))


def what_if(points: DataFrame, delta: Column) -> DataFrame:
    """A projection (i from 1, jour, valeur) with a change of sales received evenly over the horizon. delta: total change."""
    n = points.agg(F.max("i").alias("_n"))
    return points.crossJoin(F.broadcast(n)).withColumn("valeur", F.col("valeur") + delta * F.col("i") / F.col("_n")).drop("_n")  # one row
