"""Readings for the owner of a business: of a forecast, of cash, of concentration, and a bounded snapshot of all figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.operators import forecast, indicators, segments, series

#: Change against the recent level below which activity counts as stable.
STEADY = 0.05


def amount(v: float) -> str:
    return f"{v:,.0f}".replace(",", " ")


def percent(v: float) -> str:
    return f"{v * 100:+.0f} %"


def interval_width(points: DataFrame) -> DataFrame:
    """One row (incertitude): the mean width of the intervals over the mean forecast, null without intervals or a positive mean."""
    width = F.avg(F.col("borne_haute") - F.col("borne_basse"))
    return points.agg(F.when(F.avg("valeur") > 0, F.round(width / F.avg("valeur"), 6)).alias("incertitude"))


def forecast_reading(revenue: DataFrame, points: DataFrame) -> dict:
    """The most reliable model's forecast in plain figures, with advice. revenue: (jour, y); points: those of forecast.forecasts for one series.

    Everything that reaches the driver is one row for each question.
    """
    best = forecast.best_model(points).first()
    if best is None:
        return {"disponible": False, "resume": "Historique de ventes insuffisant.", "conseils": ["Importer quelques semaines de ventes."]}
    mine = points.where(F.col("modele") == best["meilleur_modele"])
    quality = mine.agg(F.max("rmse").alias("rmse"), F.max("mae").alias("mae"), F.max("moyenne_validation").alias("moyenne"))
    level = series.level_break(revenue, "y")
    got = {**series.indicators(mine, level, quality).first().asDict(), **level.first().asDict(), **quality.first().asDict(), **series.scenarios(mine, quality).first().asDict(), **interval_width(mine).first().asDict()}
    horizon, change = mine.count(), got["ecart_niveau"]
    direction = None if change is None else "hausse" if change > STEADY else "baisse" if change < -STEADY else "stable"
    agreement = None if best["dispersion"] is None else "incertaine" if best["divergent"] else "solide"
    said = {"hausse": "Prévoir les stocks d'une hausse des ventes.", "baisse": "Garder de la trésorerie et relancer les clients avant une baisse des ventes.", "stable": "Rien à changer : activité stable."}
    advice = [said[direction]] if direction else []
    if got["fiabilite"] == "faible" or agreement == "incertaine":
        advice.append("Ne pas fonder de gros engagement sur cette prévision.")
    if got["rupture"]:
        advice.append(f"Niveau récent très différent ({percent(got['variation'])}) : contrôler que l'import est complet.")
    summary = f"{amount(got['total_prevu'])} de ventes prévues en {horizon} jours" + (f", {percent(change)} face au rythme récent" if change is not None else "") + "."
    return {
        "disponible": True, "modele": best["meilleur_modele"], "horizon_jours": horizon, "resume": summary, "total_prevu": got["total_prevu"], "moyenne_jour": got["moyenne_jour"], "evolution": change, "sens_evolution": direction,
        "fiabilite": got["fiabilite"], "ecart_jour": got["mae"], "incertitude": got["incertitude"], "concordance": agreement, "scenario_bas": got["bas"], "scenario_haut": got["haut"], "conseils": advice,
    }


def cash_message(level: str, low: float, day: object, critical: float) -> str:
    """A sentence for an alert level."""
    place = f"point bas de {amount(low)} le {day}, pour un seuil de {amount(critical)}"
    return {"risque_deficit": f"Déficit possible : {place}.", "vigilance": f"Marge étroite : {place}."}.get(level, f"Pas d'alerte : {place}.")


def dependence(concentration: DataFrame) -> DataFrame:
    """One row (part, lecture) from indicators.pareto: the share of customers that makes 80 % of revenue, and how much hangs on them."""
    part = F.try_divide(F.col("nb_clients_80pct"), F.col("nb_clients"))
    said = F.when(part.isNull(), "sans clients").when(part <= 0.2, "forte dépendance à quelques clients").when(part <= 0.4, "concentration courante").otherwise("revenu réparti")
    return concentration.select(F.round(part, 6).alias("part"), said.alias("lecture"))


def snapshot(desk, n: int = 5) -> str:
    """The state of the business in a few lines for a prompt: figures, best customers, segments with examples, stocks, reordering, forecasts. Bounded tables only; a part that fails is left out."""

    def lines(df: DataFrame, limit: int = n) -> list[str]:
        return ["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in df.limit(limit).collect()]

    sales = desk.model.transactions
    parts = {
        "Indicateurs": lambda: lines(indicators.global_figures(desk.model)),
        "Meilleurs clients": lambda: lines(indicators.top_clients(desk.model, n)),
        "Dépendance": lambda: lines(dependence(indicators.pareto(sales))),
        "Segments": lambda: lines(segments.summary(desk.clients), len(S.ACTIONS)),
        "Exemples par segment": lambda: lines(segments.examples(desk.clients, n).select("segment_rfm", "client_id", "montant_total", "rang"), n * len(S.ACTIONS)),
        "Alertes de stock": lambda: lines(indicators.ordered_alerts(desk.model.stocks)),
        "Commandes à passer": lambda: lines(indicators.reorder_list(indicators.reorder(desk.model.stocks, sales), n)),
        "Niveau des ventes": lambda: lines(series.level_break(desk.revenue, "y")),
    }
    out = []
    for title, make in parts.items():
        try:
            out += [title, *(make() or ["  aucun"])]
        except Exception:  # noqa: S112  the other parts still hold
            continue
    return "\n".join(out)
