"""Decision tools with checked parameters, the briefing and the report, over the canonical tables."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.operators import cashflow, forecast, indicators, segments, series
from comptoir.plans import readings
from comptoir.sources.model import Model


class BadTool(ValueError):
    """An unknown tool or parameter."""


def bounded(params: dict, name: str, default: float, low: float, high: float) -> float:
    value = params.get(name, default)
    if not isinstance(value, int | float) or not low <= value <= high:
        raise BadTool(f"{name} must lie between {low} and {high}")
    return value


class Desk:
    """Shared inputs, each made once when first asked for."""

    def __init__(self, model: Model, clients: DataFrame | None = None) -> None:
        self.model, self.clients = model, clients

    @cached_property
    def revenue(self) -> DataFrame:
        return series.winsorised_revenue(series.daily_revenue(self.model.transactions))[0].select(F.lit("ventes").alias("serie"), "jour", "y").cache()  # a row a day

    @cached_property
    def balance(self) -> DataFrame:
        return cashflow.daily_balance(self.model.cash).select(F.lit("solde").alias("serie"), "jour", F.col("solde").cast("double").alias("y")).cache()  # a row a day

    def sales_points(self, horizon: int, models: tuple[str, ...] = ("additif", "arima", "arbres")) -> DataFrame:
        return forecast.forecasts(self.revenue, horizon, models)

    def cash_points(self, horizon: int) -> DataFrame:
        return forecast.forecasts(self.balance, horizon, ("arima",), floor=False)


def sales_forecast(desk: Desk, params: dict) -> dict:
    horizon = int(bounded(params, "horizon_jours", 30, 7, 90))
    models = (params["modele"],) if params.get("modele", "auto") != "auto" else ("additif", "arima", "arbres")
    if set(models) - set(forecast.MODELS):
        raise BadTool(f"unknown model {models[0]!r}")
    points = desk.sales_points(horizon, models).cache()  # a row for each day ahead and model
    best = forecast.best_model(points).first()
    if best is None:
        return {"disponible": False, "message": "Historique trop court."}
    mine = points.where(F.col("modele") == best["meilleur_modele"])
    weeks = [r.asDict() for r in series.weekly(mine).orderBy("semaine").collect()]  # 13 weeks at most
    return {"disponible": True, "modele": best["meilleur_modele"], "horizon_jours": horizon, "total_prevu": round(sum(w["ventes_prevues"] for w in weeks), 2), "par_semaine": weeks, "divergent": best["divergent"], "avertissements": forecast.warnings((best["meilleur_modele"],), horizon)}


def _cash(desk: Desk, horizon: int, critical: float, delta: float = 0.0) -> dict:
    points = desk.cash_points(horizon).select("i", "jour", "valeur")
    points = (cashflow.what_if(points, F.lit(delta)) if delta else points).cache()  # a row for each day ahead
    told = cashflow.alert(points, critical).first().asDict()
    now = desk.balance.agg(F.max_by("y", "jour").alias("y")).first()["y"]
    last = points.agg(F.max_by("valeur", "i").alias("y")).first()["y"]
    two = lambda v: None if v is None else round(v, 2)
    return {"solde_actuel": two(now), "solde_fin": two(last), **told, "message": readings.cash_message(told["niveau"], told["solde_projete"], told["date_alerte"], critical)}


def cash_forecast(desk: Desk, params: dict) -> dict:
    horizon = int(bounded(params, "horizon_jours", 30, 7, 90))
    return {"horizon_jours": horizon, **_cash(desk, horizon, float(params.get("seuil_critique", 0.0)))}


def sales_change(desk: Desk, params: dict) -> dict:
    horizon, percent = int(bounded(params, "horizon_jours", 30, 7, 90)), bounded(params, "variation_pct", 0, -90, 200)
    base = sales_forecast(desk, {"horizon_jours": horizon})
    if not base["disponible"]:
        return base
    delta, critical = base["total_prevu"] * percent / 100, float(params.get("seuil_critique", 0.0))
    return {"variation_pct": percent, "ventes_sans_changement": base["total_prevu"], "ecart_de_ventes": round(delta, 2), "ecart_par_jour": round(delta / horizon, 2), "sans_changement": _cash(desk, horizon, critical), "scenario": _cash(desk, horizon, critical, delta)}


def reordering(desk: Desk, params: dict) -> dict:
    rows = indicators.reorder(desk.model.stocks, desk.model.transactions, int(bounded(params, "jours_couverture", 30, 7, 120)))
    if params.get("code_produit") is not None:
        rows = rows.where(F.col("code_produit") == params["code_produit"])
    return {**indicators.reorder_totals(rows).first().asDict(), "produits": [r.asDict() for r in indicators.reorder_list(rows).collect()]}  # 15 rows at most


TOOLS: dict[str, Callable[[Desk, dict], dict]] = {"prevision_ventes": sales_forecast, "tresorerie_prevue": cash_forecast, "simulation_ventes": sales_change, "reapprovisionnement": reordering}


@dataclass
class Call:
    name: str
    params: dict


def calls_in(text: str, most: int = S.MAX_QUERIES) -> list[Call]:
    """Tool calls in fenced JSON blocks: {"outil": name, "parametres": {...}}."""
    out = []
    for block in re.findall(r"```(?:json|outil)?\s*(\{.*?\})\s*```", text, re.S):
        try:
            got = json.loads(block)
        except ValueError:
            continue
        if isinstance(got, dict) and isinstance(got.get("outil"), str):
            out.append(Call(got["outil"], got.get("parametres") or {}))
    return out[:most]


def execute(desk: Desk, call: Call) -> dict:
    """A tool's result; errors are data."""
    try:
        if call.name not in TOOLS:
            raise BadTool(f"unknown tool {call.name!r}: one of {sorted(TOOLS)}")
        return {"outil": call.name, "resultat": TOOLS[call.name](desk, call.params)}
    except Exception as error:
        return {"outil": call.name, "erreur": str(error).splitlines()[0][:300]}


def stock_point(stocks: DataFrame) -> DataFrame:
    """One row (urgence, sujet, n): urgent if a product is critical."""
    got = indicators.stock_alerts(stocks).agg(F.count_if(F.col("niveau") == "critique").alias("critiques"), F.count("*").alias("n"))
    return got.select(F.when(F.col("critiques") > 0, 0).when(F.col("n") > 0, 1).otherwise(2).alias("urgence"), F.lit("stocks").alias("sujet"), F.col("n").cast("long").alias("n"))


def client_point(clients: DataFrame) -> DataFrame:
    """One row (urgence, sujet, n) on the customers at risk."""
    got = clients.agg(F.count_if(F.col("segment_rfm") == S.RISQUE).alias("n"))
    return got.select(F.when(F.col("n") > 0, 1).otherwise(2).alias("urgence"), F.lit("clients").alias("sujet"), F.col("n").cast("long").alias("n"))


def break_point(revenue: DataFrame) -> DataFrame:
    """One row (urgence, sujet, n) on a break in the level of sales."""
    return series.level_break(revenue, "y").select(F.when(F.col("rupture"), 1).otherwise(2).alias("urgence"), F.lit("ventes").alias("sujet"), F.col("rupture").cast("long").alias("n"))


def cash_point(desk: Desk, horizon: int = 30) -> DataFrame:
    """One row (urgence, sujet, n): urgent if cash may run out within the horizon, n days ahead of the lowest point."""
    points = desk.cash_points(horizon).select("i", "jour", "valeur")
    low = cashflow.alert(points)
    place = points.agg(F.min_by("i", F.struct("valeur", "jour")).cast("long").alias("n"))
    level = F.when(F.col("niveau") == "risque_deficit", 0).when(F.col("niveau") == "vigilance", 1).otherwise(2)
    return low.crossJoin(place).select(level.alias("urgence"), F.lit("tresorerie").alias("sujet"), "n")  # one row each


def briefing(desk: Desk) -> list[dict]:
    """Points of attention by urgency; a source that fails is left out."""
    sources = [lambda: stock_point(desk.model.stocks), lambda: cash_point(desk), lambda: break_point(desk.revenue)]
    if desk.clients is not None:
        sources.append(lambda: client_point(desk.clients))
    out = []
    for make in sources:
        try:
            out.append(make().first().asDict())
        except Exception:  # noqa: S112  the others still hold
            continue
    return sorted(out, key=lambda p: p["urgence"])


def report(desk: Desk, rows: int = 15) -> str:
    """An HTML report of bounded tables; a section that fails says so and leaves the others."""
    sections = {
        "Indicateurs": lambda: indicators.global_figures(desk.model),
        "Concentration du chiffre d'affaires": lambda: indicators.pareto(desk.model.transactions),
        "Dépendance aux clients": lambda: readings.dependence(indicators.pareto(desk.model.transactions)),
        "Meilleurs clients": lambda: indicators.top_clients(desk.model),
        "Segments": lambda: segments.summary(desk.clients),
        "Lecture des segments": lambda: segments.reading(desk.clients),
        "Niveau des ventes": lambda: series.level_break(desk.revenue, "y"),
        "Alertes de stock": lambda: indicators.ordered_alerts(desk.model.stocks),
        "Réapprovisionnement": lambda: indicators.reorder_list(indicators.reorder(desk.model.stocks, desk.model.transactions)),
        "Trésorerie": lambda: cashflow.daily_balance(desk.model.cash).orderBy(F.desc("jour")),
    }
    out = []
    for title, make in sections.items():
        try:
            df = make()
            got = df.limit(rows).collect()
            cells = lambda row, tag: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in row)
            body = f"<table><tr>{cells(df.columns, 'th')}</tr>{''.join(f'<tr>{cells(r, 'td')}</tr>' for r in got)}</table>"
        except Exception as error:
            body = f"<p>Section indisponible : {html.escape(str(error).splitlines()[0][:120])}</p>"
        out.append(f"<h2>{html.escape(title)}</h2>{body}")
    return f"<!DOCTYPE html><html lang='fr'><meta charset='utf-8'><title>Rapport</title><h1>Rapport</h1>{''.join(out)}</html>"
