"""Decision tools, briefing, report, context and the stored segmentation, over small tables with known answers."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from comptoir.functions import text
from comptoir.operators import clusters, forecast, indicators
from comptoir.plans import readings, segmentation, tools
from comptoir.sources.model import Model
from comptoir.sources.stores import Store
from pyspark.sql import functions as F

START = date(2024, 1, 1)


@pytest.fixture(scope="module")
def model(spark):
    sales = []
    for d in range(60):
        day = START + timedelta(d)
        sales += [(1 + d % 4, f"F{d}", "A", 10, 200.0 + 10 * (d % 7), day, False), (5, f"G{d}", "B", 2, 50.0, day, False)]
    sales.append((1, "AV1", "A", 1, 20.0, START + timedelta(30), True))
    transactions = spark.createDataFrame(sales, "client_id int, numero_facture string, code_produit string, quantite int, montant double, date_transaction date, est_retour boolean").withColumns({"montant": F.col("montant").cast("decimal(14,2)"), "date_transaction": F.col("date_transaction").cast("timestamp_ntz")})
    clients = spark.createDataFrame([(i, f"Client {i}", "FR") for i in range(1, 6)], "client_id int, nom string, pays string")
    stocks = spark.createDataFrame([("A", "Vis", 50, 60, 100, 7, 2.5), ("B", "Clou", 100, 10, 20, 7, 1.0), ("C", "Inutile", 15, 10, 20, 7, 1.0)], "code_produit string, nom_produit string, quantite_disponible int, seuil_alerte int, seuil_reapprovisionnement int, delai_livraison_jours int, cout_unitaire double").withColumn("cout_unitaire", F.col("cout_unitaire").cast("decimal(12,2)"))
    moves = [m for d in range(40) for m in ((START + timedelta(d), "encaissement", "ventes", 1000), (START + timedelta(d), "decaissement", "achats", 900))]
    cash = spark.createDataFrame(moves, "date_mouvement date, type_mouvement string, categorie string, montant int").withColumn("montant", F.col("montant").cast("decimal(14,2)"))
    return Model(clients, transactions, stocks, cash)


@pytest.fixture(scope="module")
def desk(spark, model):
    customers = spark.createDataFrame([(1, 5, 15, 3400.0, 4, 4, 4, 0, "Fidèle", 0.01), (5, 300, 8, 200.0, 1, 4, 1, 0, "À risque", 0.8)], "client_id int, recence_jours int, frequence_achats int, montant_total double, score_r int, score_f int, score_m int, cluster_id int, segment_rfm string, score_churn double")
    return tools.Desk(model, customers)


def test_reordering_tool(desk):
    got = tools.reordering(desk, {})
    a = next(p for p in got["produits"] if p["code_produit"] == "A")
    assert (a["urgence"], a["quantite_a_commander"], a["cout_estime"]) == ("urgent", 320, 800.0) and got["produits_urgents"] == 1
    assert [p["code_produit"] for p in tools.reordering(desk, {"code_produit": "C"})["produits"]] == []
    with pytest.raises(tools.BadTool):
        tools.reordering(desk, {"jours_couverture": 500})


def test_sales_tool_and_its_warning(desk):
    got = tools.sales_forecast(desk, {"horizon_jours": 21, "modele": "arbres"})
    assert got["disponible"] and got["modele"] == "arbres" and len(got["par_semaine"]) == 3 and abs(got["total_prevu"] - 21 * 280) < 21 * 40
    assert got["avertissements"] == ["Arbres : au-delà de 14 jours, les erreurs se cumulent."]
    assert forecast.warnings(("arbres",), 14) == [] == forecast.warnings(("arima",), 90)
    with pytest.raises(tools.BadTool):
        tools.sales_forecast(desk, {"modele": "oracle"})


def test_cash_tools(desk):
    got = tools.cash_forecast(desk, {"seuil_critique": 1_000_000})
    assert got["solde_actuel"] == 4000.0 and got["niveau"] == "risque_deficit" and "point bas" in got["message"]
    assert tools.cash_forecast(desk, {})["niveau"] == "ok"
    change = tools.sales_change(desk, {"variation_pct": -50, "horizon_jours": 10})
    assert change["ecart_de_ventes"] == pytest.approx(-0.5 * change["ventes_sans_changement"], abs=0.02) and change["ecart_par_jour"] == pytest.approx(change["ecart_de_ventes"] / 10, abs=0.01)
    assert change["scenario"]["solde_fin"] == pytest.approx(change["sans_changement"]["solde_fin"] + change["ecart_de_ventes"], abs=0.05)


def test_dispatch_reports_errors_as_data(desk):
    call = tools.calls_in('Oui.\n```json\n{"outil": "reapprovisionnement", "parametres": {"jours_couverture": 30}}\n```')[0]
    assert tools.execute(desk, call)["resultat"]["produits_urgents"] == 1
    assert "jours_couverture" in tools.execute(desk, tools.Call("reapprovisionnement", {"jours_couverture": 1}))["erreur"]


def test_briefing_orders_by_urgency_and_survives_a_failure(desk, model):
    got = tools.briefing(desk)
    assert [p["urgence"] for p in got] == sorted(p["urgence"] for p in got) and got[0] == {"urgence": 0, "sujet": "stocks", "n": 2}
    assert {p["sujet"] for p in got} == {"stocks", "clients", "ventes", "tresorerie"}
    broken = tools.Desk(Model(model.clients, model.transactions, model.stocks.drop("seuil_alerte"), model.cash))
    assert {p["sujet"] for p in tools.briefing(broken)} == {"ventes", "tresorerie"}


def test_report_and_context(desk, model):
    page = tools.report(desk)
    assert page.startswith("<!DOCTYPE html>") and "Vis" in page and "indisponible" not in page
    assert tools.report(tools.Desk(model)).count("Section indisponible") == 2  # no segments
    said = readings.snapshot(desk)
    assert "segment_rfm=Fidèle" in said and "code_produit=A" in said and len(said.splitlines()) < 80


def test_alerts_are_ordered_by_level_then_ratio(spark):
    stocks = spark.createDataFrame([("d", "D", 9, 10, 20), ("a", "A", 15, 10, 20), ("b", "B", 2, 10, 20), ("c", "C", 0, 0, 5), ("e", "E", 12, 10, 20), ("f", "F", 99, 10, 20)], "code_produit string, nom_produit string, quantite_disponible int, seuil_alerte int, seuil_reapprovisionnement int")
    assert [r["code_produit"] for r in indicators.ordered_alerts(stocks).collect()] == ["c", "b", "d", "e", "a"]


def profiles(spark, order=None):
    """Loyal, at risk and single-purchase customers."""
    draw, sales, last = np.random.default_rng(11), [], datetime(2024, 6, 1)
    plan = [("FID", 30, (8, 14), (0, 30), 200), ("RISK", 20, (2, 4), (200, 350), 60), ("OCC", 25, (1, 1), (0, 100), 30)]
    client = 0
    for name, n, buys, ago, value in plan:
        for _ in range(n):
            client += 1
            recent = int(draw.integers(*ago, endpoint=True))
            for k in range(int(draw.integers(*buys, endpoint=True))):
                sales.append((client, f"{name}{client}-{k}", "P", 1, float(round(value * draw.uniform(0.8, 1.2), 2)), last - timedelta(days=recent + (0 if k == 0 else int(draw.integers(0, 15)))), False))
    sales.append((1, "FIN", "P", 1, 200.0, last, False))
    rows = sales if order is None else [sales[i] for i in np.random.default_rng(order).permutation(len(sales))]
    return spark.createDataFrame(rows, "client_id int, numero_facture string, code_produit string, quantite int, montant double, date_transaction timestamp_ntz, est_retour boolean").withColumn("montant", F.col("montant").cast("decimal(14,2)"))


def test_segmentation_is_stored_and_a_dry_run_is_not(spark, tmp_path):
    store, sales = Store(spark, str(tmp_path)), profiles(spark)
    got, row = segmentation.stored(store, sales, dry_run=True, algorithm="kmeans", starts=3)
    assert not store.exists("clients_segmentes") and not store.exists("historique_segmentation")
    assert row.first()["k_choisi"] == got.fits[0].k == 3 and got.fits[0].silhouette > 0.5
    segments = {(r["segment_rfm"], (r["client_id"] - 1) // 30 if r["client_id"] <= 30 else 1 if r["client_id"] <= 50 else 2) for r in got.clients.collect()}
    assert {s for s, g in segments if g == 1} == {"À risque"} and {s for s, g in segments if g == 2} == {"Nouveau"} and ("Fidèle", 0) in segments
    segmentation.stored(store, sales, algorithm="kmeans", starts=3)
    segmentation.stored(store, sales, algorithm="kmeans", starts=3, k_max=2)
    history = store.read("historique_segmentation")
    assert history.count() == 2 and store.read("clients_segmentes").count() == 75
    last = segmentation.latest(history).first()
    assert last["k_choisi"] == 2 and json.loads(last["repartition_segments"]) and [d["k"] for d in json.loads(last["diagnostics"])] == [2]
    assert segmentation.latest(history.limit(0)).count() == 0


def test_auto_mode_takes_the_best_ranked(spark):
    got = segmentation.run(profiles(spark), starts=3)
    table = {r["algorithme"]: r for r in got.comparison.collect()}
    best = [a for a, r in table.items() if r["rang"] == 1]
    assert best == [got.algorithm] and table[got.algorithm]["eligible"] and len(got.fits) == 3
    assert any(s.startswith("Retenu") for s in got.sentences) and sum("silhouette" in s for s in got.sentences) >= 2
    assert got.clients.count() == 75 and got.clients.where("segment_rfm IS NULL").count() == 0


def test_order_of_rows_does_not_matter(spark):
    found = {(f.k, round(f.silhouette, 9)) for f in (segmentation.run(profiles(spark, order), algorithm="kmeans", starts=3).fits[0] for order in (1, 2))}
    assert len(found) == 1


def test_dbscan_without_a_usable_candidate_takes_the_elbow(spark, monkeypatch):
    draw = np.random.default_rng(1)
    one = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(draw.normal(size=(60, 3)) * 0.01)], "client_id int, z_r double, z_f double, z_m double")
    monkeypatch.setattr(clusters, "eps_candidates", lambda curve: [1e-7])  # every point is noise
    got = segmentation.fit(one, "dbscan")
    assert [d["silhouette"] for d in got.diagnostics] == [None]
    assert got.warnings == ["silhouette non calculable : coude retenu"] and got.eps == clusters.elbow(clusters.knn_distances(one)).first()["epsilon"]
    assert got.labels.count() == 60 and got.n_groupes >= 1
    with pytest.raises(ValueError):
        segmentation.fit(one, "autre")


def test_number_formats(spark):
    df = spark.createDataFrame([(7,), (12345,)], "n int")
    assert [r[0] for r in df.select(text.client_code(F.col("n"))).collect()] == ["CLI-0007", "CLI-12345"]
    assert [r[0] for r in df.select(text.invoice_number(F.col("n"))).collect()] == ["FAC-000007", "FAC-012345"]
    assert readings.percent(0.256) == "+26 %" and "1" in readings.amount(1234.5)
