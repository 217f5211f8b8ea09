"""Small cases with known answers."""

from datetime import date

import numpy as np
import pytest
from comptoir.functions import stats
from comptoir.functions.stats import quantiles, quintile, winsor_cap
from comptoir.operators import cashflow, cleaning, clusters, forecast, indicators, segments, series
from comptoir.plans import readings, readonly_sql, segmentation, tools
from comptoir.sources import files
from comptoir.sources.stores import Cache, Store, export_csv
from comptoir.streaming import refresh
from pyspark.sql import functions as F


def test_quantiles_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=500).round(1)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0])
    assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.5, 0.99, 1.0]))
    assert quantiles(df.limit(0), "v", [0.5]) == [None]
    assert winsor_cap(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v") is None


def test_quintile_of_a_constant_is_three(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    assert {r["s"] for r in quintile(df, "v", "s").collect()} == {3}


@pytest.mark.parametrize("invoice, back", [("CMD-2024-001", False), ("ACH-17", False), ("ART-9", False), ("C536379", True), ("A563185", True), ("AV-2024-001", True), (" avoir 12", True), (None, False)])
def test_return_invoices(spark, invoice, back):
    df = spark.createDataFrame([(invoice, 1.0, 2.0)], "f string, q double, p double")
    assert df.select(cleaning.is_return(F.col("q"), F.col("p"), F.col("f"))).first()[0] is back


def test_csv_by_semicolon_and_latin(spark, tmp_path):
    path = tmp_path / "ventes.csv"
    path.write_bytes("Order Date;Client ID;Product Code;Product Name;Qty;Unit Price;Invoice Ref;Country\n2024-01-02;a1;P1;Thé;2;1500;F1;Cameroun\n2024-01-03;a2;P2;Café;-1;-1500;F2;Cameroun\n".encode("latin-1"))
    df = files.read_any(spark, str(path))
    got = files.detect_sales(df)
    assert (got["date_col"], got["client_col"], got["quantite_col"], got["prix_unitaire_col"], got["code_produit_col"]) == ("Order Date", "Client ID", "Qty", "Unit Price", "Product Code")
    assert df.where("`Product Name` = 'Thé'").count() == 1
    mapping = cleaning.SalesMapping("Order Date", "Client ID", prix_unitaire_col="Unit Price", quantite_col="Qty", numero_facture_col="Invoice Ref")
    rows = cleaning.clean_sales(cleaning.prepared_sales(files.with_ordinal(df), mapping)).collect()
    assert sorted((r["code_client_externe"], r["quantite"], float(r["prix_unitaire"]), r["est_retour"]) for r in rows) == [("A1", 2, 1500.0, False), ("A2", 1, 1500.0, True)]
    with pytest.raises(ValueError):
        cleaning.SalesMapping("nope", "Client ID", montant_col="Qty").check(df.columns)
    with pytest.raises(files.UnsupportedFile):
        files.read_any(spark, "x.pdf")
    assert files.preview(df)["n_lignes"] == 2


def test_balances_after_a_late_row(spark):
    rows = [(1, date(2024, 2, 1), 1, "encaissement", 50000), (2, date(2024, 2, 2), 2, "decaissement", 12000), (3, date(2024, 1, 1), 3, "encaissement", 20000)]
    df = spark.createDataFrame(rows, "mouvement_id int, date_mouvement date, sequence int, type_mouvement string, montant int")
    after = cashflow.balances(df)
    assert [r[0] for r in after.orderBy("date_mouvement").select("solde_apres_mouvement").collect()] == [20000, 70000, 58000]
    assert cashflow.changed_balances(cashflow.balances(df.where("mouvement_id < 3")), after).count() == 2


def test_segments_in_order_of_rules(spark):
    rows = [("a", 300, 5, 5, 5, 0), ("b", 300, 1, 1, 1, 0), ("c", 10, 1, 2, 2, 0), ("d", 10, 6, 5, 5, 1), ("e", 10, 2, 1, 5, 2), ("f", 10, 3, 4, 5, -1)]
    df = spark.createDataFrame(rows, "client_id string, recence_jours int, frequence_achats int, score_f int, score_m int, cluster_id int")
    got = {r["client_id"]: r["segment_rfm"] for r in segments.with_segment(df).collect()}
    assert got == {"a": "À risque", "b": "Perdu", "c": "Nouveau", "d": "Fidèle", "e": "Occasionnel", "f": "Atypique (B2B/grossiste)"}


def test_dbscan_finds_two_groups_and_noise(spark):
    points = [(i, 0.0 + i * 0.01, 0.0, 0.0) for i in range(8)] + [(i, 5.0 + i * 0.01, 0.0, 0.0) for i in range(10, 18)] + [(99, 50.0, 0.0, 0.0)]
    got = {r["client_id"]: r["cluster_id"] for r in clusters.dbscan(spark.createDataFrame(points, "client_id int, z_r double, z_f double, z_m double"), 0.1).collect()}
    assert {got[i] for i in range(8)} == {0} and {got[i] for i in range(10, 18)} == {1} and got[99] == -1


def test_models_follow_a_week(spark):
    y = np.array([100.0 + 2 * i + 10 * (i % 7 >= 5) for i in range(60)])
    for name in forecast.MODELS:
        got = forecast.one_forecast(y, 19_000, name, 14, True)
        assert len(got) == 14 and np.isfinite(got["valeur"].astype(float)).all() and (got["statut"] == "ok").all()
    assert (forecast.one_forecast(y[:3], 19_000, "arima", 5, True)["statut"] == "moyenne").all()
    with pytest.raises(ValueError):
        forecast.one_forecast(y, 0, "autre", 5, True)
    assert series.easter(2024) == date(2024, 3, 31)


@pytest.mark.parametrize("sql", ["SELECT count(*) FROM clients", "WITH a AS (SELECT pays FROM clients) SELECT pays FROM a", "SELECT pays FROM clients UNION SELECT code_produit FROM transactions", "SELECT nom FROM clients WHERE client_id IN (SELECT client_id FROM transactions)", "WITH a AS (SELECT client_id FROM clients), b AS (SELECT client_id FROM a) SELECT count(*) AS n, sum(1) OVER () FROM b GROUP BY client_id HAVING count(*) > 0 ORDER BY n LIMIT 3"])
def test_guard_accepts(spark, sql):
    assert readonly_sql.checked(spark, sql)


@pytest.mark.parametrize("sql", ["DROP TABLE clients", "DELETE FROM clients", "INSERT INTO clients VALUES (1)", "SELECT * FROM clients", "SELECT c.* FROM clients c", "SELECT email FROM clients", "SELECT nom FROM users", "SELECT nom FROM clients; SELECT 1", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT a FROM parquet.`/tmp/x`", "SELECT pg_sleep(9) FROM clients", "SET x = 1", "SELECT nom FROM clients WHERE EXISTS (SELECT 1 FROM users)", "SELECT a FROM secret_t WHERE ', secret_t AS (' <> ''", "WITH a AS (SELECT x FROM secret_t), secret_t AS (SELECT 1 AS x) SELECT x FROM a", "SELECT a FROM secret_t WHERE 1 IN (WITH secret_t AS (SELECT 1 AS x) SELECT x FROM secret_t)", "SELECT count(*), to_json(struct(*)) FROM clients", "SELECT upper(EMAIL) FROM clients", "SELECT nom FROM clients ORDER BY (SELECT max(a) FROM secret_t)", "SELECT current_user()"])
def test_guard_refuses(spark, sql):
    with pytest.raises(readonly_sql.Refused):
        readonly_sql.checked(spark, sql)


def test_tool_calls_and_bounds():
    assert [c.name for c in tools.calls_in('```json\n{"outil": "a", "parametres": {}}\n```\n```json\n{bad}\n```')] == ["a"]
    assert "erreur" in tools.execute(None, tools.Call("nope", {}))
    with pytest.raises(tools.BadTool):
        tools.bounded({"h": 500}, "h", 30, 7, 90)


def test_store_replaces_by_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("t", spark.range(3))
    store.append("t", spark.range(2))
    assert store.read("t").count() == 5
    store.replace("t", store.read("t").distinct())
    assert store.read("t").count() == 3 and store.version("t") == 1


def points_frame(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "client_id int, z_r double, z_f double, z_m double")


def brute_dbscan(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label = near.sum(1) >= least, np.full(len(x), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    return label


def test_dbscan_and_kth_distances_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(120, 3)), draw.normal(size=(60, 3)) * 0.05 + 4, np.zeros((7, 3)), [[30.0, 0, 0]]]).round(3)
    df = points_frame(spark, x)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {r["client_id"]: r["distance"] for r in clusters.knn_distances(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], np.sort(gap, axis=1)[:, 5])
    got = {r["client_id"]: r["cluster_id"] for r in clusters.dbscan(df, 0.6).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, 0.6, 5).tolist()
    four = points_frame(spark, np.arange(12).reshape(4, 3) * 0.01)
    assert {r["cluster_id"] for r in clusters.dbscan(four, 0.2).collect()} == {0}
    assert clusters.knn_distances(four, 9).count() == 4 and clusters.knn_distances(four.limit(1)).count() == 0 and clusters.knn_distances(four.limit(0)).count() == 0


def test_dbscan_follows_a_long_chain(spark):
    df = points_frame(spark, [(i * 0.1, 0, 0) for i in range(400)])
    assert {r["cluster_id"] for r in clusters.dbscan(df, 0.25).collect()} == {0}


def test_arima_likelihood_of_a_grid(spark):
    w, one = np.random.default_rng(2).normal(size=80), []
    p, q = np.array([0.3, -0.5, 0.9]), np.array([0.2, 0.4, -0.7])
    for a, b in zip(p, q):  # the covariance of an ARMA(1,1) and its determinant
        r = [(1 + 2 * a * b + b * b) / (1 - a * a)] + [(1 + a * b) * (a + b) / (1 - a * a) * a**k for k in range(79)]
        c = np.array([[r[abs(i - j)] for j in range(80)] for i in range(80)])
        one.append(0.5 * (80 * np.log(w @ np.linalg.solve(c, w) / 80) + np.linalg.slogdet(c)[1]))
    assert np.allclose(forecast._arma_loss(w, p, q)[0], one)


def movements(spark, rows):
    return spark.createDataFrame([(i, date(2024, 1, d), i, "encaissement" if v > 0 else "decaissement", abs(v)) for i, d, v in rows], "mouvement_id int, date_mouvement date, sequence int, type_mouvement string, montant int")


def test_streamed_movements_keep_what_was_appended(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.exists("tresorerie")
    store.append("tresorerie", cashflow.balances(movements(spark, [(1, 5, 100)])))
    assert store.exists("tresorerie")
    movements(spark, [(1, 5, 100), (2, 3, -30), (2, 3, -30)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mouvement_id int, date_mouvement date, sequence int, type_mouvement string, montant int").parquet(str(tmp_path / "in"))
    refresh.keep_balances(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert [(r[0], r[1]) for r in store.read("tresorerie").orderBy("date_mouvement").select("mouvement_id", "solde_apres_mouvement").collect()] == [(2, -30), (1, 70)]
    seen = []
    refresh.after_import(stream, lambda batch: seen.append(batch.count()), str(tmp_path / "ck2")).awaitTermination()
    assert seen == [3]


def test_streamed_daily_revenue(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS date_transaction, false AS est_retour, CAST(5 AS DECIMAL(9,2)) AS montant UNION ALL SELECT timestamp'2024-01-01 11:00:00', true, 9 UNION ALL SELECT timestamp'2024-01-01 12:00:00', false, 2").withColumn("montant", F.col("montant").cast("decimal(9,2)")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("date_transaction timestamp, est_retour boolean, montant decimal(9,2)").parquet(str(tmp_path / "in"))
    query = refresh.daily_revenue(stream).writeStream.format("memory").queryName("revenue").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(str(r["jour"]), float(r["ca"]), r["lignes"]) for r in spark.table("revenue").collect()] == [("2024-01-01", 7.0, 2)]


def test_results_are_kept_by_signature(spark, tmp_path):
    cache, made = Cache(Store(spark, str(tmp_path))), []
    sales = lambda n: indicators.signature(spark.sql(f"SELECT false AS est_retour, date'2024-01-01' AS date_transaction, {n} AS montant"))
    make = lambda: made.append(1) or spark.range(len(made))
    assert not cache.known("r", sales(1))
    assert [cache.get("r", sales(n), make).count() for n in (1, 1, 2, 1)] == [1, 1, 2, 1] and len(made) == 2 and cache.known("r", sales(2))


def test_csv_export_with_its_readme(spark, tmp_path):
    export_csv(spark.range(2), str(tmp_path / "x"), "Deux lignes.")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 2
    assert "Deux lignes." in {r[0] for r in spark.read.text(str(tmp_path / "x-README")).collect()}


def daily(spark, y):
    return spark.createDataFrame([(date.fromordinal(738000 + i), float(v)) for i, v in enumerate(y)], "jour date, y double")


def test_forecast_reading(spark):
    revenue = daily(spark, [100 + 10 * (i % 7 >= 5) for i in range(150)])
    points = forecast.forecasts(revenue.select(F.lit("ventes").alias("serie"), "jour", "y"), 21)
    got = readings.forecast_reading(revenue, points)
    assert got["disponible"] and got["sens_evolution"] == "stable" and got["fiabilite"] == "bonne" and abs(got["total_prevu"] - 21 * 102.86) < 150 and got["scenario_bas"] <= got["total_prevu"] <= got["scenario_haut"]
    drop = daily(spark, [100.0] * 120 + [5.0] * 30)
    got = readings.forecast_reading(drop, forecast.forecasts(drop.select(F.lit("ventes").alias("serie"), "jour", "y"), 21))
    assert any("import" in c for c in got["conseils"])
    assert not readings.forecast_reading(revenue.limit(3), forecast.forecasts(revenue.limit(3).select(F.lit("ventes").alias("serie"), "jour", "y"), 5))["disponible"]
    bounds = spark.createDataFrame([(10.0, 8.0, 12.0), (10.0, 6.0, 14.0)], "valeur double, borne_basse double, borne_haute double")
    assert readings.interval_width(bounds).first()[0] == 0.6
    assert [readings.dependence(spark.createDataFrame([(n, k)], "nb_clients int, nb_clients_80pct int")).first()["lecture"] for n, k in ((10, 2), (10, 4), (10, 8))] == ["forte dépendance à quelques clients", "concentration courante", "revenu réparti"]


def test_chosen_k_is_below_the_number_of_points(spark):
    got = segmentation.fit(points_frame(spark, [(0, 0, 0), (0, 0, 1), (9, 9, 9)]), "kmeans", starts=2)
    assert [d["k"] for d in got.diagnostics] == [2] and got.n_groupes == 2
    assert segmentation.fit(points_frame(spark, [(0, 0, 0), (0, 0, 1), (9, 9, 9)]), "dbscan").diagnostics == []


def test_import_report_counts_customers(spark):
    prepared = spark.createDataFrame([(False, True), (True, False), (False, False)], "rejet boolean, repli boolean")
    kept = spark.createDataFrame([(False,)], "est_retour boolean")
    clients = spark.createDataFrame([("cree",), ("complete",), ("inchange",), ("cree",)], "etat string")
    got = cleaning.import_report(prepared, kept, clients).first()
    assert (got["lues"], got["rejetees"], got["doublons"], got["clients_crees"], got["clients_completes"]) == (3, 1, 1, 2, 1) and len(got["avertissements"]) == 3


def test_naive_errors_equal_numpy(spark):
    y = np.random.default_rng(8).gamma(2, 50, 97) + 30 * (np.arange(97) % 7 == 5)
    test = max(3, int(97 * 0.2))
    train, last = y[:-test], y[-test:]
    scale = np.mean(np.abs(train[7:] - train[:-7]))
    guesses = {"moyenne": np.full(test, train.mean()), "semaine_precedente": y[97 - test - 7 : 97 - 7], "semaine_repetee": np.resize(train[-7:], test)}
    got = {r["modele"]: r for r in series.naive_errors(daily(spark, y)).collect()}
    for name, p in guesses.items():
        gap = np.abs(last - p)
        assert np.allclose([got[name]["rmse"], got[name]["mae"], got[name]["mase"]], [np.sqrt(np.mean(gap**2)), gap.mean(), gap.mean() / scale], atol=1e-4)


def test_quintiles_of_several_columns_equal_those_of_one(spark):
    draw = np.random.default_rng(9)
    rows = [(i, int(draw.integers(5)), float(draw.normal()), 7) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a int, b double, c int")
    got = {r["i"]: (r["x"], r["y"], r["z"]) for r in stats.quintiles(df, {"a": ("x", True), "b": ("y", False), "c": ("z", False)}).collect()}
    one = df
    for c, out, turned in (("a", "x", True), ("b", "y", False), ("c", "z", False)):
        one = stats.quintile(one, c, out, turned)
    assert got == {r["i"]: (r["x"], r["y"], r["z"]) for r in one.collect()} and {z for _, _, z in got.values()} == {3}
    assert stats.quintiles(df.limit(0), {"a": ("x", False)}).count() == 0


def test_quality_in_one_pass_equals_that_of_two(spark):
    rows = [(1, "a", 1.0, False, False, True), (2, "a", 1.0, False, True, False), (3, "b", 2.0, True, True, True), (4, "c", None, False, True, True), (5, "c", None, False, False, False)]
    prepared = spark.createDataFrame(rows, "ordinal int, code_client_externe string, p double, rejet boolean, repli boolean, est_retour boolean").selectExpr("*", "DATE '2024-01-01' AS date_transaction", "1D AS q", "'x' AS code_produit", "CAST(NULL AS STRING) AS numero_facture")
    want = cleaning.quality(prepared, cleaning.clean_sales(prepared)).first().asDict()
    assert cleaning.quality_of(prepared).first().asDict() == want and want["doublons"] == 2 and want["retours"] == 2
    assert cleaning.quality_of(prepared.limit(0)).first()["lues"] == 0
