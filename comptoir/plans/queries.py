"""The registered queries: each operator over the driver's tables, with DuckDB SQL written apart from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.functions import text
from comptoir.functions.stats import discrete_quantile, winsorised
from comptoir.operators import cashflow, cleaning, clusters, forecast, indicators, joins, segments, series, sketches
from comptoir.plans import readonly_sql, segmentation, tools
from comptoir.session import cut
from comptoir.sources import exports, files
from comptoir.sources.model import SQL, Model, from_star, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *more: str):
    """Registers a function of the canonical model under its name, with its oracle: more are further CTEs of the WITH clause."""

    def add(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(from_star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = "WITH " + ",".join([SQL, *more]) + sql
        return f

    return add


def raw_query(sql: str | None = None, *more: str):
    """As query, over the driver's own tables: a function of (spark, folder)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ",".join(more) if more else "") + sql
        return f

    return add


# --- key figures, customers, products ---


@query("""SELECT (SELECT count(*) FROM clients) AS nb_clients, (SELECT count(*) FROM transactions WHERE NOT est_retour) AS nb_transactions,
  (SELECT CAST(sum(montant) AS DOUBLE) FROM transactions WHERE NOT est_retour) AS chiffre_affaires_total, (SELECT CAST(sum(quantite_disponible) AS BIGINT) FROM stocks) AS stock_total_unites,
  (SELECT CAST(sum(CASE WHEN type_mouvement = 'encaissement' THEN montant ELSE -montant END) AS DOUBLE) FROM cash) AS solde_tresorerie_estime""")
def kpis_globaux(m):
    return indicators.global_figures(m)


PER_CLIENT = "per AS (SELECT client_id, sum(montant) AS ca, count(DISTINCT numero_facture) AS nb_factures FROM transactions WHERE NOT est_retour AND client_id IS NOT NULL GROUP BY client_id)"


@query("""SELECT client_id, nom AS client, CAST(ca AS DOUBLE) AS chiffre_affaires, round(CAST(ca AS DOUBLE) / (SELECT CAST(sum(ca) AS DOUBLE) FROM per), 6) AS part_ca, nb_factures
  FROM (SELECT * FROM per ORDER BY ca DESC, client_id LIMIT 10) t LEFT JOIN clients USING (client_id)""", PER_CLIENT)
def top_clients_ca(m):
    return indicators.top_clients(m)


@query("""SELECT max(n) AS nb_clients, min(rn) FILTER (WHERE cum >= total * 0.8) AS nb_clients_80pct, CAST(max(total) AS DOUBLE) AS ca_total_clients FROM (
  SELECT sum(ca) OVER (ORDER BY ca DESC, client_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY ca DESC, client_id) AS rn, sum(ca) OVER () AS total, count(*) OVER () AS n FROM per) t""", PER_CLIENT)
def pareto_80(m):
    return indicators.pareto(m.transactions)


@query("SELECT count(*) AS n, max(date_transaction) AS derniere, CAST(sum(montant) AS DOUBLE) AS total FROM transactions WHERE NOT est_retour")
def data_signature(m):
    return indicators.signature(m.transactions)


ALERTS = """alerts AS (SELECT code_produit, nom_produit, quantite_disponible, seuil_alerte,
  CASE WHEN quantite_disponible <= seuil_alerte THEN 'critique' WHEN quantite_disponible <= seuil_reapprovisionnement THEN 'attention' ELSE 'ok' END AS niveau,
  round(CAST(quantite_disponible AS DOUBLE) / seuil_alerte, 6) AS ratio FROM stocks)"""


@query("SELECT * FROM alerts WHERE niveau <> 'ok'", ALERTS)
def stock_alerts(m):
    return indicators.stock_alerts(m.stocks)


REORDER = """recent AS (SELECT code_produit, sum(quantite) AS vendues FROM transactions WHERE NOT est_retour AND date_transaction > (SELECT max(date_transaction) FROM transactions) - INTERVAL 30 DAY GROUP BY code_produit),
rated AS (SELECT s.*, coalesce(CAST(vendues AS DOUBLE), 0) / 30 AS rythme, CASE WHEN delai_livraison_jours = 0 THEN 7 ELSE delai_livraison_jours END AS delai FROM stocks s LEFT JOIN recent USING (code_produit)),
need AS (SELECT *, CASE WHEN rythme > 0 THEN quantite_disponible / rythme END AS couverture, CAST(CASE WHEN rythme > 0 THEN greatest(0, ceil(rythme * (delai + 30) - quantite_disponible)) ELSE 0 END AS BIGINT) AS q FROM rated),
reorder AS (SELECT code_produit, nom_produit AS produit, quantite_disponible AS stock_disponible, round(rythme, 2) AS ventes_par_jour, round(couverture, 1) AS jours_de_stock_restants, delai AS delai_livraison_jours, q AS quantite_a_commander,
  round(CASE WHEN cout_unitaire <> 0 THEN CAST(q * cout_unitaire AS DOUBLE) END, 2) AS cout_estime, CASE WHEN couverture < delai THEN 'urgent' WHEN q > 0 THEN 'à prévoir' ELSE 'suffisant' END AS urgence FROM need)"""


@query("SELECT * FROM reorder", REORDER)
def reorder_recommendations(m):
    return indicators.reorder(m.stocks, m.transactions)


@query("""SELECT * FROM reorder WHERE urgence <> 'suffisant' ORDER BY CASE urgence WHEN 'urgent' THEN 0 ELSE 1 END, CASE WHEN coalesce(jours_de_stock_restants, 0) = 0 THEN 1e300 ELSE jours_de_stock_restants END, code_produit LIMIT 15""", REORDER)
def reorder_top(m):
    return indicators.reorder_list(indicators.reorder(m.stocks, m.transactions))


@query("SELECT count(*) FILTER (WHERE urgence = 'urgent') AS produits_urgents, count(*) FILTER (WHERE urgence <> 'suffisant') AS produits_a_commander, round(CAST(sum(CAST(cout_estime AS DECIMAL(20,2))) FILTER (WHERE urgence <> 'suffisant') AS DOUBLE), 2) AS cout_total_estime FROM reorder", REORDER)
def reorder_totals(m):
    return indicators.reorder_totals(indicators.reorder(m.stocks, m.transactions))


# --- cash ---

SEQ = "seq AS (SELECT o_orderkey AS mouvement_id, CAST(o_orderdate AS DATE) AS date_mouvement, o_orderkey AS sequence, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'decaissement' ELSE 'encaissement' END AS type_mouvement, CAST(o_totalprice AS DECIMAL(14,2)) AS montant FROM orders)"


def _movements(spark, d):
    out = F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").like("2%")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("mouvement_id"), F.to_date("o_orderdate").alias("date_mouvement"), F.col("o_orderkey").alias("sequence"), F.when(out, "decaissement").otherwise("encaissement").alias("type_mouvement"), F.col("o_totalprice").cast("decimal(14,2)").alias("montant"))


BALANCE = "CAST(sum(CASE WHEN type_mouvement = 'encaissement' THEN montant ELSE -montant END) OVER (ORDER BY date_mouvement, sequence ROWS UNBOUNDED PRECEDING) AS DOUBLE)"


@raw_query(f"SELECT mouvement_id, date_mouvement, {BALANCE} AS solde FROM seq", SEQ)
def cash_running_balance(spark, d):
    return cashflow.balances(_movements(spark, d)).select("mouvement_id", "date_mouvement", F.col("solde_apres_mouvement").cast("double").alias("solde"))


@raw_query(f"""SELECT b.mouvement_id, a.solde AS ancien, b.solde AS nouveau FROM (SELECT mouvement_id, {BALANCE} AS solde FROM seq WHERE mouvement_id % 10 <> 0) a
  JOIN (SELECT mouvement_id, {BALANCE} AS solde FROM seq) b USING (mouvement_id) WHERE abs(a.solde - b.solde) > 1e-9""", SEQ)
def cash_backfill_changes(spark, d):
    """A tenth of the movements comes late; these are the earlier ones whose balance it changes."""
    rows = _movements(spark, d)
    got = cashflow.changed_balances(cashflow.balances(rows.where("mouvement_id % 10 != 0")), cashflow.balances(rows))
    return got.select("mouvement_id", F.col("ancien").cast("double"), F.col("nouveau").cast("double"))


CASH_DAYS = """net AS (SELECT date_mouvement AS jour, sum(CASE WHEN type_mouvement = 'encaissement' THEN montant ELSE -montant END) AS flux FROM cash GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(jour) FROM net), (SELECT max(jour) FROM net), INTERVAL 1 DAY)) AS DATE) AS jour),
solde AS (SELECT jour, CAST(coalesce(flux, 0) AS DOUBLE) AS flux, CAST(sum(coalesce(flux, 0)) OVER (ORDER BY jour ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS solde FROM cal LEFT JOIN net USING (jour))"""


def _balance(m):
    return cashflow.daily_balance(m.cash).select("jour", F.col("flux").cast("double"), F.col("solde").cast("double"))


@query("SELECT * FROM solde", CASH_DAYS)
def daily_cash_balance(m):
    return _balance(m)


@query("SELECT date_mouvement, type_mouvement, categorie, CAST(sum(montant) AS DOUBLE) AS montant FROM cash GROUP BY 1, 2, 3 HAVING sum(montant) <> 0")
def cash_by_category(m):
    return cashflow.by_category(m.cash).withColumn("montant", F.col("montant").cast("double"))


@query("SELECT type_mouvement, categorie, count(*) AS n, CAST(sum(montant) AS DOUBLE) AS total FROM cash GROUP BY 1, 2")
def cash_union_all(m):
    return m.cash.groupBy("type_mouvement", "categorie").agg(F.count("*").alias("n"), F.sum("montant").cast("double").alias("total"))


@raw_query("SELECT event_id, CASE WHEN k IN ('encaissement', 'credit', 'in', 'entree', 'recette') OR regexp_matches(k, 'encaiss|crédit|credit') THEN 'encaissement' ELSE 'decaissement' END AS sens, abs(value) AS montant FROM ev",
    "ev AS (SELECT event_id, value, lower(trim(CASE event_type WHEN 'purchase' THEN ' Crédit ' WHEN 'view' THEN 'IN' WHEN 'click' THEN 'Encaissement client' ELSE event_type END)) AS k FROM events)")
def cash_direction(spark, d):
    kind = F.when(F.col("event_type") == "purchase", " Crédit ").when(F.col("event_type") == "view", "IN").when(F.col("event_type") == "click", "Encaissement client").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", cashflow.direction(kind, F.col("value")).alias("sens"), F.abs("value").alias("montant"))


CASH_MEAN = "points AS (SELECT i, CAST(fin + CAST(i AS INTEGER) AS DATE) AS jour, valeur FROM (SELECT max(jour) AS fin, avg(solde) AS valeur FROM solde) a, (SELECT unnest(generate_series(1, 30)) AS i) b)"
ALERT = """SELECT (SELECT jour FROM {p} ORDER BY valeur, jour LIMIT 1) AS date_alerte, round(min(valeur), 2) AS solde_projete, CAST(0 AS DOUBLE) AS seuil_critique,
  CASE WHEN min(valeur) < 0 THEN 'risque_deficit' WHEN min(valeur) < greatest((max(valeur) - min(valeur)) * 0.15, 1) THEN 'vigilance' ELSE 'ok' END AS niveau FROM {p}"""


def _cash_points(m):
    return series.mean_forecast(_balance(m), 30, "solde")


@query(ALERT.format(p="points"), CASH_DAYS, CASH_MEAN)
def cash_alert(m):
    return cashflow.alert(_cash_points(m))


@query("SELECT i, jour, round(valeur - 1000000 * CAST(i AS DOUBLE) / 30, 2) AS valeur FROM points", CASH_DAYS, CASH_MEAN)
def whatif_cash(m):
    return cashflow.what_if(_cash_points(m), F.lit(-1000000.0)).select(F.col("i").cast("long").alias("i"), "jour", F.round("valeur", 2).alias("valeur"))


# --- joins and sets ---


@raw_query("""SELECT n_name AS pays, p_brand AS marque, count(*) AS lignes, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS ca FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def sales_star_join(spark, d):
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy(F.col("n_name").alias("pays"), F.col("p_brand").alias("marque")).agg(F.count("*").alias("lignes"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double").alias("ca"))


@raw_query("""SELECT l_suppkey, p_type, count(DISTINCT l_partkey) AS articles, CAST(sum(l_quantity) AS DOUBLE) AS unites FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def stock_star_join(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_suppkey", "p_type").agg(F.countDistinct("l_partkey").alias("articles"), F.sum("l_quantity").alias("unites"))


@raw_query("SELECT l_partkey AS ProductKey, max(CAST(l_shipdate AS DATE)) AS DateKey FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-06-30' GROUP BY 1")
def stock_asof_snapshot(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ProductKey"), F.to_date("l_shipdate").alias("DateKey"), F.col("l_quantity").cast("string").alias("UnitsBalance"))
    return exports.stock_snapshot(rows, F.lit("1998-06-30").cast("date")).select("ProductKey", "DateKey")


@raw_query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.jour, r.jour AS jour_prix, r.prix AS prix_connu FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS jour FROM lineitem) l
  ASOF LEFT JOIN (SELECT l_partkey, jour, arg_max(prix, (o, n, prix)) AS prix FROM known GROUP BY 1, 2) r ON l.l_partkey = r.l_partkey AND l.jour > r.jour""",
    "known AS (SELECT l_partkey, CAST(o_orderdate AS DATE) AS jour, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS prix FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def asof_last_price(spark, d):
    """For each shipped line, the price at which its article was last ordered before that day."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("jour"), F.col("l_extendedprice").alias("prix"))
    known = lines.drop("jour").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("jour")), "l_orderkey")
    got = joins.asof_join(lines.drop("prix"), known, ["l_partkey"], "jour", "jour", ties=("l_orderkey", "l_linenumber", "prix"), strict=True)
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "jour", F.col("derniere_jour").alias("jour_prix"), F.col("derniere_prix").alias("prix_connu"))


@raw_query("""SELECT o.o_orderkey, o.debut, o.fin, count(l.l_orderkey) AS lignes, CAST(sum(l.l_quantity) AS DOUBLE) AS unites FROM wide o LEFT JOIN lineitem l ON CAST(l.l_shipdate AS DATE) BETWEEN o.debut AND o.fin GROUP BY 1, 2, 3""",
    "wide AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS debut, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS fin FROM orders WHERE o_totalprice > (SELECT quantile_disc(o_totalprice, 0.99) FROM orders))")
def range_lines_after_large_orders(spark, d):
    """Lines shipped on the days from each of the largest orders on, up to three days later. Lines are summed up by day first: a pair is one of an order and a day, whatever the number of lines."""
    orders = table(spark, d, "orders")
    limit = discrete_quantile(orders, "o_totalprice", 0.99)
    day = F.to_date("o_orderdate")
    wide = orders.where(F.col("o_totalprice") > F.lit(limit)).select("o_orderkey", day.alias("debut"), F.date_add(day, (F.col("o_orderkey") % 4).cast("int")).alias("fin"))
    daily = cut(table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("jour")).agg(F.count("l_orderkey").alias("lignes"), F.sum("l_quantity").alias("unites")))  # read four times
    met = joins.range_join(wide, daily, ("debut", "fin"), ("jour", "jour"), outer=True)
    return met.groupBy("o_orderkey", "debut", "fin").agg(F.coalesce(F.sum("r_lignes"), F.lit(0).cast("long")).alias("lignes"), F.sum("r_unites").alias("unites"))


@raw_query("""SELECT a.p_brand AS marque, count(*) AS paires, CAST(sum(CAST(least(a.fin, b.fin) - greatest(a.debut, b.debut) AS BIGINT) + 1) AS BIGINT) AS jours FROM spans a JOIN spans b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.debut <= b.fin AND b.debut <= a.fin GROUP BY 1""",
    "spans AS (SELECT p_brand, p_partkey, min(CAST(l_shipdate AS DATE)) AS debut, min(CAST(l_shipdate AS DATE)) + CAST(p_size AS INTEGER) AS fin FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand, p_partkey, p_size)")
def range_launches_that_overlap(spark, d):
    """By brand: pairs of articles whose launches (from the first shipped line on, as many days as their size) overlap, and for how many days."""
    first = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.to_date(F.min("l_shipdate")).alias("debut"))
    spans = table(spark, d, "part").join(first, F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "p_partkey", "debut", F.date_add("debut", F.col("p_size").cast("int")).alias("fin"))
    return joins.overlap_totals(spans, ("debut", "fin"), ["p_brand"], "p_partkey").withColumnRenamed("p_brand", "marque")


@query("SELECT pays, CAST(year(date_transaction) AS INTEGER) AS annee, count(DISTINCT client_id) AS clients, TRUE AS dans_la_borne FROM transactions JOIN clients USING (client_id) GROUP BY 1, 2")
def distinct_clients_by_sketch(m):
    """Distinct customers by country and year: exact, and whether the union of daily sketches keeps its error bound."""
    rows = m.transactions.join(m.clients.select("client_id", "pays"), "client_id")
    daily = sketches.daily_sketches(rows, F.col("date_transaction"), "client_id", ("pays",)).withColumn("annee", F.year("jour"))
    told = sketches.distinct_between(daily, by=("pays", "annee"))
    exact = rows.groupBy("pays", F.year("date_transaction").alias("annee")).agg(F.countDistinct("client_id").alias("clients"))
    near = F.abs(F.col("distincts") - F.col("clients")) <= F.greatest(F.lit(1.0), F.col("clients") * sketches.error_bound())
    return exact.join(told, ["pays", "annee"]).select("pays", "annee", "clients", near.alias("dans_la_borne"))


@query("SELECT code_produit, nom_produit FROM stocks WHERE code_produit IN (SELECT code_produit FROM transactions WHERE NOT est_retour)")
def products_sold_semi(m):
    return m.stocks.join(indicators.sold(m.transactions), "code_produit", "left_semi").select("code_produit", "nom_produit")


@query("SELECT code_produit FROM stocks EXCEPT SELECT code_produit FROM transactions WHERE est_retour AND quantite > 47")
def products_never_returned(m):
    """Products of which no large lot ever came back."""
    return m.stocks.select("code_produit").distinct().join(m.transactions.where("est_retour AND quantite > 47"), "code_produit", "left_anti")


@query("""SELECT code_produit, greatest(5, CAST(floor(moyenne * 2) AS INTEGER)) AS seuil_alerte, CAST(floor(greatest(5, CAST(floor(moyenne * 2) AS INTEGER)) * 1.5) AS INTEGER) AS seuil_reapprovisionnement FROM (SELECT code_produit, avg(quantite) AS moyenne FROM transactions GROUP BY 1) t""")
def simulate_stock_thresholds(m):
    return exports.simulated_stock(m.transactions).drop("quantite_disponible")


# --- recency, frequency, amount ---

BASE = """ref AS (SELECT max(date_transaction) AS ref FROM transactions),
rfm AS (SELECT client_id, CAST(date_diff('second', max(date_transaction), (SELECT ref FROM ref)) // 86400 AS INTEGER) AS recence_jours, CASE WHEN count(numero_facture) > 0 THEN count(DISTINCT numero_facture) ELSE count(*) END AS frequence_achats, CAST(sum(montant) AS DOUBLE) AS montant_total
  FROM transactions WHERE NOT est_retour AND client_id IS NOT NULL AND date_transaction >= (SELECT ref FROM ref) - INTERVAL 365 DAY AND date_transaction <= (SELECT ref FROM ref) GROUP BY client_id)"""
_Q = "CAST(greatest(1, least(5, ceil((CAST(rank() OVER (ORDER BY {c}) + CAST(count(*) OVER (PARTITION BY {c}) - 1 AS DOUBLE) / 2 AS DOUBLE) / count(*) OVER ()) * 5))) AS INTEGER)"
SCORES = f"scored AS (SELECT *, 6 - {_Q.format(c='recence_jours')} AS score_r, {_Q.format(c='frequence_achats')} AS score_f, {_Q.format(c='montant_total')} AS score_m FROM rfm)"
CAP = "cap AS (SELECT greatest(q2, CASE WHEN q3 > q1 THEN least(p, q3 + 1.5 * (q3 - q1)) ELSE p END) AS cap FROM (SELECT quantile_cont(montant_total, 0.25) AS q1, quantile_cont(montant_total, 0.5) AS q2, quantile_cont(montant_total, 0.75) AS q3, quantile_cont(montant_total, 0.99) AS p FROM rfm) t)"
_Z = "(l{c} - avg(l{c}) OVER ()) / CASE WHEN stddev_pop(l{c}) OVER () > 0 THEN stddev_pop(l{c}) OVER () ELSE 1 END AS z_{c}"
MATRIX = f"lg AS (SELECT *, ln(1 + recence_jours) AS lr, ln(1 + frequence_achats) AS lf, ln(1 + least(montant_total, (SELECT cap FROM cap))) AS lm FROM scored), matrix AS (SELECT *, {', '.join(_Z.format(c=c) for c in 'rfm')}, CAST(floor((score_f + score_m) / 3.0) AS INTEGER) AS cluster_id FROM lg)"
SEGMENTED = """high AS (SELECT cluster_id FROM matrix WHERE frequence_achats > 1 AND recence_jours <= 182.5 GROUP BY 1 HAVING avg(score_f) >= 3 AND avg(score_m) >= 3),
labelled AS (SELECT *, CASE WHEN recence_jours > 182.5 AND frequence_achats > 1 THEN 'À risque' WHEN recence_jours > 182.5 THEN 'Perdu' WHEN frequence_achats <= 1 THEN 'Nouveau'
  WHEN cluster_id IN (SELECT cluster_id FROM high) AND score_f >= 3 AND score_m >= 3 THEN 'Fidèle' ELSE 'Occasionnel' END AS segment_rfm, round_even(recence_jours / 365.0::DOUBLE, 4) AS score_churn FROM matrix),
late AS (SELECT client_id, CAST(date_diff('second', max(date_transaction), (SELECT ref FROM ref)) // 86400 AS INTEGER) AS recence_jours FROM transactions WHERE NOT est_retour AND client_id IS NOT NULL GROUP BY 1 HAVING max(date_transaction) < (SELECT ref FROM ref) - INTERVAL 365 DAY),
everyone AS (SELECT client_id, recence_jours, frequence_achats, montant_total, score_r, score_f, score_m, cluster_id, segment_rfm, score_churn FROM labelled
  UNION ALL SELECT client_id, recence_jours, 0, 0, 1, 1, 1, NULL, 'Perdu', 1 FROM late)"""
ALL_RFM = (BASE, SCORES, CAP, MATRIX, SEGMENTED)


def _matrix(m):
    return cut(segments.rule_clusters(segments.matrix(segments.scored(segments.rfm(m.transactions)))[0]))


def _everyone(m):
    return cut(segments.segmented(m.transactions, _matrix(m)))


@query("SELECT * FROM rfm", BASE)
def rfm_base(m):
    return segments.rfm(m.transactions)


@query("SELECT client_id, recence_jours, frequence_achats, montant_total, score_r, score_f, score_m FROM scored", BASE, SCORES)
def rfm_scores(m):
    return segments.scored(segments.rfm(m.transactions))


@query("SELECT client_id, round(least(montant_total, (SELECT cap FROM cap)), 4) AS plafonne FROM rfm", BASE, CAP)
def winsorize_amounts(m):
    return winsorised(segments.rfm(m.transactions), "montant_total", "plafonne")[0].select("client_id", F.round("plafonne", 4).alias("plafonne"))


@query("SELECT client_id, round(z_r, 5) AS z_r, round(z_f, 5) AS z_f, round(z_m, 5) AS z_m FROM matrix", BASE, SCORES, CAP, MATRIX)
def rfm_scaled_matrix(m):
    return _matrix(m).select("client_id", *[F.round(c, 5).alias(c) for c in clusters.AXES])


@query("SELECT * FROM late", *ALL_RFM)
def clients_out_of_window(m):
    return segments.out_of_window(m.transactions)


@query("SELECT client_id, round_even(recence_jours / 365.0::DOUBLE, 4) AS score_churn FROM rfm", BASE)
def churn_score(m):
    return segments.with_churn(segments.rfm(m.transactions)).select("client_id", "score_churn")


@query("SELECT client_id, cluster_id, segment_rfm FROM labelled", *ALL_RFM)
def assign_segments(m):
    return segments.with_segment(_matrix(m)).select("client_id", "cluster_id", "segment_rfm")


@query("SELECT client_id, recence_jours, frequence_achats, CAST(montant_total AS DOUBLE) AS montant_total, score_r, score_f, score_m, cluster_id, segment_rfm, CAST(score_churn AS DOUBLE) AS score_churn FROM everyone", *ALL_RFM)
def clients_with_segments(m):
    return _everyone(m)


_ACTIONS = "CASE segment_rfm " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in S.ACTIONS.items()) + " ELSE 'Action à définir' END"
SUMMARY = "summary AS (SELECT segment_rfm, count(*) AS nb_clients, round(CAST(sum(CAST(montant_total AS DECIMAL(20,2))) AS DOUBLE) / count(*), 4) AS montant_total_moyen, round(CAST(sum(CAST(score_churn AS DECIMAL(10,4))) AS DOUBLE) / count(*), 6) AS score_churn_moyen FROM everyone GROUP BY 1)"


@query(f"SELECT *, {_ACTIONS} AS action_marketing_recommandee FROM summary", *ALL_RFM, SUMMARY)
def segment_summary(m):
    return segments.summary(_everyone(m))


@query("SELECT segment_rfm, count(*) AS n FROM everyone GROUP BY 1", *ALL_RFM)
def segment_distribution(m):
    return _everyone(m).groupBy("segment_rfm").agg(F.count("*").alias("n"))


@query("SELECT client_id, CAST(montant_total AS DOUBLE) AS montant_total, segment_rfm FROM everyone WHERE segment_rfm = 'Fidèle' ORDER BY montant_total DESC NULLS LAST, client_id LIMIT 200", *ALL_RFM)
def clients_by_segment(m):
    return segments.by_segment(_everyone(m), S.FIDELE).select("client_id", "montant_total", "segment_rfm")


@query("SELECT segment_rfm, client_id, rang FROM (SELECT segment_rfm, client_id, CAST(row_number() OVER (PARTITION BY segment_rfm ORDER BY montant_total DESC NULLS LAST, client_id) AS INTEGER) AS rang FROM everyone) t WHERE rang <= 5", *ALL_RFM)
def segment_examples(m):
    return segments.examples(_everyone(m)).select("segment_rfm", "client_id", "rang")


@query("SELECT arg_max(segment_rfm, nb_clients) AS plus_grand, arg_max(segment_rfm, montant_total_moyen) AS plus_rentable, arg_max(segment_rfm, score_churn_moyen) AS plus_a_risque FROM summary", *ALL_RFM, SUMMARY)
def report_segment_reading(m):
    return segments.reading(_everyone(m))


@query("SELECT urgence, sujet, n FROM (SELECT CASE WHEN count(*) FILTER (WHERE niveau = 'critique') > 0 THEN 0 WHEN count(*) > 0 THEN 1 ELSE 2 END AS urgence, 'stocks' AS sujet, count(*) AS n FROM alerts WHERE niveau <> 'ok' UNION ALL SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 2 END, 'clients', count(*) FROM everyone WHERE segment_rfm = 'À risque') t", *ALL_RFM, ALERTS)
def briefing_points(m):
    return tools.stock_point(m.stocks).unionByName(tools.client_point(_everyone(m)))


# --- clusters ---

_D = "sqrt(pow(a.z_r - b.z_r, 2) + pow(a.z_f - b.z_f, 2) + pow(a.z_m - b.z_m, 2))"
CENTRES = "centres AS (SELECT cluster_id, avg(z_r) AS z_r, avg(z_f) AS z_f, avg(z_m) AS z_m, count(*) AS size FROM matrix GROUP BY 1)"
KNN = f"part AS (SELECT client_id, z_r, z_f, z_m FROM matrix), curve AS (SELECT client_id, d AS distance FROM (SELECT a.client_id, {_D} AS d, row_number() OVER (PARTITION BY a.client_id ORDER BY {_D}) AS k FROM part a JOIN part b ON a.client_id <> b.client_id) t WHERE k = 5)"


@query(f"""SELECT round(avg(CASE WHEN size <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM (
  SELECT client_id, max(CASE WHEN own = other THEN total / greatest(size - 1, 1) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b, max(CASE WHEN own = other THEN size END) AS size FROM (
    SELECT a.client_id, a.cluster_id AS own, b.cluster_id AS other, sum({_D}) AS total, count(*) AS size FROM matrix a, matrix b GROUP BY 1, 2, 3) s GROUP BY 1) t""", BASE, SCORES, CAP, MATRIX)
def silhouette_by_segment(m):
    return clusters.silhouette(_matrix(m)).select(F.round("silhouette", 5).alias("silhouette"))


@query(f"""SELECT round(avg(d), 5) AS davies_bouldin FROM (SELECT a.cluster_id, max((a.s + b.s) / {_D}) AS d FROM full_ a JOIN full_ b ON a.cluster_id <> b.cluster_id GROUP BY 1) t""", BASE, SCORES, CAP, MATRIX, CENTRES,
    f"full_ AS (SELECT b.cluster_id, b.z_r, b.z_f, b.z_m, avg({_D}) AS s FROM matrix a JOIN centres b ON a.cluster_id = b.cluster_id GROUP BY 1, 2, 3, 4)")
def davies_bouldin(m):
    return clusters.davies_bouldin(_matrix(m)).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query(f"""SELECT round(between_ * (n - k) / (within_ * (k - 1)), 3) AS calinski_harabasz FROM (SELECT sum(pow({_D}, 2) * a.size) AS between_, count(*) AS k, sum(a.size) AS n FROM centres a, (SELECT avg(z_r) AS z_r, avg(z_f) AS z_f, avg(z_m) AS z_m FROM matrix) b) x,
  (SELECT sum(pow({_D}, 2)) AS within_ FROM matrix a JOIN centres b ON a.cluster_id = b.cluster_id) y""", BASE, SCORES, CAP, MATRIX, CENTRES)
def calinski_harabasz(m):
    return clusters.calinski_harabasz(_matrix(m)).select(F.round("calinski_harabasz", 3).alias("calinski_harabasz"))


@query("SELECT client_id, round(distance, 5) AS distance FROM curve", BASE, SCORES, CAP, MATRIX, KNN)
def kdistance_curve(m):
    return clusters.knn_distances(_matrix(m)).select("client_id", F.round("distance", 5).alias("distance"))


ELBOW = """SELECT round(distance, 5) AS epsilon FROM (SELECT distance, abs(CAST(i AS DOUBLE) / max(i) OVER () - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ())) AS away, i FROM (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS i FROM curve) t) u ORDER BY round(away, 12) DESC, i LIMIT 1"""


@query(ELBOW, BASE, SCORES, CAP, MATRIX, KNN)
def kdistance_elbow(m):
    return clusters.elbow(clusters.knn_distances(_matrix(m))).select(F.round("epsilon", 5).alias("epsilon"))


@query("SELECT DISTINCT epsilon FROM (SELECT round(unnest(quantile_cont(distance, [" + ", ".join(str(0.5 + 0.48 * i / 7) for i in range(8)) + "])), 5) AS epsilon FROM curve UNION ALL SELECT * FROM (" + ELBOW + ") e) t WHERE epsilon > 0", BASE, SCORES, CAP, MATRIX, KNN)
def dbscan_eps_candidates(m):
    got = clusters.eps_candidates(cut(clusters.knn_distances(_matrix(m))))
    return m.clients.sparkSession.createDataFrame([(x,) for x in sorted({round(x, 5) for x in got})], "epsilon double")


@query()
def dbscan_labels(m):
    return clusters.dbscan(_matrix(m).drop("cluster_id"), 0.4).select("client_id", "cluster_id")


@query()
def kmeans_labels(m):
    return clusters.kmeans(_matrix(m).drop("cluster_id"), 4)[0].select("client_id", "cluster_id")


@query()
def gmm_labels(m):
    return clusters.mixture(_matrix(m).drop("cluster_id"), 2)[0].select("client_id", "cluster_id")


def _measured(label: str) -> list[str]:
    """CTEs of the three measures of the customers' groups by one score, and of what ranking takes."""
    d, c = _D, f"ctr_{label}"
    return [
        f"{c} AS (SELECT {label} AS g, avg(z_r) AS z_r, avg(z_f) AS z_f, avg(z_m) AS z_m, count(*) AS size FROM matrix GROUP BY 1)",
        f"sil_{label} AS (SELECT avg(CASE WHEN size <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM (SELECT client_id, max(CASE WHEN own = other THEN total / greatest(size - 1, 1) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b, max(CASE WHEN own = other THEN size END) AS size FROM (SELECT a.client_id, a.{label} AS own, b.{label} AS other, sum({d}) AS total, count(*) AS size FROM matrix a, matrix b GROUP BY 1, 2, 3) s GROUP BY 1) t)",
        f"sp_{label} AS (SELECT b.g, b.z_r, b.z_f, b.z_m, avg({d}) AS s FROM matrix a JOIN {c} b ON a.{label} = b.g GROUP BY 1, 2, 3, 4)",
        f"db_{label} AS (SELECT avg(d) AS v FROM (SELECT a.g, max((a.s + b.s) / {d}) AS d FROM sp_{label} a JOIN sp_{label} b ON a.g <> b.g GROUP BY 1) t)",
        f"ch_{label} AS (SELECT between_ * (n - k) / (within_ * (k - 1)) AS v, k FROM (SELECT sum(pow({d}, 2) * a.size) AS between_, count(*) AS k, sum(a.size) AS n FROM {c} a, (SELECT avg(z_r) AS z_r, avg(z_f) AS z_f, avg(z_m) AS z_m FROM matrix) b) x, (SELECT sum(pow({d}, 2)) AS within_ FROM matrix a JOIN {c} b ON a.{label} = b.g) y)",
    ]


GROUPINGS = ["score_r", "score_f", "score_m"]
RANKED = "ranked AS (" + " UNION ALL ".join(f"SELECT '{c}' AS algorithme, (SELECT v FROM sil_{c}) AS silhouette, (SELECT v FROM db_{c}) AS davies_bouldin, (SELECT v FROM ch_{c}) AS calinski_harabasz, (SELECT k FROM ch_{c}) AS n_groupes" for c in GROUPINGS) + ")"


@query("""SELECT algorithme, round(silhouette, 5) AS silhouette, CASE WHEN eligible THEN round((rank() OVER (PARTITION BY eligible ORDER BY silhouette DESC) + rank() OVER (PARTITION BY eligible ORDER BY davies_bouldin) + rank() OVER (PARTITION BY eligible ORDER BY calinski_harabasz DESC)) / 3.0::DOUBLE, 6) END AS rang_moyen, eligible,
  CASE WHEN silhouette > 0.70 THEN 'forte' WHEN silhouette > 0.50 THEN 'raisonnable' WHEN silhouette > 0.25 THEN 'faible' ELSE 'non substantielle' END AS qualite FROM (SELECT *, n_groupes BETWEEN 2 AND 8 AS eligible FROM ranked) t""",
    BASE, SCORES, CAP, MATRIX, *[x for c in GROUPINGS for x in _measured(c)], RANKED)
def algorithm_ranking(m):
    """The ranking of three groupings of the customers, by each of their scores, with the reading of their silhouettes."""
    base = _matrix(m).drop("cluster_id")
    rows = []
    for c in GROUPINGS:
        got = clusters.measures(base, c)
        rows.append((c, got["silhouette"], got["davies_bouldin"], got["calinski_harabasz"], base.select(c).distinct().count(), 0.0))
    rows = m.clients.sparkSession.createDataFrame(rows, "algorithme string, silhouette double, davies_bouldin double, calinski_harabasz double, n_groupes long, part_bruit double")
    return clusters.ranking(rows).select("algorithme", F.round("silhouette", 5).alias("silhouette"), "rang_moyen", "eligible", text.silhouette_quality(F.col("silhouette")).alias("qualite"))


@query(f"""SELECT cluster_id, round(v, 4) AS silhouette, CASE WHEN v > 0.70 THEN 'forte' WHEN v > 0.50 THEN 'raisonnable' WHEN v > 0.25 THEN 'faible' ELSE 'non substantielle' END AS qualite FROM (SELECT x.cluster_id, ({_D.replace('a.', 'x.').replace('b.', 'y.')}) / 10 AS v FROM centres x, (SELECT avg(z_r) AS z_r, avg(z_f) AS z_f, avg(z_m) AS z_m FROM matrix) y) t""", BASE, SCORES, CAP, MATRIX, CENTRES)
def silhouette_quality(m):
    """The words for a silhouette, for a tenth of each group's distance from the middle of all customers, which spans the four of them."""
    rows = _matrix(m)
    middle = rows.agg(*[F.avg(c).alias(f"o_{c}") for c in clusters.AXES])
    centres = rows.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in clusters.AXES]).crossJoin(F.broadcast(middle))  # one row
    v = F.sqrt(sum(F.pow(F.col(c) - F.col(f"o_{c}"), 2) for c in clusters.AXES)) / 10
    return centres.select("cluster_id", F.round(v, 4).alias("silhouette"), text.silhouette_quality(v).alias("qualite"))


@query()
def rfm_pipeline(m):
    return segmentation.run(m.transactions).clients


def _base(m):
    return cut(segments.matrix(segments.scored(segments.rfm(m.transactions)))[0])


def _diagnostics(m, algorithm):
    fit = segmentation.fit(_base(m), algorithm)
    rows = [(d["k"], d["inertie"], d["silhouette"], d["davies_bouldin"], d["calinski_harabasz"], d["n_clusters"], d["n_bruit"], d["k"] == fit.k) for d in fit.diagnostics]
    return m.clients.sparkSession.createDataFrame(rows, "k int, valeur double, silhouette double, davies_bouldin double, calinski_harabasz double, n_clusters long, n_bruit long, choisi boolean")


@query()
def kmeans_diagnostics(m):
    return _diagnostics(m, "kmeans")


@query()
def gmm_diagnostics(m):
    return _diagnostics(m, "gmm")


@query()
def algorithm_comparison(m):
    base = _base(m)
    return segmentation.compared(m.clients.sparkSession, segmentation.fits_of(base))


@query()
def segmentation_agreement(m):
    """The share of customers whom all three algorithms, each with its best candidate, put into the same segment."""
    base = _base(m)
    found = [(f.algorithme, f.labels) for f in segmentation.fits_of(base)]
    named = [segments.with_segment(base.join(labels, "client_id")).select("client_id", F.col("segment_rfm").alias(a)) for a, labels in found if labels is not None]
    return clusters.agreement(reduce(lambda x, y: x.join(y, "client_id"), named), [a for a, labels in found if labels is not None])


# --- daily series and forecasts ---

REV = """rev0 AS (SELECT CAST(date_transaction AS DATE) AS jour, sum(montant) AS ca FROM transactions WHERE NOT est_retour GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(jour) FROM rev0), (SELECT max(jour) FROM rev0), INTERVAL 1 DAY)) AS DATE) AS jour),
rev AS (SELECT jour, CAST(coalesce(ca, 0) AS DOUBLE) AS ca FROM cal LEFT JOIN rev0 USING (jour)),
rcap AS (SELECT greatest(q2, CASE WHEN q3 > q1 THEN least(p, q3 + 1.5 * (q3 - q1)) ELSE p END) AS cap FROM (SELECT quantile_cont(ca, 0.25) AS q1, quantile_cont(ca, 0.5) AS q2, quantile_cont(ca, 0.75) AS q3, quantile_cont(ca, 0.99) AS p FROM rev WHERE ca > 0) t),
revw AS (SELECT jour, ca, least(ca, (SELECT cap FROM rcap)) AS y FROM rev)"""
SPLIT = "parts AS (SELECT jour, y, CAST(row_number() OVER (ORDER BY jour) AS INTEGER) AS rang, CASE WHEN row_number() OVER (ORDER BY jour) > count(*) OVER () - least(greatest(3, floor(count(*) OVER () * 0.2)), count(*) OVER () - 3) THEN 'test' ELSE 'train' END AS partie FROM revw)"
MEAN = "pts AS (SELECT CAST(i AS INTEGER) AS i, CAST(fin + CAST(i AS INTEGER) AS DATE) AS jour, valeur FROM (SELECT max(jour) AS fin, avg(y) AS valeur FROM revw) a, (SELECT unnest(generate_series(1, 30)) AS i) b)"
LEVEL = "level AS (SELECT avg(ca) FILTER (WHERE k <= 30) AS recent, avg(ca) FILTER (WHERE k > 30 AND k <= 120) AS avant FROM (SELECT ca, row_number() OVER (ORDER BY jour DESC) AS k FROM rev) t)"
WEEK = "wk AS (SELECT CAST(k + 7 * w AS INTEGER) AS i, CAST(fin + CAST(k + 7 * w AS INTEGER) AS DATE) AS jour, valeur FROM (SELECT 8 - row_number() OVER (ORDER BY jour DESC) AS k, y AS valeur, max(jour) OVER () AS fin FROM revw) a, (SELECT unnest(generate_series(0, 4)) AS w) b WHERE k >= 1 AND k + 7 * w <= 30)"
ERRORS = """meanpred AS (SELECT (SELECT avg(y) FROM parts WHERE partie = 'train') AS p), errs AS (SELECT sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, avg(y) AS moyenne FROM parts, meanpred WHERE partie = 'test')"""


def _revenue(m):
    return series.winsorised_revenue(series.daily_revenue(m.transactions))[0]


def _errors(m):
    rows = series.split(_revenue(m))
    mean = rows.where("partie = 'train'").agg(F.avg("y").alias("p"))
    test = rows.where("partie = 'test'").crossJoin(F.broadcast(mean))  # one row
    return test.agg(*series.errors(test, "y", "p"), F.avg("y").alias("moyenne"))


@query("SELECT * FROM rev", REV)
def daily_revenue_series(m):
    return series.daily_revenue(m.transactions)


@query("SELECT jour, round(y, 4) AS y FROM revw", REV)
def daily_revenue_winsorized(m):
    return _revenue(m).select("jour", F.round("y", 4).alias("y"))


@query("SELECT jour, CAST(isodow(jour) - 1 AS INTEGER) AS jour_semaine, CAST(month(jour) AS INTEGER) AS mois, CAST(CASE WHEN isodow(jour) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS est_weekend, CAST(CASE WHEN (month(jour), day(jour)) IN ((1, 1), (2, 11), (5, 1), (5, 20), (8, 15), (12, 25)) OR jour IN (" + ", ".join(f"DATE '{x}'" for x in series.holidays(1990, 2010) if (x.month, x.day) not in series.FIXED_HOLIDAYS) + ") THEN 1 ELSE 0 END AS INTEGER) AS est_ferie FROM rev", REV)
def calendar_features(m):
    return series.calendar(series.daily_revenue(m.transactions).select("jour"))


@query("SELECT jour, round(lag(y, 1) OVER (ORDER BY jour), 4) AS lag_1, round(lag(y, 7) OVER (ORDER BY jour), 4) AS lag_7, round(avg(y) OVER (ORDER BY jour ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS moyenne_mobile_7 FROM revw", REV)
def forecast_features(m):
    return series.lags(_revenue(m)).select("jour", *[F.round(c, 4).alias(c) for c in ("lag_1", "lag_7", "moyenne_mobile_7")])


@query("SELECT jour, rang, partie FROM parts", REV, SPLIT)
def train_test_split(m):
    return series.split(_revenue(m)).select("jour", "rang", "partie")


@query("SELECT i, jour, round(valeur, 4) AS valeur FROM pts", REV, MEAN)
def naive_mean_forecast(m):
    return series.mean_forecast(_revenue(m), 30).withColumn("valeur", F.round("valeur", 4))


@query("SELECT i, jour, round(valeur, 4) AS valeur FROM wk", REV, WEEK)
def repeated_week_forecast(m):
    return series.repeated_week(_revenue(m), 30).select(F.col("i").cast("int").alias("i"), "jour", F.round("valeur", 4).alias("valeur"))


@query("""SELECT modele, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs(y - p)) / max(e), 6) AS mase FROM (
  SELECT 'moyenne' AS modele, y, (SELECT p FROM meanpred) AS p, e FROM t UNION ALL SELECT 'semaine_precedente', y, l7, e FROM t
  UNION ALL SELECT 'semaine_repetee', t.y, s.y, e FROM t JOIN parts s ON s.rang = n - 6 + (t.rang - n - 1) % 7) u GROUP BY 1""", REV, SPLIT, ERRORS,
    "lagged AS (SELECT *, lag(y, 7) OVER (ORDER BY jour) AS l7 FROM parts), t AS (SELECT *, (SELECT avg(abs(y - l7)) FROM lagged WHERE partie = 'train') AS e, (SELECT max(rang) FROM parts WHERE partie = 'train') AS n FROM lagged WHERE partie = 'test')")
def naive_forecast_errors(m):
    return series.naive_errors(_revenue(m))


@query("SELECT round(recent, 4) AS recent, round(avant, 4) AS avant, round(recent / avant - 1, 6) AS variation, abs(recent / avant - 1) > 0.5 AS rupture FROM level", REV, LEVEL)
def sales_break_detection(m):
    return series.level_break(series.daily_revenue(m.transactions))


_TREND = "((SELECT avg(valeur) FROM wk WHERE i > 23) / (SELECT avg(valeur) FROM wk WHERE i <= 7) - 1)"


@query(f"""SELECT CAST(round(sum(CAST(valeur AS DECIMAL(20,6))), 2) AS DOUBLE) AS total_prevu, round(avg(valeur), 2) AS moyenne_jour, round(avg(valeur) / (SELECT round(recent, 4) FROM level) - 1, 6) AS ecart_niveau, round({_TREND}, 6) AS tendance,
  CASE WHEN {_TREND} > 0.05 THEN 'hausse' WHEN {_TREND} < -0.05 THEN 'baisse' ELSE 'stable' END AS sens, round((SELECT rmse / moyenne FROM errs), 6) AS erreur_relative, (SELECT CASE WHEN rmse / moyenne < 0.25 THEN 'bonne' WHEN rmse / moyenne < 0.5 THEN 'moyenne' ELSE 'faible' END FROM errs) AS fiabilite FROM wk""", REV, SPLIT, WEEK, LEVEL, ERRORS)
def forecast_indicators(m):
    points = series.repeated_week(_revenue(m), 30)
    return series.indicators(points, series.level_break(series.daily_revenue(m.transactions)), _errors(m))


@query("SELECT round(greatest(0, sum(valeur) - max(mae) * count(*)), 2) AS bas, round(sum(valeur) + max(mae) * count(*), 2) AS haut FROM wk, errs", REV, SPLIT, WEEK, ERRORS)
def forecast_scenarios(m):
    return series.scenarios(series.repeated_week(_revenue(m), 30), _errors(m))


@query("SELECT CAST((i - 1) // 7 AS INTEGER) AS semaine, min(jour) AS du, max(jour) AS au, CAST(round(sum(CAST(valeur AS DECIMAL(20,6))), 2) AS DOUBLE) AS ventes_prevues FROM wk GROUP BY 1", REV, WEEK)
def forecast_weekly_totals(m):
    return series.weekly(series.repeated_week(_revenue(m), 30))


@query("SELECT jour, ca AS montant FROM rev WHERE ca > 0 ORDER BY jour LIMIT 180", REV)
def simulate_cash_inflows(m):
    return exports.simulated_receipts(series.daily_revenue(m.transactions))


def _one(m):
    return _revenue(m).select(F.lit("ventes").alias("serie"), "jour", "y")


@query()
def forecast_arima(m):
    return forecast.forecasts(_one(m), 30, ("arima",))


@query()
def forecast_additive(m):
    return forecast.forecasts(_one(m), 30, ("additif",))


@query()
def forecast_trees(m):
    return forecast.forecasts(_one(m), 30, ("arbres",))


@query()
def forecast_comparison(m):
    return forecast.best_model(forecast.forecasts(_one(m), 30))


@query()
def forecast_chart_rows(m):
    return forecast.chart_rows(_revenue(m).select("jour", "y"), forecast.forecasts(_one(m), 30))


# --- files: raw rows with every defect, from the orders ---

RAW = """o_orderkey AS ordinal, CASE WHEN o_orderkey % 19 = 0 THEN 'pas de date' ELSE concat(CAST(year(o_orderdate) AS STRING), '-03-01') END AS jour, concat('  c', CAST(o_custkey % 50 AS STRING), ' ') AS client,
CASE WHEN o_orderkey % 7 = 0 THEN '0' WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 5 = 0 THEN '-2' ELSE CAST(o_orderkey % 5 + 1 AS STRING) END AS qte,
CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '-12.5' ELSE CAST(o_orderkey % 3 * 10 + 5 AS STRING) END AS prix,
CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 4 * 25 - 10 AS STRING) END AS montant,
CASE o_orderkey % 6 WHEN 0 THEN 'C536379' WHEN 1 THEN ' av-2024-001' WHEN 2 THEN 'CMD-2024-001' WHEN 3 THEN 'AVOIR 12' WHEN 4 THEN 'ART-9' ELSE NULL END AS facture,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE NULL END AS nom"""
RAW_SQL = f"raw AS (SELECT {RAW} FROM orders)"
_DATE_SQL, _NUM = "TRY_CAST(jour AS TIMESTAMP)", "TRY_CAST({c} AS DOUBLE)"
_RET = r"coalesce(regexp_matches(upper(trim(facture)), '^(?:[CA]\d|AV(?:OIR|O)?[\s\-_/]*\d)'), FALSE)"
PREPARED = f"""prep AS (SELECT ordinal, {_DATE_SQL} AS d, upper(trim(client)) AS c, abs(TRY_CAST(qte AS DOUBLE)) AS q, abs(TRY_CAST(prix AS DOUBLE)) AS p, facture, nullif(nom, '') AS nom, coalesce(TRY_CAST(qte AS DOUBLE) < 0, FALSE) OR coalesce(TRY_CAST(prix AS DOUBLE) < 0, FALSE) OR {_RET} AS est_retour,
  {_DATE_SQL} IS NULL OR TRY_CAST(prix AS DOUBLE) IS NULL OR TRY_CAST(qte AS DOUBLE) IS NULL AS rejet FROM raw),
kept AS (SELECT c, d, p, q, trim(facture) AS f, min(ordinal) AS ordinal, arg_min(est_retour, ordinal) AS est_retour FROM prep WHERE NOT rejet GROUP BY 1, 2, 3, 4, 5)"""
MAPPING = cleaning.SalesMapping("jour", "client", prix_unitaire_col="prix", quantite_col="qte", numero_facture_col="facture", nom_client_col="nom")


def _raw(spark, d):
    return table(spark, d, "orders").selectExpr(*_split_columns(RAW))


def _split_columns(text_: str) -> list[str]:
    """The select list as Spark reads it, cut at commas outside parentheses and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text_):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(text_[at:i])
            at = i + 1
    return [*out, text_[at:]]


@raw_query("SELECT ordinal, TRY_CAST(qte AS DOUBLE) AS qte, TRY_CAST(prix AS DOUBLE) AS prix, TRY_CAST(jour AS TIMESTAMP) AS jour FROM raw", RAW_SQL)
def lenient_casts(spark, d):
    return _raw(spark, d).select("ordinal", cleaning.number(F.col("qte")).alias("qte"), cleaning.number(F.col("prix")).alias("prix"), cleaning.timestamp(F.col("jour")).alias("jour"))


@raw_query("SELECT ordinal, upper(trim(client)) AS code FROM raw", RAW_SQL)
def normalize_client_codes(spark, d):
    return _raw(spark, d).select("ordinal", cleaning.client_code(F.col("client")).alias("code"))


@raw_query("""SELECT ordinal, CASE WHEN bad THEN CASE WHEN a < 0 THEN -1 ELSE 1 END ELSE q END AS quantite, CASE WHEN bad THEN abs(a) ELSE round(abs(a / nullif(q, 0)), 6) END AS prix, bad AS repli FROM (
  SELECT ordinal, TRY_CAST(montant AS DOUBLE) AS a, TRY_CAST(qte AS DOUBLE) AS q, TRY_CAST(montant AS DOUBLE) IS NOT NULL AND (TRY_CAST(qte AS DOUBLE) IS NULL OR abs(TRY_CAST(qte AS DOUBLE)) <= 1e-9) AS bad FROM raw) t""", RAW_SQL)
def resolve_amounts(spark, d):
    q, p, bad = cleaning.amounts(F.col("qte"), None, F.col("montant"))
    return _raw(spark, d).select("ordinal", q.alias("quantite"), F.round(p, 6).alias("prix"), bad.alias("repli"))


@raw_query("SELECT ordinal, est_retour FROM prep", RAW_SQL, PREPARED)
def returns_detection(spark, d):
    return cleaning.prepared_sales(_raw(spark, d), MAPPING).select("ordinal", "est_retour")


@raw_query("SELECT ordinal, c AS code_client_externe, d AS date_transaction, CAST(floor(q) AS INTEGER) AS quantite, CAST(CAST(p AS DECIMAL(12,2)) AS DOUBLE) AS prix_unitaire, f AS numero_facture, est_retour FROM kept", RAW_SQL, PREPARED)
def dedup_transactions(spark, d):
    rows = cleaning.clean_sales(cleaning.prepared_sales(_raw(spark, d), MAPPING))
    return rows.select("ordinal", "code_client_externe", "date_transaction", "quantite", F.col("prix_unitaire").cast("double").alias("prix_unitaire"), "numero_facture", "est_retour")


@raw_query("SELECT *, lues - rejetees - importees AS doublons FROM (SELECT (SELECT count(*) FROM prep) AS lues, (SELECT count(*) FROM prep WHERE rejet) AS rejetees, (SELECT count(*) FROM kept) AS importees, (SELECT count(*) FROM kept WHERE est_retour) AS retours, CAST(0 AS BIGINT) AS replis) t", RAW_SQL, PREPARED)
def import_quality_report(spark, d):
    return cleaning.quality_of(cleaning.prepared_sales(_raw(spark, d), MAPPING))


@raw_query("""SELECT coalesce(k.c, n.c) AS code_client_externe, coalesce(k.nom, n.nom) AS nom, CASE WHEN k.c IS NULL THEN 'cree' WHEN k.nom IS NULL AND n.nom IS NOT NULL THEN 'complete' ELSE 'inchange' END AS etat FROM known k FULL JOIN (SELECT c, arg_min(nom, ordinal) FILTER (WHERE nom IS NOT NULL) AS nom FROM prep GROUP BY c) n ON k.c = n.c""", RAW_SQL, PREPARED,
    "known AS (SELECT concat('C', CAST(c_custkey AS STRING)) AS c, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS nom FROM customer)")
def customer_enrichment(spark, d):
    none = F.lit(None).cast("string")
    known = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code_client_externe"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("nom"), none.alias("email"), none.alias("pays"))
    return cleaning.enriched_clients(known, cleaning.prepared_sales(_raw(spark, d), MAPPING)).select("code_client_externe", "nom", "etat")


STOCK_NEW = "delivered AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, l_partkey AS code_produit, CAST(l_quantity AS INTEGER) AS quantite_disponible FROM lineitem)"


def _delivered(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").alias("code_produit"), F.col("l_quantity").cast("int").alias("quantite_disponible"))


@raw_query("SELECT code_produit, max(ordinal) AS ordinal FROM delivered GROUP BY 1", STOCK_NEW)
def dedup_stock_last(spark, d):
    return cleaning.keep_one(_delivered(spark, d), ["code_produit"], last=True).select("code_produit", "ordinal")


@raw_query("""SELECT coalesce(s.p_partkey, n.code) AS code_produit, coalesce(n.q, s.q) AS quantite_disponible, coalesce(s.seuil_alerte, 10) AS seuil_alerte FROM (SELECT p_partkey, CAST(p_size AS INTEGER) AS q, CAST(20 + p_size AS INTEGER) AS seuil_alerte FROM part WHERE p_partkey % 3 <> 0) s
  FULL JOIN (SELECT p_partkey AS code, CAST(p_size * 2 AS INTEGER) AS q FROM part WHERE p_partkey % 2 = 0) n ON s.p_partkey = n.code""")
def stock_upsert(spark, d):
    part = table(spark, d, "part")
    known = part.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("code_produit"), F.col("p_size").cast("int").alias("quantite_disponible"), (F.col("p_size") + 20).cast("int").alias("seuil_alerte"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("code_produit"), (F.col("p_size") * 2).cast("int").alias("quantite_disponible"))
    return cleaning.upserted_stock(known, new)


@raw_query("SELECT c_custkey, concat('CLI-', CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS STRING), 4, '0') ELSE CAST(c_custkey AS STRING) END) AS client, concat('FAC-', lpad(CAST(c_custkey AS STRING), 6, '0')) AS facture FROM customer")
def code_formatting(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.client_code(F.col("c_custkey")).alias("client"), text.invoice_number(F.col("c_custkey")).alias("facture"))


_FIELDS = {"date_col": "jour", "client_col": "client", "montant_col": "montant", "prix_unitaire_col": "prix", "quantite_col": "qte", "code_produit_col": None, "description_produit_col": None, "numero_facture_col": "facture", "pays_col": None, "nom_client_col": "nom", "email_client_col": None}


@raw_query("SELECT champ, colonne, (SELECT count(*) FROM raw) AS n_lignes, (SELECT count(DISTINCT client) FROM raw) AS clients, (SELECT count(*) - count(montant) FROM raw) AS montants_nuls FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in _FIELDS.items()) + ") AS t(champ, colonne)", RAW_SQL)
def ingest_preview_profile(spark, d):
    """What the preview of the raw rows proposes for each field of sales, with their number."""
    rows = _raw(spark, d).withColumns({c: F.col(c).try_cast("double") for c in ("qte", "prix", "montant")})
    got = files.preview(rows)
    said = spark.createDataFrame(list(got["mapping_suggere"]["transactions"].items()), "champ string, colonne string")
    profile = rows.agg(F.countDistinct("client").alias("clients"), F.count_if(F.col("montant").isNull()).alias("montants_nuls"))
    return said.withColumn("n_lignes", F.lit(got["n_lignes"]).cast("long")).crossJoin(F.broadcast(profile))  # one row


# --- SQL from outside ---


def _agent(m: Model, sql: str) -> DataFrame:
    tables = {"clients": m.clients, "transactions": m.transactions, "stocks_produits": m.stocks, "tresorerie": m.cash}
    return readonly_sql.ReadOnly(m.clients.sparkSession, tables).frame(sql)


ROLLUP = "SELECT pays, est_retour, count(*) AS n, CAST(sum(montant) AS DOUBLE) AS ca FROM transactions t JOIN clients c ON t.client_id = c.client_id GROUP BY ROLLUP(pays, est_retour)"
WINDOWED = "SELECT code_produit, mois, ca, rank() OVER (PARTITION BY mois ORDER BY ca DESC, code_produit) AS rang FROM (SELECT code_produit, month(date_transaction) AS mois, CAST(sum(montant) AS DOUBLE) AS ca FROM transactions WHERE NOT est_retour GROUP BY 1, 2) x"
SETS = "SELECT client_id FROM transactions WHERE est_retour INTERSECT SELECT client_id FROM clients WHERE pays LIKE '%A%' EXCEPT SELECT client_id FROM transactions WHERE quantite > 49 UNION SELECT client_id FROM clients WHERE client_id < 5"


@query(ROLLUP)
def agent_rollup_ca(m):
    return _agent(m, ROLLUP)


@query("SELECT code_produit, CAST(mois AS INTEGER) AS mois, ca, CAST(rang AS INTEGER) AS rang FROM (" + WINDOWED + ") w")
def agent_window(m):
    return _agent(m, WINDOWED)


@query(SETS)
def agent_setops(m):
    return _agent(m, SETS)


CUBED = "SELECT pays, est_retour, grouping(pays) AS tous_pays, grouping(est_retour) AS tous_retours, count(*) AS n FROM transactions t JOIN clients c ON t.client_id = c.client_id GROUP BY CUBE(pays, est_retour)"
SETS_OF = "SELECT pays, mois, count(DISTINCT client_id) AS clients, sum(quantite) AS unites FROM (SELECT t.client_id, quantite, pays, month(date_transaction) AS mois FROM transactions t JOIN clients c ON t.client_id = c.client_id) x GROUP BY GROUPING SETS ((pays), (mois), ())"
OUTER = "SELECT coalesce(a.client_id, b.client_id) AS client_id, a.achats, b.retours FROM (SELECT client_id, count(*) AS achats FROM transactions WHERE NOT est_retour AND quantite > 45 GROUP BY client_id) a FULL OUTER JOIN (SELECT client_id, count(*) AS retours FROM transactions WHERE est_retour AND quantite > 45 GROUP BY client_id) b ON a.client_id = b.client_id"


@query(CUBED)
def agent_cube(m):
    return _agent(m, CUBED).select("pays", "est_retour", F.col("tous_pays").cast("long"), F.col("tous_retours").cast("long"), "n")


@query("SELECT pays, CAST(mois AS INTEGER) AS mois, clients, CAST(unites AS BIGINT) AS unites FROM (" + SETS_OF + ") g")
def agent_grouping_sets(m):
    return _agent(m, SETS_OF)


@query(OUTER)
def agent_full_outer(m):
    return _agent(m, OUTER)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["top_clients_ca"](spark, sf_dir)
