"""Canonical tables, as DDL, and business constants."""

from __future__ import annotations

CLIENTS = "client_id STRING, code_client_externe STRING, nom STRING, email STRING, pays STRING, recence_jours INT, frequence_achats BIGINT, montant_total DECIMAL(14,2), score_r INT, score_f INT, score_m INT, segment_rfm STRING, cluster_id INT, score_churn DOUBLE, date_maj_segmentation TIMESTAMP_NTZ"
TRANSACTIONS = "transaction_id STRING, client_id STRING, numero_facture STRING, code_produit STRING, description_produit STRING, quantite INT, prix_unitaire DECIMAL(12,2), date_transaction TIMESTAMP_NTZ, pays STRING, est_retour BOOLEAN"
STOCKS = "code_produit STRING, nom_produit STRING, quantite_disponible INT, seuil_alerte INT, seuil_reapprovisionnement INT, delai_livraison_jours INT, cout_unitaire DECIMAL(12,2)"
CASH = "mouvement_id STRING, date_mouvement DATE, type_mouvement STRING, categorie STRING, montant DECIMAL(14,2), solde_apres_mouvement DECIMAL(18,2)"
HISTORY = "execution_id STRING, date_execution TIMESTAMP_NTZ, algorithme STRING, n_clients BIGINT, n_clients_hors_fenetre BIGINT, fenetre_jours INT, date_reference TIMESTAMP_NTZ, k_choisi INT, eps_choisi DOUBLE, silhouette DOUBLE, davies_bouldin DOUBLE, calinski_harabasz DOUBLE, repartition_segments STRING, diagnostics STRING, avertissements STRING"

# Fixed values of the business rules.
WINDOW_DAYS, WINSOR_PERCENTILE, TUKEY = 365, 99.0, 1.5
SCORE_FIDELE, SCORE_ATYPIQUE = 3, 4
NOUVEAU, FIDELE, RISQUE, OCCASIONNEL, ATYPIQUE, PERDU = "Nouveau", "Fidèle", "À risque", "Occasionnel", "Atypique (B2B/grossiste)", "Perdu"
ACTIONS = {
    FIDELE: "Programme de fidélité, offres premium",
    RISQUE: "Campagne de relance ciblée, alerte automatique dans le tableau de bord",
    OCCASIONNEL: "Offres de découverte, incitation au réachat",
    NOUVEAU: "Séquence d'onboarding",
    ATYPIQUE: "Compte dédié, tarification négociée — à exclure des campagnes grand public",
    PERDU: "Campagne de réactivation à faible coût (offre de retour) ; sinon exclure des campagnes coûteuses",
}
K_RANGE, SEED, DBSCAN_MIN, EPS_CANDIDATES, SILHOUETTE_SAMPLE = range(2, 7), 42, 5, 8, 10_000
GROUPS, NOISE_MAX = (2, 8), 0.10
MIN_HISTORY, MIN_HISTORY_TREES, TEST_SHARE, TEST_MIN = 7, 14, 0.2, 3
TREES, TREE_DEPTH, TREE_RATE = 200, 4, 0.05
REFERENCE_DAYS, HISTORY_DAYS, TREND, DIVERGENCE, BREAK = 30, 90, 0.05, 0.20, 0.5
PARETO, CASH_MARGIN = 0.8, 0.15
REORDER_DAYS, LEAD_DEFAULT, REORDER_LIST = 30, 7, 15
STOCK_DEFAULTS = (10, 20, 7)
ROWS_READ, ROWS_SHOWN, SQL_SECONDS, MAX_QUERIES = 200, 50, 5, 3
