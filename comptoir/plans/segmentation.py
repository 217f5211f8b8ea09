"""The segmentation pipeline: scores, three algorithms or one, comparison, segments, history and its reading."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comptoir import schemas as S
from comptoir.operators import clusters, segments
from comptoir.session import cut
from comptoir.sources.stores import Store

ALGORITHMS = ("kmeans", "gmm", "dbscan")
NAMES = {"kmeans": "K-Means", "gmm": "Mélange gaussien", "dbscan": "DBSCAN"}


@dataclass
class Fit:
    """One algorithm's choice: labels (client_id, cluster_id), its measures and every candidate tried."""

    algorithme: str
    k: int | None = None
    eps: float | None = None
    silhouette: float | None = None
    davies_bouldin: float | None = None
    calinski_harabasz: float | None = None
    n_groupes: int = 0
    part_bruit: float = 0.0
    smallest: float | None = None
    diagnostics: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    labels: DataFrame | None = None


def _tried(rows: DataFrame, value: float, k: int) -> dict:
    rows = cut(rows.select("client_id", "cluster_id", *clusters.AXES))
    n = rows.agg(F.count("*"), F.count_if(F.col("cluster_id") == -1), F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id")))).first()
    return {"k": k, "inertie": value, **clusters.measures_of(rows.where("cluster_id != -1")), "n_clusters": n[2], "n_bruit": n[1], "n": n[0]}


def fit(rows: DataFrame, algorithm: str, k_min: int = 2, k_max: int = 6, starts: int | None = None) -> Fit:
    """Tries all candidates (k up to n - 1) and keeps that of the highest silhouette (the first on ties); DBSCAN without any takes the elbow of the k-distances."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}: one of {ALGORITHMS}")
    got, candidates = Fit(algorithm), []  # (value, k, labelled rows)
    n, corner = rows.count(), None
    if algorithm == "dbscan":
        curve = cut(clusters.knn_distances(rows))
        if n > clusters.least_neighbours(n) + 1:
            corner, radii = clusters.elbow(curve).first()["epsilon"], clusters.eps_candidates(curve)
            candidates = [(e, i, labelled) for i, (e, labelled) in enumerate(zip(radii, clusters.dbscan_sweep(rows, radii), strict=True))] if radii else []
    else:
        sweep, times = (clusters.kmeans_sweep, starts or 10) if algorithm == "kmeans" else (clusters.mixture_sweep, starts or 5)
        found = sweep(rows, list(range(k_min, min(k_max, n - 1) + 1)), times, S.SEED, clusters.AXES)
        candidates = [(value, k, labelled) for k, (labelled, value) in found.items()]
    with ThreadPoolExecutor(max(1, min(4, len(candidates)))) as pool:
        tried = list(pool.map(lambda c: (_tried(c[2], c[0], c[1]), c[2]), candidates))
    got.diagnostics = [t for t, _ in tried]
    if not tried:
        got.warnings.append("aucun candidat")
        return got
    best, labelled = max(tried, key=lambda t: (t[0]["silhouette"] is not None, t[0]["silhouette"] or 0))
    if best["silhouette"] is None:
        got.warnings.append("silhouette non calculable : coude retenu" if corner else "silhouette non calculable : premier candidat retenu")
        if corner:  # no candidate separates groups
            labelled = clusters.dbscan(rows, corner)
            best = _tried(labelled, corner, len(tried))
    got.k, got.eps = (None, best["inertie"]) if algorithm == "dbscan" else (best["k"], None)
    got.silhouette, got.davies_bouldin, got.calinski_harabasz = best["silhouette"], best["davies_bouldin"], best["calinski_harabasz"]
    got.n_groupes, got.part_bruit = best["n_clusters"], best["n_bruit"] / max(1, best["n"])
    got.labels = labelled.select("client_id", "cluster_id")
    got.smallest = got.labels.where("cluster_id != -1").groupBy("cluster_id").count().agg(F.min("count")).first()[0]
    got.smallest = got.smallest and got.smallest / max(1, best["n"] - best["n_bruit"])
    return got


def fits_of(rows: DataFrame, names: tuple[str, ...] = ALGORITHMS, k_min: int = 2, k_max: int = 6, starts: int | None = None) -> list[Fit]:
    """The fit of each algorithm, in parallel jobs."""
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(lambda a: fit(rows, a, k_min, k_max, starts), names))


def compared(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """One row for each algorithm with its measures, eligibility and rank."""
    rows = [(f.algorithme, f.k, f.eps, f.silhouette, f.davies_bouldin, f.calinski_harabasz, f.n_groupes, f.part_bruit) for f in fits]
    return clusters.ranking(spark.createDataFrame(rows, "algorithme string, k_choisi int, eps_choisi double, silhouette double, davies_bouldin double, calinski_harabasz double, n_groupes int, part_bruit double"))


def interpretation(f: Fit, ranked: dict) -> list[str]:
    """Sentences on one algorithm, always the same for the same figures."""
    if f.silhouette is None:
        return [f"{NAMES[f.algorithme]} : un seul groupe exploitable, aucune segmentation."]
    quality = "forte" if f.silhouette > 0.70 else "raisonnable" if f.silhouette > 0.50 else "faible" if f.silhouette > 0.25 else "non substantielle"
    out = [f"{NAMES[f.algorithme]} : {f.n_groupes} groupes, structure {quality} (silhouette {f.silhouette:.3f})".replace(".", ",") + "."]
    told = [d for d in f.diagnostics if d["silhouette"] is not None]
    if f.eps is not None:
        out.append(f"Rayon {f.eps:.3f}, le meilleur de {len(f.diagnostics)} essais.".replace(".", ",", 1))
    elif told:
        low = min(told, key=lambda d: d["silhouette"])
        out.append(f"k={f.k} est le meilleur de {f.diagnostics[0]['k']} à {f.diagnostics[-1]['k']} ; k={low['k']} sépare le moins.")
    if f.algorithme == "gmm" and f.diagnostics:
        least = min(f.diagnostics, key=lambda d: d["inertie"])["k"]
        out.append(f"Le BIC préfère k={least}" + (", comme la silhouette." if least == f.k else " ; la silhouette décide, car elle vaut pour tous les algorithmes."))
    if f.davies_bouldin is not None:
        out.append("Groupes séparés (Davies-Bouldin sous 1)." if f.davies_bouldin < 1 else "Groupes qui se recouvrent (Davies-Bouldin à 1 ou plus).")
    if f.smallest is not None:
        out.append(f"Plus petit groupe : {f.smallest * 100:.0f} % des clients.")
    if f.part_bruit:
        out.append(f"{f.part_bruit * 100:.0f} % de clients non classés.")
    out.append(f"Rang {ranked['rang']}." if ranked["eligible"] else "Non retenu : hors des bornes de groupes ou de bruit.")
    return out


@dataclass
class Result:
    clients: DataFrame
    algorithm: str | None
    fits: list[Fit]
    comparison: DataFrame
    cap: float | None
    sentences: list[str]

    def history(self, spark: SparkSession, days: int) -> DataFrame:
        """The run's row for the history table; nested values as JSON."""
        f = next((x for x in self.fits if x.algorithme == self.algorithm), Fit(self.algorithm or ""))
        counts = {r["segment_rfm"]: r["count"] for r in self.clients.groupBy("segment_rfm").count().collect()}  # six segments
        row = self.clients.agg(F.count_if(F.col("cluster_id").isNotNull()).alias("n_clients"), F.count_if(F.col("cluster_id").isNull()).alias("n_clients_hors_fenetre"))
        said = {"algorithme": self.algorithm, "fenetre_jours": days, "k_choisi": f.k, "eps_choisi": f.eps, "silhouette": f.silhouette, "davies_bouldin": f.davies_bouldin, "calinski_harabasz": f.calinski_harabasz, "repartition_segments": json.dumps(counts, ensure_ascii=False), "diagnostics": json.dumps(f.diagnostics), "avertissements": json.dumps(f.warnings, ensure_ascii=False)}
        kinds = dict(c.split() for c in S.HISTORY.split(", "))
        return row.select(F.current_timestamp().cast("timestamp_ntz").alias("date_execution"), "*", *[F.lit(v).cast(kinds[k]).alias(k) for k, v in said.items()])


def latest(history: DataFrame) -> DataFrame:
    """The row of the last run, none for an empty history."""
    return history.orderBy(F.desc_nulls_last("date_execution")).limit(1)


def shares(clients: DataFrame) -> DataFrame:
    """For each segment its share of all segmented customers."""
    each = clients.where("segment_rfm IS NOT NULL").groupBy("segment_rfm").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("segment_rfm", F.round(F.col("n") / F.col("total"), 6).alias("part"))  # six segments, one row


def run(sales: DataFrame, algorithm: str = "auto", days: int = S.WINDOW_DAYS, percentile: float = S.WINSOR_PERCENTILE, k_min: int = 2, k_max: int = 6, starts: int | None = None) -> Result:
    """Segments every customer of sales. auto: all three algorithms, in parallel jobs, and the best eligible one; if none is, clusters by score rules."""
    spark = sales.sparkSession
    base, cap = segments.matrix(segments.scored(segments.rfm(sales, days)), percentile)
    base = cut(base)
    names = ALGORITHMS if algorithm == "auto" else (algorithm,)
    fits = fits_of(base, names, k_min, k_max, starts)
    table = compared(spark, fits)
    ranked = {r["algorithme"]: r.asDict() for r in table.collect()}  # three rows
    chosen = algorithm if algorithm != "auto" else next((a for a, r in ranked.items() if r["rang"] == 1), None)
    labels = next((f.labels for f in fits if f.algorithme == chosen), None)
    labelled = base.join(labels, "client_id") if labels is not None else segments.rule_clusters(base)
    clients = segments.segmented(sales, labelled, days)
    said = [s for f in fits for s in interpretation(f, ranked[f.algorithme])]
    said.append(f"Retenu : {NAMES[chosen]}." if chosen else "Aucun algorithme exploitable : groupes par règles de score.")
    return Result(clients, chosen, fits, table, cap, said)


def stored(store: Store, sales: DataFrame, dry_run: bool = False, days: int = S.WINDOW_DAYS, **options) -> tuple[Result, DataFrame]:
    """run, its customers written as the table clients_segmentes and its row added to historique_segmentation; the run and that row. dry_run: nothing is written."""
    got = run(sales, days=days, **options)
    row = cut(got.history(sales.sparkSession, days))
    if not dry_run:
        store.replace("clients_segmentes", got.clients)
        store.append("historique_segmentation", row)
    return got, row


def as_records(fits: list[Fit]) -> list[dict]:
    return [{k: v for k, v in asdict(f).items() if k != "labels"} if f.labels is None else {k: getattr(f, k) for k in vars(f) if k != "labels"} for f in fits]
