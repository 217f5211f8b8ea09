"""DBSCAN and k-th neighbours against brute force: dense cells, equal points, far outliers; and how much they write."""

import numpy as np
import pytest
from comptoir.operators import clusters, density
from comptoir.plans import queries
from comptoir.sources.model import from_star
from test_engine import brute_dbscan, points_frame


def crowds(seed, n):
    """Blobs of unlike density, planes, a bridge between two of them, equal points and an outlier."""
    draw = np.random.default_rng(seed)
    plane = np.concatenate([draw.normal(size=(n, 2)), draw.integers(0, 4, (n, 1)) * 0.21], axis=1)
    parts = [draw.normal(size=(n, 3)) * 0.1 + 5, draw.normal(size=(n // 4, 3)) + [9, 0, 0], plane, np.zeros((n // 3, 3)) - 3, [[60.0, 60, 60]], np.linspace([5, 5, 5], [7, 5, 5], 12)]
    return np.concatenate(parts).round(3)


@pytest.mark.parametrize("seed, pairs", [(1, density.PAIRS), (2, 1)])
def test_dbscan_of_crowds_equals_brute_force(spark, seed, pairs):
    x, radii = crowds(seed, 250), [0.08, 0.2, 0.5]
    order = np.random.default_rng(seed).permutation(len(x))
    df = points_frame(spark, x[order]).repartition(3)
    for e, got in zip(radii, density.dbscan_sweep(df, radii, 5, pairs=pairs), strict=True):
        rows = {r["client_id"]: r["cluster_id"] for r in got.collect()}
        assert [rows[i] for i in range(len(x))] == brute_dbscan(x[order], e, 5).tolist(), e


def test_cells_that_only_their_halves_can_tell(spark):
    # two crowded cells whose boxes overlap epsilon, with nothing in reach, and then with a single pair in reach
    draw = np.random.default_rng(3)
    a = draw.uniform(0, 0.5, (400, 3)) * [1, 1, 0.1]
    b = draw.uniform(0, 0.5, (400, 3)) * [1, 1, 0.1] + [0, 0, 1.04]
    near = np.array([[0.1, 0.1, 0.05], [0.1, 0.1, 1.0499]])
    for x in (np.concatenate([a, b]), np.concatenate([a, b, near])):
        got = {r["client_id"]: r["cluster_id"] for r in density.dbscan_sweep(points_frame(spark, x), [1.0], 5, pairs=8)[0].collect()}
        assert [got[i] for i in range(len(x))] == brute_dbscan(x, 1.0, 5).tolist()


def test_ten_thousand_equal_points_and_an_outlier(spark):
    same = spark.range(10_000).selectExpr("CAST(id AS INT) AS client_id", "0D AS z_r", "0D AS z_f", "0D AS z_m")
    far = points_frame(spark, [(0.3, 0, 0), (1e6, 0, 0), (0.3, 0.1, 0)]).selectExpr("client_id + 10000 AS client_id", "z_r", "z_f", "z_m")
    df = same.unionByName(far)
    got = {(r["cluster_id"], r["client_id"] >= 10_000): r["n"] for r in clusters.dbscan(df, 0.35, 5).groupBy("cluster_id", (clusters.F.col("client_id")).alias("client_id")).agg(clusters.F.count("*").alias("n")).groupBy("cluster_id", clusters.F.when(clusters.F.col("client_id") >= 10_000, 10_000).otherwise(0).alias("client_id")).agg(clusters.F.sum("n").alias("n")).collect()}
    assert got == {(0, False): 10_000, (0, True): 2, (-1, True): 1}
    curve = {r["client_id"]: r["distance"] for r in clusters.knn_distances(df).where("client_id >= 9999").collect()}
    assert curve[9999] == 0.0 and curve[10_000] == 0.3 and curve[10_001] == pytest.approx(1e6 - 0.0, rel=1e-6)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_kth_distances_of_crowds_equal_brute_force(spark, k):
    x = crowds(4, 150)
    gap = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, k]
    got = {r["client_id"]: r["distance"] for r in clusters.knn_distances(points_frame(spark, x), k).collect()}
    assert np.allclose([got[i] for i in range(len(x))], gap)


def test_links_follow_cells_not_pairs(spark):
    # ten times the points in the same space: as many cells, so no more links
    def links(n):
        x = np.random.default_rng(6).uniform(0, 3, (n, 3))
        df = points_frame(spark, x).withColumnRenamed("client_id", "place").withColumn("weight", clusters.F.lit(1))
        seen = []
        whole = density.cell_links
        density.cell_links = lambda *a: seen.append(whole(*a)) or seen[0]
        try:
            density.dbscan_places(df, [0.6], 5)
        finally:
            density.cell_links = whole
        return seen[0].count()

    few, many = links(10_000), links(30_000)
    assert many <= 1.3 * few < 62 * 1000


def test_the_sweep_of_the_given_customers(spark):
    m = from_star(spark, "/root/testdata/sf0.001")
    base = queries._base(m)
    x = base.orderBy("client_id").select("client_id", *clusters.AXES).toPandas()
    curve = clusters.knn_distances(base)
    radii = clusters.eps_candidates(curve)
    assert clusters.elbow(curve).first()["epsilon"] in radii and len(radii) >= 8
    for e, got in zip(radii, clusters.dbscan_sweep(base, radii), strict=True):
        rows = {r["client_id"]: r["cluster_id"] for r in got.collect()}
        assert [rows[i] for i in x["client_id"]] == brute_dbscan(x[clusters.AXES].to_numpy(), e, 5).tolist()


def test_kth_neighbours_need_two_rounds(spark, monkeypatch):
    # three places so near one another that a tiny cell holds them, and the next ones far away
    draw = np.random.default_rng(8)
    x = np.repeat(draw.uniform(0, 9, (60, 3)), 3, axis=0) + draw.uniform(0, 1e-5, (180, 3))
    rounds, met = [], density._met
    monkeypatch.setattr(density, "_met", lambda *a: rounds.append(1) or met(*a))
    got = {r["client_id"]: r["distance"] for r in clusters.knn_distances(points_frame(spark, x), 5).collect()}
    gap = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 5]
    assert np.allclose([got[i] for i in range(len(x))], gap) and len(rounds) <= 2


def test_measures_make_labels_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    x = np.random.default_rng(9).normal(size=(300, 3)) + np.arange(300)[:, None] % 3 * 9
    df = points_frame(spark, x).withColumn("cluster_id", clusters.F.pmod("client_id", clusters.F.lit(3)))
    got = clusters.measures(df.mapInPandas(counted, df.schema))
    assert seen.value == 300 and got["silhouette"] > 0.7 and got["davies_bouldin"] < 0.5 and got["calinski_harabasz"] > 1000


def test_davies_bouldin_of_many_clusters_meets_few_pairs(spark, monkeypatch):
    # 4,000 clusters of unlike width, a few very wide, some with equal centres, some of equal points; most are small
    draw = np.random.default_rng(11)
    mid, width = draw.uniform(0, 9, (4000, 3)), draw.exponential(0.02, 4000) + 0.001
    width[:8], width[8:40], mid[41] = draw.uniform(0.5, 3, 8), 0, mid[40]
    x = np.concatenate([mid + width[:, None], mid - width[:, None]])
    df = points_frame(spark, x).withColumn("cluster_id", clusters.F.pmod("client_id", clusters.F.lit(4000)))
    mid, width = (x[:4000] + x[4000:]) / 2, np.sqrt(((x[:4000] - x[4000:]) ** 2).sum(1)) / 2
    gap = np.sqrt(((mid[:, None] - mid) ** 2).sum(-1))
    gap[gap == 0] = np.inf
    seen, met = [], clusters._met
    monkeypatch.setattr(clusters, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    got = clusters.davies_bouldin(df).first()["davies_bouldin"]
    assert got == pytest.approx(((width[:, None] + width) / gap).max(1).mean(), rel=1e-9)
    assert len(seen) == 1 and seen[0].count() < 100 * 4000


def test_davies_bouldin_of_many_clusters_without_width(spark):
    df = points_frame(spark, np.random.default_rng(12).uniform(0, 9, (1500, 3))).withColumn("cluster_id", clusters.F.col("client_id"))
    assert clusters.davies_bouldin(df).first()["davies_bouldin"] == 0


@pytest.mark.parametrize("block", [0, 12, 300])
def test_dbscan_of_crowds_in_blocks_of_any_size(spark, monkeypatch, block):
    # 0: every radius is crowded and meets by joins; 12: many blocks for the small radius, none for the others; 300: all in blocks
    x, radii = crowds(5, 150), [0.08, 0.2, 0.5]
    df, met, seen, sizes, shifts = points_frame(spark, x).repartition(3), density._met, [], [], density._shifts
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "_met", lambda *a: seen.append(1) or met(*a))
    monkeypatch.setattr(density, "_shifts", lambda *a: sizes.append(shifts(*a)) or sizes[-1])
    for key in ("client_id", "CAST(client_id + 1000 AS STRING)"):
        for e, got in zip(radii, density.dbscan_sweep(df.withColumn("client_id", clusters.F.expr(key)), radii, 5), strict=True):
            rows = {int(r["client_id"]) % 1000: r["cluster_id"] for r in got.collect()}
            assert [rows[i] for i in range(len(x))] == brute_dbscan(x, e, 5).tolist(), (key, e)
        if key != "client_id" or block != 300:
            break
    assert bool(seen) == (None in sizes[0].values()) == (block < 300)


def test_few_links_leave_their_block(spark):
    # a filled cube is one cluster, whose inner cells name the smallest of their block and need no search for components
    x = np.random.default_rng(13).uniform(0, 40, (20_000, 3))
    seen, made = [], density.cell_links
    density.cell_links = lambda *a: seen.append(made(*a)) or seen[0]
    try:
        got = density.dbscan_sweep(points_frame(spark, x), [2.5], 5)[0]
        assert got.where("cluster_id = 0").count() > 19_000
    finally:
        density.cell_links = made
    cells = len(np.unique(np.floor(x / (2.5 / 3**0.5)), axis=0))
    assert seen[0].count() < 1.5 * cells


def test_a_sweep_makes_the_labels_of_all_radii_together(spark):
    # a candidate's rows are read from what is made already: no join is left in its plan
    x = crowds(7, 100)
    for got in density.dbscan_sweep(points_frame(spark, x), [0.1, 0.3], 5):
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.columns == ["client_id", *clusters.AXES, "cluster_id"]


def test_measures_of_rows_in_one_table_of_clusters(spark, monkeypatch):
    x = np.random.default_rng(14).normal(size=(240, 3)) + np.arange(240)[:, None] % 4 * 7
    df = points_frame(spark, x).withColumn("cluster_id", clusters.F.pmod("client_id", clusters.F.lit(4)))
    alone = {"silhouette": clusters.silhouette, "davies_bouldin": clusters.davies_bouldin, "calinski_harabasz": clusters.calinski_harabasz}
    want = {n: f(df).first()[0] for n, f in alone.items()}
    seen, spreads = [], clusters._spreads
    monkeypatch.setattr(clusters, "_spreads", lambda *a: seen.append(1) or spreads(*a))
    got = clusters.measures(df)
    assert len(seen) == 1 and got == pytest.approx(want, rel=1e-9)
    assert set(clusters.measures(df.where("cluster_id = 0")).values()) == set(clusters.measures(df.limit(0)).values()) == {None}
