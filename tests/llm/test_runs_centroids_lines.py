"""Periodic runs, centroids and shared lines against brute force, and odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from comptoir.llm import centroids, lines, registry, runs
from parity import differences

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a\nb\n\nA \n a"), (4, "a\nb\n\nA \n a"), (None, "x"), (None, "\n\n"), (5, "mot " * 3000), (6, "b" * 30000), (7, "é" * 20 + "\x0bfin"), (2**53 + 1, "a\n" * 2000), (2**53 + 3, " a \nÀ\nà")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in ODD], "doc_id long, text string, `places` string, n_lines long, `runs` long").repartition(3)


# --- runs ---


def brute_runs(words, least=6, times=4):
    """(start, length, period) by comparing all places at each distance."""
    seen, n = {}, len(words)
    for q in range(1, n // times + 1):
        j = 0
        while j + q < n:
            a = j
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - a + q >= max(least, times * q):
                seen.setdefault((a, j + q), q)
            j += 1
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def told(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_run_query_equals_brute_force(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in runs.op11_runs(spark, SF).collect()}
    want = {told(r["doc_id"], r["text"]) for r in texts}
    assert got == want
    assert sum(1 for r in want if r[1]) > 5


@pytest.mark.parametrize("scanned", [1, 4, 16])
def test_runs_equal_brute_force_on_many_periods(scanned):
    draw = random.Random(scanned)

    def words():
        out, kinds, size = [], draw.choice([1, 2, 3, 5, 30]), draw.choice([0, 5, 50, 400, 900])
        while len(out) < size:
            if draw.random() < 0.5:
                base = [draw.randrange(kinds) for _ in range(draw.choice([1, 2, 3, 7, 17, 18, 40, 90]))]
                out += (base * draw.randrange(2, 9))[: draw.randrange(1, 9 * len(base))]
            else:
                out += [draw.randrange(1000) for _ in range(draw.choice([1, 3, 10, 60]))]
        return out

    many = 0
    for _ in range(60):
        docs = [words() for _ in range(draw.randrange(1, 6))]
        flat, own = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        begin = np.cumsum([0] + [len(d) for d in docs])
        want = [(s + b, s + b + n, q) for d, b in zip(docs, begin) for s, n, q in brute_runs(d)]
        assert [tuple(x) for x in runs.find_runs(flat, own, scanned=scanned).tolist()] == want
        many += len(want)
    assert many > 100


def test_runs_of_other_bounds():
    words = [1, 2] * 5 + [7] * 3 + [1, 2, 3, 1, 2, 3, 9]
    found = runs.find_runs(np.array(words), np.zeros(len(words), int), least=2, times=2).tolist()
    assert [(s, e - s, q) for s, e, q in found] == brute_runs(words, 2, 2)


def test_a_word_outside_repeated_grams_is_masked():
    words = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8, 7])
    assert runs.gram_size() == 5
    assert runs.surviving(words, np.zeros(13, int), 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False] * 2
    assert not runs.surviving(words, np.array([0] * 6 + [1] * 7), 5).any()


def test_runs_of_odd_rows(spark, odd):
    got = runs.with_runs(odd, block=1000)
    assert got.columns == ["doc_id", "text", "places", "n_lines", "runs", "collapsed"]
    rows = [(r["doc_id"], r["text"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
    words = {t: re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in ODD}
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(i, t, r) for i, t, r, _ in rows], key=key) == sorted([(i, t, brute_runs(words[t])) for i, t in ODD], key=key)
    assert {c for i, _, _, c in rows if i == 5} == {"mot"} and {c for i, _, _, c in rows if i == 1} == {""}
    assert runs.with_runs(odd.limit(0)).count() == 0


# --- centroids ---


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            if mine := [v for (_, v), o in zip(kept, own) if o == c]:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *near(v)[::-1]) for i, v in kept], centres


def vectors(count, spread):
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(6, 64)) * spread
    return [(i, (middles[i % 6] + np.round(draw.normal(size=64), 1)).tolist()) for i in range(count)]


@pytest.mark.parametrize("spread, k", [(0.0, 16), (0.5, 16), (4.0, 5), (2e5, 4), (0.5, 1)])
def test_clusters_equal_brute_force(spark, spread, k):
    rows = vectors(240, spread)
    rows += [(i, v) for i, v in rows[:40]] + [(300, None), (301, [0.0] * 63), (302, [float("nan")] * 64), (303, [float("inf")] * 64), (304, [None] + [0.0] * 63), (None, rows[0][1]), (305, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = centroids.clustered(df, k=k)
    want, centres = brute_clusters(rows, k, 3)
    order = lambda rs: sorted(map(str, rs))
    assert got.centroids.tolist() == centres
    assert order(tuple(r) for r in got.labels.collect()) == order(want)
    assert sum(got.inertia.values()) == sum(d for _, _, d in want)


def test_equally_near_centroids_give_the_smaller_number():
    rings = centroids.Rings(np.array([[4, 0], [0, 4], [-4, 0], [0, 4]]))
    x = np.array([[0, 0], [0, 4], [1, 1], [-1, 1]])
    for start in range(4):
        cluster, up, low = np.full(4, start, np.int32), np.full(4, np.inf), np.zeros(4)
        centroids.assign(x, cluster, up, low, rings)
        assert cluster.tolist() == [0, 1, 0, 1]


def test_a_ball_leaves_centroids_out():
    draw = np.random.default_rng(2)
    centres = np.array([[1000 * i, 0] for i in range(32)])
    x = centres[np.repeat(np.arange(32), 50)] + draw.integers(-20, 20, (1600, 2))
    cluster, up, low = np.repeat(np.arange(32, dtype=np.int32), 50), np.full(1600, np.inf), np.zeros(1600)
    assert centroids.assign(x, cluster, up, low, centroids.Rings(centres)) < 1600 * 5
    assert cluster.tolist() == np.repeat(np.arange(32), 50).tolist()


def test_extreme_and_missing_vectors(spark):
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {r["id"]: r["distance"] for r in centroids.clustered(df).labels.collect()} == {1: 0, 2: 0, 3: 0}
    assert max(r["distance"] for r in centroids.clustered(df, k=1).labels.collect()) == 2**60
    none = centroids.clustered(df.limit(0))
    assert none.labels.count() == 0 and not len(none.centroids) and not none.inertia


# --- lines ---


def brute_lines(rows, least):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t in rows]
    common = {k for ks in keys for k in ks if k and sum(k in other for other in keys) >= least}
    return [(i, "\n".join(x for x, k in zip((t or "").split("\n"), ks) if k not in common), len(ks), sum(k in common for k in ks)) for (i, t), ks in zip(rows, keys)]


@pytest.mark.parametrize("least", [1, 2, 4, 100])
def test_lines_equal_brute_force(spark, odd, least):
    got = lines.without_common_lines(odd, documents=least)
    assert got.columns == ["doc_id", "text", "places", "runs", "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted(brute_lines(ODD, least), key=key)
    assert lines.without_common_lines(odd.limit(0)).count() == 0


def test_a_line_of_a_third_of_all_documents(spark):
    rows = [(i, f"own {i}\nShared Line\nlast {i % 4}" if i % 3 == 0 else f"own {i}\n\n {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in lines.without_common_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()) == sorted(brute_lines(rows, 10))


@pytest.mark.parametrize("name", ["op12_centroids", "op13_lines"])
def test_equals_sql(spark, name):
    assert not differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)
