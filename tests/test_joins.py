"""As-of and range joins, and sketches, against brute force; plans without nested loops."""

import random
from datetime import date, timedelta

import pytest
from comptoir.operators import joins, sketches
from comptoir.plans import queries
from comptoir.sources.stores import Store
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(seed, n, keys, times):
    draw = random.Random(seed)
    row = lambda i: (draw.choice(keys), draw.choice(times), i)
    return [row(i) for i in range(n)] + [(None, 3, -1), ("a", None, -2)], [row(i) for i in range(n)] + [(None, 3, 999), ("a", None, 998)]


def brute_asof(left, right, strict=False, forward=False, within=None):
    out = []
    for k, t, i in left:
        sign = -1 if forward else 1
        fits = [(sign * u, v, u) for kk, u, v in right if None not in (k, t, kk, u) and kk == k and (sign * u < sign * t or (u == t and not strict)) and (within is None or abs(t - u) <= within)]
        best = max(fits, default=(None, None, None))
        out.append((k, t, i, best[2], best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict, forward, within", [(False, False, None), (True, False, None), (False, True, None), (True, True, 5), (False, False, 2)])
def test_asof_equals_brute_force(spark, strict, forward, within):
    left, right = sides(1, 300, ["a", "a", "a", "b", "c"], [*range(0, 200, 3), 7, 7, 7, 7])
    l, r = spark.createDataFrame(left, "k string, t int, i int").repartition(3), spark.createDataFrame(right, "k string, t int, v int").repartition(3)
    got = joins.asof_join(l, r, ["k"], "t", "t", ties=("v",), strict=strict, forward=forward, within=within)
    assert got.columns == ["k", "t", "i", "derniere_v", "derniere_t"] or got.columns == ["k", "t", "i", "derniere_t", "derniere_v"]
    assert sorted([tuple(x) for x in got.select("k", "t", "i", "derniere_t", "derniere_v").collect()], key=str) == brute_asof(left, right, strict, forward, within)


def test_asof_of_one_key_is_many_tasks_work(spark):
    # one key and a time that a third of all rows share: the rows of a window are those of a block, each time once
    left = spark.range(60_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id") % 9973).alias("t"), "id")
    right = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 10_007).alias("t"), F.col("id").alias("v"))
    got = joins.asof_join(left, right, ["k"], "t", "t", ties=("v",))
    last = {}
    for v in range(20_000):
        last[v * 7 % 10_007] = max(v, last.get(v * 7 % 10_007, -1))
    assert got.count() == 60_000 and got.where("derniere_t != t").count() == 0
    assert {(r["t"], r["derniere_v"]) for r in got.select("t", "derniere_v").distinct().collect()} == {(t, last[t]) for t in {5000, *range(9973)}}
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_asof_times_and_empty_sides(spark):
    l = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-02 10:00:00' AS t UNION ALL SELECT 1, TIMESTAMP '2024-01-01 10:00:00'")
    r = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-02 09:59:59.5' AS u, 'x' AS v")
    assert sorted(str(x["derniere_v"]) for x in joins.asof_join(l, r, ["k"], "t", "u").collect()) == ["None", "x"]
    assert joins.asof_join(l, r, ["k"], "t", "u", within=100_000, inner=True).count() == 0
    assert joins.asof_join(l, r.limit(0), ["k"], "t", "u").count() == 2 and joins.asof_join(l.limit(0), r, ["k"], "t", "u").count() == 0


@pytest.mark.parametrize("seed, longest", [(1, 0), (2, 3), (3, 400)])
def test_ranges_equal_brute_force(spark, seed, longest):
    draw = random.Random(seed)

    def rows(n):
        out = []
        for i in range(n):
            a = draw.randrange(-200, 200)
            out.append((draw.choice(["a", "b"]), a, a + (draw.randrange(longest + 1) if draw.random() < 0.7 else draw.choice([0, longest])), i))
        return out + [("a", 5, 1, 900), ("a", None, 4, 901), ("a", 1, None, 902), (None, 0, 9, 903), ("a", 7, 7, 904), ("a", 7, 7, 904)]

    left, right = rows(150), rows(170)
    schema = "k string, a int, b int, i int"
    l, r = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(2)
    fits = lambda x, y: None not in (x[1], x[2], y[1], y[2]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[0] is not None and fits(x, y))
    got = joins.range_join(l, r, ("a", "b"), ("a", "b"), on=["k"])
    assert sorted((x["i"], x["r_i"]) for x in got.collect()) == want
    free = joins.range_join(l, r, ("a", "b"), ("a", "b"), outer=True)
    want = [(x[3], y[3]) for x in left for y in right if fits(x, y)]
    want += [(x[3], None) for x in left if not any(fits(x, y) for y in right)]
    assert sorted((str(x["i"]), str(x["r_i"])) for x in free.collect()) == sorted((str(a), str(b)) for a, b in want)
    assert "NestedLoop" not in plan(got) + plan(free) and "Cartesian" not in plan(got) + plan(free)
    assert joins.range_join(l.limit(0), r, ("a", "b"), ("a", "b")).count() == 0


def test_ranges_of_times_and_reals(spark):
    l = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS a, TIMESTAMP '2024-01-01 12:00:00' AS b")
    r = spark.sql("SELECT TIMESTAMP '2024-01-01 12:00:00' AS t UNION ALL SELECT TIMESTAMP '2024-01-01 12:00:00.000001'")
    assert joins.range_join(l, r, ("a", "b"), ("t", "t")).count() == 1
    x = spark.sql("SELECT 0.1D AS a, 0.3D AS b UNION ALL SELECT 1e-9D, 1e9D")
    assert joins.range_join(x, x, ("a", "b"), ("a", "b")).count() == 4


def test_overlap_totals_equal_brute_force(spark):
    draw, first = random.Random(4), date(2024, 1, 1)
    rows = [(draw.choice(["a", "b"]), draw.randrange(60), first + timedelta(a := draw.randrange(300)), first + timedelta(a + draw.choice([0, 1, 5, 90, -3]))) for _ in range(150)]
    rows += [("a", 1, None, first), ("a", None, first, first), (None, 2, first, first), ("alone", 3, first, first), ("alone", 3, first, first)]
    want = {}
    for i, (k, x, a, b) in enumerate(rows):
        for kk, y, c, d in rows[:i]:
            if k == kk and None not in (k, x, y, a, b, c, d) and x != y and a <= b and c <= d and a <= d and c <= b:
                n, days = want.get(k, (0, 0))
                want[k] = n + 1, days + (min(b, d) - max(a, c)).days + 1
    got = joins.overlap_totals(spark.createDataFrame(rows, "k string, x int, a date, b date").repartition(3), ("a", "b"), ["k"], "x")
    assert {r["k"]: (r["paires"], r["jours"]) for r in got.collect()} == want
    # 200,000 spans of one key that all overlap: 2 * 10^10 pairs
    n = 200_000
    many = spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(first).alias("a"), F.lit(first + timedelta(2)).alias("b"))
    assert joins.overlap_totals(many, ("a", "b"), ["k"], "id").collect() == [(1, n * (n - 1) // 2, 3 * n * (n - 1) // 2)]


def test_lines_after_large_orders_meet_days_not_lines(spark, tmp_path):
    # a hundred thousand lines of one day, and 300 orders of that day in the top hundredth
    orders = spark.range(30_000).select(F.col("id").alias("o_orderkey"), F.lit("2024-01-01").cast("timestamp").alias("o_orderdate"), F.col("id").cast("double").alias("o_totalprice"))
    lines = spark.range(100_000).select(F.col("id").alias("l_orderkey"), F.lit("2024-01-01").cast("timestamp").alias("l_shipdate"), F.lit(2.0).alias("l_quantity"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = queries.QUERIES["range_lines_after_large_orders"](spark, str(tmp_path))
    got = df.collect()
    assert len(got) == 300 and {(r["lignes"], r["unites"]) for r in got} == {(100_000, 200_000.0)} and min(r["o_orderkey"] for r in got) == 29_700
    assert "l_quantity" not in plan(df)  # lines are summed up by day before orders meet them


@pytest.mark.parametrize("name", ["asof_last_price", "range_lines_after_large_orders", "range_launches_that_overlap"])
def test_queries_hold_no_nested_loop(spark, name):
    df = queries.QUERIES[name](spark, SF)
    df.collect()
    said = plan(df)
    assert "Cartesian" not in said
    # the one row of a limit is the only side that may be met without keys
    assert said.count("NestedLoop") <= (2 if name == "range_lines_after_large_orders" else 0)


def test_sketches_of_days_unite(spark, tmp_path):
    first = date(2024, 1, 1)
    rows = spark.createDataFrame([(first + timedelta(i % 40), i * 7919 % 3000, "ab"[i % 2]) for i in range(20_000)] + [(None, 1, "a"), (first, None, "a")], "d date, v int, g string")
    store = Store(spark, str(tmp_path))
    for part in (rows.where("d < '2024-01-21'"), rows.where("d >= '2024-01-15' OR d IS NULL")):  # six days come twice
        sketches.keep_sketches(store, "jours", sketches.daily_sketches(part, F.col("d"), "v", ("g",)))
    kept = store.read("jours")
    for a, b in ((None, None), ("2024-01-10", "2024-01-10"), ("2024-01-03", "2024-02-01")):
        span = rows.where("d IS NOT NULL") if a is None else rows.where(f"d BETWEEN '{a}' AND '{b}'")
        exact = span.select("v").dropna().distinct().count()
        told = sketches.distinct_between(kept, a, b).first()["distincts"]
        assert abs(told - exact) <= max(1, exact * sketches.error_bound())
    assert {r["g"] for r in sketches.distinct_between(kept, by=("g",)).collect()} == {"a", "b"}
    assert sketches.distinct_between(kept.limit(0)).first()["distincts"] == 0


@pytest.mark.parametrize("strict, within, inner", [(False, None, False), (True, 5, True)])
def test_asof_of_busy_keys_and_others(spark, strict, within, inner):
    left, right = sides(2, 400, ["a"] * 6 + ["b", "c"], [*range(0, 200, 3), 7, 7, 7, 7])
    l, r = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int")
    wanted = [x for x in brute_asof(left, right, strict, within=within) if x[4] is not None or not inner]
    for busy in (0, 300, 10_000):  # all keys, some, none dealt on
        got = joins.asof_join(l, r, ["k"], "t", "t", ties=("v",), strict=strict, within=within, inner=inner, busy=busy)
        assert sorted([tuple(x) for x in got.select("k", "t", "i", "derniere_t", "derniere_v").collect()], key=str) == wanted


def test_asof_sends_rows_of_many_keys_once(spark):
    # keys of a few rows each: one shuffle of both sides, no join back
    left = spark.range(2000).selectExpr("id % 200 AS k", "CAST(id AS INT) AS t", "id AS i")
    right = spark.range(2000).selectExpr("id % 200 AS k", "CAST(id AS INT) AS t", "id AS v")
    got = joins.asof_join(left, right, ["k"], "t", "t", ties=("v",))
    assert got.where("derniere_v = i").count() == 2000
    said = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in said and said.count("Exchange") == 1
