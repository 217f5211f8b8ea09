"""Balances from the earliest touched day on, snapshots of days, results made once."""

import random
import threading
import time
from datetime import date, timedelta
from pathlib import Path

import pytest
from comptoir.functions import stats
from comptoir.operators import cashflow, indicators
from comptoir.sources.stores import Cache, Lease, Store
from pyspark.sql import functions as F

SCHEMA = "mouvement_id int, date_mouvement date, sequence int, type_mouvement string, montant int"


def moves(spark, rows):
    return spark.createDataFrame([(i, None if d is None else date(2024, 1, 1) + timedelta(d), i, "encaissement" if v > 0 else "decaissement", abs(v)) for i, d, v in rows], SCHEMA)


def brute(rows):
    out, total = [], 0
    for i, d, v in sorted({r[0]: r for r in reversed(rows)}.values(), key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += v
        out.append((i, total))
    return sorted(out)


def kept(store):
    return sorted((r["mouvement_id"], r["solde_apres_mouvement"]) for r in store.read("tresorerie").collect())


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet")}


def test_batches_in_any_order_give_the_same_balances(spark, tmp_path):
    draw, store, all_ = random.Random(3), Store(spark, str(tmp_path)), []
    spans = [(20, 30), (31, 40), (10, 15), (35, 50), (36, 36), (60, 60), (1, 2)]
    for n, (a, b) in enumerate(spans):
        batch = [(100 * n + i, draw.randint(a, b), draw.choice([5, -3, 8])) for i in range(12)] + all_[:2]
        got = cashflow.merged_balances(store, moves(spark, batch + batch[:1]))
        before = dict(brute(all_)) if all_ else {}
        all_ += [r for r in batch if r[0] not in before]
        after = dict(brute(all_))
        assert kept(store) == brute(all_)
        assert got["nouveaux"] == 12 and got["ajustes"] == sum(before[i] != after[i] for i in before)
        assert got["depuis"] == (None if n == 0 else str(date(2024, 1, 1) + timedelta(min(r[1] for r in batch[:12]))))
    totals = {r["date_mouvement"]: r["flux"] for r in store.read("tresorerie", "totaux").collect()}
    per = {}
    for _, d, v in all_:
        per[date(2024, 1, 1) + timedelta(d)] = per.get(date(2024, 1, 1) + timedelta(d), 0) + v
    assert totals == per
    assert cashflow.merged_balances(store, moves(spark, all_[:3])) == {"nouveaux": 0, "depuis": None, "ajustes": 0} and kept(store) == brute(all_)


def test_days_before_the_first_touched_one_are_not_written(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(i, i, 10) for i in range(30)]
    cashflow.merged_balances(store, moves(spark, rows))
    first = files(tmp_path)
    cashflow.merged_balances(store, moves(spark, [(100, 25, -4)]))
    new = {f for f in files(tmp_path) - first if "/v2/" in f}
    assert {f.split("date_mouvement=")[1].split("/")[0] for f in new} == {str(date(2024, 1, 1) + timedelta(d)) for d in range(25, 30)}
    assert first <= files(tmp_path)  # nothing earlier is touched
    early = store.read("tresorerie").where("date_mouvement < '2024-01-10'")
    scans = early._jdf.queryExecution().executedPlan().toString()
    assert early.count() == 9 and "PartitionFilters: [isnotnull(date_mouvement" in scans or "PartitionFilters" in scans


def test_movements_without_a_day_and_appended_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("tresorerie", cashflow.balances(moves(spark, [(1, 5, 100)])))
    assert cashflow.merged_balances(store, moves(spark, [(2, 3, -30)]))["depuis"] is None  # made without totals
    assert cashflow.merged_balances(store, moves(spark, [(3, None, 7)]))["depuis"] is None
    assert kept(store) == [(1, 77), (2, -23), (3, 7)]
    assert cashflow.merged_balances(store, moves(spark, [(4, 4, 1)])) == {"nouveaux": 1, "depuis": "2024-01-05", "ajustes": 1}
    assert kept(store) == [(1, 78), (2, -23), (3, 7), (4, -22)]


def test_rows_appended_after_a_replaced_span_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *days: spark.createDataFrame([(date(2024, 1, d), d) for d in days], "jour date, v int")
    store.replace("t", rows(1, 2, 3, 4))
    store.replace_from("t", rows(3, 5), "jour", "2024-01-03")
    store.append("t", rows(2, 9))
    assert sorted(r["v"] for r in store.read("t").collect()) == [1, 2, 2, 3, 5, 9]
    store.replace_from("t", rows(8), "jour", "2024-01-02")
    assert sorted(r["v"] for r in store.read("t").collect()) == [1, 8] and store.version("t") == 4
    store.replace("t", rows(7))
    assert [r["v"] for r in store.read("t").collect()] == [7]


def test_one_busy_day_is_several_tasks_work(spark):
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("mouvement_id"), F.lit("2024-01-01").cast("date").alias("date_mouvement"), F.col("id").alias("sequence"), F.lit("encaissement").alias("type_mouvement"), F.lit(1).alias("montant"))
    got = cashflow.balances(rows)
    assert got.where("solde_apres_mouvement != sequence + 1").count() == 0 and got.count() == n
    dealt = [r["count"] for r in stats.binned(rows.withColumn("d", F.lit(7)), "d", 8, "sequence").groupBy("_bin").count().collect()]
    assert len(dealt) >= 7 and max(dealt) < 0.2 * n


def test_bins_follow_the_order_of_value_and_tie(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 2, 2, 2, 2, 2, 2, 5, 5, 5, draw.randrange(10), None]), draw.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v int, t int, i int").repartition(3)
    low = lambda x: (x is not None, x or 0)
    got = sorted(stats.binned(df, "v", 16, "t").collect(), key=lambda r: (low(r["v"]), low(r["t"])))
    assert [r["_bin"] for r in got] == sorted(r["_bin"] for r in got) and len({r["_bin"] for r in got}) >= 12
    sums = sorted(stats.running(df.dropna(), "v", {"up": F.lit(1)}, ties=("t", "i"), bins=16).collect(), key=lambda r: (r["v"], r["t"], r["i"]))
    assert [r["up"] for r in sums] == list(range(1, len(sums) + 1))


def signature(spark, n):
    return indicators.signature(spark.sql(f"SELECT false AS est_retour, date'2024-01-01' AS date_transaction, {n} AS montant"))


def test_two_sessions_make_a_result_once(spark, tmp_path):
    made, got = [], []

    def make():
        made.append(1)
        time.sleep(1.5)
        return spark.range(4)

    def ask(session):
        got.append(Cache(Store(session, str(tmp_path))).get("r", signature(session, 1), make).count())

    threads = [threading.Thread(target=ask, args=(s,)) for s in (spark, spark.newSession(), spark)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made == [1] and got == [4, 4, 4]
    assert not list(Path(tmp_path).rglob("bail-*"))


def test_a_failure_is_its_own_and_another_may_try(spark, tmp_path):
    cache = Cache(Store(spark, str(tmp_path)))
    with pytest.raises(ZeroDivisionError):
        cache.get("r", signature(spark, 1), lambda: 1 // 0)
    assert cache.get("r", signature(spark, 1), lambda: spark.range(2)).count() == 2
    assert cache.warm("w", signature(spark, 1), lambda: 1 // 0).result() is False and not cache.known("w", signature(spark, 1))
    assert cache.warm("w", signature(spark, 1), lambda: spark.range(3)).result() is True and cache.get("w", signature(spark, 1), lambda: 1 // 0).count() == 3


def test_a_lease_that_is_not_renewed_is_passed_over(spark, tmp_path):
    first, second, third = (Lease(spark, str(tmp_path / "l"), 1.0) for _ in range(3))
    assert first.take() and not second.take()
    time.sleep(1.6)
    assert not second.take()  # it is renewed
    first._ended.set()  # as if its session had died
    time.sleep(1.6)
    assert second.take() and not third.take()
    second.give_back()
