"""Read-only SQL: what is checked is what runs, and literals stay."""

import time

import pytest
from comptoir.plans import readonly_sql
from comptoir.plans.readonly_sql import ReadOnly, Refused, checked


@pytest.fixture(scope="module")
def agent(spark):
    clients = spark.createDataFrame([(1, "public.fr", "FR"), (2, "x::numeric", "FR"), (3, "fr", "BE"), (4, "a\\", "DE")], "client_id int, nom string, pays string").selectExpr("*", "'secret@x.fr' AS email")
    sales = spark.createDataFrame([(1, "3.456"), (1, "1.2"), (2, "10")], "client_id int, montant string")
    spark.range(1).selectExpr("'SECRET' AS a").createOrReplaceTempView("secret_t")
    spark.sql("CREATE TABLE IF NOT EXISTS secret_cat USING parquet AS SELECT 'SECRET' AS a")
    yield ReadOnly(spark, {"clients": clients, "transactions": sales}, seconds=60)
    spark.sql("DROP TABLE IF EXISTS secret_cat")


BYPASS = r"SELECT nom FROM clients WHERE nom <> '\public.' AND nom <> ' UNION ALL SELECT a FROM secret_cat -- '"


def test_a_literal_with_public_in_it_opens_nothing(agent):
    rows = agent.run(BYPASS).rows
    assert ["SECRET"] not in rows and sorted(r[0] for r in rows) == ["a\\", "fr", "public.fr", "x::numeric"]


@pytest.mark.parametrize("where, want", [("nom = 'public.fr'", [1]), ("nom = 'x::numeric'", [2]), ("nom = 'fr' -- public.clients x::numeric", [3]), ("nom /* public.t */ = 'fr'", [3]), ("nom LIKE 'public.%' OR nom = 'a\\\\'", [1, 4])])
def test_literals_and_comments_stay(agent, where, want):
    assert sorted(r[0] for r in agent.run(f"SELECT client_id FROM clients WHERE {where}").rows) == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT client_id FROM public.clients WHERE pays = 'BE'", [[3]]),
        ("SELECT c.client_id FROM PUBLIC . clients AS c JOIN `public`.transactions t ON c.client_id = t.client_id WHERE c.client_id = 2", [[2]]),
        ("SELECT public.clients.client_id FROM public.clients WHERE public.clients.nom = 'fr'", [[3]]),
        ("WITH a AS (SELECT client_id, sum(montant::numeric) AS m FROM public.transactions GROUP BY 1) SELECT m FROM a WHERE client_id = 1", [[4.66]]),
        ("SELECT CAST(montant AS NUMERIC) FROM transactions WHERE montant::decimal(10,3) = 3.456", [[3.46]]),
        ("SELECT client_id FROM clients WHERE client_id IN (SELECT client_id FROM public.transactions WHERE montant::numeric > 5)", [[2]]),
    ],
)
def test_names_and_casts_of_the_other_dialect(agent, sql, want):
    assert agent.run(sql).rows == want


def test_the_checked_text_checks_again_unchanged(spark, agent):
    for sql in (BYPASS, "SELECT montant::numeric FROM public.transactions", "SELECT nom FROM clients WHERE nom = 'public.fr'"):
        once = checked(spark, sql)
        assert checked(spark, once) == once
    assert checked(spark, BYPASS) == BYPASS


@pytest.mark.parametrize(
    "sql",
    ["SELECT a FROM public.secret_cat", "SELECT a FROM secret_cat", "SELECT a FROM default.secret_cat", "SELECT a FROM spark_catalog.default.secret_cat", "SELECT a FROM global_temp.secret_t", "SELECT a FROM public.public.clients", "SELECT public.clients.email FROM clients",
     "SELECT nom FROM `public.clients`", "SELECT nom FROM clients WHERE nom = (SELECT max(a) FROM public.secret_cat)", "SELECT categorie FROM tresorerie", "SELECT email FROM (SELECT nom FROM clients) x", "SELECT nom FROM IDENTIFIER('secret_cat')", "SELECT id FROM range(3)"],
)
def test_other_sources_are_refused(agent, sql):
    with pytest.raises(Refused):
        agent.run(sql)


def test_the_analysed_plan_is_looked_through(spark, agent):
    # even if a text passed the first check, a leaf outside the views refuses it
    for sql in ("SELECT a FROM secret_cat", "SELECT nom FROM clients WHERE nom IN (SELECT a FROM secret_cat)", "WITH x AS (SELECT a FROM secret_cat) SELECT a FROM x"):
        plan = agent.spark.sql(sql)._jdf.queryExecution().analyzed()
        with pytest.raises(Refused):
            readonly_sql._check_sources(plan, {"clients", "transactions"})
    good = agent.spark.sql("WITH x AS (SELECT nom FROM clients) SELECT nom, (SELECT count(*) FROM transactions) FROM x UNION SELECT 'a', 1")
    readonly_sql._check_sources(good._jdf.queryExecution().analyzed(), {"clients", "transactions"})


def test_the_limit_covers_analysis(agent, monkeypatch):
    slow = ReadOnly.__new__(ReadOnly)
    slow.__dict__.update(agent.__dict__, seconds=0.2)
    monkeypatch.setattr(ReadOnly, "frame", lambda self, sql: time.sleep(1.5))
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        slow.run("SELECT nom FROM clients")
    assert time.monotonic() - began < 1.2


def test_rows_are_bounded_and_plain(agent):
    got = agent.run("SELECT c.client_id, DATE '2024-01-02' AS d, CAST(1.5 AS DECIMAL(4,1)) AS m, array(1, 2) AS l FROM clients c ORDER BY 1", most=2)
    assert got.truncated and got.rows == [[1, "2024-01-02", 1.5, "[1, 2]"], [2, "2024-01-02", 1.5, "[1, 2]"]]
    assert "résultat tronqué" in got.text()


def test_one_failure_leaves_the_others(agent):
    text = "Voici\n```sql\nSELECT nom FROM clients WHERE client_id = 1;\n```\npuis ```SELECT a FROM secret_cat``` et ```sql\nSELECT count(*) AS n FROM clients\n```\n```sql\nSELECT 4\n```"
    assert readonly_sql.queries_in(text) == ["SELECT nom FROM clients WHERE client_id = 1", "SELECT a FROM secret_cat", "SELECT count(*) AS n FROM clients"]
    (_, one), (_, two), (_, three) = agent.run_all(text)
    assert one.rows == [["public.fr"]] and isinstance(two, str) and "secret_cat" in two and three.rows == [[4]]
    assert readonly_sql.queries_in("bonjour") == [] and readonly_sql.queries_in("select 1") == ["select 1"]
