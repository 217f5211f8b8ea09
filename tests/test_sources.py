"""Files of any kind read in many tasks, source databases by their fixtures, the account map and its checks."""

import csv
import io

import pytest
from comptoir.sources import accounts, exports, files, records
from pyspark.sql import functions as F


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- records with line ends inside quotes ---


def written(path, n, encoding="utf-8", ends="\n"):
    """A CSV with quotes, separators and line ends inside fields; the rows that it holds."""
    out, rows = io.StringIO(newline=""), []
    w = csv.writer(out, delimiter=";", lineterminator=ends, quoting=csv.QUOTE_MINIMAL)
    w.writerow(["id", "texte", "note"])
    for i in range(n):
        text = [f"simple {i}", f'il dit "oui"; {i}', f"deux\nlignes {i}", f"\nvide\n\nfin {i}\n", 'un guillemet " seul', "é" * (i % 7)][i % 6]
        rows.append((i, text or None, f"n{i}"))
        w.writerow(rows[-1])
    path.write_bytes(out.getvalue().encode(encoding))
    return rows


@pytest.mark.parametrize("split", ["300", "1000", "128m"])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_records_over_the_ends_of_splits(spark, tmp_path, split, encoding):
    rows = written(tmp_path / "a.csv", 400, encoding)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = records.lines_of(spark, str(tmp_path / "a.csv"))
        if split != "128m":
            assert lines.rdd.getNumPartitions() > 4
        df = files.read_any(spark, str(tmp_path / "a.csv"))
        assert df.columns == ["id", "texte", "note"] and dict(df.dtypes)["id"] == "int"
        assert rows_of(df) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_file_without_such_fields_is_read_in_splits(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,texte\n" + "".join(f'{i},"a ""b"", {i}"\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = files.read_any(spark, str(tmp_path / "b.csv"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 3000 and df.where("texte = 'a \"b\", 17'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_a_record_longer_than_a_split_is_told(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,texte\n1,"' + "ligne\n" * 3000 + '"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with pytest.raises(Exception, match="longer than a split"):
            files.read_any(spark, str(tmp_path / "c.csv")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert files.read_any(spark, str(tmp_path / "c.csv")).count() == 1


def test_the_head_alone_is_read_and_windows_ends_are_cut(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes(b"\xef\xbb\xbf" + 'Date,Montant\r\n2024-01-02,"5\r\n"\r\n2024-01-03,7\r\n'.encode())
    assert files.file_head(spark, str(tmp_path / "d.csv"), 3) == b"\xef\xbb\xbf"
    df = files.read_any(spark, str(tmp_path / "d.csv"), infer=False)
    assert df.columns == ["Date", "Montant"] and [r[1].strip() for r in rows_of(df)] == ["5", "7"]
    (tmp_path / "e.csv").write_text("  \n")
    with pytest.raises(files.EmptyDataset):
        files.read_any(spark, str(tmp_path / "e.csv"))
    with pytest.raises(FileNotFoundError):
        files.read_any(spark, str(tmp_path / "none.csv"))


def test_dump_and_retail_file(spark, tmp_path):
    (tmp_path / "x.dump").write_text('1|a "b|c\n2||d,e\n')
    assert rows_of(files.read_dump(spark, str(tmp_path / "x.dump"), ["k", "v", "w"])) == [("1", 'a "b', "c"), ("2", None, "d,e")]
    (tmp_path / "r.csv").write_text("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\nC5,1A,Mug,-2,2011-01-02,2.5,17,France\n")
    got = files.read_retail(spark, str(tmp_path / "r.csv"))
    assert set(files.RETAIL.values()) <= set(got.columns) and got.first()["Price"] == 2.5


# --- source databases ---


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(str(r[c]) if r.get(c) is not None else None for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


@pytest.fixture(scope="module")
def star(spark):
    product = lambda k, code, name, cost, level, point: dict(ProductKey=k, ProductAlternateKey=code, EnglishProductName=name, StandardCost=cost, SafetyStockLevel=level, ReorderPoint=point)
    products = frame(spark, [product(10, "BK-R93R-62", "Road-150 Red, 62", 2000, 100, 75), product(11, "BK-R93R-62", "Road-150 Red, 62", 2171.2942, 100, 75), product(20, "CA-1098", "AWC Logo Cap", 6.9223, 4, 3), product(30, "XX-0001", "Jamais vendu", 1, 4, 3)], ["ProductKey", "ProductAlternateKey", "EnglishProductName", "StandardCost", "SafetyStockLevel", "ReorderPoint"])
    customers = frame(spark, [dict(CustomerKey=1, GeographyKey=7, CustomerAlternateKey="AW00011000", FirstName="Jon", LastName="Yang", EmailAddress="jon24@example.org"), dict(CustomerKey=2, GeographyKey=7, CustomerAlternateKey="AW00011001", FirstName="Eugene", LastName="Huang", EmailAddress="eugene10@example.org")], ["CustomerKey", "GeographyKey", "CustomerAlternateKey", "FirstName", "LastName", "EmailAddress"])
    places = frame(spark, [dict(GeographyKey=7, EnglishCountryRegionName="Australia")], ["GeographyKey", "EnglishCountryRegionName"])
    sale = lambda k, c, n, d, p: dict(ProductKey=k, CustomerKey=c, SalesOrderNumber=n, OrderQuantity=1, UnitPrice=p, OrderDate=f"{d} 00:00:00.000")
    sales = frame(spark, [sale(10, 1, "SO43697", "2013-01-05", 3578.27), sale(11, 1, "SO50000", "2013-06-01", 2443.35), sale(20, 2, "SO73199", "2013-12-16", 8.99), sale(20, 2, "SO73201", "2013-12-16", 8.99)], ["ProductKey", "CustomerKey", "SalesOrderNumber", "OrderQuantity", "UnitPrice", "OrderDate"])
    stock = lambda k, d, n: dict(ProductKey=k, DateKey=d, UnitsBalance=n)
    inventory = frame(spark, [stock(11, "2013-12-01", 90), stock(11, "2013-12-16", 70), stock(11, "2014-06-30", 999), stock(20, "2013-12-16", -2), stock(30, "2013-12-16", 5)], ["ProductKey", "DateKey", "UnitsBalance"])
    entry = lambda a, v, org=3, scenario=1: dict(ScenarioKey=scenario, OrganizationKey=org, AccountKey=a, Amount=v, Date="2013-01-29 00:00:00.000")
    finance = frame(spark, [entry(101, 10000), entry(101, 5000, org=4), entry(60, 3000), entry(61, 500), entry(91, -200), entry(80, 999), entry(101, 777, org=11), entry(101, 888, scenario=2)], ["ScenarioKey", "OrganizationKey", "AccountKey", "Amount", "Date"])
    return dict(products=products, customers=customers, places=places, sales=sales, inventory=inventory, finance=finance)


def test_star_sales_stock_and_cash(spark, star):
    sales = exports.star_sales(star["sales"], star["customers"], star["places"], star["products"])
    got = rows_of(sales.select("Code Client", "Nom Client", "Pays", "Code Produit", "Prix Unitaire").orderBy("Numero Facture"))
    assert [r[0] for r in got] == ["CLI-11000", "CLI-11000", "CLI-11001", "CLI-11001"] and got[0][1:4] == ("Jon Yang", "Australia", "BK-R93R-62") and got[1][3] == "BK-R93R-62"
    assert sum(r[4] for r in got) == pytest.approx(3578.27 + 2443.35 + 2 * 8.99)
    stock = {r["Code Produit"]: r for r in exports.star_stock(star["inventory"], star["products"], star["sales"], "2014-01-28").collect()}
    assert set(stock) == {"BK-R93R-62", "CA-1098"} and stock["BK-R93R-62"]["Quantite Disponible"] == 70 and stock["CA-1098"]["Quantite Disponible"] == 0
    assert (stock["BK-R93R-62"]["Seuil Alerte"], stock["BK-R93R-62"]["Seuil Max"]) == (75, 100) and stock["BK-R93R-62"]["Cout Unitaire"] == pytest.approx(2171.2942)
    assert [r["StandardCost"] for r in exports.current_products(star["products"]).where("ProductAlternateKey = 'BK-R93R-62'").collect()] == ["2171.2942"]
    cash = {r["Categorie"]: r["Montant"] for r in exports.star_cash(star["finance"]).collect()}
    assert cash == {"Ventes encaissées": 15000.0, "Salaires et charges sociales": -3500.0, "Cessions d'actifs": -200.0}


def test_order_database(spark):
    line = lambda n, credit, q: dict(invoice_id=n, invoice_date="2016-03-01", is_credit_note=credit, customer_id=1, customer_name='Toys (Store 1, "FL")', country="US", stock_item_id=5, description="Article 5, taille L", quantity=q, unit_price=10.0)
    sales = exports.order_sales(frame(spark, [line(1, "false", 3), line(2, "true", 2)], list(line(1, "", 1))))
    got = {r["Numero Facture"]: r for r in sales.collect()}
    assert got["FAC-000001"]["Quantite"] == 3 and got["FAC-000002"]["Quantite"] == -2 and got["FAC-000001"]["Code Client"] == "CLI-0001" and got["FAC-000001"]["Code Produit"] == "SKU-0005"
    item = lambda i, held, goal: dict(stock_item_id=i, stock_item_name="A", quantity_on_hand=held, reorder_level=10, target_stock_level=goal, last_cost_price=3.456, lead_time_days=14)
    stock = {r["Code Produit"]: r for r in exports.order_stock(frame(spark, [item(1, 5, 100), item(2, -3, 4)], list(item(1, 1, 1)))).collect()}
    assert (stock["SKU-0001"]["Seuil Max"], stock["SKU-0002"]["Seuil Max"], stock["SKU-0002"]["Quantite Disponible"]) == (100, 10, 0)
    move = lambda d, kind, v: dict(transaction_date=d, transaction_type=kind, amount=v)
    names = ["transaction_date", "transaction_type", "amount"]
    receipts = frame(spark, [move("2016-01-04", "Customer Payment Received", -1000.0), move("2016-01-04", "Customer Payment Received", -500.0), move("2016-01-06", "Customer Refund", 50.0), move("2016-01-06", "Customer Invoice", 9.0)], names)
    payments = frame(spark, [move("2016-01-05", "Supplier Payment Issued", -300.0)], names)
    assert {(str(r[0]), r[1], r[2]) for r in exports.order_cash(receipts, payments).collect()} == {("2016-01-04", "Encaissements clients", 1500.0), ("2016-01-05", "Paiements fournisseurs", -300.0), ("2016-01-06", "Remboursements clients", -50.0)}


def test_files_made_from_a_source_are_understood(spark, star, tmp_path):
    made = {
        "ventes": exports.star_sales(star["sales"], star["customers"], star["places"], star["products"]),
        "stocks": exports.star_stock(star["inventory"], star["products"], star["sales"], "2014-01-28"),
        "tresorerie": exports.star_cash(star["finance"]),
    }
    for kind, df in made.items():
        assert accounts.mapping_faults(df, kind) == []
        path = tmp_path / f"{kind}.csv"
        df.toPandas().to_csv(path, index=False)
        assert accounts.check_file(spark, str(path), kind) == []
    renamed = made["ventes"].withColumnRenamed("Quantite", "Taille")
    assert accounts.mapping_faults(renamed, "ventes") == ["quantite_col : None proposé, 'Quantite' attendu", "prix_unitaire_col : None proposé, 'Prix Unitaire' attendu"]  # a price alone is the line's amount


def test_account_maps_are_checked(spark):
    one = accounts.Account
    good = accounts.AccountMap.read(spark.createDataFrame([(1, "encaissement", "A"), (2, "decaissement", "B")], "AccountKey int, sens string, categorie string"))
    assert {tuple(r) for r in good.frame(spark).collect()} == {("1", "A", 1), ("2", "B", -1)} and len(accounts.AccountMap.of().accounts) == 27
    for bad in ([], [one("1", "encaissement", "A"), one("1", "decaissement", "B")], [one("1", "entree", "A")], [one("1", "encaissement", " ")], [one("1", "encaissement", "A"), one("2", "decaissement", "A")]):
        with pytest.raises(accounts.BadMap):
            accounts.AccountMap(bad)
    with pytest.raises(accounts.BadMap):
        accounts.AccountMap.read(spark.range(1500).select(F.col("id").alias("AccountKey"), F.lit("encaissement").alias("sens"), F.lit("A").alias("categorie")))
