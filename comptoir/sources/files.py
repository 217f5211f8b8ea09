"""Files of any origin: CSV with unknown separator and encoding, spreadsheets, pipe-delimited dumps, JDBC; and their preview."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from comptoir.operators.cleaning import timestamp
from comptoir.sources import records

EXTENSIONS, ENCODINGS, SEPARATORS, HEAD, PREVIEW = (".csv", ".xlsx", ".xls"), ("utf-8", "latin-1", "cp1252"), (",", ";", "\t"), 1 << 16, 10


class UnsupportedFile(ValueError):
    """A format, encoding or separator that cannot be read."""


class EmptyDataset(ValueError):
    """A file without columns."""


# Words that hint at the meaning of a column, in file order of the fields.
DATE = {"date", "jour", "day", "time", "timestamp", "orderdate", "invoicedate", "date_transaction", "date_vente", "date_facture"}
CLIENT = {"client", "customer", "customerid", "client_id", "code_client", "user", "userid", "acheteur"}
AMOUNT = {"montant", "amount", "total", "ca", "revenue", "sales", "chiffre"}
PRICE = {"prix_unitaire", "unitprice", "unit_price", "price", "prix"}
QUANTITY = {"quantite", "quantity", "qty", "qte", "nombre"}
PRODUCT = {"code_produit", "stockcode", "product_code", "productcode", "prod_code", "item_code", "produit_id", "sku", "reference", "code_article"}
PRODUCT_NAME = {"description", "nom_produit", "product_name", "productname", "item_name", "designation", "libelle", "produit"}
INVOICE = {"invoiceno", "numero_facture", "facture", "invoice", "order_id", "commande"}
COUNTRY = {"pays", "country", "region"}
CLIENT_NAME = {"nom", "name", "nom_client", "client_name"}
EMAIL = {"email", "mail", "e-mail", "courriel"}
STOCK_QUANTITY = {"quantite_disponible", "stock", "quantite", "qty_available", "quantity_on_hand"}
STOCK_ALERT = {"seuil_alerte", "alert_threshold", "seuil_min", "reorder_point"}
STOCK_REORDER = {"seuil_reapprovisionnement", "reorder_qty", "seuil_max"}
COST = {"cout_unitaire", "unit_cost", "cout", "cost"}
LEAD = {"delai_livraison", "lead_time", "delai"}
KIND = {"type_mouvement", "type", "sens", "direction"}
CATEGORY = {"categorie", "category", "libelle", "poste"}

#: (field, hints, must be numeric) in order of assignment; a column goes to one field only.
SALES_FIELDS = [("date_col", DATE, False), ("client_col", CLIENT, False), ("montant_col", AMOUNT, True), ("prix_unitaire_col", PRICE, True), ("quantite_col", QUANTITY, True), ("code_produit_col", PRODUCT, False), ("description_produit_col", PRODUCT_NAME, False), ("numero_facture_col", INVOICE, False), ("pays_col", COUNTRY, False), ("nom_client_col", CLIENT_NAME, False), ("email_client_col", EMAIL, False)]
STOCK_FIELDS = [("code_produit_col", PRODUCT, False), ("nom_produit_col", PRODUCT_NAME, False), ("quantite_disponible_col", STOCK_QUANTITY, True), ("seuil_alerte_col", STOCK_ALERT, True), ("seuil_reappro_col", STOCK_REORDER, True), ("cout_unitaire_col", COST, True), ("delai_livraison_col", LEAD, True)]
CASH_FIELDS = [("date_col", DATE, False), ("type_mouvement_col", KIND, False), ("montant_col", AMOUNT, True), ("categorie_col", CATEGORY, False)]
#: The columns of a well-known public retail export.
RETAIL = {"date_col": "InvoiceDate", "client_col": "Customer ID", "prix_unitaire_col": "Price", "quantite_col": "Quantity", "code_produit_col": "StockCode", "description_produit_col": "Description", "numero_facture_col": "Invoice", "pays_col": "Country"}
RETAIL_ALIASES = {"InvoiceNo": "Invoice", "UnitPrice": "Price", "CustomerID": "Customer ID"}


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, separator) from the first bytes of a CSV: the first encoding that fits, the first separator that gives several columns."""
    if head.startswith(b"\xef\xbb\xbf"):
        head = head[3:]
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
        except UnicodeDecodeError as error:
            if error.start < len(head) - 4:
                continue
            text = head[: error.start].decode(encoding)  # a letter that the end of the head cuts
        first = text.splitlines()[0] if text.strip() else ""
        for separator in SEPARATORS:
            if separator in first:
                return encoding, separator
        break
    raise UnsupportedFile("the separator is none of comma, semicolon and tab")


def file_head(spark: SparkSession, path: str, most: int = HEAD) -> bytes:
    """The first bytes of a file, or of the first file of a folder or pattern, read through the file system of its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(system.globStatus(where) or [])
    if not found:
        raise FileNotFoundError(path)
    first = sorted((x for f in found for x in (system.listStatus(f.getPath()) if f.isDirectory() else [f]) if x.isFile() and not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getPath().toString())
    if not first:
        return b""
    stream = system.open(first[0].getPath())
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def _clean_header(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise EmptyDataset("no columns")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def with_ordinal(df: DataFrame) -> DataFrame:
    """df with ordinal: ascending with the file's rows, by partition and place; not gapless."""
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def read_any(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV or spreadsheet as a DataFrame. Only the first bytes of a CSV are read to tell its encoding and separator, from any store; its rows are read in parallel, line ends inside quotes or not."""
    name = path.lower()
    if name.endswith((".xlsx", ".xls")):
        try:
            import pandas as pd

            return _clean_header(spark.createDataFrame(pd.read_excel(path)))
        except (ImportError, ValueError) as error:
            raise UnsupportedFile(f"cannot read {path}: {error}") from error
    if not name.endswith(".csv"):
        raise UnsupportedFile(f"{path}: one of {EXTENSIONS} is needed")
    head = file_head(spark, path)
    if not head.strip():
        raise EmptyDataset(f"{path} is empty")
    encoding, separator = sniff(head)
    java = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}[encoding]
    options = {"sep": separator, "encoding": java, "header": True, "inferSchema": infer, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True}
    lines = records.lines_of(spark, path)
    counts = records.quote_counts(lines)
    if not any(r["odd"] for r in counts):  # no line ends inside quotes: any line end ends a record
        return _clean_header(spark.read.options(**options).csv(path))
    whole = records.records(lines, counts).orderBy("file", "block", "line").select(F.rtrim(F.decode("value", java), F.lit("\r")).alias("value")).where("value != ''")
    reader = spark._jsparkSession.read()
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    strings = getattr(whole._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return _clean_header(DataFrame(reader.csv(strings), spark))


def read_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A pipe-delimited dump without header or quotes; all strings."""
    return spark.read.schema(", ".join(f"`{c}` STRING" for c in columns)).options(sep="|", quote="", encoding="UTF-8").csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The result of a query on a database; partitionColumn, lowerBound, upperBound and numPartitions read it in parallel (with dbtable)."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return (reader.option("dbtable", f"({query}) q") if "partitionColumn" in options else reader.option("query", query)).load()


def read_retail(spark: SparkSession, path: str) -> DataFrame:
    df = read_any(spark, path)
    return df.withColumnsRenamed({a: b for a, b in RETAIL_ALIASES.items() if a in df.columns})


def normal(name: str) -> str:
    return name.lower().strip().replace(" ", "_").replace("-", "_")


def detect(df: DataFrame, fields: list[tuple[str, set[str], bool]]) -> dict[str, str | None]:
    """A column for each field: the first in file order whose name holds a hint and that no field has yet. A date column must parse in half its rows: one aggregate over all candidates."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    hinted = lambda c, hints: any(h in normal(c) for h in hints)
    dates = [c for c in df.columns if hinted(c, DATE)] if any(h is DATE for _, h, _ in fields) else []
    parsed = df.agg(*[F.avg(timestamp(F.col(f"`{c}`")).isNotNull().cast("double")) for c in dates]).first() if dates else ()
    good = {c for c, share in zip(dates, parsed, strict=True) if (share or 0) >= 0.5}
    out, used = {}, set()
    for field, hints, must_be_numeric in fields:
        fits = (c for c in df.columns if c not in used and hinted(c, hints) and (c in numeric or not must_be_numeric) and (hints is not DATE or c in good))
        out[field] = next(fits, None)
        used |= {out[field]} - {None}
    return out


def detect_sales(df: DataFrame) -> dict[str, str | None]:
    """As detect; a price alone, without quantity and amount, is the line's amount."""
    out = detect(df, SALES_FIELDS)
    if out["prix_unitaire_col"] and not out["quantite_col"] and not out["montant_col"]:
        out["montant_col"], out["prix_unitaire_col"] = out["prix_unitaire_col"], None
    return out


def preview(df: DataFrame) -> dict[str, Any]:
    """Columns and types, row count, the first rows as JSON values and a suggested mapping for each kind of file."""
    rows = [r.asDict() for r in df.limit(PREVIEW).select(*[F.col(f"`{c}`").cast("string").alias(c) if t in ("timestamp", "timestamp_ntz", "date") else F.col(f"`{c}`") for c, t in df.dtypes]).collect()]
    return {"n_lignes": df.count(), "n_colonnes": len(df.columns), "colonnes": [{"nom": c, "type_detecte": t} for c, t in df.dtypes], "apercu_lignes": rows, "mapping_suggere": {"transactions": detect_sales(df), "stocks": detect(df, STOCK_FIELDS), "tresorerie": detect(df, CASH_FIELDS)}}
