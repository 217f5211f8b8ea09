"""The account map of a star-schema ledger, and the check that produced files are understood by the import screen."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comptoir.sources.files import CASH_FIELDS, STOCK_FIELDS, detect, detect_sales, read_any

IN, OUT = "encaissement", "decaissement"
# Ledger accounts that move cash, with their direction and category.
ACCOUNTS = {
    101: (IN, "Ventes encaissées"),
    89: (IN, "Produits financiers"),
    92: (IN, "Autres produits"),
    91: (IN, "Cessions d'actifs"),
    53: (OUT, "Retours et remises clients"),
    54: (OUT, "Retours et remises clients"),
    56: (OUT, "Achats et coût des ventes"),
    57: (OUT, "Achats et coût des ventes"),
    60: (OUT, "Salaires et charges sociales"),
    61: (OUT, "Salaires et charges sociales"),
    62: (OUT, "Salaires et charges sociales"),
    63: (OUT, "Commissions"),
    65: (OUT, "Déplacements"),
    66: (OUT, "Déplacements"),
    67: (OUT, "Déplacements"),
    68: (OUT, "Déplacements"),
    69: (OUT, "Déplacements"),
    71: (OUT, "Marketing"),
    72: (OUT, "Marketing"),
    73: (OUT, "Fournitures de bureau"),
    74: (OUT, "Honoraires"),
    76: (OUT, "Téléphone et énergie"),
    77: (OUT, "Téléphone et énergie"),
    78: (OUT, "Autres charges"),
    87: (OUT, "Loyers"),
    90: (OUT, "Intérêts d'emprunt"),
    94: (OUT, "Impôts"),
}
# The scenario of real entries, and the organisations that keep their books in one currency.
ACTUAL, ORGANISATIONS = "1", ["3", "4", "5", "6", "7"]


class BadMap(ValueError):
    """An account map that says two things, or nothing, of an account."""


@dataclass(frozen=True)
class Account:
    key: str
    direction: str
    category: str

    @property
    def sign(self) -> int:
        return 1 if self.direction == IN else -1


class AccountMap:
    """Accounts by key, each with one direction and a category; the others do not move cash."""

    def __init__(self, accounts: list[Account]) -> None:
        if not accounts:
            raise BadMap("no accounts")
        twice = [k for k, n in Counter(a.key for a in accounts).items() if n > 1]
        if twice:
            raise BadMap(f"accounts {twice} stand more than once")
        odd = [a.key for a in accounts if a.direction not in (IN, OUT) or not a.category.strip() or not a.key.strip()]
        if odd:
            raise BadMap(f"accounts {odd} need a direction ({IN} or {OUT}) and a category")
        both = {}
        for a in accounts:
            both.setdefault(a.category, set()).add(a.direction)
        if mixed := [c for c, d in both.items() if len(d) > 1]:
            raise BadMap(f"categories {mixed} have both directions")
        self.accounts = {a.key: a for a in accounts}

    @classmethod
    def of(cls, rows: dict[int, tuple[str, str]] = ACCOUNTS) -> AccountMap:
        return cls([Account(str(k), d, c) for k, (d, c) in rows.items()])

    @classmethod
    def read(cls, df: DataFrame, key: str = "AccountKey", direction: str = "sens", category: str = "categorie") -> AccountMap:
        """From a table of some hundred rows; more than a thousand are refused."""
        rows = df.select(F.col(key).cast("string"), direction, category).limit(1001).collect()
        if len(rows) > 1000:
            raise BadMap("more than 1,000 accounts")
        return cls([Account(*(x or "" for x in r)) for r in rows])

    def frame(self, spark: SparkSession) -> DataFrame:
        """Rows (AccountKey, categorie, sens), at most a thousand."""
        return spark.createDataFrame([(a.key, a.category, a.sign) for a in self.accounts.values()], "AccountKey string, categorie string, sens int")


# The columns that the import screen must propose for the files made from the sources.
EXPECTED = {
    "ventes": {"date_col": "Date Vente", "client_col": "Code Client", "quantite_col": "Quantite", "prix_unitaire_col": "Prix Unitaire", "code_produit_col": "Code Produit", "numero_facture_col": "Numero Facture", "pays_col": "Pays"},
    "stocks": {"code_produit_col": "Code Produit", "quantite_disponible_col": "Quantite Disponible", "seuil_alerte_col": "Seuil Alerte", "seuil_reappro_col": "Seuil Max", "cout_unitaire_col": "Cout Unitaire"},
    "tresorerie": {"date_col": "Date Mouvement", "montant_col": "Montant", "categorie_col": "Categorie"},
}


def mapping_faults(df: DataFrame, kind: str, expected: dict[str, str] | None = None) -> list[str]:
    """What the import screen would propose otherwise than expected for a file of that kind, a sentence for each field; none if all is well."""
    got = detect_sales(df) if kind == "ventes" else detect(df, STOCK_FIELDS if kind == "stocks" else CASH_FIELDS)
    return [f"{field} : {got.get(field)!r} proposé, {want!r} attendu" for field, want in (expected or EXPECTED[kind]).items() if got.get(field) != want]


def check_file(spark: SparkSession, path: str, kind: str, expected: dict[str, str] | None = None) -> list[str]:
    """mapping_faults of a file that was written, read again as an import reads it."""
    return mapping_faults(read_any(spark, path), kind, expected)
