"""Numbers, codes and labels as a French reader expects them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(c: Column) -> Column:
    """12345.6 as "12 346"."""
    return F.replace(F.format_number(F.bround(c, 0), 0), F.lit(","), F.lit(" "))


def signed_percent(c: Column) -> Column:
    """0.123 as "+12 %", with a true minus sign."""
    n = F.bround(c * 100, 0).cast("long")
    return F.concat(F.when(n < 0, "−").otherwise("+"), F.abs(n).cast("string"), F.lit(" %"))


def compact(c: Column) -> Column:
    """1 234 567 as "1,2 M"; k, M and Md."""
    size = F.abs(c)
    scaled = lambda by, unit: F.concat(F.replace(F.format_string("%.1f", c / by), F.lit("."), F.lit(",")), F.lit(unit))
    return F.when(size >= 1e9, scaled(1e9, " Md")).when(size >= 1e6, scaled(1e6, " M")).when(size >= 1e3, scaled(1e3, " k")).otherwise(thousands(c))


def client_code(c: Column) -> Column:
    return F.format_string("CLI-%04d", c)


def product_code(c: Column) -> Column:
    return F.format_string("SKU-%04d", c)


def invoice_number(c: Column) -> Column:
    return F.format_string("FAC-%06d", c)


def without_prefix(c: Column, prefix: str = "AW") -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(c)


def silhouette_quality(c: Column) -> Column:
    """Label of a silhouette by the usual bounds 0.70, 0.50 and 0.25."""
    return F.when(c.isNull(), "non mesurable").when(c > 0.70, "forte").when(c > 0.50, "raisonnable").when(c > 0.25, "faible").otherwise("non substantielle")
