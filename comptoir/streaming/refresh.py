"""Sales and cash that arrive as files or topics: daily revenue with late data, and balances kept up by batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from comptoir.operators.cashflow import merged_balances
from comptoir.sources.stores import Store


def daily_revenue(stream: DataFrame, late: str = "30 days", time: str = "date_transaction") -> DataFrame:
    """Revenue by day of a stream of sales without returns; a day closes when the watermark passes it."""
    rows = stream.where(~F.col("est_retour")).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, "1 day").alias("w")).agg(F.sum("montant").alias("ca"), F.count("*").alias("lignes")).select(F.to_date("w.start").alias("jour"), "ca", "lignes")


def keep_balances(stream: DataFrame, store: Store, checkpoint: str, name: str = "tresorerie") -> StreamingQuery:
    """Every batch of movements (mouvement_id, date_mouvement, sequence, ...) joins the table, and balances are made anew from its earliest day on, as a late movement changes every one after it. A batch that runs twice adds nothing: known ids, and repeats within the batch, are left out."""

    def merge(batch: DataFrame, _: int) -> None:
        merged_balances(store, batch, name)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after_import(stream: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls refresh with each batch that holds rows, so that derived tables follow imports."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
