"""The session that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "comptoir", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a reliable checkpoint in the folder of spark.checkpoint.dir, which driver and executors share; where that is unset, a folder of this machine serves a local master alone."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='comptoir-')}")
    return df.checkpoint()
