"""Shared folder, written tables and table readers for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of texts that a task holds as Python objects at once.
BLOCK = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where that is unset, a folder of this machine serves a local master alone; elsewhere it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='comptoir-')}")
    return (named or context.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again. For wide rows it is smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batch: pa.RecordBatch, column: str, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """batch in slices of whole rows, about `block` bytes of a column of strings or binaries each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        yield batch.slice(at, to - at)
        at = to


def appended(df: DataFrame, column: str, made: dict[str, str], start: Callable[[], Callable[[list], Sequence]], drop: bool = False, block: int = BLOCK) -> DataFrame:
    """df with the columns `made` (name: type), made of the values of one column.

    start() runs once in a task and gives a function from a list of values (nulls as None) to the new
    columns. The other columns stay in Arrow as they are, so that nulls and large numbers keep their values; those
    that bear a name of `made` are replaced. drop: leave the column itself out.
    """
    kept = [f for f in df.schema if f.name not in made and not (drop and f.name == column)]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for part in blocks(batch, column, block):
                new = make(part.column(column).to_pylist())
                columns = [part.column(f.name) for f in kept] + [pa.array(x, types[made[n]]) for n, x in zip(made, new, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *made])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {t}" for n, t in made.items()]
    return df.mapInArrow(run, ", ".join(schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
