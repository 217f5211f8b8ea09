"""CSV records whose quoted fields hold line ends, read in many tasks.

A file is read as lines, in splits. Whether a line begins a record depends on how many quotes stand before it:
quotes are counted for each split, one number of each reaches the driver, and with the parity at its
start every split tells its records by itself. A record that runs over the end of a split is put together from
its pieces. Only files that need it take this way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = ["file", "block"]
PIECES = "file string, block long, line long, piece long, value binary"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, value) of lines as bytes, block being where the line's split starts."""
    got = spark.read.option("lineSep", "\n").text(path)
    return got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def quote_counts(lines: DataFrame) -> list:
    """(file, block, quotes, lines with an odd number of them) of each split; a row for each split reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [(v or b"").count(b'"') for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64())], [*SPLIT, "n"])

    counted = lines.mapInArrow(run, "file string, block long, n long")
    return counted.groupBy(*SPLIT).agg(F.sum("n").alias("quotes"), F.count_if(F.col("n") % 2 == 1).alias("odd")).orderBy(*SPLIT).collect()


def records(lines: DataFrame, counts: list) -> DataFrame:
    """Rows (file, block, line, value): whole records as bytes, line ends inside quotes kept, in file order by (file, block, line)."""
    start, before = {}, {}
    for r in counts:
        start[r["file"], r["block"]] = before.get(r["file"], 0) % 2
        before[r["file"]] = before.get(r["file"], 0) + r["quotes"]
    blocks: dict[str, list[int]] = {}
    for f, b in sorted(start):
        blocks.setdefault(f, []).append(b)
    previous = {(f, b): of[i - 1] for f, of in blocks.items() for i, b in enumerate(of) if i}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, parts, open_, head = None, 0, [], False, False

        def ended() -> tuple | None:
            """What the split leaves open: a piece of a record that goes on in the next one."""
            if not parts:
                return None
            if head:
                raise ValueError(f"{at[0]}: a record is longer than a split; raise spark.sql.files.maxPartitionBytes")
            return (*at, 1 << 62, 0, b"\n".join(parts))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "line", "piece", "value"])

        for batch in batches:
            out = []
            for file, block, value in zip(*[batch.column(c).to_pylist() for c in (*SPLIT, "value")], strict=True):
                if (file, block) != at:
                    if (left := ended()) is not None:
                        out.append(left)
                    at, line, parts = (file, block), 0, []
                    open_ = head = bool(start[at])
                parts.append(value or b"")
                open_ ^= parts[-1].count(b'"') % 2 == 1
                if not open_:
                    whole = b"\n".join(parts)
                    if head:  # the end of the record that the split before left open
                        out.append((file, previous[at], 1 << 62, 1, whole))
                    else:
                        out.append((file, block, line, 0, whole))
                    line, parts, head = line + 1, [], False
            if out:
                yield made(out)
        if (left := ended()) is not None:
            yield made([left])

    found = lines.mapInArrow(run, PIECES)
    whole = found.where(F.col("line") < 1 << 62).drop("piece")
    cut = found.where(F.col("line") == 1 << 62).groupBy(*SPLIT, "line").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("p"))  # two pieces each
    joined = F.when(F.size("p") == 2, F.concat(F.col("p")[0]["value"], F.lit(b"\n"), F.col("p")[1]["value"])).otherwise(F.col("p")[0]["value"])
    return whole.unionByName(cut.select(*SPLIT, "line", joined.alias("value")))
