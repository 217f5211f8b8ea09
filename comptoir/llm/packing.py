"""Concatenate-and-cut packing: prefix sums over the partitions' token totals, then fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import blocks, table, written
from comptoir.llm.tokens import WORD_BPE, bases, encoder, tokenised

WINDOW = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [c.split()[0] for c in PIECE.split(", ")]


def pack(docs: DataFrame, path: str = WORD_BPE, end_id: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of `window` tokens; only the last sequence has room left.

    The first pass writes each document's ids with its place in its partition; the partitions' totals
    give global places. The second cuts at multiples of the window. No document is moved. Columns as PIECE;
    ids are unsigned little-endian of 32 bits. Null and empty texts are one piece of end_id; repeated
    rows and null ids are packed like any other; an empty table gives no rows. Other columns are dropped.
    """
    stored = written(tokenised(docs, path, end_id, doc_id, text), "packing")
    totals = stored.groupBy("pid").agg(F.sum("n")).collect()
    base = docs.sparkSession.sparkContext.broadcast(bases([tuple(r) for r in totals]))  # two numbers for each partition

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        for batch in batches:
            for some in blocks(batch, "ids"):
                out = []
                for i, (pid, at, n, raw) in enumerate(zip(*[some.column(c).to_pylist() for c in ("pid", "at", "n", "ids")], strict=True)):
                    ids, place, start = np.frombuffer(raw, dtype).astype("<u4").tobytes(), base.value[pid] + at, 0
                    while start < n:
                        length = min(n - start, window - (place + start) % window)
                        part = ids[4 * start : 4 * (start + length)]
                        out.append((i, start, length, zlib.crc32(part), n, (place + start) // window, (place + start) % window, part))
                        start += length
                of, *columns = zip(*out, strict=True)
                docs = some.column("doc_id").take(pa.array(of))
                yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(NAMES[1:], columns, strict=True)]], NAMES)

    return stored.mapInArrow(cut, PIECE)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Rows (sequence_id, ids, length, documents, continued): a whole sequence padded to the window, with its boundary records.

    documents: (doc_id, start, offset, length) in order; continued: it begins inside a document. A group holds at most one window.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    length = F.sum("length").alias("length")
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"), length)
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("length")).cast("int")))
    joined = F.aggregate("parts", F.lit(b""), lambda got, x: F.concat(got, x["ids"]))
    return rows.select(
        "sequence_id", F.concat(joined, padding).alias("ids"), "length", F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"), (F.col("parts")[0]["start"] > 0).alias("continued")
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Rows as PIECE without the ids: every piece of every row of documents; null and empty texts are one piece of the end id."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
