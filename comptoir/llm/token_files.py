"""Token-id files compressed by Re-Pair grammars, one for each shard.

A shard holds whole documents in ascending doc_id order. Its ids are numbered anew by those in use, and
in rounds its most frequent pairs of neighbouring symbols become nonterminals, until no pair is left
whose uses pay for its rule; a pair never crosses a document's end, so that a document can be read by
expanding its own symbols only. A shard stores its ids in use, its rules, the length of each rule's
expansion, where each document's symbols begin, and the symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import blocks, table, written
from comptoir.llm.tokens import BYTE_BPE, bases, encoder

MAGIC, SHARD = b"RPG2", 1 << 20
#: Uses from which a rule pays: it takes three numbers, and each use saves one. Pairs of a round have this share of the commonest one's count at least. 2 ** HASH slots to find rules by. A round that saves less than one symbol in so many is the last.
LEAST, SHARE, HASH, LITTLE = 4, 128, 18, 1000
#: magic, ids in use, rules, documents, symbols, bytes of a length
HEAD = struct.Struct("<4sIIIIB")


def grammar(seq: np.ndarray, first: np.ndarray, terminals: int, limit: int = 1 << 16, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, rules, lengths): seq with its pairs replaced; first: where the documents' symbols begin.

    Counts are exact. Each round takes the pairs that are frequent beside the commonest, gives way to the more
    frequent of two that overlap, and makes rules of those used `least` times or more. It ends when there
    are none, when a round saves less than one symbol in LITTLE, or when `limit` symbols are in use, from where a rule would widen every symbol.
    """
    narrow = limit <= 1 << 16
    shift, kind = (np.uint32(16), np.uint32) if narrow else (np.uint64(32), np.uint64)
    turn, drop = (np.uint32(0x9E3779B1), np.uint32(32 - HASH)) if narrow else (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - HASH))
    seq, made, lengths = seq.astype(kind), [np.zeros((0, 2), np.uint32)], np.ones(terminals, np.int64)
    rule = np.full(1 << HASH, -1, np.int32)
    while len(lengths) < limit and len(seq) > 1:
        code = seq[:-1] << shift
        code |= seq[1:]
        some = np.sort(code)
        begin = np.flatnonzero(some[1:] != some[:-1]) + 1
        begin = np.concatenate(([0], begin))
        counts = np.diff(begin, append=len(some))
        edges = first[1:] - 1
        names, n = np.unique(code[edges], return_counts=True)  # pairs over documents' ends do not count
        counts[np.searchsorted(some[begin], names)] -= n
        often = np.flatnonzero(counts >= max(least, counts.max() // SHARE))
        if not len(often):
            break
        pairs, counts = some[begin[often]], counts[often].astype(np.int32)
        order = np.argsort(counts, kind="stable")  # the commonest last, so that it has its slot
        pairs, counts = pairs[order], counts[order]
        slot = (pairs * turn) >> drop
        rule[slot] = np.arange(len(pairs), dtype=np.int32)
        hit = rule[(code * turn) >> drop]
        rule[slot] = -1
        hit[edges] = -1
        at = np.flatnonzero(hit >= 0)
        at = at[pairs[hit[at]] == code[at]]
        weight = np.zeros(len(seq) + 1, np.int32)
        weight[at + 1] = own = counts[hit[at]]
        at = at[(own >= weight[at]) & (own >= weight[at + 2])]
        fresh = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of equal pairs in a row, every second is replaced
        at = at[(np.arange(len(at)) - np.repeat(fresh, np.diff(fresh, append=len(at)))) % 2 == 0]
        uses = np.bincount(hit[at], minlength=len(pairs))
        good = np.flatnonzero(uses >= least)
        good = good[np.argsort(-uses[good], kind="stable")][: limit - len(lengths)]
        if not len(good):
            break
        name = np.full(len(pairs), -1, np.int64)
        name[good] = len(lengths) + np.arange(len(good))
        new = name[hit[at]]
        at, new = at[new >= 0], new[new >= 0]
        seq[at] = new.astype(kind)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, first = seq[keep], first - np.searchsorted(at, first)
        two = np.stack([pairs[good] >> shift, pairs[good] & kind((1 << int(shift)) - 1)], axis=1)
        made.append(two.astype(np.uint32))
        lengths = np.concatenate((lengths, lengths[two].sum(axis=1)))
        if len(at) * LITTLE < len(seq):
            break
    return seq, first, np.concatenate(made), lengths[terminals:]


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The terminals that symbols stand for: all nonterminals by one level in each turn."""
    while len(rules) and (deep := symbols >= terminals).any():
        out = np.repeat(symbols, deep + 1)
        at = np.flatnonzero(deep) + np.arange(int(deep.sum()))
        pair = rules[symbols[deep].astype(np.int64) - terminals]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def pack_shard(docs: list[np.ndarray]) -> bytes:
    """A shard of documents of at least one id each."""
    seq = np.concatenate(docs).astype(np.int64)
    first = np.cumsum([0, *map(len, docs[:-1])])
    in_use = np.zeros(int(seq.max()) + 1, bool)
    in_use[seq] = True
    used = np.flatnonzero(in_use)
    symbols, first, rules, lengths = grammar((np.cumsum(in_use) - 1)[seq], first, len(used), 1 << 16 if len(used) <= 1 << 16 else 1 << 31)
    wide = _width(len(used), len(rules))
    size = np.dtype("<u2" if lengths.max(initial=0) < 1 << 16 else "<u4")
    parts = used.astype("<u4"), rules.astype(wide), lengths.astype(size), first.astype("<u4"), symbols.astype(wide)
    return HEAD.pack(MAGIC, len(used), len(rules), len(docs), len(symbols), size.itemsize) + b"".join(x.tobytes() for x in parts)


def _width(used: int, rules: int) -> np.dtype:
    return np.dtype("<u2" if used + rules <= 1 << 16 else "<u4")


class Shard:
    """Reads a shard; read(i) expands the symbols of document i alone, ids(i, j) those of tokens i to j of the shard."""

    def __init__(self, raw: bytes) -> None:
        magic, self.terminals, n_rules, n_docs, n, size = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        wide, at = _width(self.terminals, n_rules), HEAD.size

        def part(kind: str | np.dtype, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.used, self.rules = part("<u4", self.terminals), part(wide, 2 * n_rules).reshape(-1, 2).astype(np.uint32)
        self.lengths, self.first = part(f"<u{size}", n_rules), part("<u4", n_docs).astype(np.int64)
        self.symbols = part(wide, n).astype(np.uint32)

    def _ids(self, symbols: np.ndarray) -> np.ndarray:
        return self.used[expand(symbols, self.rules, self.terminals)]

    def read(self, i: int) -> np.ndarray:
        end = self.first[i + 1] if i + 1 < len(self.first) else None
        return self._ids(self.symbols[self.first[i] : end])

    def places(self) -> np.ndarray:
        """Tokens before each symbol, and all."""
        each = np.concatenate((np.ones(self.terminals, np.int64), self.lengths))[self.symbols]
        return np.concatenate(([0], np.cumsum(each)))

    def ids(self, i: int, j: int) -> np.ndarray:
        places = self.places()
        a, b = np.searchsorted(places, i, "right") - 1, np.searchsorted(places, j, "left")
        return self._ids(self.symbols[a:b])[i - places[a] : j - places[a]]

    def all(self) -> list[np.ndarray]:
        """The ids of each document; every rule is expanded once."""
        pool = np.concatenate((self.used, self._ids(np.arange(self.terminals, self.terminals + len(self.rules), dtype=np.uint32))))
        length = np.concatenate((np.ones(self.terminals, np.int64), self.lengths))
        start = np.cumsum(length) - length
        places, n = self.places(), length[self.symbols]
        whole = pool[np.repeat(start[self.symbols] - places[:-1], n) + np.arange(places[-1])]
        return np.split(whole, places[self.first[1:]])


def write_token_files(docs: DataFrame, path: str = BYTE_BPE, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order (null first) and returns the files' rows.

    Rows (pid, at, tokens, doc_ids, payload): a shard of about `shard` tokens or one longer document, its
    partition in the order, its place among that partition's tokens, and its documents. Rows are Parquet
    files in the shared folder, so a lost executor's shards are written anew as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, at, held, ids, n = encoder(path), TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], enc.dtype).tobytes()

        def done() -> pa.RecordBatch:
            columns = [pa.array([pid], pa.int32()), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([held], pa.list_(pa.int64())), pa.array([pack_shard(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["pid", "at", "tokens", "doc_ids", "payload"])

        for batch in batches:
            for some in blocks(batch, "text"):
                for doc, raw in zip(some.column("doc_id").to_pylist(), enc.encode_many(some.column("text").to_pylist()), strict=True):
                    held.append(doc)
                    ids.append(np.frombuffer(raw + end, enc.dtype))
                    n += len(ids[-1])
                    if n >= shard:
                        yield done()
                        at, held, ids, n = at + n, [], [], 0
        if held:
            yield done()

    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(run, "pid int, at long, tokens long, doc_ids array<long>, payload binary"), "token-files")


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; start counts the ids of all documents before it. with_ids=False leaves ids out."""
    totals = files.groupBy("pid").agg(F.sum("tokens")).collect()
    base = files.sparkSession.sparkContext.broadcast(bases([tuple(r) for r in totals]))  # two numbers for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pid, at, raw = (batch.column(c)[i].as_py() for c in ("pid", "at", "payload"))
                ids = [x.astype("<u4").tobytes() for x in Shard(raw).all()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                columns = {"doc_id": batch.column("doc_ids")[i].values, "start": base.value[pid] + at + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in ids]}
                columns = {c: x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for c, x in columns.items()} | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return files.select("pid", "at", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) as read back from the written files, in ascending doc_id order (null first, repeated rows each)."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")), with_ids=False)
