"""Periodic runs of words: stretches that repeat a period several times, found and collapsed.

A run of at least `least` words and `times` periods repeats itself at the distance of its period, so all of
its words lie in k-grams that occur again in the document, k being the shortest such overlap (five words
for six words and four periods). Words outside repeated k-grams are masked; only the stretches that are left can hold
a run, and only they go to the search of Main and Lorentz (1984): halve a stretch, find for each period how far it
reaches from the middle in both directions, and go on in the halves. Periods up to SCANNED are found by comparing
a whole block of documents with itself at that distance, which is the search's base case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import BLOCK, blocks, table

#: A run's words and periods at least; periods found by comparison.
LEAST, TIMES, SCANNED = 6, 4, 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_size(least: int = LEAST, times: int = TIMES) -> int:
    """The words that a run and its copy one period on share at least."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _FACTOR
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def surviving(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice or more in their document; by hashes, so it may hold more, never fewer."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(len(words), bool)
    each, gram = _mixed(words + 1), np.zeros(n, np.uint64)
    for j in range(k):
        gram = gram * _FACTOR + each[j : j + n]
    gram ^= _mixed(doc[:n] + 7)
    own = np.flatnonzero(doc[:n] == doc[k - 1 :])
    if not len(own):
        return np.zeros(len(words), bool)
    order = own[np.argsort(gram[own])]
    same = gram[order[1:]] == gram[order[:-1]]
    again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + k, -1)
    return np.cumsum(cover)[:-1] > 0


def _stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], true.view(np.int8), [0]))))
    return turns[::2], turns[1::2]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, 2 * step
    return n


class Search:
    """Runs of periods above `scanned` within stretches of words, by halving."""

    def __init__(self, words: np.ndarray, least: int, times: int, scanned: int, short: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.words, self.least, self.times, self.scanned, self.short = words, least, times, scanned, short
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), _FACTOR))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(words) * self.power[:-1])))
        self.found: list[tuple[int, int, int]] = []

    def _equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and from b (a < b) are alike by their hashes; equal ones always are."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def _known(self, m: int) -> list[tuple[int, int, int]]:
        """The scanned runs that hold the words on both sides of m."""
        out = []
        for q, (starts, ends) in self.short.items():
            for i in range(max(0, int(np.searchsorted(starts, m, side="right")) - 2), len(starts)):
                if starts[i] >= m:
                    break
                if ends[i] > m:
                    out.append((int(starts[i]), int(ends[i]), q))
        return out

    def within(self, first: int, last: int) -> None:
        """Adds the runs (start, end, period) that lie in words[first:last] and that no neighbouring word of it extends."""
        todo = [(first, last)]
        while todo:
            left, right = todo.pop()
            if right - left < self.times * (self.scanned + 1):
                continue
            m = (left + right) // 2
            self._across(left, m, right, first, last)
            todo += [(left, m), (m, right)]

    def _across(self, left: int, m: int, right: int, first: int, last: int) -> None:
        w = self.words
        p = np.arange(self.scanned + 1, (right - left) // self.times + 1)
        if not len(p):
            return
        # a run that holds m - 1 and m: either its copy of m one period on is in it, then it agrees for half of
        # what it shares with that copy on one side of m; or it ends sooner, then it agrees before m - p
        share = (self.times - 1) * p
        half, rest = (share + 1) // 2, share - p
        ahead, behind, before = m + p + half <= right, (m - half >= left) & (m + p <= right), m - p - rest >= left
        hit = np.zeros(len(p), bool)
        hit[ahead] = self._equal(np.full(ahead.sum(), m), m + p[ahead], half[ahead])
        hit[behind] |= self._equal(m - half[behind], m - half[behind] + p[behind], half[behind])
        late = np.zeros(len(p), bool)
        late[before] = self._equal(m - p[before] - rest[before], m - rest[before], rest[before])
        if not (hit.any() or late.any()):
            return
        known = self._known(m)
        for periods, shift in ((p[hit], 0), (p[late], 1)):
            for s, e, q in known:
                periods = self._others(periods, m, shift, s, e, q)
            while len(periods):
                q, periods = int(periods[0]), periods[1:]
                at = m - shift * q  # words around `at` are held against those one period on
                forth = _same(w[at : right - q], w[at + q : right])
                back = _same(w[left:at][::-1], w[left + q : at + q][::-1])
                s, e = at - back, at + forth + q
                known.append((s, e, q))
                periods = self._others(periods, m, shift, s, e, q)
                if e - s < max(self.least, self.times * q):
                    continue
                if (s == left and s > first and w[s - 1] == w[s - 1 + q]) or (e == right and e < last and w[e] == w[e - q]):
                    continue  # it goes on beyond this part, where it has been found
                self.found.append((s, e, q))

    @staticmethod
    def _others(periods: np.ndarray, m: int, shift: int, s: int, e: int, q: int) -> np.ndarray:
        """periods without those multiples of q whose run would be that of q: a period's words at m lie in it."""
        begin = m - shift * periods
        return periods[(periods % q != 0) | (begin < s) | (begin + periods > e)]


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES, scanned: int = SCANNED) -> np.ndarray:
    """Rows (start, end, period) of the runs in words (numbers), by start and period; none crosses documents (doc: ascending numbers)."""
    alive = surviving(words, doc, gram_size(least, times))
    starts, ends = _stretches(alive)
    if len(starts):  # stretches end with their document
        cuts = np.flatnonzero(np.diff(doc)) + 1
        cuts = cuts[alive[cuts] & alive[cuts - 1]]
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
        starts, ends = starts[ends - starts >= least], ends[ends - starts >= least]
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    sizes = ends - starts
    # the stretches side by side, each followed by a number that occurs once
    places = np.cumsum(sizes + 1) - sizes - 1
    lone = places + sizes
    part = np.empty(int(lone[-1]) + 1, np.int64)
    inner = np.repeat(starts - places, sizes + 1) + np.arange(len(part))
    part[:] = words[np.minimum(inner, len(words) - 1)]
    part[lone] = -1 - np.arange(len(lone))
    seen: dict[tuple[int, int], int] = {}
    short = {}
    for q in range(1, scanned + 1):
        need = max(least, times * q) - q
        a, b = _stretches(part[:-q] == part[q:]) if len(part) > q else (np.zeros(0, np.int64),) * 2
        long = b - a >= need
        a, b = a[long], b[long] + q
        new = np.array([seen.setdefault(x, q) == q for x in zip(a.tolist(), b.tolist())], bool)
        short[q] = a[new], b[new]
    big = np.flatnonzero(sizes >= times * (scanned + 1))
    if len(big):
        search = Search(part, least, times, scanned, short)
        for i in big:
            search.within(int(places[i]), int(lone[i]))
        for s, e, q in search.found:
            seen[s, e] = min(q, seen.get((s, e), q))
    out = np.array([(s, e, q) for (s, e), q in seen.items()], np.int64).reshape(-1, 3)
    back = inner[out[:, 0]] - out[:, 0]  # a run starts in its stretch
    out[:, 0] += back
    out[:, 1] += back
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _block(batch: pa.RecordBatch, texts: list[bytes | None], least: int, times: int) -> pa.RecordBatch:
    """batch with runs and collapsed."""
    parts = [(t or b"").split() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = [w for p in parts for w in p]
    words = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if flat else np.zeros(0, np.int64)
    doc, begin = np.repeat(np.arange(len(parts)), sizes), np.cumsum(sizes) - sizes
    found = find_runs(words, doc, least, times)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 1], -1)
    gone = np.cumsum(gone)[:-1] > 0
    of = doc[found[:, 0]]
    counts = np.bincount(of, minlength=len(parts))
    collapsed = [b" ".join(p) if not n else b" ".join([w for w, x in zip(p, gone[i : i + len(p)].tolist(), strict=True) if not x]) for p, n, i in zip(parts, counts.tolist(), begin.tolist(), strict=True)]
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(found[:, 0] - begin[of]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=list(RUN))
    own = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("runs", "collapsed")]
    added = [("runs", pa.ListArray.from_arrays(pa.array(offsets), values)), ("collapsed", pa.array(collapsed, pa.binary()).cast(pa.string()))]
    return pa.RecordBatch.from_arrays([c for _, c in own + added], [n for n, _ in own + added])


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """docs with runs (array of start, length, period; by start, then period; words numbered from 0) and collapsed (the words outside repetitions, joined by a space); columns of these names are replaced.

    A run is a stretch of words with smallest period q, of max(least, times * q) words or more, that no
    neighbouring word extends. collapsed leaves out each word that lies in a run after its first q words.
    Words are runs of bytes other than ASCII white space. Null, empty and blank texts have no words, no runs and an
    empty `collapsed`. Rows and their other columns stay as they are, repeated ones and null ids too; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text, block):
                yield _block(part, part.column(text).cast(pa.binary()).to_pylist(), least, times)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("runs", "collapsed")]
    return docs.mapInArrow(run, ", ".join([*kept, "runs array<struct<start: long, length: long, period: long>>", "collapsed string"]))


def _with_tail(text: Column, said: Column) -> Column:
    """The text whose words from a on repeat a period p, where h = crc32(said) is divisible by 10: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10); other texts, and those without words or with a null `said`, as they are."""
    h = F.crc32(said)
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \t\n\x0b\f\r]+"), lambda w: w != "")

    def rewritten(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the outer transform binds the words once
    made = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, rewritten(ws)))[0]
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of all documents, a tenth of them with a periodic tail; the run is that of the greatest exact exponent, the first of equal ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_tail(F.col("text"), F.col("doc_id").cast("string")).alias("text"))
    got = with_runs(docs).select("doc_id", "runs", "collapsed")
    larger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    got = got.withColumn("best", F.reduce("runs", F.get("runs", F.lit(0)), larger))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
