"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold[k] - weights . features): all grades share the weights, and
the thresholds are ordered. Features are hashed letter triples, letter shapes and words of the whole text, square
roots of their shares. The model is fitted on a bounded sample of rated documents: shards fit on
their own by AdaGrad, and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import appended, table

#: Bits of the three families' hashes; rated documents in the sample at most, documents from which it is split in shards, shards at most.
TRIPLES, SHAPES, WORDS, SAMPLE, SHARE, SHARDS = 14, 12, 14, 24_000, 3000, 8
GRADES, PASSES, RATE, DECAY, BLOCK = 3, 12, 0.5, 1e-5, 1 << 18
#: One in this many of the sample is held out to calibrate; share of the held-out documents of the highest grade that stay kept.
HELD, CLEAN = 5, 0.95
#: Where each family ends; the last has the length's power of two, and sixteenths of distinct words and of the commonest word.
ENDS = np.cumsum([1 << TRIPLES, 1 << SHAPES, 1 << WORDS, 96])
SIZE = int(ENDS[-1])


def _classes() -> np.ndarray:
    """The shape of each byte: lower, upper, digit, white, stop, line end, other mark, part of another letter."""
    of = np.full(256, 6, np.uint8)
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    of[[32, 9]], of[[ord(c) for c in ".,;:"]], of[[10, 13]], of[128:] = 3, 4, 5, 7
    return of


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = (_CLASS < 2) | (_CLASS == 7)
_P = 0x100000001B3
_POWERS = np.array([pow(_P, i, 1 << 64) for i in range(BLOCK)], np.uint64)
_BACK = np.array([pow(pow(_P, -1, 1 << 64), i, 1 << 64) for i in range(BLOCK)], np.uint64)


def _counts(block: np.ndarray, out: np.ndarray) -> None:
    """Adds a block's features; a word that a block's edge cuts counts as two."""
    x = block.astype(np.uint32)
    triple = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(32 - TRIPLES)
    out[: 1 << TRIPLES] += np.bincount(triple, minlength=1 << TRIPLES)
    c = _CLASS[block].astype(np.uint32)
    shape = c[:-3] | c[1:-2] << np.uint32(3) | c[2:-1] << np.uint32(6) | c[3:] << np.uint32(9)
    out[ENDS[0] : ENDS[1]] += np.bincount(shape, minlength=1 << SHAPES)
    inside = np.concatenate(([False], _WORD[block], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[block].astype(np.uint64) * _POWERS[: len(block)], dtype=np.uint64)))
    word = (total[end] - total[begin]) * _BACK[begin.clip(max=BLOCK - 1)]
    word = (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORDS)
    out[ENDS[1] : ENDS[2]] += np.bincount(word.astype(np.int64), minlength=1 << WORDS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the features that the text has; each family has length one. Null and empty texts have those of their length alone."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(SIZE, np.int64)
    for i in range(0, len(raw), BLOCK):
        _counts(raw[i : i + BLOCK], counts)
    words = counts[ENDS[1] : ENDS[2]]
    n = max(1, words.sum())
    for i in (len(raw).bit_length(), 48 + int(16 * np.count_nonzero(words) / n), 72 + int(16 * words.max() / n)):
        counts[ENDS[2] + i] += 1
    at = np.flatnonzero(counts)
    family = np.searchsorted(ENDS, at, "right")
    total = np.bincount(family, counts[at], 4)
    return at, np.sqrt(counts[at] / total[family]).astype(np.float32)


@dataclass
class Model:
    """weights and ordered thresholds; None without rated documents. least_top: the probability of the highest grade that a kept document needs."""

    weights: np.ndarray
    thresholds: np.ndarray
    least_top: float = 0.0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def fit_shard(texts: list[str | None], grades: np.ndarray, grades_n: int = GRADES, passes: int = PASSES, seed: int = 5) -> Model:
    """AdaGrad on the likelihood of the grades, one document at a time."""
    rows = [features(t) for t in texts]
    share = np.cumsum(np.bincount(grades, minlength=grades_n) + 1) / (len(grades) + grades_n)
    theta = np.log(share[:-1] / (1 - share[:-1]))
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    w, gw, gt, gg = np.zeros(SIZE, np.float32), np.full(SIZE, 1e-8, np.float32), 1e-8, np.full(len(gap), 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    low = theta[0]
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            at, x = rows[i]
            cuts = np.concatenate(([-np.inf], low + np.concatenate(([0.0], np.cumsum(np.exp(gap)))), [np.inf]))
            below = sigmoid(np.clip(cuts - w[at] @ x, -30, 30))
            below[0], below[-1] = 0.0, 1.0
            y = grades[i]
            p = max(below[y + 1] - below[y], 1e-9)
            up = 1 - below[y + 1] - below[y]  # minus the slope of the log-likelihood in the score
            g = up * x + DECAY * w[at]
            gw[at] += g * g
            w[at] -= RATE * g / np.sqrt(gw[at])
            slope = np.zeros(grades_n + 1)
            slope[y + 1], slope[y] = below[y + 1] * (1 - below[y + 1]) / p, -below[y] * (1 - below[y]) / p
            inner = slope[1:-1]
            g_low, g_gap = -inner.sum(), -np.cumsum(inner[::-1])[::-1][1:] * np.exp(gap)
            gt += g_low**2
            gg += g_gap**2
            low -= 0.1 * g_low / np.sqrt(gt)
            gap -= 0.1 * g_gap / np.sqrt(gg)
    return Model(w, low + np.concatenate(([0.0], np.cumsum(np.exp(gap)))))


def graded(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, grade): 0 of low quality, 1 of good quality but toxic, 2 of good quality. Rows without a rating are left out; of several for a document the lowest holds."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` of the rated documents (doc_id, grade), drawn by a hash; None if no document is rated."""
    ratings = ratings.select("doc_id", "grade")
    total = max(1, ratings.count())
    place = F.xxhash64("doc_id")
    drawn = ratings.where(F.pmod(place, F.lit(total)) < 2 * sample).orderBy(place, "doc_id").limit(sample)  # the same rows in every run
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")  # `sample` rows of two numbers at most
    shards = max(1, min(SHARDS, min(total, sample) // SHARE))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], ignore_index=True)
        got = fit_shard(pdf["text"].tolist(), pdf["grade"].to_numpy(np.int64))
        return pd.DataFrame({"n": [len(pdf)], "weights": [got.weights.tobytes()], "thresholds": [got.thresholds.tolist()]})

    held = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(HELD)) == 0 if total >= 10 * HELD else F.lit(False)
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard")
    parts = known.where(~held).select("*", shard).groupBy("shard").applyInPandas(run, "n long, weights binary, thresholds array<double>").collect()  # SHARDS rows at most
    if not parts:
        return None
    n = np.array([p["n"] for p in parts], float) / sum(p["n"] for p in parts)
    weights = sum(f * np.frombuffer(p["weights"], np.float32) for f, p in zip(n, parts, strict=True))
    model = Model(weights.astype(np.float32), sum(f * np.array(p["thresholds"]) for f, p in zip(n, parts, strict=True)))
    told = graded_by(known.where(held), model).select("grade", "tail_probability", "top_probability").collect()  # a HELDth of `sample` rows of three numbers
    model.least_top = calibrated(*np.array([tuple(r) for r in told], float).reshape(-1, 3).T)
    return model


def calibrated(grade: np.ndarray, tail: np.ndarray, top: np.ndarray, least: float = 0.5, clean: float = CLEAN) -> float:
    """The least probability of the highest grade at which, of the held-out documents that pass by their tail, most of the highest grade and fewest of lower grades are kept; at least `clean` of the former. 0 if either are missing."""
    good, other = np.sort(top[(tail >= least) & (grade == GRADES - 1)]), top[(tail >= least) & (grade < GRADES - 1)]
    if not len(good) or not len(other):
        return 0.0
    cuts = good[: 1 + int((1 - clean) * len(good))]
    gain = [np.mean(other < c) - np.mean(good < c) for c in cuts]
    return float(cuts[int(np.argmax(gain))])


MADE = ["expected_grade", "tail_probability", "top_probability"]


def graded_by(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (of grade 1 or more) and top_probability (of the highest grade); nulls without a model.

    Every row is graded on its whole text, null as empty; repeated rows stay, an empty table gives no rows, and columns of docs with these names are replaced.
    """
    docs = docs.drop(*MADE)
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in MADE})

    def grade(texts: list[str | None]) -> list[np.ndarray]:
        scores = np.zeros(len(texts))
        for i, t in enumerate(texts):
            at, x = features(t)
            scores[i] = model.weights[at] @ x
        tails = model.tails(scores)
        return [tails.sum(axis=1), tails[:, 0], tails[:, -1]]

    return appended(docs, text, dict.fromkeys(MADE, "double"), lambda: grade)


def kept(least: float = 0.5, least_top: float = 0.0) -> Column:
    """Whether a graded row is kept: its tail probability and that of the highest grade are at least these, or there is no model."""
    return F.coalesce((F.col("tail_probability") >= least) & (F.col("top_probability") >= least_top), F.lit(True))


def kept_by(model: Model | None) -> Column:
    """kept at the model's own threshold of the highest grade, so that good but toxic documents go."""
    return kept(least_top=model.least_top if model else 0.0)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, expected_grade, tail_probability, top_probability, kept), one for each row of documents, graded on its whole text (null: empty); without labels all are kept and the grades are null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    return graded_by(docs, model).select("doc_id", "expected_grade", "tail_probability", "top_probability", kept_by(model).alias("kept"))
