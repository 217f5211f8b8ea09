"""URL filters by host word segmentation and multinomial naive Bayes.

Unigram Viterbi splits concatenated names into words; multinomial naive Bayes scores the words of
host and path. Words and their exact counts come from all URLs; those of a least share of all words are kept, so
that their table has a bound, and shares, not counts, weigh, so that splits do not depend on the input's size.
URLs whose host holds a seed word are the unwanted class for fitting. All seeds count as one word, whose weight is
learnt like any other's, and the words that go with them have weights of their own, so that the model finds names that hold none.
A fifth of the hosts is held out, and the score from which a URL is blocked is chosen on them. Listed rules go before
the model: a rule fits its host and all subdomains where the path starts with the rule's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import table, written

#: Words of this share of all (1 in so many) or more are kept, which bounds their number; the share that a seed word has at least, and a word never seen before its letters; letters of the longest word.
KEPT, SEED, UNSEEN, LONGEST = 1 << 19, 20_000, 1 << 20, 24
#: Bits of the naive Bayes table; smoothing; uses from which a word has a weight; hosts of which one is held out; steps of a score's histogram.
TERMS, SMOOTH, USES, FOLDS, STEPS = 18, 0.5, 3, 5, 10
#: What every seed word counts as.
MARK = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that mark a name as unwanted when the model is fitted; the model learns the words that go with them.
SEEDS = (
    "ads adserver adult bet bets betting casino cams cialis crack cracked doorway escort escorts gambling jackpot keygen "
    "lottery malware nude payday phishing pills poker popunder porn porno roulette sex slots spam torrent track tracker "
    "viagra warez webcam xxx"
).split()
#: Fixed values: (rule, verdict) of the list that goes before the model.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

_CUT = re.compile(r"[^a-z0-9\x80-\U0010ffff]+")
_RUN = re.compile(r"[0-9]+|[^0-9]+")
_LETTERS = re.compile(r"[^0-9]+")


def slot(word: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - bits)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: then up to ?, # or the end. Both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is a host with a path from its first slash on."""
    name, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        name, said = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(said)
    return name, said


def delimited(host: str, path: str) -> Iterator[str]:
    """Words that a URL shows as such, without digits: the last label of its host, parts of labels with hyphens, and words of its path."""
    labels = host.split(".")
    for i, label in enumerate(labels):
        parts = [p for p in _CUT.split(label) if p]
        if len(parts) > 1 or i + 1 == len(labels):
            yield from (w for p in parts for w in _LETTERS.findall(p))
    yield from (w for p in _CUT.split(path.lower()) if p for w in _LETTERS.findall(p))


class Segmenter:
    """words(name) -> its most likely split. shares: of words among all; a word never seen costs its letters."""

    def __init__(self, shares: dict[str, float], longest: int = LONGEST) -> None:
        self.logs, self.longest = {w: log(p) for w, p in shares.items()}, longest
        self.words = lru_cache(1 << 16)(self._words)

    def cost(self, word: str) -> float:
        return self.logs.get(word, -log(UNSEEN) - log(10) * len(word))

    def _words(self, name: str) -> tuple[str, ...]:
        """Viterbi over the ends of words; digits are one word of their own, written 0."""
        out: list[str] = []
        for run in _RUN.findall(name):
            if run[0].isdigit() and run[0].isascii():
                out.append("0")
                continue
            best, back = [0.0], [0]
            for end in range(1, len(run) + 1):
                at = max(range(max(0, end - self.longest), end), key=lambda i: best[i] + self.cost(run[i:end]))
                best.append(best[at] + self.cost(run[at:end]))
                back.append(at)
            end, cut = len(run), []
            while end:
                cut.append(run[back[end] : end])
                end = back[end]
            out += cut[::-1]
        return tuple(out)

    def of(self, host: str, path: str) -> list[str]:
        """Words of host and path; those of the path are marked, so that they count apart."""
        got = [w for part in _CUT.split(host) if part for w in self.words(part)]
        return got + [f"/{w}" for part in _CUT.split(path.lower()) if part for w in self.words(part)]


@dataclass
class UrlModel:
    """shares: of words; weights: log-likelihood ratio by slot; prior: log odds of the unwanted class; seeds: words that mark it; cut: the score above which a URL is blocked."""

    shares: dict[str, float]
    weights: np.ndarray
    prior: float
    seeds: frozenset[str]
    cut: float = 0.0

    def score(self, words: list[str]) -> float:
        """Log odds of the unwanted class: the prior and the weights of all words."""
        return self.prior + float(sum(self.weights[slot(MARK if w in self.seeds else w, TERMS)] for w in words))


def _parts(urls: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    return urls.select(host.alias("host"), path.alias("path"))


def word_shares(urls: DataFrame, url: str = "url", seeds: list[str] = SEEDS) -> dict[str, float]:
    """Shares of delimited words among all of all URLs, exact; the fewer than KEPT words of a share of 1 in KEPT or more, and the seeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = Counter(w for host, path in zip(pdf["host"], pdf["path"], strict=True) for w in delimited(host, path))
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": object, "n": np.int64})

    words = written(_parts(urls, url).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = words.agg(F.sum("n")).first()[0] or 1
    shares = {w: n / total for w, n in words.where(F.col("n") * KEPT >= total).collect()}
    return shares | {w: max(shares.get(w, 0.0), 1 / SEED) for w in seeds}


def _naive_bayes(terms: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by slot and the prior, of counts by class."""
    uses = terms.sum(axis=0)
    rates = np.log(terms + SMOOTH) - np.log(terms.sum(axis=1, keepdims=True) + SMOOTH * ((uses > 0).sum() + 1))
    weights = np.where(uses >= USES, rates[1] - rates[0], 0.0)  # a word hardly seen says nothing
    return weights, float(np.log(each[1] + 1) - np.log(each[0] + 1))


def best_cut(told: list[tuple[float, int, int]]) -> float:
    """The score above which most unwanted and fewest wanted of the rows (score, kind, n) lie, as shares of each kind; of equally good ones that nearest to 0, and 0 if a kind is missing."""
    total = [sum(n for _, kind, n in told if kind == k) for k in (0, 1)]
    if not all(total):
        return 0.0
    marks = sorted({0.0, *(s for s, _, _ in told)})
    gain = lambda c: sum(n / total[1] if kind else -n / total[0] for s, kind, n in told if s > c)
    return min(marks, key=lambda c: (-round(gain(c), 12), abs(c)))


def fit(urls: DataFrame, url: str = "url", seeds: list[str] = SEEDS) -> UrlModel:
    """A model from all URLs: one with a seed word among the segmented words of its host counts as unwanted, all others as wanted.

    Four fifths of the hosts give weights by which the rest is scored, and the cut is chosen on those; the
    model's own weights are then those of all. Null URLs have no words; an empty table gives a model that allows all. 2 ** (TERMS + 2) counts
    and a histogram reach the driver at most.
    """
    shares, unwanted = word_shares(urls, url, seeds), frozenset(seeds)
    shared = urls.sparkSession.sparkContext.broadcast(shares)  # KEPT words at most
    rows = _parts(urls, url).withColumn("fold", (F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0).cast("int"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, terms, each = Segmenter(shared.value), np.zeros((4, 1 << TERMS), np.int64), np.zeros(4, np.int64)
        for pdf in batches:
            for host, path, fold in zip(pdf["host"], pdf["path"], pdf["fold"], strict=True):
                words = cut.of(host, path)
                kind = 2 * fold + int(not unwanted.isdisjoint(words))
                each[kind] += 1
                for w in words:
                    terms[kind, slot(MARK if w in unwanted else w, TERMS)] += 1
        kind, at = np.nonzero(terms)
        found = pd.DataFrame({"kind": kind, "slot": at, "n": terms[kind, at]})
        yield pd.concat([found, pd.DataFrame({"kind": range(4), "slot": -1, "n": each})])

    terms, each = np.zeros((4, 1 << TERMS)), np.zeros(4)
    for kind, at, n in rows.mapInPandas(counted, "kind int, slot long, n long").groupBy("kind", "slot").agg(F.sum("n")).collect():
        if at < 0:
            each[kind] = n
        else:
            terms[kind, at] = n
    tried = urls.sparkSession.sparkContext.broadcast(UrlModel(shares, *_naive_bayes(terms[:2], each[:2]), unwanted))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, told = Segmenter(shared.value), Counter()
        for pdf in batches:
            for host, path in zip(pdf["host"], pdf["path"], strict=True):
                words = cut.of(host, path)
                told[round(STEPS * tried.value.score(words)), int(not unwanted.isdisjoint(words))] += 1
        yield pd.DataFrame([(*k, n) for k, n in told.items()], columns=["step", "kind", "n"]).astype({"step": np.int64, "kind": np.int64, "n": np.int64})

    told = rows.where("fold = 1").mapInPandas(scored, "step long, kind int, n long").groupBy("step", "kind").agg(F.sum("n")).collect()
    cut = best_cut([(step / STEPS, kind, n) for step, kind, n in told])
    return UrlModel(shares, *_naive_bayes(terms[:2] + terms[2:], each[:2] + each[2:]), unwanted, cut)


def judged(urls: DataFrame, model: UrlModel, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """urls with host, path, words (segmented), score (log odds of unwanted), rule and verdict ("allow" or "block").

    The longest fitting rule decides, else the model: a score above its cut is blocked. Null URLs and such without "://"
    have an empty host and path. Repeated rows stay; columns of urls with these names are replaced.
    """
    made = ["host", "path", "words", "score", "rule", "verdict"]
    kept = urls.drop(*[c for c in made if c != url])
    host, path = host_and_path(F.col(url))
    rows = kept.select("*", host.alias("host"), path.alias("path"))
    shared = urls.sparkSession.sparkContext.broadcast(model)  # tables of bounded size

    @F.pandas_udf("words array<string>, score double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cut = Segmenter(shared.value.shares)
        for hosts, paths in batches:
            words = [cut.of(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"words": words, "score": [shared.value.score(w) for w in words]})

    rows = rows.withColumn("_got", scored("host", "path")).select("*", "_got.words", "_got.score").drop("_got")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") > model.cut, "block").otherwise("allow")
    return rows.select("*", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score) of all pages, judged by the rules and by a model of the same pages. Null and malformed URLs have empty parts; repeated rows stay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")
