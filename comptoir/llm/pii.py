"""Personal data by candidate gradient boosting, in DataFrame functions only.

Exact patterns give the base spans, which always stay. High-recall generators propose further, overlapping
spans; boosted trees score every proposal by its format and its context, and those at or above the
kind's calibrated threshold are added. Trees are fitted by pyspark.ml on a bounded sample of documents and
on planted lines. What generators alone find is not labelled by the exact rules: positives are rewritten
copies of true spans (spelled-out and accented addresses, long addresses, other separators), negatives
their near misses at other places of the text, and proposals of the corpus whose format tells one way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comptoir.llm.shared import checkpointed, table, written

KINDS = ["email", "ip", "card", "phone"]
#: Possessive forms of the base patterns: they match what the plain forms match, in linear time and without recursion; cards of another length than 13 to 19 digits, which would be dropped, are not matched at all.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_EDGE = r"[^\s@<>()\[\],;:\"'=]"
#: High-recall generators: other letters in addresses, spelled-out signs, other separators, numbers without a plus sign, longer addresses.
WIDE = {
    "email": rf"(?<!{_EDGE}){_EDGE}{{1,64}}@{_EDGE}{{2,190}}|(?i:(?<![\w.+-])[\w.+-]{{1,64}} ?[\[({{] ?at ?[\])}}] ?[\w-]{{1,63}}(?: ?(?:\.|[\[({{] ?dot ?[\])}}]) ?[\w-]{{1,63}}){{1,5}})",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,-])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])",
}
#: Words that announce personal data, in the languages of the corpus.
CUES = r"(?i)(e-?mail|mail|courriel|correo|phone|tel|call|mobile|telefon|tél|card|visa|carte|karte|tarjeta|credit|paid|ip|address|adresse|server|host|contact|kontakt)"
#: Documents in the sample, boosting rounds, depth; precision that a threshold must reach on held-out proposals, and how many of them it takes.
SAMPLE, ROUNDS, DEPTH, PRECISION, ENOUGH = 20_000, 12, 5, 0.99, 30
MARK, PLAIN, NEAR = "\x01", "\x02", 32
SPAN = "array<struct<kind:int,start:int,end:int,said:string>>"
BARE = "array<struct<kind:int,start:int,end:int>>"
#: Planted lines, so that small tables have a model too; the threshold of a kind too rare to calibrate, on its own or with the others.
PLANTED, CAUTIOUS = 1200, 0.9
SPELLED, DATED = r"(?i)[\[({] ?at ?[\])}]", r"^\(?[0-9]{1,4}\)?[ ./-][0-9]{1,2}[ ./-][0-9]{2,4}(?![0-9])"


@dataclass
class Detector:
    """trees: (weight, nested (feature, limit, left, right) or a value) of each; thresholds: by kind, absent if the kind gets no spans beyond the base."""

    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)


def _marked(text: Column, pattern: str, needs: Column | None) -> Column:
    out = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return out if needs is None else F.when(needs, out).otherwise(text)


def _spans(marked: Column, kind: int) -> Column:
    """The marked spans of a text as (kind, start, end, said), in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("out"))

    def step(got: Column, part: Column) -> Column:
        end = got["at"] + F.length(part)
        one = F.struct(F.lit(kind).alias("kind"), got["at"].alias("start"), end.alias("end"), part.alias("said"))
        return F.struct(end.alias("at"), (~got["inside"]).alias("inside"), F.when(got["inside"], F.concat(got["out"], F.array(one))).otherwise(got["out"]).alias("out"))

    found = F.aggregate(F.split(marked, F.lit(MARK), -1), zero, step, lambda got: got["out"])
    return F.when(F.contains(marked, F.lit(MARK)), found).otherwise(F.array().cast(SPAN))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") * (F.when(i % 2 == 0, 2).otherwise(1))
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(x: Column) -> Column:
    """Whether a base match stays: the ranges, counts and checksum of its kind."""
    n = F.length(_digits(x["said"]))
    low = F.forall(F.split(x["said"], F.lit(r"\.")), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    return F.when(x["kind"] == 0, True).when(x["kind"] == 1, low).when(x["kind"] == 2, n.between(13, 19) & luhn(_digits(x["said"]))).otherwise(n.between(9, 15))


def _features(x: Column, before: Column, after: Column) -> list[Column]:
    said, count = x["said"], lambda p: F.regexp_count(x["said"], F.lit(p)).cast("double")
    flag = lambda c, p: c.rlike(p).cast("int").cast("double")
    kinds = [(x["kind"] == k).cast("int").cast("double") for k in range(len(KINDS))]
    return [
        *kinds, F.length(said).cast("double"), count("[0-9]"), count("[A-Za-z]"), count(r"[^\x00-\x7f]"), count(r"\."), count("[ -]"), count(r"[()]"), count("[0-9]+"), count(":"),
        flag(said, r"^\+"), flag(said, r"@[^@]+\.\p{L}{2,}$"), flag(said, SPELLED), flag(said, r"(?i)\bdot\b|\.[a-z]{2,}$"), flag(said, DATED), flag(said, "^[0-9]{13,19}$"), flag(said, r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), flag(said, r"^[3-6]"), (F.length(_digits(said)).between(13, 19) & luhn(_digits(said))).cast("int").cast("double"),
        flag(before, CUES), flag(before, r"[0-9A-Za-z]$"), flag(before, r"[\"'=/_]$"), flag(after, "^[0-9A-Za-z]"), flag(after, r"^[\"'/_.-]"), flag(before, r"(^|\s)$"), flag(after, r"^(\s|$|[.,;:!?])"),
    ]


def _around(clean: Column, x: Column) -> tuple[Column, Column]:
    """What stands before and after a span."""
    return F.substring(clean, F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR))), F.substring(clean, x["end"] + 1, F.lit(4))


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _clean (the text, null as empty), _base (valid base spans, by kind and start) and _wide (what generators find beyond base spans: proposals may overlap them and one another, but none lies within one)."""
    has = lambda c: F.contains("_clean", F.lit(c))
    rows = docs.withColumn("_clean", F.translate(F.coalesce(F.col(text), F.lit("")), MARK, PLAIN))
    base, wide = {"email": has("@"), "phone": has("+")}, {"email": has("@") | F.col("_clean").rlike(SPELLED), "ip": has(":")}
    rows = rows.withColumns({f"_b{k}": _marked(F.col("_clean"), BASE[k], base.get(k)) for k in KINDS} | {f"_w{k}": _marked(F.col("_clean"), WIDE[k], wide.get(k)) for k in KINDS})
    rows = rows.withColumns({f"_{c}": F.concat(*[_spans(F.col(f"_{c}{k}"), i) for i, k in enumerate(KINDS)]) for c in "bw"}).drop(*[f"_{c}{k}" for c in "bw" for k in KINDS])
    rows = rows.withColumn("_base", F.filter("_b", _valid))
    fresh = lambda x: ~F.exists("_base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    return rows.withColumn("_wide", F.filter("_w", fresh)).drop("_b", "_w")


def _pick(of: Column, n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(n)).cast("int")


def planted(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """n lines (text) with one true span each, of all kinds in turn, half of them announced."""
    i = F.col("id")
    part = lambda size, salt: F.lpad(_pick(i, 10**size, salt).cast("string"), size, "0")
    head = F.concat(F.lit("4"), part(7, 1), part(7, 2))
    card = F.concat(head, F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)).cast("array<string>"), lambda d: luhn(F.concat(head, d))), 1))
    card = F.when(i % 8 < 4, card).otherwise(F.regexp_replace(card, F.lit("(.{4})(?=.)"), F.lit("$1 ")))
    ip = F.concat_ws(".", *[(_pick(i, 254, s) + 1).cast("string") for s in (3, 4, 5, 6)])
    names = F.array(*map(F.lit, "anna jean.luc maria_g tom k.weber info sales lopez".split()))
    hosts = F.array(*map(F.lit, "ex.fr web.de mail.example.org k12.co.uk my-shop.net example.com lab3.uni.es post.ch".split()))
    mail = F.concat(F.element_at(names, _pick(i, 8, 7) + 1), F.when(_pick(i, 3, 17) == 0, part(2, 8)).otherwise(""), F.lit("@"), F.element_at(hosts, _pick(i, 8, 9) + 1))
    phone = F.concat_ws(" ", F.concat(F.lit("+"), (_pick(i, 88, 10) + 11).cast("string")), part(3, 11), part(3, 12), part(3, 13))
    value = F.element_at(F.array(mail, ip, card, phone), F.pmod(i, F.lit(4)).cast("int") + 1)
    cues = F.array(*[F.array(*map(F.lit, c)) for c in (("mail: ", "e-mail ", "courriel : ", "Contact "), ("server ", "IP ", "host ", "address: "), ("card ", "carte ", "paid with visa ", "tarjeta: "), ("call ", "phone: ", "tel. ", "telefon "))])
    cue = F.element_at(F.element_at(cues, F.pmod(i, F.lit(4)).cast("int") + 1), _pick(i, 4, 14) + 1)
    plain = F.element_at(F.array(*map(F.lit, ("the ", "of ", "see ", "und "))), _pick(i, 4, 15) + 1)
    return spark.range(n).select(F.concat(F.lit("words before it and "), F.when(_pick(i, 2, 16) == 0, cue).otherwise(plain), value, F.lit(", and words after it")).alias("text"))


def rewritten(x: Column) -> Column:
    """Copies (said, label) of a true span: in other forms, that only generators find (1), and near misses of those (0)."""
    said, digits, hashed = x["said"], _digits(x["said"]), F.md5(x["said"])
    name, host = F.substring_index(said, "@", 1), F.substring_index(said, "@", -1)
    one = lambda c, label: F.struct(c.alias("said"), F.lit(float(label)).alias("label"))
    cut = lambda c, sep, sizes: F.concat_ws(sep, *[F.substr(c, F.lit(1 + sum(sizes[:i])), F.lit(n)) for i, n in enumerate(sizes)])
    small = lambda s: F.lpad(_pick(said, 60, s).cast("string"), 2, "0")
    other = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    tail = F.lpad(F.right(digits, F.lit(9)), 10, "0")
    day, month, year = (_pick(said, 28, 21) + 1).cast("string"), F.lpad((_pick(said, 12, 22) + 1).cast("string"), 2, "0"), (_pick(said, 60, 23) + 1970).cast("string")
    by = [
        [one(F.concat(name, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))), 1), one(F.concat(name, F.lit(" (at) "), host), 1), one(F.concat(name, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("(dot)"))), 1), one(F.concat(F.translate(name, "aeou", "àéöü"), F.lit("ñ@"), host), 1), one(F.concat(name, F.lit("@"), F.translate(host, "aeou", "àéöü")), 1),
         one(F.concat(name, F.lit("@"), F.substring_index(host, ".", 1)), 0), one(F.concat(small(24), F.lit("@"), small(25), F.lit(".00")), 0), one(F.concat(small(26), F.lit("@"), small(27)), 0)],
        [one(cut(hashed, ":", [4] * 8), 1), one(F.regexp_replace(cut(hashed, ":", [4] * 8), F.lit("(?<=:)0+(?=[0-9a-f])"), F.lit("")), 1), one(F.upper(cut(F.reverse(hashed), ":", [4] * 8)), 1),
         one(F.concat_ws(":", small(24), small(25), small(26), small(27)), 0), one(F.concat_ws(":", small(28), small(29), small(30), small(31), small(32)), 0)],
        [*[one(cut(digits, sep, [4, 4, 4, 4]), 1) for sep in (".", "/", "_")], *[one(cut(other, sep, [4, 4, 4, 4]), 0) for sep in (".", "/", " ", "-")]],
        [one(cut(tail, " ", [2] * 5), 1), one(cut(tail, ".", [2] * 5), 1), one(F.concat(F.lit("("), F.substr(tail, F.lit(1), F.lit(3)), F.lit(") "), F.substr(tail, F.lit(4), F.lit(3)), F.lit("-"), F.right(tail, F.lit(4))), 1), one(cut(tail, "-", [3, 3, 4]), 1), one(cut(tail, " ", [3, 3, 2, 2]), 1), one(cut(tail, " ", [4, 3, 3]), 1),
         one(F.concat_ws("/", F.lpad(day, 2, "0"), month, year), 0), one(F.concat_ws("-", year, month, F.lpad(day, 2, "0")), 0), one(F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), small(33)), 0), one(F.concat_ws(" ", small(34), small(35), small(36)), 0), one(cut(F.concat(tail, tail), ".", [4] * 4), 0), one(cut(F.concat(tail, tail), " ", [4] * 4), 0), one(F.concat_ws(".", small(37), small(38), small(39), small(40)), 0)],
    ]
    none = F.array().cast("array<struct<said:string,label:double>>")
    out = none
    for k, copies in enumerate(by):
        held = F.filter(F.array(*copies), lambda c: ~F.exists(F.array(x["said"]), lambda s: s == c["said"]))
        out = F.when(x["kind"] == k, held).otherwise(out)
    return out


def _told(x: Column, before: Column) -> Column:
    """The label that a proposal's format gives it, null if it tells nothing."""
    said, n, cue = x["said"], F.length(_digits(x["said"])), before.rlike(CUES)
    mail = F.when(said.rlike(r"@[^@]*\.\p{L}{2,}$") | said.rlike(SPELLED), 1.0).otherwise(0.0)
    ip = F.when(said.rlike("(?i)[a-f]") & (F.regexp_count(said, F.lit(":")) >= 7), 1.0).when(F.regexp_count(said, F.lit(":")) < 5, 0.0)
    card = F.when(~(n.between(13, 19) & luhn(_digits(said))), 0.0).when(cue, 1.0)
    phone = F.when((n < 8) | said.rlike(DATED), 0.0).when(cue & n.between(9, 12), 1.0)
    return F.when(x["kind"] == 0, mail).when(x["kind"] == 1, ip).when(x["kind"] == 2, card).otherwise(phone)


def examples(docs: DataFrame) -> DataFrame:
    """Labelled examples (kind, label, feats, fold) of documents (text): true spans, their copies and near misses, and proposals that their format labels."""
    rows = written(proposals(docs.select("text")).select("_clean", "_base", "_wide"), "pii-sample")
    x, at = F.col("x"), 1 + F.pmod(F.xxhash64("x.said", "x.start"), F.greatest(F.length("_clean"), F.lit(1))).cast("int")
    of = rows.select("_clean", F.explode("_base").alias("x"))
    before, after = _around(F.col("_clean"), x)
    of = of.select(x["kind"].alias("kind"), "x", before.alias("before"), after.alias("after"), F.substr("_clean", at, F.lit(NEAR)).alias("elsewhere"))
    true = of.select("kind", x["said"].alias("said"), F.lit(1.0).alias("label"), "before", "after")
    copies = of.select("kind", F.explode(rewritten(x)).alias("c"), "before", "after", "elsewhere")
    copies = copies.select("kind", "c.said", "c.label", F.when(F.col("c.label") == 1, F.col("before")).otherwise(F.concat("elsewhere", F.lit(" "))).alias("before"), F.when(F.col("c.label") == 1, F.col("after")).otherwise(F.lit(" ")).alias("after"))
    wild = rows.select("_clean", F.explode("_wide").alias("x"))
    wild = wild.select(x["kind"].alias("kind"), x["said"].alias("said"), _told(x, before).alias("label"), before.alias("before"), after.alias("after")).where("label IS NOT NULL")
    every = true.unionByName(copies).unionByName(wild)
    feats = F.array(*_features(F.struct("kind", "said"), F.col("before"), F.col("after")))
    return checkpointed(every.select("kind", "label", feats.alias("feats"), F.pmod(F.xxhash64("said", "before"), F.lit(4)).alias("fold")))


def _tree(lines: list[str]) -> object:
    """The nested form of a tree that pyspark.ml prints."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return float(m[1])
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    left = _tree(lines)
    lines.pop(0)  # Else
    return int(m[1]), float(m[2]), left, _tree(lines)


def _score(feats: Column, trees: list) -> Column:
    def value(node: object) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        at, limit, left, right = node
        return F.when(feats[at] <= limit, value(left)).otherwise(value(right))

    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + F.lit(weight) * value(tree)
    return 1 / (1 + F.exp(-2 * total))


def fit_detector(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Detector:
    """Trees and thresholds from about `sample` documents, drawn by a hash of doc_id, and planted lines.

    Three quarters of the examples fit the trees; the rest sets, for each kind, the least threshold whose
    examples at or above it are PRECISION positive (at least ENOUGH of them). A kind of fewer examples has the
    threshold of all kinds. Null texts are empty; an empty table is fitted on the planted lines alone.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    total = max(1, docs.count())
    drawn = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1))), F.lit(total)) < sample).select(F.col(text).alias("text"))
    rows = examples(drawn.unionByName(planted(docs.sparkSession)))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7).fit(rows.where("fold > 0").select("label", array_to_vector("feats").alias("features")))
    trees = [(w, _tree(t.toDebugString.split("\n")[1:])) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    held = rows.where("fold = 0").select("kind", "label", F.round(_score(F.col("feats"), trees), 4).alias("score"))
    got = [tuple(r) for r in held.groupBy("kind", "score").agg(F.count("*"), F.sum("label")).collect()]  # a kind has 10,001 scores at most
    own = {k: least_score([r[1:] for r in got if r[0] == k]) for k in range(len(KINDS))}
    pooled = least_score([r[1:] for r in got]) or CAUTIOUS
    few = {k: sum(r[2] for r in got if r[0] == k) < ENOUGH for k in own}
    return Detector(trees, {k: t or pooled for k, t in own.items() if t or few[k]})


def least_score(told: list[tuple[float, int, float]], enough: int = ENOUGH, precision: float = PRECISION) -> float | None:
    """The least score, 0.5 or more, from which up a share `precision` of at least `enough` examples (score, n, positive) is positive."""
    n, good, out = 0, 0.0, None
    for score, more, right in sorted(told, reverse=True):
        n, good = n + more, good + right
        if score >= 0.5 and n >= enough and good >= precision * n:
            out = score
    return out


def _found(docs: DataFrame, detector: Detector, text: str) -> DataFrame:
    """docs with _base and _spans, bare."""
    rows = proposals(docs, text)
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.array().cast(BARE)
    if detector.thresholds:
        limit = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(t)) for k, t in detector.thresholds.items()], F.lit(2.0))
        feats = F.transform("_wide", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*_features(x, *_around(F.col("_clean"), x))).alias("feats")))
        added = bare(F.filter(feats, lambda x: F.round(_score(x["feats"], detector.trees), 4) >= limit(x)))
    rows = rows.withColumn("_base", bare(F.col("_base"))).withColumn("_added", added)
    return rows.withColumn("_spans", F.array_sort(F.array_distinct(F.concat("_base", "_added")))).drop("_clean", "_wide", "_added")


def _boxed(docs: DataFrame, text: str) -> DataFrame:
    """(_row, _text): the columns of docs as one, so that none clashes with those made here."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))


def detect(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (kind, start, end) by kind as in KINDS, then start; columns of docs with these names are replaced.

    Null texts are empty and have none. Added spans may overlap one another and base spans, but lie within none of those. Repeated rows stay.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    return _found(_boxed(docs, text), detector, "_text").select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, detector: Detector, text: str = "text", chars: str | None = None) -> DataFrame:
    """The columns of docs, every span of the text replaced by its kind in brackets; overlapping spans become one, named by the first.

    chars: a column for the length of texts that changed. Null texts stay null; all other columns, whatever their names, stay as they are.
    """
    rows = _found(_boxed(docs, text), detector, "_text")
    order = F.array_sort(F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(got: Column, x: Column) -> Column:
        ahead = F.concat(got["out"], F.substring("_text", got["at"] + 1, x["start"] - got["at"]), names[x["kind"]])
        return F.struct(F.greatest(got["at"], -x["end"]).alias("at"), F.when(x["start"] >= got["at"], ahead).otherwise(got["out"]).alias("out"))

    whole = F.aggregate(order, zero, step, lambda got: F.concat(got["out"], F.substring("_text", got["at"] + 1, F.length("_text"))))
    some = F.size("_spans") > 0
    rows = rows.withColumn("_text", F.when(some, whole).otherwise(F.col("_text"))).withColumn("_some", some)
    made = {text: F.col("_text")} | ({chars: F.when(F.col("_some"), F.length("_text").cast(docs.schema[chars].dataType)).otherwise(F.col("_row")[chars])} if chars else {})
    return rows.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of all documents; a null text is an empty one, repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detect(docs, fit_detector(docs))
    counts = [count_of("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
