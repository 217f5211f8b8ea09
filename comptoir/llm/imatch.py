"""I-Match document fingerprints, in DataFrame functions only.

A document's terms are kept if their inverse document frequency lies in a band; the sorted distinct
terms are hashed once for each of several randomised subsets of the band's lexicon. Dense subsets hold
three quarters of it each, and tell copies; sparse ones split what is left of it at a rate that fits the
document's length, and tell how much two texts share. A fingerprint holds the dense digests and the sparse
ones at two neighbouring rates, so that texts of unlike length share one.

Terms stand for slots of a hashed lexicon that grows with the vocabulary up to a bound, so that document
frequencies are counted over all documents and the band is a bitmap of bounded size. Beyond the bound rare
terms share slots, which leaves more of them in the band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from comptoir.llm.shared import table, written

#: Bits of the lexicon, at least and at most; slots for each slot in use; largest share of documents and least count of them in the band.
LEXICON, FINEST, ROOM, SHARE, LEAST = 18, 22, 4, 0.1, 2
#: Dense subsets; sparse ones, as bits; terms from which a rate is quartered; digits of a digest.
DENSE, SPARSE, FULL = 6, 5, 32
EMPTY, WIDE = "....", 4
SUBSETS = 1 << SPARSE
#: Blocks of doc_id for each shuffle partition; rows in a block beyond that; blocks at most, and in a coarse step of the search.
SPREAD, ROWS, BLOCKS, COARSE = 4, 50_000, 1 << 14, 128


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, in lower case."""
    words = F.filter(F.split(F.lower(text), F.lit(r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _slot(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def lexicon_band(docs: DataFrame, text: str = "text", share: float = SHARE, least: int = LEAST) -> list[int]:
    """The band's bitmap: bit i % 64 of word i // 64 is set if slot i of the lexicon is in it. Counts cover all documents; 2 ** FINEST / 64 words reach the driver at most."""
    slots = docs.select(F.explode(F.array_distinct(F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda h: _slot(h, FINEST)))).alias("slot"))
    fine = written(slots.groupBy("slot").count(), "lexicon")
    n, used = docs.count(), fine.count()
    bits = next((b for b in range(LEXICON, FINEST) if ROOM * used <= 1 << b), FINEST)
    counts = fine.groupBy(F.shiftright("slot", FINEST - bits).alias("slot")).agg(F.sum("count").alias("n"))
    band = counts.where(F.col("n").between(least, max(share * n, least)))
    words = band.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = [0] * (1 << bits >> 6)
    for word, held in words.collect():
        out[word] = held
    return out


def with_terms(rows: DataFrame, text: str, band: list[int], out: str) -> DataFrame:
    """rows with `out`: the text's sorted terms in the band; all its terms if none is."""
    bits = (len(band) << 6).bit_length() - 1
    bitmap = F.expr(f"array({','.join(f'{x}L' if x > -(2**63) else '(-9223372036854775807L - 1L)' for x in band)})")
    inside = lambda h: F.call_function("shiftrightunsigned", F.element_at(bitmap, (F.shiftrightunsigned(h, 70 - bits) + 1).cast("int")), _slot(h, bits).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    rows = rows.withColumn("_all", terms(F.col(text))).withColumn("_band", F.filter("_all", inside))
    return rows.withColumn(out, F.array_sort(F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_all")))).drop("_all", "_band")


def _digest(h: Column) -> Column:
    return F.right(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(WIDE))


def _sparse(thinned: Column) -> Column:
    """A digest for each value of the terms' leading bits, EMPTY for those without terms: sorted terms come by them, so one pass is enough."""
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("out"))

    def step(got: Column, h: Column) -> Column:
        at = F.shiftrightunsigned(h, 64 - SPARSE).cast("int").bitwiseXOR(F.lit(SUBSETS // 2))  # ascending with signed terms
        same = got["at"] == at
        before = F.when(got["at"] < 0, "").otherwise(_digest(got["hash"]))
        out = F.when(same, got["out"]).otherwise(F.concat(got["out"], before, F.repeat(F.lit(EMPTY), at - got["at"] - 1)))
        return F.struct(at.alias("at"), F.xxhash64(F.when(same, got["hash"]).otherwise(F.lit(0).cast("long")), h).alias("hash"), out.alias("out"))

    last = lambda got: F.concat(got["out"], F.when(got["at"] < 0, "").otherwise(_digest(got["hash"])), F.repeat(F.lit(EMPTY), F.lit(SUBSETS - 1) - got["at"]))
    return F.aggregate(thinned, zero, step, last)


def _dense(sorted_terms: str, i: int) -> Column:
    """The terms in dense subset i: three quarters of the lexicon, by two bits of its own."""
    return F.filter(sorted_terms, lambda h: F.shiftright(h, 24 + 2 * i).bitwiseAND(F.lit(3)) != 0)


def with_fingerprint(rows: DataFrame, text: str, band: list[int], out: str) -> DataFrame:
    """rows with `out`: the rate in two digits, then WIDE digits for each dense subset, and for each sparse one at this rate and at the next (EMPTY: none of its terms)."""
    rows = with_terms(rows, text, band, "_terms")
    rate = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size("_terms"), F.lit(1)) / FULL) / 2)).cast("int")
    rows = rows.withColumn("_rate", rate)
    at = lambda step: F.filter("_terms", lambda h: h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_rate") + step) * 2) - 1) == 0)
    rows = rows.withColumn("_here", at(0))
    dense = [_digest(F.xxhash64(_dense("_terms", i))) for i in range(DENSE)]
    further = F.filter("_here", lambda h: h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_rate") + 1) * 2) - 1) == 0)
    whole = F.concat(F.lpad(F.col("_rate").cast("string"), 2, "0"), *dense, _sparse(F.col("_here")), _sparse(further))
    return rows.withColumn(out, whole).drop("_terms", "_rate", "_here")


def likeness(a: str, b: str) -> Column:
    """Of two fingerprint columns: 1 if equal; else the larger of the share of equal dense digests and of the share of equal sparse ones at a rate they have in common, among those that hold terms of either (0 without one)."""
    x, y = F.col(a), F.col(b)
    gap = F.substring(y, 1, 2).cast("int") - F.substring(x, 1, 2).cast("int")

    def share(first: int, other: int, n: int) -> Column:
        place = lambda c, begin, k: F.substr(c, F.lit(begin) + k * WIDE, F.lit(WIDE))
        zero = F.struct(F.lit(0).alias("told"), F.lit(0).alias("same"))

        def step(got: Column, k: Column) -> Column:
            p, q = place(x, first, k), place(y, other, k)
            told = (p != EMPTY) | (q != EMPTY)
            return F.struct((got["told"] + told.cast("int")).alias("told"), (got["same"] + (told & (p == q)).cast("int")).alias("same"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, step, lambda got: F.coalesce(F.try_divide(got["same"].cast("double"), got["told"]), F.lit(0.0)))

    here, further = 3 + DENSE * WIDE, 3 + (DENSE + SUBSETS) * WIDE
    sparse = F.when(gap == 0, F.greatest(share(here, here, SUBSETS), share(further, further, SUBSETS))).when(gap == 1, share(further, here, SUBSETS)).when(gap == -1, share(here, further, SUBSETS)).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(F.greatest(share(3, 3, DENSE), sparse))


def _block(limits: list[int], of: Column) -> Column:
    """How many of the ascending limits are at or below a value; a coarse step, then one within it."""
    listed = lambda some: F.expr(f"array({','.join(f'{b}L' for b in some)})") if some else F.array().cast("array<long>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= of))
    coarse = below(listed(limits[COARSE - 1 :: COARSE])) * COARSE
    return coarse + below(F.slice(listed(limits), coarse + 1, F.lit(COARSE)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<c> of the next row by doc_id (null first, ties by text); after the last comes the first.

    Rows are dealt by blocks of doc_id, whose bounds are quantiles, and windows stay within a block; a
    block's last row gets the first row of the block after it. Only bounds and first ids reach the driver.
    """
    spark = docs.sparkSession
    n = min(BLOCKS, max(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] or []
    rows = docs.withColumn("block", F.when(F.col("doc_id").isNull(), 0).otherwise(_block(sorted(set(bounds)), F.col("doc_id"))))
    order = W.partitionBy("block").orderBy("doc_id", "text")
    led = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns} | {"last": F.lead(F.lit(1)).over(order).isNull()})
    heads = sorted(rows.groupBy("block").agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).collect())
    if not heads:
        return led.drop("block", "last")
    ids = [None if nulls else first for _, first, nulls in heads]
    known = [i for i in ids if i is not None]
    wanted = F.col("doc_id").isin(known) if known else F.lit(False)
    wanted = wanted | F.col("doc_id").isNull() if None in ids else wanted
    firsts = docs.where(wanted).withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("place = 1")
    values = ",".join(f"({b}, {'NULL' if i is None else i})" for (b, _, _), i in zip(heads, [*ids[1:], ids[0]], strict=True))
    after = spark.sql(f"SELECT CAST(b AS INT) AS block, CAST(i AS BIGINT) AS head FROM VALUES {values} AS t(b, i)")
    follow = after.join(firsts, after["head"].eqNullSafe(firsts["doc_id"])).select("block", *[F.col(c).alias(f"follow_{c}") for c in columns])
    met = led.join(follow, "block", "left")
    return met.withColumns({f"next_{c}": F.when(F.col("last"), F.col(f"follow_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}).drop("block", "last", *[f"follow_{c}" for c in columns])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text, fingerprint), null texts as empty: equal texts have equal fingerprints. A text without terms has only empty subsets. Repeated rows stay; an empty table gives no rows; other columns are dropped."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_fingerprint(rows, "text", lexicon_band(docs, text), "fingerprint")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of docs.

    edited: the text, its last half (rounded down) replaced by as many of the first code points of the next
    text, or all of it. The next row is that by doc_id, null first, ties by text; the first follows the last, so
    that a row alone follows itself. Null texts are empty. Other columns are dropped.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    band = lexicon_band(docs)
    rows = with_next(with_fingerprint(docs, "text", band, "fingerprint"), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", "edited"), "edited", band, "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op4_imatch(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of documents; a null text is an empty one, and equal texts have equal fingerprints."""
    return edited_likeness(table(spark, sf_dir, "documents")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
