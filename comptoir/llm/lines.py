"""Lines that many documents share are dropped, by DataFrame functions alone.

Lines are exploded in normal form and hashed, the documents of each hash are counted (repeats within a
document once, in tasks before the shuffle), and places of lines over the threshold are gathered by
document, so that texts are put together again by position. What is shuffled are hashes and places; a text
moves once, to meet the places of its own lines. A line that a third of all documents hold is a row for
each task in the count, and its places are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import table, written

#: Documents from which a line is dropped; code points from which a key counts.
DOCUMENTS, LETTERS = 10, 1
#: A line with this part of all places of common lines is dealt over SALTS tasks.
SHARE, SALTS = 1024, 64
_UPPER, _LOWER, _BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"
#: 96 bits that name a line's key.
LINE = ["line_a", "line_b"]
#: What names a document's row: its id and 96 bits of its text, so that the rows of one name share all decisions.
ROW = ["row_id", "row_a", "row_b"]


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Its lines' keys: without ASCII white space at both ends, A-Z in lower case."""
    return F.transform(split_lines(F.translate(text, _UPPER, _LOWER)), lambda line: F.btrim(line, F.lit(_BLANK)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias(LINE[0]), F.hash(key).alias(LINE[1])]


def common_lines(docs: DataFrame, text: str = "text", documents: int = DOCUMENTS, letters: int = LETTERS) -> DataFrame:
    """Rows (line_a, line_b, documents) of the keys of `letters` code points or more that stand in `documents` rows of docs or more."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key")).where(F.length("key") >= letters)
    return keys.select(*_hashed(F.col("key"))).groupBy(*LINE).agg(F.count("*").alias("documents")).where(F.col("documents") >= documents)


def dropped_places(docs: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS) -> DataFrame:
    """Rows (row_id, row_a, row_b, places): numbers of the lines to drop, from 0, for each document that has one. common: rows as common_lines gives them, written, as they are read several times. Rows that repeat one another give one."""
    named = docs.select(*_named(doc_id, text), F.col(text).alias("text"))  # hashed once, below the rows of lines
    placed = named.select(*ROW, F.posexplode(line_keys(F.col("text"))).alias("place", "key")).where(F.length("key") >= letters)
    placed = placed.select(*ROW, "place", *_hashed(F.col("key")))
    total = common.agg(F.sum("documents")).first()[0] or 0
    often = F.col("documents") * SHARE >= total
    hot = common.where(often).select(*LINE, F.lit(True).alias("hot"))  # at most SHARE lines
    placed = placed.join(F.broadcast(hot), LINE, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*ROW, "place"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salted = common.select(*LINE, F.explode(F.sequence(F.lit(0).cast("long"), F.when(often, F.lit(SALTS - 1)).otherwise(0).cast("long"))).alias("salt"))
    met = placed.join(salted, [*LINE, "salt"])
    return met.groupBy(*ROW).agg(F.collect_set("place").alias("places"))


def _named(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias(ROW[0]), F.xxhash64(text).alias(ROW[1]), F.hash(text).alias(ROW[2])]


def without_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, letters: int = LETTERS) -> DataFrame:
    """docs with the text less the lines that `documents` rows share, and n_lines (before) and n_dropped; columns of these two names are replaced.

    Every row is a document, so repeated rows count each, and ids may be null or repeat. A null or empty text is one empty
    line and comes out empty, as does a text that loses all its lines; an empty line (a key of fewer than `letters`
    code points) is never dropped. Other columns stay as they are. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    common = written(common_lines(docs, text, documents, letters), "lines")
    places = dropped_places(docs, common, doc_id, text, letters)
    # the join's own columns are structs of fixed names, so that columns of any name may stand beside them
    left = docs.select(F.struct(*kept).alias("_own"), F.struct(*_named(doc_id, text)).alias("_row"))
    right = places.select(F.struct(*ROW).alias("_named"), "places")
    met = left.join(right, F.col("_row").eqNullSafe(F.col("_named")), "left")
    own = F.col("_own").getField(text)
    lines = split_lines(own)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
    # the outer transform binds the lines once
    joined = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(rest, lambda i: F.get(ls, i)), "\n"))[0]
    return met.select(
        *[F.when(F.col("places").isNull(), F.coalesce(own, F.lit(""))).otherwise(joined).alias(c) if c == text else F.col("_own").getField(c).alias(c) for c in kept],
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op13_lines(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256) of all documents, as without_common_lines gives them."""
    got = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = f"trim(translate(line, '{_UPPER}', '{_LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP13_SQL = f"""WITH cut AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, r, place, line, {_KEY} AS k FROM (SELECT doc_id, r, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM cut) t),
common AS (SELECT k FROM (SELECT DISTINCT r, k FROM each WHERE k <> '') t GROUP BY k HAVING count(*) >= {DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT *, k IN (SELECT k FROM common) AS gone FROM each) t GROUP BY doc_id, r"""
