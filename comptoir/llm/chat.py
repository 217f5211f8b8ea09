"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and its own text as the only
trainable part. Turns after the last assistant turn make one more example without a trainable part, so
that a conversation can be read back from its examples. Roles and texts are escaped: no control string
can stand in them, and unescaping gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm.shared import table

#: A turn is OPEN role MIDDLE text CLOSE; escaped strings hold no "<", and no line end in a role.
OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Rows (conv_id, example, formatted, loss_start, loss_end): code points, the end exclusive; null without a trainable part.

    Turns go by turn number (null first), ties by role and text; repeated rows stay. Null roles and texts
    are empty. Rows with a null conv_id are one conversation. Other columns are dropped.
    """
    one = F.struct(F.col(turn).alias("turn"), escape_role(F.col(role)).alias("role"), escape(F.col(text)).alias("text"), F.coalesce(F.col(role) == trained, F.lit(False)).alias("trained"))
    convs = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    marked = F.transform("turns", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE), x["text"], F.lit(CLOSE)))
    places = F.sequence(F.lit(1), F.size("turns"))
    ends = F.filter(places, lambda i: F.element_at("turns", i)["trained"] | (i == F.size("turns")))
    rows = convs.select("conv_id", "turns", marked.alias("marked"), ends.alias("ends")).select("*", F.posexplode("ends").alias("example", "end"))
    formatted = F.array_join(F.slice("marked", 1, F.col("end")), "")
    rows = rows.select("conv_id", "example", formatted.alias("formatted"), F.element_at("turns", F.col("end")).alias("last"))
    stop = F.when(F.col("last")["trained"], F.length("formatted") - len(CLOSE))
    return rows.select("conv_id", "example", "formatted", (stop - F.length(F.col("last")["text"])).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"))


def read_back(made: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, losses, formatted_chars) of examples: all turns (role, text), and the trainable texts in order."""
    loss = F.when(F.col("loss_start").isNotNull(), F.expr("substring(formatted, cast(loss_start + 1 AS int), cast(loss_end - loss_start AS int))"))
    rows = made.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), unescape(loss).alias("loss"), "formatted")
    convs = rows.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("whole"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    parts = F.split("whole", F.lit(r"<\|turn\|>"), -1)
    split = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(unescape_role(F.substring_index(x, MIDDLE, 1)).alias("role"), unescape(_text(x)).alias("text")))
    return convs.select("conv_id", split.alias("turns"), F.transform(F.filter("parts", lambda x: x["loss"].isNotNull()), lambda x: x["loss"]).alias("losses"), "formatted_chars")


def _text(part: Column) -> Column:
    """What stands between a turn's MIDDLE and its CLOSE."""
    begin = F.length(F.substring_index(part, MIDDLE, 1)) + len(MIDDLE)
    return F.substr(part, begin + 1, F.length(part) - begin - len(CLOSE))


#: A conversation that says the control strings of another template.
PLANTED = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"


def op7_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PLANTED))
    back = read_back(examples(turns))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    17 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars
  FROM said
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS prefix, max(place) OVER (PARTITION BY conv_id) AS places FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR place = places) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
