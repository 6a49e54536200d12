r"""Chat formatting by Spark expressions only.

A conversation's rows are collected as structs and sorted by turn; runs of one role merge into a block; blocks are joined
to the formatted text, with the spans of the assistant's texts as the loss mask. The template:

    <s>[ROLE]system[/ROLE]text</s><s>[INST] text [/INST]<s>text</s>

for other roles, the user and the assistant; [TURN] stands between the texts of one block. A backslash in a text is
doubled, and one is put after the first character of any control string, so that none is left and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(/?s>|/?INST\]|/?ROLE\]|TURN\])"
CHUNK = 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + CONTROL, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns ``id_col``, ``formatted``, and ``loss``: the spans (start, length, in code points) of the assistant's texts.

    Rows are sorted by turn, then role and text, so ties have one result; null turns come first. Null roles and texts are
    empty; a null id is a conversation of its own; repeated rows are turns of their own. Other columns are left behind.
    An empty table gives no rows. A conversation is one row of the result and has to fit into memory.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), escaped(F.coalesce(text_col, F.lit(""))).alias("text"))
    sorted_turns = turns.select(F.col(id_col).alias("id"), row.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    runs = sorted_turns.withColumn("starts", starts)
    merged = F.transform("starts", lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s))
    role = lambda b: F.get(b, F.lit(0))["role"]
    head = lambda b: F.when(role(b) == "user", "<s>[INST] ").when(role(b) == "assistant", "<s>").otherwise(F.concat(F.lit("<s>[ROLE]"), escaped(role(b)), F.lit("[/ROLE]")))
    blocks = runs.withColumn("blocks", F.transform(merged, lambda b: F.struct(role(b).alias("role"), F.transform(b, lambda t: t["text"]).alias("texts"), head(b).alias("head"), F.when(role(b) == "user", " [/INST]").otherwise("</s>").alias("tail"))))
    # each text with the markup before it, and the markup after the block's last
    pieces = blocks.withColumn("pieces", F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, k: F.struct((b["role"] == "assistant").alias("loss"), F.when(k == 0, b["head"]).otherwise("[TURN]").alias("before"), t.alias("text"), F.when(k == F.size(b["texts"]) - 1, b["tail"]).otherwise("").alias("after"))))))
    sized = pieces.withColumn("sizes", F.transform("pieces", lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long")))
    # offsets by sums over chunks: no quadratic work in long conversations
    chunks = F.sequence(F.lit(0), ((F.size("sizes") - 1) / CHUNK).cast("int"))
    summed = sized.withColumn("sums", F.transform(chunks, lambda i: total(F.slice("sizes", i * CHUNK + 1, CHUNK))))
    based = summed.withColumn("bases", F.transform("sums", lambda x, i: total(F.slice("sums", F.lit(1), i))))
    offset = lambda k: F.get("bases", F.floor(k / CHUNK).cast("int")) + total(F.slice("sizes", F.floor(k / CHUNK).cast("int") * CHUNK + 1, k % CHUNK))
    spans = F.transform("pieces", lambda p, k: F.struct(p["loss"].alias("loss"), (offset(k) + F.length(p["before"])).alias("start"), F.length(p["text"]).cast("long").alias("length")))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return based.select(F.col("id").alias(id_col), formatted.alias("formatted"), F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"])).alias("loss"))


def parse_chats(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Adds to format_chats()'s rows ``turns`` (role, text) and ``loss_text``, both read back from the formatted text."""
    end = lambda b, head, tail: F.substring(b, F.lit(head + 1), F.length(b) - head - tail)
    other = lambda b: F.instr(b, "[/ROLE]")
    role = lambda b: F.when(b.startswith("[INST] "), "user").when(b.startswith("[ROLE]"), unescaped(F.substring(b, F.lit(7), other(b) - 7))).otherwise("assistant")
    body = lambda b: F.when(b.startswith("[INST] "), end(b, 7, 8)).when(b.startswith("[ROLE]"), F.substring(b, other(b) + 7, F.length(b) - other(b) - 10)).otherwise(end(b, 0, 4))
    blocks = F.transform(F.filter(F.split("formatted", "<s>"), lambda b, k: k > 0), lambda b: F.struct(role(b).alias("role"), F.split(body(b), r"\[TURN\]").alias("texts")))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.withColumn("blocks", blocks).select(id_col, "formatted", "loss", turns.alias("turns"), loss.alias("loss_text"))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|TURN\])', '\1\\\2', 'g')) AS n
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN NOT opens THEN 6 WHEN role = 'user' THEN 18 WHEN role = 'assistant' THEN 7
      ELSE 20 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|TURN\])', '\1\\\2', 'g')) END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
