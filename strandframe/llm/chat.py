"""Chat formatting with typed content parts, in DataFrame functions alone.

A message holds a role and an ordered list of parts (type, text, ref, tokens). The visitor flattens
the parts: text is escaped, an attachment becomes a placeholder ``<|image:3|>`` whose number is its
place among the attachments of the conversation, and its reference, kind, place and expanded token
count go to ``attachments``. A type is written percent-encoded there, so none can hold a control string.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles every ``<``, backslashes,
``|`` gets one backslash more, so no control string survives, and reading removes one again. Line
breaks, backslashes and bars in roles are escaped too. The loss mask marks the segments that hold
assistant texts; segments joined in order are the formatted conversation.

Rows of a conversation are ordered by (turn, role, text), nulls first; a null role or text is empty,
repeated rows are repeated turns, a null conversation id is a conversation of its own, an empty table
gives no rows, other columns are not read. A conversation is one training example and becomes one
string, so its own length is bounded by that of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
# Tokens that one attachment stands for, where the part names no number of its own.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
REPEATED = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    """Splits at escaped backslashes first, so that they guard what follows them."""
    plain = F.transform(
        F.split(role, r"\\\\", -1),
        lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")),
    )
    return F.array_join(plain, "\\")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def flatten_parts(parts: Column, before: Column) -> Column:
    """The visitor: escaped text and placeholders in order; ``before`` counts earlier attachments."""

    def visit(state: Column, part: Column) -> Column:
        is_text = F.coalesce(part["type"], F.lit("text")) == "text"
        number = state["n"] + before
        mark = F.concat(F.lit("<|"), F.url_encode(part["type"]), F.lit(":"), number.cast("string"), F.lit("|>"))
        return F.struct(
            F.concat(state["out"], F.array(F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark))).alias("out"),
            (state["n"] + F.when(is_text, 0).otherwise(1)).alias("n"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), start, visit, lambda s: F.array_join(s["out"], ""))


def attachments_of(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: F.coalesce(p["type"], F.lit("text")) != "text")


def expanded_tokens(part: Column) -> Column:
    known = F.lit(0)
    for kind, tokens in DEFAULT_TOKENS.items():
        known = F.when(part["type"] == kind, tokens).otherwise(known)
    return F.coalesce(part["tokens"], known.cast("bigint"))


def format_chat(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, parts) to (conv_id, formatted, segments, attachments, attachment_tokens)."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("m"))
    sizes = F.transform("m", lambda x: F.size(attachments_of(x["parts"])))
    # Attachments before each message, as running sums.
    before = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    # One text attachment count of nought everywhere is the usual case and skips the running sums.
    before = F.when(F.aggregate(sizes, F.lit(0), lambda a, n: a + n) == 0, F.array_repeat(F.lit(0), F.size("m") + 1)).otherwise(before)
    with_counts = grouped.withColumn("before", before)
    segments = F.flatten(F.transform("m", lambda x, i: F.array(
        F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(flatten_parts(x["parts"], F.get("before", i)).alias("text"), (x["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
    )))
    attachments = F.flatten(F.transform("m", lambda x, i: F.transform(attachments_of(x["parts"]), lambda p, k: F.struct(
        (F.get("before", i) + k).alias("number"), i.alias("message"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"),
    ))))
    built = with_counts.select("conv_id", segments.alias("segments"), attachments.alias("attachments"))
    return built.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    tail = len(END) + 1

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(REPEATED).alias("text"))
    formatted = format_chat(rows.union(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss")).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{REPEATED}'), (-1, 1, 'assistant', '{REPEATED}')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(regexp_replace(role, '[^\\|\n]', '', 'g')) + length(text)
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) - length(text)
      + {len(START) + len(END) + 2})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
