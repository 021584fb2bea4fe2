"""Chat formatting: every assistant turn becomes an example of its own.

The turns before it are its context, rendered with role tags; only the reply and its end tag are
trainable, given as a span of characters in the rendered text.

Cost: one shuffle by conversation, in which repeated turns are told by a hash set; a conversation is put together in one task. The
output repeats each context, which is what the format asks for: a conversation's rows grow with the square of its replies.

Defined cases: rows without a conversation id belong to none and are left out; rows that are equal in
conversation, turn, role and text count once; turns with equal numbers are ordered by role and text,
null numbers come first; a null role reads as "unknown" and a null text as ""; an assistant turn with
a blank text trains nothing: it makes no example, but stays in the context of later ones;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import table

OPEN, MID, END = "<|", "|>\n", "<|end|>\n"


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_context, text, train_from, train_to): text[train_from:train_to] is the reply with its end tag."""
    rows = (
        turns.filter(F.col("conv_id").isNotNull())
        .select("conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_set("t")).alias("ts"))
        .withColumn("said", F.transform("ts", lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MID), t.text, F.lit(END))))
        .select("conv_id", "ts", "said", F.explode(F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (F.get("ts", i - 1).role == "assistant") & (F.btrim(F.get("ts", i - 1).text, F.lit(" \t\n\r")) != ""))).alias("i"))
    )
    tag = len(OPEN + "assistant" + MID)
    return (
        rows.withColumn("context", F.array_join(F.slice("said", F.lit(1), F.col("i") - 1), ""))
        .withColumn("t", F.get("ts", F.col("i") - 1))
        .select(
            "conv_id", F.col("t.turn").alias("turn"), (F.col("i") - 1).cast("long").alias("n_context"),
            F.concat("context", F.get("said", F.col("i") - 1)).alias("text"),
            (F.length("context") + tag).cast("long").alias("train_from"),
            (F.length("context") + tag + F.length("t.text") + len(END)).cast("long").alias("train_to"),
        )
    )


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM turns),
ctx AS (SELECT *, coalesce(string_agg(said, '') OVER w, '') AS context, count(*) OVER w AS n_context FROM said
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, n_context::BIGINT AS n_context, context || said AS text,
       (length(context) + 14)::BIGINT AS train_from, (length(context) + 14 + length(text) + 8)::BIGINT AS train_to
FROM ctx WHERE role = 'assistant' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"""
