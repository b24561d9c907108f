"""Chat formatting (operator 8): relational, with Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role are merged into a block, and the blocks are
concatenated. The template is

    <s> [role] text [+] text [/] [role] text [/] ... </s>      (without the spaces)

`[+]` stands between the turns that a block merges, so the turns can be read back one by one. In roles and texts the
characters that begin or end a control string are written as entities (& < [ ] become &amp; &lt; &#91; &#93;), so no
control string can occur in them and reading back gives the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: In the order of escaping; unescaping goes backwards, so that & comes last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
LOSS_ROLE = "assistant"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    for raw, entity in ENTITIES:
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss_spans array<struct<start, len>>.

    turns: conv_id, turn, role, text; other columns are ignored. Null roles and texts count as empty. Turns sort by
    (turn, role, text), nulls first, so ties and repeated rows have one result; a null conv_id is a conversation of
    its own. loss_spans are the code points (from 0) of each assistant text inside `formatted`. An empty table gives
    an empty result. A conversation's turns meet in one row, as its output does.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )
    merged = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    )
    heads = F.transform("blocks", lambda b: F.concat(F.lit("["), escape(b["role"]), F.lit("]")))
    whole = F.concat(
        F.lit("<s>"),
        F.array_join(
            F.zip_with("blocks", heads, lambda b, h: F.concat(h, F.array_join(b["texts"], "[+]"), F.lit("[/]"))), ""
        ),
        F.lit("</s>"),
    )
    # Every text with what stands before it: a block's head, or [/] and a head, or [+].
    texts = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    (
                        F.when(j > 0, F.lit(3)).otherwise(
                            F.length(escape(b["role"])) + 2 + 3
                        )
                    ).alias("gap"),
                    F.length(t).alias("len"),
                    (b["role"] == LOSS_ROLE).alias("loss"),
                ),
            ),
        )
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
    spans = F.aggregate(
        texts,
        zero,
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.when(
                x["loss"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["len"].alias("len")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return merged.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted string."""
    inner = F.substring(formatted, F.lit(4), F.length(formatted) - 7)
    blocks = F.filter(F.split(inner, r"\[/\]", -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, F.lit("]")) + 1, F.length(b)), r"\[\+\]", -1),
                lambda t: F.struct(
                    unescape(F.substring(b, F.lit(2), F.instr(b, F.lit("]")) - 2)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    done = format_conversations(turns.unionByName(probe))
    back = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss",
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["len"]))), ""
        ),
    )
    listing = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    for raw, entity in ENTITIES:
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(length({_sql_escape('text')})
                + CASE WHEN before = role THEN 3 ELSE 5 + length({_sql_escape('role')}) END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
