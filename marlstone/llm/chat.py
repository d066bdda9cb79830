"""Chat formatting in Spark expressions only.

Turns are collected by conversation as structs and sorted; adjacent turns of one role are merged
by array functions and everything is concatenated. The template is

    <|turn|>role<|text|>text of a turn[<|next|>text of the next turn of that role ...]<|end|>

Texts and roles are escaped: & becomes &amp; and <| becomes &lt;|, so none of the four control
strings can stand in a text, and each original turn can be read back. The loss mask is a list of
spans (start, end, in code points) of the output, one for each assistant turn's escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.texts import let, running_sums

# The template's control strings.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Turns of a conversation that are collected together first.
BLOCK_TURNS = 512
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and loss_mask (spans) of each conversation; n_runs counts merged turns.

    Null roles and texts count as empty. Turns are ordered by turn (null first), then role and
    text, so ties and repeated rows have one result. Rows with a null conv_id are one
    conversation. Other columns are not read. Turns are first collected in blocks of numbers;
    only the conversation's own output, which is one row, holds all its text.
    """
    one = F.struct(
        F.col(turn).cast("long").alias("turn"), escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
    )
    rows = turns.select(F.col(conv_id).alias("conv_id"), one.alias("t"))
    rows = rows.withColumn("block", F.floor(F.col("t.turn") / BLOCK_TURNS))
    rows = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
    rows = rows.select("conv_id", F.flatten(F.col("blocks.turns")).alias("turns"))
    # the first turn of each run of one role, and where the run ends
    first = lambda ts: F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: (i == 1) | (F.element_at(ts, i)["role"] != F.element_at(ts, F.greatest(i - 1, F.lit(1)))["role"]))

    def pieces(ts: Column, starts: Column) -> Column:
        """(before, text, role) of each turn: a run's head or the mark between its turns stands before."""
        runs = F.transform(starts, lambda s, i: F.slice(ts, s, F.when(i + 1 < F.size(starts), F.element_at(starts, F.least(i + 2, F.size(starts)))).otherwise(F.size(ts) + 1) - s))
        head = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
        return F.flatten(
            F.transform(
                runs,
                lambda r: F.transform(
                    r,
                    lambda t, k: F.struct(
                        F.when(k == 0, head(t)).otherwise(F.lit(NEXT)).alias("before"), t["text"].alias("text"),
                        F.when(k + 1 == F.size(r), F.lit(END)).otherwise(F.lit("")).alias("after"), t["role"].alias("role"),
                    ),
                ),
            )
        )

    rows = rows.withColumn("starts", let(F.col("turns"), first))
    rows = rows.select("conv_id", F.size("starts").cast("long").alias("n_runs"), pieces(F.col("turns"), F.col("starts")).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    width = lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long")
    rows = rows.withColumn("at", running_sums(F.transform("pieces", width)))
    spans = F.transform(
        F.arrays_zip("pieces", "at"),
        lambda z: F.when(
            z["pieces"]["role"] == LOSS_ROLE,
            let(z["at"] + F.length(z["pieces"]["before"]), lambda s: F.struct(s.alias("start"), (s + F.length(z["pieces"]["text"])).alias("end"))),
        ),
    )
    return rows.select("conv_id", whole.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_mask"), "n_runs")


def read_turns(formatted: Column) -> Column:
    """The original turns, as an array of structs of role and text, from a formatted conversation."""
    runs = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda r: r != "")
    turns = lambda r: let(
        F.split(r, r"<\|text\|>", 2),
        lambda x: F.transform(
            F.split(F.element_at(x, 2), r"<\|next\|>", -1),
            lambda t: F.struct(unescape(F.substring(F.element_at(x, 1), len(TURN) + 1, 1 << 30)).alias("role"), unescape(t).alias("text")),
        ),
    )
    return F.flatten(F.transform(runs, turns))


def masked_text(formatted: Column, mask: Column, block: int = 64) -> Column:
    """All unescaped text under the mask, in order. Spans are cut from stretches of ``block`` spans, these from the whole."""

    def stretch(spans: Column) -> Column:
        low, high = F.element_at(spans, 1)["start"], F.element_at(spans, -1)["end"]
        piece = formatted.substr((low + 1).cast("int"), (high - low).cast("int"))
        return let(piece, lambda p: F.array_join(F.transform(spans, lambda s: unescape(p.substr((s["start"] - low + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""))

    many = F.filter(F.sequence(F.lit(0), F.floor(F.size(mask) / block).cast("int")), lambda i: i * block < F.size(mask))
    return F.array_join(F.transform(many, lambda i: stretch(F.slice(mask, i * block + 1, block))), "")
