"""Chat formatting as a relational expression: no Python sees a turn.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` per block. Adjacent turns of
one role form one block, their texts parted by ``<|im_turn|>``, so that the turns can be
read back; a line break inside a role becomes ``<|im_line|>``. Control strings inside roles and texts are escaped reversibly: every ``<`` that
is followed by any number of ``&`` and a ``|`` gets one more ``&``; no ``<|`` is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN, LINE = "<|im_start|>", "<|im_end|>", "<|im_turn|>", "<|im_line|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(&*)\|", "<&$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<&(&*)\|", "<$1|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conv_id of ``turns`` (conv_id, turn, role, text): conv_id, n_blocks, formatted, loss_spans.

    ``loss_spans`` is an array of (start, length) in code points, one per assistant turn:
    the escaped text alone, without marks. Turns are ordered by turn (null first), then
    role and text, so that repeated and tied rows have one order; a null role or text is
    empty. Rows of a null conv_id are one conversation. Other columns are ignored. A
    conversation is one output row and has to fit a task.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    told = told.withColumn("n", F.size("turns"))
    # what stands before the text of turn i: the mark of a new block, or of a further turn of the block
    before = F.transform(
        "turns",
        lambda t, i: F.when(
            (i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(TURN)
        ).otherwise(F.concat(F.when(i > 0, F.lit(f"{END}\n")).otherwise(F.lit("")), F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))),
    )
    told = told.withColumn("before", before).withColumn("bodies", F.transform("turns", lambda t: escape(t["text"])))
    pieces = F.flatten(F.transform("bodies", lambda b, i: F.array(F.get("before", i), b)))
    lengths = F.transform("bodies", lambda b, i: F.struct(F.length(F.get("before", i)).alias("mark"), F.length(b).alias("body")))
    told = told.withColumn("lengths", lengths)
    told = told.withColumn("formatted", F.concat(F.array_join(pieces, ""), F.lit(f"{END}\n")))
    # starts are running sums: of the turns that are read, each adds its mark and body
    start = F.aggregate(
        "lengths",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + x["mark"] + x["body"]).alias("at"), F.array_append(a["starts"], a["at"] + x["mark"]).alias("starts")),
    )
    told = told.withColumn("starts", start["starts"])
    spans = F.transform(
        "turns",
        lambda t, i: F.when(
            t["role"] == "assistant", F.struct(F.get("starts", i).alias("start"), F.get("lengths", i)["body"].alias("length"))
        ),
    )
    blocks = F.size(F.filter("before", lambda b: b != TURN))
    return told.select("conv_id", blocks.alias("n_blocks"), "formatted", F.array_compact(spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as an array."""
    blocks = F.filter(F.split(formatted, rf"\Q{END}\E\n"), lambda b: b != "")
    opened = F.transform(blocks, lambda b: F.substring(b, len(START) + 1, 1 << 30))

    def turns(block: Column) -> Column:
        mark = F.substring_index(block, "\n", 1)
        role = unescape(F.replace(mark, F.lit(LINE), F.lit("\n")))
        texts = F.split(F.substring(block, F.length(mark) + 2, F.length(block)), rf"\Q{TURN}\E")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(opened, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    parts = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
    return F.array_join(parts, "")
