"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one marked-up string; every assistant turn of it becomes an example whose context is all that
stands before the reply and whose loss mask covers that reply alone. Examples hold offsets into the conversation's
string, so a conversation of n turns takes room for n turns and not for n * n / 2; `materialise` cuts them out.
Offsets are running sums over a conversation's turns, in the same shuffle that brings the turns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: Code points that a long text is read in at a time.
BLOCK = 4096
#: Strings that mean something to a chat template or a tokenizer; inside texts a backslash breaks them up.
CONTROL = ("<|", "</s>", "<s>", "<unk>", "<pad>", "[INST]", "[/INST]")


def escape(c: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, text, spans): one row per conversation of rows (conv_id, turn, role, text).

    text is the marked-up conversation; spans has (turn_no, start, end) of each assistant turn, in code points of text from
    0: the loss mask. Null roles and texts are empty. Turns go by (turn, role, text), a null turn
    first; repeated rows are turns of their own. A null conv_id is a conversation like any other. An empty table gives
    no rows; other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select("conv_id", "role", F.row_number().over(so_far).alias("turn_no"), F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"), "turn", "text")
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("upto", F.sum(size).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("upto") - len(END)
    each = F.struct(
        (F.col("turn_no") - 1).alias("turn_no"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        (end - F.length("body")).alias("start"),
        end.alias("end"),
        (F.col("role") == "assistant").alias("reply"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["reply"]), lambda t: F.struct(t["turn_no"], t["start"], t["end"]))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), spans.alias("spans"))


def expand(conversations: DataFrame, with_text: bool = False) -> DataFrame:
    """(conv_id, example, n_context_turns, context_chars, loss_start, loss_end): a row per assistant turn.

    The example's text is text[0 : loss_end + len(END)] of its conversation, and only [loss_start, loss_end) is trained on.
    A conversation without replies has no row, unless with_text adds a row for each conversation with a null example and
    the conversation's `text`, which is null in all other rows: so it goes along once, whatever the number of examples.
    Nulls, empty texts and repeated rows were settled by format_conversations; an empty table gives no rows.
    """
    one = conversations
    if with_text:
        none = F.lit(None).cast(conversations.schema["spans"].dataType.elementType)
        first = F.struct(none.alias("s"), F.col("text").alias("text"))
        rest = F.transform("spans", lambda s: F.struct(s.alias("s"), F.lit(None).cast("string").alias("text")))
        one = one.select("conv_id", F.posexplode(F.concat(F.array(first), rest)).alias("nth", "e")).select("conv_id", F.when(F.col("nth") > 0, F.col("nth") - 1).alias("example"), "e.s", "e.text")
    else:
        one = one.select("conv_id", F.posexplode("spans").alias("example", "s"))
    return one.select(
        "conv_id",
        "example",
        F.col("s.turn_no").alias("n_context_turns"),
        F.col("s.start").alias("context_chars"),
        F.col("s.start").alias("loss_start"),
        F.col("s.end").alias("loss_end"),
        *(["text"] if with_text else []),
    )


def under_mask(text: Column, spans: Column) -> Column:
    """What stands in text at each of spans (start, end), still escaped; the time is that of the text and of what is cut out.

    A text is read in blocks of BLOCK code points, so that a span is found without going through all that stands before it.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))

    def piece(held: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["end"] - 1) / BLOCK).cast("int")
        near = F.array_join(F.slice(held, first + 1, last - first + 1), "")
        cut = F.substring(near, (s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.when(s["end"] > s["start"], cut).otherwise("")

    # As a lambda's variable the blocks are made once and not for each span.
    return F.element_at(F.transform(F.array(blocks), lambda held: F.transform(spans, lambda s: piece(held, s))), 1)


def materialise(conversations: DataFrame) -> DataFrame:
    """Examples with their whole text: (conv_id, example, context, reply, text, loss_start, loss_end).

    Rows are as in expand, and so is what nulls, empty texts, repeated rows and empty tables give; reply is what stands
    under the mask. This takes the room of all prefixes.
    """
    one = conversations.select("conv_id", "text", F.posexplode("spans").alias("example", "s"))
    return one.select(
        "conv_id",
        "example",
        F.expr("substring(text, 1, s.start)").alias("context"),
        F.expr("substring(text, s.start + 1, s.end - s.start)").alias("reply"),
        F.expr(f"substring(text, 1, s.end + {len(END)})").alias("text"),
        F.col("s.start").alias("loss_start"),
        F.col("s.end").alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The (role, text) turns that a marked-up conversation says."""
    parts = F.filter(F.split(text, r"<\|role\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )
