"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every reply (a turn of the ``reply`` role) becomes an example of its own: all turns before it are its context, and its text
alone is under the loss mask. What a conversation says after its last reply teaches nothing, but stays in the output as an example
without a target, so the output always holds the whole conversation. An example is put together when its row is
produced, so memory holds one conversation and one example at a time.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside roles and texts (those of this template
and of other common ones) get one escape character behind their first character, and what looks like an escaped one
gets one more, so :func:`unescape` restores every text.

Defined results: a null role or text is an empty one. Turns are in order of ``turn`` (null first), ties in order of role and text;
repeated rows are repeated turns. Rows with a null id are one conversation. A reply with an empty text is an example with an empty mask.
Extra columns are ignored, clashing names included. An empty table gives an empty table. A conversation is one value while it is
formatted, as it is for the hash of all its turns; Spark's limit of 2 GB a value holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings behind their first character, < or [. Fixed values of public chat templates.
_REST = r"(?:/?s>|/?INST\]|\|(?:im_start|im_sep|im_end|endoftext)\|>)"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*+{_REST})", "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(~*+{_REST})", "$1$2")


def examples(
    conversations: DataFrame, reply: str = REPLY, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, whole): one row per reply, and one for what follows the last reply.

    The mask is ``text[loss_start:loss_end]`` in code points, empty where there is no target. ``whole`` marks the row that holds
    all turns of its conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    turns = conversations.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END))
    written = turns.select("conv_id", F.transform("turns", piece).alias("pieces"), F.transform("turns", lambda t: t["role"] == reply).alias("replies"))
    places = F.sequence(F.lit(1), F.size("replies"))
    ends = F.filter(places, lambda i: F.element_at("replies", i) | (i == F.size("replies")))
    each = written.select("conv_id", "pieces", "replies", F.posexplode(ends).alias("example", "upto"))
    frame = len(START) + len(reply) + len(SEP) + len(END)
    masked = F.when(F.element_at("replies", F.col("upto")), F.char_length(F.element_at("pieces", F.col("upto"))) - frame).otherwise(0)
    cut = each.select(
        "conv_id", "example", F.array_join(F.slice("pieces", F.lit(1), F.col("upto")), "").alias("text"), masked.alias("masked"),
        F.element_at("replies", F.col("upto")).alias("target"), (F.col("upto") == F.size("pieces")).alias("whole"),
    )
    stop = F.char_length("text") - F.when(F.col("target"), len(END)).otherwise(0)
    return cut.select("conv_id", "example", "text", (stop - F.col("masked")).alias("loss_start"), stop.alias("loss_end"), "whole")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text, as they were before formatting."""
    pieces = F.split(text, r"<\|im_end\|>", -1)
    parts = lambda p: F.split(p, r"<\|im_sep\|>", -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.substr(F.get(parts(p), 0), F.lit(len(START) + 1))).alias("role"), unescape(F.get(parts(p), 1)).alias("text")),
    )


def target(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """What is under the mask, as it was before formatting."""
    return unescape(F.substr(text, loss_start + 1, loss_end - loss_start))


def digest(found: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    turns = F.when(F.col("whole"), read_turns(F.col("text")))
    read = found.select(
        "conv_id", "example", turns.alias("turns"), target(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.char_length("text").alias("chars"),
    ).select(
        "conv_id", "example", "loss", "chars", F.when(F.col("turns").isNotNull(), F.size("turns")).alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
    )
    back = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sum(F.char_length("loss")).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    masked = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", F.sha2(masked.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
