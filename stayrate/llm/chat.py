"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its
text is trainable. Turns after the last reply are kept in one more example without a target, so the
longest example of a conversation holds all its turns.

Template: a turn that is not the assistant's is ``[INST] role``, a line break, the text and
`` [/INST]``; a reply is its text and ``</s>``. A control string inside a text or role gets a ``~``
after its opening bracket (one more if it has some), which reading back takes out again.

Defined cases: a null text or role is empty; an empty reply is a target of length zero. Turns are
ordered by (turn, role, text), nulls first, and repeated rows are turns of their own. Rows without a
conversation id are not one conversation: each distinct row is one by itself, told apart by ``conv_key``, which is null elsewhere. A conversation is held in one row,
like a document, and its examples repeat its earlier turns by design. An empty table gives no
examples. Of the input only the four named columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import let

REPLY = "assistant"
OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"

_CONTROL = r"([<\[])(~*)(/?)(s>|INST\])"
_ESCAPED = r"([<\[])~(~*)(/?)(s>|INST\])"
_PIECE = r"(?s)\[INST\] .*? \[/INST\]|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3$4")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def _piece(turn: Column) -> Column:
    """A turn in the template."""
    text = escape(turn["text"])
    asked = F.concat(F.lit(OPEN), _escape_role(turn["role"]), F.lit("\n"), text, F.lit(CLOSE))
    return F.when(turn["role"] == REPLY, F.concat(text, F.lit(END))).otherwise(asked)


def examples(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Examples (id, conv_key, example, text, loss_start, loss_length): the trainable characters are text[loss_start:][:loss_length].

    ``example`` counts from 0 within a conversation. The example without a target has loss_length null.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(
        F.col(conv_col).alias("__conv"),
        F.when(F.col(conv_col).isNull(), F.xxhash64(turn_col, role_col, text_col)).alias("conv_key"),
        F.struct(F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text")).alias("__turn"),
    )
    whole = turns.groupBy("__conv", "conv_key").agg(F.array_sort(F.collect_list("__turn")).alias("turns"))
    cut = whole.select(
        "__conv",
        "conv_key",
        F.transform("turns", lambda t: F.struct((t["role"] == REPLY).alias("reply"), _piece(t).alias("piece"))).alias("pieces"),
    )

    def spans(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda p, i: F.struct(i.alias("at"), p["reply"].alias("reply")))
        return F.filter(ends, lambda e: e["reply"] | (e["at"] == F.size(pieces) - 1))

    rows_out = cut.select("__conv", "conv_key", "pieces", F.posexplode(spans(F.col("pieces"))).alias("example", "last"))
    join = lambda p: F.array_join(F.transform(p, lambda x: x["piece"]), "")
    context = join(F.slice("pieces", 1, F.col("last.at")))
    target = F.get("pieces", F.col("last.at"))["piece"]
    reply = F.col("last.reply")
    return rows_out.select(
        F.col("__conv").alias(conv_col), "conv_key", "example", context.alias("__context"), target.alias("__target"), reply.alias("__reply")
    ).select(
        conv_col,
        "conv_key",
        "example",
        F.concat("__context", "__target").alias("text"),
        F.when(F.col("__reply"), F.length("__context")).cast("bigint").alias("loss_start"),
        F.when(F.col("__reply"), F.length("__target") - len(END)).cast("bigint").alias("loss_length"),
    )


def parsed(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""

    def read(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, F.length(piece) - len(OPEN) - len(CLOSE))
        asked = let(
            F.instr(body, "\n"),
            lambda at: F.struct(
                _unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
                unescape(F.substring(body, at + 1, F.length(body))).alias("text"),
            ),
        )
        reply = F.struct(F.lit(REPLY).alias("role"), unescape(F.substring(piece, F.lit(1), F.length(piece) - len(END))).alias("text"))
        return F.when(F.startswith(piece, F.lit(OPEN)), asked).otherwise(reply)

    return F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), read)


def trainable(text: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, as the reply was."""
    return unescape(F.substring(text, (start + 1).cast("int"), length.cast("int")))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from its examples alone: turns, digest of the turns, digest of the trained text, characters written."""
    parts = formatted.select(
        F.col(conv_col),
        "conv_key",
        "example",
        F.length("text").cast("bigint").alias("chars"),
        F.col("text"),
        F.when(F.col("loss_length").isNotNull(), trainable(F.col("text"), F.col("loss_start"), F.col("loss_length"))).alias("reply"),
    )
    whole = parts.groupBy(conv_col, "conv_key").agg(
        F.max(F.struct("example", "text"))["text"].alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
    )
    learnt = whole.select(
        conv_col,
        "formatted_chars",
        parsed(F.col("longest")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("learnt"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return learnt.select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
