r"""Chat formatting with a grammar round trip, by DataFrame expressions only.

A conversation is rendered as a level line and its turns, in order:

    conversation := ("#0" | "#1") "\n" turn*
    turn         := "<s>[INST]" role "\n" text "[/INST]"      a turn that is not trained on
                  | "<s>[OUT]" role "\n" text "</s>"          an assistant's turn

Level 0 holds the texts as they are. The rendered text is parsed again by a deterministic
grammar (`TURN`); if the recovered turns are not the source's, the conversation is rendered at
level 1, where content that conflicts is escaped: backslashes are doubled, and a control string
gets one before it; roles are URL-encoded. A control string ends a turn after an even number of
backslashes only, so the parser recovers every text at level 1. Escaping and parsing read a text
once from left to right, whatever its runs of backslashes.

Null roles and texts are empty; very long texts and turns are kept in whole. Turns come by turn,
then role and text (so ties and repeated rows have one order); rows with a null conv_id are one
conversation. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, long

# The control strings, as a pattern.
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]"
END = r"(?<!\\)(?:\\\\)*+"
TURN = rf"(?s)<s>\[INST\][^\n]*\n.*?{END}\[/INST\]|<s>\[OUT\][^\n]*\n.*?{END}</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\|{CONTROL})", "$1")


def _render(turn: Column, level: int) -> Column:
    role, text = (turn["role"], turn["text"]) if not level else (F.url_encode(turn["role"]), escape(turn["text"]))
    out = turn["role"] == TRAINED
    return F.concat(F.when(out, F.lit("<s>[OUT]")).otherwise(F.lit("<s>[INST]")), role, F.lit("\n"), text, F.when(out, F.lit("</s>")).otherwise(F.lit("[/INST]")))


def render(turns: Column, level: int) -> Column:
    return F.concat(F.lit(f"#{level}\n"), F.array_join(F.transform(turns, lambda t: _render(t, level)), ""))


def _pieces(formatted: Column) -> Column:
    """The turns of a rendered conversation as they stand in it: array of piece, out (whether it is
    trained on) and at (the characters before its text)."""
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.transform(found, lambda x: F.struct(x.alias("piece"), x.startswith("<s>[OUT]").alias("out"), F.call_function("instr", x, F.lit("\n")).alias("at")))


def _size(piece: Column) -> Column:
    """The length of a piece's text."""
    return F.length(piece["piece"]) - piece["at"] - F.when(piece["out"], F.lit(4)).otherwise(F.lit(7))


def _is_escaped(formatted: Column) -> Column:
    return F.substring(formatted, 2, 1) == "1"


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of role, text."""

    def turn(x: Column, plain: bool) -> Column:
        head = F.when(x["out"], F.lit(8)).otherwise(F.lit(9))
        role, text = F.substr(x["piece"], head + 1, x["at"] - head - 1), F.substr(x["piece"], x["at"] + 1, _size(x))
        return F.struct((role if plain else F.url_decode(role)).alias("role"), (text if plain else unescape(text)).alias("text"))

    pieces = _pieces(formatted)
    return F.when(_is_escaped(formatted), F.transform(pieces, lambda x: turn(x, False))).otherwise(F.transform(pieces, lambda x: turn(x, True)))


def render_until_identical(turns: Column) -> Column:
    """The rendering of the lowest level whose parse gives the turns again; fails if none does.

    A parse that gives the turns again has left out nothing: rendered, they are the text itself."""
    last = lambda f: F.when(parse(f) == turns, f).otherwise(F.raise_error(F.lit("a conversation can't be recovered")).cast("string"))
    return let(render(turns, 0), lambda f: F.when(parse(f) == turns, f).otherwise(let(render(turns, 1), last)))


def spans(formatted: Column) -> Column:
    """The loss mask: [start, end) in code points of each trained text, as it stands in formatted."""
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["at"]).alias("start"), (acc["at"] + x["at"] + _size(x)).alias("stop"))
        return F.struct((acc["at"] + F.length(x["piece"])).alias("at"), F.when(x["out"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_pieces(formatted), start, step, lambda acc: acc["out"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans, one row per conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    turns = F.transform(F.sort_array("ts"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts"))
    return grouped.select("conv_id", render_until_identical(turns).alias("formatted")).withColumn("loss_spans", spans(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the output holds, read from formatted and loss_spans alone."""
    masked = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))
    loss = F.array_join(F.when(_is_escaped(F.col("formatted")), F.transform(masked, unescape)).otherwise(masked), "")
    joined = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = let(parse(F.col("formatted")), lambda t: F.struct(long(F.size(t)).alias("n"), F.sha2(joined(t), 256).alias("sha")))
    held = let(loss, lambda x: F.struct(long(F.length(x)).alias("n"), F.sha2(x, 256).alias("sha")))
    return formatted.select("conv_id", read.alias("read"), held.alias("held"), long(F.length("formatted")).alias("formatted_chars")).select(
        "conv_id",
        F.col("read.n").alias("n_turns"),
        F.col("read.sha").alias("turns_sha256"),
        F.col("held.n").alias("loss_chars"),
        F.col("held.sha").alias("loss_sha256"),
        "formatted_chars",
    )
