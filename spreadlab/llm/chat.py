"""Chat formatting by relational expressions, and the reading of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of this template, then control strings of common chat templates.
START, SAY, MORE, END = "<|start|>", "<|say|>", "<|more|>", "<|end|>"
CONTROLS = (START, SAY, MORE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")
ESC = "\x1b"
CODES = tuple(ESC + chr(ord("a") + k) for k in range(len(CONTROLS)))


def escape(text: Column) -> Column:
    """Text without control strings: each becomes the escape character and a letter.

    The escape character itself becomes escape and 0, so every escape in the result starts a
    two-character code and `unescape` is exact.
    """
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    for control, code in zip(CONTROLS, CODES):
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for control, code in zip(CONTROLS, CODES):
        text = F.replace(text, F.lit(code), F.lit(control))
    return F.replace(text, F.lit(ESC + "0"), F.lit(ESC))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask_runs.

    Turns are sorted by turn, then role and text; repeated rows stay; null roles and texts are
    empty; rows of a null conversation form one. Adjacent turns of a role share one block, in
    which `MORE` parts the turns. mask_runs are the lengths of the formatted text's stretches
    with the loss on or off; they add up to its length, and the loss covers assistant texts.
    A conversation is one value of the result, so its turns meet in one row; everything in
    the row is linear in its length.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.select(F.col(conv).alias("conv_id"), said.alias("_said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_said")).alias("_turns"))
    chats = chats.select("conv_id", F.transform("_turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("_turns"), F.size("_turns").alias("_n"))
    shifted = F.concat(F.array(F.lit(None).cast("struct<role:string,text:string>")), F.slice("_turns", F.lit(1), F.col("_n") - 1))
    opened = F.zip_with("_turns", shifted, lambda t, p: F.struct(t["role"].alias("role"), t["text"].alias("text"), (p.isNull() | (p["role"] != t["role"])).alias("first")))
    chats = chats.select("conv_id", "_n", opened.alias("_turns"))
    lead = lambda t, i: F.when(t["first"], F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(START), t["role"], F.lit(SAY))).otherwise(F.lit(MORE))
    parts = F.transform("_turns", lambda t, i: F.struct(lead(t, i).alias("lead"), t["text"].alias("text"), (t["role"] == "assistant").alias("learn")))
    chats = chats.select("conv_id", parts.alias("_parts"))
    run = lambda on, n: F.struct(on.alias("on"), n.alias("n"))
    runs = F.flatten(F.transform("_parts", lambda p: F.array(run(F.lit(False), F.length(p["lead"])), run(p["learn"], F.length(p["text"])))))
    return chats.select(
        "conv_id",
        F.concat(F.array_join(F.transform("_parts", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.concat(runs, F.array(run(F.lit(False), F.lit(len(END))))).alias("mask_runs"),
    )


def quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.split(formatted, quoted(END), -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    head = lambda b: F.split(b, quoted(SAY), 2)
    role = lambda h: unescape(F.replace(h[0], F.lit(START), F.lit("")))
    turns = lambda h: F.transform(F.split(h[1], quoted(MORE), -1), lambda t: F.struct(role(h).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(F.transform(blocks, head), turns))


def under_loss(formatted: Column, mask_runs: Column) -> Column:
    """The formatted text where mask_runs has the loss on.

    Runs are cut out at the prefix sums of their lengths. A substring is found by counting
    characters from the front, so the text is first cut into as many blocks of runs as a block
    has runs: a text of n characters and t runs takes some 2 n sqrt(t) steps, not n t.
    """
    width = F.greatest(F.ceil(F.sqrt(F.size(mask_runs).cast("double"))).cast("int"), F.lit(1))
    total = lambda runs: F.aggregate(runs, F.lit(0), lambda a, r: a + r["n"])
    heads = F.sequence(F.lit(1), F.greatest(F.size(mask_runs), F.lit(1)), width)
    blocks = F.transform(heads, lambda at: F.slice(mask_runs, at, width))
    sized = F.transform(blocks, lambda runs: F.struct(runs.alias("runs"), total(runs).alias("n")))

    def cut(block: Column) -> Column:
        place = lambda r, k: F.when(r["on"], F.substring(block["text"], total(F.slice(block["runs"], F.lit(1), k)) + 1, r["n"])).otherwise("")
        return F.array_join(F.transform(block["runs"], place), "")

    texts = F.transform(sized, lambda b, k: F.struct(b["runs"].alias("runs"), F.substring(formatted, total(F.slice(sized, F.lit(1), k)) + 1, b["n"]).alias("text")))
    return F.array_join(F.transform(texts, cut), "")


def read_chats(chats: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss columns are read from the text under mask_runs, whatever roles the turns have.
    """
    loss = unescape(under_loss(F.col("formatted"), F.col("mask_runs")))
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("_turns"), loss.alias("_loss"))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "formatted_chars", F.size("_turns").cast("long").alias("n_turns"), whole.alias("_whole"), "_loss")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("_whole").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
