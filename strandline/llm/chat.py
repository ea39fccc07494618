"""Chat formatting with Spark expressions only (operator 8).

A conversation's rows are collected as structs, sorted by turn, and cut into runs of one role; each run becomes one
block ``<s>[role]text[+]text</s>``, where ``[+]`` stands between turns that were merged. In roles and texts the signs
that template marks are made of, and the escape sign itself, are escaped, so no text can imitate a mark; unescaping
gives the text back. The output is also kept as segments (text, loss), which are the formatted string in pieces: loss
is true for the assistant's texts alone.

Cases: null texts and roles count as empty; a null conversation id is a conversation; rows with the same turn go by
role, then text; repeated rows are turns of their own; an empty table gives an empty result; other columns are not
read. A conversation is one row of the result, so it is the unit that has to fit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (sign, escaped): the escape sign first. After escaping every escape sign is followed by one of e, l, b, r.
SIGNS = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r")]
OPEN, ROLE_END, NEXT, CLOSE = "<s>[", "]", "[+]", "</s>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for sign, to in SIGNS:
        text = F.replace(text, F.lit(sign), F.lit(to))
    return text


def unescape(text: Column) -> Column:
    for sign, to in reversed(SIGNS):
        text = F.replace(text, F.lit(to), F.lit(sign))
    return text


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, segments, formatted) of rows (conversation, turn, role, text)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Where a run of one role begins; a run ends where the next begins.
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = turns.withColumn("begins", begins).withColumn("ends", F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("turns") + 1)))
    runs = runs.withColumn("runs", F.zip_with("begins", "ends", lambda a, b: F.slice("turns", a, b - a)))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(run: Column) -> Column:
        role = F.element_at(run, 1)["role"]
        learned = role == LEARNED_ROLE
        head = segment(F.concat(F.lit(OPEN), escape(role), F.lit(ROLE_END)), F.lit(False))
        texts = F.flatten(F.transform(run, lambda t, i: F.array(segment(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)), F.lit(False)), segment(escape(t["text"]), learned))))
        return F.concat(F.array(head), texts, F.array(segment(F.lit(CLOSE), F.lit(False))))

    out = runs.select(conv_col, F.filter(F.flatten(F.transform("runs", block)), lambda s: (s["text"] != "") | s["loss"]).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), ROLE_END, 1)).alias("role"), F.split(F.substr(b, F.instr(b, ROLE_END) + 1), r"\[\+\]").alias("texts")))
    return F.flatten(F.transform(parsed, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
