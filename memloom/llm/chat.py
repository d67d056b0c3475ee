"""Chat formatting from an event log.

A conversation's log holds events in sequence: ``message`` opens or replaces a
message, ``delta`` appends a streamed piece, ``edit`` replaces the text,
``regenerate`` starts it again, ``delete`` removes it.  Each message's events
are folded in order, messages are set in the order in which they began, and
the conversation is rendered with one template and a mask of the assistant's
texts.  Only DataFrame functions are used, so all of it stays in the JVM.

Control strings inside texts get a backslash after their first character (one
more where there are some already), so no text can open or close a turn and
the escape can be undone."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that steer a model under this template or other usual ones.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_HEADS = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_TAILS = "|".join(re.escape(t) for t in sorted({c[1:] for c in CONTROL}, key=lambda t: (-len(t), t)))
ESCAPE = rf"([{_HEADS}])(\\*)({_TAILS})"
UNESCAPE = rf"([{_HEADS}])(\\*)\\({_TAILS})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


#: Roles stand on one line: percent signs, line feeds and the first characters of control strings are written in hex.
_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def role_escaped(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def role_unescaped(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def folded(log: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, first, role, body) of each message that is left, from its events in order.

    Null texts are empty, a null kind is ``message``; an unknown kind changes
    nothing.  Events of equal ``seq`` apply by kind, then text.  A message's
    role is that of its last event which names one."""
    event = F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(role).alias("role"))
    start = F.struct(F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("role"))

    def step(now: Column, e: Column) -> Column:
        k, old, new = e["kind"], now["body"], e["text"]
        body = F.when(k.isin("message", "edit"), new).when(k == "delta", F.concat(F.coalesce(old, F.lit("")), new)).when(k == "regenerate", new).when(k == "delete", F.lit(None).cast("string")).otherwise(old)
        return F.struct(body.alias("body"), F.coalesce(e["role"], now["role"]).alias("role"))

    events = log.groupBy(F.col(conv).alias("conv"), F.col(message).alias("message")).agg(F.array_sort(F.collect_list(event)).alias("events"), F.min(seq).alias("first"))
    done = events.withColumn("done", F.aggregate("events", start, step))
    return done.where(F.col("done.body").isNotNull()).select("conv", "first", "message", F.coalesce("done.role", F.lit("")).alias("role"), F.col("done.body").alias("body"))


def format_chats(log: DataFrame, loss_roles: Sequence[str] = ("assistant",), conv: str = "conv_id", message: str = "message", **names: str) -> DataFrame:
    """A row for each conversation: ``conv``, ``formatted`` and ``turns``, an array of
    (role, start, end, loss): the place of each turn's text in ``formatted`` in
    code points, end exclusive, and whether it is under the loss mask.

    Messages are ordered by their first ``seq``, then message; a null seq
    comes first and a null conversation is one of its own.  A conversation
    whose messages are all deleted has no row; an empty log gives none.  Other
    columns are not read."""
    turns = folded(log, conv, message, **names)
    head = F.concat(F.lit(OPEN), role_escaped(F.col("role")), F.lit("\n"))
    turns = turns.withColumns({"head": head, "inner": escaped(F.col("body"))}).withColumn("piece", F.concat("head", "inner", F.lit(CLOSE + "\n")))
    order = Window.partitionBy("conv").orderBy("first", "message", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("n", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("upto", F.sum(F.length("piece")).over(order))
    start = F.col("upto") - F.length("piece") + F.length("head")
    turn = F.struct("n", "piece", F.struct(F.col("role"), start.alias("start"), (start + F.length("inner")).alias("end"), F.col("role").isin(*loss_roles).alias("loss")).alias("turn"))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return whole.select(F.col("conv").alias(conv), F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"), F.transform("all", lambda t: t["turn"]).alias("turns"))


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From ``formatted`` and the mask alone: ``conv``, ``read`` (array of role and text)
    and ``masked`` (the text under the mask, unescaped)."""
    pieces = F.filter(F.split("formatted", re.escape(CLOSE + "\n")), lambda p: F.startswith(p, F.lit(OPEN)))
    got = chats.withColumn("pieces", pieces)

    def parsed(piece: Column) -> Column:
        line = F.locate("\n", piece)
        return F.struct(role_unescaped(F.substring(piece, F.lit(len(OPEN) + 1), line - 1 - len(OPEN))).alias("role"), unescaped(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    # a turn's place in its piece: the piece begins where the turn before it ends, closing string and all
    begins = F.transform("turns", lambda t, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("turns", F.greatest(i, F.lit(1)))["end"] + len(CLOSE) + 1))
    under = F.zip_with(F.zip_with("pieces", "turns", lambda p, t: F.struct(p.alias("p"), t.alias("t"))), begins, lambda x, b: F.when(x["t"]["loss"], unescaped(F.substring(x["p"], (x["t"]["start"] - b + 1).cast("int"), (x["t"]["end"] - x["t"]["start"]).cast("int")))).otherwise(F.lit("")))
    return got.select(conv, "formatted", F.transform("pieces", parsed).alias("read"), F.array_join(under, "").alias("masked"))
