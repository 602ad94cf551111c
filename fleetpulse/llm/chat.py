"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``open`` starts a message with its role, ``delta`` appends
streamed text, ``edit`` replaces part of the message so far, ``regenerate`` empties it for another
try. The log is partitioned by conversation and message and ordered by sequence number; a fold
over a message's events gives its final text: the deltas between two edits or regenerations are joined
at once, so a message costs its length for each edit, not for each delta. Messages are then rendered in order.

The template is ``<s>`` and, for each message, ``[INST]role[/INST]text</s>``. Inside roles and texts a
backslash is doubled and each control string gets a backslash after its first character, so
no control string appears there and the rendering can be undone.

Defined cases: null texts and roles are empty; rows with the same turn are ordered by role and
text; a null turn comes first; a null conv_id is a conversation of its own. Events of a message
without an ``open`` have an empty role. Repeated events are applied each. A conversation is one output row,
so its messages meet in one task as they must; each message is folded on its own before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (START, HEAD, BODY, END)
DELTA = 120


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """Drops each backslash that does not follow a dropped one."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def events_of(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """An event log that rows (conv_id, turn, role, text) are the outcome of.

    Texts arrive in deltas of ``delta`` characters. Assistant messages are first answered with a
    draft that is regenerated; other messages arrive with their first delta misspelt and edited later.
    """
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = rows.select("conv_id", "turn", "role", text.alias("text"), F.row_number().over(tie).alias("tie"))
    event = lambda kind, body=F.lit(""), at=F.lit(0), n=F.lit(0): F.struct(
        F.lit(kind).alias("kind"), body.alias("body"), at.alias("at"), n.alias("n"))
    # one pass over the text: a substring would count characters from its start for each delta
    parts = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0)), lambda piece: event("delta", piece))
    again = F.concat(F.array(event("delta", F.lit("draft ")), event("delta", F.col("role")), event("regenerate")), parts)
    mended = F.concat(F.array(event("delta", F.upper(F.substring("text", 1, delta)))), F.slice(parts, 2, F.size(parts)),
                      F.array(event("edit", F.substring("text", 1, delta), F.lit(0), F.length(F.upper(F.substring("text", 1, delta))))))
    log = F.concat(F.array(event("open", F.coalesce(F.col("role"), F.lit("")))), F.when(F.col("role") == "assistant", again).otherwise(mended))
    return (df.select("conv_id", "turn", "tie", F.posexplode(log).alias("seq", "e"))
            .select("conv_id", "turn", "tie", "seq", F.coalesce("e.kind", F.lit("")).alias("kind"), F.coalesce("e.body", F.lit("")).alias("body"), "e.at", "e.n"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, tie, role, text) of an event log."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "body", "at", "n")))
    cuts = F.filter(F.transform("parts", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
    opened = F.try_element_at(F.filter("parts", lambda e: e["kind"] == "open"), F.lit(-1))["body"]

    def step(cut: Column, k: Column) -> Column:
        """The event at a cut and the deltas between it and the next one, joined."""
        upto = F.coalesce(F.get("cuts", k + 1), F.size("parts"))
        run = F.filter(F.slice("parts", cut + 2, upto - cut - 1), lambda e: e["kind"] == "delta")
        return F.struct(F.get("parts", cut).alias("e"), F.array_join(F.transform(run, lambda e: e["body"]), "").alias("run"))

    def apply(text: Column, s: Column) -> Column:
        e = s["e"]
        edited = F.concat(F.substring(text, F.lit(1), e["at"]), e["body"], F.substring(text, e["at"] + e["n"] + 1, F.length(text)))
        return F.concat(F.when(e["kind"] == "edit", edited).when(e["kind"] == "regenerate", F.lit("")).otherwise(text), s["run"])

    return (events.groupBy("conv_id", "turn", "tie").agg(parts.alias("parts"))
            .withColumn("cuts", F.concat(F.array(F.lit(-1)), cuts)).withColumn("steps", F.transform("cuts", step))
            .select("conv_id", "turn", "tie", F.coalesce(opened, F.lit("")).alias("role"), F.aggregate("steps", F.lit(""), apply).alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are (first, n) in code points of the assistant texts."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "tie", "role", "text"))), lambda m: F.struct(
        F.concat(F.lit(HEAD), escape(m["role"]), F.lit(BODY)).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss")))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    spans = F.aggregate("turns", F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<first:int,n:int>>").alias("spans")), lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("first"), F.length(t["body"]).alias("n")))))
        .otherwise(acc["spans"]).alias("spans")))
    return (messages.groupBy("conv_id").agg(turns.alias("turns"))
            .select("conv_id", F.concat(F.lit(START), F.array_join(F.transform("turns", piece), "")).alias("formatted"), spans["spans"].alias("loss_spans")))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a rendering."""
    body = F.substring(formatted, F.lit(len(START) + 1), F.length(formatted))
    parts = F.split(body, F.lit(END.replace("/", r"\/")), -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(len(HEAD) + 1), F.length(p)), BODY, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit(BODY)) + len(BODY), F.length(p))).alias("text")))


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["first"] + 1, s["n"]))), "")
