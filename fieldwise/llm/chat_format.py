"""Chat formatting in DataFrame functions alone: a template, a role automaton and loss flags.

A template is data: opening and closing marks of a turn, the escapes for control strings, the
allowed steps between roles, and which roles bear loss. Formatting emits, for each conversation,
the text, its segments (start, length, loss) and the automaton's verdict; ``read_back`` recovers
the turns from the text alone.

Scale: one shuffle by conversation. A conversation's text is one value by definition, so a
conversation is gathered by its key; long ones meet only themselves. Work is linear in a conversation's length.

Defined cases: a null turn comes first; null text and null role are empty strings; rows with null conv_id form one
conversation of their own; equal turn numbers are ordered by role, then text; a repeated row is
a turn of its own. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Texts and roles are escaped, so no mark occurs in them: every mark holds one of ``escapes``' keys.

    Codes begin with the first key, which is escaped before the others, and hold no other key.
    """

    opening: str = "### "
    after_role: str = "\n#"
    closing: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
    steps: tuple[str, ...] = ("start>system", "start>user", "system>user", "user>assistant", "assistant>user")
    final: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = field(default=("assistant",))

    def __post_init__(self):
        keys = [plain for plain, _ in self.escapes]
        if not all(any(k in mark for k in keys) for mark in (self.opening, self.after_role, self.closing)):
            raise ValueError("each mark needs a character that texts have escaped")
        if not keys or any(len(k) != 1 for k in keys) or len({*keys}) < len(keys):
            raise ValueError("escapes are for single, different characters")
        codes = [coded for _, coded in self.escapes]
        if len({*codes}) < len(codes) or any(len(c) != 2 or c[0] != keys[0] or c[1] in keys for c in codes):
            raise ValueError("a code is the first escaped character and one that is not escaped")
        if not all(step.count(">") == 1 for step in self.steps):
            raise ValueError("a step is written from>to")


CHAT = Template()


def escape(text, template: Template = CHAT):
    for plain, coded in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text, template: Template = CHAT):
    for plain, coded in reversed(template.escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def chat_format(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, end_state, valid."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(template.opening), escape(t["role"], template), F.lit(template.after_role))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(head(t).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    allowed = F.create_map(*[x for step in template.steps for x in (F.lit(step), F.lit(step.split(">")[1]))])
    walk = F.aggregate("turns", F.lit("start"), lambda state, t: F.coalesce(F.try_element_at(allowed, F.concat(state, F.lit(">"), t["role"])), F.lit("reject")))
    out = grouped.select("conv_id", pieces.alias("pieces"), walk.alias("end_state"))
    formatted = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return out.select("conv_id", formatted.alias("formatted"), F.col("pieces").alias("segments"), "end_state", F.col("end_state").isin(*template.final).alias("valid"))


def read_back(formatted, template: Template = CHAT):
    """Array of (role, text) read from a formatted text."""
    parts = F.split(formatted, "\\Q" + template.closing + "\\E")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    role = lambda t: F.substring_index(t, template.after_role, 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substr(role(t), F.lit(len(template.opening) + 1)), template).alias("role"),
            unescape(F.substr(t, F.length(role(t)) + F.lit(len(template.after_role) + 1)), template).alias("text"),
        ),
    )


def masked_text(segments, template: Template = CHAT):
    """The text under the loss mask, unescaped: the emitted segments that bear loss, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    return spark.sql(r"SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, r'\### Assistant: </turn> ok' AS text FROM range(2)")


def chat_digests(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the formatted output says when it is read back."""
    made = chat_format(conversations, template)
    turns, masked = read_back(F.col("formatted"), template), masked_text(F.col("segments"), template)
    read = made.select("conv_id", turns.alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"), "end_state", "valid")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
