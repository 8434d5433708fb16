"""Chat messages rendered to one prompt text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS_PER_CHUNK = 256


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each message; the defaults are the ChatML markers."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    reply_role: str = "assistant"

    def message(self, role: Column, text: Column) -> Column:
        return F.concat(
            F.lit(self.before_role),
            F.coalesce(role, F.lit("")),
            F.lit(self.after_role),
            F.coalesce(text, F.lit("")),
            F.lit(self.after_text),
        )

    def reply_head(self, add_generation_prompt: bool) -> Column:
        head = self.before_role + self.reply_role + self.after_role
        return F.lit(head if add_generation_prompt else "")


def render_messages(
    messages: Column, template: ChatTemplate = ChatTemplate(), add_generation_prompt: bool = True
) -> Column:
    """Render an ARRAY<STRUCT<role, text>> column, row by row."""
    rendered = F.transform(messages, lambda m: template.message(m["role"], m["text"]))
    return F.concat(F.array_join(rendered, ""), template.reply_head(add_generation_prompt))


def render_chat(
    df: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = True,
    key: str = "conv_id",
) -> DataFrame:
    """(key, prompt) from message rows (key, turn, role, text), in turn order.

    A long conversation is joined in two steps, 256 turns at a time and then the
    chunks, so that no task has to sort all of its messages.
    """
    message = template.message(F.col("role"), F.col("text"))

    def joined(order: str, text: str) -> Column:
        rows = F.sort_array(F.collect_list(F.struct(order, text)))
        return F.array_join(rows[text], "")

    chunks = (
        df.select(
            key,
            "turn",
            F.floor(F.col("turn") / TURNS_PER_CHUNK).alias("chunk"),
            message.alias("text"),
        )
        .groupBy(key, "chunk")
        .agg(joined("turn", "text").alias("text"))
    )
    return chunks.groupBy(key).agg(
        F.concat(joined("chunk", "text"), template.reply_head(add_generation_prompt)).alias(
            "prompt"
        )
    )
