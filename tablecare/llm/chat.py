"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.tables import Scratch
from tablecare.session import configure


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around the text of a turn, by role, and which role may follow which.

    ``turns`` has (before, after, in the loss) by role; every other role takes
    ``other``, whose ``{role}`` stands for its escaped name. ``next_roles`` is the state
    machine: the state is the last role, ``""`` at the start; ``last_roles`` may end a
    conversation. ``controls`` are the strings that mark turns: inside a text they get
    a backslash after their first character, and backslashes are doubled.
    """

    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<|system|>\n", "<|end|>\n", False),
            "user": ("[INST] ", " [/INST]\n", False),
            "assistant": ("<|answer|>", "</s>\n", True),
        }
    )
    other: tuple[str, str, bool] = ("<|role:{role}|>\n", "<|end|>\n", False)
    next_roles: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            text = text.replace(control, control[0] + "\\" + control[1:])
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The text segments of one turn, each with its loss flag."""
        before, after, loss = self.turns.get(role, self.other)
        if role not in self.turns:
            before = before.replace("{role}", self.escape(role))
        return [(before, False), (self.escape(text), loss), (after, False)]

    def follows(self, state: str, role: str) -> bool:
        return role in self.next_roles.get(state, ())

    def parse(self, formatted: str) -> tuple[str, str]:
        """The role and text that one formatted turn says."""
        for role, (before, after, _) in self.turns.items():
            if formatted.startswith(before) and formatted.endswith(after):
                return role, self.unescape(formatted[len(before) : -len(after)])
        head, tail = self.other[0].split("{role}")
        end = formatted.index(tail, len(head))
        text = formatted[end + len(tail) : -len(self.other[1])]
        return self.unescape(formatted[len(head) : end]), self.unescape(text)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chat(
    conversations: DataFrame, template: ChatTemplate | None = None
) -> DataFrame:
    """One row per turn: ``conv_id``, ``number`` (place in the conversation, from 0),
    ``accepted`` (the state machine allows the role here) and ``segments``, an array of
    (``text``, ``loss``). The texts of all segments of a conversation, in order, are the
    formatted conversation.

    Turns are ordered by turn, then role, then text; null turns come first. A null
    role or text counts as empty. Rows without a conv_id are one conversation. Turns
    that break the order are formatted all the same, and marked. Other columns are
    not read.

    A conversation passes through one task as a stream, which keeps the state and
    one batch only: its order, and the digests taken of it, are sequential by nature.
    """
    template = template or ChatTemplate()
    configure(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conversation, number, state = object(), 0, ""
        for batch in batches:
            out = []
            for conv_id, role, text in zip(
                batch["conv_id"], batch["role"], batch["text"], strict=True
            ):
                if conv_id != conversation:
                    conversation, number, state = conv_id, 0, ""
                segments = template.segments(role, text)
                out.append(
                    (
                        conv_id,
                        number,
                        template.follows(state, role),
                        [{"text": t, "loss": loss} for t, loss in segments],
                    )
                )
                number, state = number + 1, role
            yield pd.DataFrame(out, columns=["conv_id", "number", "accepted", "segments"])

    ordered = _by_conversation(rows, "turn", "role", "text").drop("turn")
    schema = (
        "conv_id string, number long, accepted boolean,"
        " segments array<struct<text: string, loss: boolean>>"
    )
    out = ordered.mapInPandas(work, schema)
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def chat_digests(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests of formatted conversations, taken from what parsing them gives back.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of each
    turn), ``loss_chars`` and ``loss_sha256`` (the unescaped text under the loss flag),
    ``formatted_chars`` and ``valid`` (every turn accepted and the last one may end it).
    """
    template = template or ChatTemplate()
    names = [
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
        "formatted_chars", "valid",
    ]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, conversation = False, None
        turns = loss = hashlib.sha256()
        count = loss_chars = chars = 0
        valid, role = True, ""

        def closed() -> tuple:
            ends = valid and role in template.last_roles
            return (conversation, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, ends)

        for batch in batches:
            out = []
            for conv_id, accepted, segments in zip(
                batch["conv_id"], batch["accepted"], batch["segments"], strict=True
            ):
                if not started or conv_id != conversation:
                    if started:
                        out.append(closed())
                    started, conversation = True, conv_id
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    count = loss_chars = chars = 0
                    valid, role = True, ""
                whole = "".join(s["text"] for s in segments)
                role, text = template.parse(whole)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for segment in segments:
                    if segment["loss"]:
                        said = template.unescape(segment["text"])
                        loss.update(said.encode("utf-8", "surrogatepass"))
                        loss_chars += len(said)
                count, chars, valid = count + 1, chars + len(whole), valid and accepted
            if out:
                yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame([closed()], columns=names)

    rows = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    schema = (
        "conv_id string, n_turns long, turns_sha256 string, loss_chars long,"
        " loss_sha256 string, formatted_chars long, valid boolean"
    )
    out = _by_conversation(rows, "number").drop("number").mapInPandas(work, schema)
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def written_chat(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """``format_chat`` written as a table and read again."""
    return Scratch(conversations.sparkSession, "chat").keep(
        format_chat(conversations, template)
    )
