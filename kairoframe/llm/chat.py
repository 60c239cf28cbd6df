"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative template says how a turn is marked, which roles may follow which
and which roles' texts are trained on.  Texts are escaped so that no control
string occurs in them; reading the output back gives the turns exactly.

A conversation's rows are brought together by one shuffle on its id and sorted
by turn inside the partition; the machine then runs over the stream of rows
with one conversation's state in memory, and hashes are fed turn by turn, so a
conversation of any length takes no more memory than its longest turn.

Defined cases: a null text or role is empty; rows of equal turn are taken in
the order of role, then text, so repeated rows are turns of their own; a null
turn sorts first and a null id is an id; turns in an order that the machine
forbids are formatted all the same and marked invalid from that turn on; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """Marks of a turn and the machine's edges (from the last role, or start, to the roles allowed next)."""

    open: str = "### "
    named: str = ": "
    close: str = "</turn>\n"
    end: str = "</turn>"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    trained: tuple[str, ...] = ("assistant",)
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """A backslash doubles, and one breaks each control string after its first character."""
        text = text.replace("\\", "\\\\")
        for control in (self.open, self.end):
            text = text.replace(control, f"{control[0]}\\{control[1:]}")
        return text

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        out, at = [], 0
        while (found := text.find("\\", at)) >= 0:
            out.append(text[at:found])
            out.append(text[found + 1 : found + 2])
            at = found + 2
        return "".join(out) + text[at:]

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace(":", "\\:")

    def segments(self, role: str, text: str) -> list[dict]:
        """A turn as (text, loss) segments: the text under loss only if the role is trained on."""
        head = f"{self.open}{self.escape_role(role)}{self.named}"
        return [{"text": head, "loss": False}, {"text": self.escape(text), "loss": role in self.trained}, {"text": self.close, "loss": False}]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.open, at):
                raise ValueError(f"no turn begins at {at}")
            at += len(self.open)
            colon = at
            while not formatted.startswith(self.named, colon):
                colon += 2 if formatted[colon] == "\\" else 1
            stop = formatted.index(self.close, colon)
            turns.append((self.unescape(formatted[at:colon]), self.unescape(formatted[colon + len(self.named) : stop])))
            at = stop + len(self.close)
        return turns


def format_turns(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn, in order within its conversation.

    Columns: the conversation's id, position (from 0), role, valid (the machine
    accepts the turns so far), final (the conversation might end here) and
    segments, an array of (text, loss).
    """
    kind = dict(rows.dtypes)[conv]
    ordered = rows.select(conv, turn, F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = ordered.repartition(conv).sortWithinPartitions(conv, turn, "role", "text").select(conv, "role", "text")

    def run(batches):
        current, state, position, valid = object(), "start", 0, True
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (conv, "position", "role", "valid", "final", "segments")}
            for key, r, t in batch:
                if key != current:
                    current, state, position, valid = key, "start", 0, True
                valid = valid and r in template.follows.get(state, ())
                state = r
                for k, v in zip(out, (key, position, r, valid, valid and r in template.final, template.segments(r, t)), strict=True):
                    out[k].append(v)
                position += 1
            yield out

    return common.map_rows(ordered, run, f"{conv} {kind}, position bigint, role string, valid boolean, final boolean, segments array<struct<text string, loss boolean>>")


def read_back(turns: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from the segments alone; rows must come as format_turns gives them.

    Columns: id, n_turns, turns_sha256 (role, newline, text, newline for each
    turn), loss_chars, loss_sha256 (the unescaped text under loss),
    formatted_chars, valid, final.
    """
    kind = dict(turns.dtypes)[conv]
    names = (conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "final")

    def run(batches):
        state: list | None = None

        def add(out: dict[str, list]) -> None:
            if state is not None:
                key, n, turns_hash, chars, loss_hash, formatted, valid, final = state
                for k, v in zip(names, (key, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, valid, final), strict=True):
                    out[k].append(v)

        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for key, position, valid, final, segments in batch:
                if state is None or position == 0:
                    add(out)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, False]
                for r, t in template.parse("".join(s["text"] for s in segments)):
                    state[1] += 1
                    state[2].update(f"{r}\n{t}\n".encode())
                for s in segments:
                    state[5] += len(s["text"])
                    if s["loss"]:
                        said = template.unescape(s["text"])
                        state[3] += len(said)
                        state[4].update(said.encode())
                state[6], state[7] = valid, final
            yield out
        out = {k: [] for k in names}
        add(out)
        yield out

    schema = f"{conv} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, final boolean"
    return common.map_rows(turns.select(conv, "position", "valid", "final", "segments"), run, schema)
