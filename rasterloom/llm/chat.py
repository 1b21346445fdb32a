"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, for every role, the strings that open and close a turn, whether its text
carries loss, and which roles may follow.  Inside texts a control string gets a backslash after
its first character and a backslash gets another, so that no text can end or begin a turn and
reading gives it back unchanged.  Roles that the template lacks are written with their name.

Conversations are dealt out by conv_id and stream through a task in the order of their turns;
a long one is written in several parts of about a megabyte, so none is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part of a long conversation.
PART = 1 << 20


@dataclass(frozen=True)
class Template:
    """roles: name -> (opening, closing, loss); follows: role -> roles that may come next ("" is the start); ends: roles to end with."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple = ("[ROLE]", "[/ROLE]", "[END]")
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({s.strip() for a, b, _ in self.roles.values() for s in (a, b)} | {s.strip() for s in self.other}, key=lambda s: (-len(s), s))

    def machine(self) -> "Machine":
        return Machine(self)


class Machine:
    """Formats turns and reads them back."""

    def __init__(self, template: Template):
        self.t = template
        controls = template.controls()
        if any(len(s) < 2 or "\\" in s for s in controls):
            raise ValueError("control strings have two characters or more and no backslash")
        self._escape = re.compile("|".join(["\\\\", *map(re.escape, controls)]))
        self._open = {a: role for role, (a, _, _) in template.roles.items()}
        self._opening = re.compile("|".join(map(re.escape, sorted([*self._open, template.other[0]], key=len, reverse=True))))

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def allowed(self, before: str, role: str) -> bool:
        return role in self.t.follows.get(before, ())

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments (text, loss) of a turn."""
        if role in self.t.roles:
            a, b, loss = self.t.roles[role]
            return [(a, False), (self.escape(text), loss), (b, False)]
        a, m, b = self.t.other
        return [(a + self.escape(role) + m, False), (self.escape(text), False), (b, False)]

    def read(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(role, start, end) of the turns' escaped texts in a formatted part."""
        at = 0
        while at < len(text):
            m = self._opening.match(text, at)
            if not m:
                raise ValueError(f"no turn opens at {at}")
            if m[0] in self._open:
                role, start, close = self._open[m[0]], m.end(), None
                close = self.t.roles[role][1]
            else:
                named = text.index(self.t.other[1], m.end())
                role, start, close = self.unescape(text[m.end() : named]), named + len(self.t.other[1]), self.t.other[2]
            # a text may end with the closing string's first characters: the last place at which the turn can close
            end = text.index(close, start)
            while text.startswith(close, end + 1) and close[0] == close[1:2]:
                end += 1
            yield role, start, end
            at = end + len(close)


_FORMATTED = "conv_id {}, part long, text string, loss array<int>, n_turns long, first_bad long, complete boolean"


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Rows (conv_id, part, text, loss, n_turns, first_bad, complete) from rows (conv_id, turn, role, text).

    loss has start and end (code points of text) of each segment that carries loss.  first_bad is the
    number, within the part, of the first turn that the machine does not allow, else null; complete
    says whether the part's last role may end a conversation.  Turns are ordered by turn, role and text, null first;
    null text and role are empty; rows without conv_id are one conversation.  Other columns are ignored.
    """
    machine, kind = (template or Template()).machine(), dict(turns.dtypes)["conv_id"]

    def run(batches):
        conv = object()
        part = n = 0
        texts: list[str] = []
        loss: list[int] = []
        size, before, bad, rows, id_type = 0, "", None, [], None

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            types = (id_type, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "part", "text", "loss", "n_turns", "first_bad", "complete"])

        for batch in batches:
            id_type = batch.column("conv_id").type
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if i != conv or size > PART:
                    if n:
                        rows.append((conv, part, "".join(texts), loss, n, bad, before in machine.t.ends))
                    part, before = (0, "") if i != conv else (part + 1, before)
                    conv, texts, loss, size, n, bad = i, [], [], 0, 0, None
                    if len(rows) >= 500 or sum(len(r[2]) for r in rows[-8:]) > PART:
                        yield batch_of(rows)
                        rows = []
                role, text = role or "", text or ""
                if bad is None and not machine.allowed(before, role):
                    bad = n
                before = role
                for s, on in machine.turn(role, text):
                    if on:
                        loss += [size, size + len(s)]
                    texts.append(s)
                    size += len(s)
                n += 1
        if n:
            rows.append((conv, part, "".join(texts), loss, n, bad, before in machine.t.ends))
        if rows:
            yield batch_of(rows)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _FORMATTED.format(kind))


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text itself says: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid) per conversation.

    turns_sha256 is over role, line feed, text, line feed of every turn, loss_sha256 over the unescaped text
    under the loss mask; valid says whether the machine allows the whole conversation.
    Rows, the parts of a conversation, may come in any order; other columns are ignored, and an empty table gives an empty one.
    """
    machine, kind = (template or Template()).machine(), dict(formatted.dtypes)["conv_id"]

    def run(batches):
        conv, state, rows, id_type = object(), None, [], None

        def close():
            n, turns, chars, loss, length, valid, complete = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, valid and complete))

        def batch_of(rows):
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            id_type = batch.column("conv_id").type
            for i, text, mask, bad, complete in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "first_bad", "complete")), strict=True):
                if state is None or i != conv:
                    if state is not None:
                        close()
                    conv, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, True]
                for role, a, b in machine.read(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{machine.unescape(text[a:b])}\n".encode())
                for a, b in zip(mask[::2], mask[1::2], strict=True):
                    plain = machine.unescape(text[a:b])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
                state[5] &= bad is None
                state[6] = complete
            if rows:
                yield batch_of(rows)
                rows.clear()
        if state is not None:
            close()
            yield batch_of(rows)

    dealt = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
