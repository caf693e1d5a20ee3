"""Chat formatting with an offset-aligned loss mask.

A conversation becomes one text, a block per turn:

    <turn ROLE>
    TEXT</turn>

followed by a line end. Inside texts and roles a backslash is put before every backslash, before "<turn" and before
"</turn" (in roles also before ">" and line ends), so that control strings in them are told from the template's own and
reading back is exact. The whole conversation is encoded once, with character offsets; the sorted spans of the
assistant's texts are intersected with the sorted token spans by binary search. Tokens that meet a span carry loss, and
the text under the mask is what both have in common.

Rows of a conversation are ordered by turn, then role, then text; null roles and texts are empty, null turns come
first, and rows without conv_id form one conversation. Repeated rows are turns like any other. An empty table gives no
rows. A conversation's text is the unit of work by definition; conversations are spread by id, sorted, and read as a
stream, so a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_control = re.compile(r"\\|<(?=/?turn)")
_role_control = re.compile(r"[\\<>\n]")
_escaped = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.|<(?!/?turn))*)</turn>\n", re.DOTALL)

_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@dataclass
class Formatted:
    """A conversation's text, the spans of its turns' texts, and of those that carry loss."""

    text: str
    spans: list[tuple[int, int]]
    loss: list[tuple[int, int]]


def render(turns: list[tuple[str, str]]) -> Formatted:
    parts, spans, loss, at = [], [], [], 0
    for role, text in turns:
        head, body = "<turn " + _role_control.sub(lambda m: "\\" + m.group(), role) + ">\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        if role == ASSISTANT:
            loss.append(spans[-1])
        parts += [head, body, "</turn>\n"]
        at = spans[-1][1] + len("</turn>\n")
    return Formatted("".join(parts), spans, loss)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _turn.match(text, at)
        if not m:
            raise ValueError(f"not the template's at {at}: {text[at : at + 40]!r}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def masked(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Which tokens meet a span, and of each span the stretches that its tokens cover.

    Tokens are sorted and may share characters (the bytes of one character can lie in several tokens); the first and the
    last token of a span are found by binary search.
    """
    mask, covered = np.zeros(len(offsets), bool), []
    starts, ends = (offsets[:, 0], offsets[:, 1]) if len(offsets) else (np.array([], int), np.array([], int))
    for start, end in spans:
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end, "left"))
        stretches: list[tuple[int, int]] = []
        if start < end:
            mask[first:last] = True
            for s, e in zip(np.maximum(starts[first:last], start).tolist(), np.minimum(ends[first:last], end).tolist(), strict=True):
                if stretches and s <= stretches[-1][1]:
                    stretches[-1] = (stretches[-1][0], max(stretches[-1][1], e))
                elif s < e:
                    stretches.append((s, e))
        covered.append(stretches)
    return mask, covered


def encode(text: str, path: str):
    """Ids and character offsets, control strings of the tokenizer's own as ordinary text."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        own = _tokenizers[path] = Tokenizer.from_file(path)
        own.encode_special_tokens = True
    out = _tokenizers[path].encode(text, add_special_tokens=False)
    return out.ids, np.array(out.offsets, np.int64).reshape(-1, 2)


_TYPES = {
    "formatted": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "loss_mask": ("array<boolean>", pa.list_(pa.bool_())), "n_turns": ("long", pa.int64()), "turns_sha256": ("string", pa.string()),
    "loss_chars": ("long", pa.int64()), "loss_sha256": ("string", pa.string()), "formatted_chars": ("long", pa.int64()),
}


def format_conversations(conversations: DataFrame, path: str, outputs: tuple[str, ...] = ("formatted", "ids", "loss_mask")) -> DataFrame:
    """conv_id and the outputs asked for. All but the first three are read back from the formatted text and its mask:
    n_turns, turns_sha256 (of role, line end, text, line end per turn), loss_chars and loss_sha256 (of the unescaped text
    under the mask), formatted_chars."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("mr_turn"), F.coalesce("role", F.lit("")).alias("mr_role"), F.coalesce("text", F.lit("")).alias("mr_text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "mr_turn", "mr_role", "mr_text")
    schema = pa.schema([("conv_id", pa.int64()), *((o, _TYPES[o][1]) for o in outputs)])

    def finished(conv_id: int | None, turns: list[tuple[str, str]]) -> dict:
        made = render(turns)
        ids, offsets = encode(made.text, path)
        mask, covered = masked(made.loss, offsets)
        back = read_back(made.text)
        loss = "".join(unescape("".join(made.text[s:e] for s, e in stretches)) for stretches in covered)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        row = {
            "formatted": made.text, "ids": ids, "loss_mask": mask.tolist(), "n_turns": len(back), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in back)),
            "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(made.text),
        }
        return {"conv_id": conv_id} | {o: row[o] for o in outputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, turns, done, chars = None, [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "mr_role", "mr_text")), strict=True):
                if turns and conv_id != here:
                    done.append(finished(here, turns))
                    turns = []
                    if chars > 4 << 20:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done, chars = [], 0
                here = conv_id
                turns.append((role, text))
                chars += len(text)
        if turns:
            done.append(finished(here, turns))
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.mapInArrow(run, ", ".join(["conv_id long", *(f"{o} {_TYPES[o][0]}" for o in outputs)]))
