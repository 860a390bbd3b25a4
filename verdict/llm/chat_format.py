r"""Operator 7, chat formatting as a prefix tree: turns that conversations share at their start are emitted once.

A conversation's path is the chain of digests of its turns; sorting by path puts conversations with the same
first turns side by side, so a range-partitioned sort lays the whole forest out depth first, and each task emits
its stretch with a stack of the open ancestors. A pack is one emitted sequence: its text, and for each turn (node)
its interval in the text, its position ids (they run on from the parent's, not from the neighbour's) and its
parent; a token may attend to its node and to the intervals of its ancestors, nothing else. A pack ends at
`pack_chars` characters or at the end of a task's range; ancestors that the next pack needs are emitted again
there, so a tree of any size is spread over packs and tasks. A conversation is never split.

Template: <|im_start|>role, line feed, text, <|im_end|>, line feed. Inside roles and texts a backslash doubles and
"<|" becomes "<\|"; in roles a line feed becomes "\n". Reading back reverses this. The loss mask covers the text of
assistant turns.

Null text and null role count as empty. Turns are in order of turn, then role, then text, nulls first; repeated
rows are turns each. Rows with null conv_id form one conversation. An empty table gives no pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "assistant"

PACKS = (
    "text string, nodes array<struct<start: int, end: int, position: int, parent: int, loss_start: int, loss_end: int>>, "
    "conversations array<struct<conv_id: long, leaf: int>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=regex.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text by the template, and where the loss mask begins and ends in it (both 0: nowhere)."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    masked = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
    return head + body + END, *masked


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation's formatted text."""
    turns = []
    for piece in formatted.split(END)[:-1] if formatted else []:
        role, _, text = piece.removeprefix(START).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


class _Packer:
    """Emits conversations that come in the order of their paths."""

    def __init__(self, pack_chars: int):
        self.pack_chars = pack_chars
        self.open()

    def open(self) -> None:
        self.text, self.length, self.nodes, self.conversations = [], 0, [], []
        self.stack: list[tuple[str, str, int]] = []  # the open ancestors: role, text, node

    def close(self) -> tuple | None:
        if not self.conversations:
            return None
        done = ("".join(self.text), self.nodes, self.conversations)
        self.open()
        return done

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> tuple | None:
        """Appends a conversation; gives the pack that was full before it, if one was."""
        shared = self.shared(turns)
        rendered = [render(*t) for t in turns[shared:]]
        done = None
        if self.conversations and self.length + sum(len(x[0]) for x in rendered) > self.pack_chars:
            done, rendered, shared = self.close(), [render(*t) for t in turns], 0
        del self.stack[shared:]
        for (role, text), (formatted, loss_start, loss_end) in zip(turns[shared:], rendered, strict=True):
            parent = self.stack[-1][2] if self.stack else -1
            position = self.nodes[parent]["position"] + self.nodes[parent]["end"] - self.nodes[parent]["start"] if self.stack else 0
            start, self.length = self.length, self.length + len(formatted)
            self.stack.append((role, text, len(self.nodes)))
            self.nodes.append({"start": start, "end": self.length, "position": position, "parent": parent, "loss_start": start + loss_start, "loss_end": start + loss_end})
            self.text.append(formatted)
        self.conversations.append({"conv_id": conv_id, "leaf": self.stack[-1][2] if self.stack else -1})
        return done

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for turn, (role, text, _) in zip(turns, self.stack, strict=False):
            if turn != (role, text):
                break
            n += 1
        return n


def format_conversations(turns: DataFrame, *, pack_chars: int = 65536) -> DataFrame:
    """Packs of the conversations in turns (conv_id, turn, role, text); other columns are ignored."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    digest = F.transform("turns", lambda t: F.unhex(F.substring(F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary")), 1, 16)))
    sortable = whole.withColumn("path", F.aggregate(digest, F.lit(b""), lambda a, x: F.concat(a, x)))
    # Conversations of the same path differ in conv_id, so the range partitioning can part them.
    dealt = sortable.repartitionByRange("path", F.col("conv_id").asc_nulls_first()).sortWithinPartitions("path", F.col("conv_id").asc_nulls_first())

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, columns = _Packer(pack_chars), ["text", "nodes", "conversations"]
        for frame in frames:
            done = []
            for conv_id, own in zip(frame["conv_id"], frame["turns"], strict=True):
                x = packer.add(None if pd.isna(conv_id) else int(conv_id), [(t["role"], t["text"]) for t in own])
                if x:
                    done.append(x)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if x := packer.close():
            yield pd.DataFrame([x], columns=columns)

    return dealt.select("conv_id", "turns").mapInPandas(pack, PACKS)


def ancestors(nodes, leaf: int) -> list[int]:
    """The nodes that a node may attend to, from the root down to itself."""
    chain = []
    while leaf >= 0:
        chain.append(leaf)
        leaf = nodes[leaf]["parent"]
    return chain[::-1]


def read_back(packs: DataFrame) -> DataFrame:
    """Each conversation's digests from the packs alone: its turns and the text under its loss mask."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, nodes, conversations in zip(frame["text"], frame["nodes"], frame["conversations"], strict=True):
                for c in conversations:
                    own = [nodes[i] for i in ancestors(nodes, c["leaf"])]
                    formatted = "".join(text[n["start"] : n["end"]] for n in own)
                    turns = parse(formatted)
                    loss = "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in own)
                    whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                    rows.append((c["conv_id"], len(turns), _sha(whole), len(loss), _sha(loss), len(formatted)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return packs.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


FORMAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
lengths AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + head + 1 + body + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id
"""
