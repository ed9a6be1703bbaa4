"""Chat formatting by columnar byte assembly.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`.  Inside texts and roles every
`<|` is written as `<\\|`, and a `<` before backslashes and `|` gets one
backslash more, so no text can hold a control string and escaping can be undone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Turns that are put together at once, at most, besides those of a conversation that goes on.
STEP = 4000


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    """As escape; a line break in a role is written as backslash n, a backslash as two."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, with each value's place and length."""
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """out[to[i] : to[i] + size[i]] = flat[at[i] : at[i] + size[i]], all at once."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = flat[np.repeat(at, size) + step]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array, trained: str = TRAINED_ROLE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, and byte starts and lengths of each turn's trained text in its conversation (length -1: not trained).

    conv numbers the conversation of each turn, ascending without gaps from 0.
    Headers, texts and footers are copied into one buffer of the final size.
    """
    names = roles.dictionary_encode()
    heads = pa.array([OPEN.decode() + r + "\n" for r in escape_role(names.dictionary.cast(pa.string())).to_pylist()], pa.large_string())
    which = names.indices.to_numpy(zero_copy_only=False)
    hf, ha, hn = _flat(heads)
    tf, ta, tn = _flat(escape(texts))
    foot = np.frombuffer(CLOSE, np.uint8)
    head, n = hn[which], len(which)
    turn = head + tn + len(foot)
    start = np.r_[0, np.cumsum(turn)]
    out = np.empty(int(start[-1]), np.uint8)
    _scatter(out, start[:-1], hf, ha[which], head)
    _scatter(out, start[:-1] + head, tf, ta, tn)
    _scatter(out, start[:-1] + head + tn, foot, np.zeros(n, np.int64), np.full(n, len(foot)))
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if n else np.zeros(0, np.int64)
    offsets = np.r_[start[first], start[-1]].astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    mine = np.array([r == trained for r in names.dictionary.to_pylist()], bool)[which] if n else np.zeros(0, bool)
    begin = start[:-1] + head - np.repeat(start[first], np.diff(np.r_[first, n]))
    return formatted, begin, np.where(mine, tn, -1)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = TRAINED_ROLE) -> DataFrame:
    """conv_id, formatted, loss (byte spans of the trained role's texts, escaped form): one row per conversation.

    Turns go by turn number, nulls last, then role and text; repeated rows stay.
    Null roles and texts are empty; turns with a null conv_id form one
    conversation.  Other columns are ignored; empty tables give empty results.
    A conversation is one value of the output and so is held by one task.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text").select("conv_id", "role", "text")

    def finish(table: pa.Table):
        ids = pc.fill_null(table.column("conv_id").combine_chunks(), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        valid = pc.is_valid(table.column("conv_id")).to_numpy(zero_copy_only=False)
        new = np.r_[True, (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])]
        conv = np.cumsum(new) - 1
        formatted, begin, size = assemble(conv, table.column("role").combine_chunks(), table.column("text").combine_chunks(), trained)
        mine = size >= 0
        spans = np.stack([begin[mine], size[mine]], 1).ravel()
        ends = np.r_[0, np.cumsum(np.bincount(conv[mine], minlength=int(conv[-1]) + 1) * 2)]
        loss = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spans, pa.int64()))
        key = table.column("conv_id").combine_chunks().take(pa.array(np.flatnonzero(new)))
        return pa.RecordBatch.from_arrays([key, formatted.cast(pa.string()), loss], names=["conv_id", "formatted", "loss"])

    def run(batches):
        rest = None
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = pa.Table.from_batches([b.slice(at, STEP)])
                rest = part if rest is None else pa.concat_tables([rest, part])
                ids = rest.column("conv_id").combine_chunks()
                same = pc.is_null(ids) if ids[-1].as_py() is None else pc.fill_null(pc.equal(ids, ids[-1]), False)
                stay = int(pc.sum(same).as_py())
                if stay < rest.num_rows:
                    yield finish(rest.slice(0, rest.num_rows - stay))
                    rest = rest.slice(rest.num_rows - stay)
        if rest is not None and rest.num_rows:
            yield finish(rest)

    return rows.mapInArrow(run, "conv_id long, formatted string, loss array<bigint>")


def parse_chat(formatted: bytes) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a turn doesn't start with its mark")
        line = formatted.index(b"\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((unescape_role(formatted[at + len(OPEN) : line].decode()), unescape(formatted[line + 1 : end].decode())))
        at = end + len(CLOSE)
    return turns


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: turns, their digest, and what the loss mask covers."""

    def run(batches):
        for b in batches:
            rows = []
            for text, loss in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse_chat(text)
                learned = "".join(unescape(text[s : s + n].decode()) for s, n in zip(loss[::2], loss[1::2], strict=True))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text.decode())))
            names, kinds = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["conv_id", *names])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
