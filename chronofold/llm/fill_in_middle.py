"""Fill-in-the-middle: texts cut in prefix, middle and suffix and put together in another order, around marks.

The cuts of a whole batch are found together: a lookup gives every byte its
class, a mask over pairs of adjacent classes marks where a unit begins, its
cumulative sums, reset at every text, number the units, and one search in the
sums finds the cuts of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are transformed, and so many of these have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of texts that are worked on together; a longer text is alone.
SLICE_BYTES = 4 << 20
_FORMS = pa.array(["plain", "psm", "spm"])
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
#: Classes of bytes: inside a character, begin of one that is a separator, begin of another one.
_INSIDE, _SPACE, _OTHER = 0, 1, 2


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0x80:0xC0] = _INSIDE
    table[bw.space_table()] = _SPACE
    return table


def _begins(unit: str) -> np.ndarray:
    """[class before, class]: whether a unit begins between two bytes."""
    out = np.zeros((3, 3), bool)
    if unit == "char":
        out[:, [_SPACE, _OTHER]] = True
    elif unit == "word":  # a word and the separators after it
        out[_SPACE, _OTHER] = True
    else:
        raise ValueError(f"units are char or word, not {unit}")
    return out


def unit_sums(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: begun units up to each byte, those before each text, and each text's own."""
    kinds = _classes()[data]
    mask = np.empty(len(data), bool)
    mask[1:] = _begins(unit)[kinds[:-1], kinds[1:]]
    mask[offsets[:-1][np.diff(offsets) > 0]] = True
    sums = np.cumsum(mask, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.r_[0, sums][offsets].astype(np.int64)
    return sums, upto[:-1], np.diff(upto)


def cut(sums: np.ndarray, before: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The bytes where each text has had so many units; a text's end where these are all."""
    return np.searchsorted(sums, (before + units + 1).astype(sums.dtype), "left")


def has_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
        at = at[np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
        row = np.searchsorted(offsets, at, "right") - 1
        out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def _gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of source, one after the other."""
    if len(start) <= 6:
        return np.concatenate([source[a : a + n] for a, n in zip(start, size, strict=True)])
    at = np.cumsum(size) - size
    return source[np.repeat((start - at).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)]


def transform(texts: pa.Array, draws: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "char"):
    """Record batches n, form, prefix_chars, middle_chars, output of texts; draws [4, texts] choose cuts, form and order."""
    data, offsets = bw.buffers(texts)
    first = 0
    while first < len(texts):
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        piece, off = data[offsets[first] : offsets[to]], offsets[first : to + 1] - offsets[first]
        h = draws[:, first:to]
        sums, before, n = unit_sums(piece, off, unit)
        a, b = np.sort(h[:2] % (n + 1), axis=0)
        plain = (n == 0) | has_marks(piece, off) | (h[2] % 100 >= rate)
        form = np.where(plain, 0, np.where(h[3] % 100 < suffix_first, 2, 1))
        lo, hi, end = cut(sums, before, a), cut(sums, before, b), off[1:]
        spm, marks = form == 2, len(piece) + np.arange(3) * 3
        # six pieces: mark, part, mark, part, mark, middle; of plain texts the first part alone
        start = np.stack([np.where(spm, marks[1], marks[0]), np.where(spm, hi, off[:-1]), np.where(spm, marks[0], marks[1]), np.where(spm, off[:-1], hi), np.full(len(n), marks[2]), lo], 1)
        size = np.stack([np.full(len(n), 3), np.where(spm, end - hi, lo - off[:-1]), np.full(len(n), 3), np.where(spm, lo - off[:-1], end - hi), np.full(len(n), 3), hi - lo], 1)
        size[plain] = 0
        size[plain, 1], start[plain, 1] = (end - off[:-1])[plain], off[:-1][plain]
        out = _gather(np.concatenate([piece, _MARKS]), start.ravel(), size.ravel())
        ends = np.r_[0, np.cumsum(size.sum(1))]
        output = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
        yield first, to, [pa.array(n, pa.int64()), _FORMS.take(pa.array(form)), pa.array(a, pa.int64(), mask=plain), pa.array(b - a, pa.int64(), mask=plain), output.cast(pa.string())]
        first = to


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = "1", unit: str = "char") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (units; null if plain), output: one row per input row.

    The draws are four 32-bit groups of sha256 of seed, a colon and the id
    (null: nothing), so they depend on the id alone; rows that share an id and a
    text come out alike.  psm is prefix, suffix, middle, spm suffix, prefix,
    middle, each behind its mark; empty texts, texts that hold a mark and those
    beyond the rate stay plain.  Units are code points, or words with what
    follows them.  Null texts are empty, invalid ids are nulls, other columns
    are ignored, an empty table gives an empty result.  A text and its output
    are held by one task, with some four times their size in sums.
    """
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digest.alias("_d"))
    rows = rows.select("doc_id", "text", *[F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)])

    def run(batches):
        for batch in batches:
            draws = np.stack([batch.column(2 + i).to_numpy() for i in range(4)])
            for first, to, columns in transform(batch.column(1), draws, rate, suffix_first, unit):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, to - first), *columns], names=["doc_id", *names])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made of: each mark occurs in it once, as texts with marks stay plain."""
    out = F.col(output)
    lead = F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head, middle = F.substring_index(out, MIDDLE, 1), F.substring_index(out, MIDDLE, -1)
    at = F.instr(head, lead)
    one, other = F.substr(head, F.lit(4), at - 4), F.substr(head, at + 3)
    return F.when(F.col(form) == "psm", F.concat(one, middle, other)).when(F.col(form) == "spm", F.concat(other, middle, one)).otherwise(out)
