"""Language identification by multilingual mixture inference.

Every language has a smoothed model of byte 3-grams.  A text is a sequence of
words, each drawn from one of the languages that the text mixes;
expectation-maximisation estimates the mixture's proportions from the words'
n-gram likelihoods, and the set of languages is the one with the best
likelihood less a penalty for each language beyond the first.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

#: Hash buckets of the n-grams, as a power of two.
BITS = 16
#: Rounds of a text's expectation-maximisation, at most, and the change of a proportion below which it stops.
ROUNDS = 100
TOLERANCE = 1e-3
#: Weight of a word's log-likelihood: the n-grams of a word overlap and aren't independent.
TEMPER = 0.5
LETTER = re.compile(r"[^\W\d_]")
_SLICES = 16


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the fifth of the rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the 3-gram that is centred on every byte; bytes that aren't in words count as spaces."""
    low = bw.lower_table()
    low[bw.nonletter_table()] = 32
    b = low[data].astype(np.uint32)
    b = np.r_[np.uint32(32), b, np.uint32(32)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _pieces(column: pa.Array):
    """(data, offsets, first row, rows) of runs of rows of about a megabyte together.

    A space follows every row, so that no n-gram reaches into a neighbour; it
    belongs to no row: row i is data[offsets[i] : offsets[i + 1] - 1].
    """
    data, offsets = bw.buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + bw.WINDOW, "right")) - 1)
        part, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        spaced = np.full(len(part) + to - at, 32, np.uint8)
        spaced[np.arange(len(part)) + np.repeat(np.arange(to - at), np.diff(cuts))] = part
        yield spaced, cuts + np.arange(to - at + 1), at, to - at
        at = to


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, slice, counts: n-gram counts by language over all rows with a language, summed in fixed-size slices."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(1).to_pylist(), object)
            for data, offsets, at, n in _pieces(b.column(0)):
                grams, size = _grams(data), np.diff(offsets)
                inside = np.ones(len(data), bool)
                inside[offsets[1:] - 1] = False
                for name in set(lang[at : at + n]):
                    mine = np.repeat(lang[at : at + n] == name, size) & inside
                    total[name] = total.get(name, 0) + np.bincount(grams[mine], minlength=1 << BITS)
        for name, counts in total.items():
            for i, part in enumerate(np.split(counts, _SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([part.astype(np.int64).tobytes()], pa.binary())], names=["lang", "slice", "counts"])

    def add(key, table):
        counts = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "slice": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, slice int, counts binary").groupBy("lang", "slice").applyInArrow(add, "lang string, slice int, counts binary")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of every n-gram bucket in each: buckets x languages.

    What reaches the driver is a fixed number of counts for each language.
    """
    found: dict[str, dict[int, np.ndarray]] = {}
    for lang, i, counts in count_grams(docs, text_col, lang_col).collect():
        found.setdefault(lang, {})[i] = np.frombuffer(counts, np.int64)
    names = sorted(found)
    counts = np.stack([np.concatenate([found[x][i] for i in range(_SLICES)]) for x in names], 1).astype(float) if names else np.zeros((1 << BITS, 0))
    # interpolate every language with the n-grams of all, so that names and numbers favour none
    shared = (counts.sum(1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * len(counts)) if names else counts
    own = counts / np.maximum(counts.sum(0), 1)
    return names, np.log(0.95 * own + 0.05 * shared).astype(np.float32)


def mixtures(like: np.ndarray, offsets: np.ndarray, active: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text's mixture over its active languages.

    like: words x languages log-likelihoods; offsets: the texts' first words;
    active: texts x languages.  Texts must have words and active languages.
    Every text stops on its own, when no proportion moves by more than the
    tolerance, so its result doesn't depend on the others.
    """
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    top = np.where(active[text], like, -np.inf).max(1, keepdims=True)
    rel = np.where(active[text], np.exp(like - top), 0.0)
    share = active / active.sum(1, keepdims=True)
    open_, rest, size = np.arange(len(n)), rel, n
    for _ in range(rounds):
        part = rest * np.repeat(share[open_], size, 0)
        new = np.add.reduceat(part / part.sum(1, keepdims=True), np.cumsum(size) - size, axis=0) / size[:, None]
        moved = np.abs(new - share[open_]).max(1) > tolerance
        share[open_] = new
        if not moved.all():
            open_, rest, size = open_[moved], rest[np.repeat(moved, size)], size[moved]
            if not len(open_):
                break
    total = np.add.reduceat(np.log(np.maximum((rel * share[text]).sum(1), 1e-300)) + top[:, 0], offsets[:-1])
    return share, total


def _slack(like: np.ndarray, offsets: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What a mixture's log-likelihood can still gain at most: it is concave in the proportions, so the steepest slope bounds it."""
    n = np.diff(offsets)
    top = like.max(1, keepdims=True)
    rel = np.exp(like - top)
    part = rel / np.maximum((rel * np.repeat(share, n, 0)).sum(1, keepdims=True), 1e-300)
    return np.add.reduceat(part, offsets[:-1], axis=0).max(1) - n


def _climb(like: np.ndarray, offsets: np.ndarray, active: np.ndarray, share: np.ndarray, best: np.ndarray, most: np.ndarray, penalty: np.ndarray) -> None:
    """Improve each text's set in place: add, drop or swap one language, the best such step each time, until none helps.

    most bounds the likelihood of every set, so steps to sizes that can't win aren't tried.
    """
    n, langs = np.diff(offsets), like.shape[1]
    open_ = np.arange(len(n))
    while len(open_):
        size = active[open_].sum(1)
        base, found, found_share, found_active = best[open_], best[open_].copy(), share[open_].copy(), active[open_].copy()
        for out in range(-1, langs):  # -1: nothing leaves the set
            for into in range(-1, langs):
                if out == into:
                    continue
                goes = np.ones(len(open_), bool)
                if out >= 0:
                    goes &= active[open_, out] & ((size > 1) | (into >= 0))
                if into >= 0:
                    goes &= ~active[open_, into]
                new_size = size + (into >= 0) - (out >= 0)
                at = np.flatnonzero(goes & (most[open_] - (new_size - 1) * penalty[open_] > base + 1e-9 * (1 + np.abs(base))))
                if not len(at):
                    continue
                trial = active[open_[at]]
                if out >= 0:
                    trial[:, out] = False
                if into >= 0:
                    trial[:, into] = True
                mine = np.zeros(len(n), bool)
                mine[open_[at]] = True
                got, total = mixtures(like[np.repeat(mine, n)], np.r_[0, np.cumsum(n[open_[at]])], trial)
                total = total - (new_size[at] - 1) * penalty[open_[at]]
                better = total > found[at]
                at = at[better]
                found[at], found_share[at], found_active[at] = total[better], got[better], trial[better]
        moved = found > base + 1e-9 * (1 + np.abs(base))
        open_ = open_[moved]
        best[open_], share[open_], active[open_] = found[moved], found_share[moved], found_active[moved]


def select_languages(like: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen language set of each text, and the number of languages in it.

    Sets of any size count.  Two searches add, drop and swap languages by the
    penalised likelihood, one from the likeliest single language and one from
    all languages; the better result is taken, the first one at ties.  A text
    whose mixture of all languages, the likeliest of any set, doesn't pay for a
    second language keeps its single one.
    """
    n, langs = np.diff(offsets), like.shape[1]
    single = np.add.reduceat(like, offsets[:-1], axis=0)
    first = single.argmax(1)
    active = np.zeros((len(n), langs), bool)
    active[np.arange(len(n)), first] = True
    choice, best, penalty = active.astype(float), single.max(1), 0.5 * np.log(n) + np.log(langs)
    if langs == 1:
        return choice, active.sum(1)
    all_share, all_total = mixtures(like, offsets, np.ones((len(n), langs), bool))
    most = all_total + _slack(like, offsets, all_share)
    open_ = np.flatnonzero(most - penalty > best)
    if len(open_):
        mine = np.zeros(len(n), bool)
        mine[open_] = True
        part, cuts = like[np.repeat(mine, n)], np.r_[0, np.cumsum(n[open_])]
        up = [active[open_], choice[open_], best[open_]]
        down = [np.ones((len(open_), langs), bool), all_share[open_], all_total[open_] - (langs - 1) * penalty[open_]]
        for a, s, b in (up, down):
            _climb(part, cuts, a, s, b, most[open_], penalty[open_])
        wins = down[2] > up[2] + 1e-9 * (1 + np.abs(up[2]))
        for x, y in zip(up[:2], down[:2], strict=True):
            x[wins] = y[wins]
        active[open_], choice[open_] = up[0], up[1]
    return choice, active.sum(1)


def predict(docs: DataFrame, names: list[str], table: np.ndarray, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (share of the text in that language) and languages (the chosen set, largest share first).

    prefix comes before the three new names; it must keep them apart from docs' own.
    """
    spark = docs.sparkSession
    packed = io.BytesIO()
    np.save(packed, table)
    shared = spark.sparkContext.broadcast(packed.getvalue())
    schema = docs.schema
    at_text = schema.fieldNames().index(text_col)

    def run(batches):
        logp = np.load(io.BytesIO(shared.value))
        sep = bw.nonletter_table()
        for b in batches:
            texts = b.column(at_text)
            pred, score, sets = ["und"] * b.num_rows, np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for data, offsets, at, _ in _pieces(texts):
                if not len(data) or not names:
                    continue
                inside = np.r_[False, ~sep[data]]  # every row ends with a space, so words never touch
                begin = np.flatnonzero(inside[1:] & ~inside[:-1])
                stop = np.flatnonzero(inside[:-1] & ~inside[1:])
                if not len(begin):
                    continue
                # with its leading and trailing space a word of m bytes has m 3-grams, each centred on one of its bytes
                grams, ends = _grams(data), np.stack([begin, stop], 1).ravel()
                like = np.empty((len(begin), len(names)))
                for j in range(len(names)):
                    like[:, j] = TEMPER * np.add.reduceat(logp[grams, j].astype(np.float64), ends)[::2]
                words = np.searchsorted(begin, offsets)
                full = np.flatnonzero(np.diff(words))
                share, number = select_languages(like, np.r_[words[full], words[-1]])
                order = np.argsort(-share, 1, kind="stable")
                for i, row in enumerate(full + at):
                    if LETTER.search(texts[row].as_py()):
                        pred[row], score[row] = names[order[i, 0]], min(1.0, float(share[i, order[i, 0]]))
                        sets[row] = [names[j] for j in order[i, : number[i]]]
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}languages"])

    out = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return docs.mapInArrow(run, f"{out}, `{prefix}lang_pred` string, `{prefix}score` double, `{prefix}languages` array<string>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict the language of every row.

    Returns one row per input row: doc_id, held_out, lang_pred, score,
    languages.  Texts that are null, empty or without a letter are `und` with
    score 0.  Rows without a language are predicted, not learned from; if
    nothing can be learned all are `und`.  Ties go to the language first in
    alphabetical order.  Repeated rows and null ids are kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names, table = fit(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), names, table).drop("text")
