"""Decontamination against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from chronofold.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, row string, spans int, item string", "item_id string, text string, item int"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item or "")
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), sorted(hit), sorted(found)))
    return out


def flat(found):
    return [(r.doc_id, r.n_words, r.n_hit, [i for s in r.spans for i in range(s["first"], s["last"] + 1)], r.item_ids) for r in found.collect()]


def both(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return sorted(map(str, flat(dc.find_contamination(d, b, **more)))), sorted(map(str, brute(docs, items)))


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    words = ["a", "B", "été", "Über", "x1", "2", "語"]
    item = lambda n: " ".join(rng.choice(words, n))
    items = [("10", item(14)), ("9", item(30)), ("9", item(11)), (None, item(12)), ("short", "a b, A"), ("one", "Lonely"), ("empty", ""), ("null", None), ("signs", "-- !"), ("same", item(10)), ("same too", None)]
    items[-1] = ("same too", items[-2][1].upper().replace("ÉTÉ", "été").replace("ÜBER", "Über"))
    docs = [(i, item(int(n))) for i, n in enumerate([0, 3, 9, 10, 11, 600, 5000])]
    docs += [(7, items[0][1]), (7, items[0][1]), (None, "x " + items[9][1] + "\nLONELY"), (8, None), (9, "lonely"), (10, "Lonelyé"), (11, items[1][1].replace(" ", "--")), (12, "pad " * 40_000 + items[1][1] + " pad" * 3)]
    return docs, items


def test_all_occurrences(spark, odd):
    got, want = both(spark, *odd)
    assert got == want and any("'short'" in x for x in want)


def test_slabs_and_pieces(spark, odd, monkeypatch):
    docs, items = odd
    got, want = both(spark, docs, items, slab_bytes=90)
    assert got == want
    monkeypatch.setattr(dc, "PIECE_BYTES", 40)
    long = items[0][1] + " " + items[1][1]
    b = pa.RecordBatch.from_pydict({"item": ["x"], "text": [long]})
    pieces = [t for p in dc._pieces([b]) for t in p.column(1).to_pylist()]
    tens = lambda t: {tuple(split(t)[i : i + 10]) for i in range(len(split(t)) - 9)}
    assert len(pieces) > 3 and set().union(*map(tens, pieces)) == tens(long)


def test_nothing(spark):
    assert both(spark, [], [("1", "a b")]) == ([], [])
    got, want = both(spark, [(1, "a b"), (2, None)], [])
    assert got == want


def test_equal_hashes_are_told_apart(monkeypatch):
    """Words that differ but share hashes neither match nor become one window."""
    real = dc.bw.words

    def coarse(*args):
        h, *rest = real(*args)
        return (h % np.uint64(2), *rest)

    monkeypatch.setattr(dc.bw, "words", coarse)
    rng = np.random.default_rng(5)
    items = [(str(i), " ".join(rng.choice(["aa", "bb", "cc", "dd"], 12))) for i in range(20)]
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"], 40)) + " " + items[i][1]) for i in range(20)]
    slab = dc.Slab(pa.table({"item": [i for i, _ in items], "text": [t for _, t in items]}))
    n, spans, found = slab.search(pa.array([t for _, t in docs]))
    want = brute(docs, items)
    assert found.to_pylist() == [w[4] for w in want] and n.to_pylist() == [w[1] for w in want]
    assert [[i for s in r for i in range(s["first"], s["last"] + 1)] for r in spans.to_pylist()] == [w[3] for w in want]
