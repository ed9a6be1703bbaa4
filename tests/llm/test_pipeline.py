"""The pipeline's stages against plainer code, each on what its predecessor kept."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronofold.llm import language_mixture, quality
from chronofold.llm.queries import VOCABULARY
from chronofold.llm.storage import written

SF = "/root/testdata/sf0.001"


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def stages(spark):
    """Input of the first stage and the output of all but the last."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(written(stage(spark, out[-1], SF), "test"))
        assert out[-1].columns == out[0].columns
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_language(stages):
    want = [r.doc_id for r in language_mixture.identify(stages[0]).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE]
    assert ids(stages[1]) == Counter(want)


def test_quality(spark, stages):
    scored = quality.score_quality(stages[1], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(stages[2]) == Counter(r.doc_id for r in scored if r.score >= corpus_pipeline.LEAST_QUALITY)


def test_near_duplicates(stages):
    rows = sorted((r.doc_id, shingles(r.text)) for r in stages[2].collect())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert ids(stages[3]) == Counter(i for i, a in rows if find(i) == i)


def test_mixing(stages):
    before, after = stages[3].collect(), ids(stages[4])
    size, source = {r.doc_id: len(words(r.text)) for r in before}, {r.doc_id: r.source for r in before}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target = set(order), {}
    while left:
        rest, over = sum(total.values()) - sum(target.values()), sum(weight[s] for s in left)
        level = {s: rest * weight[s] / over for s in left}
        full = {s: 3.0 * total[s] for s in left if level[s] > 3 * total[s]}
        target |= full or level
        left -= set(target)
    assert set(after) <= set(size)
    for s in order:
        mine = [i for i in size if source[i] == s]
        rate = target[s] / total[s] if total[s] else 0
        assert all(int(rate + 1e-9) * (size[i] > 0) <= after[i] <= min(3, int(rate + 1e-9) + 1) for i in mine)
        assert abs(sum(after[i] * size[i] for i in mine) - target[s]) <= max(size[i] for i in mine)


def test_tokens_and_the_whole_run(spark, stages):
    t, want = Tokenizer.from_file(VOCABULARY), []
    for r in stages[4].collect():
        found = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(found, skip_special_tokens=False)
        want.append((r.doc_id, len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)
